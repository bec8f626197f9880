"""Scores of customers, contacts and name pairs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import pick

# Fixed values -------------------------------------------------------------------------------------------
ROLE_POINTS = {"决策者": 100, "决策层": 95, "关键人": 80, "拍板者": 90, "技术把关": 70, "技术评估者": 65, "使用者": 50, "影响者": 40, "采购": 45, "其他": 20}
INTENT_POINTS = {"高": 25, "中": 15, "低": 5}
#: Both sets of labels that are in use.
ACTIVITY_POINTS = {"高": 25, "medium": 25, "中": 15, "低": 5, "none": 0}
CONTACT_WEIGHTS = {"role": 0.35, "interaction": 0.25, "recency": 0.20, "completeness": 0.10, "intent": 0.10}
RECENCY_STEPS = ((7, 100), (30, 80), (90, 50), (180, 25))
NAME_WEIGHTS = {"levenshtein": 0.30, "contains": 0.25, "prefix": 0.10, "suffix": 0.10, "tokens": 0.25, "chars": 0.20}
FINAL_WEIGHTS = {"rule": 0.35, "evidence": 0.40, "proxy": 0.25}
AUTO_MERGE, REVIEW, RESCAN = 85, 35, 90
# ---------------------------------------------------------------------------------------------------------


def intent_score(n30: Column, open_opportunities: Column, contacts: Column) -> Column:
    """At most 100, from interactions, open opportunities and contacts; null if any of them is."""
    total = 2 * n30 + F.when(open_opportunities > 0, 20).otherwise(0) + F.when(contacts >= 3, 10).otherwise(3 * contacts)
    return F.when(total.isNull(), None).otherwise(F.least(F.lit(100), total)).cast("int")


def intent_level(n30: Column, total: Column, open_opportunities: Column) -> Column:
    return F.when((n30 >= 10) & (open_opportunities > 0), "高").when(n30 >= 3, "中").when(total > 0, "低").otherwise("无")


def activity_level(n30: Column, total: Column) -> Column:
    return F.when(n30 >= 10, "high").when(n30 >= 3, "medium").when(total > 0, "low").otherwise("none")


def days_since(as_of: Column, t: Column) -> Column:
    """Whole days of 24 hours."""
    return F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(t)) / 86400)


def contact_parts(role: Column, n30: Column, most_n30: Column, days: Column, mobile: Column, email: Column, department: Column, position: Column, intent: Column) -> dict[str, Column]:
    """The weighted parts of a contact's score, each to one decimal."""
    recency = F.when(days.isNull(), 0)
    for most, points in RECENCY_STEPS:
        recency = recency.when(days <= most, points)
    has = lambda c, p: F.when(c.isNotNull() & (c != ""), p).otherwise(0)
    points = {
        "role": pick(role, ROLE_POINTS, F.lit(20)),
        "interaction": F.least(F.lit(100.0), F.coalesce(n30, F.lit(0)) / F.greatest(most_n30, F.lit(1)) * 100),
        "recency": recency.otherwise(10),
        "completeness": has(mobile, 35) + has(email, 25) + has(department, 20) + has(position, 20),
        "intent": pick(intent, INTENT_POINTS, F.lit(10)) * 4,
    }
    return {k: F.round(v * CONTACT_WEIGHTS[k], 1) for k, v in points.items()}


def contact_score(parts: dict[str, Column], activity: Column) -> Column:
    return F.round(sum(parts.values(), F.lit(0.0)) + pick(activity, ACTIVITY_POINTS, F.lit(5)) * 0.05, 1)


def insight(intent: Column, recent: Column, funnel: Column) -> Column:
    """What the intent, the interactions of three months and the funnel say about a customer."""
    said = lambda *x: F.concat(*[v if isinstance(v, Column) else F.lit(v) for v in x])
    n, k = recent.cast("string"), funnel.cast("string")
    return F.array_compact(
        F.array(
            F.when(intent == "高", "客户处于高意向阶段，建议重点跟进").when(intent == "中", "客户处于中意向阶段，需要持续培育").when(intent == "低", "客户意向度较低，建议先进行市场教育"),
            F.when(recent > 10, said("客户近3个月互动活跃（", n, "次），购买信号强烈")).when(recent > 0, said("客户近3个月有", n, "次互动记录，保持跟进")).otherwise("客户近3个月暂无互动记录，建议主动触达"),
            F.when(funnel > 0, said("客户现有", k, "个漏斗内商机，需重点维护")),
        )
    )


def shared_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.least(F.length(a), F.length(b))).otherwise(first - 1)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets."""
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def name_score(a: Column, b: Column) -> Column:
    """Similarity of two normalised names, 0 to 100, to two decimals."""
    longest = F.greatest(F.length(a), F.length(b))
    w = NAME_WEIGHTS
    part = lambda hit, share: F.when(hit, share * 100).otherwise(0.0)
    total = (
        (1 - F.levenshtein(a, b) / longest) * 100 * w["levenshtein"]
        + part(b.contains(a), F.length(a) / F.length(b)) * w["contains"]
        + part(a.contains(b), F.length(b) / F.length(a)) * w["contains"]
        + shared_prefix(a, b) / longest * 100 * w["prefix"]
        + shared_prefix(F.reverse(a), F.reverse(b)) / longest * 100 * w["suffix"]
        + jaccard(F.split(a, " "), F.split(b, " ")) * 100 * w["tokens"]
        + jaccard(F.split(a, ""), F.split(b, "")) * 100 * w["chars"]
    )
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 100.0).otherwise(F.round(F.least(F.lit(100.0), total), 2))


def evidence_score(shared: Column) -> Column:
    return F.least(F.lit(100.0), 20.0 * shared)


def final_score(rule: Column, evidence: Column) -> Column:
    """With the mean of both in place of a judge."""
    w = FINAL_WEIGHTS
    return F.round(F.least(F.lit(100.0), w["rule"] * rule + w["evidence"] * evidence + w["proxy"] * (0.5 * rule + 0.5 * evidence)), 2)


def triage(final: Column) -> Column:
    return F.when(final > AUTO_MERGE, "auto_merged").when(final > REVIEW, "need_review")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)
