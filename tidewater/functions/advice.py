"""What to tell a seller about a contact, and the answers of judges, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first_meaningful, is_filled, stage_text

# Fixed values -------------------------------------------------------------------------------------------
DECIDERS = ("决策者", "决策层", "拍板者")
EXPERTS = ("技术把关", "技术评估者", "关键人")
WAY_WARM = "先电话或企微承接近期兴趣点，再约 30 分钟沟通"
WAY_DECIDER = "先发送价值摘要与ROI测算，再约 30 分钟决策沟通"
WAY_EXPERT = "先邮件发送结构化方案，再约 30 分钟技术评估沟通"
WAY_MAIL = "先邮件发送结构化方案，再约 30 分钟沟通"
WAY_PHONE = "先电话确认关注方向，再约 30 分钟沟通"
WAY_OTHER = "先通过客户经理确认触达方式，再安排 30 分钟沟通"
REASON = "联系人在%s影响成交节奏；近30天互动 %d 次，高价值行为 %d 次；"
NO_HISTORY, CLEAR_SIGNAL, SOME_BASIS = "暂缺历史行为，适合先做低干扰触达", "已有明确兴趣信号，适合优先推进", "已有互动基础，适合继续培育推进"
SCRIPT = "您好%s，结合贵司当前处于%s，我们建议先围绕“方案”做一次30分钟评估，现场会带上%s相关案例与ROI测算，若方向一致可在本周进入下一步评审。"
NO_NAME, NO_STAGE, NO_CASE = "该联系人", "当前阶段", "同类客户"
JUDGE_WEIGHTS = {"rule": 0.5, "evidence": 0.5}
UNREADABLE = "Could not parse LLM output; fallback score"
# ---------------------------------------------------------------------------------------------------------


def stage_of(*stages: Column) -> Column:
    """The first stage that says anything, in the words of a conversation."""
    return stage_text(first_meaningful(*stages, default=NO_STAGE))


def case_of(industry: Column, product: Column, campaign: Column) -> Column:
    """Whose cases to show: industry and product, or the first of them that is there, or the campaign."""
    both = F.when(is_filled(F.trim(industry)) & is_filled(product), F.concat(F.trim(industry), product))
    return F.coalesce(both, first_meaningful(industry, product, campaign, default=NO_CASE))


def way(role: Column, recent: Column, high_value: Column, email: Column, mobile: Column) -> Column:
    """How to approach a contact: by what it did lately, its role, and the ways it can be reached."""
    warm = (F.coalesce(high_value, F.lit(0)) > 0) | (F.coalesce(recent, F.lit(0)) >= 3)
    there = lambda c: F.coalesce(is_filled(c), F.lit(False))
    return (
        F.when(warm, WAY_WARM)
        .when(role.isin(*DECIDERS), WAY_DECIDER)
        .when(role.isin(*EXPERTS), WAY_EXPERT)
        .when(there(email), WAY_MAIL)
        .when(there(mobile), WAY_PHONE)
        .otherwise(WAY_OTHER)
    )


def reason(stage: Column, recent: Column, high_value: Column) -> Column:
    """Why to talk to a contact now; stage as of stage_of."""
    said = F.when((high_value == 0) & (recent == 0), NO_HISTORY).when(high_value > 0, CLEAR_SIGNAL).otherwise(SOME_BASIS)
    return F.concat(F.format_string(REASON, stage, recent, high_value), said)


def script(name: Column, stage: Column, case: Column) -> Column:
    """What to say first."""
    return F.format_string(SCRIPT, F.coalesce(F.nullif(name, F.lit("")), F.lit(NO_NAME)), stage, case)


def judged(answer: Column, rule: Column, evidence: Column) -> Column:
    """(score, explanation) of a judge's answer `score | explanation`, the score within 0 and 1; without a bar the first word is
    the score; the mean of rule and evidence scores (0 to 100) where there is no number."""
    text = F.trim(F.coalesce(answer, F.lit("")))
    bar = F.instr(text, "|")
    first = F.when(bar > 0, F.trim(F.substring(text, F.lit(1), bar - 1))).otherwise(F.regexp_extract(text, r"^\S*", 0))
    number = F.when(first == "", F.when(bar > 0, None).otherwise(0.0)).otherwise(first.try_cast("double"))
    proxy = (JUDGE_WEIGHTS["rule"] * rule + JUDGE_WEIGHTS["evidence"] * evidence) / 100.0
    rest = F.when(bar > 0, F.trim(F.substring(text, bar + 1, F.length(text)))).otherwise(text)
    score = F.when(number.isNull(), proxy).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))
    return F.struct(score.alias("score"), F.when(number.isNull(), UNREADABLE).otherwise(rest).alias("explanation"))


def realised(won: Column, *budgets: Column) -> Column:
    """What was won in whole percent of the sum of budgets; 0 without a budget."""
    total = sum((F.coalesce(b, F.lit(0)) for b in budgets), F.lit(0))
    return F.when(total != 0, F.floor(F.coalesce(won, F.lit(0)) / total * 100 + 0.5)).otherwise(0).cast("int")
