"""Filters as lists of predicates, and the compiler of filter dictionaries."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CHANNELS, OTHER_CHANNEL, OTHER_REGION, REGION_SUFFIX, REGIONS, channel_of_words


def both(parts: list[Column]) -> Column:
    """All of the predicates; true for none."""
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def either(parts: list[Column]) -> Column:
    """Any of the predicates; false for none."""
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def equals(c: Column, value: Any) -> list[Column]:
    """No predicate without a value; membership for a list."""
    if value is None or value == "":
        return []
    return [c.isin(*value)] if isinstance(value, (list, tuple, set)) else [c == value]


def contains(c: Column, word: str | None) -> list[Column]:
    return [F.lower(c).contains(word.lower())] if word else []


def contains_any(cols: list[Column], words: list[str]) -> Column:
    return either([F.coalesce(F.lower(c).contains(w.lower()), F.lit(False)) for c in cols for w in words])


def at_least(c: Column, value: Any) -> list[Column]:
    return [] if value is None else [c >= value]


def name_is(c: Column, value: str) -> Column:
    """A short name (four characters at most) or one with a wildcard is a pattern, others are exact."""
    return c.like(value if "%" in value else f"%{value}%") if len(value) <= 4 or "%" in value else c == value


def date_window(c: Column, start: str | None, end: str | None) -> list[Column]:
    """From start to the end of the day end; a bound that isn't a date counts for nothing."""
    parts = []
    if day := _day(start):
        parts.append(c >= F.lit(day.isoformat()).cast("timestamp_ntz"))
    if day := _day(end):
        parts.append(c < F.lit((day + timedelta(days=1)).isoformat()).cast("timestamp_ntz"))
    return parts


def text_window(c: Column, start: str | None, end: str | None) -> list[Column]:
    """From start, as it stands, to the end of the day end; an end that isn't a plain date is taken as it stands, too. What is no
    time at all is after nothing and before nothing."""
    at = lambda text: F.lit(text).try_cast("timestamp_ntz")
    parts = []
    if start:
        parts.append(c >= at(start))
    if end:
        try:
            day = datetime.strptime(end, "%Y-%m-%d").date() + timedelta(days=1)
            parts.append(c < at(day.isoformat()))
        except ValueError:
            parts.append(c < at(end))
    return parts


def _day(text: str | None) -> date | None:
    try:
        return datetime.strptime((text or "")[:10], "%Y-%m-%d").date()
    except ValueError:
        return None


def last_days(c: Column, as_of: Column, days: int) -> Column:
    return c >= as_of - F.expr(f"INTERVAL {int(days)} DAYS")


def last_months(c: Column, as_of: Column, months: int) -> Column:
    return c >= as_of - F.expr(f"INTERVAL {int(months)} MONTHS")


def region_is(c: Column, option: str) -> Column:
    """A region option: with or without the suffix; the others are empty or none of the options."""
    if option != OTHER_REGION:
        return c.isin(option, option + REGION_SUFFIX)
    known = [v for r in REGIONS[:-1] for v in (r, r + REGION_SUFFIX)]
    return c.isNull() | (c == "") | ~c.isin(*known)


def attribute_is(c: Column, kind: str) -> list[Column]:
    """heavy, or non_heavy (null included)."""
    return [c == "H"] if kind == "heavy" else [c.isNull() | (c != "H")] if kind == "non_heavy" else []


def channel_is(c: Column, code: str) -> Column:
    """A channel by its stored values; the others are non-empty and none of these."""
    if code in CHANNELS:
        return c.isin(*CHANNELS[code])
    if code == OTHER_CHANNEL:
        return c.isNotNull() & (F.trim(c) != "") & ~c.isin(*[v for vs in CHANNELS.values() for v in vs])
    return c == code


def matching(df: DataFrame, other: DataFrame, on: dict[str, str], keep: bool = True) -> DataFrame:
    """Rows of df with (or without) a match in other; on: column of df to column of other."""
    right = other.select(*[F.col(r).alias(f"__{r}") for r in on.values()])
    return df.join(right, both([F.col(k) == F.col(f"__{r}") for k, r in on.items()]), "left_semi" if keep else "left_anti")


def with_at_least(df: DataFrame, key: str, n: int) -> DataFrame:
    """Keys with n rows or more."""
    return df.groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") >= n).select(key)


# The compiler of filter dictionaries ----------------------------------------------------------------------


@dataclass
class Compiled:
    """A predicate, an order and, for questions about customers by their interactions, the inner condition."""

    where: Column
    order: list[Column] = field(default_factory=list)
    inner: Column | None = None
    inner_min: int | None = None


def _same(c: str):
    return lambda v, as_of: equals(F.col(c), v)


def _like(c: str):
    return lambda v, as_of: contains(F.col(c), v)


def _least(c: str):
    return lambda v, as_of: at_least(F.col(c), v)


def _named(c: str):
    return lambda v, as_of: [name_is(F.col(c), v)] if v else []


def _since(c: str):
    return lambda v, as_of: [last_days(F.col(c), as_of, v)] if v is not None else []


def _words(*cols: str):
    return lambda v, as_of: [contains_any([F.col(c) for c in cols], [v] if isinstance(v, str) else list(v))] if v else []


def _channel(c: str):
    return lambda v, as_of: [F.col(c) == channel_of_words(F.lit(v))] if v else []


FIELDS = {
    "customer_360": {
        "customer_name": _named("customer_name"), "keyword": _words("customer_name", "industry", "owner_name"), "industry": _same("industry"), "region": _same("region"),
        "owner_name": _like("owner_name"), "purchase_stage": _same("purchase_stage"), "forecast_type": _same("forecast_type"), "role_coverage": _same("role_coverage"),
        "intent_score": _least("intent_score"), "intent_level": _same("intent_level"), "interaction_count_30d": _least("interaction_count_30d"),
        "interaction_count_total": _least("interaction_count_total"), "channel": _channel("last_interaction_channel"), "last_interaction_days": _since("last_interaction_time"),
        "active_opp_count": _same("active_opp_count"), "active_opp_count_min": _least("active_opp_count"), "active_opp_amount": _least("active_opp_amount"),
        "contact_count": _same("contact_count"), "contact_count_min": _least("contact_count"), "is_existing_customer": _same("is_existing_customer"),
    },
    "contact_360": {
        "contact_name": _like("contact_name"), "mobile": _same("mobile"), "department": _like("department"), "position": _like("position"), "role_category": _same("role_category"),
        "activity_level": _same("activity_level"), "intent_level": _same("intent_level"), "interaction_count_30d": _least("interaction_count_30d"), "last_interaction_days": _since("last_interaction_time"),
    },
    "contact_mapping": {
        "customer_name": _named("customer_name"), "contact_name": _like("contact_name"), "mobile": _same("mobile"), "email": _like("email"), "department": _like("department"),
        "position": _like("position"), "role_category": _same("role_category"), "source_table": _same("source_table"),
    },
    "interaction_detail": {
        "customer_name": _named("customer_name"), "contact_name": _like("contact_name"), "channel": _channel("channel"), "behavior_type": _like("behavior_type"), "content": _like("content"),
        "source_table": _same("source_table"), "is_high_value": _same("is_high_value"), "last_interaction_days": _since("event_time"),
    },
}
ORDERS = {"customer_360": "intent_score", "interaction_detail": "event_time"}
_INNER = ("channel", "behavior_type", "content", "last_interaction_days")


def compile_filter(asked: dict[str, Any], table: str, as_of: Column) -> Compiled:
    """A filter dictionary over one of the four tables. Unknown keys are ignored.

    `_distinct_customer` over interactions asks for customers by their interactions (at least `interaction_min` of
    them); `interaction_min` never filters a count of the customer table."""
    asked = dict(asked)
    least, distinct = asked.pop("interaction_min", None), asked.pop("_distinct_customer", False)
    start, end = asked.pop("event_time_start", None), asked.pop("event_time_end", None)
    window = text_window(F.col("event_time"), start, end)
    inner = None
    if distinct and table == "interaction_detail":
        fields = FIELDS[table]
        inner = both([p for k in _INNER if k in asked for p in fields[k](asked[k], as_of)] + window)
        table, window = "customer_360", []
    elif table != "interaction_detail":
        window = []
    parts = [p for k, v in asked.items() if k in FIELDS[table] for p in FIELDS[table][k](v, as_of)] + window
    order = [F.col(ORDERS[table]).desc()] if asked and table in ORDERS else []
    return Compiled(both(parts), order, inner, least)


def run_filter(tables: dict[str, DataFrame], asked: dict[str, Any], table: str, as_of: Column) -> DataFrame:
    """The rows that a filter dictionary asks for."""
    c = compile_filter(asked, table, as_of)
    if c.inner is not None:
        found = tables["interaction_detail"].filter(c.inner)
        names = with_at_least(found, "customer_name", c.inner_min or 1)
        rows = matching(tables["customer_360"].filter(c.where), names, {"customer_name": "customer_name"})
    else:
        rows = tables[table].filter(c.where)
    return rows.orderBy(*c.order) if c.order else rows


# What tells the table that a question is about -------------------------------------------------
INTERACTION_KEYS = ("channel", "behavior_type", "content", "is_high_value", "event_time", "event_time_start", "event_time_end")
CONTACT_KEYS = ("contact_name", "mobile", "email", "department", "position", "purchase_role", "role_category")
INTERACTION_WORDS = ("互动", "行为", "访问", "点击", "邮件", "直播", "活动", "渠道", "邮箱互动", "邮件互动", "官网访问", "web互动")
CONTACT_WORDS = ("联系人", "手机号", "邮箱", "决策人", "采购角色", "部门", "职位", "电话", "手机", "电话号码", "联系方式")
TITLES = r"\w+(经理|总|先生|女士|姐|哥)"
# ---------------------------------------------------------------------------------------------------------


def table_for(asked: dict[str, Any], question: str) -> str:
    """Which table a question is about: by its fields, then by words, then by a name with a title."""
    if any(k in asked for k in INTERACTION_KEYS):
        return "interaction_detail"
    if any(k in asked for k in CONTACT_KEYS):
        return "contact_360" if "customer_id" in asked or "interaction_count" in question.lower() else "contact_mapping"
    if any(w in question for w in INTERACTION_WORDS):
        return "interaction_detail"
    if any(w in question for w in CONTACT_WORDS) or re.search(TITLES, question):
        return "contact_360"
    return "customer_360"


@dataclass
class ContactFilter:
    text: str | None = None
    role: str | None = None
    stage: str | None = None
    interaction_min: int | None = None
    #: recent, high or any.
    history: str | None = None
    vip: bool = False


VIP_ROLES = ("拍板者", "决策者")
HISTORY = {"recent": lambda: F.col("last_interaction_time").isNotNull(), "high": lambda: F.coalesce(F.col("high_value"), F.lit(0)) > 0, "any": lambda: F.coalesce(F.col("interaction_count"), F.lit(0)) > 0}


def contact_conditions(f: ContactFilter) -> list[Column]:
    """Over contacts with contact_name, mobile, position, department, role, purchase_stage, counts and last_interaction_time."""
    c = F.col
    parts = []
    if f.text:
        parts.append(contains_any([c("contact_name"), c("position"), c("department")], [f.text]) | F.coalesce(c("mobile").contains(f.text), F.lit(False)))
    parts += equals(c("role"), f.role) + equals(c("purchase_stage"), f.stage)
    if f.interaction_min:
        counted = F.coalesce(F.nullif(c("interaction_count"), F.lit(0)), c("interaction_count_30d"), F.lit(0))
        parts.append(counted >= f.interaction_min)
    if f.history in HISTORY:
        parts.append(HISTORY[f.history]())
    return parts + ([c("role").isin(*VIP_ROLES)] if f.vip else [])
