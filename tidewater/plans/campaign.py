"""The campaign dashboard over customers and their interactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import aggregates as agg
from ..operators import predicates as p
from ..operators.aggregates import percent, sections, share_of_total, with_default
from ..operators.merge import page

C = F.col
UNKNOWN_STAGE, UNKNOWN_FUNNEL, UNKNOWN_ROLES = "未知阶段", "未知", "0/4"
LAST_STAGE = "阶段6"


def scope(customers: DataFrame, campaign: str | None = None, industry: str | None = None) -> DataFrame:
    """Customers of a campaign and industry."""
    return customers.filter(p.both(p.equals(C("campaign_tag"), campaign) + p.equals(C("industry"), industry)))


def touches(detail: DataFrame, start: str | None = None, end: str | None = None, channel: str | None = None) -> DataFrame:
    return detail.filter(p.both(p.date_window(C("event_time"), start, end) + ([p.channel_is(C("channel"), channel)] if channel else [])))


def deal() -> Column:
    return (C("won_amount") > 0) | C("purchase_stage").contains(LAST_STAGE)


def kpis(customers: DataFrame, detail: DataFrame) -> DataFrame:
    """One row: total and active customers, opportunities, amount, customers with a deal."""
    seen = detail.select(C("customer_name").alias("__n")).distinct().withColumn("__seen", F.lit(True))
    rows = customers.join(seen, C("customer_name") == C("__n"), "left")
    return rows.agg(
        F.count_distinct("customer_name").alias("total_customers"), F.count_distinct(F.when(C("__seen"), C("customer_name"))).alias("active_customers"),
        F.coalesce(F.sum(F.coalesce(F.nullif(C("active_opp_count"), F.lit(0)), C("funnel_opp_count"), F.lit(0))), F.lit(0)).alias("opportunities"),
        F.coalesce(F.sum("active_opp_amount"), F.lit(0)).alias("amount"), F.count_distinct(F.when(deal(), C("customer_name"))).alias("deal_customers"),
    )


DIMENSIONS = {
    "funnel": lambda: with_default(C("forecast_type"), UNKNOWN_FUNNEL), "channel": lambda: text.normalize_channel(C("last_interaction_channel")),
    "roles": lambda: with_default(C("role_coverage"), UNKNOWN_ROLES), "stage": lambda: with_default(C("purchase_stage"), UNKNOWN_STAGE),
}


def distribution(customers: DataFrame, kind: str) -> DataFrame:
    """(label, n, share) of a dimension; shares of the sum of its groups. Dates and channels don't apply here."""
    return share_of_total(customers.groupBy(DIMENSIONS[kind]().alias("label")).agg(F.count("*").alias("n")), "n", "share")


def overview(customers: DataFrame, detail: DataFrame) -> DataFrame:
    """(section, label, n, active, deals, amount, share): the whole and every dimension, from one scan by grouping sets;
    shares of all customers."""
    seen = detail.select(C("customer_name").alias("__n")).distinct().withColumn("__seen", F.lit(True))
    rows = customers.join(seen, C("customer_name") == C("__n"), "left")
    out = sections(rows, {k: v() for k, v in DIMENSIONS.items()}, {"n": F.count_distinct("customer_name"), "active": F.count_if(C("__seen")), "deals": F.count_if(deal()), "amount": F.sum("active_opp_amount")})
    whole = out.filter("section = 'all'").select("n")
    return out.withColumn("share", percent(C("n"), whole.scalar()))


def signals(customers: DataFrame, most: int = 8) -> DataFrame:
    """The most frequent tags of customers."""
    none = F.lit(None).cast("array<string>")
    tags = text.customer_tags(C("campaign_tag"), C("attribute"), C("industry"), C("purchase_stage"), none, C("source_tables"))
    tags = F.coalesce(tags, F.filter(F.array(C("campaign_tag"), C("industry"), C("purchase_stage")), lambda x: x.isNotNull()))
    return customers.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(C("n").desc(), "tag").limit(most)


def content_effect(detail: DataFrame, most: int = 15) -> DataFrame:
    return page(agg.content_effect(detail), [C("touch_count").desc(), C("unique_customers").desc(), C("content"), C("behavior_type")], 1, most)


def followup(customers: DataFrame, stage: str | None = None, owner: str | None = None, keyword: str | None = None, number: int = 1, size: int = 20) -> DataFrame:
    """A page of customers to follow up, by stage number and score."""
    label = with_default(C("purchase_stage"), UNKNOWN_STAGE)
    rows = customers.withColumn("stage", label).filter(p.both(p.equals(C("stage"), stage) + p.contains(C("owner_name"), owner) + p.contains(C("customer_name"), keyword)))
    basis = text.followup_basis(C("last_interaction_time"), C("last_interaction_channel"), C("active_opp_amount"), C("interaction_count_total"))
    return page(rows.withColumn("basis", basis), [text.number_in_stage(C("stage")).asc_nulls_last(), C("stage"), C("intent_score").desc_nulls_last(), C("customer_name")], number, size)


def by_stage(rows: DataFrame) -> DataFrame:
    """The rows of a page as (stage, customers), which only a page is small enough for."""
    return rows.groupBy("stage").agg(F.array_sort(F.collect_list("customer_name")).alias("customers"))


def filter_options(customers: DataFrame, detail: DataFrame) -> DataFrame:
    """(option, value): campaigns, industries, channels, first and last day."""
    one = lambda df, n, c: df.select(F.lit(n).alias("option"), c.cast("string").alias("value")).filter("value IS NOT NULL AND value <> ''").distinct()
    days = detail.agg(F.min("event_time").alias("low"), F.max("event_time").alias("high"))
    out = one(customers, "campaign", C("campaign_tag")).unionByName(one(customers, "industry", C("industry"))).unionByName(one(detail, "channel", text.normalize_channel(C("channel"))))
    return out.unionByName(days.select(F.lit("start").alias("option"), F.date_format("low", "yyyy-MM-dd").alias("value"))).unionByName(days.select(F.lit("end").alias("option"), F.date_format("high", "yyyy-MM-dd").alias("value")))


def bootstrap(customers: DataFrame, detail: DataFrame, campaign: str | None = None, with_content: bool = True) -> dict[str, DataFrame]:
    """What the dashboard asks for first: options, key figures, the overview and, unless it comes later, content and signals."""
    rows = scope(customers, campaign)
    out = {"options": filter_options(customers, detail), "kpis": kpis(rows, detail), "overview": overview(rows, detail)}
    return out | ({"content": content_effect(detail), "signals": signals(rows)} if with_content else {})
