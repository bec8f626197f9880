"""What the customer pages ask for: lists, facets, details, contacts, timelines, exports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import advice, scoring, text
from ..operators import predicates as p
from ..operators.merge import latest, page, top
from ..operators.substrings import first_containing

SORTS = ("intent_score", "customer_name", "interaction_count_30d", "interaction_count_total", "last_interaction_time", "active_opp_amount", "contact_count", "updated_at")
KEY_ACCOUNT_TAG = "重客"


@dataclass
class CustomerFilter:
    keyword: str | None = None
    industry: str | None = None
    region: str | None = None
    region_keyword: str | None = None
    owner: str | None = None
    owner_keyword: str | None = None
    stage: str | None = None
    intent_level: str | None = None
    interaction_min: int | None = None
    interaction_period: int = 30
    attribute: str | None = None
    channel: str | None = None
    sort: str | None = None
    page: int = 1
    size: int = 20
    #: Variants as users see them documented: counts of the aggregate, the last channel.
    documented: bool = False


def conditions(f: CustomerFilter, has_attribute: bool = True) -> list[Column]:
    c = F.col
    parts = p.contains(c("customer_name"), f.keyword) + p.equals(c("industry"), f.industry) + p.equals(c("purchase_stage"), f.stage) + p.equals(c("intent_level"), f.intent_level)
    parts += [p.region_is(c("region"), f.region)] if f.region else p.contains(c("region"), f.region_keyword)
    parts += p.equals(c("owner_name"), f.owner) if f.owner else p.contains(c("owner_name"), f.owner_keyword)
    if f.attribute and has_attribute:
        parts += p.attribute_is(c("attribute"), f.attribute)
    if f.documented:
        parts += p.at_least(c("interaction_count_30d"), f.interaction_min) + ([p.channel_is(c("last_interaction_channel"), f.channel)] if f.channel else [])
    return parts


def _by_interactions(rows: DataFrame, detail: DataFrame, f: CustomerFilter, as_of: Column) -> DataFrame:
    if f.documented:
        return rows
    if f.interaction_min is not None:
        recent = detail.filter(p.last_days(F.col("event_time"), as_of, f.interaction_period))
        rows = p.matching(rows, p.with_at_least(recent, "customer_name", f.interaction_min), {"customer_name": "customer_name"})
    if f.channel:
        rows = p.matching(rows, detail.filter(p.channel_is(F.col("channel"), f.channel)), {"customer_name": "customer_name"})
    return rows


def order_of(sort: str | None) -> Column:
    name, _, way = (sort or "").strip().partition(" ")
    c = F.col(name if name in SORTS else "intent_score")
    return c.asc_nulls_first() if way.strip().upper() == "ASC" else c.desc_nulls_last()


def customer_rows(customers: DataFrame, detail: DataFrame, f: CustomerFilter, as_of: Column) -> DataFrame:
    """All rows of a customer list."""
    return _by_interactions(customers.filter(p.both(conditions(f))), detail, f, as_of)


def customer_list(customers: DataFrame, detail: DataFrame, f: CustomerFilter, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(total, page) of a customer list."""
    rows = customer_rows(customers, detail, f, as_of)
    return rows.agg(F.count("*").alias("total")), page(rows, [order_of(f.sort), F.col("customer_name")], f.page, min(max(f.size, 1), 100))


def snapshot(accounts: DataFrame) -> DataFrame:
    """The newest snapshot of key accounts (code, name, time)."""
    return accounts.filter(F.col("time") == accounts.agg(F.max("time").alias("t")).scalar())


def key_account_rows(accounts: DataFrame, customers: DataFrame) -> DataFrame:
    """The newest key accounts with the profile they have, if any."""
    c = customers.withColumnRenamed("customer_name", "__name")
    return snapshot(accounts).select("code", F.col("name").alias("customer_name")).join(c, F.col("customer_name") == F.col("__name"), "left").withColumn("campaign_tag", F.lit(KEY_ACCOUNT_TAG)).withColumn("matched", F.col("__name").isNotNull()).drop("__name")


def key_accounts(accounts: DataFrame, customers: DataFrame, detail: DataFrame, f: CustomerFilter, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(total, page) of key accounts: those with a profile first. The attribute filter doesn't apply to them."""
    rows = _by_interactions(key_account_rows(accounts, customers).filter(p.both(conditions(f, has_attribute=False))), detail, f, as_of)
    return rows.agg(F.count("*").alias("total")), page(rows, [(~F.col("matched")).asc(), order_of(f.sort), F.col("customer_name"), F.col("code")], f.page, min(max(f.size, 1), 100))


def facets(customers: DataFrame, detail: DataFrame) -> DataFrame:
    """(facet, value, ord): filter options; regions and channels in business order, others by value."""
    plain = [customers.select(F.lit(c).alias("facet"), F.trim(c).alias("value")).filter(p.both([text.is_filled(F.col("value"))])).distinct().withColumn("ord", F.lit(0)) for c in ("industry", "owner_name", "purchase_stage", "intent_level")]
    place = lambda c, names: F.array_position(F.array(*[F.lit(n) for n in names]), c).cast("int")
    region = customers.select(F.lit("region").alias("facet"), text.normalize_region(F.col("region")).alias("value")).filter("value IS NOT NULL").distinct()
    channel = detail.select(F.lit("channel").alias("facet"), text.normalize_channel(F.col("channel")).alias("value")).filter(F.col("value") != text.NO_CHANNEL).distinct()
    ordered = [region.withColumn("ord", place(F.col("value"), text.REGIONS)), channel.withColumn("ord", place(F.col("value"), [*text.CHANNELS, text.OTHER_CHANNEL]))]
    out = plain[0]
    for more in [*plain[1:], *ordered]:
        out = out.unionByName(more)
    return out


def statistics(customers: DataFrame) -> DataFrame:
    """Sums of a customer list's counts, nulls as 0."""
    names = ("interaction_count_30d", "interaction_count_total", "contact_count", "mobile_count", "active_opp_count", "funnel_opp_count")
    return customers.agg(F.count("*").alias("customers"), *[F.coalesce(F.sum(F.coalesce(n, F.lit(0))), F.lit(0)).alias(n) for n in names])


def statistics_by_name(customers: DataFrame, name: str) -> DataFrame:
    """The customer of a name, else the first whose name contains it."""
    hit = customers.filter((F.col("customer_name") == name) | F.col("customer_name").contains(name))
    return hit.orderBy((F.col("customer_name") != name).asc(), "customer_name").limit(1)


def customer_detail(customers: DataFrame, detail: DataFrame, crm: DataFrame, name: str, as_of: Column) -> DataFrame:
    """A customer with its live count of 30 days and the last visit over its CRM contacts."""
    live = detail.filter((F.col("customer_name") == name) & p.last_days(F.col("event_time"), as_of, 30)).agg(F.count("*").alias("live_30d"))
    visit = crm.filter(F.col("customer_name") == name).agg(F.max("last_visit_time").alias("last_visit"), F.min("not_visit_days").alias("days_unvisited"))
    return customers.filter(F.col("customer_name") == name).withColumns({"live_30d": live.scalar(), "last_visit": visit.select("last_visit").scalar(), "days_unvisited": visit.select("days_unvisited").scalar()})


def contacts_of(contacts: DataFrame, mapping: DataFrame, detail: DataFrame, customers: DataFrame, name: str) -> DataFrame:
    """Contacts of a customer with preferred channel and high-value interactions; from the mapping if contact 360 has none."""
    c = F.col
    own = contacts.filter(c("customer_name") == name)
    spare = mapping.filter(c("customer_name") == name).select(*[F.col(x) if x in mapping.columns else F.lit(None).cast(own.schema[x].dataType).alias(x) for x in own.columns])
    rows = own.unionByName(spare.filter(own.agg(F.count("*")).scalar() == 0))
    d = detail.filter(c("customer_name") == name)
    g = d.groupBy("contact_name", "mobile", "channel").agg(F.count("*").alias("n"), F.max("event_time").alias("t"))
    best = latest(g, ["contact_name", "mobile"], [c("n").desc(), c("t").desc(), c("channel")]).select(c("contact_name").alias("__c"), c("mobile").alias("__m"), c("channel").alias("preferred_channel"))
    high = d.groupBy(c("contact_name").alias("__c2"), c("mobile").alias("__m2")).agg(F.sum("is_high_value").alias("high_value"))
    profile = customers.filter(c("customer_name") == name)
    out = rows.join(best, c("contact_name").eqNullSafe(c("__c")) & c("mobile").eqNullSafe(c("__m")), "left").join(high, c("contact_name").eqNullSafe(c("__c2")) & c("mobile").eqNullSafe(c("__m2")), "left")
    return out.drop("__c", "__m", "__c2", "__m2").withColumns({"high_value": F.coalesce("high_value", F.lit(0)), "customer_stage": profile.agg(F.min("purchase_stage")).scalar(), "customer_intent": profile.agg(F.min("intent_level")).scalar()})


def timeline(detail: DataFrame, name: str, most: int = 50) -> DataFrame:
    return page(detail.filter(F.col("customer_name") == name), [F.col("event_time").desc_nulls_last(), F.col("source_table"), F.col("source_id")], 1, min(max(most, 1), 500))


def opportunities_of(opps: DataFrame, name: str) -> DataFrame:
    return opps.filter(F.col("customer_name") == name).orderBy(F.col("create_date").desc_nulls_last(), "id")


def priority_contacts(contacts: DataFrame, as_of: Column, n: int = 3) -> DataFrame:
    """The contacts of each customer to talk to first, with the parts of their score."""
    from pyspark.sql.window import Window

    c = F.col
    most = F.max(F.coalesce("interaction_count_30d", F.lit(0))).over(Window.partitionBy("customer_name"))
    rows = contacts.withColumn("__most", most)
    role = F.coalesce(F.nullif(c("role_category"), F.lit("")), c("purchase_role"))
    parts = scoring.contact_parts(role, c("interaction_count_30d"), c("__most"), scoring.days_since(as_of, c("last_interaction_time")), c("mobile"), c("email"), c("department"), c("position"), c("intent_level") if "intent_level" in contacts.columns else F.lit(None).cast("string"))
    rows = rows.withColumn("rule_score", scoring.contact_score(parts, c("activity_level"))).drop("__most")
    return top(rows, ["customer_name"], [c("rule_score").desc(), c("contact_name").asc_nulls_last(), c("mobile").asc_nulls_last()], n)


def priority_texts(contacts: DataFrame, customers: DataFrame, detail: DataFrame, as_of: Column, n: int = 3) -> DataFrame:
    """The contacts of each customer to talk to first, with their high-value interactions (by name, else by mobile) and why, how and
    with what words to approach them."""
    c = F.col
    first = priority_contacts(contacts, as_of, n)
    high = detail.filter("is_high_value = 1")
    by_name = high.groupBy(c("customer_name").alias("__c"), c("contact_name").alias("__n")).agg(F.count("*").alias("__by_name"))
    by_mobile = high.groupBy(c("customer_name").alias("__d"), c("mobile").alias("__m")).agg(F.count("*").alias("__by_mobile"))
    known = customers.select(c("customer_name").alias("__e"), "industry", "purchase_stage", "forecast_type")
    rows = (
        first.join(by_name, (c("customer_name") == c("__c")) & (c("contact_name") == c("__n")), "left")
        .join(by_mobile, (c("customer_name") == c("__d")) & (c("mobile") == c("__m")), "left")
        .join(known, c("customer_name") == c("__e"), "left")
    )
    named, reached = F.coalesce(text.is_filled(c("contact_name")), F.lit(False)), F.coalesce(text.is_filled(c("mobile")), F.lit(False))
    count = F.coalesce(F.when(named, c("__by_name")).when(reached, c("__by_mobile")), F.lit(0))
    recent = F.coalesce("interaction_count_30d", F.lit(0))
    role = F.coalesce(F.nullif(c("role_category"), F.lit("")), c("purchase_role"), F.lit(""))
    stage = advice.stage_of(c("purchase_stage"), c("forecast_type"))
    case = advice.case_of(c("industry"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return rows.select(
        "customer_name", "contact_name", "mobile", "rank", "rule_score", count.alias("high_value_count"),
        advice.reason(stage, recent, count).alias("reason"), advice.way(role, recent, count, c("email"), c("mobile")).alias("recommend_way"),
        advice.script(c("contact_name"), stage, case).alias("recommend_script"),
    )


def top_stage(opps: DataFrame, key: str, stage: Column, none: str = "暂无数据") -> DataFrame:
    """(key, stage): the most frequent stage of each customer's opportunities; of equally frequent ones the first by name."""
    named = opps.select(key, F.coalesce(F.nullif(stage, F.lit("")), F.lit(none)).alias("stage"))
    counts = named.groupBy(key, "stage").agg(F.count("*").alias("n"))
    return latest(counts, [key], [F.col("n").desc(), F.col("stage")]).select(key, "stage")


def top_channels(rows: DataFrame, key: str, channel: str = "channel", n: int = 2) -> DataFrame:
    """(key, channels): the n channels that a customer used most, as they are shown; of equally frequent ones the first by name.
    Rows without a channel don't count; a customer with none has no row."""
    counts = rows.filter(F.col(channel) != "").groupBy(key, channel).agg(F.count("*").alias("n"))
    best = top(counts, [key], [F.col("n").desc(), F.col(channel)], n)
    shown = text.pick(F.col(channel), text.CHANNEL_LABELS, F.col(channel))
    first = F.sort_array(F.collect_list(F.struct("rank", shown.alias("label"))))
    return best.groupBy(key).agg(F.transform(first, lambda x: x["label"]).alias("channels"))


def enriched(names: DataFrame, customers: DataFrame, columns: list[str]) -> DataFrame:
    """names (name) with columns of their customer: by the exact name, and the others by the first customer whose name contains
    theirs, which an index of n-grams finds however many they are."""
    c = F.col
    there = customers.select("customer_name", *columns)
    exact = names.join(there, c("name") == c("customer_name"), "left")
    rest = names.join(there.select("customer_name"), c("name") == c("customer_name"), "left_anti")
    first = first_containing(rest, there, "name", "customer_name").select(c("word").alias("__word"), c("name").alias("__name"))
    like = rest.join(first, c("name") == c("__word"), "left").join(there, c("__name") == c("customer_name"), "left").drop("__word", "__name")
    return exact.filter(c("customer_name").isNotNull()).unionByName(like)
