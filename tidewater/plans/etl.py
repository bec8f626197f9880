"""Source tables to contact mapping, interactions, customer 360 and contact 360.

Every step is a function of DataFrames and the pinned as_of; full and incremental loads use the same ones. Sources
come as a dict: zhique_contact, zhique_behavior, crm_contact, crm_opportunity, crm_lead, crm_opportunity_data,
marketing_lead, linkflow_contacts, linkflow_events, tianrun_session, key_customer. A missing one counts as empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..functions.text import filled, is_filled
from ..operators.aggregates import role_coverage
from ..operators.merge import first_wins, insert_missing, update_join
from ..sources.names import respelled
from ..sources.schemas import SOURCES, TABLES, conform
from ..sources.shared import stored

Tables = dict[str, DataFrame]


def source(tables: Tables, name: str, spark) -> DataFrame:
    """A source with all its columns; empty if it is missing."""
    return conform(tables[name], SOURCES[name]) if name in tables else spark.createDataFrame([], SOURCES[name])


def anchor(contacts: DataFrame) -> DataFrame:
    """The customers in scope: companies of the campaign's contacts."""
    return contacts.filter(is_filled(F.col("related_company"))).select(F.col("related_company").alias("customer_name")).distinct()


def crm_attributes(crm: DataFrame) -> DataFrame:
    return (
        crm.filter(is_filled(F.col("customer_name")))
        .groupBy("customer_name")
        .agg(
            F.max("industry").alias("industry"), F.max("sales_region").alias("region"), F.max("sales_name").alias("owner_name"), F.max("attribute").alias("attribute"),
            F.count_distinct("contact_name").cast("int").alias("contact_count"), F.count_distinct(F.when(is_filled(F.col("mobile")), F.col("mobile"))).cast("int").alias("mobile_count"),
        )
    )


def opportunity_metrics(opps: DataFrame) -> DataFrame:
    yuan = lambda when, amount: F.coalesce(F.sum(F.when(when, amount * 10000)), F.lit(0)).cast("decimal(22,2)")
    active, funnel = F.col("is_active") == 1, F.col("is_funnel") == "是"
    return (
        opps.filter(is_filled(F.col("customer_name")))
        .groupBy("customer_name")
        .agg(
            F.max("customer_stage").alias("purchase_stage"), F.max("forecast_type").alias("forecast_type"), F.count_if(active).cast("int").alias("active_opp_count"),
            yuan(active, F.col("amount_10k")).alias("active_opp_amount"), F.count_if(funnel).cast("int").alias("funnel_opp_count"),
            yuan(F.col("order_amount_10k") > 0, F.col("order_amount_10k")).alias("won_amount"),
        )
    )


def web_contacts(contacts: DataFrame, crm: DataFrame) -> DataFrame:
    """Web contacts whose mobile the CRM knows; of several customers the first by name."""
    known = crm.filter(is_filled(F.col("customer_name")) & is_filled(F.col("mobile"))).groupBy("mobile").agg(F.min("customer_name").alias("customer_name"))
    return contacts.join(known, F.col("mobile_phone") == F.col("mobile")).groupBy("contact_id").agg(F.min_by("customer_name", "id").alias("customer_name"), F.min_by("name", "id").alias("name"), F.min_by("mobile_phone", "id").alias("mobile_phone"), F.min_by("email", "id").alias("email"), F.min_by("title", "id").alias("title"), F.min_by("department", "id").alias("department"))


MAPPING = ("customer_name", "contact_name", "mobile", "email", "department", "position", "purchase_role", "role_category", "source_table", "linkflow_contact_id")


def _mapped(df: DataFrame, source_table: str, **cols: Column) -> DataFrame:
    kinds = {"linkflow_contact_id": "long"}
    return df.select(*[(cols.get(c, F.lit(source_table) if c == "source_table" else F.lit(None)).cast(kinds.get(c, "string"))).alias(c) for c in MAPPING])


def _only(df: DataFrame, only: DataFrame | None) -> DataFrame:
    """The rows of the customers in only (customer_name), if that is given."""
    if only is None:
        return df
    names = only.select(F.col("customer_name").alias("only_name"))
    return df.join(names, F.col("customer_name") == F.col("only_name"), "left_semi")


def contact_mapping(t: Tables, spark, only: DataFrame | None = None) -> DataFrame:
    """One row for each customer and mobile, from the first source that has it; contacts without a mobile all stay. only: the
    customers to compute."""
    zhique, crm = source(t, "zhique_contact", spark), source(t, "crm_contact", spark)
    icp, c = anchor(zhique), F.col
    own = _mapped(zhique.filter(is_filled(c("related_company"))), "zhique", customer_name=c("related_company"), contact_name=c("contact_name"), mobile=c("mobile"), email=c("email"), department=c("department"), position=c("position"))
    mobiles = zhique.filter(is_filled(c("mobile"))).select(c("mobile").alias("icp_mobile")).distinct()
    marked = (
        crm.filter(is_filled(c("customer_name")))
        .join(icp.select(c("customer_name").alias("icp_name")), c("customer_name") == c("icp_name"), "left")
        .join(mobiles, c("mobile") == c("icp_mobile"), "left")
        .filter(c("icp_name").isNotNull() | c("icp_mobile").isNotNull())
    )
    from_crm = _mapped(marked, "crm", customer_name=c("customer_name"), contact_name=c("contact_name"), mobile=c("mobile"), email=c("email"), department=c("department"), position=c("position"), purchase_role=c("purchase_role"), role_category=text.role_category(c("purchase_role")))
    lead = source(t, "marketing_lead", spark)
    company = F.coalesce("final_company_name", "customer_company", "opp_customer_name")
    leads = _mapped(lead.withColumn("company", company).filter(is_filled(c("company"))), "marketing", customer_name=c("company"), contact_name=c("customer_name"), mobile=c("contact_phone"), email=c("email"), position=c("lead_function")).distinct()
    web = web_contacts(source(t, "linkflow_contacts", spark), crm)
    from_web = _mapped(web, "linkflow", customer_name=c("customer_name"), contact_name=c("name"), mobile=c("mobile_phone"), email=c("email"), department=c("department"), position=c("title"), linkflow_contact_id=c("contact_id"))
    chats = source(t, "tianrun_session", spark).filter(is_filled(c("customer_name")) & is_filled(c("visitor_name")))
    from_chat = _mapped(chats, "tianrun", customer_name=c("customer_name"), contact_name=c("visitor_name")).distinct()
    parts = [_only(df, only) for df in (own, from_crm, leads, from_web, from_chat)]
    return first_wins(parts, ["customer_name", "mobile"], ["contact_name", "email", "department", "position"])


DETAIL = ("customer_name", "contact_name", "mobile", "source_table", "channel", "behavior_type", "content", "event_time", "is_high_value", "source_id")


def _detail(df: DataFrame, source_table: str, **cols: Column) -> DataFrame:
    kinds = {"event_time": "timestamp_ntz", "is_high_value": "int", "source_id": "long"}
    cols = {"is_high_value": F.lit(0)} | cols
    return df.select(*[(cols.get(c, F.lit(source_table) if c == "source_table" else F.lit(None)).cast(kinds.get(c, "string"))).alias(c) for c in DETAIL])


def interaction_detail(t: Tables, spark, only: DataFrame | None = None) -> DataFrame:
    """One row for each source and id of it, of all sources. only: the customers to compute."""
    c, zhique, crm = F.col, source(t, "zhique_contact", spark), source(t, "crm_contact", spark)
    icp = anchor(zhique).withColumnRenamed("customer_name", "icp_name")
    by_mobile = crm.filter(is_filled(c("customer_name")) & is_filled(c("mobile"))).groupBy(c("mobile").alias("crm_mobile")).agg(F.min("customer_name").alias("customer_name"))
    behaviours = source(t, "zhique_behavior", spark).join(by_mobile, c("mobile_phone") == c("crm_mobile"))
    own = _detail(behaviours, "zhique", customer_name=c("customer_name"), contact_name=c("contact_name"), mobile=c("mobile_phone"), channel=text.pick(c("behavior_type"), text.BEHAVIOUR_CHANNELS, "other"), behavior_type=c("behavior_type"), content=c("behavior_name"), event_time=c("behavior_time"), source_id=c("behavior_id"))
    chats = source(t, "tianrun_session", spark).filter(is_filled(c("customer_name")) & is_filled(c("visitor_name"))).join(icp, c("customer_name") == c("icp_name"), "left_semi")
    chat = _detail(chats, "tianrun", customer_name=c("customer_name"), contact_name=c("visitor_name"), channel=text.pick(c("contact_type_name"), text.SESSION_CHANNELS, "web"), behavior_type=F.coalesce(c("receive_type_name"), F.lit("online_chat")), content=F.coalesce(c("close_reason_name"), F.lit("")), event_time=F.timestamp_seconds("start_time_sec"), is_high_value=F.when(c("total_duration") > 60, 1).otherwise(0), source_id=c("id"))
    web = web_contacts(source(t, "linkflow_contacts", spark), crm).select(c("contact_id").alias("web_id"), "customer_name", "name", "mobile_phone")
    visits = source(t, "linkflow_events", spark).join(web, c("contact_id") == c("web_id"))
    visit = _detail(visits, "linkflow", customer_name=c("customer_name"), contact_name=c("name"), mobile=c("mobile_phone"), channel=F.lit("web"), behavior_type=c("event_name"), event_time=F.timestamp_millis("event_date_ms"), source_id=c("event_id"))
    day = lambda d: F.date_format(d, "yyyy-MM-dd")
    leads = source(t, "crm_lead", spark).filter(filled(c("company")).isNotNull() & c("obtained").isNotNull())
    lead = _detail(leads, "crm_lead", customer_name=filled(c("company")), contact_name=filled(c("person")), mobile=filled(c("phone")), channel=F.coalesce(filled(c("source_class")), F.lit("crm")), behavior_type=F.lit("线索"), content=F.coalesce(filled(c("activity")), filled(c("source_kind")), F.lit("")), event_time=c("obtained"), source_id=text.content_hash_id(c("lead_code"), c("company"), c("person"), c("phone"), day(c("obtained")), c("activity")))
    opps = source(t, "crm_opportunity_data", spark).filter(filled(c("customer")).isNotNull() & c("created").isNotNull())
    opp = _detail(opps, "crm_opportunity", customer_name=filled(c("customer")), contact_name=filled(c("owner")), channel=F.coalesce(filled(c("origin")), F.lit("crm")), behavior_type=F.lit("商机"), content=F.coalesce(filled(c("opp_name")), F.lit("")), event_time=c("created"), source_id=text.content_hash_id(c("opp_code"), c("customer"), c("opp_name"), day(c("created")), c("origin")))
    parts = [_only(df, only) for df in (own, chat, visit, lead, opp)]
    return first_wins(parts, ["source_table", "source_id"], ["customer_name", "event_time", "contact_name", "content"])


def customer_360(t: Tables, mapping: DataFrame, detail: DataFrame, as_of: Column, spark, only: DataFrame | None = None) -> DataFrame:
    """A row for each customer of the anchor, and for key customers that it lacks. only: names to compute."""
    c = F.col
    icp = anchor(source(t, "zhique_contact", spark))
    if only is not None:
        names = only.select(c("customer_name").alias("only_name")).distinct()
        icp = icp.join(names, c("customer_name") == c("only_name"), "left_semi")
    recent = c("event_time") >= as_of - F.expr("INTERVAL 30 DAYS")
    seen = detail.groupBy(c("customer_name").alias("d_name")).agg(
        F.count_if(recent).cast("int").alias("interaction_count_30d"), F.count("*").cast("int").alias("interaction_count_total"), F.max("event_time").alias("last_interaction_time"),
        F.min("channel").alias("last_interaction_channel"), F.max_by("channel", F.struct("event_time", "channel")).alias("latest_channel"), F.array_sort(F.collect_set("channel")).alias("top_channels"),
    )
    roles = mapping.groupBy(c("customer_name").alias("r_name")).agg(role_coverage(c("role_category"))["role_coverage"].alias("role_coverage"), F.array_sort(F.collect_set("source_table")).alias("source_tables"))
    crm = crm_attributes(source(t, "crm_contact", spark)).withColumnRenamed("customer_name", "a_name")
    opp = opportunity_metrics(source(t, "crm_opportunity", spark)).withColumnRenamed("customer_name", "o_name")
    none = F.array().cast("array<string>")
    zero = lambda n: F.coalesce(c(n), F.lit(0)).alias(n)
    out = (
        icp.join(seen, c("customer_name") == c("d_name"), "left").join(crm, c("customer_name") == c("a_name"), "left").join(opp, c("customer_name") == c("o_name"), "left").join(roles, c("customer_name") == c("r_name"), "left")
        .select(
            "customer_name", "industry", "region", "owner_name", "attribute", "purchase_stage", "forecast_type", F.coalesce("role_coverage", F.lit("无")).alias("role_coverage"),
            *map(zero, ("interaction_count_30d", "interaction_count_total", "contact_count", "mobile_count", "active_opp_count", "active_opp_amount", "funnel_opp_count", "won_amount")),
            "last_interaction_time", "last_interaction_channel", "latest_channel", F.coalesce("top_channels", none).alias("top_channels"), F.coalesce("source_tables", none).alias("source_tables"),
        )
    )
    out = (
        out.withColumn(
            "data_coverage",
            F.struct(
                c("industry").isNotNull().alias("has_crm"),
                (c("active_opp_count") > 0).alias("has_opp"),
                (c("contact_count") > 0).alias("has_contacts"),
                (c("interaction_count_total") > 0).alias("has_interactions"),
            ),
        )
        .withColumn("intent_score", scoring.intent_score(c("interaction_count_30d"), c("active_opp_count"), c("contact_count")))
        .withColumn("intent_level", scoring.intent_level(c("interaction_count_30d"), c("interaction_count_total"), c("active_opp_count")))
    )
    # key customers are matched by their own name; customer_name there is who is in charge of them
    key = (
        source(t, "key_customer", spark)
        .filter(is_filled(c("key_customer_name")))
        .select(
            c("key_customer_name").alias("customer_name"),
            c("customer_name").alias("owner_name"),
            c("industry_category").alias("industry"),
            c("department_level3").alias("region"),
            "attribute",
            "id",
        )
    )
    filled_in = ["owner_name", "industry", "region", "attribute"]
    if only is not None:
        key = key.join(names, c("customer_name") == c("only_name"), "left_semi")
    out = update_join(out, key, "customer_name", [*filled_in, "id"], ties=["id"]).drop("id")
    first = key.groupBy("customer_name").agg(*[F.min_by(n, "id").alias(n) for n in filled_in])
    missing = first.withColumns({n: F.lit(0) for n in ("interaction_count_30d", "interaction_count_total", "contact_count", "mobile_count", "active_opp_count", "funnel_opp_count", "intent_score")})
    out = insert_missing(out, conform(missing, out.schema), "customer_name", keys=icp)
    return conform(out, TABLES["customer_360"])


#: Parts over which contacts without a mobile are dealt, for many of them share a name.
NAMELESS = 16


def with_contacts(df: DataFrame, contacts: DataFrame, how: str, same: Column) -> DataFrame:
    """df (customer_name, contact_name, mobile) joined to contacts (k_name, k_mobile: one row each; and others) on the null-safe mobile
    and `same`. Rows without a mobile spread by their customer and meet a copy of the contact in each part."""
    c = F.col
    dealt = df.withColumn("__part", F.when(c("mobile").isNull(), F.pmod(F.xxhash64("customer_name"), F.lit(NAMELESS))).otherwise(0).cast("int"))
    parts = F.when(c("k_mobile").isNull(), F.sequence(F.lit(0), F.lit(NAMELESS - 1))).otherwise(F.array(F.lit(0)))
    on = same & c("mobile").eqNullSafe(c("k_mobile")) & (c("__part") == c("__k_part"))
    return dealt.join(contacts.withColumn("__k_part", F.explode(parts)), on, how).drop("__part", "__k_part")


def contact_360(mapping: DataFrame, detail: DataFrame, customers: DataFrame | None, icp: DataFrame, as_of: Column, keys: DataFrame | None = None) -> DataFrame:
    """A row for each customer in scope and mobile; interactions match on the contact's name and, null-safe, the mobile.
    customers (customer_name): those that customer 360 has, if it may lack some in scope. keys (contact_name, mobile): the contacts to compute."""
    c = F.col
    recent = c("event_time") >= as_of - F.expr("INTERVAL 30 DAYS")
    scope = mapping.join(icp.select(c("customer_name").alias("icp_name")), c("customer_name") == c("icp_name"), "left_semi")
    if customers is not None:
        scope = scope.join(customers.select(c("customer_name").alias("c_name")), c("customer_name") == c("c_name"), "left_semi")
    rows = first_wins([scope], ["customer_name", "mobile"], ["source_table", "contact_name", "email"])
    if keys is not None:
        detail, rows = (same_contact(df, keys, "left_semi") for df in (detail, rows))
    seen = detail.groupBy(c("contact_name").alias("k_name"), c("mobile").alias("k_mobile")).agg(
        F.count("*").cast("int").alias("interaction_count"), F.count_if(recent).cast("int").alias("interaction_count_30d"), F.max("event_time").alias("last_interaction_time")
    )
    out = with_contacts(rows, seen, "left", c("contact_name") == c("k_name"))
    n, n30 = F.coalesce("interaction_count", F.lit(0)), F.coalesce("interaction_count_30d", F.lit(0))
    new = {"interaction_count": n, "interaction_count_30d": n30, "activity_level": scoring.activity_level(n30, n), "source_tables": F.array("source_table")}
    return conform(out.withColumns(new), TABLES["contact_360"])


def run_full(t: Tables, as_of: Column, spark) -> Tables:
    """All four tables; the first two, which the others read more than once, are stored. Names that only case, accents or
    width tell apart are one customer."""
    (t,) = respelled(t, None)
    mapping, detail = stored(contact_mapping(t, spark), "contact_mapping"), stored(interaction_detail(t, spark), "interaction_detail")
    customers = customer_360(t, mapping, detail, as_of, spark)
    contacts = contact_360(mapping, detail, None, anchor(source(t, "zhique_contact", spark)), as_of)  # customer 360 has all of the anchor
    return {"contact_mapping": mapping, "interaction_detail": detail, "customer_360": customers, "contact_360": contacts}


def reached_mobiles(batch: Tables, t: Tables, spark) -> DataFrame | None:
    """(mobile) that a batch of source rows has, itself or by the web contacts of its visits; None if none of its sources has any."""
    c = F.col
    phones = {"zhique_contact": "mobile", "crm_contact": "mobile", "zhique_behavior": "mobile_phone", "linkflow_contacts": "mobile_phone"}
    mobiles = [source(batch, n, spark).select(c(col).alias("mobile")) for n, col in phones.items() if n in batch]
    if "linkflow_events" in batch:
        visitors = source(batch, "linkflow_events", spark).select(c("contact_id").alias("visitor")).distinct()
        web = source(t, "linkflow_contacts", spark).join(visitors, c("contact_id") == c("visitor"), "left_semi")
        mobiles.append(web.select(c("mobile_phone").alias("mobile")))
    return reduce(lambda a, b: a.unionByName(b), mobiles).filter(is_filled(c("mobile"))).distinct() if mobiles else None


def affected(before: Tables, batch: Tables, t: Tables, spark) -> DataFrame:
    """(customer_name) of the customers whose rows a batch of source rows can change: those it names, and those that its
    mobiles or web contacts lead to, now or before. Only the batch's own keys are looked up in the large tables."""
    c = F.col
    named = {
        "zhique_contact": "related_company", "crm_contact": "customer_name", "crm_opportunity": "customer_name", "crm_lead": "company",
        "crm_opportunity_data": "customer", "tianrun_session": "customer_name", "key_customer": "key_customer_name",
    }
    names = [source(batch, n, spark).select(F.trim(c(col)).alias("customer_name")) for n, col in named.items() if n in batch]
    names += [source(batch, n, spark).select(c(col).alias("customer_name")) for n, col in named.items() if n in batch]
    if "marketing_lead" in batch:
        company = F.coalesce("final_company_name", "customer_company", "opp_customer_name")
        names.append(source(batch, "marketing_lead", spark).select(company.alias("customer_name")))
    if (phones := reached_mobiles(batch, t, spark)) is not None:
        phone = phones.select(c("mobile").alias("phone"))
        for rows in (source(t, "crm_contact", spark), before["contact_mapping"], before["interaction_detail"]):
            names.append(rows.join(phone, c("mobile") == c("phone"), "left_semi").select("customer_name"))
    if not names:
        return spark.createDataFrame([], "customer_name string")
    return reduce(lambda a, b: a.unionByName(b), names).filter(is_filled(c("customer_name"))).distinct()


def fresh_rows(t: Tables, names: DataFrame, as_of: Column, spark) -> Tables:
    """Mapping, interactions (both stored) and customer 360 of the customers in names (customer_name)."""
    made = {"contact_mapping": contact_mapping(t, spark, names), "interaction_detail": interaction_detail(t, spark, names)}
    fresh = {k: stored(v, k) for k, v in made.items()}
    fresh["customer_360"] = customer_360(t, fresh["contact_mapping"], fresh["interaction_detail"], as_of, spark, only=names)
    return fresh


def _of(rows: DataFrame, names: DataFrame, how: str) -> DataFrame:
    return rows.join(names.select(F.col("customer_name").alias("n")), F.col("customer_name") == F.col("n"), how)


def contact_keys(before: Tables, fresh: Tables, names: DataFrame) -> DataFrame:
    """(contact_name, mobile) of interactions and contacts that came or went with the rows of names."""
    kinds = ("interaction_detail", "contact_mapping")
    gone = {k: _of(before[k], names, "left_semi") for k in kinds}
    return reduce(lambda a, b: a.unionByName(b), [x[k].select("contact_name", "mobile") for x in (gone, fresh) for k in kinds]).distinct()


def same_contact(df: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """df with how (left_semi or left_anti) the contacts of keys."""
    c = F.col
    one = keys.select(c("contact_name").alias("k_name"), c("mobile").alias("k_mobile")).distinct()
    return with_contacts(df, one, how, c("contact_name").eqNullSafe(c("k_name")))


def run_incremental(before: Tables, batch: Tables, t: Tables, as_of: Column, spark, names: DataFrame | None = None) -> Tables:
    """before: the four tables, as stored (without contact_360: that is rebuilt); t: the sources with the batch in them. The rows of the
    customers that the batch can reach are computed anew by the functions of the full load and replace the old ones; all
    others stay as they are, with the counts of their last load. A name that only case, accents or width tell from one already
    loaded is that customer. names: the affected customers, if they are stored already."""
    t, batch = respelled(t, before["customer_360"].select("customer_name"), batch)
    names = stored(affected(before, batch, t, spark), "affected") if names is None else names
    return replaced(before, t, names, fresh_rows(t, names, as_of, spark), as_of, spark)


def replaced(before: Tables, t: Tables, names: DataFrame, fresh: Tables, as_of: Column, spark) -> Tables:
    """before with the fresh rows of the customers in names in place of theirs, and contact 360 to match."""
    out = {k: _of(before[k], names, "left_anti").unionByName(fresh[k].select(*before[k].columns)) for k in fresh}
    icp = anchor(source(t, "zhique_contact", spark))
    # of the anchor customer 360 has the names, which are fresh, and those that it had before
    there = before["customer_360"].select("customer_name").unionByName(names.select("customer_name"))
    if "contact_360" not in before:
        return out | {"contact_360": contact_360(out["contact_mapping"], out["interaction_detail"], there, icp, as_of)}
    # contacts of the affected customers, and others that share a name and mobile with interactions that came or went
    keys = stored(contact_keys(before, fresh, names), "contact-keys")  # read three times
    again = contact_360(out["contact_mapping"], out["interaction_detail"], there, icp, as_of, keys)
    return out | {"contact_360": same_contact(before["contact_360"], keys, "left_anti").unionByName(again)}


def contact_index(mapping: DataFrame, detail: DataFrame) -> DataFrame:
    """(contact_name, mobile, customer_name): at which customers a contact occurs."""
    cols = ("contact_name", "mobile", "customer_name")
    return mapping.select(*cols).unionByName(detail.select(*cols)).distinct()


def publish_full(store, version: str, t: Tables, as_of: Column, spark, marks: dict | None = None) -> bool:
    """A full load as a version of a BucketStore, with the contact index and the names of customers."""
    out = run_full(t, as_of, spark)
    out["customer_360"] = stored(out["customer_360"], "customer_360")
    more = {"contact_index": contact_index(out["contact_mapping"], out["interaction_detail"]), "names": out["customer_360"].select("customer_name")}
    return store.publish(version, out | more, validate, marks)


def publish_batch(store, version: str, batch: Tables, t: Tables, as_of: Column, spark, marks: dict | None = None) -> dict[str, list[int]]:
    """A batch as a version of a BucketStore: the rows that run_incremental gives. Returns the buckets that are new in each table.

    Of the published tables only the names of customers are read whole. The contact index leads from the batch's mobiles to
    customers, so only its buckets of these are read, and of the others those of the customers reached and, for contact 360,
    of customers that share a contact with them."""
    c = F.col
    t, batch = respelled(t, store.read("names"), batch)
    phones = reached_mobiles(batch, t, spark)
    at = store.touched("contact_index", phones.withColumn("contact_name", F.lit(None).cast("string"))) if phones is not None else []
    known = store.read("contact_index", at)
    names = stored(affected({"contact_mapping": known, "interaction_detail": known.limit(0)}, batch, t, spark), "affected")
    own = store.touched("customer_360", names)
    kinds = ("contact_mapping", "interaction_detail")
    fresh = fresh_rows(t, names, as_of, spark)
    keys = stored(contact_keys({k: store.read(k, own) for k in kinds}, fresh, names), "contact-keys")
    index = store.touched("contact_index", keys)
    entries = store.read("contact_index", index)
    sharing = same_contact(entries, keys, "left_semi").select("customer_name")
    every = sorted({*own, *store.touched("customer_360", sharing)})
    out = replaced({k: store.read(k, every) for k in (*kinds, "customer_360", "contact_360")}, t, names, fresh, as_of, spark)
    out["customer_360"] = stored(out["customer_360"].filter(store.bucket("customer_360").isin(own)), "customer_360")
    changes = {k: (out[k].filter(store.bucket(k).isin(own)), own) for k in kinds} | {"customer_360": (out["customer_360"], own), "contact_360": (out["contact_360"], every)}
    changes["names"] = (out["customer_360"].select("customer_name"), own)
    changes["contact_index"] = (_of(entries, names, "left_anti").filter(c("customer_name").isNotNull()).unionByName(contact_index(*[fresh[k] for k in kinds])).distinct(), index)
    store.replace(version, changes, marks=marks)
    return {k: buckets for k, (_, buckets) in changes.items()}


def validate(t: Tables) -> DataFrame:
    """(table_name, n_rows, empty_keys, duplicate_keys, valid): an empty table is invalid, the rest are warnings."""
    out = None
    for name, key in (("contact_mapping", "customer_name"), ("interaction_detail", "customer_name"), ("customer_360", "customer_name"), ("contact_360", "customer_name")):
        if name not in t:
            continue
        per = t[name].groupBy(key).agg(F.count("*").alias("n"))
        one = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(~F.coalesce(is_filled(F.col(key)), F.lit(False)), F.col("n"))), F.lit(0)).alias("empty_keys"), F.count_if(F.col("n") > 1).alias("duplicate_keys"))
        one = one.select(F.lit(name).alias("table_name"), "n_rows", "empty_keys", "duplicate_keys", (F.col("n_rows") > 0).alias("valid"))
        out = one if out is None else out.unionByName(one)
    return out
