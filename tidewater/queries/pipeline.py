"""Loads from source tables to the four result tables, marks, validation, observations, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..plans import etl, search, sync
from ..plans.buckets import BucketStore
from ..sources import files
from ..sources.names import spellings
from ..sources.roles import AS_OF_TEXT, LOAD_SQL, as_of, load_tables, table
from ..sources.shared import shared_path, stored
from ..streaming import events
from .registry import query

C = F.col
NOW = f"TIMESTAMP '{AS_OF_TEXT}'"
TIME = "%Y-%m-%d %H:%M:%S"


def stamp(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


_ROLE = "CASE purchase_role WHEN '拍板者' THEN '决策者' WHEN '评估者' THEN '技术评估者' WHEN '使用者' THEN '使用者' ELSE '未知' END"
_MAPPING = f"""{LOAD_SQL},
icp AS (SELECT DISTINCT related_company AS customer_name FROM zhique_contact WHERE related_company <> ''), icp_m AS (SELECT DISTINCT mobile FROM zhique_contact WHERE mobile <> ''),
wk AS (SELECT mobile, min(customer_name) AS customer_name FROM crm_contact WHERE customer_name <> '' AND mobile <> '' GROUP BY 1),
web AS (SELECT w.contact_id, wk.customer_name, w.name, w.mobile_phone, w.email, w.title, w.department FROM linkflow_contacts w JOIN wk ON w.mobile_phone = wk.mobile),
ld AS (SELECT DISTINCT coalesce(final_company_name, customer_company) AS company, customer_name, contact_phone, email, lead_function FROM marketing_lead),
mu AS (SELECT 0 AS pr, related_company AS customer_name, contact_name, mobile, email, department, NULL::VARCHAR AS position, NULL::VARCHAR AS role_category, 'zhique' AS source_table FROM zhique_contact WHERE related_company <> ''
UNION ALL SELECT 1, customer_name, contact_name, mobile, email, NULL, NULL, {_ROLE}, 'crm' FROM crm_contact WHERE customer_name IN (SELECT customer_name FROM icp) OR mobile IN (SELECT mobile FROM icp_m)
UNION ALL SELECT 2, company, customer_name, contact_phone, email, NULL, lead_function, NULL, 'marketing' FROM ld WHERE company <> ''
UNION ALL SELECT 3, customer_name, name, mobile_phone, email, department, title, NULL, 'linkflow' FROM web
UNION ALL SELECT DISTINCT 4, customer_name, visitor_name, NULL, NULL, NULL, NULL, NULL, 'tianrun' FROM tianrun_session WHERE customer_name <> '' AND visitor_name <> ''),
mapping AS (SELECT * EXCLUDE (pr, n) FROM (SELECT *, row_number() OVER (PARTITION BY customer_name, mobile ORDER BY pr, contact_name NULLS LAST, email NULLS LAST, department NULLS LAST, position NULLS LAST) AS n FROM mu) WHERE n = 1 OR mobile IS NULL)"""
_BCH = "CASE behavior_type WHEN '访问落地页' THEN 'web' WHEN '点击邮件链接' THEN 'email' WHEN '报名会议' THEN 'event' WHEN '下载资料' THEN 'web' ELSE 'other' END"
_DETAIL = f"""{_MAPPING},
bm AS (SELECT mobile AS m, min(customer_name) AS customer_name FROM crm_contact WHERE mobile <> '' GROUP BY 1),
du AS (SELECT customer_name, contact_name, mobile_phone AS mobile, 'zhique' AS source_table, {_BCH} AS channel, behavior_type, behavior_name AS content, behavior_time AS event_time, 0 AS is_high_value, behavior_id AS source_id FROM zhique_behavior JOIN bm ON mobile_phone = m
UNION ALL SELECT customer_name, visitor_name, NULL, 'tianrun', CASE contact_type_name WHEN '企微客服' THEN 'wechat' ELSE 'web' END, coalesce(receive_type_name, 'online_chat'), coalesce(close_reason_name, ''), make_timestamp(start_time_sec * 1000000), CASE WHEN total_duration > 60 THEN 1 ELSE 0 END, id FROM tianrun_session WHERE customer_name IN (SELECT customer_name FROM icp)
UNION ALL SELECT web.customer_name, web.name, web.mobile_phone, 'linkflow', 'web', event_name, NULL, make_timestamp(event_date_ms * 1000), 0, event_id FROM linkflow_events e JOIN web ON web.contact_id = e.contact_id
UNION ALL SELECT trim(company), person, phone, 'crm_lead', coalesce(nullif(trim(source_class), ''), 'crm'), '线索', coalesce(nullif(trim(activity), ''), nullif(trim(source_kind), ''), ''), obtained, 0, ('0x' || substr(md5(concat_ws('|', lead_code, company, person, phone, strftime(obtained, '%Y-%m-%d'), activity)), 1, 15))::BIGINT FROM crm_lead
UNION ALL SELECT customer, owner, NULL, 'crm_opportunity', coalesce(nullif(trim(origin), ''), 'crm'), '商机', opp_name, created, 0, ('0x' || substr(md5(concat_ws('|', opp_code, customer, opp_name, strftime(created, '%Y-%m-%d'), origin)), 1, 15))::BIGINT FROM crm_opportunity_data),
detail AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY source_table, source_id ORDER BY customer_name, event_time, contact_name, content) AS n FROM du) WHERE n = 1)"""


@query(f"{_MAPPING} SELECT * FROM mapping")
def contact_mapping(spark, d):
    return etl.contact_mapping(load_tables(spark, d), spark).select("customer_name", "contact_name", "mobile", "email", "department", "position", "role_category", "source_table")


@query(f"{_DETAIL} SELECT customer_name, contact_name, mobile, source_table, channel, behavior_type, content, strftime(event_time, '{TIME}') AS event_time, is_high_value, source_id FROM detail")
def interaction_detail(spark, d):
    return etl.interaction_detail(load_tables(spark, d), spark).withColumn("event_time", stamp("event_time"))


_SCORE = "least(100, 2 * n30 + CASE WHEN active_n > 0 THEN 20 ELSE 0 END + CASE WHEN contact_count >= 3 THEN 10 ELSE 3 * contact_count END)::INT"
_C360 = f"""{_DETAIL},
sd AS (SELECT customer_name, count(*) AS total, count(CASE WHEN event_time >= {NOW} - INTERVAL 30 DAY THEN 1 END) AS n30, max(event_time) AS last_time, min(channel) AS first_channel, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels FROM detail GROUP BY 1),
ca AS (SELECT customer_name, max(industry) AS industry, max(sales_region) AS region, max(sales_name) AS owner_name, max(attribute) AS attribute, count(DISTINCT contact_name) AS contact_count, count(DISTINCT mobile) AS mobile_count FROM crm_contact GROUP BY 1),
op AS (SELECT customer_name, max(customer_stage) AS purchase_stage, count(CASE WHEN is_active = 1 THEN 1 END) AS active_n, sum(CASE WHEN is_active = 1 THEN amount_10k * 10000 END)::DECIMAL(22, 2) AS active_amount, count(CASE WHEN is_funnel = '是' THEN 1 END) AS funnel_n, sum(order_amount_10k * 10000)::DECIMAL(22, 2) AS won FROM crm_opportunity GROUP BY 1),
rc AS (SELECT customer_name, CASE WHEN max((role_category = '决策者')::INT) + max((role_category = '技术评估者')::INT) + max((role_category = '使用者')::INT) = 3 THEN '全' WHEN count(DISTINCT role_category) > 0 THEN '部分' ELSE '无' END AS role_coverage, string_agg(DISTINCT source_table, ',' ORDER BY source_table) AS sources FROM mapping GROUP BY 1),
c0 AS (SELECT icp.customer_name, ca.industry, ca.region, ca.owner_name, ca.attribute, op.purchase_stage, coalesce(rc.role_coverage, '无') AS role_coverage, coalesce(n30, 0) AS n30, coalesce(total, 0) AS total, coalesce(contact_count, 0) AS contact_count, coalesce(mobile_count, 0) AS mobile_count,
coalesce(active_n, 0) AS active_n, coalesce(active_amount, 0) AS active_amount, coalesce(funnel_n, 0) AS funnel_n, coalesce(won, 0) AS won, last_time, first_channel, coalesce(channels, '') AS channels, coalesce(sources, '') AS sources,
(industry IS NOT NULL)::INT || ',' || (coalesce(active_n, 0) > 0)::INT || ',' || (coalesce(contact_count, 0) > 0)::INT || ',' || (coalesce(total, 0) > 0)::INT AS coverage FROM icp LEFT JOIN sd USING (customer_name) LEFT JOIN ca USING (customer_name) LEFT JOIN op USING (customer_name) LEFT JOIN rc USING (customer_name)),
c1 AS (SELECT c0.* REPLACE (coalesce(kc.customer_name, c0.owner_name) AS owner_name, coalesce(kc.department_level3, c0.region) AS region, coalesce(kc.industry_category, c0.industry) AS industry, coalesce(kc.attribute, c0.attribute) AS attribute), {_SCORE} AS intent_score, CASE WHEN n30 >= 10 AND active_n > 0 THEN '高' WHEN n30 >= 3 THEN '中' WHEN total > 0 THEN '低' ELSE '无' END AS intent_level FROM c0 LEFT JOIN key_customer kc ON kc.key_customer_name = c0.customer_name),
c360 AS (SELECT * FROM c1 UNION ALL SELECT key_customer_name, industry_category, department_level3, customer_name, attribute, NULL, NULL, 0, 0, 0, 0, 0, NULL, 0, NULL, NULL, NULL, NULL, NULL, NULL, 0, NULL FROM key_customer WHERE key_customer_name NOT IN (SELECT customer_name FROM c1))"""


COVERAGE = ("has_crm", "has_opp", "has_contacts", "has_interactions")


def _shown(c):
    return c.select(
        "customer_name", "industry", "region", "owner_name", "attribute", "purchase_stage", "role_coverage", C("interaction_count_30d").cast("long").alias("n30"), C("interaction_count_total").cast("long").alias("total"), C("contact_count").cast("long").alias("contact_count"),
        C("mobile_count").cast("long").alias("mobile_count"), C("active_opp_count").cast("long").alias("active_n"), C("active_opp_amount").cast("double").alias("active_amount"), C("funnel_opp_count").cast("long").alias("funnel_n"), C("won_amount").cast("double").alias("won"),
        F.date_format("last_interaction_time", "yyyy-MM-dd HH:mm:ss").alias("last_time"), C("last_interaction_channel").alias("first_channel"), F.array_join("top_channels", ",").alias("channels"), F.array_join("source_tables", ",").alias("sources"), "intent_score", "intent_level",
        F.when(C("data_coverage").isNotNull(), F.concat_ws(",", *[C(f"data_coverage.{n}").cast("int") for n in COVERAGE])).alias("coverage"),
    )


_SHOW = f"SELECT * REPLACE (strftime(last_time, '{TIME}') AS last_time, active_amount::DOUBLE AS active_amount, won::DOUBLE AS won) FROM c360"


@query(f"{_C360} {_SHOW}")
def customer_360_full(spark, d):
    return _shown(etl.run_full(load_tables(spark, d), as_of(), spark)["customer_360"])


_K360 = f"""{_C360}, di AS (SELECT contact_name, mobile, count(*) AS n, count(CASE WHEN event_time >= {NOW} - INTERVAL 30 DAY THEN 1 END) AS n30, max(event_time) AS last_time FROM detail GROUP BY 1, 2)
SELECT m.customer_name, m.contact_name, m.mobile, m.source_table, coalesce(n, 0) AS interaction_count, strftime(last_time, '{TIME}') AS last_time, CASE WHEN coalesce(n30, 0) >= 10 THEN 'high' WHEN coalesce(n30, 0) >= 3 THEN 'medium' WHEN coalesce(n, 0) > 0 THEN 'low' ELSE 'none' END AS activity_level
FROM mapping m LEFT JOIN di ON m.contact_name = di.contact_name AND m.mobile IS NOT DISTINCT FROM di.mobile WHERE m.customer_name IN (SELECT customer_name FROM icp)"""


@query(_K360)
def contact_360_full(spark, d):
    return _contacts(etl.run_full(load_tables(spark, d), as_of(), spark)["contact_360"])


def _contacts(k):
    return k.select("customer_name", "contact_name", "mobile", F.get("source_tables", F.lit(0)).alias("source_table"), C("interaction_count").cast("long").alias("interaction_count"), F.date_format("last_interaction_time", "yyyy-MM-dd HH:mm:ss").alias("last_time"), "activity_level")


def _halves(spark, d):
    """The four tables of a first load, a batch, all sources, and the customers that the batch can change."""
    t = load_tables(spark, d)
    late = {"zhique_behavior": "behavior_id % 4 = 1", "crm_lead": "hash(lead_code) % 2 = 0", "linkflow_events": "event_id % 4 = 0", "crm_opportunity": "id % 2 = 0"}
    first = t | {n: t[n].filter(f"NOT ({w})") for n, w in late.items()}
    before = etl.run_full(first, as_of(), spark)
    before = {n: stored(before[n], n) for n in before}
    batch = {n: t[n].filter(w) for n, w in late.items()}
    return before, batch, t, stored(etl.affected(before, batch, t, spark), "affected")


@query(f"{_C360} {_SHOW}")
def incremental_equals_full(spark, d):
    """Half of the behaviours, leads, events and opportunities first, the rest as a batch: the rows of a full load."""
    before, batch, t, names = _halves(spark, d)
    return _shown(etl.run_incremental(before, batch, t, as_of(), spark, names)["customer_360"])


@query(_K360)
def incremental_contacts(spark, d):
    """The contacts of the same two loads."""
    before, batch, t, names = _halves(spark, d)
    return _contacts(etl.run_incremental(before, batch, t, as_of(), spark, names)["contact_360"])


def _published(spark, d):
    """A store with the first load and the batch of _halves as versions."""
    t = load_tables(spark, d)
    late = {"zhique_behavior": "behavior_id % 4 = 1", "crm_lead": "hash(lead_code) % 2 = 0", "linkflow_events": "event_id % 4 = 0", "crm_opportunity": "id % 2 = 0"}
    store = BucketStore(spark, shared_path(spark, "bucket-store"), 8)
    etl.publish_full(store, "1", t | {n: t[n].filter(f"NOT ({w})") for n, w in late.items()}, as_of(), spark)
    etl.publish_batch(store, "2", {n: t[n].filter(w) for n, w in late.items()}, t, as_of(), spark)
    return store


@query(f"{_C360} {_SHOW}")
def bucketed_customers(spark, d):
    """The rows of a full load from buckets that a batch has replaced."""
    return _shown(_published(spark, d).read("customer_360"))


@query(_K360)
def bucketed_contacts(spark, d):
    """The contacts of the same version."""
    return _contacts(_published(spark, d).read("contact_360"))


@query(f"""{_DETAIL}, crm_of AS (SELECT mobile, customer_name FROM crm_contact)
SELECT customer_name FROM (SELECT customer_name FROM tianrun_session WHERE start_time_sec > epoch(TIMESTAMP '1997-01-01 00:00:00')::BIGINT UNION SELECT customer_name FROM crm_of WHERE mobile IN (SELECT mobile_phone FROM zhique_behavior WHERE behavior_time > TIMESTAMP '2024-01-20 00:00:00')
UNION SELECT customer_name FROM mapping WHERE mobile IN (SELECT mobile_phone FROM zhique_behavior WHERE behavior_time > TIMESTAMP '2024-01-20 00:00:00') UNION SELECT customer_name FROM detail WHERE mobile IN (SELECT mobile_phone FROM zhique_behavior WHERE behavior_time > TIMESTAMP '2024-01-20 00:00:00')) WHERE customer_name <> ''""")
def affected_customers(spark, d):
    """Customers that a batch past the marks of two sources can change."""
    t = load_tables(spark, d)
    before = {"contact_mapping": etl.contact_mapping(t, spark), "interaction_detail": etl.interaction_detail(t, spark)}
    since = {"zhique_behavior": "2024-01-20 00:00:00", "tianrun_session": 852076800}
    return etl.affected(before, {n: sync.past(t[n], sync.MARKS[n], v) for n, v in since.items()}, t, spark)


@query("SELECT event_id, user_id FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'")
def watermark_filter(spark, d):
    e = table(spark, d, "events")
    return sync.past(e, sync.Mark("ts", "time"), "2024-01-20 00:00:00").select("event_id", "user_id")


@query(f"SELECT strftime(max(ts), '{TIME}') AS mark FROM events")
def watermark_advance(spark, d):
    return sync.advance(table(spark, d, "events"), sync.Mark("ts", "time")).select(F.substring("mark", 1, 19).alias("mark"))


@query(f"""{_C360}, per AS (SELECT 'contact_mapping' AS t, customer_name AS k, count(*) AS n FROM mapping GROUP BY 2 UNION ALL SELECT 'interaction_detail', customer_name, count(*) FROM detail GROUP BY 2 UNION ALL SELECT 'customer_360', customer_name, count(*) FROM c360 GROUP BY 2)
SELECT t AS table_name, sum(n)::BIGINT AS n_rows, coalesce(sum(CASE WHEN k IS NULL OR k = '' THEN n END), 0)::BIGINT AS empty_keys, count(CASE WHEN n > 1 THEN 1 END) AS duplicate_keys, sum(n) > 0 AS valid FROM per GROUP BY 1""")
def validation_report(spark, d):
    t = etl.run_full(load_tables(spark, d), as_of(), spark)
    return etl.validate({k: t[k] for k in ("contact_mapping", "interaction_detail", "customer_360")})


@query("SELECT 'customer' AS table_name, count(*) AS table_count FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'events', count(*) FROM events")
def table_observations(spark, d):
    log = sync.observe({n: table(spark, d, n) for n in ("customer", "orders", "events")}, as_of())
    return sync.latest_observations(log).select("table_name", "table_count")


@query("SELECT 'customer' AS table_name, count(*) AS table_count FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'events', count(*) FROM events")
def published_counts(spark, d):
    """Rows of tables as their publication counted them while it wrote."""
    store = sync.Store(spark, shared_path(spark, "counted"))
    store.publish("1", {n: table(spark, d, n) for n in ("customer", "orders", "events")})
    return sync.latest_observations(store.counts()).select("table_name", "table_count")


_T = "'%Y-%m-%d %H:%M:%S'"


def _timed(df, *cols):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in cols})


@query(f"SELECT strftime(time_bucket(INTERVAL '1 hour', ts), {_T}) AS start, strftime(time_bucket(INTERVAL '1 hour', ts) + INTERVAL 1 HOUR, {_T}) AS end, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY ALL".replace(" AS end,", ' AS "end",'))
def tumbling_events(spark, d):
    return _timed(events.windows(table(spark, d, "events"), "1 hour"), "start", "end")


@query(f"""SELECT strftime(s, {_T}) AS start, strftime(s + INTERVAL 2 HOUR, {_T}) AS "end", event_type, count(*) AS n, round(sum(value), 2) AS value FROM (SELECT *, time_bucket(INTERVAL '1 hour', ts) - k * INTERVAL 1 HOUR AS s FROM events, (SELECT unnest([0, 1]) AS k)) GROUP BY ALL""")
def sliding_events(spark, d):
    return _timed(events.windows(table(spark, d, "events"), "2 hours", "1 hour"), "start", "end")


@query(f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), {_T}) AS start, strftime(max(ts) + INTERVAL 6 HOUR, {_T}) AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def session_events(spark, d):
    return _timed(events.sessions(table(spark, d, "events"), "6 hours"), "start", "end")


@query("SELECT page_id FROM pages WHERE contains(lower(url), 'example') AND regexp_matches(lower(url), '(^|[^a-z0-9])(en|fr)([^a-z0-9]|$)') AND page_id >= 20 AND page_id <> 33")
def search_bool(spark, d):
    q = {"bool": {"must": [{"match": {"url": "en fr"}}, {"range": {"page_id": {"gte": 20}}}], "must_not": [{"term": {"page_id": 33}}], "filter": [{"match": {"url": "example"}}]}}
    return table(spark, d, "pages").filter(search.compiled(q)).select("page_id")


@query("""SELECT c_custkey, '{"id":' || c_custkey || ',"name":["' || c_name || '"]' || CASE WHEN c_acctbal < 0 THEN '' ELSE ',"segment":"' || c_mktsegment || '"' END || ',"flag":' || (c_custkey % 2 = 1) || '}' AS doc FROM customer""")
def index_documents(spark, d):
    rows = table(spark, d, "customer").selectExpr("c_custkey AS id", "c_name AS name", "CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS segment", "CAST(c_custkey % 2 AS INT) AS flag")
    return search.documents(rows, flags=("flag",), arrays=("name",)).select(F.get_json_object("doc", "$.id").cast("long").alias("c_custkey"), "doc")


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 3 <> 0")
def index_prune(spark, d):
    c = table(spark, d, "customer").selectExpr("c_custkey AS id", "c_name AS name")
    return search.pruned(c, c.filter("id % 3 <> 0"), "id")


@query("SELECT c_custkey AS id, substr(c_name, 1, 12) AS name, nullif(trim(c_mktsegment), '') AS segment, NULL::VARCHAR AS missing, c_acctbal::DOUBLE AS balance FROM customer")
def declared_columns(spark, d):
    from ..sources.files import declared

    cols = [("c_custkey", "id", "int"), ("c_name", "name", "string"), ("c_mktsegment", "segment", "string"), ("nothing", "missing", "string"), ("c_acctbal", "balance", "decimal")]
    return declared(table(spark, d, "customer"), cols, {"name": 12}).withColumn("id", C("id").cast("long"))


@query("SELECT upper(c_name) AS k, lower(c_mktsegment) AS s, count(*) AS n FROM customer GROUP BY ALL")
def collation_group(spark, d):
    """Names that differ by case or full width are one group."""
    c = table(spark, d, "customer")
    wide = F.when(C("c_custkey") % 2 == 0, F.lower("c_name")).otherwise(C("c_name"))
    return c.groupBy(text.collation_key(wide).alias("k"), text.collation_key(C("c_mktsegment")).alias("s")).agg(F.count("*").alias("n")).select(F.upper("k").alias("k"), "s", "n")


@query("""WITH s AS (SELECT c_name AS name, 0 AS rank FROM customer UNION ALL SELECT replace(s_name, 'Supplier', 'ＣＵＳＴＯＭＥＲ'), 1 FROM supplier UNION ALL SELECT 'Cústomèr#' || lpad(o_custkey::VARCHAR, 9, '0'), 2 FROM orders UNION ALL SELECT 'customer#' || lpad(o_custkey::VARCHAR, 9, '0'), 3 FROM orders),
k AS (SELECT name, min(rank) AS rank, strip_accents(lower(replace(name, 'ＣＵＳＴＯＭＥＲ', 'CUSTOMER'))) AS key FROM s GROUP BY name)
SELECT * FROM (SELECT name, first_value(name) OVER (PARTITION BY key ORDER BY rank, name) AS spelling FROM k) WHERE name <> spelling""")
def company_spellings(spark, d):
    """Names in full width, with accents or in other case, and the spelling that a load gives them."""
    c = table(spark, d, "customer").select(C("c_name").alias("related_company"))
    s = table(spark, d, "supplier").select(F.replace("s_name", F.lit("Supplier"), F.lit("ＣＵＳＴＯＭＥＲ")).alias("customer_name"))
    named = lambda word: table(spark, d, "orders").select(F.concat(F.lit(word), F.lpad(C("o_custkey").cast("string"), 9, "0")).alias("customer_name"))
    return spellings({"zhique_contact": c, "crm_contact": s, "crm_opportunity": named("Cústomèr#"), "tianrun_session": named("customer#")})


def _sheet(df):
    """Numbers as both engines have them, and heads without parentheses."""
    kinds = {"integer": "long", "decimal": "double"}
    return df.select(*[C(f"`{f.name}`").cast(kinds.get(f.dataType.typeName(), f.dataType.simpleString())).alias(f.name.replace("(万)", "_万")) for f in df.schema])


_MINUTE = "%Y-%m-%d %H:%M"


@query(f"""{_C360} SELECT customer_name AS "客户名称", industry AS "行业", region AS "区域", owner_name AS "负责人", NULL::VARCHAR AS "专项", purchase_stage AS "采购阶段", CASE WHEN customer_name IN (SELECT customer_name FROM icp) THEN (SELECT max(forecast_type) FROM crm_opportunity p WHERE p.customer_name = c360.customer_name) END AS "预测类别", role_coverage AS "关键角色覆盖", intent_level AS "合作意向",
intent_score::BIGINT AS "意向分", n30 AS "近30天互动", total AS "总互动次数", strftime(last_time, '{_MINUTE}') AS "最近互动时间", first_channel AS "最近互动渠道", active_n AS "在途商机数", active_amount::DOUBLE AS "在途金额_万", contact_count AS "联系人数", won::DOUBLE AS "已成交金额_万"
FROM c360 ORDER BY intent_score DESC NULLS LAST, customer_name LIMIT 20000""")
def export_customer_list(spark, d):
    """The sheet of the customer list, at most 20,000 rows of it being the feature."""
    return _sheet(files.export_frame(etl.run_full(load_tables(spark, d), as_of(), spark)["customer_360"]))


@query(f"""{_C360} SELECT customer_name AS "客户名称", industry AS "行业", region AS "区域", owner_name AS "负责人", purchase_stage AS "采购阶段", CASE WHEN customer_name IN (SELECT customer_name FROM icp) THEN (SELECT max(forecast_type) FROM crm_opportunity p WHERE p.customer_name = c360.customer_name) END AS "预测类型", role_coverage AS "人员覆盖度", intent_score::BIGINT AS "意向评分", intent_level AS "意向等级",
n30 AS "近30天互动", total AS "总互动", strftime(last_time, '{_MINUTE}') AS "最近互动时间", first_channel AS "最近渠道", active_n AS "活跃商机数", active_amount::DOUBLE AS "活跃商机金额", contact_count AS "联系人总数", mobile_count AS "手机号数量", NULL::VARCHAR AS "现有客户"
FROM c360 ORDER BY intent_score DESC NULLS LAST, customer_name LIMIT 10000""")
def export_customers(spark, d):
    """The sheet of an answer about customers, at most 10,000 rows being the feature."""
    return _sheet(files.export_table(etl.run_full(load_tables(spark, d), as_of(), spark)["customer_360"], "customer_360", [C("intent_score").desc(), C("customer_name")]))


_ROLE_OF = "LEFT JOIN crm_contact r ON m.source_table = 'crm' AND r.contact_name = m.contact_name AND r.customer_name = m.customer_name"


@query(f"""{_C360}, di AS (SELECT contact_name, mobile, count(*) AS n, count(CASE WHEN event_time >= {NOW} - INTERVAL 30 DAY THEN 1 END) AS n30, max(event_time) AS last_time FROM detail GROUP BY 1, 2)
SELECT NULL::VARCHAR AS "客户ID", m.contact_name AS "联系人姓名", m.mobile AS "手机号", m.email AS "邮箱", m.department AS "部门", m.position AS "职位", r.purchase_role AS "采购角色", m.role_category AS "角色类别", coalesce(n, 0) AS "总互动次数", coalesce(n30, 0) AS "近30天互动",
strftime(last_time, '{_MINUTE}') AS "最近互动时间", CASE WHEN coalesce(n30, 0) >= 10 THEN 'high' WHEN coalesce(n30, 0) >= 3 THEN 'medium' WHEN coalesce(n, 0) > 0 THEN 'low' ELSE 'none' END AS "活跃度", NULL::VARCHAR AS "意向等级", NULL::VARCHAR AS "线索阶段"
FROM mapping m LEFT JOIN di ON m.contact_name = di.contact_name AND m.mobile IS NOT DISTINCT FROM di.mobile {_ROLE_OF} WHERE m.customer_name IN (SELECT customer_name FROM icp)
ORDER BY m.customer_name, m.mobile NULLS FIRST, m.contact_name NULLS FIRST, m.source_table LIMIT 10000""")
def export_contacts(spark, d):
    """The sheet of an answer about contacts, at most 10,000 rows being the feature."""
    k = etl.run_full(load_tables(spark, d), as_of(), spark)["contact_360"]
    return _sheet(files.export_table(k, "contact_360", [C("customer_name"), C("mobile"), C("contact_name"), F.get("source_tables", F.lit(0))]))


@query(f"""{_MAPPING} SELECT m.customer_name AS "客户公司", m.contact_name AS "联系人姓名", m.mobile AS "手机号", m.email AS "邮箱", m.department AS "部门", m.position AS "职位", r.purchase_role AS "采购角色", m.role_category AS "角色类别", m.source_table AS "来源表", NULL::VARCHAR AS "智能体匹配"
FROM mapping m {_ROLE_OF} ORDER BY m.customer_name, m.mobile NULLS FIRST, m.contact_name NULLS FIRST, m.source_table LIMIT 10000""")
def export_mapping(spark, d):
    """The sheet of an answer about the contact mapping, at most 10,000 rows being the feature."""
    m = etl.contact_mapping(load_tables(spark, d), spark)
    return _sheet(files.export_table(m, "contact_mapping", [C("customer_name"), C("mobile"), C("contact_name"), C("source_table")]))
