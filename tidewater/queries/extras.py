"""Advice, contact filters, reviews, merges, batches, the document index and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import advice, text
from ..operators import dedup
from ..operators import predicates as p
from ..operators.substrings import containing
from ..plans import search, serving, sync
from ..plans.buckets import BucketStore
from ..sources import files
from ..sources.roles import AS_OF_TEXT, ROLES_SQL, as_of, contacts, customers, interactions, opportunities, table
from ..sources.shared import shared_path, spread, stored
from .registry import query

R, C = ROLES_SQL, F.col
NOW = f"TIMESTAMP '{AS_OF_TEXT}'"
TIME = "%Y-%m-%d %H:%M:%S"

_STAGE = "CASE o_custkey % 5 WHEN 0 THEN '阶段1 接触' WHEN 1 THEN '解决方案探索' WHEN 2 THEN '' WHEN 3 THEN '已完成' ELSE '谈判' END"
_WORDS = "CASE stage WHEN '阶段1 接触' THEN '初步接触阶段' WHEN '解决方案探索' THEN '方案评估阶段' WHEN '已完成' THEN '采购落地阶段' WHEN '谈判' THEN '谈判' ELSE '当前推进阶段' END"


def contact_rows(spark, d):
    """A row for each contact: role, counts, high-value interactions, mobile, stage and industry of its customer."""
    g = interactions(spark, d).groupBy("user_id", "contact_name").agg(
        F.count("*").alias("interaction_count"),
        F.count_if(p.last_days(C("event_time"), as_of(), 7)).alias("interaction_count_30d"),
        F.sum("is_high_value").alias("high_value"),
        F.max("event_time").alias("last_interaction_time"),
        F.min("mobile").alias("mobile"),
    )
    k = contacts(spark, d).select(C("user_id").alias("u"), C("contact_name").alias("n"), C("role_category").alias("role"))
    c = customers(spark, d).select("id", "industry", F.expr(_STAGE.replace("o_custkey", "id")).alias("purchase_stage"))
    return g.join(k, (C("user_id") == C("u")) & (C("contact_name") == C("n"))).join(c, C("user_id") == C("id")).drop("u", "n", "id")


_CONTACTS = f"""{R}, kr AS (SELECT i.user_id, i.contact_name, count(*) AS n, count(CASE WHEN event_time >= {NOW} - INTERVAL 7 DAY THEN 1 END) AS n30, sum(is_high_value)::BIGINT AS high, max(event_time) AS last_time, min(mobile) AS mobile FROM i GROUP BY 1, 2),
kx AS (SELECT kr.*, k.role_category AS role, c.industry, {_STAGE.replace("o_custkey", "c.id")} AS stage FROM kr JOIN k ON kr.user_id = k.user_id AND kr.contact_name = k.contact_name JOIN c ON c.id = kr.user_id)"""


@query(f"""{_CONTACTS} SELECT user_id, contact_name, CASE WHEN high > 0 OR n30 >= 3 THEN '{advice.WAY_WARM}' WHEN role = '决策者' THEN '{advice.WAY_DECIDER}' WHEN mobile IS NOT NULL THEN '{advice.WAY_PHONE}' ELSE '{advice.WAY_OTHER}' END AS way,
'联系人在' || {_WORDS} || '影响成交节奏；近30天互动 ' || n30 || ' 次，高价值行为 ' || high || ' 次；' || CASE WHEN high = 0 AND n30 = 0 THEN '暂缺历史行为，适合先做低干扰触达' WHEN high > 0 THEN '已有明确兴趣信号，适合优先推进' ELSE '已有互动基础，适合继续培育推进' END AS reason,
'您好' || contact_name || '，结合贵司当前处于' || {_WORDS} || '，我们建议先围绕“方案”做一次30分钟评估，现场会带上' || industry || '相关案例与ROI测算，若方向一致可在本周进入下一步评审。' AS script FROM kx""")
def contact_advice(spark, d):
    """How, why and with what words to approach each contact."""
    none = F.lit(None).cast("string")
    stage = advice.stage_of(C("purchase_stage"), none)
    return contact_rows(spark, d).select(
        "user_id", "contact_name",
        advice.way(C("role"), C("interaction_count_30d"), C("high_value"), none, C("mobile")).alias("way"),
        advice.reason(stage, C("interaction_count_30d"), C("high_value")).alias("reason"),
        advice.script(C("contact_name"), stage, advice.case_of(C("industry"), none, none)).alias("script"),
    )


@query(f"""{_CONTACTS} SELECT user_id, contact_name, role FROM kx WHERE (contains(lower(contact_name), 'p1') OR contains(coalesce(mobile, ''), 'P1')) AND role = '使用者' AND stage = '解决方案探索' AND n >= 2 AND high > 0
UNION ALL SELECT user_id, contact_name, role FROM kx WHERE role IN ('拍板者', '决策者') AND last_time IS NOT NULL""")
def contact_filters(spark, d):
    """Two contact lists: a narrow one, and the important ones that were ever met."""
    k = contact_rows(spark, d).withColumn("position", F.lit(None).cast("string")).withColumn("department", F.lit(None).cast("string"))
    narrow = p.ContactFilter(text="P1", role="使用者", stage="解决方案探索", interaction_min=2, history="high")
    one = lambda f: k.filter(p.both(p.contact_conditions(f))).select("user_id", "contact_name", "role")
    return one(narrow).unionByName(one(p.ContactFilter(vip=True, history="recent")))


@query("""SELECT c_custkey AS k, CASE WHEN coalesce(b1, 0) + coalesce(b2, 0) <> 0 THEN floor(coalesce(w, 0)::DOUBLE / (coalesce(b1, 0) + coalesce(b2, 0)) * 100 + 0.5)::INT ELSE 0 END AS rate
FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 50 END AS b1, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE c_custkey % 7 END AS b2, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 30 END AS w FROM customer)""")
def budget_realised(spark, d):
    """What was won in percent of the budgets."""
    c = table(spark, d, "customer").selectExpr("c_custkey AS k", "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 50 END AS b1", "CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE c_custkey % 7 END AS b2", "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 30 END AS w")
    return c.select("k", advice.realised(C("w"), C("b1"), C("b2")).alias("rate"))


@query(f"""{R}, s AS (SELECT customer_id, coalesce(nullif(CASE WHEN stage = '5-LOW' THEN '' ELSE stage END, ''), '暂无数据') AS stage, count(*) AS n FROM o GROUP BY 1, 2)
SELECT customer_id, stage FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, stage) AS rn FROM s) WHERE rn = 1""")
def top_stage(spark, d):
    return serving.top_stage(opportunities(spark, d), "customer_id", F.when(C("stage") != "5-LOW", C("stage")))


_LABELS = "CASE channel WHEN 'email' THEN '邮件' WHEN 'web' THEN '官网' WHEN 'event' THEN '直播/活动' WHEN 'wechat' THEN '微信' ELSE channel END"


@query(f"""{R}, n AS (SELECT user_id, channel, count(*) AS n FROM i WHERE channel <> '' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, encode(channel)) AS rank FROM n)
SELECT user_id, string_agg({_LABELS}, ',' ORDER BY rank) AS channels FROM r WHERE rank <= 2 GROUP BY 1""")
def top_two_channels(spark, d):
    """The two channels that each customer used most, two being the feature."""
    return serving.top_channels(interactions(spark, d), "user_id").withColumn("channels", F.array_join("channels", ","))


_STAGES = "CASE o_orderpriority WHEN '1-URGENT' THEN '阶段6：完成采购，实现进入' WHEN '2-HIGH' THEN '阶段3：测试/入围，愿意尝试' WHEN '3-MEDIUM' THEN '阶段0：未接触上客户' WHEN '5-LOW' THEN NULL ELSE '谈判' END"
_FORECASTS = "CASE o_orderstatus WHEN 'O' THEN '机会+' WHEN 'F' THEN '确保' ELSE '停滞' END"


@query(f"""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN '已完成' WHEN '2-HIGH' THEN '解决方案探索' WHEN '3-MEDIUM' THEN '未接触' WHEN '5-LOW' THEN NULL ELSE '谈判' END AS stage_label,
CASE o_orderstatus WHEN 'O' THEN '解决方案探索' WHEN 'F' THEN '需求构建' ELSE '停滞' END AS forecast_label FROM orders""")
def opportunity_labels(spark, d):
    """Stages and forecasts in short names."""
    o = table(spark, d, "orders").selectExpr("o_orderkey", f"{_STAGES} AS stage", f"{_FORECASTS} AS forecast")
    return o.select("o_orderkey", text.stage_label(C("stage")).alias("stage_label"), text.forecast_label(C("forecast")).alias("forecast_label"))


_REVIEWED = "CASE c_mktsegment WHEN 'BUILDING' THEN c_name WHEN 'MACHINERY' THEN substr(c_name, 10, 8) WHEN 'AUTOMOBILE' THEN concat('No ', c_name) WHEN 'FURNITURE' THEN '' ELSE substr(c_name, 14) END"


@query(f"""{R}, n AS (SELECT {_REVIEWED} AS name FROM customer), w AS (SELECT name, min(customer_name) AS first FROM (SELECT DISTINCT name FROM n WHERE name <> '' AND name NOT IN (SELECT customer_name FROM c)) JOIN c ON contains(customer_name, name) GROUP BY name)
SELECT n.name, coalesce(e.customer_name, l.customer_name) AS customer_name, coalesce(e.industry, l.industry) AS industry FROM n LEFT JOIN c e ON n.name = e.customer_name LEFT JOIN w ON w.name = n.name LEFT JOIN c l ON l.customer_name = w.first""")
def review_enrichment(spark, d):
    """Names of candidates, whole or in part, with their customer, by the exact name or else by a name that contains theirs."""
    names = table(spark, d, "customer").select(F.expr(_REVIEWED).alias("name"))
    return serving.enriched(names, customers(spark, d), ["industry"])


@query(f"WITH w AS (SELECT DISTINCT substr(c_name, 12) AS word FROM customer UNION SELECT p_name FROM part UNION SELECT '0'), n AS (SELECT c_name AS name FROM customer UNION SELECT p_type || ' ' || p_name FROM part) SELECT word, name FROM w JOIN n ON contains(name, word)")
def names_containing(spark, d):
    """Which names contain the ends of others, long and short words alike."""
    c, p = table(spark, d, "customer"), table(spark, d, "part")
    words = c.selectExpr("substr(c_name, 12) AS word").union(p.selectExpr("p_name")).union(c.selectExpr("'0'"))
    return containing(words, c.selectExpr("c_name AS name").union(p.selectExpr("concat(p_type, ' ', p_name)")))


_ALIASES = "SELECT c_name AS old, 'Customer#' || lpad((c_custkey - 1)::VARCHAR, 9, '0') AS new FROM customer WHERE c_custkey % 10 = 1"


@query(f"""WITH al AS ({_ALIASES}) SELECT 'crm_contact' AS table_name, count(*) AS updated FROM customer JOIN al ON c_name = old WHERE c_acctbal > 0
UNION ALL SELECT 'zhique_contact', count(*) FROM customer JOIN al ON c_name = old""")
def companies_merged(spark, d):
    """Rows that a merge of companies renames in each source table."""
    c = table(spark, d, "customer")
    al = c.filter("c_custkey % 10 = 1").selectExpr("c_name AS old", "concat('Customer#', lpad(c_custkey - 1, 9, '0')) AS new")
    rows = {"crm_contact": c.filter("c_acctbal > 0").select(C("c_name").alias("customer_name")), "zhique_contact": c.select(C("c_name").alias("related_company"))}
    return dedup.merged(rows, al)[1]


@query(f"{R} SELECT channel AS source_table, count(*) AS n FROM i WHERE event_time > TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1")
def batch_counts(spark, d):
    """Rows of a batch by source, the channel standing for the source here."""
    i = interactions(spark, d).withColumnRenamed("channel", "source_table")
    new = sync.past(i, sync.Mark("event_time", "time"), "2024-01-20 00:00:00")
    old = i.join(new.select(C("source_id").alias("s")), C("source_id") == C("s"), "left_anti")
    return sync.batch_counts({"interaction_detail": sync.stamped(old, 1).unionByName(sync.stamped(new, 2))}, 2)


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'")
def changed_companies(spark, d):
    """Companies changed since a time; were they fewer than two, all of them."""
    o = table(spark, d, "orders").select(C("o_orderkey").alias("k"), F.concat(F.lit("N"), C("o_orderkey")).alias("name"), C("o_orderdate").alias("updated_at"))
    return dedup.changed(o, F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")).select("k")


@query("""WITH a AS (SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN '0.95 | Same entity' WHEN 1 THEN '7|too sure' WHEN 2 THEN 'yes, the same' WHEN 3 THEN '0.3 different' ELSE '' END AS answer FROM customer)
SELECT k, CASE k % 5 WHEN 0 THEN 0.95 WHEN 1 THEN 1.0 WHEN 2 THEN 0.5::DOUBLE * (k % 101) / 100 + 0.2 WHEN 3 THEN 0.3 ELSE 0 END::DOUBLE AS score, CASE k % 5 WHEN 0 THEN 'Same entity' WHEN 1 THEN 'too sure' WHEN 2 THEN 'Could not parse LLM output; fallback score' WHEN 3 THEN answer ELSE '' END AS explanation FROM a""")
def judge_answers(spark, d):
    """Answers of a judge read, with the mean of the other scores where there is no number."""
    answers = "CASE c_custkey % 5 WHEN 0 THEN '0.95 | Same entity' WHEN 1 THEN '7|too sure' WHEN 2 THEN 'yes, the same' WHEN 3 THEN '0.3 different' ELSE '' END"
    a = table(spark, d, "customer").select(C("c_custkey").alias("k"), F.expr(answers).alias("answer"))
    return a.select("k", advice.judged(C("answer"), (C("k") % 101).cast("double"), F.lit(40.0)).alias("j")).select("k", "j.score", "j.explanation")


_VALUES = "SELECT o_custkey AS company, 'phone' AS kind, (o_orderkey % 5000)::VARCHAR AS value FROM orders UNION ALL SELECT o_custkey, 'email', o_orderpriority || (o_orderkey % 700) FROM orders"


@query(f"""WITH k AS (SELECT c_name AS company, kind, value FROM ({_VALUES}) JOIN customer ON c_custkey = company)
SELECT a.kind, count(DISTINCT a.value) AS shared FROM k a JOIN k b ON a.kind = b.kind AND a.value = b.value WHERE contains(a.company, '#0000000') AND contains(b.company, '#00000001') GROUP BY 1""")
def shared_values(spark, d):
    """Phones and emails that companies of one name part share with those of another."""
    from .dedup import company_contacts

    c = table(spark, d, "customer").select("c_custkey", "c_name")
    named = company_contacts(spark, d).join(c, C("company") == C("c_custkey")).select(C("c_name").alias("company"), "kind", "value")
    return dedup.shared_by_name(named, "#0000000", "#00000001")


_HALF = "TIMESTAMP '1996-01-01 00:00:00'"


@query(f"SELECT o_orderkey AS id, o_orderpriority AS p, CASE WHEN o_orderdate > {_HALF} THEN o_totalprice ELSE -1 END AS total FROM orders WHERE o_orderstatus <> 'P'")
def index_mirror(spark, d):
    """An index brought up to date: rows changed past the mark are written into it, documents without a row go."""
    o = table(spark, d, "orders").select(C("o_orderkey").alias("id"), C("o_orderpriority").alias("p"), C("o_totalprice").alias("total"), "o_orderdate", "o_orderstatus")
    index = o.filter("o_orderdate < TIMESTAMP_NTZ '1997-01-01 00:00:00'").select("id", "p", F.lit(-1.0).alias("total"))
    rows = o.filter("o_orderstatus <> 'P'")
    return search.mirrored(index, rows, "id", "o_orderdate", F.lit("1996-01-01 00:00:00").cast("timestamp_ntz"), prune=True)


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal < 1000 THEN 'new' ELSE c_name END AS name, c_mktsegment AS segment FROM customer WHERE c_nationkey <> 7 AND c_mktsegment <> 'BUILDING'")
def index_changes(spark, d):
    """Documents updated in part, deleted by id and by a query."""
    c = table(spark, d, "customer").select(C("c_custkey").alias("id"), C("c_name").alias("name"), C("c_mktsegment").alias("segment"), "c_acctbal", "c_nationkey")
    part = c.filter("c_acctbal < 1000").select("id", F.lit("new").alias("name"))
    out = search.deleted(search.updated(c.select("id", "name", "segment"), part, "id"), c.filter("c_nationkey = 7"), "id")
    return search.deleted_by_query(out, {"term": {"segment": "BUILDING"}})


@query(f"""{R} SELECT customer_name AS "客户公司", contact_name AS "联系人", mobile AS "手机号", 'events' AS "来源表", channel AS "互动渠道", behavior_type AS "行为类型", content AS "互动内容", strftime(event_time, '%Y-%m-%d %H:%M') AS "互动时间", is_high_value AS "高价值" FROM i ORDER BY event_time DESC, source_id LIMIT 10000""")
def export_interactions(spark, d):
    """The sheet of the newest 10,000 interactions, a sheet's length being the feature."""
    i = interactions(spark, d).withColumn("source_table", F.lit("events"))
    return files.export_table(i, "interaction_detail", [C("event_time").desc(), C("source_id")])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('7:' || o_orderkey), o_orderkey LIMIT 1000")
def dump_sample(spark, d):
    """A sample of 1,000 rows for a dump, a sample being the feature."""
    return files.sampled(table(spark, d, "orders"), "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey AS k, c_name AS customer_name FROM customer")
def publish_versions(spark, d):
    """A version that is published, one that is not valid and is not, and what readers see after both."""
    from ..plans import etl

    c = table(spark, d, "customer").select(C("c_custkey").alias("k"), C("c_name").alias("customer_name"))
    store = sync.Store(spark, shared_path(spark, "store"))
    store.publish("v1", {"customer_360": c}, etl.validate)
    store.publish("v2", {"customer_360": c.limit(0)}, etl.validate)
    return store.read("customer_360")


@query(f"SELECT user_id, event_id, event_type, strftime(ts, '{TIME}') AS ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def stream_last_event(spark, d):
    """The last event of each user from a stream whose parts come out of order and one of them twice."""
    from ..streaming import latest

    src, mark = shared_path(spark, "stream-in"), shared_path(spark, "stream-mark")
    store = BucketStore(spark, shared_path(spark, "stream-store"), 4, {"last_event": ("user_id",)})
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    view = C("event_type") == "view"
    for part in (view, C("event_type") == "purchase", view, ~view & (C("event_type") != "purchase")):
        e.filter(part).write.mode("append").parquet(src)
        latest.publish_latest(spark.readStream.schema(e.schema).parquet(src), store, "last_event", ["user_id"], "ts", "event_id", mark)
    return store.read("last_event").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT event_id, event_type FROM events")
def stream_available_now(spark, d):
    """Events that a stream reads in two runs, each row once."""
    from ..streaming import events

    src, sink, mark = (shared_path(spark, n) for n in ("stream-in", "stream-out", "stream-mark"))
    e = table(spark, d, "events")
    for part in (0, 1):
        e.filter(C("event_id") % 2 == part).write.mode("append").parquet(src)
        events.available_now(spark, src, e.schema, lambda s: s.select("event_id", "event_type"), sink, mark)
    return spark.read.parquet(sink)


@query("SELECT c_custkey AS k, c_acctbal > 0 AS cached FROM customer")
def vectors_cached(spark, d):
    """Names with vectors from a cache or computed anew; which were cached."""
    c = spread(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), "c_custkey")
    c = c.select(C("c_custkey").alias("k"), C("c_name").alias("name"), text.normalize_name(C("c_name")).alias("norm"), "c_acctbal", "c_mktsegment")
    spelt = F.when(C("c_mktsegment") == "BUILDING", C("name")).otherwise(F.concat(C("name"), F.lit(" Ltd"))).alias("name")
    cache = stored(c.filter("c_acctbal > 0").select(spelt, "norm", dedup.hashed_vector(C("norm")).alias("v")), "vector-cache")
    out = dedup.with_cached_vectors(c.select("name", "norm"), cache, dedup.hashed_vector)
    return out.filter(F.size("v") == 64).join(c.select("k", C("name").alias("n")), C("name") == C("n")).select("k", "cached")
