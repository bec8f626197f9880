"""Scalar functions and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators.predicates import last_days, last_months
from ..sources.roles import AS_OF_TEXT, ROLES_SQL, as_of, contacts, customers, interactions, opportunities, table
from .registry import query

R, C = ROLES_SQL, F.col
NOW = f"TIMESTAMP '{AS_OF_TEXT}'"


@query("SELECT o_orderkey, ('0x' || substr(md5(concat_ws('|', o_orderkey::VARCHAR, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d'))), 1, 15))::BIGINT AS id FROM orders")
def content_hash_id(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.content_hash_id(C("o_orderkey").cast("string"), C("o_orderpriority"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("id"))


@query("SELECT event_id, strftime(make_timestamp(epoch_us(ts) // 1000 * 1000), '%Y-%m-%d %H:%M:%S') AS at, epoch_us(ts) // 1000 AS ms FROM events")
def epoch_times(spark, d):
    ms = F.unix_millis(C("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", F.date_format(F.timestamp_millis(ms).cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss").alias("at"), ms.alias("ms"))


@query(f"SELECT event_id, trunc(epoch({NOW}) - epoch(ts))::BIGINT AS seconds, floor((epoch({NOW}) - floor(epoch(ts))) / 86400)::BIGINT AS days FROM events")
def seconds_between(spark, d):
    return table(spark, d, "events").select("event_id", F.timestamp_diff("SECOND", C("ts"), as_of()).alias("seconds"), scoring.days_since(as_of(), C("ts")).alias("days"))


@query(f"{R} SELECT source_id, regexp_matches(concat_ws(' ', behavior_type, content), '{text.OPENED}', 'i') AS opened, regexp_matches(concat_ws(' ', behavior_type, content), '{text.CLICKED}', 'i') AS clicked FROM i")
def regex_flags(spark, d):
    return interactions(spark, d).select("source_id", text.opened(C("behavior_type"), C("content")).alias("opened"), text.clicked(C("behavior_type"), C("content")).alias("clicked"))


@query("""WITH r AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ' 138 ' || c_custkey || ' ' WHEN 1 THEN c_custkey || '.0' WHEN 2 THEN '' ELSE NULL END AS phone, CASE c_custkey % 5 WHEN 0 THEN '是' WHEN 1 THEN 'N' WHEN 2 THEN '1' WHEN 3 THEN 'x' ELSE '7' END AS flag, CASE c_custkey % 3 WHEN 0 THEN '12.7' WHEN 1 THEN 'abc' ELSE c_custkey::VARCHAR END AS num FROM customer)
SELECT c_custkey, nullif(regexp_replace(regexp_replace(trim(phone), '\\s+', '', 'g'), '^(\\d+)\\.0+$', '\\1'), '') AS phone, CASE WHEN flag IN ('是', '1') THEN 1 WHEN flag = 'N' THEN 0 ELSE try_cast(flag AS INT) END AS flag, trunc(try_cast(num AS DOUBLE))::INT AS num FROM r""")
def clean_phone_int_bool(spark, d):
    r = table(spark, d, "customer").selectExpr(
        "c_custkey", "CASE c_custkey % 4 WHEN 0 THEN concat(' 138 ', c_custkey, ' ') WHEN 1 THEN concat(c_custkey, '.0') WHEN 2 THEN '' ELSE NULL END AS phone",
        "CASE c_custkey % 5 WHEN 0 THEN '是' WHEN 1 THEN 'N' WHEN 2 THEN '1' WHEN 3 THEN 'x' ELSE '7' END AS flag", "CASE c_custkey % 3 WHEN 0 THEN '12.7' WHEN 1 THEN 'abc' ELSE CAST(c_custkey AS STRING) END AS num",
    )
    return r.select("c_custkey", text.clean_phone(C("phone")).alias("phone"), text.clean_flag(C("flag")).alias("flag"), text.clean_int(C("num")).alias("num"))


@query(f"{R} SELECT source_id, CASE WHEN channel IN ('email', '邮件') THEN 'email' WHEN channel IN ('web', '官网') THEN 'web' WHEN channel IN ('event', '直播/活动') THEN 'event' ELSE 'other' END AS channel FROM i")
def channel_normalize(spark, d):
    return interactions(spark, d).select("source_id", text.normalize_channel(F.concat(F.lit(" "), C("channel"))).alias("channel"))


@query(f"{R} SELECT id, CASE WHEN region IN ('山东', '山东区域') THEN '山东' WHEN region = '广东' THEN '广东' WHEN region IS NULL OR region = '' THEN NULL ELSE '其他' END AS region FROM c")
def region_normalize(spark, d):
    return customers(spark, d).select("id", text.normalize_region(C("region")).alias("region"))


_B = f"""{R}, b AS (SELECT c.id, c.customer_name, c.industry, c.attribute, coalesce(s.n, 0) AS total, coalesce(s.n30, 0) AS n30, s.last_time, s.last_channel, coalesce(p.open_n, 0) AS open_n, coalesce(p.open_amount, 0) AS open_amount, coalesce(p.funnel_n, 0) AS funnel_n, coalesce(k.contacts, 0) AS contacts, p.stage
FROM c LEFT JOIN (SELECT user_id, count(*) AS n, count(CASE WHEN event_time >= {NOW} - INTERVAL 7 DAY THEN 1 END) AS n30, max(event_time) AS last_time, min(channel) AS last_channel FROM i GROUP BY 1) s ON c.id = s.user_id
LEFT JOIN (SELECT customer_id, count(CASE WHEN is_active = 1 THEN 1 END) AS open_n, round(coalesce(sum(CASE WHEN is_active = 1 THEN amount END), 0), 2) AS open_amount, count(CASE WHEN is_funnel = '是' THEN 1 END) AS funnel_n, max(stage) AS stage FROM o GROUP BY 1) p ON c.id = p.customer_id
LEFT JOIN (SELECT user_id, count(*) AS contacts FROM k GROUP BY 1) k ON c.id = k.user_id)"""


def base(spark, d):
    """Each customer with counts of interactions (all and of 7 days), opportunities and contacts."""
    i, o = interactions(spark, d), opportunities(spark, d)
    s = i.groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(last_days(C("event_time"), as_of(), 7)).alias("n30"), F.max("event_time").alias("last_time"), F.min("channel").alias("last_channel"))
    p = o.groupBy("customer_id").agg(F.count_if(C("is_active") == 1).alias("open_n"), F.round(F.coalesce(F.sum(F.when(C("is_active") == 1, C("amount"))), F.lit(0)), 2).alias("open_amount"), F.count_if(C("is_funnel") == "是").alias("funnel_n"), F.max("stage").alias("stage"))
    k = contacts(spark, d).groupBy(C("user_id").alias("k_id")).agg(F.count("*").alias("contacts"))
    out = customers(spark, d).join(s, C("id") == C("user_id"), "left").join(p, C("id") == C("customer_id"), "left").join(k, C("id") == C("k_id"), "left")
    return out.withColumns({n: F.coalesce(C(n), F.lit(0)) for n in ("total", "n30", "open_n", "open_amount", "funnel_n", "contacts")})


_SCORE = "least(100, 2 * n30 + CASE WHEN open_n > 0 THEN 20 ELSE 0 END + CASE WHEN contacts >= 3 THEN 10 ELSE 3 * contacts END)::INT"
_LEVEL = "CASE WHEN n30 >= 10 AND open_n > 0 THEN '高' WHEN n30 >= 3 THEN '中' WHEN total > 0 THEN '低' ELSE '无' END"


def with_intent(df):
    return df.withColumn("intent_score", scoring.intent_score(C("n30"), C("open_n"), C("contacts"))).withColumn("intent_level", scoring.intent_level(C("n30"), C("total"), C("open_n")))


@query(f"{_B} SELECT id, customer_name, n30, total, open_n, {_SCORE} AS intent_score, {_LEVEL} AS intent_level FROM b")
def intent_score(spark, d):
    return with_intent(base(spark, d)).select("id", "customer_name", "n30", "total", "open_n", "intent_score", "intent_level")


@query(f"{_B} SELECT id, customer_name, industry, {_SCORE} AS intent_score, {_LEVEL} AS intent_level, n30 FROM b ORDER BY intent_score DESC, id LIMIT 20")
def top_customers(spark, d):
    """The flagship list: the 20 customers with the highest intent score, a list of 20 being the feature."""
    return with_intent(base(spark, d)).select("id", "customer_name", "industry", "intent_score", "intent_level", "n30").orderBy(C("intent_score").desc(), "id").limit(20)


@query(f"{_B} SELECT id, CASE WHEN n30 >= 10 THEN 'high' WHEN n30 >= 3 THEN 'medium' WHEN total > 0 THEN 'low' ELSE 'none' END AS activity FROM b")
def activity_level(spark, d):
    return base(spark, d).select("id", scoring.activity_level(C("n30"), C("total")).alias("activity"))


@query(f"""{R}, s AS (SELECT user_id, contact_name, count(CASE WHEN event_time >= {NOW} - INTERVAL 7 DAY THEN 1 END) AS n30, count(*) AS total, max(event_time) AS last_time, max(mobile) AS mobile FROM i GROUP BY 1, 2),
r AS (SELECT s.*, k.role_category, max(n30) OVER (PARTITION BY s.user_id) AS most, floor((epoch({NOW}) - floor(epoch(last_time))) / 86400) AS days FROM s JOIN k USING (user_id, contact_name)),
p AS (SELECT *, round((CASE role_category WHEN '决策者' THEN 100 WHEN '使用者' THEN 50 ELSE 20 END) * 0.35::DOUBLE, 1) AS p1, round(least(100.0::DOUBLE, n30::DOUBLE / greatest(most, 1) * 100) * 0.25::DOUBLE, 1) AS p2,
round((CASE WHEN days IS NULL THEN 0 WHEN days <= 7 THEN 100 WHEN days <= 30 THEN 80 WHEN days <= 90 THEN 50 WHEN days <= 180 THEN 25 ELSE 10 END) * 0.2::DOUBLE, 1) AS p3, round((CASE WHEN mobile IS NOT NULL THEN 35 ELSE 0 END) * 0.1::DOUBLE, 1) AS p4, round(40 * 0.1::DOUBLE, 1) AS p5,
CASE WHEN n30 >= 10 THEN 5 WHEN n30 >= 3 THEN 25 WHEN total > 0 THEN 5 ELSE 0 END AS act FROM r)
SELECT user_id, contact_name, round(0.0::DOUBLE + p1 + p2 + p3 + p4 + p5 + act * 0.05::DOUBLE, 1) AS score FROM p""")
def contact_rule_score(spark, d):
    from pyspark.sql.window import Window

    i = interactions(spark, d)
    s = i.groupBy("user_id", "contact_name").agg(F.count_if(last_days(C("event_time"), as_of(), 7)).alias("n30"), F.count("*").alias("total"), F.max("event_time").alias("last_time"), F.max("mobile").alias("mobile"))
    r = s.join(contacts(spark, d).select("user_id", "contact_name", "role_category"), ["user_id", "contact_name"]).withColumn("most", F.max("n30").over(Window.partitionBy("user_id")))
    none = F.lit(None).cast("string")
    parts = scoring.contact_parts(C("role_category"), C("n30"), C("most"), scoring.days_since(as_of(), C("last_time")), C("mobile"), none, none, none, none)
    return r.select("user_id", "contact_name", scoring.contact_score(parts, scoring.activity_level(C("n30"), C("total"))).alias("score"))


@query(f"""{_B}, m AS (SELECT user_id, count(*) AS n3 FROM i WHERE event_time >= {NOW} - INTERVAL 3 MONTH GROUP BY 1), x AS (SELECT b.*, coalesce(n3, 0) AS n3, {_LEVEL} AS lv FROM b LEFT JOIN m ON b.id = m.user_id)
SELECT id, concat_ws('|', CASE lv WHEN '高' THEN '客户处于高意向阶段，建议重点跟进' WHEN '中' THEN '客户处于中意向阶段，需要持续培育' WHEN '低' THEN '客户意向度较低，建议先进行市场教育' END,
CASE WHEN n3 > 10 THEN '客户近3个月互动活跃（' || n3 || '次），购买信号强烈' WHEN n3 > 0 THEN '客户近3个月有' || n3 || '次互动记录，保持跟进' ELSE '客户近3个月暂无互动记录，建议主动触达' END,
CASE WHEN funnel_n > 0 THEN '客户现有' || funnel_n || '个漏斗内商机，需重点维护' END) AS said FROM x""")
def customer_insight(spark, d):
    m = interactions(spark, d).filter(last_months(C("event_time"), as_of(), 3)).groupBy(C("user_id").alias("m_id")).agg(F.count("*").alias("n3"))
    x = with_intent(base(spark, d)).join(m, C("id") == C("m_id"), "left").withColumn("n3", F.coalesce("n3", F.lit(0)))
    return x.select("id", F.array_join(scoring.insight(C("intent_level"), C("n3"), C("funnel_n")), "|").alias("said"))


@query(f"{_B} SELECT id, CASE WHEN last_time IS NOT NULL THEN '最近通过' || last_channel || '互动，建议结合内容兴趣跟进。' WHEN open_amount <> 0 THEN '存在在途商机金额，建议补充关键角色触达。' WHEN total <> 0 THEN '已有历史互动，建议按最近主题继续推进。' ELSE '暂无互动记录，建议先补充触达。' END AS basis FROM b")
def followup_text(spark, d):
    return base(spark, d).select("id", text.followup_basis(C("last_time"), C("last_channel"), C("open_amount"), C("total")).alias("basis"))


@query(f"{_B} SELECT id, concat_ws('|', 'ICT', attribute || '层', industry, nullif(stage, ''), 'p1', 'p2', 's1') AS tags FROM b")
def customer_tags(spark, d):
    tags = text.customer_tags(F.lit("ICT"), C("attribute"), C("industry"), C("stage"), text.from_jsonish(F.lit('["p1", "p2", "p3"]')), text.from_jsonish(F.lit('["s1","s2"]')))
    return base(spark, d).select("id", F.array_join(tags, "|").alias("tags"))


@query(f"""{_B} SELECT id, '{{"has_crm":' || (industry IS NOT NULL) || ',"has_opp":' || (open_n > 0) || ',"has_contacts":' || (contacts > 0) || ',"has_interactions":' || (total > 0) || '}}' AS coverage FROM b""")
def json_coverage(spark, d):
    parts = {"has_crm": C("industry").isNotNull(), "has_opp": C("open_n") > 0, "has_contacts": C("contacts") > 0, "has_interactions": C("total") > 0}
    return base(spark, d).select("id", F.to_json(F.struct(*[v.alias(k) for k, v in parts.items()])).alias("coverage"))


@query("""WITH q AS (SELECT conv_id, turn, lag(CASE WHEN role = 'user' THEN conv_id || '-' || turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)
SELECT conv_id, turn, CASE WHEN prev IS NOT NULL THEN prev || '的这些' || '客户列出 a b' ELSE '这些客户列出 a b' END AS question FROM q""")
def question_preprocess(spark, d):
    from pyspark.sql.window import Window

    own = F.when(C("role") == "user", F.concat_ws("-", "conv_id", "turn"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", text.preprocess_question(F.lit("  这些客户有哪些   a@  b "), F.lag(own).over(w)).alias("question"))


_ROLE_TEXTS = "CASE user_id % 4 WHEN 0 THEN '拍板人' WHEN 1 THEN '技术负责' WHEN 2 THEN '采购' ELSE '' END"


@query(f"""{R}, r AS (SELECT user_id, role_category AS v FROM k UNION ALL SELECT user_id, {_ROLE_TEXTS} FROM k), n AS (SELECT user_id, bool_or(v LIKE '%拍板%') AS a, bool_or(v LIKE '%决策%' AND v NOT LIKE '%拍板%') AS b, bool_or(v LIKE '%评估%' OR v LIKE '%技术%') AS c, bool_or(v LIKE '%采购%' OR v LIKE '%推动%') AS e FROM r GROUP BY 1)
SELECT user_id, CASE WHEN NOT (a OR b OR c OR e) AND user_id % 3 = 0 THEN '' ELSE concat_ws(',', CASE WHEN NOT a THEN '拍板者' END, CASE WHEN NOT b THEN '决策者' END, CASE WHEN NOT c THEN '评估者' END, CASE WHEN NOT e THEN '采购推动者' END) END AS missing FROM n""")
def missing_roles(spark, d):
    """Of the roles a buying centre needs, those that no contact of a customer has by either of its two role texts."""
    k = contacts(spark, d).withColumn("purchase_role", F.expr(_ROLE_TEXTS))
    texts = k.groupBy("user_id").agg(F.collect_set("role_category").alias("a"), F.collect_set("purchase_role").alias("b"))
    own = F.when(C("user_id") % 3 == 0, "全").otherwise("部分")
    return texts.select("user_id", F.array_join(text.missing_roles(F.concat("a", "b"), own), ",").alias("missing"))
