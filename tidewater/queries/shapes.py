"""Serving pages, the dashboard, and the shapes of users' questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import predicates as p
from ..operators.aggregates import share_of_total
from ..plans import campaign, etl, serving
from ..sources.roles import AS_OF_TEXT, ROLES_SQL, as_of, contacts, customers, interactions, load_tables, opportunities, table
from .pipeline import _C360
from .registry import query

R, C = ROLES_SQL, F.col
NOW = f"TIMESTAMP '{AS_OF_TEXT}'"


@query(f"{R} SELECT id, customer_name FROM c WHERE customer_name LIKE 'Customer#00000001%'")
def nl_prefix_like(spark, d):
    return customers(spark, d).filter(C("customer_name").startswith("Customer#00000001")).select("id", "customer_name")


@query(f"{R} SELECT opp_id, amount FROM o WHERE amount BETWEEN 100000 AND 120000")
def nl_between(spark, d):
    return opportunities(spark, d).filter(C("amount").between(100000, 120000)).select("opp_id", "amount")


@query(f"{R} SELECT strftime(create_date, '%Y-%m') AS month, count(*) AS n, round(sum(amount), 2) AS amount FROM o GROUP BY 1")
def nl_month_group(spark, d):
    return opportunities(spark, d).groupBy(F.date_format("create_date", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("amount"))


@query(f"{R} SELECT industry, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS share FROM c GROUP BY 1")
def nl_share_of_total(spark, d):
    return share_of_total(customers(spark, d).groupBy("industry").agg(F.count("*").alias("n")), "n", "share")


@query(f"{R} SELECT industry, count(CASE WHEN attribute = 'H' THEN 1 END) AS heavy, count(CASE WHEN attribute = 'N' THEN 1 END) AS normal FROM c GROUP BY 1")
def nl_crosstab(spark, d):
    return customers(spark, d).groupBy("industry").pivot("attribute", ["H", "N"]).agg(F.count(F.lit(1))).select("industry", F.coalesce("H", F.lit(0)).alias("heavy"), F.coalesce("N", F.lit(0)).alias("normal"))


@query(f"{R} SELECT user_id, " + ", ".join(f"count(CASE WHEN event_time >= {NOW} - INTERVAL {n} DAY THEN 1 END) AS n{n}" for n in (7, 30, 90)) + " FROM i GROUP BY 1")
def nl_periods_7_30_90(spark, d):
    return interactions(spark, d).groupBy("user_id").agg(*[F.count_if(p.last_days(C("event_time"), as_of(), n)).alias(f"n{n}") for n in (7, 30, 90)])


@query(f"{R} SELECT c.customer_name, k.contact_name, count(i.source_id) AS n FROM c JOIN k ON k.user_id = c.id JOIN i ON i.user_id = c.id AND i.contact_name = k.contact_name WHERE c.industry = 'BUILDING' GROUP BY 1, 2")
def nl_three_way_join(spark, d):
    i = interactions(spark, d).groupBy("user_id", "contact_name").agg(F.count("*").alias("n"))
    k = contacts(spark, d).select("user_id", "contact_name")
    c = customers(spark, d).filter("industry = 'BUILDING'").select("id", "customer_name")
    return c.join(k, C("id") == C("user_id")).join(i, ["user_id", "contact_name"]).select("customer_name", "contact_name", "n")


@query(f"{R} SELECT id, customer_name FROM c WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.user_id = c.id AND role_category = '决策者')")
def nl_no_decision_maker(spark, d):
    return p.matching(customers(spark, d), contacts(spark, d).filter(text.key_role(C("role_category")) == "决策者"), {"id": "user_id"}, keep=False).select("id", "customer_name")


@query(f"{R} SELECT customer_name, count(*) AS n FROM i WHERE event_time >= date_trunc('month', {NOW} + INTERVAL 1 DAY) - INTERVAL 1 MONTH AND event_time < date_trunc('month', {NOW} + INTERVAL 1 DAY) GROUP BY 1 ORDER BY n DESC, customer_name LIMIT 10")
def nl_prev_month_top10(spark, d):
    """The ten customers with most interactions last month, ten being what is asked for."""
    this = F.date_trunc("MONTH", as_of() + F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz")
    rows = interactions(spark, d).filter((C("event_time") >= this - F.expr("INTERVAL 1 MONTH")) & (C("event_time") < this))
    return rows.groupBy("customer_name").agg(F.count("*").alias("n")).orderBy(C("n").desc(), "customer_name").limit(10)


@query(f"""{R}, f AS (SELECT customer_id, min(create_date) AS first FROM o GROUP BY 1) SELECT CASE WHEN first >= TIMESTAMP '1996-01-01' THEN 'new' ELSE 'old' END AS cohort, count(DISTINCT o.customer_id) AS customers, count(*) AS n, round(avg(amount), 2) AS mean FROM o JOIN f ON o.customer_id = f.customer_id GROUP BY 1""")
def nl_old_new_cohort(spark, d):
    o = opportunities(spark, d)
    f = o.groupBy(C("customer_id").alias("k")).agg(F.min("create_date").alias("first"))
    cohort = F.when(C("first") >= F.lit("1996-01-01").cast("timestamp_ntz"), "new").otherwise("old")
    return o.join(f, C("customer_id") == C("k")).groupBy(cohort.alias("cohort")).agg(F.count_distinct("customer_id").alias("customers"), F.count("*").alias("n"), F.round(F.avg("amount"), 2).alias("mean"))


def _served(spark, d):
    i = interactions(spark, d)
    seen = i.groupBy(C("customer_name").alias("n")).agg(F.count("*").cast("int").alias("interaction_count_total"), F.count_if(p.last_days(C("event_time"), as_of(), 7)).cast("int").alias("interaction_count_30d"), F.max("event_time").alias("last_interaction_time"), F.min("channel").alias("last_interaction_channel"))
    return customers(spark, d).join(seen, C("customer_name") == C("n"), "left").drop("n").withColumn("intent_score", F.coalesce("interaction_count_30d", F.lit(0)))


@query(f"{R}, g AS (SELECT customer_name FROM i WHERE channel = 'web' AND event_type LIKE '%click%' GROUP BY 1 HAVING count(*) >= 14) SELECT c.id, c.customer_name FROM c JOIN g USING (customer_name) WHERE industry IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')")
def nl_distinct_customer_having(spark, d):
    asked = {"_distinct_customer": True, "interaction_min": 14, "content": None, "industry": ["BUILDING", "MACHINERY", "HOUSEHOLD"], "behavior_type": "点击邮件"}
    tables = {"customer_360": _served(spark, d), "interaction_detail": interactions(spark, d)}
    return p.run_filter(tables, asked, "interaction_detail", as_of()).select("id", "customer_name")


@query(f"{R} SELECT c.id, c.customer_name, coalesce(s.n7, 0)::INT AS n7 FROM c LEFT JOIN (SELECT customer_name, count(CASE WHEN event_time >= {NOW} - INTERVAL 7 DAY THEN 1 END) AS n7 FROM i GROUP BY 1) s USING (customer_name) WHERE coalesce(s.n7, 0) >= 8 AND owner_name IN ('ASIA', 'EUROPE', 'AFRICA', 'AMERICA') OR false")
def nl_compiled_filter(spark, d):
    asked = {"interaction_count_30d": 8, "owner_name": None, "unknown": 1, "interaction_min": 99}
    rows = p.run_filter({"customer_360": _served(spark, d)}, asked, "customer_360", as_of())
    return rows.filter(C("owner_name").isin("ASIA", "EUROPE", "AFRICA", "AMERICA")).select("id", "customer_name", C("interaction_count_30d").alias("n7"))


_CODE = "CASE WHEN channel IN ('email', '邮件') THEN 1 ELSE 0 END"


@query(f"""{R}, s AS (SELECT customer_name, count(*) AS n FROM i WHERE event_time >= {NOW} - INTERVAL 7 DAY GROUP BY 1 HAVING count(*) >= 5), e AS (SELECT DISTINCT customer_name FROM i WHERE channel IN ('email', '邮件'))
SELECT id, c.customer_name FROM c JOIN s USING (customer_name) JOIN e USING (customer_name) WHERE (region IN ('山东', '山东区域')) AND (attribute IS NULL OR attribute <> 'H')""")
def customer_list_filters(spark, d):
    f = serving.CustomerFilter(region="山东", attribute="non_heavy", interaction_min=5, interaction_period=7, channel="email")
    return serving.customer_rows(_served(spark, d).withColumn("purchase_stage", F.lit(None).cast("string")).withColumn("intent_level", F.lit(None).cast("string")), interactions(spark, d), f, as_of()).select("id", "customer_name")


@query(f"""{R}, t AS (SELECT * FROM o WHERE create_date = (SELECT max(create_date) FROM o)), a AS (SELECT 'K' || opp_id AS code, 'Customer#' || lpad((customer_id * 3)::VARCHAR, 9, '0') AS customer_name FROM t)
SELECT a.code, a.customer_name, c.industry, c.id IS NOT NULL AS matched FROM a LEFT JOIN c USING (customer_name)""")
def key_account_snapshot(spark, d):
    a = opportunities(spark, d).select(F.concat(F.lit("K"), "opp_id").alias("code"), F.concat(F.lit("Customer#"), F.lpad((C("customer_id") * 3).cast("string"), 9, "0")).alias("name"), C("create_date").alias("time"))
    return serving.key_account_rows(a, customers(spark, d)).select("code", "customer_name", "industry", "matched")


@query(f"""{R} SELECT 'industry' AS facet, industry AS value, 0 AS ord FROM c GROUP BY 2 UNION ALL SELECT 'owner_name', owner_name, 0 FROM c GROUP BY 2
UNION ALL SELECT DISTINCT 'region', CASE WHEN region IN ('山东', '山东区域') THEN '山东' WHEN region = '广东' THEN '广东' ELSE '其他' END, CASE WHEN region IN ('山东', '山东区域') THEN 4 WHEN region = '广东' THEN 1 ELSE 27 END FROM c WHERE region <> ''
UNION ALL SELECT DISTINCT 'channel', CASE channel WHEN '官网' THEN 'web' WHEN 'web' THEN 'web' WHEN '直播/活动' THEN 'event' WHEN '邮件' THEN 'email' ELSE 'other' END, CASE channel WHEN '官网' THEN 2 WHEN 'web' THEN 2 WHEN '直播/活动' THEN 3 WHEN '邮件' THEN 1 ELSE 5 END FROM i""")
def list_facets(spark, d):
    none = F.lit(None).cast("string")
    return serving.facets(customers(spark, d).withColumns({"purchase_stage": none, "intent_level": none}), interactions(spark, d))


_CAMP = f"{_C360}, cc AS (SELECT *, coalesce(n30, 0) AS x FROM c360), sn AS (SELECT DISTINCT customer_name AS s FROM detail)"


def _campaign(spark, d):
    t = etl.run_full(load_tables(spark, d), as_of(), spark)
    return t["customer_360"].withColumn("campaign_tag", F.lit("ICT")), t["interaction_detail"]


@query(f"""{_CAMP} SELECT count(DISTINCT customer_name) AS total_customers, count(DISTINCT s) AS active_customers, sum(coalesce(nullif(active_n, 0), funnel_n, 0))::BIGINT AS opportunities, sum(coalesce(active_amount, 0))::DOUBLE AS amount, count(DISTINCT CASE WHEN won > 0 THEN customer_name END) AS deal_customers FROM cc LEFT JOIN sn ON s = customer_name""")
def campaign_kpis(spark, d):
    c, i = _campaign(spark, d)
    return campaign.kpis(campaign.scope(c, "ICT"), campaign.touches(i)).withColumn("amount", C("amount").cast("double"))


@query(f"{_CAMP} SELECT coalesce(nullif(purchase_stage, ''), '未知阶段') AS label, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS share FROM cc GROUP BY 1")
def campaign_stage(spark, d):
    return campaign.distribution(_campaign(spark, d)[0], "stage")


@query(f"""{_CAMP}, r AS (SELECT customer_name, coalesce(nullif(purchase_stage, ''), '未知阶段') AS stage, coalesce(nullif(role_coverage, ''), '0/4') AS roles, coalesce(nullif(purchase_stage, ''), '未知') AS funnel,
CASE WHEN first_channel IS NULL THEN '无渠道/未触达' WHEN first_channel IN ('email') THEN 'email' WHEN first_channel IN ('web', '官网') THEN 'web' WHEN first_channel = 'event' THEN 'event' WHEN first_channel = 'wechat' THEN 'wechat' ELSE 'other' END AS channel, s IS NOT NULL AS active, coalesce(won > 0, false) AS deal FROM cc LEFT JOIN sn ON s = customer_name),
u AS (SELECT 'all' AS section, '' AS label, * FROM r UNION ALL SELECT 'stage', stage, * FROM r UNION ALL SELECT 'roles', roles, * FROM r UNION ALL SELECT 'funnel', funnel, * FROM r UNION ALL SELECT 'channel', channel, * FROM r)
SELECT section, label, count(DISTINCT customer_name) AS n, count(CASE WHEN active THEN 1 END) AS active, count(CASE WHEN deal THEN 1 END) AS deals, round(count(DISTINCT customer_name) * 100.0 / (SELECT count(DISTINCT customer_name) FROM r), 2) AS share FROM u GROUP BY 1, 2""")
def campaign_overview(spark, d):
    return campaign.overview(*_campaign(spark, d)).drop("amount")


@query("SELECT o_orderkey AS k, '阶段' || (o_orderkey % 7) AS stage, CASE o_orderkey % 7 WHEN 1 THEN '初步接触阶段' WHEN 2 THEN '价值确认阶段' WHEN 3 THEN '方案评估阶段' WHEN 4 THEN '招投标准备阶段' WHEN 5 THEN '采购确认阶段' WHEN 6 THEN '采购落地阶段' ELSE '阶段0' END AS words, (o_orderkey % 7)::INT AS number FROM orders")
def stage_words(spark, d):
    s = F.concat(F.lit("阶段"), C("o_orderkey") % 7)
    return table(spark, d, "orders").select(C("o_orderkey").alias("k"), s.alias("stage"), text.stage_text(s).alias("words"), text.number_in_stage(s).alias("number"))


@query("SELECT o_orderkey AS k, CASE o_orderkey % 7 WHEN 0 THEN 'email' WHEN 1 THEN 'web' WHEN 2 THEN 'wechat' WHEN 3 THEN 'event' WHEN 4 THEN 'event' WHEN 5 THEN 'wechat' ELSE 'fax' END AS channel FROM orders")
def channel_words(spark, d):
    raw = F.element_at(F.array(*map(F.lit, ("E-Mail ", "公司官网", "企业微信", "线下沙龙活动", "展会", "QQ群", "fax"))), (C("o_orderkey") % 7 + 1).cast("int"))
    return table(spark, d, "orders").select(C("o_orderkey").alias("k"), text.channel_of_words(raw).alias("channel"))
