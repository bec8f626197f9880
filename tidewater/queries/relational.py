"""Filters, joins, aggregates, windows and set operations of the customer platform."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import text
from ..operators import aggregates as agg
from ..operators import merge
from ..operators import predicates as p
from ..sources.roles import AS_OF_TEXT, ROLES_SQL, as_of, customers, interactions, opportunities, table
from .registry import query

R = ROLES_SQL
NOW = f"TIMESTAMP '{AS_OF_TEXT}'"
C = F.col
COLS = ("id", "customer_name", "industry", "region")
PLAIN = "id, customer_name, industry, region"


@query(f"{R} SELECT {PLAIN} FROM c WHERE contains(lower(customer_name), '00012')")
def cust_keyword_like(spark, d):
    return customers(spark, d).filter(p.both(p.contains(C("customer_name"), "00012"))).select(*COLS)


@query(f"{R} SELECT {PLAIN} FROM c WHERE region IN ('山东', '山东区域') AND industry IN ('BUILDING', 'MACHINERY')")
def cust_region_in(spark, d):
    return customers(spark, d).filter(p.region_is(C("region"), "山东") & p.both(p.equals(C("industry"), ["BUILDING", "MACHINERY"]) + p.equals(C("owner_name"), None))).select(*COLS)


@query(f"{R} SELECT {PLAIN} FROM c WHERE region IS NULL OR region = '' OR region = '大客户部'")
def cust_region_other(spark, d):
    return customers(spark, d).filter(p.region_is(C("region"), "其他")).select(*COLS)


@query(f"{R} SELECT {PLAIN}, attribute FROM c WHERE attribute IS NULL OR attribute <> 'H'")
def cust_attr_non_heavy(spark, d):
    return customers(spark, d).filter(p.both(p.attribute_is(C("attribute"), "non_heavy"))).select(*COLS, "attribute")


@query(f"{R} SELECT opp_id, amount FROM o WHERE create_date >= DATE '1996-01-01' AND create_date < DATE '1996-04-01'")
def orders_half_open_window(spark, d):
    return opportunities(spark, d).filter(p.both(p.date_window(C("create_date"), "1996-01-01", "1996-03-31") + p.date_window(C("create_date"), "no date", None))).select("opp_id", "amount")


@query(f"{R} SELECT source_id, user_id FROM i WHERE event_time >= {NOW} - INTERVAL 7 DAY")
def events_rolling_7d(spark, d):
    return interactions(spark, d).filter(p.last_days(C("event_time"), as_of(), 7)).select("source_id", "user_id")


@query(f"{R} SELECT source_id, user_id FROM i WHERE event_time >= {NOW} - INTERVAL 30 DAY")
def events_rolling_30d(spark, d):
    return interactions(spark, d).filter(p.last_days(C("event_time"), as_of(), 30)).select("source_id", "user_id")


@query(f"{R} SELECT source_id, user_id FROM i WHERE event_time >= {NOW} - INTERVAL 3 MONTH")
def events_rolling_3m(spark, d):
    return interactions(spark, d).filter(p.last_months(C("event_time"), as_of(), 3)).select("source_id", "user_id")


@query(f"{R} SELECT source_id, channel FROM i WHERE channel = '4. 客户端拜访获取'")
def channel_other_bucket(spark, d):
    return interactions(spark, d).filter(p.channel_is(C("channel"), "other")).select("source_id", "channel")


@query(f"{R} SELECT {PLAIN} FROM c WHERE (contains(lower(industry), 'build') OR contains(lower(owner_name), 'asia')) AND (customer_name LIKE '%#00000%' )")
def or_of_words(spark, d):
    return customers(spark, d).filter(p.contains_any([C("industry"), C("owner_name")], ["BUILD", "asia"]) & p.name_is(C("customer_name"), "%#00000%")).select(*COLS)


# Joins


@query(f"{R} SELECT {PLAIN} FROM c WHERE EXISTS (SELECT 1 FROM i WHERE i.customer_name = c.customer_name AND channel IN ('email', '邮件'))")
def whitelist_semi(spark, d):
    email = interactions(spark, d).filter(p.channel_is(C("channel"), "email"))
    return p.matching(customers(spark, d), email, {"customer_name": "customer_name"}).select(*COLS)


@query(f"{R} SELECT {PLAIN} FROM c WHERE customer_name IN (SELECT customer_name FROM i WHERE event_time >= {NOW} - INTERVAL 7 DAY GROUP BY 1 HAVING count(*) >= 15)")
def in_having_semi(spark, d):
    recent = interactions(spark, d).filter(p.last_days(C("event_time"), as_of(), 7))
    return p.matching(customers(spark, d), p.with_at_least(recent, "customer_name", 15), {"customer_name": "customer_name"}).select(*COLS)


@query(f"{R} SELECT {PLAIN} FROM c WHERE id IN (SELECT user_id FROM i) OR id IN (SELECT customer_id FROM o WHERE amount > 450000)")
def in_or_in(spark, d):
    seen = interactions(spark, d).select(C("user_id").alias("k")).distinct().withColumn("seen", F.lit(True))
    large = opportunities(spark, d).filter("amount > 450000").select(C("customer_id").alias("k2")).distinct().withColumn("large", F.lit(True))
    return customers(spark, d).join(seen, C("id") == C("k"), "left").join(large, C("id") == C("k2"), "left").filter("seen OR large").select(*COLS)


@query(f"{R} SELECT {PLAIN} FROM c WHERE id NOT IN (SELECT customer_id FROM o)")
def not_in_anti(spark, d):
    return p.matching(customers(spark, d), opportunities(spark, d), {"id": "customer_id"}, keep=False).select(*COLS)


@query(f"{R} SELECT c.id, c.customer_name, c.industry, c.region FROM c LEFT JOIN i ON c.id = i.user_id WHERE i.user_id IS NULL")
def left_null_anti(spark, d):
    return p.matching(customers(spark, d), interactions(spark, d), {"id": "user_id"}, keep=False).select(*COLS)


@query(f"""{R}, m AS (SELECT contact_name, mobile, count(*) AS n, max(event_time) AS last_time FROM i GROUP BY 1, 2),
r AS (SELECT DISTINCT contact_name, mobile, customer_name FROM i)
SELECT r.contact_name, r.mobile, r.customer_name, m.n, strftime(m.last_time, '%Y-%m-%d %H:%M:%S') AS last_time FROM r LEFT JOIN m ON r.contact_name = m.contact_name AND r.mobile IS NOT DISTINCT FROM m.mobile""")
def null_safe_join(spark, d):
    i = interactions(spark, d)
    m = i.groupBy(C("contact_name").alias("cn"), C("mobile").alias("mb")).agg(F.count("*").alias("n"), F.max("event_time").alias("last_time"))
    r = i.select("contact_name", "mobile", "customer_name").distinct()
    return r.join(m, (C("contact_name") == C("cn")) & C("mobile").eqNullSafe(C("mb")), "left").select("contact_name", "mobile", "customer_name", "n", F.date_format("last_time", "yyyy-MM-dd HH:mm:ss").alias("last_time"))


@query(f"{R} SELECT c.id, c.customer_name, c.industry, c.region, s.opp_id, s.amount FROM c LEFT JOIN (SELECT * FROM o WHERE create_date = (SELECT max(create_date) FROM o)) s ON c.id = s.customer_id")
def snapshot_left_join(spark, d):
    o = opportunities(spark, d)
    newest = o.agg(F.max("create_date").alias("m"))
    snap = o.filter(C("create_date") == newest.scalar()).select("customer_id", "opp_id", "amount")
    return customers(spark, d).join(snap, C("id") == C("customer_id"), "left").select(*COLS, "opp_id", "amount")


@query(f"{R} SELECT customer_id, opp_id, amount, status FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY create_date DESC, opp_id DESC) AS n FROM o) WHERE n = 1")
def latest_row_per_key(spark, d):
    return merge.latest(opportunities(spark, d), ["customer_id"], [C("create_date").desc(), C("opp_id").desc()]).select("customer_id", "opp_id", "amount", "status")


@query(f"""{R}, p AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON a.nation = b.nation AND a.industry = b.industry AND a.attribute = 'H' AND b.attribute = 'H' AND a.id <> b.id),
kn AS (SELECT id AS a, id + 25 AS b FROM c)
SELECT a, b FROM p WHERE a < b AND NOT EXISTS (SELECT 1 FROM kn WHERE least(kn.a, kn.b) = least(p.a, p.b) AND greatest(kn.a, kn.b) = greatest(p.a, p.b))""")
def pair_unordered_anti(spark, d):
    h = customers(spark, d).filter("attribute = 'H'")
    known = customers(spark, d).select((C("id") + 25).alias("a"), C("id").alias("b"))
    return merge.unknown_pairs(h, ["nation", "industry"], "id", known, "a", "b")


@query(f"{R}, v AS (SELECT customer_id, max(stage) AS industry FROM o WHERE status = 'F' AND amount > 400000 GROUP BY 1) SELECT c.id, coalesce(v.industry, c.industry) AS industry FROM c LEFT JOIN v ON c.id = v.customer_id")
def update_join_coalesce(spark, d):
    v = opportunities(spark, d).filter("status = 'F' AND amount > 400000").groupBy(C("customer_id").alias("id")).agg(F.max("stage").alias("industry"))
    return merge.update_join(customers(spark, d), v, "id", ["industry"]).select("id", "industry")


# Aggregates


@query(f"{R} SELECT industry, count(DISTINCT nation) AS nations, count(DISTINCT CASE WHEN attribute = 'H' THEN nation END) AS heavy_nations, count(*) AS n FROM c GROUP BY 1")
def count_distinct_case(spark, d):
    return customers(spark, d).groupBy("industry").agg(F.count_distinct("nation").alias("nations"), F.count_distinct(F.when(C("attribute") == "H", C("nation"))).alias("heavy_nations"), F.count("*").alias("n"))


@query(f"""{R} SELECT customer_id, max(stage) AS purchase_stage, count(CASE WHEN is_active = 1 THEN 1 END) AS active_opp_count, round(coalesce(sum(CASE WHEN is_active = 1 THEN amount END), 0), 2) AS active_opp_amount,
count(CASE WHEN is_funnel = '是' THEN 1 END) AS funnel_opp_count, round(coalesce(sum(CASE WHEN status = 'F' THEN amount END), 0), 2) AS won_amount FROM o GROUP BY 1""")
def opp_metrics(spark, d):
    money = lambda cond: F.round(F.coalesce(F.sum(F.when(cond, C("amount"))), F.lit(0)), 2)
    return opportunities(spark, d).groupBy("customer_id").agg(F.max("stage").alias("purchase_stage"), F.count_if(C("is_active") == 1).alias("active_opp_count"), money(C("is_active") == 1).alias("active_opp_amount"), F.count_if(C("is_funnel") == "是").alias("funnel_opp_count"), money(C("status") == "F").alias("won_amount"))


@query(f"{R} SELECT owner_name, max(industry) AS industry, max(nation) AS nation, max(attribute) AS attribute FROM c GROUP BY 1")
def max_attr_per_customer(spark, d):
    return customers(spark, d).groupBy("owner_name").agg(*[F.max(x).alias(x) for x in ("industry", "nation", "attribute")])


@query(f"{R} SELECT customer_name, min(channel) AS last_interaction_channel, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels FROM i GROUP BY 1")
def channel_list_sorted(spark, d):
    return interactions(spark, d).groupBy("customer_name").agg(F.min("channel").alias("last_interaction_channel"), F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"))


@query(f"{R} SELECT customer_name, count(*) AS n FROM i GROUP BY 1 HAVING count(*) >= 70")
def having_min(spark, d):
    return interactions(spark, d).groupBy("customer_name").agg(F.count("*").alias("n")).filter("n >= 70")


@query("SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def dup_detector(spark, d):
    return table(spark, d, "part").groupBy("p_name").agg(F.count("*").alias("n")).filter("n > 1")


_CH = "CASE WHEN channel IS NULL OR trim(channel) = '' THEN '无渠道/未触达' WHEN channel IN ('email', '邮件') THEN 'email' WHEN channel IN ('web', '官网') THEN 'web' WHEN channel IN ('event', '直播/活动') THEN 'event' WHEN channel IN ('wechat', '微信') THEN 'wechat' ELSE 'other' END"


@query(f"{R} SELECT {_CH} AS channel, count(*) AS n, count(DISTINCT customer_name) AS customers FROM i GROUP BY 1")
def group_by_case_channel(spark, d):
    return interactions(spark, d).groupBy(text.normalize_channel(C("channel")).alias("channel")).agg(F.count("*").alias("n"), F.count_distinct("customer_name").alias("customers"))


@query(f"{R} SELECT coalesce(nullif(region, ''), '未知') AS label, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS share FROM c GROUP BY 1")
def funnel_distribution(spark, d):
    return agg.share_of_total(customers(spark, d).groupBy(agg.with_default(C("region"), "未知").alias("label")).agg(F.count("*").alias("n")), "n", "share")


@query(f"""{R} SELECT user_id, count(DISTINCT role_category) AS roles, CASE WHEN max((role_category = '决策者')::INT) + max((role_category = '技术评估者')::INT) + max((role_category = '使用者')::INT) = 3 THEN '全'
WHEN count(DISTINCT role_category) > 0 THEN '部分' ELSE '无' END AS role_coverage FROM k GROUP BY 1""")
def role_coverage(spark, d):
    from ..sources.roles import contacts

    return contacts(spark, d).groupBy("user_id").agg(*[v.alias(k) for k, v in agg.role_coverage(C("role_category")).items()])


@query(f"""{R} SELECT 'all' AS section, '' AS label, count(*) AS n, round(sum(balance), 2) AS balance FROM c UNION ALL SELECT 'industry', industry, count(*), round(sum(balance), 2) FROM c GROUP BY 2
UNION ALL SELECT 'region', coalesce(nullif(region, ''), '未知'), count(*), round(sum(balance), 2) FROM c GROUP BY 2 UNION ALL SELECT 'attribute', coalesce(attribute, '无'), count(*), round(sum(balance), 2) FROM c GROUP BY 2""")
def overview_sections(spark, d):
    dims = {"industry": C("industry"), "region": agg.with_default(C("region"), "未知"), "attribute": agg.with_default(C("attribute"), "无")}
    return agg.sections(customers(spark, d), dims, {"n": F.count("*"), "balance": F.round(F.sum("balance"), 2)})


@query(f"{R} SELECT stage, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM o), 2) AS pct FROM o GROUP BY 1")
def pct_of_total(spark, d):
    return agg.share_of_total(opportunities(spark, d).groupBy("stage").agg(F.count("*").alias("n")), "n", "pct")


_OPEN, _CLICK = f"regexp_matches(concat_ws(' ', behavior_type, content), '{text.OPENED}', 'i')", f"regexp_matches(concat_ws(' ', behavior_type, content), '{text.CLICKED}', 'i')"
_EFFECT = f"""{R}, e AS (SELECT content, behavior_type, count(*) AS touch_count, count(DISTINCT customer_name) AS unique_customers, sum(({_OPEN})::INT) AS opens, sum(({_CLICK})::INT) AS clicks, sum(is_high_value) AS mql
FROM i WHERE content IS NOT NULL AND trim(content) NOT IN ('', '--') GROUP BY 1, 2)
SELECT content, behavior_type, touch_count, unique_customers, round(opens * 100.0 / greatest(1, unique_customers), 2) AS open_rate, round(clicks * 100.0 / greatest(1, unique_customers), 2) AS click_rate, mql::BIGINT AS mql FROM e"""


@query(_EFFECT)
def content_effect(spark, d):
    return agg.content_effect(interactions(spark, d))


@query(f"{_EFFECT} ORDER BY touch_count DESC, unique_customers DESC, content, behavior_type LIMIT 15")
def top15_content(spark, d):
    """The 15 contents that are the feature of the report."""
    return merge.page(agg.content_effect(interactions(spark, d)), [C("touch_count").desc(), C("unique_customers").desc(), C("content"), C("behavior_type")], 1, 15)


@query(f"{R} SELECT v AS status, count(o.opp_id) AS n, (SELECT count(*) FROM o) AS total FROM (VALUES ('O'), ('P'), ('F'), ('X')) s(v) LEFT JOIN o ON o.status = v GROUP BY 1")
def status_counts_zero_fill(spark, d):
    return agg.zero_filled(opportunities(spark, d), "status", ["O", "P", "F", "X"])


@query(f"{R} SELECT stage, status, count(*) AS n, round(sum(amount), 2) AS amount, round(avg(amount), 2) AS mean FROM o GROUP BY ROLLUP (stage, status)")
def pipeline_rollup(spark, d):
    return opportunities(spark, d).rollup("stage", "status").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("amount"), F.round(F.avg("amount"), 2).alias("mean"))


_REASON = "CASE stage WHEN '1-URGENT' THEN '客户预算被砍，报价过高' WHEN '2-HIGH' THEN '报价过高' WHEN '3-MEDIUM' THEN '友商中标' WHEN '4-NOT SPECIFIED' THEN '' ELSE '决策人离职' END"
_RATE = "CASE WHEN opp_id % 10 = 0 THEN 100 ELSE 30 END"


@query(f"""{R} SELECT CASE WHEN coalesce(reason, '') = '' THEN '—' WHEN regexp_matches(reason, '预算') THEN '预算不足' WHEN regexp_matches(reason, '价|报价|价格') THEN '价格竞争' WHEN regexp_matches(reason, '竞品|友商|竞争') THEN '竞品影响' WHEN regexp_matches(reason, '关键|联系人|决策') THEN '关键人缺失'
WHEN regexp_matches(reason, '渠道|代理') THEN '渠道问题' WHEN regexp_matches(reason, '流标|废标|招标') THEN '流标 / 废标' ELSE '其他' END AS reason, count(*) AS n FROM (SELECT {_REASON} AS reason FROM o) GROUP BY 1""")
def loss_reason(spark, d):
    return opportunities(spark, d).groupBy(text.loss_reason(F.expr(_REASON)).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""{R} SELECT customer_id, floor(avg(CASE WHEN status = 'F' AND amount > 200000 OR {_RATE} >= 100 OR stage = '成交' OR status = 'P' AND stage = '5-LOW' THEN 100.0 ELSE 0 END) + 0.5)::INT AS win_rate FROM o GROUP BY 1""")
def win_rate(spark, d):
    """Won of all opportunities of a customer, in whole percent."""
    amount = F.when((C("status") == "F") & (C("amount") > 200000), C("amount"))
    stage = F.when((C("status") == "P") & (C("stage") == "5-LOW"), "赢单").otherwise(C("stage"))
    won = text.is_won(amount, F.expr(_RATE), F.lit(""), stage)
    return opportunities(spark, d).groupBy("customer_id").agg(F.floor(F.avg(F.when(won, 100.0).otherwise(0.0)) + 0.5).cast("int").alias("win_rate"))


@query(f"{R} SELECT channel, count(*) AS n, strftime(max(event_time), '%Y-%m-%d %H:%M:%S') AS last_time FROM i GROUP BY 1")
def channel_summary(spark, d):
    return interactions(spark, d).groupBy("channel").agg(F.count("*").alias("n"), F.date_format(F.max("event_time"), "yyyy-MM-dd HH:mm:ss").alias("last_time"))


# Windows and top-k


@query(f"""{R}, g AS (SELECT contact_name, mobile, channel, count(*) AS n, max(event_time) AS last_time FROM i GROUP BY 1, 2, 3)
SELECT contact_name, mobile, channel, n FROM (SELECT *, row_number() OVER (PARTITION BY contact_name, mobile ORDER BY n DESC, last_time DESC, channel) AS rn FROM g) WHERE rn = 1""")
def preferred_channel(spark, d):
    g = interactions(spark, d).groupBy("contact_name", "mobile", "channel").agg(F.count("*").alias("n"), F.max("event_time").alias("last_time"))
    return merge.latest(g, ["contact_name", "mobile"], [C("n").desc(), C("last_time").desc(), C("channel")]).select("contact_name", "mobile", "channel", "n")


@query(f"{R} SELECT {PLAIN}, balance FROM c ORDER BY balance DESC, id LIMIT 20 OFFSET 40")
def page_offset(spark, d):
    """The third page of 20, a page being the feature."""
    return merge.page(customers(spark, d), [C("balance").desc(), C("id")], 3, 20).select(*COLS, "balance")


@query(f"""{R}, s AS (SELECT c.customer_name, x.opp_id, x.amount FROM (SELECT * FROM c WHERE attribute = 'H') c LEFT JOIN (SELECT * FROM o WHERE amount > 480000) x ON c.id = x.customer_id)
SELECT customer_name, opp_id, amount FROM s ORDER BY opp_id IS NULL, amount DESC, customer_name, opp_id LIMIT 25""")
def null_last_sort_page(spark, d):
    big = opportunities(spark, d).filter("amount > 480000").select("customer_id", "opp_id", "amount")
    s = customers(spark, d).filter("attribute = 'H'").join(big, C("id") == C("customer_id"), "left").select("customer_name", "opp_id", "amount")
    return merge.page(s, [C("opp_id").isNull(), C("amount").desc(), C("customer_name"), C("opp_id")], 1, 25)


@query(f"""{R}, g AS (SELECT user_id, contact_name, count(*) AS n FROM i GROUP BY 1, 2) SELECT user_id, contact_name, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, contact_name)::INT AS rank FROM g) WHERE rank <= 2""")
def top_contacts(spark, d):
    g = interactions(spark, d).groupBy("user_id", "contact_name").agg(F.count("*").alias("n"))
    return merge.top(g, ["user_id"], [C("n").desc(), C("contact_name")], 2)


# Set operations


@query(f"{R} SELECT 'industry' AS facet, industry AS value FROM c GROUP BY 2 UNION ALL SELECT 'owner', owner_name FROM c GROUP BY 2 UNION ALL SELECT 'channel', channel FROM i GROUP BY 2")
def facet_union(spark, d):
    c, i = customers(spark, d), interactions(spark, d)
    one = lambda df, n, col: df.select(F.lit(n).alias("facet"), C(col).alias("value")).distinct()
    return reduce(lambda a, b: a.unionByName(b), [one(c, "industry", "industry"), one(c, "owner", "owner_name"), one(i, "channel", "channel")])


@query("""WITH u AS (SELECT 0 AS pr, c_custkey AS k, c_name AS name, c_nationkey AS nk FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 1, c_custkey, upper(c_name), c_nationkey FROM customer
UNION ALL SELECT 2, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey END, s_name, s_nationkey FROM supplier)
SELECT k, name, nk FROM (SELECT *, row_number() OVER (PARTITION BY k, nk ORDER BY pr, name) AS n FROM u) WHERE n = 1 OR k IS NULL""")
def first_wins_union(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    a = c.filter("c_custkey % 2 = 0").selectExpr("c_custkey AS k", "c_name AS name", "c_nationkey AS nk")
    b = c.selectExpr("c_custkey AS k", "upper(c_name) AS name", "c_nationkey AS nk")
    x = s.selectExpr("CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey END AS k", "s_name AS name", "s_nationkey AS nk")
    return merge.first_wins([a, b, x], ["k", "nk"], ["name"])


@query("""WITH n AS (SELECT o_custkey AS k, any_value(NULL)::VARCHAR AS a, max(o_orderpriority) AS b FROM orders WHERE o_custkey % 3 = 0 GROUP BY 1 UNION ALL SELECT 1000000, 'new', 'new')
SELECT coalesce(c_custkey, n.k) AS k, CASE WHEN c_custkey IS NULL THEN n.a ELSE coalesce(n.a, c_name) END AS a, CASE WHEN c_custkey IS NULL THEN n.b ELSE coalesce(n.b, c_mktsegment) END AS b, c_acctbal AS kept
FROM customer FULL OUTER JOIN n ON c_custkey = n.k""")
def upsert_last_wins(spark, d):
    old = table(spark, d, "customer").selectExpr("c_custkey AS k", "c_name AS a", "c_mktsegment AS b", "c_acctbal AS kept")
    new = table(spark, d, "orders").filter("o_custkey % 3 = 0").groupBy(C("o_custkey").alias("k")).agg(F.lit(None).cast("string").alias("a"), F.max("o_orderpriority").alias("b"))
    more = spark.range(1).selectExpr("1000000L AS k", "'new' AS a", "'new' AS b")
    return merge.upsert(old, new.unionByName(more), ["k"], ["a", "b"])


@query(f"{R} SELECT customer_name FROM i WHERE event_time > TIMESTAMP '2024-01-29 00:00:00' UNION SELECT customer_name FROM c WHERE balance > 9500 UNION SELECT c.customer_name FROM o JOIN c ON c.id = o.customer_id WHERE amount > 495000")
def affected_keys(spark, d):
    c = customers(spark, d)
    big = opportunities(spark, d).filter("amount > 495000").join(c, C("customer_id") == C("id")).select("customer_name")
    return interactions(spark, d).filter("event_time > TIMESTAMP_NTZ '2024-01-29 00:00:00'").select("customer_name").union(c.filter("balance > 9500").select("customer_name")).union(big).distinct()
