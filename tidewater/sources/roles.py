"""The driver's tables in the roles of the customer platform, as frames and as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: All times are relative to this one.
AS_OF_TEXT = "2024-01-31 00:00:00"


def as_of() -> Column:
    return F.lit(AS_OF_TEXT).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, *exprs: str, where: str | None = None) -> DataFrame:
    df = table(spark, sf_dir, name)
    return (df.filter(where) if where else df).selectExpr(*exprs)


#: Expressions that both engines read alike.
REGION = "CASE c_nationkey % 6 WHEN 0 THEN '山东' WHEN 1 THEN '山东区域' WHEN 2 THEN '' WHEN 3 THEN NULL WHEN 4 THEN '大客户部' ELSE '广东' END"
ATTRIBUTE = "CASE WHEN c_acctbal >= 7000 THEN 'H' WHEN c_acctbal < 0 THEN NULL ELSE 'N' END"
CHANNEL = "CASE event_type WHEN 'view' THEN '官网' WHEN 'click' THEN 'web' WHEN 'signup' THEN '直播/活动' WHEN 'purchase' THEN '邮件' ELSE '4. 客户端拜访获取' END"
BEHAVIOUR = "CASE event_type WHEN 'view' THEN '访问落地页' WHEN 'click' THEN '点击邮件链接' WHEN 'signup' THEN '报名会议' WHEN 'purchase' THEN '下载资料' ELSE '其他' END"
_CUSTOMER = (f"c_custkey AS id", "c_name AS customer_name", "c_mktsegment AS industry", f"{REGION} AS region", "c_nationkey AS nation_id", "c_acctbal AS balance", f"{ATTRIBUTE} AS attribute")  # noqa: F541
_EVENT = ("event_id AS source_id", "user_id", f"{CHANNEL} AS channel", "event_type", f"{BEHAVIOUR} AS behavior_type", "props AS content", "ts AS event_time", "CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS is_high_value", "CONCAT('P', CAST(event_id % 3 AS STRING)) AS contact_name", "CASE WHEN event_id % 11 = 0 THEN NULL ELSE CONCAT('138', LPAD(CAST(user_id AS STRING), 8, '0')) END AS mobile", "value")
_ORDER = ("o_orderkey AS opp_id", "o_custkey AS customer_id", "o_orderstatus AS status", "o_totalprice AS amount", "o_orderdate AS create_date", "o_orderpriority AS stage", "CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS is_active", "CASE WHEN o_orderstatus = 'P' THEN '是' ELSE '否' END AS is_funnel")


def customers(spark: SparkSession, d: str) -> DataFrame:
    """id, customer_name, industry, region, attribute, balance, nation, owner_name."""
    nation = view(spark, d, "nation", "n_nationkey", "n_name AS nation", "n_regionkey")
    region = view(spark, d, "region", "r_regionkey", "r_name AS owner_name")
    return view(spark, d, "customer", *_CUSTOMER).join(nation, F.col("nation_id") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).drop("n_nationkey", "n_regionkey", "r_regionkey", "nation_id")


def interactions(spark: SparkSession, d: str) -> DataFrame:
    """Events with the name of their customer."""
    names = view(spark, d, "customer", "c_custkey", "c_name AS customer_name")
    return view(spark, d, "events", *_EVENT).join(names, F.col("user_id") == F.col("c_custkey")).drop("c_custkey")


def opportunities(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "orders", *_ORDER)


def contacts(spark: SparkSession, d: str) -> DataFrame:
    """A contact for each customer and name that occurs in the interactions."""
    roles = "CASE substr(contact_name, 2, 1) WHEN '0' THEN '决策者' WHEN '1' THEN '使用者' ELSE '其他' END"
    return interactions(spark, d).select("user_id", "customer_name", "contact_name", F.expr(f"{roles} AS role_category")).distinct()


_q = lambda parts: ", ".join(parts).replace("AS STRING", "AS VARCHAR")
#: The same roles for DuckDB: c, i, o and k.
ROLES_SQL = f"""
WITH c AS (SELECT {_q(_CUSTOMER)}, n_name AS nation, r_name AS owner_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
i AS (SELECT {_q(_EVENT)}, c_name AS customer_name FROM events JOIN customer ON user_id = c_custkey),
o AS (SELECT {_q(_ORDER)} FROM orders),
k AS (SELECT DISTINCT user_id, customer_name, contact_name, CASE substr(contact_name, 2, 1) WHEN '0' THEN '决策者' WHEN '1' THEN '使用者' ELSE '其他' END AS role_category FROM i)
"""

# The source tables of the load ---------------------------------------------------------------------------------
_PHONE = "CONCAT('139', LPAD(CAST({} AS STRING), 8, '0'))"
_LEAD_NAME = "CONCAT('Customer#', LPAD(CAST({} AS STRING), 9, '0'))"
_SECONDS = "{seconds}"
# Amounts are whole, since engines differ in how a double halfway between two decimals is cast.
LOAD = {
    "zhique_contact": ("customer", "c_nationkey < 15", ("c_custkey AS id", "c_name AS related_company", "c_mktsegment AS industry", "CONCAT('Contact ', CAST(c_custkey AS STRING)) AS contact_name", f"CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE {_PHONE.format('c_custkey')} END AS mobile", "CONCAT(CAST(c_custkey AS STRING), '@a.example') AS email", "CONCAT('D', CAST(c_custkey % 4 AS STRING)) AS department")),
    "crm_contact": ("customer", "c_custkey % 2 = 0", ("c_custkey AS id", "CONCAT('Crm ', CAST(c_custkey AS STRING)) AS contact_name", "c_name AS customer_name", f"{_PHONE.format('c_custkey')} AS mobile", "CONCAT(CAST(c_custkey AS STRING), '@b.example') AS email", "CASE c_custkey % 5 WHEN 0 THEN '拍板者' WHEN 1 THEN '评估者' WHEN 2 THEN '使用者' WHEN 3 THEN '经理' END AS purchase_role", "c_mktsegment AS industry", "CONCAT('R', CAST(c_nationkey AS STRING)) AS sales_region", f"{ATTRIBUTE} AS attribute", "CONCAT('S', CAST(c_custkey % 10 AS STRING)) AS sales_name")),
    "marketing_lead": ("supplier", "s_suppkey >= 0", ("s_suppkey AS id", f"CASE WHEN s_suppkey % 2 = 0 THEN {_LEAD_NAME.format('s_suppkey')} END AS final_company_name", f"{_LEAD_NAME.format('s_suppkey + 1')} AS customer_company", "CONCAT('Lead ', CAST(s_suppkey AS STRING)) AS customer_name", f"CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE {_PHONE.format('s_suppkey + 5000000')} END AS contact_phone", "CONCAT(CAST(s_suppkey AS STRING), '@c.example') AS email", "CONCAT('F', CAST(s_suppkey % 4 AS STRING)) AS lead_function")),
    "linkflow_contacts": ("customer", "c_custkey < 150", ("c_custkey AS id", "c_custkey AS contact_id", "CONCAT('Web ', CAST(c_custkey AS STRING)) AS name", f"{_PHONE.format('c_custkey')} AS mobile_phone", "CONCAT(CAST(c_custkey AS STRING), '@d.example') AS email", "'T' AS title", "'W' AS department")),
    "linkflow_events": ("events", "event_id % 2 = 0", ("event_id AS id", "user_id AS contact_id", "event_id", "event_id AS extra_id", "event_type AS event_name", "{millis} AS event_date_ms")),
    "zhique_behavior": ("events", "event_id % 2 = 1", ("event_id AS id", "event_id AS behavior_id", "CONCAT('P', CAST(event_id % 3 AS STRING)) AS contact_name", f"{_PHONE.format('user_id')} AS mobile_phone", f"{BEHAVIOUR} AS behavior_type", "props AS behavior_name", "ts AS behavior_time")),
    "crm_opportunity": ("orders", "o_orderkey >= 0", ("o_orderkey AS id", f"{_LEAD_NAME.format('o_custkey')} AS customer_name", "CASE WHEN o_orderstatus = 'P' THEN '是' ELSE '否' END AS is_funnel", "o_orderpriority AS forecast_type", "o_orderpriority AS customer_stage", "CAST(floor(o_totalprice) / 10000 AS DECIMAL(20, 4)) AS amount_10k", "CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice) / 10000 AS DECIMAL(20, 4)) END AS order_amount_10k", "CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS is_active")),
    "crm_lead": ("orders", "o_orderkey % 10 = 0", ("CONCAT('L', CAST(o_orderkey AS STRING)) AS lead_code", f"CONCAT(' ', {_LEAD_NAME.format('o_custkey')}) AS company", "'Lead' AS person", "CAST(NULL AS STRING) AS phone", "CAST(o_orderdate AS DATE) AS obtained", "CASE WHEN o_orderkey % 20 = 0 THEN '' ELSE '官网' END AS source_class", "o_orderpriority AS source_kind", "CAST(NULL AS STRING) AS activity")),
    "crm_opportunity_data": ("orders", "o_orderkey % 7 = 0", ("CONCAT('O', CAST(o_orderkey AS STRING)) AS opp_code", f"{_LEAD_NAME.format('o_custkey')} AS customer", "'Owner' AS owner", "o_orderpriority AS opp_name", "CAST(o_orderdate AS DATE) AS created", "CAST(NULL AS STRING) AS origin")),
    "tianrun_session": ("orders", "o_orderstatus = 'P'", ("o_orderkey AS id", f"{_LEAD_NAME.format('o_custkey')} AS customer_name", "CONCAT('V', CAST(o_custkey % 3 AS STRING)) AS visitor_name", "CAST(NULL AS STRING) AS visitor_mobile_phone", "CAST(NULL AS STRING) AS visitor_email", "CASE WHEN o_orderkey % 2 = 0 THEN '企微客服' ELSE '网页' END AS contact_type_name", "CAST(NULL AS STRING) AS receive_type_name", "'done' AS close_reason_name", "{seconds} AS start_time_sec", "o_orderkey % 100 AS total_duration")),
    "key_customer": ("customer", "c_custkey % 40 = 7", ("c_custkey AS id", "c_name AS key_customer_name", "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CONCAT('K', CAST(c_custkey % 7 AS STRING)) END AS customer_name", "'KEY' AS industry_category", "CASE WHEN c_custkey % 80 = 7 THEN 'North' END AS department_level3", "'H' AS attribute")),
}


def load_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The source tables of the load."""
    fill = lambda e: e.replace("{millis}", "unix_millis(CAST(ts AS TIMESTAMP))").replace("{seconds}", "unix_seconds(CAST(o_orderdate AS TIMESTAMP))")
    return {n: view(spark, d, t, *map(fill, cols), where=where) for n, (t, where, cols) in LOAD.items()}


LOAD_SQL = "WITH " + ",\n".join(f"{n} AS (SELECT {_q(cols)} FROM {t} WHERE {where})" for n, (t, where, cols) in LOAD.items()).replace("{millis}", "(epoch_us(ts) // 1000)").replace("{seconds}", "epoch(o_orderdate)::BIGINT")
