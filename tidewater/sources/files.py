"""Reading declared files and writing exports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from .workbook import read_workbook, write_workbook

#: Cleaning of a declared column by kind.
CLEAN: dict[str, Callable[[Column], Column]] = {
    "string": text.filled, "phone": text.clean_phone, "date": text.clean_date, "int": text.clean_int, "decimal": text.clean_decimal, "flag": text.clean_flag,
    "timestamp": lambda c: F.trim(c).try_cast("timestamp_ntz"),
}


def declared(raw: DataFrame, columns: list[tuple[str, str, str]], lengths: dict[str, int] | None = None) -> DataFrame:
    """raw by a declaration of (source column, target column, kind): renamed, cleaned, missing ones null, texts cut to
    lengths."""
    out = []
    for source, target, kind in columns:
        c = CLEAN[kind](F.col(f"`{source}`").cast("string") if source in raw.columns else F.lit(None).cast("string"))
        out.append((F.substring(c, 1, lengths[target]) if lengths and target in lengths else c).alias(target))
    return raw.select(*out)


def read_csv(spark: SparkSession, path: str, columns: list[tuple[str, str, str]], **options) -> DataFrame:
    """A CSV file with a header by its declaration; nothing is inferred."""
    return declared(spark.read.options(header=True, **options).csv(path), columns)


def read_excel(spark: SparkSession, path: str, columns: list[tuple[str, str, str]]) -> DataFrame:
    """A workbook, or a folder of them, by its declaration; tasks read ranges of rows."""
    return declared(read_workbook(spark, path), columns)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 8, **options) -> DataFrame:
    """A database table, in ranges of a numeric key if given."""
    r = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    return (r.options(partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts) if key else r).load()


# The columns of exports, their heads and widths --------------------------------------------------
EXPORT = (
    ("customer_name", "客户名称", 30), ("industry", "行业", 15), ("region", "区域", 12), ("owner_name", "负责人", 15), ("campaign_tag", "专项", 15), ("purchase_stage", "采购阶段", 15),
    ("forecast_type", "预测类别", 12), ("role_coverage", "关键角色覆盖", 14), ("intent_level", "合作意向", 10), ("intent_score", "意向分", 10), ("interaction_count_30d", "近30天互动", 12),
    ("interaction_count_total", "总互动次数", 12), ("last_interaction_time", "最近互动时间", 20), ("last_interaction_channel", "最近互动渠道", 14), ("active_opp_count", "在途商机数", 12),
    ("active_opp_amount", "在途金额(万)", 14), ("contact_count", "联系人数", 10), ("won_amount", "已成交金额(万)", 14),
)
EXPORTS = {
    "customer_360": (
        ("customer_name", "客户名称", 25), ("industry", "行业", 15), ("region", "区域", 12), ("owner_name", "负责人", 15), ("purchase_stage", "采购阶段", 15), ("forecast_type", "预测类型", 12),
        ("role_coverage", "人员覆盖度", 12), ("intent_score", "意向评分", 12), ("intent_level", "意向等级", 12), ("interaction_count_30d", "近30天互动", 15), ("interaction_count_total", "总互动", 12),
        ("last_interaction_time", "最近互动时间", 20), ("last_interaction_channel", "最近渠道", 15), ("active_opp_count", "活跃商机数", 15), ("active_opp_amount", "活跃商机金额", 18),
        ("contact_count", "联系人总数", 15), ("mobile_count", "手机号数量", 15), ("is_existing_customer", "现有客户", 12),
    ),
    "contact_360": (
        ("customer_id", "客户ID", 12), ("contact_name", "联系人姓名", 20), ("mobile", "手机号", 15), ("email", "邮箱", 25), ("department", "部门", 20), ("position", "职位", 20), ("purchase_role", "采购角色", 15),
        ("role_category", "角色类别", 15), ("interaction_count", "总互动次数", 15), ("interaction_count_30d", "近30天互动", 15), ("last_interaction_time", "最近互动时间", 20), ("activity_level", "活跃度", 12),
        ("intent_level", "意向等级", 12), ("lead_stage", "线索阶段", 15),
    ),
    "contact_mapping": (
        ("customer_name", "客户公司", 25), ("contact_name", "联系人姓名", 20), ("mobile", "手机号", 15), ("email", "邮箱", 25), ("department", "部门", 20), ("position", "职位", 20), ("purchase_role", "采购角色", 15),
        ("role_category", "角色类别", 15), ("source_table", "来源表", 20), ("zhique_matched", "智能体匹配", 12),
    ),
    "interaction_detail": (
        ("customer_name", "客户公司", 25), ("contact_name", "联系人", 20), ("mobile", "手机号", 15), ("source_table", "来源表", 20), ("channel", "互动渠道", 15), ("behavior_type", "行为类型", 20),
        ("content", "互动内容", 50), ("event_time", "互动时间", 20), ("is_high_value", "高价值", 10),
    ),
}
# ---------------------------------------------------------------------------------------------------------------
EXPORT_ROWS = 20_000


def export_frame(rows: DataFrame, columns=EXPORT, order: list[Column] | None = None, most: int = EXPORT_ROWS) -> DataFrame:
    """The rows of an export: headed columns (empty where rows lack one), times to the minute, at most as many rows as a sheet is
    meant to have; by default the highest intent score first."""
    cols, there = [], {f.name: f.dataType.typeName() for f in rows.schema}
    order = order or ([F.col("intent_score").desc()] if "intent_score" in there else []) + [F.col(columns[0][0])]
    for name, head, _ in columns:
        kind = there.get(name, "void")
        c = F.col(name) if name in there else F.lit(None).cast("string")
        c = F.date_format(c, "yyyy-MM-dd HH:mm") if kind.startswith("timestamp") else F.array_join(c, ",") if kind == "array" else c
        cols.append(c.alias(head))
    return rows.orderBy(*order).limit(most).select(*cols)


def write_export(frame: DataFrame, path: str) -> None:
    """One CSV file with a header; an export has few rows."""
    frame.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_sheet(frame: DataFrame, path: str, columns=EXPORT, sheet: str = "客户360") -> None:
    """One workbook with the rows of an export in their order."""
    write_workbook(frame.coalesce(1), path, sheet, tuple(w for *_, w in columns))


TABLE_ROWS = 10_000


def export_table(rows: DataFrame, table: str, order: list[Column], most: int = TABLE_ROWS) -> DataFrame:
    """The export of one of the four tables, in a total order."""
    return export_frame(rows, EXPORTS[table], order, most)


def sampled(rows: DataFrame, key: str, n: int = 1000, seed: int = 7) -> DataFrame:
    """All rows of a small table, else n of it by a seeded order of the key: a sample for a dump."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)
