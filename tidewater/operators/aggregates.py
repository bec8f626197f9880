"""Group-bys that the dashboards share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """0 where the whole is 0."""
    return F.round(F.when(whole > 0, part / whole * 100).otherwise(0.0), digits)


def share_of_total(counts: DataFrame, count: str, share: str) -> DataFrame:
    """A group-by result with each row's part of the sum. One row a group meets in one task, no data row."""
    return counts.withColumn(share, percent(F.col(count), F.sum(count).over(Window.partitionBy())))


def with_default(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def zero_filled(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Counts of the listed values, 0 for those that don't occur, with the count of all rows as total."""
    names = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(v).alias("value")) for i, v in enumerate(values)])).alias("v")
    all_counts = rows.agg(*[F.count_if(F.col(column) == v).alias(f"__{i}") for i, v in enumerate(values)], F.count("*").alias("total"))
    each = F.coalesce(*[F.when(F.col("v.ord") == i, F.col(f"__{i}")) for i in range(len(values))])
    return all_counts.select("*", names).select(F.col("v.value").alias(column), each.alias("n"), "total")


def sections(rows: DataFrame, dims: dict[str, Column], measures: dict[str, Column]) -> DataFrame:
    """(section, label, measures): one group-by of rows for each dimension and the whole, in one scan by grouping sets."""
    named = rows.withColumns({f"__{k}": v for k, v in dims.items()})
    sets = [[F.col(f"__{k}")] for k in dims] + [[]]
    grouped = named.groupingSets(sets, *[F.col(f"__{k}") for k in dims]).agg(F.grouping_id().alias("__g"), *[m.alias(k) for k, m in measures.items()])
    n = len(dims)
    section = F.lit("all")
    label = F.lit("")
    for i, k in enumerate(dims):
        own = F.col("__g") == ((1 << n) - 1) ^ (1 << (n - 1 - i))
        section = F.when(own, F.lit(k)).otherwise(section)
        label = F.when(own, F.col(f"__{k}")).otherwise(label)
    return grouped.select(section.alias("section"), label.alias("label"), *measures)


def role_coverage(role: Column) -> dict[str, Column]:
    """The roles there are, and how far they cover a buying centre."""
    has = lambda r: F.max(F.when(role == r, 1).otherwise(0))
    three = has("决策者") + has("技术评估者") + has("使用者")
    return {"roles": F.count_distinct(role), "role_coverage": F.when(three == 3, "全").when(F.count_distinct(role) > 0, "部分").otherwise("无")}


def content_effect(touches: DataFrame) -> DataFrame:
    """Touches, customers, opens and clicks per customer, and leads of each content and behaviour."""
    rows = touches.filter(F.col("content").isNotNull() & ~F.trim("content").isin("", "--"))
    one = lambda c: F.sum(c.cast("int"))
    out = rows.groupBy("content", "behavior_type").agg(F.count("*").alias("touch_count"), F.count_distinct("customer_name").alias("unique_customers"), one(text.opened(F.col("behavior_type"), F.col("content"))).alias("opens"), one(text.clicked(F.col("behavior_type"), F.col("content"))).alias("clicks"), F.sum("is_high_value").alias("mql"))
    rate = lambda c: F.round(F.col(c) * 100.0 / F.greatest(F.lit(1), F.col("unique_customers")), 2)
    return out.select("content", "behavior_type", "touch_count", "unique_customers", rate("opens").alias("open_rate"), rate("clicks").alias("click_rate"), "mql")
