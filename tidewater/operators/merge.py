"""Writing rules: first wins, last wins, update joins, key-filtered inserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import spread


def first_wins(sources: list[DataFrame], key: list[str], ties: list[str]) -> DataFrame:
    """The union of the sources in order of priority, one row a key: of the first source that has it, and in a source
    the first by ties. Rows with a null in the key never collide and all stay."""
    parts = [s.withColumn("__priority", F.lit(i)) for i, s in enumerate(sources)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    lacks = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
    w = Window.partitionBy(*key).orderBy("__priority", *[F.col(t).asc_nulls_last() for t in ties])
    first = every.filter(~lacks).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    return first.unionByName(every.filter(lacks)).drop("__priority")


def upsert(old: DataFrame, new: DataFrame, key: list[str], columns: list[str], order: list[Column] | None = None) -> DataFrame:
    """old with the listed columns taken from new where the key is there (a null keeps the old value), and the rows
    of new whose key is not. Of several new rows with one key the last by order counts."""
    if order:
        w = Window.partitionBy(*key).orderBy(*order)
        new = new.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    o = old.select(*[F.col(c).alias(f"o_{c}") for c in old.columns], F.lit(True).alias("o__there"))
    n = new.select(*[F.col(c).alias(f"n_{c}") for c in new.columns], F.lit(True).alias("n__there"))
    on = reduce(lambda a, b: a & b, [F.col(f"o_{k}") == F.col(f"n_{k}") for k in key])
    both = o.join(n, on, "full_outer")

    def value(c: str) -> Column:
        if c not in new.columns:
            return F.col(f"o_{c}")
        fresh = F.col(f"n_{c}")
        kept = F.coalesce(fresh, F.col(f"o_{c}")) if c in columns else F.col(f"o_{c}")
        return F.when(F.col("o__there").isNull(), fresh).otherwise(kept)

    return both.select(*[value(c).alias(c) for c in old.columns])


def update_join(rows: DataFrame, values: DataFrame, key: str, columns: list[str], ties: list[str] | None = None) -> DataFrame:
    """rows with the columns of the match in values where it has them; of several matches the first by ties."""
    right = values.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in columns])
    if ties is not None:
        w = Window.partitionBy("__key").orderBy(*[F.col(f"__{t}").asc_nulls_last() for t in ties])
        right = right.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    out = rows.join(right, F.col(key) == F.col("__key"), "left")
    own = lambda c: F.coalesce(F.col(f"__{c}"), F.col(c)) if c in rows.columns else F.col(f"__{c}")
    return out.withColumns({c: own(c) for c in columns}).drop("__key", *[f"__{c}" for c in columns])


def insert_missing(rows: DataFrame, more: DataFrame, key: str, keys: DataFrame | None = None) -> DataFrame:
    """rows and those of more whose key they lack. keys: a cheaper frame with the keys of rows, if there is one."""
    there = (rows if keys is None else keys).select(F.col(key).alias("__key"))
    return rows.unionByName(more.join(there, F.col(key) == F.col("__key"), "left_anti"), allowMissingColumns=True)


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def top(rows: DataFrame, key: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page of a total order; only as many rows as it takes leave each task."""
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def clamped_page(total: int, number: int, size: int) -> int:
    """The page asked for, or the last one there is."""
    return max(1, min(number, -(-total // size)))


def without_known_pairs(pairs: DataFrame, known: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs that known lacks in either order."""
    k = known.select(F.least(a, b).alias("__low"), F.greatest(a, b).alias("__high"))
    return pairs.join(k, (F.least(a, b) == F.col("__low")) & (F.greatest(a, b) == F.col("__high")), "left_anti")


def unknown_pairs(rows: DataFrame, group: list[str], key: str, known: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b), a < b, of the keys of rows of one group, without those that known (a, b) has in either order. A row brings its known partners
    along, so pairs are made where the rows of a group meet and never shuffled."""
    partners = known.select(F.least(a, b).alias("__low"), F.greatest(a, b).alias("__high")).groupBy("__low").agg(F.collect_set("__high").alias("__known"))
    first = rows.select(*group, F.col(key).alias("a")).join(partners, F.col("a") == F.col("__low"), "left")
    second = rows.select(*[F.col(g).alias(f"__{g}") for g in group], F.col(key).alias("b"))
    on = reduce(lambda x, y: x & y, [F.col(g) == F.col(f"__{g}") for g in group])
    fresh = ~F.coalesce(F.array_contains("__known", F.col("b")), F.lit(False))
    first, second = spread(first, *group), spread(second, *[f"__{g}" for g in group])  # few bytes that make many pairs
    return first.join(second.hint("merge"), on & (F.col("a") < F.col("b")) & fresh).select("a", "b")
