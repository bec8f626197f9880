"""Mixing sources to target weights by capped water-filling.

Every source has a weight and asks for that share of the budget; a source can be repeated at most max_epochs
times, and what it cannot give is shared among the others by weight until no source is above its cap. With
sources in ascending order of cap / weight the clamped ones are a prefix, so the water level is the largest of
(budget - caps so far) / (weights left) and the fixed point needs one sorted pass over the sources, not a loop.

Within a source, whole epochs take every document; the fractional epoch takes the documents that come first in
a seeded order of id and text, up to the exact number of words, so the last one counts in part. The order is never
sorted in one task: sums by the leading bits of the hash find the cell where the fraction ends, twice, and only
the different documents of that one cell (a 2**-24 part of the source) are ordered; rows equal in id and text are one there
and share alike what is left for them. The mix itself takes documents whole.

Cases: a null text has no words; a null source is a source of its own, last in order; null or repeated ids are
rows like any other (the seeded order goes by the text as well); an empty table gives an empty mix; a source without
words has target 0. Columns of the input other than the named ones are ignored, whatever their names. Sources are a bounded number
(names of collections, not of hosts): their table is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import exact, join_small, n_words, seeded, text_of, written

#: Weights by the place of a source in code-point order, repeating.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 20240131
#: Leading bits of the 60-bit order: of the first pass and of both passes.
FIRST, SECOND = 8, 24


def cyclic_weights(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sources (source, ...) with a weight each: the weights in turn by code point, null last.
    One row a source meets in one task here, never a document."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    return sources.withColumn("weight", pick.cast("long"))


def waterfill(sources: DataFrame, max_epochs: int = MAX_EPOCHS, budget: Column | None = None) -> DataFrame:
    """sources (source, source_size, weight) with target: its words in the mix, a double.
    budget: words of the whole mix; all sizes by default."""
    everything = Window.partitionBy()
    before = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total = budget if budget is not None else F.sum("source_size").over(everything)
    return (
        sources.withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("left", total - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.max(F.col("left").cast("double") / F.col("weight_left")).over(everything))
        .withColumn("target", F.least(F.col("cap").cast("double"), F.greatest(F.col("level"), F.lit(0.0)) * F.col("weight")))
        .select("source", "source_size", "weight", "target")
    )


def _edge(sums: DataFrame, cell: str, wanted: str) -> DataFrame:
    """Of sums (source, cell, words, wanted), the cell where the running words of a source pass what is wanted."""
    w = Window.partitionBy("source").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("words").over(w), F.lit(0))
    return sums.withColumn("before", before).filter((F.col("before") <= F.col(wanted)) & (F.col(wanted) < F.col("before") + F.col("words")))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: DataFrame | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED, carry: list[str] | None = None, prefix: str = "") -> DataFrame:
    """One row a document: doc_id, source, size, source_size, weight, target, epochs (whole repetitions),
    part (words of one more), taken = epochs * size + part, and alike (the rows that share its part, if it is at the edge).

    weights: (source, weight) rows, null-safe on source; sources it lacks get 0. Default: WEIGHTS in turn.
    carry: further columns of docs to keep, under their names after prefix."""
    text = text_of(exact(text_col))
    rows = docs.select(
        exact(id_col).alias("doc_id"),
        exact(source_col).cast("string").alias("source"),
        n_words(text).alias("size"),
        seeded(seed, exact(id_col), F.md5(text)).alias("at"),
        *[exact(c).alias(f"__in_{c}") for c in carry or []],
    )
    rows = written(rows, "mix-rows")
    first = F.shiftright("at", 60 - FIRST)
    second = F.shiftright("at", 60 - SECOND)
    cells = written(rows.groupBy("source", first.alias("cell")).agg(F.sum("size").alias("words")), "mix-cells")
    sources = cells.groupBy("source").agg(F.sum("words").alias("source_size"))
    if weights is None:
        weighted = cyclic_weights(sources)
    else:
        w = weights.select(F.col("source").alias("__s"), F.col("weight").cast("long"))
        weighted = sources.join(w, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s").withColumn("weight", F.coalesce("weight", F.lit(0)))
    goal = F.floor(F.col("target") + 0.5).cast("long")
    has = F.col("source_size") > 0
    level = written(
        waterfill(weighted, max_epochs)
        .withColumn("epochs", F.when(has, F.expr("CAST(floor(target + 0.5) AS BIGINT) DIV greatest(source_size, 1)")).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.when(has, goal - F.col("epochs") * F.col("source_size")).otherwise(F.lit(0)).cast("long")),
        "mix-targets",
    )
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    named = level.select(F.col("source").alias("__s"), "rest")
    cell1 = _edge(join_small(cells, named, same("source", "__s"), F.col("cell")), "cell", "rest").select(F.col("source").alias("__s"), F.col("cell").alias("cell1"), (F.col("rest") - F.col("before")).alias("rest1"))
    cell1 = written(cell1, "mix-cell1")
    inside = join_small(rows, cell1, same("source", "__s") & (first == F.col("cell1")), F.col("at"))
    sums = inside.groupBy("source", second.alias("cell")).agg(F.sum("size").alias("words"), F.first("rest1").alias("rest1"))
    cell2 = _edge(sums, "cell", "rest1").select(F.col("source").alias("__t"), F.col("cell").alias("cell2"), (F.col("rest1") - F.col("before")).alias("rest2"))
    marks = written(level.join(cell2, same("source", "__t"), "left").drop("__t").withColumnRenamed("source", "__s"), "mix-marks")
    full = join_small(rows, marks, same("source", "__s"), F.col("at")).withColumn("cell", second)
    at_edge = F.col("cell").eqNullSafe(F.col("cell2"))
    # the different documents of the cell where the fraction ends, each with what its rows get
    w = Window.partitionBy("source").orderBy("at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    alike = full.filter(at_edge).groupBy("source", "at", "doc_id", "size").agg(F.count("*").alias("alike"), F.first("rest2").alias("rest2"))
    left = F.col("rest2") - F.coalesce(F.sum(F.col("size") * F.col("alike")).over(w), F.lit(0))
    shares = alike.withColumn("left", F.greatest(F.lit(0).cast("long"), left)).withColumn("part", F.least(F.col("size"), F.expr("left DIV alike")))
    shares = written(shares.select(*[F.col(c).alias(f"__e_{c}") for c in ("source", "at", "doc_id", "size")], "part", "alike"), "mix-edge")
    on = same("source", "__e_source") & (F.col("at") == F.col("__e_at")) & same("doc_id", "__e_doc_id") & (F.col("size") == F.col("__e_size"))
    edge = join_small(full.filter(at_edge), shares, on, F.monotonically_increasing_id())
    rest = full.filter(~at_edge).withColumn("part", F.when(F.col("cell") < F.col("cell2"), F.col("size")).otherwise(F.lit(0).cast("long")))
    out = rest.withColumn("alike", F.lit(1).cast("long")).unionByName(edge.select(*map(exact, rest.columns), "alike"))
    taken = (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken")
    return out.select(
        "doc_id", "source", "size", "source_size", "weight", "target", "epochs", "part", taken, "alike",
        *[exact(f"__in_{c}").alias(f"{prefix}{c}") for c in carry or []],
    )


def mixed(docs: DataFrame, seed: int = SEED, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself, with the columns of documents, all of them whole: a document once per epoch and, where the
    fraction reaches it, once more. The document at the edge of the fraction is taken if at least half of it would be;
    of equal rows at the edge as many as fit, by chance. Documents without words are not taken."""
    plan = plan_mix(docs, seed=seed, max_epochs=max_epochs, carry=docs.columns, prefix="__in_").filter("taken > 0")
    chance = F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), F.lit(1 << 30)) / F.lit(float(1 << 30))
    more = F.when(F.col("alike") > 1, chance < F.col("part") / F.col("size")).otherwise(2 * F.col("part") >= F.col("size"))
    times = F.col("epochs").cast("int") + F.when(more & (F.col("part") > 0), 1).otherwise(0)
    out = plan.withColumn("__times", times).withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__times"))))
    return out.select(*[exact(f"__in_{c}").alias(c) for c in docs.columns])


def op1_mix(spark, sf_dir: str) -> DataFrame:
    """All documents mixed by the default weights over a budget of all their words."""
    return plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "source", "weight", "epochs", "part")


ORACLE = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS pos FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight, source_size * 3 AS cap FROM r),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS lv
    FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, weight, least(cap::DOUBLE, greatest(max(lv) OVER (), 0.0) * weight) AS target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs,
    CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT % source_size ELSE 0 END AS rest FROM t),
k AS (SELECT source, pos, doc_id, size, count(*) AS alike FROM d GROUP BY ALL),
c AS (SELECT k.doc_id, k.size, k.alike, g.*, greatest(0, rest - coalesce(sum(k.size * k.alike) OVER (PARTITION BY k.source
    ORDER BY pos, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS room FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source),
e AS (SELECT *, least(size, room // alike)::BIGINT AS part, unnest(range(alike)) FROM c)
SELECT doc_id, size, source_size, target, (epochs * size + part)::BIGINT AS taken, source, weight, epochs, part FROM e
"""
