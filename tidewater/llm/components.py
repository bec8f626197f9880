"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import dropped, join_hot, written

#: Partitions of edges that are few.
FEW = 4


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b: long) to (node, root): every node that has an edge, and the least node it is connected to.

    A step takes all neighbours of a node to the least one among them (large star: those greater than the node;
    small star: the others), so trees get flat in about log of the number of nodes rounds. Minima come from
    partial aggregates, and the few nodes with very many neighbours get theirs by a broadcast, so none is a bottleneck; each
    round is a written table. Raises if max_rounds are not enough."""

    def least(e: DataFrame, n: int) -> DataFrame:
        """(u, v) rows with m, the least node among u and its neighbours v."""
        few = n <= common.HOT_ROWS  # no node can be hot: one exchange into few partitions serves the minima and the join
        e = e.repartition(FEW, "u") if few else e
        m = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("__n"))
        m = m.select(F.col("u").alias("__u"), F.least("m", "u").alias("m"), "__n")
        if few:
            return e.join(m, F.col("u") == F.col("__u")).drop("__u", "__n")
        return join_hot(e, written(m, "components-least"), F.col("u") == F.col("__u"), "__n", n).drop("__u", "__n")

    def once(e: DataFrame, n: int) -> DataFrame:
        return (e.repartition(FEW, "u") if n <= common.HOT_ROWS else e).distinct()

    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    now = written(pairs, "components")
    ends = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("p")
    before = None
    for _ in range(max_rounds):
        n = 2 * now.count()
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = once(least(both, n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v"), n)
        if n > common.HOT_ROWS:
            large = written(large, "components-large")
        small = once(least(large, n).select(ends).select("p.u", "p.v").filter("u <> v"), n)
        old, now = now, written(small, "components")
        dropped(old, *([large] if n > common.HOT_ROWS else []))
        # a fixed point has the same edges: their number, the sum of both ends and a hash tell
        state = now.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
