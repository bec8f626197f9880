"""Sharding by histogram sort: shards of near-equal bytes, cut at exact key boundaries, with one exchange.

Documents lie on a line ordered by (hash of the text, doc_id), so equal texts are neighbours. The boundaries of
the shards are found without sorting: rows and bytes are counted exactly below candidate keys, and only the
buckets in which a boundary falls are probed again, 4096 times finer each round, until the bytes in the bucket
are within the tolerance or it holds one key. The driver sees at most 4096 counts for each of the shards' boundaries a
round, however many documents there are. A group of equal texts that fits the tolerance stays whole; a larger one is cut
between its documents, so that sizes stay near equal even if one text makes up a third of all rows.

The one exchange brings the rows in order of shard and key, in partitions of about PIECE_ROWS rows, and they are sorted
there. The slot of a row is its place in its partition plus the count of the shard's rows in the partitions before,
which is counted after the exchange.

Cases: a null text has no bytes and the checksum 0 of an empty text; null ids come first; repeated rows are
neighbours and each gets a slot; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import exact, join_small, text_of, written

SHARDS = 24
#: A boundary may miss its place by this part of a shard's bytes if that keeps equal texts together.
TOLERANCE = 0.002
PIECE_ROWS = 500_000
OVERHEAD = 8
#: Bits of a digit; a key is KEY_DIGITS digits: 64 bits of the text's hash, 64 of the id, 64 of the row.
BITS = 12
WORDS = ("k1", "k2", "k3")
DIGITS = [(w, lo, min(BITS, 64 - lo)) for w in WORDS for lo in range(0, 64, BITS)]


SIGN = 1 << 63
#: After all keys.
END = (1 << BITS,)


def _range(prefix: tuple[int, ...]) -> list[tuple[int, int]]:
    """The least and the largest value of each word of a key that starts with prefix, as signed longs."""
    out = []
    for word in WORDS:
        value, free = 0, 64
        for (w, _, bits), v in zip(DIGITS, prefix, strict=False):
            if w == word:
                value, free = value << bits | v, free - bits
        low = value << free
        out.append((low - SIGN, low + (1 << free) - 1 - SIGN))
    return out


def _digit(depth: int) -> Column:
    word, lo, bits = DIGITS[depth]
    return F.shiftrightunsigned(F.shiftleft(F.col(word).bitwiseXOR(F.lit(-SIGN)), lo), 64 - bits).cast("int")


def _starts_with(prefix: tuple[int, ...]) -> Column:
    out = F.lit(True)
    for word, (low, high) in zip(WORDS, _range(prefix), strict=True):
        if (low, high) != (-SIGN, SIGN - 1):
            out = out & (F.col(word).between(low, high) if low < high else F.col(word) == low)
    return out


class Line:
    """Exact counts of rows and bytes on the key line, refined where asked."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        self.rounds = 0
        self.buckets: list[tuple[tuple[int, ...], int, int]] = []  # (prefix, rows, bytes) in key order
        self._split([()])

    def _split(self, prefixes: list[tuple[int, ...]]) -> None:
        """Replaces the buckets of these prefixes by finer ones, in one pass over the rows."""
        self.rounds += 1
        found: dict[tuple[int, ...], list] = {p: [] for p in prefixes}
        for depth in {len(p) for p in prefixes}:
            own = [p for p in prefixes if len(p) == depth]
            which = None
            for i, p in enumerate(own):
                which = F.when(_starts_with(p), F.lit(i)) if not i else which.when(_starts_with(p), F.lit(i))
            counted = self.rows.withColumn("__b", which).filter("__b IS NOT NULL").groupBy("__b", _digit(depth).alias("__d")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
            for r in counted.collect():  # at most 4096 for each boundary
                found[own[r["__b"]]].append(((*own[r["__b"]], r["__d"]), r["n"], r["bytes"]))
        gone = set(prefixes)
        self.buckets = [x for b in self.buckets for x in (sorted(found[b[0]]) if b[0] in gone else [b])] if self.buckets else sorted(found[()])

    def cut(self, targets: list[float], tolerance: float) -> list[tuple[int, ...]]:
        """For each target in bytes, the prefix whose first key is the nearest boundary found."""
        while True:
            ends, at = [], 0
            for _, _, size in self.buckets:
                ends.append(at := at + size)
            picks, open_ = [], set()
            for t in targets:
                i = min(bisect_left(ends, t), len(ends) - 1)
                before, after = (ends[i - 1] if i else 0), ends[i]
                if min(t - before, after - t) <= tolerance or len(self.buckets[i][0]) == len(DIGITS):
                    picks.append(i if t - before <= after - t else i + 1)
                else:
                    open_.add(self.buckets[i][0])
                    picks.append(None)
            if not open_:
                return [self.buckets[i][0] if i < len(self.buckets) else END for i in picks]
            self._split(sorted(open_))


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, tolerance: float = TOLERANCE, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """One row a document: doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard).

    Sizes of shards differ from the mean by at most tolerance, or by the size of the document or the group of equal
    texts of at most that size on a boundary."""
    text, doc_id = text_of(exact(text_col)), exact(id_col).cast("long")
    rows = docs.select(
        doc_id.alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("k1"),
        F.coalesce(doc_id, F.lit(-SIGN)).alias("k2"),
        F.monotonically_increasing_id().alias("k3"),
    )
    rows = written(rows, "shard-rows")
    line = Line(rows)
    total, n = sum(b[2] for b in line.buckets), sum(b[1] for b in line.buckets)
    cuts = line.cut([total * i / shards for i in range(1, shards)], tolerance * total / shards) if n else []
    numbered = rows.withColumn("shard", _passed(cuts))
    placed = numbered.repartitionByRange(max(shards, -(-n // piece_rows)), "shard", *WORDS).sortWithinPartitions("shard", *WORDS)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = placed.select("doc_id", "size", "text_crc32", "shard", F.spark_partition_id().alias("piece"), place.alias("place"))
    placed = written(placed, "shard-placed")
    # a row a partition, and one more for each shard that starts within one
    pieces = placed.groupBy("shard", "piece").agg(F.count("*").alias("n"), F.min("place").alias("low"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    first = (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("__first")
    firsts = written(pieces.select(F.col("shard").alias("__shard"), F.col("piece").alias("__piece"), first), "shard-pieces")
    out = join_small(placed, firsts, (F.col("shard") == F.col("__shard")) & (F.col("piece") == F.col("__piece")), F.col("place"))
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("__first") + F.col("place")).alias("slot"))


def _passed(cuts: list[tuple[int, ...]]) -> Column:
    """The number of boundaries that are not after a row's key."""
    out = F.lit(0)
    for c in cuts:
        if c != END:
            low = [low for low, _ in _range(c)]
            k1, k2, k3 = map(F.col, WORDS)
            after = (k1 > low[0]) | ((k1 == low[0]) & ((k2 > low[1]) | ((k2 == low[1]) & (k3 >= low[2]))))
            out = out + after.cast("int")
    return out


def op5_shard(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near-equal bytes."""
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))
