"""Near-duplicates by SimHash, linked through BK-trees.

Fingerprints are made in Arrow batches. Equal fingerprints fall together first (a group-by), so copies cost
nothing later. Two fingerprints at most RADIUS bits apart agree in one of RADIUS + 1 bands of their bits (in `agree` of
RADIUS + agree); each value of some bits of a band is a shard, and in every shard a BK-tree (children keyed by the integer Hamming
distance to their parent) is built and queried with all its fingerprints, following only the edges within the radius
of the distance to the node. As many bits of a band are taken as leave TREE fingerprints a shard on average, so a tree's
size, and the nodes that a query visits in it, stay the same however many there are. A shard gives the links of a spanning forest, so a dense ball of near copies yields as many
rows as it has fingerprints, and no connection is lost. Trees of shards meet their queries through a shuffle, not a
broadcast (README has the figures). A shard of more than SHARD fingerprints is passed on as it streams in and cut by the bands
of its remaining bits, which again miss no pair, until all are small.

Cases: a null text has no words and the fingerprint zero, linked like any other; fewer than three words are one
shingle; repeated rows and null ids are rows like any other (the component of rows that all lack ids is null);
an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import near
from .common import dropped, exact, join_hot, written
from .components import components

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Fingerprints of a shard that one tree takes.
SHARD = 20_000
#: Fingerprints of a shard, on average at most.
TREE = 4_000
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+").findall
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint_of(h: np.ndarray) -> int:
    """A bit is 1 if set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):  # 256 kB of bits at a time
        part = h[at : at + 4096].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Of the shingles of a text, repeats included."""
    from xxhash import xxh64_intdigest

    words = _WORDS((text or "").encode().translate(_LOWER))
    if not words:
        return 0
    shingles = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return fingerprint_of(np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""
    rows = docs.select(exact(id_col).cast("bigint").alias("doc_id"), exact(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


def bands(bits: list[int], n: int) -> list[list[int]]:
    """bits in n runs of nearly the same length."""
    return [bits[len(bits) * i // n : len(bits) * (i + 1) // n] for i in range(n)]


def masked(fp: Column, bits: list[int]) -> Column:
    mask = sum(1 << b for b in bits)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


class BKTree:
    """Over distinct 64-bit values; nodes are numbered as given."""

    def __init__(self, values: np.ndarray):
        self.values = values
        #: Nodes that queries have come to.
        self.visited = 0
        n = len(values)
        # rounds place every waiting value one edge deeper; the first waiting value of an edge becomes its child
        parent = np.full(n, -1)
        edge = np.zeros(n, np.int64)
        waiting, at = np.arange(1, n), np.zeros(max(0, n - 1), np.int64)
        while len(waiting):
            d = popcount(values[waiting] ^ values[at])
            key = at * 65 + d
            _, first = np.unique(key, return_index=True)
            order = np.argsort(key, kind="stable")
            head = np.empty(len(key), np.int64)
            starts = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
            head[order] = np.repeat(waiting[order[starts]], np.diff(np.r_[starts, len(key)]))
            new = waiting[first]
            parent[new], edge[new] = at[first], d[first]
            keep = np.ones(len(waiting), bool)
            keep[first] = False
            waiting, at = waiting[keep], head[keep]
        # children of a node lie together, ordered by edge
        self.children = np.lexsort((edge, parent))[1:] if n else np.empty(0, np.int64)
        self.keys = parent[self.children] * 65 + edge[self.children]

    def within(self, queries: np.ndarray, radius: int, block: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query number, node number) of all pairs at most radius apart, in blocks of queries."""
        for low in range(0, len(queries), block):
            q = np.arange(low, min(len(queries), low + block))
            node = np.zeros(len(q), np.int64)
            while len(q):
                self.visited += len(q)
                d = popcount(queries[q] ^ self.values[node])
                hit = d <= radius
                if hit.any():
                    yield q[hit], node[hit]
                first = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0), "left")
                last = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), "right")
                many = last - first
                q = np.repeat(q, many)
                offset = np.arange(len(q)) - np.repeat(np.cumsum(many) - many, many)
                node = self.children[np.repeat(first, many) + offset]


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (value, value) that connect whatever links of at most radius bits connect."""
    up = list(range(len(values)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    out = []
    for q, node in BKTree(values).within(values, radius):
        more = q < node
        for a, b in zip(q[more].tolist(), node[more].tolist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                up[ra] = rb
                out.append((a, b))
    return out


class Cuts:
    """Bands by path: the first number is one of the choices of `agree` bands, of which `bits` bits are taken (None: all; 0: there is
    one shard), each further one a band of the bits left."""

    def __init__(self, radius: int, agree: int, bits: int | None = None):
        self.radius = radius
        parts = [sorted(sum(p, [])) for p in combinations(bands(list(range(64)), radius + agree), agree)]
        self.parts = [[]] if bits == 0 else [p[:bits] for p in parts]

    def left(self, path: str) -> list[int]:
        """The bits in which fingerprints of a shard of this path can differ."""
        first, *others = map(int, path.split("."))
        left = [b for b in range(64) if b not in self.parts[first]]
        for j in others:
            gone = bands(left, self.radius + 1)[j]
            left = [b for b in left if b not in gone]
        return left

    def again(self, values: np.ndarray, shard: int, path: str) -> Iterator[tuple[str, np.ndarray]]:
        """Paths and keys by which fingerprints of a large shard meet once more."""
        for j, bits in enumerate(bands(self.left(path), self.radius + 1)):
            h = (values & np.uint64(sum(1 << b for b in bits))) ^ np.uint64(shard % (1 << 64))
            for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9):
                h = (h ^ h >> np.uint64(31)) * np.uint64(c) + np.uint64(j + 1)
            yield f"{path}.{j}", h ^ h >> np.uint64(32)


LINKS = "a bigint, b bigint, path string, large boolean"


def shard_bits(n: int, tree: int | None = None) -> int:
    """Bits whose values split n fingerprints into shards of at most TREE, if all values come equally often."""
    return max(0, -(-n // (tree or TREE)) - 1).bit_length()


def links(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD, agree: int = 1) -> DataFrame:
    """Distinct fingerprints (fp; a written table) to links (a, b) of a forest in every shard.

    agree: bands that two fingerprints must share to meet in a shard, of radius + agree; with more of them there are more
    bits to make shards by, and each fingerprint is in more shards."""
    cuts = Cuts(radius, agree, shard_bits(fps.count()))
    keys = [F.struct(F.xxhash64(F.lit(i), masked(F.col("fp"), p)).alias("shard"), F.lit(str(i)).alias("path")) for i, p in enumerate(cuts.parts)]
    todo = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.shard", "k.path")

    def table(a: np.ndarray, b: np.ndarray, path: str, large: bool) -> pa.RecordBatch:
        cols = [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array([path] * len(a)), pa.array(np.full(len(a), large))]
        return pa.RecordBatch.from_arrays(cols, ["a", "b", "path", "large"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, path, held, size, large = None, "", [], 0, False

        def pairs() -> Iterator[pa.RecordBatch]:
            values = np.unique(np.concatenate(held)) if size > 1 and not large else ()
            if len(values) > 1 and (found := forest(values, radius)):
                ends = values[np.array(found)]
                yield table(ends[:, 0].copy(), ends[:, 1].copy(), path, False)

        for batch in batches:
            shards, values = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("shard", "fp"))
            values = values.view(np.uint64)
            at = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)] if len(shards) else [0]
            for low, high in zip(at, at[1:], strict=False):
                if shards[low] != key:
                    yield from pairs()
                    key, path, held, size, large = shards[low], batch.column("path")[low].as_py(), [], 0, False
                held.append(values[low:high])
                size += high - low
                if size > shard and len(cuts.left(path)) > radius:  # passed on, as it comes
                    own = np.concatenate(held)
                    for p, k in cuts.again(own, int(key), path):
                        yield table(own, k, p, True)
                    held, large = [], True
        yield from pairs()

    out = None
    while True:
        met = written(todo.repartition("shard").sortWithinPartitions("shard").mapInArrow(search, LINKS), "simhash-links")
        found = met.filter("NOT large").select("a", "b")
        out = found if out is None else out.unionByName(found)
        more = met.filter("large")
        if more.isEmpty():
            return out
        todo = more.select(F.col("a").alias("fp"), F.col("b").alias("shard"), "path")


def grouped(rows: DataFrame, radius: int = RADIUS, agree: int = 1) -> DataFrame:
    """Rows with fp (a written table) to (__fp, rows, component_id: the least doc_id linked to it, component_rows, component)."""
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "simhash-fps")
    roots = written(components(links(fps.select("fp"), radius, agree=agree)), "simhash-roots")
    named = fps.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp")).drop("node")
    named = written(named, "simhash-named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("rows").alias("component_rows"), F.count("*").alias("__n"))
    least = written(least.withColumnRenamed("root", "component"), "simhash-least")
    out = join_hot(named, least, F.col("root") == F.col("component"), "__n", fps.count())
    return out.select(F.col("fp").alias("__fp"), "rows", "component_id", "component_rows", "component")


def clustered(docs: DataFrame, radius: int = RADIUS, agree: int = 1) -> DataFrame:
    """One row a document: doc_id, fp, component_id, component_rows and component (one of its fingerprints)."""
    rows = written(fingerprints(docs), "simhash-rows")
    groups = written(grouped(rows, radius, agree), "simhash-groups")
    return join_hot(rows, groups, F.col("fp") == F.col("__fp"), "rows", rows.count()).drop("__fp", "rows")


#: Bits of 64 within which fingerprints of five-word shingles make candidates of the stage that removes documents. They
#: connect most near copies cheaply; at a similarity of 0.8 many are further apart, which the exact search finds.
DROP_RADIUS = 4
SALT = 64


def candidates(rows: DataFrame) -> DataFrame:
    """rows (row, fp; a written table) to pairs (a, b) of rows that connect those with fingerprints within DROP_RADIUS: rows of one
    fingerprint with the least of some of them, these with the least of all, and these by the links of fingerprints."""
    local = rows.groupBy("fp", F.pmod(F.xxhash64("row"), F.lit(SALT)).alias("salt")).agg(F.min("row").alias("b"), F.count("*").alias("n"))
    local = written(local, "dedup-local")
    firsts = written(local.groupBy("fp").agg(F.min("b").alias("b"), F.count("*").alias("n")), "dedup-fingerprints")
    crowded = local.filter("n > 1").select(F.col("fp").alias("__fp"), F.col("salt").alias("__salt"), "b")
    same_salt = (F.col("fp") == F.col("__fp")) & (F.pmod(F.xxhash64("row"), F.lit(SALT)) == F.col("__salt"))
    inner = rows.join(crowded, same_salt).select(F.col("row").alias("a"), "b")
    outer = local.select("fp", F.col("b").alias("a")).join(firsts.filter("n > 1").select("fp", "b"), "fp").select("a", "b")
    found = written(links(firsts.select("fp"), DROP_RADIUS), "dedup-links")
    end = lambda c: firsts.select(F.col("fp").alias(f"__{c}"), F.col("b").alias(f"row_{c}"))
    across = found.join(end("a"), F.col("a") == F.col("__a")).join(end("b"), F.col("b") == F.col("__b")).select(F.col("row_a").alias("a"), F.col("row_b").alias("b"))
    return inner.unionByName(outer).unionByName(across).filter("a <> b").distinct()


def joined(roots: DataFrame, found: DataFrame) -> DataFrame:
    """The written tables roots (node, root), and found (a, b), to the roots of what both connect."""
    if found.isEmpty():
        return roots
    stars = roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    out = written(components(stars.unionByName(found)), "dedup-roots")
    dropped(roots, found)
    return out


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each component of links between documents at least 4/5 alike (exact Jaccard similarity of
    five-word shingles), with its columns: the one with the least id (null last), of rows with one id the first stored.

    Equal sets fall together first. SimHash and BK-trees then propose pairs, which are verified and connect most near
    copies by a forest, rounds of near.chains most of the others; near.links finds, without loss, what else is 4/5 alike between
    different components. The choice is a
    minimum from partial aggregates, so a large component is no large task."""
    rows = near.signed(docs, docs.columns).withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "dedup-rows")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    best = rows.groupBy("sig").agg(F.min(rank).alias("best")).select(F.col("best.row").alias("__row"))
    copies = written(rows.select("row").join(best, F.col("row") == F.col("__row"), "left_anti").select(F.col("row").alias("__gone")), "dedup-copies")
    firsts = written(near.among(rows, copies, "left_anti"), "dedup-firsts")
    dropped(rows, copies)
    texts = firsts.select("row", "sig", F.col(f"__in_{docs.columns.index('text')}").alias("text"))
    close = near.verified(texts, written(candidates(firsts.select("row", "fp")), "dedup-close"))
    close = written(close, "dedup-verified")
    roots = written(components(close), "dedup-roots")
    sets = written(near.prefixes(texts, near.frequent(texts)), "dedup-prefixes")
    low = 0
    for many in near.LINKED:
        roots = joined(roots, near.chains(texts, sets, roots, low, many))
        low += many
    roots = joined(roots, near.links(texts, sets, roots))
    dropped(sets, close)
    members = written(roots.join(firsts.select("row", "doc_id"), F.col("node") == F.col("row")).select("row", "doc_id", "root"), "dedup-members")
    stay = members.groupBy("root").agg(F.min(rank).alias("best")).select(F.col("best.row").alias("__row"))
    gone = written(members.select("row").join(stay, F.col("row") == F.col("__row"), "left_anti").select(F.col("row").alias("__gone")), "dedup-gone")
    return near.among(firsts, gone, "left_anti").select(*[F.col(f"__in_{i}").alias(c) for i, c in enumerate(docs.columns)])


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    """All documents with their fingerprint and component."""
    out = clustered(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
