"""Near copies by exact Jaccard similarity of five-word shingles.

Two sets of shingles with similarity 4/5 or more share so much that, in any order of all shingles that both follow,
each has one of the other's among its first n / 5 + 1 (prefix filter), and a known number of those. Documents post
these first shingles; documents meet at a shingle by a shuffle; pairs that meet often enough are verified on their whole
sets. So no pair at or above the threshold is missed and none below it is linked. Documents that are known to be connected
don't meet, so a large group of near copies makes no pairs of all its members. Shingles that a sample shows to be frequent
come last in the order, the most frequent at the very end: a passage that many documents share makes no large group unless
it is most of each of them. The order only decides how many pairs meet, never which are found.

A shingle that more than MEET documents post makes no pairs of them. One of these documents is its pivot, the others are
known by their differences from it (shingles that only one of the two has), and two that are alike share a difference or
are both alike to the pivot: if s and t differ from p in ds and dt shingles, none of them the same, s and t differ in
ds + dt; 9 (ds + dt) <= s + t and s <= p + ds give 9 dt <= p + t, and 9 ds <= p + s likewise. So links to the
pivot do for those, and the rest meet at their rarest differences, by a prefix filter again. The positions of the key and
a sketch of 256 bits, which each difference flips one of, bound from below how much two differ. So what the members of a
group of near copies have in common makes no pairs. A first round takes a FEW of each member, and what they connect makes
no pairs in the second, which takes all.

Cases: words are lower-cased (ASCII); fewer than five words are one shingle; a null text is an empty set, equal to
any other; sets are of 64-bit hashes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, exact, join_small, written
from .components import components

SHINGLE = 5
SEED = 42
#: Similarity: of n and m shingles, s are in both, and 9 s >= 4 (n + m), which is s / (n + m - s) >= 4/5.
#: Of the sets one in SAMPLE is counted for frequent shingles; those in OFTEN or more of them, at most FREQUENT, come last.
SAMPLE, OFTEN, FREQUENT = 16, 3, 200_000
#: Row numbers (8 bytes each) are broadcast up to this number.
BROADCAST_ROWS = 1_000_000
#: Documents whose postings make one batch.
BLOCK = 500
#: Postings of a shingle, or a difference, that meet each with each.
MEET = 64
#: Pairs that a member makes at a difference in the first round.
FEW = 2
#: Parts of the members of a pivot.
PARTS = 256
#: Postings of a shingle that meet in one task.
CROWD = 20_000
#: Shingles of a document at which chains look for neighbours, in each round.
LINKED = (4, 4, 8)
#: Pairs that a task makes at a time.
PAIRS = 1_000_000
#: Frequent shingles, ascending, and how often each was seen.
Order = tuple[np.ndarray, np.ndarray]
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+").findall
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the shingles, ascending."""
    from xxhash import xxh64_intdigest

    words = _WORDS((text or "").encode().translate(_LOWER))
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh64_intdigest, words, repeat(SEED)), np.uint64, len(words))
    size = min(size, len(h))
    out = np.zeros(len(h) - size + 1, np.uint64)
    for i in range(size):
        out = (out ^ h[i : i + len(out)]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signed(docs: DataFrame, carry: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sig (128 bits of the set) and fp (its SimHash); and the columns of carry as __in_0 and so on."""
    carried = [exact(c).alias(f"__in_{i}") for i, c in enumerate(carry)]  # names that Arrow functions can ask for
    rows = docs.select(exact(id_col).cast("bigint").alias("doc_id"), exact(text_col).alias("__text"), *carried)
    kind = rows.drop("__text").schema.add("sig", "binary").add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        from .simhash import fingerprint_of

        for batch in batches:
            sigs, fps = [], []
            for t in batch.column("__text"):
                s = shingles(t.as_py())
                sigs.append(xxh3_128_digest(s.tobytes()))
                h = s * _MIX
                fps.append(fingerprint_of(h ^ h >> np.uint64(32)))
            names = [n for n in batch.schema.names if n != "__text"]
            made = [pa.array(sigs, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *made], [*names, "sig", "fp"])

    return rows.mapInArrow(run, kind)


def frequent(rows: DataFrame) -> Order:
    """Shingles that a sample of rows (sig, text) shows to be frequent, ascending, and how often each was seen."""
    part = rows.filter(F.pmod(F.xxhash64("sig"), F.lit(SAMPLE)) == 0).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for low in range(0, len(texts), BLOCK):
                h, n = np.unique(np.concatenate([shingles(t.as_py()) for t in texts[low : low + BLOCK]]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["key", "n"])

    return most_seen(part.mapInArrow(run, "key bigint, n bigint"))


def most_seen(counts: DataFrame) -> Order:
    """Of counts (key, n), the keys seen OFTEN or more, at most FREQUENT."""
    seen = counts.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= OFTEN)
    top = seen.orderBy(F.col("n").desc(), "key").limit(FREQUENT).collect()
    keys = np.array([r.key for r in top], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array([r.n for r in top], np.int64)[order]


def seen(s: np.ndarray, often: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How often each was seen, 0 for those that are not frequent."""
    if not len(often):
        return np.zeros(len(s), np.int64)
    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
    return np.where(often[at] == s, times[at], 0)


def prefix(s: np.ndarray, often: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The first n / 5 + 1 shingles of s, by how often they were seen and hash."""
    return s[np.argsort(seen(s, often, times), kind="stable")][: len(s) // 5 + 1]


def prefixes(rows: DataFrame, order: Order) -> DataFrame:
    """rows (row, text) to (row, n, firsts): the size of the set, and the shingles of its prefix in an order of their own."""
    shared = rows.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, times = shared.value
        for batch in batches:
            ids, texts = batch.column("row"), batch.column("text")
            for low in range(0, len(ids), BLOCK):
                sets = [shingles(t.as_py()) for t in texts[low : low + BLOCK]]
                firsts = [prefix(s, often, times) for s in sets]
                firsts = [f[np.argsort((f ^ f >> np.uint64(31)) * _MIX)].view(np.int64) for f in firsts]
                sizes = pa.array([len(s) for s in sets], pa.int32())
                yield pa.RecordBatch.from_arrays([ids[low : low + BLOCK], sizes, pa.array(firsts, pa.list_(pa.int64()))], ["row", "n", "firsts"])

    return rows.select("row", "text").mapInArrow(run, "row bigint, n int, firsts array<bigint>")


#: The sketch of a document's differences.
SKETCH = ("w0", "w1", "w2", "w3")
MET = f"a bigint, b bigint, na int, nb int, root bigint, d int, {', '.join(f'{w} bigint' for w in SKETCH)}, crowded boolean"
MET_NAMES = [c.split()[0] for c in MET.split(", ")]


def met_rows(*cols: np.ndarray) -> pa.RecordBatch:
    """A batch of MET; columns that are not given are 0."""
    *given, crowded = cols
    more = [np.zeros(len(crowded), np.int64)] * (len(MET_NAMES) - len(cols))
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * len(SKETCH), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip([*given, *more, crowded], kinds, strict=True)], MET_NAMES)


def pairs_of(group: list[np.ndarray], side: np.ndarray | None = None, few: int | None = None) -> Iterator[pa.RecordBatch]:
    """Of postings (key, row, size of the set, root; and, of differences from a pivot, the position of the key in them,
    their number and the words of their sketch), all pairs of one key with fitting sizes and different roots that can be 4/5
    alike if the key is the first they share: none before it is the same in both, behind it one has more than the other, and
    each bit in which the sketches differ is a difference. With `side` (0 or 1) only those of both sides, with `few`
    only so many of each row with those behind it. The work is that of the pairs with different roots."""
    order = np.lexsort((group[3], group[0]))
    k, r, n, root, *place = (x[order] for x in group)
    side = side[order] if side is not None else None
    ends = lambda new: np.repeat(np.r_[np.flatnonzero(new), len(k)][1:], np.diff(np.r_[np.flatnonzero(new), len(k)]))
    new_key = np.r_[True, k[1:] != k[:-1]] if len(k) else np.empty(0, bool)
    new_root = new_key | np.r_[True, root[1:] != root[:-1]] if len(k) else new_key
    first = ends(new_root)
    many = ends(new_key) - first  # rows behind that have the key and another root
    sums = np.cumsum(many)
    low = 0
    while low < len(k):
        high = max(low + 1, int(np.searchsorted(sums, (sums[low - 1] if low else 0) + PAIRS, "right")))
        x = np.repeat(np.arange(low, high), many[low:high])
        y = first[x] + np.arange(len(x)) - np.repeat(np.cumsum(many[low:high]) - many[low:high], many[low:high])
        fit = 5 * np.minimum(n[x], n[y]) >= 4 * np.maximum(n[x], n[y])
        if side is not None:
            fit &= side[x] != side[y]
        x, y = x[fit], y[fit]
        if place:
            i, d, *words = place
            fit = 9 * (i[x] + i[y] + np.abs((d[x] - i[x]) - (d[y] - i[y]))) <= n[x] + n[y]
            x, y = x[fit], y[fit]
            fit = 9 * sum(np.bitwise_count(w[x] ^ w[y]).astype(np.int64) for w in (w.view(np.uint64) for w in words)) <= n[x] + n[y]
            x, y = x[fit], y[fit]
        if few and len(x):
            new = np.r_[True, x[1:] != x[:-1]]
            fit = np.arange(len(x)) - np.flatnonzero(new)[np.cumsum(new) - 1] < few
            x, y = x[fit], y[fit]
        swap = r[x] > r[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        yield met_rows(r[x], r[y], n[x], n[y], np.zeros(len(x), bool))
        low = high


def in_groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], most: int | None) -> Iterator[tuple[bool, list[np.ndarray]]]:
    """Columns of whole groups of the first name, by which the batches are ordered; a group of more than `most` rows comes
    in parts, marked so."""
    held, large = None, None
    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if held is not None:
            now = [np.concatenate([h, x]) for h, x in zip(held, now, strict=True)]
        if not len(now[0]):
            continue
        if large is not None:
            high = int(np.searchsorted(now[0], large, "right"))
            yield True, [x[:high] for x in now]
            now = [x[high:] for x in now]
            if not len(now[0]):
                held = None
                continue
            large = None
        cut = int(np.searchsorted(now[0], now[0][-1], "left"))
        if cut:
            yield False, [x[:cut] for x in now]
        held = [x[cut:] for x in now]
        if most and len(held[0]) > most:
            large = held[0][0]
            yield True, held
            held = None
    if held is not None:
        yield large is not None, held


def counted(met: DataFrame) -> DataFrame:
    return met.groupBy(*MET_NAMES).agg(F.count("*").alias("met"))


def meetings(posts: DataFrame, most: int, few: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Postings (key, row, n, root; and of differences i, d and the sketch) to (a, b, na, nb, met): met adds up to the keys
    at which two documents that may be alike and have different roots meet; and to the postings of keys with more
    than `most`, which make no pairs."""
    names = ("key", "row", "n", "root", *[c for c in ("i", "d", *SKETCH) if c in posts.columns])
    crowd, most = CROWD, min(most, CROWD)

    def split(group: list[np.ndarray]) -> Iterator[tuple[bool, list[np.ndarray]]]:
        """Groups of more than `most` rows among whole ones, apart."""
        at = np.flatnonzero(group[0][1:] != group[0][:-1]) + 1
        starts, ends = np.r_[0, at], np.r_[at, len(group[0])]
        large = np.flatnonzero(ends - starts > most)
        done = 0
        for low, high in zip(starts[large].tolist(), ends[large].tolist(), strict=True):
            if done < low:
                yield False, [x[done:low] for x in group]
            if (group[3][low:high] != group[3][low]).any():
                yield True, [x[low:high] for x in group]
            done = high
        if done < len(group[0]):
            yield False, [x[done:] for x in group]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for crowded, whole in in_groups(batches, names, crowd):
            for large, group in [(True, whole)] if crowded else split(whole):
                if large:
                    k, r, n, root, *place = group
                    i, *others = place or [np.zeros(len(k), np.int32)]
                    yield met_rows(r, k, n, i, root, *others, np.ones(len(k), bool))
                else:
                    yield from pairs_of(group, None, few)

    met = written(counted(posts.repartition("key").sortWithinPartitions("key").mapInArrow(run, MET)), "near-met")
    left = met.filter("crowded").select(F.col("b").alias("key"), F.col("a").alias("row"), F.col("na").alias("n"), "root", F.col("nb").alias("i"), "d", *SKETCH)
    return met.filter("NOT crowded").select("a", "b", "na", "nb", "met"), left


def in_blocks(crowd: DataFrame, few: int | None = None) -> DataFrame:
    """Postings of crowded differences to (a, b) of the pairs that meet, each pair of blocks of a key's documents in a task of its own."""
    sizes = crowd.groupBy(F.col("key").alias("__key")).agg(
        F.ceil(F.count("*") / CROWD).cast("int").alias("blocks"), F.min("root").alias("__low"), F.max("root").alias("__high")
    )
    sizes = written(sizes.filter("__low <> __high"), "near-crowds")
    dealt = join_small(crowd, sizes, F.col("key") == F.col("__key"), F.col("row"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    posted = ["row", "n", "root", "i", "d", *SKETCH]
    dealt = dealt.select("key", *posted, "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    place = F.xxhash64("key", F.least("own", "with"), F.greatest("own", "with")).alias("place")
    dealt = dealt.select(place, *posted, (F.col("own") > F.col("with")).cast("int").alias("side"), (F.col("own") == F.col("with")).alias("same"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (*group, side, same) in in_groups(batches, ("place", *posted, "side", "same"), None):
            for kind, other in ((True, None), (False, side)):
                own = np.flatnonzero(same == kind)
                yield from pairs_of([c[own] for c in group], None if other is None else other[own], few)

    more = dealt.repartition("place").sortWithinPartitions("place").mapInArrow(blocks, MET)
    return written(counted(more), "near-blocks").select("a", "b")


def all_meetings(posts: DataFrame, few: int | None = None) -> DataFrame:
    """Postings of differences to (a, b), a written table: what meets at a difference, however many post it."""
    met, crowd = meetings(posts, CROWD, few)
    pairs = met.select("a", "b")
    return written((pairs if crowd.isEmpty() else pairs.unionByName(in_blocks(crowd, few))).distinct(), "near-pairs")


def candidates(met: DataFrame) -> DataFrame:
    """(a, b) of the pairs that meet as often as pairs above the threshold must, if not at a crowded key: of the prefix that
    ends first in the order, at most n - need can be missing from the other set, and the others lie in its prefix."""
    need = F.expr("(4 * (na + nb) + 8) DIV 9")
    least = F.least(*[F.expr(f"{n} DIV 5 + 1") - F.col(n) + need for n in ("na", "nb")])
    return met.filter(F.col("met") >= least).select("a", "b")


def differences(rows: DataFrame, crowd: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings of crowded keys to links (a, b): of rows (row, text) with their pivot, if they are 4/5 alike, and with their
    roots; and to postings of all rows at their rarest differences from it. The pivot of a key is the row, of those that post it, that has the
    most crowded keys: what is its own is little. A row alike to its pivot has the pivot's root from then on."""
    own = crowd.groupBy("row").agg(F.min("root").alias("root"), F.collect_set("key").alias("keys"))
    posts = written(own, "near-crowded").select("row", "root", F.size("keys").alias("many"), F.explode("keys").alias("key"))
    best = F.max(F.struct("many", F.xxhash64("row").alias("h"), "row")).alias("best")
    pivots = posts.groupBy(F.col("key").alias("__key")).agg(best, F.min("root").alias("low"), F.max("root").alias("high"))
    pivots = written(pivots.filter("low <> high").select("__key", F.col("best.row").alias("pivot")), "near-pivots")
    members = join_small(posts, pivots, F.col("key") == F.col("__key"), F.col("row")).select("pivot", "row", "root").distinct()
    members = written(members, "near-members")
    sets = sets_of(rows, written(members.select(F.col("row").alias("__end")).distinct(), "near-ends"))
    # a pivot's set goes once to each part of its members
    part = F.pmod(F.xxhash64("row"), F.lit(PARTS)).alias("part")
    centre = members.filter("pivot = row").select("row", F.col("root").alias("centre")).join(sets.select("row", F.col("s").alias("p")), "row")
    centre = members.select("pivot", part).distinct().join(centre, F.col("pivot") == F.col("row")).select("pivot", "part", "centre", "p")
    both = members.select("pivot", "row", "root", part).join(sets, "row").join(centre, ["pivot", "part"])

    # in SQL, a row at a time: batches of whole sets would take much of a worker's memory
    more, less = F.array_except("s", "p"), F.array_except("p", "s")
    found = both.select("pivot", "row", "root", "centre", F.size("s").alias("n"), F.size("p").alias("np"), more.alias("more"), less.alias("less"))
    alike = 9 * (F.size("more") + F.size("less")) <= F.col("n") + F.col("np")
    found = found.withColumn("alike", alike).withColumn("root", F.when(F.col("alike"), F.col("centre")).otherwise(F.col("root")))
    # a difference from one pivot is none from another
    keys = F.transform(F.concat("more", "less"), lambda e: F.xxhash64(F.col("pivot"), e)).alias("keys")
    found = written(found.select("pivot", "row", "n", "root", "alike", F.size("more").alias("added"), keys), "near-differences")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n = np.unique(batch.column("keys").flatten().to_numpy().view(np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["key", "n"])

    sample = found.filter(F.pmod(F.xxhash64("row"), F.lit(SAMPLE)) == 0).select("keys")
    shared = rows.sparkSession.sparkContext.broadcast(most_seen(sample.mapInArrow(count, "key bigint, n bigint")))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, times = shared.value
        for batch in (b.slice(low, BLOCK) for b in batches for low in range(0, len(b), BLOCK)):
            n, added = batch.column("n").to_numpy(), batch.column("added").to_numpy()
            firsts, d, sketch = [], [], []
            for i, keys in enumerate(batch.column("keys")):
                h = keys.values.to_numpy().view(np.uint64)
                order = np.lexsort((h, np.arange(len(h)) >= added[i], seen(h, often, times)))
                # another set, of at most 5/4 of the size, is alike if at most a ninth of both sizes differs
                firsts.append(h[order[: (n[i] + 5 * n[i] // 4) // 9 + 1]].view(np.int64))
                d.append(len(h))
                flips = np.bincount((h >> np.uint64(7)).astype(np.int64) & 255, minlength=256) & 1
                sketch.append(np.packbits(flips.astype(np.uint8)).view(np.int64))
            many = np.array([len(f) for f in firsts], np.int64)
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            cols = [np.concatenate(firsts) if firsts else np.empty(0, np.int64), *[np.repeat(batch.column(c).to_numpy(), many) for c in ("row", "n", "root")]]
            words = np.array(sketch, np.int64).reshape(-1, len(SKETCH))
            cols += [at.astype(np.int32), np.repeat(np.array(d, np.int32), many), *[np.repeat(w, many) for w in words.T]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "row", "n", "root", "i", "d", *SKETCH])

    kind = f"key bigint, row bigint, n int, root bigint, i int, d int, {', '.join(f'{w} bigint' for w in SKETCH)}"
    stars = found.filter("alike AND pivot <> row").select(F.col("pivot").alias("a"), F.col("row").alias("b"))
    stars = stars.unionByName(members.filter("row <> root").select(F.col("row").alias("a"), F.col("root").alias("b")))
    return stars.distinct(), found.select("row", "n", "root", "added", "keys").mapInArrow(post, kind)


def among(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """rows (row) with how (left_semi or left_anti) a written table of one id column, a broadcast if it is small: texts stay where they are."""
    one = ids.columns[0]
    few = ids.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(ids) if few else ids, F.col("row") == F.col(one), how)


def sets_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows (row, text) of ids (a written table of one column) to (row, s: the set of shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("row"), batch.column("text")
            for low in range(0, len(ids), BLOCK):
                sets = [shingles(t.as_py()).view(np.int64) for t in texts[low : low + BLOCK]]
                yield pa.RecordBatch.from_arrays([ids[low : low + BLOCK], pa.array(sets, pa.list_(pa.int64()))], ["row", "s"])

    return written(among(rows.select("row", "text"), ids, "left_semi").mapInArrow(run, "row bigint, s array<bigint>"), "near-sets")


def verified(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b; a written table) of rows (row, text), those at least 4/5 alike."""
    ends = written(pairs.select(F.explode(F.array("a", "b")).alias("__end")).distinct(), "near-ends")
    sets = sets_of(rows, ends)
    side: Callable[[str], DataFrame] = lambda c: sets.select(F.col("row").alias(f"__{c}"), F.col("s").alias(f"s{c}"))
    both = pairs.join(side("a"), F.col("a") == F.col("__a")).join(side("b"), F.col("b") == F.col("__b"))
    shared = F.size(F.array_intersect("sa", "sb"))
    alike = written(both.filter(9 * shared >= 4 * (F.size("sa") + F.size("sb"))).select("a", "b"), "near-alike")
    dropped(sets, ends)
    return alike


def rooted(firsts: DataFrame, roots: DataFrame, low: int = 0, many: int | None = None) -> DataFrame:
    """firsts (row, n, firsts) to postings (key, row, n, root): of all shingles of the prefixes, or of `many` from number low on.
    The root of a row is the one in roots (node, root: a written table), or its own number."""
    known = roots.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    if roots.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    keys = F.slice("firsts", low + 1, many) if many else F.col("firsts")
    named = firsts.select("row", "n", keys.alias("keys")).join(known, F.col("row") == F.col("__node"), "left")
    return named.select(F.explode("keys").alias("key"), "row", "n", F.coalesce("__root", "row").alias("root"))


def chains(rows: DataFrame, firsts: DataFrame, roots: DataFrame, low: int, many: int) -> DataFrame:
    """Verified pairs (a, b) of rows that are neighbours among those that post a shingle, in an order that differs from shingle to
    shingle, and have different roots: at most `many` candidates a row, from the shingles that start at number low. Rounds
    of it connect most of a large group of near copies before all its pairs are looked at: what one round has connected
    makes no pairs in the next. What they miss is left to links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (k, r, n, root) in in_groups(batches, ("key", "row", "n", "root"), CROWD):
            h = (r ^ k).view(np.uint64) * _MIX
            by = np.lexsort(((h ^ h >> np.uint64(29)) * _MIX, k))
            k, r, n, root = k[by], r[by], n[by], root[by]
            x, y = slice(None, -1), slice(1, None)
            fit = (k[x] == k[y]) & (root[x] != root[y]) & (5 * np.minimum(n[x], n[y]) >= 4 * np.maximum(n[x], n[y]))
            a, b = np.minimum(r[x], r[y])[fit], np.maximum(r[x], r[y])[fit]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    posts = rooted(firsts, roots, low, many)
    pairs = posts.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint").distinct()
    pairs = written(pairs, "near-chains")
    found = verified(rows, pairs)
    dropped(pairs)
    return found


def links(rows: DataFrame, firsts: DataFrame, roots: DataFrame) -> DataFrame:
    """rows (row, sig, text: a written table, no two with one sig) and their prefixes to links (a, b) that, with the roots
    (node, root: a written table of what is connected already), connect what all pairs of rows at least 4/5 alike connect."""
    met, crowd = meetings(rooted(firsts, roots), MEET)
    pairs = written(candidates(met), "near-pairs")
    found = verified(rows, pairs)
    dropped(pairs)
    if crowd.isEmpty():
        return found
    stars, posts = differences(rows, crowd)
    for few in (FEW, None):
        pairs = all_meetings(posts, few)
        found = found.unionByName(verified(rows, pairs))
        dropped(pairs)
        if few:
            known = written(components(stars.unionByName(found)), "near-roots").select(F.col("node").alias("row"), F.col("root").alias("known"))
            posts = posts.join(known, "row", "left").withColumn("root", F.coalesce("known", "root")).drop("known")
    return written(found.unionByName(stars), "near-found")
