"""Substring deduplication with a sparse suffix array.

Texts are sequences of words. Of all suffixes, only those at minimisers are retained: positions whose GRAM words have
the least hash in some window of WINDOW positions. Any two passages of LENGTH words that are equal hold the same
minimiser among their first WINDOW positions, with at least LENGTH - WINDOW + 1 words behind it, the prefix by which the
sparse suffixes are sorted and compared (as a 64-bit hash of it): equal neighbours in different documents are seeds.

Seeds are extended left and right in two steps. If all the words that the windows of a seed cover (the windows of LENGTH words
whose minimiser it is) are the same in another document, all these windows repeat; copies and the inside of long
passages end here, one row a seed. Where other words surround the seed elsewhere, its windows are compared one
by one by a 128-bit hash; two documents stand for all that agree around a seed. So passages of LENGTH words or more
are found exactly, shorter ones are not reported, and a third document that shares only one side of a passage can't
hide it. Matched windows that touch make a span.

Every comparison is a count with partial aggregates, and passages that very many documents have meet their counts by a broadcast
of a bounded number of keys, so neither a passage in a third of all documents nor a large group of copies gathers in one task; texts are shuffled once, to meet the seeds whose windows are compared.

Cases: null and empty texts have no words and no spans; rows equal in id and text are one document; a passage that only
repeats within one document is not reported; null ids are told apart by text; an empty table gives an empty
result; other columns are not read; long texts are handled whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, exact, join_hot, written

LENGTH = 50
WINDOW = 35
GRAM = 4
#: Words of whose hash a worker keeps a table.
TABLE = 400_000
_FIND = re.compile(r"[^\x20\x09-\x0D]+").findall
_ITER = re.compile(r"[^\x20\x09-\x0D]+").finditer
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_HASHES: dict[str, int] = {}


def hashed(words: list[str]) -> np.ndarray:
    """64-bit hashes of words."""
    from xxhash import xxh64_intdigest

    if len(_HASHES) > TABLE:
        _HASHES.clear()
    for w in set(words).difference(_HASHES):
        _HASHES[w] = xxh64_intdigest(w.encode())
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64 for i up to n."""
    if base not in _POWERS or len(_POWERS[base][0]) <= n:
        size = max(1 << 14, 1 << (n + 1).bit_length())
        up = lambda b: np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)], dtype=np.uint64)
        _POWERS[base] = up(base), up(pow(base, -1, 1 << 64))
    return _POWERS[base]


class Runs:
    """Hashes of runs of words, from running sums of hash times power."""

    def __init__(self, h: np.ndarray, base: int):
        up, self.down = powers(base, len(h))
        self.sums = np.r_[np.uint64(0), np.cumsum(h * up[: len(h)], dtype=np.uint64)]

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return mix((self.sums[high] - self.sums[low]) * self.down[low])

    def every(self, n: int) -> np.ndarray:
        """Of all runs of n words."""
        k = max(0, len(self.sums) - n)
        return mix((self.sums[n:] - self.sums[:k]) * self.down[:k])


def owned(h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Runs]:
    """The minimisers of a text, and for each the first and the last start of a window of `length` words that is its own."""
    one = Runs(h, BASES[0])
    grams = one.every(GRAM)
    starts = len(h) - length + 1
    if starts <= 0:
        none = np.empty(0, np.int64)
        return none, none, none, one
    least = np.argmin(np.lib.stride_tricks.sliding_window_view(grams, WINDOW)[:starts], axis=1) + np.arange(starts)
    first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    return least[first], first, np.r_[first[1:], starts] - 1, one


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, chars: bool = True) -> DataFrame:
    """One row a span: doc_id, start_word, end_word (exclusive), n_words, first (whether no document with a smaller key has
    any part of it: the copy to keep), uid and, with chars, start_char and end_char (code points), for which texts are
    read once more.

    length: the least number of words; more than WINDOW + GRAM."""
    prefix = length - WINDOW + 1
    doc_id, text = exact(id_col), exact(text_col)
    rows = docs.select(doc_id.cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(doc_id, F.lit(1), text).alias("uid"))
    rows = rows.filter(F.octet_length("text") >= 2 * length - 1)  # fewer bytes than that are fewer words

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = hashed(_FIND(text.as_py()))
                at, a, b, one = owned(h, length)
                if len(at):
                    keys = Runs(h, BASES[1])(at, at + prefix)
                    # all the words that the seed's windows cover, and where the seed and they lie
                    around = mix(one(a, b + length) + ((at - a) << 32 | (b - a)).astype(np.uint64))
                    for o, v in zip(out, (np.full(len(at), uid), keys.view(np.int64), around.view(np.int64), a.astype(np.int32), b.astype(np.int32)), strict=True):
                        o.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["uid", "key", "around", "a", "b"])

    sparse = written(rows.select("uid", "text").mapInArrow(suffixes, "uid bigint, key bigint, around bigint, a int, b int"), "repeat-suffixes")
    lo_hi = lambda lo, hi: (F.min(lo).alias("lo"), F.max(hi).alias("hi"))
    contexts = written(sparse.groupBy("key", "around").agg(*lo_hi("uid", "uid"), F.count("*").alias("rows")), "repeat-contexts")
    ends = [c.alias(f"__{n}") for n, c in zip(("lo", "hi"), lo_hi("lo", "hi"), strict=True)]
    keys = contexts.groupBy(F.col("key").alias("__key")).agg(*ends, F.count("*").alias("n")).filter("__lo <> __hi")
    keys = written(keys, "repeat-keys")
    # whole: the same words around the seed in another document, so all its windows repeat; windows: the key has
    # other words around it elsewhere, so its windows are compared one by one (of equal contexts, two stand for all)
    judged = join_hot(contexts, keys, F.col("key") == F.col("__key"), "n", contexts.count())
    whole, mixed = (F.col("lo") != F.col("hi")).alias("whole"), (F.col("n") > 1).alias("mixed")
    judged = judged.select(F.col("key").alias("__k"), F.col("around").alias("__around"), "lo", "hi", "rows", whole, mixed)
    judged = written(judged, "repeat-judged")
    dropped(contexts, keys)
    same = (F.col("key") == F.col("__k")) & (F.col("around") == F.col("__around"))
    seeds = join_hot(sparse, judged, same, "rows", sparse.count())
    sent = F.col("mixed") & (~F.col("whole") | (F.col("uid") == F.col("lo")) | (F.col("uid") == F.col("hi")))
    first = (F.col("whole") & (F.col("uid") == F.col("lo"))).alias("first")
    seeds = written(seeds.select("uid", "a", "b", "whole", sent.alias("sent"), first), "repeat-seeds")
    dropped(sparse, judged)
    ranges = seeds.filter("sent").groupBy(F.col("uid").alias("__uid")).agg(F.collect_list(F.struct("a", "b")).alias("ranges"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for uid, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                h = hashed(_FIND(text.as_py()))
                a, b = own.values.field("a").to_numpy(), own.values.field("b").to_numpy()
                at = np.unique(np.concatenate([np.arange(x, y + 1) for x, y in zip(a, b, strict=True)]))
                for o, v in zip(out, (np.full(len(at), uid), at.astype(np.int32), Runs(h, BASES[0])(at, at + length).view(np.int64), Runs(h, BASES[1])(at, at + length).view(np.int64)), strict=True):
                    o.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["uid", "at", "h1", "h2"])

    meeting = rows.join(ranges, F.col("uid") == F.col("__uid")).select("uid", "text", "ranges")
    every = written(meeting.mapInArrow(windows, "uid bigint, at int, h1 bigint, h2 bigint"), "repeat-windows")
    shared = every.groupBy(F.col("h1").alias("__h1"), F.col("h2").alias("__h2")).agg(*lo_hi("uid", "uid"), F.count("*").alias("rows")).filter("lo <> hi")
    shared = written(shared.drop("hi"), "repeat-shared")
    met = join_hot(every, shared, (F.col("h1") == F.col("__h1")) & (F.col("h2") == F.col("__h2")), "rows", every.count())
    single = met.select("uid", F.col("at").alias("a"), F.col("at").alias("b"), (F.col("uid") == F.col("lo")).alias("first"))
    marks = seeds.filter("whole").select("uid", "a", "b", "first").unionByName(single)
    marks = marks.groupBy(F.col("uid").alias("__uid")).agg(F.array_sort(F.collect_list(F.struct("a", "b", "first"))).alias("marks"))
    marks = written(marks, "repeat-marks")
    dropped(every, seeds, shared)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            texts = batch.column(3) if chars else [None] * batch.num_rows
            for doc_id, uid, own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), texts, strict=True):
                a, b = own.values.field("a").to_numpy(), own.values.field("b").to_numpy()
                first = own.values.field("first").to_numpy(zero_copy_only=False)
                ends = np.maximum.accumulate(b)
                cut = np.flatnonzero(np.r_[True, a[1:] > ends[:-1] + length])  # windows that touch or overlap are one span
                place = [m.span() for m in _ITER(text.as_py())] if chars else None
                for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(a)], strict=True):
                    low, high = int(a[x]), int(ends[y - 1]) + length
                    out.append((doc_id, uid, low, high, high - low, bool(first[x:y].all()), *((place[low][0], place[high - 1][1]) if chars else ())))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
                names = ["doc_id", "uid", "start_word", "end_word", "n_words", "first", "start_char", "end_char"]
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], names[: len(cols)])

    kind = "doc_id bigint, uid bigint, start_word bigint, end_word bigint, n_words bigint, first boolean" + ", start_char bigint, end_char bigint" * chars
    needed = ["doc_id", "uid", "marks", *["text"] * chars]
    return rows.select("doc_id", "uid", *["text"] * chars).join(marks, F.col("uid") == F.col("__uid")).select(*needed).mapInArrow(merged, kind)


def op10_repeats(spark, sf_dir: str) -> DataFrame:
    """Passages of LENGTH words or more that occur in two or more documents, in all documents."""
    return spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), chars=False).drop("uid")
