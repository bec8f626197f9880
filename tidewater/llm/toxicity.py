"""Toxicity by a factorization machine over hashed terms.

A document is a sparse vector: how often, per hundred terms, it has each of its words and word stems (their first bytes),
hashed to BUCKETS. The score is the logistic of

    w0 + sum of w_i x_i + sum over pairs i < j of <v_i, v_j> x_i x_j

so two terms that are harmless alone (an insult, the name of a group) can weigh together, which no additive weights express; with
factors of FACTORS numbers the sum over pairs costs as much as the linear one.

Training is on a bounded sample: at most PER_CLASS labelled rows of each class (by a seeded hash; the classes' true shares
come back as weights), counted in Spark. The FEATURES buckets whose presence separates the classes best (likelihood ratio) get
parameters, the others have none; a bucket's values are scaled by that evidence, so what occurs by chance starts small. In
each of ROUNDS rounds SHARDS parts of the sample descend from the same parameters in parallel, and the mean of theirs is the start of
the next. The driver sees SHARDS * FEATURES * (FACTORS + 1) numbers a round, whatever the input, and the FEATURES buckets once.
Every whole text is scored, where it is read: no exchange.

Cases: a null text is an empty one, and a text without terms has the score of w0; labels that are null, or whose doc_id is null, are
not used, of several labels of a doc_id the largest counts; rows that repeat a labelled doc_id are examples each, within the
same bound; without examples of both classes every score is the share of toxic ones (0 without any); a null doc_id is not
held out; equal texts have equal scores; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, exact, seeded, text_of, written
from .divergence import terms_of

#: At most about so many labelled rows of each class train the model.
PER_CLASS = 8192
BUCKETS = 1 << 22
FEATURES, FACTORS = 4096, 8
#: Bytes of a word that make its stems.
STEMS = range(4, 9)
SHARDS, ROUNDS, EPOCHS, BATCH = 4, 8, 3, 64
STEP, RIDGE = 0.15, 1e-4
#: Evidence at which a bucket's values count half, and occurrences in a hundred terms beyond which more make no difference.
HALF, MOST = 8.0, 10.0
#: Score from which a document is predicted toxic.
THRESHOLD = 0.3
SEED = 12
HELD_OUT = (4, 2)
#: Terms whose features a worker remembers.
KNOWN = 500_000


def buckets_of(term: bytes) -> set[int]:
    """The buckets of a word and its stems."""
    return {zlib.crc32(b"=" + term) % BUCKETS, *(zlib.crc32(term[:k]) % BUCKETS for k in STEMS if k <= len(term))}


@dataclass
class Machine:
    """The parameters; features are rows of buckets, weights (one a feature) and factors."""

    buckets: np.ndarray
    scale: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    known: dict[bytes, tuple[int, ...]] = field(default_factory=dict)

    def __post_init__(self):
        self.of = {int(b): i for i, b in enumerate(self.buckets)}

    def __getstate__(self):
        return {**self.__dict__, "known": {}}

    def vectors(self, texts: list[bytes]) -> np.ndarray:
        """A row for each text: its scaled occurrences of each feature in a hundred terms."""
        out = np.zeros((len(texts), len(self.buckets)), np.float32)
        for row, text in zip(out, texts, strict=True):
            total = 0
            for terms in terms_of(text):
                total += len(terms)
                for term, n in Counter(terms).items():
                    at = self.known.get(term)
                    if at is None:
                        if len(self.known) >= KNOWN:
                            self.known.clear()
                        at = self.known[term] = tuple(self.of[b] for b in buckets_of(term) if b in self.of)
                    for i in at:
                        row[i] += n
            if total:
                np.minimum(row * (100.0 / total), MOST, out=row)
        return out * self.scale

    def margins(self, x: np.ndarray) -> np.ndarray:
        """The log odds of rows of vectors."""
        pairs = (x @ self.factors) ** 2 - (x * x) @ (self.factors**2)
        return self.bias + x @ self.weights + pairs.sum(axis=1) / 2

    def descend(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int, epochs: int = EPOCHS) -> Machine:
        """The machine after some epochs of AdaGrad over examples in a seeded order."""
        m = Machine(self.buckets, self.scale, self.bias, self.weights.copy(), self.factors.copy())
        grown = [1e-3, np.full_like(m.weights, 1e-3), np.full_like(m.factors, 1e-3)]
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), BATCH):
                at = order[i : i + BATCH]
                b = x[at]
                sums = b @ m.factors
                off = (weight[at] * (odds(m.margins(b)) - y[at]) / len(at)).astype(np.float32)
                g0, gw = float(off.sum()), off @ b + RIDGE * m.weights
                gv = b.T @ (off[:, None] * sums) - m.factors * (off @ (b * b))[:, None] + RIDGE * m.factors
                for k, g in enumerate((g0, gw, gv)):
                    grown[k] = grown[k] + g * g
                m.bias -= STEP * g0 / grown[0] ** 0.5
                m.weights -= STEP * gw / np.sqrt(grown[1])
                m.factors -= STEP * gv / np.sqrt(grown[2])
        return m

    def packed(self) -> bytes:
        return np.concatenate([[self.bias], self.weights, self.factors.ravel()]).astype(np.float64).tobytes()

    def mean(self, packed: list[bytes]) -> Machine:
        """The mean of descendants."""
        v = np.mean([np.frombuffer(p) for p in packed], axis=0)
        n = len(self.weights)
        return Machine(self.buckets, self.scale, float(v[0]), v[1 : n + 1].astype(np.float32), v[n + 1 :].reshape(self.factors.shape).astype(np.float32))


def odds(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin.astype(np.float64), -35, 35)))


def _sampled(rows: DataFrame, by: str, per_class: int, *keys) -> tuple[DataFrame, dict[int, int]]:
    """About per_class rows of each value of by, chosen by a seeded hash of keys, and the number of all."""
    n = {r[by]: r["n"] for r in rows.groupBy(by).agg(F.count("*").alias("n")).collect()}
    keep = F.lit(False)
    for value, count in n.items():
        keep = keep | ((F.col(by) == value) & (seeded(SEED, *keys) < int(min(1.0, per_class / count) * (1 << 60))))
    return rows.filter(keep), n


def examples(docs: DataFrame, labels: DataFrame, learn, per_class: int, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, dict[int, int]]:
    """(y, text, shard): a sample of the rows that may teach, and the labels of each class."""
    known = labels.filter(exact(id_col).isNotNull() & exact(label_col).isNotNull()).groupBy(exact(id_col).alias("__id")).agg((F.max(exact(label_col)) > 0).cast("int").alias("y"))
    known = written(known.filter(learn("__id")), "toxicity-labels")
    few, n = _sampled(known, "y", per_class, F.col("__id"))
    # at most about 2 * per_class ids
    found = docs.select(exact(id_col).alias("__doc"), text_of(exact(text_col)).alias("text")).join(F.broadcast(few), F.col("__doc") == F.col("__id"))
    own = F.monotonically_increasing_id()
    rows = written(found.select("__id", "y", "text", own.alias("row")), "toxicity-rows")
    sample, _ = _sampled(rows, "y", per_class, F.col("__id"), F.col("row"))
    dropped(known)
    return sample.select("y", "text", F.pmod(F.xxhash64(F.lit(SEED), "__id", "row"), F.lit(SHARDS)).alias("shard")), n


def _present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, clean, toxic): the documents of each class that have a bucket."""
    of: tuple[Counter, Counter] = (Counter(), Counter())

    def out() -> Iterator[pa.RecordBatch]:
        names = list({*of[0], *of[1]})
        yield pa.record_batch([pa.array(names, pa.int64()), *(pa.array([c[b] for b in names], pa.int64()) for c in of)], names=["bucket", "clean", "toxic"])

    for batch in batches:
        for y, text in zip(batch.column("y").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
            of[y].update({b for terms in terms_of(text.as_py()) for t in set(terms) for b in buckets_of(t)})
            if len(of[0]) + len(of[1]) > KNOWN:
                yield from out()
                of[0].clear()
                of[1].clear()
    yield from out()


def evidence(sample: DataFrame, clean: int, toxic: int, features: int) -> DataFrame:
    """(bucket, g): the features buckets with the largest likelihood ratio between presence in clean and in toxic documents."""
    n = sample.select("y", "text").mapInArrow(_present, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b"))
    both, all_ = F.col("a") + F.col("b"), float(clean + toxic)
    part = lambda seen, expected: F.when(seen > 0, seen * F.ln(seen / expected)).otherwise(0.0)
    g = part(F.col("a"), both * (clean / all_)) + part(F.col("b"), both * (toxic / all_))
    g = g + part(clean - F.col("a"), (all_ - both) * (clean / all_)) + part(toxic - F.col("b"), (all_ - both) * (toxic / all_))
    return n.select("bucket", F.round(2 * g, 6).alias("g")).orderBy(F.desc("g"), "bucket").limit(features)


def _vectors(machine: Machine):
    """Of rows (y, text, shard): their vectors without zeros, and a key to order them by in every run alike."""

    def run(batches: Iterator[pa.RecordBatch], size: int = 128) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                part = batch.slice(i, size)
                texts = [t.as_py() for t in part.column("text").cast(pa.binary())]
                rows = machine.vectors(texts)
                at = [np.flatnonzero(r) for r in rows]
                cols = [pa.array([zlib.crc32(t) for t in texts], pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array([r[k] for r, k in zip(rows, at, strict=True)], pa.list_(pa.float32()))]
                yield pa.record_batch([part.column("shard"), part.column("y"), *cols], names=["shard", "y", "key", "at", "x"])

    return run


def _round(machine: Machine, weights: dict[int, float], number: int):
    """Of a part of the sample: the parameters that it descends to from the machine's."""

    def run(key, part):
        import pandas as pd

        part = part.sort_values(["key", "y"], kind="stable")
        y = part["y"].to_numpy(np.float32)
        x = np.zeros((len(part), len(machine.buckets)), np.float32)
        for row, at, values in zip(x, part["at"], part["x"], strict=True):
            row[at] = values
        after = machine.descend(x, y, np.where(y > 0, weights[1], weights[0]).astype(np.float32), number * SHARDS + int(key[0]))
        return pd.DataFrame({"shard": [key[0]], "packed": [after.packed()]})

    return run


def fitted(docs: DataFrame, labels: DataFrame, learn=lambda i: F.lit(True), per_class: int = PER_CLASS, features: int = FEATURES, factors: int = FACTORS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine | float:
    """The machine of labelled documents; learn (of an id's column) says which may teach. A float: the share of toxic ones, without
    examples of both classes."""
    sample, labelled = examples(docs, labels, learn, per_class, id_col, text_col, label_col)
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return float(1 in n)
    best = evidence(sample, n[0], n[1], features).collect()
    z = np.sqrt(np.maximum([r.g for r in best], 0))
    rng = np.random.default_rng(SEED)
    share = labelled[1] / (labelled[0] + labelled[1])
    weights = {1: share * (n[0] + n[1]) / n[1], 0: (1 - share) * (n[0] + n[1]) / n[0]}  # as if drawn without regard to the class
    start = rng.normal(0, 0.05, (len(best), factors)).astype(np.float32)
    machine = Machine(np.array([r.bucket for r in best]), (z / (z + HALF)).astype(np.float32), float(np.log(share / (1 - share))), np.zeros(len(best), np.float32), start)
    sample = written(sample.mapInArrow(_vectors(machine), "shard long, y int, key long, at array<int>, x array<float>"), "toxicity-vectors")
    for i in range(ROUNDS):
        parts = sample.groupBy("shard").applyInPandas(_round(machine, weights, i), "shard long, packed binary").collect()  # SHARDS rows
        machine = machine.mean([bytes(r.packed) for r in sorted(parts, key=lambda r: r["shard"])])
    dropped(sample)
    return machine


def scored(docs: DataFrame, machine: Machine | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    rows = docs.select(exact(id_col).alias("doc_id"), text_of(exact(text_col)).alias("text"))
    if isinstance(machine, float):
        return rows.select("doc_id", F.lit(machine).alias("score"))

    def score(batches: Iterator[pa.RecordBatch], size: int = 128) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                part = batch.slice(i, size)
                margins = machine.margins(machine.vectors([t.as_py() for t in part.column("text").cast(pa.binary())]))
                yield pa.record_batch([part.column("doc_id"), pa.array(odds(margins), pa.float64())], names=["doc_id", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, score double")


def op12_toxicity(spark, sf_dir: str) -> DataFrame:
    """All documents scored by a machine that has learned from the labels of those that are not held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = lambda i: F.coalesce(F.crc32(F.col(i).cast("string").cast("binary")) % HELD_OUT[0] == HELD_OUT[1], F.lit(False))
    out = scored(docs, fitted(docs, labels, lambda i: ~held(i)))
    return out.select("doc_id", held("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
