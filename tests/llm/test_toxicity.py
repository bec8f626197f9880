"""Toxicity: the factorization machine against its definition, what it learns that weights alone miss, and held-out accuracy."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import toxicity
from tidewater.llm.queries import QUERIES

WORDS = [f"wort{i}{'abcdefgh'[i % 8]}" for i in range(60)]


def said(rng, *parts, n=60):
    words = rng.choices(WORDS, k=n)
    for p in parts:
        for _ in range(2):
            words.insert(rng.randrange(len(words)), p)
    return " ".join(words)


@pytest.fixture(scope="module")
def pairs():
    """Toxic is an insult together with a group; either alone, or an insult with something else, is not."""
    rng = random.Random(3)
    rows = []
    for i in range(1200):
        insult, group = i % 2, i // 2 % 2
        rows.append((i, said(rng, *(["vermin"] if insult else []), *(["martians"] if group else [])), insult & group))
    return rows


def tables(spark, rows):
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")


def hits(scores, rows, threshold=0.5):
    return sum((scores[i] >= threshold) == bool(y) for i, _, y in rows) / len(rows)


def test_machine_is_its_definition():
    rng = np.random.default_rng(0)
    m = toxicity.Machine(np.arange(7), np.ones(7, np.float32), 0.3, rng.normal(size=7), rng.normal(size=(7, 3)))
    x = rng.normal(size=(5, 7))
    want = [0.3 + r @ m.weights + sum(m.factors[i] @ m.factors[j] * r[i] * r[j] for i, j in itertools.combinations(range(7), 2)) for r in x]
    assert m.margins(x) == pytest.approx(want)
    # the step is against the slope of the loss
    y, w = np.array([1, 0, 1, 0, 1.0]), np.ones(5)
    loss = lambda m: -np.log(np.where(y > 0, toxicity.odds(m.margins(x)), 1 - toxicity.odds(m.margins(x)))).sum()
    assert loss(m.descend(x, y, w, 1, epochs=40)) < loss(m)
    assert m.mean([m.packed(), m.packed()]).factors == pytest.approx(m.factors, abs=1e-6)


def test_vectors_are_rates_of_whole_texts(monkeypatch):
    m = toxicity.Machine(np.array(sorted(toxicity.buckets_of(b"idiots"))), np.ones(4, np.float32), 0, np.zeros(4), np.zeros((4, 2)))
    text = b"Idiots and " + b"more " * 97 + b"IDIOTS"
    got = m.vectors([text, b"", b"none of it"])
    assert got[0] == pytest.approx([2.0] * 4) and not got[1:].any()  # the word and its stems of 4, 5 and 6 bytes: 2 in 100
    assert m.vectors([b"idiotic"])[0].max() == toxicity.MOST  # the stems are shared


def test_pairs_that_weights_miss(spark, pairs):
    docs, labels = tables(spark, pairs)
    learn = lambda i: F.col(i) % 3 != 0
    held = [r for r in pairs if r[0] % 3 == 0]
    share = {}
    for factors in (0, toxicity.FACTORS):
        m = toxicity.fitted(docs, labels, learn, factors=factors)
        share[factors] = {r.doc_id: r.score for r in toxicity.scored(docs, m).collect()}
    whole = toxicity.fitted(docs, labels, learn)
    machine = hits(share[toxicity.FACTORS], held)
    assert machine >= 0.97
    # insult and group weigh together more than the sum of both
    odd = lambda *words: float(whole.margins(whole.vectors([" ".join(["wort1b"] * 46 + [*words * 2]).encode()]))[0])
    together, alone = odd("vermin", "martians") - odd(), odd("vermin") + odd("martians") - 2 * odd()
    assert together > alone + 1


def test_held_out_accuracy_and_reruns(spark, tmp_path):
    """op12 over a corpus with a third of copies, labels for half of it, and toxic words at about two in a hundred."""
    rng = random.Random(5)
    bad = ["scumbag", "pathetic", "worthless"]
    rows = []
    for i in range(900):
        y = int(rng.random() < 0.15)
        text = "the same text again and again" if i % 3 == 0 else said(rng, *(rng.choices(bad, k=3) if y else []), n=rng.choice([5, 60, 400]) if not y else 100)
        rows.append((i, text, 0 if i % 3 == 0 else y))
    docs, labels = tables(spark, rows)
    docs.withColumn("toxic", F.lit(9)).write.parquet(f"{tmp_path}/documents.parquet")
    labels.filter("doc_id % 5 < 3").write.parquet(f"{tmp_path}/labels.parquet")
    out = QUERIES["op12_toxicity"](spark, f"file://{tmp_path}")
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    held = [r for r in rows if got[r[0]].held_out]
    assert hits({i: r.score for i, r in got.items()}, held, 0.3) >= 0.98
    assert len({got[i].score for i in range(0, 900, 3)}) == 1
    again = {r.doc_id: r.score for r in QUERIES["op12_toxicity"](spark, f"file://{tmp_path}").collect()}
    assert again == pytest.approx({i: r.score for i, r in got.items()}, abs=1e-9)
    # labels of held-out rows and other columns play no part
    flipped = labels.filter("doc_id % 5 < 3").withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    flipped.write.parquet(f"{tmp_path}/b/labels.parquet")
    docs.withColumn("source", F.lit("s")).write.parquet(f"{tmp_path}/b/documents.parquet")
    other = {r.doc_id: r.score for r in QUERIES["op12_toxicity"](spark, f"file://{tmp_path}/b").collect()}
    assert other == pytest.approx(again, abs=1e-6)


def test_sample_is_bounded_and_weighted(spark, pairs):
    docs, labels = tables(spark, pairs)
    docs = docs.unionByName(docs.filter("doc_id = 3").crossJoin(spark.range(500).select()))  # a labelled id that repeats
    sample, labelled = toxicity.examples(docs, labels, lambda i: F.lit(True), 40, "doc_id", "text", "toxic")
    n = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    assert all(15 <= n[y] <= 75 for y in (0, 1))
    assert labelled == {0: 900, 1: 300}
    scores = {r.doc_id: r.score for r in toxicity.scored(docs, toxicity.fitted(docs, labels, per_class=150)).collect()}
    assert hits(scores, pairs) >= 0.85
    assert sum(scores.values()) / len(scores) == pytest.approx(0.25, abs=0.08)  # as likely as among the labels, not among the sample


def test_odd_labels_and_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(1, 1), (2, 1), (None, 0), (3, None)], "doc_id long, toxic int")
    both = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (3, 1), (5, 0), (7, 1), (None, 0), (99, 0)], "doc_id long, toxic int")
    extra = odd.select("*", *[F.lit(f"x{i}").alias(n) for i, n in enumerate("__id __doc y row shard score predicted toxic key at x".split())])
    for labels, want in ((none, {0.0}), (one, {1.0})):
        assert {r.score for r in toxicity.scored(odd, toxicity.fitted(odd, labels)).collect()} == want
    a, b = (sorted(((r.doc_id, r.score) for r in toxicity.scored(d, toxicity.fitted(d, both)).collect()), key=repr) for d in (odd, extra))
    assert a == b
    assert len(a) == odd.count() and all(0 <= s <= 1 for _, s in a)
    assert toxicity.scored(odd.limit(0), toxicity.fitted(odd.limit(0), both)).count() == 0
