"""The inverted file against brute force, candidates of companies and what they share."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions import text
from tidewater.operators import dedup, nearest
from tidewater.operators.nearest import Index
from tidewater.queries import QUERIES
from tidewater.sources.shared import stored


def frame(spark, v, ids=None):
    return spark.createDataFrame([(int(i), [float(x) for x in r]) for i, r in zip(ids if ids is not None else range(len(v)), v, strict=True)], "id long, v array<double>")


def clustered(n, seed=1, dim=24):
    """Vectors around centres, about thirty to each."""
    rng = np.random.default_rng(seed)
    return rng.standard_normal((n // 30 + 1, dim))[rng.integers(0, n // 30 + 1, n)] + rng.standard_normal((n, dim)) * 0.3


def exact_top(v, k):
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -2)
    return s, np.lexsort((np.broadcast_to(np.arange(len(v)), s.shape), -s))[:, :k]


def recall(index, v, k):
    """Of the k most alike of each (ties count for each other), how many are found."""
    s, best = exact_top(v, k)
    edge = np.take_along_axis(s, best[:, -1:], 1)[:, 0]
    found = index.neighbours(k).collect()
    assert all(r.similarity == pytest.approx(s[r.a, r.b], abs=2e-9) and r["rank"] <= k for r in found)
    return sum(r.similarity >= edge[r.a] - 2e-9 for r in found) / best.size


def test_exact_while_all_cells_are_asked(spark):
    v = clustered(400)
    for index in (Index(frame(spark, v)), Index(frame(spark, v), rows=20, probes=99)):
        got = {(r.a, r["rank"]): r.b for r in index.neighbours(5).collect()}
        _, best = exact_top(v, 5)
        assert got == {(i, k + 1): int(b) for i, row in enumerate(best) for k, b in enumerate(row)}


@pytest.mark.parametrize("table, rows", [("part", 10), ("embeddings", 20)])
def test_recall_of_the_first_fifty(spark, sf_dir, table, rows):
    """Of the names of parts and of embeddings, with so many cells that only a part of them is asked."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if table == "part":
        named = df.select(text.normalize_name(F.concat_ws(" ", "p_name", "p_type")).alias("name")).distinct().orderBy("name").collect()
        vectors = dedup.gram_vectors(spark.createDataFrame([(i, r.name) for i, r in enumerate(named)], "id long, name string"))
        probes = 10
    else:
        vectors = df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
        probes = 20
    v = np.array([r.v for r in vectors.orderBy("id").collect()])
    index = Index(vectors, rows=rows, probes=probes)
    assert index.n == len(v) and index.cells.n > probes and index.comparisons() < 0.95 * len(v) ** 2
    assert recall(index, v, 50) >= 0.9


def test_work_of_a_vector_stays_flat(spark, monkeypatch):
    """Four times the vectors, four times the cells: as many comparisons each, on one level of cells and on two."""
    work = {}
    for fan in (256, 16):
        monkeypatch.setattr(nearest, "FAN", fan)
        for n in (1000, 4000):
            v = clustered(n)
            index = Index(frame(spark, v), rows=25, probes=6)
            work[fan, n] = index.comparisons() / n
            assert index.cells.n == pytest.approx(n / 25, rel=0.35)
            assert recall(index, v, 10) >= 0.9
        assert work[fan, 4000] < 1.5 * work[fan, 1000]


def test_copies_zeros_and_crowds(spark, monkeypatch):
    """A third of all rows are one vector; blocks of a crowded cell; vectors of zeros; scaled vectors are equal."""
    monkeypatch.setattr(nearest, "BLOCK", 7)
    monkeypatch.setattr(nearest, "ASKED", 11)
    v = np.concatenate([clustered(60), np.tile(np.eye(24)[0], (40, 1)), [[0.0] * 24] * 2, [np.eye(24)[0] * 3, np.eye(24)[1]]])
    df = frame(spark, v).unionByName(spark.createDataFrame([(None, [1.0] * 24), (500, None)], "id long, v array<double>"))
    index = Index(df)
    members = {r.id: r.rep for r in index.members.collect()}
    assert len(members) == len(v) and {members[i] for i in range(60, 100)} == {60} and members[102] == 60 and members[101] == 100
    reps = sorted(set(members.values()))
    s, best = exact_top(v[reps], 4)
    got = {(r.a, r["rank"]): r.b for r in index.neighbours(4).collect()}
    assert got == {(reps[i], k + 1): reps[b] for i, row in enumerate(best) for k, b in enumerate(row)}
    assert {(r.a, r.b) for r in index.pairs(4, 0.7).collect()} == {tuple(sorted((reps[i], reps[b]))) for i, row in enumerate(best) for b in row if s[i, b] >= 0.7}
    empty = Index(df.limit(0))
    assert empty.n == 0 and empty.neighbours(3).count() == 0 and empty.pairs(3, 0.5).count() == 0 and empty.comparisons() == 0


def test_gram_vectors(spark):
    import hashlib

    names = ["acme ltd", "é😀x", "a", "", None]
    got = {r.id: r.v for r in dedup.gram_vectors(spark.createDataFrame(list(enumerate(names)), "id int, name string")).collect()}
    for i, name in enumerate(names):
        want = [0.0] * 64
        for n in (2, 3, 4):
            for j in range(len(name or "") - n + 1):
                want[int(hashlib.md5(name[j : j + n].encode()).hexdigest()[:8], 16) % 64] += 1
        assert got[i] == want


def test_evidence_and_names(spark):
    """A switchboard number that all companies have, one company with very many values, blank and repeated names."""
    rows = [(c, "phone", "800", None, 9) for c in range(50)] + [(0, "email", f"m{i}", "Ann", i) for i in range(300)]
    rows += [(1, "email", f"m{i}", " ", 0) for i in range(3)] + [(1, "email", "m2", "Bea ", 1), (1, "phone", "800", "  Zoe", 3), (7, "phone", "800", "Yan", 5), (2, "phone", "", "x", 1), (2, "phone", None, "x", 1)]
    contacts = spark.createDataFrame(rows, "company int, kind string, value string, name string, ord int")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 60), (5, 0)], "a int, b int")
    got = {(r.a, r.b): (r.shared, r.evidence_score, r.shared_contacts and [tuple(x) for x in r.shared_contacts]) for r in dedup.evidence(pairs, contacts).collect()}
    assert got == {
        (0, 1): (4, 80.0, [("Zoe", "800", "phone"), ("Ann", "m0", "email"), ("Bea", "m2", "email")]),
        (1, 2): (1, 20.0, [("Zoe", "800", "phone")]),
        (2, 60): (0, 0.0, None),
        (5, 0): (1, 20.0, [("Zoe", "800", "phone")]),
    }
    bare = dedup.evidence(pairs, contacts.drop("name", "ord")).filter("a = 1").first()
    assert bare.shared == 1 and [tuple(x) for x in bare.shared_contacts] == [("800", "800", "phone")]
    assert dedup.evidence(pairs.limit(0), contacts).count() == 0 and dedup.evidence(pairs, contacts.limit(0)).agg(F.sum("shared")).first()[0] == 0


def test_run_reports_and_orders(spark):
    companies = spark.createDataFrame([(1, "Blue River Foods Ltd"), (2, "blue river foods"), (3, "Blue River Food"), (4, "Quantum Xylo"), (5, None), (6, "QUANTUM XYLO")], "id int, name string")
    contacts = spark.createDataFrame([(c, "phone", str(v)) for c in (1, 3, 4) for v in range(5)], "company int, kind string, value string")
    known = spark.createDataFrame([(2, 1)], "a int, b int")
    for exact in (False, True):
        out = dedup.run(companies, contacts, known, exact=exact).collect()
        assert {(r.a, r.b) for r in out} == {(1, 3), (2, 3), (4, 6)} and [r.similarity for r in out] == sorted((r.similarity for r in out), reverse=True)
    pairs = dedup.scored_pairs(companies, contacts)
    r = dedup.report(companies, pairs, known).first()
    assert (r.total_companies, r.pairs_found, r.auto_merged, r.need_review, r.new_pairs_found) == (6, 4, 1, 3, 3)
    assert r.avg_match_score == pytest.approx(pairs.agg(F.avg("match_score")).first()[0], abs=0.006)


def test_copies_give_a_row_each(spark):
    """Of 3000 rows, a third with one name, every copy is one row, and different names keep all their pairs, whatever the parts."""
    norm = F.when(F.col("id") % 3 == 0, "blue river").otherwise(F.concat(F.lit("name "), F.col("id") % 40))
    names = spark.range(3000).select("id", norm.alias("norm"))
    rows = names.collect()
    first = {}
    for r in rows:
        first.setdefault(r.norm, r.id)
    star = {(first[r.norm], r.id) for r in rows if first[r.norm] != r.id}
    met = {tuple(sorted((a, b))) for a in first.values() for b in first.values() if a != b}
    for size in (2000, 7):
        got = dedup.blocked_pairs(names, F.lit("x"), size).collect()
        assert len(got) == len(star | met) and {(r.a, r.b) for r in got} == star | met
    got = dedup.exact_pairs(names.unionByName(spark.createDataFrame([(5000, ""), (5001, "")], "id long, norm string"))).collect()
    assert len(got) == len(star) and {(r.a, r.b) for r in got} == star
    near = dedup.nearest_pairs(names.select("id", dedup.hashed_vector(F.col("norm")).alias("v"))).collect()
    assert star <= {(r.a, r.b) for r in near} <= star | met and len(near) <= len(star | met)


def test_legal_forms_in_one_pass(spark):
    names = ["The Co Inc. LTD co", "co-co group holding holdings", "Tech Technologies techno", "A.G. SA sa", "科技co公司 Ltd", None]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(text.normalize_name(F.col("n"))).collect()]
    assert got[:4] == ["the", "", "techno", "a g"] and got[5] == ""


def test_pairs_that_share_nothing_go_first(spark, monkeypatch):
    """Pairs without a common value never meet as rows of values; those with one, and companies of very many values, stay."""
    monkeypatch.setattr(dedup, "MANY", 20)
    rows = [(c, "phone", str(c % 7)) for c in range(40)] + [(90, "email", f"m{i}") for i in range(30)]
    values = spark.createDataFrame(rows, "company int, kind string, value string")
    pairs = spark.createDataFrame([(a, b) for a in range(12) for b in range(a + 1, 12)] + [(1, 90), (1, 77)], "a int, b int")
    got = {(r.a, r.b) for r in dedup.may_share(pairs, values).collect()}
    assert got == {(a, b) for a in range(12) for b in range(a + 1, 12) if a % 7 == b % 7} | {(1, 90)}


def test_a_vector_goes_to_parts(spark, monkeypatch):
    """On two levels of cells a vector meets others in the parts that its cells are cut from, in blocks as well: the result is that of all cells."""
    monkeypatch.setattr(nearest, "FAN", 8)
    v = clustered(600)
    index = Index(frame(spark, v), rows=20, probes=12)
    parts, asks = index.placed.agg(F.avg(F.size("parts")), F.avg(F.size("asks"))).first()
    assert index.cells.n > 8 and asks > 11 and parts < asks / 1.5
    want = [tuple(r) for r in index.neighbours(5).orderBy("a", "rank").collect()]
    monkeypatch.setattr(nearest, "BLOCK", 31)
    monkeypatch.setattr(nearest, "STEP", 7)
    monkeypatch.setattr(nearest, "COSINES", 40)
    assert [tuple(r) for r in index.neighbours(5).orderBy("a", "rank").collect()] == want
    home = {r.id: r.home for r in index.placed.collect()}
    s, _ = exact_top(v, 5)
    for r in index.placed.filter("id % 50 = 0").collect():
        there = sorted((j for j in home if j != r.id and home[j] in r.asks), key=lambda j: (-s[r.id, j], j))[:5]
        assert [b for a, b, _, _ in want if a == r.id] == there


def test_neighbours_of_those_that_ask(spark):
    """Queries are some of the rows, the vectors all of them; the blocks change nothing."""
    v = clustered(200)
    _, best = exact_top(v, 4)
    for block in (2000, 17):
        got = {(r.a, r["rank"]): r.b for r in dedup.neighbours(frame(spark, v), 4, block, F.col("id") % 20 == 0).collect()}
        assert got == {(i, k + 1): int(b) for i in range(0, 200, 20) for k, b in enumerate(best[i])}


def test_exact_pairs_meet_in_wide_blocks(spark, monkeypatch):
    """A vector is sent once for each block, of which there are some eight while blocks are below WIDE, however small BLOCK is."""
    monkeypatch.setattr(dedup, "BLOCK", 5)
    v = clustered(200)
    s, _ = exact_top(v, 1)
    seen = dedup._products

    def counted(threshold):
        run = seen(threshold)
        return lambda key, group: run(key, group).assign(similarity=float(key[1]))

    df = frame(spark, v)
    assert {(r.a, r.b) for r in dedup.similar_pairs(df, 0.7).collect()} == {(i, j) for i in range(200) for j in range(i + 1, 200) if s[i, j] >= 0.7}
    monkeypatch.setattr(dedup, "_products", counted)
    assert dedup.similar_pairs(df, -2.0).agg(F.max("similarity")).first()[0] == 7


def test_every_pair_of_rows(spark, monkeypatch):
    """Copies give all their pairs, whatever the chunks and parts; equal ids and rows without a block give none, names are scored in any order."""
    rows = [(i, "blue river" if i % 3 == 0 else f"name {i % 7}" if i % 11 else None, "x" if i % 5 else "y") for i in range(120)] + [(3, "other", "x"), (200, "lost", None), (None, "lost", "x")]
    names = spark.createDataFrame(rows, "id long, norm string, block string")
    met = [(x, y) for x in rows for y in rows if x[0] is not None and y[0] is not None and x[0] < y[0] and x[2] and x[2] == y[2]]
    both = lambda a, b: F.concat(F.least(a, b), F.greatest(a, b))
    want = sorted((x[0], y[0], x[1] and y[1] and min(x[1], y[1]) + max(x[1], y[1])) for x, y in met)
    for chunk, part in ((1000, 16_000), (4, 9)):
        monkeypatch.setattr(dedup, "CHUNK", chunk)
        monkeypatch.setattr(dedup, "PART", part)
        out = dedup.every_pair(names, F.col("block"), lambda a, b: F.when(a.isNotNull() & b.isNotNull(), both(a, b)))
        assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


def rows_of(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir).count()


def same_brand(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").groupBy("p_brand").agg((F.count("*") * (F.count("*") - 1) / 2).alias("n")).agg(F.sum("n")).first()[0]


def test_all_parts_of_a_brand_meet_name_levenshtein(spark, sf_dir):
    assert rows_of(spark, sf_dir, "name_levenshtein") == same_brand(spark, sf_dir)


def test_all_parts_of_a_brand_meet_jaccard_tokens(spark, sf_dir):
    assert rows_of(spark, sf_dir, "jaccard_tokens") == same_brand(spark, sf_dir)


def test_all_parts_of_a_brand_meet_rule_score(spark, sf_dir):
    assert rows_of(spark, sf_dir, "rule_score") == same_brand(spark, sf_dir)


def test_all_equal_names_meet(spark, sf_dir):
    named = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(text.normalize_name(F.concat_ws(" ", F.lit("The"), "p_name", "p_type"))).agg((F.count("*") * (F.count("*") - 1) / 2).alias("n"))
    assert rows_of(spark, sf_dir, "exact_norm_pairs") == named.agg(F.sum("n")).first()[0]


def test_every_vector_asks(spark, sf_dir):
    asked = QUERIES["nearest_neighbours"](spark, sf_dir).select(F.col("a").alias("vec_id")).distinct()
    assert asked.count() == spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()


def test_vectors_ask_in_waves(spark, monkeypatch):
    """The result is the same however few ask at a time; counts are a byte or two, and equal as they are, other numbers as directions."""
    counts = np.random.default_rng(3).poisson(1.5, (300, 24)).astype(float)
    counts[7], counts[8], counts[9], counts[10] = counts[6], counts[6] * 2, 300 * np.eye(24)[0], 70_000 * np.eye(24)[1]
    index = Index(frame(spark, counts), rows=15, probes=5, counts=True)
    assert {r.n for r in index.placed.select(F.octet_length("v").alias("n")).distinct().collect()} == {24, 48, 192}
    members = {r.id: r.rep for r in index.members.collect()}
    assert members[7] == 6 and members[8] == 8
    want = sorted(map(tuple, index.neighbours(5).collect()))
    s, _ = exact_top(counts, 5)
    assert all(c == pytest.approx(s[a, b], abs=2e-9) for a, b, c, _ in want)
    monkeypatch.setattr(nearest, "WAVE", 70)
    waves = index.neighbours(5)
    assert sorted(map(tuple, waves.collect())) == want and len({f.rsplit("/", 2)[1] for f in waves.inputFiles()}) == 5
    whole = Index(frame(spark, np.delete(counts, 8, 0)), rows=15, probes=99)
    packed = Index(frame(spark, np.delete(counts, 8, 0)), rows=15, probes=99, counts=True)
    assert sorted(map(tuple, whole.neighbours(5).collect())) == sorted(map(tuple, packed.neighbours(5).collect()))


def test_links_in_waves(spark, monkeypatch):
    words = ["blue", "river", "foods", "quantum", "xylo", "north", "mill"]
    names = spark.createDataFrame([(i, f"{words[i % 7]} {words[i * 3 % 5]} {i % 40}{' Ltd' if i % 3 else ''}") for i in range(120)], "id long, name string")
    names = names.withColumn("norm", text.normalize_name(F.col("name")))
    want = sorted(map(tuple, dedup.linked_pairs(names).collect()))
    monkeypatch.setattr(dedup, "LINKS", 100)
    monkeypatch.setattr(nearest, "WAVE", 50)
    out = dedup.linked_pairs(names)
    assert sorted(map(tuple, out.collect())) == want and len({f.rsplit("/", 2)[1] for f in out.inputFiles()}) > 3
    assert sorted(map(tuple, dedup.linked_pairs(names, exact=True).select("a", "b").collect())) == [(a, b) for a, b, _ in want]


def test_evidence_in_waves(spark, monkeypatch):
    """What pairs share is the same however few meet at a time."""
    contacts = spark.createDataFrame([(c, "phone", str(v), f"N{c % 4}", c) for c in range(60) for v in (c % 7, c % 11 + 20)], "company int, kind string, value string, name string, ord int")
    pairs = stored(spark.createDataFrame([(a, b) for a in range(60) for b in range(a + 1, 60)], "a int, b int"), "pairs")
    want = sorted(map(repr, dedup.evidence(pairs, contacts).collect()))
    monkeypatch.setattr(dedup, "LINKS", 300)
    monkeypatch.setattr(dedup, "MANY", 1)
    out = dedup.shared_contacts(pairs, contacts)
    assert sorted(map(repr, dedup.with_shared(pairs, out).collect())) == want and len({f.rsplit("/", 2)[1] for f in out.inputFiles()}) > 10


def test_scores_in_waves(spark, monkeypatch):
    """Scored pairs are the same however many are scored at a time, and only they are left on disk."""
    companies = spark.createDataFrame([(i, f"Blue River {i % 9} Foods {i % 13}") for i in range(80)], "id int, name string")
    contacts = spark.createDataFrame([(c, "phone", str(c % 9)) for c in range(80)], "company int, kind string, value string")
    want = sorted(map(repr, dedup.scored_pairs(companies, contacts).collect()))
    monkeypatch.setattr(dedup, "LINKS", 200)
    out = dedup.scored_pairs(companies, contacts)
    assert sorted(map(repr, out.collect())) == want and len({f.rsplit("/", 2)[1] for f in out.inputFiles()}) > 3
