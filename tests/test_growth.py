"""Work that must be dealt over tasks, whatever the input's files."""

from pyspark.sql import functions as F

from tidewater.operators import dedup, merge, substrings
from tidewater.plans import etl
from tidewater.queries import QUERIES
from tidewater.sources.shared import stored


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_vectors_are_hashed_by_all_tasks(spark, sf_dir):
    assert QUERIES["hash_embedding"](spark, sf_dir).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_cached_vectors_meet_names_by_a_shuffle(spark):
    """The cache's rows go by name, then by normalised name; a row without a vector is none."""
    cache = spark.createDataFrame([("Acme", "acme", [1.0]), ("Beta B", "beta", [3.0]), ("Beta A", "beta", [2.0]), ("Cyan", "cyan", None)], "name string, norm string, v array<double>")
    names = spark.createDataFrame([("Acme", "acme"), ("acme!", "acme"), ("Beta", "beta"), ("Beta B", "beta"), ("Cyan", "cyan"), ("New", "new"), (None, None)], "name string, norm string")
    out = dedup.with_cached_vectors(names, stored(cache, "cache"), lambda n: F.array(F.length(n).cast("double")))
    assert "SortMergeJoin [coalesce(__from" in plan_of(out)
    got = {(r["name"], r.cached): r.v for r in out.collect()}
    assert got == {("Acme", True): [1.0], ("acme!", True): [1.0], ("Beta", True): [2.0], ("Beta B", True): [3.0], ("Cyan", False): [4.0], ("New", False): [3.0], (None, False): [None]}


def test_known_pairs_go_without_a_shuffle_of_pairs(spark):
    rows = spark.createDataFrame([(i, f"g{i % 3}") for i in range(30)] + [(40, None), (41, None)], "id long, g string")
    known = spark.createDataFrame([(3, 0), (1, 4), (0, 6), (9, None)], "x long, y long")
    out = merge.unknown_pairs(rows, ["g"], "id", known, "x", "y")
    want = {(i, j) for i in range(30) for j in range(i + 1, 30) if i % 3 == j % 3} - {(0, 3), (1, 4), (0, 6)}
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want
    assert "LeftAnti" not in plan_of(QUERIES["pair_unordered_anti"](spark, "/root/testdata/sf0.001"))


def test_words_ask_long_grams(spark):
    """Numbers of seven digits share every three digits with very many others, but hardly six."""
    numbers = spark.range(3000).selectExpr("lpad(id * 3, 7, '0') AS word")
    names = numbers.selectExpr("concat('N', word) AS name")
    seen = {}
    kept = substrings.stored
    substrings.stored = lambda df, name: seen.setdefault(name, kept(df, name))
    try:
        out = substrings.containing(numbers.unionByName(spark.createDataFrame([("12",)], "word string")), names)
        assert out.filter("word <> '12'").count() == 3000 and out.filter("word = '12'").count() == names.filter("contains(name, '12')").count()
    finally:
        substrings.stored = kept
    met = seen["substring-asks"].filter("word <> '12'").join(seen["substring-postings"], "gram").count()
    assert met < 30 * 3000


def test_contacts_without_a_mobile_are_dealt(spark):
    """Many customers have a visitor of one name and no mobile: their rows do not meet in one task, and no match is lost or doubled."""
    rows = spark.createDataFrame([(f"c{i}", f"V{i % 2}", None) for i in range(400)] + [("c1", "Ann", "1"), ("c2", "Ann", "2"), ("c3", None, None)], "customer_name string, contact_name string, mobile string")
    known = spark.createDataFrame([("V0", None, 7), ("Ann", "1", 8), ("V1", "3", 9)], "k_name string, k_mobile string, n int")
    same = F.col("contact_name") == F.col("k_name")
    out = etl.with_contacts(rows, known, "left", same)
    assert out.count() == rows.count() and {(r.contact_name, r.mobile, r.n) for r in out.collect()} == {("V0", None, 7), ("V1", None, None), ("Ann", "1", 8), ("Ann", "2", None), (None, None, None)}
    assert etl.same_contact(rows, known.selectExpr("k_name AS contact_name", "k_mobile AS mobile"), "left_anti").count() == 202
    assert "__part" in plan_of(out)
    contacts = plan_of(QUERIES["contact_360_full"](spark, "/root/testdata/sf0.001"))
    assert "intent_score" not in contacts and "o_orderkey" not in contacts
