"""Substring search by n-grams against brute force."""

import pytest
from pyspark.sql import functions as F

from tidewater.operators import dedup, substrings
from tidewater.plans import serving

NAMES = ["Acme Foods", "Acme Steel", "acme", "北京腾讯科技", "腾讯", "é😀x", "ab", "a", "", None, "Acme Foods", "x.y*z"] + [f"Unit {i:04d} North" for i in range(300)]
WORDS = ["Acme", "腾讯", "a", "é", "😀x", "ab", "x.y", "Unit", "0042", "29 N", "nowhere", "", None, "Acme Foods and more", "Acme", "%", "North"]


@pytest.mark.parametrize("hot", [100_000, 5])
def test_like_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    words, names = (spark.createDataFrame([(x,) for x in v], f"{n} string") for v, n in ((WORDS, "word"), (NAMES, "name")))
    got = [tuple(r) for r in substrings.containing(words, names).collect()]
    want = {(w, n) for w in WORDS for n in NAMES if w and n is not None and w in n}
    assert len(got) == len(want) and set(got) == want
    first = {r.word: r.name for r in substrings.first_containing(words, names).collect()}
    assert first == {w: min(n for v, n in want if v == w) for w in {w for w, _ in want}}
    assert substrings.containing(words.limit(0), names).count() == 0 == substrings.containing(words, names.limit(0)).count()


def test_no_nested_loop_and_no_limit(spark):
    customers = spark.createDataFrame([(n, f"i{i}") for i, n in enumerate(dict.fromkeys(n for n in NAMES if n))], "customer_name string, industry string")
    names = spark.createDataFrame([(f"{i:04d}",) for i in range(300)] + [("acme",), ("Steel",), ("gone",), ("",), (None,), ("Steel",)], "name string")
    out = serving.enriched(names, customers, ["industry"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = sorted(map(str, ((r.name, r.customer_name) for r in out.collect())))
    want = [(f"{i:04d}", f"Unit {i:04d} North") for i in range(300)] + [("acme", "acme"), ("Steel", "Acme Steel"), ("gone", None), ("", None), (None, None), ("Steel", "Acme Steel")]
    assert got == sorted(map(str, want))


def test_shared_by_parts_of_names(spark):
    contacts = spark.createDataFrame([("Acme Foods", "phone", "1"), ("Acme Steel", "phone", "1"), ("Beta Steel", "phone", "1"), ("Beta Steel", "email", "e"), ("Acme Foods", "email", "e"), ("Acme", "email", ""), ("Beta", "email", None)], "company string, kind string, value string")
    pairs = spark.createDataFrame([("Acme", "Beta"), ("Foods", "Acme S"), ("Acme", "zzz"), ("Acme", "Acme")], "a string, b string")
    got = {(r.a, r.b, r.kind): r.shared for r in dedup.shared_by_parts(contacts, pairs).collect()}
    assert got == {("Acme", "Beta", "phone"): 1, ("Acme", "Beta", "email"): 1, ("Foods", "Acme S", "phone"): 1, ("Acme", "Acme", "phone"): 1, ("Acme", "Acme", "email"): 1}
    assert dedup.shared_by_name(contacts, "Foods", "Beta").agg(F.sum("shared")).first()[0] == 2
