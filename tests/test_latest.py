"""Streaming last-wins: repeats, late rows, batches delivered again."""

import datetime

from tidewater.plans.buckets import BucketStore
from tidewater.streaming import latest

SCHEMA = "k string, v int, at timestamp_ntz, tie long"


def at(hour, minute=0):
    return datetime.datetime(2024, 1, 30, hour, minute)


def test_replays_and_late_rows_change_nothing(spark, tmp_path):
    src, mark = (f"file://{tmp_path}/{n}" for n in ("in", "mark"))
    store = BucketStore(spark, f"file://{tmp_path}/store", 4, {"t": ("k",)})
    shown = lambda: {(r.k, r.v) for r in store.read("t").collect()}

    def run(*rows):
        spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(src)
        latest.publish_latest(spark.readStream.schema(SCHEMA).parquet(src), store, "t", ["k"], "at", "tie", mark)

    first = (("a", 1, at(9), 1), ("a", 2, at(10), 1), ("b", 1, at(9), 1), (None, 5, at(9), 1), ("c", None, None, 1))
    run(*first)
    assert shown() == {("a", 2), ("b", 1), (None, 5), ("c", None)}
    version = store.state()["current"]
    run(*first)  # the same rows again
    run(("a", 9, at(9, 30), 7), ("c", 9, None, 0))  # late ones
    assert shown() == {("a", 2), ("b", 1), (None, 5), ("c", None)} and store.state()["current"] == version
    folders = store.manifest()["tables"]["t"]["folders"]
    run(("a", 3, at(10), 2), ("c", 4, at(1), 1))  # a tie, and the first with a time
    assert shown() == {("a", 3), ("b", 1), (None, 5), ("c", 4)}
    touched = set(map(str, store.touched("t", spark.createDataFrame([("a",), ("c",)], "k string"))))
    now = store.manifest()["tables"]["t"]["folders"]
    assert {b for b in now if now[b] != folders.get(b)} <= touched


def test_a_batch_delivered_again(spark, tmp_path):
    """By its number, and if the mark is lost by the order of its rows."""
    store = BucketStore(spark, f"file://{tmp_path}/store", 4, {"t": ("k",)})
    batch = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    one, two = batch(("a", 1, at(9), 1)), batch(("a", 2, at(10), 1), ("b", 1, at(9), 1))
    args = (["k"], "at", "tie")
    assert latest.merged(store, "t", one, "m", 0, *args) and latest.merged(store, "t", two, "m", 1, *args)
    assert not latest.merged(store, "t", one, "m", 0, *args) and not latest.merged(store, "t", two, "m", 1, *args)
    before = sorted(map(str, store.read("t").collect()))
    assert latest.merged(store, "t", one, "other", 0, *args) and sorted(map(str, store.read("t").collect())) == before
    assert not latest.merged(store, "t", one.limit(0), "m", 2, *args)


def test_orders_of_ties():
    values = [-5, 0, 3, 10, 1 << 40]
    assert sorted(values, key=latest.order_of) == values and latest.order_of(None) == "" and latest.order_of("x") == "x"
