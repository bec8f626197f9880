"""Loads into buckets: what a batch reads and writes, versions, leases, expiry."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidewater.plans import etl
from tidewater.plans.buckets import BucketStore
from tidewater.plans.sync import Store, latest_observations
from tidewater.sources.roles import as_of

TABLES = ("contact_mapping", "interaction_detail", "customer_360", "contact_360")
VISIT = "id long, behavior_id long, contact_name string, mobile_phone string, behavior_type string, behavior_name string, behavior_time timestamp_ntz"


def visits(spark, *rows):
    return spark.createDataFrame([(i, i, n, m, "点击邮件链接", "x", datetime.datetime(2024, 1, 29)) for i, n, m in rows], VISIT)


@pytest.fixture
def sources(spark):
    n = 40
    return {
        "zhique_contact": spark.createDataFrame([(i, f"Company {i}", f"P{i}", str(i)) for i in range(n)], "id long, related_company string, contact_name string, mobile string"),
        "crm_contact": spark.createDataFrame([(i, f"P{i}", f"Company {i}", str(i)) for i in range(n)] + [(90, "Both", "Company 1", "77"), (91, "Both", "Company 2", "77")], "id long, contact_name string, customer_name string, mobile string"),
        "zhique_behavior": visits(spark, *[(i, f"P{i}", str(i)) for i in range(n)]),
    }


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def recorded(store, monkeypatch):
    """The buckets read of each table, all of them as None."""
    seen, read = {}, BucketStore.read
    monkeypatch.setattr(BucketStore, "read", lambda self, name, buckets=None, version=None: seen.setdefault(name, []).append(buckets) or read(self, name, buckets, version))
    return seen


def test_a_batch_of_one_customer_touches_one_bucket(spark, sources, tmp_path, monkeypatch):
    store = BucketStore(spark, f"file://{tmp_path}/s", 16)
    assert etl.publish_full(store, "1", sources, as_of(), spark)
    before = store.manifest()
    assert all(sum(store.read(n, [b]).count() for b in range(16)) == store.read(n).count() for n in TABLES)
    more = visits(spark, (100, "P7", "7"), (101, "P7", "7"))
    t = sources | {"zhique_behavior": sources["zhique_behavior"].unionByName(more)}
    seen = recorded(store, monkeypatch)
    done = etl.publish_batch(store, "2", {"zhique_behavior": more}, t, as_of(), spark)
    own = store.touched("customer_360", spark.createDataFrame([("Company 7",)], "customer_name string"))
    assert len(own) == 1 and all(done[n] == own for n in TABLES) and len(done["contact_index"]) == 1
    assert all(b == own for n in TABLES for b in seen[n]) and len({*map(tuple, seen["contact_index"])}) == 1  # nothing else is read
    now = store.manifest()
    for n in TABLES:  # the other buckets are the same folders
        changed = {b for b, at in now["tables"][n]["folders"].items() if before["tables"][n]["folders"].get(b) != at}
        assert changed == set(map(str, own))
        opened = {f.split("__bucket=")[1].split("/")[0] for f in store.read(n, own).inputFiles()}
        assert opened == set(map(str, own))
    full = etl.run_full(t, as_of(), spark)
    assert all(rows(store.read(n)) == rows(full[n]) for n in TABLES)
    assert store.read("customer_360").filter("customer_name = 'Company 7'").first().interaction_count_total == 3


def test_a_batch_reaches_customers_that_share_a_contact(spark, sources, tmp_path):
    """A mobile of two customers, a new customer, another spelling: as a full load has them."""
    store = BucketStore(spark, f"file://{tmp_path}/s", 16)
    etl.publish_full(store, "1", sources, as_of(), spark)
    batch = {
        "zhique_behavior": visits(spark, (100, "Both", "77")),
        "zhique_contact": spark.createDataFrame([(50, "New one", "Neo", None)], "id long, related_company string, contact_name string, mobile string"),
            "crm_contact": spark.createDataFrame([(92, "Cy", "COMPANY 3", "33")], "id long, contact_name string, customer_name string, mobile string"),
    }
    t = sources | {n: sources[n].unionByName(df) for n, df in batch.items()}
    etl.publish_batch(store, "2", batch, t, as_of(), spark, {"zhique_behavior": "2024-01-29"})
    full = etl.run_full(t, as_of(), spark)
    assert all(rows(store.read(n)) == rows(full[n]) for n in TABLES)
    assert rows(store.read("names")) == rows(full["customer_360"].select("customer_name"))
    assert rows(store.read("contact_index")) == rows(etl.contact_index(full["contact_mapping"], full["interaction_detail"]))
    both = {r.customer_name: r.interaction_count for r in store.read("contact_360").filter("contact_name = 'Both'").collect()}
    assert both == {"Company 1": 1, "Company 2": 1}
    assert store.state()["marks"] == {"zhique_behavior": "2024-01-29"}
    store.go_back()
    assert store.read("customer_360").filter("customer_name = 'New one'").count() == 0


def test_versions_leases_and_expiry(spark, tmp_path):
    store = BucketStore(spark, f"file://{tmp_path}/s", 4, {"t": ("k",)})
    frame = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    assert store.publish("1", {"t": frame(("a", 1), ("b", 1), (None, 1))})
    lease = store.lease(100)
    held = store.read("t")
    a = store.touched("t", frame(("a", 0)))
    same = store.read("t", a).filter("k <> 'a' OR k IS NULL")
    for i in (2, 3, 4):
        assert store.replace(str(i), {"t": (same.unionByName(frame(("a", i))), a)})
    assert store.expire() == ["2"]  # 4 is current, 3 the one before, 1 is leased
    assert sorted(r.v for r in held.collect()) == [1, 1, 1] and {r.k: r.v for r in store.read("t").collect()} == {"a": 4, "b": 1, None: 1}
    store.release(lease)
    assert store.expire() == ["1"] and {r.k: r.v for r in store.read("t").collect()} == {"a": 4, "b": 1, None: 1}
    store.lease(1)
    assert store.replace("5", {"t": (frame(), a)}) and store.replace("6", {"t": (frame(), [])})
    import time

    assert store.expire(now=time.time() + 5) == ["3", "4"] and store._named("lease-") == []
    assert {r.k for r in store.read("t").collect()} == {r.k for r in held.limit(0).collect()} | {k for k in ("b", None) if store.touched("t", frame((k, 0))) != a}
    with pytest.raises(ValueError):
        store.replace("7", {"t": (frame(("a", 9)), [b for b in range(4) if b not in a])})
    bad = lambda tables: spark.range(1).select(F.lit("t").alias("table_name"), F.lit(False).alias("valid"))
    assert not store.publish("8", {"t": frame()}, bad) and store.state()["current"] == "6"
    assert BucketStore(spark, f"file://{tmp_path}/n", 4, {"t": ("k",)}).manifest() == {"tables": {}}


def test_counts_come_from_the_writes(spark, tmp_path):
    """No second pass over the rows; a failed write is -1; the history stays."""
    passes = spark.sparkContext.accumulator(0)

    def seen(parts):
        for part in parts:
            passes.add(part.num_rows)
            yield part

    rows = spark.range(30).selectExpr("id", "CAST(id AS STRING) AS k").repartition(3).mapInArrow(seen, "id long, k string")
    for i, store in enumerate((Store(spark, f"file://{tmp_path}/a"), BucketStore(spark, f"file://{tmp_path}/b", 4, {"t": ("k",)}))):
        assert store.publish("1", {"t": rows}) and passes.value == 30 * (i + 1)
        bad = rows.select("id", F.when(F.col("id") == 7, F.raise_error(F.lit("boom"))).otherwise(F.col("k")).alias("k")).limit(29)
        with pytest.raises(Exception, match="boom"):
            store.publish("2", {"t": bad.orderBy("id")})
        passes.add(30 * (i + 1) - passes.value)
        assert store.publish("3", {"t": spark.createDataFrame([], "id long, k string")}) and store.state()["current"] == "3"
        assert [(r.version, r.table_name, r.table_count) for r in store.counts().orderBy("at").collect()] == [("1", "t", 30), ("2", "t", -1), ("3", "t", 0)]
        assert latest_observations(store.counts()).first().table_count == 0
