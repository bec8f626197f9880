"""High-water marks, published versions, run logs and observations."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mark:
    """How a source is read on: everything, or rows past the greatest value seen of a field (time, id or unix_time)."""

    field: str | None = None
    kind: str = "full"


MARKS = {
    "zhique_behavior": Mark("behavior_time", "time"), "linkflow_contacts": Mark("contact_id", "id"), "linkflow_events": Mark("extra_id", "id"),
    "tianrun_session": Mark("start_time_sec", "unix_time"), "zhique_contact": Mark("etl_time", "time"), "crm_contact": Mark("etl_time", "time"), "marketing_lead": Mark("etl_time", "time"),
    "crm_lead": Mark(), "crm_opportunity_data": Mark(), "crm_opportunity": Mark(), "key_customer": Mark(),
}


def past(rows: DataFrame, mark: Mark, value: Any, look_back: Column | None = None) -> DataFrame:
    """Rows strictly past the mark; all of them on the first run or for full sources. look_back widens the window for
    late rows; loading those again changes nothing, since keys decide."""
    if mark.field is None or value is None:
        return rows
    limit = F.lit(value) if mark.kind != "time" else F.lit(value).cast("timestamp_ntz")
    return rows.filter(F.col(mark.field) > (limit - look_back if look_back is not None else limit))


def advance(batch: DataFrame, mark: Mark) -> DataFrame:
    """The mark after a batch, from the batch itself: rows that arrive meanwhile stay ahead of it."""
    if mark.field is None:
        return batch.agg(F.lit(None).cast("string").alias("mark"))
    return batch.agg(F.max(mark.field).cast("string").alias("mark"))


def observe(tables: dict[str, DataFrame], at: Column) -> DataFrame:
    """(table_name, table_count, at) of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("table_count")).select(F.lit(name).alias("table_name"), "table_count", at.alias("at"))
        out = one if out is None else out.unionByName(one)
    return out


def latest_observations(log: DataFrame) -> DataFrame:
    return log.groupBy("table_name").agg(F.max_by("table_count", "at").alias("table_count"), F.max("at").alias("at"))


#: Of the history of writes.
COUNTS = "version string, table_name string, table_count long, at long"


class Store:
    """Versions of tables under a path and a pointer to the one that readers see. Writers build a version aside; only
    after validation the pointer moves, so readers never meet a half-built table; the version before stays for going back.
    Pointer and log are small text files, written through Spark, so any file system it knows will do."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _write(self, name: str, text: str) -> None:
        """The file is replaced by one rename, so there is always the old or the new one."""
        fs, path = self._files()
        new, old = path(f"{self.path}/.{name}.{uuid.uuid4().hex}"), path(f"{self.path}/{name}")
        out = fs.create(new, True)
        out.write(bytearray(text.encode()))
        out.close()
        sc = self.spark.sparkContext
        rename = sc._jvm.org.apache.hadoop.fs.Options.Rename
        over = sc._gateway.new_array(rename, 1)
        over[0] = rename.OVERWRITE
        sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(old.toUri(), sc._jsc.hadoopConfiguration()).rename(new, old, over)

    def _read(self, name: str) -> str | None:
        fs, path = self._files()
        at = path(f"{self.path}/{name}")
        return "\n".join(r.value for r in self.spark.read.text(f"{self.path}/{name}").collect()) if fs.exists(at) else None

    def state(self) -> dict[str, Any]:
        return json.loads(self._read("state") or '{"current": null, "previous": null, "marks": {}}')

    def publish(self, version: str, tables: dict[str, DataFrame], validate=None, marks: dict[str, Any] | None = None) -> bool:
        """Writes a version and, if it is valid, moves the pointer to it. The writes count their rows for `counts`."""
        for name, df in tables.items():
            self.counted(version, name, df, lambda rows, at=f"{self.path}/{version}/{name}": rows.write.mode("overwrite").parquet(at))
        written = {name: self.spark.read.parquet(f"{self.path}/{version}/{name}") for name in tables}
        if validate is not None and validate(written).filter("NOT valid").count():
            return False
        old = self.state()
        self._write("state", json.dumps({"current": version, "previous": old["current"], "marks": old["marks"] | (marks or {})}))
        return True

    def counted(self, version: str, name: str, rows: DataFrame, write) -> Any:
        """What write(rows) returns, with the number of rows, as they are written, in the history of counts; -1 if it fails."""
        seen = Observation()
        try:
            out = write(rows.observe(seen, F.count(F.lit(1)).alias("n")))
        except Exception:
            self._count(version, name, -1)
            raise
        try:
            n = seen.get.get("n", 0)
        except Py4JJavaError:  # nothing was counted: the plan is known to give no row
            n = 0
        self._count(version, name, n)
        return out

    def _count(self, version: str, name: str, n: int) -> None:
        row = [(version, name, n, time.time_ns() // 1000)]
        self.spark.createDataFrame(row, COUNTS).coalesce(1).write.mode("append").json(f"{self.path}/counts")

    def counts(self) -> DataFrame:
        """(version, table_name, table_count, at): the rows of each write, in microseconds of its end; a table's last is by at."""
        return self.spark.read.schema(COUNTS).json(f"{self.path}/counts")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.state()['current']}/{name}")

    def go_back(self) -> None:
        s = self.state()
        self._write("state", json.dumps(s | {"current": s["previous"], "previous": s["current"]}))

    def log(self, run: str, **what: Any) -> None:
        """Appends a line to the log of runs."""
        rows = [(run, json.dumps(what, default=str, ensure_ascii=False))]
        self.spark.createDataFrame(rows, "run string, details string").coalesce(1).write.mode("append").json(f"{self.path}/log")

    def history(self) -> DataFrame:
        return self.spark.read.schema("run string, details string").json(f"{self.path}/log")


def stamped(batch: DataFrame, batch_id: int) -> DataFrame:
    """The rows of a batch with its id, by which they are counted where they went."""
    return batch.withColumn("sync_batch_id", F.lit(batch_id).cast("long"))


def batch_counts(tables: dict[str, DataFrame], batch_id: int) -> DataFrame:
    """(source_table, n): rows of a batch in all tables by the source they came from."""
    out = None
    for df in tables.values():
        one = df.filter((F.col("sync_batch_id") == batch_id) & F.col("source_table").isNotNull()).select("source_table")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("source_table").agg(F.count("*").alias("n"))


def anything_new(interactions: DataFrame, contacts: DataFrame, scope: DataFrame, customers: DataFrame) -> bool:
    """Whether aggregates have to be built anew: new interactions, contacts, or customers in scope that have no row."""
    if not interactions.isEmpty() or not contacts.isEmpty():
        return True
    there = customers.select(F.col("customer_name").alias("__c"))
    return not scope.join(there, F.col("customer_name") == F.col("__c"), "left_anti").isEmpty()
