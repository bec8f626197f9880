"""Published tables in buckets, of which a version lists the folders.

A table's rows lie in BUCKETS folders by a hash of its key. A version is a manifest: for each table the folders of each bucket and the
schema. A load of a batch writes folders for the buckets that it touches and a manifest that names the old folders for the
others, so its cost is that of those buckets, and nothing is listed or copied. The pointer of Store moves after validation, so
readers see one version or the other; a reader that holds a lease keeps its version's folders from `expire`.

Cases: rows whose key is null share a bucket; a bucket without rows has no folder; a hot key's bucket is written in as many
files as its size asks for (Spark rebalances it), still in one folder; an empty table keeps its schema.
"""

from __future__ import annotations

import json
import time
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .sync import Store

BUCKETS = 64
#: By which columns a table's rows are dealt; several stand for their first that is not null.
KEYS: dict[str, tuple[str, ...]] = dict.fromkeys(("contact_mapping", "interaction_detail", "customer_360", "contact_360", "names"), ("customer_name",)) | {"contact_index": ("mobile", "contact_name")}


class BucketStore(Store):
    """A Store whose versions share the folders of buckets that did not change."""

    def __init__(self, spark, path: str, buckets: int = BUCKETS, keys: dict[str, tuple[str, ...]] = KEYS):
        super().__init__(spark, path)
        self.buckets, self.keys = buckets, keys

    def bucket(self, table: str) -> Column:
        """The bucket of a row."""
        return F.pmod(F.xxhash64(F.coalesce(*[F.col(k).cast("string") for k in self.keys[table]])), F.lit(self.buckets)).cast("int")

    def touched(self, table: str, keys: DataFrame) -> list[int]:
        """The buckets of a table in which rows with the keys' columns lie; at most as many as there are."""
        return sorted(r.b for r in keys.select(self.bucket(table).alias("b")).distinct().collect())

    def manifest(self, version: str | None = None) -> dict[str, Any]:
        version = version or self.state()["current"]
        return json.loads(self._read(f"manifest-{version}") or '{"tables": {}}') if version else {"tables": {}}

    def read(self, name: str, buckets: list[int] | None = None, version: str | None = None) -> DataFrame:
        """A table of a version (the current one), or the rows of some of its buckets: other folders are neither listed nor read."""
        table = self.manifest(version)["tables"][name]
        schema = StructType.fromJson(table["schema"])
        wanted = None if buckets is None else set(map(str, buckets))
        folders = [f"{self.path}/{at}" for b, at in table["folders"].items() if wanted is None or b in wanted]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _add(self, name: str, rows: DataFrame) -> dict[str, str]:
        """Writes rows in folders of their own and returns the folder of each bucket."""
        at = f"data/{name}/{uuid.uuid4().hex}"
        dealt = rows.withColumn("__bucket", self.bucket(name)).hint("rebalance", "__bucket")
        dealt.write.partitionBy("__bucket").parquet(f"{self.path}/{at}")
        fs, path = self._files()
        names = [f.getPath().getName() for f in fs.listStatus(path(f"{self.path}/{at}"))]
        return {n.removeprefix("__bucket="): f"{at}/{n}" for n in names if n.startswith("__bucket=")}

    def publish(self, version: str, tables: dict[str, DataFrame], validate=None, marks: dict[str, Any] | None = None) -> bool:
        """Writes all buckets of tables as a version and, if it is valid, moves the pointer to it."""
        new = {n: {"schema": json.loads(df.schema.json()), "folders": self.counted(version, n, df, lambda rows, n=n: self._add(n, rows))} for n, df in tables.items()}
        return self._move(version, {"tables": new}, validate, marks)

    def replace(self, version: str, changes: dict[str, tuple[DataFrame, list[int]]], validate=None, marks: dict[str, Any] | None = None) -> bool:
        """A version in which the rows of some buckets are new: changes has for a table all rows of these buckets, and the buckets."""
        tables = self.manifest()["tables"]
        for name, (rows, buckets) in changes.items():
            gone, new = set(map(str, buckets)), self.counted(version, name, rows, lambda r, n=name: self._add(n, r))
            if not new.keys() <= gone:
                raise ValueError(f"rows of {name} in buckets {sorted(new.keys() - gone)}, which they do not replace")
            tables[name]["folders"] = {b: at for b, at in tables[name]["folders"].items() if b not in gone} | new
        return self._move(version, {"tables": tables}, validate, marks)

    def _move(self, version: str, manifest: dict[str, Any], validate, marks: dict[str, Any] | None) -> bool:
        self._write(f"manifest-{version}", json.dumps(manifest))
        if validate is not None and validate({n: self.read(n, version=version) for n in manifest["tables"]}).filter("NOT valid").count():
            return False
        old = self.state()
        self._write("state", json.dumps({"current": version, "previous": old["current"], "marks": old["marks"] | (marks or {})}))
        return True

    def lease(self, seconds: float = 3600, version: str | None = None) -> str:
        """Keeps a version (the current one) for some time; the name to release it by."""
        name = f"lease-{uuid.uuid4().hex}"
        self._write(name, json.dumps({"version": version or self.state()["current"], "until": time.time() + seconds}))
        return name

    def release(self, lease: str) -> None:
        fs, path = self._files()
        fs.delete(path(f"{self.path}/{lease}"), False)

    def _named(self, prefix: str) -> list[str]:
        fs, path = self._files()
        return [n.removeprefix(prefix) for f in fs.listStatus(path(self.path)) if (n := f.getPath().getName()).startswith(prefix)]

    def expire(self, now: float | None = None) -> list[str]:
        """Drops versions that are neither the current nor the previous one nor leased, and folders that no version names; the
        versions dropped. For the writer alone: folders of a version that is being written belong to none yet."""
        fs, path = self._files()
        held = {self.state()["current"], self.state()["previous"]}
        for name in self._named("lease-"):
            lease = json.loads(self._read(f"lease-{name}"))
            if lease["until"] > (time.time() if now is None else now):
                held.add(lease["version"])
            else:
                self.release(f"lease-{name}")
        gone = sorted(set(self._named("manifest-")) - held)
        for v in gone:
            fs.delete(path(f"{self.path}/manifest-{v}"), False)
        used = {at for v in self._named("manifest-") for t in self.manifest(v)["tables"].values() for at in t["folders"].values()}
        for name in self.keys:
            if not fs.exists(path(f"{self.path}/data/{name}")):
                continue
            for load in fs.listStatus(path(f"{self.path}/data/{name}")):
                at = f"data/{name}/{load.getPath().getName()}"
                for f in fs.listStatus(load.getPath()):
                    if f.isDirectory() and f"{at}/{f.getPath().getName()}" not in used:
                        fs.delete(f.getPath(), True)
                if not any(f.isDirectory() for f in fs.listStatus(load.getPath())):
                    fs.delete(load.getPath(), True)
        return gone
