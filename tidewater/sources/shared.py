"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Has Spark remove the shuffle files of a query once it is over.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a new folder on a local master, and an error on a cluster, whose machines share none."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tidewater-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def cleaned_up(spark: SparkSession) -> Iterator[None]:
    """Queries in it leave no shuffle files behind."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, so a lost executor costs no recomputation."""
    at = shared_path(df.sparkSession, name)
    with cleaned_up(df.sparkSession):
        df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out.stored_at = at
    return out


def in_waves(rows: DataFrame, n: int, most: int, key: str, make: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """make(rows) as a stored table, made of about `most` of the n rows after the other (dealt by a hash of their key): on disk are the
    shuffle files of a wave only, whatever n. make has to be the same for all rows of a key together or alone."""
    count, at = max(1, -(-n // most)), shared_path(rows.sparkSession, name)
    for i in range(count):
        part = make(rows if count == 1 else rows.filter(F.pmod(F.xxhash64(F.lit(11), key), F.lit(count)) == i))
        with cleaned_up(rows.sparkSession):
            part.write.parquet(f"{at}/{i}")
    out = rows.sparkSession.read.schema(part.schema).parquet(*[f"{at}/{i}" for i in range(count)])
    out.stored_at = at
    return out


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt over all shuffle partitions, for work that costs much more than its bytes: a file may be a single task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def dropped(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for t in tables:
        path = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
