"""The last row of each key from a stream, published as versions of a bucketed table.

State holds for each key the time and tie of the newest row that has been passed on, for as long as ttl; older and
equal rows, late ones and repeats among them, end there. What passes is merged with the published rows of its buckets by the same
order, and the number of the batch goes into the version's marks. So a batch that is delivered again, before or after its
version became current, changes nothing, and neither do repeated files, even when their keys' state has expired.

Cases: rows without a key are one key; a null time is before all times; of equal times the greatest tie counts, which
must tell different rows apart; an empty batch publishes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.merge import latest
from ..plans.buckets import BucketStore
from ..sources.shared import stored

NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
#: Before all times.
NEVER = -(1 << 63)
DAY = 24 * 3600 * 1000


def _newest(time: str, tie: str, ttl: int):
    """Passes on a key's newest row, if it is newer than all before."""

    def run(key: Any, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best, row = (tuple(state.get) if state.exists else None), None
        for part in parts:
            at = part[time].astype("datetime64[us]")
            order = pd.DataFrame({"at": at.astype("int64").where(at.notna(), NEVER), "tie": part[tie].map(order_of)}).sort_values(["at", "tie"])
            if len(order):
                now = (int(order["at"].iloc[-1]), order["tie"].iloc[-1])
                if best is None or now > best:
                    best, row = now, part.loc[[order.index[-1]]]
        state.update(best)
        state.setTimeoutDuration(ttl)
        if row is not None:
            yield row

    return run


def order_of(tie: Any) -> str:
    """A text that sorts as the tie does: whole numbers by value, texts by characters."""
    if isinstance(tie, str):
        return tie
    return f"{int(tie) + (1 << 63):020d}" if pd.notna(tie) else ""


def newest(stream: DataFrame, key: list[str], time: str, tie: str, ttl: int = 30 * DAY) -> DataFrame:
    """Of each key of a stream the rows that are newer than all before, by time and tie (a whole number or a text)."""
    return stream.groupBy(*key).applyInPandasWithState(_newest(time, tie, ttl), stream.schema, "at long, tie string", "update", GroupStateTimeout.ProcessingTimeTimeout)


def merged(store: BucketStore, table: str, batch: DataFrame, mark: str, number: int, key: list[str], time: str, tie: str) -> bool:
    """A version of table with the rows of a batch, if they are the last of their keys; False if the batch has been published."""
    if number <= store.state()["marks"].get(mark, -1):
        return False
    rows = stored(batch, "stream-batch")
    touched = store.touched(table, rows)
    known = table in store.manifest()["tables"]
    if not touched and known:
        return False
    order = [F.col(time).desc_nulls_last(), F.col(tie).desc_nulls_last()]
    version, marks = f"{number}-{uuid.uuid4().hex[:8]}", {mark: number}
    if not known:
        return store.publish(version, {table: latest(rows, key, order)}, marks=marks)
    last = stored(latest(store.read(table, touched).unionByName(rows), key, order), "stream-last")
    return store.replace(version, {table: (last, touched)}, marks=marks)


def publish_latest(stream: DataFrame, store: BucketStore, table: str, key: list[str], time: str, tie: str, checkpoint: str, ttl: int = 30 * DAY) -> None:
    """Publishes what is new in a stream since the last run of this checkpoint."""
    spark = stream.sparkSession

    def mark() -> str:
        """The stream by the id in its checkpoint: numbers of batches are its own."""
        text = "".join(r.value for r in spark.read.text(f"{checkpoint}/metadata").collect())
        return f"{table}:{json.loads(text)['id']}"

    def publish(batch: DataFrame, number: int) -> None:
        merged(store, table, batch, mark(), number, key, time, tie)

    before = spark.conf.get(NO_DATA, "true")
    spark.conf.set(NO_DATA, "false")  # else state with a timeout asks for one more batch for ever
    try:
        write = newest(stream, key, time, tie, ttl).writeStream.outputMode("update").foreachBatch(publish)
        write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(NO_DATA, before)
