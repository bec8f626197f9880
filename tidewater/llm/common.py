"""What the training-data operators share: word rules, written tables (of the sources package), checked joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import dropped, shared_path
from ..sources.shared import stored as written

__all__ = ["BROADCAST_ROWS", "SPACE", "WORD", "dropped", "exact", "join_hot", "join_small", "n_words", "seeded", "shared_path", "text_of", "written"]

#: White space is these six characters and nothing else; words are runs of anything else.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

#: A table joined by broadcast has at most this many rows; with more rows the join salts instead.
BROADCAST_ROWS = 50_000
SALTS = 64
#: A key is hot if it has more than HOT_ROWS rows and more than one in HOT_KEYS of all: there are at most HOT_KEYS such.
HOT_ROWS, HOT_KEYS = 100_000, 10_000


def exact(name: str) -> Column:
    """The column of just this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(col: str | Column) -> Column:
    """Null texts count as empty ones."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def seeded(seed: str | int, *cols: Column) -> Column:
    """60 bits that only the seed and the values decide, as every SQL engine with MD5 computes them."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 15), 16, 10).cast("long")


def join_small(big: DataFrame, small: DataFrame, on: Column, salt: Column, how: str = "inner") -> DataFrame:
    """big joined to a written table with one row a key. Few rows: broadcast, after a count. More: the small
    side is repeated once per salt and hot keys of the big side spread over the salts.

    on may use null-safe equality; salt is any expression of big whose values vary within a key."""
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), on, how)
    left = big.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    right = small.withColumn("__salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, on & (F.col("__salt") == F.col("__salt2")), how).drop("__salt", "__salt2")


def join_hot(big: DataFrame, small: DataFrame, on: Column, rows: str, total: int) -> DataFrame:
    """big, of total rows, inner joined to a written table with one row a key and the key's rows of big in the column
    rows. Hot keys are broadcast, the others meet by a shuffle, so no task has more than the rows of a cold key."""
    limit = max(HOT_ROWS, total // HOT_KEYS)
    hot = small.filter(F.col(rows) > limit)
    if hot.isEmpty():
        return big.join(small, on)
    cold = big.join(F.broadcast(hot), on, "left_anti").join(small.filter(F.col(rows) <= limit), on)
    return big.join(F.broadcast(hot), on).unionByName(cold)
