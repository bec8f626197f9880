"""Substring search of many words in many names by n-gram postings.

Every name posts its distinct n-grams, but only those that some word has. A word's n is the largest of SIZES that it is long enough
for: with three characters for all, digits would make a few thousand n-grams whose postings grow with the names. A word asks the postings of its rarest n-gram, and the names there are verified. So a word meets the names that share
its rarest n-gram instead of all names, and both sides meet by hash joins. Where even that n-gram is in very many names
(more than HOT), its postings are dealt over SALTS parts, each of which the few words that ask it see.

Cases: texts are compared exactly, as bytes; null and empty words are in no name, null names have no words; repeated words and names
count once; a word with an n-gram that no name has costs nothing; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored
from .merge import latest

SIZES = (1, 2, 3, 6, 12)
HOT, SALTS = 100_000, 64


def grams(c: Column, n: int) -> Column:
    """The distinct n-grams of a text."""
    count = F.length(c) - n + 1
    return F.when(count > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), count), lambda i: F.substring(c, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def containing(words: DataFrame, names: DataFrame, word: str = "word", name: str = "name") -> DataFrame:
    """(word, name): the names that contain each word."""
    asked = words.select(F.col(word).alias("word")).filter(F.col("word") != "").distinct()
    asked = stored(asked.withColumn("n", F.greatest(*[F.when(F.length("word") >= n, n) for n in SIZES])), "substring-words")
    sizes = sorted(r.n for r in asked.select("n").distinct().collect())  # at most as many as SIZES
    pieces = F.array().cast("array<string>")
    for n in sizes:
        pieces = F.when(F.col("n") == n, grams(F.col("word"), n)).otherwise(pieces)
    of_words = stored(asked.select("word", F.explode(pieces).alias("gram")), "substring-grams")
    every = F.array_distinct(F.flatten(F.array(*[grams(F.col("name"), n) for n in sizes]))) if sizes else F.array().cast("array<string>")
    listed = names.select(F.col(name).alias("name")).filter(F.col("name").isNotNull()).distinct().select("name", F.explode(every).alias("gram"))
    known = of_words.select(F.col("gram").alias("__gram")).distinct()
    postings = stored(listed.join(known, F.col("gram") == F.col("__gram"), "left_semi"), "substring-postings")
    counts = postings.groupBy(F.col("gram").alias("__gram")).agg(F.count("*").alias("there"))
    # a word all of whose n-grams are there asks the rarest
    rated = of_words.join(counts, F.col("gram") == F.col("__gram"), "left")
    rarest = F.min(F.struct("there", "gram")).alias("rarest")
    asks = rated.groupBy("word").agg(rarest, F.count_if(F.col("there").isNull()).alias("missing")).filter("missing = 0")
    asks = stored(asks.select("word", F.col("rarest.gram").alias("gram"), (F.col("rarest.there") > HOT).alias("hot")), "substring-asks")
    salt = F.pmod(F.xxhash64("name"), F.lit(SALTS)).cast("int")
    cold = asks.filter("NOT hot").select("word", F.col("gram").alias("__gram"))
    found = postings.join(cold, F.col("gram") == F.col("__gram")).filter(F.col("name").contains(F.col("word"))).select("word", "name")
    hot = asks.filter("hot").select("word", F.col("gram").alias("__gram"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    if hot.isEmpty():
        return found
    met = postings.withColumn("salt", salt).join(hot, (F.col("gram") == F.col("__gram")) & (F.col("salt") == F.col("__salt")))
    return found.unionByName(met.filter(F.col("name").contains(F.col("word"))).select("word", "name"))


def first_containing(words: DataFrame, names: DataFrame, word: str = "word", name: str = "name") -> DataFrame:
    """(word, name): of each word that some name contains the first such name."""
    return latest(containing(words, names, word, name), ["word"], [F.col("name")])
