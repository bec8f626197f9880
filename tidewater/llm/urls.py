"""URL filters: rules first, then a ratio of two character language models.

URLs that a rule allows or blocks are the labelled examples. For each of the two classes a variable-order Markov
model (orders 1 to ORDER, interpolated by Witten-Bell: a context that was followed by many different characters
trusts shorter contexts more) is counted over 32 symbols: letters, one digit, `/`, `.`, `-`, the start and
anything else. Both models together are one table of 32**4 log-likelihood ratios, whose size no input changes. The
score of a URL is the mean ratio of its characters; the threshold is calibrated on the fifth of the labelled
URLs that the models haven't seen, at the score that best separates the classes.

Cases: a null URL or one without `://` has empty host and path, fits no rule and is judged by the model like any
text; without examples of both classes the threshold is 0, and without any all ratios are 0, so that the verdict
is allow; repeated URLs count each time; an empty table gives an empty result; other columns (html) are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import seeded, written

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
ORDER = 4
BITS = 5
SYMBOLS = string.ascii_lowercase + "0/.-"  # 1 to 30; 0 is anything else
START = 31
#: One URL in HELD of the labelled ones calibrates the threshold.
HELD = 5
#: Scores are told apart to 1 / GRID and clipped to +-CLIP for the calibration.
GRID, CLIP = 200, 20


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def match(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null if none does."""
    rule = verdict = None
    for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return rule, verdict


def symbols(url: Column) -> Column:
    """The numbers of the symbols of a URL's host and path."""
    plain = F.translate(F.lower(url), string.digits, "0" * 10)
    return F.when(plain == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(plain, "", -1), lambda c: F.when(c == "", 0).otherwise(F.call_function("instr", F.lit(SYMBOLS), c))))


def grams(padded: str) -> Column:
    """From the padded symbols, the number of the ORDER-gram that ends at each symbol."""
    code = lambda i: sum((F.shiftleft(F.get(padded, i + k), BITS * (ORDER - 1 - k)) for k in range(ORDER)), F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.size(padded) - ORDER), code)


def ratios(counts: DataFrame) -> DataFrame:
    """counts (code, good, bad) of ORDER-grams to (code, ratio) for every possible one: the log of its last
    symbol's probability in accepted over that in rejected URLs."""
    spark, size = counts.sparkSession, 1 << BITS
    lower = spark.range(1).select(F.lit(0).alias("code"), F.lit(1 / size).alias("p_good"), F.lit(1 / size).alias("p_bad"))
    for k in range(1, ORDER + 1):
        own = counts.groupBy(F.col("code").bitwiseAND(F.lit((1 << BITS * k) - 1)).alias("code")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        context = own.groupBy(F.shiftright("code", BITS).alias("context")).agg(F.sum("good").alias("n_good"), F.count_if(F.col("good") > 0).alias("t_good"), F.sum("bad").alias("n_bad"), F.count_if(F.col("bad") > 0).alias("t_bad"))
        every = spark.range(1 << BITS * k).select(F.col("id").cast("int").alias("code"))
        joined = (
            every.join(own, "code", "left")
            .join(context, F.shiftright("code", BITS) == F.col("context"), "left")
            .join(lower.withColumnRenamed("code", "shorter"), F.col("code").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1)) == F.col("shorter"))
        )
        mix = lambda c: F.when(F.coalesce(F.col(f"n_{c}"), F.lit(0)) == 0, F.col(f"p_{c}")).otherwise((F.coalesce(F.col(c), F.lit(0)) + F.col(f"t_{c}") * F.col(f"p_{c}")) / (F.col(f"n_{c}") + F.col(f"t_{c}"))).alias(f"p_{c}")  # noqa: E731, B023
        lower = joined.select("code", mix("good"), mix("bad"))
    return lower.select("code", (F.log("p_good") - F.log("p_bad")).alias("ratio"))


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict, score and threshold."""
    host, path = parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("__url"), host.alias("host"), path.alias("path"))
    rule, verdict = match(F.col("host"), F.col("path"), rules)
    pad = F.array_repeat(F.lit(START), ORDER - 1)
    rows = rows.withColumn("rule", rule).withColumn("label", verdict).withColumn("held", F.pmod(seeded("urls", F.col("__url")), F.lit(HELD)) == 0)
    rows = rows.withColumn("padded", F.concat(pad, symbols(F.concat("host", "path")), F.array(F.lit(START))))
    rows = written(rows.withColumn("grams", grams("padded")).drop("padded", "__url"), "url-rows")
    one = lambda v: F.sum(F.when(F.col("label") == v, 1).otherwise(0))
    counts = rows.filter("label IS NOT NULL AND NOT held").select("label", F.explode("grams").alias("code")).groupBy("code").agg(one("allow").alias("good"), one("block").alias("bad"))
    # one array of 32**4 numbers, whatever the input
    table = ratios(written(counts, "url-counts")).agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "ratio"))), lambda x: x["ratio"]).alias("r"))
    table = written(table, "url-model")
    total = F.aggregate("grams", F.lit(0.0), lambda a, c: a + F.get(F.col("model"), c))
    scored = rows.withColumn("model", table.scalar()).withColumn("score", total / F.size("grams")).drop("model", "grams")
    scored = written(scored, "url-scores")
    bucket = F.floor(F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), F.col("score"))) * GRID)
    seen = scored.filter("label IS NOT NULL AND held").groupBy(bucket.alias("b")).agg(one("allow").alias("good"), one("block").alias("bad"))
    below, every = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()  # at most 2 * CLIP * GRID rows
    lost = lambda c: F.coalesce(F.sum(c).over(below), F.lit(0)) / F.sum(c).over(every)
    at = seen.withColumn("gain", lost("bad") - lost("good")).agg(F.max_by(F.col("b") / GRID, F.struct("gain", -F.abs("b"), "b"))).first()[0]
    threshold = F.lit(float(at) if at is not None else 0.0)
    final = F.coalesce("label", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", final.alias("verdict"), "score", threshold.alias("threshold"))


def op8_urls(spark, sf_dir: str) -> DataFrame:
    """All pages judged by the rules, or else by the character models."""
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))
