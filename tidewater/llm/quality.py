"""Quality rules with thresholds that adapt to each language and source.

Signals are counts in a document (symbols, repeated lines, words in repeated windows, characters of words) over its
words or lines. For each (language, source), each language and the whole corpus a mergeable quantile sketch holds
the rates, rounded down to SIGNIFICANT bits: a group-by with partial sums builds it, adding counts merges it, any
quantile is off by less than 1 part in 64, and a rerun gives the same sketch whatever the order of merging.

The rate that a group allows comes from its sketch alone: of symbols, lines and repeats the ninth decile, but where that
is more than SKEWED times the median (a group in which junk is common), no more than the language allows, and of a language
in the same way no more than the corpus; of characters a word, REACH times the way from the median to the outer
deciles beyond it, the longer way counting at most double the shorter. A document goes if a count of it is so far beyond
that rate that chance would bring it there in about one of exp(EVIDENCE / 2) documents (Bernstein's bound, with signals that
come in bursts counted by the burst). So a few symbols in a clean group are no evidence, however clean it is, and
no fixed share of a group goes. A group of fewer than MIN_GROUP documents uses the sketch of its language, or of the corpus.

Cases: a null text has no words and fails the base rules; null languages and sources are groups of their own;
repeated rows and ties count and are judged alike; an empty table gives an empty result; other columns are
carried untouched by `judged`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, WORD, exact, join_small, text_of, written

MIN_GROUP = 200
SIGNIFICANT = 7
#: Rates are per so many words or lines.
SCALE = 100_000
SKEWED, REACH, EVIDENCE = 4, 4, 18
#: signal: (count, of what, how many of them come together).
SIGNALS = {
    "symbols": ("n_symbols", "n_words", 3),
    "lines": ("n_dup_lines", "n_lines", 1),
    "repeats": ("n_repeat_words", "n_words", 6),
    "length": ("word_chars", "n_words", 2),
}
BOUNDS = ("symbols_high", "lines_high", "repeats_high", "length_high", "length_low")
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


def repeat_words(words: str) -> tuple[Column, Column]:
    """For a column with the words of a text: hashes of its 3-word windows, and from a column `windows` of them
    the number of words in windows that occur twice or more."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    windows = F.when(F.size(words) >= 3, hashes).otherwise(F.array().cast("array<bigint>"))
    # let s be the sorted (hash, place) pairs: repeated windows have an equal neighbour there
    pairs = F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    same = lambda s, e, k: F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))
    repeated = lambda s: F.transform(F.filter(s, lambda e, k: same(s, e, k - 1) | same(s, e, k + 1)), lambda e: e["i"])
    places = F.sort_array(F.get(F.transform(F.array(pairs), repeated), F.lit(0)))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"))
    covered = F.aggregate(places, start, step, lambda a: a["n"])
    return windows, F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0).cast("long")).otherwise(covered)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words (long) and base_failed.
    Columns of docs must not have these names; `judged` sees to that."""
    text = text_of(text_col)
    windows, covered = repeat_words("words")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    without = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    out = (
        docs.withColumn("words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
        .withColumn("lines", lines)
        .withColumn("windows", windows)
        .withColumn("n_words", F.size("words").cast("long"))
        .withColumn("word_chars", F.length(F.translate(text, BLANKS, "")).cast("long"))
        .withColumn("n_symbols", without(SYMBOLS).cast("long"))
        .withColumn("n_lines", F.size("lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
        .withColumn("n_repeat_words", covered)
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("words", "lines", "windows")


def signal(name: str) -> str:
    """The rate of a document."""
    count, of, _ = SIGNALS[name]
    return f"({SCALE} * {count}) DIV greatest({of}, 1)"


def beyond(bound: str) -> str:
    """Whether a document's count is far beyond a bound, in SQL that Spark and DuckDB read alike."""
    name, side = bound.split("_")
    count, of, burst = SIGNALS[name]
    allowed = f"(CAST({bound} AS DOUBLE) * {of})"
    over = f"(CAST({count} AS DOUBLE) * {SCALE} - {allowed})" if side == "high" else f"({allowed} - CAST({count} AS DOUBLE) * {SCALE})"
    # the chance of falling short has the thinner tail
    room = f"({allowed} + {over} / 3)" if side == "high" else allowed
    return f"({over} > 0 AND {over} * {over} > {EVIDENCE * burst * SCALE} * {room})"


def spread(name: str, longer: str, shorter: str) -> str:
    return f"{REACH} * least({longer.format(name)}, 2 * ({shorter.format(name)}))"


UP, DOWN = "{0}_9 - {0}_5", "{0}_5 - {0}_1"
#: The bounds of a sketch by its deciles; of counts, to be held against the level above.
OWN = {
    "length_high": f"length_5 + {spread('length', UP, DOWN)}",
    "length_low": f"length_5 - {spread('length', DOWN, UP)}",
}


def rounded(v: str) -> Column:
    """The column v down to its SIGNIFICANT leading bits."""
    spare = f"greatest(0, length(bin({v})) - {SIGNIFICANT})"
    return F.expr(f"CAST(shiftleft(shiftright({v}, {spare}), {spare}) AS BIGINT)")


def sketches(rows: DataFrame) -> DataFrame:
    """(level, lang, source, signal, value, n): level 0 for each language and source, 1 for each language, 2 for all."""
    pairs = F.array(*[F.struct(F.lit(s).alias("signal"), F.expr(signal(s)).alias("__v")) for s in SIGNALS])
    values = rows.filter("NOT base_failed").select("lang", "source", F.explode(pairs).alias("p")).select("lang", "source", "p.signal", "p.__v")
    own = values.groupBy("lang", "source", "signal", rounded("__v").alias("value")).agg(F.count("*").alias("n"))
    level = F.explode(F.array(*map(F.lit, range(3))))
    return (
        own.withColumn("level", level)
        .groupBy("level", F.when(F.col("level") < 2, F.col("lang")).alias("lang"), F.when(F.col("level") < 1, F.col("source")).alias("source"), "signal", "value")
        .agg(F.sum("n").alias("n"))
    )


def fences(rows: DataFrame) -> DataFrame:
    """(__lang, __source, level, <bounds>): for each group of rows the rates that hold there.
    A sketch has a bounded number of values, so ordering one is a small task."""
    sketch = written(sketches(rows), "quality-sketches")
    keys = ("level", "lang", "source")
    w = Window.partitionBy(*keys, "signal")
    running = F.sum("n").over(w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    run = sketch.withColumn("run", running).withColumn("all", F.sum("n").over(w))
    decile = lambda s, k: F.min(F.when((F.col("signal") == s) & (10 * F.col("run") >= k * F.col("all")), F.col("value"))).alias(f"{s}_{k}")
    deciles = run.groupBy(*keys).agg(F.max("all").alias("n"), *[decile(s, k) for s in SIGNALS for k in (1, 5, 9)])
    by = written(deciles.withColumns({b: F.expr(OWN.get(b, b.replace("_high", "_9"))) for b in BOUNDS}), "quality-deciles")
    counts = [b for b in BOUNDS if b not in OWN]

    def held(b: str, above: Column) -> Column:
        return F.least(F.col(b), F.greatest(SKEWED * F.col(b.replace("_high", "_5")), above))

    whole = by.filter("level = 2").first()  # one row: the corpus
    of_all = lambda b: F.lit(whole[b] if whole else None).cast("long")
    languages = by.filter("level = 1").withColumns({b: held(b, of_all(b)) for b in counts})
    up = languages.select(F.col("lang").alias("lang1"), F.col("n").alias("n1"), *[F.col(b).alias(f"{b}1") for b in BOUNDS])
    joined = by.filter("level = 0").join(up, F.col("lang").eqNullSafe(F.col("lang1"))).withColumns({b: held(b, F.col(f"{b}1")) for b in counts})
    level = F.when(F.col("n") >= MIN_GROUP, 0).when(F.col("n1") >= MIN_GROUP, 1).otherwise(2)
    pick = lambda b: F.when(level == 0, F.col(b)).when(level == 1, F.col(f"{b}1")).otherwise(of_all(b)).alias(b)
    return joined.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), level.alias("level"), *map(pick, BOUNDS))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: list[str] | None = None, prefix: str = "") -> DataFrame:
    """One row a document: doc_id, the measures, base_failed, kept and level, and the columns of carry after prefix."""
    carried = [exact(c).alias(f"__in_{c}") for c in carry or []]
    texts = [exact(c).cast("string").alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]
    named = docs.select(exact(id_col).alias("doc_id"), *texts, exact(text_col).alias("__text"), *carried)
    rows = written(measured(named.select("doc_id", "lang", "source", "__text"), "__text").drop("__text"), "quality-rows")
    bounds = written(fences(rows), "quality-fences")
    if carry:  # a second pass over the documents instead of a copy of them; each measure is made once, for one struct
        measures = F.explode(F.array(F.struct(*MEASURES, "n_lines", "base_failed"))).alias("__m")
        rows = measured(named, "__text").select("doc_id", "lang", "source", *[exact(f"__in_{c}") for c in carry], measures)
        rows = rows.select("*", "__m.*").drop("__m")
    same = F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source"))
    joined = join_small(rows, bounds, same, F.xxhash64("doc_id"), "left")
    far = F.coalesce(F.expr(" OR ".join(map(beyond, BOUNDS))), F.lit(False))
    out = joined.withColumn("kept", ~F.col("base_failed") & ~far)
    return out.select("doc_id", *MEASURES, "base_failed", "kept", "level", *[exact(f"__in_{c}").alias(f"{prefix}{c}") for c in carry or []])


def filtered(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns."""
    return judged(docs, carry=docs.columns, prefix="__keep_").filter("kept").select(*[exact(f"__keep_{c}").alias(c) for c in docs.columns])


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """All documents judged by the base rules and the adaptive fences."""
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("level")


def _oracle() -> str:
    spare = f"greatest(0, length(bin(v)) - {SIGNIFICANT})"
    rate = lambda s: signal(s).replace("DIV", "//")
    values = " UNION ALL ".join(f"SELECT lang, source, '{s}' AS signal, ({rate(s)})::BIGINT AS v FROM f WHERE NOT base_failed" for s in SIGNALS)
    deciles = ", ".join(f"min(CASE WHEN signal = '{s}' AND 10 * run >= {k} * total THEN value END) AS {s}_{k}" for s in SIGNALS for k in (1, 5, 9))
    own = ", ".join(f"{OWN.get(b, b.replace('_high', '_9'))} AS {b}" for b in BOUNDS)
    # what a level allows, held against the one above
    held = lambda b, of, above: f"{of}.{b}" if b in OWN else f"least({of}.{b}, greatest({SKEWED} * {of}.{b.replace('_high', '_5')}, {above}))"
    language = {b: held(b, "b", f"c.{b}") for b in BOUNDS}
    pick = ", ".join(
        f"CASE WHEN a.n >= {MIN_GROUP} THEN {held(b, 'a', language[b])} WHEN b.n >= {MIN_GROUP} THEN {language[b]} ELSE c.{b} END AS {b}"
        for b in BOUNDS
    )
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, lang, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
win AS (SELECT uid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT uid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT uid, i FROM (SELECT uid, i, count(*) OVER (PARTITION BY uid, g) AS k FROM win) WHERE k > 1),
cov AS (SELECT uid, count(DISTINCT i + o) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS o) GROUP BY uid),
m AS (SELECT d.uid, doc_id, lang, source, len(w)::BIGINT AS n_words, length(translate(text, {blank}, ''))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    len(lines)::BIGINT AS n_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN cov USING (uid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
v AS ({values}),
x AS (SELECT *, ((v >> {spare}) << {spare}) AS value FROM v),
lv AS (SELECT 0 AS level, lang, source, signal, value FROM x UNION ALL SELECT 1, lang, NULL, signal, value FROM x UNION ALL SELECT 2, NULL, NULL, signal, value FROM x),
run AS (SELECT level, lang, source, signal, value, row_number() OVER (PARTITION BY level, lang, source, signal ORDER BY value) AS run,
    count(*) OVER (PARTITION BY level, lang, source, signal) AS total FROM lv),
q AS (SELECT level, lang, source, max(total) AS n, {deciles} FROM run GROUP BY level, lang, source),
b AS (SELECT *, {own} FROM q),
p AS (SELECT a.lang, a.source, {pick} FROM b a JOIN b ON b.level = 1 AND a.lang IS NOT DISTINCT FROM b.lang JOIN b c ON c.level = 2 WHERE a.level = 0)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT coalesce({" OR ".join(map(beyond, BOUNDS))}, false) AS kept
FROM f LEFT JOIN p ON f.lang IS NOT DISTINCT FROM p.lang AND f.source IS NOT DISTINCT FROM p.source
"""


ORACLE = _oracle()
