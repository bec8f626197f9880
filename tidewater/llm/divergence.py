"""Source divergence audit: how far the sources of a language use different words, from joint count histograms.

Terms are counted whole in workers (per batch of documents and group, then by partial sums), and a language keeps the
terms that MIN_DOCS of its documents have. A kept term is then one vector of (source, count) entries without zeros,
and equal vectors are one row with a multiplicity. For each pair of sources the distinct (count, count) combinations
are tallied: entries of a vector give the cells where both have the term; cells with a zero are implied, so they come
from signed rows (a term counted as present in both is taken from the margins of either, and the terms of the
language less those of both fill the cell of two zeros). The function f is evaluated once a combination, for both directions,
and multiplied by its tally. So its cost follows the number of different counts, not that of terms.

All arithmetic is exact. 10**9 * (count + 1) is a decimal, so counts up to 10**18 do not overflow; a sum of f is
at most 10**9 * (10**9 + V), which a long holds for up to 8 * 10**9 kept terms.

Skew: a frequent term or a source of a third of all rows is summed in workers and by partial sums before any exchange. The
top ranks are cut in each partition before groups meet. Nothing is collected, and only tables counted to be small are
broadcast.

Cases: null text, lang and source are ''; a group without terms has its rows in part `pair` (its p is that of counts of zero) and
none in part `term`; a language that keeps no term has value 0 for every pair; repeated rows count each time, as documents
as well; ties rank by the bytes of the item; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import exact, join_small, text_of, written

MIN_DOCS = 3
RANKS = 200
SCALE = 1_000_000_000
#: Different terms that a worker counts before it hands them on, and bytes of a text that it splits at once.
HELD, PIECE = 400_000, 1 << 20
COUNTED = "lang string, source string, term string, n long, docs long"

#: Letters stay (A-Z as a-z), and so do all bytes of characters beyond ASCII; everything else separates terms.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms_of(text: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, some MB of it at a time."""
    at = 0
    while at < len(text):
        end = at + piece
        part = text[at:end].translate(FOLD)
        if end < len(text):  # up to the last separator, or the next one if a term is longer than a piece
            cut = part.rfind(b" ")
            while cut < 0 and end < len(text):
                end += piece
                part = text[at:end].translate(FOLD)
                cut = part.find(b" ")
            if cut >= 0:
                part = part[:cut]
        at += max(1, len(part))
        yield part.split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of COUNTED: counts of terms for each group, and a row without a term for each group that occurs."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, docs) in groups.items():
            terms = list(counts)
            for i in range(0, len(terms) + 1, 50_000):
                part = terms[i : i + 50_000]
                names, n, d = [t.decode() for t in part], [counts[t] for t in part], [docs[t] for t in part]
                if i == 0:
                    names, n, d = [None, *names], [0, *n], [0, *d]
                yield pa.record_batch([pa.array([lang] * len(names), pa.string()), pa.array([source] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts, strict=True):
            counts, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            before, seen = len(counts), set()
            for terms in terms_of(text.as_py()):
                counts.update(terms)
                seen.update(terms)
            docs.update(seen)
            held += len(counts) - before
            if held > HELD:
                yield from out()
                groups.clear()
                held = 0
    yield from out()


def counted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group and the documents that have it; and for each
    group one row whose term is null."""
    rows = docs.select(text_of(exact(lang_col).cast("string")).alias("lang"), text_of(exact(source_col).cast("string")).alias("source"), text_of(exact(text_col)).alias("text"))
    return rows.mapInArrow(_counted, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """p of a count among total occurrences of kept terms, in parts of SCALE; null where no term is kept."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")
    return F.when(kept > 0, F.call_function("div", above, (total + kept).cast("decimal(20,0)")).cast("long") + 1)


def gain(p: Column, q: Column) -> Column:
    """f: how far p departs from q."""
    return F.call_function("div", (p - q) * (p - q), q)


class Audit:
    """The kept terms of a corpus as written tables: vectors, groups and tallies."""

    def __init__(self, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS):
        counts = written(counted(docs, text_col, lang_col, source_col), "divergence-counts")
        entries = F.array_sort(F.collect_list(F.struct("source", "n"))).alias("entries")
        per_term = counts.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), entries)
        #: (lang, term, total, entries): every kept term with its counts, sorted by source and without zeros
        self.vectors = written(per_term.filter(F.col("docs") >= min_docs).drop("docs"), "divergence-vectors")
        #: (lang, source, count, terms): how many kept terms a group has so many times
        flat = self.vectors.select("lang", F.explode("entries").alias("e")).select("lang", "e.source", F.col("e.n").alias("count"))
        self.margins = written(flat.groupBy("lang", "source", "count").agg(F.count("*").alias("terms")), "divergence-margins")
        languages = self.vectors.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_total"))
        own = self.margins.groupBy("lang", "source").agg(F.sum(F.col("count") * F.col("terms")).alias("total"))
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        #: (lang, source, total, kept, lang_total): every group that occurs
        self.groups = written(counts.filter("term IS NULL").select("lang", "source").join(own, ["lang", "source"], "left").join(languages, ["lang"], "left").select("lang", "source", *map(zero, ("total", "kept", "lang_total"))), "divergence-groups")

    def tallies(self) -> DataFrame:
        """(lang, a, b, count_a, count_b, terms) for each pair of sources a < b of a language: the kept terms that have just these
        counts, zeros included."""
        n_vectors = self.vectors.groupBy("lang", "entries").agg(F.count("*").alias("m"))
        after = lambda i: F.slice("entries", i + 2, F.greatest(F.size("entries") - i - 1, F.lit(0)))
        both = F.flatten(F.transform("entries", lambda x, i: F.transform(after(i), lambda y: F.struct(x.alias("x"), y.alias("y")))))
        joint = n_vectors.select("lang", "m", F.explode(both).alias("p")).groupBy("lang", F.col("p.x.source").alias("a"), F.col("p.y.source").alias("b"), F.col("p.x.n").alias("ca"), F.col("p.y.n").alias("cb")).agg(F.sum("m").alias("m"))
        zero = F.lit(0).cast("long")
        cell = lambda ca, cb, m: F.struct(ca.alias("ca"), cb.alias("cb"), m.alias("m"))
        ca, cb, m = F.col("ca"), F.col("cb"), F.col("m")
        cells = lambda *of: F.explode(F.array(*of)).alias("c")
        present = joint.select("lang", "a", "b", cells(cell(ca, cb, m), cell(ca, zero, -m), cell(zero, cb, -m), cell(zero, zero, m)))
        # the margins of either source, for each pair that it is in
        mates = self.pairs()
        margin = self.margins.select(F.col("lang").alias("l"), F.col("source").alias("s"), "count", F.col("terms").alias("m"))
        count = F.col("count")
        of = lambda side: F.col("lang").eqNullSafe(F.col("l")) & (F.col(side) == F.col("s"))
        left = mates.join(margin, of("a")).select("lang", "a", "b", cells(cell(count, zero, m), cell(zero, zero, -m)))
        right = mates.join(margin, of("b")).select("lang", "a", "b", cells(cell(zero, count, m), cell(zero, zero, -m)))
        whole = mates.select("lang", "a", "b", cells(cell(zero, zero, F.col("kept"))))
        every = present.unionByName(left).unionByName(right).unionByName(whole)
        tally = every.groupBy("lang", "a", "b", F.col("c.ca").alias("count_a"), F.col("c.cb").alias("count_b")).agg(F.sum("c.m").alias("terms"))
        return tally.filter("terms > 0")

    def pairs(self) -> DataFrame:
        """(lang, a, b, kept, total_a, total_b): pairs of sources a < b of a language; the audit has a result for each of them."""
        right = self.groups.select(F.col("lang").alias("l"), F.col("source").alias("b"), F.col("total").alias("total_b"))
        return self.groups.join(right, (F.col("lang") == F.col("l")) & (F.col("source") < F.col("b"))).select("lang", F.col("source").alias("a"), "b", "kept", F.col("total").alias("total_a"), "total_b")

    def divergences(self) -> DataFrame:
        """(lang, source, item, value): of each source to each other one of its language."""
        pairs, tally = self.pairs(), self.tallies()
        found = tally.join(pairs, ["lang", "a", "b"])
        p, q = share(F.col("count_a"), F.col("total_a"), F.col("kept")), share(F.col("count_b"), F.col("total_b"), F.col("kept"))
        found = found.select("lang", "a", "b", "terms", p.alias("p"), q.alias("q"))
        sums = found.groupBy("lang", "a", "b").agg(F.sum(F.col("terms") * gain(F.col("p"), F.col("q"))).alias("ab"), F.sum(F.col("terms") * gain(F.col("q"), F.col("p"))).alias("ba"))
        every = pairs.select("lang", "a", "b").join(sums, ["lang", "a", "b"], "left")
        way = lambda s, i, v: F.struct(F.col(s).alias("source"), F.col(i).alias("item"), F.coalesce(v, F.lit(0)).alias("value"))
        return every.select("lang", F.explode(F.array(way("a", "b", "ab"), way("b", "a", "ba"))).alias("w")).select("lang", "w.*")

    def marks(self) -> DataFrame:
        """(lang, source, item, value): the terms that a group has more often than its language."""
        flat = self.vectors.select("lang", F.col("term").alias("item"), F.col("total").alias("lang_n"), F.explode("entries").alias("e")).select("lang", "item", "lang_n", "e.source", "e.n")
        groups = self.groups.select(F.col("lang").alias("l"), F.col("source").alias("s"), "total", "kept", "lang_total")
        on = (F.col("lang") == F.col("l")) & (F.col("source") == F.col("s"))
        p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
        rows = join_small(flat, groups, on, F.col("item")).select("lang", "source", "item", p.alias("p"), q.alias("q")).filter("p > q")
        return rows.select("lang", "source", "item", gain(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has each other source of the language by divergence, part `term` the
    first ranks terms by which a source departs from its language."""
    a = Audit(docs, text_col, lang_col, source_col, min_docs)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    pair, term = ranked(a.divergences()).withColumn("part", F.lit("pair")), ranked(a.marks()).filter(F.col("rank") <= ranks).withColumn("part", F.lit("term"))
    return pair.unionByName(term).select("lang", "source", "part", "item", "value", "rank")


def op11_divergence(spark, sf_dir: str) -> DataFrame:
    """The sources of all documents."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS uid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT uid, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT uid) >= {MIN_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, kept.term, kept.n AS lang_n, coalesce(x.n, 0) AS n FROM g JOIN kept ON g.lang = kept.lang
    LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM t GROUP BY 1, 2, 3) x ON x.lang = g.lang AND x.source = g.source AND x.term = kept.term),
s AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total, sum(lang_n) OVER (PARTITION BY lang, source) AS lang_total, count(*) OVER (PARTITION BY lang, source) AS v FROM c),
p AS (SELECT lang, source, term, n, 1 + {SCALE}::HUGEINT * (n + 1) // (total + v) AS p, 1 + {SCALE}::HUGEINT * (lang_n + 1) // (lang_total + v) AS q FROM s),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY 1, 2, 3),
rows AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM rows)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= {RANKS}
"""
