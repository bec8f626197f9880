"""Secret scans through a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams: a conjunction of clauses, each a
choice of literal strings that a match must contain one of (`trigram_query`). One pass over the texts writes the
postings (trigram, document) of the trigrams that some query asks for; postings are intersected per document and
rule; the expressions themselves then run only on the candidates, all others having no match. A rule without a
mandatory trigram (the hexadecimal runs) scans every text.

Postings name a document by a hash of its id and text. Two rows with one hash share their candidates, which can
only add a scan, never lose a match, since every candidate is verified.

Offsets are in code points, end exclusive. Cases: a null text is empty and has no spans; null and repeated ids,
repeated rows and clashing names of other columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from re import IGNORECASE
from re import _constants as C
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import exact, text_of, written


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: A match counts if this group of it has at least so many characters.
    group: int = 0
    least: int = 1
    base: bool = field(default=False)
    #: The pattern in the SQL, if that is an older one.
    sql: str = ""


ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: What stands between the lines of a key: white space, escaped line ends, and marks of quotes, lists and comments.
BETWEEN = r"""(?:\s|\\[nr]|[>|"',#*])"""
HEADS = r"(?:[\r\n]++[A-Za-z-]++:[^\r\n]*+)*+"
#: Lines of base64: long runs, whole lines, and the last run before END.
LINES = (
    rf"(?:{BETWEEN}++[A-Za-z0-9+/=]{{24,}}+|(?:[\r\n]|\\[nr])++[\x20\t>|]*+[A-Za-z0-9+/=]++(?=[\x20\t]*+(?:[\r\n]|\\[nr]))"
    rf"|{BETWEEN}++[A-Za-z0-9+/=]++(?={BETWEEN}*+-----END))*+"
)
#: A key from its BEGIN line over header lines and base64 to the END line. Between marks that have something else between them
#: it is BEGIN and what follows as if there were no END: header lines and base64, that is long runs, whole lines, and
#: what follows an escaped line end or ends in "=". Loops are possessive, so a long text takes no stack.
PEM = (
    rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:{HEADS}{LINES}{BETWEEN}*+-----END [A-Z ]*PRIVATE KEY-----"
    rf"|{HEADS}"
    r"(?:(?:\s|\\[nr])++[A-Za-z0-9+/=]{24,}+|\s*+(?<=[\r\n])[A-Za-z0-9+/=]++(?=[\x20\t]*(?:[\r\n]|$))|(?:\\[nr])++[A-Za-z0-9+/=]++|\x20[A-Za-z0-9+/]++={1,2}+)*+)"
)
RULES = (
    Rule("assign", ASSIGN, 2, 12, True),
    Rule("access", "AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", "[0-9a-f]+", 0, 16, True),
    Rule("pem", PEM, sql="-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("forge", "(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", "AIza[0-9A-Za-z_-]{35}"),
    Rule("pay", "(?:sk|rk)_live_[0-9A-Za-z]{16,}"),
    Rule("login", r"://[^/\x20\x09-\x0D:@]+:[^/\x20\x09-\x0D:@]+@", sql=r"://[^/\x20\x09-\x0D:@]{1,64}:[^/\x20\x09-\x0D:@]{1,64}@"),
)
#: Up to so many distinct strings are followed side by side through an expression.
WIDE = 16
#: Candidates are broadcast up to this number of documents (16 bytes each), else joined by a shuffle.
BROADCAST_KEYS = 400_000


def trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Clauses that every text with a match satisfies, compared without case: of each clause all trigrams of at
    least one alternative. Empty if the expression has no mandatory trigram."""
    clauses: list[list[frozenset[str]]] = []

    def flush(run: set[str]) -> None:
        if all(len(s) >= 3 for s in run) and (clause := sorted({trigrams(s) for s in run}, key=sorted)) not in clauses:
            clauses.append(clause)

    def exact(items) -> set[str] | None:
        """All strings that items can match, if they are few."""
        out = {""}
        for item in items:
            if (one := strings(item)) is None or len(out) * len(one) > WIDE:
                return None
            out = {a + b for a in out for b in one}
        return out

    def strings(item) -> set[str] | None:
        op, arg = item
        if op is C.LITERAL:
            return {chr(arg).lower()}
        if op is C.IN and all(o is C.LITERAL for o, _ in arg):
            return {chr(a).lower() for _, a in arg}
        if op is C.SUBPATTERN:
            return exact(arg[-1])
        if op is C.BRANCH:
            parts = [exact(x) for x in arg[1]]
            return None if any(p is None for p in parts) else set().union(*parts)
        if op is C.MAX_REPEAT and arg[1] is not C.MAXREPEAT and arg[1] <= 4 and (one := exact(arg[2])) is not None:
            out = set()
            for n in range(arg[0], arg[1] + 1):
                more = {""}
                for _ in range(n):
                    more = {a + b for a in more for b in one}
                out |= more
            return out
        return None

    def walk(items) -> None:
        run = {""}
        for item in items:
            one = strings(item)
            if one is not None and len(one) * len(run) <= WIDE:
                run = {a + b for a in run for b in one}
                continue
            flush(run)
            run = one if one is not None and len(one) <= WIDE else {""}
            if one is None and item[0] is C.SUBPATTERN:
                walk(item[1][-1])
            elif one is None and item[0] is C.MAX_REPEAT and item[1][0] >= 1:
                walk(item[1][2])
        flush(run)

    walk(parser.parse(pattern, IGNORECASE))
    return clauses


def candidates(docs: DataFrame, rules=RULES) -> DataFrame:
    """(key, mask): the documents that have all mandatory trigrams of at least one rule; bit r of mask for rule r."""
    spark = docs.sparkSession
    queries = {r: q for r, rule in enumerate(rules) if (q := trigram_query(rule.pattern))}
    wanted = sorted({t for q in queries.values() for clause in q for alt in clause for t in alt})
    folded = F.lower("text")
    found = F.filter(F.array(*map(F.lit, wanted)), lambda t: F.contains(F.col("folded"), t))
    postings = docs.select("key", folded.alias("folded")).select("key", F.explode(found).alias("trigram"))
    postings = written(postings, "secret-postings")
    asked = [(t, r, c, a, len(alt)) for r, q in queries.items() for c, clause in enumerate(q) for a, alt in enumerate(clause) for t in sorted(alt)]
    values = ", ".join(f"('{t}', {r}, {c}, {a}, {n})".replace("'''", "'\\''") for t, r, c, a, n in asked)
    query = spark.sql(f"SELECT * FROM VALUES {values} AS q(trigram, rule, clause, alt, size)")  # fixed by the rules
    sizes = F.element_at(F.array(*[F.lit(len(queries.get(r, []))) for r in range(len(rules))]), F.col("rule") + 1)
    hits = postings.join(F.broadcast(query), "trigram")
    met = hits.groupBy("key", "rule", "clause", "alt", "size").agg(F.count_distinct("trigram").alias("n")).filter("n = size")
    passed = met.groupBy("key", "rule").agg(F.count_distinct("clause").alias("n")).filter(F.col("n") == sizes)
    return passed.groupBy("key").agg(F.sum(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("rule"))).alias("mask"))


def spans_of(text: Column, rule: Rule, number: int) -> Column:
    """Leftmost matches that don't overlap, as (start, number, end): what lies between them and they themselves
    give the offsets by running sums."""
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda g: F.length(g))
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.length(m))
    counted = whole if rule.group == 0 else F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda m: F.length(m))
    found = F.arrays_zip(gaps.alias("gap"), whole.alias("len"), counted.alias("counted"))
    kind = "array<struct<start:int,kind:int,end:int>>"
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(a, m):
        start = a["at"] + m["gap"]
        end = start + F.coalesce(m["len"], F.lit(0))
        new = F.when(m["counted"] >= rule.least, F.array(F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end")))).otherwise(F.array().cast(kind))
        return F.struct(end.alias("at"), F.concat(a["out"], new).alias("out"))

    return F.aggregate(found, begin, step, lambda a: a["out"])


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, carry: list[str] | None = None, prefix: str = "") -> DataFrame:
    """One row a document: doc_id, text and spans, an array of (start, kind: number of the rule, end) by start and
    kind; and the columns of carry after prefix."""
    text = text_of(exact(text_col))
    carried = [exact(c).alias(f"{prefix}{c}") for c in carry or []]
    rows = docs.select(exact(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(exact(id_col), text).alias("key"), *carried)
    found = written(candidates(rows, rules), "secret-candidates").withColumnRenamed("key", "__key")
    few = found.count() <= BROADCAST_KEYS
    joined = rows.join(F.broadcast(found) if few else found, F.col("key") == F.col("__key"), "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    each = []
    for r, rule in enumerate(rules):
        if trigram_query(rule.pattern):
            asked = F.col("mask").bitwiseAND(F.lit(1 << r)) != 0
        else:
            asked = F.col("text").rlike(rule.pattern.rstrip("+") + f"{{{rule.least}}}" if rule.pattern.endswith("]+") else rule.pattern)
        each.append(F.when(asked, spans_of(F.col("text"), rule, r)).otherwise(none))
    return joined.withColumn("spans", F.sort_array(F.concat(*each))).drop("key", "__key", "mask")


def listed(spans: Column, rules=RULES) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redacted(docs: DataFrame, mark: str = "[secret]", rules=RULES) -> DataFrame:
    """docs with every secret replaced by mark; documents without secrets stay as they are."""
    found = scanned(docs, rules=rules, carry=docs.columns, prefix="__in_")
    # spans that overlap become one: (from, to) of what stays between them
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a, s):
        piece = F.col("text").substr(a["at"] + 1, F.greatest(F.lit(0), s["start"] - a["at"]))
        inside = s["start"] < a["at"]
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(inside, a["out"]).otherwise(F.concat(a["out"], F.array(piece))).alias("out"))

    clean = F.aggregate("spans", begin, step, lambda a: F.array_join(F.concat(a["out"], F.array(F.col("text").substr(a["at"] + 1, F.length("text")))), mark))
    has = F.size("spans") > 0
    new = {"text": F.when(has, clean).otherwise(F.col("__in_text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(has, F.length(new["text"])).otherwise(F.col("__in_n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.select(*[(new[c] if c in new else exact(f"__in_{c}")).alias(c) for c in docs.columns])


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    found = scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{RULES[k].kind}")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select("doc_id", of(0), of(1), of(2), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _oracle() -> str:
    """The SQL finds only the BEGIN line of a key, and logins of up to 64 characters a part: on others op4 finds more."""
    parts = []
    for i, r in enumerate(RULES):
        p = (r.sql or r.pattern).replace("'", "''")
        parts.append(
            f"SELECT uid, {i} AS kind, '{r.kind}' AS name, string_split_regex(text, '{p}') AS gaps, regexp_extract_all(text, '{p}') AS m, "
            + (f"regexp_extract_all(text, '{p}', {r.group})" if r.group else "m") + f" AS g, {r.least} AS least FROM d WHERE regexp_matches(text, '{p}')"
        )
    return f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(parts)}),
e AS (SELECT uid, kind, name, least, unnest(range(1, len(m) + 1)) AS i, gaps, m, g FROM f),
p AS (SELECT uid, kind, name, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s, length(m[i]) AS n FROM e WHERE length(g[i]) >= least),
a AS (SELECT uid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    coalesce(string_agg(name || ':' || s || ':' || (s + n), ',' ORDER BY s, kind) FILTER (kind < 3), '') AS base, string_agg(name || ':' || s || ':' || (s + n), ',' ORDER BY s, kind) AS spans FROM p GROUP BY uid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (uid)
"""


ORACLE = _oracle()
