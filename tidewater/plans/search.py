"""The subset of a document index's query language that frames can answer: bool, term, terms, range, match, exists."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.merge import upsert

RANGES = {"gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}


def tokens(c: Column) -> Column:
    """Words of letters and digits, lower-cased, and bigrams of CJK runs."""
    low = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    words = F.regexp_extract_all(low, F.lit(r"[a-z0-9]+"), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(r"[一-鿿]+"), F.lit(0))
    grams = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) < 2, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, 2)))))
    return F.array_distinct(F.concat(words, grams))


def compiled(q: dict[str, Any] | None) -> Column:
    """The predicate of a query."""
    if not q or "match_all" in q:
        return F.lit(True)
    (kind, body), *_ = q.items()
    if kind == "bool":
        parts = [compiled(x) for k in ("must", "filter") for x in _list(body.get(k))] + [~compiled(x) for x in _list(body.get("must_not"))]
        if should := [compiled(x) for x in _list(body.get("should"))]:
            if not parts or body.get("minimum_should_match", 0):
                parts.append(reduce(lambda a, b: a | b, should))
        return F.coalesce(reduce(lambda a, b: a & b, parts, F.lit(True)), F.lit(False))
    if kind == "exists":
        return F.col(body["field"]).isNotNull()
    (name, value), *_ = body.items()
    c = F.col(name.removesuffix(".keyword"))
    if kind == "term":
        value = value["value"] if isinstance(value, dict) else value
        return F.coalesce(c == value, F.lit(False))
    if kind == "terms":
        return F.coalesce(c.isin(*value), F.lit(False))
    if kind == "range":
        return F.coalesce(reduce(lambda a, b: a & b, [getattr(c, RANGES[k])(v) for k, v in value.items()], F.lit(True)), F.lit(False))
    if kind == "match":
        words = value["query"] if isinstance(value, dict) else value
        return F.size(F.array_intersect(tokens(c), tokens(F.lit(words)))) > 0
    raise ValueError(f"unknown query {kind}")


def _list(x: Any) -> list:
    return [] if x is None else x if isinstance(x, list) else [x]


def search(docs: DataFrame, body: dict[str, Any], id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(total, hits) of a request with query, sort, from and size; ties by id."""
    rows = docs.filter(compiled(body.get("query")))
    order = []
    for s in _list(body.get("sort")):
        (name, how), *_ = ({s: "asc"} if isinstance(s, str) else s).items()
        how = how["order"] if isinstance(how, dict) else how
        c = F.col(name.removesuffix(".keyword"))
        order.append(c.desc_nulls_last() if how == "desc" else c.asc_nulls_last())
    hits = rows.orderBy(*order, id_col).offset(int(body.get("from", 0))).limit(int(body.get("size", 10)))
    return rows.agg(F.count("*").alias("total")), hits


def documents(rows: DataFrame, flags: tuple[str, ...] = (), arrays: tuple[str, ...] = ()) -> DataFrame:
    """(doc): rows as JSON documents without null fields: flags as booleans, scalars in array fields as arrays,
    decimals as numbers, times in ISO form."""
    cols = []
    for f in rows.schema:
        kind, c = f.dataType.typeName(), F.col(f.name)
        if f.name in flags:
            c = c.cast("boolean")
        elif f.name in arrays and kind == "string":
            c = F.when(c.isNotNull(), F.array(c))
        elif kind == "decimal":
            c = c.cast("double")
        elif kind in ("timestamp", "timestamp_ntz"):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        cols.append(c.alias(f.name))
    return rows.select(F.to_json(F.struct(*cols)).alias("doc"))


def pruned(index: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The index without documents whose row is gone."""
    return index.join(rows.select(F.col(key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left_semi")


def got(index: DataFrame, key: str, value: Any) -> DataFrame:
    """The document of an id, if there is one."""
    return index.filter(F.col(key) == value)


def updated(index: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """The index with partial documents written into it: their fields replace those of the document with their id (a null keeps
    it), and documents that the index lacks are added."""
    return upsert(index, docs, [key], [c for c in docs.columns if c != key])


def deleted(index: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The index without the documents of these ids."""
    return index.join(ids.select(F.col(key).alias("__k")), F.col(key) == F.col("__k"), "left_anti")


def deleted_by_query(index: DataFrame, query: dict[str, Any]) -> DataFrame:
    return index.filter(~compiled(query))


def mirrored(index: DataFrame, rows: DataFrame, key: str, changed_at: str, last: Column, prune: bool = False) -> DataFrame:
    """The index after an incremental mirror: rows changed past the last mark are upserted as documents, and with prune those whose
    row is gone are dropped."""
    fresh = rows.filter(F.col(changed_at) > last).select(*index.columns)
    out = updated(index, fresh, key)
    return pruned(out, rows, key) if prune else out
