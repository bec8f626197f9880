"""Merkle manifest of a dataset, with a proof for each row, by parent-preimage paths.

A row's leaf is a hash of its columns. The leaves of a source stand in the order of their ids and three consecutive nodes at a time
have a parent, up to the subroot of the source; the subroots, in the order of their sources, have parents likewise up to the
root. A parent is stored as its preimage, which is the concatenated hashes of its children (at most ARITY times 64 characters);
its hash is the hash of that. The paths go down again: a parent's path is its own preimage before the path of its parent, so each
level joins the one above it and a row's path is one join with the lowest parents. All that a proof needs is in the path and
the row's place: cutting the own 64 characters out of each preimage leaves the siblings, and putting another hash there
folds a replacement up to a root.

Places are found without a window over a source: rows are exchanged by range of (source, id, leaf, row) and sorted, a row's
place is the one in its partition plus the rows of the partitions before. Texts are hashed where they are read and never
move. A level is a third of the one below it, so all of them together are half the leaves, and each is a written table: a lost
executor costs one level. The driver gets the number of rows of the largest source and the root; nothing else.

Cases: null fields are hashed as `-`, so a null text and an empty one differ; null sources and ids come first; rows with equal
ids stand in the order of their leaves, repeated rows next to each other, each with its place and proof; a lone leaf is its
subroot, and a lone subroot the root, with an empty proof; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import dropped, exact, join_small, written

ARITY = 3
DIGEST = 64
#: The fields of a leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PIECE_ROWS = 500_000


def digest(text: Column) -> Column:
    """H: SHA-256 in lowercase hexadecimal."""
    return F.sha2(text, 256)


def leaf_of(fields: list[Column]) -> Column:
    """H of the fields, each as its number of bytes, a colon and its value, or `-` for null."""
    text = [f.cast("string") for f in fields]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]))


def placed(rows: DataFrame, order: list[str], total: int) -> DataFrame:
    """rows with place: their number from 0 in the order of these columns, nulls first. Equal rows have any of their places."""
    parts = max(4, -(-total // PIECE_ROWS))
    here = F.monotonically_increasing_id()
    keyed = rows.withColumn("__row", here)
    sorted_ = keyed.repartitionByRange(parts, *order, "__row").sortWithinPartitions(*order, "__row").drop("__row")
    mask = F.lit((1 << 33) - 1)
    numbered = written(sorted_.withColumn("__part", F.spark_partition_id()).withColumn("__at", here.bitwiseAND(mask)), "manifest-places")
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = numbered.groupBy(F.col("__part").alias("__p")).agg(F.count("*").alias("__n"))
    starts = written(starts.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")), "manifest-starts")
    out = join_small(numbered, starts, F.col("__part") == F.col("__p"), F.col("__at"))
    return out.withColumn("place", F.col("__start") + F.col("__at")).drop("__part", "__at", "__p", "__start")


def div(n: Column, by: Column | int) -> Column:
    return F.call_function("div", n, by if isinstance(by, Column) else F.lit(by))


def climbed(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """nodes (tree, n, place, hash), n of them in a tree and at most `most`: the written levels of parents (tree, n, place, preimage,
    hash) from the lowest to the highest, and (tree, top): the hash that remains of each tree."""
    levels, tops, now = [], [], nodes
    while True:
        tops.append(now.filter("n = 1").select("tree", F.col("hash").alias("top")))
        if most <= 1:
            break
        family = now.filter("n > 1").groupBy("tree", "n", div(F.col("place"), ARITY).alias("place")).agg(F.sort_array(F.collect_list(F.struct("place", "hash"))).alias("children"))
        preimage = F.array_join(F.transform("children", lambda c: c["hash"]), "")
        now = family.select("tree", div(F.col("n") + (ARITY - 1), ARITY).alias("n"), "place", preimage.alias("preimage")).withColumn("hash", digest(F.col("preimage")))
        now, most = written(now, "manifest-level"), -(-most // ARITY)
        levels.append(now)
    top = tops[0]
    for t in tops[1:]:
        top = top.unionByName(t)
    return levels, written(top, "manifest-tops")


def paths(levels: list[DataFrame]) -> DataFrame | None:
    """(tree, place, path) of the lowest parents: all preimages from their own up to the top of the tree, as one array. None if there
    are no parents."""
    down = None
    for level in reversed(levels):
        own = F.array("preimage")
        if down is None:
            out = level.select("tree", "place", own.alias("path"))
        else:
            up = down.select(F.col("tree").alias("t"), F.col("place").alias("p"), F.col("path").alias("rest"))
            out = level.join(up, (F.col("tree") == F.col("t")) & (div(F.col("place"), ARITY) == F.col("p")), "left")
            out = out.select("tree", "place", F.concat(own, F.coalesce("rest", F.array().cast("array<string>"))).alias("path"))
        before, down = down, written(out, "manifest-paths")
        dropped(*([before] if before is not None else []))
    return down


def slots(place: Column, preimages: Column) -> Column:
    """(preimage, at) for each level: where in its parent's preimage the node above a place stands, from 0."""
    digit = lambda i: F.pmod(div(place, F.pow(F.lit(float(ARITY)), i).cast("long")), F.lit(ARITY)).cast("int")
    return F.transform(preimages, lambda x, i: F.struct(x.alias("preimage"), (DIGEST * digit(i)).alias("at")))


def siblings(path: Column) -> Column:
    """The hashes beside a row's, level by level: each preimage without its own slot."""
    rest = lambda s: F.concat(F.substring(s["preimage"], F.lit(1), s["at"]), F.substring(s["preimage"], s["at"] + DIGEST + 1, F.lit(ARITY * DIGEST)))
    return F.array_join(F.transform(path, rest), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to, put into its slots."""
    return F.aggregate(path, leaf, lambda h, s: digest(F.overlay(s["preimage"], h, s["at"] + 1, F.lit(DIGEST))))


def manifest(docs: DataFrame, tampered: Column | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row a document: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.

    fields are the columns of doc_id, source, lang, n_chars and text. tampered is the text as it is found at verification, by default
    the text itself: its leaf is folded through the original siblings, and verified if that gives the root."""
    doc_id, source, *_, text = (exact(f) for f in fields)
    cols = [exact(f) for f in fields]
    found = text if tampered is None else tampered
    again = F.when(found.eqNullSafe(text), F.lit(None).cast("string")).otherwise(leaf_of([*cols[:-1], found]))
    rows = written(docs.select(doc_id.alias("doc_id"), source.alias("source"), leaf_of(cols).alias("leaf"), again.alias("found")), "manifest-leaves")
    leaves = written(placed(rows, ["source", "doc_id", "leaf"], rows.count()), "manifest-placed")

    # a source is a tree, numbered in order of the sources; its leaves are neighbours
    trees = written(leaves.groupBy("source").agg(F.min("place").alias("first"), F.count("*").alias("n")), "manifest-sources")
    n_trees, most = trees.agg(F.count("*"), F.max("n")).first()
    trees = written(placed(trees, ["first"], n_trees).select(F.col("place").alias("tree"), F.col("source").alias("s"), "first", "n"), "manifest-trees")
    nodes = join_small(leaves, trees, F.col("source").eqNullSafe(F.col("s")), F.col("place"))
    nodes = written(nodes.select("tree", "n", (F.col("place") - F.col("first")).alias("place"), F.col("leaf").alias("hash"), "doc_id", "found"), "manifest-nodes")
    levels, subroots = climbed(nodes.select("tree", "n", "place", "hash"), most or 0)

    # the tree of the subroots
    whole = subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(n_trees).cast("long").alias("n"), F.col("tree").alias("place"), F.col("top").alias("hash"))
    high, root = climbed(whole, n_trees)
    last = root.first()  # one row
    none = F.array().cast("array<string>")
    above = paths(high)
    tops = subroots.select(F.col("tree").alias("t"), F.col("top").alias("subroot"))
    if above is None:
        tops = tops.withColumn("above", none)
    else:
        tops = tops.join(above.select(F.col("place").alias("p"), F.col("path").alias("above")), div(F.col("t"), ARITY) == F.col("p"))
    tops = written(tops.select("t", "subroot", "above"), "manifest-subroots")

    # rows and the lowest parents have their order and so their exchange in common
    lowest = paths(levels)
    if lowest is None:
        rows = nodes.withColumn("path", none)
    else:
        up = lowest.select(F.col("tree").alias("t"), F.col("place").alias("p"), "path")
        rows = nodes.join(up, (F.col("tree") == F.col("t")) & (div(F.col("place"), ARITY) == F.col("p")), "left").drop("t", "p")
    rows = join_small(rows, tops, F.col("tree") == F.col("t"), F.col("place"))
    path = F.concat(slots(F.col("place"), F.coalesce("path", none)), slots(F.col("tree"), F.col("above")))
    rows = rows.select("doc_id", F.col("hash").alias("leaf"), F.coalesce("found", "hash").alias("found"), "subroot", F.lit(last.top if last else None).cast("string").alias("root"), path.alias("path"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", digest(siblings(F.col("path"))).alias("proof_sha256"), folded(F.col("found"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_manifest(spark, sf_dir: str) -> DataFrame:
    """All documents; where 2 divides the checksum of the id, the text to verify lacks its line ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return manifest(docs, F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text")))


_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = " || ".join(_FIELD.format(f) for f in FIELDS)
_FOUND = " || ".join(_FIELD.format(f if f != "text" else "replace(text, chr(10), '')") for f in FIELDS)
#: The checksum of the id, bit by bit: DuckDB has no function for it.
_CRC = "list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), c -> ascii(c)::BIGINT), lambda c, b: list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, z: xor(x >> 1, (x & 1) * 3988292384)))".replace("c -> ", "lambda c: ")
ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, sha256({_LEAF}) AS leaf, sha256(CASE WHEN coalesce(xor({_CRC}, 4294967295) % 2 = 0, false) THEN {_FOUND} ELSE {_LEAF} END) AS found FROM documents),
l AS (SELECT *, row_number() OVER () AS uid, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
    count(*) OVER (PARTITION BY source) AS n FROM d),
up AS (SELECT 0 AS level, tree, place, n, NULL::VARCHAR AS pre, leaf AS hash FROM l
    UNION ALL SELECT level + 1, tree, place // {ARITY}, max(n + {ARITY - 1}) // {ARITY}, string_agg(hash, '' ORDER BY place), sha256(string_agg(hash, '' ORDER BY place)) FROM up WHERE n > 1 GROUP BY level, tree, place // {ARITY}),
sub AS (SELECT tree, hash, max(tree) OVER () + 1 AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS level, tree AS place, n, NULL::VARCHAR AS pre, hash FROM sub
    UNION ALL SELECT level + 1, place // {ARITY}, max(n + {ARITY - 1}) // {ARITY}, string_agg(hash, '' ORDER BY place), sha256(string_agg(hash, '' ORDER BY place)) FROM top WHERE n > 1 GROUP BY level, place // {ARITY}),
steps AS (SELECT uid, level, (l.place // pow({ARITY}, level - 1)::BIGINT) % {ARITY} AS slot, pre FROM l JOIN up ON up.tree = l.tree AND level > 0 AND up.place = l.place // pow({ARITY}, level)::BIGINT
    UNION ALL SELECT uid, 1000 + level, (l.tree // pow({ARITY}, level - 1)::BIGINT) % {ARITY}, pre FROM l JOIN top ON level > 0 AND top.place = l.tree // pow({ARITY}, level)::BIGINT),
proof AS (SELECT uid, string_agg(pre[1:{DIGEST} * slot] || pre[{DIGEST} * slot + {DIGEST + 1}:], '' ORDER BY level) AS proof, list(struct_pack(pre := pre, slot := slot) ORDER BY level) AS path FROM steps GROUP BY uid),
fold AS (SELECT l.uid, found AS h, path FROM l LEFT JOIN proof USING (uid)
    UNION ALL SELECT uid, sha256(path[1].pre[1:{DIGEST} * path[1].slot] || h || path[1].pre[{DIGEST} * path[1].slot + {DIGEST + 1}:]), path[2:] FROM fold WHERE len(path) > 0)
SELECT doc_id, leaf, sub.hash AS subroot, (SELECT hash FROM top WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256, h AS folded_root, h = (SELECT hash FROM top WHERE n = 1) AS verified
FROM l JOIN sub USING (tree) LEFT JOIN proof USING (uid) JOIN fold USING (uid) WHERE coalesce(len(fold.path), 0) = 0
"""
