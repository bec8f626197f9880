"""Source divergence and the Merkle manifest; their SQL is held against the queries in test_native."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidewater.llm import divergence, manifest

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+").findall
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def audited(rows, ranks=divergence.RANKS):
    """The audit of (doc_id, text, lang, source) rows in plain Python, cell by cell."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        terms = TERM((text or "").translate(LOWER))
        groups.add((lang or "", source or ""))
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang, source in groups:
        kept = sorted(t for t, n in docs[lang].items() if n >= 3)
        names = sorted(s for at, s in groups if at == lang)
        whole = sum((counts[lang, s] for s in names), Counter())

        def p(of, kept=kept):
            total = sum(of[t] for t in kept)
            return {t: 1 + 10**9 * (of[t] + 1) // (total + len(kept)) for t in kept}

        def f(a, b):
            return (a - b) ** 2 // b

        own, every = p(counts[lang, source]), p(whole)
        pair = [(sum(f(own[t], q[t]) for t in kept), s) for s in names if s != source for q in [p(counts[lang, s])]]
        term = [(f(own[t], every[t]), t) for t in kept if counts[lang, source][t] and own[t] > every[t]]
        for part, found, most in (("pair", pair, None), ("term", term, ranks)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most])]
    return sorted(out)


def test_divergence_against_plain_python(docs_of, monkeypatch):
    # a hot source, an odd language, terms in upper case, with accents and beyond the basic plane, a group without terms
    texts = ["The cat; THE dog", "the Étoile étoile 東京", "cat-dog 😀x 42", "\x7fa\x00b the", "", "123 456", None]
    rows = [(i, texts[i % 7], ["en", None, "fr"][i % 3], "hot" if i % 2 else f"s{i % 5}") for i in range(120)] + [(200, "lone words", "xx", "s"), (201, "9", "en", "none"), (202, "9", "yy", None)]
    for held in (divergence.HELD, 3):
        monkeypatch.setattr(divergence, "HELD", held)
        got = sorted(map(tuple, divergence.audit(docs_of(rows), ranks=4).collect()))
        assert got == audited(rows, 4)


def test_divergence_tallies_cover_every_kept_term(spark, corpus):
    a = divergence.Audit(corpus)
    kept = {r.lang: r.kept for r in a.groups.select("lang", "kept").distinct().collect()}
    sums = a.tallies().groupBy("lang", "a", "b").agg(F.sum("terms").alias("n"), F.max((F.col("count_a") + F.col("count_b") == 0).cast("int")).alias("zeros")).collect()
    assert sums and all(r.n == kept[r.lang] for r in sums) and any(r.zeros for r in sums)


def test_divergence_edges(spark, docs_of, odd):
    assert divergence.audit(odd.limit(0)).count() == 0
    extra = odd.select("*", *[F.lit(f"x{i}").alias(n) for i, n in enumerate("term n docs total kept l s e entries a b p q m c rank value item part lang_n count text2".split())])
    rows = [tuple(r) for r in odd.select("doc_id", "text", "lang", "source").collect()]
    assert sorted(map(tuple, divergence.audit(extra).collect())) == audited(rows)


def test_terms_of_pieces():
    text = ("Abc, dÉf 12 x" * 50 + "y" * 300 + " z").encode()
    want = [t.encode() for t in TERM(text.decode().translate(LOWER))]
    for piece in (1, 7, 64, 1 << 20):
        assert [t for part in divergence.terms_of(text, piece) for t in part] == want


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    doc_id, source, lang, n_chars, text = row
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(hashes):
    """The root of a list of hashes, and for each the (siblings before, siblings after) of each level."""
    levels, proofs = [hashes], [[] for _ in hashes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        for i in range(len(hashes)):
            at = i // 3 ** (len(levels) - 1)
            run = now[at // 3 * 3 : at // 3 * 3 + 3]
            proofs[i].append((run[: at % 3], run[at % 3 + 1 :]))
        levels.append([H(*now[i : i + 3]) for i in range(0, len(now), 3)])
    return levels[-1][0], proofs


def manifested(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((-1 if r[0] is None else r[0], leaf(r), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs = {s: tree([x[1] for x in sorted(by[s], key=lambda x: x[:2])]) for s in names}
    root, tops = tree([subs[s][0] for s in names])
    out = []
    for i, s in enumerate(names):
        for (_, h, r), own in zip(sorted(by[s], key=lambda x: x[:2]), subs[s][1], strict=True):
            proof = own + tops[i]
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            f = leaf((*r[:4], r[4].replace("\n", ""))) if even and r[4] is not None else h
            for before, after in proof:
                f = H(*before, f, *after)
            out.append((r[0], h, subs[s][0], root, H(*[x for b, a in proof for x in b + a]), f, f == root))
    return sorted(out, key=repr)


def query_rows(spark, path, docs):
    docs.write.parquet(f"{path}/documents.parquet")
    return sorted(map(tuple, manifest.op13_manifest(spark, f"file://{path}").collect()), key=repr)


def test_manifest_against_plain_python(spark, tmp_path, docs_of, odd):
    """Sources of 1 to 40 rows (a hot one with a third of all), repeated rows and ids, null fields, line ends; and few or no rows."""
    rows = [(i, f"line {i}\nand more\n" if i % 4 else "no end", "en", "hot" if i % 3 == 0 else f"s{i % 11}") for i in range(120)]
    rows += [(5, "line\n", None, "s1"), (5, "other\n", "en", "s1"), (5, "other\n", "en", "s1"), (None, "a\n", "en", "s1"), (None, None, None, None), (7, "", "en", None), (900, "lone\n", "en", "é"), (901, "lone\n", "en", "z")]
    full = [(i, s, lang, None if t is None else len(t), t) for i, t, lang, s in rows]
    got = query_rows(spark, tmp_path / "a", docs_of(rows))
    assert got == manifested(full)
    assert {r[6] for r in got} == {True, False}
    assert got == sorted(map(tuple, manifest.op13_manifest(spark, f"file://{tmp_path}/a").collect()), key=repr)
    # one row, one source, no row
    assert query_rows(spark, tmp_path / "b", docs_of(rows[:1])) == manifested(full[:1])
    one = [(i, f"t{i}\n", "en", "a") for i in range(10)]
    assert query_rows(spark, tmp_path / "c", docs_of(one)) == manifested([(i, s, lang, len(t), t) for i, t, lang, s in one])
    assert query_rows(spark, tmp_path / "d", odd.limit(0)) == []


def test_manifest_places_over_many_partitions(spark, monkeypatch, docs_of):
    monkeypatch.setattr(manifest, "PIECE_ROWS", 7)
    rows = [(i, f"x{i}", "en", f"s{i % 2}") for i in range(100)] + [(1, "same", "en", "s1")] * 50
    got = sorted(map(tuple, manifest.manifest(docs_of(rows)).collect()), key=repr)
    want = manifested([(i, s, lang, len(t), t) for i, t, lang, s in rows])
    assert [r[:5] for r in got] == [r[:5] for r in want] and all(r[6] for r in got)


def test_manifest_ignores_other_columns(spark, odd):
    names = "leaf found tree n place hash path top t p s first __row __part __at preimage children above subroot root".split()
    extra = odd.select("*", *[F.lit(f"x{i}").alias(n) for i, n in enumerate(names)])
    a, b = (sorted(map(tuple, manifest.manifest(d).collect()), key=repr) for d in (odd, extra))
    assert a == b and all(r[6] for r in a)
