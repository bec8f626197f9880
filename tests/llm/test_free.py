"""Media, pieces, SimHash, n-grams and repeats against libraries or plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import common, components, media, near, ngram, pieces, repeats, simhash
from tidewater.llm.common import shared_path

WORD = re.compile(r"[^\x20\x09-\x0D]+").findall


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def test_media_round_trip(spark, corpus, odd):
    for docs in (corpus, odd, odd.limit(0)):
        want = Counter()
        for r in docs.collect():
            raw = (r.text or "").encode()
            p = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
            want[r.doc_id, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
        path = shared_path(spark, "media-test")
        media.store(docs, path)
        got = media.features(media.load(spark, path, rangeBytes=4000)).collect()
        assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
        assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in got}) == len({r.payload_sha256 for r in got})


def test_media_retries_a_member_by_its_offset(spark, docs_of, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/media"
    media.store(docs_of([(i, f"text {i}", "en", "a") for i in range(5)]).coalesce(1), path)
    reader = media.ArchiveReader(path, 1 << 20, 3, True)
    tries, real = Counter(), media.read_member

    def flaky(file, info):
        tries[info.header_offset] += 1
        if info.filename.startswith("000000002") and tries[info.header_offset] < 3 or info.filename.startswith("000000004"):
            raise OSError("gone")
        return real(file, info)

    monkeypatch.setattr(media, "read_member", flaky)
    rows = [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
    assert [r["error"] for r in rows] == [None] * 4 + ["OSError: gone"] and sorted(tries.values()) == [1, 1, 1, 3, 3]
    strict = media.ArchiveReader(path, 1 << 20, 3, False)
    with pytest.raises(OSError):
        list(strict.read(strict.partitions()[0]))


def test_media_appends_and_overwrites(spark, docs_of, tmp_path):
    path = f"file://{tmp_path}/media"
    ids = lambda: sorted(r.doc_id for r in media.load(spark, path).collect())
    for low in (0, 5):
        media.store(docs_of([(i, f"text {i}", "en", "a") for i in range(low, low + 5)]), path)
    assert ids() == list(range(10))
    media.store(docs_of([(20, "new", "en", "a")]), path, mode="overwrite")
    assert ids() == [20] and len(list(tmp_path.joinpath("media").glob("*.zip"))) == 1
    media.store(docs_of([(21, "more", "en", "a")]), path)
    assert ids() == [20, 21]


def test_media_ranges():
    """Every byte is in one range; there are at most so many, however large or small the archives."""
    for archives in ([], [("a", 100, 1)], [(f"s{i}", 3, 1) for i in range(1000)], [("big", 10_007, 9), ("b", 1, 1), ("c", 500, 2)]):
        for size, most in ((10, 1 << 30), (10, 7), (1 << 30, 5)):
            got = [p for r in media.ranges_of(archives, size, most) for p in r.parts]
            assert sum(high - low for _, low, high in got) == sum(n for _, n, _ in archives)
            assert len(media.ranges_of(archives, size, most)) <= max(1, min(most, sum(n for _, n, _ in archives) // size + 1))


def test_media_form_and_features_plainly(spark, docs_of, tmp_path):
    """The stored form read by the wave module, the features summed one sample at a time."""
    import io
    import wave

    texts = ["", "a", "é 腾讯 😀" * 40, "\x00\x7f" * 100, "z" * 64]
    path = f"file://{tmp_path}/media"
    media.store(docs_of([(i, t, "en", "a") for i, t in enumerate(texts)]), path)
    stored = media.load(spark, path)
    found = {r.doc_id: r for r in media.features(stored).collect()}
    for r in stored.collect():
        with wave.open(io.BytesIO(bytes(r.media))) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.getframerate()) == (1, 1, media.RATE)
            x = w.readframes(w.getnframes())
        assert x.rstrip(b"\0") == texts[r.doc_id].encode().rstrip(b"\0") and len(x) % 64 == 0
        hist = ",".join(str(sum(v // 16 == k for v in x)) for k in range(16))
        crossings = sum((a >= 128) != (b >= 128) for a, b in zip(x, x[1:], strict=False))
        want = f"sum={sum(x)};energy={sum((v - 128) ** 2 for v in x)};crossings={crossings};min={min(x)};max={max(x)};hist={hist}"
        f = found[r.doc_id]
        assert f.feature == want and f.media_bytes == len(r.media) and f.media_sha256 == hashlib.sha256(r.media).hexdigest()


def test_media_damage_is_found(spark, docs_of, tmp_path):
    path = f"file://{tmp_path}/media"
    media.store(docs_of([(1, "a" * 5000, "en", "a"), (2, "b", "en", "a")]).coalesce(1), path)
    archive = next(tmp_path.joinpath("media").glob("*.zip"))
    data = bytearray(archive.read_bytes())
    data[60] ^= 255
    archive.write_bytes(data)
    errors = [r.error for r in media.load(spark, path, on_error="keep").orderBy("offset").collect()]
    assert errors[0] is not None and errors[1] is None


@pytest.fixture(scope="module")
def coder():
    import sentencepiece

    with open(pieces.default_model(), "rb") as f:
        model = f.read()
    return pieces.Pieces(model), sentencepiece.SentencePieceProcessor(model_proto=model)


def test_pieces_like_the_library(coder, corpus):
    own, sp = coder
    for r in corpus.collect():
        ids, joined = own.encode(r.text)
        assert ids == sp.encode(r.text) and joined == ",".join(map(str, ids)) and own.decode(ids) == sp.decode(ids)


def test_pieces_of_odd_texts(coder):
    own, sp = coder
    rnd = random.Random(7)
    parts = [" ", "  ", "▁", "a", "e", "th", "ing", "é", "\n", "\t", "腾", "😀", "\0", "1", "<s>", "<0x0A>", "ﬁ", "\u200b", *own.ids]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(4000)] + [" " * n + w for n in range(70) for w in ("", "x", "the", "腾")] + ["x" * 20_000, "腾" * 5000, " " * 5000]
    for t in texts:
        ids = own.encode(t)[0]
        assert ids == sp.encode(t) and own.decode(ids) == sp.decode(ids), repr(t)


def test_pieces_of_a_table(odd, coder):
    _, sp = coder
    want = Counter((r.doc_id, tuple(sp.encode(r.text or ""))) for r in odd.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in pieces.encoded(odd).collect()) == want
    assert pieces.encoded(odd.limit(0)).count() == 0


def fingerprint(t):
    import xxhash

    w = WORD(lower(t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius):
    up = list(range(len(ids)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= radius).tolist():
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    least = {}
    for i, k in enumerate(ids):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    return [least.get(root(i)) for i in range(len(ids))]


def test_simhash_like_brute_force(corpus, odd):
    for docs in (corpus, odd):
        rows = docs.select("doc_id", "text").collect()
        fps = np.array([fingerprint(r.text) for r in rows], np.uint64)
        want = Counter((r.doc_id, int(f), c) for r, f, c in zip(rows, fps, brute_components([r.doc_id for r in rows], fps, 2), strict=True))
        assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.clustered(docs).collect()) == want
    assert simhash.clustered(odd.limit(0)).count() == 0


@pytest.mark.parametrize(("radius", "agree", "shard"), [(2, 1, 20_000), (2, 1, 20), (4, 3, 20_000), (3, 2, 10)])
def test_links_connect_what_is_near(spark, monkeypatch, radius, agree, shard):
    monkeypatch.setattr(simhash, "TREE", 20)
    rng = np.random.default_rng(radius)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = np.unique(np.concatenate([c ^ np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(60)], np.uint64) for c in centres]))
    df = spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long")
    found = {r.node: r.root for r in components.components(simhash.links(df, radius, shard, agree)).collect()}
    mine = [found.get(int(v), int(v)) for v in fps.view(np.int64)]
    want = brute_components(list(range(len(fps))), fps, radius)
    assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))


def test_large_shards_are_cut_until_small(spark, monkeypatch):
    """Fingerprints that agree in most bits, so that every band is one large shard: no tree gets more than a shard takes."""
    low = np.random.default_rng(9).choice(1 << 14, 600, replace=False).astype(np.uint64)
    fps = np.unique(np.uint64(0xABCD) << np.uint64(48) | low)
    cuts = simhash.Cuts(2, 1)
    bands = [fps & np.uint64(sum(1 << b for b in bits)) for bits in cuts.parts]
    shards, todo, deepest = [], [(str(i), fps[band == v]) for i, band in enumerate(bands) for v in np.unique(band)], 0
    while todo:
        path, values = todo.pop()
        if len(values) <= 20 or len(cuts.left(path)) <= 2:
            shards.append(values)
            continue
        for p, keys in cuts.again(values, 7, path):
            todo += [(p, values[keys == k]) for k in np.unique(keys)]
            deepest = max(deepest, p.count("."))
    assert deepest >= 2 and max(map(len, shards)) <= 20
    met = {(int(a), int(b)) for v in shards for a in v for b in v if a < b and int(a ^ b).bit_count() <= 2}
    assert met == {(int(a), int(b)) for a in fps for b in fps if a < b and int(a ^ b).bit_count() <= 2}
    df = spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long")
    found = {r.node: r.root for r in components.components(simhash.links(df, 2, 20)).collect()}
    want = brute_components(list(range(len(fps))), fps, 2)
    mine = [found.get(int(v), int(v)) for v in fps.view(np.int64)]
    assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))


def test_hot_fingerprints_and_hubs(docs_of, spark, monkeypatch):
    """A fingerprint of a third of all rows, and a node with most of the edges, are joined by a broadcast."""
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    monkeypatch.setattr(common, "HOT_KEYS", 5)
    docs = docs_of([(i, None if i % 3 else f"some words of their own number {i} {i * 7} {i * i}", "en", "a") for i in range(90)])
    rows = {r.doc_id: r for r in simhash.clustered(docs).collect()}
    assert len(rows) == 90 and {rows[i].component_id for i in range(90) if i % 3} == {1}
    star = spark.range(1, 200).selectExpr("0L AS a", "id AS b")
    assert {r.root for r in components.components(star).collect()} == {0}
    with pytest.raises(RuntimeError):
        components.components(spark.range(200).selectExpr("id AS a", "id + 1 AS b"), max_rounds=1)


def test_bk_tree_finds_all():
    v = np.unique(np.random.default_rng(1).integers(0, 1 << 12, 1500).astype(np.uint64))
    got = {(int(a), int(b)) for q, n in simhash.BKTree(v).within(v, 2) for a, b in zip(q, n, strict=True)}
    assert got == {(i, int(j)) for i in range(len(v)) for j in np.flatnonzero(np.bitwise_count(v ^ v[i]) <= 2)}


def test_trees_take_all_fingerprints(spark, corpus, monkeypatch):
    """No shard of the corpus is without a tree of a good size, and queries visit a small part of it."""
    fps = np.array([fingerprint(r.text) for r in corpus.select("text").collect()], np.uint64)
    fps = np.unique(fps)
    tree = 50
    cuts = simhash.Cuts(2, 1, simhash.shard_bits(len(fps), tree))
    assert len(cuts.parts) == 3 and all(len(p) == simhash.shard_bits(len(fps), tree) for p in cuts.parts)
    for bits in cuts.parts:
        _, sizes = np.unique(fps & np.uint64(sum(1 << b for b in bits)), return_counts=True)
        assert tree / 4 < len(fps) / len(sizes) <= tree and sizes.max() <= 4 * tree
    v = np.unique(np.random.default_rng(3).integers(0, 1 << 63, simhash.TREE, dtype=np.uint64))
    full = simhash.BKTree(v)
    assert sum(1 for q, n in full.within(v, 2) for a, b in zip(q, n, strict=True) if a == b) == len(v)
    assert full.visited / len(v) < len(v) / 20
    assert [simhash.shard_bits(n, 100) for n in (0, 1, 100, 101, 200, 201, 400, 401)] == [0, 0, 0, 1, 1, 2, 2, 3]
    # many small trees find what one finds
    fps = np.unique(np.concatenate([fps, fps[:40] ^ np.uint64(1), fps[:20] ^ np.uint64(7)]))
    df = common.written(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), "fps")
    roots = []
    for size in (10**9, 20):
        monkeypatch.setattr(simhash, "TREE", size)
        roots.append({r.node: r.root for r in components.components(simhash.links(df)).collect()})
    assert roots[0] == roots[1] and len(roots[0]) >= 80


def test_components_of_a_chain(spark):
    chain = spark.range(200).selectExpr("id AS a", "id + 1 AS b")
    assert {r.root for r in components.components(chain).collect()} == {0}
    assert components.components(chain.limit(0)).count() == 0


def test_one_of_each_group_stays(docs_of):
    base = " ".join(f"word{i}" for i in range(400))
    docs = docs_of([(5, base, "en", "a"), (3, base, "en", "b"), (9, base.replace("word7 ", "other "), "en", "a"), (1, "something else entirely", "en", "a"), (None, base, "en", "a")])
    assert sorted(r.doc_id for r in simhash.deduplicated(docs).collect()) == [1, 3]


def brute_near(rows):
    """Least id of each component of pairs with a Jaccard similarity of 4/5 or more on five-word shingles."""
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := WORD(lower(t or ""))) else frozenset() for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for i, j in links:
        a, b = root(i), root(j)
        up[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), k), k)
    return set(least.values()), links


@pytest.mark.parametrize(("often", "crowd", "radius"), [(1, 20_000, 4), (3, 3, 4), (3, 7, 0)])
def test_near_copies_like_brute_force(docs_of, monkeypatch, often, crowd, radius):
    """All pairs at 0.8 or more are found, none below; whatever counts as frequent or as a crowd, and SimHash proposes."""
    monkeypatch.setattr(near, "OFTEN", often)
    monkeypatch.setattr(near, "CROWD", crowd)
    monkeypatch.setattr(simhash, "DROP_RADIUS", radius)
    monkeypatch.setattr(near, "SAMPLE", 2)
    rnd = random.Random(7)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for base in range(50):
        n = rnd.choice([3, 5, 9, 14, 60, 200, 400])
        words = [f"w{rnd.randint(0, 5000)}" for _ in range(n)]
        if rnd.random() < 0.5:
            words[n // 2 : n // 2] = passage
        for _ in range(4):
            new = list(words)
            for _ in range(rnd.randint(0, max(1, n // 30))):
                new[rnd.randrange(len(new))] = f"x{rnd.randint(0, 10**6)}"
            new = new[: len(new) - rnd.choice([0, 0, n // 20, n // 6])]
            rows.append((len(rows), " ".join(new)))
    # exactly 4/5: 9 shingles, 8 of them in both, of 10
    edge = [f"e{i}" for i in range(13)]
    rows += [(900, " ".join(edge)), (901, " ".join([*edge[:-1], "other"])), (902, " ".join(edge[:12])), (903, "")]
    want, links = brute_near(rows)
    fps = {k: fingerprint(t) for k, t in rows}
    assert sum((fps[rows[i][0]] ^ fps[rows[j][0]]).bit_count() > 4 for i, j in links) > 20
    assert {r.doc_id for r in simhash.deduplicated(docs_of([(k, t, "en", "a") for k, t in rows])).collect()} == want


def test_near_copies_of_the_corpus(corpus, odd):
    want, _ = brute_near([(r.doc_id, r.text) for r in corpus.select("doc_id", "text").collect()])
    assert {r.doc_id for r in simhash.deduplicated(corpus).collect()} == want
    assert sorted(str(r.doc_id) for r in simhash.deduplicated(odd).collect()) == ["1", "3", "5", "7", "None"] and simhash.deduplicated(odd.limit(0)).count() == 0


def test_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    """Copies of one text, most a little below 0.8 of each other: all links that are there, from pairs by the number of copies."""
    rnd = random.Random(11)
    base, rows = [f"w{i}" for i in range(64)], []
    for k in range(400):
        new = list(base)
        for _ in range(rnd.choice([1, 2, 2, 3])):
            new[rnd.randrange(len(new))] = f"x{rnd.randint(0, 10**9)}"
        rows.append((k, " ".join(new[rnd.choice([0, 0, 3]) : len(new) - rnd.choice([0, 0, 2])])))
    tried, real = [], near.verified

    def verified(texts, pairs):
        tried.append(pairs.count())
        return real(texts, pairs)

    monkeypatch.setattr(near, "verified", verified)
    texts = common.written(spark.createDataFrame(rows, "row long, text string").withColumn("sig", F.md5("text").cast("binary")), "texts")
    roots = common.written(spark.createDataFrame([], "node long, root long"), "roots")
    found = near.links(texts, near.prefixes(texts, near.frequent(texts)), roots)
    ends = {r.root for r in components.components(found).collect()} | {k for k, _ in rows} - {e for r in found.collect() for e in r}
    assert ends == brute_near(rows)[0] and 20 < len(ends) < 380
    assert sum(tried) < 5 * len(rows), tried


def brute_ngram(rows, order, prune):
    """Modified Kneser-Ney written out plainly: what test_ngram_like_brute_force compares with."""
    t = [[*WORD(lower(r.text or "")), "\n"] for r in rows]
    held = [zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 == 2 for r in rows]
    train = [x for x, h in zip(t, held, strict=True) if not h]
    c = Counter(w for x in train for w in x)
    total, v = sum(c.values()), len(c)
    padded = lambda x, k: [("",) * max(0, k - 1 - i) + tuple(x[max(0, i - k + 1) : i + 1]) for i in range(len(x))]
    levels = {order: Counter(g for x in train for g in padded(x, order))}
    for k in range(order - 1, 0, -1):  # an n-gram that starts a text keeps its count, others count the words before them
        levels[k] = Counter()
        for g, n in levels[k + 1].items():
            levels[k][g[1:]] += n if g[1] == "" else 1
    d = {k: ngram.discounts([Counter(of.values())[j] for j in (1, 2, 3, 4)]) for k, of in levels.items()}
    behind = {k: defaultdict(list) for k in levels}
    for k, of in levels.items():
        for g, n in of.items():
            behind[k][g[:-1]].append(n)
    gone = lambda n, k: n if prune and k == order and n == 1 else d[k][min(n, 3) - 1]
    sums = {k: {h: (sum(x), sum(gone(n, k) for n in x)) for h, x in of.items()} for k, of in behind.items()}
    rest = sum(d[1][min(n, 3) - 1] for n in levels[1].values()) / sums[1][()][0]

    def p(g):
        """Of the last word of g behind the others."""
        k = len(g)
        n = levels[k][g]
        if k == 1:
            return (n - d[1][min(n, 3) - 1] if n else 0) / sums[1][()][0] + rest / (v + 1)
        if g[:-1] not in sums[k]:
            return p(g[1:])
        total, all_gone = sums[k][g[:-1]]
        return (n - gone(n, k) if n else 0) / total + all_gone / total * p(g[1:])

    for h in [("",) * (order - 1), next(iter(levels[order]))[:-1], *[g[1:] for g in list(levels[order])[50:53] if g[-1] != "\n"]]:
        assert sum(p((*h, w)) for w in c) + p((*h, "unseen word")) == pytest.approx(1)
    out = defaultdict(list)
    for r, x, h in zip(rows, t, held, strict=True):
        base = math.fsum(math.log10((c[w] + 1) / (total + v + 1)) for w in x)
        out[r.doc_id].append((len(x), sum(w in c for w in x), h, total, base, math.fsum(math.log10(p(g)) for g in padded(x, order))))
    return out


@pytest.mark.parametrize(("order", "prune"), [(2, False), (3, False), (3, True), (4, False)])
def test_ngram_like_brute_force(corpus, odd, order, prune):
    for docs in (corpus, odd):
        want = brute_ngram(docs.select("doc_id", "text").collect(), order, prune)
        got = defaultdict(list)
        for r in ngram.score(docs, order=order, prune=prune).collect():
            got[r.doc_id].append((r.n_tokens, r.n_known, r.held_out, r.train_tokens, r.base_score, r.score))
        assert got.keys() == want.keys()
        for k in want:
            for a, b in zip(sorted(got[k]), sorted(want[k]), strict=True):
                assert a == pytest.approx(b, rel=1e-9)


def test_ngram_in_many_shards(corpus, monkeypatch):
    """Some 300 shards of words and as many of n-grams, with most words hot."""
    want = sorted((r.doc_id, r.n_known, round(r.score, 6)) for r in ngram.score(corpus).collect())
    monkeypatch.setattr(ngram, "WORDS_SHARD", 15)
    monkeypatch.setattr(ngram, "GRAMS_SHARD", 120)
    assert corpus.agg(F.sum(F.octet_length("text"))).first()[0] // (6 * 120) > 300
    assert sorted((r.doc_id, r.n_known, round(r.score, 6)) for r in ngram.score(corpus).collect()) == want


def test_ngram_tokens_of_odd_texts():
    """Hashes are equal where the lower-cased words are, long ones and borders included; each text has its end."""
    rnd = random.Random(11)
    parts = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1f", "\x85", "\xa0", "a", "A", "b", "É", "腾", "x" * 1023, "x" * 1024, "y" * 3000, "Y" * 3000, "\0"]
    texts = [None, "", " ", "a"] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(400)]
    h, sizes = ngram.hashed(texts)
    seen, at = {}, 0
    for t, n in zip(texts, sizes, strict=True):
        words = WORD(lower(t or ""))
        assert n == len(words) + 1 and h[at + n - 1] == ngram.END
        for w, x in zip(words, h[at : at + n - 1].tolist(), strict=True):
            assert seen.setdefault(w, x) == x
        at += n
    assert len(set(seen.values()) | {int(ngram.END)}) == len(seen) + 1 and at == len(h)


def test_ngram_shards_are_even():
    """A word that is a third of all is dealt by whole n-grams."""
    rng = np.random.default_rng(5)
    layout = ngram.Layout(1 << 20, 100, np.array([7, 1 << 20]))
    middle = np.where(rng.random(300_000) < 1 / 3, 7, rng.integers(0, 1 << 20, 300_000))
    gram = [rng.integers(0, 1 << 20, 300_000), middle, rng.integers(0, 1 << 20, 300_000)]
    many = np.bincount(layout.shards_of(gram, ngram.keys_of(gram)), minlength=100)
    assert many.max() < 1.2 * many.mean()


def test_columns_as_bytes():
    rng = np.random.default_rng(3)
    for n in (0, 1, 1000):
        cols = [np.sort(rng.integers(0, 1 << 40, n)), rng.integers(0, 3, n), np.zeros(n, np.int64), rng.integers(0, 1 << 62, n)]
        assert all((a == b).all() for a, b in zip(cols, ngram.unpack(ngram.pack(cols), 4), strict=True))


def test_ngram_without_training(spark, docs_of):
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = ngram.score(docs_of([(held, "a b", "en", "a")])).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0.0, 0.0)
    assert ngram.score(docs_of([(1, "a", "en", "a")]).limit(0)).count() == 0


def brute_spans(docs, n=50):
    w = {k: WORD(t or "") for k, t in docs}
    where = defaultdict(set)
    for k, x in w.items():
        for i in range(len(x) - n + 1):
            where[tuple(x[i : i + n])].add(k)
    out = set()
    for k, x in w.items():
        low = high = None
        for i in range(len(x) - n + 1):
            if len(where[tuple(x[i : i + n])]) > 1:
                if low is not None and i <= high:
                    high = i + n
                else:
                    if low is not None:
                        out.add((k, low, high))
                    low, high = i, i + n
        if low is not None:
            out.add((k, low, high))
    return out


def test_repeats_like_brute_force(corpus):
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    got = repeats.spans(corpus).collect()
    assert {(r.doc_id, r.start_word, r.end_word) for r in got} == brute_spans(rows)
    text = dict(rows)
    assert all(WORD(text[r.doc_id][r.start_char : r.end_char]) == WORD(text[r.doc_id])[r.start_word : r.end_word] for r in got)


def test_repeats_of_random_splices(docs_of):
    rnd = random.Random(3)
    pool = [[rnd.choice("abcdefgh") + str(rnd.randint(0, 40)) for _ in range(rnd.randint(20, 90))] for _ in range(12)]
    rows = [(i, " ".join(w for _ in range(rnd.randint(1, 5)) for w in (rnd.choice(pool) if rnd.random() < 0.7 else [str(rnd.random()) for _ in range(30)])), "en", "a") for i in range(80)]
    got = {(r.doc_id, r.start_word, r.end_word) for r in repeats.spans(docs_of(rows), chars=False).collect()}
    assert got == brute_spans([(i, t) for i, t, *_ in rows])


def test_repeats_of_a_hot_passage(docs_of, monkeypatch):
    """A passage that half of the documents have, alone or among other words, met by a broadcast."""
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(common, "HOT_KEYS", 3)
    rnd = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(70))
    other = lambda n: " ".join(str(rnd.random()) for _ in range(n))
    rows = [(i, passage if i % 4 == 0 else f"{other(20)} {passage} {other(30)}" if i % 4 == 1 else other(90), "en", "a") for i in range(60)]
    got = {(r.doc_id, r.start_word, r.end_word) for r in repeats.spans(docs_of(rows), chars=False).collect()}
    assert got == brute_spans([(i, t) for i, t, *_ in rows])


def test_repeats_of_odd_rows(odd, docs_of):
    assert repeats.spans(odd).count() == 0 and repeats.spans(odd.limit(0)).count() == 0
    p = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"a {p} b", "en", "x"), (2, f"{p}", "en", "x"), (3, f"{p} {p}", "en", "x"), (None, f"c {p}", "en", "x"), (4, " ".join(p.split()[:49]), "en", "x")]
    got = sorted((r.doc_id or 0, r.start_word, r.end_word) for r in repeats.spans(docs_of(rows)).collect())
    assert got == [(0, 1, 61), (1, 1, 61), (2, 0, 60), (3, 0, 120)]
    once = docs_of([(3, f"{p} {p}", "en", "x")])
    assert repeats.spans(once.unionByName(once)).count() == 0


def test_pipeline(spark, corpus, sf_dir, coder):
    """Each stage on what its predecessor kept, against a plain version."""
    import corpus_pipeline as c
    from tidewater.llm import mixing, quality, secrets
    from tidewater.llm.common import written

    docs = corpus
    for name, stage in c.STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), "stage")
        assert docs.columns == corpus.columns
        old = {r.doc_id: r.text for r in before.collect()}
        new = docs.collect()
        if name == "quality rules":
            assert {r.doc_id for r in new} == {r.doc_id for r in quality.judged(before).filter("kept").collect()}
        elif name == "near-duplicates":
            assert {r.doc_id for r in new} == brute_near(sorted(old.items()))[0]
        elif name == "secrets":
            found = {r.doc_id: [(s["start"], s["end"]) for s in r.spans] for r in secrets.scanned(before).collect()}
            for r in new:
                marks, at, out = found[r.doc_id], 0, []
                for a, b in marks:
                    out += [old[r.doc_id][at:a]] if a >= at else []
                    at = max(at, b)
                assert r.text == "[secret]".join([*out, old[r.doc_id][at:]]) if marks else r.text == old[r.doc_id]
        else:
            times = Counter(r.doc_id for r in new)
            plan = {r.doc_id: r for r in mixing.plan_mix(before).collect()}
            assert all(times[k] == r.epochs + (r.part > 0 and 2 * r.part >= r.size) if r.size else times[k] == 0 for k, r in plan.items())
            assert all(r.text == old[r.doc_id] for r in new)
    _, sp = coder
    want = Counter((r.doc_id, tuple(sp.encode(r.text))) for r in docs.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in c.sentence_pieces(spark, docs, sf_dir).collect()) == want
    assert c.run(spark, sf_dir).count() == sum(want.values())


def test_whole_table_queries(spark, sf_dir):
    from tidewater.llm.queries import QUERIES

    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in ("op2_media", "op3_pieces", "op5_shard", "op6_simhash", "op7_ngram"):
        assert QUERIES[name](spark, sf_dir).select(F.count("*")).first()[0] == n
    assert QUERIES["op10_repeats"](spark, sf_dir).count() > 0
