"""Language-model scoring: an interpolated modified Kneser-Ney model of any order from 2, counted in Spark.

Words are counted first. Their 64-bit hashes, sorted, are the first arrays; a word's id is its place there. Then the
n-grams of the highest order are counted, and each order below from the distinct n-grams of the one above: how many
words stand before an n-gram, and how many, how often, behind it. An n-gram that starts a text has no word before it,
so its own count stands. Every order is one shuffle of counts that were summed batch by batch before, one task a shard,
which writes its n-grams as sorted 64-bit hashes with their counts to the shared folder and passes on what the next
order needs. The driver sees the list of shards and a few sums. Workers map the files into memory: they share them on
a host and page in what they read (a file of a remote store is fetched once to an unlinked temporary file).

An n-gram lies in the shard of its middle word, so that its two parts mostly meet others like them in one task and
sums stay few; those whose middle word is very frequent are dealt by their whole hash, so no shard is large.

Cases: a null text is empty, its only token the end; a null id counts as the empty string in the split; repeated
rows count each time; without training documents all probabilities are those of an empty vocabulary (1); an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, exact, shared_path, written

ORDER = 3
#: Whether n-grams of the highest order that occur once are left out of the arrays; their probability goes to the
#: shorter ones (they still count for discounts and for all orders below).
PRUNE = True
FOLDS, HELD = 7, 2
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Tokens that a task gathers before it passes on their counts, and bytes of texts that it looks at together.
GATHER, SOME = 2_000_000, 1_600_000
#: Distinct words, and tokens, for which there is a shard.
WORDS_SHARD, GRAMS_SHARD = 2_000_000, 1_500_000
#: Shards that a worker keeps mapped.
OPEN = 8192
_C = np.uint64(0xD6E8FEB86659FD93)
_HALF, _LOW = np.uint64(32), np.uint64(0xFFFFFFFF)


# A word's hash is the sum of a number for each byte times a power for its place, mixed; words longer than the powers are
# hashed one by one.
_POWERS = np.cumprod(np.full(1024, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTES[list(_SPACES)] = 0
#: The end of a text as a token.
END = np.uint64(0xE703_7ED1_A0B4_28DB)


def mixed(h: np.ndarray) -> np.ndarray:
    for _ in range(2):
        h ^= h >> _HALF
        h *= _C
    h ^= h >> _HALF
    return h


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of data, lower-cased, and where they start."""
    from xxhash import xxh64_intdigest

    x = np.frombuffer(data, np.uint8)
    value = _BYTES[x]
    word = value != 0
    starts = np.flatnonzero(word & ~np.r_[False, word[:-1]])
    if not len(starts):
        return np.empty(0, np.uint64), starts
    place = np.arange(starts[0], len(x)) - np.repeat(starts, np.diff(np.r_[starts, len(x)]))
    h = np.add.reduceat(value[starts[0] :] * _POWERS[np.minimum(place, len(_POWERS) - 1)], starts - starts[0], dtype=np.uint64)
    ends = np.r_[starts, len(x)]
    for i in np.flatnonzero(np.diff(ends) > len(_POWERS)).tolist():  # with the spaces behind it
        one = data[ends[i] : ends[i + 1]].rstrip(_SPACES)
        if len(one) > len(_POWERS):
            h[i] = xxh64_intdigest(one)
    return mixed(h), starts


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of texts, each with its end, and the number of tokens of each."""
    data = [(t or "").encode().translate(_LOWER) for t in texts]
    ends = np.cumsum([len(d) + 1 for d in data])
    h, starts = words_of(b"\n".join([*data, b""]))
    text = np.searchsorted(ends, starts, "right")
    out = np.full(len(h) + len(texts), END, np.uint64)
    out[np.arange(len(h)) + text] = h
    return out, np.bincount(text, minlength=len(texts)) + 1


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str | None]]:
    """Texts of the column text, about SOME bytes together."""
    texts, n = [], 0
    for batch in batches:
        for t in batch.column(batch.schema.get_field_index("text")).to_pylist():
            texts.append(t)
            n += len(t or "")
            if n >= SOME:
                yield texts
                texts, n = [], 0
    if texts:
        yield texts


def keys_of(gram: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of n-grams, given as a column of ids for each place."""
    h = np.full(len(gram[0]), len(gram), np.uint64)
    for w in gram:
        h *= _C
        h += w.view(np.uint64) if w.dtype == np.int64 else w.astype(np.uint64)
        mixed(h)
    return h


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """By range: shards of sorted keys follow one another."""
    return ((h >> _HALF) * np.uint64(shards) >> _HALF).astype(np.int64)


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the keys, and in it the start of each run of equal ones."""
    order = np.argsort(keys)
    return order, np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]]) if len(keys) else np.empty(0, np.int64)


def runs_of(values: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal neighbours."""
    at = np.flatnonzero(values[1:] != values[:-1]) + 1
    return list(zip([0, *at.tolist()], [*at.tolist(), len(values)], strict=True)) if len(values) else []


def windows(values: np.ndarray, sizes: np.ndarray, order: int, start: int) -> list[np.ndarray]:
    """For each token the value order - 1 tokens before it, and so on to its own; start where its text has none."""
    place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return [np.where(place < back, start, np.roll(values, back)) for back in range(order - 1, -1, -1)]


# Columns of whole numbers as bytes: planes of equal significance lie together, and the first column, which ascends, as
# differences, so that the codec of the shuffle finds runs.


def pack(cols: list[np.ndarray | None]) -> bytes:
    """None stands for zeros."""
    planes, widths = [], []
    for c in (np.diff(cols[0], prepend=0), *cols[1:]):
        width = (int(c.max(initial=0)).bit_length() + 7) // 8 if c is not None else 0
        widths.append(width)
        if width:
            planes.append(c.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    return len(cols[0]).to_bytes(8, "little") + bytes(widths) + b"".join(planes)


def unpack(data: bytes, cols: int) -> list[np.ndarray]:
    n, at = int.from_bytes(data[:8], "little"), 8 + cols
    out = []
    for width in data[8:at]:
        c = np.zeros((n, 8), np.uint8)
        c[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
        at += n * width
        out.append(c.reshape(-1).view("<i8"))
    out[0] = np.cumsum(out[0])
    return out


BLOB = "shard int, data binary"


def blobs(shards: np.ndarray, cols: list[np.ndarray | None], by: int) -> pa.RecordBatch:
    """One row a shard with its part of the columns, ascending by one of them, which comes first in it."""
    place = shards * (int(cols[by].max(initial=0)) + 1) + cols[by]
    order = np.argsort(place, kind="stable" if (place[1:] < place[:-1]).mean() < 0.1 else None) if len(place) > 1 else slice(None)
    shards, cols = shards[order], [None if c is None else c[order] for c in (cols[by], *cols[:by], *cols[by + 1 :])]
    runs = runs_of(shards)
    data = [pack([None if c is None else c[low:high] for c in cols]) for low, high in runs]
    return pa.RecordBatch.from_arrays([pa.array([int(shards[low]) for low, _ in runs], pa.int32()), pa.array(data, pa.binary())], ["shard", "data"])


def unblobbed(batches: Iterator[pa.RecordBatch], cols: int, by: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(shard, columns) of a task's shards, which is one."""
    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for s, d in zip(batch.column("shard").to_pylist(), batch.column("data").to_pylist(), strict=True):
            held.setdefault(s, []).append(d)
    for s in sorted(held):
        first, *rest = (np.concatenate(c) for c in zip(*[unpack(d, cols) for d in held.pop(s)], strict=True))
        yield s, [*rest[:by], first, *rest[by:]]


def coded(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of small numbers as places in a table of the different ones."""
    if len(cols) == 1 and 0 <= cols[0].min(initial=0) and cols[0].max(initial=0) < 1 << 16:
        there = np.flatnonzero(np.bincount(cols[0]))
        places = np.zeros(1 << 16, np.int64)
        places[there] = np.arange(len(there))
        code, table = places[cols[0]], there[None]
    else:
        order, starts = groups(keys_of(cols))
        code = np.empty(len(order), np.int64)
        code[order] = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(order)]))
        table = np.stack([c[order[starts]] for c in cols]) if len(starts) else np.zeros((len(cols), 0), np.int64)
    n = table.shape[1]
    return code.astype(np.uint8 if n <= 1 << 8 else np.uint16 if n <= 1 << 16 else np.uint32), table


def save(path: str, **arrays: np.ndarray) -> str:
    """Arrays as files path/<new name>.<array>.npy; the name. A repeated task writes other names."""
    from pyarrow.fs import FileSystem

    fs, root = FileSystem.from_uri(path)
    fs.create_dir(root, recursive=True)
    name = uuid.uuid4().hex
    for key, a in arrays.items():
        a = np.ascontiguousarray(a)
        with fs.open_output_stream(f"{root}/{name}.{key}.npy", compression=None) as f:
            head = io.BytesIO()
            np.lib.format.write_array_header_1_0(head, np.lib.format.header_data_from_array_1_0(a))
            f.write(head.getvalue())
            f.write(memoryview(a.reshape(-1)).cast("B"))
    return name


def mapped(path: str, name: str, key: str) -> np.ndarray:
    import tempfile

    from pyarrow.fs import FileSystem, LocalFileSystem

    fs, root = FileSystem.from_uri(path)
    at = f"{root}/{name}.{key}.npy"
    if fs.get_file_info(at).size <= 4096:
        return np.load(io.BytesIO(fs.open_input_stream(at, compression=None).read()))
    if isinstance(fs, LocalFileSystem):
        return np.load(at, mmap_mode="r")
    with tempfile.NamedTemporaryFile(suffix=".npy") as copy:  # gone from the folder at once, mapped as long as needed
        with fs.open_input_stream(at, compression=None) as f:
            while part := f.read(8 << 20):
                copy.write(part)
        copy.flush()
        return np.load(copy.name, mmap_mode="r")


class Words:
    """Ids of words, by the mapped arrays of hashes; listed: (shard, name, words) in order."""

    def __init__(self, path: str, listed: list[tuple[int, str, int]], shards: int, start: int):
        self.path, self.shards, self.start = path, shards, start
        self.names = {s: name for s, name, _ in listed}
        self.firsts = np.cumsum([0, *[n for _, _, n in listed]])[:-1]
        self.first = dict(zip(self.names, self.firsts.tolist(), strict=True))
        self.hashes: dict[int, np.ndarray] = {}

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Of ascending hashes; -1 for unknown words."""
        out = np.full(len(h), -1, np.int64)
        for low, high in runs_of(shard_of(h, self.shards)):
            s = int(shard_of(h[low : low + 1], self.shards)[0])
            if s in self.names:
                if s not in self.hashes:
                    self.hashes[s] = mapped(self.path, self.names[s], "key")
                keys = self.hashes[s]
                i = np.minimum(np.searchsorted(keys, h[low:high]), len(keys) - 1)
                hit = np.flatnonzero(keys[i] == h[low:high])
                out[low + hit] = self.first[s] + i[hit]
        return out

    def lookup(self, h: np.ndarray) -> dict[str, np.ndarray]:
        """What is kept for the words of these hashes."""
        different, place = np.unique(h, return_inverse=True)
        return {k: v[place] for k, v in self.values(self.ids(different)).items()}

    def values(self, ids: np.ndarray) -> dict[str, np.ndarray]:
        return {"id": ids}

    def shard_of_ids(self, ids: np.ndarray) -> np.ndarray:
        """Numbers, in order, of the shards that ids are in; the start's is the last."""
        return np.maximum(np.searchsorted(self.firsts, ids, "right") - 1, 0)


def discounts(n: list[int]) -> list[float]:
    """Discounts of counts 1, 2 and 3 or more, from how many n-grams have counts 1 to 4."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return [0.5, 0.75, 1.0]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2 if n3 else 1.0, 3 - 4 * y * n4 / n3 if n3 and n4 else 1.5]
    return [min(max(v, 0.1), top) for v, top in zip(d, (0.95, 1.9, 2.8), strict=True)]


def cut(count: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(count, 3)]


class Layout:
    """Where n-grams lie: by the id of their middle word, or by their key where that word (or the start) is hot."""

    def __init__(self, vocabulary: int, shards: int, hot: np.ndarray):
        self.start, self.shards, self.hot = vocabulary, shards, hot

    def shards_of(self, gram: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
        middle = gram[self.middle(len(gram))]
        at = np.minimum(np.searchsorted(self.hot, middle), len(self.hot) - 1)
        return np.where(self.hot[at] == middle, shard_of(keys, self.shards), middle * self.shards // (self.start + 1))

    @staticmethod
    def middle(order: int) -> int:
        return (order - 1) // 2


#: What a context has: the sum of counts behind it, the weight of the shorter n-grams, whether the arrays have any behind it.
CONTEXT = ("total", "back", "children")


class Model(Words):
    """levels: for each order from 1, {shard: name}; d: for each order from 1 its discounts."""

    def __init__(self, words: tuple, layout: Layout, levels: list[dict[int, str]], d: list[list[float]], uniform: float, total: int, prune: bool):
        super().__init__(*words)
        self.layout, self.levels, self.d, self.uniform, self.total, self.prune = layout, levels, d, uniform, total, prune
        self.open: dict[tuple[int, int], tuple] = {}
        # of the contexts that start a text: sum of counts behind it, and weight of the shorter n-grams
        begin = [np.array([self.start], np.int64)]
        self.begins = [tuple(self.values(begin[0])[k][0] for k in CONTEXT)]
        for k in range(2, len(levels)):
            self.begins.append(tuple(v[0] for v in self.find(k, begin * k)[1:]))

    def shard(self, level: int, s: int) -> tuple:
        """keys, codes, and by code count, total, back and children."""
        if (level, s) not in self.open:
            if len(self.open) > OPEN:
                self.open.clear()
            name = self.levels[level - 1][s]
            table = mapped(self.path, name, "table")
            count, values = table[0], [table[0]]
            if level < len(self.levels):
                d = self.d[level]  # of the order above
                d1 = 1.0 if self.prune and level + 1 == len(self.levels) else d[0]
                total, n1, n2, n3 = table[-4:]
                back = np.where(total > 0, (d1 * n1 + d[1] * n2 + d[2] * n3) / np.maximum(total, 1), 1.0)
                # with children in the arrays of the order above
                values = [count, total, back, total > (n1 if self.prune and level + 1 == len(self.levels) else 0)]
            if level == 1:
                words, before = table[:2]
                values = [words, np.maximum(before - cut(before, self.d[0]), 0) / max(self.total, 1) + self.uniform, *values[1:]]
            self.open[level, s] = (mapped(self.path, name, "key") if level > 1 else None, mapped(self.path, name, "code"), *values)
        return self.open[level, s]

    def values(self, ids: np.ndarray) -> dict[str, np.ndarray]:
        n = len(ids)
        out = {"id": ids, "count": np.zeros(n, np.int64), "low": np.full(n, self.uniform), "total": np.zeros(n, np.int64), "back": np.ones(n), "children": np.zeros(n, bool)}
        where = np.where(ids >= 0, self.shard_of_ids(ids), -1)
        for s in set(where.tolist()).intersection(self.levels[0]):
            own = np.flatnonzero(where == s)
            _, codes, *values = self.shard(1, s)
            code = codes[ids[own] - self.firsts[s]]
            for name, v in zip(("count", "low", "total", "back", "children"), values, strict=True):
                out[name][own] = v[code]
        return out

    def find(self, level: int, gram: list[np.ndarray], asked: np.ndarray | None = None) -> list[np.ndarray]:
        """Of n-grams (or those asked for): count, and below the highest order total, back and children as contexts."""
        n = len(gram[0])
        out = [np.zeros(n, np.int64)]
        if level < len(self.levels):
            out += [np.zeros(n, np.int64), np.ones(n), np.zeros(n, bool)]
        known = np.minimum.reduce(gram) >= 0
        known = np.flatnonzero(known if asked is None else known & asked)
        gram = [w[known] for w in gram]
        keys = keys_of(gram)
        where = self.layout.shards_of(gram, keys)
        # few enough shards are sorted by radix
        order = np.argsort(where.astype(np.uint16) if self.layout.shards <= 1 << 16 else where, kind="stable")
        keys, where, known = keys[order], where[order], known[order]
        for low, high in runs_of(where):
            s = int(where[low])
            if s not in self.levels[level - 1]:
                continue
            stored, codes, *values = self.shard(level, s)
            if len(stored):
                by = np.argsort(keys[low:high])
                own = keys[low:high][by]
                i = np.minimum(np.searchsorted(stored, own), len(stored) - 1)
                hit = np.flatnonzero(stored[i] == own)
                code, at = codes[i[hit]], known[low:high][by[hit]]
                for o, v in zip(out, values, strict=True):
                    o[at] = v[code]
        return out

    def score(self, texts: list[str | None], base: float) -> list[np.ndarray]:
        """Of each text: tokens, known ones, base score and log10 probability."""
        h, sizes = hashed(texts)
        firsts = np.cumsum(sizes) - sizes
        local = self.lookup(h)

        def before(v: np.ndarray, start) -> np.ndarray:
            out = np.roll(v, 1)
            out[firsts] = start
            return out

        p, context = local["low"], [before(local[k], b) for k, b in zip(CONTEXT, self.begins[0], strict=True)]
        for level in range(2, len(self.levels) + 1):
            total, back, children = context
            asked = children if level == len(self.levels) else None  # below, all are contexts
            count, *values = self.find(level, windows(local["id"], sizes, level, self.start), asked)
            p = np.where(total > 0, np.maximum(count - cut(count, self.d[level - 1]), 0) / np.maximum(total, 1) + back * p, p)
            context = [before(v, b) for v, b in zip(values, self.begins[level - 1], strict=True)] if values else []
        sums = lambda v: np.add.reduceat(v, firsts)
        return [sizes, sums((local["count"] > 0).astype(np.int64)), sums(np.log10((local["count"] + 1) / base)), sums(np.log10(p))]


#: The worker's own model; it outlives a task.
_LOADED: dict[str, Words] = {}


def loaded(key: str, make) -> Words:
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = make()
    return _LOADED[key]


def _words(train: DataFrame, path: str, shards: int, hot: int) -> list[dict]:
    """Counts the words; a row a shard: shard, name, n (words), total, and the places of its hot words."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[np.ndarray]) -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            # shards are ranges of the upper half
            return blobs(shard_of(h, shards), [(h >> _HALF).astype(np.int64), (h & _LOW).astype(np.int64), n], 0)

        held, n = [], 0
        for texts in gathered(batches):
            held.append(hashed(texts)[0])
            n += len(held[-1])
            if n >= GATHER:
                yield out(held)
                held, n = [], 0
        if held:
            yield out(held)

    kinds = pa.schema([("shard", pa.int32()), ("name", pa.string()), ("n", pa.int64()), ("total", pa.int64()), ("hot", pa.list_(pa.int64()))])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, (upper, lower, n) in unblobbed(batches, 3, 0):
            h = upper.astype(np.uint64) << _HALF | lower.astype(np.uint64)
            order, starts = groups(h)
            counts = np.add.reduceat(n[order], starts)
            name = save(path, key=h[order][starts], count=counts)
            row = {"shard": s, "name": name, "n": len(counts), "total": int(counts.sum()), "hot": np.flatnonzero(counts > hot).tolist()}
            yield pa.RecordBatch.from_pylist([row], kinds)

    dealt = train.mapInArrow(counted, BLOB).repartitionById(shards, F.col("shard"))
    rows = written(dealt.mapInArrow(write, "shard int, name string, n bigint, total bigint, hot array<bigint>"), "ngram-words")
    return sorted((r.asDict() for r in rows.collect()), key=lambda r: r["shard"])


LISTED = "shard int, data binary, name string, grams bigint, total bigint, n1 bigint, n2 bigint, n3 bigint, n4 bigint"
_LISTED = pa.schema([("shard", pa.int32()), ("data", pa.binary()), ("name", pa.string()), *[(c, pa.int64()) for c in ("grams", "total", "n1", "n2", "n3", "n4")]])


def listing(shard: int, name: str, count: np.ndarray) -> pa.RecordBatch:
    row = {"shard": shard, "data": None, "name": name, "grams": int((count > 0).sum()), "total": int(count.sum())}
    return pa.RecordBatch.from_pylist([row | {f"n{k}": int((count == k).sum()) for k in (1, 2, 3, 4)}], _LISTED)


def parts(gram: list[np.ndarray], count: np.ndarray, start: int) -> Iterator[list[np.ndarray | None]]:
    """Of distinct n-grams, their first words and then their last, in order where the ids allow it: columns of the shorter
    n-grams, and for each its count (words before it, or how often it starts a text), and of those behind it the sum of
    counts and how many have 1, 2 and more. None stands for zeros."""
    if not count.all():  # contexts only
        real = np.flatnonzero(count)
        gram, count = [w[real] for w in gram], count[real]
    k = len(gram) - 1
    powers = [(start + 1) ** i for i in range(k)][::-1]
    order_of = lambda g: groups(sum(w * p for w, p in zip(g, powers, strict=True)) if (start + 1) ** k < 1 << 63 else keys_of(g))
    order, starts = order_of(gram[:-1])
    sums = lambda x: np.add.reduceat(x, starts, dtype=np.int64) if len(starts) else count
    c = count[order]
    total, ones, twos = sums(c), sums(c == 1), sums(c == 2)
    pick = order[starts]
    yield [*[w[pick] for w in gram[:-1]], None, total, ones, twos, np.diff(np.r_[starts, len(c)]) - ones - twos]
    order, starts = order_of(gram[1:])
    pick = order[starts]
    last = [w[pick] for w in gram[1:]]
    before = np.diff(np.r_[starts, len(order)])
    if k > 1:
        before = np.where(last[0] == start, sums(count[order]), before)
    yield [*last, before, None, None, None, None]


def train_model(train: DataFrame, order: int, prune: bool) -> tuple:
    """Counts, writes the arrays and returns what makes a Model of them: its arguments, and tokens and words."""
    if order < 2:
        raise ValueError("the order is 2 at least")
    path = shared_path(train.sparkSession, "ngram")
    n_bytes = max(1, train.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    word_shards = max(1, n_bytes // (6 * 8 * WORDS_SHARD))  # a word in eight is new at most
    shards = max(1, n_bytes // (6 * GRAMS_SHARD))
    listed = _words(train, path, word_shards, GRAMS_SHARD // 4)
    n_tokens, vocabulary = sum(r["total"] for r in listed), sum(r["n"] for r in listed)
    words = (path, [(r["shard"], r["name"], r["n"]) for r in listed], word_shards, vocabulary)
    firsts = Words(*words).first
    # at most 4 hot words a shard of tokens; the start is one
    hot = np.array(sorted([vocabulary, *[firsts[r["shard"]] + i for r in listed for i in r["hot"]]]), np.int64)
    layout = Layout(vocabulary, shards, hot)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = loaded(f"{path} words", lambda: Words(*words))

        def out(ids: list[np.ndarray], sizes: list[np.ndarray]) -> pa.RecordBatch:
            gram = windows(np.concatenate(ids), np.concatenate(sizes), order, vocabulary)
            keys = keys_of(gram)
            by, starts = groups(keys)
            pick = by[starts]
            gram = [w[pick] for w in gram]
            return blobs(layout.shards_of(gram, keys[pick]), [*gram, np.diff(np.r_[starts, len(by)])], layout.middle(order))

        ids, sizes, n = [], [], 0
        for texts in gathered(batches):
            h, size = hashed(texts)
            ids.append(m.lookup(h)["id"])
            sizes.append(size)
            n += len(h)
            if n >= GATHER:
                yield out(ids, sizes)
                ids, sizes, n = [], [], 0
        if ids:
            yield out(ids, sizes)

    def reduce(level: int):
        top = level == order

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for s, cols in unblobbed(batches, level + (1 if top else 5), layout.middle(level)):
                keys = keys_of(cols[:level])
                by, starts = groups(keys)
                gram, keys = [w[by[starts]] for w in cols[:level]], keys[by[starts]]
                values = [np.add.reduceat(v[by], starts) for v in cols[level:]]
                del cols, by, starts
                keep = np.flatnonzero(values[0] > 1) if top and prune else slice(None)
                code, table = coded([v[keep] for v in values])
                yield listing(s, save(path, key=keys[keep], code=code, table=table), values[0])
                for cols in parts(gram, values[0], vocabulary):
                    shorter = cols[: level - 1]
                    where = layout.shards_of(shorter, keys_of(shorter)) if level > 2 else Words(*words).shard_of_ids(shorter[0])
                    b = blobs(where, cols, layout.middle(level - 1))
                    none = [pa.nulls(b.num_rows, f.type) for f in list(_LISTED)[2:]]
                    yield pa.RecordBatch.from_arrays([*b.columns, *none], schema=_LISTED)

        return run

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The order 1, by id; the start's row is the last."""
        m = Words(*words)
        for s, (ids, *values) in unblobbed(batches, 6, 0):
            _, name, size = words[1][s]
            size += s == len(words[1]) - 1
            by, starts = groups(ids)
            rows = [np.zeros(size, np.int64) for _ in values]
            at = ids[by[starts]] - m.firsts[s]
            for r, v in zip(rows, values, strict=True):
                r[at] = np.add.reduceat(v[by], starts)
            raw = np.zeros(size, np.int64)
            raw[: words[1][s][2]] = mapped(path, name, "count")
            code, table = coded([raw, *rows])
            yield listing(s, save(path, code=code, table=table), rows[0])

    levels, d, rows = [], [], train.mapInArrow(counted, BLOB)
    for level in range(order, 0, -1):
        n = shards if level > 1 else max(1, len(listed))
        done = written(rows.repartitionById(n, F.col("shard")).mapInArrow(reduce(level) if level > 1 else write_words, LISTED), f"ngram-{level}")
        if level < order:
            dropped(above)
        own = done.filter("name IS NOT NULL").drop("data").collect()  # a row a shard
        levels.insert(0, {r["shard"]: r["name"] for r in own})
        d.insert(0, discounts([sum(r[f"n{k}"] for r in own) for k in (1, 2, 3, 4)]))
        above, rows = done, done.filter("data IS NOT NULL").select("shard", "data")
    n1, n2, n = (sum(r[c] for r in own) for c in ("n1", "n2", "grams"))
    total = sum(r["total"] for r in own)
    rest = (d[0][0] * n1 + d[0][1] * n2 + d[0][2] * (n - n1 - n2)) / total if total else 1.0
    return (words, layout, levels, d, rest / (vocabulary + 1), total, prune), n_tokens, vocabulary


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, prune: bool = PRUNE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Trains on the documents whose crc32 of the id as text is not HELD mod FOLDS."""
    held = F.crc32(F.coalesce(exact(id_col).cast("string"), F.lit(""))) % FOLDS == HELD
    rows = docs.select(exact(id_col).cast("bigint").alias("doc_id"), exact(text_col).alias("text"), held.alias("held_out"))
    made, n_tokens, vocabulary = train_model(rows.filter("NOT held_out").select("text"), order, prune)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = loaded(made[0][0], lambda: Model(*made))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = np.cumsum([0, *[len(t or "") for t in texts]])
            low = 0
            while low < len(texts):
                high = max(low + 1, int(np.searchsorted(at, at[low] + SOME, "right")) - 1)
                n, known, base, own = m.score(texts[low:high], n_tokens + vocabulary + 1)
                part = batch.slice(low, high - low)
                cols = [n, known, np.full(len(n), n_tokens), base, own]
                names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *map(pa.array, cols)], names)
                low = high

    kind = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return rows.mapInArrow(run, kind)


def op7_ngram(spark, sf_dir: str) -> DataFrame:
    """All documents scored by a model of the training folds."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
