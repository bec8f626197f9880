"""SentencePiece (merge type) encoding and decoding with a prefix table.

For every prefix of a word the last token of its encoding is unique. An Aho-Corasick automaton yields the tokens
that end at a character; the one that fits is either the whole prefix, or compatible with the last token of the
prefix before it, where two tokens are compatible if encoding their concatenation gives just these two. That is
decided by undoing merges at the border in order of priority and looking for one that would have crossed it.
Following the last tokens backwards recovers the ids. The time is linear in the text, however long a word is.

Words are independent, since no piece has the space mark behind another character: a run of marks is merged last
and from the left, without the one that the word's first piece takes. Words seen before are looked up in a table
of bounded size. Characters outside the vocabulary become byte pieces. The vocabulary file is read once by the
driver and sent to the workers as bytes (half a megabyte, whatever the input); nothing is trained.

Cases: a null text is an empty one, with no ids; an empty table gives an empty result; null ids, repeated rows and
other columns pass through or are ignored; texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
#: Words in each of the two generations of the table.
TABLE = 80_000
#: Pairs of tokens whose compatibility is kept.
PAIRS = 250_000


class Pieces:
    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i).replace(MARK, " ") for i in range(n)]
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.silent = {i for i in range(n) if sp.is_control(i)}
        self.ids = {sp.id_to_piece(i): i for i in normal}
        if any(MARK in p.lstrip(MARK) or (p[:2] == MARK * 2 and p.strip(MARK)) for p in self.ids):
            raise ValueError("words of this vocabulary are not independent")
        # priority of the merge that makes a piece: the higher score first
        self.score = {i: sp.get_score(i) for i in normal}
        self.rank = {i: r for r, i in enumerate(sorted(normal, key=lambda i: -self.score[i]))}
        self.name = {i: p for p, i in self.ids.items()}
        self.split: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[int, bool] = {}
        automaton = ahocorasick.Automaton()
        words = [p for p in self.ids if p[:2] != MARK * 2]
        for p in sorted(words, key=len):
            parts = self._merge(p)
            if len(parts) == 1:  # a piece that no sequence of merges makes never occurs
                automaton.add_word(p, (self.ids[p], len(p)))
        automaton.make_automaton()
        self.automaton = automaton
        self.new: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}
        self.runs: dict[int, list[int]] = {}

    def _merge(self, s: str) -> list[int]:
        """The merges of a single piece, carried out one by one; notes which two pieces make it."""
        parts = [self.ids.get(c) for c in s]
        if None in parts:
            return parts
        while len(parts) > 1:
            best = None
            for k in range(len(parts) - 1):
                made = self.ids.get(self.name[parts[k]] + self.name[parts[k + 1]])
                if made is not None and (best is None or self.rank[made] < best[0]):
                    best = (self.rank[made], k, made)
            if best is None:
                break
            _, k, made = best
            if len(parts) == 2:
                self.split[made] = (parts[0], parts[1])
            parts[k : k + 2] = [made]
        return parts

    def _compatible(self, left: int, right: int) -> bool:
        """Whether encoding left and right together gives left, right.

        From the last merges back: whichever of the two was made later is undone first, and what then stands at
        the border must not have had a merge of its own that came before that."""
        rank, split, ids, name = self.rank, self.split, self.ids, self.name
        limit = len(rank)
        while True:
            made = ids.get(name[left] + name[right])
            if made is not None and rank[made] < limit:
                return False
            a, b = split.get(left), split.get(right)
            # on equal terms the merge on the left comes first, so one on the right is undone first
            ra, rb = (rank[left] if a else -1), (rank[right] if b else -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, left = ra, a[1]
            else:
                limit, right = rb + 1, b[0]

    def _run(self, n: int) -> list[int]:
        """A run of n space marks: merges of equal priority, the leftmost first."""
        if n in self.runs:
            return self.runs[n]
        ids, size = self.ids, [1] * n
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(-self.score[ids[MARK * 2]], k, 1, 1) for k in range(n - 1)] if MARK * 2 in ids else []
        heapify(queue)
        while queue:
            _, k, a, b = heappop(queue)
            if size[k] != a or (j := after[k]) >= n or size[j] != b:
                continue
            size[k], size[j], after[k] = a + b, 0, after[j]
            if after[k] < n:
                before[after[k]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y < n and (made := ids.get(MARK * (size[x] + size[y]))) is not None:
                    heappush(queue, (-self.score[made], x, size[x], size[y]))
        out = [ids[MARK * x] for x in size if x]
        if n <= 4096:
            self.runs[n] = out
        return out

    def _word(self, s: str) -> list[int]:
        """Ids of a word with at most one space mark, at its front."""
        n = len(s)
        last: list[int | None] = [None] * (n + 1)
        size = [1] * (n + 1)  # of the last token
        fits, compatible = self.fits, self._compatible
        for end, (t, length) in self.automaton.iter(s):
            i = end + 1
            if last[i] is not None:
                continue
            j = i - length
            if j == 0:
                last[i], size[i] = t, length
                continue
            p = last[j]
            if p is None:  # a character outside the vocabulary
                last[i], size[i] = t, length
                continue
            pair = p << 20 | t
            ok = fits.get(pair)
            if ok is None:
                if len(fits) > PAIRS:
                    fits.clear()
                ok = fits[pair] = compatible(p, t)
            if ok:
                last[i], size[i] = t, length
        out, i = [], n
        while i:
            if last[i] is None:
                out.extend(self.bytes[b] for b in reversed(s[i - 1].encode()))
            else:
                out.append(last[i])
            i -= size[i]
        return out[::-1]

    def _entry(self, s: str) -> tuple[tuple[int, ...], str]:
        """Ids of a run of space marks and the word behind it, and the same as text."""
        e = self.old.get(s)
        if e is None:
            word = s.lstrip(MARK)
            n = len(s) - len(word)
            if not word:
                ids = self._run(n)
            else:
                ids = self._word(MARK + word if n else word)
                if n > 1:
                    alone = ids[0] == self.ids.get(MARK)
                    ids = self._run(n) + ids[1:] if alone else self._run(n - 1) + ids
            e = (tuple(ids), ",".join(map(str, ids)))
        if len(s) <= 64:
            if len(self.new) >= TABLE:
                self.old, self.new = self.new, {}
            self.new[s] = e
        return e

    segments = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall

    def encode(self, text: str) -> tuple[list[int], str]:
        """The ids, and the ids as text joined by commas."""
        if not text:
            return [], ""
        new, entry = self.new, self._entry
        entries = []
        for s in self.segments(MARK + text.replace(" ", MARK)):
            e = new.get(s)
            if e is None:
                e = entry(s)
                new = self.new
            entries.append(e)
        return list(chain.from_iterable(e[0] for e in entries)), ",".join([e[1] for e in entries])

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes put together, the first space mark dropped."""
        text, byte_of = self.text, self.byte_of
        if byte_of.keys().isdisjoint(ids) and self.silent.isdisjoint(ids):
            out = "".join(map(text.__getitem__, ids))
        else:
            parts, held = [], bytearray()
            for i in ids:
                if i in byte_of:
                    held.append(byte_of[i])
                    continue
                if held:
                    parts.append(held.decode(errors="replace"))
                    held.clear()
                if i not in self.silent:
                    parts.append(text[i])
            parts.append(held.decode(errors="replace"))
            out = "".join(parts)
        return out[1:] if out.startswith(" ") else out


_LOADED: dict[bytes, Pieces] = {}


def loaded(model: bytes) -> Pieces:
    """The worker's own coder of a vocabulary; it outlives a task."""
    key = hashlib.sha256(model).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces(model)
    return _LOADED[key]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def encoded(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """One row a document: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of
    the text that the ids decode to) and, if asked for, the ids themselves."""
    with open(model_path or default_model(), "rb") as f:  # on the driver
        model = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [coder.encode(t.as_py() or "") for t in part.column(1)]
                cols = [part.column(0), pa.array([len(i) for i, _ in rows], pa.int64()), pa.array([_sha(s) for _, s in rows]), pa.array([_sha(coder.decode(i)) for i, _ in rows])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    cols.append(pa.array([i for i, _ in rows], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    kind = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"`{text_col}` AS text").mapInArrow(run, kind)


def op3_pieces(spark, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), ids=False)
