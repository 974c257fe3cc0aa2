"""BPE encoding and decoding with a published vocabulary.

Merges of a piece come off a priority queue of merge ranks over a doubly linked list of symbols;
entries whose symbols have meanwhile changed are stale and skipped. Decoding concatenates the
vocabulary strings. The vocabulary file is a parameter and is read where the tasks run.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumenvec.llm._bytes import LOWER, slices, small_batches, word_hashes, words

#: Words whose encoding a worker keeps (about 200 bytes a word).
KEPT_WORDS = 250_000

#: Longest pieces that are merged in step, by class of length; others one by one. What stands for no merge.
PIECE_BYTES, NO_MERGE = (1, 8, 16, 32), np.iinfo(np.int64).max

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _char_class(major: str) -> str:
    """The inside of a regex class with all characters of a Unicode major category."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == major
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}" if c - 1 > start else f"\\U{start:08x}")
            start = None
    return "".join(out)


#: Unicode's White_Space property.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte: itself if printable in Latin-1, else from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Memo(dict):
    """Word to encoded string; encodes on a miss."""

    def __init__(self, owner: Bpe, part: int):
        self.owner, self.part = owner, part

    def __missing__(self, word: str) -> str:
        return self.owner.fill(word)[self.part]


class Bpe:
    """The tokenizer of one vocabulary file (BPE with an end-of-word suffix, byte-level pieces)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        model = j["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in j["added_tokens"]}
        self.strings = {i: s for s, i in (self.vocab | self.special).items()}
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(self.vocab[a] << 20 | self.vocab[b], rank << 20 | self.vocab[a + b])
        own = _byte_chars()
        self.inner = [self.vocab[own[b]] for b in range(256)]
        self.final = [self.vocab[own[b] + self.suffix] for b in range(256)]
        letter, number = _char_class("L"), _char_class("N")
        self.odd = re.compile("[\x1c-\x1f]")
        self.pattern = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{_WHITE}{letter}{number}]+")
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.ids, self.toks = _Memo(self, 0), _Memo(self, 1)
        self._tables()

    def _tables(self) -> None:
        """The merges as sorted arrays, and those of two bytes (256 more: a byte that ends a piece) by both."""
        keys = np.fromiter(self.merges, np.int64, len(self.merges))
        order = np.argsort(keys)
        self.pairs = np.concatenate([keys[order], [np.iinfo(np.int64).max]])
        self.results = np.concatenate([np.fromiter(self.merges.values(), np.int64, len(keys))[order], [NO_MERGE]])
        self.bytes = np.array(self.inner + self.final, np.int64)
        self.of_bytes = self.look_up(self.bytes[:, None] << 20 | self.bytes[None, :])

    def look_up(self, pairs: np.ndarray) -> np.ndarray:
        """The merge of each pair of symbols, NO_MERGE if there is none."""
        at = np.searchsorted(self.pairs, pairs)
        return np.where(self.pairs[at] == pairs, self.results[at], NO_MERGE)

    def merge_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after another, offsets of each piece): what `merge` gives, many pieces in step."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        least = 0
        for most in PIECE_BYTES:
            at = np.flatnonzero((size > least) & (size <= most))
            if len(at):
                self._merge_rows(np.frombuffer(b"".join([pieces[i].ljust(most, b"\0") for i in at.tolist()]), np.uint8).reshape(-1, most), size[at], at, done)
            least = most
        for i in np.flatnonzero(size > least).tolist():
            done.append((np.array([i]), np.array([self.merge(pieces[i].decode("utf-8", "surrogatepass"))], np.int64)))
        counts = np.zeros(len(pieces), np.int64)
        for at, ids in done:
            counts[at] = (ids >= 0).sum(1)
        offsets = np.concatenate([[0], np.cumsum(counts)])
        out = np.zeros(offsets[-1], np.int64)
        for at, ids in done:
            there = ids >= 0
            out[(offsets[at][:, None] + np.arange(ids.shape[1]))[there]] = ids[there]
        return out, offsets

    def _merge_rows(self, raw: np.ndarray, size: np.ndarray, at: np.ndarray, done: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """A row a piece: every round merges the pair of each row that comes first by rank, then from the left, until none is left."""
        n = raw.shape[1]
        where = np.arange(n)
        code = raw.astype(np.int64)
        code[np.arange(len(raw)), size - 1] += 256
        # symbols with a -1 at the end, and the merge of each with the next one
        syms = np.full((len(raw), n + 1), -1)
        syms[:, :n] = np.where(where < size[:, None], self.bytes[code], -1)
        found = np.full((len(raw), n), NO_MERGE)
        found[:, : n - 1] = np.where(where[1:] < size[:, None], self.of_bytes[code[:, :-1], code[:, 1:]], NO_MERGE)
        while len(at):
            best = found.argmin(1)
            merge = found[np.arange(len(at)), best]
            more = merge != NO_MERGE
            if not more.all():
                done.append((at[~more], syms[~more, :n]))
                at, syms, found, best, merge = at[more], syms[more], found[more], best[more], merge[more]
            row = np.arange(len(at))
            after = where > best[:, None]
            syms[:, :n] = np.where(after, syms[:, 1:], syms[:, :n])
            syms[row, best] = merge & 0xFFFFF
            found[:, : n - 1] = np.where(after[:, : n - 1], found[:, 1:], found[:, : n - 1])
            own, right = syms[row, best], syms[row, best + 1]
            found[row, best] = np.where(right >= 0, self.look_up(own << 20 | np.maximum(right, 0)), NO_MERGE)
            inner = np.flatnonzero(best)
            found[inner, best[inner] - 1] = self.look_up(syms[inner, best[inner] - 1] << 20 | own[inner])

    def fill(self, word: str) -> tuple[str, str]:
        """Encodes a word without white space; no piece crosses white space, so words can be kept whole."""
        if len(self.ids) >= KEPT_WORDS:
            self.ids.clear()
            self.toks.clear()
        ids = [i for piece in self.pattern.findall(word) for i in self.merge(piece)]
        got = " ".join(map(str, ids)), " ".join([self.strings[i] for i in ids])
        if len(word) < 64:
            self.ids[word], self.toks[word] = got
        return got

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece."""
        raw = piece.encode("utf-8", "surrogatepass")
        inner = self.inner
        syms = [inner[b] for b in raw]
        syms[-1] = self.final[raw[-1]]
        n = len(syms)
        if n == 1:
            return syms
        get = self.merges.get
        heap = []
        for i in range(n - 1):
            m = get(syms[i] << 20 | syms[i + 1])
            if m is not None:
                heap.append(m << 32 | i)
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            e = heappop(heap)
            i, m = e & 0xFFFFFFFF, e >> 32
            a, j = syms[i], after[i]
            if a < 0 or j >= n or get(a << 20 | syms[j]) != m:
                continue  # stale
            syms[i] = s = m & 0xFFFFF
            syms[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                m = get(s << 20 | syms[k])
                if m is not None:
                    heappush(heap, m << 32 | i)
            p = before[i]
            if p >= 0:
                m = get(syms[p] << 20 | s)
                if m is not None:
                    heappush(heap, m << 32 | p)
        return [s for s in syms if s >= 0]

    @staticmethod
    def normalize(text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            text = text.replace("Σ", "σ")  # lower case without regard to the word's end
        return text.lower()

    def words(self, text: str) -> list[str]:
        text = self.normalize(text)
        if self.odd.search(text):  # split() takes these for white space, the pattern doesn't
            return self.pattern.findall(text)
        return text.split()

    def encode_strings(self, text: str) -> tuple[str, str]:
        """Ids joined by spaces, and the vocabulary strings joined by spaces (this format's decoding)."""
        if self.split_special is None or "<|" not in text and not self.split_special.search(text):
            words = self.words(text)
            return " ".join(map(self.ids.__getitem__, words)), " ".join(map(self.toks.__getitem__, words))
        ids, toks = [], []
        for part in self.split_special.split(text):
            if part in self.special:
                ids.append(str(self.special[part]))
                toks.append(part)
            elif part:
                words = self.words(part)
                ids += map(self.ids.__getitem__, words)
                toks += map(self.toks.__getitem__, words)
        return " ".join(ids), " ".join(toks)

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.encode_strings(text)[0].split(" ") if x]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.strings[i] for i in ids)


@cache
def load(path: str) -> Bpe:
    return Bpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every text.

    A null or empty text has no ids and decodes to an empty string; every row of `docs` gives one
    row, repeated rows too; other columns of `docs` are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path or default_path())
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                got = [bpe.encode_strings(t or "") for t in part.column(1).to_pylist()]
                ids = pa.array([[int(x) for x in g[0].split(" ")] if g[0] else [] for g in got], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array([g[1] for g in got], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(docs["doc_id"].cast("bigint"), docs["text"].cast("string")).mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")


class _Pool:
    """By hash of a word, its ids and its vocabulary strings as bytes, each followed by a space."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        ids = range(max(bpe.strings, default=-1) + 1)
        self.strings = []
        # of each id its number and its vocabulary string, with the space that follows
        for every in ([b"%d " % i for i in ids], [bpe.strings.get(i, "").encode() + b" " for i in ids]):
            size = np.fromiter(map(len, every), np.int64, len(every))
            self.strings.append((np.frombuffer(b"".join(every), np.uint8), np.cumsum(size) - size, size))
        self.clear()

    def clear(self) -> None:
        self.slot: dict[int, int] = {}
        self.size = np.zeros((2, 1 << 16), np.int64)
        self.start = np.zeros((2, 1 << 16), np.int64)
        self.count = np.zeros(1 << 16, np.int64)
        self.bytes = [bytearray(), bytearray()]

    def add(self, hashes: list[int], new: list[bytes]) -> None:
        """Words that aren't there yet; their pieces are merged together."""
        pieces = [self.bpe.pattern.findall(w.decode("utf-8", "replace")) for w in new]
        ids, at = self.bpe.merge_all([p.encode("utf-8", "surrogatepass") for x in pieces for p in x])
        at = at[np.concatenate([[0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(new)))])]
        k = len(self.slot)
        while k + len(new) > len(self.count):
            self.size, self.start, self.count = (np.concatenate([x, np.zeros_like(x)], -1) for x in (self.size, self.start, self.count))
        here = slice(k, k + len(new))
        self.slot.update(zip(hashes, range(k, k + len(new))))
        self.count[here] = np.diff(at)
        for part, (data, start, size) in enumerate(self.strings):
            ends = np.concatenate([[0], np.cumsum(size[ids])])
            own = ends[at]
            self.start[part, here], self.size[part, here] = len(self.bytes[part]) + own[:-1], np.diff(own)
            self.bytes[part] += data[np.repeat(start[ids] - ends[:-1], size[ids]) + np.arange(ends[-1])].tobytes()

    def slots(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        hashes = word_hashes(data, starts, ends)
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.slot) + len(unique) > max(KEPT_WORDS, len(unique)):
            self.clear()
        found = list(map(self.slot.get, keys := unique.tolist()))
        new = [k for k, s in enumerate(found) if s is None]
        if new:
            n = len(self.slot)
            at, to = starts[first[new]].tolist(), ends[first[new]].tolist()
            raw = data.tobytes()
            self.add([keys[k] for k in new], [raw[a:b] for a, b in zip(at, to)])
            for i, k in enumerate(new, n):
                found[k] = i
        return np.array(found, np.int64)[inverse]

    def joined(self, part: int, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of these words one after another, and the offset of each word."""
        size = self.size[part, slots]
        at = np.concatenate([[0], np.cumsum(size)])
        where = np.repeat(self.start[part, slots] - at[:-1], size)
        where += np.arange(at[-1])
        return np.frombuffer(self.bytes[part], np.uint8)[where], at


@cache
def _pool(path: str) -> _Pool:
    return _Pool(load(path))


def digest_batch(texts: pa.Array, path: str) -> tuple[list[int], list[str], list[str]]:
    pool, bpe, sha = _pool(path), load(path), hashlib.sha256
    n, ids, decoded = [], [], []
    for lo, hi, data, offsets in slices(texts):
        raw = data.tobytes()
        if raw.isascii() and b"<|" not in raw:
            data = LOWER[data]
        else:
            own = [raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace") for i in range(hi - lo)]
            if bpe.split_special is not None and b"<|" in raw and any(map(bpe.split_special.search, own)):
                for t in own:
                    a, b = bpe.encode_strings(t)
                    n.append(a.count(" ") + 1 if a else 0)
                    ids.append(sha(a.encode()).hexdigest())
                    decoded.append(sha(b.encode()).hexdigest())
                continue
            own = [bpe.normalize(t).encode("utf-8", "replace") for t in own]
            data = np.frombuffer(b"".join(own), np.uint8)
            offsets = np.cumsum([0, *map(len, own)])
        starts, ends, at = words(data, offsets)
        slots = pool.slots(data, starts, ends) if len(starts) else np.zeros(0, np.int64)
        counts = np.concatenate([[0], np.cumsum(pool.count[slots])])
        n += (counts[at[1:]] - counts[at[:-1]]).tolist()
        for part, out in ((0, ids), (1, decoded)):
            joined, edge = pool.joined(part, slots)
            edge, joined = edge[at].tolist(), memoryview(joined)
            out += [sha(joined[a : b - 1] if b > a else b"").hexdigest() for a, b in zip(edge, edge[1:])]
    return n, ids, decoded


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text, without sending the ids back to the JVM.

    A null or empty text has no tokens, and digests of an empty string. Repeated rows give a row each;
    an empty table gives none. Long texts are encoded whole; merges of equal rank go from left to
    right. Columns other than doc_id (null or not) and text aren't looked at, whatever they are called.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, ids, decoded = digest_batch(b.column(1), path or default_path())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"].cast("bigint"), docs["text"].cast("string")).mapInArrow(run, SCHEMA)
