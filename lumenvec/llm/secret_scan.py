"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds what they miss.

The field tags the tokens of each line as secret begin, inside or outside. Its features are a
token's shape, the shapes of its neighbours and what the whole file looks like; the weights are
trained when the operator is built, on a bounded sample of the documents' own lines, labelled by the
fixed patterns, and on made-up secrets put into such lines. Lines are decoded by Viterbi.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenvec.llm._bytes import LOWER, slices, small_batches, word_hashes

KINDS = ("assign", "access", "hex", "crf")
SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
#: Lines of the training sample at most, and steps of gradient descent.
SAMPLE_LINES = 800
STEPS = 80
#: A tagged run becomes a span if it has so many bytes and its log odds over "outside" so much at least.
LEAST_BYTES = 12

_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]+")
_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[[*range(0x30, 0x3A), *range(0x61, 0x67)]] = True
_ASSIGN_WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")


def base_spans(raw: bytes, long_hex: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes, sorted."""
    out = []
    low = raw.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(raw) if m.end() - m.start() >= 20]
    if long_hex:
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(raw) if m.end() - m.start() >= 24]
    return sorted(out)


# ---- tokens and their shapes

_WORDY = np.zeros(256, bool)
_WORDY[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), 0x5F, 0x2B, 0x2F, 0x2D, *range(0x80, 0x100)]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_DIGIT, _UPPER, _ALOWER, _OTHER = (np.zeros(256, np.int32) for _ in range(4))
_DIGIT[0x30:0x3A] = 1
_UPPER[0x41:0x5B] = 1
_ALOWER[0x61:0x7B] = 1
_OTHER[0x80:] = 1
#: Words near a secret.
CUES = ("password", "passwd", "pwd", "secret", "token", "key", "apikey", "api_key", "auth", "authorization", "bearer", "credential", "credentials", "private", "access", "client_secret", "passphrase")
_MARKS = b"=:\"'|@.,(<"
#: Shapes: 0 none (line's edge), 1 cue word, then marks, other marks, then words by make-up and length.
_FIRST = 3 + len(_MARKS)
_LENGTHS = np.array([4, 8, 12, 16, 20, 28, 40])
_MAKES = 9
SHAPES = _FIRST + _MAKES * (len(_LENGTHS) + 1)
FILES = 6
B, I, O = 0, 1, 2  # noqa: E741


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of word-like bytes and of single marks."""
    n = len(data)
    wordy = _WORDY[data]
    mark = ~wordy & ~_BLANK[data]
    first, last = np.ones(n, bool), np.ones(n, bool)
    if n:
        np.logical_not(wordy[:-1], out=first[1:])
        np.logical_not(wordy[1:], out=last[:-1])
        edges = offsets[(offsets > 0) & (offsets < n)]
        first[edges] = True
        last[edges - 1] = True
    return np.flatnonzero(mark | (wordy & first)), np.flatnonzero(mark | (wordy & last)) + 1


_cues: np.ndarray | None = None


def _cue_hashes() -> np.ndarray:
    global _cues
    if _cues is None:
        raw = [w.encode() for w in CUES]
        at = np.cumsum([0, *map(len, raw)])
        _cues = np.sort(word_hashes(np.frombuffer(b"".join(raw), np.uint8), at[:-1], at[1:]))
    return _cues


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A shape number for each token."""
    size = ends - starts

    def inside(table: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(table[data], out=total[1:])
        return total[ends] - total[starts]

    digit, upper, lower, other = map(inside, (_DIGIT, _UPPER, _ALOWER, _OTHER))
    alpha = upper + lower
    make = np.full(len(size), 8)  # anything else
    make[(lower == size)] = 0
    make[(upper == 1) & (lower == size - 1)] = 1
    make[(upper == size) & (size > 0)] = 2
    make[digit == size] = 3
    mixed = (digit > 0) & (alpha > 0) & (other == 0)
    make[mixed & (upper == 0)] = 4
    make[mixed & (lower == 0)] = 5
    make[mixed & (upper > 0) & (lower > 0)] = 6
    make[other > 0] = 7
    first = data[starts] if len(starts) else data[:0]
    word = _WORDY[first]
    out = _FIRST + make * (len(_LENGTHS) + 1) + np.searchsorted(_LENGTHS, size, side="right")
    marks = np.full(256, 2 + len(_MARKS))
    for k, c in enumerate(_MARKS):
        marks[c] = 2 + k
    out[~word] = marks[first[~word]]
    at = np.flatnonzero(word & (size <= 16) & (size >= 3) & (digit == 0) & (other == 0))
    if len(at):
        cues = _cue_hashes()
        h = word_hashes(LOWER[data], starts[at], ends[at])
        where = np.minimum(np.searchsorted(cues, h), len(cues) - 1)
        out[at[cues[where] == h]] = 1
    return out


def file_kind(shape: np.ndarray, of: np.ndarray, rows: int) -> np.ndarray:
    """What each file looks like, 0 to 5: share of = and quote tokens, and whether it has a cue word."""
    n = np.maximum(np.bincount(of, minlength=rows), 1)
    code = np.bincount(of[(shape >= 2) & (shape < 6)], minlength=rows) / n
    cue = np.bincount(of[shape == 1], minlength=rows) > 0
    return np.digitize(code, [0.005, 0.05]) * 2 + cue


# ---- the field


class Field:
    """Weights: by label, of the shapes of a token and of the two before and the one after it, of the file, and of label pairs."""

    def __init__(self):
        self.own, self.prev, self.prev2, self.next = (np.zeros((SHAPES, 3)) for _ in range(4))
        self.file = np.zeros((FILES, 3))
        self.pair = np.zeros((3, 3))
        self.pair[O, I] = -30.0  # a secret starts with its beginning
        self.start = np.array([0.0, -30.0, 0.0])

    def emissions(self, shape: np.ndarray, line: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Scores [tokens, 3]; line: each token's line number, kind: its file's kind."""
        p, p2, nx = neighbours(shape, line)
        return self.own[shape] + self.prev[p] + self.prev2[p2] + self.next[nx] + self.file[kind]

    def viterbi(self, e: np.ndarray, line: np.ndarray) -> np.ndarray:
        """Best labels; all lines step together, the longest first."""
        out = np.full(len(e), O, np.int8)
        if not len(e):
            return out
        first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        size = np.diff(np.concatenate([first, [len(e)]]))
        # a line none of whose tokens can beat O by what its best path could gain needs no decoding
        gain = np.maximum.reduceat(e[:, :2].max(1) - e[:, O], first)
        slack = max(0.0, self.pair.max() * 2 - 2 * self.pair[O, O]) + max(0.0, self.start[:2].max() - self.start[O])
        some = np.flatnonzero(gain + slack > 0)
        some = some[np.argsort(-size[some], kind="stable")]
        if not len(some):
            return out
        first, size = first[some], size[some]
        alive = np.searchsorted(-size, -np.arange(size[0]), side="left")
        score = self.start + e[first]
        back = []
        for t in range(1, size[0]):
            k = alive[t]
            step = score[:k, :, None] + self.pair
            best = step.argmax(1)
            back.append(best.astype(np.int8))
            score[:k] = np.take_along_axis(step, best[:, None, :], 1)[:, 0] + e[first[:k] + t]
        label = score.argmax(1)
        for t in range(size[0] - 1, -1, -1):
            k = alive[t]
            out[first[:k] + t] = label[:k]
            if t:
                label[:k] = back[t - 1][np.arange(k), label[:k]]
        return out

    def fit(self, shape: np.ndarray, line: np.ndarray, kind: np.ndarray, label: np.ndarray, steps: int = STEPS) -> Field:
        """Maximum likelihood with a small L2 penalty, by Adam on the whole sample."""
        first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        size = np.diff(np.concatenate([first, [len(shape)]]))
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        alive = np.searchsorted(-size, -np.arange(size[0]), side="left")
        p, p2, nx = neighbours(shape, line)
        inner = np.ones(len(shape), bool)
        inner[first] = False
        at = np.flatnonzero(inner)
        params = [(self.own, shape), (self.prev, p), (self.prev2, p2), (self.next, nx), (self.file, kind)]
        tables = [t for t, _ in params] + [self.pair, self.start]
        gold = [self._sum(t.shape, i, np.eye(3)[label]) for t, i in params]
        pair = np.zeros((3, 3))
        np.add.at(pair, (label[at - 1], label[at]), 1)
        gold += [pair, np.bincount(label[first], minlength=3).astype(float)]
        m = [np.zeros_like(t) for t in tables]
        v = [np.zeros_like(t) for t in tables]
        for step in range(1, steps + 1):
            e = self.emissions(shape, line, kind)
            node, edge = self._marginals(e, first, size, alive)
            model = [self._sum(t.shape, i, node) for t, i in params] + [edge, node[first].sum(0)]
            for k, t in enumerate(tables):
                g = (gold[k] - model[k]) / len(first) - 1e-4 * np.clip(t, -5, 5)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                t += 0.25 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
            self.pair[O, I], self.start[I] = -30.0, -30.0
        return self

    @staticmethod
    def _sum(shape: tuple, index: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(index, weight[:, k], shape[0]) for k in range(3)], 1)

    def _marginals(self, e, first, size, alive):
        """Label probabilities of tokens, and expected label pairs, by forward and backward sums."""
        lse = lambda x, axis: (top := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - top).sum(axis))
        fw, bw = np.empty_like(e), np.zeros_like(e)
        fw[first] = self.start + e[first]
        for t in range(1, size[0]):
            k = alive[t]
            fw[first[:k] + t] = lse(fw[first[:k] + t - 1][:, :, None] + self.pair, 1) + e[first[:k] + t]
        for t in range(size[0] - 1, 0, -1):
            k = alive[t]
            bw[first[:k] + t - 1] = lse(self.pair + (bw[first[:k] + t] + e[first[:k] + t])[:, None, :], 2)
        z = lse(fw[first + size - 1], 1)
        total = np.empty(len(e))
        total[np.concatenate([np.arange(a, a + s) for a, s in zip(first, size)])] = np.repeat(z, size)
        node = np.exp(fw + bw - total[:, None])
        edge = np.zeros((3, 3))
        for t in range(1, size[0]):
            a = first[: alive[t]] + t
            edge += np.exp(fw[a - 1][:, :, None] + self.pair + (e[a] + bw[a])[:, None, :] - total[a][:, None, None]).sum(0)
        return node, edge


def neighbours(shape: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p, p2, nx = np.zeros_like(shape), np.zeros_like(shape), np.zeros_like(shape)
    same = line[1:] == line[:-1]
    p[1:] = np.where(same, shape[:-1], 0)
    nx[:-1] = np.where(same, shape[1:], 0)
    p2[2:] = np.where(line[2:] == line[:-2], shape[:-2], 0)
    return p, p2, nx


def _lines(data: np.ndarray, starts: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line number of each token (new at line feeds and texts), and its row."""
    row = np.searchsorted(offsets, starts, side="right") - 1
    feeds = np.flatnonzero(data == 0x0A)
    return np.searchsorted(feeds, starts) + row, row


# ---- training


def _made_up(rng: random.Random) -> tuple[str, str, str]:
    """What stands before a made-up secret, the secret, what stands after it."""
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    secret = rng.choice([
        lambda: pick("0123456789abcdef", rng.choice([18, 20, 32, 40, 64])),
        lambda: pick(upper + digit, rng.randrange(16, 24)),
        lambda: pick(lower + upper + digit, rng.randrange(20, 48)),
        lambda: pick(lower + upper + digit + "+/", rng.randrange(24, 60)),
        lambda: rng.choice(["ghp_", "glpat-", "xoxb-", "sk_live_"]) + pick(lower + upper + digit, rng.randrange(20, 36)),
    ])()
    before, after = rng.choice([("", ""), ("", ""), ("key: ", ""), ("password=", ""), ('token = "', '"'), ("Authorization: Bearer ", ""), ("pwd='", "'"), ("auth ", "")])
    return before, secret, after


def training_set(texts: list[str], seed: int = 7) -> tuple[np.ndarray, ...]:
    """Shapes, line numbers, file kinds and labels of sampled lines; every third gets a made-up secret."""
    rng = random.Random(seed)
    lines, gold = [], []
    for k, t in enumerate(texts):
        spans = []
        raw = t.encode("utf-8", "replace")
        for start, kind, end in base_spans(raw):
            if kind == 0:
                m = _ASSIGN.match(raw, start)
                start, end = m.start(2), m.end(2)
            spans.append((start, end))
        if k % 3 == 0 and not spans:
            words = t.split(" ")
            at = rng.randrange(len(words) + 1)
            before, secret, after = _made_up(rng)
            head = " ".join(words[:at]) + (" " if at else "") + before
            start = len(head.encode("utf-8", "replace"))
            raw = (head + secret + after + (" " if at < len(words) else "") + " ".join(words[at:])).encode("utf-8", "replace")
            spans = [(start, start + len(secret))]
        lines.append(raw)
        gold.append(spans)
    offsets = np.cumsum([0, *map(len, lines)])
    data = np.frombuffer(b"".join(lines), np.uint8)
    starts, ends = tokens(data, offsets)
    row = np.searchsorted(offsets, starts, side="right") - 1
    shape = shapes(data, starts, ends)
    label = np.full(len(starts), O)
    for r, spans in enumerate(gold):
        for a, b in spans:
            inside = np.flatnonzero((starts >= offsets[r] + a) & (ends <= offsets[r] + b))
            label[inside] = I
            label[inside[:1]] = B
    return shape, row, file_kind(shape, row, len(lines))[row], label


def train(docs: DataFrame, most: int = SAMPLE_LINES) -> Field:
    """A field from a bounded sample: four lines in a row, of at most 600 characters each, from a place in each document that its hash draws; documents are drawn by the hash too."""
    line = F.expr("filter(split(text, '\\n'), x -> length(x) between 1 and 600)")
    # a fair sample by a hash: about twice as many documents as are wanted come to the driver, however many there are
    share = min(1.0, most / max(docs.count(), 1))
    hashed = docs.where("text is not null").withColumn("h", F.xxhash64("text")).where(F.pmod("h", F.lit(1 << 40)) < int(share * (1 << 40)))
    few = hashed.select("h", F.slice(line, 1 + F.pmod(F.shiftright("h", 41), F.greatest(F.lit(1), F.size(line) - 3)).cast("int"), 4).alias("lines")).where("size(lines) > 0").orderBy("h").limit(most // 2)
    texts = [t for r in few.collect() for t in r["lines"]][:most]
    # what a field needs to see even if the sample is empty or has no such lines
    texts += ["See https://example.org/a/b-c_d?x=1 or call +1 (555) 010-0199 now.", "id 20240131-17 costs $1,299.00 (v2.10.3)", "Order A12345678 shipped to 10.0.0.1:8080", "password reset and token rules: see key = value"] * 20
    return Field().fit(*training_set(texts))


# ---- scanning


def _scan(texts, field: Field) -> Iterator[tuple[int, bytes, list[tuple[int, int, int]]]]:
    """(row, text as bytes, spans as (start, kind, end) in bytes) of every text."""
    for lo, hi, data, offsets in slices(texts):
        raw = data.tobytes()
        starts, ends = tokens(data, offsets)
        line, row = _lines(data, starts, offsets)
        shape = shapes(data, starts, ends)
        label = field.viterbi(field.emissions(shape, line, file_kind(shape, row, hi - lo)[row]), line)
        begins = np.flatnonzero(label == B)
        tagged: dict[int, list[tuple[int, int]]] = {}
        for i in begins.tolist():
            j = i
            while j + 1 < len(label) and label[j + 1] == I and line[j + 1] == line[i]:
                j += 1
            if ends[j] - starts[i] >= LEAST_BYTES:
                r = int(row[i])
                tagged.setdefault(r, []).append((int(starts[i] - offsets[r]), int(ends[j] - offsets[r])))
        # rows with a run of 24 hex digits, runs ending with their text
        hexed = set((np.searchsorted(offsets, _long_runs(_HEX_BYTE[data], offsets, 24), side="right") - 1).tolist())
        for r in range(hi - lo):
            text = raw[offsets[r] : offsets[r + 1]]
            spans = base_spans(text, r in hexed)
            base = list(spans)
            for s, e in tagged.get(r, ()):
                if all(e <= x or s >= y for x, _, y in base):
                    spans.append((s, 3, e))
            yield lo + r, text, sorted(spans)


def _long_runs(inside: np.ndarray, offsets: np.ndarray, least: int) -> np.ndarray:
    """Starts of runs of so many true values at least, none of which goes on over an offset."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    return a[b - a >= least - 1]


def _points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans in code points."""
    if not spans or text.isascii():
        return spans
    at = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(int(at[s]), k, int(at[e])) for s, k, e in spans]


def _redacted(text: bytes, found: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for s, k, e in found:
        if e > at:
            out += [text[at : max(s, at)], b"[" + KINDS[k].encode() + b"]" if s >= at else b""]
            at = e
    return b"".join([*out, text[at:]]).decode("utf-8", "replace")


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Every row of `docs` with all its columns, secrets in its text replaced by [kind], and n_chars, if there, that of the new text.

    A null text stays null, an empty one empty; repeated rows are treated alike; an empty table gives
    none. A very long text is worked on whole, by itself. Columns may have any names.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field or train(docs))
    names = docs.columns
    # numbered while they are worked on, so that no name is read as an expression
    at, counted = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    rows = docs.toDF(*[f"c{k}" for k in range(len(names))])
    rows = rows.withColumn(f"c{at}", F.col(f"c{at}").cast("string"))
    if counted is not None:
        rows = rows.withColumn(f"c{counted}", F.col(f"c{counted}").cast("bigint"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            null = b.column(at).is_null().to_pylist()
            texts = [None if null[r] else _redacted(text, found) for r, text, found in _scan(b.column(at), shared.value)]
            columns = list(b.columns)
            columns[at] = pa.array(texts, pa.string())
            if counted is not None:
                columns[counted] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return rows.mapInArrow(run, rows.schema).toDF(*names)


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Counts and digests of the spans of every row of `docs`.

    A null or empty text has none: counts of 0, the digest of an empty string. Repeated rows are
    scanned each; an empty table gives no rows. A very long text is scanned whole, by itself. Spans of
    the field that overlap a fixed pattern's are left out; of spans with the same start the kind first
    in KINDS comes first. Columns other than doc_id (null or not) and text aren't looked at.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field or train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, sha, joined = ([], [], []), [], []
            for _, text, found in _scan(b.column(1), shared.value):
                for k in range(3):
                    counts[k].append(sum(x[1] == k for x in found))
                spans = _points(text, found)
                say = lambda xs: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in xs)
                sha.append(hashlib.sha256(say([x for x in spans if x[1] < 3]).encode()).hexdigest())
                joined.append(say(spans))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(sha, pa.string()), pa.array(joined, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
