"""Language identification with language-bitmask n-gram filters.

Training counts the byte n-grams of lower-cased words by language over all training texts and keeps
those that make up at least `share` of their language's n-grams, so a language keeps 1/share of them
at most, however large the corpus. They go into one bit-sliced Bloom filter: each of its cells is a
bitmask of languages, and the AND of an n-gram's cells has a bit for every language that contains
it. A text is judged by popcounts for each language, less the false positives to be expected from
that language's fill; the language with the largest corrected share of the text's n-grams wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenvec.llm._bytes import LOWER, mix, slices

N = 4
SHARE = 1 / 20_000
CELLS_LOG2 = 20
PROBES = 2
#: Languages of one plane of the filter (bits of a cell, at most); more languages have more planes, 8 MB each.
PLANE = 64
UND = "und"
SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double"

#: Bytes that can be part of a letter: A-Z, a-z and all of a non-ASCII character.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: What stands between words, one byte for all of it.
_FOLD = np.where(_LETTER, LOWER, 0x20).astype(np.uint8)


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-grams (as integers) that have a letter first or second and lie inside one text, and the row of each.

    A text has a separator before it and N - 1 after it, so each of its letters is first and second in one.
    """
    rows = len(offsets) - 1
    if not rows:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    folded = np.full(len(data) + N * rows, 0x20, np.uint8)
    folded[np.arange(len(data)) + np.repeat(N * np.arange(rows) + 1, np.diff(offsets))] = _FOLD[data]
    offsets = offsets + N * np.arange(rows + 1)
    x = folded.astype(np.uint32)
    gram = (x[:-3] << 24) | (x[1:-2] << 16) | (x[2:-1] << 8) | x[3:]
    keep = (folded[:-3] != 0x20) | (folded[1:-2] != 0x20)
    for k in range(1, N):  # not across the end of a text
        edge = offsets[1:-1] - k
        keep[edge[(edge >= 0) & (edge < len(keep))]] = False
    at = np.flatnonzero(keep)
    return gram[at], np.searchsorted(offsets, at, side="right") - 1


def count_ngrams(train: DataFrame) -> DataFrame:
    """(lang, gram, n) over texts of (text, lang); partial counts are made in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def out(lang: str) -> pa.RecordBatch:
            parts = held.pop(lang)
            gram = np.concatenate([p[0] for p in parts])
            order = np.argsort(gram, kind="stable")
            gram, n = gram[order], np.concatenate([p[1] for p in parts])[order]
            edge = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(edge), pa.string()), pa.array(gram[edge].astype(np.int64)), pa.array(np.add.reduceat(n, edge))], ["lang", "gram", "n"])

        for b in batches:
            langs, code = np.unique(np.array(b.column(1).to_pylist(), object).astype(str), return_inverse=True)
            for lo, hi, data, offsets in slices(b.column(0), 8 << 20):
                gram, row = ngrams(data, offsets)
                key, n = np.unique(gram.astype(np.uint64) | code[lo:hi][row].astype(np.uint64) << np.uint64(32), return_counts=True)
                of = (key >> np.uint64(32)).astype(np.int64)
                for k in np.unique(of):
                    held.setdefault(langs[k], []).append(((key[of == k] & np.uint64(0xFFFFFFFF)).astype(np.uint32), n[of == k]))
            for lang in [x for x, p in held.items() if sum(len(y[0]) for y in p) > 2_000_000]:
                yield out(lang)
        for lang in list(held):
            yield out(lang)

    part = train.select("text", "lang").mapInArrow(run, "lang string, gram bigint, n bigint")
    return part.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Filters:
    """A bit-sliced Bloom filter: cells of language bits, in planes of PLANE languages."""

    def __init__(self, grams: dict[str, np.ndarray], cells_log2: int = CELLS_LOG2):
        self.langs = sorted(grams)
        self.log2 = cells_log2
        kind = np.uint8 if len(grams) <= 8 else np.uint64
        self.cells = np.zeros((-(-max(len(grams), 1) // PLANE), 1 << cells_log2), kind)
        for k, lang in enumerate(self.langs):
            for p in self.probes(grams[lang].astype(np.uint32)):
                self.cells[k // PLANE][p] |= kind(1 << k % PLANE)
        fill = np.array([np.count_nonzero(self.cells[k // PLANE] >> kind(k % PLANE) & kind(1)) for k in range(len(grams))]) / (1 << cells_log2)
        #: By language, how often an n-gram that it doesn't contain is found all the same.
        self.false = fill**PROBES

    def probes(self, gram: np.ndarray) -> list[np.ndarray]:
        h = mix(gram.astype(np.uint64))
        return [(h >> np.uint64(64 - self.log2 - 20 * k)).astype(np.int64) & ((1 << self.log2) - 1) for k in range(PROBES)]

    def masks(self, gram: np.ndarray) -> list[np.ndarray]:
        """By plane, the bits of all languages that contain each n-gram."""
        a, b = self.probes(gram)
        return [plane[a] & plane[b] for plane in self.cells]

    def judge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By row, the language's number (-1: none) and the score."""
        rows, n = len(offsets) - 1, len(self.langs)
        gram, row = ngrams(data, offsets)
        total = np.bincount(row, minlength=rows)
        mask = self.masks(gram)
        found = np.empty((rows, n))
        if n <= 8:
            table = np.bincount(row << 8 | mask[0], minlength=rows << 8).reshape(rows, 256)
            for k in range(n):
                found[:, k] = table[:, (np.arange(256) >> k & 1).astype(bool)].sum(1)
        else:
            for k in range(n):
                found[:, k] = np.bincount(row[(mask[k // PLANE] >> np.uint64(k % PLANE) & np.uint64(1)).astype(bool)], minlength=rows)
        some = np.maximum(total, 1)[:, None]
        # of t n-grams a share s is the language's: found = t s + t (1 - s) false
        share = np.clip((found / some - self.false) / np.maximum(1 - self.false, 1e-9), 0, 1)
        best = share.argmax(1)
        score = (share.max(1) + 1e-6) / (share.sum(1) + 1e-6 * max(n, 1))
        return np.where(total > 0, best, -1), np.where(total > 0, np.clip(score, 0, 1), 0.0)


def train(docs: DataFrame, share: float = SHARE) -> Filters:
    """Filters from rows of (text, lang) with both given; what comes to the driver is at most 1/share n-grams a language."""
    counts = count_ngrams(docs.where("text is not null and lang is not null"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    kept = counts.join(totals, "lang").where(F.col("n") >= F.col("total") * share).select("lang", "gram")
    got = kept.toArrow()
    lang, gram = np.array(got.column(0).to_pylist(), object), got.column(1).to_numpy()
    return Filters({x: gram[lang == x] for x in sorted(set(lang))})


def held_out(column: str = "doc_id", folds: int = 4, fold: int = 2):
    """crc32 of the id as text leaves this remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % folds == fold, F.lit(False))


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of `docs`.

    A null text, a text without letters and, if there was nothing to learn from, any text is `und`
    with score 0. A text with letters but no known n-gram goes to the first language with an even
    score; of languages with equal shares the first by name wins. Repeated rows are judged each.
    Texts of any length are judged whole. Only doc_id, text and, in training, lang are looked at.
    An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            lang, score = [], []
            for _, _, data, offsets in slices(b.column(2)):
                k, s = f.judge(data, offsets) if f.langs else (np.full(len(offsets) - 1, -1), np.zeros(len(offsets) - 1))
                lang += [f.langs[i] if i >= 0 else UND for i in k.tolist()]
                score.append(s)
            has = b.column(3).to_pylist()
            score = np.concatenate(score) if score else np.zeros(0)
            lang = [x if h else UND for x, h in zip(lang, has)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(np.where([x == UND for x in lang], 0.0, score) if lang else score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"), letters.alias("letters"))
    return rows.mapInArrow(run, SCHEMA)


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the labelled documents that aren't held out, then predicts every document."""
    return predict(docs, train(docs.where(~held_out())))
