"""Importance resampling towards a target: hashed n-gram gains, Gumbel noise, and the highest scores by radix sort.

Every run of one to three words falls in one of 10,000 buckets. A bucket's gain compares how often
it occurs in the target's texts and in all documents; a document's weight is the sum of its features'
gains, looked up in an array. Weight plus noise ranks documents, so the highest ones are a
sample without replacement in proportion to exp(weight).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenvec.llm._bytes import LOWER, slices, small_batches, words
from lumenvec.llm.linking import cut
from lumenvec.llm.radix import ranked

BUCKETS, LONGEST = 10_000, 3
#: Documents with fewer words are never drawn.
LEAST_WORDS = 20
PERCENT, SEED = 5, 42

#: What parts words here: all of ASCII but digits and letters (A-Z are lower-cased before).
GAPS = np.zeros(256, bool)
GAPS[:0x80] = True
GAPS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False

#: Words longer than this go on alone, not in step with the others.
IN_STEP = 48


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC = _crc_table()


def _extended(state: np.ndarray, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC registers after these bytes, all words a byte at a time; the rest of long words is left to zlib."""
    order = np.argsort(-size, kind="stable")
    s, at, n = state[order], starts[order], size[order]
    most = min(int(n[0]) if len(n) else 0, IN_STEP)
    more = np.searchsorted(-n, -np.arange(1, most + 1), side="right")  # words of that many bytes at least
    for j, k in enumerate(more.tolist()):
        x = s[:k]
        s[:k] = CRC[(x ^ data[at[:k] + j]) & 0xFF] ^ (x >> 8)
    for i in range(int(np.searchsorted(-n, -IN_STEP))):
        s[i] = zlib.crc32(data[at[i] + IN_STEP : at[i] + n[i]].tobytes(), int(s[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(s)
    out[order] = s
    return out


def features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """By slice of rows: (first row, end row, words of each row, for runs of 1, 2, 3 words: (buckets, row of each, counted in the slice))."""
    for lo, hi, data, offsets in slices(texts):
        data = LOWER[data]
        starts, ends, at = words(data, offsets, GAPS)
        row = np.repeat(np.arange(hi - lo), np.diff(at))
        size, out = ends - starts, []
        state = np.full(len(starts), 0xFFFFFFFF, np.uint32)
        for k in range(LONGEST):
            if k:
                state = state[:-1]
                state = CRC[(state ^ np.uint32(0x20)) & 0xFF] ^ (state >> 8)
            state = _extended(state, data, starts[k:], size[k:])
            same = row[k:] == row[: len(row) - k]
            out.append((((state ^ np.uint32(0xFFFFFFFF)) % BUCKETS)[same].astype(np.int64), row[k:][same]))
            if len(state) < 2:
                break
        yield lo, hi, np.diff(at), out


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of all texts (column `text`) fall in each bucket; a task sends one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for _, _, _, runs in features(b.column(0)):
                for buckets, _ in runs:
                    total += np.bincount(buckets, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in texts.select(texts["text"].cast("string")).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of how much likelier each bucket is in the target, rounded down; one is added to every count."""
    s_all, t_all = float(source.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((float(t) + 1) * s_all / ((float(s) + 1) * t_all))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row: gains are looked up in an array that each task holds (80 KB)."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_features, weight = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for lo, hi, n, runs in features(b.column(1)):
                n_words[lo:hi] = n
                for buckets, row in runs:
                    n_features[lo:hi] += np.bincount(row, minlength=hi - lo)
                    # sums of whole numbers, exact in doubles up to 2^53
                    weight[lo:hi] += np.bincount(row, held.value[buckets], hi - lo).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (n_words, n_features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(docs["doc_id"].cast("bigint"), docs["text"].cast("string")).mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of `docs`; rank is null for those that aren't drawn.

    `target` gives texts, `docs` ids and texts; other columns aren't looked at, whatever they are
    called. A null or empty text has no words, no features and weight 0. Texts are read whole. Repeated
    rows count, and are drawn, each; equal scores go to the smaller doc_id, and a null doc_id comes before
    all others (its noise is that of the word null). An empty `docs` gives no rows, an empty
    `target` equal counts of one in every bucket.
    """
    spark = docs.sparkSession
    small_batches(spark)
    gain = gains(bucket_counts(docs), bucket_counts(target))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    rows = cut(weighted(docs, gain).withColumn("score", F.col("weight") + noise))
    may = rows.where(F.col("n_words") >= LEAST_WORDS)
    n = may.count()
    # a null id sorts first: its key is below all ids by the marker that is sorted before them
    keyed = may.withColumn("has_id", F.col("doc_id").isNotNull().cast("bigint")).withColumn("id_key", F.coalesce("doc_id", F.lit(0)))
    order = ranked(keyed, [("score", True), ("has_id", False), ("id_key", False)]).drop("has_id", "id_key")
    drawn = F.when(F.col("rank") <= percent * n // 100, F.col("rank"))
    rest = rows.where(F.col("n_words") < LEAST_WORDS).withColumn("rank", F.lit(None).cast("bigint"))
    return order.withColumn("rank", drawn).unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
