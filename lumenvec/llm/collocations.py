"""Phrase collocations: exact counts of n-grams in counting quotient filters, merged across shards.

A shard is a batch of texts: its own dictionary, and its texts as numbers of that dictionary. Words
frequent in all of a language get ids; a phrase that is a candidate has only such words, as each of
its parts is at least as frequent as itself. The shards count pairs of frequent words; pairs that reach
the least count go back to the shards that have them; the shards then count runs of three and four
words all of whose pairs did. Filters are merged bucket by bucket, a bounded number of shards at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenvec.llm import cqf
from lumenvec.llm._bytes import LOWER, released, slices, small_batches, words
from lumenvec.llm.linking import cut

LEAST, LONGEST = 30, 4
#: 100 * f(longer) >= COVERED * f(phrase) drops the phrase.
COVERED = 80
SCALE, FIRST = 2_000_000, 2000
UNKNOWN = "und"

#: Texts of a shard: about so many bytes, or one longer text.
SHARD_BYTES = 4 << 20
#: Occurrences of n-grams in a bucket, on average; and shards whose filters are merged at a time.
BUCKET_ENTRIES, MERGED_SHARDS = 1 << 20, 2048
#: Dictionary entries of one bucket of words, within which words are numbered.
BUCKET_WORDS = 1 << 14

#: Bytes of the frequent words up to which every task holds them; more are joined to the shards' dictionaries.
HELD_BYTES = 32 << 20

#: What parts words: space and tab; and what parts pieces too.
BREAKS = np.zeros(256, bool)
BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAPS = BREAKS.copy()
GAPS[[0x20, 0x09]] = True

SHARDS = "shard bigint, n_tokens bigint, langs array<string>, words array<string>, counts array<bigint>, stream binary"


def _packed(stream: np.ndarray) -> bytes:
    """A stream as it is written: its length and its numbers, compressed."""
    raw = stream.astype("<i4").tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(value: pa.Scalar) -> np.ndarray:
    raw = value.as_py()
    return np.frombuffer(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True), "<i4")


def _shard(texts: pa.Array, langs: list[str]) -> Iterator[tuple[int, list[str], list[str], np.ndarray, bytes]]:
    """(occurrences, language of each entry, word of each, count of each, stream) of every slice.

    The stream has the entries' numbers from 1, in order, with 0 between pieces.
    """
    for lo, hi, data, offsets in slices(texts, SHARD_BYTES):
        data = LOWER[data]
        starts, ends, at = words(data, offsets, GAPS)
        if not len(starts):
            continue
        size = ends - starts
        solid = data[~GAPS[data]]
        column = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(solid)).dictionary_encode()
        names, own = np.unique(np.array(langs[lo:hi], object), return_inverse=True)
        row = np.repeat(np.arange(hi - lo), np.diff(at))
        key = column.indices.to_numpy().astype(np.int64) * len(names) + own[row]
        entries, number = np.unique(key, return_inverse=True)
        # breaks before a word; a running sum would take 8 bytes for every byte of text
        piece = np.searchsorted(np.flatnonzero(BREAKS[data]), starts) + row
        breaks = np.flatnonzero(np.diff(piece)) + 1
        stream = np.insert(number.astype(np.int32) + 1, breaks, 0)
        yield len(starts), names[entries % len(names)].tolist(), column.dictionary.take(pa.array(entries // len(names))).to_pylist(), np.bincount(number), _packed(stream)


def shards(docs: DataFrame) -> DataFrame:
    """The shards of (lang, text), as rows of SHARDS; a null text has no words, a null lang is `und`."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 33
        for b in batches:
            for n, langs, terms, counts, stream in _shard(b.column(1), [UNKNOWN if x is None else x for x in b.column(0).to_pylist()]):
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([n], pa.int64()), pa.array([langs], pa.list_(pa.string())), pa.array([terms], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64())), pa.array([stream], pa.binary())], ["shard", "n_tokens", "langs", "words", "counts", "stream"])
                shard += 1

    return docs.select(docs["lang"].cast("string"), docs["text"].cast("string")).mapInArrow(released(run), SHARDS)


def vocabulary(entries: DataFrame, least: int) -> tuple[DataFrame, int]:
    """((lang, word, f, id) of frequent words, bits of an id). Words are numbered within buckets of a hash, so no task has all of them."""
    found = cut(entries.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least))
    buckets = found.count() // BUCKET_WORDS + 1
    own = found.withColumn("b", F.pmod(F.xxhash64("lang", "word"), F.lit(buckets)))
    nth = F.row_number().over(Window.partitionBy("b").orderBy("lang", "word"))
    out = cut(own.select("lang", "word", "f", ((nth - 1) * buckets + F.col("b") + 1).cast("bigint").alias("id")))
    most = out.agg(F.max("id")).first()[0] or 1
    return out, max(int(most).bit_length(), 1)


def _translated(shard: int, raw: pa.Scalar, size: int, at: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """A shard's stream with the ids of its entries `at`, and 0 for all others."""
    to = np.zeros(size + 1, np.int32)
    to[at + 1] = ids
    stream = to[_unpacked(raw)]
    # of rare words and breaks one in a row is enough
    stream = stream[(stream > 0) | np.concatenate([[True], stream[:-1] > 0])]
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([_packed(stream)], pa.binary())], ["shard", "ids"])


def _numbered(own: DataFrame, entries: DataFrame, known: DataFrame) -> DataFrame:
    """(shard, ids): every shard's stream in ids of the vocabulary."""
    size = known.agg(F.sum(F.octet_length("word") + 16)).first()[0] or 0
    if size <= HELD_BYTES:
        table = known.select("lang", "word", "id").toArrow()
        by_lang = {x.as_py(): pc.equal(table["lang"], x) for x in table["lang"].unique()}
        held = own.sparkSession.sparkContext.broadcast({x: (table["word"].filter(m).combine_chunks(), table["id"].filter(m).to_numpy()) for x, m in by_lang.items()})

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for shard, langs, terms, raw in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3)):
                    of, found = langs.values.to_numpy(zero_copy_only=False), np.zeros(len(terms.values), np.int64)
                    for lang in np.unique(of):
                        if lang in held.value:
                            names, ids = held.value[lang]
                            mine = np.flatnonzero(of == lang)
                            at = pc.index_in(terms.values.take(pa.array(mine)), value_set=names).fill_null(-1).to_numpy()
                            found[mine[at >= 0]] = ids[at[at >= 0]]
                    at = np.flatnonzero(found)
                    yield _translated(shard, raw, len(found), at, found[at])

        return own.select("shard", "langs", "words", "stream").mapInArrow(released(look_up), "shard bigint, ids binary")
    numbers = entries.join(known.select("lang", "word", "id"), ["lang", "word"]).groupBy("shard").agg(F.collect_list(F.struct("at", "id")).alias("numbers"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, n, raw, pairs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                yield _translated(shard, raw, n, *(pairs.values.field(k).to_numpy() for k in range(2)))

    return own.select("shard", F.size("words").alias("size"), "stream").join(numbers, "shard").mapInArrow(released(joined), "shard bigint, ids binary")


def _runs(stream: np.ndarray, n: int) -> list[np.ndarray]:
    return [stream[k : len(stream) - n + 1 + k] for k in range(n)]


def _pairs(ids: DataFrame, p: cqf.Packing) -> DataFrame:
    """(n, bucket, shard, filter) of the pairs in every shard's stream (shard, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, raw in zip(b.column(0).to_pylist(), b.column(1)):
                a, c = _runs(_unpacked(raw), 2)
                there = (a > 0) & (c > 0)
                yield _batch([(2, k, shard, x) for k, _, x in cqf.filters(p, [a[there], c[there]])])

    return ids.mapInArrow(released(run), FILTERS)


FILTERS = "n int, bucket bigint, shard bigint, filter binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["n", "bucket", "shard", "filter"])


def _longer(ids: DataFrame, kept: DataFrame, two: cqf.Packing, longer: list[cqf.Packing]) -> DataFrame:
    """The same for runs of three and four words, all pairs of which are among the shard's kept ones (shard, pairs: [(bucket, filter)])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, raw, pairs in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                stream = _unpacked(raw)
                left, right = map(np.concatenate, zip(*[cqf.decode(two, x["bucket"], x["filter"])[:2] for x in pairs]))
                a, c = two.unpack(*two.restored(left, right))
                known = np.sort((a << 32) | c)
                a, c = (x.astype(np.int64) for x in _runs(stream, 2))
                own = (a << 32) | c
                alive = known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own
                rows = []
                for p in longer:
                    there = np.logical_and.reduce(_runs(alive, p.n - 1)) if len(stream) >= p.n else np.zeros(0, bool)
                    rows += [(p.n, k, shard, x) for k, _, x in cqf.filters(p, [x[there] for x in _runs(stream, p.n)])] if there.any() else []
                yield _batch(rows)

    return ids.join(kept, "shard").select("shard", "ids", "pairs").mapInArrow(released(run), FILTERS)


def _merge(found: DataFrame, packings: dict[int, cqf.Packing], n_shards: int, least: int) -> DataFrame:
    """(n, bucket, filter) of the n-grams that count `least` or more in all shards; found: FILTERS, written."""

    def step(limit: int):
        def run(key: tuple, rows: pa.Table) -> pa.Table:
            n, bucket = key[0].as_py(), key[1].as_py()
            p = packings[n]
            left, right, counts = cqf.merged(p, bucket, rows.column("filter").to_pylist(), limit)
            return pa.table({"n": pa.array([n], pa.int32()), "bucket": pa.array([bucket], pa.int64()), "shard": pa.array([key[2].as_py()], pa.int64()), "filter": pa.array([cqf.encode(p, left, right, counts)], pa.binary())}) if len(left) else rows.slice(0, 0).select(["n", "bucket", "shard", "filter"])

        return run

    groups = n_shards
    while True:
        groups = -(-groups // MERGED_SHARDS)
        dealt = found.select("n", "bucket", F.pmod(F.xxhash64("shard"), F.lit(groups)).alias("shard"), "filter")
        found = dealt.groupBy("n", "bucket", "shard").applyInArrow(step(least if groups == 1 else 1), FILTERS)
        if groups == 1:
            return found.drop("shard")


def _kept(found: DataFrame, frequent: DataFrame, p: cqf.Packing) -> DataFrame:
    """(shard, pairs): what each shard's filters have of the frequent pairs, as filters again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, last = [], (None, None)
            for bucket, shard, own, common in zip(*[b.column(k).to_pylist() for k in range(4)]):
                if last[0] != bucket:
                    last = bucket, cqf.decode(p, bucket, common)
                left, right, counts = cqf.decode(p, bucket, own)
                keep = cqf.within(p, left, right, *last[1][:2])
                if keep.any():
                    out.append((2, bucket, shard, cqf.encode(p, left[keep], right[keep], counts[keep])))
            yield _batch(out)

    met = found.select("bucket", "shard", "filter").join(frequent.select("bucket", F.col("filter").alias("common")), "bucket")
    return met.mapInArrow(released(run), FILTERS).groupBy("shard").agg(F.collect_list(F.struct("bucket", "filter")).alias("pairs"))


def _rows(frequent: DataFrame, packings: dict[int, cqf.Packing]) -> DataFrame:
    """(ids, f) of merged filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, bucket, raw in zip(*[b.column(k).to_pylist() for k in range(3)]):
                p = packings[n]
                left, right, counts = cqf.decode(p, bucket, raw)
                ids = np.stack(p.unpack(*p.restored(left, right)), 1).ravel()
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, len(ids) + 1, n), pa.int32()), pa.array(ids)), pa.array(counts)], ["ids", "f"])

    return frequent.select("n", "bucket", "filter").mapInArrow(released(run), "ids array<bigint>, f bigint")


def count(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((lang, n): words of each language; (lang, word, f, id): frequent words; (ids, f): runs of two to four words that occur `least` times or more)."""
    spark = docs.sparkSession
    own = cut(shards(docs))
    entries = own.select("shard", F.posexplode(F.arrays_zip("langs", "words", "counts")).alias("at", "e")).select("shard", "at", F.col("e.langs").alias("lang"), F.col("e.words").alias("word"), F.col("e.counts").alias("n"))
    langs = cut(entries.groupBy("lang").agg(F.sum("n").alias("n")))
    n_shards, n_tokens = own.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    known, width = vocabulary(entries, least)
    if not n_shards:
        return langs, known, spark.createDataFrame([], "ids array<bigint>, f bigint")
    bucket_bits = max(int(n_tokens // BUCKET_ENTRIES).bit_length(), 1)
    packings = {n: cqf.Packing(n, width, min(bucket_bits, width)) for n in range(2, LONGEST + 1)}
    ids = cut(_numbered(own, entries, known))
    found = cut(_pairs(ids, packings[2]))
    two = cut(_merge(found, packings, n_shards, least))
    more = cut(_longer(ids, _kept(found, two, packings[2]), packings[2], [packings[n] for n in range(3, LONGEST + 1)]))
    return langs, known, cut(_rows(two.unionByName(_merge(more, packings, n_shards, least)), packings))


def collocations(docs: DataFrame, least: int = LEAST, covered: int = COVERED, first: int = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `first` best phrases of two to four words.

    A null text has no words; a null lang is `und`; repeated rows count each; an empty table gives no rows.
    Texts are read whole. Equal scores go by a, then by phrase, so no ranks tie. Columns other
    than lang and text aren't looked at, whatever they are called.
    """
    langs, known, runs = count(docs, least)
    single = known.select(F.array("id").alias("ids"), "f")
    every = single.unionByName(runs)
    cuts = runs.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.select("ids", "a", "k", F.slice("ids", F.lit(1), F.col("k")).alias("head"), F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")).alias("tail"))
    cuts = cuts.join(every.select(F.col("ids").alias("head"), F.col("f").alias("l")), "head").join(every.select(F.col("ids").alias("tail"), F.col("f").alias("r")), "tail")
    scored = cuts.withColumn("score", F.expr(f"cast({SCALE} as decimal(10, 0)) * cast(a as decimal(19, 0)) div cast(l + r as decimal(19, 0))"))
    best = scored.groupBy("ids").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("m")).select("ids", "a", "m.l", "m.r", "m.score")
    spans = F.expr("flatten(transform(sequence(2, size(ids) - 1), n -> transform(sequence(1, size(ids) - n + 1), i -> slice(ids, i, n))))")
    inside = runs.where(F.size("ids") > 2).select(F.explode(spans).alias("ids"), F.col("f").alias("longer")).groupBy("ids").agg(F.max("longer").alias("longer"))
    left = best.join(inside, "ids", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a"))).drop("longer")
    # ranked before phrases are spelt, keeping all that tie with the last
    left = left.join(known.select(F.col("id").alias("_1"), "lang"), F.col("ids")[0] == F.col("_1")).drop("_1")
    may = left.withColumn("may", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("may") <= first)
    spelt = may.select("*", F.posexplode("ids").alias("at", "id")).join(known.select("id", "word"), "id")
    spelt = spelt.groupBy("ids", "lang", "a", "l", "r", "score").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = spelt.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return top.join(langs, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
