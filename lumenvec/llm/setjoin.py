"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, then exact intersection.

A document's set is its distinct 4-word shingles. Documents with the same set are one class, and
classes are joined through their representatives. Sets that are alike enough share an element of
their prefixes (the first elements in one fixed order, frequent ones last), so classes meet in tiles:
one for each prefix element and band of sizes, each class also in the band below. In a tile, bit
counts of hashed bitmaps bound the intersection from above; what passes is verified on the sorted
arrays. First each class is verified against its tiles' smallest member only; then, in tiles whose
members aren't yet in one component, the remaining pairs are. Large tiles are dealt in blocks of
members, two blocks to a group, so that no task holds a tile and no pair that its bit counts rule out
is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenvec.llm._bytes import LOWER, mix, slices, small_batches, word_hashes, words
from lumenvec.llm.linking import components as connect
from lumenvec.llm.linking import cut

WORDS = 4
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 85
#: 64-bit words of the smallest bitmap; larger sets have more, a power of two, at least two bits for each element.
BITMAP_WORDS = 16
#: Bits of the filter of the ids whose arrays are wanted; it only saves work, so its size needn't follow theirs.
FILTER_LOG2 = 24
#: Documents of the sample that tells frequent elements (it only changes their order, not results), and most of those kept.
SAMPLE, FREQUENT = 20_000, 1 << 17
#: Members of a tile at most that are paired as rows; larger tiles are cut into blocks of about so many members.
FEW, BLOCK = 64, 1024
SCHEMA = "doc_id bigint, n_shingles bigint, component_id bigint"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> list[np.ndarray]:
    """Of each text, its sorted distinct shingles as 64-bit hashes."""
    lowered = LOWER[data]
    starts, ends, at = words(lowered, offsets)
    h = word_hashes(lowered, starts, ends)
    n = len(h)
    odd = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5)]
    full = np.zeros(max(n - size + 1, 0), np.uint64)
    for k in range(size):
        full = mix(full + h[k : n - size + 1 + k] * odd[k % 4]) if n >= size else full
    out = []
    for a, b in zip(at.tolist(), at[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(full[a : b - size + 1]))
        elif b > a:
            x = np.uint64(b - a)
            for w in h[a:b]:
                x = mix(np.array([x ^ w], np.uint64))[0]
            out.append(np.array([x], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _prefix_size(n: int, percent: int = PERCENT) -> int:
    """Elements of a set of n of which a link's partner of any size has one in its own prefix."""
    return n - -(-percent * n // 100) + 1 if n else 0


def bitmap(s: np.ndarray) -> np.ndarray:
    width = 64 * BITMAP_WORDS
    while width < 2 * len(s):
        width *= 2
    bits = np.zeros(width, np.uint8)
    bits[((s >> np.uint64(20)) & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def _frequent(docs: DataFrame, most: int = SAMPLE) -> np.ndarray:
    """Elements that a sample of documents shows to be common, rarest first; a bounded number."""
    n = docs.count()
    share = min(1.0, most / max(n, 1))
    few = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < int(share * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, offsets in slices(b.column(0), 8 << 20):
                key, n = np.unique(np.concatenate(shingle_sets(data, offsets)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    counts = few.select("text").mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where("n >= 4")
    got = counts.orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    return got.column(0).to_numpy().view(np.uint64)[::-1].copy()


def _signed(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(doc_id, n, sig_a, sig_b, bits, prefix): of every text its set's size, 128-bit digest, bitmap and prefix."""
    order = np.argsort(frequent)
    shared = docs.sparkSession.sparkContext.broadcast((frequent[order], order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks = shared.value
        for b in batches:
            for lo, hi, data, offsets in slices(b.column(1)):
                sets = shingle_sets(data, offsets)
                n = [len(s) for s in sets]
                prefixes, bits, sig = [], [], ([], [])
                for s in sets:
                    p = _prefix_size(len(s))
                    if p and len(keys):
                        where = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                        common = keys[where] == s
                        rare = s[~common]
                        if len(rare) < p:
                            late = np.flatnonzero(common)
                            rare = np.concatenate([rare, s[late[np.argsort(ranks[where[late]], kind="stable")]]])
                        prefixes.append(rare[:p])
                    else:
                        prefixes.append(s[:p])
                    bits.append(bitmap(s))
                    with np.errstate(over="ignore"):
                        sig[0].append(np.add.reduce(mix(s)) if len(s) else np.uint64(0))
                        sig[1].append(np.bitwise_xor.reduce(mix(s + np.uint64(0x9E3779B97F4A7C15))) if len(s) else np.uint64(0))
                edge = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
                prefix = pa.ListArray.from_arrays(pa.array(edge), pa.array(np.concatenate(prefixes).view(np.int64)))
                flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, bits)]).astype(np.int32)), pa.array(np.concatenate(bits)))
                sigs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in sig]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), *sigs, flat, prefix], ["doc_id", "n", "sig_a", "sig_b", "bits", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, sig_a bigint, sig_b bigint, bits array<bigint>, prefix array<bigint>")


def _filter_bit(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.view(np.uint64)) >> np.uint64(64 - FILTER_LOG2)).astype(np.int64)


def _filter_of(ids: DataFrame) -> np.ndarray:
    """A bit for every id, from bounded partial filters: one row for each 64 bits of it at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_LOG2, np.uint8)
        for b in batches:
            bits[_filter_bit(b.column(0).to_numpy())] = 1
        packed = np.packbits(bits).view(np.int64)
        at = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(packed[at])], ["at", "bits"])

    got = ids.mapInArrow(run, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    packed = np.zeros(1 << (FILTER_LOG2 - 6), np.int64)
    packed[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return packed


def _arrays(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, s): the sorted sets of the documents in ids, and of a few more that the filter of ids can't tell from them; texts are not shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter_of(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value.view(np.uint8))
        for b in batches:
            b = b.filter(pa.array(bits[_filter_bit(b.column(0).to_numpy())].astype(bool)))
            for lo, hi, data, offsets in slices(b.column(1)):
                raw = [s.tobytes() for s in shingle_sets(data, offsets)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(raw, pa.binary())], ["id", "s"])

    return docs.select("doc_id", "text").mapInArrow(run, "id bigint, s binary")


def _sizes_fit(a: Column, b: Column) -> Column:
    """Whether sets of these sizes may be linked."""
    return (100 * F.least(a, b)) >= (PERCENT * F.greatest(a, b))


def _may_link(bits_a, n_a, bits_b, n_b) -> Column:
    """Whether sizes and bit counts leave room for a link: bits of one set that the other lacks are elements it lacks.

    A wider bitmap is folded to the narrower one's width, of which partners' are at most twice.
    """
    a, b, x, y = F.col(n_a), F.col(n_b), F.col(bits_a), F.col(bits_b)

    def room(in_x: Column, in_y: Column, in_both: Column) -> Column:
        most = F.least(a - (in_x - in_both), b - (in_y - in_both))
        return (100 + PERCENT) * most >= PERCENT * (a + b)

    total = lambda words: F.aggregate(words, F.lit(0), lambda t, w: t + F.bit_count(w))
    fold = lambda w: F.when((F.size(x) == F.size(y)) | (F.size(w) == F.least(F.size(x), F.size(y))), w).otherwise(F.zip_with(F.slice(w, F.lit(1), (F.size(w) / 2).cast("int")), F.slice(w, (F.size(w) / 2).cast("int") + 1, (F.size(w) / 2).cast("int")), lambda p, q: p.bitwiseOR(q)))
    plain = lambda f: sum((F.bit_count(f(k)) for k in range(BITMAP_WORDS)), F.lit(0))
    small = room(plain(lambda k: F.get(x, k)), plain(lambda k: F.get(y, k)), plain(lambda k: F.get(x, k).bitwiseAND(F.get(y, k))))
    large = room(total(fold(x)), total(fold(y)), total(F.zip_with(fold(x), fold(y), lambda p, q: p.bitwiseAND(q))))
    return _sizes_fit(a, b) & F.when((F.size(x) == BITMAP_WORDS) & (F.size(y) == BITMAP_WORDS), small).otherwise(large)


def _verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of (u, v) that are links, by exact intersection of the sorted arrays.

    The arrays of a document that is in many pairs are dealt with its pairs, by the other document.
    """
    pairs = cut(pairs)
    ids = pairs.select(F.explode(F.array("u", "v")).alias("id"))
    arrays = cut(_arrays(docs, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = (x, y) if len(x) < len(y) else (y, x)
                both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["u", "v"])

    with_u = pairs.join(arrays.select(F.col("id").alias("u"), F.col("s").alias("su")), "u")
    both = with_u.join(arrays.select(F.col("id").alias("v"), F.col("s").alias("sv")), "v").select("u", "v", "su", "sv")
    return both.mapInArrow(run, "u bigint, v bigint")


def _blocks(tiles: DataFrame, block: int = BLOCK) -> DataFrame:
    """(u, v), u > v, of different labels, that sizes and bit counts don't rule out; tiles: (h, band, members, lo, id, label, n, bits).

    Members with the tile's smallest label, often nearly all, need only meet the others. Both sides
    are dealt into blocks by a hash of the id; each two blocks that must meet make a group of their
    own, some thousand rows, whatever the tile's size.
    """
    tiles = tiles.withColumn("same", F.col("label") == F.col("lo"))
    sides = tiles.groupBy("h", "band").agg(*[F.greatest(F.lit(1), F.ceil(F.count_if(c) / block)).cast("int").alias(a) for a, c in (("n_same", F.col("same")), ("n_other", ~F.col("same")))])
    tiles = tiles.join(sides, ["h", "band"])
    own = F.when(F.col("same"), F.pmod(F.xxhash64("id"), F.col("n_same"))).otherwise(F.col("n_same") + F.pmod(F.xxhash64("id"), F.col("n_other"))).cast("int")
    others = F.sequence(F.when(F.col("same"), F.col("n_same")).otherwise(F.lit(0)), F.col("n_same") + F.col("n_other") - 1)
    met = tiles.select("h", "band", F.explode(others).alias("other"), own.alias("block"), "id", "label", "n", "bits")
    met = met.select("h", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "label", "n", "bits")

    def run(table: pa.Table) -> pa.Table:
        ids, label, n = (table.column(c).to_numpy() for c in ("id", "label", "n"))
        bits = table.column("bits").combine_chunks()
        flat, edge = bits.flatten().to_numpy(zero_copy_only=False), bits.offsets.to_numpy() - bits.offsets[0].as_py()
        order = np.argsort(-ids)
        wide = np.diff(edge)
        u, v = [], []
        # bitmaps as bytes, folded to the width of the narrowest there
        least = int(wide.min())
        rows = np.stack([np.bitwise_or.reduce(flat[a:b].reshape(-1, least), 0) for a, b in zip(edge, edge[1:])])[order]
        ids, label, n = ids[order], label[order], n[order]
        own = _popcount(rows)
        for k in range(len(ids) - 1):
            rest = slice(k + 1, None)
            both = _popcount(rows[k] & rows[rest])
            a, b = n[k], n[rest]
            most = np.minimum(a - (own[k] - both), b - (own[rest] - both))
            fits = ((100 + PERCENT) * most >= PERCENT * (a + b)) & (100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)) & (label[k] != label[rest]) & (ids[k] != ids[rest])
            at = np.flatnonzero(fits)
            u.append(np.full(len(at), ids[k]))
            v.append(ids[rest][at])
        none = [np.zeros(0, np.int64)]
        return pa.table({"u": pa.array(np.concatenate(u or none)), "v": pa.array(np.concatenate(v or none))})

    return met.groupBy("h", "band", "i", "j").applyInArrow(run, "u bigint, v bigint")


def _popcount(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words.view(np.uint64)).sum(-1).astype(np.int64)


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `docs`.

    A null or empty text, or one without words, has an empty set and links with nothing; an empty
    table gives no rows. Texts of any length are taken whole. Repeated rows have equal sets, so they
    are one class, and which of equals leads a class or tile goes by the smallest id. Rows without an
    id count as one more id, below all others, and come back with null in its place. Other columns
    of `docs`, whatever they are called, aren't looked at.
    """
    small_batches(docs.sparkSession)
    none = -(1 << 63)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(none)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = cut(_signed(rows, _frequent(rows)))
    some = signed.where("n > 0")
    # a class of equal sets goes on as its smallest document
    classes = cut(some.groupBy("n", "sig_a", "sig_b").agg(F.min("doc_id").alias("id")))
    # an id that stands on rows of different texts would hold different sets: links go by id, texts by their own
    one = some.join(classes, ["n", "sig_a", "sig_b"]).where("doc_id = id").dropDuplicates(["id", "n", "sig_a", "sig_b"])
    one = cut(one.select("id", "n", "bits", "prefix"))
    spread = one.select("id", "n", F.explode("prefix").alias("h"))
    # most elements are in one class only: those go first, on counts alone
    often = spread.groupBy("h").agg(F.count("*").alias("members")).where("members > 1").select("h")
    shared = cut(spread.join(often, "h").select("h", "id", "n"))
    band = F.floor(F.ln(F.col("n")) / F.lit(-log(PERCENT / 100))).cast("int")
    # a class stands in its own band's tile and in the one below, where partners of smaller sizes are
    tiles = shared.select("id", "n", "h", F.explode(F.array(band, band - 1)).alias("band"))
    heads = tiles.groupBy("h", "band").agg(F.min(F.struct("id", "n")).alias("head"), F.count("*").alias("members")).where("members > 1")
    full = tiles.join(heads, ["h", "band"])
    facts = one.select("id", "n", "bits")
    u, v = (facts.select(*[F.col(c).alias(f"{c}_{x}") for c in facts.columns]) for x in "uv")
    # bitmaps join pairs only once these are few: of sizes that may be linked, and each once
    star = full.where((F.col("id") > F.col("head.id")) & _sizes_fit(F.col("n"), F.col("head.n"))).select(F.col("id").alias("id_u"), F.col("head.id").alias("id_v")).distinct()
    star = star.join(u, "id_u").join(v, "id_v").where(_may_link("bits_u", "n_u", "bits_v", "n_v"))
    # one head for each class, the smallest
    star = star.groupBy(F.col("id_u").alias("u")).agg(F.min("id_v").alias("v"))
    links = cut(_verify(star, rows))
    part = connect(links)
    # tiles whose members are in several components
    labelled = full.join(part.withColumnRenamed("component_id", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    mixed = labelled.groupBy("h", "band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("h", "band", "lo")
    open_ = cut(labelled.join(mixed, ["h", "band"]).select("h", "band", "members", "lo", "id", "label", "n"))
    few = open_.where(F.col("members") <= FEW)
    a, b = (few.select("h", "band", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "label", "n")]) for x in "uv")
    rest = a.join(b, ["h", "band"]).where((F.col("id_u") > F.col("id_v")) & (F.col("label_u") != F.col("label_v")) & _sizes_fit(F.col("n_u"), F.col("n_v")))
    rest = rest.select("id_u", "id_v").distinct().join(u, "id_u").join(v, "id_v").where(_may_link("bits_u", "n_u", "bits_v", "n_v")).select(F.col("id_u").alias("u"), F.col("id_v").alias("v"))
    many = _blocks(open_.where(F.col("members") > FEW).join(facts.select("id", "bits"), "id"))
    more = _verify(rest.unionByName(many).distinct().join(links, ["u", "v"], "left_anti"), rows)
    part = connect(links.unionByName(more))
    classes = classes.join(part, "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    out = signed.select("doc_id", "n", "sig_a", "sig_b").join(classes.drop("id"), ["n", "sig_a", "sig_b"], "left")
    real = lambda c: F.when(F.col(c) != none, F.col(c))
    return out.select(real("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.coalesce("component_id", "doc_id") != none, F.coalesce("component_id", "doc_id")).alias("component_id"))
