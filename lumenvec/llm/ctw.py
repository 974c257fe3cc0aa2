"""Language-model scoring: context-tree weighting over bytes, beside a smoothed unigram of words.

The model is a decomposed context tree: each byte is coded by its 8 binary decisions, most
significant first; every node (a context of 0 to DEPTH preceding bytes, and the bits so far) has a
Krichevsky-Trofimov estimate of its counts, and a node's weighted probability is the even mixture
of that estimate and of the product over its children, contexts one byte longer. Counts come from
all training texts, and every context found there is a node, so the tree grows with the corpus; where a
text leaves what training texts reach, the deepest node that they reach speaks. The tree is
a table of counts, dealt by the last two bytes of the context: what hangs below is weighed in one task, and
what is above is 257 contexts on the driver. What comes out is a table of the log probability of each
string of DEPTH + 1 bytes of the texts. Its common rows are broadcast, the others are joined to the
strings that need them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenvec.llm._bytes import LOWER, mix, slices, small_batches, word_hashes, words
from lumenvec.llm.langid import held_out

#: Bytes of the longest contexts.
DEPTH = 5
#: Strings that make up such a share of all are looked up in each task, the others joined; it changes the work, not results.
COMMON_GRAMS = 2.0**-22
_SLOTS_LOG2 = 22
#: Rows of a block of the tree that is weighed at once; more only where contexts of the same last two bytes have more.
BLOCK_ROWS = 4096
#: Words whose counts every task gets, the most frequent; the counts of all others are joined.
COMMON_WORDS = 1 << 16
#: The end token's key; no word's hash is used for it.
END = 0
_WORD, _GRAM = 0, 1


def _keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    h = word_hashes(data, starts, ends)
    h[h == END] = 1
    return h.view(np.int64)


def _grams(lowered: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every byte and an end mark (a zero byte) of each text, itself after the DEPTH bytes before it (zero bytes before a text's start), and the offsets by row."""
    rows = len(offsets) - 1
    pad = np.zeros(len(lowered) + DEPTH * rows + rows, np.int64)
    own = np.arange(len(lowered)) + np.repeat((DEPTH + 1) * np.arange(rows) + DEPTH, np.diff(offsets))
    pad[own] = lowered
    to = offsets + (DEPTH + 1) * np.arange(rows + 1)
    n = len(pad) - DEPTH
    gram = np.zeros(n, np.int64)
    for k in range(DEPTH + 1):
        gram = gram << 8 | pad[k : k + n]
    keep = np.ones(n, bool)
    for k in range(1, DEPTH + 1):
        keep[(to[1:-1] - k)] = False
    return gram[keep], offsets + np.arange(rows + 1)


def _counted(held: list) -> tuple[np.ndarray, np.ndarray]:
    key = np.concatenate([k for k, _ in held])
    order = np.argsort(key)
    key, n = key[order], np.concatenate([n for _, n in held])[order]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[edge], np.add.reduceat(n, edge, axis=0) if len(edge) else n


def count(docs: DataFrame) -> DataFrame:
    """(kind, key, n, every): counts of word hashes in training texts and of strings of DEPTH + 1 bytes in training and in all texts of (text, held_out), summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        size = [0, 0]

        def out(kind: int) -> Iterator[pa.RecordBatch]:
            if held[kind]:
                key, n = _counted(held[kind])
                held[kind].clear()
                size[kind] = 0
                for lo in range(0, len(key), 1 << 17):
                    k, c = key[lo : lo + (1 << 17)], n[lo : lo + (1 << 17)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.astype(np.int64)), pa.array(c[:, 0].copy()), pa.array(c[:, 1].copy())], ["kind", "key", "n", "every"])

        def add(kind: int, key: np.ndarray, teaches: bool) -> None:
            key, n = np.unique(key, return_counts=True)
            held[kind].append((key, np.stack([n * teaches, n], 1).astype(np.int64)))
            size[kind] += len(key)

        for b in batches:
            every = ~np.array(b.column(1).to_pylist(), bool)
            for lo, hi, data, offsets in slices(b.column(0), 8 << 20):
                lowered, teaches = LOWER[data], every[lo:hi]
                starts, ends, at = words(lowered, offsets)
                gram, edge = _grams(lowered, offsets)
                of_gram = np.repeat(teaches, np.diff(edge))
                add(_WORD, np.concatenate([_keys(lowered, starts, ends)[np.repeat(teaches, np.diff(at))], np.full(teaches.sum(), END, np.int64)]), True)
                add(_GRAM, gram[of_gram], True)
                add(_GRAM, gram[~of_gram], False)
                for kind in (_WORD, _GRAM):
                    if size[kind] > 1_000_000:
                        yield from out(kind)
        yield from out(_WORD)
        yield from out(_GRAM)

    found = docs.select("text", "held_out").mapInArrow(run, "kind int, key bigint, n bigint, every bigint")
    return found.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("every").alias("every"))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x >= 0.5, by Stirling's series past a shift."""
    shift = np.zeros_like(x)
    x = x.copy()
    for _ in range(7):
        low = x < 7
        shift[low] -= np.log(x[low])
        x[low] += 1
    z = 1 / (x * x)
    return shift + (x - 0.5) * np.log(x) - x + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / x


def _kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    out, some = np.zeros(zeros.shape), zeros + ones > 0
    zeros, ones = zeros[some], ones[some]
    out[some] = _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - np.log(np.pi)
    return out


class Block:
    """Nodes below some contexts of `top` bytes, by depth from `top` to DEPTH, weighed together.

    A node is a context and a binary decision; only those that the strings reach are rows here, so
    memory follows the strings. key: strings of DEPTH + 1 bytes, n: their training counts, 0 for strings of other texts.
    """

    def __init__(self, key: np.ndarray, n: np.ndarray, top: int = 2, depth: int = DEPTH):
        byte, context = key & 255, key >> 8
        bit = np.arange(8)
        node = (1 << bit) | (byte[:, None] >> (8 - bit))
        self.one = (byte[:, None] >> (7 - bit)) & 1
        ids, at = np.unique((context[:, None] << 8 | node).ravel(), return_inverse=True)
        self.at = at.reshape(node.shape)  # of each string, its eight nodes
        n = np.repeat(n.astype(float), 8)
        ones = self.one.ravel().astype(float)
        self.levels: list[tuple] = []  # from DEPTH up: (ids, zeros, ones, own, total, parent in the next)
        zeros, ones, below = np.bincount(at, n * (1 - ones), len(ids)), np.bincount(at, n * ones, len(ids)), None
        for d in range(depth, top - 1, -1):
            own, total = weigh(zeros, ones, below)
            up, parent = np.unique((ids >> 8 & ((1 << 8 * max(d - 1, 0)) - 1)) << 8 | (ids & 255), return_inverse=True)
            self.levels.append((ids, zeros, ones, own, total, parent))
            ids, below = up, np.bincount(parent, total, len(up))
            zeros, ones = np.bincount(parent, zeros, len(up)), np.bincount(parent, ones, len(up))
        self.above = (ids, zeros, ones, below)

    def logs(self, mixed: np.ndarray, left: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Log10 probability of each string's last byte, from what the nodes of `above` say (see `descend`)."""
        for k in range(len(self.levels) - 1, -1, -1):
            _, zeros, ones, own, total, parent = self.levels[k]
            mixed, left, stop = descend(zeros, ones, own, total, mixed[parent], left[parent], stop[parent], k == 0)
        p = np.clip(stop, 1e-12, 1 - 1e-12)[self.at]
        return np.log10(np.where(self.one, p, 1 - p)).sum(1)


def weigh(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Log of the own estimate and of the weighted probability; below: the children's summed log probabilities, None at the greatest depth."""
    own = _kt(zeros, ones)
    return own, own if below is None else np.logaddexp(own, below) - np.log(2)


def descend(zeros, ones, own, total, mixed, left, stop, last: bool):
    """One depth further down: what the estimates so far say of a one, the share that is left to deeper ones, and what is said if nothing is deeper.

    A node that no training text reaches says nothing: all that is left goes to the deepest that one reaches.
    """
    some = zeros + ones > 0
    p = (ones + 0.5) / (zeros + ones + 1.0)
    alone = np.ones(len(p)) if last else np.exp(own - np.log(2) - total)
    here = mixed + left * alone * p
    onwards = left * (1 - alone)
    return np.where(some, here, stop), np.where(some, onwards, 0.0), np.where(some, here + onwards * p, stop)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, n) in blocks that hold all of a context of two bytes; batches come in the order of those."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        if sum(len(k) for k, _ in held) < BLOCK_ROWS:
            continue
        key, n = (np.concatenate(x) for x in zip(*held))
        of = key >> 8 & 0xFFFF
        edge = np.append(np.flatnonzero(of[1:] != of[:-1]) + 1, len(key))
        lo = 0
        for i, hi in enumerate(edge[:-1].tolist()):
            if hi - lo >= BLOCK_ROWS or i == len(edge) - 2:  # the last context may go on in the next batch
                yield key[lo:hi], n[lo:hi]
                lo = hi
        held = [(key[lo:], n[lo:])]
    if held and sum(len(k) for k, _ in held):
        yield tuple(np.concatenate(x) for x in zip(*held))


def log_probabilities(grams: DataFrame) -> DataFrame:
    """(key, log): log10 probability of the last byte of each string after those before it; grams: (key, n), n 0 where training texts lack it."""
    above = F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF).cast("bigint"))
    dealt = grams.select("key", "n").repartition(above).sortWithinPartitions(above).persist(StorageLevel.DISK_ONLY)

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, 1 << 16))
        for key, n in _blocks(batches):
            ids, *values = Block(key, n).above
            for total, value in zip(sums, values):
                np.add.at(total, ids, value)
        at = np.flatnonzero((sums != 0).any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(x[at]) for x in sums]], ["at", "zeros", "ones", "below"])

    got = dealt.mapInArrow(up, "at bigint, zeros double, ones double, below double").groupBy("at").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")]).toArrow()
    zeros, ones, below = np.zeros((3, 1 << 16))
    for k, x in enumerate((zeros, ones, below)):
        x[got.column(0).to_numpy()] = got.column(k + 1).to_numpy()
    # contexts of one byte, then of none
    own, total = weigh(zeros, ones, below)
    fold = lambda x: x.reshape(256, 256).sum(0)
    root_own, root_total = weigh(fold(zeros), fold(ones), fold(total))
    root = descend(fold(zeros), fold(ones), root_own, root_total, np.zeros(256), np.ones(256), np.full(256, 0.5), False)
    shared = grams.sparkSession.sparkContext.broadcast(descend(zeros, ones, own, total, *[np.tile(x, 256) for x in root], False))

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n in _blocks(batches):
            block = Block(key, n)
            log = block.logs(*[x[block.above[0]] for x in shared.value])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(log)], ["key", "log"])

    return dealt.mapInArrow(down, "key bigint, log double")


class Common:
    """Log probabilities of common strings, looked up in one place each; of strings that share a place the most frequent has it."""

    def __init__(self, key: np.ndarray, log: np.ndarray, n: np.ndarray):
        order = np.lexsort((key, n))
        self.key, self.log = key[order], log[order]
        self.table = None

    def __getstate__(self):
        return self.__dict__ | {"table": None}

    @staticmethod
    def slot(gram: np.ndarray) -> np.ndarray:
        return (mix(gram.view(np.uint64)) >> np.uint64(64 - _SLOTS_LOG2)).astype(np.int64)

    def __call__(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which strings are known, and the log probability of each (0 where not)."""
        if self.table is None:
            keys, logs = np.full(1 << _SLOTS_LOG2, -1, np.int64), np.full(1 << _SLOTS_LOG2, np.nan, np.float32)
            at = self.slot(self.key)
            keys[at], logs[at] = self.key, self.log
            self.table = keys, logs
        at = self.slot(gram)
        log = self.table[1][at]
        hit = (self.table[0][at] == gram) & ~np.isnan(log)
        return hit, np.where(hit, log, 0.0).astype(np.float64)


def _scored(docs: DataFrame, grams, common, n_train: int, v_train: int) -> DataFrame:
    """By document: its own sums, and the hashes of words and the strings that aren't common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logs, known = common.value
        bottom = np.log10(n_train + v_train + 1.0)
        for b in batches:
            for lo, hi, data, offsets in slices(b.column(1)):
                lowered = LOWER[data]
                starts, ends, at = words(lowered, offsets)
                key, rows = _keys(lowered, starts, ends), hi - lo
                where = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
                hit = keys[where] == key if len(keys) else np.zeros(len(key), bool)
                row = np.repeat(np.arange(rows), np.diff(at))
                sums = np.bincount(row[hit], logs[where[hit]], rows)
                seen = np.bincount(row[hit], known[where[hit]], rows)
                end = np.searchsorted(keys, END)
                if end < len(keys) and keys[end] == END:
                    sums, seen = sums + logs[end], seen + 1
                n = np.diff(at) + 1
                rest = key[~hit]
                edge = np.concatenate([[0], np.cumsum(np.bincount(row[~hit], minlength=rows))]).astype(np.int32)
                gram, of = _grams(lowered, offsets)
                known_gram, log = grams.value(gram)
                rare = np.flatnonzero(~known_gram)
                rare_edge = np.searchsorted(rare, of).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, rows), pa.array(n), pa.array(np.diff(of)), pa.array(seen.astype(np.int64)), pa.array(sums - n * bottom), pa.array(np.add.reduceat(log, of[:-1])), pa.ListArray.from_arrays(pa.array(edge), pa.array(rest)), pa.ListArray.from_arrays(pa.array(rare_edge), pa.array(gram[rare]))],
                    ["doc_id", "n_tokens", "n_bytes", "n_known", "base", "score", "rest", "rare"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, n_bytes bigint, n_known bigint, base double, score double, rest array<bigint>, rare array<bigint>")


def score(docs: DataFrame, common_grams: float = COMMON_GRAMS, common_words: int = COMMON_WORDS) -> DataFrame:
    """Scores every row of `docs` with what the rows that aren't held out (remainder 2 of 7) teach.

    bits_per_byte is the code length of a text with its end mark, by its bytes and that mark. A null
    text is empty: one token, the end. Without training rows all counts are 0, and each bit costs one.
    Repeated rows are scored each, and count each in training; an empty table gives none. A null
    doc_id is training. Long texts are taken whole. Other columns aren't looked at, whatever they are called.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(folds=7).alias("held_out"), F.col("text").cast("string").alias("text"))
    counts = count(rows).persist(StorageLevel.DISK_ONLY)
    words_, grams = counts.where(f"kind = {_WORD}").select("key", "n"), counts.where(f"kind = {_GRAM}").select("key", "n", "every")
    n_train, v_train = words_.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    logs = grams.join(log_probabilities(grams), "key").persist(StorageLevel.DISK_ONLY)
    total = logs.agg(F.coalesce(F.sum("every"), F.lit(0))).first()[0]
    got = logs.where(F.col("every") >= common_grams * total).select("key", "log", "every").toArrow()
    often = spark.sparkContext.broadcast(Common(*[got.column(k).to_numpy() for k in range(3)]))
    top = words_.orderBy(F.desc("n"), "key").limit(common_words).toArrow()
    keys, n = top.column(0).to_numpy(), top.column(1).to_numpy()
    order = np.argsort(keys)
    common = spark.sparkContext.broadcast((keys[order], np.log10(n[order] + 1.0), (n[order] > 0).astype(np.int64)))
    own = _scored(rows, often, common, n_train, v_train)
    # each row gets a name of its own, so that repeated ids stay apart; its sums travel with the first of its entries
    own = own.withColumn("row", F.monotonically_increasing_id())
    carried = ["doc_id", "n_tokens", "n_bytes", "n_known", "base", "score"]
    entries = own.select("row", *carried, F.size("rest").alias("words"), F.posexplode(F.concat(F.array(F.lit(END).cast("bigint")), "rest", "rare")).alias("pos", "key"))
    first = F.col("pos") == 0
    entries = entries.select("row", F.when(first, -1).when(F.col("pos") <= F.col("words"), _WORD).otherwise(_GRAM).alias("kind"), F.when(first, F.col("row")).otherwise(F.col("key")).alias("key"), *[F.when(first, F.col(c)).alias(c) for c in carried])
    known = words_.select(F.lit(_WORD).alias("kind"), "key", "n", F.lit(None).cast("double").alias("log")).unionByName(logs.select(F.lit(_GRAM).alias("kind"), "key", F.lit(None).cast("bigint").alias("n"), "log"))
    found = entries.join(known, ["kind", "key"], "left")
    sums = found.groupBy("row").agg(*[F.max(c).alias(c) for c in carried], F.sum(F.log10(F.col("n") + 1.0)).alias("more"), F.count("n").alias("seen"), F.sum("log").alias("rarer"))
    return sums.select(
        "doc_id", held_out(folds=7).alias("held_out"), "n_tokens", (F.col("n_known") + F.col("seen")).alias("n_known"), F.lit(n_train).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("rarer", F.lit(0.0))).alias("score"),
        (-(F.col("score") + F.coalesce("rarer", F.lit(0.0))) / F.lit(float(np.log10(2))) / F.col("n_bytes")).alias("bits_per_byte"),
    )
