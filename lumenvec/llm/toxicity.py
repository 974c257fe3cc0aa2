"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

Terms are beginnings of words (runs of letters, in lower case), each by itself and once more for each
density it reaches in the text, so that what any text may hold once by chance is told from what a
text keeps saying. Kept are those that tell the two labels apart in the training rows; their counts
come from all training rows. Examples are a bounded sample of the training rows
that contain such terms. The index keeps, for each term and each block of examples, the largest
weight; a query visits blocks by descending upper bound and stops when no block can hold a closer
neighbour, so its nearest examples are exact. Votes are weighted by cosine and by how many training
texts an example of its label stands for, and smoothed with the base rate, and the neighbours found are the evidence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenvec.llm._bytes import LOWER, mix, slices
from lumenvec.llm.langid import held_out
from lumenvec.llm.linking import cut

#: Bytes of a word's beginning; a term's densities are one word in 2 ** k.
N = 6
DENSITIES = (8, 7, 6, 5)
#: Most labelled documents that are learned from, a fair sample by a hash of the id where there are more.
LABELLED = 200_000
#: Most examples of each label in the index, and most terms.
EXAMPLES = 3000
TERMS = 20_000
#: A term is kept if it is in so many toxic texts at least, and that many times likelier in them.
LEAST_TEXTS = 4
LEAST_ODDS = 12.0
BLOCK = 64
NEIGHBOURS = 15
#: Votes of the base rate that are added to the neighbours'.
PRIOR_VOTES = 0.6
SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int, evidence array<struct<doc_id: bigint, toxic: int, cosine: double>>"
#: The evidence as Arrow sees it.
_EVIDENCE = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))
_BITS = 22


def _letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes (ASCII and Latin-1 letters), and which of them are letters; all beyond ASCII count as such."""
    x = LOWER[data]
    if len(x):
        wide = np.flatnonzero((x[:-1] == 0xC3) & (x[1:] >= 0x80) & (x[1:] < 0x9F) & (x[1:] != 0x97)) + 1
        x[wide] += 0x20
    return x, (x >= 0x80) | ((x >= 0x61) & (x <= 0x7A))


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms (as integers) of each text, once each, in the order of their rows; their rows and how often they stand there."""
    x, letter = _letters(data)
    n = len(x)
    if not letter.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    first[edges] = letter[edges]
    at = np.flatnonzero(first)
    # a word's bytes end at the first that is no letter, or at its text's end
    key = np.zeros(len(at), np.uint64)
    row = np.searchsorted(offsets, at, side="right") - 1
    inside = np.ones(len(at), bool)
    for k in range(N):
        inside &= at + k < offsets[row + 1]
        here = np.minimum(at + k, n - 1)
        inside &= letter[here]
        key = (key << np.uint64(8)) | np.where(inside, x[here], 0).astype(np.uint64)
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    edge = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])]))
    tf = np.diff(np.append(edge, len(key)))
    all_words = np.bincount(row, minlength=len(offsets) - 1)
    key, row = key[edge], row[edge]
    dense = [tf << k >= all_words[row] for k in DENSITIES]
    key = np.concatenate([key, *[key[d] | np.uint64(i + 1 << 8 * N) for i, d in enumerate(dense)]])
    tf = np.concatenate([tf, *[np.ones(d.sum(), np.int64) for d in dense]])
    row = np.concatenate([row, *[row[d] for d in dense]])
    by = np.argsort(row, kind="stable")
    return key[by], row[by], tf[by]


def _slot(key: np.ndarray) -> np.ndarray:
    return (mix(key) >> np.uint64(64 - _BITS)).astype(np.int64)


def _texts_with(rows: DataFrame) -> DataFrame:
    """(key, n): in how many texts of (text) each term is, counts made in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size = [], [], 0

        def out() -> pa.RecordBatch:
            key = np.concatenate(keys)
            order = np.argsort(key)
            key, n = key[order], np.concatenate(counts)[order]
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            return pa.RecordBatch.from_arrays([pa.array(key[edge].astype(np.int64)), pa.array(np.add.reduceat(n, edge))], ["key", "n"])

        for b in batches:
            for _, _, data, offsets in slices(b.column(0), 4 << 20):
                got, n = np.unique(terms_of(data, offsets)[0], return_counts=True)
                keys.append(got)
                counts.append(n)
                size += len(got)
                if size > 3_000_000:
                    yield out()
                    keys, counts, size = [], [], 0
        if size:
            yield out()

    return rows.select("text").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def _count_given(rows: DataFrame, keys: np.ndarray) -> np.ndarray:
    """In how many texts each of these (bounded, sorted) terms is."""
    shared = rows.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(shared.value)
        total = np.zeros(len(shared.value), np.int64)
        for b in batches:
            for _, _, data, offsets in slices(b.column(0)):
                total += np.bincount(find(data, offsets)[0], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])

    if not len(keys):
        return np.zeros(0, np.int64)
    got = rows.select("text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(keys), np.int64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out


class Finder:
    """Finds which of given terms are where in texts."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(np.uint64)
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[_slot(self.keys)] = True

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the given terms, rows and how often they stand there, by row and term."""
        key, row, tf = terms_of(data, offsets)
        at = np.flatnonzero(self.maybe[_slot(key)])
        where = np.minimum(np.searchsorted(self.keys, key[at]), max(len(self.keys) - 1, 0))
        hit = self.keys[where] == key[at] if len(self.keys) else np.zeros(0, bool)
        where, at = where[hit], at[hit]
        by = np.lexsort((where, row[at]))
        return where[by], row[at[by]], tf[at[by]]


class Index:
    """Block-max inverted index over the examples' unit vectors."""

    def __init__(self, idf: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, stands_for: np.ndarray | None = None, ids: list | None = None):
        self.idf, self.labels = idf, labels.astype(float)
        self.blocks = -(-len(rows) // BLOCK)
        # alike examples side by side make tight bounds: by their heaviest term
        lead = [int(t[np.argmax(idf[t])]) if len(t) else -1 for t, _ in rows]
        order = np.argsort(lead, kind="stable")
        self.labels = self.labels[order]
        self.ids = [ids[i] for i in order] if ids else [None] * len(rows)
        self.stands_for = (np.ones(len(rows)) if stands_for is None else stands_for)[order]
        term = np.concatenate([rows[i][0] for i in order]) if rows else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(rows)), [len(rows[i][0]) for i in order]) if rows else np.zeros(0, np.int64)
        w = np.concatenate([self.vector(*rows[i]) for i in order]) if rows else np.zeros(0)
        by = np.lexsort((doc, term))
        self.term, self.doc, self.w = term[by], doc[by], w[by]
        # a block's entries: (term, block), its postings and its largest weight
        block = self.doc // BLOCK
        edge = np.flatnonzero(np.concatenate([[True], (self.term[1:] != self.term[:-1]) | (block[1:] != block[:-1])])) if len(by) else np.zeros(0, np.int64)
        self.entry_block = block[edge]
        self.entry_max = np.maximum.reduceat(self.w, edge) if len(edge) else np.zeros(0)
        self.entry_at = np.concatenate([edge, [len(by)]])
        self.first = np.searchsorted(self.term[edge], np.arange(len(idf) + 1))

    def vector(self, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        w = (1 + np.log(tf)) * self.idf[term]
        norm = np.sqrt((w * w).sum())
        return w / norm if norm else w

    def nearest(self, term: np.ndarray, tf: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and numbers of the k nearest examples that share a term; ties by number."""
        q = self.vector(term, tf)
        span = [np.arange(self.first[t], self.first[t + 1]) for t in term]
        entry = np.concatenate(span) if span else np.zeros(0, np.int64)
        weight = np.repeat(q, [len(s) for s in span]) if span else np.zeros(0)
        bound = np.bincount(self.entry_block[entry], weight * self.entry_max[entry], self.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        by = np.argsort(self.entry_block[entry], kind="stable")
        entry, weight = entry[by], weight[by]
        lo = np.searchsorted(self.entry_block[entry], order)
        hi = np.searchsorted(self.entry_block[entry], order, side="right")
        found, number, least = np.zeros(0), np.zeros(0, np.int64), -1.0
        step = 4
        for i in range(0, len(order), step):
            if len(found) == k and bound[order[i]] < least - 1e-12:
                break
            for b, x, y in zip(order[i : i + step], lo[i : i + step], hi[i : i + step]):
                score = np.zeros(BLOCK)
                for e, w in zip(entry[x:y], weight[x:y]):
                    s = slice(self.entry_at[e], self.entry_at[e + 1])
                    score[self.doc[s] - b * BLOCK] += w * self.w[s]
                some = np.flatnonzero(score)
                found, number = np.concatenate([found, score[some]]), np.concatenate([number, some + b * BLOCK])
            best = np.lexsort((number, -np.round(found, 12)))[:k]
            found, number = found[best], number[best]
            least = found[-1] if len(found) else -1.0
        return found, number

    def score(self, term: np.ndarray, tf: np.ndarray, rate: float) -> tuple[float, list[dict]]:
        """Distance-weighted share of toxic votes among the neighbours, with some votes at the base rate; and those neighbours, nearest first."""
        cos, number = self.nearest(term, tf)
        evidence = [{"doc_id": self.ids[i], "toxic": int(self.labels[i]), "cosine": float(c)} for c, i in zip(cos, number)]
        if len(number):
            cos = cos * self.stands_for[number] / self.stands_for[number].mean()
        return float((cos @ self.labels[number] + PRIOR_VOTES * rate) / (cos.sum() + PRIOR_VOTES)), evidence


class Model:
    def __init__(self, keys: np.ndarray, index: Index | None, rate: float):
        self.keys, self.index, self.rate = keys, index, rate
        self.find = None

    def __getstate__(self):
        return self.__dict__ | {"find": None}

    def judge(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[dict]]]:
        """By row, the score and its evidence."""
        out, evidence = np.full(len(offsets) - 1, float(self.rate)), [[]] * (len(offsets) - 1)
        if self.index is None:
            return out, evidence
        self.find = self.find or Finder(self.keys)
        for r, term, tf in _by_row(*self.find(data, offsets)):
            out[r], evidence[r] = self.index.score(term, tf, self.rate)
        return out, evidence


def _by_row(term: np.ndarray, row: np.ndarray, tf: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    edge = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else []
    for a, b in zip(edge, [*edge[1:], len(row)]):
        yield int(row[a]), term[a:b], tf[a:b]


def train(rows: DataFrame) -> Model:
    """A model from rows of (text, label 0 or 1, and doc_id if examples are to be named); bounded: TERMS terms and EXAMPLES examples a label come to the driver."""
    spark = rows.sparkSession
    toxic, clean = rows.where("label = 1"), rows.where("label = 0")
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    rate = n1 / max(n1 + n0, 1)
    if not n1 or not n0:
        return Model(np.zeros(0, np.uint64), None, rate if n1 + n0 else 0.0)
    least = min(LEAST_TEXTS, n1)
    # the most telling terms by how many toxic texts have them; at this point clean texts don't count yet
    got = _texts_with(toxic).where(F.col("n") >= least).orderBy(F.desc("n"), "key").limit(8 * TERMS).toArrow()
    keys, a = got.column(0).to_numpy().astype(np.uint64), got.column(1).to_numpy()
    order = np.argsort(keys)
    keys, a = keys[order], a[order]
    c = _count_given(clean, keys)
    odds = (a + 0.1) / (n1 + 1) / ((c + 0.1) / (n0 + 1))
    keep = np.flatnonzero(odds >= LEAST_ODDS)
    keep = np.sort(keep[np.lexsort((keys[keep], -a[keep]))[:TERMS]])
    keys, df = keys[keep], (a + c)[keep]
    idf = np.log((n1 + n0 + 1) / (df + 1)) + 1
    shared = spark.sparkContext.broadcast(keys)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder(shared.value)
        for b in batches:
            label, order_, ids = b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3)
            for lo, _, data, offsets in slices(b.column(0)):
                got = list(_by_row(*find(data, offsets))) if len(shared.value) else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(label[lo + r]) for r, _, _ in got], pa.int32()), pa.array([int(order_[lo + r]) for r, _, _ in got], pa.int64()), ids.take(pa.array([lo + r for r, _, _ in got], pa.int64())), pa.array([t.tolist() for _, t, _ in got], pa.list_(pa.int64())), pa.array([f.tolist() for _, _, f in got], pa.list_(pa.int64()))],
                    ["label", "by", "doc_id", "term", "tf"],
                )

    # equal texts are one example; examples in the order of a hash of the text, a fair sample
    named = F.col("doc_id") if "doc_id" in rows.columns else F.lit(None)
    found = rows.select("text", F.col("label").cast("int").alias("label"), F.xxhash64("text").alias("by"), named.cast("bigint").alias("doc_id")).mapInArrow(vectors, "label int, by bigint, doc_id bigint, term array<bigint>, tf array<bigint>")
    texts = {r["label"]: r["n"] for r in found.groupBy("label").agg(F.count_distinct("by").alias("n")).collect()}
    sample, stands_for = [], []
    for label in (0, 1):
        sample += found.where(F.col("label") == label).groupBy("by").agg(F.min(F.struct("term", "tf")).alias("v"), F.min("doc_id").alias("doc_id")).orderBy("by").limit(EXAMPLES).select(F.lit(label).alias("label"), "doc_id", "v.term", "v.tf").collect()
        stands_for += [texts[label] / (len(sample) - len(stands_for))] * (len(sample) - len(stands_for)) if label in texts else []
    index = Index(idf, [(np.array(r["term"]), np.array(r["tf"])) for r in sample], np.array([r["label"] for r in sample]), np.array(stands_for), [r["doc_id"] for r in sample])
    return Model(keys, index if sample else None, rate)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of every row of `docs`.

    Null and empty texts, and texts with none of the telling terms, score the base rate (0 if there
    was nothing to learn from), without evidence. Evidence are the nearest examples, equal texts by their
    smallest id; equally near ones go by their place in the index. Repeated rows are scored each, texts of
    any length whole; other columns aren't looked at, and an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in slices(b.column(2)):
                score, evidence = shared.value.judge(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(evidence, _EVIDENCE)], ["doc_id", "held_out", "score", "predicted", "evidence"]
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(folds=5, fold=0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from the labels of documents that aren't held out (crc32 of the id, remainder 0 of 5), then scores all.

    Of more than LABELLED labels a sample counts. Labels other than 0 and 1 and null are left out; a document labelled twice counts twice.
    """
    known = labels.where("toxic in (0, 1)").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    known = known.where(~held_out(folds=5, fold=0)).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(LABELLED)
    texts = docs.where("text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # bounded, so texts need no shuffle to meet their labels; they are read once for all that training asks
    return predict(docs, train(cut(texts.join(F.broadcast(known), "doc_id").select("doc_id", "text", "label"))))
