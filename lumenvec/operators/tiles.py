"""Exact search in tiles, for batches whose pairs of query and document nearly all share a term.

A join on terms makes rows of all such pairs, whose number is the square of the input's. Here documents are
dealt in groups and queries in blocks; a group meets a block in one stream, queries first, and only the
k best of each query leave it, so what is shuffled grows as the input does. The products, still all of
them, are worked out in numpy, a tile of queries and documents at a time: terms that many of both have
as a product of matrices, the others by the entries that meet.

With `bounds` a group's documents come by falling norm, and a tile's queries that neither the norms
(Cauchy and Schwarz) nor the largest weights of its terms let reach their k-th best score are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType, IntegralType, LongType

from lumenvec.model import to_rows, to_triples
from lumenvec.operators.topk import check_k, top_k

#: Fewer queries make no more pairs than so many a document, which a join bears.
LEAST_QUERIES = 32
#: Products a pair from which tiles are less work than rows.
LEAST_PRODUCTS = 0.25
#: Pairs of a block and a group, about; entries, and rows of results, of a block at most; rows of all groups' results, about.
TASKS, BLOCK_ENTRIES, BLOCK_RESULTS, ALL_RESULTS = 64, 1 << 22, 1 << 22, 1 << 26
#: Queries of a tile, its cells and products worked out at a time, and cells of a matrix of frequent terms.
TILE_QUERIES, TILE_CELLS, CHUNK_PRODUCTS, DENSE_CELLS = 1024, 1 << 22, 1 << 20, 1 << 23
#: A term is a matrix's column if this share of pairs have it on both sides: a product by entries takes about so many times as long.
DENSE_SHARE = 1 / 256


def measured(queries: DataFrame) -> tuple[int, int, float]:
    """(queries, their entries, products a pair of different queries), which tell what to expect of documents like them."""
    queries = to_triples(queries, "qid") if "terms" in queries.columns else queries
    asked = queries.select("qid").distinct().count()
    by_term = queries.groupBy("term").agg(F.count("*").cast("double").alias("n"))
    n, pairs = by_term.agg(F.sum("n"), F.sum(F.col("n") * (F.col("n") - 1))).first()
    return asked, int(n or 0), (pairs or 0) / max(asked * (asked - 1), 1)


def planned(queries: DataFrame) -> tuple[int, int] | None:
    """(queries, entries) if searching the batch in tiles is less work than joining it, else None."""
    asked, entries, products = measured(queries)
    return (asked, entries) if asked >= LEAST_QUERIES and products >= LEAST_PRODUCTS else None


def dealt(asked: int, entries: int, k: int) -> tuple[int, int]:
    """(groups of documents, blocks of queries): blocks fit a task, and groups are few enough for all their results."""
    blocks = max(1, -(-entries // BLOCK_ENTRIES), -(-asked * k // BLOCK_RESULTS))
    groups = max(1, min(TASKS // blocks, ALL_RESULTS // max(asked * k, 1)))
    return groups, max(blocks, -(-TASKS // groups))


def search(queries: DataFrame, vectors: DataFrame, k: int, size: tuple[int, int], digits: int | None = None, bounds: bool = False, zeros: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(qid, rank, doc_id, score): the k best documents of each query with a score above 0, ties by id.

    Both may be triples, or rows, which need no shuffle of their own. size: `planned`; zeros: ids of
    (queries, documents), of which all count, whatever their score.
    """
    groups, blocks = dealt(*size, check_k(k))
    kinds = {c: [x.schema[f"{c}s"].dataType.elementType if "terms" in x.columns else x.schema[c].dataType for x in (queries, vectors)] for c in ("term", "weight")}
    whole = all(isinstance(t, IntegralType) for t in kinds["weight"])
    long = any(isinstance(t, LongType) for t in kinds["weight"])
    weight = ("bigint" if long else "int") if whole else "float" if all(isinstance(t, FloatType) for t in kinds["weight"]) else "double"
    term = "bigint" if any(isinstance(t, LongType) for t in kinds["term"]) else "int"

    def rows(of: DataFrame, key: str, every: DataFrame | None) -> DataFrame:
        arrays = (of if "terms" in of.columns else to_rows(of, key)).select(F.col(key).cast("bigint").alias("id"), F.col("terms").cast(f"array<{term}>").alias("terms"), F.col("weights").cast(f"array<{weight}>").alias("weights"))
        if every is None:
            return arrays
        own = every.select(F.col(key).cast("bigint").alias("id")).distinct().join(arrays, "id", "left")
        return own.select("id", F.coalesce("terms", F.array().cast(f"array<{term}>")).alias("terms"), F.coalesce("weights", F.array().cast(f"array<{weight}>")).alias("weights"))

    q, d = (rows(of, key, every) for of, key, every in zip((queries, vectors), ("qid", "doc_id"), zeros or (None, None)))
    norm = F.sqrt(F.aggregate("weights", F.lit(0.0), lambda s, w: s + w.cast("double") * w.cast("double")))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.select(all_of(groups).alias("g"), "id", "terms", "weights").select("g", own(blocks).alias("b"), F.lit(False).alias("doc"), F.lit(0.0).alias("by"), "id", "terms", "weights")
    d = d.select(all_of(blocks).alias("b"), "id", "terms", "weights").select(own(groups).alias("g"), "b", F.lit(True).alias("doc"), (-norm if bounds else F.lit(0.0)).alias("by"), "id", "terms", "weights")
    # a number of partitions, as small ones would be put together by their bytes, not by their work
    met = q.unionByName(d).repartition(2 * groups * blocks, "g", "b").sortWithinPartitions("g", "b", "doc", "by", "id")
    found = best_of(met, k, digits, whole, bounds, zeros is not None)
    found = found.select(F.col("qid").cast(queries.schema["qid"].dataType), F.col("doc_id").cast(vectors.schema["doc_id"].dataType), F.col("score").cast("bigint" if whole else "double"))
    return top_k(found, k)


def best_of(met: DataFrame, k: int, digits: int | None, whole: bool, bounds: bool, every: bool) -> DataFrame:
    """(qid, doc_id, score) of the k best documents for each query of a block and group.

    met: (g, b, doc, by, id, terms, weights), whole numbers g and b naming group and block, sorted by all up to id; every: whether scores of 0 and below count.
    """
    step = 1.0 if whole else 10.0**-digits if digits is not None else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, at = None, None
        for b in batches:
            pair = np.stack([b.column(c).to_numpy().astype(np.int64) for c in (0, 1)], 1)
            edges = [0, *(np.flatnonzero(np.diff(pair, axis=0).any(1)) + 1).tolist(), len(pair)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if tuple(pair[lo]) != at:
                    if one is not None:
                        yield from one.found()
                    one, at = _Block(k, step, whole, bounds, every), tuple(pair[lo])
                part = b.slice(lo, hi - lo)
                n = hi - lo - part.column(2).true_count
                one.ask(part.slice(0, n))
                one.meet(part.slice(n))
        if one is not None:
            yield from one.found()

    return met.mapInArrow(run, "qid bigint, doc_id bigint, score double")


def _entries(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets from 0, terms, weights)."""
    terms, weights = part.column(5), part.column(6)
    at = terms.offsets.to_numpy()
    values = [x.values.slice(x.offsets[0].as_py(), x.offsets[-1].as_py() - x.offsets[0].as_py()).to_numpy(zero_copy_only=False) for x in (terms, weights)]
    return part.column(4).to_numpy(), at - at[0], values[0].astype(np.int64), values[1].astype(np.float64)


def _norms(row: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    return np.sqrt(np.bincount(row, weight * weight, n))


class _Block:
    """A block of queries, and the best of the documents it has met."""

    def __init__(self, k: int, step: float, whole: bool, bounds: bool, zeros: bool):
        self.k, self.step, self.whole, self.bounds, self.zeros = k, step, whole, bounds, zeros
        self.asked: list[tuple[np.ndarray, ...]] = []
        self.ids: np.ndarray | None = None
        self.pool: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def ask(self, part: pa.RecordBatch) -> None:
        if part.num_rows:
            self.asked.append(_entries(part))

    def _build(self, docs: int, term: np.ndarray) -> None:
        """Queries in order of their entries' terms, tile by tile; the first documents met tell which terms are frequent."""
        self.ids = np.concatenate([x[0] for x in self.asked])
        sizes = np.concatenate([np.diff(x[1]) for x in self.asked])
        terms, weights = (np.concatenate([x[c] for x in self.asked]) for c in (2, 3))
        self.asked, n = [], len(self.ids)
        row = np.repeat(np.arange(n), sizes)
        self.terms, of = np.unique(terms, return_inverse=True)
        self.norm = _norms(row, weights, n)
        # below it a score doesn't count
        self.floor = np.full(n, -np.inf if self.zeros else 0.49 * self.step or np.nextafter(0, 1))
        found = self._placed(term)
        both = np.bincount(of, minlength=len(self.terms)) / n * (np.bincount(found[found >= 0], minlength=len(self.terms)) / docs)
        most = max(1, DENSE_CELLS // max(n, TILE_CELLS // min(n, TILE_QUERIES)))
        frequent = np.argsort(-both, kind="stable")[:most]
        frequent = np.sort(frequent[both[frequent] >= DENSE_SHARE])
        self.column = np.full(len(self.terms), -1)
        self.column[frequent] = np.arange(len(frequent))
        self.columns = len(frequent)
        self.tiles = []
        for lo in range(0, n, TILE_QUERIES):
            hi = min(lo + TILE_QUERIES, n)
            here = slice(*np.searchsorted(row, [lo, hi]))
            r, t, w = row[here] - lo, of[here], weights[here]
            dense = self.column[t] >= 0
            matrix = np.bincount(r[dense] * self.columns + self.column[t[dense]], w[dense], (hi - lo) * self.columns).reshape(hi - lo, self.columns)
            order = np.argsort(t[~dense], kind="stable")
            start = np.concatenate([[0], np.cumsum(np.bincount(t[~dense], minlength=len(self.terms)))])
            self.tiles.append((lo, hi, matrix, start, r[~dense][order], w[~dense][order], (r, t, np.abs(w))))

    def _placed(self, term: np.ndarray) -> np.ndarray:
        """The place of each term among the queries' terms, -1 for others."""
        if not len(self.terms):
            return np.full(len(term), -1)
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        return np.where(self.terms[at] == term, at, -1)

    def meet(self, part: pa.RecordBatch) -> None:
        """Documents: of a tile of queries and some of these the scores are worked out, and those that reach a query's k-th best kept."""
        if not part.num_rows or not (self.asked or self.ids is not None):
            return
        ids, at, term, weight = _entries(part)
        if self.ids is None:
            self._build(len(ids), term)
        n = max(1, TILE_CELLS // min(len(self.ids), TILE_QUERIES))
        for lo in range(0, len(ids), n):
            own = at[lo : lo + n + 1]
            here = slice(own[0], own[-1])
            row = np.repeat(np.arange(len(own) - 1), np.diff(own))
            place, w = self._placed(term[here]), weight[here]
            longest = _norms(row, w, len(own) - 1).max()
            there = place >= 0
            row, place, w = row[there], place[there], w[there]
            dense = self.column[place] >= 0
            docs = np.bincount(row[dense] * self.columns + self.column[place[dense]], w[dense], (len(own) - 1) * self.columns).reshape(len(own) - 1, self.columns)
            rest = (row[~dense], place[~dense], w[~dense])
            largest = None
            if self.bounds:
                largest = np.zeros(len(self.terms))
                np.maximum.at(largest, place, np.abs(w))
            for tile in self.tiles:
                self._score(tile, ids[lo : lo + n], docs, rest, longest, largest)

    def _score(self, tile, ids, docs, rest, longest, largest) -> None:
        lo, hi, matrix, start, q_row, q_weight, (r, t, size) = tile
        alive = np.arange(hi - lo)
        if largest is not None:
            reach = np.minimum(self.norm[lo:hi] * longest, np.bincount(r, size * largest[t], hi - lo)) * (1 + 1e-9) + 1e-9
            alive = np.flatnonzero(reach >= self.floor[lo:hi])
            if not len(alive):
                return
        to = np.full(hi - lo, -1)
        to[alive] = np.arange(len(alive))
        scores = (matrix if len(alive) == hi - lo else matrix[alive]) @ docs.T
        cells = scores.reshape(-1)
        row, place, weight = rest
        many = start[place + 1] - start[place]
        ends = np.cumsum(many)
        first = 0
        while first < len(row):
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + CHUNK_PRODUCTS, side="right")))
            count = many[first:last]
            which = np.repeat(np.arange(first, last), count)
            at = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + start[place[which]]
            of = to[q_row[at]]
            value = q_weight[at] * weight[which]
            cell = of * len(ids) + row[which]
            if len(alive) < hi - lo:
                cell, value = cell[of >= 0], value[of >= 0]
            np.add.at(cells, cell, value)
            first = last
        self._keep(lo + alive, ids, scores)

    def _keep(self, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        hit = scores >= self.floor[queries][:, None]
        if np.count_nonzero(hit) > 4 * self.k * len(queries) and len(ids) > self.k:
            least = np.partition(scores, len(ids) - self.k, axis=1)[:, len(ids) - self.k]
            self.floor[queries] = np.maximum(self.floor[queries], self._below(least))
            hit = scores >= self.floor[queries][:, None]
        q, d = np.nonzero(hit)
        if len(q):
            self.pool.append((queries[q], ids[d], self._rounded(scores[q, d])))
            self.held += len(q)
            if self.held > 2 * self.k * len(self.ids) + 65536:
                self._trim()

    def _below(self, score: np.ndarray) -> np.ndarray:
        """What a score must reach to be rounded to this one, at least."""
        return score - 0.51 * self.step - 1e-12 * np.abs(score)

    def _rounded(self, score: np.ndarray) -> np.ndarray:
        if self.whole or not self.step:
            return score
        scale = round(1 / self.step)
        return np.copysign(np.floor(np.abs(score) * scale + 0.5) / scale, score) + 0.0

    def _trim(self) -> None:
        """Leaves each query its k best; others must reach the k-th, or, as documents come by id, be above it."""
        q, d, s = (np.concatenate(x) for x in zip(*self.pool))
        order = np.lexsort((d, -s, q))
        q, d, s = q[order], d[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        last = rank == self.k - 1
        kth = s[last]
        above = np.nextafter(kth, np.inf) if not self.step else kth + 0.49 * self.step
        self.floor[q[last]] = np.maximum(self.floor[q[last]], self._below(kth) if self.bounds else above)
        keep = rank < self.k
        self.pool, self.held = [(q[keep], d[keep], s[keep])], int(keep.sum())

    def found(self) -> Iterator[pa.RecordBatch]:
        if self.pool:
            self._trim()
        for q, d, s in self.pool:
            if not self.zeros:
                q, d, s = (x[s > 0] for x in (q, d, s))
            for lo in range(0, len(q), 1 << 16):
                here = slice(lo, lo + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(self.ids[q[here]]), pa.array(d[here]), pa.array(s[here])], ["qid", "doc_id", "score"])
