"""Clusters of posting lists and their summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenvec.model import to_rows


def centroids(pruned: DataFrame, beta: int, seed: int) -> DataFrame:
    """(term, cluster, doc_id): beta documents of each list, drawn by a seeded hash; beta 0 means the root of the list's size."""
    n = F.count("*").over(Window.partitionBy("term"))
    drawn = Window.partitionBy("term").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "term", "doc_id")), F.asc("doc_id"))
    want = F.floor(F.sqrt("n")) if beta == 0 else F.col("n") if beta < 0 else F.least(F.lit(beta), F.col("n"))
    c = pruned.withColumn("n", n).withColumn("cluster", F.row_number().over(drawn) - 1)
    return c.where(F.col("cluster") < F.greatest(F.lit(1), want)).select("term", "cluster", "doc_id")


def marked(rows: DataFrame, lam: int, beta: int, seed: int, every: bool = False) -> DataFrame:
    """(term, doc_id, cluster, n, others): what `prune` (every: `prune_keeping`) leaves of each list, and of `centroids` the clusters they found, else null.

    rows: vectors as rows; n: the list's length; others: whether it has documents that are no centroids.
    Lists are dealt once for all of it, and a document's heaviest term is found in its row.
    """
    own = F.array_max(F.transform(F.arrays_zip("terms", "weights"), lambda e: F.named_struct(F.lit("w"), e["weights"], F.lit("t"), -e["terms"])))
    of = rows.select("doc_id", own["t"].alias("own"), F.explode(F.arrays_zip("terms", "weights")).alias("e"))
    of = of.select(F.col("e.terms").alias("term"), "doc_id", F.col("e.weights").alias("weight"), (F.col("e.terms") == -F.col("own")).alias("own"))
    by = Window.partitionBy("term")
    if lam > 0:
        of = of.withColumn("r", F.row_number().over(by.orderBy(F.desc("weight"), F.asc("doc_id"))))
        of = of.where((F.col("r") <= lam) | F.col("own") if every else F.col("r") <= lam)
    drawn = by.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "term", "doc_id")), F.asc("doc_id"))
    of = of.select("term", "doc_id", F.count("*").over(by).alias("n"), (F.row_number().over(drawn) - 1).alias("cluster"))
    want = F.greatest(F.lit(1), F.floor(F.sqrt("n")) if beta == 0 else F.col("n") if beta < 0 else F.least(F.lit(beta), F.col("n")))
    return of.select("term", "doc_id", F.when(F.col("cluster") < want, F.col("cluster")).alias("cluster"), "n", (F.col("n") > want).alias("others"))


#: Documents of a list that meet its centroids in one place, about; products worked out at a time.
BLOCK_DOCS, CHUNK_PRODUCTS = 1024, 1 << 22


def members(pruned: DataFrame, centers: DataFrame, vectors: DataFrame) -> DataFrame:
    """(term, cluster, pos, doc_id): every posting in the cluster of the centroid most like it; the centroid is at 0.

    Ties go to the lowest cluster, and so do documents that share nothing with any centroid. A long
    list is dealt in blocks of about BLOCK_DOCS documents, each with a copy of the list's centroids.
    """
    of = pruned.select("term", "doc_id").join(centers.select("term", "doc_id", "cluster"), ["term", "doc_id"], "left")
    by = Window.partitionBy("term")
    of = of.select("term", "doc_id", "cluster", F.count("*").over(by).alias("n"), (F.count("cluster").over(by) < F.count("*").over(by)).alias("others"))
    return sized(of, to_rows(vectors)).drop("size")


def sized(of: DataFrame, rows: DataFrame) -> DataFrame:
    """(term, cluster, pos, doc_id, size): the same of `marked` lists, with the clusters' sizes. Lists of centroids alone need no vectors."""
    alone = of.where(~F.col("others")).select("term", "cluster", F.lit(0).alias("pos"), "doc_id", F.lit(1).cast("bigint").alias("size"))
    of = of.where("others")
    centers = of.where("cluster is not null")
    own = of.select("term", "doc_id", "cluster", F.ceil(F.col("n") / BLOCK_DOCS).cast("int").alias("blocks"))
    of = own.join(rows, "doc_id").select("term", "blocks", "doc_id", "cluster", "terms", "weights")
    every = F.when(F.col("cluster").isNull(), F.array(F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = of.select("term", F.explode(every).alias("block"), "cluster", "doc_id", "terms", F.col("weights").cast("array<double>").alias("weights"))
    # centroids come before the documents of their block
    dealt = dealt.repartition("term", "block").sortWithinPartitions("term", "block", F.desc_nulls_last("cluster"), "doc_id")
    placed = dealt.select(F.col("term").cast("bigint"), "block", "cluster", F.col("doc_id").cast("bigint"), "terms", "weights").mapInArrow(_assigned, "term bigint, cluster int, doc_id bigint")
    kinds = {c: centers.schema[c].dataType for c in ("term", "doc_id")}
    placed = placed.select(F.col("term").cast(kinds["term"]), "cluster", F.col("doc_id").cast(kinds["doc_id"]), F.lit(1).alias("late"))
    every = placed.unionByName(centers.select("term", "cluster", "doc_id", F.lit(0).alias("late")))
    order = Window.partitionBy("term", "cluster").orderBy("late", "doc_id")
    size = F.count("*").over(Window.partitionBy("term", "cluster"))
    return alone.unionByName(every.select("term", "cluster", (F.row_number().over(order) - 1).alias("pos"), "doc_id", size.alias("size")))


def _assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, cluster, doc_id) of the documents in a stream of blocks, each after its centroids; a block's centroids are kept until it ends."""
    kept: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        table = pa.Table.from_batches([b])
        table = table if kept is None else pa.concat_tables([kept, table])
        table = table.combine_chunks()
        term, block = table["term"].to_numpy(), table["block"].to_numpy()
        group = np.concatenate([[0], np.cumsum((term[1:] != term[:-1]) | (block[1:] != block[:-1]))])
        center = table["cluster"].is_valid().to_numpy()
        docs = np.flatnonzero(~center)
        if len(docs):
            yield pa.RecordBatch.from_arrays([pa.array(term[docs], pa.int64()), pa.array(_nearest(table, group, np.flatnonzero(center), docs), pa.int32()), pa.array(table["doc_id"].to_numpy()[docs], pa.int64())], ["term", "cluster", "doc_id"])
        kept = table.filter(pa.array(center & (group == group[-1])))


def _entries(table: pa.Table, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row's number, term, weight) of the vectors of these rows."""
    terms, weights = (table[c].combine_chunks().take(pa.array(rows)) for c in ("terms", "weights"))
    terms, weights = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (terms, weights))
    return np.repeat(np.arange(len(rows)), np.diff(terms.offsets.to_numpy())), terms.flatten().to_numpy().astype(np.int64), weights.flatten().to_numpy()


def _nearest(table: pa.Table, group: np.ndarray, centers: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The cluster of each document: that of the centroid of its group with the largest product, rounded to 6 digits, if it is above 0."""
    cluster = table["cluster"].combine_chunks().take(pa.array(centers)).to_numpy().astype(np.int64)
    of, term, weight = _entries(table, centers)
    key = (group[centers][of] << 32) | term
    order = np.argsort(key, kind="stable")
    key, of, weight = key[order], of[order], weight[order]
    row, own, value = _entries(table, docs)
    own = (group[docs][row] << 32) | own
    lo, hi = np.searchsorted(key, own), np.searchsorted(key, own, side="right")
    n = np.cumsum(hi - lo)
    out = np.zeros(len(docs), np.int64)
    # documents in slices, so that products stay bounded
    ends = np.searchsorted(row, np.arange(1, len(docs) + 1))
    first = 0
    while first < len(docs):
        start = ends[first - 1] if first else 0
        done = n[start - 1] if start else 0
        total = np.concatenate([[0], n])[ends[first:]] - done
        last = first + max(int(np.searchsorted(total, CHUNK_PRODUCTS, side="right")), 1)
        here = slice(start, ends[last - 1])
        size = (hi - lo)[here]
        at = np.repeat(lo[here], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        pair = np.repeat(row[here] - first, size) * len(centers) + of[at]
        pairs, which = np.unique(pair, return_inverse=True)
        like = np.round(np.bincount(which, np.repeat(value[here], size) * weight[at], len(pairs)), 6)
        doc, c = pairs // len(centers), cluster[pairs % len(centers)]
        best = np.lexsort((c, -like, doc))
        doc, c, like = doc[best], c[best], like[best]
        head = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
        head = head[like[head] > 0]
        out[first + doc[head]] = c[head]
        first = last
    return out


def max_pool(member: DataFrame, vectors: DataFrame) -> DataFrame:
    """(term, cluster, s_term, s_value): largest weight of each term in each cluster, at least 0."""
    of = vectors.select("doc_id", F.col("term").alias("s_term"), F.col("weight").cast("double").alias("w"))
    return member.select("term", "cluster", "doc_id").join(of, "doc_id").groupBy("term", "cluster", "s_term").agg(F.greatest(F.lit(0.0), F.max("w")).alias("s_value"))


def alpha_mass(pooled: DataFrame, alpha: float) -> DataFrame:
    """The heaviest summary terms up to and with the one that reaches the share alpha; all of them if all are 0."""
    by = Window.partitionBy("term", "cluster")
    order = by.orderBy(F.desc("s_value"), F.asc("s_term"))
    s = pooled.withColumn("r", F.row_number().over(order)).withColumn("total", F.sum("s_value").over(by))
    s = s.withColumn("before", F.coalesce(F.sum("s_value").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    keep = (F.col("r") == 1) | (F.col("total") == 0) | (F.round("before", 6) < F.round(F.lit(float(alpha)) * F.col("total"), 6))
    return s.where(keep).select("term", "cluster", "s_term", "s_value")


def cut_rows(rows: DataFrame, alpha: float) -> DataFrame:
    """(doc_id, e): of each vector what `alpha_mass` leaves of a cluster with it alone, as an array of (s_term, s_value) by term."""
    zero = F.lit(0.0)
    down = F.array_sort(F.transform(F.arrays_zip("terms", "weights"), lambda e: F.named_struct(F.lit("v"), -F.greatest(zero, e["weights"].cast("double")), F.lit("t"), e["terms"])))
    of = rows.select("doc_id", down.alias("a")).withColumn("total", F.aggregate("a", zero, lambda s, e: s - e["v"]))
    least = F.round(F.lit(float(alpha)) * F.col("total"), 6)
    start = F.named_struct(F.lit("before"), zero, F.lit("n"), F.lit(0))
    more = lambda s, e: F.named_struct(F.lit("before"), s["before"] - e["v"], F.lit("n"), s["n"] + F.when((s["n"] == 0) | (F.round(s["before"], 6) < least), 1).otherwise(0))
    kept = F.when(F.col("total") == 0, F.size("a")).otherwise(F.aggregate("a", start, more)["n"])
    return of.select("doc_id", F.array_sort(F.transform(F.slice("a", F.lit(1), kept), lambda e: F.named_struct(F.lit("s_term"), e["t"], F.lit("s_value"), -e["v"]))).alias("e"))


def blocks(member: DataFrame, vectors: DataFrame) -> DataFrame:
    """(term, cluster, doc_id, s_term, weight): each block with its documents' vectors, ordered so that row groups prune."""
    of = vectors.select("doc_id", F.col("term").alias("s_term"), "weight")
    return member.select("term", "cluster", "doc_id").join(of, "doc_id").select("term", "cluster", "doc_id", "s_term", "weight")
