"""Exact search in tiles against plain sums, and that it makes no rows of pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenvec.operators import exact, maxscore, tiles


def vectors(seed, n, dim, sign=0):
    """Vectors of very different lengths, many of them alike; weights in quarters, so that sums are exact."""
    rng = np.random.default_rng(seed)
    kinds = [{int(t): int(rng.integers(1, 9)) / 4 - sign for t in rng.choice(dim, 1 + rng.integers(dim), replace=False)} for _ in range(n // 3)]
    return [kinds[rng.integers(len(kinds))] for _ in range(n)]


def frame(spark, rows, key):
    return spark.createDataFrame([(3 * i, t, float(w)) for i, r in enumerate(rows) for t, w in r.items()], f"{key} long, term long, weight double")


def brute(asked, docs, k, zeros):
    out = []
    for q, query in enumerate(asked):
        found = sorted((-sum(w * d.get(t, 0) for t, w in query.items()), i) for i, d in enumerate(docs))
        out += [(3 * q, r, 3 * i, -s + 0.0) for r, (s, i) in enumerate([x for x in found if zeros or x[0] < 0][:k], 1)]
    return sorted(out)


def rows_of(found):
    return sorted(map(tuple, found.select("qid", "rank", "doc_id", "score").collect()))


@pytest.fixture
def small(monkeypatch):
    for name, value in {"TASKS": 6, "TILE_QUERIES": 7, "TILE_CELLS": 150, "CHUNK_PRODUCTS": 40, "DENSE_CELLS": 400, "BLOCK_ENTRIES": 300}.items():
        monkeypatch.setattr(tiles, name, value)


@pytest.mark.parametrize("k,digits,bounds,sign,share", [(1, 6, False, 0, 0.1), (5, 6, True, 0, 0.3), (5, None, True, 1, 2.0), (200, None, False, 1, 0.0)])
def test_tiles_leave_nothing_out(spark, small, monkeypatch, k, digits, bounds, sign, share):
    monkeypatch.setattr(tiles, "DENSE_SHARE", share)
    docs = vectors(1, 120, 30, sign)
    asked = docs[::3]
    q, v = frame(spark, asked, "qid"), frame(spark, docs, "doc_id")
    assert rows_of(tiles.search(q, v, k, (40, 600), digits, bounds)) == brute(asked, docs, k, False)


def test_whole_scores_stay_whole(spark, small):
    docs = [{t: int(4 * w) for t, w in d.items()} for d in vectors(2, 90, 20)]
    q, v = (frame(spark, x, key).withColumn("weight", F.col("weight").cast("int")) for x, key in ((docs[::2], "qid"), (docs, "doc_id")))
    found = tiles.search(q, v, 4, (45, 400))
    assert dict(found.dtypes)["score"] == "bigint" and rows_of(found) == brute(docs[::2], docs, 4, False)


def test_all_documents_count_where_zeros_do(spark, small):
    docs = vectors(3, 60, 12, 1) + [{}, {}]
    asked = vectors(4, 40, 12) + [{}]
    q, v = frame(spark, asked, "qid"), frame(spark, docs, "doc_id")
    ids = [spark.range(0, 3 * len(x), 3).select(F.col("id").alias(key)) for x, key in ((asked, "qid"), (docs, "doc_id"))]
    assert rows_of(exact.brute(q, ids[0], v, ids[1], 55, 6)) == brute(asked, docs, 55, True)


def test_pairs_are_not_rows(spark):
    """Of a batch whose pairs nearly all share a term only the k best of each group leave a task."""
    docs = vectors(5, 300, 8)
    v = frame(spark, docs, "doc_id").cache()
    for q, many in ((v.where("doc_id % 5 = 0"), 60), (v.where("doc_id % 90 = 0"), 10)):
        q = q.withColumnRenamed("doc_id", "qid")
        lists = maxscore.lists(v)
        for found in (exact.inverted(q, v, 3, digits=6), maxscore.search(q, lists, maxscore.band_stats(lists), 3, 6)):
            assert ("Join" not in found._jdf.queryExecution().optimizedPlan().toString()) == (many >= tiles.LEAST_QUERIES)
            assert found.count() == 3 * many
    v.unpersist()


def test_sparse_batches_are_joined(spark):
    q = spark.range(0, 100).select(F.col("id").alias("qid"), F.col("id").alias("term"), F.lit(1.0).alias("weight"))
    assert tiles.planned(q) is None and tiles.planned(q.withColumn("term", F.lit(7))) == (100, 100)


def test_blocks_and_groups_stay_bounded():
    for asked, entries, k in ((1, 1, 1), (6_000, 200_000, 10), (30_000, 7_000_000, 10), (5_400, 27_000, 2_000)):
        groups, blocks = tiles.dealt(asked, entries, k)
        assert groups * blocks >= tiles.TASKS / 2 and entries / blocks <= tiles.BLOCK_ENTRIES and asked * k * groups <= 2 * tiles.ALL_RESULTS
