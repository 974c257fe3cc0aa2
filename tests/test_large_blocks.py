"""Clusters of one document and large blocks: the same results, without pooling the ones and without rows of all pairs of the others."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenvec.model import to_rows
from lumenvec.operators import blocks, clusters, seismic


def frame(spark, rows, key):
    return spark.createDataFrame([(i, t, float(w)) for i, r in rows for t, w in r.items()], f"{key} long, term long, weight double")


@pytest.fixture(scope="module")
def some(spark):
    """Documents by id, and their vectors: a list of a term is the longer the smaller it is; weights are sixteenths, and some 0."""
    rng = np.random.default_rng(5)
    docs = [{int(t): int(rng.integers(0, 33)) / 16 for t in np.unique(rng.geometric(0.15, 1 + rng.integers(8)))} for _ in range(120)]
    return docs, frame(spark, enumerate(docs), "doc_id").cache()


def table(of, *columns):
    return sorted(map(tuple, of.select(*columns).collect()))


def test_clusters_of_one_are_not_pooled(spark, some, monkeypatch):
    v = some[1]
    member = seismic.lists(v, 30, 9, 3, True).cache()
    plain = clusters.alpha_mass(clusters.max_pool(member, v), 0.6)
    alone = member.groupBy("term", "cluster").count().where("count = 1").count()
    pool, pooled = seismic.max_pool, []

    def watched(m, of):
        pooled.append(m.groupBy("term", "cluster").count().where("count = 1").count())
        return pool(m, of)

    monkeypatch.setattr(seismic, "max_pool", watched)
    columns = ("term", "cluster", "s_term", "s_value")
    assert table(seismic.summaries(member, v, 0.6), *columns) == table(plain, *columns)
    own = ("term", "cluster", "size", "s_terms", "s_values")
    assert table(seismic.summary_rows(member, to_rows(v), 0.6), *own) == table(blocks.directory(member, plain), *own)
    assert alone and pooled == [0, 0]


def test_lists_of_centroids_need_no_vectors(spark, some):
    v = some[1]
    marked = clusters.marked(to_rows(v), 0, 200, 3)
    nothing = to_rows(v).limit(0)
    assert table(clusters.sized(marked, nothing), "term", "doc_id", "pos", "size") == table(v.select("term", "doc_id", F.lit(0).alias("pos"), F.lit(1).alias("size")), "term", "doc_id", "pos", "size")


@pytest.mark.parametrize("large", [False, True])
def test_large_blocks_give_only_their_best(spark, some, monkeypatch, large):
    monkeypatch.setattr(blocks, "TILE_LEAST", 4)
    monkeypatch.setattr(blocks, "TILE_DOCS", 16)
    if large:
        monkeypatch.setattr(blocks, "LOCAL_ROWS", 3)
        monkeypatch.setattr(blocks.tiles, "BLOCK_ENTRIES", 20)
    docs, v = some
    q = frame(spark, [(i, docs[i]) for i in range(0, 120, 10)] + [(500, {999: 1})], "qid")
    member = seismic.lists(v, 0, 3, 2).cache()
    summary = seismic.summaries(member, v, 1.5).cache()
    directory, rows = blocks.directory(member, summary).cache(), blocks.block_rows(member, v).cache()
    own = ("qid", "rank", "doc_id", "score")
    for heap, strata in ((1.0, ()), (1.0, (1, 3)), (1e9, ())):
        want = seismic.search(q, member, summary, v, 2, 5, heap)
        got = table(blocks.search(q, directory, rows, 2, 5, heap, strata=strata), *own)
        assert strata or got == table(want, *own)
    done = seismic.work(q, member, summary, v, 2, 5, 1e9)
    assert table(blocks.work(q, directory, rows, 2, 5, 1e9), "qid", "n_candidates", "n_evaluated") == table(done, "qid", "n_candidates", "n_evaluated")
    *_, (_, found) = blocks.rounds(q, directory, rows, 2, 5, 1e9)
    # 12 queries, 5 lists of 3 blocks, 3 tiles at most, 2 documents of each; all opened documents are more
    assert found.groupBy("qid").count().agg(F.max("count")).first()[0] <= 5 * 3 * 4 * 2 < done.agg(F.max("n_candidates")).first()[0] * 2
