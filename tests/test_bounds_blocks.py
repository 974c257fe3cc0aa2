"""Search by upper bounds and over blocks, against plain sums and against each other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenvec.operators import blocks, exact, maxscore, seismic
from lumenvec.operators.selectors import FrameSelector, SetSelector, is_small
from lumenvec.plans import store
from lumenvec.plans.index import SeismicParameters, index_factory, read_index, write_index


def frame(spark, rows, key):
    return spark.createDataFrame([(i, t, float(w)) for i, r in enumerate(rows) for t, w in r.items()], f"{key} long, term long, weight double")


def zipf(seed, n, dim, longest):
    """Vectors of very different lengths whose terms are drawn by rank, in 64ths, so that sums are exact."""
    rng = np.random.default_rng(seed)
    p = 1 / np.arange(1, dim + 1)
    drawn = (np.unique(rng.choice(dim, 1 + rng.integers(longest) // (1 + rng.integers(8)), p=p / p.sum()), return_counts=True) for _ in range(n))
    return [dict(zip(terms.tolist(), counts.tolist())) for terms, counts in drawn]


def rows_of(found):
    return sorted(map(tuple, found.select("qid", "rank", "doc_id", "score").collect()))


def brute(docs, asked, k):
    out = []
    for q, query in enumerate(asked):
        found = sorted((-float(sum(w * d.get(t, 0) for t, w in query.items())), i) for i, d in enumerate(docs))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(found[:k], 1) if s < 0]
    return sorted(out)


@pytest.fixture
def large(monkeypatch):
    """As if no table were small."""
    monkeypatch.setattr(store, "LOCAL_ROWS", 3)
    monkeypatch.setattr(blocks, "LOCAL_ROWS", 3)


def _bounded(spark, k, share):
    docs = zipf(1, 250, 60, 80)
    asked = docs[::50] + [{59: 1}, {0: 2, 58: 1}]
    v, q = frame(spark, docs, "doc_id"), frame(spark, asked, "qid")
    lists = maxscore.lists(v).cache()
    got = rows_of(maxscore.search(q, lists, maxscore.band_stats(lists), k, 6, share=share, most=1.0, least=0))
    assert got == brute(docs, asked, k)
    lists.unpersist()


@pytest.mark.parametrize("k,share", [(1, 0.1), (10, 0.3), (400, 0.5)])
def test_bounds_leave_nothing_out(spark, k, share):
    _bounded(spark, k, share)


def test_bounds_of_a_large_batch(spark, large):
    _bounded(spark, 5, 0.3)


def test_bounds_read_less(spark):
    docs = zipf(2, 600, 80, 120)
    q = frame(spark, docs[:5], "qid")
    lists = maxscore.lists(frame(spark, docs, "doc_id"))
    done = maxscore.work(q, lists, maxscore.band_stats(lists), 5).collect()
    assert len(done) == 5 and sum(r.n_read for r in done) < 0.5 * sum(r.n_postings for r in done) and all(r.n_candidates < 300 for r in done)


def test_negative_weights_are_searched_plainly(spark):
    v = spark.createDataFrame([(0, 0, 1.0), (0, 1, -2.0), (1, 0, 0.5), (2, 1, 0.0)], "doc_id long, term long, weight double")
    lists = maxscore.lists(v)
    for weights in ({0: 1.0, 1: 1.0}, {0: 1.0, 1: -1.0}):
        q = frame(spark, [weights], "qid")
        assert rows_of(maxscore.search(q, lists, maxscore.band_stats(lists), 3, 6, most=1.0, least=0)) == rows_of(exact.inverted(q, v, 3, digits=6))


def _tables(spark, docs, folders=3):
    v = frame(spark, docs, "doc_id")
    member = seismic.lists(v, 40, 6, 2, True).cache()
    summary = seismic.summaries(member, v, 0.6).cache()
    return v, member, summary, blocks.directory(member, summary).cache(), blocks.with_folders(blocks.block_rows(member, v, folders).cache(), folders)


def _same_as_joins(spark):
    docs = zipf(3, 300, 30, 40)
    v, member, summary, directory, rows = _tables(spark, docs)
    q = frame(spark, docs[::60], "qid")
    for selector in (None, SetSelector(range(0, 300, 3))):
        for heap in (1.0, 0.7):
            assert rows_of(blocks.search(q, directory, rows, 5, 4, heap, selector)) == rows_of(seismic.search(q, member, summary, v, 5, 4, heap, selector))
    one = {r.qid: r.n_evaluated for r in blocks.evaluated(q, directory, rows, 5, 4).collect()}
    assert one == {r.qid: r.n_evaluated for r in seismic.work(q, member, summary, v, 5, 4).collect()}
    more = {r.qid: r.n_evaluated for r in blocks.evaluated(q, directory, rows, 5, 4, 1.0, (1, 2)).collect()}
    assert all(more[x] <= one[x] for x in one)
    assert sum(blocks.num_blocks_in_list(directory, t) for t in range(30)) == member.select("term", "cluster").distinct().count() and blocks.num_blocks_in_list(directory, 99) == 0


def test_blocks_find_what_joins_find(spark):
    _same_as_joins(spark)


def test_blocks_of_a_large_batch(spark, large):
    _same_as_joins(spark)


def test_rounds_raise_the_threshold(spark):
    """Each round's documents reach the k-th best score of all rounds before it, by their block's summary."""
    docs = zipf(4, 400, 24, 40)
    *_, directory, rows = _tables(spark, docs)
    q = frame(spark, docs[::80], "qid")
    found = [(None if top is None else {r.qid: r.score for r in top.collect()}, opened.count()) for top, opened in blocks.rounds(q, directory, rows, 5, 6, 1.0, None, 6, (1, 3))]
    assert found[0][0] is None and len(found) == 4
    best = [rows_of(blocks.search(q, directory, rows, 5, 6, 1.0, None, 6, strata)) for strata in ((), (1, 3), (1, 2, 3, 4, 5))]
    truth = [{(q_, i) for q_, _, i, _ in brute(docs, docs[::80], 5)}, *[{(r[0], r[2]) for r in x} for x in best]]
    assert all(len(truth[0] & x) >= 0.8 * len(truth[0]) for x in truth[1:])


def test_folders_are_pruned(spark, tmp_path):
    docs = zipf(5, 200, 24, 30)
    x = index_factory(spark, 24, "seismic,lambda=40|beta=6|alpha=0.6|seed=2")
    x.add_frame(frame(spark, docs, "doc_id"), 200)
    x.build()
    x.folders = 4
    x.rows = blocks.with_folders(blocks.block_rows(x.member, x.vectors, 4), 4)
    write_index(x, str(tmp_path / "i"))
    again = read_index(spark, str(tmp_path / "i"))
    q = frame(spark, [{3: 1.0}], "qid")
    found = again.search_frame(q, q.select("qid"), 3, SeismicParameters(None, 1, 1.0))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "part#" in plan and "= 3)" in plan
    want = x.search_frame(q, q.select("qid"), 3, SeismicParameters(None, 1, 1.0))
    assert rows_of(found) == rows_of(want)
    n = again.num_blocks_in_list(3)
    assert n > 0 and sum(again.block(3, c).count() for c in range(n)) == x.member.where("term = 3").count() and again.block(3, 10**6).count() == 0
    assert again.block(3, 0).columns == ["doc_id", "terms", "weights"]


def test_codes_are_stored_and_summed_whole(spark, tmp_path):
    docs = [{t: w / 64 for t, w in d.items()} for d in zipf(6, 120, 24, 30)]
    x = index_factory(spark, 24, "seismic_sq,quantizer=8bit|vmin=0|vmax=1|lambda=0|beta=3|alpha=1|seed=2")
    x.add_frame(frame(spark, docs, "doc_id"), 120)
    x.build()
    write_index(x, str(tmp_path / "i"))
    again = read_index(spark, str(tmp_path / "i"))
    assert dict(spark.read.parquet(str(tmp_path / "i" / "codes_rows")).dtypes)["weights"] == "array<smallint>" == dict(again.rows.dtypes)["weights"]
    assert dict(again.weights().dtypes)["weight"] == "smallint"
    q = frame(spark, docs[:2], "qid")
    params = SeismicParameters(None, 24, 1e6)
    found = again.search_frame(q, q.select("qid"), 120, params)
    code = lambda w: int(np.floor(np.float32(w) * np.float32(255) + np.float32(0.5)))
    want = brute([{t: code(w) for t, w in d.items()} for d in docs], [{t: code(w) for t, w in d.items()} for d in docs[:2]], 120)
    got = [r for r in rows_of(found) if r[3] > 0]
    assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3] for r in got], [r[3] / 255**2 for r in want])
    few = again.search_frame(q, q.select("qid"), 3, SeismicParameters(SetSelector([1, 2]), 24, 1e6))
    assert {r[2] for r in rows_of(few)} == {1, 2}


def test_exact_sums_of_codes_are_whole(spark):
    v = spark.createDataFrame([(0, 0, 200), (0, 1, 255), (1, 0, 3)], "doc_id int, term int, weight int")
    q = spark.createDataFrame([(0, 0, 255), (0, 1, 255)], "qid int, term int, weight int")
    found = exact.scores(q, v)
    assert dict(found.dtypes)["score"] == "bigint" and sorted(r.score for r in found.collect()) == [765, 255 * 455]


def test_size_of_a_table_selector(spark):
    ids = spark.createDataFrame([(2,), (5,)], "id long")
    assert FrameSelector(ids).size is None and not is_small(FrameSelector(ids), 5)
    assert FrameSelector(ids, counted=True).size == 2 and is_small(FrameSelector(ids, counted=True), 2)
    assert spark.range(9).select(F.col("id").alias("doc_id")).count() == 9
