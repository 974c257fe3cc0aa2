import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenvec import model
from lumenvec.functions.quantize import Quantizer
from lumenvec.operators import clusters, exact, postings, seismic
from lumenvec.operators.selectors import FrameSelector, ListSelector, MappedSelector, NotSelector, SetSelector, WhereSelector
from lumenvec.operators.topk import top_k
from lumenvec.plans.index import SearchParameters, SeismicParameters, SeismicSQParameters, index_factory, read_index, write_index


def csr(rows):
    indptr = np.cumsum([0, *map(len, rows)])
    terms = [t for r in rows for t in r]
    return len(rows), indptr, np.array(terms, np.uint16), np.array([r[t] for r in rows for t in r], np.float32)


def built(spark, descriptor, rows, dim=128, ids=None):
    x = index_factory(spark, dim, descriptor)
    if ids is None:
        x.add(*csr(rows))
    else:
        x.add_with_ids(*csr(rows), ids)
    if "brutal" not in descriptor:
        x.build()
    return x


def drawn(seed, n, dim, nnz):
    """n vectors of some weights, as dicts."""
    rng = np.random.default_rng(seed)
    return [dict(zip(rng.choice(dim, nnz, replace=False).tolist(), (rng.integers(1, 64, nnz) / 64).tolist())) for _ in range(n)]


def brute(docs, query, k, allowed=None):
    """(score, id) of the k best positive scores, by plain sums; 64ths are exact in any order of sums."""
    found = [(sum(w * d.get(t, 0) for t, w in query.items()), -i) for i, d in enumerate(docs) if allowed is None or i in allowed]
    return [(s, -i) for s, i in sorted(found, reverse=True)[:k] if s > 0]


def test_inverted_against_brute_force(spark):
    docs, asked = drawn(1, 60, 20, 4), drawn(2, 6, 20, 3)
    x = built(spark, "inverted", docs, 20)
    d, i = x.search(*csr(asked), 70)
    for row, query in enumerate(asked):
        want = brute(docs, query, 70)
        assert i[row].tolist() == [n for _, n in want] + [-1] * (70 - len(want))
        assert np.allclose(d[row, : len(want)], [s for s, _ in want], atol=1e-5) and (d[row, len(want) :] == -1).all()
    x.close()


def test_trailing_empty_document_counts(spark, tmp_path):
    x = built(spark, "inverted", [{0: 1.0, 1: 0.5}, {}], 8)
    write_index(x, str(tmp_path / "i"))
    assert x.num_vectors == 2 and read_index(spark, str(tmp_path / "i"), lazy=False).num_vectors == 2


def test_prune_and_cut(spark):
    """Heaviest postings of every list, ties by id; heaviest terms of every query, ties by term."""
    docs = drawn(21, 50, 6, 3)
    v = spark.createDataFrame([(i, t, w) for i, d in enumerate(docs) for t, w in d.items()], "doc_id int, term int, weight double")
    for lam in (1, 4, 0):
        want = {(t, i) for t in range(6) for _, i in sorted((-d[t], i) for i, d in enumerate(docs) if t in d)[: lam or None]}
        assert {(r.term, r.doc_id) for r in postings.prune(v, lam).collect()} == want
        own = {(min(d, key=lambda t: (-d[t], t)), i) for i, d in enumerate(docs)}
        assert sorted((r.term, r.doc_id) for r in postings.prune_keeping(v, lam).collect()) == sorted(want | own)
    q = v.withColumnRenamed("doc_id", "qid")
    got = {(r.qid, r.list_no): r.term for r in postings.cut_terms(q, 2).collect()}
    assert got == {(i, n): t for i, d in enumerate(docs) for n, t in enumerate(sorted(d, key=lambda t: (-d[t], t))[:2])}
    with pytest.raises(ValueError):
        postings.cut_terms(q, 0)


def test_one_list_pruned_and_filtered(spark):
    """With one term a list is all: pruning keeps its heaviest, filters take from what is kept, and few ids are matched exactly."""
    weights = {i: float(w) for i, w in enumerate(np.random.default_rng(22).permutation(12) + 1)}
    best = sorted(weights, key=lambda i: -weights[i])
    rows = [{0: w} for w in weights.values()]
    x = built(spark, "seismic,lambda=5|beta=2|alpha=0.5|seed=1", rows)
    assert x.search(*csr([{0: 2.0}]), 8)[1].tolist() == [best[:5] + [-1] * 3]
    assert x.search(*csr([{0: 2.0}]), 8, SeismicParameters(NotSelector(SetSelector(best[1:3]))))[1].tolist() == [[best[0], *best[3:5], *[-1] * 5]]
    few = sorted(best[6:8], key=lambda i: -weights[i])
    assert x.search(*csr([{0: 2.0}]), 2, SearchParameters(SetSelector(few)))[1].tolist() == [few]


def test_search_that_prunes_nothing_is_exact(spark):
    docs, asked = drawn(3, 80, 16, 4), drawn(4, 5, 16, 3)
    x = built(spark, "seismic,lambda=0|beta=3|alpha=0.7|seed=9", docs, 16)
    got = x.search(*csr(asked), 80, SeismicParameters(None, 16, 1e6))[1]
    for row, query in enumerate(asked):
        want = [n for _, n in brute(docs, query, 80)]
        found = got[row][got[row] >= 0].tolist()
        assert found[: len(want)] == want


def test_pruned_search_opens_fewer_documents(spark):
    docs, asked = drawn(5, 300, 24, 6), drawn(6, 8, 24, 5)
    x = built(spark, "seismic,lambda=40|beta=6|alpha=0.6|seed=2|every=1", docs, 24)
    assert x.member.select("doc_id").distinct().count() == 300  # pruning leaves no document out
    q = spark.createDataFrame([(n, t, float(w)) for n, r in enumerate(asked) for t, w in r.items()], "qid int, term int, weight double")
    done = {r.qid: r for r in seismic.work(q, x.member, x.summary, x.vectors, 5, 5, 1.0).collect()}
    assert len(done) == 8 and all(5 <= r.n_evaluated <= r.n_candidates for r in done.values()) and sum(r.n_evaluated for r in done.values()) < sum(r.n_candidates for r in done.values())
    exact_ = [[n for _, n in brute(docs, r, 5)] for r in asked]
    got = x.search(*csr(asked), 5, SeismicParameters(None, 5, 1.0))[1]
    assert np.mean([len({*a} & {*b}) / 5 for a, b in zip(got.tolist(), exact_)]) >= 0.8
    x.close()


def test_recall_floor_and_persistence(spark, tmp_path):
    rng = np.random.default_rng(7)
    docs = [dict(zip(rng.choice(256, 12, replace=False).tolist(), rng.uniform(0.1, 1, 12).tolist())) for _ in range(400)]
    asked = csr([dict(zip(rng.choice(256, 8, replace=False).tolist(), rng.uniform(0.1, 1, 8).tolist())) for _ in range(10)])
    truth = built(spark, "inverted", docs, 256).search(*asked, 10)[1]
    for descriptor, params in (("seismic,lambda=25|beta=4|alpha=0.4|seed=5", None), ("seismic_sq,quantizer=8bit|vmin=0|vmax=1|lambda=25|beta=4|alpha=0.4|seed=5", SeismicSQParameters(None, 10, 1.2))):
        x = built(spark, descriptor, docs, 256)
        got = x.search(*asked, 10, params)[1]
        assert np.mean([len({*a} & {*b}) / 10 for a, b in zip(got, truth)]) >= 0.8
        write_index(x, str(tmp_path / x.kind))
        assert (read_index(spark, str(tmp_path / x.kind)).search(*asked, 10, params)[1] == got).all()


def test_brute_zero_fill_and_exact_match(spark):
    x = built(spark, "brutal", [{2: 3.0}, {3: 7.0}, {0: 1.0}])
    d, i = x.search(*csr([{0: 10.0}]), 4)
    assert i.tolist() == [[2, 0, 1, -1]] and d.tolist() == [[10.0, 0.0, 0.0, -1.0]]
    with pytest.raises(RuntimeError):
        x.build()
    with pytest.raises(RuntimeError):
        write_index(x, "/tmp/never")
    v = spark.createDataFrame([(0, 0, 1.0), (1, 0, 10.0), (2, 0, 5.0)], "doc_id int, term int, weight double")
    q = spark.createDataFrame([(0, 0, 1.0)], "qid int, term int, weight double")
    got = exact.match(q, q.select("qid"), v, v.select("doc_id"), ListSelector([0, 2, 2]), 3).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in got] == [(2, 5.0), (0, 1.0)]


def test_ids_are_numbered_in_order(spark):
    ids = sorted({-(1 << 40), -5, 0, 1, 4095, 4096, 1 << 22, (1 << 22) + 1, (1 << 50) + 3, *np.random.default_rng(3).integers(-(1 << 24), 1 << 24, 300).tolist()})
    d = spark.createDataFrame([(i,) for i in ids], "doc_id long").repartition(5)
    found = exact.numbered(d)
    assert sorted(map(tuple, found.collect())) == [(i, n) for n, i in enumerate(ids, 1)]
    assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString().split("ObjectHashAggregate")[0]


def test_zeros_come_before_negative_scores(spark):
    """Whatever a query has seen, its zeros are the smallest ids that it hasn't."""
    rng = np.random.default_rng(31)
    docs = [{int(t): float(w) for t, w in zip(rng.choice(6, 2, replace=False), rng.integers(-3, 4, 2))} for _ in range(40)]
    asked = [{0: 1.0}, {1: -1.0, 2: 1.0}, {9: 1.0}]
    v = spark.createDataFrame([(3 * i, t, w) for i, d in enumerate(docs) for t, w in d.items()], "doc_id int, term int, weight double")
    q = spark.createDataFrame([(i, t, w) for i, d in enumerate(asked) for t, w in d.items()], "qid int, term int, weight double")
    for k in (3, 30, 60):
        got = exact.brute(q, q.select("qid").distinct(), v, spark.range(0, 120, 3).select(F.col("id").alias("doc_id")), k, 6)
        want = [(n, r, i, s) for n, a in enumerate(asked) for r, (s, i) in enumerate(sorted(((sum(w * d.get(t, 0) for t, w in a.items()), 3 * i) for i, d in enumerate(docs)), key=lambda x: (-x[0], x[1]))[:k], 1)]
        assert sorted((r.qid, r["rank"], r.doc_id, r.score) for r in got.collect()) == want


def test_idmap(spark, tmp_path):
    rng = np.random.default_rng(23)
    ext = (rng.choice(5000, 9, replace=False) + 17).tolist()
    docs = [{0: float(w)} for w in rng.permutation(9) + 1]
    order = sorted(range(9), key=lambda i: -docs[i][0])
    x = built(spark, "idmap,inverted", docs, ids=ext)
    some = sorted(order[2:5] + order[:1])
    want = [ext[i] for i in order if i in some]
    assert x.search(*csr([{0: 1.0}]), 6, SearchParameters(SetSelector([ext[i] for i in some])))[1].tolist() == [want + [-1, -1]]
    assert x.search(*csr([{0: 1.0}]), 2, SearchParameters(SetSelector([3])))[1].tolist() == [[-1, -1]]
    with pytest.raises(ValueError):
        x.add_with_ids(*csr([{0: 1.0}]), [ext[4]])
    write_index(x, str(tmp_path / "i"))
    again = read_index(spark, str(tmp_path / "i"))
    assert again.num_vectors == 9 and again.search(*csr([{0: 1.0}]), 3)[1].tolist() == [[ext[i] for i in order[:3]]]
    assert MappedSelector(SetSelector([ext[7], 3]), again.id_map).ids() == [7]


def test_quantizer(spark):
    """Codes are those of a rounded, clipped line; a decoded product is near the product of decoded values."""
    values = np.linspace(-0.5, 3.5, 41).astype(np.float32)
    v = spark.createDataFrame([(float(x),) for x in values], "x float")
    for kind, top in (("8bit", 255), ("16bit", 65535)):
        q, asked = Quantizer(kind, 0.25, 3.0), Quantizer(kind, 0.0, 2.0)
        codes = np.array([r[0] for r in v.select(q.encode(F.col("x"))).collect()])
        line = np.clip((values.astype(float) - 0.25) / 2.75 * top, 0, top)
        assert (np.abs(codes - line) <= 0.5 + 1e-3).all()
        back = np.array([r[0] for r in spark.createDataFrame([(int(c),) for c in codes], "c int").select(q.decode(F.col("c"))).collect()])
        assert np.abs(back - np.clip(values, 0.25, 3.0)).max() <= 2.75 / top
    for bad in ((3, 3), (5, 2), (0, float("inf")), (float("nan"), 4)):
        with pytest.raises(ValueError):
            Quantizer("8bit", *bad)


def test_alpha_and_assignment(spark):
    rng = np.random.default_rng(11)
    weights = (rng.integers(1, 100, 12) / 8).tolist()
    p = spark.createDataFrame([(0, 0, t, w) for t, w in enumerate(weights)], "term int, cluster int, s_term int, s_value double")
    for alpha in (0.2, 0.6, 1.0):
        want, mass = [], 0.0
        for t in sorted(range(12), key=lambda t: (-weights[t], t)):
            if mass < alpha * sum(weights):
                want.append(t)
                mass += weights[t]
        assert {r.s_term for r in clusters.alpha_mass(p, alpha).collect()} == set(want)
    assert clusters.alpha_mass(p.withColumn("s_value", F.lit(0.0)), 0.5).count() == 12
    docs = drawn(12, 30, 10, 3)
    v = spark.createDataFrame([(i, t, float(w)) for i, d in enumerate(docs) for t, w in d.items()], "doc_id int, term int, weight double")
    lists = spark.createDataFrame([(7, d) for d in range(30)], "term int, doc_id int")
    cen = spark.createDataFrame([(7, c, d) for c, d in enumerate((4, 9, 21))], "term int, cluster int, doc_id int")
    got = {r.doc_id: (r.cluster, r.pos) for r in clusters.members(lists, cen, v).collect()}
    dot = lambda a, b: sum(w * docs[b].get(t, 0) for t, w in docs[a].items())
    for d in range(30):
        like = [dot(d, c) for c in (4, 9, 21)]
        assert got[d] == ((4, 9, 21).index(d), 0) if d in (4, 9, 21) else got[d][0] == int(np.argmax(like)) and got[d][1] > 0


@pytest.mark.parametrize("docs_,products", [(1024, 1 << 22), (5, 7)])
def test_assignment_in_blocks(spark, monkeypatch, docs_, products):
    """Lists of very different lengths, dealt in blocks, and batches that cut blocks in two, against plain products."""
    monkeypatch.setattr(clusters, "BLOCK_DOCS", docs_)
    monkeypatch.setattr(clusters, "CHUNK_PRODUCTS", products)
    rng = np.random.default_rng(41)
    docs = [{int(t): float(rng.integers(-2, 5)) for t in np.unique(rng.zipf(1.5, 6) % 9)} for _ in range(120)]
    v = spark.createDataFrame([(i, t, w) for i, d in enumerate(docs) for t, w in d.items()], "doc_id long, term long, weight double")
    cen = clusters.centroids(v, 4, 3).cache()
    of = {}
    for r in cen.collect():
        of.setdefault(r.term, {})[r.doc_id] = r.cluster
    got = {(r.term, r.doc_id): (r.cluster, r.pos) for r in clusters.members(v, cen, v).collect()}
    assert len(got) == sum(map(len, docs)) and {c: clusters.members(v, cen, v).schema[c].dataType for c in ("term", "doc_id")} == {c: v.schema[c].dataType for c in ("term", "doc_id")}
    for (t, i), (c, pos) in got.items():
        if i in of[t]:
            assert (c, pos) == (of[t][i], 0)
        else:
            like = {k: sum(w * docs[j].get(x, 0) for x, w in docs[i].items()) for j, k in of[t].items()}
            assert c == min((-s, k) for k, s in like.items() if s > 0)[1] if any(s > 0 for s in like.values()) else c == 0
            assert pos > 0
    plain = cen.join(v.withColumnRenamed("term", "x"), "doc_id").groupBy("term", "doc_id", "cluster").agg(F.collect_list("x"), F.collect_list("weight"))
    batches = [(t, 0, c, i, xs, ws) for t, i, c, xs, ws in plain.collect()]
    others = [(t, 0, None, i, list(docs[i]), list(docs[i].values())) for (t, i) in got if i not in of[t]]
    stream = sorted(batches + others, key=lambda r: (r[0], r[2] is None, r[3]))
    schema = pa.schema([("term", pa.int64()), ("block", pa.int32()), ("cluster", pa.int32()), ("doc_id", pa.int64()), ("terms", pa.list_(pa.int64())), ("weights", pa.list_(pa.float64()))])
    cut_up = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*stream[k : k + 11]), schema)], schema=schema) for k in range(0, len(stream), 11)]
    found = {(t, i): c for b in clusters._assigned(iter(cut_up)) for t, c, i in zip(*[x.to_pylist() for x in b.columns])}
    assert found == {(t, i): c for (t, i), (c, _) in got.items() if i not in of[t]}


def test_errors(spark):
    for bad in ("nonsense", "", "idmap"):
        with pytest.raises(ValueError):
            index_factory(spark, 8, bad)
    x = index_factory(spark, 8, "inverted")
    with pytest.raises(TypeError):
        x.add(1, [0, 1], [0], np.array([1.0]))
    with pytest.raises(TypeError):
        x.add(1, [0, 1], np.array([0.5]), np.array([1.0], np.float32))
    x.add(*csr([{8: 1.0}]))
    with pytest.raises(Exception, match="out of range"):
        x.build()
    with pytest.raises(ValueError):
        x.search(*csr([{0: 1.0}]), 0)
    assert index_factory(spark, 8, " seismic , lambda = 7 | lambda=9 | junk | foo=1 ").cluster.lam == 7


def test_incremental_equals_one_batch_and_ties(spark):
    rows = [{0: float(i % 3 + 1)} for i in range(9)]
    x = index_factory(spark, 4, "inverted")
    for a, b in ((0, 3), (3, 6), (6, 9)):
        x.add(*csr(rows[a:b]))
    x.build()
    assert (x.search(*csr([{0: 1.0}]), 5)[1] == built(spark, "inverted", rows, 4).search(*csr([{0: 1.0}]), 5)[1]).all()
    s = spark.createDataFrame([(0, 9, 1.0), (0, 3, 1.0), (0, 5, 2.0)], "qid int, doc_id int, score double")
    assert [r.doc_id for r in top_k(s, 2).orderBy("rank").collect()] == [5, 3]


def test_dense(spark):
    v = spark.createDataFrame([(0, 1, 2.0), (0, 3, 4.0)], "doc_id int, term int, weight double").withColumn("weight", F.col("weight").cast("float"))
    assert model.dense(v, 5).first()["dense"] == [0, 2, 0, 4, 0]
    codes = v.withColumn("weight", Quantizer("8bit", 0, 4).encode(F.col("weight")))
    assert model.dense(codes, 4).first()["dense"] == [0, 128, 0, 255]


def test_selectors_by_table_and_expression(spark):
    v = spark.range(10).select(F.col("id").alias("doc_id"))
    some = FrameSelector(spark.createDataFrame([(2,), (2,), (11,)], "id long"))
    assert [r[0] for r in some.apply(v).collect()] == [2] and NotSelector(some).apply(v).count() == 9
    assert WhereSelector(lambda c: c > 7).apply(v).count() == 2 and NotSelector(WhereSelector(lambda c: c > 7)).apply(v).count() == 8
    with pytest.raises(TypeError):
        some.ids()
