"""The text corpus against plain counting, and that deriving it moves no words."""

import hashlib
from collections import Counter

import pytest

from lumenvec import catalog
from lumenvec.operators import exact, tiles
from lumenvec.sources import corpora

TEXTS = [(0, "one Two two"), (100, "TWO"), (3, None), (4, ""), (5, "12 – ÄÖ é"), (6, "aéb x1y\nx\ty"), (7, "end"), (8, "start again " * 40), (9, "K ſ two")]


def counted(texts):
    out = Counter()
    for i, t in texts:
        for w in "".join(c if c.isascii() and c.isalpha() else " " for c in t or "").lower().split():
            out[i, int(hashlib.md5(w.encode()).hexdigest()[:4], 16)] += 1
    return sorted((i, t, float(n)) for (i, t), n in out.items())


@pytest.mark.parametrize("texts", [TEXTS, TEXTS + [(100, "two more"), (3, "late"), (3, "late")]])
@pytest.mark.parametrize("size", [1 << 22, 1])
def test_words_are_counted_where_they_are_read(spark, tmp_path, monkeypatch, texts, size):
    monkeypatch.setattr(corpora, "SLICE_BYTES", size)
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = corpora.text(spark, str(tmp_path))
    assert found.dtypes == [("doc_id", "bigint"), ("term", "bigint"), ("weight", "double")]
    assert sorted(map(tuple, found.collect())) == counted(texts)
    assert ("Exchange" in found._jdf.queryExecution().executedPlan().toString()) == (len(texts) > len(TEXTS))


@pytest.mark.parametrize("least", [1, 1 << 30])
def test_rows_are_searched_as_triples_are(spark, monkeypatch, least):
    monkeypatch.setattr(tiles, "LEAST_QUERIES", least)
    d = "/root/testdata/sf0.001"
    of = lambda v: sorted(map(tuple, exact.inverted(*corpora.split(v), 10, digits=6).collect()))
    want = of(corpora.text(spark, d))
    assert want and of(corpora.text_rows(spark, d)) == want
    for name in ("exact_topk_text", "bounded_topk_text"):
        assert sorted(map(tuple, catalog.queries()[name](spark, d).collect())) == want


def test_searches_in_tiles_shuffle_rows_once(spark, tmp_path):
    """Of vectors as rows only the groups and blocks are shuffled, and the best of each."""
    rows = spark.createDataFrame([(i, [1, 2], [1.0, float(i)]) for i in range(300)], "doc_id long, terms array<int>, weights array<double>")
    plan = tiles.search(*corpora.split(rows, 3), 3, (100, 200), 6)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
