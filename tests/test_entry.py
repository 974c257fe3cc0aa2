import duckdb
import pytest

import __spark_entry__
from lumenvec import catalog

SF = "/root/testdata/sf0.001"


def rows(names, data):
    order = sorted(names)
    at = [names.index(c) for c in order]
    return order, sorted(repr([round(float(r[i]), 6) if r[i] is not None else None for i in at]) for r in data)


@pytest.mark.parametrize("name", ["exact_topk_emb", "brute_topk_zero_fill", "topk_padded", "filter_not", "idmap_filter", "sq_exact_topk8", "seismic_topk_emb", "seismic_sq_topk", "csr_roundtrip"])
def test_sql_says_the_same(spark, name):
    c = duckdb.connect()
    for t in ("embeddings", "lineitem", "events", "documents"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = catalog.queries()[name](spark, SF), c.sql(catalog.oracle_sql()[name])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
