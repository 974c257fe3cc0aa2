"""The basket corpus as rows: what triples make of it, in one shuffle."""

from lumenvec import model
from lumenvec.sources import corpora


def test_rows_take_one_shuffle(spark):
    d = "/root/testdata/sf0.001"
    found = corpora.basket_rows(spark, d)
    want = model.to_rows(corpora.basket(spark, d))
    assert found.dtypes == want.dtypes
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1


def test_lines_of_a_part_are_added_up(spark, tmp_path):
    lines = [(7, 2, 1.0), (7, 1, 5.0), (7, 2, 3.0), (8, 2, 4.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted(map(tuple, corpora.basket_rows(spark, str(tmp_path)).collect())) == [(7, [1, 2], [5.0, 4.0]), (8, [2], [4.0])]
