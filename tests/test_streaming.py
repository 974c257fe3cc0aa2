from lumenvec.streaming.search import search_stream


def test_stream_of_queries(spark, tmp_path):
    q = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0)], "qid int, term int, weight double")
    q.write.parquet(str(tmp_path / "q"))
    v = spark.createDataFrame([(7, 1, 2.0), (8, 2, 3.0)], "doc_id int, term int, weight double")
    got = []
    search_stream(spark.readStream.schema(q.schema).parquet(str(tmp_path / "q")), v, 1, lambda d, _: got.extend(d.collect()), str(tmp_path / "c")).awaitTermination()
    assert {(r.qid, r.doc_id, r.score) for r in got} == {(0, 7, 2.0), (1, 8, 3.0)}
