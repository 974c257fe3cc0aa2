import corpus_pipeline
from lumenvec.llm import bpe, mixing, quality, secret_scan, setjoin

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = quality.clean(docs).cache()
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert kept.count() == quality.measure(docs).where("kept").count()
    once = corpus_pipeline.ngram_jaccard_join(spark, kept, SF)
    groups = setjoin.components(kept).select("component_id").distinct().count()
    assert once.columns == docs.columns and once.count() == groups
    clean = corpus_pipeline.secret_scans(spark, once, SF)
    assert clean.columns == docs.columns and clean.count() == groups
    mixed = corpus_pipeline.mixing_sources(spark, clean, SF)
    assert mixed.columns == docs.columns
    assert secret_scan.scan(mixed).selectExpr("sum(n_access + n_hex) n").first()["n"] == 0


def test_run_is_the_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert got == sorted(map(tuple, docs.collect()))
    assert bpe.SCHEMA and mixing.SEED
