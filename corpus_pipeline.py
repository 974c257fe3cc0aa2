"""From raw documents to a tokenised training mix: each stage's rows are written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenvec.llm import bpe, mixing, quality, secret_scan, setjoin
from lumenvec.llm.linking import cut, set_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their failing and repeated lines.

    Null, empty and short texts go; equal rows are judged alike, so there are no ties; other columns stay as
    they are, whatever they are called. Long texts are judged whole; an empty table stays empty.
    """
    return quality.clean(docs)


#: Ids of documents to drop, at most, that are sent to every task (16 bytes each); more are joined by shuffle.
BROADCAST_IDS = 2_000_000


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near duplicates.

    Documents without an id stay, and so do all rows of an id that stays; texts that are null, empty
    or without words are like no other and stay. All columns are kept, whatever they are called; an
    empty table stays empty. Long texts are compared whole; of equal texts the smallest id stays.
    """
    goes = setjoin.components(docs).where("doc_id is not null").groupBy("doc_id").agg(F.max("component_id").alias("kept")).where("kept < doc_id")
    goes = cut(goes.select(F.col("doc_id").alias("gone")))
    if goes.count() <= BROADCAST_IDS:
        goes = F.broadcast(goes)
    return docs.join(goes, docs["doc_id"] == goes["gone"], "left_anti")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by the secret's kind in brackets.

    Null and empty texts stay so, and so do other columns, whatever they are called. Long texts are scanned whole, equal
    rows alike; of secrets that begin at the same place the kind named first goes. An empty table stays empty.
    """
    return secret_scan.redact(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents as often as it takes them, ties by id, then size.

    Documents without words, null ones too, are never taken; the last document of a source may be cut, however long
    it is, and equal rows are drawn each. Other columns stay; an empty table stays empty.
    """
    return mixing.sample(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row, a null text counting as empty.

    Long texts are encoded whole; equal rows have equal digests, as merges of equal rank go from left to right. Other
    columns aren't looked at; an empty table gives no rows.
    """
    return bpe.digest(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", mixing_sources),
    ("BPE encoding and decoding", bpe_encoding),
]

#: Secret scans train a field and BPE merges ranks: SQL can't express them; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what each returns is written to the checkpoint folder and read again."""
    set_folder(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
