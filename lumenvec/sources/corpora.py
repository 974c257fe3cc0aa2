"""Sparse vectors derived from the fixture tables, in Spark and, for comparison, in SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenvec.model import to_rows, to_triples


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive entries of the embeddings."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.posexplode("embedding").alias("term", "weight"))
    return e.where("weight > 0")


def basket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of parts by order."""
    return _baskets(spark, sf_dir).groupBy("doc_id", "term").agg(F.sum("weight").alias("weight"))


def basket_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as rows with terms ascending: lines are dealt by order once, for adding them up and for the rows."""
    return to_rows(_baskets(spark, sf_dir).repartition("doc_id").groupBy("doc_id", "term").agg(F.sum("weight").alias("weight")))


def _baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("term"), F.col("l_quantity").alias("weight"))


def _hashed(c: str):
    return F.conv(F.substring(F.md5(F.col(c)), 1, 4), 16, 10).cast("bigint")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of events by user, event types hashed to terms."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ev.groupBy(F.col("user_id").alias("doc_id"), _hashed("event_type").alias("term")).agg(F.count("*").cast("double").alias("weight"))


#: Bytes that are letters; bytes of text that are counted at a time, about.
LETTERS = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
SLICE_BYTES = 1 << 20


def text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of words by document, words hashed to terms, as rows with terms ascending.

    A text is counted where it is read: only an id that several documents share makes a shuffle.
    """
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = d.select("doc_id", "text").mapInArrow(_counted, "doc_id bigint, terms array<int>, weights array<double>")
    if d.groupBy("doc_id").count().where("count > 1").isEmpty():
        return rows
    return to_rows(to_triples(rows).groupBy("doc_id", "term").agg(F.sum("weight").alias("weight")))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, terms, weights) of the texts that have a word."""
    for b in batches:
        ids, texts = b.column(0), b.column(1).cast(pa.large_string()).fill_null("")
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + SLICE_BYTES, side="right")) - 1)
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[first] : ends[last]]
            row, terms, n = _terms(data, ends[first : last + 1] - ends[first])
            if len(row):
                head = np.flatnonzero(np.diff(row, prepend=-1))
                at = pa.array(np.append(head, len(row)), pa.int32())
                arrays = [ids.take(pa.array(first + row[head])), pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(at, pa.array(n, pa.float64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "terms", "weights"])
            first = last


def _terms(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, term, words), by both, of texts in UTF-8 that stand one after another."""
    letter = LETTERS[data]
    head = letter.copy()
    head[1:] &= ~letter[:-1]
    begin = edges[:-1][edges[:-1] < edges[1:]]
    head[begin] = letter[begin]
    at = np.flatnonzero(head)
    if not len(at):
        return at, at, at
    before = np.cumsum(letter)
    starts = np.append(before[at] - 1, before[-1]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(starts), pa.py_buffer(data[letter] | 32)]).dictionary_encode()
    hashed = np.array([int.from_bytes(hashlib.md5(w, usedforsecurity=False).digest()[:2], "big") for w in words.dictionary.to_pylist()])
    row = np.searchsorted(edges, at, side="right") - 1
    key, n = np.unique(row << 16 | hashed[words.indices.to_numpy()], return_counts=True)
    return key >> 16, key & 0xFFFF, n


def text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of words by document, words hashed to terms."""
    return to_triples(text_rows(spark, sf_dir)).withColumn("term", F.col("term").cast("bigint"))


SQL = {
    "emb": "SELECT vec_id AS doc_id, i - 1 AS term, embedding[i] AS weight FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) WHERE embedding[i] > 0",
    "basket": "SELECT l_orderkey AS doc_id, l_partkey AS term, sum(l_quantity) AS weight FROM lineitem GROUP BY 1, 2",
    "users": "SELECT user_id AS doc_id, ('0x' || substr(md5(event_type), 1, 4))::BIGINT AS term, count(*)::DOUBLE AS weight FROM events GROUP BY 1, 2",
    "text": "SELECT doc_id, ('0x' || substr(md5(lower(w)), 1, 4))::BIGINT AS term, count(*)::DOUBLE AS weight FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents) GROUP BY 1, 2",
}
CORPORA = {"emb": emb, "basket": basket, "users": users, "text": text}
#: Vectors whose id is divisible by this are the queries; all vectors, those too, are the documents.
QUERY_STEP = 100


def split(vectors: DataFrame, step: int = QUERY_STEP) -> tuple[DataFrame, DataFrame]:
    """(queries, documents)."""
    return vectors.where(F.col("doc_id") % step == 0).withColumnRenamed("doc_id", "qid"), vectors
