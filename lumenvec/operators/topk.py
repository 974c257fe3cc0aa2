"""Ranking by group and padding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def check_k(k: int) -> int:
    if k <= 0:
        raise ValueError("k must be positive")
    return k


def top_k(scores: DataFrame, k: int, ascending: bool = False) -> DataFrame:
    """(qid, rank, doc_id, score): the k best of (qid, doc_id, score), ties by id; `rank <= k` makes Spark limit groups before the shuffle."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("doc_id"))
    best = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= check_k(k))
    if ascending:
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.asc("score"), F.desc("doc_id"))))
    return best.select("qid", "rank", "doc_id", "score")


def padded(results: DataFrame, query_ids: DataFrame, k: int) -> DataFrame:
    """k rows for every query; missing ones have id -1 and score -1."""
    slots = query_ids.select("qid", F.explode(F.sequence(F.lit(1), F.lit(check_k(k)))).alias("rank"))
    got = slots.join(results, ["qid", "rank"], "left")
    return got.select("qid", "rank", F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), F.coalesce("score", F.lit(-1.0)).alias("score"))


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(recall): mean over the queries of truth of the share of its k ids that were found."""
    hits = truth.select("qid", "doc_id").join(found.select("qid", "doc_id"), ["qid", "doc_id"], "left_semi").groupBy("qid").agg(F.count("*").alias("hits"))
    return truth.select("qid").distinct().join(hits, "qid", "left").agg(F.round(F.avg(F.coalesce("hits", F.lit(0)) / float(k)), 6).alias("recall"))
