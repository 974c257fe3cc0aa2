"""Posting lists, their statistics and pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def postings(vectors: DataFrame) -> DataFrame:
    """Triples clustered by term, documents ascending."""
    return vectors.select("term", "doc_id", "weight").repartition("term").sortWithinPartitions("term", "doc_id")


def term_stats(vectors: DataFrame) -> DataFrame:
    """(term, df, max_weight): list sizes and largest weights, at least 0."""
    return vectors.groupBy("term").agg(F.count("*").alias("df"), F.greatest(F.lit(0.0), F.max("weight").cast("double")).alias("max_weight"))


def prune(vectors: DataFrame, lam: int) -> DataFrame:
    """The lam heaviest postings of each list, ties by id; all of them if lam isn't positive."""
    if lam <= 0:
        return vectors
    order = Window.partitionBy("term").orderBy(F.desc("weight"), F.asc("doc_id"))
    return vectors.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= lam).drop("_r")


def prune_keeping(vectors: DataFrame, lam: int) -> DataFrame:
    """The same, and of every document the heaviest posting, ties by term, so that pruning leaves no document out."""
    if lam <= 0:
        return vectors
    own = vectors.groupBy("doc_id").agg(F.max_by(F.struct("term", "weight"), F.struct("weight", -F.col("term"))).alias("e")).select("doc_id", "e.term", "e.weight")
    return prune(vectors, lam).select("doc_id", "term", "weight").unionByName(own).dropDuplicates(["term", "doc_id"])


def cut_terms(queries: DataFrame, cut: int) -> DataFrame:
    """(qid, list_no, term): each query's `cut` heaviest terms, numbered from 0, ties by term."""
    if cut <= 0:
        raise ValueError("cut must be positive")
    order = Window.partitionBy("qid").orderBy(F.desc("weight"), F.asc("term"))
    return queries.withColumn("list_no", F.row_number().over(order) - 1).where(F.col("list_no") < cut).select("qid", "list_no", "term")


def upper_bounds(queries: DataFrame, stats: DataFrame) -> DataFrame:
    """(qid, term, bound, prefix): what a term can add to any score, and the sum of the smallest bounds up to it."""
    b = queries.join(stats, "term").select("qid", "term", F.round(F.col("weight").cast("double") * F.col("max_weight"), 6).alias("bound"))
    order = Window.partitionBy("qid").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    return b.withColumn("prefix", F.round(F.sum("bound").over(order), 6))
