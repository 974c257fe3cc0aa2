"""Approximate search over clustered posting lists.

Clusters of each query's heaviest lists are scored by their summaries. The first clusters in visiting
order that hold k members give a threshold, the k-th best exact score among them; any other cluster
is opened if its summary, times heap_factor, reaches it. That visits all that a search with
a rising threshold would, and no vector of a cluster that isn't opened is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenvec.model import to_rows, to_triples
from lumenvec.operators.clusters import alpha_mass, cut_rows, marked, max_pool, sized
from lumenvec.operators.exact import small_side
from lumenvec.operators.postings import cut_terms
from lumenvec.operators.selectors import Selector
from lumenvec.operators.topk import check_k, top_k
from lumenvec.plans.store import written


def summary_scores(queries: DataFrame, summary: DataFrame, cut: int) -> DataFrame:
    """(qid, list_no, term, cluster, s) for every cluster of the query's cut lists; 0 if the summary shares no term.

    Every cluster has a summary of at least one term, so one pass over the summaries finds all.
    """
    q = queries.select("qid", F.col("term").alias("s_term"), F.col("weight").cast("double").alias("w"))
    met = cut_terms(queries, cut).join(summary, "term").join(small_side(q), ["qid", "s_term"], "left")
    return met.groupBy("qid", "list_no", "term", "cluster").agg(F.coalesce(F.round(F.sum(F.col("w") * F.col("s_value")), 6), F.lit(0.0)).alias("s"))


def _scores(pairs: DataFrame, queries: DataFrame, vectors: DataFrame, digits: int) -> DataFrame:
    """(qid, doc_id, score) of these pairs by whole vectors; every document has a term, so none is lost in the join."""
    q = queries.select("qid", "term", F.col("weight").cast("double").alias("w"))
    of = vectors.select("doc_id", "term", F.col("weight").cast("double").alias("v"))
    met = pairs.join(of, "doc_id").join(small_side(q), ["qid", "term"], "left")
    return met.groupBy("qid", "doc_id").agg(F.coalesce(F.round(F.sum(F.col("w") * F.col("v")), digits), F.lit(0.0)).alias("score"))


def _visits(queries: DataFrame, allowed: DataFrame, summary: DataFrame, cut: int) -> DataFrame:
    """(qid, term, cluster, s, before): clusters in visiting order, and how many members those before it have."""
    s = summary_scores(queries, summary, cut)
    asked = cut_terms(queries, cut).select("term").distinct()
    sizes = allowed.join(asked, "term", "left_semi").groupBy("term", "cluster").agg(F.count("*").alias("size"))
    order = Window.partitionBy("qid").orderBy("list_no", F.when(F.col("list_no") == 0, -F.col("s")).otherwise(F.lit(0.0)), "cluster", "term")
    ahead = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return s.join(sizes, ["term", "cluster"]).select("qid", "term", "cluster", "s", F.coalesce(ahead, F.lit(0)).alias("before"))


def evaluated(queries: DataFrame, member: DataFrame, summary: DataFrame, vectors: DataFrame, k: int, cut: int = 10, heap_factor: float = 1.0, selector: Selector | None = None, digits: int = 6) -> DataFrame:
    """(qid, doc_id, score) of the documents visited, each once.

    The prefix is scored first and gives each query's threshold; of all other clusters only those
    whose summary reaches it are opened, and only documents of opened clusters meet the vectors. A
    query whose prefix has fewer than k documents opens all. The few documents of the prefix are
    scored again with the others, which is less work than telling them apart.
    """
    check_k(k)
    of = (selector.apply(member) if selector is not None else member).select("term", "cluster", "doc_id")
    visits = _visits(queries, of, summary, cut)
    first = visits.where(F.col("before") < k).join(of, ["term", "cluster"]).select("qid", "doc_id").distinct()
    rank = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("doc_id"))
    bound = _scores(first, queries, vectors, digits).withColumn("r", F.row_number().over(rank)).where(F.col("r") <= k).where(F.col("r") == k).select("qid", F.col("score").alias("tau"))
    opened = visits.join(bound, "qid", "left").where((F.col("before") < k) | F.col("tau").isNull() | (F.col("s") * heap_factor >= F.col("tau")))
    docs = opened.join(of, ["term", "cluster"]).select("qid", "doc_id").distinct()
    return _scores(docs, queries, vectors, digits)


def search(queries: DataFrame, member: DataFrame, summary: DataFrame, vectors: DataFrame, k: int, cut: int = 10, heap_factor: float = 1.0, selector: Selector | None = None, digits: int = 6) -> DataFrame:
    """(qid, rank, doc_id, score): the k best of the documents visited, by exact score."""
    return top_k(evaluated(queries, member, summary, vectors, k, cut, heap_factor, selector, digits), k)


def work(queries: DataFrame, member: DataFrame, summary: DataFrame, vectors: DataFrame, k: int, cut: int = 10, heap_factor: float = 1.0) -> DataFrame:
    """(qid, n_candidates, n_evaluated): documents in the query's cut lists, and those whose vectors were scored."""
    every = cut_terms(queries, cut).join(member, "term").groupBy("qid").agg(F.count_distinct("doc_id").alias("n_candidates"))
    done = evaluated(queries, member, summary, vectors, k, cut, heap_factor).groupBy("qid").agg(F.count("*").alias("n_evaluated"))
    return every.join(done, "qid")


def lists(vectors: DataFrame, lam: int, beta: int, seed: int, every: bool = False) -> DataFrame:
    """The members of all lists' clusters; every: no document is pruned from all its lists."""
    return sized_lists(to_rows(vectors), lam, beta, seed, every).drop("size")


def sized_lists(rows: DataFrame, lam: int, beta: int, seed: int, every: bool = False, to: str | None = None) -> DataFrame:
    """The same of vectors as rows, with the size of each member's cluster; to: a folder for the marked lists, which are read several times."""
    of = marked(rows, lam, beta, seed, every)
    if to is not None:
        (of,) = written(rows.sparkSession, to, lists=of)
    return sized(of, rows)


def _sized(member: DataFrame) -> DataFrame:
    return member if "size" in member.columns else member.withColumn("size", F.count("*").over(Window.partitionBy("term", "cluster")))


def summaries(member: DataFrame, vectors: DataFrame, alpha: float, rows: DataFrame | None = None) -> DataFrame:
    """The summaries of clusters, from members that have best been written or persisted; rows: the vectors as rows, if they are there.

    A cluster of one document has what its vector leaves of itself, which needs no pooling.
    """
    of = _sized(member)
    alone = of.where(F.col("size") == 1).join(cut_rows(to_rows(vectors) if rows is None else rows, alpha), "doc_id").select("term", "cluster", F.explode("e").alias("e"))
    pooled = alpha_mass(max_pool(of.where(F.col("size") > 1), vectors), alpha)
    return alone.select("term", "cluster", F.col("e.s_term").alias("s_term"), F.col("e.s_value").alias("s_value")).unionByName(pooled)


def summary_rows(member: DataFrame, rows: DataFrame, alpha: float) -> DataFrame:
    """(term, cluster, size, s_terms, s_values): what `blocks.directory` makes of members and their summaries, of vectors as rows."""
    of = _sized(member)
    alone = of.where(F.col("size") == 1).join(cut_rows(rows, alpha), "doc_id").select("term", "cluster", "size", "e")
    many = of.where(F.col("size") > 1)
    pooled = alpha_mass(max_pool(many, to_triples(rows)), alpha).groupBy("term", "cluster").agg(F.array_sort(F.collect_list(F.struct("s_term", "s_value"))).alias("e"))
    pooled = many.where(F.col("pos") == 0).select("term", "cluster", "size").join(pooled, ["term", "cluster"])
    return alone.unionByName(pooled).select("term", "cluster", "size", F.col("e.s_term").alias("s_terms"), F.col("e.s_value").alias("s_values"))


__all__ = ["evaluated", "lists", "search", "sized_lists", "summaries", "summary_rows", "summary_scores", "work"]
