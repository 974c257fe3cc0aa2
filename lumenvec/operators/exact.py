"""Exact search: an equi-join on terms, a sum of products for each query and document, the k best.

Where nearly all pairs share a term they aren't made rows of: see `tiles`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lumenvec.model import to_triples
from lumenvec.operators import tiles
from lumenvec.operators.selectors import Selector
from lumenvec.operators.topk import check_k, padded, top_k

#: Bytes of queries that are sent to every task; larger batches are joined by shuffle, as Spark's own limit has it.
BROADCAST_BYTES = 8 << 20


def small_side(queries: DataFrame) -> DataFrame:
    """Queries marked for broadcast if Spark's own size estimate proves them small."""
    plan = getattr(queries, "_jdf", None)  # a remote session has none and goes by Spark's own limit
    if plan is None:
        return queries
    size = plan.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(queries) if int(str(size)) <= BROADCAST_BYTES else queries


def scores(queries: DataFrame, vectors: DataFrame, digits: int | None = None) -> DataFrame:
    """(qid, doc_id, score) of all pairs that share a term; partial sums are made before the shuffle. Codes are summed as whole numbers."""
    whole = all(isinstance(x.schema["weight"].dataType, IntegralType) for x in (queries, vectors))
    kind = "bigint" if whole else "double"
    product = F.col("q.weight").cast(kind) * F.col("d.weight").cast(kind)
    pairs = vectors.alias("d").join(small_side(queries).alias("q"), F.col("q.term") == F.col("d.term"))
    total = F.sum(product)
    return pairs.groupBy("q.qid", "d.doc_id").agg((F.round(total, digits) if digits is not None and not whole else total).alias("score"))


def inverted(queries: DataFrame, vectors: DataFrame, k: int, selector: Selector | None = None, digits: int | None = None) -> DataFrame:
    """The k best documents with a positive score; what the selector leaves out never counts. Queries and vectors are triples, or both rows."""
    if selector is not None:
        vectors = selector.apply(vectors)
    size = tiles.planned(queries)
    if size is not None:
        return tiles.search(queries, vectors, k, size, digits)
    if "terms" in vectors.columns:
        queries, vectors = to_triples(queries, "qid"), to_triples(vectors)
    return top_k(scores(queries, vectors, digits).where("score > 0"), check_k(k))


#: Bits of ids that are numbered together, and of ranges of those; places of zeros that are made at a time.
RANGE_BITS, SUPER_BITS, STEP = 12, 10, 4096


def numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, nth): ids in order from 1, by counts of id ranges, and of ranges of ranges, which alone are added up in one place."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).select("doc_id", F.shiftright("doc_id", RANGE_BITS).alias("b"))
    within = own.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("doc_id")))
    ranges = own.groupBy("b").agg(F.count("*").alias("n")).withColumn("s", F.shiftright("b", SUPER_BITS))
    earlier = F.sum("n").over(Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    # one number for 4 million ids
    supers = ranges.groupBy("s").agg(F.sum("n").alias("n")).agg(F.array_sort(F.collect_list(F.struct("s", "n"))).alias("all"))
    before = F.transform("all", lambda x, i: F.struct(x["s"].alias("s"), F.aggregate(F.slice("all", F.lit(1), i), F.lit(0).cast("bigint"), lambda done, y: done + y["n"]).alias("before")))
    supers = supers.select(F.explode(before).alias("x")).select("x.s", "x.before")
    starts = ranges.select("s", "b", F.coalesce(earlier, F.lit(0)).alias("earlier")).join(supers, "s")
    return within.join(starts, "b").select("doc_id", (F.col("before") + F.col("earlier") + F.col("r")).alias("nth"))


def brute(queries: DataFrame, query_ids: DataFrame, vectors: DataFrame, docs: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """The k best of all documents, whatever their score.

    Documents that share no term score 0. A query with k scores above 0 needs none of them; for any
    other, they are among the first k + (documents with a term in common): as many places as it has
    scores, and k more, are joined to the numbered ids.
    """
    size = tiles.planned(queries)
    if size is not None:
        found = tiles.search(queries, vectors, k, size, digits, zeros=(query_ids, docs))
        return found.withColumns({"doc_id": F.col("doc_id").cast("bigint"), "score": F.col("score").cast("double")})
    own = scores(queries, vectors, digits)
    seen = own.groupBy("qid").agg(F.count("*").alias("seen"), F.count_if(F.col("score") > 0).alias("above"))
    many = query_ids.join(seen, "qid", "left").where(F.coalesce("above", F.lit(0)) < check_k(k)).select("qid", (F.coalesce("seen", F.lit(0)) + k).alias("many"))
    steps = many.select("qid", "many", F.explode(F.sequence(F.lit(0), F.expr(f"(many - 1) div {STEP}"))).alias("step"))
    places = steps.select("qid", F.explode(F.sequence(F.col("step") * STEP + 1, F.least("many", (F.col("step") + 1) * STEP))).alias("nth"))
    zeros = places.join(numbered(docs), "nth").select("qid", "doc_id").join(own, ["qid", "doc_id"], "left_anti").withColumn("score", F.lit(0.0))
    return top_k(own.unionByName(zeros.select("qid", "doc_id", "score")), k)


def match(queries: DataFrame, query_ids: DataFrame, vectors: DataFrame, docs: DataFrame, selector: Selector, k: int, digits: int | None = None) -> DataFrame:
    """Exact scores of the few selected documents, zeros included; a selector of at most k ids bounds the pairs."""
    chosen = selector.apply(docs.select("doc_id"))
    own = scores(queries, selector.apply(vectors), digits)
    every = query_ids.select("qid").crossJoin(F.broadcast(chosen)).join(own, ["qid", "doc_id"], "left")
    return top_k(every.select("qid", "doc_id", F.coalesce("score", F.lit(0)).alias("score")), check_k(k))


__all__ = ["brute", "inverted", "match", "padded", "scores", "small_side"]
