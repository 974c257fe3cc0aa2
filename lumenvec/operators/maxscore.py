"""Exact search that leaves most postings unread, by upper bounds; weights must not be negative.

Documents are told apart by the band of their norm (powers of two of its square), and lists keep the largest
weight of each band. What a document can still add to a partial score is bounded twice: by the sum of
the largest weights of the terms left over in its band, and, by Cauchy and Schwarz, by the norm of
the query's terms left over times the norm of what the document has besides the terms already seen.

    1. The heaviest terms of each query are scored against all documents; the k-th best of these partial
       scores is a threshold that no document of the answer is below.
    2. A later term is read in the bands where it and all after it could reach the threshold together;
       a document of another band that has none of the terms read can't be in the answer.
    3. Documents whose partial score and bound reach the threshold are scored by their whole vectors.

Nothing is approximate: documents that may tie with the threshold are scored too. A batch of queries
whose terms are few enough is planned on the driver between the passes; a larger one stays distributed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenvec.operators import tiles
from lumenvec.operators.exact import inverted, small_side
from lumenvec.operators.topk import check_k, top_k
from lumenvec.plans.store import settled

#: Share of a query's bounds that its first terms hold. More reads more postings before there is a threshold, less gives a lower one.
FIRST_SHARE = 0.3
#: Two passes pay if the first reads at most this share of the query terms' postings; else all are read at once. It changes the work only.
FIRST_POSTINGS = 0.1
#: And if there are so many postings that reading them takes longer than planning two passes, which is some seconds.
LEAST_POSTINGS = 100_000_000
#: What sums of doubles in another order, and rounding, may differ by.
SLACK = 1e-5


def banded(vectors: DataFrame) -> DataFrame:
    """(term, band, doc_id, weight, norm2): the triples with the square of their document's norm, and its band; vectors without weight have the lowest."""
    square = F.sum(F.col("weight").cast("double") * F.col("weight").cast("double")).over(Window.partitionBy("doc_id"))
    rows = vectors.select("doc_id", "term", "weight", square.alias("norm2"))
    return rows.select("term", F.coalesce(F.floor(F.log2("norm2")), F.lit(-1075)).cast("int").alias("band"), "doc_id", "weight", "norm2")


def lists(vectors: DataFrame) -> DataFrame:
    """The banded triples dealt by (term, band), so that a frequent term isn't one task, in order of both."""
    return banded(vectors).repartition("term", "band").sortWithinPartitions("term", "band", "doc_id")


def band_stats(lists: DataFrame) -> DataFrame:
    """(term, band, df, max_weight, min_weight) of every list in every band."""
    w = F.col("weight").cast("double")
    return lists.groupBy("term", "band").agg(F.count("*").alias("df"), F.max(w).alias("max_weight"), F.min(w).alias("min_weight"))


def ordered(queries: DataFrame, stats: DataFrame, share: float = FIRST_SHARE) -> DataFrame:
    """(qid, term, weight, pos, later, df, first): each query's terms that have a list, the heaviest bound first.

    later: the square of the norm of it and all after it; first: whether it is among the first, which hold `share` of the bounds.
    """
    w = F.col("weight").cast("double")
    whole = stats.groupBy("term").agg(F.sum("df").alias("df"), F.max("max_weight").alias("max_weight"))
    met = whole.join(small_side(queries), "term").select("qid", "term", w.alias("weight"), "df", (w * F.col("max_weight")).alias("bound"))
    order = Window.partitionBy("qid").orderBy(F.desc("bound"), "term")
    before = F.coalesce(F.sum("bound").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    later = F.sum(F.col("weight") * F.col("weight")).over(order.rowsBetween(0, Window.unboundedFollowing))
    return met.select("qid", "term", "weight", F.row_number().over(order).alias("pos"), later.alias("later"), "df", (before < share * F.sum("bound").over(Window.partitionBy("qid"))).alias("first"))


def partial(terms: DataFrame, of: DataFrame, on: list[str]) -> DataFrame:
    """(qid, doc_id, band, norm2, p, seen) of terms joined to lists: partial scores, and the square of the norm of the postings read."""
    w = F.col("d.weight").cast("double")
    met = of.alias("d").join(terms.alias("q"), [F.col(f"d.{c}") == F.col(f"q.{c}") for c in on])
    return met.groupBy("q.qid", "d.doc_id", "d.band", "d.norm2").agg(F.sum(F.col("q.weight") * w).alias("p"), F.sum(w * w).alias("seen"))


def thresholds(partials: DataFrame, k: int) -> DataFrame:
    """(qid, tau): the k-th best partial score of each query that has k."""
    best = partials.select("qid", "p", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("p"))).alias("r")).where(F.col("r") <= k)
    return best.where(F.col("r") == k).select("qid", F.col("p").alias("tau"))


def bounds(terms: DataFrame, stats: DataFrame, tau: DataFrame) -> DataFrame:
    """(qid, band, term, weight, tau, read, rest, later): by band, whether a term that isn't among the first must be read, and the bounds of it and all after it."""
    by_band = stats.join(terms.where(~F.col("first")), "term").join(tau, "qid", "left").withColumn("tau", F.coalesce("tau", F.lit(0.0)))
    order = Window.partitionBy("qid", "band").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    by_band = by_band.select("qid", "band", "term", "weight", "pos", "tau", "later", F.sum(F.col("weight") * F.col("max_weight")).over(order).alias("rest"))
    # the norm of any document in a band is below the next band's start
    reach = F.least("rest", F.sqrt(F.col("later") * F.pow(F.lit(2.0), F.col("band") + 1)))
    return by_band.select("qid", "band", "term", "weight", "pos", "tau", "rest", "later", (reach * (1 + 1e-9) + SLACK >= F.col("tau")).alias("read"))


def _planned(terms: DataFrame, of: DataFrame, stats: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(partial scores of the first terms, their thresholds, the terms to read by band, the bounds of all others by band)."""
    first = partial(terms.where("first").select("qid", "term", "weight"), of, ["term"])
    tau, _ = settled(thresholds(first, k))
    # of the terms never read in a band the one that comes first has the bounds of all
    edge = F.coalesce(F.lag("read").over(Window.partitionBy("qid", "band").orderBy("pos")), F.lit(True))
    by_band, _ = settled(bounds(terms, stats, tau).withColumn("edge", edge).where("read or edge").select("qid", "band", "term", "weight", "rest", "later", "read"))
    return first, tau, by_band.where("read").select("qid", "band", "term", "weight"), by_band.where("not read").select("qid", "band", "rest", "later")


def candidates(queries: DataFrame, of: DataFrame, stats: DataFrame, k: int, share: float = FIRST_SHARE, terms: DataFrame | None = None) -> DataFrame:
    """(qid, doc_id) of all documents that may be among the k best, and few others; of: `lists`."""
    terms = settled(ordered(queries, stats, share))[0] if terms is None else terms
    first, tau, read, left = _planned(terms, of, stats, k)
    both = first.unionByName(partial(read, of, ["term", "band"])).groupBy("qid", "doc_id", "band", "norm2").agg(F.sum("p").alias("p"), F.sum("seen").alias("seen"))
    reach = F.least(F.coalesce("rest", F.lit(0.0)), F.sqrt(F.coalesce("later", F.lit(0.0)) * F.greatest(F.col("norm2") - F.col("seen"), F.lit(0.0))))
    met = both.join(left, ["qid", "band"], "left").join(tau, "qid", "left")
    most = (F.col("p") + reach) * (1 + 1e-9) + SLACK
    may = met.select("qid", "doc_id", "p", most.alias("most")).where(F.col("most") >= F.coalesce("tau", F.lit(0.0)))
    # with more terms read the k-th best partial score is higher: those that have it are among these
    by = Window.partitionBy("qid")
    may = may.withColumn("r", F.row_number().over(by.orderBy(F.desc("p"))))
    may = may.withColumn("tau", F.coalesce(F.max(F.when(F.col("r") == k, F.col("p"))).over(by), F.lit(0.0)))
    return may.where(F.col("most") >= F.col("tau")).select("qid", "doc_id")


def search(queries: DataFrame, of: DataFrame, stats: DataFrame, k: int, digits: int | None = None, vectors: DataFrame | None = None, share: float = FIRST_SHARE, most: float = FIRST_POSTINGS, least: int = LEAST_POSTINGS) -> DataFrame:
    """(qid, rank, doc_id, score): exactly what `exact.inverted` finds.

    of: `lists`, stats: its `band_stats`; vectors: the same triples where they are better found by
    document. Batches with a negative weight on either side, those whose first terms have more than `most`
    of the postings, and those of fewer than `least` postings are searched by reading all postings of their terms.
    Batches whose partial scores would be rows of nearly all pairs are searched in tiles, by bounds of each.
    """
    check_k(k)
    size = tiles.planned(queries)
    if size is not None:
        return tiles.search(queries, of if vectors is None else vectors, k, size, digits, bounds=True)
    terms, held = settled(ordered(queries, stats, share))
    if held is not None:
        some = held.to_pandas()
        df = {"first": int(some["df"][some["first"]].sum()), "every": int(some["df"].sum()), "least": some["weight"].min() if len(some) else 0}
    else:
        df = terms.agg(F.sum(F.when(F.col("first"), F.col("df"))).alias("first"), F.sum("df").alias("every"), F.min("weight").alias("least")).first()
    plain = not df["every"] or df["every"] < least or df["first"] > most * df["every"] or df["least"] < 0
    if plain or stats.where("min_weight < 0").limit(1).count():
        return inverted(queries, of, k, digits=digits)
    pairs, _ = settled(candidates(queries, of, stats, k, share, terms))
    return top_k(rescored(pairs, queries, of if vectors is None else vectors, digits).where("score > 0"), k)


def rescored(pairs: DataFrame, queries: DataFrame, vectors: DataFrame, digits: int | None) -> DataFrame:
    """(qid, doc_id, score) of distinct pairs by whole vectors."""
    q = queries.select("qid", "term", F.col("weight").cast("double").alias("w"))
    met = vectors.select("doc_id", "term", F.col("weight").cast("double").alias("v")).join(pairs, "doc_id").join(small_side(q), ["qid", "term"])
    total = F.sum(F.col("w") * F.col("v"))
    return met.groupBy("qid", "doc_id").agg((F.round(total, digits) if digits is not None else total).alias("score"))


def work(queries: DataFrame, of: DataFrame, stats: DataFrame, k: int, share: float = FIRST_SHARE) -> DataFrame:
    """(qid, n_postings, n_read, n_candidates): postings of the query's terms, those read in both passes, and documents scored."""
    terms, _ = settled(ordered(queries, stats, share))
    *_, read, _ = _planned(terms, of, stats, k)
    more = read.join(stats.select("term", "band", F.col("df").alias("in_band")), ["term", "band"]).groupBy("qid").agg(F.sum("in_band").alias("more"))
    done = candidates(queries, of, stats, k, share, terms).groupBy("qid").agg(F.count("*").alias("n_candidates"))
    own = terms.groupBy("qid").agg(F.sum("df").alias("n_postings"), F.sum(F.when(F.col("first"), F.col("df")).otherwise(0)).alias("first"))
    return own.join(more, "qid", "left").join(done, "qid", "left").select("qid", "n_postings", (F.col("first") + F.coalesce("more", F.lit(0))).alias("n_read"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))
