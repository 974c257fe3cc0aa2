"""Schemas of the engine's tables, validation, and the two forms of a sparse matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VECTORS = "doc_id int, term int, weight float"
ROWS = "doc_id int, terms array<int>, weights array<float>"
QUERIES = "qid int, term int, weight float"
RESULTS = "qid int, rank int, doc_id int, score double"
#: Terms are unsigned 16-bit numbers.
MOST_DIMENSION = 1 << 16


def check_dimension(dimension: int) -> int:
    if not 0 < dimension <= MOST_DIMENSION:
        raise ValueError(f"dimension must be positive and at most {MOST_DIMENSION}")
    return dimension


def validated(vectors: DataFrame, dimension: int, key: str = "doc_id") -> DataFrame:
    """The same triples; a row with a term out of range, or a weight that isn't a number, fails the job that reads it."""
    check_dimension(dimension)
    term = F.when((F.col("term") >= 0) & (F.col("term") < dimension), F.col("term")).otherwise(F.raise_error(F.lit("term_id out of range")).cast("int"))
    bad = F.col("weight").isNull() | F.isnan("weight") | (F.abs(F.col("weight")) == float("inf"))
    weight = F.when(~bad, F.col("weight")).otherwise(F.raise_error(F.lit("weight must be finite")).cast("float"))
    return vectors.select(key, term.alias("term"), weight.alias("weight"))


def duplicates(vectors: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, term, n) of the terms that a row has more than once."""
    return vectors.groupBy(key, "term").agg(F.count("*").alias("n")).where("n > 1")


def merged(vectors: DataFrame, policy: str, key: str = "doc_id") -> DataFrame:
    """The triples with every term of a row once; policy: `sum` adds repeated ones up, `refuse` fails the job that reads them. One shuffle, combined before it."""
    if policy not in ("sum", "refuse"):
        raise ValueError("policy must be sum or refuse")
    kind = vectors.schema["weight"].dataType
    once = vectors.groupBy(key, "term").agg(F.sum("weight").cast(kind).alias("weight"), F.count("*").alias("n"))
    if policy == "refuse":
        once = once.withColumn("weight", F.when(F.col("n") == 1, F.col("weight")).otherwise(F.raise_error(F.lit("a row has a term twice")).cast(kind)))
    return once.select(key, "term", "weight")


def to_rows(vectors: DataFrame, key: str = "doc_id") -> DataFrame:
    """Triples to one row a vector, terms ascending."""
    both = F.array_sort(F.collect_list(F.struct("term", "weight")))
    return vectors.groupBy(key).agg(both.alias("e")).select(key, F.col("e.term").alias("terms"), F.col("e.weight").alias("weights"))


def to_triples(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    return rows.select(key, F.explode(F.arrays_zip("terms", "weights")).alias("e")).select(key, F.col("e.terms").alias("term"), F.col("e.weights").alias("weight"))


def dense(vectors: DataFrame, dimension: int, key: str = "doc_id") -> DataFrame:
    """One array of all weights (or codes) for each vector, for tests and debugging; terms are unique in a vector."""
    kind = vectors.schema["weight"].dataType
    by = vectors.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("m"))
    return by.select(key, F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast(kind))).alias("dense"))


def stats(vectors: DataFrame) -> DataFrame:
    """(n_vectors, nnz, n_terms) of triples."""
    return vectors.agg(F.countDistinct("doc_id").alias("n_vectors"), F.count("*").alias("nnz"), F.countDistinct("term").alias("n_terms"))
