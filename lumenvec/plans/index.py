"""Indexes: what a descriptor names, how they take vectors, build, search, and are saved."""

from __future__ import annotations

import dataclasses
import json
import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenvec.functions.quantize import BITS, Quantizer
from lumenvec.model import VECTORS, check_dimension, merged, to_rows, to_triples, validated
from lumenvec.operators import blocks, exact, maxscore, seismic
from lumenvec.operators.selectors import MappedSelector, Selector, is_small
from lumenvec.operators.topk import check_k, padded
from lumenvec.plans.store import folder, written
from lumenvec.sources.csr import read_csr


@dataclass(frozen=True)
class SearchParameters:
    selector: Selector | None = None


@dataclass(frozen=True)
class SeismicParameters(SearchParameters):
    cut: int = 10
    heap_factor: float = 1.0
    strata: tuple[int, ...] = ()  # numbers of lists after which the threshold is raised


@dataclass(frozen=True)
class SeismicSQParameters(SeismicParameters):
    vmin: float | None = None
    vmax: float | None = None


@dataclass(frozen=True)
class ClusterParameters:
    """-1: lambda by the number of documents, beta a tenth of it, seed drawn once a build."""

    lam: int = -1
    beta: int = -1
    alpha: float = 0.4
    seed: int = -1
    every: bool = False  # whether each document stays in its heaviest list, whatever lambda says

    def resolved(self, n: int) -> ClusterParameters:
        lam = max(int(0.0005 * n), 160) if self.lam == -1 else self.lam
        beta = int(0.1 * lam) if self.beta == -1 else self.beta
        seed = random.randrange(1 << 31) if self.seed == -1 else self.seed
        return ClusterParameters(lam, beta, self.alpha, seed, self.every)


class Index:
    """Vectors with ordinals as ids, in the order they were added."""

    kind = ""
    #: Scores are rounded to so many digits before they are ranked, so that equal vectors tie whatever the order of their sums.
    digits = 6

    def __init__(self, spark: SparkSession, dimension: int):
        self.spark, self.dimension = spark, check_dimension(dimension)
        self.vectors: DataFrame | None = None
        self.n = 0

    # -- taking vectors

    def add_frame(self, vectors: DataFrame, n: int, duplicates: str | None = None) -> None:
        """n vectors as triples (doc_id from 0 to n - 1, term, weight); terms are checked when they are read.

        duplicates: `sum` or `refuse` what a vector has twice of a term; None where it is known that none has.
        """
        if n <= 0:
            raise ValueError("n must be positive")
        vectors = vectors if duplicates is None else merged(vectors, duplicates)
        batch = validated(vectors, self.dimension).select((F.col("doc_id") + self.n).cast("int").alias("doc_id"), "term", "weight")
        self.vectors = batch if self.vectors is None else self.vectors.unionByName(batch)
        self.n += n

    def add(self, n: int, indptr, indices, values) -> None:
        self.add_frame(_triples(self.spark, n, indptr, indices, values), n)

    def add_with_ids(self, n: int, indptr, indices, values, ids) -> None:
        raise RuntimeError("add_with_ids is not implemented for this index")

    def read_csr(self, path: str, layout: str = "interchange") -> None:
        from lumenvec.sources.csr import layout_of

        if layout == "native" and self.n:
            raise RuntimeError("a native file is only read into an empty index")
        self.add_frame(read_csr(self.spark, path, layout, self.dimension), layout_of(self.spark, path, layout, self.dimension).rows)

    @property
    def num_vectors(self) -> int:
        return self.n

    def docs(self) -> DataFrame:
        return self.spark.range(self.n).select(F.col("id").cast("int").alias("doc_id"))

    def build(self) -> None:
        raise RuntimeError("build is not implemented for this index")

    # -- searching

    def search_frame(self, queries: DataFrame, query_ids: DataFrame, k: int, params: SearchParameters | None = None) -> DataFrame:
        """(qid, rank, doc_id, score) without padding."""
        raise NotImplementedError

    def search(self, n: int, indptr, indices, values, k: int, params: SearchParameters | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(distances, labels) as arrays [n, k], padded with -1; for batches that fit the driver."""
        if n <= 0:
            raise ValueError("n must be positive")
        check_k(k)
        q = validated(_triples(self.spark, n, indptr, indices, values), 1 << 16).withColumnRenamed("doc_id", "qid")
        ids = self.spark.range(n).select(F.col("id").cast("int").alias("qid"))
        distances, labels = np.full((n, k), -1, np.float32), np.full((n, k), -1, np.int32)
        if self.vectors is not None:
            for r in self.search_frame(q, ids, k, params).collect():
                distances[r["qid"], r["rank"] - 1], labels[r["qid"], r["rank"] - 1] = r["score"], r["doc_id"]
        return distances, labels

    def search_padded(self, queries: DataFrame, query_ids: DataFrame, k: int, params: SearchParameters | None = None) -> DataFrame:
        return padded(self.search_frame(queries, query_ids, k, params), query_ids, k)

    def close(self) -> None:
        """Lets go of what reading an index eagerly has kept in memory; what build writes goes with the checkpoint folder."""
        for name in ("vectors", "lists", "stats", "member", "summary", "directory", "rows"):
            if getattr(self, name, None) is not None:
                getattr(self, name).unpersist()

    # -- saving

    def tables(self) -> dict[str, DataFrame]:
        raise RuntimeError("this index does not support saving")

    def meta(self) -> dict:
        return {"kind": self.kind, "dimension": self.dimension, "n": self.n}

    def write(self, path: str) -> None:
        for name, table in self.tables().items():
            out = table.write.mode("overwrite")
            (out.partitionBy("part") if "part" in table.columns else out).parquet(f"{path}/{name}")
        self.spark.createDataFrame([(json.dumps(self.meta()),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_meta.json")

    def load(self, path: str, meta: dict) -> None:
        self.n = meta["n"]
        self.vectors = self._loaded_vectors(path)

    def _loaded_vectors(self, path: str) -> DataFrame:
        return to_triples(self.spark.read.parquet(f"{path}/vectors_rows"))


class BruteIndex(Index):
    """Scores every document; takes no notice of selectors unless strict."""

    kind = "brutal"
    strict = False

    def search_frame(self, queries, query_ids, k, params=None):
        vectors, docs = self.vectors, self.docs()
        if self.strict and params is not None and params.selector is not None:
            vectors, docs = params.selector.apply(vectors), params.selector.apply(docs)
        return exact.brute(queries, query_ids, vectors, docs, k, self.digits)


class InvertedIndex(Index):
    """Exact search over posting lists by upper bounds; documents must score above 0."""

    kind = "inverted"

    def __init__(self, spark, dimension):
        super().__init__(spark, dimension)
        self.lists = self.stats = None

    def build(self):
        if self.vectors is None:
            raise RuntimeError("nothing to build")
        # dealt by term once, for every search after; a term out of range fails here
        to = folder(self.spark)
        (self.lists,) = written(self.spark, to, postings=maxscore.lists(self.vectors))
        (self.stats,) = written(self.spark, to, term_stats=maxscore.band_stats(self.lists))

    def search_frame(self, queries, query_ids, k, params=None):
        if self.lists is None:
            return exact.inverted(queries, self.vectors.limit(0), k)
        chosen = params.selector if params else None
        return maxscore.search(queries, self.lists if chosen is None else chosen.apply(self.lists), self.stats, k, self.digits)

    def tables(self):
        if self.lists is None:
            self.build()
        return {"postings": self.lists, "term_stats": self.stats}

    def load(self, path, meta):
        self.n = meta["n"]
        self.lists, self.stats = (self.spark.read.parquet(f"{path}/{t}") for t in ("postings", "term_stats"))
        self.vectors = self.lists.select("doc_id", "term", "weight")


class SeismicIndex(Index):
    """Approximate search over pruned, clustered posting lists whose blocks hold their documents' vectors."""

    kind = "seismic"
    parameters = SeismicParameters

    def __init__(self, spark, dimension, cluster: ClusterParameters = ClusterParameters()):
        super().__init__(spark, dimension)
        self.cluster = cluster
        self.member = self.summary = self.directory = self.rows = None
        self.folders = 1

    def weights(self) -> DataFrame:
        """The vectors that are clustered and scored."""
        return self.vectors

    def build(self):
        if self.vectors is None:
            raise RuntimeError("nothing to build")
        to = folder(self.spark)
        # written once, as building reads them several times; a term out of range fails here
        (self.vectors,) = written(self.spark, to, vectors=self.vectors)
        (own,) = written(self.spark, to, weights=self.weights()) if self.weights() is not self.vectors else (self.vectors,)
        c = self.cluster.resolved(self.n)
        (self.member,) = written(self.spark, to, cluster_members=seismic.lists(own, c.lam, c.beta, c.seed, c.every))
        (self.summary,) = written(self.spark, to, cluster_summary=seismic.summaries(self.member, own, c.alpha))
        self.folders = blocks.folders_for(self.member.count() * own.count() // max(self.n, 1))
        self.directory, self.rows = written(self.spark, to, {"blocks": "part"}, directory=blocks.directory(self.member, self.summary), blocks=blocks.block_rows(self.member, own, self.folders))
        self.rows = blocks.with_folders(self.rows, self.folders)

    def _params(self, params):
        plain = params or self.parameters()
        own = {f.name: getattr(plain, f.name) for f in dataclasses.fields(self.parameters) if hasattr(plain, f.name)}
        return self.parameters(**own)

    def search_frame(self, queries, query_ids, k, params=None):
        p = self._params(params)
        if p.cut <= 0:
            raise ValueError("cut must be positive")
        queries = self.prepared(queries, p)
        if is_small(p.selector, k):
            found = exact.match(queries, query_ids, self.weights(), self.docs(), p.selector, k, self.digits)
        elif self.rows is None:
            found = exact.inverted(queries, self.vectors.limit(0), k)
        else:
            found = blocks.search(queries, self.directory, self.rows, k, p.cut, p.heap_factor, p.selector, self.digits, p.strata)
        return self.finished(found, p)

    def prepared(self, queries, p):
        return queries

    def finished(self, found, p):
        return found

    def meta(self):
        return super().meta() | {"cluster": dataclasses.asdict(self.cluster), "folders": self.folders, "built": self.rows is not None}

    def kept(self) -> dict[str, DataFrame]:
        """The vectors as they are saved."""
        return {"vectors_rows": to_rows(self.vectors)}

    def tables(self):
        if self.rows is None:
            return self.kept()
        return self.kept() | {"cluster_members": self.member, "cluster_summary": self.summary, "directory": self.directory, "blocks": self.rows}

    def block(self, term: int, cluster: int) -> DataFrame:
        """(doc_id, terms, weights) of one block's documents, read from its folder; empty if there is none."""
        here = (F.col("part") == term % self.folders) & (F.col("term") == term) & (F.col("cluster") == cluster)
        return self.rows.where(here).select("doc_id", "terms", "weights")

    def num_blocks_in_list(self, term: int) -> int:
        return blocks.num_blocks_in_list(self.directory, term)

    def load(self, path, meta):
        super().load(path, meta)
        if meta.get("built", True):
            self.folders = meta.get("folders", 1)
            self.member, self.summary, self.directory, rows = (self.spark.read.parquet(f"{path}/{t}") for t in ("cluster_members", "cluster_summary", "directory", "blocks"))
            self.rows = blocks.with_folders(rows, self.folders)


class SeismicSQIndex(SeismicIndex):
    """The same over 8- or 16-bit codes, which are stored and summed as whole numbers; scores are decoded at the end."""

    kind = "seismic_sq"
    parameters = SeismicSQParameters

    def __init__(self, spark, dimension, cluster: ClusterParameters = ClusterParameters(), quantizer: Quantizer = Quantizer()):
        super().__init__(spark, dimension, cluster)
        self.quantizer = quantizer
        self.codes: DataFrame | None = None

    def weights(self):
        return self.vectors.withColumn("weight", self.quantizer.encode(F.col("weight")).cast(self.quantizer.column)) if self.codes is None else self.codes

    def prepared(self, queries, p):
        return queries.withColumn("weight", self.quantizer.for_query(p.vmin, p.vmax).encode(F.col("weight")))

    def finished(self, found, p):
        return found.withColumn("score", self.quantizer.decode_dot(F.col("score"), self.quantizer.for_query(p.vmin, p.vmax)))

    def meta(self):
        return super().meta() | {"quantizer": dataclasses.asdict(self.quantizer)}

    def kept(self):
        """Codes only: they are made once and never again."""
        return {"codes_rows": to_rows(self.weights())}

    def load(self, path, meta):
        self.codes = to_triples(self.spark.read.parquet(f"{path}/codes_rows"))
        super().load(path, meta)

    def _loaded_vectors(self, path):
        return self.codes.withColumn("weight", self.quantizer.decode(F.col("weight")).cast("float"))


class IdMapIndex(Index):
    """Another index under external ids."""

    kind = "idmap"

    def __init__(self, inner: Index):
        super().__init__(inner.spark, inner.dimension)
        self.inner = inner
        self.id_map: DataFrame | None = None

    def _extend(self, n: int, ids: DataFrame) -> None:
        self.id_map = ids if self.id_map is None else self.id_map.unionByName(ids)
        self.n = self.inner.n
        self.vectors = self.inner.vectors

    def add(self, n, indptr, indices, values):
        """Ids are the ordinals."""
        at = self.inner.n
        self.inner.add(n, indptr, indices, values)
        self._extend(n, self.spark.range(at, at + n).select(F.col("id").cast("int").alias("doc_id"), F.col("id").cast("int").alias("ext_id")))

    def add_with_ids(self, n, indptr, indices, values, ids):
        ids = [int(x) for x in ids]
        if len(ids) != n:
            raise ValueError("ids must be as many as vectors")
        self.add_frame_with_ids(_triples(self.spark, n, indptr, indices, values), n, self.spark.createDataFrame(list(enumerate(ids)), "doc_id int, ext_id int"))

    def add_frame_with_ids(self, vectors: DataFrame, n: int, ids: DataFrame) -> None:
        """The same for triples with doc_id from 0 to n - 1, and ids: (doc_id, ext_id)."""
        at = self.inner.n
        mine = ids.select((F.col("doc_id") + at).cast("int").alias("doc_id"), F.col("ext_id").cast("int").alias("ext_id"))
        every = mine if self.id_map is None else self.id_map.unionByName(mine)
        if every.groupBy("ext_id").count().where("count > 1").take(1):
            raise ValueError("ids must be distinct")
        self.inner.add_frame(vectors, n)
        self._extend(n, mine)

    def read_csr(self, path, layout="interchange"):
        at = self.inner.n
        self.inner.read_csr(path, layout)
        self._extend(self.inner.n - at, self.spark.range(at, self.inner.n).select(F.col("id").cast("int").alias("doc_id"), F.col("id").cast("int").alias("ext_id")))

    def build(self):
        self.inner.build()

    def close(self):
        self.inner.close()

    def search_frame(self, queries, query_ids, k, params=None):
        if params is not None and params.selector is not None:
            params = dataclasses.replace(params, selector=MappedSelector(params.selector, self.id_map))
        found = self.inner.search_frame(queries, query_ids, k, params)
        return found.join(self.id_map, "doc_id").select("qid", "rank", F.col("ext_id").alias("doc_id"), "score")

    def meta(self):
        return super().meta() | {"inner": self.inner.meta()}

    def tables(self):
        return {"id_map": self.id_map} | {f"inner/{k}": t for k, t in self.inner.tables().items()}


def _triples(spark: SparkSession, n: int, indptr, indices, values) -> DataFrame:
    """Triples from arrays of compressed sparse rows."""
    indptr, indices, values = np.asarray(indptr, np.int64), np.asarray(indices), np.asarray(values)
    if values.dtype != np.float32:
        raise TypeError("weights must be float32")
    if not np.issubdtype(indices.dtype, np.integer):
        raise TypeError("indices must be integers")
    if len(indptr) != n + 1 or indptr[0] != 0 or indptr[-1] != len(indices) or len(indices) != len(values) or (np.diff(indptr) < 0).any():
        raise ValueError("bad row offsets")
    import pandas as pd

    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(indptr))
    # of a term that a row has twice the last weight holds
    key = (row.astype(np.int64) << 32) | indices.astype(np.int64)
    last = len(key) - 1 - np.unique(key[::-1], return_index=True)[1]
    if len(last) < len(key):
        last.sort()
        row, indices, values = row[last], indices[last], values[last]
    return spark.createDataFrame(pd.DataFrame({"doc_id": row, "term": indices.astype(np.int32), "weight": values}), VECTORS)


def index_factory(spark: SparkSession, dimension: int, descriptor: str) -> Index:
    """type[,key=value|key=value ...]; unknown keys and malformed pairs count for nothing, the first of repeated keys holds."""
    if not descriptor or not descriptor.strip():
        raise ValueError("descriptor is null or empty")
    head, _, tail = descriptor.partition(",")
    head = head.strip()
    if head == "idmap":
        if not tail.strip():
            raise ValueError("idmap: a delegate is required")
        return IdMapIndex(index_factory(spark, dimension, tail))
    options: dict[str, str] = {}
    for pair in tail.split("|"):
        key, eq, value = pair.partition("=")
        if eq and key.strip() and "=" not in value:
            options.setdefault(key.strip(), value.strip())
    if head == "brutal":
        return BruteIndex(spark, dimension)
    if head == "inverted":
        return InvertedIndex(spark, dimension)
    if head not in ("seismic", "seismic_sq"):
        raise ValueError(f"unknown index type {head}")
    cluster = ClusterParameters(int(options.get("lambda", 10)), int(options.get("beta", 5)), float(options.get("alpha", 0.5)), int(options.get("seed", -1)), options.get("every", "0") == "1")
    if head == "seismic":
        return SeismicIndex(spark, dimension, cluster)
    kind = options.get("quantizer", "8bit")
    return SeismicSQIndex(spark, dimension, cluster, Quantizer(kind if kind in BITS else "8bit", float(options.get("vmin", 0.0)), float(options.get("vmax", 1.0))))


def write_index(index: Index, path: str) -> None:
    index.write(path)


def read_index(spark: SparkSession, path: str, lazy: bool = True) -> Index:
    """A saved index; lazy leaves its tables on disk until they are scanned, else they are persisted."""
    meta = json.loads(spark.read.text(f"{path}/_meta.json").first()[0])
    return _load(spark, path, meta, lazy)


def _load(spark: SparkSession, path: str, meta: dict, lazy: bool) -> Index:
    if meta["kind"] == "idmap":
        out = IdMapIndex(_load(spark, f"{path}/inner", meta["inner"], lazy))
        out.id_map, out.n, out.vectors = spark.read.parquet(f"{path}/id_map"), meta["n"], out.inner.vectors
        return out
    kinds = {"inverted": InvertedIndex, "seismic": SeismicIndex, "seismic_sq": SeismicSQIndex}
    if meta["kind"] not in kinds:
        raise ValueError(f"unknown index type {meta['kind']}")
    args = [ClusterParameters(**meta["cluster"])] if "cluster" in meta else []
    args += [Quantizer(**meta["quantizer"])] if "quantizer" in meta else []
    out = kinds[meta["kind"]](spark, meta["dimension"], *args)
    out.load(path, meta)
    if not lazy:
        for name in ("vectors", "lists", "stats", "member", "summary", "directory", "rows"):
            if getattr(out, name, None) is not None:
                setattr(out, name, getattr(out, name).persist())
    return out
