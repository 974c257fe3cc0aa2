"""Approximate search over clustered blocks that hold their documents' vectors.

A directory has a row for every block: its size and its summary. A block's documents stand next to each other
with their whole vectors, in folders by a remainder of the list's term, so a search reads the
folders of the lists it asks and joins no vectors. Products with the queries are worked out a batch at a time
in numpy; codes of a quantised index are summed as whole numbers.

Search goes in rounds. The first blocks in visiting order that hold k documents give a threshold; every
round opens the blocks of some of the query's lists whose summaries, times heap_factor, reach the threshold, which is
raised to the k-th best score after it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lumenvec.model import to_rows
from lumenvec.operators import tiles
from lumenvec.operators.postings import cut_terms
from lumenvec.operators.selectors import Selector
from lumenvec.operators.topk import check_k
from lumenvec.plans.store import LOCAL_ROWS, settled

#: Entries of blocks in a folder, about, and folders at most.
FOLDER_ENTRIES, MOST_FOLDERS = 1 << 22, 1024


def block_rows(member: DataFrame, vectors: DataFrame, folders: int = 1) -> DataFrame:
    """(term, cluster, doc_id, terms, weights, part): each block's documents with their vectors, blocks in order, dealt by folder and block."""
    return of_rows(member, to_rows(vectors), folders)


def of_rows(member: DataFrame, rows: DataFrame, folders: int = 1) -> DataFrame:
    """The same of vectors as rows. A folder's blocks are dealt to as many tasks as its share of all, so that files don't multiply."""
    own = member.select("term", "cluster", "doc_id").join(rows, "doc_id").select("term", "cluster", "doc_id", "terms", "weights", F.pmod("term", F.lit(folders)).cast("int").alias("part"))
    tasks = -(-2 * int(member.sparkSession.conf.get("spark.sql.shuffle.partitions")) // folders)
    return own.repartition("part", F.pmod(F.xxhash64("term", "cluster"), F.lit(tasks))).sortWithinPartitions("part", "term", "cluster", "doc_id")


def folders_for(entries: int) -> int:
    return min(max(entries // FOLDER_ENTRIES, 1), MOST_FOLDERS)


def directory(member: DataFrame, summary: DataFrame) -> DataFrame:
    """(term, cluster, size, s_terms, s_values): every block's number of documents and its summary, terms ascending."""
    sizes = member.groupBy("term", "cluster").agg(F.count("*").alias("size"))
    both = F.array_sort(F.collect_list(F.struct("s_term", "s_value")))
    held = summary.groupBy("term", "cluster").agg(both.alias("e")).select("term", "cluster", F.col("e.s_term").alias("s_terms"), F.col("e.s_value").alias("s_values"))
    return sizes.join(held, ["term", "cluster"]).repartition("term").sortWithinPartitions("term", "cluster")


def num_blocks_in_list(directory_: DataFrame, term: int) -> int:
    """Blocks of one list; 0 if there is none."""
    return directory_.where(F.col("term") == term).count()


class Asked:
    """A batch of queries: a sorted array that every task holds, or, where that is too large, rows to be joined."""

    def __init__(self, queries: DataFrame):
        rows = queries.select(F.col("qid").cast("bigint").alias("qid"), F.col("term").cast("bigint").alias("term"), "weight")
        self.whole = isinstance(queries.schema["weight"].dataType, IntegralType)
        self.type = "bigint" if self.whole else "double"
        some = rows.select("qid", "term", F.col("weight").cast(self.type).alias("weight")).limit(LOCAL_ROWS + 1).toArrow()
        self.rows = self.held = self.local = None
        if some.num_rows > LOCAL_ROWS:
            self.rows = to_rows(rows, "qid").select("qid", F.col("terms").alias("q_terms"), F.col("weights").alias("q_weights"))
            return
        qid, term, weight = (c.to_numpy() for c in some.columns)
        ids, at = np.unique(qid, return_inverse=True)
        key = (at.astype(np.int64) << 32) | term
        self.local = (qid, term, weight)
        # a term that a query has twice counts twice
        key, first = np.unique(key, return_inverse=True)
        total = np.zeros(len(key), weight.dtype)
        np.add.at(total, first, weight)
        self.held = queries.sparkSession.sparkContext.broadcast((ids, key, total))

    def cuts(self, queries: DataFrame, cut: int) -> DataFrame:
        """(qid, list_no, term): what `cut_terms` gives."""
        if cut <= 0 or self.local is None:
            return cut_terms(queries, cut)
        qid, term, weight = self.local
        order = np.lexsort((term, -weight, qid))
        qid, term = qid[order], term[order]
        no = np.arange(len(qid)) - np.searchsorted(qid, qid)
        keep = no < cut
        table = pa.table({"qid": qid[keep], "list_no": no[keep].astype(np.int32), "term": term[keep]})
        return F.broadcast(queries.sparkSession.createDataFrame(table))

    def scored(self, rows: DataFrame, keep: str, terms: str, values: str, digits: int | None) -> DataFrame:
        """The columns of `keep` (name type, ...; with qid) and `score`: products of the arrays `terms` and `values` with the row's query."""
        names = [x.split()[0] for x in keep.split(", ")]
        held, whole = self.held, self.whole
        rows = rows if held is not None else rows.join(self.rows, "qid")
        more = [] if held is not None else ["q_terms", "q_weights"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                at, term = _flat(b.column(len(names)))
                _, value = _flat(b.column(len(names) + 1))
                if held is not None:
                    ids, key, weight = held.value
                    row = np.searchsorted(ids, b.column(names.index("qid")).to_numpy())
                else:
                    q_at, q_term = _flat(b.column(len(names) + 2))
                    row = np.arange(b.num_rows)
                    key = (np.repeat(row, np.diff(q_at)) << 32) | q_term
                    weight = _flat(b.column(len(names) + 3))[1]
                own = (np.repeat(row, np.diff(at)) << 32) | term
                found = np.minimum(np.searchsorted(key, own), max(len(key) - 1, 0))
                hit = key[found] == own if len(key) else np.zeros(len(own), bool)
                dtype = np.int64 if whole and np.issubdtype(value.dtype, np.integer) else np.float64
                product = np.where(hit, weight[found].astype(dtype) * value.astype(dtype), 0)
                of = np.repeat(np.arange(b.num_rows), np.diff(at))
                if dtype == np.int64:
                    ends = np.concatenate([[0], np.cumsum(product)])
                    score = (ends[at[1:]] - ends[at[:-1]]).astype(np.float64)
                else:
                    score = np.bincount(of, product, b.num_rows)
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(score)], [*names, "score"])

        out = rows.select(*[F.col(x.split()[0]).cast(x.split()[1]) for x in keep.split(", ")], terms, values, *more).mapInArrow(run, f"{keep}, score double")
        return out if digits is None else out.withColumn("score", F.round("score", digits))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, values) of a list array."""
    at = lists.offsets.to_numpy()
    return at - at[0], lists.values.slice(int(at[0]), int(at[-1] - at[0])).to_numpy(zero_copy_only=False)


VISIT = "qid bigint, list_no int, term int, cluster int, size bigint"


def visits(asked: Asked, queries: DataFrame, directory_: DataFrame, cut: int) -> DataFrame:
    """(qid, list_no, term, cluster, s, before, size): blocks of the query's heaviest lists in visiting order, their summaries' scores, and how many documents those before it hold."""
    s = asked.scored(directory_.join(asked.cuts(queries, cut), "term"), VISIT, "s_terms", "s_values", 6).withColumnRenamed("score", "s")
    # dealt by query once, for the order and all that follows
    order = Window.partitionBy("qid").orderBy("list_no", F.when(F.col("list_no") == 0, -F.col("s")).otherwise(F.lit(0.0)), "cluster", "term")
    ahead = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return s.select("qid", "list_no", "term", "cluster", "s", F.coalesce(ahead, F.lit(0)).alias("before"), "size")


#: Documents from which a block is scored in tiles, of as many documents at most: only the k best of each leave it.
TILE_LEAST, TILE_DOCS = 64, 4096


def tiled(which: DataFrame, queries: DataFrame, rows: DataFrame, k: int, digits: int, parts: int) -> DataFrame:
    """(qid, doc_id, score) of the k best documents for each query in each tile of large blocks; parts: of queries, so that a task holds a bounded number."""
    whole = all(isinstance(t, IntegralType) for t in (queries.schema["weight"].dataType, rows.schema["weights"].dataType.elementType))
    kinds = ["array<bigint>", "array<bigint>" if whole else "array<double>"]
    arrays = lambda of: [F.col("terms").cast(kinds[0]).alias("terms"), F.col("weights").cast(kinds[1]).alias("weights")]
    tiles_of = F.ceil(F.col("size") / TILE_DOCS)
    all_of = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    own = lambda id_, n: F.pmod(F.xxhash64(id_), n)
    # a block's tile and a part of the queries in one number
    place = lambda tile, part: ((F.col("cluster").cast("bigint") * (1 << 20) + tile) * F.lit(parts) + part).alias("b")
    parts_ = F.lit(parts).cast("bigint")
    sizes = which.select("term", "cluster", "size").distinct()
    q = which.select("qid", "term", "cluster", F.explode(all_of(tiles_of)).alias("tile")).join(to_rows(queries.withColumn("qid", F.col("qid").cast("bigint")), "qid"), "qid")
    q = q.select(F.col("term").cast("bigint").alias("g"), place(F.col("tile"), own("qid", parts_)), F.lit(False).alias("doc"), F.lit(0.0).alias("by"), F.col("qid").alias("id"), *arrays(q))
    d = rows.join(sizes, ["term", "cluster"]).withColumn("id", F.col("doc_id").cast("bigint"))
    d = d.select("term", "cluster", "size", "id", "terms", "weights", F.explode(all_of(parts_)).alias("part"))
    d = d.select(F.col("term").cast("bigint").alias("g"), place(own("id", tiles_of), F.col("part")), F.lit(True).alias("doc"), F.lit(0.0).alias("by"), "id", *arrays(d))
    n = max(2 * tiles.TASKS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = q.unionByName(d).repartition(n, "g", "b").sortWithinPartitions("g", "b", "doc", "by", "id")
    return tiles.best_of(met, k, digits, whole, False, True)


def best(found: DataFrame, k: int, copies: int) -> DataFrame:
    """(qid, doc_id, score, rank): the k best distinct documents of each query, dealt once; copies: of a document at most, so that Spark limits groups before the shuffle."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("doc_id"))
    some = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k * copies).drop("rank")
    once = some.dropDuplicates(["qid", "doc_id"])
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rounds(queries: DataFrame, directory_: DataFrame, rows: DataFrame, k: int, cut: int = 10, heap_factor: float = 1.0, selector: Selector | None = None, digits: int = 6, strata: Sequence[int] = ()) -> Iterator[tuple[DataFrame | None, DataFrame]]:
    """For the prefix and for every round: the k best before it (none before the prefix), and (qid, doc_id, score) of the documents it opens, of those in large blocks the k best of each tile.

    strata: numbers of lists at which a round ends; () opens all that the prefix's threshold leaves at once.
    """
    for top, found, _ in _rounds(queries, directory_, rows, k, cut, heap_factor, selector, digits, strata):
        yield top, found


def _rounds(queries: DataFrame, directory_: DataFrame, rows: DataFrame, k: int, cut: int, heap_factor: float, selector: Selector | None, digits: int, strata: Sequence[int]) -> Iterator[tuple[DataFrame | None, DataFrame, DataFrame]]:
    """The same, and (qid, term, cluster) of the blocks that each round opens."""
    check_k(k)
    asked = Asked(queries)
    if selector is not None:
        rows = selector.apply(rows)
        sizes = rows.groupBy("term", "cluster").agg(F.count("*").alias("size"))
        directory_ = directory_.drop("size").join(sizes, ["term", "cluster"])
    large = asked.local is None
    every, held = settled(visits(asked, queries, directory_, cut), large)

    folders = int(rows.schema["part"].metadata.get("folders", 0)) if "part" in rows.columns else 0

    if held is not None:
        most = pc.max(held.column("size")).as_py()
    else:
        most = directory_.agg(F.max("size")).first()[0]
    large_blocks = (most or 0) >= TILE_LEAST
    parts = 1 if asked.local is not None or not large_blocks else tiles.dealt(*tiles.measured(queries)[:2], k)[1]

    def opened(which: DataFrame, some: np.ndarray | None) -> DataFrame:
        of = rows
        which = which.select("qid", "term", "cluster", "size")
        if some is not None and folders and len(some):
            terms = np.unique(held.column("term").to_numpy()[some])
            of = rows.where(F.col("part").isin(sorted({int(t) % folders for t in terms})))
        few = which.where(F.col("size") < TILE_LEAST).drop("size")
        if held is not None:
            few = F.broadcast(few)  # no more than are held
        found = asked.scored(of.join(few, ["term", "cluster"]), "qid bigint, doc_id bigint", "terms", "weights", digits)
        if large_blocks:
            found = found.unionByName(tiled(which.where(F.col("size") >= TILE_LEAST), queries, of, k, digits, parts))
        return found

    before = held.column("before").to_numpy() if held is not None else None
    which = every.where(F.col("before") < k)
    found = opened(which, np.flatnonzero(before < k) if held is not None else None)
    top, last = None, 0
    yield top, found, which.select("qid", "term", "cluster")
    for end in [*strata, cut]:
        # a document is in one block of a list, and among the best so far
        now = best(found if top is None else top.unionByName(found), k, cut + 1).select("qid", "doc_id", "score", "rank")
        top, _ = settled(now, large)
        tau = top.where(F.col("rank") == k).select("qid", F.col("score").alias("tau"))
        top = top.drop("rank")
        here = every.where((F.col("before") >= k) & (F.col("list_no") >= last) & (F.col("list_no") < end)).join(tau, "qid", "left")
        here = here.where(F.col("tau").isNull() | (F.col("s") * heap_factor >= F.col("tau")))
        found = opened(here, np.flatnonzero(before >= k) if held is not None else None)
        yield top, found, here.select("qid", "term", "cluster")
        last = end


def with_folders(rows: DataFrame, folders: int) -> DataFrame:
    """Block rows that know how many folders they are in."""
    return rows.withMetadata("part", {"folders": folders})


def search(queries: DataFrame, directory_: DataFrame, rows: DataFrame, k: int, cut: int = 10, heap_factor: float = 1.0, selector: Selector | None = None, digits: int = 6, strata: Sequence[int] = ()) -> DataFrame:
    """(qid, rank, doc_id, score): the k best of the documents opened."""
    *_, (top, found) = rounds(queries, directory_, rows, k, cut, heap_factor, selector, digits, strata)
    return best(top.unionByName(found), k, cut + 1).select("qid", "rank", "doc_id", "score")


def evaluated(queries: DataFrame, directory_: DataFrame, rows: DataFrame, k: int, cut: int = 10, heap_factor: float = 1.0, strata: Sequence[int] = ()) -> DataFrame:
    """(qid, n_evaluated): documents whose vectors were scored, each once."""
    opened = [which for *_, which in _rounds(queries, directory_, rows, k, cut, heap_factor, None, 6, strata)]
    return documents(reduce(DataFrame.unionByName, opened), rows, ["term", "cluster"], "n_evaluated")


def documents(which: DataFrame, member: DataFrame, by: list[str], name: str) -> DataFrame:
    """(qid, name): number of distinct documents in each query's groups; `by` are a group's columns, and no group is given twice.

    Documents in one group only are counted by group; rows of query and document are made of the others alone.
    """
    of = member.select(*by, "doc_id").withColumn("lists", F.count("*").over(Window.partitionBy("doc_id")))
    lone = of.where(F.col("lists") == 1).groupBy(*by).agg(F.count("*").alias("n"))
    shared = which.join(of.where(F.col("lists") > 1), by).select("qid", "doc_id").distinct().groupBy("qid").agg(F.count("*").alias("n"))
    return which.join(lone, by).select("qid", "n").unionByName(shared).groupBy("qid").agg(F.sum("n").alias(name))


def work(queries: DataFrame, directory_: DataFrame, rows: DataFrame, k: int, cut: int = 10, heap_factor: float = 1.0) -> DataFrame:
    """(qid, n_candidates, n_evaluated): what `seismic.work` gives; documents are counted, and only the prefix is scored."""
    every = documents(cut_terms(queries, cut).select("qid", "term"), rows, ["term"], "n_candidates")
    return every.join(evaluated(queries, directory_, rows, k, cut, heap_factor), "qid").select("qid", "n_candidates", "n_evaluated")
