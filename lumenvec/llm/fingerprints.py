"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraphs.

A text's paragraphs are pieces of its lines, short ones at its start, cut at ends of sentences, so
an edit changes few of them. A sketch has three tables of cells; each paragraph's 64-bit digest goes into one
cell of each, and a cell holds a count and the XOR of digests and of check values. The fingerprint is
a text's smallest sketch, written out. Two versions' sketches are subtracted cell by cell; cells left with
a single digest are peeled until none is left, which recovers the digests that differ and whose they
are. Where that fails, the digests of both are dealt into parts by their hash, a sketch for each, and a
part that fails is built again with twice the cells until it can be peeled. Only DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenvec.llm._native import let, text
from lumenvec.llm.linking import cut

#: Characters of a text that are cut into short pieces.
START = 480
#: Pieces: so many characters, on to the end of the sentence, inside one line.
SHORT = r"[^\n]{1,40}(?:[^\n.!? ]*[.!?]*)"
LONG = r"[^\n]{1,160}(?:[^\n.!?]*[.!?]+|[^\n]*)"
#: Digests that a part is meant for, cells of each of a sketch's three tables at first, and how often they are doubled at most.
PART_ITEMS = 4
CELLS = 4
DOUBLINGS = 10
#: Rounds of peeling before a sketch counts as failed.
ROUNDS = 12
_FOUND = "array<struct<x: bigint, n: int>>"


def _pieces(value: Column, size: str) -> Column:
    return F.regexp_extract_all(value, F.lit(size), F.lit(0))


def _digests(value: Column) -> Column:
    """Distinct digests of a text's paragraphs."""
    rest = F.substring(value, F.lit(START + 1), F.greatest(F.length(value) - START, F.lit(0)))
    pieces = F.concat(_pieces(F.substring(value, 1, START), SHORT), F.when(F.length(value) > START, _pieces(rest, LONG)).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.transform(pieces, lambda x: F.xxhash64(x)))


def _check(x: Column) -> Column:
    return F.xxhash64(x, F.lit(-1)).bitwiseAND(F.lit(0xFFFFFFFF))


def _placed(x: Column, n: Column, cells: Column, salt: Column) -> Column:
    """A digest, its count, its check value and its cells, one in each of three tables that stand one after another."""
    at = lambda t: (F.pmod(F.xxhash64(x, salt, F.lit(t)), cells).cast("int") + t * cells).cast("int")
    return F.struct(x.alias("x"), n.cast("int").alias("n"), _check(x).alias("c"), at(0).alias("a"), at(1).alias("b"), at(2).alias("d"))


def _with(cell: Column, placed: Column, add: bool) -> Column:
    """The cell after these are put in or taken out."""
    put = lambda a, p: F.struct((a["n"] + p["n"] if add else a["n"] - p["n"]).alias("n"), a["x"].bitwiseXOR(p["x"]).alias("x"), a["c"].bitwiseXOR(p["c"]).alias("c"))
    return F.aggregate(placed, cell, put)


def sketch(digests: Column, cells: Column, salt: Column) -> Column:
    """Cells (n, x, c) of an array of digests: count, XOR of digests, XOR of check values."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("c"))
    placed = F.transform(digests, lambda x: _placed(x, F.lit(1), cells, salt))
    table = lambda ps, t, f: F.transform(F.sequence(t * cells, (t + 1) * cells - 1), lambda j: _with(zero, F.filter(ps, lambda p: p[f] == j), True))
    return let(placed, lambda ps: F.concat(*[table(ps, t, f) for t, f in enumerate("abd")]))


def subtract(one: Column, other: Column) -> Column:
    """What two sketches of the same size don't share, cell by cell: digests in both cancel out."""
    return F.zip_with(one, other, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["x"].bitwiseXOR(y["x"]).alias("x"), x["c"].bitwiseXOR(y["c"]).alias("c")))


def peel(difference: Column, cells: Column, salt: Column) -> Column:
    """The digests (x, n) of a difference, n 1 for those of the first version and -1 for those of the second; null if it can't be peeled empty."""
    pure = lambda c: (F.abs(c["n"]) == 1) & (c["c"] == _check(c["x"]))

    def one_round(state: Column, _: Column) -> Column:
        # a digest that is alone in several cells is taken out once
        found = F.array_distinct(F.transform(F.filter(state["t"], pure), lambda c: _placed(c["x"], c["n"], cells, salt)))
        mine = lambda gone, g: F.filter(gone, lambda p: (p["a"] == g) | (p["b"] == g) | (p["d"] == g))
        names = lambda gone: F.transform(gone, lambda p: F.struct(p["x"].alias("x"), p["n"].alias("n")))
        take = lambda gone: F.struct(F.when(F.size(gone) > 0, F.transform(state["t"], lambda c, g: _with(c, mine(gone, g), False))).otherwise(state["t"]).alias("t"), F.concat(state["k"], names(gone)).alias("k"), (F.size(gone) > 0).alias("on"))
        return F.when(state["on"], let(found, take)).otherwise(state)

    start = F.struct(difference.alias("t"), F.array().cast(_FOUND).alias("k"), F.lit(True).alias("on"))
    empty = lambda t: F.forall(t, lambda c: (c["n"] == 0) & (c["x"] == 0) & (c["c"] == 0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one_round, lambda s: F.when(empty(s["t"]), s["k"]))


def differing(one: Column, other: Column) -> Column:
    """The digests that two arrays don't share, as `peel` has them: sketches of both, subtracted and peeled; each failure doubles the cells.

    A sketch of 2048 cells a table for a part of some digests fails ten times over with no chance
    worth naming; the job would then fail rather than give a wrong result.
    """

    def attempt(found: Column, k: Column) -> Column:
        cells = (F.lit(CELLS) * F.pow(F.lit(2), k)).cast("int")
        return F.when(found.isNotNull(), found).otherwise(let(cells, lambda n: peel(subtract(sketch(one, n, k), sketch(other, n, k)), n, k)))

    got = F.aggregate(F.sequence(F.lit(0), F.lit(DOUBLINGS - 1)), F.lit(None).cast(_FOUND), attempt)
    return F.coalesce(got, F.raise_error(F.lit("a sketch could not be peeled")).cast(_FOUND))


def following(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id) for distinct non-null ids, after the last the first.

    Ids are dealt by ranges, whatever their values; neighbours inside a range are told by a window,
    and the last of a range is followed by the first of the next, of which there are as many as partitions.
    """
    dealt = cut(ids.select(F.col("doc_id").alias("id")).repartitionByRange("id").withColumn("p", F.spark_partition_id()))
    inside = dealt.withColumn("next", F.lead("id").over(Window.partitionBy("p").orderBy("id")))
    firsts = dealt.groupBy("p").agg(F.min("id").alias("first"))
    after = firsts.select("p", F.lead("first").over(Window.partitionBy(F.lit(0)).orderBy("first")).alias("after"), F.min("first").over(Window.partitionBy(F.lit(0))).alias("least"))
    return inside.join(F.broadcast(after), "p").select(F.col("id").alias("doc_id"), F.coalesce("next", "after", "least").alias("next_id"))


def _first_sketch(digests: str) -> Column:
    return sketch(F.col(digests), F.lit(CELLS), F.lit(0))


def _serial(digests: str, cells: str) -> Column:
    """A fingerprint: the number of paragraphs, then the cells of the smallest sketch in hexadecimal, count, digests and check values."""
    wide = lambda x, n: F.right(F.lpad(F.hex(x), F.lit(16), F.lit("0")), F.lit(n))
    cell = lambda c: F.concat(wide(c["n"].cast("bigint"), 4), wide(c["x"], 16), wide(c["c"], 8))
    return F.lower(F.concat(F.size(digests).cast("string"), F.lit(":"), F.array_join(F.transform(cells, cell), "")))


_NO_ID = -(1 << 63)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)).alias("k"), text().alias("text"))


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, removed, added) of every row of `docs`.

    removed and added: the digests of paragraphs that the edited text lacks and that it alone has, as
    recovered from the sketches. Likeness is 1 less the share of digests that differ in those of both.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the
    next document's text. A null or empty text has no paragraphs; two texts without paragraphs are
    alike (1). Of documents with the same id, the one whose text begins smallest is what the id
    before it is followed by, and all of them are followed by the same text. A row without an id is
    followed by the first document and follows none; a single document follows itself. Repeated rows
    give a row each; an empty table gives none. Long texts have more parts, not larger ones. Other
    columns, whatever they are called, aren't looked at.
    """
    rows = _texts(docs)
    ids = rows.select("k").where(F.col("k") != _NO_ID).distinct().withColumnRenamed("k", "doc_id")
    follow = following(ids)
    first = ids.agg(F.min("doc_id").alias("next_id"))
    follow = follow.unionByName(first.select(F.lit(_NO_ID).cast("bigint").alias("doc_id"), "next_id").where("next_id is not null"))
    need = rows.groupBy("k").agg(F.max(F.floor(F.length("text") / 2)).cast("int").alias("need"))
    follow = follow.join(need, follow["doc_id"] == need["k"]).select(F.col("doc_id").alias("to"), F.col("next_id").alias("k"), "need")
    # only as much of the next text as the edit needs travels, and its paragraphs' digests
    heads = rows.join(follow, "k").select("to", F.struct(F.substring("text", F.lit(1), F.col("need")).alias("head"), _digests(F.col("text")).alias("digests")).alias("next"))
    heads = heads.groupBy("to").agg(F.min("next").alias("next"))
    both = rows.join(heads, rows["k"] == heads["to"], "left").withColumn("n_chars", F.length("text").cast("bigint"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.coalesce("next.head", F.lit("")), F.lit(1), half))
    both = both.withColumn("edited", edited).withColumn("row", F.monotonically_increasing_id())
    both = both.select("k", "row", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), _digests(F.col("text")).alias("own"), _digests(F.col("edited")).alias("other"), F.coalesce("next.digests", F.array().cast("array<bigint>")).alias("following"))
    both = both.select("*", *[_first_sketch(c).alias(f"{c}_sketch") for c in ("own", "other", "following")])
    # the fingerprints themselves are compared first
    small = lambda c: peel(subtract(F.col("own_sketch"), F.col(f"{c}_sketch")), F.lit(CELLS), F.lit(0))
    both = both.select("*", small("other").alias("found0"), small("following").alias("found1"))
    own_row = F.struct("n_chars", "edited_sha256", _serial("own", "own_sketch").alias("fingerprint"), _serial("other", "other_sketch").alias("edited_fingerprint"), (F.size("own") + F.size("other")).alias("sum0"), (F.size("own") + F.size("following")).alias("sum1"), "found0", F.size("found1").alias("differ1"))
    # what they can't tell goes into parts that don't grow with the text; a row's own results travel beside those
    def entries(pair: int, other: str) -> Column:
        parts = F.greatest(F.lit(1), F.ceil((F.size("own") + F.size(other)) / PART_ITEMS)).cast("bigint")
        sides = [F.transform(side, lambda x: F.struct(F.lit(pair).alias("pair"), F.pmod(F.xxhash64(x, F.lit(-2)), parts).alias("part"), x.alias("x"), F.lit(sign).alias("sign"))) for side, sign in (("own", 1), (other, -1))]
        return F.when(F.col(f"found{pair}").isNull(), F.concat(*sides)).otherwise(F.array().cast("array<struct<pair: int, part: bigint, x: bigint, sign: int>>"))

    head = F.array(F.struct(F.lit(2).alias("pair"), F.lit(0).cast("bigint").alias("part"), F.lit(0).cast("bigint").alias("x"), F.lit(0).alias("sign")))
    items = both.select("k", "row", own_row.alias("own_row"), F.explode(F.concat(head, entries(0, "other"), entries(1, "following"))).alias("e"))
    mine = F.col("e.pair") == 2
    items = items.select("k", "row", "e.pair", "e.part", F.when(~mine, F.struct("e.x", "e.sign")).alias("item"), F.when(mine, F.col("own_row")).alias("own_row"))
    parts = items.groupBy("k", "row", "pair", "part").agg(F.collect_list("item").alias("items"), F.first("own_row", True).alias("own_row"))
    side = lambda s: F.transform(F.filter("items", lambda x: x["sign"] == s), lambda x: x["x"])
    parts = parts.withColumn("found", F.when(F.col("pair") < 2, differing(side(1), side(-1))))
    total = parts.groupBy("k", "row").agg(
        F.first("own_row", True).alias("r"), F.flatten(F.collect_list(F.when(F.col("pair") == 0, F.col("found")))).alias("found0"), F.sum(F.when(F.col("pair") == 1, F.size("found"))).alias("differ1")
    )
    total = total.withColumn("found", F.coalesce("r.found0", "found0"))
    near = lambda differ, whole: F.when(whole > 0, 1.0 - differ / whole).otherwise(1.0)
    whose = lambda n: F.array_sort(F.transform(F.filter("found", lambda x: x["n"] == n), lambda x: x["x"]))
    return total.select(
        F.when(F.col("k") != _NO_ID, F.col("k")).alias("doc_id"), "r.n_chars", "r.edited_sha256", "r.fingerprint", "r.edited_fingerprint",
        near(F.size("found"), F.col("r.sum0")).alias("near_edited"), near(F.when(F.col("r.differ1") >= 0, F.col("r.differ1")).otherwise(F.col("differ1")), F.col("r.sum1")).alias("near_next"),
        whose(1).alias("removed"), whose(-1).alias("added"),
    )
