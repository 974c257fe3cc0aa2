"""Ranks of rows by a composite key: a least-significant-digit radix sort whose passes are Spark jobs.

Rows stand in blocks. A pass counts each block's digits, adds the counts up into offsets (those of
all smaller digits, then those of the same digit in earlier blocks), and moves every row to its
offset; equal digits keep their order. After the pass over the highest digit a row's place is its rank.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenvec.llm.linking import cut

#: Bits of a digit: a pass has at most 8,192 counters a block.
DIGIT_BITS = 13
#: Rows of a block at least, and blocks at most.
LEAST_BLOCK, MOST_BLOCKS = 4096, 4096
#: Bits of one word of the key; wider keys are several words.
WORD_BITS = 62


@dataclass(frozen=True)
class Limb:
    """A non-negative part of the key."""

    value: Column
    bits: int


def _limbs(name: str, low: int, high: int, descending: bool) -> list[Limb]:
    """A bigint column with these bounds as parts, the least significant first."""
    c = F.col(name)
    if (high - low).bit_length() <= WORD_BITS:
        return [Limb(F.lit(high) - c if descending else c - F.lit(low), (high - low).bit_length())]
    # too wide to be shifted to 0 in 64 bits: the upper half is signed, the lower isn't
    upper, lower = F.shiftright(c, 32), c.bitwiseAND(F.lit(0xFFFFFFFF))
    top, bottom = high >> 32, low >> 32
    return [Limb(F.lit(0xFFFFFFFF) - lower if descending else lower, 32), Limb(F.lit(top) - upper if descending else upper - F.lit(bottom), (top - bottom).bit_length())]


def _packed(limbs: list[Limb]) -> list[Limb]:
    """Neighbouring parts that fit one word together become one."""
    out: list[Limb] = []
    for x in limbs:
        if out and out[-1].bits + x.bits <= WORD_BITS:
            out[-1] = Limb(out[-1].value.bitwiseOR(F.shiftleft(x.value, out[-1].bits)), out[-1].bits + x.bits)
        else:
            out.append(x)
    return out


def digits(keys: list[tuple[str, int, int, bool]]) -> list[Column]:
    """The key's digits, the least significant first; keys: (bigint column, smallest, largest, descending), the most significant first."""
    out = []
    for word in _packed([x for key in reversed(keys) for x in _limbs(*key)]):
        n = -(-word.bits // DIGIT_BITS)
        size = -(-word.bits // n) if n else 0
        out += [F.shiftrightunsigned(word.value, size * k).bitwiseAND(F.lit((1 << size) - 1)).cast("int") for k in range(n)]
    return out


def _placed(rows: pa.Table, offsets: pa.Table) -> pa.Table:
    """The rows of one block with their new places: a counting sort by digit that keeps the order of `place`."""
    rows = rows.sort_by("place")
    digit = rows.column("digit").to_numpy()
    order = np.argsort(digit, kind="stable")
    first = np.zeros(len(order), np.int64)
    new = np.flatnonzero(np.diff(digit[order])) + 1
    first[new] = new
    at = np.zeros(int(digit.max()) + 1, np.int64)
    at[offsets.column("d").to_numpy()] = offsets.column("offset").to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = at[digit[order]] + np.arange(len(order)) - np.maximum.accumulate(first)
    return rows.set_column(rows.schema.get_field_index("place"), "place", pa.array(place)).drop_columns(["block", "digit"])


def ranked(rows: DataFrame, keys: list[tuple[str, bool]]) -> DataFrame:
    """The rows with `rank`, 1, 2, 3, ..., by bigint columns without nulls: (name, whether it descends), the most significant first.

    Rows that agree in all keys have ranks in some order. `rows` is read several times, so write it
    first. No rows give none; the names `place`, `block` and `digit` are taken.
    """
    names = [name for name, _ in keys]
    bounds = rows.agg(F.count("*").alias("n"), *[f(c).alias(f"{c}{k}") for c in names for k, f in enumerate((F.min, F.max))]).first()
    n = bounds["n"]
    if not n:
        return rows.select("*", F.lit(None).cast("bigint").alias("rank"))
    every = digits([(c, bounds[f"{c}0"], bounds[f"{c}1"], down) for c, down in keys])
    size = max(LEAST_BLOCK, -(-n // MOST_BLOCKS))
    # the first places are those of the written rows: their partition, and their number in it
    here = rows.withColumn("place", F.monotonically_increasing_id())
    here = cut(here.withColumn("block", F.shiftright("place", 33)))
    for digit in every:
        now = here.withColumn("digit", digit)
        counts = now.groupBy(F.col("block").alias("of"), F.col("digit").alias("d")).agg(F.count("*").alias("n"))
        total = sorted(map(tuple, counts.groupBy("d").agg(F.sum("n")).collect()))  # a row a digit: 8,192 at most
        smaller = np.cumsum([0] + [k for _, k in total]).tolist()
        base = rows.sparkSession.createDataFrame([(d, s) for (d, _), s in zip(total, smaller)], "d int, base bigint")
        earlier = F.sum("n").over(Window.partitionBy("d").orderBy("of").rowsBetween(Window.unboundedPreceding, -1))
        offsets = counts.withColumn("earlier", F.coalesce(earlier, F.lit(0))).join(F.broadcast(base), "d").select("of", "d", (F.col("base") + F.col("earlier")).alias("offset"))
        schema = here.drop("block").schema
        here = now.groupBy("block").cogroup(offsets.groupBy("of")).applyInArrow(_placed, schema)
        here = cut(here.withColumn("block", F.expr(f"place div {size}")))
    return here.withColumn("rank", F.col("place") + 1 if every else F.row_number().over(Window.orderBy("place")).cast("bigint")).drop("place", "block")
