"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key, divided by its quality weight. A source first gives whole
epochs of all its documents, then, in the order of the keys, documents until its budget of words is
full; the last one gives only the words that are missing. The running sum over a source is taken in
two steps, over ranges of keys and inside each range, so no source is in one task. Only DataFrame
functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenvec.llm._native import quoted, text, without

#: Weights of the sources in order, repeating; the mix's size over that of all documents; most epochs.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
SEED = 17
#: Ranges of keys of one source.
RANGES = 4096
_SYMBOLS = "#*$%&|<>"


def _words(value: Column) -> Column:
    return F.regexp_count(value, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def quality(value: Column) -> Column:
    """A weight from 0.1 to 1: less the more of the text is symbols."""
    n = F.length(value)
    return F.greatest(F.lit(0.1), 1.0 - 8.0 * (n - F.length(without(value, _SYMBOLS))) / F.greatest(n, F.lit(1)))


def _keys(docs: DataFrame, extra: list[Column], seed: int) -> DataFrame:
    """(doc_id, source, size, key) and what else is asked for."""
    digits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("bigint")
    uniform = (digits + 0.5) / float(1 << 52)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), _words(text()).alias("size"), (-F.ln(uniform) / quality(text())).alias("key"), *extra)


def key_range(key: Column) -> Column:
    """The range of a key: half of a range's width goes by keys of weight 1, half by those of weight 0.1, so for any weight between none holds over thrice its share."""
    level = (2 - F.exp(-key) - F.exp(-key / 10.0)) / 2
    return F.least(F.lit(RANGES - 1), F.floor(level * RANGES)).cast("int")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), a row for each source.

    Sources capped at `most` times their size are those whose cap is below their share at the water
    level that the others reach; sorted by cap for each weight, the level before each source tells.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("cap", most * F.col("source_size").cast("double"))
    ratio = F.col("cap") / F.col("weight")
    order = Window.orderBy(ratio, F.asc_nulls_last("source"))
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (share * F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", level).withColumn("capped", ratio <= F.col("level"))
    final = F.min(F.when(~F.col("capped"), F.struct(ratio.alias("r"), F.col("level").alias("level")))).over(every)["level"]
    return s.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * final)).select("source", "source_size", "target")


def _mixed(docs: DataFrame, extra: list[Column], seed: int) -> DataFrame:
    rows = _keys(docs, extra, seed)
    # no document is in one task with all others of its source: first by ranges of its key
    part = key_range(F.col("key"))
    rows = rows.withColumn("part", part)
    parts = _keys(docs, [], seed).withColumn("part", part).groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    goals = targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("part_before", F.coalesce(F.sum("part_size").over(ahead), F.lit(0)))
    parts = parts.join(goals, parts["source"].eqNullSafe(goals["source"])).select(parts["source"], "part", "part_before", "source_size", "target")
    rows = rows.alias("r").join(parts.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.part") == F.col("p.part"))).select("r.*", "part_before", "source_size", "target")
    within = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("part_before") + F.coalesce(F.sum("size").over(within), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rows = rows.withColumn("epochs", epochs.cast("bigint"))
    left = F.round(F.col("target")).cast("bigint") - F.col("epochs") * F.col("source_size")
    rows = rows.withColumn("fraction", F.greatest(F.lit(0), F.least(F.col("size"), left - before)).cast("bigint"))
    return rows.withColumn("taken", F.col("epochs") * F.col("size") + F.col("fraction"))


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of `docs`.

    A null text and an empty one have no words and are never taken; a null source is a source of its
    own, last in order; sources without words have target 0. Repeated rows are sampled each, ties of
    keys go by id, then size. A null id draws one fixed number.
    """
    return _mixed(docs, [], seed).select("doc_id", "size", "source_size", "target", "taken")


def sample(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of `docs` as often as the mix takes it, the last of a source cut to the words taken."""
    mine = docs.columns
    rows = _mixed(docs, [F.struct(*map(quoted, mine)).alias("row")], seed)
    whole = F.col("fraction") == F.col("size")
    copies = F.col("epochs").cast("int") + F.when(F.col("fraction") > 0, 1).otherwise(0)
    rows = rows.where((copies > 0) & (F.col("size") > 0)).withColumn("nth", F.explode(F.sequence(F.lit(1), copies)))
    # a word with the separators before it is one piece
    cut = F.array_join(F.slice(F.split("row.text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), F.greatest(F.col("fraction").cast("int"), F.lit(1))), "")
    rows = rows.withColumn("piece", F.when((F.col("nth") > F.col("epochs")) & ~whole, cut).otherwise(F.col("row.text")))
    out = {"text": F.col("piece"), "n_chars": F.length("piece").cast("bigint")}
    return rows.select(*[out[c].alias(c) if c in out else F.col("row")[c].alias(c) for c in mine])
