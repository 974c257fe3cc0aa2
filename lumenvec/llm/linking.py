"""Connected components of links between documents, by DataFrame joins.

Links are replaced, round by round, by links to the smallest neighbour (large-star and small-star
steps); after a number of rounds that grows with the logarithm of the longest chain, every node is
linked to the smallest node of its component. Each round is cut off by a checkpoint in the folder
all executors share. Nothing but a count and a checksum comes to the driver.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cut(frame: DataFrame) -> DataFrame:
    """The same rows, written to the checkpoint folder; sets a folder only where none is set, as in tests."""
    set_folder(frame.sparkSession)
    return frame.checkpoint()


def set_folder(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or os.path.join(tempfile.gettempdir(), "lumenvec-checkpoints"))


def _large(links: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to the smallest of it and its neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(links: DataFrame) -> DataFrame:
    """Every node's smaller neighbours and itself are linked to the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component_id) of every node that has a link to another; links: (u, v). component_id is the component's smallest node, and nodes that are that themselves are left out."""
    links = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    sign = F.struct(F.count("*"), F.coalesce(F.sum(F.hash("u", "v").cast("bigint")), F.lit(0)))
    before = tuple(links.agg(sign.alias("s")).first()["s"])
    while before[0]:
        links = cut(_small(_large(links)))
        now = tuple(links.agg(sign.alias("s")).first()["s"])
        if now == before:
            break
        before = now
    return links.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component_id"))
