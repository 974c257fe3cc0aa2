"""Tables written between the steps of a plan, and small ones held on the driver."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that is planned with on the driver and sent to every task: 64 bytes each at most, 8 MB.
LOCAL_ROWS = 1 << 17


def folder(spark: SparkSession) -> str:
    """A new folder that all executors share: in the checkpoint folder, or a temporary one where none is set, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or os.path.join(tempfile.gettempdir(), "lumenvec")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(spark: SparkSession, to: str, parts: dict[str, str] | None = None, **tables: DataFrame) -> list[DataFrame]:
    """The tables, written and read again, so that each is worked out once, survives lost executors, and has a size that Spark knows; parts: table to partition column."""
    for name, table in tables.items():
        out = table.write
        (out.partitionBy(parts[name]) if parts and name in parts else out).parquet(f"{to}/{name}")
    return [spark.read.parquet(f"{to}/{name}") for name in tables]


def settled(frame: DataFrame, large: bool = False) -> tuple[DataFrame, pa.Table | None]:
    """The rows, of 64 bytes at most, as a table that is broadcast, with its rows, if they are few; else persisted as they are, and None. large: they aren't few, and are worked out once and written."""
    if large:
        return written(frame.sparkSession, folder(frame.sparkSession), rows=frame)[0], None
    some = frame.limit(LOCAL_ROWS + 1).toArrow()
    if some.num_rows <= LOCAL_ROWS:
        return F.broadcast(frame.sparkSession.createDataFrame(some)), some
    return frame.persist(StorageLevel.DISK_ONLY), None
