"""Files of compressed sparse rows, as a Spark data source in two layouts, for reading and for writing.

interchange: int64 rows, cols, nnz; int64 row offsets; int32 terms; float32 weights.
native: the same header; int32 row offsets; uint16 terms; padding to 4 bytes; float32 weights.
Reading is split by rows, each task seeking to its own part of the file, so a file is never in one task.
A path that only Spark can open (one with a scheme other than file) is read through Hadoop's input formats,
in records of equal length. Writing deals rows by ranges; from the ranges' numbers of entries each task
knows where its parts of the file are, and writes them there.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from lumenvec.model import VECTORS

HEADER = 24
NATIVE_SUFFIX = ".mcsr"
#: Entries of one reading task.
PART_ENTRIES = 4 << 20


def native_path(path: str) -> str:
    return path + NATIVE_SUFFIX


def interchange_size(rows: int, nnz: int) -> int:
    return HEADER + 8 * (rows + 1) + 8 * nnz


def native_values_offset(rows: int, nnz: int) -> int:
    at = HEADER + 4 * (rows + 1) + 2 * nnz
    return at + -at % 4


def native_size(rows: int, nnz: int) -> int:
    return native_values_offset(rows, nnz) + 4 * nnz


def plain_path(path: str) -> str | None:
    """The path as this machine opens it; None for one that only Spark can open."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return None if "://" in path else path


class Layout:
    """Where things are in a file, after its header has been checked."""

    def __init__(self, path: str, layout: str, dimension: int | None):
        self.path = plain_path(path)
        if self.path is None or not os.path.isfile(self.path):
            raise ValueError(f"no such file: {path}")
        self.check(layout, dimension, os.path.getsize(self.path), self._read(0, np.uint8, HEADER).tobytes())
        first, last = self.offsets(0, 1)[0], self.offsets(self.rows, self.rows + 1)[0]
        if first != 0 or last != self.nnz:
            raise ValueError("bad row offsets")

    def check(self, layout: str, dimension: int | None, size: int, head: bytes) -> None:
        if layout not in ("interchange", "native"):
            raise ValueError("layout must be interchange or native")
        self.native = layout == "native"
        if len(head) < HEADER:
            raise ValueError("truncated header")
        self.rows, self.cols, self.nnz = struct.unpack("<qqq", head)
        if self.rows <= 0 or self.cols <= 0 or self.nnz < 0 or max(self.rows, self.nnz) >= 1 << 31:
            raise ValueError("bad header")
        if dimension is not None and self.cols > dimension:
            raise ValueError("more columns than the dimension")
        if size != (native_size if self.native else interchange_size)(self.rows, self.nnz):
            raise ValueError("file size doesn't match its header")

    def sections(self) -> list[tuple[int, str, int]]:
        """(where it begins, numbers' type, how many) of row offsets, terms and weights."""
        n, m = self.rows + 1, self.nnz
        if self.native:
            return [(HEADER, "<i4", n), (HEADER + 4 * n, "<u2", m), (native_values_offset(self.rows, m), "<f4", m)]
        return [(HEADER, "<i8", n), (HEADER + 8 * n, "<i4", m), (HEADER + 8 * n + 4 * m, "<f4", m)]

    def _read(self, at: int, kind, n: int) -> np.ndarray:
        with open(self.path, "rb") as f:
            f.seek(at)
            return np.frombuffer(f.read(n * np.dtype(kind).itemsize), kind)

    def offsets(self, lo: int, hi: int) -> np.ndarray:
        return self._read(HEADER + (4 if self.native else 8) * lo, "<i4" if self.native else "<i8", hi - lo).astype(np.int64)

    def entries(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        if self.native:
            at = HEADER + 4 * (self.rows + 1)
            return self._read(at + 2 * lo, "<u2", hi - lo), self._read(native_values_offset(self.rows, self.nnz) + 4 * lo, "<f4", hi - lo)
        at = HEADER + 8 * (self.rows + 1)
        return self._read(at + 4 * lo, "<i4", hi - lo), self._read(at + 4 * self.nnz + 4 * lo, "<f4", hi - lo)


class _Part(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class CsrReader(DataSourceReader):
    def __init__(self, options):
        self.args = (options["path"], options.get("layout", "interchange"), int(options["dimension"]) if "dimension" in options else None)

    def partitions(self):
        file = Layout(*self.args)
        step = max(1, int(file.rows * PART_ENTRIES / max(file.nnz, 1)))
        return [_Part(lo, min(lo + step, file.rows)) for lo in range(0, file.rows, step)]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        file = Layout(*self.args)
        offsets = file.offsets(part.lo, part.hi + 1)
        size = np.diff(offsets)
        if (size < 0).any():
            raise ValueError("row offsets must not fall")
        term, weight = file.entries(int(offsets[0]), int(offsets[-1]))
        if len(term) and (term.min() < 0 or term.max() >= (self.args[2] or file.cols)):
            raise ValueError("term_id out of range")
        row = np.repeat(np.arange(part.lo, part.hi, dtype=np.int32), size)
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(term.astype(np.int32)), pa.array(weight)], ["doc_id", "term", "weight"])


class CsrSource(DataSource):
    """spark.read.format("csr_sparse").option("path", ...).option("layout", ...).option("dimension", ...)."""

    @classmethod
    def name(cls):
        return "csr_sparse"

    def schema(self):
        return VECTORS

    def reader(self, schema):
        return CsrReader(self.options)

    def writer(self, schema, overwrite):
        return CsrWriter(self.options)


class CsrWriter(DataSourceWriter):
    """Writes parts (at, bytes) of one file in their places; the file has its name once all are written, so a task that is run again writes the same."""

    def __init__(self, options):
        self.to, self.size = options["path"], int(options["size"])
        self.temporary = f"{self.to}.{options['name']}"

    def write(self, iterator):
        # the file is there before any task, so one that comes after the rest were aborted makes none
        with open(self.temporary, "r+b") as f:
            for row in iterator:
                f.seek(row["at"])
                f.write(row["bytes"])
            f.flush()
            os.fsync(f.fileno())
        return WriterCommitMessage()

    def commit(self, messages):
        if os.path.getsize(self.temporary) != self.size:
            raise ValueError("parts are missing")
        os.replace(self.temporary, self.to)

    def abort(self, messages):
        if os.path.exists(self.temporary):
            os.remove(self.temporary)


def layout_of(spark: SparkSession, path: str, layout: str = "interchange", dimension: int | None = None) -> Layout:
    """The checked layout of a file on any path that Spark or this machine opens."""
    return remote_layout(spark, path, layout, dimension) if plain_path(path) is None else Layout(path, layout, dimension)


def read_csr(spark: SparkSession, path: str, layout: str = "interchange", dimension: int | None = None) -> DataFrame:
    """Triples of a file; bad headers, sizes, offsets and columns fail here, terms out of range in the job that reads them."""
    if plain_path(path) is None:
        return _read_by_spark(spark, path, layout, dimension)
    Layout(path, layout, dimension)
    spark.dataSource.register(CsrSource)
    reader = spark.read.format("csr_sparse").option("path", path).option("layout", layout)
    return (reader.option("dimension", str(dimension)) if dimension else reader).load()


def write_csr(path: str, indptr, indices, values, cols: int, layout: str = "interchange") -> None:
    """A file from arrays of compressed sparse rows."""
    indptr, indices, values = np.asarray(indptr, np.int64), np.asarray(indices, np.int64), np.asarray(values, "<f4")
    native = layout == "native"
    if len(indices) and (indices.min() < 0 or indices.max() >= min(cols, 1 << 16 if native else cols)):
        raise ValueError("term_id out of range")
    with open(path, "wb") as f:
        f.write(struct.pack("<qqq", len(indptr) - 1, cols, len(indices)))
        f.write(indptr.astype("<i4" if native else "<i8").tobytes())
        f.write(indices.astype("<u2" if native else "<i4").tobytes())
        f.write(b"\0" * (-f.tell() % 4))
        f.write(values.tobytes())


def convert(path: str, to: str | None = None, step: int = 1 << 16) -> str:
    """An interchange file as a native one, a bounded number of entries at a time; returns the new path."""
    file, to = Layout(path, "interchange", 1 << 16), to or native_path(path)
    with open(to, "wb") as f:
        f.write(struct.pack("<qqq", file.rows, file.cols, file.nnz))
        for lo in range(0, file.rows + 1, step):
            f.write(file.offsets(lo, min(lo + step, file.rows + 1)).astype("<i4").tobytes())
        for k, kind in ((0, "<u2"), (1, "<f4")):
            if k:
                f.write(b"\0" * (-f.tell() % 4))
            for lo in range(0, file.nnz, step):
                x = file.entries(lo, min(lo + step, file.nnz))[k]
                if not k and len(x) and (x.min() < 0 or x.max() >= file.cols):
                    raise ValueError("term_id out of range")
                f.write(x.astype(kind).tobytes())
    return to


#: Bytes of a record that Hadoop's formats read at a time, at most; entries of a group that is put together again.
RECORD_BYTES, GROUP_ENTRIES = 1 << 20, 1 << 16


def remote_layout(spark: SparkSession, path: str, layout: str, dimension: int | None) -> Layout:
    """The layout of a file that only Spark can open, by its first bytes; row offsets are checked in the job that reads them."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise ValueError(f"no such file: {path}")
    size = fs.getFileStatus(at).getLen()
    stream = fs.open(at)
    try:
        head = bytes(x & 0xFF for x in (stream.read() for _ in range(min(HEADER, size))))
    finally:
        stream.close()
    out = Layout.__new__(Layout)
    out.path = path
    out.check(layout, dimension, size, head)
    return out


def _read_by_spark(spark: SparkSession, path: str, layout: str, dimension: int | None) -> DataFrame:
    """Triples of a file in records of equal length, each with its number, that Hadoop's input format deals to tasks.

    A record's bytes go to groups of GROUP_ENTRIES entries, and so do the offsets of the rows that have entries in
    a group; a group has a bounded size, whatever the lengths of rows.
    """
    file = remote_layout(spark, path, layout, dimension)
    sections = file.sections()
    end = native_size(file.rows, file.nnz) if file.native else interchange_size(file.rows, file.nnz)
    length = max(d for d in range(1, min(RECORD_BYTES, end) + 1) if end % d == 0)
    most, nnz, rows = dimension or file.cols, file.nnz, file.rows

    def cut(record: tuple) -> Iterator[tuple]:
        """(group, section, number of its first value, bytes) of a record; numbers that two records share are sent in parts."""
        begin, raw = record[0] * length, bytes(record[1])
        for k, (at, kind, n) in enumerate(sections):
            size = np.dtype(kind).itemsize
            lo, hi = max(begin, at), min(begin + len(raw), at + size * n)
            step = GROUP_ENTRIES * size
            while lo < hi:
                group = (lo - at) // step
                stop = min(hi, at + (group + 1) * step)
                yield group, k, lo - at - group * step, raw[lo - begin : stop - begin]
                lo = stop

    records = spark.sparkContext.newAPIHadoopFile(path, "org.apache.spark.input.FixedLengthBinaryInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf={"org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(length)})
    parts = spark.createDataFrame(records.flatMap(cut), "group long, section int, at long, bytes binary")

    def whole(table: pa.Table) -> bytes:
        order = np.argsort(table.column("at").to_numpy())
        raw = table.column("bytes").to_pylist()
        return b"".join(raw[k] for k in order)

    def offsets(key: tuple, table: pa.Table) -> pa.Table:
        """(group of entries, row, from, to) of the rows of one group of offsets; the next group's first offset comes with it."""
        base = key[0].as_py() * GROUP_ENTRIES
        x = np.frombuffer(whole(table), sections[0][1]).astype(np.int64)
        first = base + np.arange(len(x) - 1)
        if (np.diff(x) < 0).any() or x[0] < 0 or x[-1] > nnz or (base == 0 and x[0] != 0) or (base + len(x) - 1 == rows and x[-1] != nnz):
            raise ValueError("bad row offsets")
        has = x[1:] > x[:-1]
        first, lo, hi = first[has], x[:-1][has], x[1:][has]
        n = (hi - 1) // GROUP_ENTRIES - lo // GROUP_ENTRIES + 1
        group = np.repeat(lo // GROUP_ENTRIES, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        lo, hi = np.repeat(lo, n), np.repeat(hi, n)
        return pa.table({"group": group, "row": np.repeat(first, n), "lo": np.maximum(lo, group * GROUP_ENTRIES), "hi": np.minimum(hi, (group + 1) * GROUP_ENTRIES)})

    # a group of offsets ends with the first of the next one
    width = np.dtype(sections[0][1]).itemsize
    own = parts.where("section = 0")
    heads = own.where((F.col("at") < width) & (F.col("group") > 0)).select((F.col("group") - 1).alias("group"), "section", (F.col("at") + GROUP_ENTRIES * width).alias("at"), F.expr(f"substring(bytes, 1, cast({width} - at as int))").alias("bytes"))
    of_rows = own.unionByName(heads).groupBy("group").applyInArrow(offsets, "group long, row long, lo long, hi long")

    def entries(key: tuple, table: pa.Table, of: pa.Table) -> pa.Table:
        base = key[0].as_py() * GROUP_ENTRIES
        term, weight = (np.frombuffer(whole(table.filter(pa.compute.equal(table["section"], k))), sections[k][1]) for k in (1, 2))
        if len(term) and (term.min() < 0 or term.max() >= most):
            raise ValueError("term_id out of range")
        row, lo, hi = (of.column(c).to_numpy() for c in ("row", "lo", "hi"))
        order = np.argsort(lo)
        row, lo, hi = row[order], lo[order], hi[order]
        at = np.arange(lo[0], hi[-1]) - base if len(lo) else np.zeros(0, np.int64)
        return pa.table({"doc_id": np.repeat(row, hi - lo).astype(np.int32), "term": term[at].astype(np.int32), "weight": weight[at]})

    return parts.where("section > 0").groupBy("group").cogroup(of_rows.groupBy("group")).applyInArrow(entries, VECTORS)


#: Entries of a range of rows that one task writes, about.
RANGE_ENTRIES = 4 << 20


def write_csr_frame(vectors: DataFrame, path: str, rows: int, cols: int, layout: str = "interchange") -> None:
    """One file of triples (doc_id from 0 to rows - 1, term, weight), written by all tasks at once; the path must be on storage that all executors mount.

    Ranges of rows are counted first; the sums of the counts before a range say where its offsets, terms
    and weights stand. Terms out of range, ids out of range and repeated terms of a row fail.
    """
    to = plain_path(path)
    if to is None:
        raise ValueError("files are written to storage that is mounted")
    if not 0 < rows < 1 << 31 or not 0 < cols <= (1 << 16 if layout == "native" else 1 << 31):
        raise ValueError("bad header")
    spark, native = vectors.sparkSession, layout == "native"
    spark.dataSource.register(CsrSource)
    nnz = vectors.count()
    step = max(1, rows * RANGE_ENTRIES // max(nnz, 1))
    ranges = -(-rows // step)
    dealt = vectors.select(F.expr(f"cast(doc_id div {step} as int)").alias("range"), F.col("doc_id").cast("int"), F.col("term").cast("int"), F.col("weight").cast("float"))
    counts = np.zeros(ranges, np.int64)
    for k, n in dealt.groupBy("range").count().collect():  # a row for every RANGE_ENTRIES entries
        if not 0 <= k < ranges:
            raise ValueError("doc_id out of range")
        counts[k] = n
    before = np.concatenate([[0], np.cumsum(counts)])
    file = Layout.__new__(Layout)
    file.rows, file.cols, file.nnz, file.native = rows, cols, int(before[-1]), native
    at, kinds = [x[0] for x in file.sections()], [x[1] for x in file.sections()]
    header = struct.pack("<qqq", rows, cols, file.nnz)
    size = (native_size if native else interchange_size)(rows, file.nnz)
    pad = at[2] - (at[1] + np.dtype(kinds[1]).itemsize * file.nnz)

    def part(key: tuple, own: pa.Table, none: pa.Table) -> pa.Table:
        k = key[0].as_py()
        doc, term, weight = (own.column(c).to_numpy() for c in ("doc_id", "term", "weight"))
        lo, hi = k * step, min((k + 1) * step, rows)
        if len(term) and (term.min() < 0 or term.max() >= cols or doc.min() < lo or doc.max() >= hi):
            raise ValueError("term_id or doc_id out of range")
        order = np.lexsort((term, doc))
        doc, term, weight = doc[order], term[order], weight[order]
        if ((doc[1:] == doc[:-1]) & (term[1:] == term[:-1])).any():
            raise ValueError("a row has a term twice")
        ends = before[k] + np.searchsorted(doc, np.arange(lo, hi), side="right")
        values = [(at[0] + np.dtype(kinds[0]).itemsize * (lo + 1), ends, kinds[0]), (at[1] + np.dtype(kinds[1]).itemsize * before[k], term, kinds[1]), (at[2] + 4 * before[k], weight, kinds[2])]
        places, raw = [int(a) for a, _, _ in values], [np.asarray(x).astype(kind).tobytes() for _, x, kind in values]
        if k == 0:
            places, raw = [*places, 0, at[2] - pad], [*raw, header + np.zeros(1, kinds[0]).tobytes(), bytes(pad)]
        return pa.table({"at": pa.array(places, pa.int64()), "bytes": pa.array(raw, pa.binary())})

    # every range is written, those without entries too
    every = spark.range(ranges).select(F.col("id").cast("int").alias("range"))
    parts = dealt.groupBy("range").cogroup(every.groupBy("range")).applyInArrow(part, "at long, bytes binary")
    os.makedirs(os.path.dirname(to) or ".", exist_ok=True)
    name = uuid.uuid4().hex
    open(f"{to}.{name}", "xb").close()
    try:
        parts.write.format("csr_sparse").option("path", to).option("size", str(size)).option("name", name).mode("append").save()
    finally:
        if os.path.exists(f"{to}.{name}"):
            os.remove(f"{to}.{name}")


def convert_frame(spark: SparkSession, path: str, to: str | None = None) -> str:
    """An interchange file, on any path that Spark or this machine opens, as a native one, read and written by all tasks; returns the new path."""
    file, to = layout_of(spark, path, "interchange", 1 << 16), to or native_path(path)
    write_csr_frame(read_csr(spark, path, "interchange", 1 << 16), to, file.rows, file.cols, "native")
    return to
