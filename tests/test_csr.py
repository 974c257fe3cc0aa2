import os

import numpy as np
import pytest

from lumenvec import model
from lumenvec.plans.index import index_factory
from lumenvec.sources import csr
from lumenvec.sources.csr import convert, convert_frame, interchange_size, native_size, read_csr, write_csr, write_csr_frame


def test_roundtrip(spark, tmp_path):
    p = str(tmp_path / "a.csr")
    write_csr(p, [0, 2, 2, 3], [1, 5, 0], [0.5, 1.5, 2.0], 6)
    assert (tmp_path / "a.csr").stat().st_size == interchange_size(3, 3)
    want = [(0, 1, 0.5), (0, 5, 1.5), (2, 0, 2.0)]
    assert sorted(map(tuple, read_csr(spark, p, dimension=6).collect())) == want
    n = convert(p)
    assert n.endswith(".mcsr") and (tmp_path / "a.csr.mcsr").stat().st_size == native_size(3, 3)
    assert sorted(map(tuple, read_csr(spark, n, "native").collect())) == want


def test_errors(spark, tmp_path):
    p = tmp_path / "b.csr"
    with pytest.raises(ValueError):
        read_csr(spark, str(p))
    write_csr(str(p), [0, 1], [3], [1.0], 4)
    raw = p.read_bytes()
    with pytest.raises(ValueError):
        read_csr(spark, str(p), dimension=3)
    for bad in (raw[:10], raw[:-1], np.int64(0).tobytes() + raw[8:], raw[:24] + np.int64(1).tobytes() + raw[32:]):
        p.write_bytes(bad)
        with pytest.raises(ValueError):
            read_csr(spark, str(p))


def drawn(seed, rows, cols):
    rng = np.random.default_rng(seed)
    return [(i, int(t), float(rng.integers(1, 99)) / 8) for i in range(rows) for t in rng.choice(cols, rng.integers(0, 6), replace=False)]


@pytest.mark.parametrize("layout", ["interchange", "native"])
def test_all_tasks_write_one_file(spark, tmp_path, monkeypatch, layout):
    monkeypatch.setattr(csr, "RANGE_ENTRIES", 7)
    entries = drawn(1, 40, 50)
    v = spark.createDataFrame(entries, "doc_id int, term int, weight float").repartition(3)
    p, q = str(tmp_path / "x" / "all.csr"), str(tmp_path / "one.csr")
    write_csr_frame(v, p, 43, 50, layout)
    indptr = np.searchsorted([e[0] for e in entries], np.arange(44))
    order = sorted(entries)
    write_csr(q, indptr, [e[1] for e in order], [e[2] for e in order], 50, layout)
    assert open(p, "rb").read() == open(q, "rb").read()
    assert os.listdir(tmp_path / "x") == ["all.csr"]  # nothing else is left
    assert sorted(map(tuple, read_csr(spark, p, layout, 50).collect())) == order


def test_writing_refuses(spark, tmp_path):
    to = str(tmp_path / "c.csr")
    for bad in ([(0, 1, 1.0), (0, 1, 2.0)], [(0, 9, 1.0)], [(5, 1, 1.0)]):
        with pytest.raises(Exception, match="twice|out of range"):
            write_csr_frame(spark.createDataFrame(bad, "doc_id int, term int, weight float"), to, 3, 4)
    with pytest.raises(ValueError):
        write_csr_frame(spark.createDataFrame([(0, 1, 1.0)], "doc_id int, term int, weight float"), "viewfs://x/y", 3, 4)
    assert os.listdir(tmp_path) == []
    write_csr_frame(spark.createDataFrame([], "doc_id int, term int, weight float"), to, 3, 4)
    assert read_csr(spark, to).count() == 0


@pytest.mark.parametrize("layout", ["interchange", "native"])
@pytest.mark.parametrize("group,record", [(1 << 16, 1 << 20), (5, 12)])
def test_paths_that_only_spark_opens(spark, tmp_path, monkeypatch, layout, group, record):
    monkeypatch.setattr(csr, "GROUP_ENTRIES", group)
    monkeypatch.setattr(csr, "RECORD_BYTES", record)
    store = f"{layout}{group}"  # Hadoop keeps a file system by its name
    spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{store}.link./in", f"file://{tmp_path}")
    entries = sorted(drawn(2, 33, 50) + [(33, t, 1.0) for t in range(40)])
    p = str(tmp_path / "d.csr")
    write_csr(p, np.searchsorted([e[0] for e in entries], np.arange(37)), [e[1] for e in entries], [e[2] for e in entries], 50, layout)
    far = f"viewfs://{store}/in/d.csr"
    assert sorted(map(tuple, read_csr(spark, far, layout, 50).collect())) == entries
    x = index_factory(spark, 50, "inverted")
    x.read_csr(far, layout)
    assert x.num_vectors == 36
    if layout == "native":
        with pytest.raises(RuntimeError):
            x.read_csr(far, layout)
    else:
        assert sorted(map(tuple, read_csr(spark, convert_frame(spark, far, str(tmp_path / "e.mcsr")), "native", 50).collect())) == entries
    for bad in (f"viewfs://{store}/in/none", far):
        with pytest.raises(ValueError):
            read_csr(spark, bad, layout, 49)


def test_repeated_terms(spark):
    v = spark.createDataFrame([(0, 1, 1.0), (0, 1, 2.5), (0, 2, 1.0), (1, 1, 4.0)], "doc_id int, term int, weight float")
    assert sorted(map(tuple, model.merged(v, "sum").collect())) == [(0, 1, 3.5), (0, 2, 1.0), (1, 1, 4.0)]
    assert [tuple(r) for r in model.duplicates(v).collect()] == [(0, 1, 2)]
    with pytest.raises(Exception, match="twice"):
        model.merged(v, "refuse").collect()
    with pytest.raises(ValueError):
        model.merged(v, "first")
    x = index_factory(spark, 8, "inverted")
    x.add_frame(v, 2, duplicates="sum")
    x.add(1, [0, 3], np.array([3, 3, 4], np.uint16), np.array([1.0, 7.0, 2.0], np.float32))  # the last one holds
    assert sorted(map(tuple, x.vectors.collect())) == [(0, 1, 3.5), (0, 2, 1.0), (1, 1, 4.0), (2, 3, 7.0), (2, 4, 2.0)]
    y = index_factory(spark, 8, "inverted")
    y.add_frame(v, 2, duplicates="refuse")
    with pytest.raises(Exception, match="twice"):
        y.build()


def test_tasks_that_come_after_an_abort_leave_no_file(tmp_path):
    writer = csr.CsrWriter({"path": str(tmp_path / "c.csr"), "size": "8", "name": "n"})
    (tmp_path / "c.csr.n").touch()
    writer.write(iter([{"at": 0, "bytes": b"12345678"}]))
    writer.abort([])
    with pytest.raises(FileNotFoundError):
        writer.write(iter([]))
    assert os.listdir(tmp_path) == []
