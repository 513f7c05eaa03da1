"""Exports as JSON text sequences: split reads, filters, malformed records."""

import io
import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from passages.sources import exports

ROWS = [("a", "one\ntwo"), ("a", "\x1e inside"), (None, "no name"), ("b", None), ("b1", "é" * 500), ("c", ""), ("a", "one\ntwo")]


@pytest.fixture
def folder(spark, tmp_path):
    exports.register(spark)
    exports.save(spark.createDataFrame(ROWS, "source string, text string").withColumn("more", F.lit(1)).coalesce(1), f"{tmp_path}/e")
    return f"{tmp_path}/e"


def key(r):
    return r[0], r[1] or ""


@given(st.lists(st.binary(max_size=12).filter(lambda b: b"\x1e" not in b), max_size=8), st.binary(max_size=5).filter(lambda b: b"\x1e" not in b), st.integers(1, 9))
def test_each_record_lies_in_one_range(parts, before, size):
    data = before + b"".join(b"\x1e" + p for p in parts)
    old, exports._READ = exports._READ, 3
    try:
        got = [raw for at in range(0, len(data), size) for _, raw in exports.records(io.BytesIO(data), at, min(at + size, len(data)))]
    finally:
        exports._READ = old
    assert got == parts


@pytest.mark.parametrize("size", [7, 100, 1 << 20])
def test_ranges_read_every_record_once(spark, folder, size):
    df = spark.read.format("document_export").option("range", size).load(folder)
    assert sorted(map(tuple, df.collect()), key=key) == sorted([(s or "?", t) for s, t in ROWS], key=key)
    assert (df.rdd.getNumPartitions() > 1) == (size < 1000)
    assert spark.read.format("document_export").load("file://" + folder).count() == len(ROWS)


FILTERS = [("source = 'a'", 3), ("source IN ('b', 'c')", 2), ("source LIKE 'b%'", 2), ("source = 'a' AND text LIKE '%two'", 2), ("source = '?'", 1), ("source LIKE '%1'", 1)]


def test_filters_reach_the_reader_that_asks(spark, folder):
    exports.register(spark, pushdown=True)
    for where, n in FILTERS:
        assert spark.read.format("document_export").option("pushdown", True).load(folder).filter(where).count() == n
    filters = [exports.EqualTo(("source",), "a"), exports.EqualTo(("text",), "x")]
    reader = exports.ExportSource({"path": folder, "pushdown": "true"}).reader(None)
    assert [f.attribute for f in reader.pushFilters(filters)] == [("text",)] and reader.tests == [("among", {"a"})]
    assert {r["source"] for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()} == {"a"}
    assert type(exports.ExportSource({"path": folder}).reader(None)) is exports.ExportReader


def test_a_load_that_does_not_ask_may_be_filtered_and_read_again(spark, folder):
    exports.register(spark, pushdown=True)
    df = spark.read.format("document_export").load(folder)
    for where, n in FILTERS:
        assert df.filter(where).count() == n and df.count() == len(ROWS)
    assert df.filter("source = 'a'").union(df.filter("source = 'b'")).union(df).count() == 4 + len(ROWS)


def test_malformed_and_other_fields(spark, tmp_path):
    exports.register(spark)
    lines = [b'\x1e{"name": 7, "body": {"x": "\xc3\xa9"}}\n', b"\x1e{broken\n", b"\x1e[1]\n", b"\x1e\n", b'\x1e{"name": "z", "body": "cut']
    (tmp_path / "log.seq").write_bytes(b"".join(lines))
    (tmp_path / "empty.seq").write_bytes(b"")
    (tmp_path / "_SUCCESS").write_bytes(b"no")
    read = spark.read.format("document_export").option("text", "body").option("source", "name")
    assert [tuple(r) for r in read.option("malformed", "drop").load(str(tmp_path)).collect()] == [("7", json.dumps({"x": "é"}, ensure_ascii=False))]
    with pytest.raises(PySparkException):
        read.option("malformed", "fail").load(str(tmp_path)).collect()
    with pytest.raises(PySparkException):
        read.option("range", 0).load(str(tmp_path)).collect()
    with pytest.raises(PySparkException):
        read.load(f"{tmp_path}/missing").collect()
