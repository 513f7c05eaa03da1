"""Folders of files, stored indexes, streams."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from passages.sources import corpus, index
from passages.streaming.ingest import chunk_stream


def test_load_corpus(spark, tmp_path):
    for name, data in {"b.md": b"one\r\ntwo\rthree", "a b+c.txt": "é".encode(), "skip.csv": b"x", "empty.txt": b""}.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.md").write_text("no")
    got = {r.source: r.text for r in corpus.load_corpus(spark, str(tmp_path)).collect()}
    assert {k: v for k, v in got.items() if k != "empty.txt"} == {"b.md": "one\ntwo\nthree", "a b+c.txt": "é"}


def test_from_table(spark):
    t = spark.createDataFrame([(1, "x"), (None, None)], "id int, body string")
    assert [tuple(r) for r in corpus.from_table(t, "body", "id").collect()] == [("1", "x"), ("?", None)]


def records(spark, n=3):
    return spark.createDataFrame([(f"t{i}", [1.0, float(i)], {"source": "s"} if i else None) for i in range(n)], "text string, vector array<float>, metadata map<string,string>")


def test_build_or_load(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return records(spark)

    header = {"model": "m", "size": 120, "overlap": 20}
    for wanted, built in ((header, True), (header, False), ({**header, "size": 40}, True), ({**header, "size": 40}, False)):
        got, was_built = index.build_or_load(spark, str(tmp_path / "i"), wanted, build)
        assert was_built == built and got.count() == 3
    assert index.build_or_load(spark, str(tmp_path / "i"), {**header, "size": 40}, build, rebuild=True)[1] and len(calls) == 3
    assert got.filter(F.size("metadata") == 0).count() == 1
    with pytest.raises(ValueError):
        index.build_or_load(spark, str(tmp_path / "j"), header, lambda: records(spark).limit(0))


def test_append_and_check(spark):
    more = spark.createDataFrame([("new", [0.0, 1.0], "cat")], "text string, vector array<float>, category string")
    both = index.appended(records(spark), more)
    assert both.count() == 4 and both.filter("category is null").count() == 3
    assert index.checked(both, 2).count() == 4
    with pytest.raises(PySparkException):
        index.checked(both, 3).collect()


def test_a_run_written_again_is_there_once(spark, tmp_path):
    def trace(run, *scores):
        rows = spark.createDataFrame([(run, 1, i + 1, s, "s") for i, s in enumerate(scores)], "run string, query_id int, rank int, score double, source string")
        index.save_hits(rows, f"{tmp_path}/h")

    seen = lambda: sorted((r.run, r["rank"], r.score) for r in spark.read.parquet(f"{tmp_path}/h").collect())
    trace("a", 0.5, 0.25)
    trace("b", 0.5)
    trace("a", 0.5, 0.25)
    assert seen() == [("a", 1, 0.5), ("a", 2, 0.25), ("b", 1, 0.5)]
    trace("b", 0.75)
    assert seen() == [("a", 1, 0.5), ("a", 2, 0.25), ("b", 1, 0.75)]


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, " a  b c "), (2, None)], "doc_id int, text string")
    docs.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in")
    chunk_stream(stream, f"{tmp_path}/out", f"{tmp_path}/cp", 2, 0).awaitTermination(120)
    assert sorted(r.text for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a b", "c"]
