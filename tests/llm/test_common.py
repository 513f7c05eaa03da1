"""Group minima by salts, removal of rows, column names that clash."""

import random

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from passages.llm import decontamination, embeddings, language, near_duplicates, packing, secrets, suffix_dedup, warc
from passages.llm.common import _file_code, placed, shared_dir, table, with_group_min, with_row_id, without, written


def test_with_group_min(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), i, rng.randrange(100)) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, id int, v int")
    got = {r.id: (r.low, r.n) for r in with_group_min(df, ["k"], "v", ["id"], ("low", "n"), 5).collect()}
    for k, i, _ in rows:
        group = [v for g, _, v in rows if g == k and k is not None]
        assert got[i] == ((min(group), len(group)) if group else (None, None))


def test_removal_keeps_clashing_columns(spark, tmp_path):
    rows = [(1, "the same words here again", "en", "s", 5, 7), (1, "the same words here again", "en", "s", 5, 7), (2, "the other text that stays", "en", "s", 5, None), (None, None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row_id int, node int").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    items = written(spark.createDataFrame([(1, "the other text that stays")], "item_id long, text string"), "t")
    for f, n in ((language.accepted, 3), (near_duplicates.deduplicated, 3), (lambda d: decontamination.decontaminated(d, items), 3)):
        out = f(docs)
        assert out.columns == docs.columns and out.count() == n and out.filter("row_id = 5").count() == n - (f is not language.accepted)
    assert without(docs, with_row_id(docs), "t").count() == 0


def test_shared_dir_is_set_once(spark):
    assert shared_dir(spark) == shared_dir(spark)


D = "/root/testdata/sf0.001"


def test_row_ids_are_apart_and_stay(spark, tmp_path):
    spark.range(1000).repartition(7).write.parquet(f"{tmp_path}/a b+c%")
    read = lambda: {r.id: r.row_id for r in with_row_id(spark.read.parquet(f"{tmp_path}/a b+c%").select("id")).collect()}
    ids = read()
    assert len(set(ids.values())) == 1000 and min(ids.values()) >= 0
    spark.conf.set("spark.sql.files.minPartitionNum", "64")
    assert read() == ids
    spark.conf.unset("spark.sql.files.minPartitionNum")
    spark.range(5).selectExpr("id", "'clash' AS _metadata").write.parquet(f"{tmp_path}/m")
    assert with_row_id(spark.read.parquet(f"{tmp_path}/m")).select("row_id", "_metadata").distinct().count() == 5
    assert with_row_id(spark.range(9).distinct()).select("row_id").distinct().count() == 9  # no file: written first
    bits, salt = _file_code([f"hdfs://h/d/part-{i}" for i in range(3000)])
    assert bits == 24 and salt.endswith(":")


def test_rows_that_files_do_not_tell_apart(spark, tmp_path):
    spark.createDataFrame([(i, "some words that copies share again", "en", "s", 1) for i in range(100)], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/e")
    docs = spark.read.parquet(f"{tmp_path}/e")
    twice = F.explode(F.array(F.lit(1), F.lit(2)))
    made = [docs.withColumn("x", twice), docs.withColumn("x", twice).filter("x > 0").select("text", "doc_id"), docs.union(docs), docs.select("doc_id", "text").sample(True, 2.0, 1), docs.join(docs.select("doc_id"), "doc_id"), docs.limit(50).select("doc_id", "text"), docs.distinct()]
    for df in made:
        ids = with_row_id(df).select("row_id")
        assert ids.distinct().count() == ids.count()
    assert placed(docs.filter("doc_id > 3").select("doc_id")).inputFiles() == docs.inputFiles()  # read where it lies
    assert near_duplicates.report(made[0]).count() == 200


OPERATORS = {
    "warc": lambda s, d: warc.report(d("pages")),
    "suffix": lambda s, d: suffix_dedup.report(d("documents")),
    "packing": lambda s, d: packing.report(d("documents")).select("doc_id", "piece", "start", "length", "ids_crc32"),
    "decontamination": lambda s, d: decontamination.report(d("documents"), d("benchmark")),
    "secrets": lambda s, d: secrets.secret_report(d("documents")),
    "embeddings": lambda s, d: embeddings.report(d("embeddings")),
    "deduplicated": lambda s, d: near_duplicates.deduplicated(d("documents")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_do_not_depend_on_splits(name, spark, tmp_path, monkeypatch):
    """The number of read splits changes after every table that an operator writes."""

    def many(t):
        table(spark, D, t).repartition(9).write.parquet(f"{tmp_path}/{t}")
        return lambda: spark.read.parquet(f"{tmp_path}/{t}")

    tables = {t: many(t) for t in ("documents", "pages", "benchmark", "embeddings")}
    run = lambda: sorted(map(repr, OPERATORS[name](spark, lambda t: tables[t]()).collect()))
    want, write, turn = run(), DataFrameWriter.parquet, iter(range(10_000))

    def changing(self, *a, **b):
        write(self, *a, **b)
        spark.conf.set("spark.sql.files.minPartitionNum", str((64, 2, 17)[next(turn) % 3]))

    monkeypatch.setattr(DataFrameWriter, "parquet", changing)
    try:
        assert run() == want
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
