"""Stored indexes: Parquet records with a one-row header that says how they were built."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checked(records: DataFrame, dim: int | None = None, vector: str = "vector") -> DataFrame:
    """Records as they are, but a null text or vector, or another dimension than ``dim``, fails the job that reads them."""
    wrong = F.col("text").isNull() | F.col(vector).isNull()
    if dim is not None:
        wrong = wrong | (F.size(vector) != dim)
    return records.withColumn(vector, F.when(wrong, F.raise_error(F.lit("a record lacks its text or vector, or has another dimension"))).otherwise(F.col(vector)))


def appended(records: DataFrame, more: DataFrame) -> DataFrame:
    """Both tables' rows by column name; columns that one lacks are null there."""
    return records.unionByName(more, allowMissingColumns=True)


def save(records: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    records.write.mode(mode).partitionBy(*partition_by).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Saved records; a missing ``metadata`` map is empty."""
    records = spark.read.parquet(path)
    return records.withColumn("metadata", F.coalesce("metadata", F.create_map())) if "metadata" in records.columns else records


def build_or_load(spark: SparkSession, path: str, header: dict[str, str], build: Callable[[], DataFrame], rebuild: bool = False) -> tuple[DataFrame, bool]:
    """(records, whether they were built): stored records are used if their header equals ``header``, which must name
    all that shapes them, the model too. Records are written under a new name and the header, written last, points to
    them, so readers of the former ones go on. An empty build raises ValueError and leaves what is stored."""
    wanted = {k: str(v) for k, v in header.items()}
    if not rebuild:
        try:
            rows = spark.read.parquet(f"{path}/header").collect()  # one row
        except AnalysisException:
            rows = []
        if rows and rows[0]["header"] == wanted:
            return load(spark, f"{path}/{rows[0]['records']}"), False
    records = build()
    if records.isEmpty():
        raise ValueError("the corpus is empty")
    name = f"records-{uuid.uuid4().hex}"
    save(records, f"{path}/{name}")
    spark.createDataFrame([(wanted, name)], "header map<string,string>, records string").coalesce(1).write.mode("overwrite").parquet(f"{path}/header")
    return load(spark, f"{path}/{name}"), True


def save_hits(hits: DataFrame, path: str, run: str = "run") -> None:
    """Adds the trace of what each query retrieved, (``run``, query_id, rank, score, source, ...), to the table at ``path``. Rows of a run replace those
    that it has there, so a run that is written again, by a retry or with other hits, is there once; other runs stay."""
    hits.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run).parquet(path)
