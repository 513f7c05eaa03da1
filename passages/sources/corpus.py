"""Reading documents: folders of text files and any table with a text and a name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(source, text) of each ``*.md`` and ``*.txt`` file of a folder, not of its subfolders; line ends become line feeds."""
    raw = spark.read.option("pathGlobFilter", "*.{md,txt}").text(folder, wholetext=True)
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    return raw.select(name.alias("source"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))


def from_table(table: DataFrame, text: str, source: str) -> DataFrame:
    """(source, text) of any table; a null name becomes ``?``."""
    return table.select(F.coalesce(F.col(source).cast("string"), F.lit("?")).alias("source"), F.col(text).cast("string").alias("text"))
