"""What the training-data operators share: row ids, salted joins and, from the library, tables in the shared folder."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable
from functools import wraps
from itertools import count

import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passages.sources.scratch import scratch_path, shared_dir, written  # noqa: F401

#: Largest side, in rows of a few dozen bytes, that a join may broadcast after a count.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _file_code(files: list[str]) -> tuple[int, str]:
    """(bits, salt) for which the first ``bits`` bits of the hash of salt and path tell all files apart."""
    paths = [re.sub(_SCHEME, "", f) for f in files]
    bits = 2 * max(1, len(paths)).bit_length()
    for salt_ in map("{}:".format, count()):
        if len({xxhash.xxh64_intdigest((salt_ + p).encode(), 42) >> (64 - bits) for p in paths}) == len(set(paths)):
            return bits, salt_


_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:/+"


#: Logical operators that keep each row of a file one row.
_ONE_TO_ONE = {"Project", "Filter", "SubqueryAlias", "View", "LogicalRelation"}


def _one_to_one(df: DataFrame) -> bool:
    """Whether ``df`` reads files, filtered and projected at most: ``explode``, ``sample``, ``limit`` and all else may repeat rows or not be repeatable."""
    plan = df._jdf.queryExecution().analyzed()
    while True:
        if plan.getClass().getSimpleName() not in _ONE_TO_ONE or plan.children().size() > 1:
            return False
        if plan.children().isEmpty():
            return True
        plan = plan.children().head()


def placed(df: DataFrame) -> DataFrame:
    """``df`` itself if it reads Parquet files, filtered and projected at most, so that each row has a file and a place
    there; what comes from anything else is written to the shared folder first."""
    try:
        place = df.metadataColumn("_metadata")
        df.select(place["file_path"], place["row_index"])
        return df if _one_to_one(df) else written(df, "rows")
    except AnalysisException:
        return written(df, "rows")


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Adds a long that tells rows apart even where other ids repeat or are null: the file's hash, as long as it takes to
    tell all files of ``df`` apart, and the row's number in it. It does not depend on how the read is split, so
    two jobs agree on it whatever executors come and go. See :func:`placed` for what ``df`` may be."""
    df = placed(df)
    place = df.metadataColumn("_metadata")
    bits, salt_ = _file_code(df.inputFiles())
    code = F.xxhash64(F.concat(F.lit(salt_), F.regexp_replace(place["file_path"], _SCHEME, "")))
    at, most = place["row_index"], 1 << (63 - bits)
    number = F.when(at < most, at).otherwise(F.raise_error(F.lit(f"a file has more than {most} rows")))
    return df.withColumn(name, F.shiftleft(F.shiftrightunsigned(code, 64 - bits), 63 - bits).bitwiseOR(number))


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are few; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= most else df


def with_lists(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """``rows`` (row_id, ...) joined with stored ``lists`` (row_id, arrays). Only ids are broadcast, if they are few; the
    arrays meet the rows that are left in a shuffled join."""
    ids = lists.select("row_id")
    return rows.join(small(ids, ids.count()), "row_id", "left_semi").join(lists, "row_id")


def semi_join(rows: DataFrame, counted: DataFrame, on: list[str], hot: int = 10_000) -> DataFrame:
    """``rows`` whose keys are in ``counted`` (on, n), a stored table. Rows of keys that occur more than ``hot`` times, which are
    few, stay where they are and meet their keys by broadcast; only the others are dealt by key."""
    large = counted.filter(F.col("n") > hot).select(*on)
    if not 0 < large.count() <= BROADCAST_ROWS:
        return rows.join(counted.select(*on), on, "left_semi")
    large = F.broadcast(large)
    others = rows.join(large, on, "left_anti").join(counted.filter(F.col("n") <= hot).select(*on), on, "left_semi")
    return rows.join(large, on, "left_semi").unionByName(others)


def without(docs: DataFrame, gone: DataFrame, label: str) -> DataFrame:
    """``docs`` without the rows whose ids, as :func:`with_row_id` gives them, are in ``gone`` (row_id)."""
    stored = written(gone.select(F.col("row_id").alias("__row")), label)
    return with_row_id(docs, "__row").join(small(stored, stored.count()), "__row", "left_anti").drop("__row")


def tidy(run: Callable) -> Callable:
    """A task's function whose end gives freed memory back to the system: workers outlive their tasks, and what the allocators keep of one
    task's texts would stay beside the next stage's."""

    @wraps(run)
    def tidied(*args, **how):
        try:
            yield from run(*args, **how)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # of glibc
                libc.malloc_trim(0)

    return tidied


def salt(n: int, *by: Column) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")


def with_group_min(df: DataFrame, keys: list[str], value: str, salt_by: list[str], names: tuple[str, str], salts: int = 64) -> DataFrame:
    """Adds the smallest ``value`` and the row count of each group of ``keys``, as ``names``.

    A group of any size is dealt over ``salts`` tasks: it is first summed by (keys, salt), these few
    rows are summed by key, and each (keys, salt) gets the result back. Nulls in keys form no group.
    """
    low, n = names
    dealt = df.withColumn("__salt", salt(salts, *[F.col(c) for c in salt_by]))
    parts = dealt.groupBy(*keys, "__salt").agg(F.min(value).alias("__low"), F.count("*").alias("__n"))
    whole = (
        parts.groupBy(*keys)
        .agg(F.min("__low").alias(low), F.sum("__n").alias(n), F.collect_list("__salt").alias("__salts"))
        .withColumn("__salt", F.explode("__salts"))
        .drop("__salts")
    )
    return dealt.join(whole, [*keys, "__salt"], "left").drop("__salt")
