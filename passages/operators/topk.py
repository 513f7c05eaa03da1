"""Top-k of each group, with ties in a fixed order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def top_k(df: DataFrame, by: list[str], score: str, keys: list[str], k: int | None, rank: str = "rank") -> DataFrame:
    """The k rows of highest ``score`` for each ``by``, ranked from 1; equal scores (to nine places, since
    distributed sums differ in their last bits) go by ``keys``. k=None ranks all rows."""
    order = W.partitionBy(*by).orderBy(F.round(score, 9).desc(), *keys)
    ranked = df.withColumn(rank, F.row_number().over(order))
    return ranked if k is None else ranked.filter(F.col(rank) <= k)
