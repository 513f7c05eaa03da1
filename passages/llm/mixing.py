"""Mixing sources to target weights by capped water-filling.

Each source weighs something and together they share a number of words; a source whose share is more than so many
epochs of its words is clamped there, and what it leaves goes to the others by weight, until no source is above. Each round of
that is one grouped sum over the sources. Of a source's target, whole repetitions take every document; the words left are
taken from the documents in the order of a seeded hash, the last of them up to the word where the target is met. Where that
order crosses the target is found by sums over ranges of hashes, finer and finer, so no task sorts more of a source than one
short range of it, and the sampled words of a source are its target rounded down, not an estimate.

Defined results: a null or empty text has no words and is never part of the mix; documents with equal ids, or none, are drawn row
by row; the null source is one source, after all others; a source without words, or whose weight is not above 0, has the target 0; where
all sources together have too few words, each has the most epochs; an empty table gives an empty mix. For ``docs`` see
``common.placed``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from passages.llm.common import small, with_row_id, written

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Settings:
    weights: tuple[int, ...] = (3, 1, 2)  #: of the sources in order, repeating
    share: float = 1.5  #: words of the mix, as a multiple of all words
    epochs: float = 2.0  #: most times that a source is repeated
    seed: int = 0
    cell: int = 100_000  #: most documents that one task puts in order


def numbered(rows: DataFrame, by: list[Column], name: str) -> DataFrame:
    """``rows`` with their position in the order of ``by``, from 0: sorted over ranges, each of which is counted."""
    ranged = written(rows.repartitionByRange(*by).withColumn("__range", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("__range").agg(F.count("*").alias("__n"))  # as many rows as partitions
    starts = counts.select("__range", (F.sum("__n").over(W.orderBy("__range")) - F.col("__n")).alias("__start"))
    at = F.row_number().over(W.partitionBy("__range").orderBy(*by)) - 1
    return ranged.join(F.broadcast(starts), "__range").withColumn(name, at + F.col("__start")).drop("__range", "__start")


def cycled(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """``sources`` (source, ...) with weights dealt in turn by code point, null last."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    placed = numbered(sources, [F.col("source").asc_nulls_last()], "__at")
    return placed.withColumn("weight", F.element_at(cycle, (F.col("__at") % len(weights) + 1).cast("int"))).drop("__at")


def water_filled(sources: DataFrame, share: float, epochs: float) -> DataFrame:
    """``sources`` (source, source_size, weight), a stored table, with ``target``. The level, words a unit of weight, rises while a
    round clamps more sources than the one before."""
    cap, weight = epochs * F.col("source_size"), F.greatest(F.col("weight").cast("double"), F.lit(0.0))
    full, before, level = F.lit(False), -1, 0.0
    while True:
        clamped = F.sum(F.when(full, cap).otherwise(0.0))
        free = F.sum(F.when(full, 0.0).otherwise(weight))
        total, held, rest, n = sources.agg(F.sum("source_size"), clamped, free, F.count_if(full)).first()
        if not rest or n == before:
            break
        level, before = max(level, (share * total - held) / rest), n
        full = cap <= level * weight
    return sources.withColumn("target", F.when(full, cap).otherwise(F.lit(level) * weight))


def _ordered(docs: DataFrame, seed: int) -> DataFrame:
    """(row_id, doc_id, source, size, h, x): words, the seeded hash of id and size, and that of the row for equal ones."""
    rows = with_row_id(docs.select("doc_id", "text", "source"))
    rows = rows.withColumn("size", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long"))
    h = F.conv(F.left(F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id"), F.col("size"))), F.lit(15)), 16, 10).cast("long")
    return rows.select("row_id", "doc_id", "source", "size", h.alias("h"), F.shiftrightunsigned(F.xxhash64("row_id"), 4).alias("x"))


#: The steps in which ranges get finer: twelve bits of h at a time, then of x.
_STEPS = [(c, s) for c in ("h", "x") for s in (48, 36, 24, 12, 0)]


def _joined(rows: DataFrame, facts: DataFrame, *more: str, hint=lambda x: x, how: str = "inner") -> DataFrame:
    """``rows`` with the other columns of ``facts`` of the same source, null with null, and of the same ``more``."""
    facts = facts.withColumnsRenamed({c: f"__{c}" for c in ("source", *more)})
    on = F.col("source").eqNullSafe(F.col("__source"))
    for c in more:
        on = on & (F.col(c) == F.col(f"__{c}"))
    return rows.join(hint(facts), on, how).drop("__source", *[f"__{c}" for c in more])


def taken(docs: DataFrame, s: Settings = Settings(), weights: DataFrame | None = None) -> DataFrame:
    """(row_id, doc_id, size, source, source_size, weight, target, taken): for each document the words that the mix takes of it.
    ``weights`` (source, weight) may replace those dealt in turn; a source that it lacks has the target 0."""
    rows = written(_ordered(docs, s.seed), "sized")
    sources = written(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    if weights is None:
        weighed = cycled(sources, s.weights)
    else:
        weighed = _joined(sources, weights.select("source", "weight"), how="left").withColumn("weight", F.coalesce("weight", F.lit(0)))
    targets = water_filled(written(weighed, "weights"), s.share, s.epochs)
    goal, size = F.floor("target"), F.col("source_size")
    whole = F.when(size > 0, F.floor(goal / F.when(size > 0, size))).otherwise(0)
    # need: words beyond the whole repetitions
    needs = written(targets.withColumn("whole", whole.cast("long")).withColumn("need", (goal - F.col("whole") * size).cast("long")), "targets")
    out, kept = None, ["row_id", "doc_id", "size", "source", "source_size", "weight", "target", "whole"]
    carried = [c for c in needs.columns if c not in ("source", "need")]
    for column, shift in _STEPS:
        rows = rows.withColumn("range", F.shiftrightunsigned(column, shift).bitwiseAND(4095))
        sums = rows.groupBy("source", "range").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        ends = F.sum("words").over(W.partitionBy("source").orderBy("range"))  # at most 4,096 rows a source
        cut = _joined(sums, needs).withColumn("end", ends)
        left = F.col("need") - (F.col("end") - F.col("words"))  # words still wanted where the range begins
        cut = written(cut.select("source", "range", "n", *carried, left.alias("left"), (left >= F.col("words")).alias("all"), ((left > 0) & (left < F.col("words"))).alias("crossed")), "ranges")
        most = cut.agg(F.count("*"), F.max(F.when(F.col("crossed"), F.col("n")))).first()
        seen = _joined(rows, cut.drop("n"), "range", hint=lambda x: small(x, most[0], 100_000))
        sure = seen.filter("NOT crossed").select(*kept, F.when(F.col("all"), F.col("size")).otherwise(0).alias("extra"))
        out = sure if out is None else out.unionByName(sure)
        if most[1] is None:
            break
        rows = written(seen.filter("crossed").drop("range", "all", "crossed"), "crossed")
        if most[1] <= s.cell:
            end = F.sum("size").over(W.partitionBy("source").orderBy("h", "x", "row_id").rowsBetween(W.unboundedPreceding, 0))
            part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - (end - F.col("size"))))
            out = out.unionByName(rows.select(*kept, part.alias("extra")))
            break
        needs = rows.groupBy("source").agg(F.first("left").alias("need"), *[F.first(c).alias(c) for c in carried])
        rows = rows.drop("left", *carried)
    return out.withColumn("taken", F.col("whole") * F.col("size") + F.col("extra")).drop("whole", "extra")


def _cut_udf():
    @F.pandas_udf("string")
    def cut(text: pd.Series, words: pd.Series) -> pd.Series:
        ends = [[m.end() for m in re.finditer(WORD, t)][n - 1] for t, n in zip(text, words)]
        return pd.Series([t[:e] for t, e in zip(text, ends)], index=text.index)

    return cut


def mixture(docs: DataFrame, s: Settings = Settings(), weights: DataFrame | None = None) -> DataFrame:
    """The mix: a row of ``docs`` for each repetition (``mix_repetition``, from 0), its text cut where only a part is taken."""
    chosen = written(taken(docs, s, weights).filter("taken > 0").select(F.col("row_id").alias("__row"), F.col("size").alias("__size"), F.col("taken").alias("__taken")), "taken")
    full, part = F.floor(F.col("__taken") / F.col("__size")), F.col("__taken") % F.col("__size")
    rows = with_row_id(docs, "__row").join(chosen, "__row")
    whole = rows.filter(full > 0).withColumn("mix_repetition", F.explode(F.sequence(F.lit(0), (full - 1).cast("int")))).select(*docs.columns, "mix_repetition")
    cut = rows.filter(part > 0).withColumn("text", _cut_udf()("text", part)).withColumn("mix_repetition", full.cast("int"))
    return whole.unionByName(cut.select(*docs.columns, "mix_repetition"))


def report(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, weight) of every row of ``docs``."""
    return taken(docs, s).drop("row_id")


REPORT_SQL = rf"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT size FROM documents),
s AS (SELECT source, sum(size)::BIGINT source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE weight FROM d GROUP BY source),
o AS (SELECT *, (sum(source_size) OVER ())::DOUBLE total, coalesce(sum(2.0 * source_size) OVER (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE held,
 (sum(weight) OVER (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE rest FROM s),
c AS (SELECT *, 2.0 * source_size * rest <= weight * (1.5 * total - held) AS clamped FROM o),
l AS (SELECT coalesce((1.5 * any_value(total) - coalesce(sum(2.0 * source_size) FILTER (clamped), 0)) / nullif(sum(weight) FILTER (NOT clamped), 0), 0)::DOUBLE level FROM c),
t AS (SELECT source, source_size, weight, (CASE WHEN clamped THEN 2.0 * source_size ELSE level * weight END)::DOUBLE target FROM c, l),
n AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END whole, CASE WHEN source_size > 0 THEN floor(target)::BIGINT % source_size ELSE 0 END need FROM t),
e AS (SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY ('0x' || left(md5(concat_ws(':', 0, doc_id, size)), 15))::BIGINT ROWS UNBOUNDED PRECEDING) e FROM d)
SELECT doc_id, size, source_size, target, e.source, weight, (whole * size + greatest(0, least(size, need - (e - size))))::BIGINT AS taken FROM e JOIN n ON e.source IS NOT DISTINCT FROM n.source"""
