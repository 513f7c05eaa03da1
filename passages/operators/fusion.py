"""Fusion of scored or ranked lists. Lists are (query_id, key..., score)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from passages.operators import postings
from passages.operators.lexical import scores
from passages.operators.postings import Stored
from passages.operators.topk import top_k
from passages.operators.vectors import all_scores, cosine, knn
from passages.sources.scratch import written


def normalize(lists: DataFrame, score: str = "score", to: str = "norm", by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Scores divided by their query's largest; 0 where that is 0. A negative largest turns the order round."""
    most = F.max(score).over(W.partitionBy(*by))
    return lists.withColumn(to, F.when(most == 0, 0.0).otherwise(F.col(score) / F.when(most != 0, most)))


def ranks(lists: DataFrame, keys: list[str], score: str = "score", rank: str = "rank") -> DataFrame:
    """Position of each row in its query's list, from 1; ties by keys, none share a rank."""
    return top_k(lists, ["query_id"], score, keys, None, rank)


def rrf(ranked: list[DataFrame], keys: list[str], k: int = 60) -> DataFrame:
    """(query_id, keys, score): sum over the lists of 1 / (k + rank). A row absent from a list adds nothing for it,
    so lists cut to their first n give the pooled form of the full sum."""
    parts = [r.select("query_id", *keys, (1.0 / (k + F.col("rank"))).alias("part")) for r in ranked]
    return reduce(DataFrame.unionByName, parts).groupBy("query_id", *keys).agg(F.sum("part").alias("score"))


def blend(vector: Column, keyword: Column, weight: float) -> Column:
    return weight * F.coalesce(vector, F.lit(0.0)) + (1 - weight) * F.coalesce(keyword, F.lit(0.0))


METHODS = ("vector", "keyword", "blend50", "rrf", "blend90")
#: Rows of each list that fusion looks at first, for each query; four times as many in every further round.
DEPTH = 100
_NEAR = 1e-9  # scores that ranking takes for equal


@dataclass(frozen=True)
class Source:
    """A list over all rows, for any queries. ``first(queries, n)``: (query_id, keys, score) of each query's first n rows, all of them if there are no
    more, in the order of :func:`top_k`. ``look_up(pairs)``: (query_id, keys, score) of chosen (query_id, keys). ``better(of)``: for ``of`` (query_id,
    keys, score) the number of rows before each in its query's list, as ``better``. ``start(queries, n)``: (query_id, keys) of the n first keys, for lists
    that may hold NaN, which makes all rows of a blend equal."""

    first: Callable[[DataFrame, int], DataFrame]
    look_up: Callable[[DataFrame], DataFrame]
    better: Callable[[DataFrame], DataFrame]
    start: Callable[[DataFrame, int], DataFrame] | None = None


def _batch_better(batches: Iterator[pd.DataFrame], asked: dict, key: str) -> Iterator[pd.DataFrame]:
    for frame in batches:
        for q, rows in frame.groupby("query_id"):
            if q in asked:
                keys, scores = asked[q]
                both = np.round(np.concatenate([scores, rows["score"].to_numpy()]), 9)
                order = np.lexsort((np.concatenate([keys, rows[key].to_numpy()]), -np.where(np.isnan(both), np.inf, both)))  # NaN comes first, as in SQL
                before = np.cumsum(order >= len(keys))
                mine = order < len(keys)  # of equals by score and key the chosen row comes first: it is the same row
                yield pd.DataFrame({"query_id": q, key: keys[order[mine]], "better": before[mine]})


def counted_better(lists: DataFrame, of: DataFrame, key: str) -> DataFrame:
    """(query_id, key, better): how many rows of ``lists`` (query_id, key, score) come before each row of ``of``, a table of a few rows
    for each of a block of queries. The lists are read once and not sorted: each batch counts its own."""
    chosen = of.select("query_id", key, "score").toPandas()
    asked = {q: (g[key].to_numpy(), g["score"].to_numpy()) for q, g in chosen.groupby("query_id")}
    kinds = dict(of.dtypes)
    counts = lists.select("query_id", key, "score").mapInPandas(partial(_batch_better, asked=asked, key=key), f"query_id {kinds['query_id']}, {key} {kinds[key]}, better long")
    summed = counts.groupBy("query_id", key).agg(F.sum("better").alias("better"))
    return of.select("query_id", key).join(summed, ["query_id", key], "left").select("query_id", key, F.coalesce("better", F.lit(0)).alias("better"))


def _with_missing(pool: DataFrame, seen: DataFrame, source: Source, keys: list[str], name: str) -> DataFrame:
    """``pool`` with the score of each row in a list, looked up where its first rows do not hold it."""
    lacking = pool.select("query_id", *keys).join(seen, ["query_id", *keys], "left_anti")
    known = seen.select("query_id", *keys, "score").unionByName(source.look_up(lacking).select("query_id", *keys, "score"))
    return pool.join(written(known.withColumnRenamed("score", name), name), ["query_id", *keys], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def _scaled(x: Column, most: Column) -> Column:
    return F.when(most == 0, 0.0).otherwise(x / F.when(most != 0, most))


def exact_top(vector: Source, keyword: Source, queries: DataFrame, keys: list[str], top: int = 3, k: int = 60, methods: tuple[str, ...] = METHODS, depth: int = DEPTH) -> DataFrame:
    """(query_id, method, rank, keys, score): each query's first hits under each method, over all rows of both lists, by a threshold algorithm.

    Both lists' first ``depth`` rows are pooled and their scores in the other list looked up. No row outside the pool scores more than the lists' last
    rows together; queries whose ``top``-th hit does not lie above that go into another round with four times the depth. Reciprocal
    ranks need the ranks of pooled rows in whole lists: one pass over each list counts the rows before them."""
    out, depth = None, max(depth, top)
    weights = {m: int(m.removeprefix("blend")) / 100 for m in methods if m.startswith("blend")}
    left = written(queries.select("query_id").distinct(), "fusion-queries")
    while not left.isEmpty():
        lists = {name: written(source.first(left, depth).select("query_id", *keys, "score"), name) for name, source in (("v", vector), ("w", keyword))}
        heads = [x.select("query_id", *keys) for x in lists.values()] + [x.start(left, top).select("query_id", *keys) for x in (vector, keyword) if x.start]
        pool = reduce(DataFrame.unionByName, heads).distinct()
        both = _with_missing(_with_missing(pool, lists["v"], vector, keys, "v"), lists["w"], keyword, keys, "w")
        ends = None
        for name, rows in lists.items():
            one = rows.groupBy("query_id").agg(F.max("score").alias(f"most_{name}"), F.min("score").alias(f"last_{name}"), F.count("*").alias(f"n_{name}"))
            ends = one if ends is None else ends.join(one, "query_id", "full_outer")
        both = written(both.join(ends, "query_id"), "pool")
        v, w = (_scaled(F.col(x), F.coalesce(F.col(f"most_{x}"), F.lit(0.0))) for x in "vw")
        scores = {"vector": v, "keyword": w} | {m: blend(v, w, x) for m, x in weights.items()}
        # a row that a list lacks scores 0 there
        last = [_scaled(F.greatest(F.coalesce(F.col(f"last_{x}"), F.lit(0.0)), F.lit(0.0)), F.coalesce(F.col(f"most_{x}"), F.lit(0.0))) for x in "vw"]
        bounds = {m: blend(last[0], last[1], x) for m, x in weights.items()}
        if "rrf" in methods:
            for name, source in (("v", vector), ("w", keyword)):
                of = written(both.select("query_id", *keys, F.col(name).alias("score")), "ranked")
                both = both.join(source.better(of).withColumnRenamed("better", f"rank_{name}"), ["query_id", *keys])
            both = written(both, "pool")
            scores["rrf"] = 1.0 / (k + 1 + F.col("rank_v")) + 1.0 / (k + 1 + F.col("rank_w"))
            bounds["rrf"] = F.lit(2.0 / (k + 1 + depth))
        facts = both.select("query_id", *keys, *[scores[m].alias(m) for m in methods])
        hits = written(top_k(facts.unpivot(["query_id", *keys], list(methods), "method", "score"), ["query_id", "method"], "score", keys, top), "fused")
        kth = hits.filter(F.col("rank") == top).groupBy("query_id").pivot("method", list(methods)).agg(F.first("score"))
        # NaN is what all rows score then, and the first keys are pooled
        above = lambda m: F.coalesce(F.isnan(m) | (F.col(m) > bounds[m] + _NEAR), F.lit(False))
        sure = (F.coalesce("most_v", F.lit(0.0)) >= 0) & (F.coalesce("most_w", F.lit(0.0)) >= 0)
        for m in bounds:
            sure = sure & above(m)
        ended = (F.coalesce("n_v", F.lit(0)) < depth) & (F.coalesce("n_w", F.lit(0)) < depth)  # neither has more rows
        state = written(left.join(ends.join(kth, "query_id", "left"), "query_id", "left").select("query_id", (ended | F.coalesce(sure, F.lit(False))).alias("done")), "fusion-state")
        done = hits.join(state.filter("done").select("query_id"), "query_id", "left_semi")
        out, left, depth = done if out is None else out.unionByName(done), state.filter("NOT done").select("query_id"), 4 * depth
    return out if out is not None else queries.sparkSession.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, {', '.join(f'{c} long' for c in keys)}, method string, score double, rank int")


def list_source(lists: DataFrame, key: str) -> Source:
    """A stored list (query_id, key, score)."""
    rows = lists.select("query_id", key, "score")

    def first(queries: DataFrame, n: int) -> DataFrame:
        return top_k(rows.join(queries, "query_id", "left_semi"), ["query_id"], "score", [key], n)

    return Source(first, lambda pairs: rows.join(pairs, ["query_id", key], "left_semi"), lambda of: counted_better(rows, of, key))


def vector_source(vectors: DataFrame, asked: DataFrame, key: str, vector: str = "embedding", undefined: float = 0.0) -> Source:
    """Cosine over ``vectors`` (key, vector) for ``asked`` (query_id, vector); ``undefined`` as in :func:`passages.operators.vectors.knn`."""
    q = asked.select("query_id", F.col(vector).alias("__q"))

    def look_up(pairs: DataFrame) -> DataFrame:
        return pairs.join(vectors.select(key, vector), key).join(q, "query_id").select("query_id", key, cosine(F.col(vector), F.col("__q"), undefined).alias("score"))

    def first(queries: DataFrame, n: int) -> DataFrame:
        return knn(vectors, asked.join(queries, "query_id", "left_semi"), n, key, vector, undefined)

    def better(of: DataFrame) -> DataFrame:
        chosen = asked.join(of.select("query_id").distinct(), "query_id", "left_semi")
        return counted_better(all_scores(vectors, chosen, key, vector, undefined), of, key)

    def start(queries: DataFrame, n: int) -> DataFrame:
        return queries.select("query_id").crossJoin(F.broadcast(vectors.filter(F.col(vector).isNotNull()).select(key).orderBy(key).limit(n)))  # n rows

    return Source(first, look_up, better, start if np.isnan(undefined) else None)


def keyword_source(index: Stored, asked: DataFrame, key: str = "doc_id") -> Source:
    """BM25 over an index of whole documents (chunk_no 0) for ``asked`` (query_id, text); rows without a query term score 0."""
    some = lambda queries: asked.join(queries.select("query_id").distinct(), "query_id", "left_semi")

    def look_up(pairs: DataFrame) -> DataFrame:
        return scores(index, some(pairs), among=pairs.select("query_id", key).withColumn("chunk_no", F.lit(0))).select("query_id", key, "score")

    def better(of: DataFrame) -> DataFrame:
        hits = written(scores(index, some(of)).select("query_id", key, "score"), "hits")
        before = counted_better(hits, of, key)
        # rows that score 0 follow all hits by key: those before are rows of smaller keys that are no hits
        zero = written(of.filter(F.round("score", 9) == 0).select("query_id", key, F.lit(0.0).alias("score")), "zeros")
        one = zero.select(F.lit(0).alias("query_id"), key, "score").distinct()
        smaller = counted_better(index.split.select(F.lit(0).alias("query_id"), key, F.lit(0.0).alias("score")), one, key).select(key, F.col("better").alias("__all"))
        hit = counted_better(hits.withColumn("score", F.lit(0.0)), zero, key).select("query_id", key, F.col("better").alias("__hit"))
        more = F.coalesce(F.col("__all") - F.col("__hit"), F.lit(0))
        return before.join(hit.join(smaller, key), ["query_id", key], "left").select("query_id", key, (F.col("better") + more).alias("better"))

    return Source(lambda queries, n: postings.top(index, some(queries), n), look_up, better)
