"""Retrieval beyond one search: parents of chunks, several phrasings, drafted answers, context, reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from passages.functions.text import lines, strip, words
from passages.operators.topk import top_k


def parents(hits: DataFrame, sections: DataFrame, doc: str = "source") -> DataFrame:
    """Hits with the whole section that their (``doc``, heading) names, as ``parent``, and word counts. Of sections
    with the same heading the last stands for all."""
    last = sections.withColumn("__n", F.row_number().over(W.partitionBy(doc, "heading").orderBy(F.col("section_no").desc()))).filter("__n = 1")
    joined = hits.join(last.select(doc, "heading", F.col("body").alias("parent")), [doc, "heading"])
    counted = joined.withColumn("chunk_words", F.size(words(F.col("text")))).withColumn("parent_words", F.size(words(F.col("parent"))))
    return counted.withColumn("ratio", F.floor(F.col("parent_words") / F.when(F.col("chunk_words") > 0, F.col("chunk_words"))))


def variants(question: Column, reply: Column) -> Column:
    """The question and the phrasings in a reply: one for each line that is not blank, without bullets."""
    said = F.filter(lines(F.coalesce(reply, F.lit(""))), lambda x: strip(x) != "")
    return F.concat(F.array(question), F.transform(said, lambda x: strip(F.regexp_replace(x, "^[-• ]+|[-• ]+$", ""))))


def best_of_variants(hits: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """``hits``: query_id, variant_no, rank, score, keys. The k best by each key's best score; ties go to
    what was seen first: the earlier variant, then the earlier rank."""
    best = hits.groupBy("query_id", *keys).agg(F.max("score").alias("score"), F.min(F.struct("variant_no", "rank")).alias("seen"))
    return top_k(best, ["query_id"], "score", ["seen"], k).drop("seen")


def contextual(chunks: DataFrame, documents: DataFrame, context: Column, doc: str = "source") -> DataFrame:
    """Chunks with ``embed_text``, their context and a line feed before them; ``text`` stays bare. ``context`` may use the
    chunk's columns and ``document``, the whole text."""
    joined = chunks.join(documents.select(doc, F.col("text").alias("document")), doc)
    return joined.withColumn("embed_text", F.concat_ws("\n", context, F.col("text"))).drop("document")


def two_stage(hits: DataFrame, score: Column, keys: list[str], keep: int = 3) -> DataFrame:
    """The ``keep`` best of each query's hits under another score, given as a column of the hits; ties keep their order."""
    return top_k(hits.withColumnRenamed("rank", "first_rank").withColumn("score", score), ["query_id"], "score", ["first_rank", *keys], keep)


def listing(hits: DataFrame, width: int = 200) -> DataFrame:
    """(query_id, listing): each query's hits as numbered lines of their first characters."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.left(F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " "), F.lit(width)))
    listed = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return listed.select("query_id", F.array_join(F.col("l.line"), "\n").alias("listing"))


def reply_order(reply: Column, n: Column) -> Column:
    """Ranks 1 to n in the order of a reply: its valid numbers, first mentions only, then the rest as they were."""
    said = F.transform(F.regexp_extract_all(F.coalesce(reply, F.lit("")), F.lit(r"(\d+)"), F.lit(1)), lambda x: x.try_cast("int"))
    valid = F.array_distinct(F.filter(said, lambda x: x.isNotNull() & (x >= 1) & (x <= n)))
    return F.when(n > 0, F.concat(valid, F.array_except(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), valid))).otherwise(F.array().cast("array<int>"))


def apply_reply(hits: DataFrame, replies: DataFrame, top_n: int = 3) -> DataFrame:
    """Hits in the order of a reply (query_id, reply), with ``new_rank``, cut to ``top_n``. No reply keeps the order."""
    counts = hits.groupBy("query_id").agg(F.max("rank").cast("int").alias("n")).join(replies, "query_id", "left")
    order = counts.select("query_id", F.posexplode(F.slice(reply_order(F.col("reply"), F.col("n")), 1, top_n)).alias("at", "rank"))
    return hits.join(order, ["query_id", "rank"]).withColumn("new_rank", F.col("at") + 1).drop("at")
