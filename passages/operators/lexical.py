"""BM25 over a table of chunks for a table of queries. Keys are (doc_id, chunk_no)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passages.functions.text import tokens
from passages.operators.topk import top_k

KEY = ["doc_id", "chunk_no"]
#: Most rows of query terms that are broadcast; beyond it the join on terms is shuffled.
BROADCAST_TERMS = 200_000


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def part(k1: float = 1.5, b: float = 0.75) -> Column:
    """What a term adds to a chunk's score, of the columns times, idf, tf, dl and avgdl."""
    norm = F.when(F.col("avgdl") > 0, k1 * (1 - b + b * F.col("dl") / F.when(F.col("avgdl") > 0, F.col("avgdl")))).otherwise(k1)
    return F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)


def idf_of(df: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf) of document frequencies (term, df) in a corpus of ``stats`` (n_docs)."""
    return df.crossJoin(F.broadcast(stats)).select("term", "df", idf(F.col("n_docs"), F.col("df")).alias("idf"))  # stats is one row


@dataclass
class Index:
    """``split`` (key, dl, tokens) of all chunks and ``stats`` (n_docs, avgdl; one row)."""

    split: DataFrame
    stats: DataFrame

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """(key, dl, term, tf), of ``terms`` (term) only if given: others are left out before they are counted."""
        each = self.split.select(*KEY, "dl", F.explode("tokens").alias("term"))
        if terms is not None:
            each = each.join(terms, "term", "left_semi")
        return each.groupBy(*KEY, "dl", "term").agg(F.count("*").alias("tf"))

    def terms(self, postings: DataFrame | None = None) -> DataFrame:
        """(term, df, idf) of all terms, or of those in ``postings``."""
        return idf_of((self.postings() if postings is None else postings).groupBy("term").agg(F.count("*").alias("df")), self.stats)


def build(chunks: DataFrame, text: str = "text", keep: Callable[[DataFrame, str], DataFrame] | None = None) -> Index:
    """The index of chunks. ``keep(table, label)`` may store the tokens, so that what reads them does not cut and
    split the texts again (:func:`passages.sources.scratch.written`)."""
    words = tokens(F.col(text))
    split = chunks.select(*KEY, F.size(words).alias("dl"), words.alias("tokens"))
    split = keep(split, "tokens") if keep else split
    return Index(split, split.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl")))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, times): repeated terms count as often as they occur."""
    return queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def scores(index: Index, queries: DataFrame, k1: float = 1.5, b: float = 0.75, among: DataFrame | None = None) -> DataFrame:
    """(query_id, key, score) of chunks that hold a query term, or of those in ``among`` (query_id, key); all others score 0."""
    terms = query_terms(queries)
    few = terms.count() <= BROADCAST_TERMS
    small = F.broadcast if few else lambda x: x
    postings = index.postings(small(terms.select("term").distinct()))
    known = index.terms(postings)
    if among is not None:  # document frequencies are of all chunks
        postings = postings.join(among.select(*KEY).distinct(), KEY, "left_semi")
    weighed = postings.join(small(terms), "term")
    if among is not None:
        weighed = weighed.join(among, ["query_id", *KEY], "left_semi")
    weighed = weighed.join(small(known), "term").crossJoin(F.broadcast(index.stats))
    return weighed.groupBy("query_id", *KEY).agg(F.sum(part(k1, b)).alias("score"))


def bm25_top_k(index: Index, queries: DataFrame, k: int = 5, **how) -> DataFrame:
    """(query_id, key, score, rank): exactly k chunks for each query; those of score 0 fill up in the order of
    keys. The first k chunks by key suffice: those among them that are no hits follow all hits."""
    best = top_k(scores(index, queries, **how), ["query_id"], "score", KEY, k).drop("rank")
    first = index.split.select(*KEY).orderBy(*KEY).limit(k)
    fill = queries.select("query_id").distinct().crossJoin(F.broadcast(first)).withColumn("score", F.lit(0.0))  # k rows
    # a filled row that is also a hit loses against itself
    both = best.unionByName(fill).groupBy("query_id", *KEY).agg(F.max("score").alias("score"))
    return top_k(both, ["query_id"], "score", KEY, k)


def idf_report(index: Index, chosen: DataFrame) -> DataFrame:
    """(term, idf) of chosen terms, 0 if absent."""
    known = index.terms(index.postings(chosen.select("term").distinct()))
    return chosen.join(known, "term", "left").select("term", F.coalesce("idf", F.lit(0.0)).alias("idf"))


def idf_extremes(index: Index, n: int = 5) -> DataFrame:
    """The ``n`` lowest idf by (idf, term) as (term, idf, ties), and a row with a null term for how many terms tie at the highest."""
    terms = index.terms()
    low = terms.orderBy("idf", "term").limit(n).select("term", "idf", F.lit(None).cast("long").alias("ties"))
    top = terms.groupBy("idf").agg(F.count("*").alias("ties")).orderBy(F.col("idf").desc()).limit(1)
    return low.unionByName(top.select(F.lit(None).cast("string").alias("term"), "idf", "ties"))
