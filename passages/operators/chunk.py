"""Cutting documents into chunks. All are projections and explodes without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passages.functions.text import WS, lines, strip, words


def checked(size: int, overlap: int) -> None:
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError(f"need size > 0 and 0 <= overlap < size, not {size} and {overlap}")


def _windows(word_list: Column, size: Column, overlap: Column) -> Column:
    step = size - overlap
    count = F.ceil(F.greatest(F.size(word_list) - size, F.lit(0)) / step).cast("int") + 1
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.array_join(F.slice(word_list, i * step + 1, size), " "))


def chunk_words(docs: DataFrame, size: int = 120, overlap: int = 20, text: str = "text") -> DataFrame:
    """Replaces ``text`` by its windows of ``size`` words, each starting ``size - overlap`` after the last, and adds
    ``chunk_no`` from 0; the last window reaches the end. Documents without words give no rows."""
    checked(size, overlap)
    split = docs.withColumn("__w", words(F.col(text))).filter(F.size("__w") > 0)
    others = [c for c in docs.columns if c not in (text, "chunk_no")]
    return split.select(*others, F.posexplode(_windows(F.col("__w"), F.lit(size), F.lit(overlap))).alias("chunk_no", text))


def chunk_paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Paragraphs between exact double line feeds, stripped, empty ones dropped, with ``chunk_no``."""
    parts = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda x: x != "")
    others = [c for c in docs.columns if c not in (text, "chunk_no")]
    return docs.select(*others, F.posexplode(parts).alias("chunk_no", text))


def chunk_sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """Sections of Markdown: ``section_no``, ``heading`` and ``body``. A heading line is one to six ``#`` and white space;
    text before the first has the heading ``(intro)``; sections with an empty body are dropped."""
    others = [c for c in docs.columns if c not in (text, "section_no", "heading", "body")]
    split = docs.withColumn("__l", lines(F.col(text))).filter(F.col(text).isNotNull())
    is_heading = f"^#{{1,6}}{WS}"
    heads = F.filter(F.sequence(F.lit(1), F.size("__l")), lambda i: F.element_at("__l", i).rlike(is_heading))
    split = split.withColumn("__h", F.concat(F.array(F.lit(0)), heads)).withColumn("__e", F.concat(heads, F.array(F.size("__l") + 1)))

    def section(i: Column) -> Column:
        start, end = F.element_at("__h", i), F.element_at("__e", i)
        heading = F.when(start == 0, "(intro)").otherwise(strip(F.regexp_replace(F.element_at("__l", F.greatest(start, F.lit(1))), "^#+", "")))
        return F.struct(heading.alias("heading"), strip(F.array_join(F.slice("__l", start + 1, end - start - 1), "\n")).alias("body"))

    found = F.filter(F.transform(F.sequence(F.lit(1), F.size("__h")), section), lambda s: s["body"] != "")
    return split.select(*others, F.posexplode(found).alias("section_no", "s")).select(*others, "section_no", "s.heading", "s.body")


def chunk_section_windows(docs: DataFrame, size: int = 14, overlap: int = 4, text: str = "text") -> DataFrame:
    """Word windows inside sections, keyed by (section_no, chunk_no)."""
    return chunk_words(chunk_sections(docs, text), size, overlap, "body").withColumnRenamed("body", text)


def chunk_sweep(docs: DataFrame, configs: list[tuple[int, int]], text: str = "text") -> DataFrame:
    """For each (size, overlap): number of chunks and their mean length in words."""
    for size, overlap in configs:
        checked(size, overlap)
    table = docs.sparkSession.createDataFrame(configs, "size int, overlap int")
    n = docs.select(F.size(words(F.col(text))).alias("n")).filter("n > 0").crossJoin(F.broadcast(table))  # as long as the given list
    step = F.col("size") - F.col("overlap")
    starts = F.sequence(F.lit(0), F.ceil(F.greatest(F.col("n") - F.col("size"), F.lit(0)) / step).cast("int"))
    each = n.select("size", "overlap", F.explode(F.transform(starts, lambda i: F.least(F.col("size"), F.col("n") - i * step))).alias("len"))
    return each.groupBy("size", "overlap").agg(F.count("*").alias("n_chunks"), F.round(F.avg("len"), 6).alias("avg_words"))


def chunk_configs(docs: DataFrame, configs: list[tuple[int, int]], text: str = "text") -> DataFrame:
    """:func:`chunk_words` under each (size, overlap), which become columns, in one scan; each text is split into words once."""
    for size, overlap in configs:
        checked(size, overlap)
    table = docs.sparkSession.createDataFrame(configs, "size int, overlap int")
    others = [c for c in docs.columns if c not in (text, "chunk_no", "size", "overlap")]
    split = docs.select(*others, words(F.col(text)).alias("__w")).filter(F.size("__w") > 0).crossJoin(F.broadcast(table))  # as long as the given list
    return split.select("size", "overlap", *others, F.posexplode(_windows(F.col("__w"), F.col("size"), F.col("overlap"))).alias("chunk_no", text))


def straddling(chunks: DataFrame, first: str, second: str, text: str = "text") -> DataFrame:
    """Chunks that hold both markers, with the parts ``before`` and ``after`` the second one's start."""
    at = F.instr(F.col(text), second)
    both = chunks.filter(F.col(text).contains(first) & F.col(text).contains(second))
    return both.withColumn("before", F.substring(F.col(text), F.lit(1), at - 1)).withColumn("after", F.substring(F.col(text), at, F.length(text)))


def sections_about(sections: DataFrame, part: str) -> DataFrame:
    """Sections whose heading holds a substring."""
    return sections.filter(F.col("heading").contains(part))
