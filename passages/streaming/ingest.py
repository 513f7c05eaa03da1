"""Documents that keep arriving: the same cleaning and chunking on a stream; both are stateless per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from passages.functions.text import clean
from passages.operators.chunk import chunk_words


def chunk_stream(docs: DataFrame, path: str, checkpoint: str, size: int = 120, overlap: int = 20) -> StreamingQuery:
    """Appends the chunks of all documents that are there to Parquet at ``path``; a restart goes on after them."""
    chunks = chunk_words(docs.withColumn("text", clean(F.col("text"))), size, overlap)
    return chunks.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
