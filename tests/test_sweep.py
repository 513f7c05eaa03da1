"""The sweep over chunk sizes and weights against the plain operators, one configuration at a time."""

import numpy as np
from pyspark.sql import functions as F

from passages.operators import chunk, lexical, sweep

CONFIGS, WEIGHTS = [(6, 2), (10, 0)], [0.0, 0.4, 1.0]


def counted():
    """A vector of how many words begin with each of eight letters."""
    return lambda texts, kind: [[float(sum(w[0] == c for w in t.split())) for c in "abcdefgh"] for t in texts]


def corpus(spark):
    rng = np.random.default_rng(3)
    words = ["apple", "bee", "cow", "dog", "elk", "fig", "gnu", "hat"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 40)))) for i in range(30)] + [(30, None), (31, ""), (32, "apple bee " * 9), (33, "apple bee " * 9)]
    asked = [(1, "apple bee apple"), (2, "gnu hat"), (3, None), (4, ""), (5, "zebra"), (6, "apple bee apple")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, text string")


def expected(spark, docs, asked, k):
    """Every score in plain Python over the chunks of each configuration alone."""
    embed, out = counted(), []
    for size, overlap in CONFIGS:
        chunks = [((r.doc_id, r.chunk_no), r.text) for r in chunk.chunk_words(docs, size, overlap).collect()]
        index = lexical.build(chunk.chunk_words(docs, size, overlap))
        keyword = {(r.query_id, (r.doc_id, r.chunk_no)): r.score for r in lexical.scores(index, asked).collect()}
        v = np.array(embed([t for _, t in chunks], ""))
        v = v / np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) == 0, 1, n)
        for q in asked.collect():
            x = np.zeros(8) if q.text is None else np.array(embed([q.text], "")[0])
            cosine = v @ (x / (np.linalg.norm(x) or 1))
            bm25 = np.array([keyword.get((q.query_id, key), 0.0) for key, _ in chunks])
            for weight in WEIGHTS:
                score = weight * cosine / (cosine.max() or 1) + (1 - weight) * bm25 / (bm25.max() or 1)
                first = sorted(range(len(chunks)), key=lambda i: (-round(score[i], 9), chunks[i][0]))[:k]
                out += [(size, overlap, weight, q.query_id, rank + 1, *chunks[i][0], round(score[i], 6)) for rank, i in enumerate(first)]
    return sorted(out)


def test_sweep_equals_one_configuration_at_a_time(spark, monkeypatch):
    docs, asked = corpus(spark)
    wanted = expected(spark, docs, asked, 4)
    for block, cells in ((4096, 1 << 20), (2, 16)):  # several passes, a few chunks at a time
        monkeypatch.setattr(sweep, "_CELLS", cells)
        chunks = sweep.stored_chunks(docs, CONFIGS, counted)
        assert set(chunks.columns) == {"size", "overlap", "doc_id", "chunk_no", "dl", "tokens", "embedding"}
        got = sweep.swept(chunks, asked, WEIGHTS, counted, 4, block)
        assert sorted((r["size"], r.overlap, r.weight, r.query_id, r["rank"], r.doc_id, r.chunk_no, round(r.score, 6)) for r in got.collect()) == wanted


def test_nothing_to_sweep(spark):
    docs, asked = corpus(spark)
    chunks = sweep.stored_chunks(docs, CONFIGS, counted)
    assert sweep.swept(chunks, asked.limit(0), WEIGHTS, counted).count() == 0
    assert sweep.swept(chunks.limit(0), asked, WEIGHTS, counted).count() == 0
    silent = sweep.swept(chunks, asked.filter("query_id = 3"), WEIGHTS, counted, 2)
    assert {(r.doc_id, r.score) for r in silent.collect()} == {(0, 0.0)}  # all score 0, so the first by key


def test_one_cut_serves_all_configurations(spark):
    docs, _ = corpus(spark)
    cut = chunk.chunk_configs(docs.withColumn("size", F.lit("mine")), CONFIGS)
    for size, overlap in CONFIGS:
        got = cut.filter((F.col("size") == size) & (F.col("overlap") == overlap)).select("doc_id", "chunk_no", "text")
        assert sorted(map(tuple, got.collect())) == sorted((r.doc_id, r.chunk_no, r.text) for r in chunk.chunk_words(docs, size, overlap).collect())
