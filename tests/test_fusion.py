"""Fused first hits against the fusion of whole lists."""

import random

import pytest

from passages.operators import answer, fusion, postings
from passages.plans import standins
from tests.test_search import bm25


def brute(v, w, top, k=60):
    """v, w: scores of every key in two lists."""
    norm = lambda s: {x: (y / max(s.values()) if max(s.values()) else 0.0) for x, y in s.items()}
    rank = lambda s: {x: i + 1 for i, x in enumerate(sorted(s, key=lambda x: (-round(s[x], 9), x)))}
    nv, nw, rv, rw = norm(v), norm(w), rank(v), rank(w)
    methods = {"vector": nv, "keyword": nw, "rrf": {x: 1 / (k + rv[x]) + 1 / (k + rw[x]) for x in v}}
    for name, share in (("blend50", 0.5), ("blend90", 0.9)):
        methods[name] = {x: share * nv[x] + (1 - share) * nw[x] for x in v}
    return {m: sorted((-round(s, 9) or 0.0, x) for x, s in by.items())[:top] for m, by in methods.items()}


def lists(seed, n=120, queries=6):
    rnd = random.Random(seed)
    out = {}
    for q in range(queries):
        v = {i: round(rnd.uniform(-0.2, 1), rnd.choice([1, 4])) for i in range(n)}
        w = {i: rnd.choice([0.0, 0.0, 0.0, 1.0, rnd.uniform(0, 30)]) for i in range(n)}
        if q == 1:  # one order is the other turned round: the first rows hold no winner of a blend
            v, w = {i: 1 - i / n for i in range(n)}, {i: 1 + i / n for i in range(n)}
        if q == 2:
            w = dict.fromkeys(w, 0.0)
        if q == 3:
            v = dict.fromkeys(v, 0.25)
        if q == 4:
            v = {i: -1 - i / n for i in range(n)}  # a negative largest turns the order round
        out[q] = v, w
    return out


def source(spark, rows, name):
    table = spark.createDataFrame([(q, i, s) for q, both in rows.items() for i, s in both[name].items()], "query_id long, key long, score double")
    return fusion.list_source(table, "key")


@pytest.mark.parametrize("depth,top", [(4, 3), (100, 10)])
def test_whole_lists(spark, depth, top):
    rows = lists(depth)
    asked = spark.createDataFrame([(q,) for q in rows], "query_id long")
    got = fusion.exact_top(source(spark, rows, 0), source(spark, rows, 1), asked, ["key"], top, depth=depth).orderBy("query_id", "method", "rank").collect()
    for q, (v, w) in rows.items():
        for method, want in brute(v, w, top).items():
            seen = [(-round(r.score, 9) or 0.0, r.key) for r in got if r.query_id == q and r.method == method]
            assert [x[1] for x in seen] == [x[1] for x in want] and [x[0] for x in seen] == pytest.approx([x[0] for x in want]), (q, method)


def test_documents(spark, tmp_path):
    rnd = random.Random(5)
    texts = [(i, " ".join(rnd.choices([f"w{j}" for j in range(40)], k=rnd.randint(1, 12)))) for i in range(90)]
    texts += [(100, texts[0][1]), (101, texts[0][1]), (102, "")]
    asked = [(1, "w1 w2 w3"), (2, "w7"), (3, "nothing known"), (4, texts[0][1])]
    make = lambda: standins.hashing_embedder(16)
    docs = answer.embedded(spark.createDataFrame(texts, "doc_id long, text string"), make, "document")
    q = answer.embedded(spark.createDataFrame(asked, "query_id long, text string"), make, "query")
    index = postings.build(docs.selectExpr("doc_id", "0 chunk_no", "text"), f"{tmp_path}/i", shard=8)
    got = fusion.exact_top(fusion.vector_source(docs, q, "doc_id"), fusion.keyword_source(index, q), q, ["doc_id"], 3, depth=8).orderBy("query_id", "method", "rank").collect()
    embed = standins.hashing_embedder(16)
    for i, text in asked:
        a = embed([text], "query")[0]
        v = {d: sum(x * y for x, y in zip(a, embed([t], "document")[0])) for d, t in texts}
        w = {d: -s for s, d, _ in bm25([(d, 0, t) for d, t in texts], text)}
        for method, want in brute(v, w, 3).items():
            seen = [(-r.score, r.doc_id) for r in got if r.query_id == i and r.method == method]
            assert [x[1] for x in seen] == [x[1] for x in want] and [x[0] for x in seen] == pytest.approx([x[0] for x in want], abs=1e-6), (i, method)


def test_no_queries(spark):
    rows = lists(1, 5, 1)
    assert fusion.exact_top(source(spark, rows, 0), source(spark, rows, 1), spark.createDataFrame([], "query_id long"), ["key"]).count() == 0
