"""BM25, vectors, fusion, IVF, reranking, prompts and measures on small cases with known answers."""

import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from passages.functions import models
from passages.operators import ann, answer, evaluate, expand, fusion, lexical, prompt, vectors
from passages.operators.topk import top_k
from passages.plans import standins

CHUNKS = [(1, 0, "the xx-1 error code"), (1, 1, ""), (2, 0, "notes and the export of notes"), (2, 1, "the xx-1 error code"), (3, 0, "plans"), (3, 1, None)]
QUERIES = [(1, "what is xx-1?"), (2, "notes notes export"), (3, "unknown"), (4, "!!"), (5, "the")]


def bm25(chunks, query, k1=1.5, b=0.75):
    import re

    docs = [re.findall("[a-z0-9]+(?:-[a-z0-9]+)*", (t or "").lower()) for *_, t in chunks]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d))
    out = []
    for (d, c, _), words in zip(chunks, docs):
        tf, s = Counter(words), 0.0
        for t in re.findall("[a-z0-9]+(?:-[a-z0-9]+)*", query.lower()):
            if tf[t]:
                s += math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(words) / avg))
        out.append((-round(s, 9), d, c))
    return sorted(out)


@pytest.mark.parametrize("partitions", [1, 7])
def test_bm25_with_zero_fill(spark, partitions):
    chunks = spark.createDataFrame(CHUNKS, "doc_id int, chunk_no int, text string").repartition(partitions)
    queries = spark.createDataFrame(QUERIES, "query_id int, text string")
    for k in (1, 4, 10):
        got = lexical.bm25_top_k(lexical.build(chunks), queries, k).orderBy("query_id", "rank").collect()
        for q, text in QUERIES:
            assert [(-round(r.score, 9) or 0, r.doc_id, r.chunk_no) for r in got if r.query_id == q] == [(s or 0, d, c) for s, d, c in bm25(CHUNKS, text)[:k]]


def test_bm25_of_an_empty_corpus(spark):
    chunks = spark.createDataFrame([], "doc_id int, chunk_no int, text string")
    index = lexical.build(chunks)
    assert index.stats.first() == (0, 0.0)
    assert lexical.bm25_top_k(index, spark.createDataFrame(QUERIES, "query_id int, text string")).count() == 0


def vecs(spark, rows, name="vec_id"):
    return spark.createDataFrame([(i, [float(x) for x in v] if v is not None else None) for i, v in rows], f"{name} long, embedding array<float>")


def test_knn_equals_the_native_form(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = list(enumerate(rng.standard_normal((60, 5)).round(2).tolist())) + [(100, [0] * 5), (101, [1, 0, 0, 0, 0]), (102, [2, 0, 0, 0, 0]), (103, [-1, 0, 0, 0, 0]), (104, None)]
    q = vecs(spark, [(1, [1, 0, 0, 0, 0]), (2, [0] * 5), (3, rng.standard_normal(5).tolist()), (4, None)], "query_id")
    for parts in (1, 6):
        v = vecs(spark, rows).repartition(parts)
        for k in (1, 3, 100):
            rank = lambda df: [(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in df.orderBy("query_id", "rank").collect()]
            want = rank(vectors.knn_native(v, q, k))
            assert rank(vectors.knn(v, q, k)) == want
            monkeypatch.setattr(vectors, "BLOCK", 1)
            assert rank(vectors.knn(v, q, k)) == want
            monkeypatch.undo()
    with pytest.raises(Exception, match="dimensions"):
        vectors.knn(vecs(spark, [(1, [1, 2])]), q, 1).collect()


def test_granted_knn_has_no_most_values(spark):
    n = 10_050
    v = spark.range(n).selectExpr("id vec_id", "CAST(id AS INT) label", "array(1F, CAST(id AS FLOAT)) embedding")
    q = spark.range(n).selectExpr("id query_id", "array(1F, 0F) embedding")
    got = vectors.granted_knn(v, q, spark.range(n).selectExpr("id query_id", "CAST(id AS INT) label"), "label").collect()
    assert sorted((r.query_id, r.vec_id, r["rank"]) for r in got) == [(i, i, 1) for i in range(n)]


def test_granted_knn_in_small_cells(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL", 7)
    rng = np.random.default_rng(4)
    m, label = rng.integers(-2, 3, (300, 3)).astype(float), np.where(np.arange(300) < 200, 0, rng.integers(1, 5, 300))
    v = spark.createDataFrame([(i, int(label[i]) if i % 50 else None, m[i].tolist() if i % 41 else None) for i in range(300)], "vec_id long, label int, embedding array<double>")
    q = vecs(spark, [(i, rng.standard_normal(3)) for i in range(30)] + [(99, None)], "query_id")
    allowed = [(i, g) for i in range(30) for g in ([0, 2], [0, 1, 2, 3], [4, 4, 77], [])[i % 4]] + [(99, 0), (500, 0), (3, None), (3, 1 << 40)]
    grants = spark.createDataFrame(allowed, "query_id long, label long")
    got = {(r.query_id, r.vec_id): (r["rank"], round(r.score, 9)) for r in vectors.granted_knn(v, q, grants, "label", 6).collect()}
    pairs = v.join(grants.distinct(), "label").join(q.select("query_id", F.col("embedding").alias("q")), "query_id").filter("embedding IS NOT NULL AND q IS NOT NULL")
    want = top_k(pairs.select("query_id", "vec_id", vectors.cosine(F.col("embedding"), F.col("q")).alias("score")), ["query_id"], "score", ["vec_id"], 6).collect()
    assert got == {(r.query_id, r.vec_id): (r["rank"], round(r.score, 9)) for r in want} and len(got) == len(want) > 100
    assert vectors.granted_knn(v, q, grants.limit(0), "label").count() == 0 == vectors.granted_knn(v.limit(0), q, grants, "label").count()


def test_ties_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(1, float(i % 3), i) for i in range(40)], "q int, s double, key int")
    want = [r.key for r in top_k(df, ["q"], "s", ["key"], 5).orderBy("rank").collect()]
    assert want == [2, 5, 8, 11, 14] == [r.key for r in top_k(df.repartition(9), ["q"], "s", ["key"], 5).orderBy("rank").collect()]


def test_fusion(spark):
    lists = spark.createDataFrame([(1, "a", -1.0), (1, "b", -2.0), (2, "a", 0.0), (3, "a", 4.0), (3, "b", 1.0)], "query_id int, key string, score double")
    assert [r.norm for r in fusion.normalize(lists).orderBy("query_id", "key").collect()] == [1.0, 2.0, 0.0, 1.0, 0.25]
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, key string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id int, key string, rank int")
    got = {r.key: r.score for r in fusion.rrf([a, b], ["key"]).collect()}
    assert got == pytest.approx({"x": 1 / 61, "y": 1 / 62 + 1 / 61, "z": 1 / 62})


def test_ivf_recall_on_clusters(spark):
    rng = np.random.default_rng(42)
    centres = rng.standard_normal((60, 16)) * 6
    rows = list(enumerate((centres[rng.integers(60, size=1500)] + rng.standard_normal((1500, 16))).tolist()))
    v, q = vecs(spark, rows), vecs(spark, [(i, (centres[i] + rng.standard_normal(16)).tolist()) for i in range(20)], "query_id")
    c = ann.centroids(v, 60)
    index = ann.assigned(v, c)
    assert index.count() == 1500
    dial = ann.recall_dial(index, c, q, vectors.knn(v, q, 10), [1, 6, 60]).orderBy("n_probe").collect()
    assert dial[0].recall <= dial[1].recall <= dial[2].recall == 1.0 and dial[2].scanned == 1500
    assert dial[1].recall >= 0.9 and dial[1].scanned <= 0.2 * 1500
    with pytest.raises(ValueError):
        ann.centroids(v, 0)


def _files_read(df):
    """The numbers of files that the scans of a partitioned table read, from the executed plan."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        todo += [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else []
        if name == "FileSourceScanExec" and "cluster_id" in node.relation().partitionSchema().simpleString():
            found.append(node.metrics().apply("numFiles").value())
    return found


def test_stored_ivf_reads_the_probed_clusters_only(spark, tmp_path):
    rng = np.random.default_rng(42)
    centres = rng.standard_normal((40, 16)) * 6
    which = np.where(np.arange(1200) % 3 == 0, 0, rng.integers(40, size=1200))
    v = vecs(spark, list(enumerate((centres[which] + rng.standard_normal((1200, 16))).tolist())) + [(5000, None)])
    c = ann.centroids(v, 40)
    index, centers = ann.saved(ann.assigned(v, c), c, f"{tmp_path}/ivf", rows=20)
    q = vecs(spark, [(1, centres[3].tolist())], "query_id")
    files = {r.n_probe: r.files for r in ann.files_read(index, centers, q, [1, 5, 40]).collect()}
    for n in (1, 5, 40):
        found = ann.ivf_search(index, centers, q, 10, n)
        assert "dynamicpruning" in found._jdf.queryExecution().toString().lower()
        assert _files_read(found) == [files[n]]
        plain = ann.ivf_search(ann.assigned(v, c), c, q, 10, n)
        rows = lambda df: [(r.vec_id, round(r.score, 9)) for r in df.orderBy("rank").collect()]
        assert rows(found) == rows(plain)
    assert files[1] < files[5] < files[40] and files[40] > index.select("cluster_id").distinct().count()  # a large cluster has several


def test_replies_and_variants(spark):
    hits = spark.createDataFrame([(q, r, f"t{r}") for q in (1, 2, 3, 4) for r in (1, 2, 3, 4)], "query_id int, rank int, text string")
    replies = spark.createDataFrame([(1, "3, 3 then 99 and 1"), (2, "none"), (3, "123456789012345678901234567890 2")], "query_id int, reply string")
    got = expand.apply_reply(hits, replies, 3).orderBy("query_id", "new_rank").collect()
    assert [[r.rank for r in got if r.query_id == q] for q in (1, 2, 3, 4)] == [[3, 1, 2], [1, 2, 3], [2, 1, 3], [1, 2, 3]]
    df = spark.createDataFrame([("q", "- one\n\n• two \n-\n three"), ("q", None)], "q string, r string")
    assert [r.v for r in df.select(expand.variants(F.col("q"), F.col("r")).alias("v")).collect()] == [["q", "one", "two", "", "three"], ["q"]]


def test_parents_take_the_last_body(spark):
    sections = spark.createDataFrame([("s", 0, "H", "old body"), ("s", 1, "H", "new body here"), ("s", 2, "G", "x")], "source string, section_no int, heading string, body string")
    hits = spark.createDataFrame([(1, "s", "H", "new")], "query_id int, source string, heading string, text string")
    r = expand.parents(hits, sections).first()
    assert (r.parent, r.chunk_words, r.parent_words, r.ratio) == ("new body here", 1, 3, 3)


def test_prompts_and_citations(spark):
    queries = spark.createDataFrame([(1, "q1"), (2, "q2")], "query_id int, text string")
    hits = spark.createDataFrame([(1, 2, None, "b"), (1, 1, "s", "a")], "query_id int, rank int, source string, text string")
    got = {r.query_id: r.prompt for r in prompt.build_prompt(queries, hits).collect()}
    assert got == {1: "Context:\n[1] (source: s)\na\n\n[2] (source: ?)\nb\n\nQuestion: q1", 2: "Context:\n\n\nQuestion: q2"}
    answers = spark.createDataFrame([(1, "see [1], [9] and [1]"), (2, None)], "query_id int, answer string")
    assert {(r.n, r.times, r.source) for r in prompt.citations(answers, hits).collect()} == {(1, 2, "s"), (9, 1, None)}
    assert [(r.query_id, r.n) for r in prompt.dangling(answers, hits).collect()] == [(1, 9)]


def test_snippets(spark):
    text = "alpha " * 30 + "the export of notes " + "omega " * 30
    show = lambda t, q, width=75: prompt.snippets(spark.createDataFrame([(1, t)], "query_id int, text string"), spark.createDataFrame([(1, q)], "query_id int, text string"), width).first().snippet
    got = show(text, "how do I export my notes?", 40)
    assert "export of notes" in got and got.startswith("...") and got.endswith("...") and len(got) == 46
    assert show("short  x", "x") == "short x" and show(None, "x") is None and show("", None) == ""
    assert show(text, "zzz", 10) == text[:10] + "..." and show(text, None, 10) == text[:10] + "..."
    assert show("key " + "b " * 60, "keys") == ("key " + "b " * 60)[:75] + "..."  # found without its s, at the start
    assert show("b " * 60 + "key", "the key") == "..." + ("b " * 60 + "key")[-75:]
    assert show("one " + "b " * 60 + "one two one " + "c " * 60, "one two", 30)[3:-3].count("one two one") == 1


def test_measures(spark):
    gold = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "query_id int, source string")
    hits = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (2, 1, "x"), (2, 3, "b"), (3, 1, "x")], "query_id int, rank int, source string")
    ranks = evaluate.first_hit_rank(gold, hits)
    assert {r.query_id: r.first_rank for r in ranks.collect()} == {1: 1, 2: 3, 3: 0}
    r = evaluate.retrieval_quality(ranks).first()
    assert (r.n, r.hit_rate, r.mrr) == (3, round(2 / 3, 6), round((1 + 1 / 3) / 3, 6))
    sweep = {r.k: r.hit_rate for r in evaluate.retrieval_quality(evaluate.first_hit_rank(gold, evaluate.at_several_k(hits, [1, 3]), ("k",)), ("k",)).collect()}
    assert sweep == {1: round(1 / 3, 6), 3: round(2 / 3, 6)}
    answers = spark.createDataFrame([(1, "It IS Twelve", "twelve"), (2, "x", ""), (3, None, "y")], "query_id int, answer string, fact string")
    assert [r.correct for r in evaluate.answer_correct(answers).orderBy("query_id").collect()] == [True, True, False]


def test_models(spark):
    df = spark.createDataFrame([("a b",), (None,), ("",)], "t string")
    got = [r.v for r in df.select(models.embed_udf(lambda: standins.hashing_embedder(8))(F.col("t")).alias("v")).collect()]
    assert got[1] is None and sum(x * x for x in got[0]) == pytest.approx(1, abs=1e-5) and got[2] == [0.0] * 8
    assert df.limit(1).select(models.generate_udf(lambda: lambda s, u, n: u.upper())(F.col("t")).alias("o")).first().o == "A B"
    overlap = models.score_udf(lambda q, t: pd.Series([float(len(set(a.split()) & set(b.split()))) for a, b in zip(q, t)]))
    assert df.limit(1).select(overlap(F.lit("b c"), F.col("t")).alias("o")).first().o == 1.0


def test_answers_and_drafts(spark):
    texts = ["invoices are due in thirty days", "exports hold all notes", "the xx-1 code means no network"]
    calls = spark.sparkContext.accumulator(0)

    def make_embed():
        inner = standins.hashing_embedder(64)

        def embed(batch, input_type):
            calls.add(len(batch))
            return inner([t + (" invoices" if input_type == "document" and t == "draft" else "") for t in batch], input_type)

        return embed

    passages = answer.embedded(spark.createDataFrame([(i, f"s{i}", t) for i, t in enumerate(texts)], "vec_id long, source string, text string"), make_embed, "document")
    questions = spark.createDataFrame([(1, "when are invoices due"), (2, "what means xx-1"), (3, None)], "query_id long, text string")
    got = {(r.query_id, r["rank"]): r.vec_id for r in answer.retrieve(questions, passages, make_embed, 1).collect()}
    assert got == {(1, 1): 0, (2, 1): 2}
    before = calls.value
    answers, hits = answer.answer(questions, passages, make_embed, lambda: lambda system, user, n: f"{n}|{system[:8]}|{user.splitlines()[1]} [1]", 1, 99)
    said = {r.query_id: r.answer for r in answers.collect()}
    assert said[1] == "99|Use only|[1] (source: s0) [1]" and said[3] == "99|Use only| [1]" and calls.value == before + 2  # each question once
    cited = {(r.query_id, r.source) for r in prompt.citations(answers, hits).collect()}
    assert (1, "s0") in cited and (2, "s2") in cited and (3, None) in cited
    drafted = answer.hyde(questions.filter("query_id = 2"), passages, lambda: lambda s, u, n: "draft", make_embed, 1).collect()
    assert [(r.query_id, r.vec_id) for r in drafted] == [(2, 0)]


LETTERS = lambda: lambda texts, kind: [[float(t.count(c)) for c in "abcd"] for t in texts]


def test_phrasings_are_searched_each_by_its_own_vector(spark):
    docs = spark.createDataFrame([(i, LETTERS()([t], "")[0]) for i, t in enumerate(["aaa", "bbb", "ccc", "ab", "dd", "aaa"])], "vec_id long, embedding array<float>")
    questions = spark.createDataFrame([(1, "a"), (2, "c"), (3, None), (4, "d")], "query_id long, text string")
    replies = spark.createDataFrame([(1, "- bb\n\n\u2022 ab "), (2, ""), (3, "d"), (9, "a")], "query_id long, reply string")
    got = {}
    for r in answer.by_phrasings(questions, replies, docs, LETTERS, 3).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 6)))
    assert got[1] == [(0, 1.0), (5, 1.0), (3, 1.0)]  # the question found 3 too, below the best, so it was seen before 1
    assert got[2][0] == (2, 1.0) and got[3][0] == (4, 1.0) and got[4][0] == (4, 1.0) and set(got) == {1, 2, 3, 4}
    said = answer.multi_query(questions, docs, lambda: lambda system, user, n: "bb", LETTERS, 2)
    assert {r.vec_id for r in said.filter("query_id = 4").collect()} == {1, 4}


def test_context_is_embedded_and_the_bare_text_found(spark):
    chunks = spark.createDataFrame([("s1", 0, "aa"), ("s2", 0, "aa"), ("s1", 1, None)], "source string, chunk_no int, text string")
    docs = spark.createDataFrame([("s1", "bbbbb"), ("s2", None)], "source string, text string")
    index = answer.contextual_index(chunks, docs, F.col("document"), LETTERS)
    questions = spark.createDataFrame([(1, "abbb"), (2, "a"), (3, "b")], "query_id long, text string")
    hits = answer.retrieve(questions, index, LETTERS, 1, key=["source", "chunk_no"]).join(index, ["source", "chunk_no"])
    assert {(r.query_id, r.source, r.text) for r in hits.collect()} == {(1, "s1", "aa"), (2, "s2", "aa"), (3, "s1", None)}  # a chunk without text has its context's vector


def test_parents_of_found_windows(spark):
    sections = spark.createDataFrame([("s", 0, "x", "aa bb cc"), ("s", 1, "y", "dd"), ("s", 2, "x", "late body here too")], "source string, section_no int, heading string, body string")
    windows = spark.createDataFrame([("s", 0, 0, "x", "aa bb"), ("s", 0, 1, "x", "cc"), ("s", 1, 0, "y", "dd")], "source string, section_no int, chunk_no int, heading string, text string")
    questions = spark.createDataFrame([(1, "c"), (2, "d"), (3, None)], "query_id long, text string")
    got = answer.found_parents(questions, answer.embedded(windows, LETTERS, "document"), sections, LETTERS, 1)
    assert {(r.query_id, r.section_no, r.chunk_no, r.parent, r.ratio) for r in got.collect()} == {(1, 0, 1, "late body here too", 4), (2, 1, 0, "dd", 1)}


def test_containing(spark):
    docs = spark.createDataFrame([(1, "xa b c d e f gz  h"), (2, "a b c d e f g"), (3, "b c d e f"), (4, None), (5, "")], "doc_id int, text string")
    items = spark.createDataFrame([(1, "a b c d e f g"), (2, "c d"), (3, "q r s t u v w"), (4, None), (5, "a b  c d e f g")], "query_id int, item string")
    assert sorted((r.doc_id, r.query_id) for r in evaluate.containing(docs, items).collect()) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 2)]
