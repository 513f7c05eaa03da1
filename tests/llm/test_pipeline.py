"""The pipeline, stage by stage, against brute force on each stage's own input."""

import corpus_pipeline as cp
from passages.llm import packing, pii
from passages.llm.common import written
from tests.llm.test_decontamination import brute as leaks
from tests.llm.test_near_duplicates import brute as components

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}

    docs = written(cp.language_id(spark, docs, D), "t")
    kept = {r.doc_id for r in docs.collect()}
    assert kept == {i for i, r in before.items() if any(c.isalpha() for c in r.text)}  # every text here is in a known language

    docs = written(cp.near_dedup(spark, docs, D), "t")
    after = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(after) == [d for d, _, _, first in components([(i, before[i].text) for i in kept], 5) if first]

    docs = written(cp.decontaminate(spark, docs, D), "t")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    leaked = {x[0] for x in leaks(after.items(), items)}
    assert {r.doc_id for r in docs.collect()} == set(after) - leaked

    docs = written(cp.redact(spark, docs, D), "t")
    for r in docs.collect():
        assert r.text == pii.redact(after[r.doc_id], pii.find_spans(after[r.doc_id])) and r.n_chars == len(r.text)
        assert docs.columns == cp.COLUMNS

    rows = cp.pack(spark, docs, D).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    assert sum(r.length for r in rows) == sum(r.length for r in packing.pieces(docs).collect())
    assert [name for name, _ in cp.STAGES] == ["language_id", "near_dedup", "decontaminate", "redact", "pack"]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_id int, node string, family int, score string"
PLAIN = "Every evening the old ferry leaves the northern quay with crates of apples, two bicycles and a sleeping dog, and nobody asks where it goes."
MAIL = "Write to jane.doe@example.org before noon, the office by the harbour closes early in winter and the clerk leaves with the last tram."


def odd_documents(spark):
    """Nulls in every column, empty and blank texts, ties, repeated rows, a very long text and columns whose names the stages use themselves."""
    extra = (1, "n", 2, "s")
    rows = [(1, PLAIN, "en", "a", len(PLAIN), *extra), (1, PLAIN, "en", "a", len(PLAIN), *extra), (2, PLAIN, None, None, None, *extra), (None, MAIL, "en", "b", 1, *extra)]
    rows += [(3, None, "en", "a", None, *extra), (4, "", None, "a", 0, *extra), (5, " \n\t ", "en", None, 4, *extra), (6, MAIL + " Again.", "en", "b", 1, None, None, None, None)]
    rows += [(7, " ".join(f"w{i % 977}x{i} and the" for i in range(60_000)), "en", "a", 0, *extra)]
    return written(spark.createDataFrame(rows, SCHEMA), "odd")


def test_stages_on_odd_documents(spark):
    docs = odd_documents(spark)
    texts = lambda df: sorted((r.doc_id if r.doc_id is not None else -1, (r.text or "")[:20]) for r in df.collect())
    known = cp.language_id(spark, docs, D)
    assert texts(known) == [(-1, MAIL[:20]), (1, PLAIN[:20]), (1, PLAIN[:20]), (2, PLAIN[:20]), (6, MAIL[:20]), (7, "w0x0 and the w1x1 an")]
    single = cp.near_dedup(spark, docs, D)
    assert texts(single) == [(-1, MAIL[:20]), (1, PLAIN[:20]), (3, ""), (4, ""), (5, " \n\t "), (7, "w0x0 and the w1x1 an")]
    clean = cp.decontaminate(spark, docs, D)
    assert clean.count() == docs.count()
    tagged = cp.redact(spark, docs, D)
    want = sorted((r.doc_id or -1, r.text and pii.redact(r.text, pii.find_spans(r.text))) for r in docs.filter("text is not null").collect())
    assert sorted((r.doc_id or -1, r.text) for r in tagged.filter("text is not null").collect()) == want and not any("jane.doe" in t for _, t in want)
    assert all(r.n_chars == len(r.text) for r in tagged.filter("text is not null").collect()) and tagged.filter("text is null").count() == 1
    for df in (known, single, clean, tagged):
        assert df.columns == cp.COLUMNS
    packed = cp.pack(spark, docs, D)
    assert packed.filter("piece = 0").count() == docs.count()
    ends = {}
    for r in packed.orderBy("sequence_id", "offset").collect():
        assert r.offset == ends.get(r.sequence_id, 0) and r.offset + r.length <= 4096
        ends[r.sequence_id] = r.offset + r.length


def test_stages_on_an_empty_table(spark):
    docs = written(odd_documents(spark).limit(0), "none")
    for _, stage in cp.STAGES:
        assert stage(spark, docs, D).count() == 0


def test_stages_on_a_clean_document_beside_a_benchmark_passage(spark):
    item = max((r.text for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()), key=len)
    docs = written(spark.createDataFrame([(1, PLAIN, "en", "a", 1), (2, f"{PLAIN} {item} {MAIL}", "en", "a", 1), (None, item, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long"), "leaks")
    assert [r.doc_id for r in cp.decontaminate(spark, docs, D).collect()] == [1]
