"""Repeated strings against a plain dictionary of all of them; suffix order against sorting."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np

from passages.llm import suffix_dedup as sd

D = "/root/testdata/sf0.001"
#: Every 400-byte window of every document, in hexadecimal; nothing of the operator's method.
WINDOWS_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 399)) AS i FROM d)),
r AS (SELECT doc_id, i, i > lag(i, 1, -401) OVER (PARTITION BY doc_id ORDER BY i) + 400 AS new
      FROM w WHERE s IN (SELECT s FROM w GROUP BY s HAVING count(*) > 1)),
n AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r),
g AS (SELECT doc_id, min(i) AS start, max(i) + 400 AS "end" FROM n GROUP BY doc_id, run),
p AS (SELECT doc_id, start, "end", lag("end", 1, 0) OVER (PARTITION BY doc_id ORDER BY start) AS past FROM g),
k AS (SELECT doc_id, count(*) AS n_spans, sum("end" - start) AS n_removed, max("end") AS past,
        string_agg(substr(h, 2 * past + 1, 2 * (start - past)), '' ORDER BY start) AS kept FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(past, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


def brute(docs, span):
    raws = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(r[i : i + span] for _, r in raws for i in range(len(r) - span + 1))
    out = []
    for d, r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - span + 1):
            if seen[r[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        kept = bytes(b for b, g in zip(r, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, span):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(80)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [text(span // 3), text(span // 2), text(span // 4), "ab" * span, "z" * (2 * span)]
    docs = []
    for _ in range(40):
        parts = [text(rng.randint(0, span)) for _ in range(rng.randint(1, 3))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            parts.insert(rng.randint(0, len(parts)), rng.choice(passages)[rng.choice([0, 0, 3]) :])
        docs.append("".join(parts))
    docs += [None, "", "q" * 450, "q" * 420 + "".join(chr(122 - i // 40) for i in range(800)), docs[0], docs[1][: len(docs[1]) // 2], docs[2][5:], "y" + docs[3] + "x", docs[4] + docs[4]]
    return [(i % 45, t) for i, t in enumerate(docs)]


def frame(spark, tmp_path, docs):
    spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, anchor int").write.mode("overwrite").parquet(f"{tmp_path}/d")
    return spark.read.parquet(f"{tmp_path}/d")


def result(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def test_report_equals_dictionary(spark, tmp_path):
    docs = corpus(1, 400)
    assert result(sd.report(frame(spark, tmp_path, docs))) == brute(docs, 400)
    assert sd.report(frame(spark, tmp_path, docs).limit(0)).count() == 0


def test_given_documents_equal_every_window(spark):
    """Also that the benchmark's passages of over 50 words, which documents share, have under 400 bytes: only longer strings around them go."""
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{D}/{name}.parquet'")
    got = result(sd.report(spark.read.parquet(f"{D}/documents.parquet")))
    assert got == sorted(con.sql(WINDOWS_SQL).fetchall(), key=str) and sum(r[2] > 0 for r in got) > 10
    sizes = con.sql("SELECT octet_length(encode(text)) FROM benchmark WHERE len(string_split(text, ' ')) > 50").fetchall()
    assert sizes and max(sizes) < (400,)


def test_removed_runs_and_kept_texts(spark, tmp_path):
    """A passage of over 50 words goes where it has 400 bytes, and stays where it has not; sizes are of the input either way."""
    rng = random.Random(8)
    text = lambda n, size: " ".join("".join(rng.choice("abcdefghiê") for _ in range(size)) for _ in range(n))
    long, short = text(60, 9), text(60, 3)
    docs = [(i, text(80, 7) + "<" * (i + 1) + p + ">" * (i + 1) + text(80, 7)) for i, p in enumerate([long, long, short, short])] + [(4, None), (5, "")]
    df = frame(spark, tmp_path, docs)
    got, kept = {r.doc_id: r for r in sd.report(df).collect()}, {r.doc_id: bytes(r.kept) for r in sd.kept_texts(df).collect()}
    assert len(got) == len(kept) == 6 and len(short.encode()) < 398
    for d, t in docs:
        raw, runs = (t or "").encode(), [(x.start, x.end) for x in got[d].removed]
        assert got[d].n_bytes == len(raw) and got[d].n_spans == len(runs) and got[d].n_removed == sum(e - b for b, e in runs)
        assert hashlib.sha256(kept[d]).hexdigest() == got[d].kept_sha256
        if d > 1:
            assert not runs and kept[d] == raw
        else:
            assert [raw[b:e].decode() for b, e in runs] == ["<" + long + ">"]
            assert kept[d] == raw.replace(("<" + long + ">").encode(), b"")


def test_dealt_anchors(spark, tmp_path):
    for seed, s in ((2, sd.Settings(span=40, gram=20, cell=4, bucket=50)), (3, sd.Settings(span=24, gram=16, cell=2, bucket=7))):
        docs = corpus(seed, s.span)
        assert result(sd.report(frame(spark, tmp_path, docs)) if s.span == 400 else sd.repeats_removed(frame(spark, tmp_path, docs), s)) == brute(docs, s.span)


def test_suffix_order():
    rng = random.Random(4)
    for alphabet in (b"ab", b"abc\xff", bytes(range(1, 256))):
        raw = bytes(rng.choice(alphabet) for _ in range(700))
        data = np.frombuffer(raw + b"\0\1" + b"\0" * 48, dtype=np.uint8)
        got = sd.suffix_order(data, np.arange(701), 40)
        assert sorted(got) == list(range(701))
        cut = [bytes(data[i : i + 40]) for i in got]
        assert cut == sorted(cut)


def test_anchors_do_not_depend_on_the_step(monkeypatch):
    raw, s = bytes(random.Random(5).choice(b"abcd") for _ in range(5000)), sd.Settings(span=60, gram=30)
    whole = sd.anchors(raw, s)
    monkeypatch.setattr(sd, "_STEP", 97)
    assert all(np.array_equal(a, b) for a, b in zip(whole, sd.anchors(raw, s)))
