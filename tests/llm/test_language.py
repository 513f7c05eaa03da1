"""Language identification: fused evidence against a plain per-row version, and edge cases."""

import re

import numpy as np
from pyspark.sql import functions as F

from passages.llm import language
from passages.llm.common import with_row_id

EN = "the cat sat on the mat and the dog ran with the bird over there"
DE = "der hund und die katze sind nicht auf der straße und ein vogel singt"


def docs(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, language int").write.mode("overwrite").parquet(f"{tmp_path}/d")
    return spark.read.parquet(f"{tmp_path}/d")


def test_fusion_and_edges(spark, tmp_path):
    rows = [(i, EN + f" x{i}", "en", "www.a.uk", 1) for i in range(20)] + [(100 + i, DE + f" y{i}", "de", "b.example.de", 1) for i in range(20)]
    rows += [(200, None, "en", None, 1), (201, "", None, "c", 1), (202, "12 34 %%", "de", "c", 1), (203, DE * 200, "en", "c", 1), (204, EN, None, None, 1), (204, EN, None, None, 1)]
    got = {r.doc_id: r for r in language.identify(docs(spark, tmp_path, rows)).collect()}
    assert len(got) == 45
    assert all(got[i].language == "en" and got[i].accepted for i in range(20))
    assert all(got[100 + i].language == "de" and got[100 + i].accepted for i in range(20))
    assert [got[i].accepted for i in (200, 201, 202, 203, 204)] == [False, False, False, True, True]
    assert got[203].language == "de" and got[204].language == "en"
    assert [r.doc_id for r in language.accepted(docs(spark, tmp_path, rows)).filter("doc_id >= 200").orderBy("doc_id").collect()] == [203, 204, 204]


def test_host_prior_decides_without_text_evidence(spark, tmp_path):
    rows = [(i, EN, "en", "en.example.com", 1) for i in range(60)] + [(100 + i, DE, "de", "de.example.org", 1) for i in range(60)]
    rows += [(300, "zzqq", None, "en.example.com", 1), (301, "zzqq", None, "de.example.org", 1), (302, "zzqq", None, "new.example.org", 1)]
    got = {r.doc_id: r for r in language.identify(docs(spark, tmp_path, rows)).filter("doc_id >= 300").collect()}
    assert got[300].language == "en" and got[301].language == "de" and got[302].language == "de"


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = language.identify(d, s=language.Settings(fit_rows=20))
    assert found.filter("text_language = lang").count() >= 0.99 * d.count()
    assert found.filter("not accepted").count() == 0


def test_no_labels(spark, tmp_path):
    got = {r.doc_id: (r.language, r.accepted) for r in language.identify(docs(spark, tmp_path, [(1, EN, None, None, 1), (2, None, None, None, 1)])).collect()}
    assert got == {1: (None, True), 2: (None, False)}
    assert language.identify(docs(spark, tmp_path, []).limit(0)).count() == 0


def test_trigrams():
    assert len(language.trigrams("a", 1 << 14)) == 1 and len(language.trigrams(" 12 ", 1 << 14)) == 0
    assert list(language.trigrams("AB  cd", 1 << 14)) == list(language.trigrams("ab cd", 1 << 14))


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = language.page_report(pages)
    assert found.count() == pages.count() and found.filter("declared is null").count() == 0
    assert found.filter("accepted and language = left(declared, 2)").count() >= 0.95 * pages.count()
    odd = spark.createDataFrame([(1, None, None), (2, "not an address", "<p>x</p>")], "page_id long, url string, html string")
    assert [tuple(r) for r in language.page_evidence(odd).collect()] == [(1, None, None, None), (2, "x", None, None)]


def brute(rows, langs, model, s):
    """Fused evidence row by row, from the text models on."""
    own = []
    for _, text, _, _ in rows:
        at = language.trigrams(text, s.buckets)
        mean = model[at].astype(float).sum(axis=0) / max(1, len(at))
        p = np.exp(min(len(at), s.effective) * (mean - mean.max()))
        own.append((len(at), mean, p / p.sum() if len(at) else np.zeros(len(langs))))
    keys = [(h := (r[3] or "").lower(), ".".join(h.split(".")[-2:]) if "." in h else "", h.split(".")[-1] if "." in h else "") for r in rows]
    above = [lambda k: 0, lambda k: k[2], lambda k: k[1:], lambda k: k]
    out = {}
    for (n, mean, p), key, (doc_id, _, tag, _) in zip(own, keys, rows):
        if not n:
            out[doc_id] = ("und", 0.0, "und", False)
            continue
        prior = np.full(len(langs), 1 / len(langs))
        for level, of in enumerate(above):
            others = sum((q for (_, _, q), other in zip(own, keys) if of(other) == of(key)), np.zeros(len(langs))) - p
            k = s.shrink if level else len(langs)
            prior = (others + k * prior) / (others.sum() + k)
        log = min(n, s.effective) * mean + np.log(prior)
        tagged = re.match(r"\s*([A-Za-z]{2,3})(?![A-Za-z0-9])", tag or "")
        for said, trust in ((tagged and tagged[1].lower(), s.declared_trust), (language.SUFFIX_LANGUAGE.get(key[2]), s.suffix_trust)):
            if said in langs:
                log += [np.log(trust if x == said else (1 - trust) / (len(langs) - 1)) for x in langs]
        post = np.exp(log - log.max())
        post /= post.sum()
        out[doc_id] = (langs[post.argmax()], round(post.max(), 6), langs[mean.argmax()], bool(post.max() >= s.least and mean.max() >= -np.log(s.buckets)))
    return out


def test_fusion_equals_a_row_by_row_version(spark, tmp_path):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    hosts = ["www.a.example.de", "b.example.de", "c.es", "x.co.uk", "src1", None, "d.example.de"]
    tags = [lambda x: x, lambda x: x + "-XX", lambda x: x.upper() + "_Latn", lambda x: None, lambda x: "free text", lambda x: "de"]
    rows = [(r.doc_id, r.text[: (40, 9, 400)[i % 3]], tags[i % 6](r.lang), hosts[i * i % 7]) for i, r in enumerate(d)]
    rows += [(1000, None, "en", "c.es"), (1001, "12", None, None), (1002, "q", None, "alone.example.com"), (1003, "x", "en-GB", "c.es")]
    stored, s = docs(spark, tmp_path, [(*r, 7) for r in rows]), language.Settings(fit_rows=60)
    langs, model = language.fit(with_row_id(stored, "__row"), "text", "lang", s)
    assert langs == ["de", "en", "es", "fr"]
    want = brute(rows, langs, model, s)
    for r in language.identify(stored, s=s).collect():
        assert (r.language, r.text_language, r.accepted) == (want[r.doc_id][0], *want[r.doc_id][2:]) and abs(r.posterior - want[r.doc_id][1]) < 2e-6


def test_every_declared_language_has_a_model(spark, tmp_path):
    tags = [a + b for a in "abcdefghij" for b in "klmnopqrs"]
    rows = [(i, " ".join(f"{tag}{tag[::-1]}{'aeiou'[(i + j) % 5]}" for j in range(12)), tag, f"h{i % 7}.example.org", 1) for i, tag in enumerate(t for t in tags for _ in range(3 if t == "ak" else 2))]
    rows += [(1000, "akka akkao " * 30000, None, None, 1)]
    stored = docs(spark, tmp_path, rows)
    langs, model = language.fit(with_row_id(stored, "__row"), "text", "lang", language.Settings(block=8))
    assert langs == tags and np.allclose(np.exp(model.astype(float)).sum(axis=0), 1, atol=1e-3)
    assert np.array_equal(model, language.fit(with_row_id(stored, "__row"), "text", "lang", language.Settings())[1])
    got = {r.doc_id: r for r in language.identify(stored).collect()}
    assert all(got[i].language == tag == got[i].text_language and got[i].accepted for i, _, tag, _, _ in rows if tag)
    assert got[1000].language == "ak"
    want = brute([r[:4] for r in rows], langs, model, language.Settings())
    assert all((r.language, r.text_language, r.accepted) == (want[i][0], *want[i][2:]) and abs(r.posterior - want[i][1]) < 2e-6 for i, r in got.items())


def test_tags(spark):
    said = spark.createDataFrame([("de-AT",), (" PT_br",), ("english",), ("x",), (None,), ("eng",)], "t string")
    assert [r.p for r in said.select(language.primary(F.col("t")).alias("p")).collect()] == ["de", "pt", None, None, None, "eng"]
