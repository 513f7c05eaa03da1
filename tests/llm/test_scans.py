"""PII and secret spans against plain regular expressions; licence digests."""

import hashlib
import os
import random
import re

import pytest

from passages.llm import licenses, pii, secrets

RAW = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    t = [int(c) for c in reversed(d)]
    return (sum(t[::2]) + sum(sum(divmod(2 * x, 10)) for x in t[1::2])) % 10 == 0


def base_pii(text):
    out = []
    for no, (kind, rx) in enumerate(RAW.items()):
        for m in re.finditer(rx, text or ""):
            digits = re.sub(r"[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), no, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


def base_secrets(text):
    rules = [
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
        ("hex", re.compile("[0-9a-f]+"), 0, 24),
    ]
    out = [(m.start(), no, k, m.end()) for no, (k, rx, g, n) in enumerate(rules) for m in rx.finditer(text or "") if len(m.group(g)) >= n]
    return [(k, s, e) for s, _, k, e in sorted(out)]


def texts(seed, n=400):
    rng = random.Random(seed)
    bits = ["a@b.co", "@", "x.y+z@d-e.f.g", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8.9", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", "+1 (555) 010-2030", "+1((", "+49 30", "é", "字", "😀", " ", ".", "-", "\n", "12", "token = abc123def", "Token=token: abcdefgh", "secret: 'xy'", "api_key=\"Zz9/+=\"", "APIKEY:token=longenough", "AKIA" + "B" * 16, "AKIAAKIA", "deadbeef" * 3, "deadbeef" * 2, "password", "passwd:", "IBAN DE89370400440532013000", "acct no. 12345678", "http://u:p@h.example/x", "ssn 123-45-6789"]
    return [None, "", " ", "a" * 5000 + "@" + "b." * 3000, "1" * 20000, "+" + "1-" * 5000] + ["".join(rng.choice(bits) + rng.choice(["", " ", ""]) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def test_pii_base_spans():
    for t in texts(1, 4000):
        assert [s for s in pii.find_spans(t) if s[0] in pii.BASE_KINDS] == base_pii(t), t


def test_pii_extras_and_redaction():
    found = pii.find_spans("IBAN DE89370400440532013000, acct no. 12345678, ssn 123-45-6789 http://u:p@h.example/x")
    assert [k for k, *_ in found if k in pii.EXTRA_KINDS] == ["iban", "account", "ssn", "url"]
    assert pii.redact("mail a@b.co now", pii.find_spans("mail a@b.co now")) == "mail <EMAIL> now"
    assert pii.redact(None, []) is None


def test_pii_report(spark):
    rows = list(enumerate(texts(2))) + [(0, None), (7, "a@b.co")]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, spans string")
    got = sorted((r.doc_id, r.base_sha256, r.n_email + r.n_ip + r.n_card + r.n_phone) for r in pii.pii_report(docs).collect())
    assert got == sorted((i, digest(base_pii(t)), len(base_pii(t))) for i, t in rows)


def test_secret_report(spark, tmp_path):
    rows = list(enumerate(texts(3))) + [(0, None), (7, "token: abcdefghi"), (7, "token: abcdefghi")]
    spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, spans int").write.parquet(f"{tmp_path}/d")
    got = sorted((r.doc_id, r.base_sha256, r.n_assign, r.n_access, r.n_hex) for r in secrets.secret_report(spark.read.parquet(f"{tmp_path}/d")).collect())
    want = [(i, base_secrets(t)) for i, t in rows]
    assert got == sorted((i, digest(s), *[sum(k == x for k, *_ in s) for x in ("assign", "access", "hex")]) for i, s in want)


def test_secret_trigrams():
    assert secrets.trigram_clauses("[0-9a-f]+") == []
    assert secrets.trigram_clauses("abc?d") == [frozenset({"abc", "bcd"}), frozenset({"abd"})]
    assert secrets.trigram_clauses("ab[0-9]cd") == []
    for rule in secrets.RULES:
        for text in texts(4):
            if text and (m := re.search(rule.pattern, text)) and (clauses := secrets.trigram_clauses(rule.pattern)):
                low = m.group().lower()
                assert any(all(t in low for t in c) for c in clauses)


def test_licences(spark):
    mit = licenses.KNOWN["MIT"]
    docs = [(1, mit), (2, "Copyright (c) 2020 Some One\n\n" + mit.upper().replace(" ", "\n")), (3, mit + " more"), (4, None), (5, ""), (6, licenses.KNOWN["WTFPL"].replace("LICENSE", "Licence")), (1, mit)]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, digest string")
    got = sorted((r.doc_id, r.licence_id or "-") for r in licenses.licence_report(df).collect())
    assert got == [(1, "MIT"), (1, "MIT"), (2, "MIT"), (3, "-"), (4, "-"), (5, "-"), (6, "WTFPL")]
    assert licenses.licence_report(df.limit(0)).count() == 0


def test_titled_files_and_spellings(spark):
    known = licenses.KNOWN
    docs = [(1, "MIT License\n\nCopyright (c) 2021 A B\n\n" + known["MIT"]), (2, "The ISC License (ISC)\n\n" + known["ISC"]), (3, "BSD 3-Clause License\n\nCopyright (c) 2020, C\nAll rights reserved.\n\n" + known["BSD-3-Clause"].replace("copyright holder", "copyright owner")), (4, known["WTFPL"].replace("distribute", "redistribute")), (5, "MIT License\n\nand\n" + known["MIT"]), (6, "ISC License\n" + known["ISC"])]
    got = {r.doc_id: r.licence_id for r in licenses.licence_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: "MIT", 2: None, 3: "BSD-3-Clause", 4: None, 5: None, 6: "ISC"}
    same = spark.createDataFrame([("licence licence sub license", "license license sublicense")], "a string, b string").select(licenses.unified(licenses.F.col("a")).alias("a"), licenses.unified(licenses.F.col("b")).alias("b")).first()
    assert same.a == same.b


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no folder of licence texts")
def test_a_folder_of_full_texts(spark):
    table = licenses.licence_files(spark, "/usr/share/common-licenses")
    names = {r.licence_id: r.text for r in table.collect()}
    gpl = names["GPL-3"]
    docs = spark.createDataFrame([(1, gpl.upper()), (2, re.sub(r"\s+", "\n", names["Apache-2.0"])), (3, gpl[:-40])], "doc_id long, text string")
    got = {r.doc_id: r.licence_id for r in licenses.licence_lookup(docs, table).collect()}
    assert got[1] in {n for n, t in names.items() if t == gpl} and got[2] == "Apache-2.0" and got[3] is None


def test_secret_index_serves_other_rules_and_columns_stay(spark, tmp_path):
    rows = [(i, t, i, "x") for i, t in enumerate(texts(5))] + [(0, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, row_id int, spans string").write.parquet(f"{tmp_path}/d")
    read = lambda: spark.read.parquet(f"{tmp_path}/d")
    index = secrets.trigram_index(read(), secrets.trigrams_of(secrets.RULES))
    rules = tuple(r for r in secrets.RULES if r.kind in ("access", "assign"))
    found = secrets.secret_spans(read(), rules=rules, index=index)
    assert sorted(found.columns) == ["doc_id", "row_id", "spans", "text"]
    seen = lambda df: sorted(((r.doc_id, r.row_id, r.text, str(r.spans)) for r in df.collect()), key=str)
    assert seen(found) == seen(secrets.secret_spans(read(), rules=rules)) and found.count() == len(rows)


def test_capitals_after_an_iban():
    for t in ("IBAN DE89 3704 0044 0532 0130 00 PAYEE", "IBAN DE89 3704 0044 0532 0130 00 PAY TO ME", "IBAN: DE89370400440532013000 OK"):
        (s,) = [x for x in pii.find_spans(t) if x[0] == "iban"]
        assert t[s[1] : s[2]].replace(" ", "") == "DE89370400440532013000"
    assert not [x for x in pii.find_spans("IBAN DE89 3704 0044 0532 0130 01 PAYEE") if x[0] == "iban"]


def test_pii_extra_kinds_against_plain_expressions():
    rx = {
        "ssn": re.compile(r"(?:ssn|SSN|Ssn)[ :#=]{0,4}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])"),
        "account": re.compile(r"(?:account|ACCOUNT|Account|acct|ACCT|Acct)(?:[ ]?(?i:number|num|no|nr)\.?)?[ :#=]{1,4}([0-9](?:[ -]?[0-9]){5,16})(?![0-9])"),
        "url": re.compile(r"(?:https?|ftp|ssh)://[A-Za-z0-9._~%+-]+(?::[^\s@/]*)?@[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s<>\"']*)?"),
    }
    rng = random.Random(8)
    bits = ["ssn ", "SSN: ", "123-45-6789", "666-12-1234", "account ", "Acct no. ", "account number: ", "1234 5678", "12345", "http://", "ssh://", "u:p@", "me@", "h.example", "/p?q", " ", ",", "x"]
    for _ in range(5000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(1, 9)))
        found = pii.find_spans(t)
        for kind, r in rx.items():
            want = [(m.start(1 if r.groups else 0), m.end()) for m in r.finditer(t) if kind != "ssn" or m[1][:3] not in ("000", "666")]
            assert [(s, e) for k, s, e in found if k == kind] == want, (kind, t)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, spans string, row_id int")
    for report in (pii.pii_report, secrets.secret_report, licenses.licence_report):
        assert report(none).count() == 0
    assert pii.pii_redacted(none).columns == none.columns and pii.pii_redacted(none).count() == 0
    assert secrets.secret_spans(none).count() == 0
