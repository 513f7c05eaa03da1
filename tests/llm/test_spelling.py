"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from passages.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, s=spelling.Settings()):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if s.every and h % s.every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= s.shortest and k >= s.least}
    form, count = {}, {}
    for w in n:
        near = sorted((-n[v], v) for v in n if one_edit(w, v))
        count[w] = len(near)
        form[w] = near[0][1] if near and -near[0][0] >= s.ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], count[w], n[form[w]] if form[w] else None))
    return sorted(out)


def corpus(seed):
    rnd = random.Random(seed)
    bases = ["".join(rnd.choice("aabé×") for _ in range(rnd.randint(3, 7))) for _ in range(25)]
    words = []
    for base in bases:
        for _ in range(12):
            w, at = base, rnd.randint(0, len(base))
            w = rnd.choice([w, w[:at] + rnd.choice("aabÉé") + w[at:], w[:at] + w[at + 1 :], w[:at] + rnd.choice("aBé") + w[at + 1 :]])
            words += [w] * rnd.choice([1, 2, 3, 8, 30])
    rnd.shuffle(words)
    rows = [(i if i % 11 else None, " ".join(words[i * 20 : i * 20 + 20])) for i in range(len(words) // 20)]
    return [*rows, *rows[:3], (3, None), (4, ""), (5, "$$ 12 \n a"), (6, "aaaaa Aaaaaa AAAAAAA aaaaaé " * 5), (7, "long" * 5000), (8, "Éaaaaa éaaaaaĀaaaaaa " * 4)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int")


@pytest.mark.parametrize("seed,every", [(1, 97), (2, 3), (3, 0)])
def test_all_pairs(spark, seed, every):
    s = spelling.Settings(every=every)
    want = brute(corpus(seed), s)
    assert sum(r[1] is not None for r in want) > 20 and any(r[2] not in (r[0], r[1]) for r in want)
    got = sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.report(frame(spark, corpus(seed)), s).collect())
    assert got == want


def test_chains_are_followed_to_the_last(spark):
    forms = spark.createDataFrame([(f"w{i:02}", f"w{i + 1:02}") for i in range(37)] + [("v", "w20")], "word string, form string")
    assert {tuple(r) for r in spelling.roots(forms).select("word", "root").collect()} == {(f"w{i:02}", "w37") for i in range(37)} | {("v", "w37")}


def test_ties_go_by_code_points(spark):
    rows = [(1, "abcdé " * 6 + "abcdz " * 6 + "abcd÷ " * 3)]
    got = {r.word: (r.form, r.n_near) for r in spelling.report(frame(spark, rows), spelling.Settings(every=0)).collect()}
    assert got == {"abcdé": (None, 2), "abcdz": (None, 2), "abcd÷": ("abcdz", 2)}


def test_no_words(spark):
    assert spelling.report(frame(spark, corpus(1)).limit(0)).count() == 0
    assert spelling.report(frame(spark, [(1, None), (2, "a b c")])).count() == 0
