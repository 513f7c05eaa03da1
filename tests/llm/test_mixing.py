"""Mixes against a row-by-row version, and the targets against exact fractions."""

import hashlib
import random
import re
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from passages.llm import mixing

WORD = "[^\x20\x09-\x0d]+"


def targets(sizes, weights, share=Fraction(3, 2), epochs=2):
    """One source after another is clamped while any is above."""
    full, budget = set(), share * sum(sizes.values())
    while True:
        free = {s for s in sizes if s not in full}
        rest = budget - sum(epochs * sizes[s] for s in full)
        total = sum(weights[s] for s in free)
        new = {s for s in free if total and rest * weights[s] / total > epochs * sizes[s]}
        if not new:
            return {s: Fraction(epochs * sizes[s]) if s in full else Fraction(rest * weights[s], total) if total else Fraction(0) for s in sizes}
        full |= new


def brute(rows):
    size = lambda t: len(re.findall(WORD, t or ""))
    order = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(size(r[1]) for r in rows if r[2] == s) for s in order}
    want = targets(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)})
    out = []
    for s in order:
        goal = int(want[s])
        mine = sorted((r for r in rows if r[2] == s), key=lambda r: int(hashlib.md5(":".join(["0", *([str(r[0])] if r[0] is not None else []), str(size(r[1]))]).encode()).hexdigest()[:15], 16))
        whole, left = divmod(goal, sizes[s]) if sizes[s] else (0, 0)
        for r in mine:
            part = min(left, size(r[1]))
            left -= part
            out.append((str(r[0]), size(r[1]), sizes[s], round(float(want[s]), 6), whole * size(r[1]) + part))
    return sorted(out)


def corpus(seed):
    rnd = random.Random(seed)
    text = lambda: " ".join(["wörd"] * rnd.choice([1, 2, 5, 40, 300]))
    rows = [(i, text(), rnd.choice(["hot"] * 8 + ["a", "b", "é", "Z", "", None, "z", "zz"])) for i in range(160)]
    rows += [rows[0]] * 3 + [(None, "a\tb\x0bc d\r\n", "a"), (None, "x y", "a"), (161, None, "a"), (162, "", "nothing"), (163, " \n\t", "nothing"), (164, "one " * 3000, "b"), (165, "w", "\U00010000"), (166, "w", "￿")]
    return rows


def frame(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, target string, size int").repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/m")
    return spark.read.parquet(f"{tmp_path}/m")


def seen(df):
    return sorted((str(r.doc_id), r["size"], r.source_size, round(r.target, 6), r.taken) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_row_by_row(spark, tmp_path, seed):
    rows = corpus(seed)
    docs = frame(spark, tmp_path, rows)
    want = brute(rows)
    assert seen(mixing.report(docs)) == want
    assert seen(mixing.report(docs, mixing.Settings(cell=1))) == want  # ranges down to single rows
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/m/*.parquet'")
    c = ["doc_id", "size", "source_size", "target", "taken"]
    assert sorted((str(r[0]), r[1], r[2], round(r[3], 6), r[4]) for r in duckdb.sql(mixing.REPORT_SQL).project(", ".join(c)).fetchall()) == want


def test_the_mix_holds_what_is_taken(spark, tmp_path):
    docs = frame(spark, tmp_path, corpus(3))
    mix = mixing.mixture(docs).withColumn("w", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)))
    assert mix.columns == [*docs.columns, "mix_repetition", "w"]
    got = {r.source: r.w for r in mix.groupBy("source").agg(F.sum("w").alias("w")).collect()}
    want = {r.source: int(r.target) for r in mixing.report(docs).select("source", "target").distinct().collect()}
    assert got == {s: n for s, n in want.items() if n}
    cut = mix.groupBy("source").agg(F.countDistinct("doc_id").alias("n")).count()
    assert cut and mix.filter("mix_repetition > 1").isEmpty()  # two epochs at most


def test_given_weights(spark, tmp_path):
    docs = frame(spark, tmp_path, [(1, "a " * 100, "p"), (2, "a " * 100, "q"), (3, "a " * 100, "r"), (4, "a " * 100, None)])
    weights = spark.createDataFrame([("p", 1.0), ("q", 8.0), (None, 1.0), ("other", 5.0)], "source string, weight double")
    got = {r.source: (r.target, r.taken) for r in mixing.taken(docs, mixing.Settings(share=1.0), weights).collect()}
    assert got == {"p": (100.0, 100), "q": (200.0, 200), "r": (0.0, 0), None: (100.0, 100)}
    most = {r.source: r.target for r in mixing.taken(docs, mixing.Settings(share=9.0)).collect()}
    assert set(most.values()) == {200.0}


def test_no_documents(spark, tmp_path):
    docs = frame(spark, tmp_path, corpus(1)).limit(0)
    assert mixing.report(docs).count() == 0 and mixing.mixture(docs).count() == 0
    assert seen(mixing.report(frame(spark, tmp_path, [(1, None, None), (2, "", "a")]))) == [("1", 0, 0, 0.0, 0), ("2", 0, 0, 0.0, 0)]
