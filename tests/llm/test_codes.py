"""Codes of vectors against all distances, in Python's integers."""

import hashlib
import math

import numpy as np
import pytest

from passages.llm import codes

NAN, INF = float("nan"), float("inf")


def brute(rows, s=codes.Settings()):
    """rows of (vec_id, embedding, label)"""
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = len(kept[0][1]) if kept else 0
    kept = [r for r in kept if len(r[1]) == dim]
    cells = [[math.floor(s.scale * float(np.float32(x))) for x in r[1]] for r in kept]
    wide = -(-dim // s.parts)
    cells = [c + [0] * (wide * s.parts - dim) for c in cells]
    parts = [[c[p * wide : (p + 1) * wide] for p in range(s.parts)] for c in cells]
    books = [[c[p] for c in parts[: s.entries]] for p in range(s.parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda p, x: min(range(len(books[p])), key=lambda e: (far(x, books[p][e]), e))
    for _ in range(s.rounds):
        for p in range(s.parts):
            at = [nearest(p, c[p]) for c in parts]
            for e in range(len(books[p])):
                mine = [c[p] for c, a in zip(parts, at) if a == e]
                if mine:
                    books[p] = [*books[p][:e], [sum(x) // len(mine) for x in zip(*mine)], *books[p][e + 1 :]]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, total = [], {}
    for r, c in zip(kept, parts):
        at = [nearest(p, x) for p, x in enumerate(c)]
        error = sum(far(c[p], books[p][a]) for p, a in enumerate(at))
        total[r[2]] = total.get(r[2], 0) + error
        out.append([r[0], bytes(at).hex(), error, r[2]])
    return sorted((str(i), code, error, total[label], sha) for i, code, error, label in out)


def corpus(seed, dim=16, n=150):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(np.float32(x)) for x in rng.standard_normal(dim) * rng.choice([0.001, 0.1, 1])], [None, 0, 1, 1, 1][i % 5]) for i in range(40, 40 + n)]
    rows += [(1, None, 1), (2, [], 1), (3, [None] + [1.0] * (dim - 1), 1), (4, [NAN] * dim, 0), (5, [INF] + [0.0] * (dim - 1), 0), (6, [-INF] * dim, None)]
    rows += [(7, [0.0] * dim, 0), (7, [0.0] * dim, 0), (8, [-0.0] * dim, 1), (9, [1.0] * dim, None), (10, [1.0] * (dim - 1), 1), (None, [0.5] * dim, 2), (None, [0.25] * dim, 2)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, code string, error int")


def seen(df):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


@pytest.mark.parametrize("dim", [16, 8, 12, 5])
def test_all_distances(spark, dim):
    rows = corpus(dim, dim)
    assert seen(codes.report(frame(spark, rows).repartition(5))) == brute(rows)


def test_few_vectors_and_none(spark):
    rows = corpus(1)
    assert seen(codes.report(frame(spark, rows[:3]))) == brute(rows[:3])
    assert codes.report(frame(spark, rows).limit(0)).count() == 0
    assert codes.report(frame(spark, rows[-12:-8])).count() == 0  # none that takes part


def test_other_settings(spark):
    s = codes.Settings(parts=2, entries=60, rounds=2, ways=3)
    assert seen(codes.report(frame(spark, corpus(2)), s)) == brute(corpus(2), s)
    with pytest.raises(ValueError):
        codes.report(frame(spark, corpus(2)), codes.Settings(entries=257))


def test_too_large_components_are_left_out(spark):
    rows = [(1, [1.0] * 8, 0), (2, [1e30] * 8, 0), (3, [-30000.0] * 8, 0)]
    assert [r[0] for r in seen(codes.report(frame(spark, rows)))] == ["1", "3"]
    assert seen(codes.report(frame(spark, rows))) == brute([rows[0], rows[2]])


def test_sums_dealt_over_tasks(spark):
    rows = spark.createDataFrame([(i, None if i % 3 else i % 2, i) for i in range(200)], "k int, g int, v int")
    want = codes.with_total(rows, "g", "v", "s").select("k", "g", "v", "s").collect()
    assert sorted(map(tuple, want), key=str) == sorted(map(tuple, codes.with_total(rows, "g", "v", "s", most=0).select("k", "g", "v", "s").collect()), key=str)


def test_trees_keep_ties_and_rule_out_subtrees():
    rng = np.random.default_rng(3)
    for spread, m in ((2, 40), (50, 64), (4000, 200), (1 << 27, 100)):
        entries, x = rng.integers(-spread, spread, (m, 4)), rng.integers(-spread, spread, (800, 4))
        entries[m // 2 :: 3] = entries[0]
        tree = codes.Gnat(entries)
        entry, least = tree.nearest(x)
        far = ((x[:, None] - entries[None]) ** 2).sum(-1)
        assert (entry == far.argmin(1)).all() and (least == far.min(1)).all()
        assert tree.scanned < 0.7 * len(x) * m
