"""MinHash components against all pairs; graph components against union-find."""

import random
import re
from collections import Counter

from passages.llm import near_duplicates as nd
from passages.llm.graph import connected_components


def brute(rows, words, percent=80):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                root[max(top(i), top(j))] = min(top(i), top(j))
    low = {}
    for i, (d, _) in enumerate(rows):
        low[top(i)] = min(low.get(top(i), d), d)
    return sorted((d, len(sets[i]), low[top(i)], d == low[top(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 8, 40, 120]))]
        for _ in range(rng.choice([1, 1, 2, 8, 20])):
            copy = [w if rng.random() > rng.choice([0, 0.02, 0.05, 0.1]) else rng.choice(vocab) for w in base]
            rows.append(" ".join(copy).upper() if rng.random() < 0.2 else "\n".join(copy))
    rows += [None, "", "  ", "é É", "a", "a", "A"]
    rng.shuffle(rows)
    return [(1000 - i, t) for i, t in enumerate(rows)]


def frame(spark, tmp_path, rows):
    spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, node int, family string").write.mode("overwrite").parquet(f"{tmp_path}/d")
    return spark.read.parquet(f"{tmp_path}/d")


def test_report_equals_all_pairs(spark, tmp_path):
    rows = corpus(5)
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.report(frame(spark, tmp_path, rows)).collect())
    assert got == brute(rows, 2)


def test_cells_smaller_than_families(spark, tmp_path):
    rows = corpus(6)
    found = nd.near_duplicates(frame(spark, tmp_path, rows), nd.Settings(words=2, cell=3))
    assert sorted((r.doc_id, r.component_id) for r in found.collect()) == [(d, c) for d, _, c, _ in brute(rows, 2)]


def test_first_cells_grow_in_number_not_in_size(spark):
    best = spark.range(1, 20_001).selectExpr("id node", "IF(id <= 19990, 0L, -id) rep")
    rows = nd.first_cells(best, nd.Settings(cell=10)).collect()
    targets, queries = Counter(r.cell for r in rows if not r.query), Counter(r.cell for r in rows if r.query)
    assert sum(targets.values()) == 20_000 and max(targets.values()) <= 40
    assert queries.keys() == targets.keys() and max(queries.values()) == 1


def test_more_cells_than_parts(spark, tmp_path):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(f"x{i}" if j == k else w for j, w in enumerate(base))) for i in range(200) for k in [rng.randrange(60)]]
    found = nd.near_duplicates(frame(spark, tmp_path, rows), nd.Settings(words=2, cell=2))
    assert sorted((r.doc_id, r.component_id) for r in found.collect()) == [(d, c) for d, _, c, _ in brute(rows, 2)]


def test_deduplicated_keeps_one_of_repeated_rows(spark, tmp_path):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (1, "a b c d e f"), (2, None), (2, None), (4, "x")]
    assert sorted(r.doc_id for r in nd.deduplicated(frame(spark, tmp_path, rows)).collect()) == [1, 2, 2, 4]
    empty = frame(spark, tmp_path, rows).limit(0)
    assert nd.report(empty).count() == 0


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(500, i) for i in range(501, 560)] + [(i, i + 1) for i in range(600, 640)]
    root = {}

    def top(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: top(x) for a, b in links if a != b for x in (a, b)}
