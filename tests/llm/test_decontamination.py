"""Leaks against all windows of all documents and items."""

import random
import re
from collections import Counter

from passages.llm import decontamination as dc


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(docs, items):
    out = []
    for d, t in docs:
        w = words(t)
        for i, x in items:
            v = words(x)
            if not v:
                continue
            k = min(5, len(v))
            item, best = Counter(tuple(v[j : j + k]) for j in range(len(v) - k + 1)), None
            for s in range(max(0, len(w) - k + 1)):
                win = w[s : s + len(v)]
                have = Counter(tuple(win[j : j + k]) for j in range(len(win) - k + 1))
                o, u = sum((have & item).values()), sum((have | item).values())
                if o * 100 >= u * 80 and (best is None or o / u > best[1] / best[2]):
                    best = (s, o, u)
            if best:
                out.append((d, i, *best))
    return sorted(out, key=str)


def tables(spark, tmp_path, docs, items):
    spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string").write.mode("overwrite").parquet(f"{tmp_path}/d")
    spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, doc_id int").write.mode("overwrite").parquet(f"{tmp_path}/i")
    return spark.read.parquet(f"{tmp_path}/d"), spark.read.parquet(f"{tmp_path}/i")


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [text(n) for n in (3, 5, 6, 16, 30, 45, 59)]
    docs = []
    for _ in range(60):
        w = text(rng.choice([0, 2, 30, 150]))
        for _ in range(rng.choice([0, 1, 1, 2])):
            v = list(rng.choice(items))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                j = rng.randrange(len(v))
                rng.choice([lambda: v.pop(j) if len(v) > 1 else 0, lambda: v.insert(j, "new"), lambda: v.__setitem__(j, "other")])()
            if rng.random() < 0.2:
                v = v[len(v) // 2 :] + v[: len(v) // 2]
            at = rng.randint(0, len(w))
            w[at:at] = v
        docs.append((rng.choice([" ", ", ", "\n"]).join(w)).upper() if rng.random() < 0.3 else " ".join(w))
    items = list(enumerate([" ".join(i) for i in items] + [None, "", "!!", " ".join(items[3])]))
    return [(100 + i, t) for i, t in enumerate([*docs, None, "", docs[3]])], items


def test_leaks_equal_all_windows(spark, tmp_path):
    for seed in (1, 2):
        docs, items = corpus(seed)
        got = dc.report(*tables(spark, tmp_path, docs, items)).collect()
        assert sorted(((r.doc_id, r.item_id, r.start, r.overlap, r.union_size) for r in got), key=str) == brute(docs, items)


def test_removal_and_empty_tables(spark, tmp_path):
    docs, items = corpus(3)
    d, i = tables(spark, tmp_path, docs, items)
    found = {x[0] for x in brute(docs, items)}
    assert sorted(r.doc_id for r in dc.decontaminated(d, i).collect()) == sorted(x for x, _ in docs if x not in found)
    assert dc.report(d.limit(0), i).count() == 0
    assert dc.report(d, i.limit(0)).count() == 0 and dc.decontaminated(d, i.limit(0)).count() == len(docs)


def test_fingerprints_of_many_shingles(spark):
    rows = spark.range(90_000).selectExpr("id % 2 AS k", "xxhash64(id) AS hash").union(spark.range(40_000).selectExpr("2L AS k", "-1L AS hash"))
    held = {}
    for r in rows.collect():
        held.setdefault(r.k, []).append(r.hash)
    for r in dc.fingerprint(rows, ["k"]).collect():
        own = held[r.k]
        assert r.n_shingles == len(own) and r.fp & (2**64 - 1) == sum((sum(h >> b & 1 for h in own) * 2 > len(own)) << b for b in range(64))


def test_parts_of_a_document_with_many_hits(spark, tmp_path):
    rng = random.Random(5)
    item = [f"u{i}" for i in range(20)]
    w = []
    for _ in range(30):
        w += [rng.choice("abcdefgh") for _ in range(rng.randint(0, 200))] + (item if rng.random() < 0.3 else item[:15] + item[16:])
    docs, items = [(1, " ".join(w)), (2, "z " * 700 + " ".join(item))], [(1, " ".join(item)), (2, " ".join(item[3:18]))]
    got = dc.report(*tables(spark, tmp_path, docs, items)).collect()
    assert sorted(((r.doc_id, r.item_id, r.start, r.overlap, r.union_size) for r in got), key=str) == brute(docs, items)
