"""Packing: ids equal the tokenizer's, pieces tile documents, sequences are gapless and few."""

import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

from passages.llm import packing

ODD = ["hello<|endoftext|> x", "it's dogs' <b> a\x1cb\xa0c İstanbul ΣΑΣ é ﬁ 12a3 ½ it'S   x'ry don't!!'s", "日本語 テスト", "ÀB À Å", "'s's", "foo'́s", "ſ ǅ ß ẞ", "a\x0bb\x0cc\rd\te", "x,, ,y ...z!?'", "𝒜b ªº µ"]


def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_words_equal_whole_texts(spark):
    words, whole = packing.Words(public_tokenizers.path("word_bpe_49k.json")), tokenizer()
    words.most = 500  # the store is emptied on the way
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for t in texts:
        assert words.of(t) == b"".join(i.to_bytes(4, "little") for i in whole.encode(t, add_special_tokens=False).ids), t
    assert words.of(None) == b""


def test_punctuation_after_punctuation_is_one_run():
    words, whole = packing.Words(public_tokenizers.path("word_bpe_49k.json")), tokenizer()
    for t in ["'hello',", "dogs'.", "“end”).", "d’accord»,", "»,", "x',y'.", "été, naïf”! 12', a1). ½. ²,", "o'.'", "a…?!", "日本。, 本,", "e\u0301, \u0301."]:
        assert words.of(t) == b"".join(i.to_bytes(4, "little") for i in whole.encode(t, add_special_tokens=False).ids), t


def test_a_word_of_several_texts_is_looked_up_once(monkeypatch):
    words, whole = packing.Words(public_tokenizers.path("word_bpe_49k.json")), tokenizer()
    words.most, seen, ids_of = 2, [], words._ids  # what is kept is dropped all the time
    monkeypatch.setattr(words, "_ids", lambda word: seen.append(word) or ids_of(word))
    texts = ["one two, three four"] * 50 + [None, "", "  ", "two four. ", *ODD, "five\x0bsix\x1cseven <|startoftext|> five"]
    got = words.of_all(texts)
    for t, ids in zip(texts, got, strict=True):
        assert ids == b"".join(i.to_bytes(4, "little") for i in whole.encode(t or "", add_special_tokens=False).ids), t
    assert seen.count(b"one") == seen.count(b"three") == 1 and len(seen) < 150


def test_groups_of_texts_change_nothing(monkeypatch):
    texts = ["a bc, d"] * 3 + [None, "", "x" * 50, "e f g"]
    monkeypatch.setattr(packing, "_TOGETHER", 10)
    groups = list(packing._groups(range(7), texts))
    assert [i for ids, _ in groups for i in ids] == list(range(7)) and [t for _, ts in groups for t in ts] == texts
    assert len(groups) == 3 and not list(packing._groups([], []))


def test_report(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate([*ODD, None, "", "word " * 9000])], "doc_id long, text string")
    docs = docs.unionByName(odd)
    whole, want = tokenizer(), {}
    for d, t in docs.collect():
        want[d] = whole.encode(t or "", add_special_tokens=False).ids + [1]
    seen, places, lengths = defaultdict(list), defaultdict(list), 0
    for r in packing.report(docs).collect():
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length <= 4096 and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        seen[r.doc_id].append((r.piece, r.start, r.length))
        places[r.sequence_id].append((r.offset, r.length))
        lengths += r.length
    for d, ids in want.items():
        assert sorted(seen[d]) == [(k, at, min(4096, len(ids) - at)) for k, at in enumerate(range(0, len(ids), 4096))]
    for rows in places.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) <= -(-lengths // 4096) + 1


def test_islands_and_repeated_rows(spark):
    docs = spark.createDataFrame([(7, "a b c")] * 50 + [(None, "d " * 1500)] * 5, "doc_id long, text string")
    rows = packing.packed(packing.pieces(docs), packing.Settings(cell=10, islands=2)).collect()
    assert len(rows) == 55 and sum(r.length for r in rows) == 50 * 4 + 5 * 1501
    assert packing.report(docs.limit(0)).count() == 0


def test_cells_win_back_their_last_bins(spark):
    """Each of some 20 cells rounds its bins up; packed again, all but a few of these are won back."""
    rng = random.Random(3)
    lengths = [rng.choice([3, 5, 7, 11, 30]) for _ in range(2000)]
    parts = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    s = packing.Settings(capacity=100, cell=100)
    rows = packing.packed(parts, s).collect()
    fills = defaultdict(int)
    for r in rows:
        fills[r.sequence_id] += r.length
    assert len(rows) == 2000 and sorted(r.length for r in rows) == sorted(lengths) and max(fills.values()) <= 100
    assert len(fills) <= -(-sum(lengths) // 100) + 2


def test_crossover_beats_best_fit_decreasing():
    rng, won, s = random.Random(6), 0, packing.Settings(capacity=1000, generations=60, population=12)
    for no in range(12):
        lengths = []
        for _ in range(20):  # bins of three that fill exactly, so the bound is known
            a, b = rng.randint(260, 480), rng.randint(200, 300)
            lengths += [a, b, 1000 - a - b]
        bins: list = []
        packing.best_fit(lengths, sorted(range(60), key=lambda i: -lengths[i]), bins, [], 1000)
        owner = packing.evolve(lengths, [], s, random.Random(no))
        assert 20 <= max(owner) + 1 <= len(bins)
        won += max(owner) + 1 < len(bins)
    assert won >= 3


def test_crossover_keeps_every_item_once():
    rng = random.Random(1)
    lengths = [rng.randint(1, 60) for _ in range(300)]
    s = packing.Settings(capacity=100)
    owner = packing.evolve(lengths, [], s, rng)
    a, b = ([[]], [0]), ([[]], [0])
    for p in (a, b):
        p[0].clear(), p[1].clear()
        packing.best_fit(lengths, rng.sample(range(300), 300), p[0], p[1], 100)
    child = packing.crossed(a, b, lengths, 100, rng)
    assert sorted(i for x in child[0] for i in x) == list(range(300)) and max(child[1]) <= 100
    assert all(sum(lengths[i] for i in x) == f for x, f in zip(*child))
    assert max(owner) + 1 <= len(a[0])
