"""Best-fit packing of tokenized documents by a grouping genetic algorithm on islands.

Pieces are dealt at random to cells of bounded size. Each cell is packed by several islands, each with a
population of packings. Crossover injects whole well-filled bins of one parent into the other, removes
the bins that hold their documents again, and places the displaced ones by best fit. After each round
every island gets the best packing of its neighbour. A cell stops at the lower bound of its bins. Then the emptiest
bin of each cell is opened and its pieces are packed again with those of other cells, in fewer cells each time,
until one cell is left: what the cells lose by rounding up their bins is won back.

Defined results: a null or empty text is one piece, the end id alone; repeated rows are packed each;
an empty table gives no rows.
"""

from __future__ import annotations

import random
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache, partial

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from passages.llm.common import tidy, with_row_id, written


@dataclass(frozen=True)
class Settings:
    capacity: int = 4096  #: ids of a sequence
    end_id: int = 1  #: follows each document
    tokenizer: str | None = None  #: file for the tokenizers library; None: word_bpe_49k.json of public_tokenizers
    cell: int = 16384  #: pieces that are packed together, on average
    islands: int = 3
    rounds: int = 2
    population: int = 6
    generations: int = 12


@cache
def _packed(n: int) -> Callable[..., bytes]:
    """Packs n ids, little-endian."""
    return struct.Struct(f"<{n}I").pack


class Words(dict):
    """Ids of each word, as little-endian bytes, kept while words repeat. When grown large it starts anew and keeps
    the former words beside it for one more turn, so frequent words stay.

    The tokenizer splits at white space and, there, into runs of letters, single digits and runs of other
    characters; so a text's ids are those of its words in a row, and a word that ends in an ASCII letter or
    digit with punctuation after it is two (another character before may be of the same run), which are kept
    apart. Letters go straight to the model; everything else through the whole tokenizer. Each word that texts
    taken together hold is looked up once.
    """

    _TAIL = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
    most = 200_000

    def __init__(self, path: str):
        self.former: dict[bytes, bytes] = {}
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the byte-level alphabet
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > self.most:
            self.former = dict(self)
            self.clear()
        ids = self.former.get(word)
        if ids is None:
            ids = self._ids(word)
        self[word] = ids
        return ids

    def _ids(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if word.isalpha():  # of bytes: ASCII letters, in lower case already
            ids = [t.id for t in self.model.tokenize(text)]
        elif (low := unicodedata.normalize("NFC", text).lower()).isalpha() and max(text) < "ƀ":
            ids = [t.id for t in self.model.tokenize("".join(map(self.alphabet.__getitem__, low.encode())))]
        else:
            ids = self.whole.encode(text, add_special_tokens=False).ids
        return _packed(len(ids))(*ids)

    def _parted(self, word: bytes) -> bytes:
        if word.isalpha():
            return self[word]
        core = word.rstrip(self._TAIL)
        if len(core) < len(word) and core[-1:].isalnum():  # of bytes: ASCII only
            return self[core] + self[word[len(core) :]]
        return self[word]

    def of_all(self, texts: Iterable[str | None]) -> list[bytes]:
        """All ids of each text."""
        texts = [t or "" for t in texts]
        special = {i for i, t in enumerate(texts) if "<|" in t}  # may hold a special token, which is found before lower-casing
        plain = ["" if i in special else t for i, t in enumerate(texts)]
        raw = pa.array([t.encode("utf-8", "replace").lower() for t in plain], pa.large_binary())
        split = pc.ascii_split_whitespace(raw.view(pa.large_string()))
        coded = split.values.dictionary_encode()
        ids = list(map(self._parted, coded.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False)))
        codes, cuts = coded.indices.to_numpy(), split.offsets.to_numpy()
        out = [b"".join(map(ids.__getitem__, codes[at:end].tolist())) for at, end in zip(cuts[:-1], cuts[1:])]
        for i in special:
            out[i] = b"".join(t.to_bytes(4, "little") for t in self.whole.encode(texts[i], add_special_tokens=False).ids)
        return out

    def of(self, text: str | None) -> bytes:
        """All ids of a text."""
        return self.of_all([text])[0]


_words: dict[str, Words] = {}
_TOGETHER = 1 << 22  # code points of texts whose words are looked up together, about
_LEVELS = 8  # cells are packed again in fewer cells so often at most; each time they are some hundred times fewer


def _groups(doc_ids: Iterable, texts: Iterable[str | None]) -> Iterator[tuple[list, list]]:
    """Documents in their order, in groups of about ``_TOGETHER`` code points; a longer text ends its group."""
    size, group = 0, ([], [])
    for doc_id, text in zip(doc_ids, texts):
        group[0].append(doc_id)
        group[1].append(text)
        size += len(text or "")
        if size >= _TOGETHER:
            yield group
            size, group = 0, ([], [])
    if group[0]:
        yield group


@tidy
def _pieces(frames: Iterator[pd.DataFrame], s: Settings, path: str) -> Iterator[pd.DataFrame]:
    words = _words[path] = _words.get(path) or Words(path)
    step, end = 4 * s.capacity, s.end_id.to_bytes(4, "little")
    for frame in frames:
        out = []
        for doc_ids, texts in _groups(frame["doc_id"], frame["text"]):
            for doc_id, ids in zip(doc_ids, words.of_all(texts)):
                ids += end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    out.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
        yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})


def pieces(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of whole tokenized documents."""
    path = s.tokenizer
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return docs.select("doc_id", "text").mapInPandas(partial(_pieces, s=s, path=str(path)), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], items, bins: list[list[int]], fills: list[int], capacity: int) -> None:
    """Adds ``items`` in their order to ``bins``, each to the fullest bin with room, or to a new one."""
    by_room: dict[int, list[int]] = {}
    rooms = 0
    for b, fill in enumerate(fills):
        by_room.setdefault(capacity - fill, []).append(b)
        rooms |= 1 << (capacity - fill)
    for item in items:
        size = lengths[item]
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[b].append(item)
            fills[b] += size
        else:
            b = len(bins)
            bins.append([item])
            fills.append(size)
        room = capacity - fills[b]
        by_room.setdefault(room, []).append(b)
        rooms |= 1 << room


def fitness(bins: list, fills: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins, then bins filled unevenly, are better (larger)."""
    return -len(bins), sum(f * f for f in fills) / (capacity * capacity * max(1, len(fills)))


def crossed(a: tuple, b: tuple, lengths: list[int], capacity: int, rng: random.Random) -> tuple:
    """Some of b's best-filled bins go whole into a; a's bins that hold their items again are dissolved."""
    (bins_a, fills_a), (bins_b, fills_b) = a, b
    well = sorted(range(len(bins_b)), key=lambda i: -fills_b[i])[: max(1, len(bins_b) // 2)]
    injected = rng.sample(well, rng.randint(1, max(1, min(len(well), len(bins_b) // 4))))
    taken = {i for k in injected for i in bins_b[k]}
    bins, fills, displaced = [list(bins_b[k]) for k in injected], [fills_b[k] for k in injected], []
    for items, fill in zip(bins_a, fills_a):
        if taken.isdisjoint(items):
            bins.append(list(items))
            fills.append(fill)
        else:
            displaced += [i for i in items if i not in taken]
    displaced.sort(key=lambda i: (-lengths[i], i))
    best_fit(lengths, displaced, bins, fills, capacity)
    return bins, fills


def evolve(lengths: list[int], seeds: list[list[int]], s: Settings, rng: random.Random) -> list[int]:
    """The bin of each item in the best packing of an island that starts with ``seeds`` (bins of items)."""
    people = []
    for owner in seeds:
        bins: list[list[int]] = [[] for _ in range(max(owner, default=-1) + 1)]
        for item, b in enumerate(owner):
            bins[b].append(item)
        people.append((bins, [sum(lengths[i] for i in b) for b in bins]))
    bound = -(-sum(lengths) // s.capacity)
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    while len(people) < s.population and not any(len(b) == bound for b, _ in people):
        bins, fills = [], []
        best_fit(lengths, order, bins, fills, s.capacity)
        people.append((bins, fills))
        order = sorted(order, key=lambda i: -lengths[i] * rng.uniform(0.8, 1.0))
    rank = lambda p: fitness(*p, s.capacity)
    people.sort(key=rank, reverse=True)
    for _ in range(s.generations):
        if len(people[0][0]) <= bound or len(people) < 2:
            break
        mother, father = rng.sample(people[: max(2, len(people) // 2 + 1)], 2)
        children = [crossed(mother, father, lengths, s.capacity, rng), crossed(father, mother, lengths, s.capacity, rng)]
        people = sorted(people + children, key=rank, reverse=True)[: s.population]
    owner = [0] * len(lengths)
    for b, items in enumerate(people[0][0]):
        for i in items:
            owner[i] = b
    return owner


@tidy
def _evolved(frames: Iterator[pd.DataFrame], s: Settings, turn: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for cell, island, lengths, own, guest in zip(*[frame[c] for c in ("cell", "island", "lengths", "own", "guest")]):
            seeds = [[int(x) for x in g] for g in (own, guest) if g is not None]
            owner = evolve([int(x) for x in lengths], seeds, s, random.Random(f"{cell}/{island}/{turn}"))
            yield pd.DataFrame({"cell": [cell], "island": [island], "lengths": [lengths], "own": [owner], "bins": [max(owner, default=-1) + 1]})


def _cells_packed(pieces: DataFrame, s: Settings, n_cells: int) -> DataFrame:
    """(uid, length, cell, bin) of stored ``pieces`` (uid, length), dealt to ``n_cells`` cells that evolve on their own."""
    dealt = pieces.withColumn("cell", F.pmod(F.xxhash64("uid", F.lit(n_cells)), F.lit(n_cells)))
    items = dealt.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("uid", F.col("length").cast("int").alias("length")))).alias("items"))  # about s.cell in each
    items = written(items, "cells")
    state = items.select("cell", F.explode(F.sequence(F.lit(0), F.lit(s.islands - 1))).alias("island"), F.col("items.length").alias("lengths"), F.lit(None).cast("array<int>").alias("own"), F.lit(None).cast("array<int>").alias("guest"))
    schema = "cell long, island int, lengths array<int>, own array<int>, bins int"
    for turn in range(s.rounds):
        spread = state.repartition(min(4096, n_cells * s.islands), "cell", "island")
        done = written(spread.mapInPandas(partial(_evolved, s=s, turn=turn), schema), "islands")
        elites = done.select("cell", F.pmod(F.col("island") + 1, F.lit(s.islands)).alias("island"), F.col("own").alias("guest"))
        state = done.drop("bins").join(elites, ["cell", "island"])
    best = done.groupBy("cell").agg(F.min_by("own", F.struct("bins", "island")).alias("own"))
    placed = items.join(best, "cell").select("cell", F.explode(F.arrays_zip(F.col("items.uid").alias("uid"), F.col("items.length").alias("length"), F.col("own").alias("bin"))).alias("x"))
    return placed.select("x.uid", "x.length", "cell", "x.bin")


def packed(parts: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces, which come from :func:`pieces`."""
    keyed = with_row_id(written(parts, "pieces"), "uid")
    loose, n_cells, level, done = keyed.select("uid", "length"), max(1, -(-keyed.count() // s.cell)), 0, None
    while True:
        found = written(_cells_packed(loose, s, n_cells), "packed").withColumn("sequence_id", (F.col("cell") * (1 << 20) + F.col("bin")) * _LEVELS + level)
        if n_cells == 1 or level == _LEVELS - 1:
            kept = found.select("uid", "sequence_id")
            done = kept if done is None else done.unionByName(kept)
            break
        # one bin of each cell, a small share of its pieces
        fills = found.groupBy("cell", "sequence_id").agg(F.sum("length").alias("fill"), F.count("*").alias("n"))
        opened = written(fills.groupBy("cell").agg(F.min_by(F.struct("sequence_id", "n"), F.struct("fill", "sequence_id")).alias("b")).select("b.*"), "opened")
        kept = found.join(opened, "sequence_id", "left_anti").select("uid", "sequence_id")
        done = kept if done is None else done.unionByName(kept)
        loose = written(found.join(opened.select("sequence_id"), "sequence_id", "left_semi").select("uid", "length"), "loose")
        n_cells, level = min(n_cells - 1, max(1, -(-opened.agg(F.sum("n")).first()[0] // s.cell))), level + 1
    before = W.partitionBy("sequence_id").orderBy("uid").rowsBetween(W.unboundedPreceding, -1)
    return keyed.join(done, "uid").withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("uid")


def report(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    return packed(pieces(docs, s), s).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
