"""Removal of repeated 400-byte strings by two-stage suffix sorting.

A byte goes if a string of ``span`` bytes that covers it also starts anywhere else, in the same or another document.

1. Winnowing: of the hashes of all ``gram``-byte strings in each span, the smallest is its anchor. Equal spans
   have equal anchors, so only spans around anchors that occur twice can be repeated.
2. An anchor's context holds all spans that contain it. Contexts that occur twice as a whole are
   repeated throughout; one of each kind and all single ones go on, as few as lie at the edges of repeated text.
3. Contexts of an anchor meet in a cell of bounded size. There only suffixes smaller than their successors are
   sorted directly; the others are induced by scanning the buckets of first bytes in order. Adjacent common
   prefixes of ``span`` bytes or more give the repeated spans.
4. An anchor with more contexts than fit a cell is dealt over several. Such cells pass on the digests
   of their distinct spans, packed and dealt by digest, so that equal spans of different cells meet.
5. The intervals of each document are joined and cut out.

Defined results: null counts as empty; texts shorter than a span keep all bytes; repeated rows are
occurrences of their own, so all their spans go; an empty table gives no rows. For ``docs`` see
``common.placed``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passages.llm.common import semi_join, with_lists, with_row_id, written
from passages.llm.near_duplicates import _by_cell, _mixed


@dataclass(frozen=True)
class Settings:
    span: int = 400  #: bytes of a string that may not repeat
    gram: int = 300  #: bytes of an anchor
    cell: int = 1024  #: contexts of an anchor that are sorted together at most, about
    bucket: int = 1 << 20  #: spans of dealt anchors that are compared together, about


_STEP = 1 << 22  # spans of a text that are winnowed at once
_ROW = 1 << 16  # most anchors in a row


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


_up = _down = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse modulo 2**64, kept for the next text."""
    global _up, _down
    if len(_up) < n:
        base = 0x9E3779B97F4A7C15
        up, down = np.full(2 * n, base, dtype=np.uint64), np.full(2 * n, pow(base, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _up, _down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _up[:n], _down[:n]


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of each run of ``size`` bytes."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data + np.uint64(1)) * up[:-1], out=total[1:])
    n = len(data) - size + 1
    return _mixed((total[size:] - total[:n]) * down[:n])


def _sliding(x: np.ndarray, width: int, of) -> np.ndarray:
    """Minimum or maximum (a ufunc) of each window of ``width``."""
    n = len(x) - width + 1
    padded = np.concatenate((x, np.repeat(x[-1:], -len(x) % width))).reshape(-1, width)
    ahead = of.accumulate(padded, axis=1).ravel()
    back = of.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return of(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(raw: bytes, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the anchors of all spans; all of equal smallest hashes in a span count."""
    hashes, places, width = [], [], s.span - s.gram + 1
    for at in range(0, len(raw) - s.span + 1, _STEP):
        h = rolling(np.frombuffer(raw, dtype=np.uint8)[at : at + _STEP + s.span - 1], s.gram)
        low = _sliding(h, width, np.minimum)
        none = np.zeros(width - 1, dtype=np.uint64)
        chosen = np.flatnonzero(h == _sliding(np.concatenate((none, low, none)), width, np.maximum))
        hashes.append(h[chosen])
        places.append(chosen + at)
    if not places:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    places, first = np.unique(np.concatenate(places), return_index=True)
    return np.concatenate(hashes)[first], places


def _scanned(frames: Iterator[pd.DataFrame], s: Settings) -> Iterator[pd.DataFrame]:
    """A row for each document with its anchors; more rows, without the sizes, where these are many."""
    before = s.span - s.gram
    for frame in frames:
        out = []
        for row_id, doc_id, text in zip(frame["row_id"], frame["doc_id"], frame["text"]):
            raw = _raw(text)
            h, at = anchors(raw, s)
            about = (len(raw), hashlib.sha256(raw).hexdigest())
            for i in range(0, max(1, len(at)), _ROW):
                part = at[i : i + _ROW]
                contexts = np.fromiter((xxhash.xxh3_64_intdigest(raw[max(0, p - before) : p + s.span], min(p, before)) for p in part.tolist()), dtype=np.uint64, count=len(part))
                out.append((row_id, doc_id, *(about if not i else (None, None)), h[i : i + _ROW].view(np.int64), part, contexts.view(np.int64)))
                if i:
                    yield _anchor_rows(out)
                    out = []
        yield _anchor_rows(out)


def _anchor_rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["row_id", "doc_id", "n_bytes", "sha", "anchor", "place", "context"]).astype({"doc_id": "Int64", "n_bytes": "Int64"})


def _cut_out(frames: Iterator[pd.DataFrame], s: Settings) -> Iterator[pd.DataFrame]:
    """The contexts at the listed places of a text."""
    before = s.span - s.gram
    names = ["cell", "hot", "many", "row_id", "low", "bytes"]
    for frame in frames:
        out = []
        for row_id, text, wanted in zip(frame["row_id"], frame["text"], frame["wanted"]):
            raw = _raw(text)
            for w in wanted:
                low = max(0, w["place"] - before)
                out.append((w["cell"], w["hot"], w["many"], row_id, low, raw[low : w["place"] + s.span]))
                if len(out) == 4096:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=names)


def suffix_order(data: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Places in ``wanted`` (sorted, and each followed there by its successors up to the next one smaller than
    its own successor), in the order of their suffixes up to ``depth`` bytes, by two-stage sorting.
    ``data`` ends in a zero, a one and ``depth + 8`` zeros or more, so that its last zero before the one is rising."""
    n = len(data)
    step = np.sign(data[1:].astype(np.int16) - data[:-1])
    known = np.where(step != 0, np.arange(n - 1), n - 1)
    known = np.minimum.accumulate(known[::-1])[::-1]  # of equal bytes in a row the first change decides
    rising = np.append(np.append(step, -1)[known] > 0, False)  # smaller than its successor
    words = np.zeros(n - 8, dtype=np.uint64)
    for i in range(8):
        words = (words << np.uint64(8)) | data[i : n - 8 + i]

    # stage one: sort the rising ones directly, by eight bytes at a time, ties only
    direct = wanted[rising[wanted]]
    order = direct[np.argsort(words[direct], kind="stable")]
    group = np.concatenate(([0], np.cumsum(words[order[1:]] != words[order[:-1]]))) if len(order) else np.empty(0, dtype=np.int64)
    blocks = rolling(data, 64)
    for block in range(8, depth, 64):
        if not len(order):
            break
        same = group[1:] == group[:-1]
        # ties that are equal throughout the next 64 bytes need no sorting there
        here = blocks[np.minimum(order + block, len(blocks) - 1)]
        differ = np.flatnonzero(same & (here[1:] != here[:-1]))
        open_ = np.zeros(group[-1] + 1, dtype=bool)
        open_[group[differ]] = True
        tied = np.flatnonzero((np.append(same, False) | np.append(False, same)) & open_[group])
        for d in range(block, min(block + 64, depth), 8):
            if not len(tied):
                break
            keys, groups = words[order[tied] + d], group[tied]
            by = np.lexsort((keys, groups))
            order[tied], keys = order[tied][by], keys[by]
            parted = np.zeros(len(order), dtype=np.int64)
            parted[tied[1:]] = (keys[1:] != keys[:-1]) & (groups[1:] == groups[:-1])
            group = group + np.cumsum(parted)
            own = group[tied]
            tied = tied[np.append(own[1:] == own[:-1], False) | np.append(False, own[1:] == own[:-1])]

    # stage two: scan the buckets of first bytes; a place's predecessor, if falling, is next in its own bucket
    first = data[order] if len(order) else np.empty(0, dtype=np.uint8)
    cuts = np.searchsorted(first, np.arange(257))
    inside = np.zeros(n, dtype=bool)
    inside[wanted] = True
    fed: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        now = np.concatenate(fed[c]) if fed[c] else np.empty(0, dtype=np.int64)
        done = [now]
        while len(now):  # runs of the byte itself
            now = now[now > 0] - 1
            now = now[inside[now] & ~rising[now] & (data[now] == c)]
            done.append(now)
        bucket = np.concatenate([*done, order[cuts[c] : cuts[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[inside[before] & ~rising[before] & (data[before] > c)]
        if len(before):
            chars = data[before]
            by = np.argsort(chars, kind="stable")
            chars, before = chars[by], before[by]
            ends = np.append(np.flatnonzero(chars[1:] != chars[:-1]) + 1, len(chars))
            for start, end in zip([0, *ends[:-1]], ends):
                fed[chars[start]].append(before[start:end])
    return np.concatenate(out)


def repeated_spans(contexts: list[bytes], rows: np.ndarray, lows: np.ndarray, many: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """All spans of contexts in suffix order: their context, start in it, run of equal spans, and whether the run
    holds two occurrences (or a context that occurs elsewhere). A place of a document counts once."""
    sizes = np.array([len(x) for x in contexts])
    begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    data = np.frombuffer(b"\0".join(contexts) + b"\0\1" + b"\0" * (span + 16), dtype=np.uint8)
    n_spans = np.maximum(sizes - span + 1, 0)
    owner = np.repeat(np.arange(len(contexts)), n_spans)
    starts = begins[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n_spans) - n_spans, n_spans)
    # each start with its successors up to the first rising place
    step = np.sign(data[1:].astype(np.int16) - data[:-1])
    rises = np.append(np.flatnonzero(step > 0), len(data) - 1)
    last = begins + n_spans - 1
    until = rises[np.searchsorted(rises, last)]
    length = np.where(n_spans > 0, until - begins + 1, 0)
    wanted = np.unique(np.repeat(begins - (np.cumsum(length) - length), length) + np.arange(length.sum()))
    place = suffix_order(data, wanted[wanted < len(data) - span - 8], span)
    is_start = np.zeros(len(data), dtype=bool)
    is_start[starts] = True
    place = place[is_start[place]]
    # adjacent common prefixes
    words = np.zeros(len(data) - 8, dtype=np.uint64)
    for i in range(8):
        words = (words << np.uint64(8)) | data[i : len(data) - 8 + i]
    blocks = rolling(data, 64)
    ends = blocks[np.minimum(place + span - 64, len(blocks) - 1)] if span >= 64 else blocks[place] * np.uint64(0)
    starts_ = blocks[place] if span >= 64 else ends
    equal = np.flatnonzero((starts_[1:] == starts_[:-1]) & (ends[1:] == ends[:-1]))  # the others cannot be equal
    for d in [*range(0, span - 7, 8), span - 8]:
        equal = equal[words[place[equal] + d] == words[place[equal + 1] + d]]
    new = np.ones(len(place), dtype=bool)
    new[equal + 1] = False
    run = np.cumsum(new) - 1
    owner = np.searchsorted(begins, place, "right") - 1
    offset = place - begins[owner]
    if not len(place):
        return owner, offset, run, np.empty(0, dtype=bool)
    ident = (np.unique(rows, return_inverse=True)[1].astype(np.int64)[owner] << 36) + lows[owner] + offset
    cuts = np.flatnonzero(new)
    twice = (np.minimum.reduceat(ident, cuts) != np.maximum.reduceat(ident, cuts)) | np.maximum.reduceat(many[owner], cuts)
    return owner, offset, run, twice[run]


def _sorted_cells(frames: Iterator[pd.DataFrame], s: Settings, buckets: int) -> Iterator[pd.DataFrame]:
    """Intervals that a cell repeats, and for dealt anchors the packed spans that others may repeat."""
    for cell in _by_cell(frames):
        contexts, rows, lows, many, hot = cell["bytes"].tolist(), cell["row_id"].to_numpy(), cell["low"].to_numpy(), cell["many"].to_numpy(), cell["hot"].to_numpy()
        owner, offset, run, twice = repeated_spans(contexts, rows, lows, many, s.span)
        yield _intervals(rows, lows, owner[twice], offset[twice], s.span)
        if hot.any() and len(owner):
            told = np.ones(len(run), dtype=bool)
            told[1:] = run[1:] != run[:-1]  # one of each run; the others of a run are repeated already
            told &= hot[owner]
            digest = np.array([xxhash.xxh3_64_intdigest(contexts[o][j : j + s.span]) for o, j in zip(owner[told].tolist(), offset[told].tolist())], dtype=np.uint64)
            to = (digest % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(to, kind="stable")
            packed = np.stack([digest.view(np.int64), rows[owner[told]], lows[owner[told]], offset[told]], axis=1)[by]
            ends = np.append(np.flatnonzero(np.diff(to[by])) + 1, len(by))
            for start, end in zip([0, *ends[:-1]], ends):
                if end > start:
                    yield pd.DataFrame({"row_id": [-1], "start": [0], "end": [0], "bucket": [int(to[by[start]])], "packed": [packed[start:end].tobytes()]})


def _intervals(rows: np.ndarray, lows: np.ndarray, owner: np.ndarray, offset: np.ndarray, span: int) -> pd.DataFrame:
    """All spans of a context share its anchor, so those that are repeated cover one interval."""
    found = pd.DataFrame({"o": owner, "j": offset}).groupby("o")["j"].agg(["min", "max"])
    at = found.index.to_numpy()
    return pd.DataFrame({"row_id": rows[at], "start": lows[at] + found["min"].to_numpy(), "end": lows[at] + found["max"].to_numpy() + span, "bucket": -1, "packed": None})


def _met(frames: Iterator[pd.DataFrame], span: int) -> Iterator[pd.DataFrame]:
    for cell in _by_cell(frames):
        x = np.concatenate([np.frombuffer(p, dtype=np.int64).reshape(-1, 4) for p in cell["packed"]])
        place = x[:, 2] + x[:, 3]
        x, place = x[by := np.lexsort((place, x[:, 1], x[:, 0]))], place[by]
        new = np.append(True, x[1:, 0] != x[:-1, 0])
        other = ~new & ((x[:, 1] != np.roll(x[:, 1], 1)) | (place != np.roll(place, 1)))
        cuts = np.flatnonzero(new)
        twice = np.add.reduceat(other, cuts)[np.cumsum(new) - 1] > 0
        if twice.any():
            found = pd.DataFrame({"row_id": x[twice, 1], "low": x[twice, 2], "at": place[twice]}).groupby(["row_id", "low"])["at"].agg(["min", "max"]).reset_index()
            yield pd.DataFrame({"row_id": found["row_id"], "low": found["low"], "first": found["min"], "last": found["max"]})


def runs(spans, size: int) -> list[tuple[int, int]]:
    """Overlapping and adjacent ``spans`` of a text of ``size`` bytes, joined, in their order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((x["start"], min(x["end"], size)) for x in spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _left(raw: bytes, removed: list[tuple[int, int]]) -> bytes:
    ends, starts = [0, *[end for _, end in removed]], [*[start for start, _ in removed], len(raw)]
    return b"".join(raw[end:start] for end, start in zip(ends, starts))


def _kept(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for row_id, text, spans in zip(frame["row_id"], frame["text"], frame["spans"]):
            removed = runs(spans, len(raw := _raw(text)))
            out.append((row_id, [{"start": start, "end": end} for start, end in removed], hashlib.sha256(_left(raw, removed)).hexdigest()))
        yield pd.DataFrame(out, columns=["row_id", "removed", "kept_sha256"])


def _remaining(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        kept = [_left(raw := _raw(t), runs(x if x is not None else [], len(raw))) for t, x in zip(frame["text"], frame["spans"])]
        yield pd.DataFrame({"row_id": frame["row_id"], "doc_id": frame["doc_id"].astype("Int64"), "kept": kept})


def _repeats(docs: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of ``docs`` with ids, their sizes and digests, and the stored spans of those that have any."""
    rows = with_row_id(docs.select("doc_id", "text"))
    scanned = written(rows.mapInPandas(partial(_scanned, s=s), "row_id long, doc_id long, n_bytes long, sha string, anchor array<long>, place array<int>, context array<long>"), "suffix-anchors")
    each = scanned.select("row_id", F.explode(F.arrays_zip("anchor", "place", "context")).alias("x")).select("row_id", "x.*")
    twice = written(each.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"), "suffix-twice")
    found = written(semi_join(each, twice, ["anchor"]), "suffix-found")

    # kinds of contexts of each anchor
    kinds = found.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("row_id", "place")).alias("one"))
    kinds = written(kinds, "suffix-kinds")
    whole = semi_join(found, kinds.filter("n > 1").select("anchor", "context", "n"), ["anchor", "context"])
    before = s.span - s.gram
    covered = whole.select("row_id", F.greatest(F.col("place") - before, F.lit(0)).cast("long").alias("start"), (F.col("place") + s.span).cast("long").alias("end"))

    # anchors with a single context beside others go to cells
    sizes = kinds.groupBy("anchor").agg(F.count("*").alias("size"), F.min("n").alias("least")).filter("size > 1 and least = 1")
    going = kinds.join(sizes, "anchor").select("anchor", "size", "n", F.col("one.row_id").alias("row_id"), F.col("one.place").alias("place"))
    going = written(going, "suffix-going")
    n_going = going.count()
    hot = F.col("size") > s.cell
    part = F.pmod(F.xxhash64("row_id", "place"), F.ceil(F.col("size") / s.cell))
    cell = F.when(hot, F.xxhash64("anchor", part)).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(max(1, n_going // s.cell))))
    lists = going.groupBy("row_id").agg(F.collect_list(F.struct(cell.alias("cell"), hot.alias("hot"), (F.col("n") > 1).alias("many"), "place")).alias("wanted"))
    lists = written(lists, "suffix-lists")
    contexts = with_lists(rows.select("row_id", "text"), lists).mapInPandas(partial(_cut_out, s=s), "cell long, hot boolean, many boolean, row_id long, low long, bytes binary")
    n = max(2 * docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    n_hot = going.filter(hot).count() * (before + 1)
    schema = "row_id long, start long, end long, bucket long, packed binary"
    made = written(contexts.repartition(n, "cell").sortWithinPartitions("cell").mapInPandas(partial(_sorted_cells, s=s, buckets=max(1, -(-n_hot // s.bucket))), schema), "suffix-cells")
    dealt = made.filter("bucket >= 0").select(F.col("bucket").alias("cell"), "packed").repartition(n, "cell").sortWithinPartitions("cell")
    met = dealt.mapInPandas(partial(_met, span=s.span), "row_id long, low long, first long, last long")
    met = met.groupBy("row_id", "low").agg(F.min("first").alias("start"), (F.max("last") + s.span).alias("end")).drop("low")  # an anchor's spans cover one interval

    every = covered.unionByName(made.filter("bucket < 0").select("row_id", "start", "end")).unionByName(met)
    spans = written(every.groupBy("row_id").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "suffix-spans")
    return rows, scanned.filter("n_bytes IS NOT NULL").select("row_id", "doc_id", "n_bytes", "sha"), spans


def repeats_removed(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Per row of ``docs``: row_id, doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed runs of bytes themselves."""
    rows, all_rows, spans = _repeats(docs, s)
    cut = with_lists(rows.select("row_id", "text"), spans).mapInPandas(_kept, "row_id long, removed array<struct<start:long,end:long>>, kept_sha256 string")
    removed = F.coalesce("removed", F.array().cast("array<struct<start:long,end:long>>"))
    done = all_rows.join(cut, "row_id", "left").withColumn("removed", removed)
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return done.select("row_id", "doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "removed")


def kept_texts(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Per row of ``docs``: row_id, doc_id and the bytes that are left, which may begin or end within a character."""
    rows, _, spans = _repeats(docs, s)
    return rows.join(spans, "row_id", "left").select("row_id", "doc_id", "text", "spans").mapInPandas(_remaining, "row_id long, doc_id long, kept binary")


def report(docs: DataFrame) -> DataFrame:
    return repeats_removed(docs).drop("row_id")
