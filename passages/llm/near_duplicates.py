"""Near-duplicate documents by MinHash with tensored banding.

A text's set holds its distinct k-word shingles as 64-bit hashes. ``collections`` small groups of
``rows`` minima each make one value; a table key is the pair of two such values, so c collections
give c(c-1)/2 tables and only about the square root of their minima is computed. Two sets meet in a
table if any two of their values agree: at similarity 0.8 all pairs do but about one in a million with
the production parameters (32 collections of 4 minima).

Equal sets are one node. In each bucket of a table every node is proposed to the bucket's first node (its
representative). Round one verifies each node's likeliest proposal on the full sets; the links'
components are the families. Round two verifies what is left exactly: a node that was
proposed to a family outside its own is compared with all of that family and with all others so
proposed, in cells of bounded size. Pairs are never rows; a cell gives a spanning forest of its links.

Defined results: null, empty or blank texts have an empty set, link with nothing and stay; texts of
fewer words than a shingle are one shingle; repeated rows are copies; for ``docs`` see
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

from passages.llm.common import placed, small, tidy, with_group_min, with_row_id, without, written
from passages.llm.graph import connected_components


@dataclass(frozen=True)
class Settings:
    words: int = 5  #: words of a shingle
    percent: int = 80  #: linked if 100 * intersection >= percent * union
    collections: int = 32  #: small hash collections; each pair of them is a table
    rows: int = 4  #: minima in a collection
    cell: int = 1024  #: most targets, and most queries, of one comparison cell (on average over a group's cells, which are dealt by hash)


class _Hashes(dict):
    """Hash of each word seen so far; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles: A-Z lower-cased, words between ASCII white space."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    each = np.fromiter(map(_hashes.__getitem__, found), dtype=np.uint64, count=len(found))
    k = min(words, len(found))
    h = np.full(len(found) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + each[i : len(found) - k + 1 + i]
    return np.unique(_mixed(h))


def values(hashes: np.ndarray, s: Settings) -> np.ndarray:
    """The value of each collection: its minima mixed to 64 bits."""
    n = s.collections * s.rows
    rng = np.random.Generator(np.random.PCG64(20240607))
    a, b = rng.integers(1, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(n, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(least, (a[:, None] * x[None, i : i + 2048] + b[:, None]).min(axis=1), out=least)
    out = np.arange(s.collections, dtype=np.uint64)
    for column in least.reshape(s.collections, s.rows).T:
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out.view(np.int64)


@tidy
def _signed(frames: Iterator[pd.DataFrame], s: Settings) -> Iterator[pd.DataFrame]:
    for frame in frames:
        n, digest, vals = [], [], []
        for text in frame["text"]:
            h = shingle_set(text, s.words)
            n.append(len(h))
            digest.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
            vals.append(values(h, s) if len(h) else None)
        yield pd.DataFrame({"row_id": frame["row_id"], "doc_id": frame["doc_id"], "n": n, "digest": digest, "vals": vals})
    _hashes.clear()


@tidy
def _sets(frames: Iterator[pd.DataFrame], words: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame({"node": frame["node"], "hashes": [shingle_set(t, words).tobytes() for t in frame["text"]]})
    _hashes.clear()


def _by_cell(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole cells from batches that are sorted by cell."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        cells = frame["cell"].to_numpy()
        cuts = np.flatnonzero(cells[1:] != cells[:-1]) + 1
        for start, end in zip([0, *cuts], [*cuts, len(cells)]):
            if held and held[0]["cell"].iloc[0] != cells[start]:
                yield held[0] if len(held) == 1 else pd.concat(held)
                held = []
            held.append(frame.iloc[start:end])
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held)


@tidy
def _linked(frames: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Links that connect what the queries of each cell link with, as a spanning forest."""
    for cell in _by_cell(frames):
        targets, queries = cell[~cell["query"]], cell[cell["query"]]
        if not len(targets) or not len(queries):
            continue
        nodes, sets = targets["node"].to_numpy(), [np.frombuffer(x, dtype=np.uint64) for x in targets["hashes"]]
        sizes = np.array([len(x) for x in sets])
        every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        out = []
        for node, raw in zip(queries["node"], queries["hashes"]):
            own = np.frombuffer(raw, dtype=np.uint64)
            low, high = np.searchsorted(every, own, "left"), np.searchsorted(every, own, "right")
            n = high - low
            at = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(sets))
            for other in nodes[100 * both >= percent * (len(own) + sizes - both)]:
                x, y = top(int(node)), top(int(other))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((int(node), int(other)))
        if out:
            yield pd.DataFrame(out, columns=["a", "b"])


def compared(cells: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """(a, b): links of the queries with the targets of their cells. ``cells``: cell, query, node."""
    rows = cells.join(sets, "node")
    n = max(2 * rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, "cell").sortWithinPartitions("cell").mapInPandas(partial(_linked, percent=s.percent), "a long, b long")


def proposals(nodes: DataFrame) -> DataFrame:
    """(node, rep, tables): the representatives that meet a node in tables. ``nodes``: node, vals."""
    each = nodes.select("node", F.posexplode("vals").alias("no", "val"))
    often = written(each.groupBy("no", "val").agg(F.count("*").alias("n")).filter("n > 1").select("no", "val"), "minhash-often")
    shared = each.join(often, ["no", "val"], "left_semi")  # rows of a hot value are on the side that a skewed join splits
    lists = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("no", "val"))).alias("v")).filter(F.size("v") > 1)
    first = lists.select("node", "v", F.posexplode("v").alias("i", "x"))
    pairs = first.select("node", "x", F.explode(F.slice("v", F.col("i") + 2, F.greatest(F.size("v") - F.col("i") - 1, F.lit(0)))).alias("y"))
    keys = pairs.select("node", F.xxhash64("x.no", "x.val", "y.no", "y.val").alias("key"))
    met = with_group_min(keys, ["key"], "node", ["node"], ("rep", "n")).filter("n > 1")
    return met.select("node", "rep").filter("node <> rep").groupBy("node", "rep").agg(F.count("*").alias("tables"))


def first_cells(best: DataFrame, s: Settings) -> DataFrame:
    """(cell, query, node): the nodes of each representative dealt to 64 cells, or to more where these would hold over ``s.cell``; the
    representative is the query of each. ``best``: node, rep."""
    counted = with_group_min(best, ["rep"], "node", ["node"], ("low", "n"))
    parts = F.greatest(F.lit(64), F.ceil(F.col("n") / s.cell))
    dealt = counted.select("node", "rep", F.xxhash64("rep", F.pmod(F.xxhash64("node", F.lit("part")), parts)).alias("cell"))
    return dealt.select("cell", F.lit(False).alias("query"), "node").unionByName(dealt.select("cell", F.lit(True).alias("query"), F.col("rep").alias("node")).distinct())


def near_duplicates(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Per row of ``docs``: row_id, doc_id, n_shingles, component_id (smallest doc_id reachable by links), and
    ``first``: whether it is its component's first row by doc_id, then place."""
    rows = with_row_id(docs.select("doc_id", "text"))
    signed = written(rows.mapInPandas(partial(_signed, s=s), "row_id long, doc_id long, n int, digest binary, vals array<long>"), "minhash")
    linkable = signed.filter("n > 0")
    classed = written(with_group_min(linkable.select("row_id", "doc_id", "digest"), ["digest"], "row_id", ["row_id"], ("node", "copies")).select("row_id", "node"), "minhash-classes")
    nodes = written(signed.select("row_id", "vals").join(classed.filter("row_id = node").select("row_id"), "row_id").select(F.col("row_id").alias("node"), "vals"), "minhash-nodes")
    proposed = written(proposals(nodes), "minhash-proposals")
    involved = written(proposed.select("node").unionByName(proposed.select(F.col("rep").alias("node"))).distinct(), "minhash-involved")
    texts = rows.select(F.col("row_id").alias("node"), "text").join(small(involved, involved.count()), "node")
    sets = written(texts.mapInPandas(partial(_sets, words=s.words), "node long, hashes binary"), "minhash-sets")

    # round one: each node with its likeliest representative
    best = proposed.groupBy("node").agg(F.max_by("rep", F.struct("tables", F.xxhash64("rep"))).alias("rep"))
    links = written(compared(first_cells(best, s), sets, s), "minhash-links")
    families = written(_labelled(involved, links), "minhash-families")

    # round two: proposals that still lead out of the own family
    of_rep = families.select(F.col("node").alias("rep"), F.col("family").alias("to"))
    left = proposed.select("node", "rep").join(of_rep, "rep").join(families, "node").filter("to <> family").select("node", "to").distinct()
    left = written(left, "minhash-left")
    queries = left.groupBy("to").agg(F.count("*").alias("q"))
    members = families.select("node", F.col("family").alias("to")).join(queries.select("to"), "to", "left_semi").unionByName(left)
    targets = members.groupBy("to").agg(F.count("*").alias("t"))
    grid = queries.join(targets, "to").select("to", F.ceil(F.col("q") / s.cell).alias("qs"), F.ceil(F.col("t") / s.cell).alias("ts"))
    dealt = lambda df, own, other: df.join(grid, "to").select("node", "to", F.pmod(F.xxhash64("node", F.lit(own)), F.col(own)).alias("mine"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("theirs"))
    cells = (
        dealt(left, "qs", "ts").select(F.xxhash64("to", "mine", "theirs").alias("cell"), F.lit(True).alias("query"), "node")
        .unionByName(dealt(members, "ts", "qs").select(F.xxhash64("to", "theirs", "mine").alias("cell"), F.lit(False).alias("query"), "node"))
    )
    more = written(compared(cells, sets, s), "minhash-more")
    if not more.isEmpty():
        families = _joined_families(families, more)

    labels = classed.join(families, "node", "left").select("row_id", F.coalesce("family", "node").alias("family"))
    whole = signed.select("row_id", "doc_id", F.col("n").cast("long").alias("n_shingles")).join(labels, "row_id", "left").withColumn("family", F.coalesce("family", "row_id"))
    ranked = with_group_min(whole.withColumn("__id", F.struct("doc_id", "row_id")), ["family"], "__id", ["row_id"], ("low", "size"))
    return ranked.select("row_id", "doc_id", "n_shingles", F.col("low.doc_id").alias("component_id"), (F.col("low.row_id") == F.col("row_id")).alias("first"))


def _labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, family) for all nodes; a node without links is its own family."""
    found = connected_components(links)
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("family"))


def _joined_families(families: DataFrame, links: DataFrame) -> DataFrame:
    """(node, family) after ``links`` (a, b) between families: only these become a graph, of families."""
    of = lambda end: families.select(F.col("node").alias(end), F.col("family").alias(f"of_{end}"))
    joined = connected_components(links.join(of("a"), "a").join(of("b"), "b"), "of_a", "of_b").withColumnRenamed("node", "family")
    return families.join(small(joined, joined.count()), "family", "left").select("node", F.coalesce("component", "family").alias("family"))


def deduplicated(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``docs`` with the first row of each component of near duplicates only."""
    docs = placed(docs)
    return without(docs, near_duplicates(docs, s).filter(~F.col("first")), "minhash-gone")


def report(docs: DataFrame) -> DataFrame:
    """Two-word shingles: per document its set's size, its component and whether it is kept."""
    return near_duplicates(docs, Settings(words=2)).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


REPORT_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') l FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(l[i:i+1], ' ') g FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l), 2))) i FROM w WHERE len(l) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
o AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
t AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a, b FROM t UNION SELECT r.a, t.b FROM r JOIN t ON r.b = t.a)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(min(r.b), w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(min(r.b), w.doc_id)) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = w.doc_id GROUP BY w.doc_id"""
