"""Codes of vectors: each part of a vector is replaced by the nearest entry of its codebook, found in a GNAT.

Components become integers; each part position has a codebook that starts as that part of the first vectors and follows its parts
for some rounds. A round is one pass in which every task finds its parts' nearest entries and sums them up, and one grouped sum of these few
rows; only codebooks, whose size the settings fix, go through the driver. A codebook's entries are kept in a GNAT: split points that hold, for each
other split point's subtree, the range of distances from them to it. A query's distance to a split point rules out each
subtree whose range lies further away than the nearest entry so far, strictly, with roots rounded so that no entry that is as near can be lost; distances
are compared as integers, ties go to the lower entry.

Defined results: vectors that are null or empty or hold a null or a non-finite component have no row; nor have vectors of another length than the first
kept one, or with components too large for squared distances in 64 bits (beyond 2**15 for 64 components and a scale of 4096);
lengths that the parts do not divide are filled up with zeros; repeated ids are separate rows, null ids come last; with fewer vectors than entries
the codebooks are that much smaller; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passages.llm.common import BROADCAST_ROWS, salt, written


@dataclass(frozen=True)
class Settings:
    parts: int = 8
    entries: int = 16  #: of a codebook, at most 256
    rounds: int = 6
    scale: int = 4096  #: components become floor(scale * x)
    ways: int = 4  #: split points of a GNAT node


_SLACK = 2.0**-50


def _up(x):
    return x * (1 + _SLACK)


def _down(x):
    return x * (1 - _SLACK)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


class Gnat:
    """Nearest entry of integer vectors. ``scanned`` counts the distances computed."""

    def __init__(self, entries: np.ndarray, ways: int = 4):
        self.entries, self.ways, self.scanned = entries, ways, 0
        self.root = self._build(np.arange(len(entries)))

    def _build(self, members: np.ndarray):
        if len(members) <= self.ways:
            return members, [], None, None
        split, least = [members[0]], _squared(self.entries[members], self.entries[members[0]])
        while len(split) < self.ways and least.max() > 0:  # the entry furthest from the split points so far
            split.append(members[least.argmax()])
            least = np.minimum(least, _squared(self.entries[members], self.entries[split[-1]]))
        if len(split) == 1:  # equal entries: the first is the lowest, the others never win
            return members[:1], [], None, None
        far = np.stack([_squared(self.entries[members], self.entries[i]) for i in split])
        owner, roots = far.argmin(axis=0), np.sqrt(far.astype(float))
        owner[np.isin(members, split)] = [split.index(m) for m in members[np.isin(members, split)]]
        low = np.array([[_down(r[owner == j].min()) for j in range(len(split))] for r in roots])
        high = np.array([[_up(r[owner == j].max()) for j in range(len(split))] for r in roots])
        below = [self._build(members[(owner == j) & ~np.isin(members, split)]) for j in range(len(split))]
        return np.array(split), below, low, high

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row of ``x``."""
        best = np.full(len(x), len(self.entries)), np.full(len(x), np.iinfo(np.int64).max)
        self._search(self.root, x, np.arange(len(x)), *best)
        return best

    def _search(self, node, x: np.ndarray, rows: np.ndarray, entry: np.ndarray, least: np.ndarray) -> None:
        split, below, low, high = node
        alive = np.ones((len(split), len(rows)), dtype=bool)
        seen: list[tuple[np.ndarray, np.ndarray]] = []  # for each split point: whose distances, and these
        for i, at in enumerate(split):
            mine = np.flatnonzero(alive[i])
            r = rows[mine]
            d = _squared(x[r], self.entries[at])
            self.scanned += len(r)
            better = (d < least[r]) | ((d == least[r]) & (at < entry[r]))
            least[r[better]], entry[r[better]] = d[better], at
            seen.append((mine, np.sqrt(d.astype(float))))
            if below:
                self._rule_out(alive, seen[-1], low[i], high[i], least[rows], range(i + 1, len(split)))
        for j, child in enumerate(below):
            if len(child[0]):
                for i, one in enumerate(seen):  # the nearest entry so far may have come nearer
                    self._rule_out(alive, one, low[i], high[i], least[rows], [j])
                if alive[j].any():
                    self._search(child, x, rows[alive[j]], entry, least)

    @staticmethod
    def _rule_out(alive, seen, low, high, least, children) -> None:
        """Subtrees all of whose members are further away than the nearest entry so far."""
        mine, d = seen
        radius = _up(np.sqrt(least[mine].astype(float)))
        for j in children:
            alive[j, mine] &= ~((_down(_down(d) - high[j]) > radius) | (_down(low[j] - _up(d)) > radius))


def _cells(batch: pa.RecordBatch, dim: int, s: Settings) -> np.ndarray:
    """(rows, parts, components) of a batch."""
    column = batch.column("__cells")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)
    wide = -(-dim // s.parts) * s.parts
    return np.pad(flat, ((0, 0), (0, wide - dim))).reshape(len(column), s.parts, -1)


def _trees(books: np.ndarray, s: Settings) -> list[Gnat]:
    return [Gnat(book, s.ways) for book in books]


def _summed(batches: Iterator[pa.RecordBatch], books: np.ndarray, dim: int, s: Settings) -> Iterator[pa.RecordBatch]:
    """A task's sums: for each part and entry, of each component and their count."""
    trees, total, n = _trees(books, s), np.zeros_like(books), np.zeros(books.shape[:2], dtype=np.int64)
    for batch in batches:
        if len(batch):
            cells = _cells(batch, dim, s)
            for p, tree in enumerate(trees):
                entry = tree.nearest(cells[:, p])[0]
                np.add.at(total[p], entry, cells[:, p])
                n[p] += np.bincount(entry, minlength=len(n[p]))
    if n.any():
        part, entry, at = (x.ravel().astype(np.int32) for x in np.indices(books.shape))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part, entry, at, total.ravel(), np.broadcast_to(n[:, :, None], books.shape).ravel())], names=["part", "entry", "at", "total", "n"])


def _coded(batches: Iterator[pa.RecordBatch], books: np.ndarray, dim: int, s: Settings, kept: list[str]) -> Iterator[pa.RecordBatch]:
    trees = _trees(books, s)
    for batch in batches:
        if len(batch):
            cells = _cells(batch, dim, s)
            found = [tree.nearest(cells[:, p]) for p, tree in enumerate(trees)]
            codes = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
            error = sum(f[1] for f in found)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array([bytes(c).hex() for c in codes]), pa.array(error)], names=[*kept, "code", "error"])


def integers(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = (), s: Settings = Settings()) -> tuple[DataFrame, int]:
    """(stored table of key, kept columns and ``__cells``; their length) of the vectors that take part."""
    x = F.col(vector)
    sound = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.filter(F.coalesce(sound, F.lit(False)))
    first = rows.orderBy(F.col(key).asc_nulls_last(), vector).select(F.size(x)).first()
    dim = first[0] if first else 0
    most = isqrt((1 << 61) // max(dim, 1))
    scaled = F.transform(x, lambda v: v.cast("double") * s.scale)
    rows = rows.filter(F.size(x) == dim).filter(F.forall(scaled, lambda v: F.abs(v) < most))
    cells = F.transform(scaled, lambda v: F.floor(v).cast("long"))
    return written(rows.select(key, *keep, cells.alias("__cells")), "integers"), dim


def fitted(cells: DataFrame, dim: int, key: str = "vec_id", s: Settings = Settings()) -> np.ndarray:
    """The codebooks, (parts, entries, components), of the table that :func:`integers` gives."""
    if not 0 < s.entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    first = cells.orderBy(F.col(key).asc_nulls_last(), "__cells").limit(s.entries).select("__cells").toArrow()  # at most 256 rows
    books = np.concatenate([_cells(b, dim, s) for b in first.to_batches()] or [np.zeros((0, s.parts, 1), dtype=np.int64)]).transpose(1, 0, 2)
    if not books.size:
        return books
    for _ in range(s.rounds):
        sums = cells.select("__cells").mapInArrow(partial(_summed, books=books, dim=dim, s=s), "part int, entry int, at int, total long, n long")
        found = sums.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).filter("n > 0").toPandas()  # as many rows as the codebooks have numbers
        books = books.copy()
        books[found["part"], found["entry"], found["at"]] = found["total"].to_numpy() // found["n"].to_numpy()
    return books


def encoded(cells: DataFrame, books: np.ndarray, dim: int, s: Settings = Settings()) -> DataFrame:
    """(kept columns, code, error) of each row of ``cells``: two hex digits for each part, and the sum of squared distances."""
    kept = [f for f in cells.schema if f.name != "__cells"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", code string, error long"
    return cells.mapInArrow(partial(_coded, books=books, dim=dim, s=s, kept=[f.name for f in kept]), schema)


def with_total(rows: DataFrame, group: str, value: str, to: str, salts: int = 64, most: int = BROADCAST_ROWS) -> DataFrame:
    """Adds the sum of ``value`` over equal ``group``, nulls together. The sums are broadcast if they are at most ``most``; else each group
    is dealt over ``salts`` tasks."""
    dealt = rows.withColumn("__salt", salt(salts, *[F.col(c) for c in rows.columns]))
    parts = dealt.groupBy(F.col(group).alias("__group"), F.col("__salt").alias("__s")).agg(F.sum(value).alias("__sum"))
    whole = written(parts.groupBy("__group").agg(F.sum("__sum").alias(to), F.collect_list("__s").alias("__s")), "sums")
    same = F.col(group).eqNullSafe(F.col("__group"))
    if whole.count() <= most:
        return rows.join(F.broadcast(whole.drop("__s")), same).drop("__group")
    return dealt.join(whole.withColumn("__s", F.explode("__s")), same & (F.col("__salt") == F.col("__s"))).drop("__group", "__s", "__salt")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def report(vectors: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of each vector that takes part."""
    cells, dim = integers(vectors, keep=("label",), s=s)
    books = fitted(cells, dim, s=s)
    coded = written(encoded(cells, books, dim, s), "codes")
    return with_total(coded, "label", "error", "label_error").withColumn("codebooks_sha256", F.lit(digest(books)))


def report_sql(s: Settings = Settings()) -> str:
    """The same by all distances, for vectors whose length the parts divide."""
    near = "list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - b.v[i]) * (p.v[i] - b.v[i])))"
    out = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 i, vec_id, label, list_transform(embedding, lambda x: floor({s.scale} * x::DOUBLE)::BIGINT) v FROM embeddings
 WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT i, part, v[part * len(v) // {s.parts} + 1 : (part + 1) * len(v) // {s.parts}] v FROM v, (SELECT unnest(range(0, {s.parts})) part)),
b0 AS MATERIALIZED (SELECT part, i entry, v FROM p WHERE i < {s.entries}), """
    for r in range(s.rounds + 1):
        out += f"a{r} AS MATERIALIZED (SELECT p.i, p.part, entry, d, v FROM (SELECT p.i, p.part, p.v, entry, {near} d FROM p JOIN b{r} b USING (part)) p QUALIFY row_number() OVER (PARTITION BY i, part ORDER BY d, entry) = 1),\n"
        if r < s.rounds:
            out += f"""b{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n.v, o.v) v FROM b{r} o LEFT JOIN (SELECT part, entry, array_agg(m ORDER BY k) v FROM
 (SELECT part, entry, k, floor(sum(x)::DOUBLE / count(*))::BIGINT m FROM (SELECT part, entry, unnest(range(0, len(v))) k, unnest(v) x FROM a{r}) GROUP BY ALL) GROUP BY ALL) n USING (part, entry)),
"""
    return out + f"""c AS (SELECT i, string_agg(format('{{:02x}}', entry), '' ORDER BY part) code, sum(d)::BIGINT error FROM a{s.rounds} GROUP BY i)
SELECT vec_id, label, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM b{s.rounds}) AS codebooks_sha256 FROM c JOIN v USING (i)"""
