"""Benchmark decontamination by SimHash of item-sized windows, with DataFrame operations only.

A window is a run of as many words of a document as the item has, cut at the document's end. Windows and
items are compared as multisets of 5-word shingles: sum of minima over sum of maxima, at least 0.8.

1. Anchors: a window that similar misses at most a fifth of the item's shingles, so it holds one of any set
   that weighs more. Each item's rarest such set is looked up in all documents; only windows that
   hold an anchor, all of them, are fingerprinted. Nothing is lost by this.
2. Fingerprints: 64-bit SimHash of a window's shingles, counted in 32 sums of two 32-bit lanes.
3. Multi-index: in 8 blocks of 8 bits, two fingerprints within ``radius`` differ by ``radius // 8`` bits at
   most in some block. The items' index holds all values so close, and a join on (item, block, value)
   finds every pair within the radius. At similarity 0.8 a pair of fingerprints differs by 9.7 bits
   on average, and by more than the default of 23 about once in a million pairs.
4. Verification of the found windows on the whole multisets.

Words are runs of letters and digits, lower-cased. Items of fewer than five words are one shingle.

Defined results: null or empty texts and items without words match nothing; repeated rows of either table are
compared each; windows of equal similarity give the first; for both tables
see ``common.placed``.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from passages.llm.common import placed, small, with_row_id, without, written


@dataclass(frozen=True)
class Settings:
    words: int = 5
    percent: int = 80
    radius: int = 23  #: bits that fingerprints of a candidate pair may differ by


_LANES = 0x0000000100000001
_BLOCKS = 8
_PART = 4  # words of a document that are hashed together, times the item's


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shingle(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(words, at + i) for i in range(k)])


def fingerprint(rows: DataFrame, keys: list[str]) -> DataFrame:
    """SimHash ``fp`` of the long ``hash`` of all rows of each key: a bit is set if more than half of the hashes have it."""
    sums = [F.sum(F.shiftrightunsigned("hash", i).bitwiseAND(F.lit(_LANES))).alias(f"s{i}") for i in range(32)]
    counted = rows.groupBy(*keys).agg(*sums, F.count("*").alias("n_shingles"))
    half, one, none = F.col("n_shingles") / 2, F.lit(1).cast("long"), F.lit(0).cast("long")
    bit = lambda count, i: F.when(count > half, F.call_function("shiftleft", one, i)).otherwise(none)
    pair = lambda both, i: bit(both.bitwiseAND(F.lit(0xFFFFFFFF)), i).bitwiseOR(bit(F.shiftrightunsigned(both, 32), i + 32))
    bits = F.transform(F.array(*[F.col(f"s{i}") for i in range(32)]), pair)
    return counted.select(*keys, "n_shingles", F.aggregate(bits, none, lambda a, x: a.bitwiseOR(x)).alias("fp"))


def _block(fp: Column, block: Column) -> Column:
    return F.expr("shiftrightunsigned(fp, 8 * block) & 255").cast("int")


def _item_tables(items: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(irow, item_id, n, k, hash, c, q) by distinct shingle with its count and first offset, and (irow, fp)."""
    rows = with_row_id(items.select("item_id", "text"), "irow").withColumn("w", words_of(F.col("text"))).withColumn("n", F.size("w")).filter("n > 0")
    rows = rows.withColumn("k", F.least(F.col("n"), F.lit(s.words)))
    at = rows.select("irow", "item_id", "n", "k", "w", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("k"))).alias("q"))
    hashed = F.coalesce(*[F.when(F.col("k") == k, _shingle(F.col("w"), F.col("q"), k)) for k in range(1, s.words + 1)])
    each = written(at.select("irow", "item_id", "n", "k", "q", hashed.alias("hash")), "decontam-items")
    distinct = each.groupBy("irow", "item_id", "n", "k", "hash").agg(F.count("*").alias("c"))
    return written(distinct, "decontam-shingles"), written(fingerprint(each, ["irow"]), "decontam-fingerprints")


def _anchors(shingles: DataFrame, s: Settings) -> DataFrame:
    """For each item its shingles that are rarest among items, as many as weigh more than a match can miss."""
    among = shingles.groupBy("hash").agg(F.sum("c").alias("among"))
    order = W.partitionBy("irow").orderBy("among", "hash")  # as long as one item's text
    total = F.col("n") - F.col("k") + 1
    before = F.sum("c").over(order.rowsBetween(W.unboundedPreceding, -1))
    kept = shingles.join(among, "hash").withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") * 100 <= total * (100 - s.percent))
    return kept.select("hash", "irow", "n", "k")


def leaks(docs: DataFrame, items: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(row_id, doc_id, item_id, start, overlap, union_size): the most similar window of each pair, counted in words."""
    shingles, item_fps = _item_tables(items, s)
    n_shingles = shingles.count()
    anchors = written(_anchors(shingles, s), "decontam-anchors")
    rows = with_row_id(docs.select("doc_id", "text")).withColumn("w", words_of(F.col("text"))).withColumn("nw", F.size("w"))
    regions = None
    for (k,) in shingles.select("k").distinct().collect():  # at most s.words values
        at = rows.filter(F.col("nw") >= k).select("row_id", "w", F.explode(F.sequence(F.lit(0), F.col("nw") - k)).alias("pos"))
        places = at.select("row_id", "pos", _shingle(F.col("w"), F.col("pos"), k).alias("hash"))
        hits = places.join(small(anchors.filter(F.col("k") == k).drop("k"), n_shingles), "hash")
        starts = hits.select("row_id", "irow", "n", F.explode(F.sequence(F.greatest(F.col("pos") - F.col("n") + k, F.lit(0)), F.col("pos"))).alias("start"))
        # a part of a document has few times the item's words, so long documents and many hits make more rows, not longer ones
        parts = starts.withColumn("part", F.floor(F.col("start") / (_PART * F.col("n"))))
        found = written(parts.groupBy("row_id", "irow", "n", "part").agg(F.sort_array(F.collect_set("start")).alias("starts")), "decontam-starts")
        low, high = F.col("starts")[0], F.least(F.array_max("starts") + F.col("n") - k, F.col("nw") - k)
        near = rows.join(small(found, _n_starts(found)), "row_id")
        part = near.select("row_id", "doc_id", "irow", "n", "part", F.lit(k).alias("k"), low.alias("low"), "starts", F.sequence(low, high).alias("at"), "w")
        part = part.withColumn("region", _hashed_at(k)).drop("at", "w")
        regions = part if regions is None else regions.unionByName(part)
    if regions is None:
        return docs.sparkSession.createDataFrame([], "row_id long, doc_id long, item_id long, start int, overlap long, union_size long")
    regions = written(regions, "decontam-regions").repartition("row_id", "irow", "part")

    def shingled(windows: DataFrame) -> DataFrame:
        each = windows.select("row_id", "irow", "part", "n", "k", "low", "region", F.explode("starts").alias("start"))
        first = F.col("start") - F.col("low")
        last = F.least(first + F.col("n") - F.col("k"), F.size("region") - 1)
        return each.select("row_id", "irow", "part", "start", "region", F.explode(F.sequence(first, last)).alias("j")).select("row_id", "irow", "part", "start", F.get("region", F.col("j")).alias("hash"))

    windows = fingerprint(shingled(regions), ["row_id", "irow", "part", "start"])
    near_masks = [sum(1 << b for b in c) for d in range(s.radius // _BLOCKS + 1) for c in combinations(range(8), d)]
    blocks = F.explode(F.sequence(F.lit(0), F.lit(_BLOCKS - 1))).alias("block")
    index = item_fps.select("irow", "fp", blocks).select("irow", F.col("fp").alias("item_fp"), "block", F.explode(F.array(*[F.lit(m) for m in near_masks])).alias("mask"), _block(F.col("fp"), F.col("block")).alias("own"))
    index = index.select("irow", "item_fp", "block", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
    probes = windows.select("row_id", "irow", "part", "start", "fp", blocks).withColumn("value", _block(F.col("fp"), F.col("block")))
    met = probes.join(small(index, n_shingles * _BLOCKS * len(near_masks)), ["irow", "block", "value"])
    met = met.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= s.radius)
    candidates = written(met.groupBy("row_id", "irow", "part").agg(F.collect_set("start").alias("starts")), "decontam-candidates")

    again = regions.drop("starts").join(small(candidates, _n_starts(candidates)), ["row_id", "irow", "part"])
    window = ["row_id", "irow", "part", "start"]
    counts = shingled(again).groupBy(*window, "hash").agg(F.count("*").alias("c"))
    sizes = counts.groupBy(*window).agg(F.sum("c").alias("size"))
    known = shingles.select("irow", "hash", F.col("c").alias("ci"))
    shared = counts.join(small(known, n_shingles), ["irow", "hash"]).groupBy(*window).agg(F.sum(F.least("c", "ci")).alias("overlap"))
    per_item = shingles.select("irow", "item_id", (F.col("n") - F.col("k") + 1).cast("long").alias("total")).distinct()
    scored = shared.join(sizes, window).join(small(per_item, n_shingles), "irow")
    scored = scored.withColumn("union_size", F.col("size") + F.col("total") - F.col("overlap")).filter(F.col("overlap") * 100 >= F.col("union_size") * s.percent)
    best = scored.groupBy("row_id", "irow", "item_id").agg(F.max(F.struct((F.col("overlap") / F.col("union_size")).alias("sim"), (-F.col("start")).alias("neg"), "overlap", "union_size")).alias("b"))
    ids = regions.select("row_id", "irow", "doc_id").distinct()
    return best.join(ids, ["row_id", "irow"]).select("row_id", "doc_id", "item_id", (-F.col("b.neg")).alias("start"), "b.overlap", "b.union_size")


def _n_starts(lists: DataFrame) -> int:
    """Rows and starts in them: what a broadcast of lists would hold."""
    return lists.agg(F.count("*") + F.coalesce(F.sum(F.size("starts")), F.lit(0))).first()[0]


def _hashed_at(k: int) -> Column:
    return F.transform("at", lambda i: _shingle(F.col("w"), i, k))


def decontaminated(docs: DataFrame, items: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``docs`` without the rows that hold a window similar to an item."""
    docs = placed(docs)
    return without(docs, leaks(docs, items, s).select("row_id").distinct(), "decontam-leaks")


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document and item with a similar window: its start and size of overlap and union in shingles."""
    return leaks(docs, items).select("doc_id", "item_id", F.col("start").cast("long").alias("start"), "overlap", "union_size", F.round(F.col("overlap") / F.col("union_size"), 6).alias("similarity"))


REPORT_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') w FROM documents),
i AS (SELECT item_id, w, len(w) n, least(len(w), 5) k FROM (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') w FROM benchmark) WHERE len(w) > 0),
dp AS (SELECT doc_id, p, array_to_string(w[p:p+4], ' ') s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) p FROM d)),
ip AS (SELECT item_id, n, k, s, count(*) c FROM (SELECT item_id, n, k, array_to_string(w[q:q+4], ' ') s FROM (SELECT item_id, n, k, w, unnest(range(1, n - k + 2)) q FROM i)) GROUP BY ALL),
starts AS (SELECT DISTINCT doc_id, item_id, n, k, unnest(range(greatest(p - n + k, 1), p + 1)) st FROM dp JOIN ip USING (s)),
cw AS (SELECT doc_id, item_id, n, k, st, s, count(*) c FROM starts JOIN dp USING (doc_id) WHERE p BETWEEN st AND st + n - k GROUP BY ALL),
sc AS (SELECT doc_id, item_id, n, k, st, sum(cw.c) size, sum(least(cw.c, coalesce(c2, 0))) overlap FROM cw LEFT JOIN (SELECT item_id i2, s s2, c c2 FROM ip) x ON cw.item_id = i2 AND cw.s = s2 GROUP BY ALL),
u AS (SELECT *, size + n - k + 1 - overlap un FROM sc WHERE overlap * 100 >= (size + n - k + 1 - overlap) * 80)
SELECT doc_id, item_id, (st - 1)::BIGINT AS start, overlap::BIGINT overlap, un::BIGINT union_size, round(overlap / un, 6) similarity
FROM u QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY overlap / un DESC, st) = 1"""
