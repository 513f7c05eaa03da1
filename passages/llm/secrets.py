"""Secrets in texts by a trigram inverted index, with DataFrame operations only.

Each rule is a regular expression. From it a Boolean query over trigrams is derived: clauses, one of
which must have all its trigrams in any text that the rule can match. The index, a stored table, holds which
rows have which trigrams (lower-cased), for the trigrams that the clauses of a set of rules name; it serves any
rules whose trigrams it has, also later. Intersecting the postings of a
clause gives its candidate rows, and only those are read again and verified with the expression.
Rules without a mandatory trigram read every row. Spans count code points, end exclusive.

Defined results: a null or empty text has no spans; repeated rows are told apart by their place; other columns,
the text too, pass unchanged, but one named ``spans`` is replaced; for ``docs`` see ``common.placed``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from passages.llm.common import placed, small, with_row_id, written


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds leftmost non-overlapping matches; one counts if ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int
    least: int


#: The base rules, in the order of their kinds. A match of ``AKIA[A-Z0-9]+`` or ``[0-9a-f]+`` is a run to
#: its end, and one that is too short holds no other, so their least lengths can stand in the expression;
#: then only what counts becomes a row. An ``assign`` that fails can hide another, so its test comes after.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Rules beyond the base: private key headers, signed web tokens and prefixed tokens.
EXTRA_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("prefixed", r"(?:ghp_|gho_|glpat-|xoxb-|xoxp-)[A-Za-z0-9_-]+", 0, 20),
)
RULES = BASE_RULES + EXTRA_RULES

_parser = re._parser
_MOST = 64  # strings that a part may stand for before it counts as unknown


def _grams(strings: set[str]) -> set[frozenset[str]] | None:
    """Clauses for a text that must hold one of ``strings``; None: nothing is mandatory."""
    found = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return None if frozenset() in found else found


def _both(a: set | None, b: set | None) -> set | None:
    if a is None or b is None:
        return b if a is None else a
    return {x | y for x in a for y in b}


def _walk(items) -> tuple[set[str] | None, set | None]:
    """(the strings a sequence can be, or None if not a few; the clauses that any match fulfils)."""
    now, clauses, exact = {""}, None, True
    for op, arg in items:
        name, part, inner = str(op), None, None
        if name == "LITERAL":
            part = {chr(arg).lower()}
        elif name == "SUBPATTERN":
            part, inner = _walk(arg[3])
        elif name == "BRANCH":
            parts = [_walk(x) for x in arg[1]]
            if all(s is not None for s, _ in parts):
                part = set().union(*[s for s, _ in parts])
            elif all(c is not None for _, c in parts):
                inner = set().union(*[c for _, c in parts])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, body = arg
            strings, inner = _walk(body)
            if strings is not None and int(high) <= 1:
                part, inner = strings | ({""} if low == 0 else set()), None
            elif low == 0:
                inner = None
        elif name == "AT":
            part = {""}
        if part is not None and len(now) * len(part) <= _MOST:
            now = {a + b for a, b in product(now, part)}
        else:
            clauses, exact, now = _both(_both(clauses, _grams(now)), inner), False, {""}
    return (now, None) if exact else (None, _both(clauses, _grams(now)))


def trigram_clauses(pattern: str) -> list[frozenset[str]]:
    """Sets of lower-cased trigrams, one of which is whole in any text that ``pattern`` matches;
    an empty list if the pattern has no mandatory trigram."""
    strings, clauses = _walk(_parser.parse(pattern))
    found = _grams(strings) if strings is not None else clauses
    return sorted(found or [], key=sorted)


def _matches(text: Column, rule: Rule) -> Column:
    """Each match of a text with the piece before it: the pieces between matches are the same
    expression's splits, so positions follow from lengths."""
    pieces, found = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    each = F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("piece"), found.alias("found"), group.alias("grp"))
    return F.transform(each, lambda x: F.struct(F.length(x["piece"]).alias("before"), F.length(x["found"]).alias("size"), F.length(x["grp"]).alias("judged")))


def _verified(rows: DataFrame, rules: list[Rule], candidate) -> DataFrame:
    """(row_id, kind, start, end) of what the rules find in rows; ``candidate(rule)`` says which rows to try."""
    tried = [
        F.when(candidate(r) & F.col("__text").rlike(r.pattern), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.least).alias("least"), _matches(F.col("__text"), r).alias("each")))
        for r in rules
    ]
    by_kind = rows.select("row_id", F.explode(F.filter(F.array(*tried), lambda x: x.isNotNull())).alias("m"))
    by_match = by_kind.select("row_id", "m.kind", "m.least", F.posexplode("m.each").alias("no", "x"))
    before = W.partitionBy("row_id", "kind").orderBy("no").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("x.before") + F.col("x.size")).over(before)
    return by_match.withColumn("end", end).filter("x.judged >= least").select("row_id", "kind", (F.col("end") - F.col("x.size")).alias("start"), "end")


def trigrams_of(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({t for r in rules for c in trigram_clauses(r.pattern) for t in c})


def trigram_index(docs: DataFrame, trigrams: list[str], text: str = "text") -> DataFrame:
    """(row_id, trigram): the stored postings of ``trigrams`` in the texts of ``docs``."""
    low = with_row_id(docs.select(text)).select("row_id", F.lower(text).alias("low"))
    has = F.filter(F.array(*[F.when(F.col("low").contains(t), F.lit(t)) for t in trigrams]), lambda x: x.isNotNull())
    return written(low.select("row_id", F.explode(has).alias("trigram")), "secret-index")


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(row_id, kinds): the rows whose postings fulfil a clause of each of the kinds."""
    clauses = [(f"{r.kind}/{i}", r.kind, t, len(c)) for r in rules for i, c in enumerate(trigram_clauses(r.pattern)) for t in sorted(c)]
    query = index.sparkSession.createDataFrame(clauses, "clause string, kind string, trigram string, n int")
    return (
        index.join(F.broadcast(query), "trigram")  # as long as the rules, never the data
        .groupBy("row_id", "clause", "kind")
        .agg((F.count("*") == F.first("n")).alias("all"))
        .filter("all")
        .groupBy("row_id")
        .agg(F.collect_set("kind").alias("kinds"))
    )


def secret_spans(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, index: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``spans``, an array of (start, order of the rule, kind, end), sorted. ``index``: an earlier
    :func:`trigram_index` of the same files that holds all trigrams of the rules."""
    docs = placed(docs)
    texts = with_row_id(docs.select(text)).select("row_id", F.coalesce(F.col(text), F.lit("")).alias("__text"))
    indexed = tuple(r for r in rules if trigram_clauses(r.pattern))
    scanned = [r for r in rules if r not in indexed]
    found = []
    if scanned:
        found.append(_verified(texts, scanned, lambda r: F.lit(True)))
    if indexed:
        index = trigram_index(docs, trigrams_of(indexed), text) if index is None else index
        picked = written(candidates(index, indexed), "secret-candidates")
        again = texts.join(small(picked, picked.count()), "row_id")
        found.append(_verified(again, indexed, lambda r: F.array_contains("kinds", r.kind)))
    spans = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    order = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind"))
    by_row = spans.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("start", order.alias("no"), "kind", "end"))).alias("__spans"))
    none = F.array().cast("array<struct<start:bigint,no:bigint,kind:string,end:bigint>>")
    rows = with_row_id(docs.drop("spans"), "__row").join(by_row.withColumnRenamed("row_id", "__row"), "__row", "left")
    return rows.withColumn("spans", F.coalesce("__spans", none)).drop("__row", "__spans")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def secret_report(docs: DataFrame) -> DataFrame:
    """Per document its counts by base kind, the digest of its base spans and all of its spans."""
    kinds = [r.kind for r in BASE_RULES]
    spans = F.col("spans")
    return secret_spans(docs.select("doc_id", "text")).drop("text").select(
        "doc_id",
        *[_count_of(spans, k).alias(f"n_{k}") for k in kinds],
        F.sha2(_joined(F.filter(spans, lambda s: s["kind"].isin(*kinds))), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
    )


def report_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL: each match's place from the lengths of matches and of the pieces between them."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    length = lambda part: f"coalesce(list_sum(list_transform({part}, lambda x: length(x))), 0)"
    parts = []
    for no, r in enumerate(rules):
        rx = quoted(r.pattern)
        parts.append(f"SELECT doc_id, text, {no} AS no, {quoted(r.kind)} AS kind, {r.least} AS least, regexp_extract_all(text, {rx}) m, regexp_extract_all(text, {rx}, {r.group}) g, string_split_regex(text, {rx}) p FROM docs WHERE regexp_matches(text, {rx})")
    kinds = [r.kind for r in BASE_RULES]
    joined = lambda where: f"coalesce(string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, no) FILTER ({where}), '')"
    base = "kind IN (" + ", ".join(map(quoted, kinds)) + ")"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(parts)}),
k AS (SELECT *, unnest(range(1, len(m) + 1)) i FROM m),
s AS (SELECT doc_id, no, kind, least, length(g[i]) judged, ({length("p[1:i]")} + {length("m[1:i-1]")})::BIGINT st, length(m[i]) size FROM k),
f AS (SELECT doc_id, no, kind, st, st + size en FROM s WHERE judged >= least)
SELECT d.doc_id, {", ".join(f"count(*) FILTER (kind = {quoted(x)}) AS n_{x}" for x in kinds)}, sha256({joined(base)}) AS base_sha256, {joined("kind IS NOT NULL")} AS spans
FROM docs d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id"""
