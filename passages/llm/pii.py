"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, URL schemes and the
cues of account numbers. A small parser for each kind expands an anchor to both sides and validates
what it finds, so the cost beyond the pass follows the number of anchors, not the text's length.
Spans count code points, end exclusive.

Defined results: a null or empty text has no spans; repeated rows are scanned alike; other columns
pass unchanged, but a column named as the output is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passages.llm.common import tidy

#: Kinds that the base rules define, in their order.
BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds that only cues lead to: IBANs, cued account numbers, social security numbers, URLs with credentials.
EXTRA_KINDS = ("iban", "account", "ssn", "url")
KINDS = BASE_KINDS + EXTRA_KINDS
SPANS = "array<struct<kind:string,start:int,end:int>>"

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[A-Za-z0-9._~%+-]++(?::[^\s@/]*+)?@[A-Za-z0-9.-]++(?::[0-9]++)?(?:/[^\s<>\"']*+)?")
_IBAN = re.compile(r"[ :#]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Z0-9])")
_ACCOUNT = re.compile(r"(?:[ ]?(?:number|num|no|nr)\.?)?[ :#=]{1,4}([0-9](?:[ -]?[0-9]){5,16})(?![0-9])", re.I)
_SSN = re.compile(r"[ :#=]{0,4}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
_CUES = {"iban": "iban", "account": "account", "acct": "account", "ssn": "ssn"}
_SCHEMES = ("http://", "https://", "ftp://", "ssh://")


@cache
def _automaton() -> ahocorasick.Automaton:
    anchors = {"@": "@", "+": "+", **dict.fromkeys("0123456789", "0"), **dict.fromkeys(_SCHEMES, "url")}
    for cue, kind in _CUES.items():
        anchors |= dict.fromkeys((cue, cue.upper(), cue.capitalize()), kind)
    automaton = ahocorasick.Automaton()
    for word, kind in anchors.items():
        automaton.add_word(word, (kind, len(word)))
    automaton.make_automaton()
    return automaton


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _iban_ok(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of one text, by start, then kind as listed in KINDS."""
    if not text:
        return []
    found: list[tuple[int, int, int]] = []
    email_free = last_at = chain_free = card_free = phone_free = url_free = 0
    for last, (kind, size) in _automaton().iter(text):
        at = last + 1 - size
        if kind == "0":
            if at >= chain_free:
                m = _CHAIN.match(text, at)
                chain_free = m.end()
                if m.group().count(".") >= 3:
                    runs, start = m.group().split("."), at
                    for i in range(0, len(runs) - 3, 4):
                        end = start + sum(map(len, runs[i : i + 4])) + 3
                        if all(len(r.lstrip("0")) <= 3 and int(r.lstrip("0") or 0) <= 255 for r in runs[i : i + 4]):
                            found.append((start, 1, end))
                        start = end + 1
            if at >= card_free and (m := _CARD.match(text, at)):
                card_free = m.end()
                if m.end() - at >= 14:
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and _luhn(digits):
                        found.append((at, 2, m.end()))
        elif kind == "@":
            before = text[max(email_free, last_at) : at]
            start = len(before.rstrip(_LOCAL)) - len(before) + at
            last_at = at + 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                found.append((start, 0, m.end()))
                email_free = m.end()
        elif kind == "+":
            if at >= phone_free and (m := _PHONE.match(text, at)):
                phone_free = m.end()
                if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    found.append((at, 3, m.end()))
        elif kind == "url":
            if at >= url_free and (m := _URL.match(text, last + 1)):
                found.append((at, KINDS.index("url"), m.end()))
                url_free = m.end()
        elif kind == "iban":
            if m := _IBAN.match(text, last + 1):
                said = m.group(1)
                while len(said) >= 15 and not _iban_ok(said):  # capitals may follow it
                    said = said.rpartition(" ")[0]
                if len(said) >= 15:
                    found.append((m.start(1), KINDS.index("iban"), m.start(1) + len(said)))
        elif kind == "account":
            if m := _ACCOUNT.match(text, last + 1):
                found.append((m.start(1), KINDS.index("account"), m.end()))
        elif (m := _SSN.match(text, last + 1)) and m.group(1)[:3] not in ("000", "666"):
            found.append((m.start(1), KINDS.index("ssn"), m.end()))
    return [(KINDS[k], start, end) for start, k, end in sorted(set(found))]


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each run of overlapping spans replaced by the tag of its first kind."""
    if not spans:
        return text
    out, done = [], 0
    for kind, start, end in spans:
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])


@tidy
def _spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t)] for t in texts], dtype=object)


@tidy
def _redacted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([redact(t, find_spans(t)) for t in texts], dtype=object)


def pii_spans(docs: DataFrame, text: str = "text", to: str = "spans") -> DataFrame:
    """Adds every span of ``text`` as an array of (kind, start, end)."""
    return docs.withColumn(to, F.pandas_udf(_spans, SPANS)(F.col(text)))


def pii_redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replaces each span of ``text`` by a tag such as ``<EMAIL>``; null stays null."""
    return docs.withColumn(text, F.pandas_udf(_redacted, "string")(F.col(text)))


def joined(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """``kind:start:end`` of spans, in their order, comma-joined; only those of ``kinds`` if given."""
    kept = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def pii_report(docs: DataFrame) -> DataFrame:
    """Per document its counts by base kind, the digest of its base spans, all of its spans and their number."""
    spans = F.col("spans")
    return pii_spans(docs.select("doc_id", "text")).select(
        "doc_id",
        *[count_of(spans, k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(spans, BASE_KINDS), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
        F.size(spans).cast("long").alias("n_spans"),
    )
