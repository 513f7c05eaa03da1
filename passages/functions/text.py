"""Text columns: cleaning, lines, previews, tokens. White space is Unicode's, with the four ASCII separators."""

from __future__ import annotations

import html as html_lib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: One white-space character, as str.split() sees it; Spark's own ``\s`` is ASCII only.
WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
#: Where lines end, as str.splitlines() sees it.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
#: A keyword token.
TOKEN = r"([a-z0-9]+(?:-[a-z0-9]+)*)"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def clean(text: Column) -> Column:
    """White-space runs as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{WS}+"), "")


def lines(text: Column) -> Column:
    return F.split(text, LINE_END)


def one_line(text: Column, width: int = 88, ellipsis: str = "...") -> Column:
    flat = clean(text)
    return F.when(F.length(flat) <= width, flat).otherwise(F.concat(F.left(flat, F.lit(width)), F.lit(ellipsis)))


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits, joined by single hyphens."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(1))


_GAP = r"[ \t\n\f\r]"  # white space of HTML's grammar
#: What may follow a tag's name: attributes, whose quoted values may hold any character; what a quote leaves open reaches the end.
_ATTRIBUTES = rf"""(?:[ \t\n\f\r/]++|[^ \t\n\f\r/>][^ \t\n\f\r/>=]*+(?:{_GAP}*+={_GAP}*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^ \t\n\f\r>"'][^ \t\n\f\r>]*+)?)?+)*+"""
_NEXT = r"(?=[ \t\n\f\r/>])"
#: Markup, the first form that fits: comments; script and style with all they hold; title and textarea, whose text is kept; tags; all else
#: that starts like markup and ends with the next ``>``. What is left open reaches the end of the page.
MARKUP = re.compile(
    rf"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))
    |(?P<raw>script|style){_NEXT}{_ATTRIBUTES}(?:(?<=/)>|>.*?(?:</(?P=raw){_NEXT}{_ATTRIBUTES}(?:>|\Z)|\Z)|\Z)
    |(?P<kept>title|textarea){_NEXT}{_ATTRIBUTES}(?:(?<=/)>|>(?P<text>.*?)(?:</(?P=kept){_NEXT}{_ATTRIBUTES}(?:>|\Z)|\Z)|\Z)
    |/?[a-z][^ \t\n\f\r/>]*+{_ATTRIBUTES}(?:>|\Z)
    |(?:[!?]|/(?=.))[^>]*+(?:>|\Z))""".replace("\n    |", "|"),
    re.IGNORECASE | re.DOTALL,
)


def visible(page: str | None) -> str | None:
    """A page without markup, a space for each piece of it, with character references decoded once."""
    if page is None:
        return None
    shown = MARKUP.sub(lambda m: f" {m['text'] or ''} ", page) if "<" in page else page
    return html_lib.unescape(shown) if "&" in shown else shown


def html_to_text(html: Column) -> Column:
    """The visible text of a page, cleaned: no script, style, tags or comments. One Arrow pass; the grammar's tags are those of HTML's tokenizer, so a quoted ``>``
    ends none. A self-closed script or style holds nothing."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(visible)

    return clean(run(html))


def category_of(source: Column, rules: list[tuple[list[str], str]], default: str = "general") -> Column:
    """The category of the first rule one of whose substrings the lower-cased source holds."""
    low, out = F.lower(source), None
    for parts, category in rules:
        hit = F.lit(False)
        for part in parts:
            hit = hit | low.contains(part)
        out = F.when(hit, F.lit(category)) if out is None else out.when(hit, F.lit(category))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


#: Categories of a help corpus.
CATEGORY_RULES = [(["billing", "plan"], "billing"), (["security", "privacy"], "security")]
