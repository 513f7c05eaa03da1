"""Language identification by Bayesian evidence fusion.

For each row four kinds of evidence are multiplied: the likelihood of the text under byte-trigram
models, the declared markup language, the language that an address suffix stands for, and a prior of
the row's host. Host priors are smoothed hierarchically: a host's counts shrink to its domain's, these
to the suffix's, these to the whole corpus; all are grouped sums of the text posteriors of all rows. A row's own
posterior is taken out of all four, so its text counts once.

Every language that a row with letters declares has a text model, fitted on a bounded sample of such rows
(``Settings.fit_rows`` rows for each language, on average); all other statistics cover every row. Of a declaration such as
``de-AT`` or ``pt_BR`` the primary part counts, if it has two or three letters, so there are at most 26**2 + 26**3 languages.

Defined results: rows whose text is null, empty or without letters, or fits a uniform model better than
any language, are not accepted (language ``und`` for the former); null declarations and hosts give no evidence; ties go to the
first language by name; repeated rows count each; if no row declares a language, every text with letters is
accepted with a null language; other columns pass unchanged. For ``docs`` see ``common.placed``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passages.functions.text import html_to_text
from passages.llm.common import placed, salt, small, tidy, with_row_id, without, written

# Country suffixes of addresses and the language they speak for.
SUFFIX_LANGUAGE = {
    "at": "de", "ch": "de", "de": "de",
    "ar": "es", "cl": "es", "co": "es", "es": "es", "mx": "es",
    "be": "fr", "fr": "fr",
    "au": "en", "ie": "en", "nz": "en", "uk": "en", "us": "en",
    "br": "pt", "it": "it", "nl": "nl", "pl": "pl", "pt": "pt",
}


#: Share of a text that counts as none, so that a row adds only the languages it may be in to its host.
NO_SHARE = 1e-12


@dataclass(frozen=True)
class Settings:
    block: int = 64  #: languages whose counts the driver reads at a time
    fit_rows: int = 400  #: labelled rows of each language for the text models, on average
    buckets: int = 1 << 14  #: hash buckets of byte trigrams
    mixed: float = 0.1  #: share of the uniform model mixed into each language's
    effective: int = 60  #: trigrams that a text counts for at most: neighbours are not independent
    declared_trust: float = 0.9  #: probability that a declaration is right
    suffix_trust: float = 0.6  #: probability that a page under a country suffix is in its language
    shrink: float = 20.0  #: rows of its parent that a host, domain or suffix is smoothed with
    least: float = 0.5  #: posterior of an accepted language


def trigrams(text: str | None, buckets: int) -> np.ndarray:
    """Bucket of each byte trigram of the letters of a text, lower-cased, other characters as single spaces."""
    raw = np.frombuffer((text or "").lower().encode("utf-8", "replace"), dtype=np.uint8)
    letters = ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    if not letters.any():
        return np.empty(0, dtype=np.int64)
    raw = np.where(letters, raw, 32)
    raw = np.concatenate(([32], raw[np.concatenate(([True], letters[1:] | letters[:-1]))], [32])).astype(np.uint32)
    code = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - buckets.bit_length() + 1)).astype(np.int64)


@tidy
def _counted(frames: Iterator[pd.DataFrame], buckets: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for lang, texts in frame.groupby("lang")["text"]:
            total = np.zeros(buckets, dtype=np.int64)
            for text in texts:  # each text weighs the same, or one long mislabelled text could fill a model
                at = trigrams(text, buckets)
                total += np.bincount(at, minlength=buckets) * 1_000_000 // max(1, len(at))
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": total[at]})


@tidy
def _scored(batches: Iterator[pd.Series], model: np.ndarray, s: Settings) -> Iterator[pd.DataFrame]:
    for texts in batches:
        out = []
        for text in texts:
            at = trigrams(text, s.buckets)
            times = np.bincount(at, minlength=s.buckets)
            used = np.flatnonzero(times)
            mean = times[used] @ model[used].astype(np.float64) / max(1, len(at))
            share = np.exp(min(len(at), s.effective) * (mean - mean.max()))
            share /= share.sum()
            share[(share < NO_SHARE) | (len(at) == 0)] = 0.0
            out.append((len(at), mean, share))
        yield pd.DataFrame(out, columns=["n", "mean", "own"])


def _scorer(model: np.ndarray, s: Settings):
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return _scored(batches, model, s)

    return score


def primary(tag: Column) -> Column:
    """The primary part of a language tag, lower-cased; null if it is none of two or three letters."""
    part = F.lower(F.regexp_extract(tag, r"^[ \t\r\n]*([A-Za-z]{2,3})(?![A-Za-z0-9])", 1))
    return F.when(part != "", part)


def fit(rows: DataFrame, text: str, declared: str, s: Settings) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (buckets x languages). The driver holds four bytes for each bucket and language,
    64 KB a language, and reads the sums of ``Settings.block`` languages at a time."""
    labelled = rows.select(primary(F.col(declared)).alias("lang"), F.col(text).alias("text"), "__row").filter("lang IS NOT NULL")
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("rows"))
    drawn = labelled.join(F.broadcast(sizes), "lang").filter(F.pmod(F.xxhash64("__row"), F.lit(1 << 30)) < F.lit(float(1 << 30)) * s.fit_rows / F.col("rows"))
    counts = drawn.select("lang", "text").mapInPandas(partial(_counted, buckets=s.buckets), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = written(counts, "language-counts")
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    model = np.empty((s.buckets, len(langs)), dtype=np.float32)
    for start in range(0, len(langs), s.block):
        some = counts.filter(F.col("lang").isin(langs[start : start + s.block])).toPandas()
        for lang, own in some.groupby("lang"):
            share = np.zeros(s.buckets)
            share[own["bucket"]] = own["n"] / own["n"].sum()
            model[:, langs.index(lang)] = np.log((1 - s.mixed) * share + s.mixed / s.buckets)
    return langs, model


def _identified(docs: DataFrame, text: str, declared: str, host: str, s: Settings) -> DataFrame:
    """:func:`identify` with the rows' ids as ``__row``."""
    rows = with_row_id(docs, "__row")
    langs, model = fit(rows, text, declared, s)
    carried = [c for c in docs.columns if c not in (text, "language", "posterior", "text_language", "accepted")]
    if not langs:
        lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
        none = F.lit(None).cast("string")
        return rows.select(*carried, "__row", none.alias("language"), F.lit(None).cast("double").alias("posterior"), none.alias("text_language"), lettered.alias("accepted"))
    score = F.pandas_udf(_scorer(model, s), "n int, mean array<double>, own array<double>")
    address = F.lower(F.coalesce(F.col(host), F.lit("")))
    labels = F.split(address, r"\.")
    scored = rows.withColumn("__t", score(F.col(text))).select(
        *carried, "__row", F.col("__t.n").alias("__n"), F.col("__t.mean").alias("__mean"), F.col("__t.own").alias("__own"), primary(F.col(declared)).alias("__said"),
        address.alias("__host"),
        F.when(F.size(labels) > 1, F.concat_ws(".", F.element_at(labels, -2), F.element_at(labels, -1))).otherwise("").alias("__domain"),
        F.when(F.size(labels) > 1, F.element_at(labels, -1)).otherwise("").alias("__suffix"),
    ).withColumn("__salt", salt(64, F.col("__row")))
    scored = written(scored, "language-scores")
    priors = _levels(scored, len(langs))

    said = F.coalesce(F.array_position(F.lit(langs), F.col("__said")), F.lit(0))
    speaks = F.try_element_at(F.create_map(*[F.lit(x) for kv in SUFFIX_LANGUAGE.items() for x in kv]), F.col("__suffix"))
    means = F.coalesce(F.array_position(F.lit(langs), speaks), F.lit(0))

    def prior(i: Column) -> Column:
        """The smoothed share of a language among the other rows: of all, of the suffix, of the domain, of the host."""
        own, out = F.get("__own", i), F.lit(1.0 / len(langs))
        for name in LEVELS:
            k = float(len(langs)) if name == "__by_all" else s.shrink
            out = (F.greatest(F.get(name, i) - own, F.lit(0.0)) + k * out) / (F.greatest(F.col(f"{name}_n") - 1.0, F.lit(0.0)) + k)
        return out

    def evidence(place: str, i: Column, trust: float) -> Column:
        """Of a language at a place in ``langs`` from 1, or 0 if it is none of them."""
        off = float(np.log((1 - trust) / max(1, len(langs) - 1)))
        return F.when((F.col(place) == 0) | F.lit(len(langs) == 1), 0.0).when(F.col(place) == i + 1, float(np.log(trust))).otherwise(off)

    text_weight = F.least(F.col("__n"), F.lit(s.effective))
    joined = scored.join(priors, ["__host", "__salt"], "left").withColumns({"__said_at": said, "__means_at": means})
    fused = joined.withColumn(
        "__logs",
        F.transform(
            F.sequence(F.lit(0), F.lit(len(langs) - 1)),
            lambda i: text_weight * F.get("__mean", i) + F.log(prior(i)) + evidence("__said_at", i, s.declared_trust) + evidence("__means_at", i, s.suffix_trust),
        ),
    )
    fused = fused.withColumns({"__top": F.array_max("__logs"), "__text": F.array_max("__mean")})
    fused = fused.withColumn("__best", 1.0 / F.aggregate("__logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("__top"))))
    named = lambda logs, top: F.get(F.lit(langs), (F.array_position(logs, F.col(top)) - 1).cast("int"))
    lettered = F.col("__n") > 0
    return fused.select(
        *carried, "__row",
        F.when(lettered, named("__logs", "__top")).otherwise("und").alias("language"),
        F.when(lettered, F.round("__best", 6)).otherwise(0.0).alias("posterior"),
        F.when(lettered, named("__mean", "__text")).otherwise("und").alias("text_language"),
        (lettered & (F.col("__best") >= s.least) & (F.col("__text") >= float(-np.log(s.buckets)))).alias("accepted"),
    )


#: Levels of the hosts' hierarchy, the widest first.
LEVELS = ["__by_all", "__by_suffix", "__by_domain", "__by_host"]


def _levels(scored: DataFrame, n_langs: int) -> DataFrame:
    """For each host and salt that has a text with letters, the sums of its rows' shares by language, and those of its domain, its suffix and
    all rows, as an array for each level and their totals (``..._n``).

    Shares are summed as rows (host, salt, language), which a language that no text of a host may be in has none of. Broadcast
    sides are counted in array elements, one for each language and level."""
    host = ["__host", "__domain", "__suffix"]
    shares = scored.select(*host, "__salt", F.posexplode("__own").alias("__i", "__c")).filter("__c > 0")
    up = lambda df, keys: df.groupBy(*keys, "__i").agg(F.sum("__c").alias("__c"))
    sums = written(up(up(shares, [*host, "__salt"]), host), "language-hosts")

    def level(keys: list[str], name: str) -> DataFrame:
        one = up(sums, keys).groupBy(*keys).agg(F.coalesce(F.sum("__c"), F.lit(0.0)).alias(f"{name}_n"), F.map_from_entries(F.collect_list(F.struct("__i", "__c"))).alias("__map"))
        every = F.transform(F.sequence(F.lit(0), F.lit(n_langs - 1)), lambda i: F.coalesce(F.try_element_at("__map", i), F.lit(0.0)))
        return one.select(*keys, f"{name}_n", every.alias(name))

    n_hosts = sums.select("__host").distinct().count()
    suffixes = written(level(["__suffix"], "__by_suffix"), "language-suffixes")  # a suffix may have a third of all hosts
    levels = level(host, "__by_host").join(small(level(["__domain", "__suffix"], "__by_domain"), n_hosts * n_langs), ["__domain", "__suffix"])
    levels = levels.join(small(suffixes, suffixes.count() * n_langs), "__suffix").crossJoin(F.broadcast(level([], "__by_all")))  # the last is one row
    keys = scored.filter("__n > 0").select("__host", "__salt").distinct()
    return keys.join(small(levels.drop("__domain", "__suffix"), n_hosts * n_langs * len(LEVELS)), "__host")


def identify(docs: DataFrame, text: str = "text", declared: str = "lang", host: str = "source", s: Settings = Settings()) -> DataFrame:
    """``docs`` without ``text``, with ``language``, ``posterior``, ``text_language`` and ``accepted``, which replace such columns."""
    return _identified(docs, text, declared, host, s).drop("__row")


def accepted(docs: DataFrame, text: str = "text", declared: str = "lang", host: str = "source", s: Settings = Settings()) -> DataFrame:
    """``docs`` without the rows that :func:`identify` rejects."""
    docs = placed(docs)
    gone = _identified(docs, text, declared, host, s).filter(~F.col("accepted"))
    return without(docs, gone.select(F.col("__row").alias("row_id")), "language-rejected")


def page_evidence(pages: DataFrame) -> DataFrame:
    """(page_id, text, lang, source) of web pages: visible text, declared markup language, host of the address."""
    declared, host = F.regexp_extract("html", r"(?i)<html[^>]*\blang=[\"']?([a-z_-]+)", 1), F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)
    none = lambda c: F.when(c != "", c)
    return pages.select("page_id", html_to_text(F.col("html")).alias("text"), none(declared).alias("lang"), none(host).alias("source"))


def page_report(pages: DataFrame) -> DataFrame:
    """The same as :func:`report` for web pages, whose addresses have suffixes and domains."""
    return identify(page_evidence(pages)).select("page_id", F.col("lang").alias("declared"), "language", "posterior", "text_language", "accepted")


def report(docs: DataFrame) -> DataFrame:
    """Per document its language, posterior, the text's own best language and whether it is accepted."""
    return identify(docs.select("doc_id", "text", "lang", "source")).select("doc_id", F.col("lang").alias("declared"), "language", "posterior", "text_language", "accepted")
