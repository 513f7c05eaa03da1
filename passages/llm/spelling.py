"""Spelling variants of a corpus' words, grouped by permuterm rotations.

Each word gets a terminator, and its rotations are sorted: a rotation that starts after a character and ends before it skips it, so words that differ
only there stand together, next to the rotation of the word without it. Rotations are dealt by ranges of what they hold before the last, skipped character, each
range is sorted, and groups of more than one word are scanned. What a group can hold does not grow with the corpus: one word for each
character that words have, and one without it. Where a character repeats, skipping any one of its run gives the same
rotation but for the start; only the first of the run counts for insertions and deletions, so each pair of words meets once.

A word's form is its most frequent near word, if that is frequent enough; forms are followed to the last by pointer jumping, so a chain of
n forms takes about log2(n) joins, and only words with a form take part.

Defined results: null texts have no words; a null id counts as empty in the hash that plants a deletion; words are compared by code points and
repeated rows count each; a corpus without words that are long and frequent enough gives no rows. The operator reads doc_id and text only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passages.llm.common import written

RUN = r"([A-Za-zÀ-ÿ]+)"
END = "$"  # no letter


@dataclass(frozen=True)
class Settings:
    shortest: int = 5  #: code points of a word
    least: int = 3  #: occurrences of a word
    ratio: int = 2  #: times that a form is as frequent as the word, at least
    every: int = 97  #: runs whose hash this divides lose a character; 0: none


def words(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(word, n): the lower-cased runs of letters that are long and frequent enough."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = F.translate("text", upper, upper.lower())
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(1))).alias("run"))
    word = F.col("run")
    if s.every:
        h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), word))
        at = (h % F.length(word)).cast("int")
        word = F.when(h % s.every == 0, F.concat(F.left(word, at), F.substring(word, at + 2, F.length(word)))).otherwise(word)
    made = runs.select(word.alias("word")).filter(F.length("word") >= s.shortest)
    return made.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= s.least)


def _rotated(word: Column, start: Column, skip: int) -> Column:
    """The word from ``start`` (1-based) on, the terminator, and the word before; ``skip`` characters before ``start`` are left out."""
    return F.concat(F.substring(word, start, F.length(word)), F.lit(END), F.left(word, start - 1 - skip))


def rotations(known: DataFrame) -> DataFrame:
    """(prefix, skips, first, word, n): for each character of a word its rotation without it, which is the prefix of all rotations that
    agree but for this character, and each rotation of the whole word. ``first``: the character does not repeat the one before."""
    word, ends = F.col("word"), F.sequence(F.lit(1), F.length("word") + 1)
    char = lambda i: F.substring(word, i, F.lit(1))
    part = lambda i: F.struct(_rotated(word, i, 1).alias("prefix"), F.lit(True).alias("skips"), ((i == 2) | (char(i - 1) != char(i - 2))).alias("first"))
    whole = lambda i: F.struct(_rotated(word, i, 0).alias("prefix"), F.lit(False).alias("skips"), F.lit(True).alias("first"))
    each = F.concat(F.transform(F.slice(ends, 2, F.length("word")), part), F.transform(ends, whole))
    return known.select("word", "n", F.explode(each).alias("r")).select("r.*", "word", "n")


def near(known: DataFrame) -> DataFrame:
    """(word, n_near, best): for each word that has near words their number and the most frequent, (least, word) with ``least`` = -n."""
    ordered = rotations(known).repartitionByRange("prefix").sortWithinPartitions("prefix")
    one = F.struct((-F.col("n")).alias("least"), "word", "skips", "first")
    groups = ordered.groupBy("prefix").agg(F.collect_list(one).alias("g")).filter(F.size("g") > 1)  # at most one row a letter, and one
    each = groups.select(F.explode("g").alias("m"), F.sort_array("g").alias("g"))
    # both skip it: one replacement; one does: an insertion or deletion at the start of a run
    other = lambda o: (o["word"] != F.col("m.word")) & F.when(o["skips"] == F.col("m.skips"), o["skips"]).otherwise(o["first"] & F.col("m.first"))
    found = each.select(F.col("m.word").alias("word"), F.filter("g", other).alias("g")).filter(F.size("g") > 0)
    best = F.element_at("g", 1)
    return found.groupBy("word").agg(F.sum(F.size("g")).alias("n_near"), F.min(F.struct(best["least"].alias("least"), best["word"].alias("word"))).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form) without cycles: the last form that is reached."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return now


def variants(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    known = written(words(docs, s), "words")
    frequent = -F.col("best.least") >= s.ratio * F.col("n")
    rows = known.join(near(known), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(frequent, F.col("best.word")).alias("form"), F.when(frequent, -F.col("best.least")).alias("form_n")
    )
    rows = written(rows, "forms")
    last = roots(rows.filter("form IS NOT NULL"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def report(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    return variants(docs, s)


#: crc32 by a table of its 256 remainders, which the rule makes; near words by what is left without one character.
REPORT_SQL = r"""WITH RECURSIVE steps AS (SELECT i, i::BIGINT c, 0 k FROM (SELECT unnest(range(0, 256)) i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
tab AS (SELECT array_agg(c ORDER BY i) t FROM steps WHERE k = 8),
r AS (SELECT doc_id, run, count(*) n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) run FROM documents) GROUP BY ALL),
b AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) x FROM r),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT), lambda c, y: xor(t[xor(c & 255, y) + 1], c >> 8), 4294967295::BIGINT)) h FROM b, tab),
w AS (SELECT word, sum(n)::BIGINT n FROM (SELECT n, CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END word FROM h) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
d AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) rest FROM (SELECT word, n, unnest(range(0, length(word))) i FROM w)),
pairs AS (SELECT a.word, b.word other, b.n FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word UNION SELECT d.word, w.word, w.n FROM d JOIN w ON w.word = d.rest UNION SELECT w.word, d.word, d.n FROM d JOIN w ON w.word = d.rest),
best AS (SELECT word, count(*) n_near, arg_min(other, struct_pack(a := -n, b := other)) other, max(n) most FROM pairs GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) n_near, CASE WHEN most >= 2 * w.n THEN other END form, CASE WHEN most >= 2 * w.n THEN most END form_n FROM w LEFT JOIN best USING (word)),
go AS (SELECT word, word root FROM f UNION ALL SELECT go.word, f.form FROM go JOIN f ON f.word = go.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, go.root, f.n, f.n_near::BIGINT AS n_near, f.form_n FROM f JOIN go ON go.word = f.word JOIN f l ON l.word = go.root AND l.form IS NULL"""
