"""Text semantics, chunkers and HTML, against plain Python on hand-made cases."""

import html
import html.entities
import html.parser
import random
import re

import pytest
from pyspark.sql import functions as F

from passages.functions import text as T
from passages.operators import chunk

SPACES = ["a\xa0b  c d\x85e\x1cf​g\r\nh\ti \n", "", "   ", "one", "x\x0by\x0cz", None]


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.o for r in df.select("i", expr(F.col("t")).alias("o")).orderBy("i").collect()]


def test_white_space(spark):
    texts = [t for t in SPACES if t is not None]
    assert column(spark, texts, T.clean) == [" ".join(t.split()) for t in texts]
    assert column(spark, texts, T.strip) == [t.strip() for t in texts]
    assert column(spark, texts, T.words) == [t.split() for t in texts]
    assert column(spark, [None], T.words) == [[]]


def test_lines_tokens_one_line(spark):
    texts = ["a\nb\r\nc\rd\x0be\x0cf\x1cg\x85h i", "x"]
    assert column(spark, texts, T.lines) == [t.splitlines() for t in texts]
    assert column(spark, ["Étude NN-413, a--b c-d- 'x'"], T.tokens) == [["tude", "nn-413", "a", "b", "c-d", "x"]]
    assert column(spark, ["a " * 60, "short"], lambda c: T.one_line(c, 10)) == ["a a a a a ...", "short"]


def test_html(spark):
    pages = ["<p>Hi<b>there</b></p>", "<script>var t='</p>';</script>x<style>p{}</style>", "a<script>never closed", "a<!-- > -->b", "&amp;lt; &lt;b&gt; &quot &copy;", "1 < 2 and 3", "<title>T</title><nav>n</nav>", ""]
    assert column(spark, pages, T.html_to_text) == ["Hi there", "x", "a", "a b", '&lt; <b> " ©', "1 < 2 and 3", "T n", ""]


def test_markup(spark):
    cases = {
        '<p><a title="x > y">link</a></p>': "link",
        '<img alt="<b>">t': "t",
        "<a href='a>b' x=1>c</a>d": "c d",
        "<a b=c\"d>e": "e",  # a quote inside an unquoted value is part of it
        "<a b'c>d'>e": "d'>e",  # and in an attribute's name
        "<a ==\">\">x": "x",
        "<a b = '>' c>x": "x",
        "a<!-->b<!--->c<!-- - -- > --!>d<!-- never closed": "a b c d",
        "a<!doctype x>b<?php echo 1 ?>c</3>d</>e<![CDATA[x]]>f": "a b c d e f",
        "<title>a <b>&amp; c</title>d<textarea rows='>'></p></textarea >e": "a <b>& c d </p> e",
        "<title>never &lt; closed": "never < closed",
        "<SCRIPT a='</script>'>x</scripty>y</ScRiPt z='>'>a<style>b</sty</style\n>c<scripts>d": "a c d",
        "<script/>a<script>b": "a",
        "1<2 & 3 <4 <": "1<2 & 3 <4 <",
        "a</": "a</",
        "a<b 'x": "a",
        'a<b c="never closed> d': "a",
        "<" * 2000 + "a": "<" * 1999,
        "<a " + "b='>' " * 20000 + ">x": "x",
    }
    for page, want in zip(cases, column(spark, list(cases), T.html_to_text)):
        assert want == cases[page], page[:60]


class Standard(html.parser.HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts, self.skip = [], False

    def handle_starttag(self, tag, attrs):
        self.skip = self.skip or tag in ("script", "style")

    def handle_endtag(self, tag):
        self.skip = self.skip and tag not in ("script", "style")

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def test_random_pages_against_the_standard_parser(spark):
    rnd = random.Random(7)
    words = ["one", "two > three", "&amp;", "&eacute;", "x & y", "1 < 2", "&#39;", "\n\t", "é"]
    values = ["v", '"a > b"', "'<i>'", '"</p>"', "'\"'", '""', "a/b", '"x=\'y\'"']

    def attributes():
        return "".join(f" {rnd.choice(['id', 'data-x', 'checked', 'TITLE'])}" + (f"{rnd.choice(['=', ' = '])}{rnd.choice(values)}" if rnd.random() < 0.7 else "") for _ in range(rnd.randint(0, 3)))

    def page(depth):
        kind = rnd.random()
        if depth == 0 or kind < 0.3:
            return rnd.choice(words)
        if kind < 0.7:
            tag = rnd.choice(["p", "div", "b", "h1", "a", "LI", "x-y"])
            return f"<{tag}{attributes()}>" + " ".join(page(depth - 1) for _ in range(rnd.randint(0, 3))) + f"</{tag}>"
        if kind < 0.8:
            return rnd.choice([f"<br{attributes()}/>", f"<img{attributes()} >"])
        if kind < 0.9:
            return rnd.choice(["<!-- a > b <p> -->", "<!doctype html>", "<!-- -->", "<?x y?>"])
        return rnd.choice([f"<script{attributes()}>if (a < b) '</p>' && \"<!--\"</script>", f"<STYLE{attributes()}>p > b {{}}</STYLE>"])

    pages = [" ".join(page(4) for _ in range(rnd.randint(1, 5))) for _ in range(400)]
    want = []
    for text in pages:
        parser = Standard()
        parser.feed(text)
        parser.close()
        want.append(" ".join(" ".join(parser.parts).split()))
    assert sum('">' in x or "<i>" in x for x in pages) > 100
    assert column(spark, pages, T.html_to_text) == want


def test_every_character_reference(spark):
    names = [f"a&{name}b" for name in html.entities.html5]
    texts = [*names, "&eacute;&uuml;&Uuml; &#8217;&mdash;&#xE9;&#XE9; &#0; &#x80; &#xD800; &amp;eacute; &notit; &eacute &am &nosuch; &", None]
    assert column(spark, texts, T.html_to_text) == [t and " ".join(html.unescape(t).split()) for t in texts]


def test_categories(spark):
    got = column(spark, ["Billing.md", "plan-security.md", "PRIVACY.txt", "x", None], lambda c: T.category_of(c, T.CATEGORY_RULES))
    assert got == ["billing", "billing", "security", "general", "general"]


def windows(words, size, overlap):
    out, at = [], 0
    while words:
        out.append(" ".join(words[at : at + size]))
        if at + size >= len(words):
            break
        at += size - overlap
    return out


@pytest.mark.parametrize("size,overlap", [(3, 1), (4, 0), (5, 4), (1, 0), (120, 20)])
def test_chunk_words(spark, size, overlap):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (0, 1, 2, 3, 4, 5, 9, 10, 121, 250)] + [None]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id int, text string, chunk_no int")
    got = [(r.doc_id, r.chunk_no, r.text) for r in chunk.chunk_words(docs, size, overlap).orderBy("doc_id", "chunk_no").collect()]
    assert got == [(i, k, w) for i, t in enumerate(texts) for k, w in enumerate(windows((t or "").split(), size, overlap))]


def test_bad_sizes(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id int, text string")
    for size, overlap in ((0, 0), (-1, 0), (5, 5), (5, 6), (5, -1)):
        with pytest.raises(ValueError):
            chunk.chunk_words(docs, size, overlap)


def test_paragraphs_and_sections(spark):
    docs = spark.createDataFrame([(1, "a\n\n b \n \nc\n\n\n\nd"), (2, None), (3, "")], "doc_id int, text string")
    assert [(r.doc_id, r.chunk_no, r.text) for r in chunk.chunk_paragraphs(docs).collect()] == [(1, 0, "a"), (1, 1, "b \n \nc"), (1, 2, "d")]
    md = "before\n# One\nbody 1\r\n#\n####### seven\n## # #tag \n\n### Two\nx\n# One\nagain\n# Empty\n"
    docs = spark.createDataFrame([(1, md), (2, "no heading"), (3, None), (4, "# T\ntext"), (5, "")], "doc_id int, text string")
    got = [(r.doc_id, r.section_no, r.heading, r.body) for r in chunk.chunk_sections(docs).orderBy("doc_id", "section_no").collect()]
    assert got == [(1, 0, "(intro)", "before"), (1, 1, "One", "body 1\n#\n####### seven"), (1, 2, "Two", "x"), (1, 3, "One", "again"), (2, 0, "(intro)", "no heading"), (4, 0, "T", "text")]


def test_section_windows(spark):
    docs = spark.createDataFrame([(1, "# A\n" + " ".join(f"w{i}" for i in range(24)) + "\n## B\nx")], "doc_id int, text string")
    got = [(r.section_no, r.heading, r.chunk_no, len(r.text.split())) for r in chunk.chunk_section_windows(docs).orderBy("section_no", "chunk_no").collect()]
    assert got == [(0, "A", 0, 14), (0, "A", 1, 14), (1, "B", 0, 1)]


def test_sweep_and_straddling(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "")], "doc_id int, text string")
    got = {(r.size, r.overlap): (r.n_chunks, r.avg_words) for r in chunk.chunk_sweep(docs, [(2, 0), (3, 1)]).collect()}
    assert got == {(2, 0): (3, round(5 / 3, 6)), (3, 1): (2, 3.0)}
    found = chunk.straddling(docs, "b", "d").collect()
    assert [(r.before, r.after) for r in found] == [("a b c ", "d e")]
    assert re.match("a", found[0].text)
