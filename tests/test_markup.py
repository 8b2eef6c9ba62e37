"""The tokenizer of pages against the standard library's parser, and the cases that a pattern gets wrong."""

import random
from html import unescape
from html.parser import HTMLParser

import duckdb
import pytest

from terralog.functions import markup
from terralog.plans import evidence


class Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out = []

    def handle_starttag(self, tag, attrs):
        self.out.append(("open", tag))

    def handle_endtag(self, tag):
        self.out.append(("close", tag))

    def handle_data(self, data):
        self.out.append(("text", data))


def joined(tokens):
    out = []
    for kind, value in tokens:
        if kind == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + value)
        elif value:
            out.append((kind, value))
    return out


PARTS = ["<p>", "</p>", '<a href="x>y" title=\'a"b\'>', "</a >", "<br>", "<B CLASS=c>", "</b>", "text ", "1 < 2 ", "a &amp; b ", "&lt;i&gt; ", "&eacute;&#233;&#xe9;", "&nosuch; ", "<!-- <p> \"> -->", "<!DOCTYPE html>", "<script>if (a < b && c > d) { '</p>' }</script>", "<style>p > a { }</style>", "\n", "<input value=a>b>", "<td colspan = '2'>", "ünï "]


def test_tokens_equal_the_parser():
    r = random.Random(8)
    for _ in range(800):
        html = "".join(r.choice(PARTS) for _ in range(r.randint(1, 14)))
        p = Plain()
        p.feed(html)
        p.close()
        assert joined(markup.tokens(html)) == joined(p.out), html


@pytest.mark.parametrize(("html", "text"), [
    ('<a title="1 > 2">x</a>', "x"), ("<script>var a = '<p>no</p>';</script>yes", "yes"), ("a<!-- never closed <p>b", "a"), ("a<!-->b", "ab"), ("a<!-- x --!>b<!-- -- -->c", "abc"), ("a<p unclosed", "a"), ("a <b", "a"), ("3 < 4 <5", "3 < 4 <5"),
    ("<svg><svg>x</svg>y</svg>z", "z"), ("<noscript><p>off</p></noscript>on", "on"), ("&copy; &hellip; &notit; &AMP &#8364;&#x20AC;", "© … ¬it; & €€"), ("a&nbsp;&nbsp;b", "a b"), ("</>a</ p>b<?php x ?>c", "abc"),
    ("<textarea><b>raw</b></textarea>", "<b>raw</b>"), ("<script>never closed", ""), (None, ""), ("", ""), ("<p>a</p>\n\n  <p> b\t c </p>", "a\nb c"), ("<div a='>' b=\">\" c=d'>e", "e"),
])
def test_text(html, text):
    assert markup.page(html)[1] == text


def test_title_and_long_pages():
    assert markup.page("<title>A &amp; <b>\n B</title><p>x<title>second</title>")[0] == "A & <b> B"
    assert markup.page("<p>" * 100_000 + "x" + "<" * 50_000)[1].startswith("x<")


def test_sql_resolves_references_as_the_tokenizer_does():
    r = random.Random(3)
    texts = ["a &amp&amp;&amp", "&amp;lt; &ltx &notit; &nosuch; &AMP &eacute;&eacute &#233 &#xe9;z &#39", "&#0; &#x0 &#13; &#128; &#x81 &#11; &#xd800; &#1114112; &#99999999999999999999; &#xfdd0; &#x1fffe;", "&", "&;&#;&#x;", "&NotEqualTilde; &fjlig;", None, ""]
    texts += ["".join(r.choice(["&", "#", "x", "lt", "gt", "amp", "not", "in", ";", "4", "1", " ", "é", "'"]) for _ in range(12)) for _ in range(400)]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id INT, t VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(texts)))
    got = dict(con.execute(f"WITH {evidence.references_sql()}, {evidence.unescaped_sql('u', 'pages')} SELECT page_id, t FROM u").fetchall())
    assert [got[k] or "" for k in range(len(texts))] == [unescape(t or "") for t in texts]
    page = "<title>x &amp&amp</title><p>" + "y" * 600 + " &lt"
    con.execute("CREATE OR REPLACE TABLE pages AS SELECT 1 AS page_id, ? AS html", [page])
    title, text = con.execute(evidence.SQL["corpus_html_text"]).fetchall()[0][1:]
    assert (title, text) == markup.page(page)
    assert con.execute(evidence.SQL["corpus_gate"]).fetchall()[0][1] == len(text)


def test_gate_rounds_ties_and_null_pages_as_its_sql_does(spark):
    """Ratios that lie in the middle of two figures go up on both sides; a null page has an empty text."""
    from terralog.operators import corpus

    html = [None, "", "<p></p>", "short", "é" * 400 + "1" * 400, *(f"<p>{'a' * n}{'1' * (2000 - n)}</p>" for n in (*range(991, 1030), 1234, 1629)), *(f"{'b' * n}{'-' * (4000 - n)}" for n in range(1998, 2050, 2))]
    rows = list(enumerate(html))
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    df = spark.createDataFrame(rows, "page_id long, html string").select("page_id", corpus.page("html").alias("p")).select("page_id", "p.title", "p.text")
    assert sorted(con.execute(evidence.SQL["corpus_html_text"]).fetchall()) == sorted(map(tuple, df.collect()))
    got = corpus.gate(df).select("page_id", "chars", "alpha_ratio", "reason", "usable")
    assert sorted(con.execute(evidence.SQL["corpus_gate"]).fetchall()) == sorted(map(tuple, got.collect()))
