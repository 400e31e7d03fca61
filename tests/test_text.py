"""Markup, references, numerals and links on hand-made inputs."""

import html
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provenir.functions.text import (
    collapse_blanks,
    decode_references,
    escape_markup,
    plain_numeral,
    readable_text,
)
from provenir.functions.urls import url_host, with_absolute
from provenir.plans.records import build_records
from provenir.sources.listing import listing_links


def run(spark, values, function):
    """The function's value for each input, in input order."""
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r.out for r in rows.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>a</p><p>b</p>", "a b"),
        ("<p>日<b>本</B>語<br>a<!-- x -->b<span class='c'>c</span></p>", "日本語 abc"),
        ("x <<b>y</b> z <abc>w", "x <y z w"),
        ("a<scripty>b</scripty><a日>c", "a b c"),
        ("a <!-- --> b <i> </i> c", "a b c"),
        ("a < b and c > d", "a < b and c > d"),
        ("x <script>if (a<b) t='</p>';</script>y", "x y"),
        ("x<SCRIPT type='a'>no</Script >y", "xy"),
        ("x<style>p{}</style><p>y<!-- <p>no</p> -->z", "x yz"),
        ("kept<script>cut off in the middle", "kept"),
        ("kept<!-- cut off", "kept"),
        ('kept<a href="cut', "kept"),
        ("<!DOCTYPE html><?xml version='1'?>t", "t"),
        ("a 　b\r\n\tc", "a b c"),
        ("1 &lt; 2 &amp;amp; &#65;&#x42; &copy; &unknown; & &;", "1 < 2 &amp; AB © &unknown; & &;"),
        ("&#0;&#xD800;&#x110000;", "\ufffd\ufffd\ufffd"),
        ("<img alt='x > y'>z", "z"),
        ('<p title="a>b">t</p>', "t"),
        ("<p don't>it's</p>", "it's"),
        ("caf&eacute; &euro;5 &auml;&szlig; &frac12; &AMP; &copy 2024", "café €5 äß ½ & © 2024"),
        ("&#26085;&#x672C;", "日本"),
        ("", ""),
        (None, None),
    ],
)
def test_readable_text(spark, page, text):
    assert run(spark, [page], readable_text) == [text]


def test_broken_documents_neither_overflow_nor_hang(spark):
    pages = [
        piece * 100_000
        for piece in ("<a ", "<", "<script>", "<!--", "&", "&#", "</script", "<a href=", '<a href="', "<title", "<html ", "<script ", "<style/", "a = 1 ")
    ]
    assert len(run(spark, pages, readable_text)) == len(pages)
    docs = spark.createDataFrame(list(enumerate(pages)), "doc_id long, html string").withColumn("url", F.lit("https://h.example/"))
    assert listing_links(docs).agg(F.max("pos")).first()[0] is not None
    records = build_records(docs, F.lit(1))
    assert records.agg(F.sum(F.length("body_text")), F.sum("n_sections"), F.max("title")).first()[1] == 0


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30), min_size=1, max_size=30))
def test_escaping_is_undone_by_decoding(spark, texts):
    escaped = run(spark, texts, escape_markup)
    for text, row in zip(texts, escaped, strict=True):
        assert not set(row) & set("\r\n\"'")
        assert html.unescape(row.replace("<br>", "\n")) == re.sub("\r\n|\r", "\n", text)
    no_lines = [t for t in texts if not set(t) & set("\r\n")]
    if no_lines:
        assert run(spark, no_lines, lambda c: decode_references(escape_markup(c))) == no_lines


def test_blanks(spark):
    assert run(spark, ["  a \n\n b　", "　", "a"], collapse_blanks) == ["a b", "", "a"]


@pytest.mark.parametrize(
    ("text", "number"),
    [
        ("１２３", 123),
        ("1,234,567", 1234567),
        ("１，２３４", 1234),
        ("－5", -5),
        ("12,34", None),
        ("1" + ",234" * 10, int("1" + "234" * 10)),
        ("", None),
        ("12 units", None),
        (None, None),
    ],
)
def test_numerals(spark, text, number):
    assert run(spark, [text], lambda c: plain_numeral(c).try_cast("decimal(38,0)")) == [number]


@pytest.mark.parametrize(
    ("base", "link", "url"),
    [
        ("https://h.example/a/b?q=1#f", "/x", "https://h.example/x"),
        ("https://h.example/a/b?q=1#f", "x.pdf", "https://h.example/a/x.pdf"),
        ("https://h.example/a/b/", "x.pdf", "https://h.example/a/b/x.pdf"),
        ("https://h.example/a/b/c", "../x?y=/../z", "https://h.example/a/x?y=/../z"),
        ("https://h.example/a/b/c", "../../../../x", "https://h.example/x"),
        ("https://h.example/a/b/c", "./..", "https://h.example/a/"),
        ("https://h.example/a/b/c", ".", "https://h.example/a/b/"),
        ("https://h.example/a/b/c", "...", "https://h.example/a/b/..."),
        ("https://h.example", "x", "https://h.example/x"),
        ("https://h.example/a?q", "?r=2", "https://h.example/a?r=2"),
        ("https://h.example/a?q#f", "#g", "https://h.example/a?q#g"),
        ("https://h.example/a?q#f", "", "https://h.example/a?q"),
        ("https://h.example/a", "//o.example/x", "https://o.example/x"),
        ("https://h.example/a", "http://o.example/x", "http://o.example/x"),
        ("https://h.example/a", "mailto:x@o.example", "mailto:x@o.example"),
    ],
)
def test_absolute_links(spark, base, link, url):
    rows = spark.createDataFrame([(base, link)], "base string, link string")
    assert with_absolute(rows, "base", "link").first().link == url


@pytest.mark.parametrize(
    ("page", "title"),
    [
        ("<title>1 < 2 wins</title>", "1 < 2 wins"),
        ("<title-card>no</title-card>", None),
        ('<title lang="a>b">t</TITLE>', "t"),
        ("<title>open", "open"),
    ],
)
def test_titles(spark, page, title):
    docs = spark.createDataFrame([(1, "https://h.example/", page)], "doc_id long, url string, html string")
    assert build_records(docs, F.lit(1)).first().title == title


@pytest.mark.parametrize(
    ("url", "number"),
    [
        ("https://163.com/a/12", 12),
        ("https://10.0.0.1/x/55", 55),
        ("https://h.example/a?x=/7/", None),
        ("https://163.com", None),
        ("https://h.example/5/6.html", 5),
        ("file:/data/x/9.html", 9),
    ],
)
def test_number_in_the_path(spark, url, number):
    docs = spark.createDataFrame([(1, url, "")], "doc_id long, url string, html string")
    assert build_records(docs, F.lit(1)).first().url_no == number


@pytest.mark.parametrize(
    ("page", "links"),
    [
        ('<a title="a>b" href="/lost">', ["https://h.example/lost"]),
        ("<a/href='/slash'>", ["https://h.example/slash"]),
        ('<a title="x"href="/tight">', ["https://h.example/tight"]),
        ('<a href="\n/x\t\n">', ["https://h.example/x"]),
        ('<a data-href="/no" title="href=/no">', []),
        ('<base href="/b/"><a href="x">', ["https://h.example/b/x"]),
        ('<area href="/map">', ["https://h.example/map"]),
        ("<abbr href='/no'>", []),
    ],
)
def test_links(spark, page, links):
    docs = spark.createDataFrame([(1, "https://h.example/list/", page)], "doc_id long, url string, html string")
    assert [r.link for r in listing_links(docs).orderBy("pos").collect()] == links


def test_hosts(spark):
    assert run(spark, ["https://h.example:8/x", "no url", None], url_host) == ["h.example:8", None, None]
