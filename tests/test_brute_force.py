"""Operators on random tables and texts against plain Python."""

import html
import random
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

import provenir as pv
from provenir.functions.text import INLINE_TAG, NOT_TEXT, TAG
from provenir.functions.urls import with_absolute


@pytest.fixture
def draw():
    return random.Random(20)


def keyed_values(draw, n):
    """Few keys, so that they repeat; some null keys and values."""
    return [
        (draw.choice([None, *range(300)]), draw.choice([None, "a", "a", "a", "b"]))
        for _ in range(n)
    ]


def by_key(pairs):
    grouped = defaultdict(list)
    for key, value in pairs:
        grouped[key].append(value)
    return grouped


def test_reconcile(spark, draw):
    official, extracted = keyed_values(draw, 250), keyed_values(draw, 200)
    left, right = by_key(official), by_key(extracted)
    expected = set()
    for key in left.keys() | right.keys():
        mine, theirs = left.get(key, []), right.get(key, [])
        if key is None or not mine or not theirs:
            if mine:
                expected.add((key, len(mine), 0, "not_extracted"))
            if theirs:
                expected.add((key, 0, len(theirs), "not_in_official"))
        else:
            state = "match" if len(set(mine + theirs)) == 1 else "mismatch"
            expected.add((key, len(mine), len(theirs), state))
    tables = [spark.createDataFrame(pairs, "k int, v string") for pairs in (official, extracted)]
    got = pv.reconcile(*tables, ["k"], "v").select("k", "n_official", "n_extracted", "state").collect()
    assert len(got) == len(expected)
    assert set(map(tuple, got)) == expected
    assert {state for *_, state in expected} == {"match", "mismatch", "not_extracted", "not_in_official"}


def test_missing_documents(spark, draw):
    listed, recorded = keyed_values(draw, 400), keyed_values(draw, 200)
    known = {k for k, _ in recorded if k is not None}
    expected = Counter(k for k, _ in listed if k not in known)
    tables = [spark.createDataFrame(pairs, "k int, v string") for pairs in (listed, recorded)]
    assert {r.k: r.n_listed for r in pv.missing_documents(*tables, ["k"]).collect()} == expected


def test_verification_status(spark, draw):
    records = [(i, draw.choice([None, *range(300)])) for i in range(400)]
    checks = [(draw.choice([None, *range(300)]), draw.choice([None, True, True, False])) for _ in range(300)]
    verdicts = by_key(checks)

    def status(key):
        known = [p for p in verdicts[key] if p is not None] if key is not None else []
        return "unverified" if not known else "verified" if all(known) else "rejected"

    got = pv.verification_status(
        spark.createDataFrame(records, "i int, doc_id int"), spark.createDataFrame(checks, "doc_id int, passed boolean")
    )
    assert sorted((r.i, r.status) for r in got.collect()) == [(i, status(key)) for i, key in records]


def test_completeness_and_duplicates(spark, draw):
    rows = keyed_values(draw, 500)
    counts = Counter(k for k, _ in rows)
    expected = {k: draw.randrange(4) for k in range(0, 350, 2)}
    df = spark.createDataFrame(rows, "k int, v string")
    stated = spark.createDataFrame(list(expected.items()), "k int, expected int")
    got = {r.k: (r.expected, r.found) for r in pv.completeness(stated, df, "k").collect()}
    assert got == {k: (expected.get(k), counts[k]) for k in expected.keys() | counts.keys()}
    repeated = {r.k: r.n_rows for r in pv.duplicate_keys(df, ["k"]).collect()}
    assert repeated == {k: n for k, n in counts.items() if n > 1}


def python_reading(page):
    """The reading of a page with Python's own regular expressions."""
    text = re.sub(f"(?is)<(?:{NOT_TEXT}|{INLINE_TAG})".replace(r"\z", r"\Z"), "\x01", page, flags=re.ASCII)
    text = re.sub(f"(?is)<{TAG}".replace(r"\z", r"\Z"), " ", text, flags=re.ASCII)

    text = html.unescape(text)
    return re.sub("[\t-\r \xa0　]+", " ", text.replace("\x01", "")).strip(" ")


def test_readable_text(spark, draw):
    pieces = (
        "<script> </script> </SCRIPT\n> <style> </style> <!-- --> <p> </p> <b> </b> <br> <span <a\thref='x'> < > <! <? / & ; &amp; &lt; &#65; "
        "&#x4e2D; &#xD800; &#9999999; &nbsp; &copy &nope; script style -- a 日"
    ).split(" ") + [" ", "\n", "\xa0", "　"]
    pages = ["".join(draw.choices(pieces, k=draw.randrange(25))) for _ in range(5000)]
    docs = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    got = {r.i: r.body_text for r in pv.extract_text(docs).select("i", "body_text").collect()}
    assert got == dict(enumerate(map(python_reading, pages)))


class Reader(HTMLParser):
    """An independent reader: it shares no pattern with the library."""

    INLINE = {"a", "b", "i", "em", "span", "code", "sub"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.hidden, self.title, self.in_title, self.links, self.lang = [], 0, None, False, [], None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag not in self.INLINE:
            self.parts.append(" ")
        first = {}
        for name, value in attrs:
            first.setdefault(name, value)
        if tag in ("a", "area") and first.get("href"):
            self.links.append(first["href"])
        if tag == "html" and self.lang is None:
            self.lang = first.get("lang")
        if tag == "title" and self.title is None:
            self.title, self.in_title = "", True

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden -= 1
        elif tag not in self.INLINE:
            self.parts.append(" ")
        if tag == "title":
            self.in_title = False

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)
        if self.in_title:
            self.title += data


def plain(text):
    return re.sub("[\t-\r \xa0　]+", " ", text).strip(" ")


def random_page(draw):
    words = ["word", "caf&eacute;", "&euro;5", "&auml;&szlig;", "&frac12;", "&AMP;", "&copy 2024", "&#8364;", "&#x41", "&#150;", "&nosuch;", "日本", "1 < 2", "a & b", "x > y", "don't", '"q"']
    names = ["p", "P", "div", "b", "B", "i", "span", "em", "td", "H2"]

    def attribute():
        name = draw.choice(["title", "alt", "DATA-x", "class"])
        value = draw.choice(["plain", "a>b", "x &amp; y", "it is", "<p>"])
        return f" {name}" + draw.choice([f'="{value}"', f"='{value}'", f' = "{value}"', "=plain", ""])

    def text():
        return " ".join(draw.choices(words, k=draw.randrange(1, 4)))

    def element(depth):
        kind = draw.randrange(8)
        if kind == 0:
            return draw.choice(["<!-- <p>no</p> -->", "<script type='a>b'>if (a<b) t='<p>'</script>", "<STYLE>p>a{}</STYLE >"])
        if kind == 1:
            return f'<a{attribute()} href="/x/{draw.randrange(9)}?a=1&amp;b=2">{text()}</a>'
        if kind == 2 or depth > 3:
            return text()
        name = draw.choice(names)
        return f"<{name}{attribute()}{attribute()}>" + "".join(element(depth + 1) for _ in range(draw.randrange(3))) + f"</{name}>"

    head = f'<!DOCTYPE html><html data-x="y" lang="{draw.choice(["en", "es-419", "zh-Hant-TW"])}"><head><title{attribute()}>{text()}</title></head>'
    page = head + "<body>" + "".join(element(0) for _ in range(draw.randrange(8)))
    return page + draw.choice(["</body></html>", "", "<p>cut off here"])


def test_an_independent_reader_agrees(spark, draw):
    pages = [random_page(draw) for _ in range(1500)]
    docs = spark.createDataFrame([(i, f"https://h.example/d/{i}", p) for i, p in enumerate(pages)], "doc_id long, url string, html string")
    records = {r.doc_id: r for r in pv.build_records(docs, F.lit(1)).collect()}
    links = by_key((r.doc_id, r.link) for r in pv.listing_links(docs).orderBy("doc_id", "pos").collect())
    for i, page in enumerate(pages):
        reader = Reader()
        reader.feed(page)
        reader.close()
        assert records[i].body_text == plain("".join(reader.parts)), page
        assert records[i].title == plain(reader.title), page
        assert records[i].lang == reader.lang, page
        assert links.get(i, []) == [urljoin(f"https://h.example/d/{i}", x) for x in reader.links], page


def test_all_references_are_decoded_as_html_does(spark, draw):
    from html.entities import html5

    texts = [f"a&{name} b&{name.rstrip(';')}x;" for name in html5]
    texts += [f"&#{n}; &#x{n:x} &#{n}x" for n in [*range(300), 0xD800, 0xFDD0, 0xFFFE, 0x1F600, 0x10FFFF, 0x110000, 10**9, 10**30]]
    pieces = ["&", "#", "x", "amp", "lt", ";", "65", "notin", "copy", " ", "é", "&amp;"]
    texts += ["".join(draw.choices(pieces, k=draw.randrange(12))) for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    from provenir.functions.text import decode_references

    got = {r.i: r.out for r in rows.select("i", decode_references(F.col("t")).alias("out")).collect()}
    wrong = [(t, got[i], html.unescape(t)) for i, t in enumerate(texts) if got[i] != html.unescape(t)]
    assert not wrong[:5]


def test_absolute_links(spark, draw):
    segments = ["a", "b.pdf", "..", ".", "...", "c:d", ""]

    def link():
        path = "/".join(draw.choices(segments, k=draw.randrange(1, 5)))
        return draw.choice(["", "/", "./"]) + path + draw.choice(["", "?q=1/../2", "#f"])

    bases = ["https://h.example", "https://h.example/", "https://h.example/a", "https://h.example/a/b/c.html?x=/y#z"]
    # Left out: links with "//", where urljoin merges slashes, and links that read
    # like a scheme or are empty, which have cases of their own.
    pairs = [(b, x) for b, x in ((draw.choice(bases), link()) for _ in range(8000)) if x and "//" not in x and not x.startswith("c:d")]
    assert len(pairs) > 2000
    got = with_absolute(spark.createDataFrame(pairs, "base string, link string").withColumn("raw", F.col("link")), "base", "link")
    wrong = {(r.base, r.raw, r.link, urljoin(r.base, r.raw)) for r in got.collect() if r.link != urljoin(r.base, r.raw)}
    assert not wrong
