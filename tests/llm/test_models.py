"""Language identification, toxicity and URL filter: held-out rows and defined cases."""

import random
import time
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from provenir.llm import language, queries, toxicity, url_filter
from provenir.llm.common import crc_bucket
from tests.llm.cases import ROWS, docs, empty

SF = "/root/testdata/sf0.01"


def test_held_out_languages(spark):
    got = {r.doc_id: r for r in queries.op6_language_id(spark, SF).collect()}
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert got.keys() == lang.keys()
    assert all(r.held_out == (crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert sum(got[i].lang_pred == lang[i] for i in held) / len(held) > 0.98


def test_language_of_awkward_rows(spark):
    table = docs(spark).withColumn("tongue", F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd"))
    model = language.train(table, lang_col="tongue")
    assert model.languages == ["even", "odd"]
    got = language.predict(table, model)
    assert got.columns == [*table.columns, "language"]
    found = [(r.doc_id, r.language.lang, r.language.score) for r in got.collect()]
    assert len(found) == len(ROWS)
    for i, lang, score in found:
        assert (lang, score) == ("und", 0.0) if i in (1, 2, 3, 13) else lang in ("even", "odd") and 0.5 <= score <= 1
    assert language.predict(empty(spark), model).count() == 0
    nothing = language.train(table.limit(0), lang_col="tongue")
    assert {r.language.lang for r in language.predict(table, nothing).collect()} == {"und"}
    with pytest.raises(ValueError, match="already"):
        language.predict(table, model, out="text")


def test_pieces_of_a_long_text_count_the_same(monkeypatch):
    text = ROWS[4][1]
    whole = language._grams(text)
    monkeypatch.setattr(language, "PIECE", 1000)
    assert (language._grams(text) == whole).all()


def test_probabilities_are_calibrated_by_a_temperature():
    import numpy as np

    draw = np.random.default_rng(1)
    labels = draw.integers(0, 3, 4000)
    logits = draw.normal(size=(4000, 3)) + 2 * np.eye(3)[labels]
    t = language._fit_temperature(10 * logits, labels)
    assert 3 < t < 12  # ten times too sure, and somewhat less than that is right


def test_held_out_toxicity(spark):
    folder = "/root/testdata/sf0.1"
    got = queries.op7_toxicity(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for r in rows)
    toxic = [r.predicted for r in rows if r.toxic == 1]
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert sum(toxic) / len(toxic) > 0.85 and sum(clean) / len(clean) < 0.05
    assert got.where("score is null or score < 0 or score > 1").isEmpty()


def test_folding():
    assert toxicity.fold("You ID1OT, s7upid") == " you idiot stupid "
    assert toxicity.fold("idіоt mörön 100 3") == " idiot moron 100 3 "  # Cyrillic letters
    assert toxicity.fold("") == "  "


def test_terms_exceptions_and_length():
    model = toxicity.ToxicityModel({" clown ": 5.0, " idio": 6.0}, ("clown fish",))
    assert model.features("a clown")[0] > 0
    assert model.features("a clown fish") == (0.0, 0.0)
    assert model.features("clown fish, clown")[0] == model.features("clown")[0]
    assert model.features("idiotic")[0] > 0 and model.features("clowns")[0] == 0
    assert model.features("clown " + "word " * 50)[1] < model.features("clown")[1]
    assert model.features(None) == model.features("") == (0.0, 0.0)


def test_toxicity_of_awkward_rows(spark):
    labels = spark.createDataFrame([(4, 1), (6, 0), (6, 0), (9, None), (None, 1), (99, 1), (10, 0)], "doc_id long, toxic int")
    table = docs(spark)
    model = toxicity.train(table, labels)
    got = toxicity.score(table, model)
    assert got.count() == len(ROWS) and got.where("toxicity between 0 and 1").count() == len(ROWS)
    assert toxicity.score(empty(spark), model).count() == 0
    for rows in (labels.limit(0), labels.where("toxic = 0")):
        assert toxicity.train(table, rows).weights == {}


RULES = queries.URL_RULES


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("https://A.example.NET/en/x?q=/fr/", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("https://a.example.net/EN/x", "a.example.net", "/EN/x", "net/", "block"),
        ("https://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
        ("http://notexample.com/de/", "notexample.com", "/de/", None, None),
        ("http://x.org/fr/1", "x.org", "/fr/1", "org/fr/", "allow"),
        ("http://x.org#/fr/1", "x.org", "", None, None),
        ("http://x.net", "x.net", "", None, None),
        ("no url", "", "", None, None),
        ("a://b://c/d", "b:", "//c/d", None, None),
        ("http://É.org/fr/", "É.org", "/fr/", "org/fr/", "allow"),
        (None, "", "", None, None),
        ("", "", "", None, None),
    ],
)
def test_rules(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, "x")], "page_id long, url string, text string")
    got = url_filter.filter_urls(pages, RULES).first()
    assert (got.host, got.path, got.rule) == (host, path, rule)
    assert got.verdict == (verdict or "allow")  # nothing to learn from here


def test_models_part_what_rules_leave_open(spark):
    """Open hosts that are written like accepted or like rejected ones."""
    rules = [url_filter.UrlRule("good.example", "/", "allow"), url_filter.UrlRule("bad.example", "/", "block")]
    rows = [f"https://{w}{i}.good.example/news/{w}/{i}" for i in range(60) for w in ("garden", "library")]
    rows += [f"https://{w}{i}.bad.example/buy/{w}/{i}?x=1" for i in range(60) for w in ("casino", "pills")]
    rows += ["https://library.other.example/news/garden/5", "https://casino.other.example/buy/pills/5", None, "x" * 20_000] + [rows[0]] * 50
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = url_filter.filter_urls(pages, rules).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got}
    assert (by_id[240].verdict, by_id[241].verdict) == ("allow", "block")
    assert by_id[0].score is None and by_id[240].score is not None
    assert all(r.verdict in ("allow", "block") for r in got)
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0


def test_models_see_scheme_query_and_fragment(spark):
    """URLs of one host and path, and ones without ``://``, that say different things."""
    rules = [url_filter.UrlRule("good.example", "/", "allow"), url_filter.UrlRule("bad.example", "/", "block")]
    rows = [f"https://h{i}.good.example/page?topic=garden{i}#library{i}" for i in range(100)]
    rows += [f"http://h{i}.bad.example/page?topic=casino{i}#pills{i}" for i in range(100)]
    rows += ["https://h.other.example/page?topic=garden1", "https://h.other.example/page?topic=casino1"]
    rows += ["https://h.other.example/page#library1", "https://h.other.example/page#pills1"]
    rows += ["topic=garden1#library1", "topic=casino1#pills1", "https://h.other.example/x", "http://h.other.example/x", None, ""]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r.page_id - 200: r for r in url_filter.filter_urls(pages, rules).collect()}
    assert len(got) == len(rows)
    assert [got[i].verdict for i in (0, 1, 4, 5)] == ["allow", "block"] * 2
    assert all(got[i].score > got[i + 1].score for i in (0, 2, 4, 6))
    assert got[8].score == got[9].score is not None
    assert (got[1].host, got[1].path, got[5].host, got[5].path) == ("h.other.example", "/page", "", "")


def test_url_query(spark):
    got = queries.op4_url_filter(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert {r.rule for r in got} == {None, "net/", "example.net/en/", "example.com/de/", "org/fr/"}


def test_hash_split_matches_crc32(spark):
    rows = spark.range(200).select("id", crc_bucket(F.col("id"), 3).alias("b")).collect()
    assert all(r.b == crc32(str(r.id).encode()) % 3 for r in rows)


def test_exceptions_are_looked_up_in_one_pass():
    """Against comparing every hit with every phrase; a text of a megabyte takes under a second."""
    model = toxicity.ToxicityModel({" clown": 3.0, " fish ": 2.0, " trash ": 4.0, " tra": 1.0}, toxicity.EXCEPTIONS)

    def by_hand(text):
        words = toxicity.fold(text).split()
        covered = {i + k for p in model.exceptions for i in range(len(words)) if words[i : i + len(p.split())] == p.split() for k in range(len(p.split()))}
        total = sum(
            max([w for t, w in model.weights.items() if f" {word} ".startswith(t)], default=0.0) for i, word in enumerate(words) if i not in covered
        )
        return float(np.log1p(total)), float(np.log1p(100 * total / max(1, len(words))))

    draw = random.Random(5)
    for _ in range(300):
        text = " ".join(draw.choices(["clown", "fish", "white", "trash", "can", "bin", "other"], k=draw.randrange(12)))
        assert np.allclose(model.features(text), by_hand(text))
    for text in ("clown fish ", "trash word ", "clown fish trash word ", "white trash can "):
        started = time.perf_counter()
        model.features(text * (1_000_000 // len(text)))
        assert time.perf_counter() - started < 2


def by_witten_bell(learn):
    """The probability of a character after those before it, from plain counts of each order."""
    pad = "\x02" * url_filter.ORDER
    counts = [Counter() for _ in range(url_filter.ORDER + 2)]
    for text in learn:
        whole = pad + text + "\x03"
        for i in range(url_filter.ORDER, len(whole)):
            for k in range(url_filter.ORDER + 1):
                counts[k][whole[i - k : i + 1]] += 1

    def probability(gram):
        p = 1 / url_filter.ALPHABET
        for k in range(url_filter.ORDER + 1):
            context = gram[url_filter.ORDER - k : url_filter.ORDER]
            after = {g: n for g, n in counts[k].items() if g[:-1] == context}
            if after:
                p = (after.get(context + gram[-1], 0) + len(after) * p) / (sum(after.values()) + len(after))
        return p

    return probability


def test_url_scores_by_hand(spark):
    draw = random.Random(4)
    urls = [f"http://{h}/{draw.choice(['a', 'bb', 'xyz'])}{draw.randrange(9)}" for h in ("ok.org", "ok.org", "bad.net", "bad.net", "open.io") for _ in range(9)]
    rules = [url_filter.UrlRule("org", "/", "allow"), url_filter.UrlRule("net", "/", "block")]
    table = spark.createDataFrame(list(enumerate([*urls, None, "ok.org/x"])), "page_id int, url string")
    got = url_filter.filter_urls(table, rules).collect()
    texts = sorted(set(urls))
    signed = lambda n: n - (1 << 64) if n >> 63 else n
    held = {t for t in texts if signed(xxhash.xxh64_intdigest(t, seed=42)) % url_filter.HELD_BACK == 0}
    good, bad = (by_witten_bell([t for t in texts if mark in t and t not in held]) for mark in ("ok.org", "bad.net"))
    scored = [r for r in got if r.rule is None]
    assert {r.page_id for r in scored} == set(range(36, 47))
    for r in scored:
        text = ([*urls, None, "ok.org/x"][r.page_id]) or ""
        whole = "\x02" * url_filter.ORDER + text + "\x03"
        grams = [whole[i : i + url_filter.ORDER + 1] for i in range(len(text) + 1)]
        assert np.isclose(r.score, np.mean([np.log(good(g) / bad(g)) for g in grams]))
    assert max([r.score for r in scored if r.verdict == "block"], default=-9) < min([r.score for r in scored if r.verdict == "allow"], default=9)
