"""Operators on small tables with the cases the test data lacks."""

import hashlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as wired
import provenir as pv


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_absent_and_malformed_values_stay_apart(spark):
    docs = spark.createDataFrame(
        [(1, "amount: １，２００ on 2024-02-29"), (2, "amount: many on 2023-02-29"), (3, "nothing"), (4, None)],
        "doc_id int, text string",
    )
    fields = [
        pv.Field("amount", "text", r"amount: (\S+)", T.DecimalType(18, 2)),
        pv.Field("day", "text", r"on (\S+)", T.DateType()),
        pv.Field("n_o", "text", r"o", T.LongType(), count=True),
    ]
    got = rows(pv.extract_values(docs, fields, ["doc_id"]).withColumn("day", F.col("day").cast("string")))
    assert got == [
        (1, Decimal("1200.00"), "2024-02-29", 2, []),
        (2, None, None, 2, ["amount", "day"]),
        (3, None, None, 1, []),
        (4, None, None, None, []),
    ]


def test_conform_flags_bad_casts_but_not_absent_values(spark):
    df = spark.createDataFrame([("7", "x"), (None, "1.5"), ("seven", None)], "a string, b string")
    conformed = pv.conform(df, [pv.Target("n", "a", T.IntegerType()), pv.Target("x", "b", T.DecimalType(18, 2)), pv.Target("b", "b", T.StringType())])
    assert sorted(map(repr, conformed.collect())) == sorted(
        map(
            repr,
            [
                T.Row(n=7, x=None, b="x", bad_casts=["x"]),
                T.Row(n=None, x=Decimal("1.50"), b="1.5", bad_casts=[]),
                T.Row(n=None, x=None, b=None, bad_casts=["n"]),
            ],
        )
    )


def test_conform_flags_numbers_that_do_not_survive(spark):
    df = spark.createDataFrame([(3.7, 5), (4.0, 6), (None, None)], "x double, n long")
    conformed = pv.conform(df, [pv.Target("i", "x", T.IntegerType()), pv.Target("d", "n", T.DoubleType())])
    assert [r.bad_casts for r in conformed.orderBy("i").collect()] == [[], ["i"], []]


def test_absent_declared_columns_and_taken_names_raise(spark, sf_dir):
    from provenir.sources import schemas

    with pytest.raises(ValueError, match="no column"):
        schemas.read_table(spark, f"{sf_dir}/lineitem.parquet", schemas.PAGES)
    records = spark.createDataFrame([(1, 1, "x", "y")], "doc_id int, round int, status string, source_page string")
    with pytest.raises(ValueError, match="status"):
        pv.verification_status(records, spark.createDataFrame([(1, True)], "doc_id int, passed boolean"))
    with pytest.raises(ValueError, match="source_page"):
        pv.attach_provenance(records, spark.createDataFrame([("A", [1])], "source_page string, rounds array<int>"))


def test_rules(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, -5)], "id int, n int")
    rules = [pv.Rule("positive", F.col("n") > 0), pv.Rule("present", F.col("n").isNotNull())]
    checked = pv.validate(df, rules)
    assert rows(checked.select("id", "violations"), "id") == [(1, []), (2, ["present"]), (3, ["positive"])]
    assert rows(pv.violation_counts(checked)) == [("positive", 1), ("present", 1)]
    with pytest.raises(ValueError, match="repeat"):
        pv.validate(df, [rules[0], rules[0]])


def test_status_keeps_every_record(spark):
    records = spark.createDataFrame([(1,), (1,), (2,), (3,), (4,), (None,)], "doc_id int")
    checks = spark.createDataFrame(
        [(1, True), (1, True), (2, True), (2, False), (3, None), (9, True), (None, True)], "doc_id int, passed boolean"
    )
    got = rows(pv.verification_status(records, checks), F.col("doc_id").asc_nulls_last())
    assert got == [
        (1, "verified"),
        (1, "verified"),
        (2, "rejected"),
        (3, "unverified"),
        (4, "unverified"),
        (None, "unverified"),
    ]


@pytest.mark.parametrize(("of_records", "of_checks"), [("long", "int"), ("int", "long"), ("string", "int"), ("decimal(9,2)", "short")])
def test_keys_of_different_types_meet(spark, of_records, of_checks):
    records = spark.range(50).select(F.col("id").cast(of_records).alias("doc_id"))
    checks = spark.range(0, 50, 2).select(F.col("id").cast(of_checks).alias("doc_id"), F.lit(True).alias("passed"))
    status = pv.verification_status(records, checks)
    assert status.where("status = 'verified'").count() == 25
    assert pv.missing_documents(records, checks, ["doc_id"]).count() == 25
    states = pv.reconcile(records.withColumn("v", F.lit(1)), checks.withColumn("v", F.lit(1)), ["doc_id"], "v")
    assert states.where("state = 'match'").count() == 25
    sources = spark.createDataFrame([("A", [1, 2])], "source_page string, rounds array<int>")
    sourced = pv.attach_provenance(records.withColumnRenamed("doc_id", "round"), sources)
    assert sourced.where("source_page = 'A'").count() == 2


def test_source_page_of_a_round_must_be_definite(spark):
    records = spark.createDataFrame([(1, 1), (2, 7), (3, None)], "doc_id int, round int")
    sources = spark.createDataFrame([("A", [1, 2]), ("A", [1])], "source_page string, rounds array<int>")
    assert rows(pv.attach_provenance(records, sources), "doc_id") == [(1, 1, "A"), (2, 7, None), (3, None, None)]
    claimed = sources.union(spark.createDataFrame([("B", [1])], sources.schema))
    with pytest.raises(Exception, match="several source pages for round 1"):
        pv.attach_provenance(records, claimed).collect()


def test_missing_documents(spark):
    listed = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "url string")
    records = spark.createDataFrame([("b",), ("c",), (None,)], "url string")
    missing = pv.missing_documents(listed, records)
    assert set(map(tuple, missing.collect())) == {("a", 2), (None, 1)}
    matched = listed.select("url").join(records, "url", "left_semi").count()
    assert missing.agg(F.sum("n_listed")).first()[0] + matched == listed.count()


def test_completeness_keeps_groups_nobody_expected(spark):
    expected = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (4, 0)], "round int, expected int")
    records = spark.createDataFrame([(1,), (2,), (2,), (9,), (9,)], "round int")
    assert rows(pv.completeness(expected, records)) == [
        (1, 2, 1, "short"),
        (2, 1, 2, "over"),
        (3, 1, 0, "short"),
        (4, 0, 0, "complete"),
        (9, None, 2, "unexpected"),
    ]


def test_reconcile_states(spark):
    schema = "k int, v string"
    official = spark.createDataFrame(
        [(1, "a"), (2, "a"), (3, "a"), (4, None), (5, None), (6, "a"), (7, "a"), (7, "a"), (8, "a"), (8, "b"), (9, "a"), (9, None), (None, "a")],
        schema,
    )
    extracted = spark.createDataFrame(
        [(1, "a"), (2, "b"), (4, None), (5, "a"), (6, None), (7, "a"), (8, "a"), (9, "a"), (10, "a"), (None, "a")], schema
    )
    got = pv.reconcile(official, extracted, ["k"], "v")
    assert {(r.k, r.state) for r in got.collect()} == {
        (1, "match"),
        (2, "mismatch"),
        (3, "not_extracted"),
        (4, "match"),
        (5, "mismatch"),
        (6, "mismatch"),
        (7, "match"),
        (8, "mismatch"),
        (9, "mismatch"),
        (10, "not_in_official"),
        (None, "not_extracted"),
        (None, "not_in_official"),
    }
    assert got.agg(F.sum("n_official"), F.sum("n_extracted")).first() == (13, 10)


def test_reconcile_shows_values_that_differ_within_a_side(spark):
    official = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "k int, v string")
    extracted = spark.createDataFrame([(1, "a"), (2, "a")], "k int, v string")
    got = pv.reconcile(official, extracted, ["k"], "v").orderBy("k").collect()
    assert [(r.official, r.official_other, r.extracted, r.extracted_other, r.state) for r in got] == [
        ("a", "b", "a", None, "mismatch"),
        ("a", None, "a", None, "match"),
    ]


def test_reconcile_by_field(spark):
    official = spark.createDataFrame([(1, "x", 5), (2, "y", None), (3, "z", 1)], "id int, name string, n int")
    extracted = spark.createDataFrame([(1, "x", 6), (2, "y", None), (4, "z", 1)], "id int, name string, n int")
    got = pv.reconcile_fields(official, extracted, ["id"], ["name", "n"])
    assert rows(got.select("id", "field", "state")) == [
        (1, "n", "mismatch"),
        (1, "name", "match"),
        (2, "n", "match"),
        (2, "name", "match"),
        (3, "n", "not_extracted"),
        (3, "name", "not_extracted"),
        (4, "n", "not_in_official"),
        (4, "name", "not_in_official"),
    ]
    sides = [pv.long_fields(side, ["id"], ["name", "n"]) for side in (official, extracted)]
    long = pv.reconcile(*sides, ["id", "field"], "value")
    assert rows(long.select("id", "field", "state")) == rows(got.select("id", "field", "state"))


def test_coverage_and_duplicates(spark):
    df = spark.createDataFrame([(3, "t", None), (1, "t", 1), (2, None, None), (4, None, 1)], "id int, t string, n int")
    assert rows(pv.field_coverage(df, ["t", "n"])) == [("n", 4, 2), ("t", 4, 2)]
    assert [tuple(r)[1:] for r in pv.duplicate_content(df, "t", "id").collect()] == [(2, 1)]
    assert set(map(tuple, pv.duplicate_keys(df, ["n"]).collect())) == {(None, 2), (1, 2)}


def test_links_in_scripts_and_comments_do_not_count(spark):
    page = (
        """<a class=x HREF='/1'>1</a><!-- <a href="/no">-->"""
        """<script>"<a href='/no'>"</script><a data-href="/no">x</a><a\nhref = "/2?a=1&amp;b=2">2</a><a href=3.pdf>3</a><a name="n">"""
    )
    pages = spark.createDataFrame([(1, "https://h.example/list/", page), (2, "https://h.example/", "none"), (3, "u", None)], "doc_id int, url string, html string")
    assert rows(pv.listing_links(pages)) == [
        (1, 0, "https://h.example/1"),
        (1, 1, "https://h.example/2?a=1&b=2"),
        (1, 2, "https://h.example/list/3.pdf"),
    ]


def test_scan_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.html").write_bytes("<p>ä</p></HTML>".encode())
    (tmp_path / "sub" / "b.html").write_bytes(b"<p>\xff")
    (tmp_path / "c.txt").write_text("no")
    files = pv.scan_files(spark, str(tmp_path), "*.html")
    got = rows(files.select(F.element_at(F.split("url", "/"), -1).alias("f"), "n_bytes", "n_chars", "closed", "valid_utf8", "html"))
    assert got == [("a.html", 16, 15, True, True, "<p>ä</p></HTML>"), ("b.html", 4, 4, False, False, "<p>�")]
    records = pv.build_records(files, F.lit(1), keys=["url"])
    assert "doc_id" not in records.columns
    assert {(r.url.rsplit("/", 1)[1], r.body_text) for r in records.collect()} == {("a.html", "ä"), ("b.html", "�")}


def test_scan_files_leaves_the_settings_of_the_session(spark, tmp_path):
    (tmp_path / "a.html").write_text("a")
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    for before in (None, "77"):
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
        pv.scan_files(spark, str(tmp_path))
        assert spark.conf.get(key, None) == before
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            pv.scan_files(spark, str(tmp_path / "none"))
        assert spark.conf.get(key, None) == before
    spark.conf.unset(key)


def test_page_files_are_listed_in_parts(spark, tmp_path, monkeypatch):
    page = '<html lang="de"><title>T{0}</title><p>a\n&amp; {0}</p></html>'
    made = [(n, "u", page.format(n)) for n in (*range(60), 7)] + [(60, "u", None), (61, "u", "")]
    spark.createDataFrame(made, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    scan, listed = pv.scan_files, []

    def counted(*args):
        listed.append(len(scan(*args).inputFiles()))
        return scan(*args)

    def md5(text):
        return hashlib.md5(text.encode()).hexdigest()

    monkeypatch.setattr(pv, "scan_files", counted)
    want = [(n, 2, f"T{n}", "de", 1, md5(f"T{n} a & {n}")) for n in range(60)]
    want[7] = (7, 2, "T7", "de", 2, md5("T7 a & 7 T7 a & 7"))  # a page that comes twice
    want += [(n, None, None, None, 0, md5("")) for n in (60, 61)]
    for at_once, parts in ((20, 4), (1000, 1)):
        monkeypatch.setattr(wired, "FILES_AT_ONCE", at_once, raising=False)
        assert rows(wired.file_records(spark, str(tmp_path)), "doc_id") == want
        assert len(listed) == parts and sum(listed) == 62 and max(listed) < 2 * at_once
        listed.clear()


def test_records_of_a_truncated_page(spark):
    page = '<html lang="ja"><script>"<p><title>no"</script><!-- <p> --><head><title>&#026085;本 &amp; co'
    docs = spark.createDataFrame([(1, "https://h.example/ja/12?x", page)], "doc_id bigint, url string, html string")
    got = pv.build_records(docs, F.when(F.col("lang") == "ja", F.lit(4))).first().asDict()
    assert got == {
        "doc_id": 1,
        "round": 4,
        "url": "https://h.example/ja/12?x",
        "title": "日本 & co",
        "lang": "ja",
        "n_sections": 0,
        "url_no": 12,
        "body_text": "日本 & co",
        "malformed": [],
        "bad_casts": [],
    }


def test_conservation_over_the_tables(spark, sf_dir):
    import __spark_entry__ as wired

    queries = wired.queries()
    n_docs = wired._documents(spark, sf_dir).count()
    for name in ("verification_status", "analysis_view", "verify_records", "validate_records"):
        assert queries[name](spark, sf_dir).count() == n_docs
    by_round = queries["status_by_round"](spark, sf_dir)
    assert by_round.agg(F.sum("n_records")).first()[0] == n_docs
    total = queries["violation_counts"](spark, sf_dir).agg(F.sum("n_records")).first()[0]
    assert total == wired._validated(spark, sf_dir).agg(F.sum(F.size("violations"))).first()[0]


def test_listed_links_without_a_record(spark):
    pages = spark.createDataFrame(
        [(1, "https://h.example/list/", '<a href="a.pdf">a</a><a href="/list/b.pdf">b</a><a href="./a.pdf">again</a>')],
        "doc_id int, url string, html string",
    )
    listed = pv.listing_links(pages).withColumnRenamed("link", "url")
    records = spark.createDataFrame([("https://h.example/list/b.pdf",)], "url string")
    assert rows(pv.missing_documents(listed, records)) == [("https://h.example/list/a.pdf", 2)]
