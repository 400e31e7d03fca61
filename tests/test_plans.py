"""Physical plans: what is read, what is shuffled, and what a hot key does."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as wired
import provenir as pv
from provenir.functions import joins
from provenir.operators import provenance

SMALL_PARTITIONS = {
    "spark.sql.shuffle.partitions": "64",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
}


@pytest.fixture
def like_large_tables(spark):
    """Thresholds scaled down, so that small tables are treated as large ones."""
    before = {k: spark.conf.get(k, None) for k in SMALL_PARTITIONS}
    for key, value in SMALL_PARTITIONS.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def plan_of(df, final=False):
    if final:
        df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0] if final else text


def exchanges(df):
    """Shuffles of the plan before execution."""
    return len(re.findall(r"\bExchange (?!SinglePartition)", plan_of(df)))


NARROW = [
    "scan_documents",
    "extract_values",
    "extract_text",
    "conform_schema",
    "validate_records",
    "organise_by_round",
    "write_csv",
    "write_jsonl",
    "write_html",
    "html_rows",
    "listing_links",
    "long_fields",
    "build_records",
    "semi_structured_values",
]
# The only shuffle is the one that groups the lookup itself.
BROADCAST = ["verification_status", "attach_provenance", "analysis_view", "verify_records"]
ONE_SHUFFLE = [
    "reconcile_fields",
    "violation_counts",
    "duplicate_keys",
    "duplicate_content",
]


@pytest.mark.parametrize("name", NARROW)
def test_row_wise_queries_do_not_shuffle(spark, sf_dir, name):
    assert exchanges(wired.queries()[name](spark, sf_dir)) == 0


@pytest.mark.parametrize("name", ONE_SHUFFLE)
def test_groupings_shuffle_once(spark, sf_dir, name):
    assert exchanges(wired.queries()[name](spark, sf_dir)) == 1


def test_a_small_listing_leaves_the_records_in_place(spark, like_large_tables, monkeypatch):
    records = hot_records(spark)
    listed = spark.range(5, 12).select(F.col("id").alias("doc_id"))
    plan = plan_of(pv.missing_documents(listed, records, ["doc_id"]))
    assert re.search(r"BroadcastHashJoin .*LeftSemi", plan)
    # The one shuffle of records is of the few that were found.
    assert {r.doc_id for r in pv.missing_documents(listed, records, ["doc_id"]).collect()} == {6}

    monkeypatch.setattr(joins, "SMALL_ROWS", 2)
    missing = pv.missing_documents(listed, records, ["doc_id"])
    assert "BroadcastHashJoin" not in plan_of(missing)
    assert {r.doc_id for r in missing.collect()} == {6}


def test_the_listing_is_parsed_once(spark, sf_dir):
    """The written listing is read where it is needed; pages are read for their URLs alone."""
    plan = wired.queries()["missing_links"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "regexp" not in plan
    scans = plan_of(wired.queries()["missing_links"](spark, sf_dir))
    assert "html" not in scans


def test_scripts_are_looked_for_once(spark, sf_dir):
    plan = wired.queries()["build_records"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("!--.*?") <= 1


@pytest.mark.parametrize("name", BROADCAST)
def test_small_lookups_leave_the_records_in_place(spark, sf_dir, name):
    plan = plan_of(wired.queries()[name](spark, sf_dir))
    assert "SortMergeJoin" not in plan
    assert plan.count("BroadcastHashJoin") == plan.count("Exchange hashpartitioning") > 0


@pytest.mark.parametrize("name", list(wired.library_queries()))
def test_no_query_leaves_the_jvm_or_pairs_everything(spark, sf_dir, name):
    plan = plan_of(wired.queries()[name](spark, sf_dir))
    assert not re.search(r"Python|Pandas|CartesianProduct|NestedLoop|BatchEvalPython", plan)


def test_only_needed_columns_are_read(spark, sf_dir):
    status = plan_of(wired.queries()["verification_status"](spark, sf_dir))
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in status
    links = plan_of(pv.missing_documents(wired._pages(spark, sf_dir), wired._pages(spark, sf_dir)))
    assert "html" not in links


def test_filters_reach_the_scan(spark, sf_dir):
    view = wired.queries()["analysis_view"](spark, sf_dir).where((F.col("lang") == "fr") & (F.col("doc_id") > 5))
    plan = plan_of(view)
    assert "EqualTo(lang,fr)" in plan
    assert plan.count("GreaterThan(doc_id,5)") == 2  # of the records and of the checks


def hot_records(spark, n=240_000, parts=24):
    """Every third record has key 9; the others are on their own."""
    key = F.when(F.col("id") % 3 == 0, F.lit(9)).otherwise(F.col("id"))
    return spark.range(0, n, 1, parts).select(key.alias("doc_id"), F.md5(F.col("id").cast("string")).alias("body"))


def largest_task_share(df):
    sizes = [r["count"] for r in df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()]
    return max(sizes) / sum(sizes)


def test_a_hot_key_is_split_over_tasks(spark, like_large_tables):
    records = hot_records(spark)
    checks = spark.range(0, 240_000, 1, 8).select(
        (F.col("id") % 60_000).alias("doc_id"), (F.col("id") % 5 != 0).alias("passed")
    )
    status = pv.verification_status(records, checks).withColumn("task", F.spark_partition_id())
    rows = status.select("doc_id", "body", "status", "task").collect()
    assert len(rows) == 240_000
    per_task = {}
    for r in rows:
        per_task[r.task] = per_task.get(r.task, 0) + 1
    assert max(per_task.values()) < 240_000 / 6  # the hot key alone has a third

    plan = plan_of(status, final=True)
    assert "SortMergeJoin(skew=true)" in plan

    failed = {r.doc_id for r in checks.where(~F.col("passed")).select("doc_id").distinct().collect()}
    for r in rows:
        assert r.status == ("unverified" if r.doc_id >= 60_000 else "rejected" if r.doc_id in failed else "verified")


def test_hot_rounds_and_sources_too_many_to_broadcast(spark, like_large_tables, monkeypatch):
    monkeypatch.setattr(joins, "SMALL_ROWS", 2)
    records = hot_records(spark).withColumnRenamed("doc_id", "round")
    sources = spark.createDataFrame([("A", [9, 1]), ("B", [2])], "source_page string, rounds array<long>")
    sourced = pv.attach_provenance(records, sources)
    assert sourced.groupBy("source_page").count().where("source_page = 'A'").first()["count"] == 80_001
    plan = plan_of(sourced, final=True)
    assert "SortMergeJoin(skew=true)" in plan


def test_bucketed_tables_are_joined_as_they_lie(spark, like_large_tables, tmp_path):
    records = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 4 + 1).cast("int").alias("round"))
    checks = spark.range(0, 4000, 3).select(F.col("id").alias("doc_id"), (F.col("id") % 2 == 0).alias("passed"))
    for name, df in (("bucketed_records", records), ("bucketed_checks", checks)):
        df.write.bucketBy(4, "doc_id").sortBy("doc_id").option("path", str(tmp_path / name)).saveAsTable(name)
    try:
        sources = wired._sources(spark)
        stored = spark.table("bucketed_records"), sources, spark.table("bucketed_checks")
        view = pv.analysis_view(*stored, bucketed=True)
        plan = plan_of(view)
        assert "SortMergeJoin" in plan
        assert exchanges(view) == 1  # of the source pages
        assert exchanges(pv.analysis_view(*stored)) > 1
        expected = pv.analysis_view(records, sources, checks)
        assert view.exceptAll(expected).isEmpty() and expected.exceptAll(view).isEmpty()
    finally:
        spark.sql("drop table bucketed_records")
        spark.sql("drop table bucketed_checks")


@pytest.mark.parametrize("build", ["missing", "reconcile", "copies", "keys", "complete"])
def test_hot_groups_are_reduced_before_the_shuffle(spark, build, monkeypatch):
    # The reduced listing is written by a job of its own; here it stays in the plan to be looked at.
    monkeypatch.setattr(provenance, "stored", lambda df, name: df)
    hot = hot_records(spark)
    texts = hot.select("doc_id", F.when(F.col("doc_id") == 9, F.lit("copy")).otherwise(F.col("body")).alias("body"))
    df = {
        "missing": lambda: pv.missing_documents(hot, hot.where("doc_id > 9"), ["doc_id"]),
        "reconcile": lambda: pv.reconcile(texts, texts, ["doc_id"], "body"),
        "copies": lambda: pv.duplicate_content(texts, "body", "doc_id"),
        "keys": lambda: pv.duplicate_keys(hot, ["doc_id"]),
        "complete": lambda: pv.completeness(spark.createDataFrame([(9, 80_000)], "doc_id long, expected long"), hot, "doc_id"),
    }[build]()
    plan = plan_of(df)
    shuffle = plan.index("Exchange hashpartitioning")
    assert "partial_" in plan[shuffle:]
    if build == "keys":
        assert [tuple(r) for r in df.collect()] == [(9, 80_000)]
    if build == "copies":
        assert [r.n_copies for r in df.collect()] == [80_000]
    if build == "missing":
        assert {r.doc_id for r in df.collect()} == {1, 2, 4, 5, 7, 8, 9}
    if build == "reconcile":
        assert {r.state for r in df.collect()} == {"match"}
    if build == "complete":
        assert df.where("doc_id = 9").first().state == "complete"


def test_small_means_both_rows_and_bytes(spark, monkeypatch):
    df = spark.range(100).select(F.col("id").cast("string").alias("s"), F.lit(None).cast("string").alias("n"))
    assert joins.is_small(df)
    assert joins.is_small(df.limit(0))
    monkeypatch.setattr(joins, "SMALL_BYTES", 189)  # 10 of one digit, 90 of two
    assert not joins.is_small(df)
    monkeypatch.setattr(joins, "SMALL_BYTES", 190)
    assert joins.is_small(df)
    monkeypatch.setattr(joins, "SMALL_ROWS", 99)
    assert not joins.is_small(df)
