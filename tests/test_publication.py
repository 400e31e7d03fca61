"""What changed, publishing only that, the manifest, and taking in what arrives."""

import hashlib
import os
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import provenir as pv
from tests.test_plans import plan_of

ROWS = "doc_id int, round int, a string, b double"


def some(draw, n):
    return [(draw.choice([None, *range(60)]), draw.choice([None, 1, 2, 3]), draw.choice([None, "", "x", "xy"]), draw.choice([None, 0.5])) for _ in range(n)]


def test_publication_diff(spark):
    draw = random.Random(8)
    old = some(draw, 150)
    new = [r for r in old if draw.random() < 0.8] + some(draw, 30)
    new += [(90, 1, "m", 1.0), (91, 1, "", None), (92, 1, "1:a", None)]
    old += [(90, 2, "m", 1.0), (91, 1, None, None), (92, 1, "1", None)]

    def expected(key):
        mine, theirs = ([r[1:] for r in side if r[0] == key] for side in (old, new))
        same = Counter(r[1:] for r in mine) == Counter(r[1:] for r in theirs)
        change = "added" if not mine else "removed" if not theirs else "unchanged" if Counter(mine) == Counter(theirs) else "moved" if same else "changed"
        return key, len(mine), len(theirs), change

    left, right = (spark.createDataFrame(side, ROWS) for side in (old, new))
    got = pv.publication_diff(left.withColumn("more", F.lit(1)), right)
    assert {tuple(r) for r in got.collect()} == {expected(k) for k in {r[0] for r in old + new}}
    assert {r.change for r in got.collect()} >= {"added", "removed", "changed", "moved", "unchanged"}
    touched = {r.round: r.left for r in pv.touched_groups(left, right).collect()}
    by_round = [Counter() if not side else {g: Counter(r for r in side if r[1] == g) for g in (None, 1, 2, 3)} for side in (old, new)]
    assert touched == {g: bool(by_round[1][g]) for g in (None, 1, 2, 3) if by_round[0][g] != by_round[1][g]}
    assert pv.publication_diff(left.limit(0), right.limit(0)).count() == 0


def test_hot_rows_are_counted_before_the_shuffle(spark):
    rows = spark.range(30_000).select(F.lit(1).alias("doc_id"), F.lit(1).alias("round"), F.lit("same").alias("a"))
    got = pv.publication_diff(rows, rows.limit(29_999))
    assert [tuple(r) for r in got.collect()] == [(1, 30_000, 29_999, "changed")]
    plan = plan_of(got)
    assert "Join" not in plan and plan.count("partial_sum") >= 2


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


@pytest.mark.parametrize("even_files", [False, True])
def test_only_touched_rounds_are_written(spark, tmp_path, even_files):
    path = str(tmp_path / "published")
    old = [(i, i % 5 if i % 5 else None, str(i)) for i in range(50)]
    schema = "doc_id int, round int, a string"
    pv.organise_by_round(spark.createDataFrame(old, schema), path)
    before = files_of(path)
    new = [(i, r, a + "!" if r == 2 else a) for i, r, a in old if r != 3] + [(99, 7, "new"), (0, None, "0")]
    got = pv.publish_changes(spark.createDataFrame(new, schema), path, even_files=even_files)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, new))
    after = files_of(path)
    kept = {f for f in before if "round=1/" in f or "round=4/" in f}
    assert kept and all(after.get(f) == before[f] for f in kept)
    assert not any("round=3/" in f for f in after) and not any(f in after for f in before if "round=2/" in f or "HIVE_DEFAULT" in f)
    # Nothing changed: no file is touched. All gone: an empty table is left.
    assert pv.publish_changes(spark.createDataFrame(new, schema), path).count() == len(new) and files_of(path) == after
    assert pv.publish_changes(spark.createDataFrame(new, schema).limit(0), path).count() == 0


def verified(row, root):
    """Whether the proof leads from the record's hash to the root."""
    at, own = row.position, row.hash
    for group in row.proof:
        if group[at % 16] != own:
            return False
        own, at = hashlib.sha256("".join(group).encode()).hexdigest(), at // 16
    return own == root


@pytest.mark.parametrize("n", [0, 1, 16, 17, 300])
def test_manifest(spark, n):
    draw = random.Random(n)
    rows = [(draw.choice([None, *range(200)]), draw.choice([None, "", "a", "b"])) for _ in range(n)]
    df = spark.createDataFrame(rows, "doc_id int, a string")
    manifest = pv.publication_manifest(df)
    found = pv.proofs(manifest).collect()
    assert len(found) == n and sorted(r.position for r in found) == list(range(n))
    assert all(verified(r, manifest.root) for r in found) and (manifest.root is None) == (n == 0)
    again = pv.publication_manifest(df.repartition(3))
    assert again.root == manifest.root  # the order of reading is no matter
    if n > 1:
        other = pv.publication_manifest(spark.createDataFrame([(rows[0][0], "z"), *rows[1:]], "doc_id int, a string"))
        assert other.root != manifest.root
        one = pv.proofs(manifest, spark.createDataFrame([(k,) for k, _ in rows[:1]], "doc_id int"))
        assert {r.position for r in one.collect()} <= set(range(n))


def test_positions_of_rows_that_are_all_alike(spark):
    rows = spark.range(0, 40_000, 1, 8).select(F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(F.lit(-1)).alias("k"))
    from provenir.functions.ordered import with_positions

    got = with_positions(rows, ["k"])
    assert got.agg(F.min("position"), F.max("position"), F.countDistinct("position")).first() == (0, 39_999, 40_000)
    assert got.where("k = -1").agg(F.max("position")).first()[0] == got.where("k = -1").count() - 1
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 40_000 / 3


EVENT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("at", T.TimestampNTZType()), T.StructField("v", T.StringType())])
START = datetime(2024, 1, 1)


def arrive(spark, folder, rows):
    df = spark.createDataFrame([(k, None if d is None else START + timedelta(days=d), v) for k, d, v in rows], EVENT)
    df.coalesce(1).write.mode("append").parquet(folder)


def test_intake_goes_on_where_it_stopped(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "table", "checkpoint"))
    run = lambda **more: {(r.doc_id, r.v) for r in pv.intake_stream(spark, source, EVENT, path, checkpoint, **more).collect()}
    arrive(spark, source, [(1, 0, "a"), (1, 0, "a"), (2, 1, "b"), (None, 1, "n"), (None, 1, "n")])
    assert run(at="at") == {(1, "a"), (2, "b"), (None, "n")}
    assert run(at="at") == {(1, "a"), (2, "b"), (None, "n")}  # nothing new
    arrive(spark, source, [(2, 2, "repeated"), (3, 20, "c")])
    assert run(at="at") == {(1, "a"), (2, "b"), (None, "n"), (3, "c")}
    arrive(spark, source, [(4, 1, "late"), (5, 14, "in time")])
    assert run(at="at") == {(1, "a"), (2, "b"), (None, "n"), (3, "c"), (5, "in time")}
    assert spark.read.parquet(path).count() == 5


def test_intake_equals_the_batch(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "table", "checkpoint"))
    for part in range(4):
        arrive(spark, source, [(i % 37, i % 5, f"{i % 37}") for i in range(part * 50, part * 50 + 80)])
    got = pv.intake_stream(spark, source, EVENT, path, checkpoint, files_per_run=1)
    batch = spark.read.parquet(source).select("doc_id", "v").distinct()
    assert got.count() == 37 and got.select("doc_id", "v").exceptAll(batch).isEmpty()
