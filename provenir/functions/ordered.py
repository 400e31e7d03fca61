"""Rows of a key in the order of time, without one task for a key that has very many.

A window over a key sorts all its rows in one task. Here a hot key is cut into spans of
time of about equal size; windows run within spans, and what has to pass from one to the
next is settled afterwards on a few rows for each span.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenir.functions.joins import join_lookup
from provenir.sinks.scratch import stored

# A key with more rows than this is cut into spans of about as many.
HOT_ROWS = 5_000_000
# Spans of all keys together, which bounds what is sent to every task.
MAX_SPANS = 10_000
# A time is looked up among every so manyth cut, then among as many that follow.
STRIDE = 64


def have_all(columns: Sequence[str]) -> Column:
    return reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])


def hot_spans(rows: DataFrame, keys: Sequence[str], at: str, hot_rows: int | None = None) -> DataFrame | None:
    """``keys, __cuts, __coarse``: where in time the rows of each hot key are cut, and every
    ``STRIDE``-th of these; None without such keys.

    Two passes over keys and times alone: one counts rows by key; if any key is hot, one
    takes the quantiles of its times. There are fewer than ``MAX_SPANS`` hot keys and cuts,
    whatever the size of the table.
    """
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total, most = counted.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.coalesce(F.max("__n"), F.lit(0))).first()
    span = max(HOT_ROWS if hot_rows is None else hot_rows, total // MAX_SPANS, 1)
    if most <= span:
        return None
    hot = rows.sparkSession.createDataFrame(counted.where(F.col("__n") > span).collect(), counted.schema)
    pieces = min(-(-most // span), MAX_SPANS)
    own = rows.select(*keys, at).join(F.broadcast(hot), list(keys))
    shares = F.array(*(F.lit(i / pieces) for i in range(1, pieces)))
    found = own.groupBy(*keys, "__n").agg(F.percentile_approx(at, shares, F.lit(max(100, 4 * pieces))).alias("__cuts"))
    # All keys were asked for as many quantiles; a smaller key takes every so manyth of them.
    step = F.greatest(F.floor(F.lit(pieces * span) / F.col("__n")), F.lit(1))
    thinned = F.array_distinct(F.filter("__cuts", lambda c, i: (i + 1) % step == 0))
    coarse = F.filter("__cuts", lambda c, i: (i + 1) % STRIDE == 0)
    return found.select(*keys, thinned.alias("__cuts")).withColumn("__coarse", coarse)


def in_spans(rows: DataFrame, spans: DataFrame | None, keys: Sequence[str], at: str) -> DataFrame:
    """``rows`` with ``__span``, counted from 0 in each hot key and null for the other keys.

    Equal times of a key are in one span.
    """
    if spans is None:
        return rows.withColumn("__span", F.lit(None).cast("int"))
    placed = join_lookup(rows, spans, keys, small=True)
    past = STRIDE * F.size(F.filter("__coarse", lambda c: c <= F.col(at)))
    span = past + F.size(F.filter(F.slice("__cuts", past + 1, F.lit(STRIDE)), lambda c: c <= F.col(at)))
    return placed.withColumn("__span", F.when(F.col("__cuts").isNotNull(), span)).drop("__cuts", "__coarse")


def with_positions(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``position``, counted from 0 in the order of the columns ``order``.

    Rows go to ranges of the order and are written; ranges are then counted and numbered
    each in a task of its own, from where the ones before end. Equal rows are spread by
    where they were read, so even a row that is a third of the table fills no range.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(n, *order, "__row")
    ranged = stored(spread.withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select(F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__begin"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order, "__row"))
    numbered = ranged.withColumn("__within", within).join(F.broadcast(begins), F.col("__range") == F.col("__r"))
    return numbered.select(*rows.columns, (F.col("__begin") + F.col("__within") - 1).cast("long").alias("position"))
