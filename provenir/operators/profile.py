"""Figures of groups that can be kept, put together and asked later."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenir.functions.joins import is_small

# Two to the power of this many registers: a relative standard error of 1.04 / sqrt(2**14), 0.8 %.
DISTINCT_BITS = 14
# Items a quantile sketch keeps of each level; ranks are off by some 1.33 % at 200, less at more.
QUANTILE_ITEMS = 800


def status_rollup(df: DataFrame, by: Sequence[str] = ("round", "lang", "status")) -> DataFrame:
    """Rows of every combination of ``by``, of each part of it, and of all.

    ``grouping`` has a bit for each column, the first the highest, set where the column is
    summed over, which tells that from a null in the data. Sums are built before the one
    shuffle, so a combination with very many rows is one row for each task.
    """
    return df.cube(*by).agg(F.grouping_id().alias("grouping"), F.count(F.lit(1)).alias("n_records"))


def distinct_sketches(df: DataFrame, column: str, by: Sequence[str] = ("round",), bits: int = DISTINCT_BITS) -> DataFrame:
    """``by, n_rows, sketch``: of each group what it takes to estimate its distinct values.

    Sketches have a size of their own, whatever the group's, and can be stored with a
    publication. Nulls don't count; a group of nulls alone has an empty sketch.
    """
    value = F.col(column).cast("string")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.hll_sketch_agg(value, F.lit(bits)).alias("sketch"))


def distinct_counts(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Estimated distinct values of stored sketches, put together by ``by`` or all in one.

    The same as of a sketch of all their rows at once; the rows are not read again.
    """
    joined = sketches.groupBy(*by).agg(F.sum("n_rows").alias("n_rows"), F.hll_union_agg("sketch", F.lit(True)).alias("__all"))
    return joined.select(*by, "n_rows", F.hll_sketch_estimate("__all").alias("n_distinct"))


def value_sketches(df: DataFrame, column: str, by: Sequence[str] = ("round",), items: int = QUANTILE_ITEMS) -> DataFrame:
    """``by, n_rows, n_missing, low, high, sketch``: a quantile sketch of a numeric column by group.

    One pass. Nulls and what is not a number are counted as missing.
    """
    value = F.col(column).cast("double")
    known = F.when(~F.isnan(value), value)
    return df.withColumn("__value", known).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("__value").isNull()).alias("n_missing"),
        F.min("__value").alias("low"),
        F.max("__value").alias("high"),
        F.kll_sketch_agg_double("__value", F.lit(items)).alias("sketch"),
    )


def value_profile(sketches: DataFrame, by: Sequence[str] = (), shares: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Quantiles of stored sketches, put together by ``by`` or all in one.

    ``by, n_rows, n_missing, low, high, quantiles array<double>``. The quantile at a share
    is a value of the data, at most that share of which is lower; the sketch may be off by
    its error in rank. Null for a group without a number.
    """
    joined = sketches.groupBy(*by).agg(
        *(F.sum(c).alias(c) for c in ("n_rows", "n_missing")),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.kll_merge_agg_double("sketch").alias("__all"),
    )
    asked = F.array(*map(F.lit, map(float, shares)))
    found = F.when(F.col("n_rows") > F.col("n_missing"), F.kll_sketch_get_quantile_double("__all", asked))
    return joined.select(*by, "n_rows", "n_missing", "low", "high", found.alias("quantiles"))


def outliers(df: DataFrame, profile: DataFrame, column: str, by: Sequence[str] = ("round",), reach: float = 1.5) -> DataFrame:
    """Rows of ``df`` beyond ``reach`` times the distance of the quartiles from them.

    ``profile`` is ``value_profile`` of quarter and three quarters by the same ``by``, of
    this table or of an earlier publication. It is one row a group; Spark joins it.
    """
    first, last = F.element_at("quantiles", 1), F.element_at("quantiles", -1)
    bounds = profile.select(
        *(F.col(c).alias(f"__{c}") for c in by),
        (first - reach * (last - first)).alias("__least"),
        (last + reach * (last - first)).alias("__most"),
    )
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    value = F.col(column).cast("double")
    beyond = (value < F.col("__least")) | (value > F.col("__most"))
    joined = df.where(~F.isnan(value)).join(F.broadcast(bounds) if is_small(bounds) else bounds, same)
    return joined.where(beyond).select(*df.columns)
