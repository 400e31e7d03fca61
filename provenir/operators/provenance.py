"""Where a record comes from and whether anybody checked it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.functions.joins import is_small, join_lookup
from provenir.sinks.scratch import stored

VERIFIED = "verified"
REJECTED = "rejected"
UNVERIFIED = "unverified"


def _require_absent(records: DataFrame, column: str) -> None:
    if column in records.columns:
        raise ValueError(f"the records have a column {column} already")


def verification_status(
    records: DataFrame,
    checks: DataFrame,
    keys: Sequence[str] = ("doc_id",),
    passed: str = "passed",
    bucketed: bool = False,
) -> DataFrame:
    """Add ``status`` to every record; records are neither lost nor repeated.

    ``verified`` when every check of the key passed, ``rejected`` when one
    failed, ``unverified`` when nobody looked or no check came to a result.
    Checks are reduced to one row per key first, so several checks of one record
    do not multiply it.
    """
    _require_absent(records, "status")
    verdicts = checks.groupBy(*keys).agg(F.bool_and(passed).alias("__passed"))
    status = (
        F.when(F.col("__passed"), F.lit(VERIFIED))
        .when(~F.col("__passed"), F.lit(REJECTED))
        .otherwise(F.lit(UNVERIFIED))
    )
    joined = join_lookup(records, verdicts, keys, bucketed=bucketed)
    return joined.withColumn("status", status).drop("__passed")


def attach_provenance(records: DataFrame, sources: DataFrame, by: str = "round") -> DataFrame:
    """Add ``source_page`` to every record; null where no page covers its round.

    ``sources`` holds ``source_page`` and the array ``rounds``. Two pages that
    claim one round would leave its records without a definite source, so that
    stops the query with an error.

    The sources are counted first, by a Spark job of its own that reads at most
    10,001 of their rows. As long as they are few, records are not
    shuffled; there are only a handful of rounds to shuffle them by.
    """
    _require_absent(records, "source_page")
    covered = sources.select(F.explode("rounds").alias(by), "source_page")
    distinct = F.min("source_page").eqNullSafe(F.max("source_page"))
    conflict = F.concat(F.lit(f"several source pages for {by} "), F.col(by).cast("string"))
    page = F.when(distinct, F.min("source_page")).otherwise(F.raise_error(conflict))
    lookup = covered.groupBy(by).agg(page.alias("source_page"))
    return join_lookup(records, lookup, [by], small=is_small(covered))


def missing_documents(listed: DataFrame, records: DataFrame, keys: Sequence[str] = ("url",)) -> DataFrame:
    """Listed documents without a record, once each, with ``n_listed`` times listed.

    The listing is reduced to its distinct keys and written once (``sinks/scratch.py``),
    since finding links is most of the work and three steps need them. Records are only
    asked which of these they hold: a semi join that broadcasts a small listing, so that no
    record moves, and that adaptive execution can split where the listing is large and one
    key has very many records. A listed key that is null matches no record.
    """
    counted = stored(listed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_listed")), "missing_documents")
    named = counted.select(*(F.col(k).alias(f"__{k}") for k in keys))
    own = records.select(*keys)
    same = reduce(Column.__and__, [F.col(k) == F.col(f"__{k}") for k in keys])
    small = is_small(named)
    if small:
        found = own.join(F.broadcast(named), same, "left_semi")
    else:
        # As in join_lookup: the hash gives the join shuffles of its own, which can be split.
        alike = [F.col(f"__{k}").try_cast(own.schema[k].dataType) for k in keys]
        found = own.join(named, same & (F.xxhash64(*keys) == F.xxhash64(*alike)), "left_semi")
    held = found.distinct().select(*(F.col(k).alias(f"__{k}") for k in keys))
    # No more rows are held than listed, so what was small is small.
    return counted.join(F.broadcast(held) if small else held, same, "left_anti")


def status_by_round(df: DataFrame, by: str = "round") -> DataFrame:
    """Records per round and how many of them are in each state."""
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_records"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in (VERIFIED, REJECTED, UNVERIFIED)],
    )
