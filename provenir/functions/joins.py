"""Joining a small fact onto every row of a table of any size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A lookup within both bounds is sent to every task.
SMALL_ROWS = 10_000
SMALL_BYTES = 8 * 1024 * 1024


def is_small(df: DataFrame) -> bool:
    """Whether ``df`` is within the bounds, found from the widths of its first rows.

    This fetches at most one number more than ``SMALL_ROWS``. It is needed where
    Spark cannot know the size of a table, such as one made from Python rows, and
    would shuffle the large side to be safe.
    """
    widths = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns]
    first = df.select(reduce(Column.__add__, widths).cast("bigint").alias("width")).take(SMALL_ROWS + 1)
    return len(first) <= SMALL_ROWS and sum(r.width for r in first) <= SMALL_BYTES


def join_lookup(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    small: bool = False,
    bucketed: bool = False,
) -> DataFrame:
    """Left join a lookup that was grouped by ``keys``; ``rows`` keeps every row.

    ``small`` is for a lookup the caller has checked with ``is_small``: it is
    broadcast. Otherwise Spark broadcasts when the size it knows is under
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles when it is not.

    For the shuffle, the condition also compares a hash of the keys. It changes no
    result, but the partitioning left by the lookup's own grouping then no longer
    serves the join, so both inputs get a shuffle of the join's own. That is the
    only shape in which adaptive execution splits a skewed partition, and the one
    thing that keeps a key holding a third of ``rows`` from landing in one task.
    The price is a second shuffle of the lookup: one narrow row per key.

    ``bucketed`` is for tables stored in buckets of ``keys``. The hash is left
    out, so the buckets are joined as they lie and nothing is shuffled; a hot key
    then stays in its bucket.
    """
    fact = lookup.select(
        *[F.col(k).alias(f"__{k}") for k in keys],
        *[c for c in lookup.columns if c not in keys],
    )
    same = reduce(Column.__and__, [F.col(k) == F.col(f"__{k}") for k in keys])
    if not (small or bucketed):
        # Equal keys of different types, such as int and bigint, hash differently.
        alike = [F.col(f"__{k}").try_cast(rows.schema[k].dataType) for k in keys]
        same &= F.xxhash64(*keys) == F.xxhash64(*alike)
    joined = rows.join(F.broadcast(fact) if small else fact, same, "left")
    return joined.drop(*[f"__{k}" for k in keys])
