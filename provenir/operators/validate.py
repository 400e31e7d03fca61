"""Rules, counts and comparisons over whole tables.

Each report is one grouping whose partial results are built before the shuffle,
so a key that holds a large share of the rows costs one row per input partition.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A condition a record must meet.

    As with a SQL CHECK, a condition that is null is not violated; state a
    separate rule such as ``col.isNotNull()`` where presence is required.
    """

    id: str
    holds: Column


def validate(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add ``violations``: the ids of the violated rules, in rule order."""
    ids = [r.id for r in rules]
    if len(set(ids)) != len(ids):
        raise ValueError(f"rule ids repeat: {ids}")
    violated = [F.when(~r.holds, F.lit(r.id)) for r in rules]
    return df.withColumn("violations", F.array_compact(F.array(*violated)))


def violation_counts(validated: DataFrame) -> DataFrame:
    """Records per violated rule."""
    return (
        validated.select(F.explode("violations").alias("rule"))
        .groupBy("rule")
        .agg(F.count(F.lit(1)).alias("n_records"))
    )


def completeness(expected: DataFrame, records: DataFrame, by: str = "round") -> DataFrame:
    """Expected against found count per ``by``; ``expected`` holds ``by, expected``.

    A group with no record has ``found`` 0. A group nobody expected is kept, with
    ``expected`` null.
    """
    found = records.groupBy(by).agg(F.count(F.lit(1)).alias("found"))
    stated = expected.select(by, F.col("expected").cast("bigint").alias("expected"), F.lit(0).alias("found"))
    counted = found.select(by, F.lit(None).cast("bigint").alias("expected"), "found")
    both = stated.unionByName(counted).groupBy(by).agg(
        F.sum("expected").alias("expected"), F.sum("found").alias("found")
    )
    state = (
        F.when(F.col("expected").isNull(), F.lit("unexpected"))
        .when(F.col("found") == F.col("expected"), F.lit("complete"))
        .when(F.col("found") < F.col("expected"), F.lit("short"))
        .otherwise(F.lit("over"))
    )
    return both.select(by, "expected", "found", state.alias("state"))


def reconcile(official: DataFrame, extracted: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Compare ``value`` per key: match, mismatch, not_extracted or not_in_official.

    Two nulls match. One row per key, also where a side repeats it; repeated
    values match only if all of them, on both sides, are the same. Of each side
    stand the smallest value, the largest where it differs (``..._other``), and how
    often the key was given (``n_...``).

    Both sides are stacked and grouped once. A full outer join gives the same
    states, but adaptive execution cannot split its skewed partitions and it
    would emit every pair of a repeated key.
    """
    return _reconciled(official, extracted, keys, {value: value}).select(
        *keys,
        F.col(f"__{value}")["official"].alias("official"),
        F.col(f"__{value}")["extracted"].alias("extracted"),
        F.col(f"__{value}")["official_other"].alias("official_other"),
        F.col(f"__{value}")["extracted_other"].alias("extracted_other"),
        "n_official",
        "n_extracted",
        F.col(f"__{value}")["state"].alias("state"),
    )


def reconcile_fields(
    official: DataFrame, extracted: DataFrame, keys: Sequence[str], fields: Sequence[str]
) -> DataFrame:
    """The same for several fields at once: a row per key and field, values as text.

    The wide rows are grouped once by key, and only the one result row per key is
    taken apart by field afterwards.
    """
    as_text = {f: f for f in fields}
    sides = [t.select(*keys, *(F.col(f).cast("string").alias(f) for f in fields)) for t in (official, extracted)]
    wide = _reconciled(*sides, keys, as_text)
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"__{f}").alias("found")) for f in fields)))
    long = wide.select(*keys, "n_official", "n_extracted", each.alias("__each"))
    found = F.col("__each.found")
    return long.select(
        *keys,
        F.col("__each.field").alias("field"),
        *(found[c].alias(c) for c in ("official", "extracted", "official_other", "extracted_other")),
        "n_official",
        "n_extracted",
        found["state"].alias("state"),
    )


def _reconciled(official: DataFrame, extracted: DataFrame, keys: Sequence[str], values: dict[str, str]) -> DataFrame:
    """One row per key: counts, and a struct ``__name`` of values and state for each value."""
    is_official = F.col("__official")
    picked = [F.col(v).alias(f"__value_{n}") for n, v in values.items()]
    stacked = official.select(*keys, *picked, F.lit(True).alias("__official")).unionByName(
        extracted.select(*keys, *picked, F.lit(False).alias("__official"))
    )
    # Records without a full key belong together on neither side.
    no_key = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    stacked = stacked.withColumn("__unkeyed", F.when(no_key, is_official))

    def side(value: str, name: str, mine: Column) -> list[Column]:
        own = F.when(mine, F.col(f"__value_{value}"))
        return [
            F.count(own).alias(f"__{value}_{name}_filled"),
            F.min(own).alias(f"__{value}_{name}"),
            F.max(own).alias(f"__{value}_{name}_max"),
        ]

    grouped = stacked.groupBy(*keys, "__unkeyed").agg(
        F.count_if(is_official).alias("n_official"),
        F.count_if(~is_official).alias("n_extracted"),
        *(c for v in values for c in side(v, "official", is_official) + side(v, "extracted", ~is_official)),
    )

    def least(value: str, name: str) -> Column:
        return F.col(f"__{value}_{name}")

    def uniform(value: str, name: str) -> Column:
        filled = F.col(f"__{value}_{name}_filled")
        one_value = (filled == F.col(f"n_{name}")) & (least(value, name) == F.col(f"__{value}_{name}_max"))
        return (filled == 0) | one_value

    def other(value: str, name: str) -> Column:
        most = F.col(f"__{value}_{name}_max")
        return F.when(most != least(value, name), most).alias(f"{name}_other")

    def state(value: str) -> Column:
        same = uniform(value, "official") & uniform(value, "extracted")
        same &= least(value, "official").eqNullSafe(least(value, "extracted"))
        return (
            F.when(F.col("n_extracted") == 0, F.lit("not_extracted"))
            .when(F.col("n_official") == 0, F.lit("not_in_official"))
            .when(same, F.lit("match"))
            .otherwise(F.lit("mismatch"))
        )

    compared = [
        F.struct(
            least(v, "official").alias("official"),
            least(v, "extracted").alias("extracted"),
            other(v, "official"),
            other(v, "extracted"),
            state(v).alias("state"),
        ).alias(f"__{v}")
        for v in values
    ]
    return grouped.select(*keys, "n_official", "n_extracted", *compared)


def field_coverage(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Per field: ``n_rows`` and ``n_missing``, from one pass over the table."""
    missing = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(f).isNull()).alias(f) for f in fields],
    )
    return missing.unpivot(["n_rows"], list(fields), "field", "n_missing").select("field", "n_rows", "n_missing")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their number."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.where(F.col("n_rows") > 1)


def duplicate_content(df: DataFrame, content: str, key: str) -> DataFrame:
    """Contents held under several keys: hash, number, and the smallest key to keep.

    Contents are hashed before the shuffle: 16 bytes move for each, not the text.
    Missing contents are not copies of each other.
    """
    hashed = df.where(F.col(content).isNotNull()).select(F.unhex(F.md5(content)).alias("__md5"), key)
    counted = hashed.groupBy("__md5").agg(F.count(F.lit(1)).alias("n_copies"), F.min(key).alias("keep_id"))
    copies = counted.where(F.col("n_copies") > 1)
    return copies.select(F.lower(F.hex("__md5")).alias("content_md5"), "n_copies", "keep_id")
