"""Declared schemas and table shapes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Target:
    """A column of the declared schema and the input column it comes from."""

    name: str
    source: str
    dtype: T.DataType


def _bad_cast(value: Column, old: T.DataType, new: T.DataType) -> Column:
    """A value became null, or a number another number."""
    cast = value.try_cast(new)
    bad = value.isNotNull() & cast.isNull()
    if isinstance(old, T.NumericType) and isinstance(new, T.NumericType):
        bad |= cast.isNotNull() & ~cast.try_cast(old).eqNullSafe(value)
    return bad


def conform(df: DataFrame, targets: Sequence[Target]) -> DataFrame:
    """Select, rename and cast to the declared columns, and add ``bad_casts``.

    A value that cannot be cast becomes null and its column is named in
    ``bad_casts``; a value that was null to begin with is not. A number that does
    not survive the way back, such as 3.7 as an int, stays as it was cast and is
    named too: between numbers nothing may be lost, so a decimal with too many
    places is rounded and named.
    """
    castable = [t for t in targets if df.schema[t.source].dataType != t.dtype]
    cast = df.select(
        *[F.col(t.source).try_cast(t.dtype).alias(t.name) for t in targets],
        *[_bad_cast(F.col(t.source), df.schema[t.source].dataType, t.dtype).alias(f"__{t.name}") for t in castable],
    )
    failed = [F.when(F.col(f"__{t.name}"), F.lit(t.name)) for t in castable]
    bad_casts = F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")
    return cast.select(*[t.name for t in targets], bad_casts.alias("bad_casts"))


def long_fields(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row per record and field: keys, ``field``, ``value`` as text, nulls kept."""
    as_text = df.select(*keys, *[F.col(f).cast("string").alias(f) for f in fields])
    return as_text.unpivot(list(keys), list(fields), "field", "value")
