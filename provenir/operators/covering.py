"""Which source, of those valid for a time, covers a record."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenir.functions.joins import join_lookup
from provenir.functions.ordered import have_all
from provenir.operators.provenance import _require_absent

# Widths of bins are powers of this.
STEP = 4


def _number(df: DataFrame, column: str) -> Column:
    """A time or whole number as a long; the time zone of the session plays no part."""
    dtype, value = df.schema[column].dataType, F.col(column)
    if isinstance(dtype, T.IntegralType):
        return value.cast("long")
    if not isinstance(dtype, T.TimestampType):
        value = F.concat(value.cast("timestamp_ntz").cast("string"), F.lit("Z")).cast("timestamp")
    return F.unix_micros(value)


def covering_source(
    records: DataFrame,
    sources: DataFrame,
    at: str = "at",
    start: str = "valid_from",
    end: str = "valid_to",
    source: str = "source_page",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Add ``source``: the one valid at the record's time, ``start <= at < end``.

    Times are of any type with an order, or whole numbers. Of several the one that starts latest, then the greatest. Null where none is valid,
    or the record lacks a key or time. A source without ``start`` or ``end`` or key, or
    that ends before it starts, covers nothing. No record is lost or repeated.

    An interval belongs to the bins of the least width, a power of four, that it fits
    into: two bins at most, of which it fills an eighth or more, however lengths differ. Records look
    into one bin of each width that the intervals have, 32 at most. Only the distinct
    keys and times of the records are looked up, so a time that very many share is one
    row; a key that is in a third of the rows is spread by its bins.
    """
    _require_absent(records, source)
    placed = sources.where(have_all([*keys, start, end]) & (F.col(start) < F.col(end)))
    low, high = _number(sources, start), _number(sources, end)
    sized = placed.select(*keys, low.alias("__low"), high.alias("__high"), F.col(start).alias("__start"), F.col(source).alias("__source"))
    width = F.ceil(F.log(float(STEP), (F.col("__high") - F.col("__low")).cast("double"))).cast("int")
    sized = sized.withColumn("__level", F.greatest(width, F.lit(0)))
    levels = sorted(r[0] for r in sized.select("__level").distinct().collect())
    times = records.where(have_all([*keys, at])).select(*keys, at).distinct()
    if not levels:
        return records.withColumn(source, F.lit(None).cast(sources.schema[source].dataType))

    def bin_of(time: Column) -> Column:
        return F.call_function("shiftright", time, 2 * F.col("__level"))  # rounds down, below zero too

    last = F.col("__high") - 1
    binned = sized.select("*", F.explode(F.sequence(bin_of(F.col("__low")), bin_of(last))).alias("__bin"))
    looked = times.withColumn("__time", _number(records, at))
    looked = looked.select("*", F.explode(F.array(*map(F.lit, levels))).alias("__level"))
    looked = looked.withColumn("__bin", bin_of(F.col("__time")))
    binned = binned.select(*(F.col(k).alias(f"__{k}") for k in keys), "__low", "__high", "__start", "__source", F.col("__level").alias("__l"), F.col("__bin").alias("__b"))
    same = reduce(Column.__and__, [F.col(k) == F.col(f"__{k}") for k in keys], (F.col("__level") == F.col("__l")) & (F.col("__bin") == F.col("__b")))
    inside = (F.col("__low") <= F.col("__time")) & (F.col("__time") < F.col("__high"))
    hits = looked.join(binned, same & inside)
    best = hits.groupBy(*keys, at).agg(F.max(F.struct("__start", "__source")).alias("__best"))
    found = join_lookup(records, best, [*keys, at])
    return found.withColumn(source, F.col("__best")["__source"]).drop("__best")
