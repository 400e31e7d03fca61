"""Values and text out of documents."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenir.functions.text import (
    collapse_blanks,
    part_text,
    plain_numeral,
    plain_text,
)


@dataclass(frozen=True)
class Field:
    """A value to pull out of ``source``.

    The first group of ``pattern`` is the value; with ``count`` it is the number
    of matches instead. Character references are decoded unless ``source`` is
    ``plain`` text, such as a URL.
    """

    name: str
    source: str
    pattern: str
    dtype: T.DataType = T.StringType()
    count: bool = False
    plain: bool = False


def _found(field: Field) -> Column:
    """The matched text, '' when the pattern finds nothing, or the count."""
    if field.count:
        return F.regexp_count(field.source, F.lit(field.pattern))
    return F.regexp_extract(field.source, field.pattern, 1)


def _read(field: Field) -> Column:
    found = F.col(f"__{field.name}")
    return found if field.count else collapse_blanks(found) if field.plain else plain_text(found)


def _typed(field: Field) -> Column:
    found = F.col(f"__{field.name}")
    if field.count:
        return found.cast(field.dtype)
    present = F.when(found != "", found)
    if isinstance(field.dtype, T.NumericType):
        return plain_numeral(present).try_cast(field.dtype)
    return present.try_cast(field.dtype)


def extract_values(docs: DataFrame, fields: Sequence[Field], keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns, one typed column per field, and ``malformed``.

    A value is null when it is absent and when it is malformed. ``malformed``
    names the fields of the second kind, so the two stay apart.

    Search, reading, cast and flag are projections on top of each other, so that each
    pattern runs once per document.
    """
    matched = docs.select(*keep, *[_found(f).alias(f"__{f.name}") for f in fields])
    found = matched.withColumns({f"__{f.name}": _read(f) for f in fields})
    typed = found.withColumns({f.name: _typed(f) for f in fields})
    castable = [f for f in fields if not f.count and not isinstance(f.dtype, T.StringType)]
    broken = [
        F.when((F.col(f"__{f.name}") != "") & F.col(f.name).isNull(), F.lit(f.name)) for f in castable
    ]
    malformed = F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")
    return typed.select(*keep, *[f.name for f in fields], malformed.alias("malformed"))


def extract_text(docs: DataFrame, html: str = "html", name: str = "body_text", clean: bool = False) -> DataFrame:
    """Add the readable text of ``html``; null stays null.

    ``clean`` says that scripts, styles and comments are gone already.
    """
    parted = docs.withColumn("__parted", part_text(F.col(html), clean))
    return parted.withColumn(name, plain_text(F.col("__parted"))).drop("__parted")
