"""Values out of columns that hold JSON."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class JsonField:
    """A value at ``path``, such as ``$.address.city`` or ``$.tags[0]``."""

    name: str
    path: str
    dtype: T.DataType = T.StringType()


def semi_structured_values(df: DataFrame, column: str, fields: Sequence[JsonField], keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns, one typed column per field, ``malformed`` and ``mistyped``.

    A text is parsed once. A value is null where the text is null or no JSON (then
    ``malformed``), where the path is absent or null, and where it holds another type:
    only the last names the field in ``mistyped``. Projections over the scan, no shuffle.
    """
    text = F.col(column)
    parsed = df.select(*keep, text.isNotNull().alias("__given"), F.try_parse_json(text).alias("__json"))
    found = parsed.select(
        *keep,
        (F.col("__given") & F.col("__json").isNull()).alias("malformed"),
        *(F.try_variant_get("__json", f.path, f.dtype.simpleString()).alias(f.name) for f in fields),
        *(F.try_variant_get("__json", f.path, "variant").alias(f"__{f.name}") for f in fields),
    )
    wrong = [
        F.when(F.col(f.name).isNull() & F.col(f"__{f.name}").isNotNull() & ~F.is_variant_null(f"__{f.name}"), F.lit(f.name))
        for f in fields
    ]
    mistyped = F.array_compact(F.array(*wrong)) if wrong else F.array().cast("array<string>")
    return found.select(*keep, *(f.name for f in fields), "malformed", mistyped.alias("mistyped"))


def json_schemas(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """``by, n_rows, n_malformed, json_schema``: the one schema that all texts of a group fit.

    A group whose schema differs from that of an earlier publication has drifted. A field
    that holds several types is a ``VARIANT`` in it; a group without JSON has ``VOID``.
    """
    parsed = df.select(*by, F.col(column).isNotNull().alias("__given"), F.try_parse_json(F.col(column)).alias("__json"))
    return parsed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("__given") & F.col("__json").isNull()).alias("n_malformed"),
        F.schema_of_variant_agg("__json").alias("json_schema"),
    )
