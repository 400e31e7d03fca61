"""What changed since the last publication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_text(*columns: str) -> Column:
    """One text for the values of the columns that no other values have.

    Each value as text after its length and a colon, ``-`` for a null; so neither nulls
    and empty texts nor neighbouring values run together.
    """
    values = [F.col(c).cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values])


def _counted(published: DataFrame, records: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """How often each key, group and content stands on either side, contents as hashes."""
    others = [c for c in records.columns if c not in (*keys, by)]
    content = F.unhex(F.sha2(content_text(*others) if others else F.lit(""), 256)).alias("__content")
    sides = [
        df.select(*keys, by, content, F.lit(old).alias("__old"), F.lit(1 - old).alias("__new"))
        for df, old in ((published, 1), (records, 0))
    ]
    return sides[0].unionByName(sides[1]).groupBy(*keys, by, "__content").agg(F.sum("__old").alias("__old"), F.sum("__new").alias("__new"))


def publication_diff(published: DataFrame, records: DataFrame, keys: Sequence[str] = ("doc_id",), by: str = "round") -> DataFrame:
    """One row for every key of either table: ``keys, n_published, n_records, change``.

    ``added`` and ``removed`` keys stand on one side only; ``unchanged`` ones have the same
    rows on both, each as often; ``moved`` ones the same but for ``by``; all others are
    ``changed``. Both tables need the columns of ``records``; others of ``published`` don't
    count. Values compare as their text, null apart. Rows with a null key are one key.

    Rows are reduced to a hash of their content before the shuffle and counted, so a key
    with very many equal rows is one row for each task, and no text moves.
    """
    rows = _counted(published, records, keys, by)
    # What a group has on one side and not the other; in all groups together for a move.
    by_content = rows.groupBy(*keys, "__content").agg(
        F.sum("__old").alias("__old"), F.sum("__new").alias("__new"), F.bool_or(F.col("__old") != F.col("__new")).alias("__differs")
    )
    by_key = by_content.groupBy(*keys).agg(
        F.sum("__old").alias("n_published"),
        F.sum("__new").alias("n_records"),
        F.bool_or("__differs").alias("__differs"),
        F.bool_or(F.col("__old") != F.col("__new")).alias("__content_differs"),
    )
    change = (
        F.when(F.col("n_published") == 0, F.lit("added"))
        .when(F.col("n_records") == 0, F.lit("removed"))
        .when(~F.col("__differs"), F.lit("unchanged"))
        .when(~F.col("__content_differs"), F.lit("moved"))
        .otherwise(F.lit("changed"))
    )
    return by_key.select(*keys, "n_published", "n_records", change.alias("change"))


def touched_groups(published: DataFrame, records: DataFrame, keys: Sequence[str] = ("doc_id",), by: str = "round") -> DataFrame:
    """The values of ``by`` whose rows differ between the two tables, and if any are left: ``by, left``."""
    rows = _counted(published, records, keys, by)
    groups = rows.groupBy(by).agg(F.bool_or(F.col("__old") != F.col("__new")).alias("__differs"), F.max("__new").alias("__new"))
    return groups.where("__differs").select(by, (F.col("__new") > 0).alias("left"))
