"""Finished tables in the formats they are published in.

Writers add no shuffle: every task writes the rows it holds. Paths must not exist
yet unless ``mode`` says otherwise, and each writer returns the table as read
back under the schema it was written with.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenir.functions.joins import is_small
from provenir.functions.text import escape_markup
from provenir.operators.changes import touched_groups
from provenir.sinks.scratch import drop_folder, stored

NULL_MARK = r"\N"

# To the microsecond; the default formats stop at milliseconds.
TIME_FORMATS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}

# The narrow set that keeps null, '' and blanks apart and survives line ends
# inside a field. `emptyValue` must stay unset, or '' is lost.
CSV_FORMAT = {
    **TIME_FORMATS,
    "header": "true",
    "escape": '"',
    # Unset, this is NUL, and a quote before a NUL is lost.
    "charToEscapeQuoteEscaping": '"',
    "lineSep": "\n",
    "nullValue": NULL_MARK,
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}
# A CSV file is read by one task, so it gets no more records than this by default.
CSV_RECORDS_PER_FILE = 250_000


def organise_by_round(
    df: DataFrame, path: str, by: str = "round", mode: str = "error", even_files: bool = False
) -> DataFrame:
    """Write one folder per round; reading a round opens its folder only.

    A null round has a folder of its own. Rounds are numbers: Spark reads the
    folder of an empty text back as null, so a text as ``by`` raises.

    By default each task writes its own rows and nothing is shuffled. With
    ``even_files`` rows are first brought together by round, which costs a
    shuffle and gives fewer files; a large round is then split over many tasks
    by size, so it never becomes the work of one.
    """
    if isinstance(df.schema[by].dataType, T.StringType):
        raise ValueError(f"{by} is a text, of which '' would be read back as null")
    rows = df.hint("rebalance", by) if even_files else df
    # Overwriting means the whole table, whatever the session says.
    rows.write.mode(mode).option("partitionOverwriteMode", "static").partitionBy(by).parquet(path)
    fields = [f for f in df.schema.fields if f.name != by]
    stored = T.StructType([*fields, df.schema[by]])
    return df.sparkSession.read.schema(stored).parquet(path).select(*df.columns)


def publish_changes(
    records: DataFrame, path: str, keys: Sequence[str] = ("doc_id",), by: str = "round", even_files: bool = False
) -> DataFrame:
    """Bring what ``organise_by_round`` wrote to ``path`` up to ``records``.

    Only rounds of which a row differs are written; the files of all others stay as they
    are. A round that has no record any more goes. Returns the table as it then stands.
    ``records`` must not be read from ``path``. Whoever reads a round while it is written
    may find the old rows, the new ones or none.
    """
    spark = records.sparkSession
    fields = [f for f in records.schema.fields if f.name != by]
    published = spark.read.schema(T.StructType([*fields, records.schema[by]])).parquet(path)
    touched = stored(touched_groups(published, records, keys, by), "touched")  # a row for each round
    same = F.col(by).eqNullSafe(F.col("__by"))
    written = touched.where("left").select(F.col(by).alias("__by"))
    rows = records.join(F.broadcast(written) if is_small(written) else written, same, "left_semi")
    rows = rows.hint("rebalance", by) if even_files else rows
    gone = [r[0] for r in touched.where("not left").select(by).collect()]
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    for value in gone:
        drop_folder(spark, f"{path}/{by}={'__HIVE_DEFAULT_PARTITION__' if value is None else value}")
    return spark.read.schema(published.schema).parquet(path).select(*records.columns)


def _per_string(df: DataFrame, change) -> DataFrame:
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({name: change(F.col(name)) for name in strings})


def _guard_null_mark(text: Column) -> Column:
    """A text that reads like the mark for null gets one more backslash."""
    return F.when(text.rlike(r"^\\+N\z"), F.concat(F.lit("\\"), text)).otherwise(text)


def _unguard_null_mark(text: Column) -> Column:
    return F.when(text.rlike(r"^\\\\+N\z"), F.substr(text, F.lit(2))).otherwise(text)


def write_csv(
    df: DataFrame, path: str, mode: str = "error", max_records_per_file: int = CSV_RECORDS_PER_FILE
) -> DataFrame:
    """Write CSV with a header; null is ``\\N``, '' is ``""``.

    Fields may hold line ends, so a file is read by one task. A task that writes more
    than ``max_records_per_file`` records starts another file; 0 is no bound.
    """
    layout = {**CSV_FORMAT, "maxColumns": str(len(df.columns) + 1)}
    guarded = _per_string(df, _guard_null_mark)
    guarded.write.mode(mode).options(**layout, maxRecordsPerFile=max_records_per_file).csv(path)
    stored = (
        df.sparkSession.read.schema(df.schema)
        .options(**layout, multiLine="true", mode="FAILFAST", maxCharsPerColumn="-1")
        .csv(path)
    )
    return _per_string(stored, _unguard_null_mark)


def write_jsonl(df: DataFrame, path: str, mode: str = "error", max_records_per_file: int = 0) -> DataFrame:
    """Write one JSON object per line; null fields are left out."""
    layout = {**TIME_FORMATS, "lineSep": "\n"}
    df.write.mode(mode).options(**layout, maxRecordsPerFile=max_records_per_file).json(path)
    return df.sparkSession.read.schema(df.schema).options(**layout, mode="FAILFAST").json(path)


def html_row(*columns: str) -> Column:
    """A table row; a null gives a cell of class ``missing``, '' an empty cell."""

    def cell(name: str) -> Column:
        filled = F.concat(F.lit("<td>"), escape_markup(F.col(name).cast("string")), F.lit("</td>"))
        return F.coalesce(filled, F.lit('<td class="missing"></td>'))

    return F.concat(F.lit("<tr>"), *[cell(c) for c in columns], F.lit("</tr>"))


def html_rows(df: DataFrame) -> DataFrame:
    """One column ``row``: every record as an HTML table row on a line of its own."""
    return df.select(html_row(*df.columns).alias("row"))


def write_html(df: DataFrame, path: str, mode: str = "error", max_records_per_file: int = 0) -> DataFrame:
    """Write the rows as text, to be placed inside a ``<table>``; returns the rows."""
    html_rows(df).write.mode(mode).options(lineSep="\n", maxRecordsPerFile=max_records_per_file).text(path)
    return df.sparkSession.read.options(lineSep="\n").text(path).withColumnRenamed("value", "row")
