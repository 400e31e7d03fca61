"""Taking in what has arrived since the last time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def intake_stream(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    path: str,
    checkpoint: str,
    keys: Sequence[str] = ("doc_id",),
    at: str | None = None,
    delay: str = "7 days",
    files_per_run: int | None = None,
) -> DataFrame:
    """Append the files that are new in ``source`` to ``path``; the table as it then stands.

    Each call takes in what has arrived and ends. What was read is kept in ``checkpoint``, so
    a call that failed or was killed goes on where it stopped, and no file is read twice.
    Of rows with the same keys the first one seen counts. With ``at``, an event time, a
    key is remembered until ``delay`` after it, and a row whose time lies more than
    ``delay`` before the latest of earlier runs or batches is late and left out: its key
    can't be told from one that was forgotten. Without ``at`` every key is remembered and
    nothing is late. Null keys equal each other.

    State is kept by key, on as many partitions as ``spark.sql.shuffle.partitions`` said on
    the first run. A key that very many rows share is one row of state.
    """
    reader = spark.readStream.schema(schema)
    if files_per_run:
        reader = reader.option("maxFilesPerTrigger", files_per_run)
    rows = reader.parquet(source)
    if at is None:
        once = rows.dropDuplicates(list(keys))
    else:
        timed = rows.withColumn("__at", F.col(at).cast("timestamp"))
        once = timed.withWatermark("__at", delay).dropDuplicatesWithinWatermark(list(keys)).drop("__at")
    query = (
        once.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return spark.read.schema(schema).parquet(path)
