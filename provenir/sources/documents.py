"""The published documents as a table."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.functions.urls import url_host
from provenir.sources.schemas import PAGES, read_table


def _closed(content: Column) -> Column:
    # Nearly every page ends in one of two spellings, and looking for these is cheap.
    usual = F.contains(content, F.lit("</html>")) | F.contains(content, F.lit("</HTML>"))
    return usual | content.rlike(r"(?i)</html[\t\n\f\r />]")


def _facts(content: Column, url: Column) -> list[Column]:
    return [
        F.octet_length(content).cast("bigint").alias("n_bytes"),
        F.length(content).cast("bigint").alias("n_chars"),
        url_host(url).alias("host"),
        _closed(content).alias("closed"),
    ]


def scan_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents kept as Parquet: ``doc_id, url, html`` and facts about each.

    ``closed`` is false for a page cut off before its end. The facts are plain
    projections, so a caller that selects none of them, nor ``html``, does not
    read the page bodies.
    """
    pages = read_table(spark, path, PAGES)
    return pages.select(
        F.col("page_id").alias("doc_id"),
        "url",
        "html",
        *_facts(F.col("html"), F.col("url")),
    )


@contextmanager
def _listing(spark: SparkSession) -> Iterator[None]:
    """Folders are listed by some tasks for each core, where Spark would send 10,000, and what
    they find is held by the scan alone, not by the session too."""
    wanted = {
        "spark.sql.sources.parallelPartitionDiscovery.parallelism": str(4 * spark.sparkContext.defaultParallelism),
        "spark.sql.hive.filesourcePartitionFileCacheSize": "0",
    }
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def scan_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Documents kept one per file: ``url`` is the file path, plus the same facts.

    Where ``valid_utf8`` is false, bytes that are not UTF-8 became replacement
    characters in ``html``; ``content`` holds the bytes as they are. File contents
    are read only if these or a fact about them is selected; filters on
    ``modified`` and ``n_bytes`` skip files before they are opened.

    The driver holds an entry for each file, so many millions take a scan for each of
    several folders.
    """
    reader = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
    )
    with _listing(spark):
        files = reader.load(path)
    html = F.make_valid_utf8(F.col("content").cast("string"))
    return files.select(
        F.col("path").alias("url"),
        F.col("modificationTime").alias("modified"),
        F.col("length").alias("n_bytes"),
        "content",
        html.alias("html"),
        F.is_valid_utf8(F.col("content").cast("string")).alias("valid_utf8"),
        F.length(html).cast("bigint").alias("n_chars"),
        _closed(html).alias("closed"),
    )
