"""Links on the official pages that list the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.functions.text import INSIDE, decode_references, drop_non_text, tag_attribute
from provenir.functions.urls import with_absolute

LINK_TAG = rf"(?i)<(?:a|area)[\t\n\f\r /]{INSIDE}"
BASE_TAG = rf"(?i)<base[\t\n\f\r /]{INSIDE}"


def _written_url(value: Column) -> Column:
    """A URL as browsers read it: no quotes, no blanks around, no line ends or tabs inside."""
    unquoted = F.regexp_replace(value, r"""^["']|["']$""", "")
    return F.regexp_replace(decode_references(unquoted), r"^[\t\n\f\r ]+|[\t\n\f\r ]+\z|[\t\n\r]", "")


def listing_links(
    pages: DataFrame, key: str = "doc_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """One row per link: ``key``, its position on the page from 0, absolute ``link``.

    Links are the ``href`` of ``a`` and ``area``, against the page's first ``base`` if
    it has one. Those inside scripts, styles and comments are no links. A page
    without links gives no row.
    """
    markup = pages.select(key, F.col(url).alias("__page"), drop_non_text(F.col(html)).alias("__markup"))
    hrefs = F.transform(F.regexp_extract_all("__markup", F.lit(LINK_TAG), 0), lambda t: tag_attribute(t, "href"))
    bases = F.transform(F.regexp_extract_all("__markup", F.lit(BASE_TAG), 0), lambda t: tag_attribute(t, "href"))
    parts = markup.select(
        key,
        "__page",
        F.coalesce(_written_url(F.get(F.filter(bases, lambda b: b.isNotNull()), F.lit(0))), F.lit("")).alias("__base"),
        F.filter(hrefs, lambda h: h.isNotNull()).alias("__hrefs"),
    )
    based = with_absolute(parts, "__page", "__base")
    found = based.select(key, "__base", F.posexplode("__hrefs").alias("pos", "link"))
    links = found.withColumn("link", _written_url(F.col("link")))
    return with_absolute(links, "__base", "link").drop("__base")
