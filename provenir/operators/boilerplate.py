"""The site's own furniture on its pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.functions.joins import is_small, join_lookup
from provenir.functions.text import INLINE_TAG, SEAM, TAG, collapse_blanks, decode_references, drop_non_text
from provenir.functions.urls import url_host
from provenir.operators.provenance import _require_absent
from provenir.sinks.scratch import stored


def text_blocks(html: Column) -> Column:
    """The readable text of a page in blocks, in order: what stands between tags that part words."""
    joined = F.regexp_replace(drop_non_text(html), f"(?i)<(?:{INLINE_TAG})", SEAM)
    blocks = F.transform(F.split(joined, f"(?is)<{TAG}"), lambda b: collapse_blanks(decode_references(b)))
    return F.filter(blocks, lambda b: b != "")


def page_boilerplate(
    pages: DataFrame,
    url: str = "url",
    html: str = "html",
    share: float = 0.5,
    least: int = 3,
    name: str = "body_text",
) -> DataFrame:
    """``pages`` with ``name``, the text without the site's own furniture, and ``n_dropped`` blocks.

    A block is furniture where it stands on at least ``least`` pages of its host and on
    ``share`` of them, however often on each. The rest is put together in order, a space
    between blocks. Pages without a host keep all. A null page has a null text; a page
    of nothing but furniture an empty one. Repeated rows are pages of their own, and so
    count twice.

    Blocks are counted by the hash of their text, so texts don't cross the shuffle. What is
    furniture is found by one pass over the pages and written (``sinks/scratch.py``), and a
    second pass applies it: sent to every task where it is little, which leaves the pages
    in place, else by a join that brings pages to their host's list and splits a host that
    has very many. A list is no longer than the blocks of a page over ``share``.
    """
    for column in (name, "n_dropped"):
        _require_absent(pages, column)
    parted = pages.withColumns({"__host": url_host(F.col(url)), "__blocks": text_blocks(F.col(html))})
    own = parted.where("__host is not null and __blocks is not null")
    hashes = F.array_distinct(F.transform("__blocks", lambda b: F.unhex(F.md5(b))))
    seen = own.select("__host", F.explode(hashes).alias("__hash"))
    counted = seen.groupBy("__host", "__hash").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least)
    sizes = own.groupBy("__host").agg(F.count(F.lit(1)).alias("__pages"))
    furniture = join_lookup(counted, sizes, ["__host"]).where(F.col("__n") >= share * F.col("__pages"))
    furniture = stored(furniture.select("__host", "__hash"), "page_boilerplate")
    listed = furniture.groupBy("__host").agg(F.collect_set("__hash").alias("__furniture"))
    found = join_lookup(parted, listed, ["__host"], small=is_small(furniture))
    none = F.array().cast("array<binary>")
    drop = F.coalesce("__furniture", none)
    kept = F.filter("__blocks", lambda b: ~F.array_contains(drop, F.unhex(F.md5(b))))
    found = found.withColumn("__kept", kept)
    return found.withColumns(
        {name: F.array_join("__kept", " "), "n_dropped": (F.size("__blocks") - F.size("__kept")).cast("long")}
    ).select(*pages.columns, name, "n_dropped")
