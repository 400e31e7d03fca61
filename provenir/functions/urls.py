"""Hosts of URLs, and links made absolute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEME = r"[A-Za-z][A-Za-z0-9+.-]*"


def url_host(url: Column) -> Column:
    """Host and port of an absolute URL, null when there is none."""
    return F.nullif(F.regexp_extract(url, rf"^{SCHEME}://([^/?#]*)", 1), F.lit(""))


def _without_dot_segments(path: Column) -> Column:
    """Resolve ``.`` and ``..`` in a path that starts with a slash."""

    def step(kept: Column, segment: Column) -> Column:
        return (
            F.when(segment == ".", kept)
            .when(segment == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1))))
            .otherwise(F.concat(kept, F.array(segment)))
        )

    none = F.array().cast("array<string>")
    resolved = F.array_join(F.aggregate(F.split(path, "/"), none, step), "/")
    ends_in_dots = path.rlike(r"/\.{1,2}$")
    return (
        F.when(~path.rlike(r"/\.{1,2}(/|$)"), path)
        .when(ends_in_dots, F.concat(resolved, F.lit("/")))
        .otherwise(resolved)
    )


def with_absolute(links: DataFrame, base: str, link: str) -> DataFrame:
    """Replace ``link``, as found on the page at ``base``, by the absolute URL.

    The parts are columns of their own, so that each is worked out once per link.
    """
    at, to = F.col(base), F.col(link)
    parts = links.withColumns(
        {
            "__origin": F.regexp_extract(at, rf"^({SCHEME}://[^/?#]*)", 1),
            "__base_path": F.regexp_extract(at, rf"^{SCHEME}://[^/?#]*([^?#]*)", 1),
            "__path": F.regexp_extract(to, r"^([^?#]*)", 1),
            "__tail": F.regexp_extract(to, r"(?s)^[^?#]*(.*)$", 1),
        }
    )
    folder = F.regexp_replace("__base_path", r"[^/]*$", "")
    from_folder = F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), F.col("__path"))
    parts = parts.withColumn("__path", F.when(to.startswith("/"), F.col("__path")).otherwise(from_folder))
    absolute = (
        F.when(to.rlike(rf"^{SCHEME}:"), to)
        .when(to.startswith("//"), F.concat(F.regexp_extract(at, rf"^({SCHEME}:)", 1), to))
        .when((to == "") | to.startswith("#"), F.concat(F.regexp_extract(at, r"^([^#]*)", 1), to))
        .when(to.startswith("?"), F.concat("__origin", "__base_path", to))
        .otherwise(F.concat(F.col("__origin"), _without_dot_segments(F.col("__path")), F.col("__tail")))
    )
    return parts.withColumn(link, absolute).drop("__origin", "__base_path", "__path", "__tail")
