"""Names that are written in different ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.functions.joins import join_lookup

# Letters of a gram, and the mark that stands before and after a name.
GRAM = 2
EDGE = "\x01"


def _grams(name: Column) -> Column:
    """The grams of a name with marks at its ends, each with how often it occurred before."""
    padded = F.concat(F.lit(EDGE * (GRAM - 1)), name, F.lit(EDGE * (GRAM - 1)))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - GRAM + 1), lambda i: F.substring(padded, i, F.lit(GRAM)))
    number = lambda g, i: F.size(F.filter(F.slice(grams, F.lit(1), i), lambda x: x == g))
    return F.transform(grams, lambda g, i: F.concat(g, F.lit(EDGE), number(g, i).cast("string")))


def _shortened(name: Column, times: int) -> Column:
    """All that is left of a name when up to so many letters are left out."""
    kept = F.array(name)
    for _ in range(times):
        fewer = F.transform(
            kept,
            lambda s: F.when(
                F.length(s) > 0,
                F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s)))),
            ).otherwise(F.array(s)),
        )
        kept = F.array_distinct(F.concat(kept, F.flatten(fewer)))
    return kept


def match_names(
    official: DataFrame, extracted: DataFrame, name: str, max_distance: int = 2, other_name: str | None = None
) -> DataFrame:
    """Pairs of an official and an extracted name at most ``max_distance`` edits apart.

    ``official, extracted, distance, n_official, n_extracted``: the distinct names as they
    are written, the least number of letters put in, left out or changed, and how often
    each was given. Null names match nothing; empty ones are names. Names are compared
    letter by letter as they are: fold case or blanks before where they should not count.

    An edit touches at most ``GRAM`` grams, so names within the distance share one of the
    ``GRAM * max_distance + 1`` grams of each that are rarest over all names. Only pairs
    that do, and whose lengths can agree, are compared. Names too short for that rule are
    found by what is left when letters are left out of them. Names are distinct before
    anything is compared, so a name that a third of the rows bear is one row.
    """
    sides = ((official, name, "n_official"), (extracted, other_name or name, "n_extracted"))
    left, right = (
        df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("name")).agg(F.count(F.lit(1)).alias(n))
        for df, c, n in sides
    )
    names = left.select("name").unionByName(right.select("name"))
    counted = names.select(F.explode(_grams(F.col("name"))).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("__f"))

    # Shorter than this, a name and its match may share no gram.
    edits = GRAM * max_distance
    least = edits - GRAM + 2

    def keyed(df: DataFrame, number: str) -> DataFrame:
        own = df.select("name", number, F.length("name").alias("size"))
        each = own.select("*", F.explode(_grams(F.col("name"))).alias("g"))
        ranked = join_lookup(each, counted, ["g"]).groupBy("name", number, "size").agg(
            F.slice(F.sort_array(F.collect_list(F.struct("__f", "g"))), 1, edits + 1).alias("rarest")
        )
        rare = ranked.select("name", number, "size", F.explode("rarest.g").alias("g"))
        by_gram = rare.select("name", number, "size", F.concat(F.lit("g"), F.col("g")).alias("key"))
        short = own.where(F.col("size") < least + max_distance)
        by_rest = short.select("name", number, "size", F.explode(_shortened(F.col("name"), max_distance)).alias("rest"))
        return by_gram.unionByName(by_rest.select("name", number, "size", F.concat(F.lit("r"), F.col("rest")).alias("key")))

    a = keyed(left, "n_official").withColumnsRenamed({"name": "official", "size": "__size"})
    b = keyed(right, "n_extracted").withColumnsRenamed({"name": "extracted", "key": "__key"})
    near = F.abs(F.col("size") - F.col("__size")) <= max_distance
    met = a.join(b, (F.col("key") == F.col("__key")) & near)
    pairs = met.select("official", "extracted", "n_official", "n_extracted").distinct()
    distance = F.levenshtein("official", "extracted", max_distance)
    found = pairs.withColumn("distance", distance).where(F.col("distance") >= 0)
    return found.select("official", "extracted", "distance", "n_official", "n_extracted")
