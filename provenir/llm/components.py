"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenir.llm.common import settle


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every end of ``links (a, b)``: the smallest node reachable.

    Each round takes the smallest label among the neighbours, then the label of that
    label, so the number of rounds follows the logarithm of the longest path for most
    graphs. Groupings pre-aggregate and every join reads written tables, which
    adaptive execution can split, so a node with very many links is no single task.
    Nulls link nothing; a link to oneself adds a node alone; no links, no rows.
    """
    ends = links.where("a is not null and b is not null").select(F.col("a").cast("long"), F.col("b").cast("long"))
    both = settle(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = settle(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("n")).select("node", F.least("node", "n").alias("component")),
        "labels",
    )
    total = _total(labels)
    while True:
        heard = both.join(labels, both["b"] == labels["node"]).select(both["a"].alias("node"), "component")
        heard = heard.unionByName(labels).groupBy("node").agg(F.min("component").alias("component"))
        heard = settle(heard, "labels")
        root = heard.select(F.col("node").alias("label"), F.col("component").alias("root"))
        jumped = heard.join(root, heard["component"] == root["label"]).select("node", F.col("root").alias("component"))
        labels = settle(jumped, "labels")
        before, total = total, _total(labels)
        if total == before:  # labels only ever fall
            return labels


def _total(labels: DataFrame):
    return labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
