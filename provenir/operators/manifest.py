"""A manifest by which a record can be shown to be part of a publication."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenir.functions.ordered import with_positions
from provenir.operators.changes import content_text
from provenir.sinks.scratch import stored

FANOUT = 16


@dataclass(frozen=True)
class Manifest:
    """``leaves``: keys, ``position`` and ``hash`` of each record. ``groups``: of each level
    from the leaves up a table ``position, hash, parts``, the parts being the hashes that
    ``hash`` is of. ``root`` stands for the whole table, null for an empty one."""

    leaves: DataFrame
    groups: list[DataFrame]
    root: str | None
    fanout: int


def publication_manifest(records: DataFrame, keys: Sequence[str] = ("doc_id",), fanout: int = FANOUT) -> Manifest:
    """A tree of hashes over all records in the order of their keys.

    A record's hash is the SHA-256 of its columns' texts (``changes.content_text``). A group
    of ``fanout`` neighbours has the hash of their hashes, one after the other, and so
    on until one is left. Rows of equal keys stand in the order of their hashes, so the
    root depends on nothing but the rows; repeated ones are leaves of their own.

    Records are reduced to keys and a hash before anything moves. Positions come from
    ranges of the keys that are numbered side by side, so no task sorts the whole table.
    Each level is one grouping of at most ``fanout`` rows a group, written and read back;
    a table of 10**12 records has ten.
    """
    hashed = records.select(*keys, F.sha2(content_text(*records.columns), 256).alias("hash"))
    leaves = stored(with_positions(hashed, [*keys, "hash"]), "manifest_leaves")
    left, level, groups = leaves.count(), leaves.select("position", "hash"), []
    while left > 1 or (left == 1 and not groups):
        member = F.struct("position", "hash")
        grouped = level.groupBy(F.floor(F.col("position") / fanout).cast("long").alias("__group")).agg(
            F.transform(F.sort_array(F.collect_list(member)), lambda m: m["hash"]).alias("parts")
        )
        table = grouped.select(F.col("__group").alias("position"), F.sha2(F.array_join("parts", ""), 256).alias("hash"), "parts")
        groups.append(stored(table, "manifest_level"))
        level, left = groups[-1].select("position", "hash"), -(-left // fanout)
    root = groups[-1].first()["hash"] if groups else None
    return Manifest(leaves, groups, root, fanout)


def proofs(manifest: Manifest, wanted: DataFrame | None = None, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keys, position, hash, proof``: for each record, or each ``wanted`` one, what proves it.

    ``proof`` is an array of arrays, from the record up: the hashes of its group, then
    those of the group's group. Each joined and hashed is an element of the next one; the
    last gives the root. Proofs are put together from the root down, where there are few
    groups, and joined to the leaves once.
    """
    own = manifest.leaves if wanted is None else manifest.leaves.join(wanted.select(*keys).distinct(), list(keys), "left_semi")
    if not manifest.groups:
        return own.withColumn("proof", F.array().cast("array<array<string>>"))
    *lower, top = manifest.groups
    above = top.select(F.col("position").alias("__group"), F.array("parts").alias("__proof"))
    for groups in reversed(lower):
        parent = F.floor(F.col("position") / manifest.fanout).cast("long")
        joined = groups.withColumn("__group", parent).join(above, "__group")
        above = joined.select(F.col("position").alias("__group"), F.concat(F.array("parts"), "__proof").alias("__proof"))
    found = own.withColumn("__group", F.floor(F.col("position") / manifest.fanout).cast("long")).join(above, "__group")
    return found.select(*own.columns, F.col("__proof").alias("proof"))
