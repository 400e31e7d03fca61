"""The state of records at a date, and how it came about."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenir.functions.joins import join_lookup
from provenir.functions.ordered import have_all, hot_spans, in_spans
from provenir.operators.provenance import REJECTED, UNVERIFIED, VERIFIED, _require_absent


def join_as_of(
    rows: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    at: str,
    since: str,
    values: Sequence[str],
    hot_rows: int | None = None,
) -> DataFrame:
    """``rows`` with the ``since`` and ``values`` of the last fact known at the time ``at``.

    That is the fact of the same keys with the latest ``since`` not after ``at``; of
    several at one time, the one with the greatest values. Rows before the first fact get
    nulls, and so do rows without a key or time, which are not shuffled. Facts without
    them are left out. No row is lost or repeated.

    Both sides are stacked and sorted once within each key, and the last fact is carried
    along, where a join would pair every row with every earlier fact. A key with more
    than ``hot_rows`` rows is cut into spans of time (``functions/ordered.py``); each
    span then takes over the last fact of those before it.
    """
    for column in (since, *values):
        _require_absent(rows, column)
    placed = have_all([*keys, at])
    fact = F.struct(since, *values)
    known = facts.where(have_all([*keys, since])).select(*keys, F.col(since).alias("__at"), fact.alias("__fact"))
    own = rows.where(placed).select(*keys, F.col(at).alias("__at"), F.struct(*rows.columns).alias("__row"))
    stacked = own.unionByName(known, allowMissingColumns=True)
    spans = hot_spans(stacked, keys, "__at", hot_rows)
    order = Window.partitionBy(*keys, "__span").orderBy("__at", F.col("__row").isNotNull(), "__fact")
    carried = F.last("__fact", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = in_spans(stacked, spans, keys, "__at").withColumn("__fact", carried).where("__row is not null")
    if spans is not None:
        carry = _carried_over(in_spans(known, spans, keys, "__at"), spans, keys)
        found = join_lookup(found, carry, [*keys, "__span"], small=True)
        found = found.withColumn("__fact", F.coalesce("__fact", "__before"))
    added = [F.col("__fact")[c].alias(c) for c in (since, *values)]
    loose = rows.where(~placed)
    types = found.schema["__fact"].dataType
    nulls = [F.lit(None).cast(types[c].dataType).alias(c) for c in (since, *values)]
    return found.select("__row.*", *added).unionByName(loose.select("*", *nulls))


def _carried_over(known: DataFrame, spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, __span, __before``: the last fact of all earlier spans; a row for each span."""
    latest = known.where("__span is not null").groupBy(*keys, "__span").agg(F.max(F.struct("__at", "__fact")).alias("__last"))
    grid = spans.select(*keys, F.explode(F.sequence(F.lit(0), F.size("__cuts"))).alias("__span"))
    earlier = Window.partitionBy(*keys).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.col("__last")["__fact"], ignorenulls=True).over(earlier)
    return join_lookup(grid, latest, [*keys, "__span"]).select(*keys, "__span", before.alias("__before"))


def status_as_of(
    records: DataFrame,
    checks: DataFrame,
    keys: Sequence[str] = ("doc_id",),
    at: str = "at",
    checked_at: str = "checked_at",
    passed: str = "passed",
    hot_rows: int | None = None,
) -> DataFrame:
    """Add ``status`` at the record's own date, and when the deciding check was made.

    The latest check up to that date decides; one that came to no result does not count.
    ``unverified`` where nobody had looked yet.
    """
    _require_absent(records, "status")
    decided = checks.where(F.col(passed).isNotNull()).select(*keys, checked_at, F.col(passed).alias("__passed"))
    found = join_as_of(records, decided, keys, at, checked_at, ["__passed"], hot_rows)
    status = F.when(F.col("__passed"), F.lit(VERIFIED)).when(~F.col("__passed"), F.lit(REJECTED)).otherwise(F.lit(UNVERIFIED))
    return found.withColumn("status", status).drop("__passed")


def status_history(
    states: DataFrame, keys: Sequence[str], at: str, state: str, hot_rows: int | None = None
) -> DataFrame:
    """The stretches of time over which a key kept one state.

    ``keys, state, since, last_at, until, n_rows``: from the first row of the state
    (``since``) up to the next one of another (``until``, null for the last stretch).
    Of rows at one time, the lesser state comes first; a null state is one of its own.
    Rows without a key or a time have no place in a history.

    Neighbours are compared within a key in one sort. A key with more than ``hot_rows``
    rows is cut into spans of time; only the first and last stretch of each span are
    looked at again, to join those that go on beyond its edge.
    """
    rows = states.where(have_all([*keys, at])).select(*keys, F.col(at).alias("__at"), F.col(state).alias("__state"))
    spans = hot_spans(rows, keys, "__at", hot_rows)
    own = Window.partitionBy(*keys, "__span")
    order = own.orderBy("__at", "__state")
    held = F.struct("__state")
    starts = ~held.eqNullSafe(F.lag(held).over(order))
    placed = in_spans(rows, spans, keys, "__at").withColumn("__starts", starts.cast("int"))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = placed.withColumn("__run", F.sum("__starts").over(so_far))
    runs = numbered.groupBy(*keys, "__span", "__run").agg(
        F.first("__state").alias("state"),
        F.min("__at").alias("since"),
        F.max("__at").alias("last_at"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    runs = runs.withColumn("until", F.lead("since").over(own.orderBy("__run")))
    columns = [*keys, F.col("state").alias(state), "since", "last_at", "until", "n_rows"]
    if spans is None:
        return runs.select(*columns)
    at_edge = F.col("__span").isNotNull() & ((F.col("__run") == 1) | F.col("until").isNull())
    joined = _joined_at_edges(runs.where(at_edge), keys)
    return runs.where(~at_edge).select(*columns).unionByName(joined.select(*columns))


def _joined_at_edges(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stretches of the edges of spans, joined where the state goes on; two rows a span at most."""
    order = Window.partitionBy(*keys).orderBy("__span", "__run")
    before = F.lag(F.struct("__span", "state")).over(order)
    goes_on = (before["__span"] < F.col("__span")) & before["state"].eqNullSafe(F.col("state"))
    parted = edges.withColumn("__new", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    parted = parted.withColumn("__whole", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = parted.groupBy(*keys, "__whole").agg(
        F.first("state").alias("state"),
        F.min("since").alias("since"),
        F.max("last_at").alias("last_at"),
        F.sum("n_rows").alias("n_rows"),
        F.max_by(F.struct("until"), F.struct("__span", "__run")).alias("__last"),
    )
    following = F.lead("since").over(Window.partitionBy(*keys).orderBy("__whole"))
    return whole.withColumn("until", F.coalesce(F.col("__last")["until"], following))
