"""As-of joins: for each target the nearest row at or before (after) it, per key.

Both sides are stacked and the last right row seen is carried along the order.  A
key with a large share of all rows would make one long sequence, so the order is cut into spans of
``span`` ticks: sequences run within (key, span), and what enters a span from earlier
ones is carried over a table of one row a span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], at: str, take: list[str], backward: bool = True, span: int | None = None, tie: str | None = None) -> DataFrame:
    """``left`` with the columns ``take`` of the matching row of ``right``, null without one.

    Equal ticks match in both directions.  Of right rows with equal ticks the last by ``tie``
    counts backward, the first forward."""
    payload = F.struct(*(F.col(c) for c in take))
    order = F.col(tie).cast("long") if tie else F.lit(0).cast("long")
    row = F.struct(*(F.col(c) for c in left.columns))
    # at equal ticks right rows come first backward, last forward, so that they are seen
    stacked = left.select(*by, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_tie"), row.alias("_row")).unionByName(
        right.select(*by, F.col(at).alias("_at"), F.lit(0 if backward else 2).alias("_side"), order.alias("_tie"), payload.alias("_hit")), allowMissingColumns=True
    )
    keys = list(by)
    if span:
        stacked = stacked.withColumn("_span", F.floor(F.col("_at") / span))
        keys.append("_span")
    order_by = [F.col("_at"), F.col("_side"), F.col("_tie")]
    if backward:
        seen = F.last("_hit", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    else:
        seen = F.first("_hit", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order_by).rowsBetween(Window.currentRow, Window.unboundedFollowing))
    found = stacked.withColumn("_found", seen)
    if span:
        edge = F.max if backward else F.min
        spans = stacked.groupBy(*keys).agg(edge(F.when(F.col("_hit").isNotNull(), F.struct("_at", "_tie", "_hit"))).alias("_edge"))
        w = Window.partitionBy(*by).orderBy("_span")
        if backward:
            carried = F.last("_edge", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        else:
            carried = F.first("_edge", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
        carry = spans.withColumn("_carry", carried).select(*keys, F.col("_carry._hit").alias("_carried"))
        found = found.filter("_side = 1").join(carry, keys, "left").withColumn("_found", F.coalesce("_found", "_carried"))
    return found.filter("_side = 1").select("_row.*", *(F.col("_found")[c].alias(c) for c in take))


def bounds(left: DataFrame, right: DataFrame, by: list[str], at: str, column: str, span: int | None = None) -> DataFrame:
    """The entries on both sides of each target: ``lower`` and ``upper``."""
    low = asof(left, right.withColumn("lower", F.col(column)), by, at, ["lower"], True, span)
    return asof(low, right.withColumn("upper", F.col(column)), by, at, ["upper"], False, span)


def first_crossing(df: DataFrame, by: list[str], order: list[str], reached: Column) -> DataFrame:
    """Rows from the first one on for which ``reached`` holds, whatever comes later."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_on", F.max(F.coalesce(reached, F.lit(False)).cast("int")).over(w)).filter("_on = 1").drop("_on")
