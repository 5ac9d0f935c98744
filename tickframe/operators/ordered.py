"""Operators on ordered rows, as window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fill_durations(df: DataFrame, by: list[str], order: list[str], pts: str = "pts", duration: str = "duration") -> DataFrame:
    """Unknown durations (negative) become the distance to the next row, if not negative; the last stays -1."""
    gap = F.lead(pts).over(Window.partitionBy(*by).orderBy(*order)) - F.col(pts)
    return df.withColumn(duration, F.when(F.col(duration) >= 0, F.col(duration)).when(gap >= 0, gap).otherwise(F.lit(-1)))


def drop_adjacent(df: DataFrame, by: list[str], order: list[str], same: list[str]) -> DataFrame:
    """Drops rows equal in ``same`` to the row just before."""
    w = Window.partitionBy(*by).orderBy(*order)
    key = F.struct(*(F.col(c) for c in same))
    return df.withColumn("_before", F.lag(key).over(w)).withColumn("_first", F.row_number().over(w) == 1).filter(F.col("_first") | ~key.eqNullSafe(F.col("_before"))).drop("_before", "_first")


def fill_ends(df: DataFrame, by: list[str], order: list[str], start: str, end: str, total: str) -> DataFrame:
    """Missing ends become the next start, the last one the total, where that isn't before the own start."""
    following = F.coalesce(F.lead(start).over(Window.partitionBy(*by).orderBy(*order)), F.col(total))
    return df.withColumn(end, F.coalesce(F.col(end), F.when(following >= F.col(start), following)))


def clock(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Frame times: the own, else the one before plus its last positive duration; before any, the packet's, else 0; never negative.

    Within the rows behind one that has a time the last positive duration applies to each step; where it isn't constant
    the general form in ``stateful`` is needed."""
    w = Window.partitionBy(*by).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    island = F.count("pts").over(upto)
    rows = df.withColumn("_island", island).withColumn("_base", F.coalesce(F.last("pts", ignorenulls=True).over(upto), F.first("packet_pts").over(upto), F.lit(0)))
    w2 = Window.partitionBy(*by, "_island").orderBy(*order)
    step = F.coalesce(F.last(F.when(F.col("duration") > 0, F.col("duration")), ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = F.row_number().over(w2) - 1
    rows = rows.withColumn("_step", step).withColumn("_n", moved)
    behind = F.sum(F.when(F.col("_n") > 0, F.col("_step")).otherwise(0)).over(w2.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("time", F.greatest(F.col("_base") + behind, F.lit(0))).drop("_island", "_base", "_step", "_n")


def nth_of_kind(df: DataFrame, by: list[str], order: str, name: str = "nth") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1)


def failures_in_a_row(df: DataFrame, by: list[str], order: list[str], ok: str, limit: int) -> DataFrame:
    """Streams with ``limit`` failures in a row, and the row at which the last of them came first."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.withColumn("_good", F.sum(F.col(ok).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).filter(~F.col(ok))
    run = F.row_number().over(Window.partitionBy(*by, "_good").orderBy(*order))
    return rows.withColumn("_run", run).filter(F.col("_run") == limit).groupBy(*by).agg(F.min(F.struct(*order)).alias("_at")).select(*by, F.col("_at")[order[-1]].alias("retired_at"))


def within_budget(df: DataFrame, by: list[str], order: list[Column], size: str, most: int) -> DataFrame:
    """The first rows whose sizes together stay within ``most``."""
    total = F.sum(size).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("_total", total).filter(F.col("_total") <= most).drop("_total")


def read_ahead(df: DataFrame, by: list[str], at: str, now: str, span: int, most: int, size: str = "bytes") -> DataFrame:
    """Packets kept ahead of the clock: later than now, within ``span`` of the newest, and of those the
    newest with at most ``most`` bytes in all (the oldest go first)."""
    newest = F.max(at).over(Window.partitionBy(*by))
    near = df.filter(F.col(at) > F.col(now)).withColumn("_newest", newest).filter(F.col("_newest") - F.col(at) <= span).drop("_newest")
    return within_budget(near, by, [F.col(at).desc(), F.col("seq").desc()], size, most)


def display_positions(df: DataFrame, by: list[str], shown: list[str]) -> DataFrame:
    """The place of each picture in display order, from 0."""
    return df.withColumn("position", (F.row_number().over(Window.partitionBy(*by).orderBy(*shown)) - 1).cast("long"))


def decisive(df: DataFrame, by: list[str], order: str, poc: str, stamp: str) -> DataFrame:
    """Whether stamps contradict the display order: the first row below the largest picture order so far decides, ``Repair`` if
    its stamp is above that picture's, else ``Trust``; ``Undecided`` without one."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_top", F.max(F.struct(poc, stamp)).over(before))
    below = F.col(poc) < F.col(f"_top.{poc}")
    verdict = F.when(below & (F.col(stamp) > F.col(f"_top.{stamp}")), "Repair").when(below & (F.col(stamp) < F.col(f"_top.{stamp}")), "Trust")
    return rows.withColumn("_v", verdict).groupBy(*by).agg(F.coalesce(F.min_by("_v", F.when(F.col("_v").isNotNull(), F.col(order))), F.lit("Undecided")).alias("verdict"))


def slots(df: DataFrame, by: list[str], display: str, decode: str, stamp: str, depth: int) -> DataFrame:
    """The k-th picture in display order gets the (k + depth)-th stamp in decode order; behind the last stamp times go on
    by the last step."""
    shown = df.withColumn("_slot", F.row_number().over(Window.partitionBy(*by).orderBy(display)) + depth)
    stamps = df.withColumn("_slot", F.row_number().over(Window.partitionBy(*by).orderBy(decode))).select(*by, "_slot", F.col(stamp).alias("_stamp"))
    w = Window.partitionBy(*by).orderBy("_slot")
    ends = stamps.withColumn("_step", F.col("_stamp") - F.lag("_stamp").over(w)).groupBy(*by).agg(F.max(F.struct("_slot", "_stamp", "_step")).alias("_end"))
    found = shown.join(stamps, [*by, "_slot"], "left").join(ends, by)
    beyond = F.col("_end._stamp") + F.coalesce("_end._step", F.lit(0)) * (F.col("_slot") - F.col("_end._slot"))
    return found.withColumn("repaired", F.coalesce("_stamp", beyond)).drop("_slot", "_stamp", "_end")


def cascade(declarations: DataFrame, by: list[str]) -> DataFrame:
    """Of the rules for a property the most specific counts, of equal ones the last."""
    return declarations.groupBy(*by, "property").agg(F.max_by("value", F.struct("specificity", "position")).alias("value"))


def last_write(df: DataFrame, by: list[str], order: str, *columns: str) -> DataFrame:
    """Of rows with an equal key the last one written."""
    return df.groupBy(*by).agg(F.max(F.struct(order, *columns)).alias("_r")).select(*by, *(F.col("_r")[c].alias(c) for c in (order, *columns)))


def decimate(df: DataFrame, by: list[str], order: str, keep_last: bool = False) -> DataFrame:
    """Every other entry, from the first; with ``keep_last`` the last one as well."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    return rows.filter((F.col("_i") % 2 == 0) | (F.lit(keep_last) & (F.col("_i") == F.col("_n") - 1))).drop("_i", "_n")
