"""Release order, lateness, trust and seeking along a timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def release_order(df: DataFrame, by: list[str], at: str, order: str) -> DataFrame:
    """Batches in the order of release, exact while fewer wait than the queue holds."""
    return df.filter(F.col(at).isNotNull()).withColumn("released", F.row_number().over(Window.partitionBy(*by).orderBy(at, order)))


def untimed(df: DataFrame, by: list[str], order: str) -> DataFrame:
    return df.filter(F.col("pts").isNull()).withColumn("at", F.lead("dts").over(Window.partitionBy(*by).orderBy(order)))


def on_time(df: DataFrame, clock: Column, due: Column, slack: int, limit: int) -> DataFrame:
    return df.filter(~F.coalesce((clock > due + slack) | (due > limit), F.lit(False)))


def runs(df: DataFrame, by: list[str], order: list[str], during: Column, at: str, least: int) -> DataFrame:
    """Runs of neighbouring rows for which ``during`` holds, at least ``least`` long."""
    island = F.sum(F.when(during, 0).otherwise(1)).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = df.withColumn("_g", island).filter(during).groupBy(*by, "_g").agg(F.min(at).alias("since"), F.max(at).alias("until"))
    return found.filter(F.col("until") - F.col("since") >= least).drop("_g")


def trusted_end(df: DataFrame, by: list[str], order: str, end: str, leap: int) -> DataFrame:
    """The end up to which packets follow each other without a leap, and the plain maximum.

    A left fold: a packet that leaps isn't where the next is measured from."""
    from .stateful import fold

    def step(rows):
        trusted = horizon = key = None
        for r in rows:
            at = r[-1]
            key = r[: len(by)]
            if trusted is None or at <= trusted + leap:
                trusted = at if trusted is None else max(trusted, at)
            horizon = at if horizon is None else max(horizon, at)
        yield (*key, trusted, horizon)

    rows = df.filter(F.col(end).isNotNull()).select(*by, order, F.col(end).cast("long").alias(end))
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in by]
    return fold(rows, by, [order], ", ".join([*kinds, "trusted_end long", "horizon long"]), step)


def master_clock(df: DataFrame, by: list[str], order: list[str], at: str, action: str, to: str, audio: str) -> DataFrame:
    """``position`` at each row: the audio clock's where there is one, else that of a clock which runs freely between ``play`` and
    ``pause`` rows and is set by ``seek`` rows; null before it was first started or set."""
    w = Window.partitionBy(*by).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turn = F.when(F.col(action).isin("play", "pause"), F.col(action))
    running = F.coalesce(F.last(turn, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) == "play", F.lit(False))
    seek = F.col(action) == "seek"
    rows = df.withColumn("_ran", F.when(running, F.greatest(F.col(at) - F.lag(at).over(w), F.lit(0))).otherwise(0)).withColumn("_since", F.sum(seek.cast("int")).over(so_far))
    rows = rows.withColumn("_started", F.max((seek | (F.col(action) == "play")).cast("int")).over(so_far) == 1)
    island = Window.partitionBy(*by, "_since").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    free = F.coalesce(F.max(F.when(seek, F.col(to))).over(island), F.lit(0)) + F.sum(F.when(seek, 0).otherwise(F.col("_ran"))).over(island)
    return rows.withColumn("position", F.coalesce(F.col(audio), F.when(F.col("_started"), free))).drop("_ran", "_since", "_started")


def selected(df: DataFrame, by: list[str], order: str, select: str, track: str) -> DataFrame:
    """Rows of the track that the last control row (``select`` not null) before them named; control rows don't pass."""
    playing = F.last(select, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("_playing", playing).filter(F.col(select).isNull() & (F.col(track) == F.col("_playing"))).drop("_playing")


def newest(df: DataFrame, by: list[str], generation: str) -> DataFrame:
    """Rows of the newest generation; the newest is a sum by key, so that a long group isn't sorted."""
    top = df.groupBy(*by).agg(F.max(generation).alias("_top"))
    return df.join(top, by).filter(F.col(generation) == F.col("_top")).drop("_top")


def walk_back(targets: DataFrame, packets: DataFrame, by: list[str], at: str, back: int) -> DataFrame:
    key = F.max(F.when(F.col("keyframe") & (F.col(at) > F.col("target") - back), F.col(at)))
    return packets.join(targets, by).filter(F.col(at) <= F.col("target")).groupBy(*by, "target").agg(F.coalesce(key, F.max(at)).alias("landed"))


def read_on(df: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    others = F.sum((F.col("past") & ~F.col("keyframe")).cast("int")).over(w)
    keys = F.sum((F.col("past") & F.col("keyframe")).cast("int")).over(w)
    rows = df.withColumn("_n", others).withColumn("_k", keys)
    return rows.filter((F.col("_n") <= most) & ((F.col("_k") == 0) | ((F.col("_k") == 1) & F.col("past") & F.col("keyframe")))).drop("_n", "_k")


def disposition(abort: Column, resync: Column, late: Column, caught_up: Column) -> Column:
    return F.when(abort, "Abort").when(resync, "Resync").when(late, "Late").when(caught_up, "CaughtUp").otherwise("Now")
