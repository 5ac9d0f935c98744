"""Aggregations with the tie and order rules of ordered files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lane_span(df: DataFrame, by: list[str], order: str, at: str, size: str) -> DataFrame:
    """Last minus first time in file order, not negative, over timed rows; the bytes of all rows."""
    timed = F.when(F.col(at).isNotNull(), F.col(order))
    return df.groupBy(*by).agg(F.greatest(F.max_by(at, timed) - F.min_by(at, timed), F.lit(0)).alias("span"), F.sum(size).alias("bytes"))


def upper_median(c: str) -> Column:
    """The element at n / 2 of the sorted values: of an even number the upper middle one.

    That is the first value up to which more than half of the rows lie.  Spark counts a group's rows by value, tasks first, so what is
    held is its different values."""
    return F.expr(f"percentile_disc({0.5 + 1e-12!r}) WITHIN GROUP (ORDER BY `{c}`)")


def median_row(df: DataFrame, by: list[str], value: str, order: str, *columns: str) -> DataFrame:
    """The row that holds the upper median; of equal ones the first in order."""
    medians = df.groupBy(*by).agg(upper_median(value).alias("_m")).select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), "_m")
    same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]
    at = df.join(medians, [*same, F.col(value) == F.col("_m")])
    return at.groupBy(*by).agg(F.min(F.struct(order, value, *columns)).alias("_r")).select(*by, *(F.col("_r")[c].alias(c) for c in (value, order, *columns)))


def merge_entries(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """Rows of an entry, each once, by first appearance; more than one policy of a kind is an error."""
    firsts = df.groupBy(*by, "row").agg(F.min(order).alias("_o"))
    rows = firsts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "row"))), lambda x: x["row"]).alias("rows"))
    policies = df.groupBy(*by).agg(F.count_distinct("policy").alias("_n"), F.min("policy").alias("policy"))
    return rows.join(policies, by).select(*by, "rows", F.when(F.col("_n") == 1, F.col("policy")).alias("policy"), (F.col("_n") > 1).alias("conflict"))


def downmix(samples: Column, gains: list[tuple[float, float]]) -> Column:
    """Left and right of a frame of channels; gains are scaled by 1 / max(sum of left, sum of right, 1)."""
    scale = 1 / max(sum(g[0] for g in gains), sum(g[1] for g in gains), 1.0)
    mixed = [F.aggregate(F.zip_with(samples, F.array(*[F.lit(g[side] * scale) for g in gains]), lambda s, g: s.cast("double") * g), F.lit(0.0), lambda a, b: a + b) for side in (0, 1)]
    return F.array(*mixed)


#: Speaker gains, fixed values: front left and right, centre and surrounds 3 dB down, no low-frequency channel.
HALF_POWER = 0.7071067811865476
SURROUND_51 = [(1.0, 0.0), (0.0, 1.0), (HALF_POWER, HALF_POWER), (0.0, 0.0), (HALF_POWER, 0.0), (0.0, HALF_POWER)]


def verdict(speed: Column, floor: Column, checked: Column, complete: Column, frames: Column, capped: Column, streams: Column, error: Column) -> Column:
    """The verdict of a benchmarked input; later rules override earlier ones."""
    slow = speed < floor
    return (
        F.when(streams == 0, F.when(error.isNotNull(), "ERROR").otherwise("MISSING"))
        .when(capped, "CAPPED")
        .when(frames == 0, "ERROR")
        .when(~checked, "UNCHECKED")
        .when(~complete, F.when(slow, "SLOW!").otherwise("FAIL"))
        .when(slow, "SLOW")
        .otherwise("ok")
    )
