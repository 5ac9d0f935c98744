"""Choosing rows: caps, ranks, tracks, probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(df: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group.  Spark keeps no more than that of a group in any task before dealing rows by group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")


def ranked(df: DataFrame, value: Column, tie: str, parts: int = 64) -> DataFrame:
    """Places by rising value, those without one last.

    Values are cut into ranges at about ``parts`` of their quantiles, which are measured first.  A row's place is that in its
    range and the number of rows in the ranges before, so no task has all rows."""
    rows = df.withColumn("_value", F.coalesce(value.cast("double"), F.lit(float("inf"))))
    cuts = sorted(set(rows.select(F.percentile_approx("_value", [i / parts for i in range(1, parts)], 10_000)).first()[0] or []))
    part = F.lit(0) if not cuts else sum((F.col("_value") > c).cast("int") for c in cuts)
    rows = rows.withColumn("_part", part)
    # one row a range
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    placed = rows.withColumn("_rank", F.rank().over(Window.partitionBy("_part").orderBy("_value", tie))).join(F.broadcast(before), "_part")
    return placed.withColumn("position", (F.col("_rank") + F.col("_before")).cast("int")).drop("_value", "_part", "_rank", "_before")


def first_best(df: DataFrame, by: list[str], value: str, order: str, *columns: str) -> DataFrame:
    """The row with the largest value; of equal ones the first."""
    best = F.min_by(F.struct(value, order, *columns), F.struct((-F.col(value)).alias("v"), F.col(order).alias("o")))
    return df.groupBy(*by).agg(best.alias("_r")).select(*by, *(F.col("_r")[c].alias(c) for c in (value, order, *columns)))
