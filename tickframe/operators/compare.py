"""Comparison of sequences by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def ordinal_join(left: DataFrame, right: DataFrame, by: list[str], one: str, two: str) -> DataFrame:
    """Rows of equal position in each group; a group with lists of different lengths is one row with ``error``."""
    sizes = left.groupBy(*by).agg(F.count("*").alias("_n")).join(right.groupBy(*by).agg(F.count("*").alias("_m")), by, "full")
    same = sizes.select(*by, F.coalesce(F.col("_n") == F.col("_m"), F.lit(False)).alias("_same"))
    a, b = numbered(left, by, [one], "nth"), numbered(right, by, [two], "nth")
    pairs = a.join(b, [*by, "nth"]).join(same.filter("_same"), by, "left_semi").select(*by, "nth", one, two, F.lit(False).alias("error"))
    return pairs.unionByName(same.filter("NOT _same").select(*by, F.lit(True).alias("error")), allowMissingColumns=True)


def _aligned(left: DataFrame, right: DataFrame, by: str, order: list[str], columns: list[str]) -> DataFrame:
    """Both sequences side by side: columns with _a and _b, position i; ``in_a`` and ``in_b`` where there is a row."""
    a, b = (numbered(df, [by], order, "i").select(by, "i", F.lit(True).alias(f"in_{e}"), *(F.col(c).alias(f"{c}_{e}") for c in columns)) for df, e in ((left, "a"), (right, "b")))
    return a.join(b, [by, "i"], "full")


def frame_sequences(left: DataFrame, right: DataFrame, by: str, order: str) -> DataFrame:
    both = _aligned(left, right, by, [order], ["frame_md5"])
    same = F.coalesce(F.col("frame_md5_a") == F.col("frame_md5_b"), F.lit(False))
    return both.groupBy(by).agg(
        F.count("in_a").alias("frames"), F.count("in_b").alias("expected"), F.count_if(same).alias("matched"), ((F.count("in_a") == F.count("in_b")) & F.bool_and(same)).alias("exact"), F.min(F.when(~same, F.col("i"))).cast("long").alias("first_different")
    )


def milliseconds(us: Column) -> Column:
    return F.floor((us + 500) / 1000)


def cue_sequences(left: DataFrame, right: DataFrame, by: str, order: list[str]) -> DataFrame:
    both = _aligned(left, right, by, order, ["start_us", "text"])
    return both.groupBy(by).agg(
        (F.count("in_a") == F.count("in_b")).alias("same_count"), F.count_if(milliseconds(F.col("start_us_a")) != milliseconds(F.col("start_us_b"))).alias("late"), F.count_if(F.col("text_a") != F.col("text_b")).alias("different_texts")
    )


def bitmap_cues(left: DataFrame, right: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``right`` shows its end for every other cue only, as a reference does that leaves states open."""
    both = _aligned(left, right, by, order, ["start_us", "end_us"]).filter("in_a AND in_b").withColumn("end_us_b", F.when(F.col("i") % 2 == 0, F.col("end_us_b")))
    ends = F.col("end_us_a").isNull() | F.col("end_us_b").isNull() | (milliseconds(F.col("end_us_a")) == milliseconds(F.col("end_us_b")))
    return both.groupBy(by).agg(F.count("*").alias("cues"), F.count_if((milliseconds(F.col("start_us_a")) == milliseconds(F.col("start_us_b"))) & ends).alias("same"))


def snr(left: DataFrame, right: DataFrame, by: str, order: str, value: str, slack: int = 0) -> DataFrame:
    """Decibels of ``left`` (reference) against ``right`` over their common length.

    No noise is +infinity, silence against noise -infinity; errors: empty, not finite, or lengths more than ``slack`` apart."""
    both = _aligned(left.withColumnRenamed(value, "v"), right.withColumnRenamed(value, "v"), by, [order], ["v"])
    shared = F.col("in_a") & F.col("in_b")
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    sums = both.groupBy(by).agg(
        F.count("in_a").alias("n"), F.count("in_b").alias("m"), F.sum(F.when(shared, F.col("v_a") ** 2)).alias("signal"), F.sum(F.when(shared, (F.col("v_a") - F.col("v_b")) ** 2)).alias("noise"),
        F.bool_or((F.col("in_a") & ~finite(F.col("v_a"))) | (F.col("in_b") & ~finite(F.col("v_b")))).alias("odd"),
    )
    error = F.when((F.col("n") == 0) | (F.col("m") == 0), "empty").when(F.abs(F.col("n") - F.col("m")) > slack, "length").when(F.coalesce("odd", F.lit(False)), "not finite")
    inf = float("inf")
    db = F.when(F.col("noise") == 0, F.lit(inf)).when(F.col("signal") == 0, F.lit(-inf)).otherwise(10 * F.log10(F.try_divide("signal", "noise")))
    return sums.select(by, error.alias("error"), F.when(error.isNull(), db).alias("snr_db"))
