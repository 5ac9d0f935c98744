"""Reports and journals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_report(df: DataFrame, path: str, rank: str | None = None) -> None:
    """JSON lines, ranked by a column where given, in files of the order's ranges."""
    (df.orderBy(F.col(rank).asc_nulls_last()) if rank else df).write.mode("overwrite").json(path)


def append_journal(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_journal(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole records; torn lines are left out."""
    return spark.read.schema(f"{schema}, _torn string").option("columnNameOfCorruptRecord", "_torn").json(path).filter("_torn IS NULL").drop("_torn")


def to_srt_files(cues: DataFrame) -> DataFrame:
    """``(path, content)`` of cues (path, seq, start_us, end_us, text) as numbered SubRip text."""
    from ..functions.timebase import srt_end, srt_time

    block = F.concat((F.col("seq") + 1).cast("string"), F.lit("\n"), srt_time(F.col("start_us")), F.lit(" --> "), srt_end(F.col("start_us"), F.col("end_us")), F.lit("\n"), "text", F.lit("\n\n"))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("seq", block.alias("b")))), lambda x: x["b"])
    return cues.groupBy("path").agg(F.array_join(blocks, "").alias("content"))
