"""Tables of a folder, and the media views of them that the queries use.

The event log stands in for demultiplexed packets: a user is a stream, an event a packet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "2024-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The packet view in a dialect both engines read, but for the tick count.
PACKETS = """SELECT user_id AS stream, event_id AS seq, {us} AS us,
 CASE WHEN event_type = 'error' THEN NULL ELSE {us} END AS pts, CASE WHEN event_type = 'view' THEN NULL ELSE {us} - 40000 END AS dts,
 CASE WHEN event_type = 'click' THEN NULL ELSE CAST(floor(value * 1000) AS BIGINT) END AS duration,
 event_type = 'signup' AS keyframe, CAST(round(value * 100) AS BIGINT) AS bytes, event_type AS kind FROM events"""
PACKETS_SQL = "(" + PACKETS.format(us=f"date_diff('microsecond', TIMESTAMP '{EPOCH}', ts)") + ")"


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream, seq, us (always set), pts, dts, duration (nullable), keyframe, bytes, kind."""
    us = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'{EPOCH} 00:00:00', ts)")
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("stream"), F.col("event_id").alias("seq"), us.alias("us"),
        F.when(kind != "error", us).alias("pts"), F.when(kind != "view", us - 40000).alias("dts"),
        F.when(kind != "click", F.floor(F.col("value") * 1000).cast("long")).alias("duration"),
        (kind == "signup").alias("keyframe"), F.round(F.col("value") * 100).cast("long").alias("bytes"), kind.alias("kind"),
    )


def values(spark: SparkSession, columns: str, rows: str) -> DataFrame:
    """A small literal table; ``rows`` is the body of a VALUES clause."""
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")
