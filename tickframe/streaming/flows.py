"""Streaming sources, filters and sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def tail(spark: SparkSession, path: str, schema: str | StructType, files_per_batch: int = 8) -> DataFrame:
    """New Parquet files of a folder; the number taken at once is the backpressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def on_time(df: DataFrame, clock: Column, due: Column, slack: int) -> DataFrame:
    """Late rows are dropped and counted: the count is observed as ``late`` with each batch."""
    late = F.coalesce(clock > due + slack, F.lit(False))
    return df.observe("late", F.count_if(late).alias("late"), F.count("*").alias("rows")).filter(~late)


def windowed(df: DataFrame, at: str, by: str, width: str, lateness: str) -> DataFrame:
    """Counts by window of event time behind a watermark; plain timestamps become zoned ones at the entrance."""
    return df.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, lateness).groupBy(F.window(at, width), by).count()


def capture(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All there is now, to a table in memory."""
    return df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def capture_files(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All there is now, to Parquet files, which a capture of any size needs; each row once."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def journal(df: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Appends each batch once: a batch is a folder named by its number and is written over when repeated."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={number}")
        if each:
            each(batch, number)

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Monitor:
    """A handle on a streaming query: suspend and resume it from its checkpoint, stop it, and hear when it waits for data.

    ``start`` starts the query; it is called again to resume, so its checkpoint has to be the same each time."""

    def __init__(self, start: Callable[[], StreamingQuery]):
        self.start, self.stopped, self.listener = start, False, None
        self.query: StreamingQuery | None = start()

    def suspend(self) -> None:
        if self.query is not None:
            self.query.stop()
            self.query = None

    def resume(self) -> None:
        if self.stopped:
            raise RuntimeError("the query was stopped")
        if self.query is None:
            self.query = self.start()

    def stop(self) -> None:
        self.suspend()
        self.stopped = True

    def on_starved(self, spark: SparkSession, hook: Callable[[bool], None]) -> None:
        """``hook(True)`` once a trigger finds nothing new, ``hook(False)`` once rows come again."""
        from pyspark.sql.streaming import StreamingQueryListener

        monitor, waiting = self, [False]

        def tell(run, now: bool) -> None:
            if monitor.query is not None and str(run) == str(monitor.query.runId) and waiting[0] != now:
                waiting[0] = now
                hook(now)

        class Listener(StreamingQueryListener):
            def onQueryStarted(self, event):
                pass

            def onQueryIdle(self, event):
                tell(event.runId, True)

            def onQueryProgress(self, event):
                tell(event.progress.runId, event.progress.numInputRows == 0)

            def onQueryTerminated(self, event):
                pass

        self.listener = Listener()
        spark.streams.addListener(self.listener)


def tap(df: DataFrame, name: str | Observation, *measures: Column) -> DataFrame:
    """Measures rows that pass without changing them."""
    return df.observe(name, *measures)
