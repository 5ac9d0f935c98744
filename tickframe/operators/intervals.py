"""Intervals: overlap, states that replace each other, splitting at every boundary, trimming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlaps(cues: DataFrame, by: list[str], key: str, width: int) -> DataFrame:
    """Pairs (a, b), a < b, of cues of a group that overlap in time.

    Each cue is put in every span of ``width`` it touches, so that the join is on (group, span) and a long
    group is many tasks; a pair is reported in the span where the later of the two begins."""
    spans = cues.withColumn("_span", F.explode(F.sequence(F.floor(F.col("start_us") / width), F.floor((F.col("end_us") - 1) / width))))
    side = lambda e: spans.select(*by, "_span", F.col(key).alias(e), F.col("start_us").alias(f"_s{e}"), F.col("end_us").alias(f"_e{e}"))
    pairs = side("a").join(side("b"), [*by, "_span"]).filter("a < b AND _sa < _eb AND _sb < _ea")
    return pairs.filter(F.col("_span") == F.floor(F.greatest("_sa", "_sb") / width)).select(*by, "a", "b")


def replaced(states: DataFrame, by: list[str]) -> DataFrame:
    """Bitmap states: an open one ends where the next begins, a finite end wins if earlier; a blank clears the
    screen and isn't shown, its own end ignored."""
    w = Window.partitionBy(*by).orderBy("start_us", "seq")
    until = F.lead("start_us").over(w)
    end = F.least(F.col("end_us"), until)
    return states.withColumn("shown_until", end).filter("NOT blank").select(*by, "seq", "start_us", "shown_until")


def collapse_states(states: DataFrame, by: list[str], order: list[str], content: str) -> DataFrame:
    """Blanks go first, then repeats of the last kept one: a repeat behind a blank goes too."""
    w = Window.partitionBy(*by).orderBy(*order)
    return states.filter("NOT blank").withColumn("_before", F.lag(content).over(w)).withColumn("_first", F.row_number().over(w) == 1).filter(F.col("_first") | ~F.col(content).eqNullSafe(F.col("_before"))).drop("_before", "_first")


def atomic(spans: DataFrame, paragraph: list[str]) -> DataFrame:
    """Intervals between neighbouring boundaries of a paragraph's spans, clamped to (p_begin, p_end)."""
    clamp = lambda c: F.least(F.greatest(F.col(c), F.col("p_begin")), F.col("p_end"))
    edges = spans.groupBy(*paragraph).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("p_begin", "p_end", clamp("begin"), clamp("end")))))).alias("_edges"))
    pairs = F.zip_with(F.expr("slice(_edges, 1, size(_edges) - 1)"), F.expr("slice(_edges, 2, size(_edges) - 1)"), lambda a, b: F.struct(a.alias("begin"), b.alias("end")))
    return edges.filter("size(_edges) > 1").select(*paragraph, F.explode(pairs).alias("_i")).select(*paragraph, "_i.begin", "_i.end")


def trim(frames: DataFrame, by: list[str], order: str) -> DataFrame:
    """Audio trimming: ``skip`` samples from the start, ``pad`` from the end, each carried over frames; padding larger
    than what there is is ignored.  Gives first and last sample kept of each frame that keeps any."""
    w = Window.partitionBy(*by).orderBy(order)
    whole = Window.partitionBy(*by)
    stop = F.sum("samples").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("samples").over(whole)
    pad = F.when(F.col("pad") <= total, F.col("pad")).otherwise(0)
    kept = frames.withColumn("_stop", stop).withColumn("_start", stop - F.col("samples")).withColumn("_to", total - pad)
    low, high = F.greatest("_start", "skip"), F.least("_stop", "_to")
    return kept.withColumn("from_sample", low - F.col("_start")).withColumn("to_sample", high - F.col("_start")).filter(high > low).drop("_stop", "_start", "_to")
