"""Mixing sources to target weights by hash-threshold histograms.

A document's size is its number of words.  A source's target is its share of all words by
weight, at most ``most`` times its own size; what is over is shared again by
weight until no source is above (the level L with sum(min(cap, L * weight)) = total).
A source is taken floor(target / size) times whole, and for the rest the documents
whose hash is below the source's threshold are taken once more.  Thresholds of growing budgets are
nested.

Finding a threshold needs no sort: sizes are summed by source and hash bucket (4096
to a level); the running sum over a source's buckets shows the one in which the budget ends, and only
that one is split again, by the next bits of the hash, until the bits are used up.  A
document at the end is taken if that brings the sum nearer to the budget.  Each level reads the small
table (id, source, size, hash), written once, and sums before it shuffles, so a hot source is a few thousand
rows for each task.  The targets themselves are found over one row a source, in one task: sources are meant to be
collections, up to a million or so, not addresses of single pages.

Defined results: null text and text without words have size 0 and are taken as often as any, for 0
words; null is a source of its own, last; rows with equal ids share a hash and are taken or left together;
an empty table or one without words takes nothing; any extra columns are carried by ``mix``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import WORD, drop, fresh, keep, text_or_empty

BITS, LEVELS = 12, 5


def words(df: DataFrame, text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(df, text), F.lit(WORD)).cast("long")


def unit_hash(key: Column) -> Column:
    """60 bits of a digest; the same in any engine."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], most: int) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row a source."""
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x).cast("double") for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * most)
    # by rising cap / weight, those before a source are at their cap when it reaches its own
    rising = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("w").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) - before).cast("double") / left
    found = ranked.withColumn("level", level)
    reached = F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct((F.col("cap") / F.col("w")).alias("at"), "level"))).over(everything)["level"]
    target = F.least(F.col("cap").cast("double"), reached * F.col("w"))
    return found.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def thresholds(slim: DataFrame, goal: DataFrame) -> DataFrame:
    """``(source, source_size, target, copies, below)``: whole copies, and the hash below which once more.

    ``slim`` is (source, size, hash); ``goal`` is the result of ``targets``."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    open_ = goal.withColumn("copies", whole).withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long")).withColumn("below_sum", F.lit(0).cast("long"))
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        rows = slim.withColumn("bucket", F.shiftright("hash", shift))
        if level > 1:
            # only rows of the bucket in which the budget ends
            edge = open_.select(F.col("source").alias("s"), F.col("prefix").alias("p"))
            rows = rows.join(edge, rows["source"].eqNullSafe(edge["s"]) & (F.shiftright(rows["hash"], shift + BITS) == edge["p"]), "left_semi")
        sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
        run = F.sum("in_bucket").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        sums = sums.withColumn("upto", run).select(F.col("source").alias("s"), "bucket", "in_bucket", "upto")
        at = open_.join(sums, F.col("source").eqNullSafe(F.col("s")), "left")
        total = F.col("below_sum") + F.col("upto")
        if level < LEVELS:
            over = total.cast("double") > F.col("budget")
            first = F.min(F.when(over, F.struct("bucket", (total - F.col("in_bucket")).alias("sum"))))
            # none over: the budget ends behind the last bucket, which is then the one to split
            last = F.max(F.struct("bucket", (total - F.col("in_bucket")).alias("sum")))
        else:
            # the last bucket is one hash: it is taken if that is nearer
            over = 2 * F.col("budget") < (2 * total - F.col("in_bucket")).cast("double")
            first = F.min(F.when(over, F.struct("bucket", total.alias("sum"))))
            last = F.max(F.struct((F.col("bucket") + 1).alias("bucket"), total.alias("sum")))
        found = at.groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("copies").alias("copies"), F.first("budget").alias("budget"), F.coalesce(first, last).alias("edge"))
        open_ = found.select("source", "source_size", "target", "copies", "budget", F.coalesce(F.col("edge.bucket"), F.lit(0)).cast("long").alias("prefix"), F.coalesce(F.col("edge.sum"), F.lit(0)).cast("long").alias("below_sum"))
        before, open_ = open_, keep(open_)  # a row a source: its size is known from here on, so that it is broadcast if small
        drop(before)
    return open_.select("source", "source_size", "target", "copies", F.col("prefix").alias("below"))


def plan(docs: DataFrame, weights: Sequence[float], most: int = 3, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """The small table (id, source, size, hash), written once, and the sources' thresholds."""
    slim = keep(docs.select(docs[id_column].alias("id"), docs[source_column].alias("source"), words(docs, text_column).alias("size"), unit_hash(docs[id_column]).alias("hash")))
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    return slim, thresholds(slim.select("source", "size", "hash"), targets(sizes, weights, most))


def take(rows: DataFrame, edges: DataFrame, source: str = "source", hash_: str = "hash") -> DataFrame:
    """Give each row ``(source_size, target, times)``.  ``edges`` has a row a source: Spark broadcasts it
    while its measured size allows, and else splits the hot sources of a sort-merge join."""
    edge = edges.select(F.col("source").alias("edge_source"), "source_size", "target", "copies", "below")
    joined = rows.join(edge, rows[source].eqNullSafe(edge["edge_source"]), "left")
    return joined.withColumn("times", F.col("copies") + (F.col(hash_) < F.col("below")).cast("long")).drop("edge_source", "copies", "below")


def report(docs: DataFrame, weights: Sequence[float], most: int = 3, **columns) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, source, times)`` of every row."""
    slim, edges = plan(docs, weights, most, **columns)
    return take(slim, edges).select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "source", "times")


def mix(docs: DataFrame, weights: Sequence[float], most: int = 3, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their own columns."""
    slim, edges = plan(docs, weights, most, id_column, source_column, text_column)
    drop(slim)
    h, s, c, b, n = fresh(docs, "mix_hash", "mix_source", "mix_copies", "mix_below", "mix_n")
    edge = edges.select(F.col("source").alias(s), F.col("copies").alias(c), F.col("below").alias(b))
    joined = docs.withColumn(h, unit_hash(docs[id_column])).join(edge, F.col(source_column).eqNullSafe(F.col(s)), "left")
    times = joined.withColumn(n, (F.col(c) + (F.col(h) < F.col(b)).cast("long")).cast("int")).filter(F.col(n) > 0)
    return times.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)
