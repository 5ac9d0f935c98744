"""Rules against facts, and what follows for the rows of a rubric."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match(streams: DataFrame, rules: DataFrame) -> DataFrame:
    """Pairs of a rule and a stream of its kind whose codec it lists or begins like its prefix.

    Listed ids are exploded to an equi-join; prefixes are few and compared in a join on the kind, whose small side Spark broadcasts."""
    ids = rules.select("row_name", F.col("kind").alias("rule_kind"), F.explode("ids").alias("id"))
    listed = streams.join(ids, (F.col("kind") == F.col("rule_kind")) & (F.col("codec") == F.col("id"))).select("row_name", *streams.columns)
    prefixes = rules.filter("prefix IS NOT NULL").select("row_name", F.col("kind").alias("rule_kind"), "prefix")
    begun = streams.join(prefixes, (F.col("kind") == F.col("rule_kind")) & F.startswith("codec", "prefix")).select("row_name", *streams.columns)
    return listed.unionByName(begun).distinct()


#: Standings from worst to best.
RANK = {"Failed": 0, "Unverified": 1, "Verified": 2}


def rank(standing):
    return F.create_map(*[F.lit(v) for pair in RANK.items() for v in pair])[standing]


def named(rank_):
    return F.create_map(*[F.lit(v) for name, i in RANK.items() for v in (i, name)])[rank_]


def claim_any(entries: DataFrame, streams: DataFrame, by: str) -> DataFrame:
    """Codec rows: the best standing among matching streams; failed without one or if the entry's streams failed as a whole."""
    best = streams.groupBy(by).agg(F.max(rank(F.col("standing"))).alias("best"))
    joined = entries.join(best, by, "left")
    return joined.select(by, F.when(F.col("stream_failure") | F.col("best").isNull(), "Failed").otherwise(named(F.col("best"))).alias("standing"))


def claim_all(entries: DataFrame, streams: DataFrame, by: str) -> DataFrame:
    """Container rows: fail on a wrong demuxer, on a failure of the entry or without streams; else the worst
    standing, with the first failing stream."""
    worst = streams.groupBy(by).agg(F.min(rank(F.col("standing"))).alias("worst"), F.min(F.when(F.col("standing") == "Failed", F.col("stream"))).alias("first_failed"))
    joined = entries.join(worst, by, "left")
    reason = F.when(~F.col("demuxer_ok"), "demuxer").when(F.col("entry_failure"), "entry").when(F.col("worst").isNull(), "no streams").when(F.col("worst") == 0, F.concat(F.lit("stream "), F.col("first_failed").cast("string")))
    return joined.select(by, F.when(reason.isNotNull(), "Failed").otherwise(named(F.col("worst"))).alias("standing"), reason.alias("reason"))


def status(rows: DataFrame, claims: DataFrame, by: str) -> DataFrame:
    """VERIFIED, UNVERIFIED, FAIL, NOT RUN or UNCOVERED for each row of the rubric, with its entries by standing."""
    lists = [F.sort_array(F.collect_list(F.when(F.col("standing") == s, F.col("entry")))).alias(name) for s, name in (("Verified", "verified"), ("Unverified", "unverified"), ("Failed", "failing"))]
    sums = claims.groupBy(by).agg(*lists, F.count("*").alias("claims"))
    j = rows.join(sums, by, "left")
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    verdict = F.when(some("verified"), "VERIFIED").when(some("unverified"), "UNVERIFIED").when(some("failing"), "FAIL").when(F.coalesce("claims", F.lit(0)) > 0, "NOT RUN").otherwise("UNCOVERED")
    none = F.array().cast("array<bigint>")
    return j.select(by, verdict.alias("status"), *(F.coalesce(c, none).alias(c) for c in ("verified", "unverified", "failing")))
