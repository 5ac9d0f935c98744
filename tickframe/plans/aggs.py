"""Queries on aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates, compare, rules, selection
from ..sources.tables import PACKETS_SQL, packets, table
from .registry import query


@query(f"SELECT stream, greatest(arg_max(pts, seq) FILTER (pts IS NOT NULL) - arg_min(pts, seq) FILTER (pts IS NOT NULL), 0) AS span, CAST(sum(bytes) AS BIGINT) AS bytes FROM {PACKETS_SQL} GROUP BY stream".replace("FILTER (pts", "FILTER (WHERE pts"))
def a01_lane_span(spark, sf_dir):
    return aggregates.lane_span(packets(spark, sf_dir), ["stream"], "seq", "pts", "bytes")


@query("""WITH e AS (SELECT o_custkey AS path, o_orderkey AS seq, o_orderpriority AS row, CASE WHEN o_custkey % 3 = 0 THEN 'md5' WHEN o_orderstatus = 'P' THEN 'snr' ELSE 'md5' END AS policy FROM orders),
f AS (SELECT path, row, min(seq) AS o FROM e GROUP BY ALL), r AS (SELECT path, list(row ORDER BY o) AS rows FROM f GROUP BY path), p AS (SELECT path, count(DISTINCT policy) AS n, min(policy) AS policy FROM e GROUP BY path)
SELECT path, rows, CASE WHEN n = 1 THEN policy END AS policy, n > 1 AS conflict FROM r JOIN p USING (path)""")
def a02_manifest_merge(spark, sf_dir):
    e = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("row"), F.when((F.col("o_custkey") % 3 != 0) & (F.col("o_orderstatus") == "P"), "snr").otherwise("md5").alias("policy"))
    return aggregates.merge_entries(e, ["path"], "seq")


@query("""WITH a AS (SELECT l_orderkey AS stream, l_linenumber AS i, max(l_quantity) AS v FROM lineitem GROUP BY ALL), b AS (SELECT stream, i, CASE WHEN stream % 3 = 0 THEN v ELSE v - 0.5 END AS v FROM a),
s AS (SELECT a.stream, sum(a.v * a.v) AS r, sum((a.v - b.v) * (a.v - b.v)) AS n FROM a JOIN b USING (stream, i) GROUP BY ALL) SELECT stream, NULL::VARCHAR AS error, round(CASE WHEN n = 0 THEN 'infinity'::DOUBLE ELSE 10 * log10(r / n) END, 6) AS snr_db FROM s""")
def a03_snr(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("stream"), F.col("l_linenumber").alias("i")).agg(F.max("l_quantity").alias("v"))  # noqa: E741
    noisy = l.withColumn("v", F.when(F.col("stream") % 3 == 0, F.col("v")).otherwise(F.col("v") - 0.5))
    return compare.snr(l, noisy, "stream", "i", "v").withColumn("snr_db", F.round("snr_db", 6))


@query("SELECT l_orderkey AS file, CAST(max(l_quantity) AS BIGINT) * 2 AS slack, bool_and(l_linestatus = 'F') AS same_channels FROM lineitem GROUP BY ALL")
def a04_lossy_slack(spark, sf_dir):
    """Samples two lengths may differ by: the largest frame times the channels."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("file")).agg((F.max("l_quantity").cast("long") * 2).alias("slack"), F.bool_and(F.col("l_linestatus") == "F").alias("same_channels"))


@query("SELECT user_id AS input, list_sort(list(value))[len(list(value)) // 2 + 1] AS median FROM events GROUP BY ALL")
def a05_upper_median(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("input")).agg(aggregates.upper_median("value").alias("median"))


@query("""WITH r AS (SELECT l_partkey AS input, l_quantity AS speed, l_orderkey * 10 + l_linenumber AS run, l_shipdate AS payload FROM lineitem), m AS (SELECT input, list_sort(list(speed))[len(list(speed)) // 2 + 1] AS speed FROM r GROUP BY ALL)
SELECT input, m.speed, min(run) AS run, arg_min(payload, run) AS payload FROM r JOIN m USING (input, speed) GROUP BY ALL""")
def a06_median_run(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("input"), F.col("l_quantity").alias("speed"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("run"), F.col("l_shipdate").alias("payload"))
    return aggregates.median_row(r, ["input"], "speed", "run", "payload")


@query("SELECT l_partkey AS row, l_quantity AS secs, l_orderkey * 10 + l_linenumber AS seq FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_orderkey * 10 + l_linenumber) = 1")
def a07_longest_first(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("row"), F.col("l_quantity").alias("secs"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return selection.first_best(r, ["row"], "secs", "seq")


@query("SELECT l_suppkey AS source, l_linenumber AS stream, list_sort(list(DISTINCT l_partkey)) AS rows FROM lineitem GROUP BY ALL")
def a08_shared_inputs(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("source"), F.col("l_linenumber").alias("stream")).agg(F.array_sort(F.collect_set("l_partkey")).alias("rows"))


@query(f"""SELECT stream, count(*) FILTER (WHERE kind <> 'error') AS frames, CAST(sum(bytes) AS BIGINT) AS samples, count(*) AS packets, count(*) FILTER (WHERE kind = 'error') AS errors,
 arg_min(bytes, seq) FILTER (WHERE kind = 'error') AS first_error, min(pts) AS first_pts, max(pts) AS last_pts FROM {PACKETS_SQL} GROUP BY stream""")
def a09_tally(spark, sf_dir):
    bad = F.col("kind") == "error"
    return packets(spark, sf_dir).groupBy("stream").agg(
        F.count_if(~bad).alias("frames"), F.sum("bytes").alias("samples"), F.count("*").alias("packets"), F.count_if(bad).alias("errors"), F.min_by("bytes", F.when(bad, F.col("seq"))).alias("first_error"),
        F.min("pts").alias("first_pts"), F.max("pts").alias("last_pts"),
    )


@query(f"""SELECT stream, coalesce(CASE WHEN stream % 3 = 0 THEN CAST(sum(bytes) AS DOUBLE) / 48000 WHEN stream % 3 = 1 THEN CAST(count(*) AS DOUBLE) / 25 END, CAST(max(us) - min(us) AS DOUBLE) / 1000000) AS media_secs FROM {PACKETS_SQL} GROUP BY stream""")
def a10_media_seconds(spark, sf_dir):
    """Samples over the rate, else frames over their rate, else the span of times."""
    known = F.when(F.col("stream") % 3 == 0, F.sum("bytes") / 48000).when(F.col("stream") % 3 == 1, F.count("*") / 25)
    return packets(spark, sf_dir).groupBy("stream").agg(F.coalesce(known, (F.max("us") - F.min("us")) / 1000000).alias("media_secs"))


@query(f"SELECT stream, CASE WHEN max(pts + coalesce(duration, 0)) > min(pts) THEN max(pts + coalesce(duration, 0)) - min(pts) END AS span FROM {PACKETS_SQL} GROUP BY stream")
def a11_packet_span(spark, sf_dir):
    low, high = F.min("pts"), F.max(F.col("pts") + F.coalesce("duration", F.lit(0)))
    return packets(spark, sf_dir).groupBy("stream").agg(F.when(high > low, high - low).alias("span"))


_STREAMS = "(SELECT l_orderkey AS entry, l_linenumber AS stream, CASE WHEN l_quantity < 10 THEN 'Failed' WHEN l_quantity < 25 THEN 'Unverified' ELSE 'Verified' END AS standing FROM lineitem WHERE l_tax < 0.06)"


def _entries(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry"), (F.col("o_custkey") % 17 == 0).alias("stream_failure"), (F.col("o_custkey") % 19 == 0).alias("entry_failure"), (F.col("o_custkey") % 13 != 0).alias("demuxer_ok"))


def _standings(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").filter("l_tax < 0.06").select(F.col("l_orderkey").alias("entry"), F.col("l_linenumber").alias("stream"), F.when(q < 10, "Failed").when(q < 25, "Unverified").otherwise("Verified").alias("standing"))


_RANK = "CASE standing WHEN 'Failed' THEN 0 WHEN 'Unverified' THEN 1 ELSE 2 END"


@query(f"""SELECT o_orderkey AS entry, CASE WHEN o_custkey % 17 = 0 OR m IS NULL THEN 'Failed' ELSE ['Failed', 'Unverified', 'Verified'][m + 1] END AS standing
FROM orders LEFT JOIN (SELECT entry, max({_RANK}) AS m FROM {_STREAMS} GROUP BY ALL) ON entry = o_orderkey""")
def a12_claim_any(spark, sf_dir):
    return rules.claim_any(_entries(spark, sf_dir), _standings(spark, sf_dir), "entry")


@query(f"""WITH j AS (SELECT o_orderkey AS entry, o_custkey AS c, m, ff FROM orders LEFT JOIN (SELECT entry, min({_RANK}) AS m, min(stream) FILTER (WHERE standing = 'Failed') AS ff FROM {_STREAMS} GROUP BY ALL) ON entry = o_orderkey),
r AS (SELECT *, CASE WHEN c % 13 = 0 THEN 'demuxer' WHEN c % 19 = 0 THEN 'entry' WHEN m IS NULL THEN 'no streams' WHEN m = 0 THEN 'stream ' || ff END AS reason FROM j)
SELECT entry, CASE WHEN reason IS NOT NULL THEN 'Failed' ELSE ['Failed', 'Unverified', 'Verified'][m + 1] END AS standing, reason FROM r""")
def a13_claim_all(spark, sf_dir):
    return rules.claim_all(_entries(spark, sf_dir), _standings(spark, sf_dir), "entry")


@query("""WITH c AS (SELECT s_nationkey AS row, s_suppkey AS entry, CASE WHEN s_acctbal > 6000 THEN 'Verified' WHEN s_acctbal > 3000 THEN 'Unverified' WHEN s_acctbal > 0 THEN 'Failed' ELSE 'Skipped' END AS standing FROM supplier),
s AS (SELECT row, list_sort(coalesce(list(entry) FILTER (WHERE standing = 'Verified'), [])) AS verified, list_sort(coalesce(list(entry) FILTER (WHERE standing = 'Unverified'), [])) AS unverified, list_sort(coalesce(list(entry) FILTER (WHERE standing = 'Failed'), [])) AS failing, count(*) AS n FROM c GROUP BY row)
SELECT n_nationkey AS row, CASE WHEN len(verified) > 0 THEN 'VERIFIED' WHEN len(unverified) > 0 THEN 'UNVERIFIED' WHEN len(failing) > 0 THEN 'FAIL' WHEN n > 0 THEN 'NOT RUN' ELSE 'UNCOVERED' END AS status, coalesce(verified, []) AS verified, coalesce(unverified, []) AS unverified, coalesce(failing, []) AS failing
FROM nation LEFT JOIN s ON s.row = n_nationkey""")
def a14_row_status(spark, sf_dir):
    b = F.col("s_acctbal")
    c = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("row"), F.col("s_suppkey").alias("entry"), F.when(b > 6000, "Verified").when(b > 3000, "Unverified").when(b > 0, "Failed").otherwise("Skipped").alias("standing"))
    return rules.status(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("row")), c, "row")


@query("SELECT user_id AS entry, count(*) FILTER (WHERE value < 20) > 0 AND count(*) FILTER (WHERE value < 20 AND event_type = 'error') = 0 AS passed FROM events GROUP BY ALL")
def a15_fuzz_verdict(spark, sf_dir):
    """Passes with at least one mutation and no failure."""
    tried = F.col("value") < 20
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("entry")).agg(((F.count_if(tried) > 0) & (F.count_if(tried & (F.col("event_type") == "error")) == 0)).alias("passed"))


@query("SELECT CAST(CASE WHEN bool_or(s_acctbal < 0) THEN 1 ELSE 0 END AS INTEGER) AS exit_status FROM supplier")
def a16_exit_status(spark, sf_dir):
    return table(spark, sf_dir, "supplier").agg(F.coalesce(F.bool_or(F.col("s_acctbal") < 0), F.lit(False)).cast("int").alias("exit_status"))


@query("SELECT o_custkey AS seed, count(DISTINCT md5(o_orderpriority)) AS outputs FROM orders GROUP BY ALL")
def a17_distinct_outputs(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("seed")).agg(F.count_distinct(F.md5(F.col("o_orderpriority").cast("binary"))).alias("outputs"))


@query("SELECT o_orderstatus AS verdict, count(*) AS n FROM orders GROUP BY ALL")
def a18_verdict_histogram(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("verdict")).agg(F.count("*").alias("n"))


@query("SELECT l_suppkey AS decoder, CAST(least(sum(CAST(l_quantity AS BIGINT)), 4294967295) AS BIGINT) AS fallbacks FROM lineitem GROUP BY ALL")
def a19_saturating_counter(spark, sf_dir):
    """Counters that stop at 32 bits, merged by addition."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("decoder")).agg(F.least(F.sum(F.col("l_quantity").cast("long")), F.lit(2**32 - 1)).alias("fallbacks"))


_H = "0.7071067811865476"
_S = "(1 / greatest(1.0::DOUBLE + " + _H + "::DOUBLE + " + _H + "::DOUBLE, 1.0))"


@query(f"""WITH v AS (SELECT vec_id, list_transform(embedding[1:6], lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) SELECT vec_id, round(e[1] * {_S} + e[3] * {_H} * {_S} + e[5] * {_H} * {_S}, 9) AS l, round(e[2] * {_S} + e[3] * {_H} * {_S} + e[6] * {_H} * {_S}, 9) AS r FROM v""")
def a20_downmix(spark, sf_dir):
    mixed = aggregates.downmix(F.slice("embedding", 1, 6), aggregates.SURROUND_51)
    return table(spark, sf_dir, "embeddings").select("vec_id", mixed.alias("m")).select("vec_id", F.round(F.col("m")[0], 9).alias("l"), F.round(F.col("m")[1], 9).alias("r"))


@query("""WITH m AS (SELECT o_orderkey AS input, o_totalprice / 50000 AS speed, CASE WHEN o_custkey % 2 = 0 THEN 2 ELSE 4 END AS fl, o_custkey % 5 <> 0 AS checked, o_custkey % 7 <> 0 AS complete, o_custkey % 11 AS frames, o_custkey % 23 = 0 AS capped, o_custkey % 29 AS streams, CASE WHEN o_custkey % 58 = 0 THEN 'x' END AS err FROM orders)
SELECT input, CASE WHEN streams = 0 THEN CASE WHEN err IS NOT NULL THEN 'ERROR' ELSE 'MISSING' END WHEN capped THEN 'CAPPED' WHEN frames = 0 THEN 'ERROR' WHEN NOT checked THEN 'UNCHECKED' WHEN NOT complete THEN CASE WHEN speed < fl THEN 'SLOW!' ELSE 'FAIL' END WHEN speed < fl THEN 'SLOW' ELSE 'ok' END AS verdict FROM m""")
def a21_benchmark_verdict(spark, sf_dir):
    c = F.col("o_custkey")
    v = aggregates.verdict(F.col("o_totalprice") / 50000, F.when(c % 2 == 0, 2).otherwise(4), c % 5 != 0, c % 7 != 0, c % 11, c % 23 == 0, c % 29, F.when(c % 58 == 0, "x"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("input"), v.alias("verdict"))


@query("""WITH a AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) SELECT conv_id, count(*) AS expected, count(*) FILTER (WHERE length(text) % 3 <> 0) AS matched, bool_and(length(text) % 3 <> 0) AS complete FROM a GROUP BY ALL""")
def a22_matched_frames(spark, sf_dir):
    """Frames whose hash equals the reference's at the same place; complete needs all."""
    c = table(spark, sf_dir, "conversations")
    other = c.withColumn("text", F.when(F.length("text") % 3 == 0, F.concat(F.lit("!"), "text")).otherwise(F.col("text")))
    a, b = (x.select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("frame_md5")) for x in (c, other))
    return compare.frame_sequences(a, b, "conv_id", "turn").select("conv_id", "expected", "matched", F.col("exact").alias("complete"))
