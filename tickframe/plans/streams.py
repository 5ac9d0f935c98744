"""Batch forms of the streaming semantics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import asof, timeline
from ..sources.tables import PACKETS_SQL, packets, table
from .registry import query


@query(f"SELECT stream, seq, pts, CAST(row_number() OVER (PARTITION BY stream ORDER BY pts, seq) AS INTEGER) AS released FROM {PACKETS_SQL} WHERE pts IS NOT NULL")
def r01_release_order(spark, sf_dir):
    """The order in which waiting batches are released: by time, then arrival."""
    return timeline.release_order(packets(spark, sf_dir), ["stream"], "pts", "seq").select("stream", "seq", "pts", "released")


@query(f"WITH u AS (SELECT stream, seq, dts FROM {PACKETS_SQL} WHERE pts IS NULL) SELECT stream, seq, lead(dts) OVER (PARTITION BY stream ORDER BY seq) AS at FROM u")
def r02_untimed(spark, sf_dir):
    """An untimed batch takes the decode time of the next untimed packet; the last has none."""
    return timeline.untimed(packets(spark, sf_dir), ["stream"], "seq").select("stream", "seq", "at")


@query(f"SELECT stream, count(*) AS flushed, arg_max(seq, (pts, seq)) AS last FROM {PACKETS_SQL} WHERE pts IS NOT NULL GROUP BY ALL")
def r03_flush(spark, sf_dir):
    """All that waits at the end is released in order."""
    return packets(spark, sf_dir).filter("pts IS NOT NULL").groupBy("stream").agg(F.count("*").alias("flushed"), F.max_by("seq", F.struct("pts", "seq")).alias("last"))


@query(f"SELECT stream, seq FROM {PACKETS_SQL} WHERE NOT coalesce(us + (seq % 200) * 1000 > pts + 100000, false) AND coalesce(pts <= 2000000000000, true)")
def r04_late_frames(spark, sf_dir):
    """Frames no more than 100 ms behind the clock and within the limit after the end."""
    p = packets(spark, sf_dir).withColumn("clock", F.col("us") + (F.col("seq") % 200) * 1000)
    return timeline.on_time(p, F.col("clock"), F.col("pts"), 100_000, 2_000_000_000_000).select("stream", "seq")


@query(f"""WITH p AS (SELECT stream, seq, us, kind IN ('error', 'view') AS late FROM {PACKETS_SQL}), g AS (SELECT *, sum(CASE WHEN late THEN 0 ELSE 1 END) OVER (PARTITION BY stream ORDER BY us, seq) AS g FROM p)
SELECT stream, min(us) AS since, max(us) AS until FROM g WHERE late GROUP BY stream, g HAVING max(us) - min(us) >= 250000""")
def r05_sustained_lateness(spark, sf_dir):
    """Runs of late frames that last for at least 250 ms."""
    p = packets(spark, sf_dir).withColumn("late", F.col("kind").isin("error", "view"))
    return timeline.runs(p, ["stream"], ["us", "seq"], F.col("late"), "us", 250_000)


@query(f"""WITH RECURSIVE p AS (SELECT stream, us // 3600000000 AS t, row_number() OVER (PARTITION BY stream ORDER BY seq) AS n FROM {PACKETS_SQL}),
f(stream, n, trusted, horizon) AS (SELECT stream, n, t, t FROM p WHERE n = 1 UNION ALL SELECT p.stream, p.n, CASE WHEN p.t <= f.trusted + 10 THEN greatest(f.trusted, p.t) ELSE f.trusted END, greatest(f.horizon, p.t) FROM f JOIN p ON p.stream = f.stream AND p.n = f.n + 1)
SELECT stream, arg_max(trusted, n) AS trusted_end, arg_max(horizon, n) AS horizon FROM f GROUP BY stream""")
def r06_trusted_end(spark, sf_dir):
    """A packet that ends far beyond what is trusted moves the horizon but not the trusted end."""
    p = packets(spark, sf_dir).select("stream", "seq", F.expr("us div 3600000000").alias("t"))
    return timeline.trusted_end(p, ["stream"], "seq", "t", 10)


@query(f"SELECT stream, span >= 5000000 OR bytes > 8192 AS full_ FROM (SELECT stream, greatest(arg_max(us, seq) - arg_min(us, seq), 0) AS span, sum(bytes) AS bytes FROM {PACKETS_SQL} GROUP BY stream)")
def r08_lane_full(spark, sf_dir):
    """Backpressure: a lane is full by span or by bytes."""
    from ..operators import aggregates

    return aggregates.lane_span(packets(spark, sf_dir), ["stream"], "seq", "us", "bytes").select("stream", ((F.col("span") >= 5_000_000) | (F.col("bytes") > 8192)).alias("full_"))


@query("SELECT conv_id AS session, turn AS seq FROM (SELECT conv_id, turn, turn // 2 AS gen, max(turn // 2) OVER (PARTITION BY conv_id) AS newest FROM conversations) WHERE gen = newest")
def r09_seek_generation(spark, sf_dir):
    """Only rows of the newest seek generation count."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.expr("turn div 2").alias("gen"))
    return timeline.newest(c, ["session"], "gen").select("session", "seq")


@query(f"""WITH t AS (SELECT stream, max(us) - 3600000000 AS target FROM {PACKETS_SQL} GROUP BY stream), l AS (SELECT t.stream, target, max(us) FILTER (WHERE keyframe) AS k, max(us) AS any_ FROM t JOIN {PACKETS_SQL} p ON p.stream = t.stream AND us <= target GROUP BY ALL)
SELECT stream, target, CASE WHEN k > target - 600000000000 THEN k ELSE any_ END AS landed FROM l""")
def r10_walk_back(spark, sf_dir):
    """The last random access point within the look-back, else where the seek first landed."""
    p = packets(spark, sf_dir)
    t = p.groupBy("stream").agg((F.max("us") - 3_600_000_000).alias("target"))
    return timeline.walk_back(t, p, ["stream"], "us", 600_000_000_000)


@query(f"""WITH p AS (SELECT stream, seq, us, keyframe, us >= 864000000000 AS past FROM {PACKETS_SQL}), c AS (SELECT *, sum(CASE WHEN past AND NOT keyframe THEN 1 ELSE 0 END) OVER w AS n, sum(CASE WHEN past AND keyframe THEN 1 ELSE 0 END) OVER w AS k FROM p WINDOW w AS (PARTITION BY stream ORDER BY us, seq))
SELECT stream, seq FROM c WHERE n <= 3 AND (k = 0 OR (k = 1 AND past AND keyframe))""")
def r13_read_on(spark, sf_dir):
    """Reading on stops behind the first key packet past the target or after so many others."""
    p = packets(spark, sf_dir).withColumn("past", F.col("us") >= 864_000_000_000)
    return timeline.read_on(p, ["stream"], ["us", "seq"], 3).select("stream", "seq")


@query(f"""SELECT stream, seq, CASE WHEN seq % 50 = 0 THEN 'Abort' WHEN seq % 31 = 0 THEN 'Resync' WHEN lag_ > 100 THEN 'Late' WHEN caught THEN 'CaughtUp' ELSE 'Now' END AS disposition FROM (SELECT stream, seq, bytes % 200 AS lag_, kind = 'view' AS caught FROM {PACKETS_SQL})""")
def r15_disposition(spark, sf_dir):
    """What becomes of a frame, in order of the tests."""
    p = packets(spark, sf_dir)
    return p.select("stream", "seq", timeline.disposition(F.col("seq") % 50 == 0, F.col("seq") % 31 == 0, F.col("bytes") % 200 > 100, F.col("kind") == "view").alias("disposition"))


@query(f"SELECT stream, seq, CASE WHEN kind = 'error' THEN us - 7 WHEN kind = 'view' THEN us - 3 ELSE us END AS position FROM {PACKETS_SQL} WHERE seq % 3 > 0")
def r16_position(spark, sf_dir):
    """The position comes from the frozen value while held, else the audio clock if it leads, else the free clock; stale seeks don't count."""
    p = packets(spark, sf_dir).filter("seq % 3 > 0")
    return p.select("stream", "seq", F.coalesce(F.when(F.col("kind") == "error", F.col("us") - 7), F.when(F.col("kind") == "view", F.col("us") - 3), F.col("us")).alias("position"))


@query(f"SELECT stream, seq, us AS start_us, lead(us) OVER (PARTITION BY stream ORDER BY us, seq) AS end_us FROM {PACKETS_SQL} WHERE kind <> 'view'")
def r17_screen_states(spark, sf_dir):
    """Screens shown as they change, given the end at which the next one replaces them."""
    w = Window.partitionBy("stream").orderBy("us", "seq")
    return packets(spark, sf_dir).filter("kind <> 'view'").select("stream", "seq", F.col("us").alias("start_us"), F.lead("us").over(w).alias("end_us"))


@query("""WITH k AS (SELECT doc_id AS stream, unnest(range(0, n_chars, 188)) AS place FROM documents), u AS (SELECT doc_id AS stream, unnest(range(0, n_chars, 301)) AS place FROM documents)
SELECT u.stream, u.place, k.place * 10 AS pts FROM u ASOF LEFT JOIN k ON u.stream = k.stream AND u.place >= k.place""")
def r18_unit_framing(spark, sf_dir):
    """A unit has the time of the chunk that holds its first byte."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("stream"), "n_chars").filter("n_chars > 0")
    cut = lambda step: d.select("stream", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chars") - 1, F.lit(step).cast("long"))).alias("place"))
    return asof.asof(cut(301), cut(188).withColumn("pts", F.col("place") * 10), ["stream"], "place", ["pts"], span=1 << 16)


@query()
def r01_release_machine(spark, sf_dir):
    """The data-driven release with its bounded queue, as a fold."""
    from ..streaming import machines

    p = packets(spark, sf_dir).select("stream", "seq", F.col("pts").alias("ts"), "dts", F.col("bytes").alias("size"))
    return machines.run_batch(p, "stream", "seq", machines.release)


_GO = "((primed AND horizon >= CASE WHEN lowest IS NULL THEN now + 1000000 ELSE greatest(lowest, now + 2500000) END) OR (full_ AND (primed OR starved)))"


@query(f"""WITH RECURSIVE p AS (SELECT stream, seq, us AS now, us + bytes * 1000 AS horizon, kind = 'error' AS starved, bytes % 2 = 0 AS source, kind <> 'view' AS primed, bytes > 9000 AS full_, row_number() OVER (PARTITION BY stream ORDER BY seq) AS n FROM {PACKETS_SQL}),
f(stream, n, seq, held, lowest, action) AS (SELECT DISTINCT stream, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), true, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM p
UNION ALL SELECT p.stream, p.n, p.seq, CASE WHEN held THEN NOT {_GO} ELSE starved AND source END, CASE WHEN held AND NOT {_GO} THEN lowest WHEN NOT held AND starved AND source THEN now + 2500000 END,
 CASE WHEN held AND {_GO} THEN 'play' WHEN NOT held AND starved AND source THEN 'hold' END FROM f JOIN p ON p.stream = f.stream AND p.n = f.n + 1)
SELECT stream, seq, action FROM f WHERE action IS NOT NULL""")
def r07_buffering(spark, sf_dir):
    """When playback holds and goes on: starved before the end, and far enough ahead again."""
    from ..streaming import machines

    p = packets(spark, sf_dir)
    rows = p.select(
        "stream", "seq", F.col("us").alias("now"), (F.col("us") + F.col("bytes") * 1000).alias("horizon"), (F.col("kind") == "error").alias("starved"), (F.col("bytes") % 2 == 0).alias("source_starved"),
        F.lit(False).alias("eof"), (F.col("kind") != "view").alias("primed"), (F.col("bytes") > 9000).alias("full"),
    )
    return machines.run_batch(rows, "stream", "seq", machines.buffering)


@query(f"""WITH p AS (SELECT stream, seq, keyframe, bytes % 3 AS track, CASE WHEN keyframe THEN bytes % 3 END AS sel FROM {PACKETS_SQL}), s AS (SELECT *, last_value(sel IGNORE NULLS) OVER (PARTITION BY stream ORDER BY seq) AS playing FROM p)
SELECT stream, seq, track FROM s WHERE NOT keyframe AND track = playing""")
def r11_selection_switch(spark, sf_dir):
    """Packets of the track chosen last; ``machines.selection`` is the same over a stream."""
    p = packets(spark, sf_dir).select("stream", "seq", F.when(F.col("keyframe"), F.col("bytes") % 3).alias("select"), (F.col("bytes") % 3).alias("track"))
    return timeline.selected(p, ["stream"], "seq", "select", "track").select("stream", "seq", "track")
