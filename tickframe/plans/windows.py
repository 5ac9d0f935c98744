"""Queries on window-shaped operators, sorts and limits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import intervals, ordered, stateful
from ..sources.tables import PACKETS_SQL, packets, table, values
from .registry import query

_GOLD = "(20, 2, -1, 'b'), (10, 1, 5, 'a'), (10, 3, 5, 'a'), (30, 4, -1, 'c')"


def _gold(spark):
    return values(spark, "pts, pos, duration, data", _GOLD).select(F.lit(0).alias("stream"), F.col("pts").cast("long"), F.col("pos").cast("long"), F.col("duration").cast("long"), "data")


_W01 = f"""SELECT stream, seq, us, CAST(CASE WHEN duration >= 0 THEN duration ELSE coalesce(lead(us) OVER (PARTITION BY stream ORDER BY us, seq) - us, -1) END AS BIGINT) AS duration FROM {PACKETS_SQL}"""


@query(_W01)
def w01_fill_durations(spark, sf_dir):
    p = packets(spark, sf_dir).select("stream", "seq", "us", F.coalesce("duration", F.lit(-1)).alias("duration"))
    return ordered.fill_durations(p, ["stream"], ["us", "seq"], pts="us")


@query(f"WITH p AS (SELECT stream, seq, kind, lag(kind) OVER (PARTITION BY stream ORDER BY us, seq) AS b, row_number() OVER (PARTITION BY stream ORDER BY us, seq) AS n FROM {PACKETS_SQL}) SELECT stream, seq, kind FROM p WHERE n = 1 OR kind <> b")
def w02_drop_adjacent(spark, sf_dir):
    """Repeats of the row just before go; repeats further off stay."""
    return ordered.drop_adjacent(packets(spark, sf_dir), ["stream"], ["us", "seq"], ["kind"]).select("stream", "seq", "kind")


@query(f"""WITH g(pts, pos, duration, data) AS (VALUES {_GOLD}), f AS (SELECT pts, pos, data, CAST(CASE WHEN duration >= 0 THEN duration ELSE coalesce(lead(pts) OVER (ORDER BY pts, pos) - pts, -1) END AS BIGINT) AS duration FROM g),
b AS (SELECT *, lag((pts, duration, data)) OVER (ORDER BY pts, pos) AS prev FROM f) SELECT CAST(pts AS BIGINT) AS pts, duration, data FROM b WHERE prev IS NULL OR prev <> (pts, duration, data)""")
def w02_golden_case(spark, sf_dir):
    """Fill, then drop: the order of the two matters."""
    filled = ordered.fill_durations(_gold(spark), ["stream"], ["pts", "pos"])
    return ordered.drop_adjacent(filled, ["stream"], ["pts", "pos"], ["pts", "duration", "data"]).select("pts", "duration", "data")


@query("""WITH c AS (SELECT conv_id AS file, turn, conv_id * 7 % 11 + turn * 10 AS s, CASE WHEN turn % 2 = 0 THEN NULL ELSE turn * 10 + 15 END AS e, 65 AS total FROM conversations),
f AS (SELECT *, coalesce(lead(s) OVER (PARTITION BY file ORDER BY turn), total) AS nx FROM c) SELECT file, turn, s AS start_s, CAST(coalesce(e, CASE WHEN nx >= s THEN nx END) AS BIGINT) AS end_s FROM f""")
def w03_chapter_ends(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), "turn", (F.col("conv_id") * 7 % 11 + F.col("turn") * 10).alias("start_s"), F.when(F.col("turn") % 2 != 0, F.col("turn") * 10 + 15).alias("end_s"), F.lit(65).cast("long").alias("total"))
    return ordered.fill_ends(c, ["file"], ["turn"], "start_s", "end_s", "total").drop("total")


@query(f"""WITH p AS (SELECT stream, seq, CASE WHEN seq % 4 = 0 THEN us END AS pts, us - 5000 AS packet_pts FROM {PACKETS_SQL}), i AS (SELECT *, count(pts) OVER w AS island, first_value(packet_pts) OVER w AS fp FROM p WINDOW w AS (PARTITION BY stream ORDER BY seq)),
n AS (SELECT *, row_number() OVER (PARTITION BY stream, island ORDER BY seq) - 1 AS n FROM i)
SELECT stream, seq, CAST(greatest(coalesce(max(pts) OVER (PARTITION BY stream, island), fp) + n * 40000, 0) AS BIGINT) AS time FROM n""")
def w04_frame_clock(spark, sf_dir):
    """Frame times with a constant duration."""
    p = packets(spark, sf_dir).select("stream", "seq", F.when(F.col("seq") % 4 == 0, F.col("us")).alias("pts"), (F.col("us") - 5000).alias("packet_pts"), F.lit(40000).cast("long").alias("duration"))
    return ordered.clock(p, ["stream"], ["seq"]).select("stream", "seq", "time")


@query(f"""WITH RECURSIVE p AS (SELECT stream, seq, CASE WHEN seq % 4 = 0 THEN us END AS pts, dts, duration, row_number() OVER (PARTITION BY stream ORDER BY seq) AS n FROM {PACKETS_SQL}),
f(stream, n, seq, time, step) AS (SELECT stream, n, seq, greatest(coalesce(pts, dts, 0), 0), CASE WHEN duration > 0 THEN duration END FROM p WHERE n = 1
UNION ALL SELECT p.stream, p.n, p.seq, greatest(coalesce(p.pts, f.time + coalesce(f.step, 0)), 0), CASE WHEN p.duration > 0 THEN p.duration ELSE f.step END FROM f JOIN p ON p.stream = f.stream AND p.n = f.n + 1)
SELECT stream, seq, CAST(time AS BIGINT) AS time FROM f""")
def w04_frame_clock_general(spark, sf_dir):
    p = packets(spark, sf_dir).select("stream", "seq", F.when(F.col("seq") % 4 == 0, F.col("us")).alias("pts"), F.col("dts").alias("packet_pts"), "duration")
    return stateful.clock(p)


@query(f"WITH p AS (SELECT stream, seq, md5(kind) AS md5, lag(kind) OVER (PARTITION BY stream ORDER BY us, seq) AS b, kind, row_number() OVER (PARTITION BY stream ORDER BY us, seq) AS n FROM {PACKETS_SQL} WHERE kind <> 'error') SELECT stream, seq, md5 FROM p WHERE n = 1 OR kind <> b")
def w05_collapse_states(spark, sf_dir):
    p = packets(spark, sf_dir).select("stream", "us", "seq", F.md5(F.col("kind").cast("binary")).alias("md5"), (F.col("kind") == "error").alias("blank"))
    return intervals.collapse_states(p, ["stream"], ["us", "seq"], "md5").select("stream", "seq", "md5")


@query("SELECT o_custkey, o_orderpriority, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) - 1 AS INTEGER) AS nth FROM orders")
def w06_nth_of_kind(spark, sf_dir):
    return ordered.nth_of_kind(table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey"), ["o_custkey", "o_orderpriority"], "o_orderkey")


@query("""WITH h AS (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE abs(s_acctbal) END AS xrt, CASE WHEN s_suppkey % 3 = 0 THEN 10 ELSE 4 END AS floor_ FROM supplier)
SELECT s_suppkey, CAST(rank() OVER (ORDER BY coalesce(xrt / floor_, 'infinity'::DOUBLE), s_suppkey) AS INTEGER) AS position FROM h""")
def w07_headroom_rank(spark, sf_dir):
    """Least headroom first; inputs without a measurement last."""
    from ..operators import selection

    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 5 != 0, F.abs("s_acctbal")).alias("xrt"), F.when(F.col("s_suppkey") % 3 == 0, 10).otherwise(4).alias("floor"))
    return selection.ranked(s, F.col("xrt") / F.col("floor"), "s_suppkey").select("s_suppkey", "position")


_PIC = "(SELECT user_id AS stream, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events)"
_PICS = f"(SELECT stream, seq, n // 8 AS period, (n % 8) + CASE (n % 8) % 4 WHEN 1 THEN 2 WHEN 2 THEN -1 WHEN 3 THEN -1 ELSE 0 END AS poc, n * 40 AS stamp FROM {_PIC})"


def _pictures(spark, sf_dir):
    n = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("seq"), n.alias("n"))
    m = F.col("n") % 8
    return e.select("stream", "seq", F.floor(F.col("n") / 8).cast("long").alias("period"), (m + F.when(m % 4 == 1, 2).when(m % 4 == 2, -1).when(m % 4 == 3, -1).otherwise(0)).cast("long").alias("poc"), (F.col("n") * 40).alias("stamp"))


@query(f"SELECT stream, seq, CAST(poc AS BIGINT) AS poc, CAST(row_number() OVER (PARTITION BY stream ORDER BY period, poc, seq) - 1 AS BIGINT) AS position FROM {_PICS}")
def w08_display_order(spark, sf_dir):
    """Places in display order.  ``stateful.display_order`` is the buffer of a given depth, which gives these where it is deep enough."""
    return ordered.display_positions(_pictures(spark, sf_dir), ["stream"], ["period", "poc", "seq"]).select("stream", "seq", "poc", "position")


@query(f"""WITH p AS (SELECT *, period * 8 + poc AS shown FROM {_PICS}), d AS (SELECT stream, seq, row_number() OVER (PARTITION BY stream ORDER BY shown, seq) + 2 AS slot FROM p),
s AS (SELECT stream, row_number() OVER (PARTITION BY stream ORDER BY seq) AS slot, stamp FROM p), e AS (SELECT stream, max(slot) AS slot, max(stamp) AS stamp, max(stamp) - max(CASE WHEN slot < m THEN stamp END) AS step FROM (SELECT *, max(slot) OVER (PARTITION BY stream) AS m FROM s) GROUP BY stream)
SELECT d.stream, d.seq, CAST(coalesce(s.stamp, e.stamp + coalesce(e.step, 0) * (d.slot - e.slot)) AS BIGINT) AS repaired FROM d LEFT JOIN s USING (stream, slot) JOIN e ON e.stream = d.stream""")
def w09_slots(spark, sf_dir):
    p = _pictures(spark, sf_dir).withColumn("shown", F.struct(F.col("period") * 8 + F.col("poc"), "seq"))
    return ordered.slots(p, ["stream"], "shown", "seq", "stamp", 2).select("stream", "seq", "repaired")


@query(f"""WITH p AS (SELECT stream, seq, period * 8 + poc AS poc, CASE WHEN stream % 3 = 0 THEN (period * 8 + poc) * 40 ELSE stamp END AS stamp FROM {_PICS}),
t AS (SELECT stream, seq, poc, stamp, max((poc, stamp)) OVER (PARTITION BY stream ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM p),
v AS (SELECT stream, seq, CASE WHEN poc < top[1] AND stamp > top[2] THEN 'Repair' WHEN poc < top[1] AND stamp < top[2] THEN 'Trust' END AS v FROM t)
SELECT stream, coalesce(arg_min(v, seq) FILTER (WHERE v IS NOT NULL), 'Undecided') AS verdict FROM v GROUP BY stream""")
def w10_order_verdict(spark, sf_dir):
    """Whether stamps are in decode order, by the first picture that tells."""
    shown = F.col("period") * 8 + F.col("poc")
    p = _pictures(spark, sf_dir).withColumn("poc", shown).withColumn("stamp", F.when(F.col("stream") % 3 == 0, F.col("poc") * 40).otherwise(F.col("stamp")))
    return ordered.decisive(p, ["stream"], "seq", "poc", "stamp")


@query(f"""WITH p AS (SELECT stream, seq, kind <> 'error' AS ok, sum(CASE WHEN kind <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY seq) AS g FROM {PACKETS_SQL}),
r AS (SELECT stream, seq, row_number() OVER (PARTITION BY stream, g ORDER BY seq) AS n FROM p WHERE NOT ok) SELECT stream, min(seq) AS retired_at FROM r WHERE n = 3 GROUP BY stream""")
def w11_refused_in_a_row(spark, sf_dir):
    p = packets(spark, sf_dir).select("stream", "seq", (F.col("kind") != "error").alias("ok"))
    return ordered.failures_in_a_row(p, ["stream"], ["seq"], "ok", 3)


@query(f"""WITH p AS (SELECT stream, seq, us, bytes FROM {PACKETS_SQL} WHERE us > {5 * 86_400_000_000}), n AS (SELECT *, max(us) OVER (PARTITION BY stream) AS newest FROM p), r AS (SELECT *, sum(bytes) OVER (PARTITION BY stream ORDER BY us DESC, seq DESC) AS total FROM n WHERE newest - us <= {3 * 86_400_000_000})
SELECT stream, seq, us, bytes FROM r WHERE total <= 20000""")
def w12_read_ahead(spark, sf_dir):
    p = packets(spark, sf_dir).select("stream", "seq", "us", "bytes").withColumn("now", F.lit(5 * 86_400_000_000))
    return ordered.read_ahead(p, ["stream"], "us", "now", 3 * 86_400_000_000, 20000).drop("now")


@query(f"SELECT stream, seq FROM (SELECT stream, seq, sum(bytes) OVER (PARTITION BY stream ORDER BY us, seq) AS total FROM {PACKETS_SQL}) WHERE total <= 50000")
def w13_cue_budget(spark, sf_dir):
    """Pending cues within a byte budget: those due last go."""
    return ordered.within_budget(packets(spark, sf_dir), ["stream"], [F.col("us"), F.col("seq")], "bytes", 50000).select("stream", "seq")


@query(f"""WITH s AS (SELECT stream, seq, us AS start_us, CASE WHEN kind = 'view' THEN us + duration * 1000 END AS end_us, kind = 'error' AS blank, lead(us) OVER (PARTITION BY stream ORDER BY us, seq) AS nx FROM {PACKETS_SQL})
SELECT stream, seq, start_us, least(coalesce(end_us, nx), coalesce(nx, end_us)) AS shown_until FROM s WHERE NOT blank""")
def w14_replacement(spark, sf_dir):
    s = packets(spark, sf_dir).select("stream", "seq", F.col("us").alias("start_us"), F.when(F.col("kind") == "view", F.col("us") + F.col("duration") * 1000).alias("end_us"), (F.col("kind") == "error").alias("blank"))
    return intervals.replaced(s, ["stream"])


@query("""WITH s AS (SELECT o_custkey AS paragraph, o_orderkey % 97 AS b, o_orderkey % 97 + o_orderkey % 13 AS e FROM orders), x AS (SELECT paragraph, unnest([10, 80, least(greatest(b, 10), 80), least(greatest(e, 10), 80)]) AS t FROM s), d AS (SELECT DISTINCT paragraph, t FROM x)
SELECT * FROM (SELECT paragraph, t AS begin_at, lead(t) OVER (PARTITION BY paragraph ORDER BY t) AS end_at FROM d) WHERE end_at IS NOT NULL""")
def w15_atomic_intervals(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("paragraph"), (F.col("o_orderkey") % 97).alias("begin"), (F.col("o_orderkey") % 97 + F.col("o_orderkey") % 13).alias("end"))
    return intervals.atomic(o.withColumn("p_begin", F.lit(10).cast("long")).withColumn("p_end", F.lit(80).cast("long")), ["paragraph"]).toDF("paragraph", "begin_at", "end_at")


@query("""WITH f AS (SELECT o_custkey AS stream, o_orderkey AS seq, 100 + o_orderkey % 50 AS samples, 120 AS skip, CASE WHEN o_custkey % 4 = 0 THEN 100000 ELSE 75 END AS pad FROM orders),
t AS (SELECT *, sum(samples) OVER (PARTITION BY stream ORDER BY seq) AS stop, sum(samples) OVER (PARTITION BY stream) AS total FROM f), k AS (SELECT *, stop - samples AS start, total - CASE WHEN pad <= total THEN pad ELSE 0 END AS until FROM t)
SELECT stream, seq, CAST(greatest(start, skip) - start AS BIGINT) AS from_sample, CAST(least(stop, until) - start AS BIGINT) AS to_sample FROM k WHERE least(stop, until) > greatest(start, skip)""")
def w16_audio_trim(spark, sf_dir):
    f = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("stream"), F.col("o_orderkey").alias("seq"), (100 + F.col("o_orderkey") % 50).alias("samples"), F.lit(120).cast("long").alias("skip"), F.when(F.col("o_custkey") % 4 == 0, 100000).otherwise(75).cast("long").alias("pad"))
    return intervals.trim(f, ["stream"], "seq").select("stream", "seq", "from_sample", "to_sample")


@query("SELECT l_partkey AS cue, l_returnflag AS property, arg_max(l_linestatus || l_quantity::INT, (l_linenumber, l_orderkey * 1000 + l_suppkey)) AS value FROM lineitem GROUP BY ALL")
def w17_cascade(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("cue"), F.col("l_returnflag").alias("property"), F.concat("l_linestatus", F.col("l_quantity").cast("int").cast("string")).alias("value"), F.col("l_linenumber").alias("specificity"), (F.col("l_orderkey") * 1000 + F.col("l_suppkey")).alias("position"))
    return ordered.cascade(d, ["cue"])


@query("""SELECT body, sid, CAST(start AS INTEGER) AS start, duration FROM (SELECT l_suppkey % 5 AS body, l_linenumber AS sid, l_partkey % 7 AS start, l_orderkey AS duration, row_number() OVER (PARTITION BY l_suppkey % 5, l_linenumber, l_partkey % 7 ORDER BY l_orderkey DESC) AS n FROM lineitem WHERE l_quantity > 10 OR l_tax > 0.02) WHERE n = 1""")
def w18_index_segments(spark, sf_dir):
    """Of index segments with equal keys the longest."""
    s = table(spark, sf_dir, "lineitem").filter("l_quantity > 10 OR l_tax > 0.02")
    return s.groupBy((F.col("l_suppkey") % 5).alias("body"), F.col("l_linenumber").alias("sid"), (F.col("l_partkey") % 7).cast("int").alias("start")).agg(F.max("l_orderkey").alias("duration")).orderBy("body", "sid", "start")


@query(f"SELECT stream, seq FROM (SELECT stream, seq, row_number() OVER (PARTITION BY stream ORDER BY us DESC, seq DESC) AS n FROM {PACKETS_SQL} WHERE us <= {15 * 86_400_000_000} AND us + coalesce(duration, 0) * 100000 > {15 * 86_400_000_000}) WHERE n <= 3")
def w19_concurrent_cap(spark, sf_dir):
    """Of the cues up at a moment at most three: those up longest go first."""
    from ..operators import selection

    moment = 15 * 86_400_000_000
    p = packets(spark, sf_dir).filter((F.col("us") <= moment) & (F.col("us") + F.coalesce("duration", F.lit(0)) * 100000 > moment))
    return selection.top(p, ["stream"], [F.col("us").desc(), F.col("seq").desc()], 3).select("stream", "seq")


@query(f"WITH o AS (SELECT stream, seq, n, CASE n % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS off FROM {_PIC}) SELECT stream, seq, CAST(n + off AS BIGINT) AS pts, CAST(-max(off) OVER (PARTITION BY stream) AS BIGINT) AS first_dts FROM o")
def w20_temporal_offsets(spark, sf_dir):
    n = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("seq"), n.alias("n")).withColumn("off", F.when(F.col("n") % 3 == 0, 1).when(F.col("n") % 3 == 1, -1).otherwise(0).cast("long"))
    return e.select("stream", "seq", (F.col("n") + F.col("off")).alias("pts"), (-F.max("off").over(Window.partitionBy("stream"))).alias("first_dts"))


@query(f"""WITH c AS (SELECT stream, seq, us, kind = 'error' AS blank, lead(us) OVER w AS nx, lead(kind = 'error') OVER w AS nb FROM {PACKETS_SQL} WINDOW w AS (PARTITION BY stream ORDER BY seq)),
k AS (SELECT stream, seq, us, CASE WHEN nb THEN nx - us ELSE -1 END AS d FROM c WHERE NOT blank) SELECT stream, seq, us, CAST(CASE WHEN d >= 0 THEN d ELSE coalesce(lead(us) OVER (PARTITION BY stream ORDER BY us, seq) - us, -1) END AS BIGINT) AS duration FROM k""")
def w21_blank_closes(spark, sf_dir):
    """An empty cue ends the one before it; other unknown ends are filled afterwards."""
    w = Window.partitionBy("stream").orderBy("seq")
    p = packets(spark, sf_dir).withColumn("blank", F.col("kind") == "error").withColumn("next_us", F.lead("us").over(w)).withColumn("next_blank", F.lead("blank").over(w))
    kept = p.filter("NOT blank").select("stream", "seq", "us", F.when(F.col("next_blank"), F.col("next_us") - F.col("us")).otherwise(F.lit(-1)).alias("duration"))
    return ordered.fill_durations(kept, ["stream"], ["us", "seq"], pts="us")


@query(f"""WITH d AS (SELECT stream, seq, us, kind, coalesce(lead(us) OVER (PARTITION BY stream ORDER BY us, seq) - us, -1) AS duration FROM {PACKETS_SQL}), b AS (SELECT *, lag((duration, kind)) OVER (PARTITION BY stream ORDER BY us, seq) AS prev FROM d)
SELECT stream, seq, us, duration, kind FROM b WHERE prev IS NULL OR prev <> (duration, kind)""")
def w22_durations_overwritten(spark, sf_dir):
    """The variant that overwrites every duration with the distance to the next cue."""
    p = packets(spark, sf_dir).select("stream", "seq", "us", "kind").withColumn("duration", F.lit(-1).cast("long"))
    filled = ordered.fill_durations(p, ["stream"], ["us", "seq"], pts="us")
    return ordered.drop_adjacent(filled, ["stream"], ["us", "seq"], ["duration", "kind"])


@query(f"SELECT stream, seq, us, CAST(row_number() OVER (PARTITION BY stream ORDER BY us, seq) AS INTEGER) AS place FROM {PACKETS_SQL}")
def o01_stable_order(spark, sf_dir):
    """O01 to O03: a stable order is an order with the place of arrival as its last key."""
    return packets(spark, sf_dir).select("stream", "seq", "us", F.row_number().over(Window.partitionBy("stream").orderBy("us", "seq")).alias("place"))


@query(f"SELECT stream, seq FROM (SELECT stream, seq, row_number() OVER (PARTITION BY stream ORDER BY seq) AS n FROM {PACKETS_SQL}) WHERE n <= 64")
def o04_cap(spark, sf_dir):
    from ..operators import selection

    return selection.top(packets(spark, sf_dir), ["stream"], [F.col("seq")], 64).select("stream", "seq")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 20")
def o05_first_failures(spark, sf_dir):
    """The first twenty failures."""
    return table(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", "user_id").orderBy("event_id").limit(20)


@query(f"SELECT stream, us FROM (SELECT stream, us, row_number() OVER (PARTITION BY stream ORDER BY us) - 1 AS i, count(*) OVER (PARTITION BY stream) AS n FROM {PACKETS_SQL}) WHERE i % 2 = 0 OR i = n - 1")
def o06_decimate(spark, sf_dir):
    return ordered.decimate(packets(spark, sf_dir).select("stream", "us"), ["stream"], "us", keep_last=True)


@query("SELECT o_custkey AS stream, date_diff('day', TIMESTAMP '1990-01-01', o_orderdate) // 30 AS at, max(o_orderkey) AS seq, arg_max(o_orderpriority, o_orderkey) AS payload FROM orders GROUP BY ALL")
def o07_upsert(spark, sf_dir):
    """An index entry with an equal time replaces the one before."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("stream"), F.expr("timestampdiff(DAY, TIMESTAMP_NTZ'1990-01-01 00:00:00', o_orderdate) div 30").alias("at"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("payload"))
    return ordered.last_write(o, ["stream", "at"], "seq", "payload")
