"""Queries on join-shaped operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, compare, rules
from ..sources.tables import PACKETS_SQL, packets, table, values
from .registry import query

DAY = 86_400_000_000
_T = f"(SELECT stream, seq, us FROM {PACKETS_SQL} WHERE kind = 'purchase')"
_K = f"(SELECT stream, seq AS pos, us FROM {PACKETS_SQL} WHERE keyframe)"


def _targets(spark, sf_dir):
    return packets(spark, sf_dir).filter("kind = 'purchase'").select("stream", "seq", "us")


def _keys(spark, sf_dir):
    return packets(spark, sf_dir).filter("keyframe").select("stream", F.col("seq").alias("pos"), "us")


@query(f"SELECT t.stream, t.seq, t.us, k.pos FROM {_T} t ASOF LEFT JOIN {_K} k ON t.stream = k.stream AND t.us >= k.us")
def j01_asof_backward(spark, sf_dir):
    """Seek landing: the last key packet at or before each target."""
    return asof.asof(_targets(spark, sf_dir), _keys(spark, sf_dir), ["stream"], "us", ["pos"], backward=True, span=DAY)


@query(f"SELECT t.stream, t.seq, t.us, k.pos FROM {_T} t ASOF LEFT JOIN {_K} k ON t.stream = k.stream AND t.us <= k.us")
def j02_asof_forward(spark, sf_dir):
    return asof.asof(_targets(spark, sf_dir), _keys(spark, sf_dir), ["stream"], "us", ["pos"], backward=False, span=DAY)


_TIED = f"(SELECT stream, seq, us // 3600000000 AS hour FROM {PACKETS_SQL})"


@query(f"""WITH p AS {_TIED}, t AS (SELECT * FROM p WHERE seq % 3 = 0), k AS (SELECT * FROM p WHERE seq % 3 = 1)
SELECT t.stream, t.seq, t.hour, (SELECT max_by(k.seq, (k.hour, k.seq)) FROM k WHERE k.stream = t.stream AND k.hour <= t.hour) AS back,
 (SELECT min_by(k.seq, (k.hour, k.seq)) FROM k WHERE k.stream = t.stream AND k.hour >= t.hour) AS fore FROM t""")
def j03_asof_ties(spark, sf_dir):
    """Equal ticks match in both directions; among equal ones the order of arrival decides."""
    p = packets(spark, sf_dir).select("stream", "seq", F.floor(F.col("us") / 3_600_000_000).cast("long").alias("hour"))
    t, k = p.filter("seq % 3 = 0"), p.filter("seq % 3 = 1")
    one = asof.asof(t, k.withColumn("back", F.col("seq")), ["stream"], "hour", ["back"], True, 24, tie="back")
    return asof.asof(one, k.withColumn("fore", F.col("seq")), ["stream"], "hour", ["fore"], False, 24, tie="fore")


@query(f"""SELECT t.stream, t.seq, t.us, a.us AS lower, b.us AS upper FROM {_T} t ASOF LEFT JOIN {_K} a ON t.stream = a.stream AND t.us >= a.us
ASOF LEFT JOIN {_K} b ON t.stream = b.stream AND t.us <= b.us""")
def j04_index_bounds(spark, sf_dir):
    """Index entries on both sides of each target."""
    return asof.bounds(_targets(spark, sf_dir), _keys(spark, sf_dir), ["stream"], "us", "us", span=DAY)


@query("""WITH o AS (SELECT o_custkey AS stream, o_orderkey AS pos, date_diff('day', TIMESTAMP '1990-01-01', o_orderdate) AS frame FROM orders),
e AS (SELECT stream, frame, max(pos) AS pos FROM o WHERE pos % 2 = 0 GROUP BY ALL), w AS (SELECT stream, pos AS seq, frame FROM o WHERE pos % 2 = 1)
SELECT w.stream, w.seq, w.frame, e.pos AS entry FROM w ASOF LEFT JOIN e ON w.stream = e.stream AND w.frame >= e.frame""")
def j05_table_lookup(spark, sf_dir):
    """A packet table searched by frame number: the last entry at or before it."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("stream"), F.col("o_orderkey").alias("pos"), F.expr("timestampdiff(DAY, TIMESTAMP_NTZ'1990-01-01 00:00:00', o_orderdate)").alias("frame"))
    entries = o.filter("pos % 2 = 0").withColumn("entry", F.col("pos"))
    return asof.asof(o.filter("pos % 2 = 1").select("stream", F.col("pos").alias("seq"), "frame"), entries, ["stream"], "frame", ["entry"], tie="entry", span=365)


@query(f"""WITH t AS (SELECT stream, min(us) + (max(us) - min(us)) * f // 4 AS target FROM {PACKETS_SQL}, (VALUES (0), (1), (2), (3), (4)) v(f) GROUP BY stream, f)
SELECT t.stream, t.target, p.seq AS landed FROM t ASOF LEFT JOIN {PACKETS_SQL} p ON t.stream = p.stream AND t.target >= p.us""")
def j06_interpolated_search(spark, sf_dir):
    """What a bisection over byte positions finds: the last packet at or before a target."""
    p = packets(spark, sf_dir)
    t = p.groupBy("stream").agg(F.min("us").alias("lo"), F.max("us").alias("hi")).select("stream", "lo", "hi", F.explode(F.array(*map(F.lit, range(5)))).alias("f")).select("stream", F.expr("lo + ((hi - lo) * f) div 4").alias("target"))
    return asof.asof(t, p.select("stream", F.col("us").alias("target"), F.col("seq").alias("landed")), ["stream"], "target", ["landed"], span=DAY)


@query("""WITH a AS (SELECT o_custkey AS file, o_orderpriority AS kind, o_orderkey AS track, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS nth FROM orders WHERE o_orderstatus <> 'P'),
b AS (SELECT o_custkey AS file, o_orderpriority AS kind, o_orderkey AS other, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS nth FROM orders WHERE o_orderstatus <> 'O'),
n AS (SELECT coalesce(x.file, y.file) AS file, coalesce(x.kind, y.kind) AS kind, coalesce(x.n, 0) = coalesce(y.n, 0) AS same FROM (SELECT file, kind, count(*) n FROM a GROUP BY ALL) x FULL JOIN (SELECT file, kind, count(*) n FROM b GROUP BY ALL) y ON x.file = y.file AND x.kind = y.kind)
SELECT n.file, n.kind, CASE WHEN same THEN CAST(a.nth - 1 AS INTEGER) END AS nth, CASE WHEN same THEN track END AS track, CASE WHEN same THEN other END AS other, NOT same AS error
FROM n LEFT JOIN a ON same AND a.file = n.file AND a.kind = n.kind LEFT JOIN b ON same AND b.file = a.file AND b.kind = a.kind AND b.nth = a.nth""")
def j07_ordinal_join(spark, sf_dir):
    """The n-th track of a kind goes with the n-th stream of that kind; lists of different lengths are an error."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderpriority").alias("kind"), "o_orderkey", "o_orderstatus")
    a = o.filter("o_orderstatus <> 'P'").select("file", "kind", F.col("o_orderkey").alias("track"))
    b = o.filter("o_orderstatus <> 'O'").select("file", "kind", F.col("o_orderkey").alias("other"))
    return compare.ordinal_join(a, b, ["file", "kind"], "track", "other")


_FR = "(SELECT conv_id AS stream, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, md5(CASE WHEN {} THEN upper(text) ELSE text END) AS frame_md5 FROM conversations WHERE {})"


@query(f"""WITH a AS {_FR.format('false', 'true')}, b AS {_FR.format('conv_id % 3 = 0 AND turn = 1', 'NOT (conv_id % 5 = 0 AND turn = 1)')}
SELECT coalesce(a.stream, b.stream) AS stream, count(a.i) AS frames, count(b.i) AS expected, count(*) FILTER (WHERE a.frame_md5 = b.frame_md5) AS matched,
 count(a.i) = count(b.i) AND bool_and(coalesce(a.frame_md5 = b.frame_md5, false)) AS exact, CAST(min(CASE WHEN a.frame_md5 IS DISTINCT FROM b.frame_md5 THEN coalesce(a.i, b.i) END) AS BIGINT) AS first_different
FROM a FULL JOIN b ON a.stream = b.stream AND a.i = b.i GROUP BY ALL""")
def j08_frame_sequences(spark, sf_dir):
    """Frame hashes compared in order: counts, matches and the first difference."""
    c = table(spark, sf_dir, "conversations")
    a = c.select(F.col("conv_id").alias("stream"), "turn", F.md5(F.col("text").cast("binary")).alias("frame_md5"))
    changed = F.when((F.col("conv_id") % 3 == 0) & (F.col("turn") == 1), F.upper("text")).otherwise(F.col("text"))
    b = c.filter(~((F.col("conv_id") % 5 == 0) & (F.col("turn") == 1))).select(F.col("conv_id").alias("stream"), "turn", F.md5(changed.cast("binary")).alias("frame_md5"))
    return compare.frame_sequences(a, b, "stream", "turn")


_CUE = "(SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) + {} AS start_us, upper(event_type) AS text FROM events)"


@query(f"""WITH a AS {_CUE.format('event_id % 700')}, b AS {_CUE.format(0)}
SELECT coalesce(a.stream, b.stream) AS stream, count(a.i) = count(b.i) AS same_count, count(*) FILTER (WHERE (a.start_us + 500) // 1000 <> (b.start_us + 500) // 1000) AS late, count(*) FILTER (WHERE a.text <> b.text) AS different_texts
FROM a FULL JOIN b ON a.stream = b.stream AND a.i = b.i GROUP BY ALL""")
def j09_cue_sequences(spark, sf_dir):
    """Text cues compared in order: count, times in milliseconds, texts."""
    p = packets(spark, sf_dir)
    a = p.select("stream", "us", "seq", (F.col("us") + F.col("seq") % 700).alias("start_us"), F.upper("kind").alias("text"))
    b = p.select("stream", "us", "seq", F.col("us").alias("start_us"), F.upper("kind").alias("text"))
    return compare.cue_sequences(a, b, "stream", ["us", "seq"])


@query(f"""WITH p AS (SELECT stream, row_number() OVER (PARTITION BY stream ORDER BY us, seq) - 1 AS i, us AS s, us + duration AS e FROM {PACKETS_SQL}), q AS (SELECT stream, i, s + 300 AS s, CASE WHEN i % 2 = 0 THEN e END AS e FROM p)
SELECT p.stream, count(*) AS cues, count(*) FILTER (WHERE (p.s + 500) // 1000 = (q.s + 500) // 1000 AND (p.e IS NULL OR q.e IS NULL OR (p.e + 500) // 1000 = (q.e + 500) // 1000)) AS same FROM p JOIN q ON p.stream = q.stream AND p.i = q.i GROUP BY ALL""")
def j10_bitmap_cues(spark, sf_dir):
    """Bitmap cues: starts equal in milliseconds, ends only where both have one."""
    p = packets(spark, sf_dir).select("stream", "us", "seq", F.col("us").alias("start_us"), (F.col("us") + F.col("duration")).alias("end_us"))
    return compare.bitmap_cues(p, p.withColumn("start_us", F.col("start_us") + 300), "stream", ["us", "seq"])


@query("""WITH r(row_name, kind, ids, prefix) AS (VALUES ('kind:mail', 'a', ['promo', 'spam'], NULL), ('kind:five', 'b', ['5-LOW'], NULL), ('kind:urgent', 'b', ['1-URGENT', '2-HIGH'], NULL), ('kind:spec', 'b', [], '4-NOT'))
SELECT r.row_name, o_orderkey AS stream FROM orders JOIN r ON r.kind = 'b' AND (list_contains(r.ids, o_orderpriority) OR (r.prefix IS NOT NULL AND starts_with(o_orderpriority, r.prefix)))""")
def j11_rule_join(spark, sf_dir):
    """Rows of a rubric and the streams their rules match: by kind, by a list of ids, or by a prefix."""
    r = values(spark, "row_name, kind, ids, prefix", "('kind:mail', 'a', array('promo', 'spam'), NULL), ('kind:five', 'b', array('5-LOW'), NULL), ('kind:urgent', 'b', array('1-URGENT', '2-HIGH'), NULL), ('kind:spec', 'b', array(), '4-NOT')")
    streams = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("stream"), F.lit("b").alias("kind"), F.col("o_orderpriority").alias("codec"))
    return rules.match(streams, r).select("row_name", "stream")


@query("SELECT n_name AS row_name, count(c_custkey) AS claims FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 9000) ON c_nationkey = n_nationkey GROUP BY ALL")
def j12_rollup_base(spark, sf_dir):
    """Every row of the rubric appears, with or without claims."""
    claims = table(spark, sf_dir, "customer").filter("c_acctbal > 9000").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "nation").join(claims, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("n_name").alias("row_name"), F.coalesce("n", F.lit(0)).alias("claims"))


@query("SELECT n_name AS row_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def j13_without_rule(spark, sf_dir):
    """Rows of the rubric that no rule covers."""
    covered = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey"))
    return table(spark, sf_dir, "nation").join(covered, F.col("n_nationkey") == F.col("s_nationkey"), "left_anti").select(F.col("n_name").alias("row_name"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def j14_claimed(spark, sf_dir):
    """Rows claimed anywhere."""
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT p_brand AS codec, coalesce(list_sort(list(l_orderkey) FILTER (l_orderkey IS NOT NULL)), []) AS inputs FROM (SELECT p_brand, min(p_partkey) AS k FROM part GROUP BY ALL) LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 25) ON l_partkey = k GROUP BY ALL")
def j15_codec_coverage(spark, sf_dir):
    """Each codec with the inputs measured for it, possibly none."""
    codecs = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("k"))
    inputs = table(spark, sf_dir, "lineitem").filter("l_quantity > 25").select("l_partkey", "l_orderkey")
    return codecs.join(inputs, F.col("l_partkey") == F.col("k"), "left").groupBy(F.col("p_brand").alias("codec")).agg(F.sort_array(F.collect_list("l_orderkey")).alias("inputs"))


@query(f"""WITH c AS (SELECT stream, seq, us AS s, us + duration * 200000 AS e FROM {PACKETS_SQL} WHERE duration > 0)
SELECT a.stream, a.seq AS a, b.seq AS b FROM c a JOIN c b ON a.stream = b.stream AND a.seq < b.seq AND a.s < b.e AND b.s < a.e""")
def j16_overlap(spark, sf_dir):
    """Cues of a stream that share the screen."""
    from ..operators import intervals

    c = packets(spark, sf_dir).filter("duration > 0").select("stream", "seq", F.col("us").alias("start_us"), (F.col("us") + F.col("duration") * 200000).alias("end_us"))
    return intervals.overlaps(c, ["stream"], "seq", width=3_600_000_000)


@query(f"""WITH RECURSIVE p AS (SELECT stream, seq, pts, coalesce(duration, 0) AS d, row_number() OVER (PARTITION BY stream ORDER BY seq) - 1 AS i FROM {PACKETS_SQL} WHERE dts IS NOT NULL),
e AS (SELECT stream, list(seq ORDER BY i) AS seqs, list(stop ORDER BY i) AS stops FROM (SELECT *, CAST(sum(d) OVER (PARTITION BY stream ORDER BY i) AS BIGINT) AS stop FROM p) GROUP BY stream),
h AS (SELECT stream, pts, min(i) AS hit FROM p WHERE pts IS NOT NULL GROUP BY ALL),
f AS (SELECT p.stream, seq AS frame, i AS n, hit, d // 2 AS lasts FROM p LEFT JOIN h ON h.stream = p.stream AND h.pts = CASE WHEN seq % 4 <> 0 THEN p.pts END),
r(stream, n, frame, i, used_up) AS (SELECT DISTINCT stream, CAST(-1 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM p
UNION ALL SELECT f.stream, f.n, f.frame, coalesce(hit, list_min(list_filter(range(r.i, len(stops)), lambda k: stops[k + 1] > r.used_up)), len(stops) - 1),
 lasts + CASE WHEN hit IS NULL THEN r.used_up WHEN hit = 0 THEN 0 ELSE stops[hit] END FROM r JOIN f ON f.stream = r.stream AND f.n = r.n + 1 JOIN e ON e.stream = f.stream)
SELECT r.stream, frame, seqs[i + 1] AS packet FROM r JOIN e ON e.stream = r.stream WHERE frame IS NOT NULL""")
def j17_frame_packets(spark, sf_dir):
    """Decoded frames and the packets they come from: by time, else the packet whose duration they use up."""
    from ..operators import stateful

    p = packets(spark, sf_dir).filter("dts IS NOT NULL").select("stream", "seq", "pts", F.coalesce("duration", F.lit(0).cast("long")).alias("duration"))
    frames = p.select("stream", F.col("seq").alias("frame"), F.when(F.col("seq") % 4 != 0, F.col("pts")).alias("pts"), (F.floor(F.col("duration") / 2)).cast("long").alias("length"))
    return stateful.associate(frames, p)
