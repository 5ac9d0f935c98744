"""Queries on projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths, text, timebase, tracks
from ..operators import asof, selection
from ..sources.tables import PACKETS_SQL, packets, table, values
from .registry import query


@query(f"SELECT DISTINCT stream, seq FROM {PACKETS_SQL} WHERE stream IN (3, 5, 8)")
def p01_active_streams(spark, sf_dir):
    """Packets of the selected streams and those read ahead; the filter reaches the scan."""
    active = sorted({3, 5} | {5, 8})
    return packets(spark, sf_dir).filter(F.col("stream").isin(active)).select("stream", "seq")


_TR = "(SELECT o_custkey AS file, o_orderkey AS stream, CASE o_orderstatus WHEN 'O' THEN 'video' WHEN 'F' THEN 'audio' ELSE 'data' END AS kind, CAST(o_totalprice / 20 AS INTEGER) AS w, CAST(o_orderkey % 9000 AS INTEGER) AS h FROM orders)"


def _tracks(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderstatus") == "O", "video").when(F.col("o_orderstatus") == "F", "audio").otherwise("data")
    return o.select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("stream"), kind.alias("kind"), F.bround(F.col("o_totalprice") / 20).cast("int").alias("w"), (F.col("o_orderkey") % 9000).cast("int").alias("h"))


@query(f"SELECT file, stream, kind FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY stream) AS n FROM {_TR}) WHERE n <= 64 AND kind IN ('audio', 'video', 'subtitle') AND NOT (kind = 'video' AND (w > 16384 OR h > 16384 OR CAST(w AS BIGINT) * h > 67108864))")
def p02_offered_tracks(spark, sf_dir):
    first = selection.top(_tracks(spark, sf_dir), ["file"], [F.col("stream")], 64)
    return first.filter(tracks.offered(F.col("kind"), F.col("w"), F.col("h"))).select("file", "stream", "kind")


@query(f"SELECT file, kind, CASE WHEN file % 4 = 0 AND max(stream) % 2 = 0 THEN max(stream) ELSE min(stream) END AS chosen FROM {_TR} GROUP BY file, kind")
def p03_default_track(spark, sf_dir):
    """The first track of each kind unless another is wanted."""
    t = _tracks(spark, sf_dir).groupBy("file", "kind").agg(F.min("stream").alias("first"), F.max("stream").alias("last"))
    wanted = F.when((F.col("file") % 4 == 0) & (F.col("last") % 2 == 0), F.col("last"))
    return t.select("file", "kind", F.coalesce(wanted, "first").alias("chosen"))


@query("SELECT l_orderkey AS file, coalesce(CASE WHEN l_orderkey % 3 = 0 THEN 12.5::DOUBLE END, max(CASE WHEN l_linenumber % 4 <> 0 THEN greatest(CAST(l_partkey - 50 AS DOUBLE) / l_linenumber, 0) END)) AS secs FROM lineitem GROUP BY l_orderkey")
def p04_duration(spark, sf_dir):
    """The container's duration, else the longest of streams with a valid base."""
    secs = timebase.seconds(F.col("l_partkey") - 50, F.lit(1), F.when(F.col("l_linenumber") % 4 != 0, F.col("l_linenumber")).otherwise(0))
    longest = F.max(F.when(secs.isNotNull(), F.greatest(secs, F.lit(0.0))))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("file")).agg(longest.alias("longest")).select("file", F.coalesce(F.when(F.col("file") % 3 == 0, F.lit(12.5)), "longest").alias("secs"))


@query(f"SELECT stream, seq, CAST(coalesce(pts, dts) + coalesce(duration, 0) AS DOUBLE) / 1000000 AS end_secs FROM {PACKETS_SQL}")
def p05_packet_end(spark, sf_dir):
    p = packets(spark, sf_dir)
    return p.select("stream", "seq", timebase.seconds(F.coalesce("pts", "dts") + F.coalesce("duration", F.lit(0)), F.lit(1), F.lit(1_000_000)).alias("end_secs"))


_RS = "CAST((CAST(abs({a}) AS HUGEINT) * {b} + {c} // 2) // {c} AS HUGEINT) * CASE WHEN {a} < 0 THEN -1 ELSE 1 END"


@query(f"SELECT stream, seq, CASE WHEN pts > 0 AND seq % 9 <> 0 THEN CAST({_RS.format(a='pts', b='1000000000', c='90000')} AS BIGINT) ELSE 0 END AS ns FROM {PACKETS_SQL}")
def p06_media_time(spark, sf_dir):
    p = packets(spark, sf_dir).filter("true")
    return p.select("stream", "seq", timebase.media_time(F.col("pts"), F.lit(1).cast("long"), F.when(F.col("seq") % 9 != 0, 90000).otherwise(0).cast("long")).alias("ns"))


@query(f"WITH p AS (SELECT stream, seq, max(CASE WHEN coalesce(pts >= 864000000000, false) THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY seq) AS reached FROM {PACKETS_SQL}) SELECT stream, seq FROM p WHERE reached = 1")
def p07_from_target(spark, sf_dir):
    """Frames from the first at or behind the target, also those behind it that are earlier again."""
    return asof.first_crossing(packets(spark, sf_dir), ["stream"], ["seq"], F.col("pts") >= 864_000_000_000).select("stream", "seq")


@query(f"SELECT stream, seq FROM {PACKETS_SQL} WHERE NOT (kind = 'view' AND pts < 864000000000)")
def p08_skip_unreferenced(spark, sf_dir):
    """Pictures no other needs are skipped before the target."""
    skipped = (F.col("kind") == "view") & (F.col("pts") < 864_000_000_000)
    return packets(spark, sf_dir).filter(~F.coalesce(skipped, F.lit(False))).select("stream", "seq")


_FPS = "(24000.0::DOUBLE / 1001), (24.0::DOUBLE), (25.0::DOUBLE), (30000.0::DOUBLE / 1001), (30.0::DOUBLE), (50.0::DOUBLE), (60000.0::DOUBLE / 1001), (60.0::DOUBLE)"


@query(f"WITH m AS (SELECT event_id, value AS fps FROM events), c(f) AS (VALUES {_FPS}), x AS (SELECT event_id, arg_min(f, abs(fps - f) / f) FILTER (WHERE abs(fps - f) / f <= 0.0025) AS snapped FROM m, c GROUP BY event_id) SELECT event_id, coalesce(snapped, fps) AS fps FROM m JOIN x USING (event_id)")
def p09_snap_fps(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", tracks.snap_fps(F.col("value")).alias("fps"))


@query(f"SELECT file, stream, CAST(CASE WHEN kind = 'audio' THEN 10 WHEN h > 576 THEN 2 ELSE 4 END AS DOUBLE) AS floor FROM {_TR}")
def p10_floor(spark, sf_dir):
    return _tracks(spark, sf_dir).select("file", "stream", tracks.floor_for(F.col("kind"), F.col("h")).alias("floor"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'a') AND contains(p_type, 'S')")
def p11_substring_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(F.contains("p_name", F.lit("a")) & F.contains("p_type", F.lit("S"))).select("p_partkey", "p_name")


@query("SELECT conv_id AS stream, count(*) FILTER (WHERE role <> 'system') AS visible, count(*) FILTER (WHERE turn < 3) AS shows, count(*) FILTER (WHERE role <> 'system') = count(*) FILTER (WHERE turn < 3) AS shown_all FROM conversations GROUP BY ALL")
def p12_shown_all(spark, sf_dir):
    """As many shows as states with something to see."""
    visible, shows = F.count_if(F.col("role") != "system"), F.count_if(F.col("turn") < 3)
    return table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("stream")).agg(visible.alias("visible"), shows.alias("shows"), (visible == shows).alias("shown_all"))


@query("SELECT o_orderkey AS stream, CASE o_custkey % 4 WHEN 0 THEN 'HDR10' WHEN 1 THEN 'HLG' WHEN 2 THEN 'Dolby Vision' ELSE 'SDR' END || ' ' || CASE WHEN o_orderkey % 2 = 0 THEN '10' ELSE '8' END || '-bit ' || CASE o_orderkey % 3 WHEN 0 THEN '4:2:0' WHEN 1 THEN '4:2:2' ELSE '4:4:4' END AS signal FROM orders")
def p14_signal(spark, sf_dir):
    """A label of dynamic range, bit depth and chroma layout."""
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    transfer = F.when(c % 4 == 0, "pq").when(c % 4 == 1, "hlg").when(c % 4 == 2, "dolby").otherwise("bt709")
    return table(spark, sf_dir, "orders").select(k.alias("stream"), tracks.signal(transfer, F.when(k % 2 == 0, 10).otherwise(8), (k % 3).cast("int")).alias("signal"))


_EDGE = "(5L, 1L, 2L), (-5L, 1L, 2L), (9223372036854775807L, 9223372036854775807L, 9223372036854775807L), (9223372036854775807L, 3L, 2L), (7L, -1L, 2L), (7L, 1L, 0L), (0L, 0L, 5L), (-7L, 3L, 4L)"


@query(f"""WITH v(a, b, c) AS (SELECT l_partkey - 100, l_orderkey * 1000003, l_suppkey * 7 + 1 FROM lineitem UNION ALL SELECT CAST(a AS BIGINT), CAST(b AS BIGINT), CAST(c AS BIGINT) FROM (VALUES {_EDGE.replace('L', '')}) e(a, b, c)),
q AS (SELECT *, CASE WHEN b >= 0 AND c > 0 THEN {_RS.format(a='a', b='b', c='c')} END AS r FROM v) SELECT a, b, c, CASE WHEN r BETWEEN -9223372036854775808 AND 9223372036854775807 THEN CAST(r AS BIGINT) ELSE -9223372036854775807 - 1 END AS r FROM q""")
def f01_rescale(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") - 100).alias("a"), (F.col("l_orderkey") * 1000003).alias("b"), (F.col("l_suppkey") * 7 + 1).alias("c"))
    v = v.unionByName(values(spark, "a, b, c", _EDGE))
    return v.select("a", "b", "c", timebase.rescale(F.col("a"), F.col("b"), F.col("c")).alias("r"))


_CLOCK = "printf('%02d:%02d:%02d,%03d', {m} // 3600000, {m} // 60000 % 60, {m} // 1000 % 60, {m} % 1000)"


@query(f"SELECT event_id, {_CLOCK.format(m='((us + 500) // 1000)')} AS shown FROM (SELECT event_id, greatest(date_diff('microsecond', TIMESTAMP '2024-01-05', ts), 0) AS us FROM events)")
def f02_srt_time(spark, sf_dir):
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-05 00:00:00', ts)")
    return table(spark, sf_dir, "events").select("event_id", timebase.srt_time(us).alias("shown"))


@query(f"SELECT stream, seq, CASE WHEN duration IS NULL THEN {_CLOCK.format(m='((us + 500) // 1000 + 4294967295)')} ELSE {_CLOCK.format(m='((us + duration + 500) // 1000)')} END AS end_at FROM {PACKETS_SQL}")
def f03_srt_end(spark, sf_dir):
    return packets(spark, sf_dir).select("stream", "seq", timebase.srt_end(F.col("us"), F.col("us") + F.col("duration")).alias("end_at"))


@query(f"""WITH l AS (SELECT stream, seq, CASE WHEN seq % 11 = 0 THEN 'x --> y' ELSE {_CLOCK.format(m='(us // 1000)')} || ' --> ' || replace({_CLOCK.format(m='(us // 1000 + bytes)')}, ',', '.') || ' X1:0' END AS line, us // 1000 AS s, bytes AS d FROM {PACKETS_SQL})
SELECT stream, seq, CASE WHEN seq % 11 <> 0 THEN s END AS start_ms, CASE WHEN seq % 11 <> 0 THEN d END AS duration_ms FROM l""")
def f04_srt_parse(spark, sf_dir):
    ms = F.expr("us div 1000")
    line = F.concat(timebase.srt_clock(ms), F.lit(" --> "), F.replace(timebase.srt_clock(ms + F.col("bytes")), F.lit(","), F.lit(".")), F.lit(" X1:0"))
    start, length = timebase.srt_parse(F.when(F.col("seq") % 11 == 0, "x --> y").otherwise(line))
    return packets(spark, sf_dir).select("stream", "seq", start.alias("start_ms"), length.alias("duration_ms"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 64 < 60 AND l_suppkey % 80 < 75 THEN CAST((l_orderkey % 99 * 60 + l_partkey % 64) * 1000000000 + l_suppkey % 80 * 1000000000 // 75 AS BIGINT) END AS ns FROM lineitem")
def f05_cd_time(spark, sf_dir):
    t = F.format_string("%02d:%02d:%02d", F.col("l_orderkey") % 99, F.col("l_partkey") % 64, F.col("l_suppkey") % 80)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", timebase.cd_time(t).alias("ns"))


@query(r"""WITH s AS (SELECT page_id, regexp_replace(replace(html, '\h', chr(160)), '<[^>]*>|\{[^}]*\}', '', 'g') AS t FROM pages) SELECT page_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> ''), chr(10)) AS plain FROM s""")
def f06_plain_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.plain(F.col("html")).alias("plain"))


@query("SELECT doc_id, md5(text) AS md5 FROM documents")
def f07_md5(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("md5"))


@query("SELECT vec_id, list_transform([1, 2, 3, 5, 6, 4], lambda i: CAST(embedding[i] AS DOUBLE)) AS channels FROM embeddings")
def f09_channel_order(spark, sf_dir):
    """Channels put in another order."""
    order = [1, 2, 3, 5, 6, 4]
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array(*[F.element_at("embedding", i).cast("double") for i in order]).alias("channels"))


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS query FROM pages""".replace("\\\\", "\\"))
def f10_url_parts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", paths.path(F.col("url")).alias("path"), paths.query(F.col("url")).alias("query"))


@query("""WITH r AS (SELECT o_orderkey, o_orderkey % 1000 AS a, o_orderkey % 1000 + o_custkey % 50 AS b, 900 AS size, o_custkey % 4 AS form FROM orders) SELECT o_orderkey,
 CAST(CASE WHEN form = 0 AND a < size THEN a WHEN form = 1 AND a < size THEN a WHEN form = 2 AND a > 0 THEN greatest(size - a, 0) END AS BIGINT) AS first, CAST(CASE WHEN form = 0 AND a < size THEN least(b, size - 1) WHEN form = 1 AND a < size THEN size - 1 WHEN form = 2 AND a > 0 THEN size - 1 END AS BIGINT) AS last FROM r""")
def f10_byte_range(spark, sf_dir):
    """Range headers: ``a-b``, ``a-``, ``-n``, or one that isn't a range."""
    a, b, form = F.col("o_orderkey") % 1000, F.col("o_orderkey") % 1000 + F.col("o_custkey") % 50, F.col("o_custkey") % 4
    header = F.when(form == 0, F.format_string("bytes=%d-%d", a, b)).when(form == 1, F.format_string("bytes=%d-", a)).when(form == 2, F.format_string("bytes=-%d", a)).otherwise("lines=1-2")
    first, last = paths.byte_range(header, F.lit(900).cast("long"))
    return table(spark, sf_dir, "orders").select("o_orderkey", first.alias("first"), last.alias("last"))


@query("""WITH t AS (SELECT o_orderkey, o_totalprice / 100 AS w, o_custkey % 900 + 100 AS h FROM orders) SELECT o_orderkey, round(least(1920 / w, 1080.0 / h), 9) AS scale, CAST(floor(w * least(1920 / w, 1080.0 / h) + 0.5) AS BIGINT) AS out_w, CAST(floor(h * least(1920 / w, 1080.0 / h) + 0.5) AS BIGINT) AS out_h FROM t""")
def f13_fit_canvas(spark, sf_dir):
    """The largest size of a picture's shape within a canvas."""
    scale, w, h = tracks.fit(F.col("o_totalprice") / 100, F.col("o_custkey") % 900 + 100, 1920, 1080)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(scale, 9).alias("scale"), w.alias("out_w"), h.alias("out_h"))


_TOK = "('audio:snr:95.5'), ('audio:snr:89.9'), ('audio:snr:nan'), ('video:md5'), ('audio:snr:x'), ('sub:text'), ('audio:snr:120'), ('video:decodes'), ('bogus')"


@query(f"""SELECT t AS token, CASE WHEN t = 'bogus' THEN NULL ELSE split_part(t, ':', 1) END AS kind, CASE WHEN t = 'bogus' THEN NULL ELSE split_part(t, ':', 2) END AS policy, CASE WHEN split_part(t, ':', 2) = 'snr' AND try_cast(split_part(t, ':', 3) AS DOUBLE) BETWEEN 90 AND 1e308 THEN try_cast(split_part(t, ':', 3) AS DOUBLE) END AS db,
 t NOT IN ('bogus') AND (split_part(t, ':', 2) <> 'snr' OR coalesce(try_cast(split_part(t, ':', 3) AS DOUBLE) BETWEEN 90 AND 1e308, false)) AS valid FROM (VALUES {_TOK}) v(t)""")
def f14_policy_tokens(spark, sf_dir):
    return text.policies(values(spark, "token", _TOK), "token")


@query(f"SELECT stream, seq, CAST((us * 90 + 500) // 1000 AS BIGINT) AS ticks, CAST((us + 500) // 1000 AS BIGINT) AS ms FROM {PACKETS_SQL}")
def f17_caption_ticks(spark, sf_dir):
    us = F.col("us")
    return packets(spark, sf_dir).select("stream", "seq", timebase.rescale(us, F.lit(90).cast("long"), F.lit(1000).cast("long")).alias("ticks"), F.expr("(us + 500) div 1000").alias("ms"))


@query("SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM documents")
def f18_text_decoding(spark, sf_dir):
    """UTF-8 where valid, else the older code page; line ends made alike.  Odd rows arrive in that code page."""
    raw = F.col("text").cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", text.decoded(raw).alias("text"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'http://h/a/film.sub?x=1#t' WHEN page_id % 3 = 1 THEN 'file:///v/FILM.SUB' END AS url FROM pages")
def s04_sibling_stream(spark, sf_dir):
    """The data file beside an index: ``.idx`` becomes ``.sub`` in the same case."""
    url = F.when(F.col("page_id") % 3 == 0, "http://h/a/film.idx?x=1#t").when(F.col("page_id") % 3 == 1, "file:///v/FILM.IDX").otherwise("http://h/film.mkv")
    return table(spark, sf_dir, "pages").select("page_id", paths.sub_beside_idx(url).alias("url"))


@query("SELECT * FROM (VALUES ('track.wav', 'http://h/music/track.wav?k=1'), ('../x.wav', NULL), ('a/b.wav', NULL), ('c:x', NULL), ('..', NULL), ('d\\e', NULL), ('ok name.flac', 'http://h/music/ok name.flac?k=1')) v(name, url)".replace("\\\\", "\\"))
def s05_safe_sibling(spark, sf_dir):
    """A file named by a cue sheet, beside it; names that lead elsewhere are refused."""
    v = values(spark, "name", r"('track.wav'), ('../x.wav'), ('a/b.wav'), ('c:x'), ('..'), ('d\\e'), ('ok name.flac')")
    return v.select("name", paths.sibling(F.lit("http://h/music/disc.cue?k=1"), F.col("name")).alias("url"))


@query("""WITH c AS (SELECT o_custkey AS file, o_orderpriority AS name, CAST(o_totalprice / 5000 AS BIGINT) AS score, o_orderkey AS seq FROM orders), t AS (SELECT file, arg_max(name, (score, -seq)) AS name, max(score) AS score FROM c GROUP BY file)
SELECT file, CASE WHEN score >= 50 THEN name ELSE CASE file % 3 WHEN 0 THEN 'mkv' WHEN 1 THEN 'mp4' END END AS container FROM t""")
def s06_probe(spark, sf_dir):
    """The best-scoring candidate if good enough, else what the extension says."""
    c = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderpriority").alias("name"), F.bround(F.col("o_totalprice") / 5000).cast("long").alias("score"), F.col("o_orderkey").alias("seq"))
    by_extension = F.when(F.col("file") % 3 == 0, "mkv").when(F.col("file") % 3 == 1, "mp4")
    return selection.first_best(c, ["file"], "score", "seq", "name").select("file", F.when(F.col("score") >= 50, F.col("name")).otherwise(by_extension).alias("container"))
