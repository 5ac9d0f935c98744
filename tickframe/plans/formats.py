"""Queries on formats beyond plain cues: indexes, placement and styles of cues, captions, coded pictures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import bitstream, timebase
from ..operators import ordered, timeline
from ..sources import containers, cues, movtext, vobsub, webvtt
from ..sources.tables import PACKETS_SQL, packets
from ..streaming import captions, machines
from .registry import query
from .scans import _CUES, _cues, _files, _hms


def _content(lines, *order):
    """One file's text from a group's lines."""
    sorted_ = F.transform(F.array_sort(F.collect_list(F.struct(*order, lines.alias("line")))), lambda x: x["line"])
    return F.array_join(sorted_, "")


@query(f"SELECT CAST(stream AS VARCHAR) AS path, CAST(row_number() OVER (PARTITION BY stream ORDER BY s, n DESC) - 1 AS INTEGER) AS seq, s AS start_us, e AS end_us, text FROM {_CUES}")
def o02_sort_by_start(spark, sf_dir):
    """Cues that a file has in any order, by their start."""
    c = _cues(spark, sf_dir)
    line = F.concat(F.lit('<p begin="'), _hms("s", "."), F.lit('" dur="2s">'), "text", F.lit("</p>"))
    body = F.concat(F.lit('<tt xmlns="http://www.w3.org/ns/ttml"><body><div>'), _content(line, -F.col("n")), F.lit("</div></body></tt>"))
    return cues.parse_files(c.groupBy("stream").agg(F.encode(body, "UTF-8").alias("content")).select(F.col("stream").cast("string").alias("path"), "content"))


_INDEXED = f"(SELECT stream, seq, CAST(seq % 2 AS INTEGER) AS id, us // 1000 + 2000 AS pts, abs(bytes) AS position, first_value(seq % 2) OVER (PARTITION BY stream ORDER BY seq) AS first FROM {PACKETS_SQL})"


@query(f"""SELECT stream || '.idx' AS path, CAST(CASE WHEN id = first THEN 0 ELSE 1 END AS INTEGER) AS track, id, CASE id WHEN 0 THEN 'en' ELSE 'fr' END AS language, pts AS pts_ms, position, NULL::VARCHAR AS error FROM {_INDEXED} WHERE stream % 7 <> 0
UNION ALL SELECT DISTINCT stream || '.idx', NULL, NULL, NULL, NULL, NULL, 'no stream beside it' FROM {_INDEXED} WHERE stream % 7 = 0""")
def s08_vobsub_index(spark, sf_dir):
    """Index files, written from packets of two tracks a stream and read back with the streams they point into."""
    p = packets(spark, sf_dir).select("stream", "seq", F.expr("us div 1000").alias("ms"), F.abs("bytes").alias("position"))
    clock = F.replace(timebase.srt_clock(F.col("ms")), F.lit(","), F.lit(":"))
    track = F.when(F.col("seq") % 2 == 0, "id: en, index: 0\n").otherwise("id: fr, index: 1\n")
    line = F.concat(track, F.lit("timestamp: "), clock, F.format_string(", filepos: %09x\n", "position"))
    text = F.concat(F.lit("# VobSub index file, v7\nsize: 720x480\ndelay: 00:00:02:000\n"), _content(line, "seq"))
    found = p.groupBy("stream").agg(F.encode(text, "UTF-8").alias("content"), F.encode(F.repeat(F.lit("x"), F.max("position").cast("int")), "UTF-8").alias("body"))
    name = lambda ending: F.concat(F.col("stream").cast("string"), F.lit(ending)).alias("path")
    return vobsub.read_pairs(found.select(name(".idx"), "content").unionByName(found.filter("stream % 7 <> 0").select(name(".sub"), F.col("body").alias("content"))))


@query(f"SELECT stream, id, seq, CAST(row_number() OVER (PARTITION BY stream, id ORDER BY position, pts, seq) - 1 AS BIGINT) AS place FROM {_INDEXED}")
def o03_position_order(spark, sf_dir):
    """Packets of a track by file position, then time."""
    p = packets(spark, sf_dir).select("stream", (F.col("seq") % 2).cast("int").alias("id"), "seq", F.expr("us div 1000 + 2000").alias("pts"), F.abs("bytes").alias("position"))
    return ordered.display_positions(p.withColumnRenamed("position", "at"), ["stream", "id"], ["at", "pts", "seq"]).select("stream", "id", "seq", F.col("position").alias("place"))


_SETTINGS = [" ", " line:{n},end position:25%,line-left align:start", " line:50% size:80%", " vertical:rl align:right position:120%", " region:one"]


@query(f"""SELECT CAST(stream AS VARCHAR) AS path, CAST(n AS INTEGER) AS seq, CASE WHEN n % 5 = 3 THEN 'rl' ELSE '' END AS vertical, CAST(CASE n % 5 WHEN 1 THEN n WHEN 2 THEN 50 END AS DOUBLE) AS line, n % 5 <> 2 AS snap,
 CASE WHEN n % 5 = 1 THEN 'end' ELSE 'start' END AS line_align, CAST(CASE WHEN n % 5 = 1 THEN 25 END AS DOUBLE) AS position, CASE WHEN n % 5 = 1 THEN 'line-left' ELSE 'auto' END AS position_align,
 CAST(CASE WHEN n % 5 = 2 THEN 80 ELSE 100 END AS DOUBLE) AS size, CASE n % 5 WHEN 1 THEN 'start' WHEN 3 THEN 'right' ELSE 'center' END AS align, CASE WHEN n % 5 = 4 THEN 'one' END AS region FROM {_CUES}""")
def s_vtt_settings(spark, sf_dir):
    """Where cues are placed."""
    c = _cues(spark, sf_dir).withColumn("k", F.col("n") - 1)
    words = F.element_at(F.array(*map(F.lit, _SETTINGS)), (F.col("k") % 5 + 1).cast("int"))
    line = F.concat(_hms("s", "."), F.lit(" --> "), _hms("e", "."), F.replace(words, F.lit("{n}"), F.col("k").cast("string")), F.lit("\n"), "text", F.lit("\n\n"))
    return webvtt.read_settings(_files(c, line, "WEBVTT\n\nREGION\nid:one\nwidth:40%\n\n"))


_SHEET = '::cue { color: yellow }\n::cue(.ERROR) { color: red; font-weight: bold }\n/* later, but less specific */ ::cue(c) { color: lime; font-size: 150% }\n::cue(v[voice="3"]) { font-style: italic }\n::cue(c:past) { color: blue }'


@query(f"""WITH r AS (SELECT *, unnest([0, 1]) AS run FROM {_CUES}) SELECT CAST(stream AS VARCHAR) AS path, CAST(n AS INTEGER) AS seq, CAST(run AS INTEGER) AS run, CASE run WHEN 0 THEN 'hi ' ELSE text END AS text, CAST(stream % 5 AS VARCHAR) AS voice,
 CASE WHEN run = 0 THEN 'ffff00ff' WHEN text = 'ERROR' THEN 'ff0000ff' ELSE '00ff00ff' END AS color, NULL::VARCHAR AS background, run = 1 AND text = 'ERROR' AS bold, stream % 5 = 3 AS italic, false AS underline, NULL::VARCHAR AS family,
 CASE run WHEN 0 THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END AS size, 1.0::DOUBLE AS opacity FROM r""")
def w17_vtt_cascade(spark, sf_dir):
    """Runs of cue text as the file's style block dresses them."""
    c = _cues(spark, sf_dir)
    text = F.concat(F.lit("<v "), (F.col("stream") % 5).cast("string"), F.lit(">hi <c."), "text", F.lit(">"), "text", F.lit("</c></v>"))
    line = F.concat(_hms("s", "."), F.lit(" --> "), _hms("e", "."), F.lit("\n"), text, F.lit("\n\n"))
    return webvtt.read_runs(_files(c, line, f"WEBVTT\n\nSTYLE\n{_SHEET}\n\n"))


@query(f"SELECT stream, us AS start_us, lead(us) OVER (PARTITION BY stream ORDER BY us, seq) AS end_us, upper(kind) AS text FROM {PACKETS_SQL} QUALIFY kind <> 'error'")
def r17_caption_states(spark, sf_dir):
    """Pop-on captions from byte pairs; each screen lasts until the next one or an erasure."""
    p = packets(spark, sf_dir).select("stream", F.struct("us", "seq").alias("order"), F.col("us").alias("at"), F.upper("kind").alias("text"))
    pairs = F.hex(F.rpad("text", (F.ceil(F.length("text") / 2) * 2).cast("int"), F.lit("\0")))
    data = F.when(F.col("text") == "ERROR", "142C").otherwise(F.concat(F.lit("14201420142E1470"), pairs, F.lit("142F142F")))
    return machines.run_batch(p.select("stream", "order", "at", data.alias("data")), "stream", "order", captions.buffered)


_H264 = {"signup": "0000000109100000000165888400", "view": "00000001060502ABCD0601C480000001419A00", "click": "000000010606017180000001419A00", "error": "00000001019E00"}
_HEVC = {"signup": "000000012A01AF", "view": "000000014E01060180800000010201D0", "click": "000000010201D0", "error": "000000010201D0"}


@query(f"""SELECT stream, seq, CASE WHEN kind = 'error' OR (seq % 2 = 1 AND kind = 'click') THEN 'Dependent' WHEN kind = 'click' THEN 'Recovery' ELSE 'Refresh' END AS entry,
 CAST(CASE WHEN seq % 2 = 0 AND kind = 'click' THEN 2 END AS INTEGER) AS frames, seq % 2 = 0 AND kind = 'error' AS unneeded FROM {PACKETS_SQL}""")
def p13_random_access(spark, sf_dir):
    """Where decoding can start, by the units of packets of two codecs."""
    p = packets(spark, sf_dir)
    even = F.col("seq") % 2 == 0
    coded = lambda table, other: F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col("kind")], F.lit(other))
    data = F.unhex(F.when(even, coded(_H264, "000000010910")).otherwise(coded(_HEVC, "00000001460110")))
    return p.select("stream", "seq", bitstream.entries(F.when(even, "h264").otherwise("hevc"), data).alias("e")).select("stream", "seq", "e.*")


@query(f"""WITH d AS (SELECT stream, seq, list_transform(regexp_extract_all(hex(encode(kind || seq)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM {PACKETS_SQL})
SELECT stream, seq, list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, v: list_reduce(list_prepend(xor(c, v << 24), range(8)), lambda x, i: xor((x << 1) & 4294967295, CASE WHEN x & 2147483648 > 0 THEN 79764919 ELSE 0 END))) AS checksum FROM d""")
def f12_checksum(spark, sf_dir):
    """The checksum of transport streams."""
    return packets(spark, sf_dir).select("stream", "seq", bitstream.checksum(F.concat("kind", F.col("seq").cast("string")).cast("binary")).alias("checksum"))


@query(f"SELECT stream, seq, hex(encode(kind)) || '000001' || repeat('000002', seq % 3) || '000003' AS plain, hex(encode(kind)) || '00000301' || repeat('00000302', seq % 3) || '00000303' AS coded FROM {PACKETS_SQL}")
def f12_escapes(spark, sf_dir):
    """Payloads without and with the bytes that keep start codes out of them."""
    p = packets(spark, sf_dir)
    plain = F.unhex(F.concat(F.hex(F.col("kind").cast("binary")), F.lit("000001"), F.expr("repeat('000002', cast(seq % 3 as int))"), F.lit("000003")))
    coded = bitstream.escaped(plain)
    return p.select("stream", "seq", F.hex(bitstream.unescaped(coded)).alias("plain"), F.hex(coded).alias("coded"))


@query(f"""WITH p AS (SELECT stream, seq, us, CASE kind WHEN 'signup' THEN 'play' WHEN 'error' THEN 'pause' WHEN 'click' THEN 'seek' ELSE 'tick' END AS action, bytes * 1000 AS seek_to, CASE WHEN seq % 11 = 0 THEN us - 3 END AS audio FROM {PACKETS_SQL}),
q AS (SELECT *, last_value(CASE WHEN action IN ('play', 'pause') THEN action END IGNORE NULLS) OVER (PARTITION BY stream ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS turn, us - lag(us) OVER w AS passed, sum(CASE WHEN action = 'seek' THEN 1 ELSE 0 END) OVER w AS since, bool_or(action IN ('seek', 'play')) OVER w AS started FROM p WINDOW w AS (PARTITION BY stream ORDER BY us, seq)),
f AS (SELECT *, coalesce(max(CASE WHEN action = 'seek' THEN seek_to END) OVER v, 0) + sum(CASE WHEN action <> 'seek' AND turn = 'play' THEN passed ELSE 0 END) OVER v AS free FROM q WINDOW v AS (PARTITION BY stream, since ORDER BY us, seq))
SELECT stream, seq, CAST(coalesce(audio, CASE WHEN started THEN free END) AS BIGINT) AS position FROM f""")
def r12_master_clock(spark, sf_dir):
    """The position by the audio clock, else by one that runs freely between play and pause and is set by seeks."""
    action = F.when(F.col("kind") == "signup", "play").when(F.col("kind") == "error", "pause").when(F.col("kind") == "click", "seek").otherwise("tick")
    p = packets(spark, sf_dir).select("stream", "seq", "us", action.alias("action"), (F.col("bytes") * 1000).alias("seek_to"), F.when(F.col("seq") % 11 == 0, F.col("us") - 3).alias("audio"))
    return timeline.master_clock(p, ["stream"], ["us", "seq"], "us", "action", "seek_to", "audio").select("stream", "seq", "position")


@query(f"""SELECT stream, seq, kind AS text, CAST(CASE WHEN seq % 3 > 0 THEN 1 END AS INTEGER) AS first, CAST(CASE WHEN seq % 3 > 0 THEN 3 END AS INTEGER) AS stop, CASE seq % 3 WHEN 1 THEN true WHEN 2 THEN false END AS bold, CASE WHEN seq % 3 > 0 THEN true END AS italic,
 CASE WHEN seq % 3 > 0 THEN false END AS underline, CAST(CASE WHEN seq % 3 > 0 THEN 18 END AS INTEGER) AS size, CASE WHEN seq % 3 > 0 THEN 'ff0000ff' END AS color, NULL::VARCHAR AS error FROM {PACKETS_SQL} WHERE kind <> 'error'
UNION ALL SELECT stream, seq, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, '99 bytes of text in 5' FROM {PACKETS_SQL} WHERE kind = 'error'""")
def s_mov_text(spark, sf_dir):
    """Styled parts of timed text samples, some of them damaged."""
    p = packets(spark, sf_dir)
    short = lambda c: F.lpad(F.hex(c), 4, "0")
    style = F.when(F.col("seq") % 3 == 0, "").otherwise(F.concat(F.lit("00000016" + "7374796C" + "0001" + "00010003" + "0001"), F.when(F.col("seq") % 3 == 1, "03").otherwise("02"), F.lit("12" + "FF0000FF")))
    length = F.when(F.col("kind") == "error", 99).otherwise(F.length("kind"))
    data = F.concat(short(length), F.hex(F.col("kind").cast("binary")), F.when(F.col("kind") == "error", "").otherwise(style))
    return movtext.read_samples(p.select("stream", "seq", F.unhex(data).alias("data")), "data")


@query(f"""SELECT CAST(stream AS VARCHAR) AS path, 'voc' AS container, CAST(row_number() OVER w - 1 AS INTEGER) AS seq, CAST(0 AS INTEGER) AS stream, CAST(sum(length(kind)) OVER w - length(kind) AS BIGINT) AS pts, CAST(length(kind) AS BIGINT) AS duration, true AS keyframe, CAST(length(kind) AS BIGINT) AS size,
 CAST(1 AS INTEGER) AS tb_num, CAST(8000 AS INTEGER) AS tb_den FROM {PACKETS_SQL} WINDOW w AS (PARTITION BY stream ORDER BY seq)""")
def s07_voc_packets(spark, sf_dir):
    """Sound blocks of a file, the first with a rate and the others going on from it."""
    p = packets(spark, sf_dir).withColumn("first", F.col("seq") == F.min("seq").over(Window.partitionBy("stream")))
    little = lambda c: F.regexp_replace(F.lpad(F.hex(c), 6, "0"), "(..)(..)(..)", "$3$2$1")
    body = F.concat(F.when(F.col("first"), "8300").otherwise(""), F.hex(F.col("kind").cast("binary")))
    block = F.concat(F.when(F.col("first"), "01").otherwise("02"), little((F.length(body) / 2).cast("long")), body)
    head = F.lit((b"Creative Voice File\x1a" + bytes((26, 0, 10, 1, 41, 17))).hex())
    files = p.groupBy(F.col("stream").cast("string").alias("path")).agg(F.unhex(F.concat(head, _content(block, "seq"), F.lit("00"))).alias("content"))
    return containers.demux_files(files)
