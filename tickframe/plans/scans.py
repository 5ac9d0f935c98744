"""Queries on sources: cue files and records, written from the driver's tables and read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import timebase
from ..sources import containers, cues, records
from ..sources.tables import PACKETS_SQL, packets, table, values
from .registry import query


def _cues(spark, sf_dir):
    """Cues on whole tenths of a second, so that every format holds them exactly; some last, some are open."""
    p = packets(spark, sf_dir).select("stream", "seq", F.expr("us div 1000000 * 1000000").alias("s"), F.upper("kind").alias("text"))
    n = F.row_number().over(Window.partitionBy("stream").orderBy("seq"))
    return p.withColumn("e", F.col("s") + 2_000_000).withColumn("n", n)


_CUES = f"(SELECT stream, seq, us // 1000000 * 1000000 AS s, us // 1000000 * 1000000 + 2000000 AS e, upper(kind) AS text, row_number() OVER (PARTITION BY stream ORDER BY seq) - 1 AS n FROM {PACKETS_SQL})"
_READ = f"SELECT CAST(stream AS VARCHAR) AS path, CAST(n AS INTEGER) AS seq, s AS start_us, {{end}} AS end_us, text FROM {_CUES}"


def _files(c, line, head="", tail=""):
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"])
    content = F.encode(F.concat(F.lit(head), F.array_join(lines, ""), F.lit(tail)), "UTF-8")
    return c.groupBy("stream").agg(content.alias("content")).select(F.col("stream").cast("string").alias("path"), "content")


def _ms(c):
    return F.expr(f"{c} div 1000")


def _hms(c, mark=","):
    return F.replace(timebase.srt_clock(_ms(c)), F.lit(","), F.lit(mark))


def _secs(c):
    return F.regexp_replace(_hms(c), ",.*", "")


_CLOSED, _NEXT = _READ.format(end="e"), _READ.format(end="lead(s) OVER (PARTITION BY stream ORDER BY n)")


@query(_CLOSED)
def s_cues_srt(spark, sf_dir):
    c = _cues(spark, sf_dir)
    return cues.parse_files(_files(c, F.concat(F.col("n").cast("string"), F.lit("\n"), _hms("s"), F.lit(" --> "), _hms("e"), F.lit("\n"), "text", F.lit("\n\n"))))


@query(_CLOSED)
def s_cues_webvtt(spark, sf_dir):
    c = _cues(spark, sf_dir)
    return cues.parse_files(_files(c, F.concat(F.lit("id\n"), _hms("s", "."), F.lit(" --> "), _hms("e", "."), F.lit(" line:0\n"), "text", F.lit("\n\n")), "WEBVTT\n\n"))


@query(_CLOSED)
def s_cues_microdvd(spark, sf_dir):
    c = _cues(spark, sf_dir)
    return cues.parse_files(_files(c, F.format_string("{%d}{%d}%s\n", F.expr("s div 1000000 * 25"), F.expr("e div 1000000 * 25"), F.col("text")), "{1}{1}25\n"))


@query(_CLOSED)
def s_cues_subviewer2(spark, sf_dir):
    c = _cues(spark, sf_dir)
    return cues.parse_files(_files(c, F.concat(_hms("s", "."), F.lit(","), _hms("e", "."), F.lit("\n"), "text", F.lit("\n\n")), "[INFORMATION]\n"))


@query(_NEXT)
def s_cues_subviewer1(spark, sf_dir):
    c = _cues(spark, sf_dir)
    return cues.parse_files(_files(c, F.concat(F.lit("["), _secs("s"), F.lit("]\n"), "text", F.lit("\n"))))


@query(_NEXT)
def s_cues_vplayer(spark, sf_dir):
    c = _cues(spark, sf_dir)
    return cues.parse_files(_files(c, F.concat(_secs("s"), F.lit(":"), "text", F.lit("\n"))), "vplayer")


@query(_CLOSED)
def s_cues_ass(spark, sf_dir):
    c = _cues(spark, sf_dir)
    head = "[Script Info]\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"
    return cues.parse_files(_files(c, F.concat(F.lit("Dialogue: 0,"), _secs("s"), F.lit(".00,"), _secs("e"), F.lit(".00,Default,,0,0,0,,{\\b1}"), "text", F.lit("\n")), head))


@query(_NEXT)
def s_cues_sami(spark, sf_dir):
    c = _cues(spark, sf_dir)
    return cues.parse_files(_files(c, F.format_string("<SYNC Start=%d><P Class=EN>%s\n", _ms("s"), F.col("text")), "<SAMI><BODY>\n", "</BODY></SAMI>"))


@query(_CLOSED)
def s_cues_ttml(spark, sf_dir):
    c = _cues(spark, sf_dir)
    return cues.parse_files(_files(c, F.concat(F.lit('<p begin="'), _hms("s", "."), F.lit('" dur="2s">'), "text", F.lit("</p>")), '<tt xmlns="http://www.w3.org/ns/ttml"><body><div>', "</div></body></tt>"))


@query(_CLOSED)
def s_cues_usf(spark, sf_dir):
    c = _cues(spark, sf_dir)
    return cues.parse_files(_files(c, F.concat(F.lit('<subtitle start="'), _hms("s", "."), F.lit('" stop="'), _hms("e", "."), F.lit('"><text>'), "text", F.lit("</text></subtitle>")), "<USFSubtitles><subtitles>", "</subtitles></USFSubtitles>"))


@query(_NEXT)
def s_cues_cmml(spark, sf_dir):
    c = _cues(spark, sf_dir)
    return cues.parse_files(_files(c, F.concat(F.lit('<clip start="npt:'), _hms("s", "."), F.lit('"><desc>'), "text", F.lit("</desc></clip>")), "<cmml>", "</cmml>"))


@query("SELECT CAST(doc_id AS VARCHAR) AS path FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 = 0")
def s09_pin_mismatches(spark, sf_dir):
    """Files whose hash isn't the pinned one, or that have no pin."""
    d = table(spark, sf_dir, "documents")
    files = d.select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    pins = d.filter("doc_id % 7 <> 0").select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 11 == 0, F.lit("0")).otherwise(F.sha2(F.encode("text", "UTF-8"), 256)).alias("sha256"))
    return records.pin_mismatches(files, pins).select("path")


@query("SELECT o_orderkey AS input FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0)")
def s11_journal_resume(spark, sf_dir):
    """Inputs left to do: a journal of JSON lines, some of them torn, names those done."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("input"))
    line = F.to_json(F.struct("input", F.lit("done").alias("state")))
    journal = o.filter("input % 3 = 0").select(F.when(F.col("input") % 5 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value"))
    return records.remaining(o, records.journalled(journal, "input long, state string"), ["input"])


@query("SELECT c_custkey AS file, CAST(i AS INTEGER) AS index, CASE i WHEN 0 THEN 'video' ELSE 'audio' END AS codec_type, c_mktsegment AS codec_name, CAST(CASE WHEN i > 0 THEN 48000 END AS INTEGER) AS sample_rate, CAST(CASE WHEN i > 0 THEN i + 1 END AS INTEGER) AS channels FROM customer, (VALUES (0), (1), (2)) v(i) WHERE i < 2 OR c_custkey % 2 = 1")
def s12_probe_streams(spark, sf_dir):
    """Streams of a probe's JSON, without attached pictures."""
    stream = lambda i, kind, rate, ch, pic: F.struct(F.lit(i).alias("index"), F.lit(kind).alias("codec_type"), F.col("c_mktsegment").alias("codec_name"), F.lit(rate).cast("string").alias("sample_rate"), F.lit(ch).cast("int").alias("channels"), F.struct(pic.alias("attached_pic")).alias("disposition"))
    even = F.when(F.col("c_custkey") % 2 == 0, 1).otherwise(0)
    doc = F.to_json(F.struct(F.array(stream(0, "video", None, None, F.lit(0)), stream(1, "audio", "48000", 2, F.lit(0)), stream(2, "audio", "48000", 3, even)).alias("streams")))
    return records.probe_streams(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file"), doc.alias("json")), "json")


@query(f"SELECT stream AS file, CAST(stream % 4 AS INTEGER) AS stream, pts, md5(kind) AS hash FROM {PACKETS_SQL} WHERE pts IS NOT NULL")
def s12_frame_hashes(spark, sf_dir):
    p = packets(spark, sf_dir).filter("pts IS NOT NULL")
    line = F.format_string("%d, %d, %10d, 1, %d, %s", F.col("stream") % 4, F.col("pts"), F.col("pts"), F.col("bytes"), F.md5(F.col("kind").cast("binary")))
    files = p.groupBy(F.col("stream").alias("file")).agg(F.concat(F.lit("#format: frame checksums\n"), F.array_join(F.collect_list(line), "\n"), F.lit("\n")).alias("body"))
    return records.frame_hashes(files, "body").drop("line")


@query("""SELECT CAST(c_nationkey AS VARCHAR) AS path, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INTEGER) AS n, c_name AS title, 'disc' AS performer, CAST((c_custkey // 50 * 60 + c_custkey % 50) * 1000000000 + 200000000 AS BIGINT) AS start_ns FROM customer""")
def s_cue_sheets(spark, sf_dir):
    """chapters of cue sheets."""
    n = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name", n.alias("n"))
    track = F.format_string('TRACK %02d AUDIO\n  TITLE "%s"\n  INDEX 01 %02d:%02d:15\n', F.col("n"), F.col("c_name"), F.expr("c_custkey div 50"), F.col("c_custkey") % 50)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n", track.alias("t")))), lambda x: x["t"])
    files = c.groupBy(F.col("c_nationkey").cast("string").alias("path")).agg(F.encode(F.concat(F.lit('PERFORMER "disc"\n'), F.array_join(lines, "")), "UTF-8").alias("content"))
    return records.read_cue_sheets(files)


@query(f"SELECT CAST(stream AS VARCHAR) AS path, 'ivf' AS container, CAST(row_number() OVER (PARTITION BY stream ORDER BY seq) - 1 AS INTEGER) AS seq, CAST(0 AS INTEGER) AS stream, us // 1000 AS pts, CAST(1 AS BIGINT) AS duration, row_number() OVER (PARTITION BY stream ORDER BY seq) = 1 AS keyframe, CAST(length(kind) AS BIGINT) AS size, CAST(1 AS INTEGER) AS tb_num, CAST(1000 AS INTEGER) AS tb_den FROM {PACKETS_SQL}")
def s07_ivf_packets(spark, sf_dir):
    """Packets of a simple container, written here byte by byte and demultiplexed."""
    little = lambda c, n: F.reverse(F.lpad(F.hex(c), n * 2, "0"))  # noqa: E731  nibbles from the low end
    swap = lambda c, n: F.unhex(F.regexp_replace(little(c, n), "(.)(.)", "$2$1"))
    p = packets(spark, sf_dir)
    frame = F.concat(swap(F.length("kind").cast("long"), 4), swap(F.expr("us div 1000"), 8), F.col("kind").cast("binary"))
    head = F.concat(F.lit("DKIF").cast("binary"), F.unhex(F.lit("00002000")), F.lit("AV01").cast("binary"), F.unhex(F.lit("80023801E803000001000000" + "00" * 8)))
    frames = F.transform(F.array_sort(F.collect_list(F.struct("seq", frame.alias("f")))), lambda x: F.hex(x["f"]))
    files = p.groupBy(F.col("stream").cast("string").alias("path")).agg(F.concat(head, F.unhex(F.array_join(frames, ""))).alias("content"))
    return containers.demux_files(files)


@query("SELECT vec_id, list_transform(embedding, lambda x: CAST(CAST(x * 32767 AS SMALLINT) AS DOUBLE) / 32768) AS samples FROM embeddings")
def f08_samples(spark, sf_dir):
    """Little-endian PCM bytes to floating point."""
    from ..functions import pcm

    short = lambda x: F.bround(x.cast("float") * F.lit(32767.0).cast("float")).cast("long")
    hexed = F.transform("embedding", lambda x: F.lpad(F.hex(F.pmod(short(x), F.lit(65536))), 4, "0"))
    raw = F.unhex(F.array_join(F.transform(hexed, lambda h: F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2))), ""))
    return table(spark, sf_dir, "embeddings").select("vec_id", pcm.decoder("S16")(raw).alias("samples"))


@query("SELECT DISTINCT l_orderkey * l_linenumber AS num, l_partkey AS den, l_orderkey * l_linenumber // gcd(l_orderkey * l_linenumber, l_partkey) AS rnum, l_partkey // gcd(l_orderkey * l_linenumber, l_partkey) AS rden FROM lineitem WHERE l_partkey > 0")
def f16_reduced(spark, sf_dir):
    """Rationals in lowest terms."""
    from ..functions import pcm

    l = table(spark, sf_dir, "lineitem").filter("l_partkey > 0").select((F.col("l_orderkey") * F.col("l_linenumber")).alias("num"), F.col("l_partkey").alias("den")).distinct()  # noqa: E741
    return l.withColumn("r", pcm.reduce(F.col("num"), F.col("den"))).select("num", "den", F.col("r.num").alias("rnum"), F.col("r.den").alias("rden"))


@query("""WITH d AS (SELECT doc_id, hex(encode(text)) AS h, CAST(octet_length(encode(text)) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL), v AS (SELECT *, unnest(range(20)) AS i FROM d),
p AS (SELECT *, CASE i WHEN 16 THEN 0 WHEN 17 THEN n // 2 WHEN 18 THEN 3 ELSE n - 1 END AS spot, least((i - 12) * (n // 4), n - 1) AS z FROM v),
m AS (SELECT doc_id, i, CASE WHEN n = 0 THEN '' WHEN i < 8 THEN substr(h, 1, 2 * greatest(1, n // ([1, 1, 2, 4, 8, 16, 32, 64])[i + 1]))
 WHEN i < 12 THEN array_to_string(list_transform(regexp_extract_all(h, '..'), lambda x, k: CASE WHEN k <= 65536 AND (k - 1) % (7 + 3 * (i - 8)) = 0 THEN printf('%02X', 255 - CAST('0x' || x AS INT)) ELSE x END), '')
 WHEN i < 16 THEN substr(h, 1, 2 * z) || repeat('00', least(4096, n - z)) || substr(h, 2 * least(z + 4096, n) + 1)
 WHEN spot >= n THEN h ELSE substr(h, 1, 2 * spot) || printf('%02X', 255 - CAST('0x' || substr(h, 2 * spot + 1, 2) AS INT)) || substr(h, 2 * spot + 3) END AS hx FROM p)
SELECT doc_id, CAST(i AS INTEGER) AS mutation, md5(unhex(hx)) AS md5 FROM m""")
def f15_mutations(spark, sf_dir):
    """Twenty damaged versions of each file."""
    from ..functions import pcm

    d = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.encode("text", "UTF-8").alias("content")).filter("content IS NOT NULL")
    return pcm.mutated(d, "content").select("doc_id", "mutation", F.md5("content").alias("md5"))


@query("SELECT 'gen:' || lower(n_name) AS path, [r_name, 'row ' || n_nationkey] AS rows, CAST(n_nationkey % 3 AS INTEGER) AS audio FROM nation JOIN region ON r_regionkey = n_regionkey")
def s10_manifest(spark, sf_dir):
    """Entries of a manifest, which is a configuration: here with one for each nation, a table of fixed size."""
    found = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    entry = F.format_string('[[sample]]\npath = "gen:%s"\nrows = ["%s", "row %d"]\ncompare = ["video:md5"]\n[sample.streams]\naudio = %d\n', F.lower("n_name"), F.col("r_name"), F.col("n_nationkey"), F.col("n_nationkey") % 3)
    rows = found.select(entry.alias("entry"), F.array("r_name", F.concat(F.lit("row "), F.col("n_nationkey").cast("string"))).alias("rows")).collect()
    entries, errors = records.read_manifest(spark, "".join(r["entry"] for r in rows), [x for r in rows for x in r["rows"]])
    assert not errors
    return entries.select("path", "rows", F.col("streams")["audio"].alias("audio"))


@query("SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 3 = 0 THEN 'amr' END AS container, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS packets, doc_id % 3 = 0 AS ok FROM documents")
def r14_fault_isolation(spark, sf_dir):
    """A damaged file is reported and the others go on."""
    frame = "3C" + "00" * 31
    amr = F.unhex(F.lit("2321414D520A" + frame * 2 + "3C"))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 3 == 0, amr).otherwise(F.encode("text", "UTF-8")).alias("content"))
    return containers.demux_report(files).select("path", "container", "packets", "ok")

