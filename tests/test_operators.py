"""Golden cases and edges that the tables don't have."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tickframe.functions import pcm, timebase
from tickframe.operators import asof, compare, intervals, ordered, stateful, timeline
from tickframe.sources import containers, cues, records, sinks
from tickframe.streaming import flows, machines


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_rescale_halves_and_bounds(spark):
    cases = [(5, 1, 2, 3), (-5, 1, 2, -3), (4, 1, 2, 2), (1, 1, 3, 0), (2**63 - 1, 3, 2, -(2**63)), (7, -1, 2, -(2**63)), (7, 1, 0, -(2**63)), (2**62, 2**62, 2**62, 2**62), (-(2**63), 1, 1, -(2**63))]
    df = spark.createDataFrame(cases, "a long, b long, c long, want long")
    for r in df.withColumn("got", timebase.rescale(F.col("a"), F.col("b"), F.col("c"))).collect():
        assert r.got == r.want, r


@pytest.mark.parametrize("span", [None, 3, 100])
def test_asof_with_ties_and_spans(spark, span):
    r = random.Random(5)
    left = [(k, t, i) for i, (k, t) in enumerate((r.randrange(3), r.randrange(30)) for _ in range(60))]
    right = [(r.randrange(3), r.randrange(30), i) for i in range(25)]
    a = spark.createDataFrame(left, "k int, t long, id int")
    b = spark.createDataFrame(right, "k int, t long, v int")
    back = {x[2]: x[3] for x in rows(asof.asof(a, b, ["k"], "t", ["v"], True, span, tie="v").select("k", "t", "id", "v"))}
    fore = {x[2]: x[3] for x in rows(asof.asof(a, b, ["k"], "t", ["v"], False, span, tie="v").select("k", "t", "id", "v"))}
    for k, t, i in left:
        low = [(u, v) for q, u, v in right if q == k and u <= t]
        high = [(u, v) for q, u, v in right if q == k and u >= t]
        assert back[i] == (max(low)[1] if low else None)
        assert fore[i] == (min(high)[1] if high else None)


def test_state_collapse_ignores_blanks_between(spark):
    df = spark.createDataFrame([(1, 1, "A", False), (1, 2, "A", False), (1, 3, "", True), (1, 4, "A", False), (1, 5, "B", False)], "s int, seq int, md5 string, blank boolean")
    assert [r[1] for r in rows(intervals.collapse_states(df, ["s"], ["seq"], "md5").select("s", "seq"))] == [1, 5]


def test_fill_before_dedupe(spark):
    df = spark.createDataFrame([(0, 20, 2, -1, "b"), (0, 10, 1, 5, "a"), (0, 10, 3, 5, "a"), (0, 30, 4, -1, "c")], "s int, pts long, pos long, duration long, data string")
    out = ordered.drop_adjacent(ordered.fill_durations(df, ["s"], ["pts", "pos"]), ["s"], ["pts", "pos"], ["pts", "duration", "data"])
    assert rows(out.select("pts", "duration", "data")) == [(10, 5, "a"), (20, 10, "b"), (30, -1, "c")]


def test_snr_edges(spark):
    inf = float("inf")
    a = spark.createDataFrame([("same", 0, 1.0), ("quiet", 0, 0.0), ("odd", 0, inf), ("long", 0, 1.0), ("long", 1, 1.0), ("half", 0, 2.0)], "s string, i int, v double")
    b = spark.createDataFrame([("same", 0, 1.0), ("quiet", 0, 0.5), ("odd", 0, 1.0), ("long", 0, 1.0), ("half", 0, 1.0), ("none", 0, 1.0)], "s string, i int, v double")
    got = {r.s: (r.error, r.snr_db) for r in compare.snr(a, b, "s", "i", "v").collect()}
    assert got["same"] == (None, inf) and got["quiet"] == (None, -inf)
    assert got["odd"][0] == "not finite" and got["long"][0] == "length" and got["none"][0] == "empty"
    assert abs(got["half"][1] - 6.0206) < 1e-4


def test_trusted_end_rejects_leaps(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate([0, 5, 100, 12, 101, 20])], "s int, seq int, t long")
    assert rows(timeline.trusted_end(df, ["s"], "seq", "t", 10)) == [(1, 20, 101)]


def test_clock_forms_agree_on_constant_durations(spark):
    df = spark.createDataFrame([(1, i, p, i * 10, 40) for i, p in enumerate([None, None, 100, None, None, 50, None])], "stream long, seq long, pts long, packet_pts long, duration long")
    assert rows(ordered.clock(df, ["stream"], ["seq"]).select("stream", "seq", "time")) == rows(stateful.clock(df))


def test_overlap_pairs_once(spark):
    r = random.Random(2)
    c = [(i, s, s + r.randrange(1, 40)) for i, s in enumerate(r.randrange(100) for _ in range(40))]
    df = spark.createDataFrame([(0, *x) for x in c], "g int, id int, start_us long, end_us long")
    want = [(0, a[0], b[0]) for a, b in itertools.combinations(c, 2) if a[1] < b[2] and b[1] < a[2]]
    assert rows(intervals.overlaps(df, ["g"], "id", 7)) == sorted(want)


def test_display_order_buffer_too_small(spark):
    df = spark.createDataFrame([(1, i, 0, p) for i, p in enumerate([3, 2, 1, 0])], "stream long, seq long, period long, poc long")
    assert [r[2] for r in rows(stateful.display_order(df, 1), "position")] == [2, 1, 0, 3]
    assert [r[2] for r in rows(stateful.display_order(df, 4), "position")] == [0, 1, 2, 3]


SRT = "1\n00:00:01,000 --> 00:00:02,500\nHello\nthere\n\n2\n00:00:03,000 --> 00:00:04,000\n<i>x</i>\n\n"


def test_cue_files():
    assert cues.parse("a.srt", SRT.encode()) == [(1_000_000, 2_500_000, "Hello\nthere"), (3_000_000, 4_000_000, "<i>x</i>")]
    assert cues.parse("a.srt", SRT.replace("\n", "\r\n").encode("utf-16")) == cues.parse("a.srt", SRT.encode())
    assert cues.parse("a.sub", b"{1}{1}25\n{25}{50}a|b\n{75}{}c\nbroken\n") == [(1_000_000, 2_000_000, "a\nb"), (3_000_000, None, "c")]
    assert cues.parse("a.sub", b"[00:00:01]\nx\n[00:00:02]\n\n[00:00:05]\ny\n") == [(1_000_000, 2_000_000, "x"), (5_000_000, None, "y")]
    assert cues.parse("a.smi", b"<SAMI><BODY><SYNC Start=1000><P>a<br>b<SYNC Start=2000><P>&nbsp;</BODY></SAMI>") == [(1_000_000, 2_000_000, "a\nb")]
    assert cues.parse("a.vtt", b"WEBVTT\n\nNOTE x\n\n00:01.000 --> 00:02.000\nq\n") == [(1_000_000, 2_000_000, "q")]
    assert cues.parse("a.srt", "1\n00:00:01,000 --> 00:00:02,000\nžluť\n".encode("cp1250"))[0][2] == "žluť"
    assert cues.parse("a.ttml", b"<tt><broken") == [] and cues.parse("a.srt", b"") == []


@pytest.mark.parametrize("kind", sorted(cues.PARSERS))
def test_cue_parsers_survive_damage(kind):
    samples = [SRT.encode(), b"WEBVTT\n\n00:01.000 --> 00:02.000\nq\n", b"{1}{2}a\n", b"[Events]\nDialogue: 0,0:00:01.00,0:00:02.00,a,,0,0,0,,t\n", b"<tt><body><p begin='1s' end='2s'>a</p></body></tt>"]
    for data in samples:
        for i in range(20):
            cues.parse("x", pcm.mutate(data, i), kind)


def test_files_to_cues_and_back(spark, tmp_path):
    (tmp_path / "one.srt").write_text(SRT)
    read = cues.read_cues(spark, str(tmp_path))
    assert read.count() == 2
    out = sinks.to_srt_files(read).collect()[0].content
    assert cues.parse("x.srt", out.encode()) == cues.parse("x.srt", SRT.encode())


def test_containers(spark):
    voc = b"Creative Voice File\x1a" + (26).to_bytes(2, "little") + b"\x0a\x01\x29\x11" + b"\x01" + (12).to_bytes(3, "little") + bytes([131, 0]) + b"0123456789" + b"\0"
    amr = b"#!AMR\n" + bytes([7 << 3]) + bytes(31) + bytes([7 << 3]) + bytes(31) + b"\x38"
    sup = b"PG" + (90000).to_bytes(4, "big") + bytes(4) + b"\x16\0\x02ab" + b"PG" + (90000).to_bytes(4, "big") + bytes(4) + b"\x80\0\0"
    files = spark.createDataFrame([("v", bytearray(voc)), ("a", bytearray(amr)), ("s", bytearray(sup)), ("n", bytearray(b"\0\0\1\x67ab\0\0\1\x41cd")), ("x", bytearray(b"none")), ("e", None)], "path string, content binary")
    got = rows(containers.demux_files(files).select("path", "seq", "pts", "size", "keyframe"))
    assert got == [("a", 0, 0, 32, True), ("a", 1, 160, 32, True), ("n", 0, None, 3, True), ("n", 1, None, 3, False), ("s", 0, 90000, 28, True), ("v", 0, 0, 10, True)]


def test_cue_sheet():
    text = 'PERFORMER "P"\nTRACK 01 AUDIO\n TITLE "A"\n INDEX 00 00:00:00\n INDEX 01 00:02:00\nTRACK 02 AUDIO\n PERFORMER Q\n INDEX 01 00:61:00\n INDEX 00 01:00:37\n'
    assert records.parse_cue_sheet(text) == [(1, "A", "P", 2 * 10**9), (2, None, "Q", 60 * 10**9 + 37 * 10**9 // 75)]


def test_manifest_errors(spark):
    _, errors = records.read_manifest(spark, '[[sample]]\npath = "x:y"\nrows = ["no"]\nbogus = 1\n', ["yes"])
    assert len(errors) == 3


def test_journal_drops_torn_tail(spark, tmp_path):
    (tmp_path / "j.json").write_text('{"input": 1, "state": "done"}\n{"input": 2, "state": "done"}\n{"inp')
    done = sinks.read_journal(spark, str(tmp_path / "j.json"), "input long, state string").cache()
    assert sorted(r.input for r in done.collect()) == [1, 2]


def _packet_rows(n=120):
    r = random.Random(7)
    out = []
    for i in range(n):
        out.append((i % 3, i, None if r.random() < 0.2 else i * 10 + r.randrange(60), i * 10, r.randrange(3)))
    return out


def test_stream_equals_batch(spark, tmp_path):
    schema = "stream long, seq long, ts long, dts long, size long"
    data = _packet_rows()
    for k in range(0, len(data), 30):
        spark.createDataFrame(data[k : k + 30], schema).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    live = machines.run_stream(flows.tail(spark, str(tmp_path / "in"), schema, 1), "stream", "seq", machines.release)
    flows.capture(live, "released", str(tmp_path / "cp")).awaitTermination(120)
    got = {}
    for r in spark.table("released").collect():
        got.setdefault(r.stream, []).append((r.ts, r.seq))
    want = {}
    for s in range(3):
        state, out = machines.release.initial(), []
        for row in (dict(zip(("stream", "seq", "ts", "dts", "size"), x)) for x in data if x[0] == s):
            out += machines.release.step(state, row)
        want[s] = out
    # files may be read in any order only if their times tie; each group's rows come in order here
    assert got == want


def test_release_is_bounded_and_complete():
    state, out = machines.release.initial(), []
    for i in range(200):
        out += machines.release.step(state, {"ts": 10_000 - i, "dts": None, "seq": i, "size": 1})
        assert len(state["waiting"]) <= machines.WAITING
    assert len([*out, *machines.release.finish(state)]) == 200


def test_windowed_counts(spark, tmp_path, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = flows.windowed(flows.tail(spark, str(tmp_path / "in"), e._jdf.schema().toDDL()), "ts", "event_type", "1 day", "1 hour")
    flows.capture(live, "by_day", str(tmp_path / "cp"), "complete").awaitTermination(120)
    assert spark.table("by_day").agg(F.sum("count")).collect()[0][0] == e.count()


def test_journal_sink_is_idempotent(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        flows.journal(flows.tail(spark, str(tmp_path / "in"), "id long"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.json(str(tmp_path / "out")).count() == 10
