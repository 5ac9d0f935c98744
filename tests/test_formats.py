"""Formats with odd and damaged input: SubRip, indexes, placement and styles, captions, coded pictures, stream handles."""

import struct
import time

import pytest

from tickframe.functions import bitstream as B
from tickframe.sources import containers, cues, movtext, vobsub, webvtt
from tickframe.streaming import captions, flows, machines

S = 1_000_000


def srt(text):
    return list(cues.srt(text))


def test_subrip_cues_are_divided_by_timing_lines():
    text = "1\n00:00:10,000 --> 00:00:12,000\nfirst\n\n17\n\nsecond\n2\n00:00:13,500 --> 00:00:14,000\n\n3\n00:00:15,000 --> 00:00:16,250\n1984\n"
    assert srt(text) == [(10 * S, 12 * S, "first\n17\nsecond"), (15 * S, 16_250_000, "1984")]
    # milliseconds are counted, not digits behind a point; a number that isn't alone is text of an empty cue
    assert srt("x\n00:00:01,5 --> 00:00:02.40\n7 dwarfs\n00:00:03,000 --> 00:00:04,000\nz") == [(1_005_000, 2_040_000, "7 dwarfs"), (3 * S, 4 * S, "z")]
    assert srt("no cues\nat all") == [] and srt("") == [] and srt("00:00:01,000 --> 00:00:02,000") == []


def test_timed_text_is_sorted_by_start():
    text = '<tt xmlns="http://www.w3.org/ns/ttml"><body><div><p begin="5s" end="6s">c</p><p begin="1s" end="9s">a</p><p begin="5s" end="7s">d</p><p begin="2s" end="3s">b</p></div></body></tt>'
    assert [c[2] for c in cues.ttml(text)] == ["a", "b", "c", "d"]


INDEX = "# VobSub index file, v7\npalette: 000000\nid: en, index: 3\ntimestamp: 00:00:05:000, filepos: 0000000a0\ndelay: -00:00:01:500\ntimestamp: 00:00:04:000, filepos: 000000010\nid: de, index: 1\r\ntimestamp: 00:01:00:000, filepos: 000000000\nid: en, index: 3\ntimestamp: 00:00:02:000, filepos: 000000010\n"


def test_index_files():
    assert vobsub.read_index(INDEX, 0xA0) == [(0, 3, "en", 500, 16), (0, 3, "en", 2500, 16), (0, 3, "en", 5000, 160), (1, 1, "de", 58_500, 0)]
    for damaged in ("", "id: en, index: 0\n", vobsub.MARK, INDEX.replace("index: 1", "index: 32"), INDEX.replace("00:01:00:000", "00:61:00:000"), INDEX.replace(", filepos: 000000000", ""), vobsub.MARK + "\ntimestamp: 00:00:00:000, filepos: 0\n"):
        with pytest.raises(ValueError):
            vobsub.read_index(damaged, 0xA0)
    with pytest.raises(ValueError):
        vobsub.read_index(INDEX, 0x9F)


def test_index_files_of_a_table(spark):
    files = spark.createDataFrame([("a/x.idx", INDEX.encode()), ("a/x.sub", bytes(200)), ("a/y.idx", INDEX.encode()), ("a/z.idx", b"broken"), ("a/z.sub", b"")], "path string, content binary")
    got = [(r.path, r.track, r.position, r.error) for r in vobsub.read_pairs(files).collect()]
    assert sum(p == "a/x.idx" and e is None for p, _, _, e in got) == 4 and ("a/y.idx", None, None, "no stream beside it") in got and ("a/z.idx", None, None, "no index file") in got and len(got) == 6
    assert vobsub.read_pairs(files.filter("false")).count() == 0


# --- placement and styles -----------------------------------------------------------------------------------------


def test_settings():
    assert webvtt.settings("") == ("", None, True, "start", None, "auto", 100.0, "center", None)
    assert webvtt.settings("line:-2,center position:10.5%,line-right size:40% align:end vertical:lr") == ("lr", -2.0, True, "center", 10.5, "line-right", 40.0, "end", None)
    # what isn't valid is skipped whole
    assert webvtt.settings("line:1,middle line:x line:1.5.2 line:3- position:101% position:5 size:-1% align:top vertical:up :x y: region:none") == webvtt.settings("")
    assert webvtt.settings("region:r", {"r": {}})[-1] == "r" and webvtt.settings("region:r line:1", {"r": {}})[-1] is None
    assert webvtt.placed(None, "auto", "start") == (0.0, "line-left") and webvtt.placed(None, "auto", "start", rtl=True) == (100.0, "line-right") and webvtt.placed(30.0, "center", "end") == (30.0, "center")


def test_colors():
    assert [webvtt.color(c) for c in ("Lime", "#f00", "#12345678", "rgb(0, 128, 255)", "rgba(0,0,0,0.5)", "rgb(100% 0% 0% / 50%)", "transparent", "#12", "nonsense")] == ["00ff00ff", "ff0000ff", "12345678", "0080ffff", "00000080", "ff000080", "00000000", None, None]


def test_the_cascade():
    sheet = webvtt.rules(["::cue { color: white; background-color: rgba(0,0,0,0.8) }\n::cue(.shout) { color: red; font-weight: bold }", "/* later */ ::cue(c) { color: lime; font-size: 50% }\n::cue(b i) { text-decoration: underline }\n::cue(#last) { opacity: 40% }\n::cue(v[voice=Ann]) { font-style: italic }\np { color: blue }\n::cue(c:future) { color: blue }"])
    runs = list(webvtt.styled("<v Ann>One <c.shout>two</c></v><c>three<c>four</c></c> <b>five<i>six</i></b><i>seven &amp; more</i>", "first", sheet))
    by = {text: (voice, s) for text, voice, s in runs}
    assert [text for text, _, _ in runs] == ["One ", "two", "three", "four", " ", "five", "six", "seven & more"]
    assert by["One "][0] == "Ann" and by["One "][1].italic and by["three"][0] is None
    assert (by["two"][1].color, by["two"][1].bold, by["two"][1].italic, by["two"][1].size) == ("ff0000ff", True, True, 0.5)
    assert (by["three"][1].color, by["three"][1].size, by["four"][1].size) == ("00ff00ff", 0.5, 0.25)
    assert by["six"][1].underline and by["six"][1].bold and not by["seven & more"][1].underline
    assert all(s.background == "000000cc" and s.opacity == 1 for _, s in by.values())
    assert next(webvtt.styled("x", "last", sheet))[2].opacity == 0.4


def test_damaged_webvtt():
    assert webvtt.read("WEBVTTX\n\n00:01.000 --> 00:02.000\nx").cues == [] and webvtt.read("").cues == []
    file = webvtt.read("WEBVTT - note\n\nSTYLE\n::cue { color: red\n\nNOTE x\n\nlast\n00:01.000 --> 00:02.000 line:1\nx\n\nSTYLE\n::cue { color: red }\n\n00:05.000 -> 00:06.000\ny")
    assert [(c[0], c[3].strip(), c[4]) for c in file.cues] == [("last", "line:1", "x")] and webvtt.rules(file.sheets) == []
    assert [r[0] for r in webvtt.styled("</b><00:01.000>a<unknown>b</c><b>c", "", [])] == ["a", "b", "c"]


# --- captions -----------------------------------------------------------------------------------------------------


def screens(machine, *packets):
    state, out = machine.initial(), []
    for at, data in packets:
        out += machine.step(state, {"at": at, "data": data})
    return out + list(machine.finish(state))


def text(s):
    return (s + "\0" * (len(s) % 2)).encode().hex()


def test_pop_on_captions():
    first, second = "142014201470" + text("Hello") + "142f142f", "1420142e" + "1450" + text("row one") + "1470" + text("row two") + "142f"
    assert screens(captions.buffered, (1, first), (5, second), (9, "142c142c"), (12, first)) == [(1, 5, "Hello"), (5, 9, "row one\nrow two"), (12, None, "Hello")]
    assert screens(captions.live, (1, first), (5, second), (9, "142c")) == [(1, None, "Hello"), (5, None, "row one\nrow two"), (9, None, "")]
    parity = bytes(b | (0x80 if bin(b).count("1") % 2 == 0 else 0) for b in bytes.fromhex(first)).hex()
    assert screens(captions.buffered, (1, parity), (2, "142c")) == [(1, 2, "Hello")]


def test_roll_up_and_paint_on_captions():
    assert screens(captions.buffered, (0, "1425142d"), (1, text("one")), (3, "142d"), (4, text("two")), (6, "142d"), (7, text("three")), (9, "142c")) == [(0, 3, "one"), (3, 6, "one\ntwo"), (6, 9, "two\nthree")]
    assert screens(captions.buffered, (0, "142c1429"), (1, "1470" + text("ab") + "1421" + text("cd")), (4, "142c")) == [(0, 4, "acd")]
    # special, extended and overridden characters; tabs and indents
    assert screens(captions.buffered, (0, "14201474" + text("a*") + "1137" + text("e") + "1221" + "1722" + text("z") + "142f"), (1, "142c")) == [(0, 1, "aá♪É  z")]


def test_captions_with_state_between_batches(spark):
    rows = [(s, i, 10 * i, "142c" if i % 3 == 2 else "1420142e1470" + text(f"s{s} n{i}") + "142f") for s in range(3) for i in range(9)]
    df = spark.createDataFrame(rows, "stream long, seq long, at long, data string").repartition(3)
    got = sorted(map(tuple, machines.run_batch(df, "stream", "seq", captions.buffered).collect()))
    assert got == sorted((s, 10 * i, 10 * i + 10, f"s{s} n{i}") for s in range(3) for i in range(9) if i % 3 < 2)


# --- coded pictures -----------------------------------------------------------------------------------------------

IDR, OTHER, UNNEEDED, MARK = b"\x65\x88", b"\x41\x9a", b"\x01\x9e", b"\x09\x10"


def avc(*units, size=4):
    return B.entry("h264", b"".join(len(u).to_bytes(size) + u for u in units), size)


def test_entry_points():
    assert avc(MARK, IDR) == ("Refresh", None, False) and avc(MARK, OTHER) == ("Dependent", None, False) and avc(MARK) == ("Refresh", None, False)
    assert avc(UNNEEDED, UNNEEDED)[2] and not avc(UNNEEDED, OTHER)[2] and avc(b"", IDR, size=2)[0] == "Refresh"
    # an earlier message of another kind, with escaped bytes in it, doesn't hide the recovery point
    sei = b"\x06\x04\x04\x00\x00\x03\x00\xff\x06\x01\xc4\x80"
    assert avc(sei, OTHER) == ("Refresh", None, False) and avc(b"\x06\x06\x01\x49\x80", OTHER) == ("Recovery", 1, False)
    assert avc(b"\x06\x01\x01\x80\x80", OTHER)[0] == "Dependent" and avc(b"\x06\xff", OTHER)[0] == "Dependent"
    assert B.entry("h264", b"\0\0\1" + IDR, 0)[0] == B.entry("hevc", b"\0\0\0\1\x2a\1", 0)[0] == B.entry("vp9", b"x", 0)[0] == "Refresh"
    assert B.entry("hevc", b"\0\0\1\x02\1", 0)[0] == "Dependent"


def test_escapes_and_checksum():
    import random

    r = random.Random(1)
    for _ in range(500):
        data = bytes(r.choice((0, 0, 0, 1, 2, 3, 4, 255)) for _ in range(r.randrange(30)))
        coded = B.escape(data)
        assert B.unescape(coded) == data and not any(coded[i : i + 3] in (b"\0\0\0", b"\0\0\1", b"\0\0\2") for i in range(len(coded)))
    assert B.crc32_mpeg(b"123456789") == 0x0376E6E7 and B.crc32_mpeg(b"") == 0xFFFFFFFF


# --- handles on streams -------------------------------------------------------------------------------------------


def test_monitor(spark, tmp_path):
    def write(i):
        spark.createDataFrame([(i,)], "n long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def start():
        rows = flows.tail(spark, str(tmp_path / "in"), "n long")
        return rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="200 milliseconds").start()

    def wait(condition, seconds=60):
        end = time.time() + seconds
        while not condition() and time.time() < end:
            time.sleep(0.2)
        assert condition()

    write(1)
    monitor, heard = flows.Monitor(start), []
    monitor.on_starved(spark, heard.append)
    try:
        monitor.query.processAllAvailable()
        monitor.suspend()
        write(2)
        assert monitor.query is None and [r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]
        monitor.resume()
        monitor.query.processAllAvailable()
        assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]
        wait(lambda: heard[-1:] == [True], 90)
        monitor.stop()
        with pytest.raises(RuntimeError):
            monitor.resume()
    finally:
        monitor.stop()
        spark.streams.removeListener(monitor.listener)


# --- containers ---------------------------------------------------------------------------------------------------


def packets(data):
    name, rows, error = containers.packets_of(data)
    return name, [(pts, duration, size) for _, _, pts, duration, _, size, _, _ in rows], error


def chunk(kind, body):
    return kind + struct.pack(">q", len(body)) + body


def test_audio_containers():
    tta = b"TTA1" + struct.pack("<HHHIII", 1, 2, 16, 44100, 100_000, 0) + struct.pack("<III", 5, 6, 7) + bytes(4) + bytes(18)
    length = 44100 * 256 // 245
    assert packets(tta) == ("tta", [(0, length, 5), (length, length, 6), (2 * length, 100_000 - 2 * length, 7)], None)
    assert packets(tta[:-1])[1] == packets(tta)[1][:2] and packets(tta[:30])[2].startswith("error")
    block = lambda index, flags, body: b"wvpk" + struct.pack("<IHBBIIIII", 24 + len(body), 0x410, 0, 0, 300, index, 100, flags | 9 << 23, 0) + body
    assert packets(block(0, 0x1800, b"ab") + block(100, 0x800, b"c") + block(100, 0x1000, b"d") + block(200, 0x1800, b"e")[:-1]) == ("wv", [(0, 100, 34), (100, 100, 66)], None)
    head = lambda each, frames: b"caff" + bytes(4) + chunk(b"desc", struct.pack(">d4sIIIII", 48000.0, b"lpcm", 0, each, frames, 1, 16))
    assert packets(head(4, 2) + chunk(b"data", bytes(4 + 9))) == ("caf", [(0, 2, 4), (2, 2, 4)], None)
    table = struct.pack(">qqii", 3, 0, 0, 0)
    assert packets(head(0, 1024) + chunk(b"pakt", table + bytes((3, 0x81, 0, 2))) + chunk(b"data", bytes(4 + 200))) == ("caf", [(0, 1024, 3), (1024, 1024, 128), (2048, 1024, 2)], None)
    assert packets(head(0, 0) + chunk(b"pakt", table + bytes((3, 10, 4, 20, 9, 30))) + chunk(b"data", bytes(4 + 7)))[1] == [(0, 10, 3), (10, 20, 4)]
    assert packets(head(0, 1))[2] is not None and packets(b"caff")[2] is not None
    frame = lambda rate, code: (b"\x0b\x77\0\0" + bytes((rate << 6 | code, 8 << 3))).ljust({0: 128, 1: 138 + 2 * (code & 1), 2: 192}[rate], b"x")
    assert packets(frame(0, 0) + b"??" + frame(1, 1) + frame(1, 0) + frame(2, 0)[:-1]) == ("ac3", [(0, 1536, 128), (1536, 1536, 140), (3072, 1536, 138)], None)
    assert packets(b"\x0b\x77\0\0\xff\xff") == ("ac3", [], None)


def test_more_audio_containers():
    part = lambda kind, words, code: b"\x0b\x77" + bytes((kind << 6 | words - 1 >> 8, words - 1 & 255, code, 16 << 3)) + bytes(2 * words - 6)
    assert packets(part(0, 10, 0b00_11_0000) + part(1, 6, 0) + part(0, 300, 0b11_01_0000) + part(0, 9, 0)[:-1]) == ("eac3", [(0, 1536, 32), (1536, 1536, 600)], None)
    assert packets(b"\0\x08\0\0" + bytes(260) + b"\2" + bytes(2048 - 265) + bytes(424 + 100)) == ("aea", [(0, 512, 424), (512, 512, 100)], None)
    big = lambda kind, body: kind + struct.pack(">Q", len(body)) + body + bytes(len(body) & 1)
    sound = big(b"PROP", b"SND " + big(b"FS  ", struct.pack(">I", 2822400)) + big(b"CHNL", struct.pack(">H", 2) + b"SLFTSRGT"))
    assert packets(big(b"FRM8", b"DSD " + big(b"FVER", b"abc") + sound + big(b"DSD ", bytes(2048 + 7)))) == ("dff", [(0, 1024, 2048), (1024, 3, 6)], None)
    head = lambda fixed: (b"RIFF" + bytes(4) + b"QLCMfmt " + bytes(106) + struct.pack("<HHHH", fixed, 160, 8000, 16) + struct.pack("<I", 3) + bytes((3, 1, 7, 2, 9, 200))).ljust(170, b"\0")
    assert packets(head(35) + b"vrat" + struct.pack("<III", 8, 1, 0) + b"data" + struct.pack("<I", 15) + b"\2abcdefg" + b"\3" + b"\1abc" + b"\2a") == ("qcp", [(0, 160, 7), (160, 160, 3), (320, 160, 1)], None)
    assert packets(head(4) + b"data" + struct.pack("<I", 6) + b"\1abc\1a")[1] == [(0, 160, 3), (160, 160, 1)]
    assert packets((b"\xd5" + bytes(32)) * 40 + b"\xd1") == ("gsm", [(n, 1, 33) for n in range(40)], None) and packets(b"\xd5" * 20)[0] is None


def test_text_samples():
    style = lambda *rows: struct.pack(">I4sH", 10 + 12 * len(rows), b"styl", len(rows)) + b"".join(struct.pack(">HHHBB4s", a, b, 1, flags, 20, bytes((1, 2, 3, 4))) for a, b, flags in rows)
    assert movtext.read_sample(b"\0\5Hello" + b"\0\0\0\x08none" + style((1, 3, movtext.BOLD), (3, 3, 1), (4, 9, 6))) == ("Hello", [(1, 3, 1, 20, "01020304"), (4, 5, 6, 20, "01020304")])
    assert movtext.read_sample(b"\0\0") == ("", []) and movtext.read_sample(b"\0\6" + "hé".encode("utf-16"))[0] == "hé" and movtext.read_sample(b"\0\1a\0\0\0\xffstyl") == ("a", [])
    for damaged in (b"", b"\0", b"\0\1"):
        with pytest.raises(ValueError):
            movtext.read_sample(damaged)
