"""Simple containers to packet rows: (path, seq, stream, pts, duration, keyframe, size, tb_num, tb_den).

Each demultiplexer is a generator over a file's bytes by the format's public description.  Files are
parsed where they are read; packets carry sizes, not payloads, unless asked for.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

Packet = tuple[int, int | None, int | None, bool, bytes, int, int]
DEMUXERS: dict[str, tuple[Callable[[bytes], bool], Callable[[bytes], Iterator[Packet]]]] = {}
SCHEMA = "path string, container string, seq int, stream int, pts long, duration long, keyframe boolean, size long, tb_num int, tb_den int"


def demuxer(name: str, probe: Callable[[bytes], bool]):
    def add(function):
        DEMUXERS[name] = (probe, function)
        return function

    return add


@demuxer("ivf", lambda b: b[:4] == b"DKIF")
def ivf(data: bytes) -> Iterator[Packet]:
    head, = struct.unpack_from("<H", data, 6)
    den, num = struct.unpack_from("<II", data, 16)
    at = head
    while at + 12 <= len(data):
        size, pts = struct.unpack_from("<Iq", data, at)
        body = data[at + 12 : at + 12 + size]
        if len(body) < size:
            return
        key = not body[0] & 1 if body and data[8:12] == b"VP80" else at == head
        yield 0, pts, 1, key, body, num, den
        at += 12 + size


#: Payload bytes of narrow-band and wide-band speech frames by type.
AMR_NB, AMR_WB = [12, 13, 15, 17, 19, 20, 26, 31, 5, 0, 0, 0, 0, 0, 0, 0], [17, 23, 32, 36, 40, 46, 50, 58, 60, 5, 0, 0, 0, 0, 0, 0]


@demuxer("amr", lambda b: b.startswith(b"#!AMR"))
def amr(data: bytes) -> Iterator[Packet]:
    wide = data.startswith(b"#!AMR-WB\n")
    at, n, sizes, rate = (9, 0, AMR_WB, 16000) if wide else (6, 0, AMR_NB, 8000)
    while at < len(data):
        size = 1 + sizes[data[at] >> 3 & 15]
        if at + size > len(data):
            return
        yield 0, n * rate // 50, rate // 50, True, data[at : at + size], 1, rate
        at, n = at + size, n + 1


@demuxer("voc", lambda b: b.startswith(b"Creative Voice File\x1a"))
def voc(data: bytes) -> Iterator[Packet]:
    at, = struct.unpack_from("<H", data, 20)
    done, rate = 0, 8000
    while at < len(data) and data[at]:
        size = int.from_bytes(data[at + 1 : at + 4], "little")
        kind, body = data[at], data[at + 4 : at + 4 + size]
        if kind == 1 and len(body) > 2:
            rate, body = 1_000_000 // (256 - body[0]), body[2:]
        elif kind == 9 and len(body) > 12:
            rate, body = struct.unpack_from("<I", body)[0], body[12:]
        elif kind != 2:
            body = b""
        if body:
            yield 0, done, len(body), True, body, 1, rate
            done += len(body)
        at += 4 + size


@demuxer("dsf", lambda b: b[:4] == b"DSD ")
def dsf(data: bytes) -> Iterator[Packet]:
    channels, rate = struct.unpack_from("<II", data, 28 + 24)
    block, = struct.unpack_from("<I", data, 28 + 44)
    at = 28 + 52 + 12
    step, n = block * channels, 0
    while step and at + step <= len(data):
        yield 0, n * block, block, True, data[at : at + step], 8, rate
        at, n = at + step, n + 1


@demuxer("sup", lambda b: b[:2] == b"PG")
def sup(data: bytes) -> Iterator[Packet]:
    """Presentation graphics: a packet a display set, up to and with its end segment."""
    at, start, pts = 0, 0, None
    while at + 13 <= len(data) and data[at : at + 2] == b"PG":
        stamp, = struct.unpack_from(">I", data, at + 2)
        kind, size = data[at + 10], int.from_bytes(data[at + 11 : at + 13], "big")
        pts = stamp if pts is None else pts
        at += 13 + size
        if kind == 0x80:
            yield 0, pts, None, True, data[start:at], 1, 90000
            start, pts = at, None


@demuxer("tta", lambda b: b[:4] == b"TTA1")
def tta(data: bytes) -> Iterator[Packet]:
    """Lossless audio: a table of frame sizes, each but the last of 256 / 245 seconds."""
    rate, samples = struct.unpack_from("<II", data, 10)
    length = rate * 256 // 245
    count = -(-samples // length)
    at = 22 + 4 * count + 4
    for n, size in enumerate(struct.unpack_from(f"<{count}I", data, 22)):
        if at + size > len(data):
            return
        yield 0, n * length, min(length, samples - n * length), True, data[at : at + size], 1, rate
        at += size


#: Sampling rates by index.
WAVPACK_RATES = (6000, 8000, 9600, 11025, 12000, 16000, 22050, 24000, 32000, 44100, 48000, 64000, 88200, 96000, 192000)


@demuxer("wv", lambda b: b[:4] == b"wvpk")
def wavpack(data: bytes) -> Iterator[Packet]:
    """Blocks of samples; those of several channel pairs at one time are one packet, from a first to a final block."""
    at, start = 0, 0
    while at + 32 <= len(data) and data[at : at + 4] == b"wvpk":
        size, = struct.unpack_from("<I", data, at + 4)
        index, samples, flags = struct.unpack_from("<III", data, at + 16)
        start = at if flags & 0x800 else start
        at += size + 8
        if at > len(data):
            return
        if flags & 0x1000 and samples:
            yield 0, index, samples, True, data[start:at], 1, WAVPACK_RATES[flags >> 23 & 15]


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = 0
    while data[at] & 0x80:
        value, at = value << 7 | data[at] & 0x7F, at + 1
    return value << 7 | data[at], at + 1


@demuxer("caf", lambda b: b[:4] == b"caff")
def caf(data: bytes) -> Iterator[Packet]:
    """Packets of one size each, or of those in the packet table."""
    at, chunks = 8, {}
    while at + 12 <= len(data):
        size, = struct.unpack_from(">q", data, at + 4)
        stop = len(data) if size < 0 else at + 12 + size
        chunks.setdefault(data[at : at + 4], data[at + 12 : stop])
        at = stop
    rate, _, _, each, frames, *_ = struct.unpack_from(">d4sIIIII", chunks[b"desc"])
    body, done, start = chunks.get(b"data", b"")[4:], 0, 0
    if each:
        sizes = ((each, frames) for _ in range(len(body) // each))
    else:
        sizes = _packet_table(chunks[b"pakt"], frames)
    for size, length in sizes:
        if start + size > len(body):
            return
        yield 0, done, length, True, body[start : start + size], 1, int(rate)
        start, done = start + size, done + length


def _packet_table(table: bytes, frames: int) -> Iterator[tuple[int, int]]:
    at = 24
    for _ in range(struct.unpack_from(">q", table)[0]):
        size, at = _varint(table, at)
        length = frames
        if not frames:
            length, at = _varint(table, at)
        yield size, length


#: Sampling rates and, two codes each, bit rates in kbit/s.
AC3_RATES = (48000, 44100, 32000)
AC3_KBITS = (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384, 448, 512, 576, 640)
AC3_SAMPLES = 1536


#: Blocks of 256 samples by code.
EAC3_BLOCKS = (1, 2, 3, 6)


@demuxer("eac3", lambda b: b[:2] == b"\x0b\x77" and len(b) > 5 and 10 < b[5] >> 3 <= 16)
def eac3(data: bytes) -> Iterator[Packet]:
    """Frames with those that depend on them; a rate code of 3 halves the rate that the next bits name."""
    at, done, start, found = 0, 0, 0, None
    while at + 6 <= len(data) and data[at : at + 2] == b"\x0b\x77":
        kind, size = data[at + 2] >> 6, 2 * ((data[at + 2] & 7) << 8 | data[at + 3]) + 2
        code, second = data[at + 4] >> 6, data[at + 4] >> 4 & 3
        if kind == 3 or (code == 3 and second == 3) or at + size > len(data):
            break
        if kind != 1:
            if found:
                yield 0, done, found[0], True, data[start:at], 1, found[1]
                done += found[0]
            start, found = at, (256 * (6 if code == 3 else EAC3_BLOCKS[second]), AC3_RATES[second] // 2 if code == 3 else AC3_RATES[code])
        at += size
    if found:
        yield 0, done, found[0], True, data[start:at], 1, found[1]


@demuxer("ac3", lambda b: b[:2] == b"\x0b\x77")
def ac3(data: bytes) -> Iterator[Packet]:
    """Frames of 1536 samples; what lies between frames is skipped."""
    at, n = data.find(b"\x0b\x77"), 0
    while 0 <= at and at + 5 <= len(data):
        rate_code, size_code = data[at + 4] >> 6, data[at + 4] & 63
        if rate_code < 3 and size_code < 2 * len(AC3_KBITS) and data[at + 5] >> 3 <= 10:
            rate, bits = AC3_RATES[rate_code], AC3_KBITS[size_code // 2] * 1000 * AC3_SAMPLES
            # in words of 16 bits; where that is no whole number, odd codes have one more
            size = 2 * (bits // (rate * 16) + (size_code & 1 if rate == 44100 else 0))
            if at + size > len(data):
                return
            yield 0, n * AC3_SAMPLES, AC3_SAMPLES, True, data[at : at + size], 1, rate
            at, n = at + size, n + 1
            if data[at : at + 2] == b"\x0b\x77":
                continue
        else:
            at += 1
        at = data.find(b"\x0b\x77", at)


#: Bytes and samples of a sound unit and where the first one is; the sampling rate.
AEA_UNIT, AEA_SAMPLES, AEA_START, AEA_RATE = 212, 512, 2048, 44100


@demuxer("aea", lambda b: b[:4] == b"\0\x08\0\0" and len(b) > 264 and b[264] in (1, 2))
def aea(data: bytes) -> Iterator[Packet]:
    """A sound unit of each channel a packet; the last may be cut short."""
    size = AEA_UNIT * data[264]
    for n, at in enumerate(range(AEA_START, len(data), size)):
        yield 0, n * AEA_SAMPLES, AEA_SAMPLES, True, data[at : at + size], 1, AEA_RATE


@demuxer("dff", lambda b: b[:4] == b"FRM8" and b[12:16] == b"DSD ")
def dff(data: bytes) -> Iterator[Packet]:
    """Plain one-bit sound, 1024 bytes a channel a packet; times count bytes of a channel."""

    def chunks(at: int, stop: int):
        while at + 12 <= stop:
            size, = struct.unpack_from(">Q", data, at + 4)
            yield data[at : at + 4], at + 12, min(stop, at + 12 + size)
            at += 12 + size + (size & 1)

    rate = channels = 0
    for name, start, stop in chunks(16, len(data)):
        if name == b"PROP" and data[start : start + 4] == b"SND ":
            for inner, at, _ in chunks(start + 4, stop):
                if inner == b"FS  ":
                    rate, = struct.unpack_from(">I", data, at)
                elif inner == b"CHNL":
                    channels, = struct.unpack_from(">H", data, at)
        elif name == b"DSD " and rate and channels:
            done = 0
            while start + channels <= stop:
                size = min(1024 * channels, stop - start) // channels * channels
                yield 0, done, size // channels, True, data[start : start + size], 8, rate
                start, done = start + size, done + size // channels


#: Samples of a packet; where the header has its packet size, rate and table of packet sizes.
QCP_SAMPLES, QCP_SIZES, QCP_TABLE, QCP_CHUNKS = 160, 122, 130, 170


@demuxer("qcp", lambda b: b[:4] == b"RIFF" and b[8:16] == b"QLCMfmt ")
def qcp(data: bytes) -> Iterator[Packet]:
    """Speech packets behind a byte that names their rate, or of one size; a chunk of the file can say which."""
    fixed, _, rate = struct.unpack_from("<HHH", data, QCP_SIZES)
    count, = struct.unpack_from("<I", data, QCP_TABLE)
    sizes = {data[QCP_TABLE + 4 + 2 * i + 1]: data[QCP_TABLE + 4 + 2 * i] for i in range(min(count, 8)) if data[QCP_TABLE + 4 + 2 * i + 1] <= 4}
    at, n = QCP_CHUNKS, 0
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        at += 8
        if name == b"vrat":
            fixed = 0 if data[at : at + 4] != bytes(4) else fixed
        if name != b"data":
            at += size + (size & 1)
            continue
        stop = min(len(data), at + size)
        while at < stop:
            own = fixed - 1 if fixed else sizes.get(data[at])
            at += 1
            if own is not None:
                yield 0, n * QCP_SAMPLES, QCP_SAMPLES, True, data[at : min(stop, at + own)], 1, rate
                at, n = min(stop, at + own), n + 1
        at += at & 1


#: Bytes and samples of a block, the rate.
GSM_BLOCK, GSM_SAMPLES, GSM_RATE = 33, 160, 8000


def _is_gsm(data: bytes) -> bool:
    marks = [data[i] & 0xF0 == 0xD0 for i in range(0, len(data) - 32, GSM_BLOCK)]
    return sum(marks) >> 5 > len(marks) - sum(marks)


@demuxer("gsm", _is_gsm)
def gsm(data: bytes) -> Iterator[Packet]:
    """Whole blocks; times count them."""
    for n in range(len(data) // GSM_BLOCK):
        yield 0, n, 1, True, data[n * GSM_BLOCK : (n + 1) * GSM_BLOCK], GSM_SAMPLES, GSM_RATE


def _start_codes(data: bytes) -> Iterator[bytes]:
    at = data.find(b"\0\0\1")
    while at >= 0:
        end = data.find(b"\0\0\1", at + 3)
        yield data[at + 3 : end if end >= 0 else len(data)].rstrip(b"\0")
        at = end


@demuxer("annexb", lambda b: b[:4] == b"\0\0\0\1" or b[:3] == b"\0\0\1")
def annexb(data: bytes) -> Iterator[Packet]:
    """Units of a byte stream with start codes; no times."""
    for unit in _start_codes(data):
        if unit:
            yield 0, None, None, unit[0] & 31 in (5, 7, 8), unit, 1, 1_200_000


def probe(data: bytes) -> str | None:
    return next((name for name, (fits, _) in DEMUXERS.items() if fits(data)), None)


def packets_of(data: bytes) -> tuple[str | None, list[tuple], str | None]:
    """Container, packets and what broke off, if anything: one damaged file doesn't end a job."""
    name, rows = probe(data), []
    try:
        for i, (stream, pts, duration, key, body, num, den) in enumerate(DEMUXERS[name][1](data) if name else ()):
            rows.append((i, stream, pts, duration, key, len(body), num, den))
    except (struct.error, IndexError, KeyError, ZeroDivisionError) as error:
        return name, rows, f"{type(error).__name__}: {error}"
    return name, rows, None if name else "no container"


def demux_files(files: DataFrame) -> DataFrame:
    """Packets of a table of files (path, content); a file that breaks off gives the packets before that."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                name, found, _ = packets_of(bytes(content or b""))
                rows += [(path, name, *r) for r in found]
            out = pd.DataFrame(rows, columns=[f.split()[0] for f in SCHEMA.split(", ")])
            yield out.astype({"pts": "Int64", "duration": "Int64"})

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def demux_report(files: DataFrame) -> DataFrame:
    """``(path, container, packets, ok, error)`` of each file."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                name, found, error = packets_of(bytes(content or b""))
                rows.append((path, name, len(found), error is None, error))
            yield pd.DataFrame(rows, columns=["path", "container", "packets", "ok", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, container string, packets long, ok boolean, error string")


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    return demux_files(spark.read.format("binaryFile").load(path))
