"""Coded pictures by their units: escaping, a checksum, and where decoding can start."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unit and message types of the two codecs.
AVC_SLICE, AVC_IDR, AVC_SEI = 1, 5, 6
HEVC_IRAP, HEVC_PICTURES, HEVC_SEI = range(16, 24), range(32), 39
RECOVERY_POINT = 6
CRC_POLYNOMIAL = 0x04C11DB7


def escape(data: bytes) -> bytes:
    """A 3 goes before what would look like a start code or an escape: any byte up to 3 behind two zeros."""
    out, zeros = bytearray(), 0
    for b in data:
        if zeros == 2 and b <= 3:
            out.append(3)
            zeros = 0
        out.append(b)
        zeros = zeros + 1 if b == 0 else 0
    return bytes(out)


def unescape(data: bytes) -> bytes:
    """Without the 3 behind two zeros: between such places whole runs are kept."""
    out, start = [], 0
    while (at := data.find(b"\0\0\3", start)) >= 0:
        out.append(data[start : at + 2])
        start = at + 3
    return b"".join([*out, data[start:]])


@functools.lru_cache(maxsize=1)
def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        value = byte << 24
        for _ in range(8):
            value = (value << 1) ^ (CRC_POLYNOMIAL if value >> 31 else 0)
            value &= 0xFFFFFFFF
        table.append(value)
    return table


def crc32_mpeg(data: bytes) -> int:
    """The checksum of transport streams: most significant bit first, started with ones, not inverted at the end."""
    table, value = _crc_table(), 0xFFFFFFFF
    for b in data:
        value = (value << 8 & 0xFFFFFFFF) ^ table[value >> 24 ^ b]
    return value


def units(data: bytes, length_size: int) -> Iterator[bytes]:
    """Units of a packet, each behind its length; behind start codes where ``length_size`` is 0."""
    if length_size:
        at = 0
        while at + length_size <= len(data):
            size = int.from_bytes(data[at : at + length_size])
            at += length_size
            yield data[at : at + size]
            at += size
        return
    for part in data.split(b"\0\0\1")[1:]:
        if unit := part.rstrip(b"\0"):
            yield unit


def _recovery(message: bytes) -> int | None:
    """The pictures until recovery that the first recovery-point message names; message bytes are unescaped."""
    at = 0
    while at + 2 <= len(message) and message[at:] != b"\x80":
        numbers = []
        for _ in range(2):
            value = 0
            while at < len(message) and message[at] == 255:
                value, at = value + 255, at + 1
            if at >= len(message):
                return None
            numbers.append(value + message[at])
            at += 1
        kind, size = numbers
        if kind == RECOVERY_POINT:
            bits = "".join(f"{b:08b}" for b in message[at : at + size])
            zeros = bits.find("1")
            return int(bits[zeros : 2 * zeros + 1], 2) - 1 if 0 <= zeros and 2 * zeros + 1 <= len(bits) else None
        at += size
    return None


def entry(codec: str, data: bytes, length_size: int) -> tuple[str, int | None, bool]:
    """What decoding that starts at a packet gives (``Refresh``, ``Recovery`` after so many pictures, ``Dependent``), and whether it is
    a picture that no other one needs.  A packet without a picture is as the container says: ``Refresh``."""
    picture = starts = reference = False
    recovery = None
    for unit in units(data, length_size):
        if not unit:
            continue
        if codec == "h264":
            kind = unit[0] & 31
            if kind in (AVC_SLICE, AVC_IDR):
                picture, starts, reference = True, starts or kind == AVC_IDR, reference or bool(unit[0] >> 5 & 3)
            elif kind == AVC_SEI and recovery is None:
                recovery = _recovery(unescape(unit[1:]))
        elif codec == "hevc":
            kind = unit[0] >> 1 & 63
            if kind in HEVC_PICTURES:
                picture, starts = True, starts or kind in HEVC_IRAP
            elif kind == HEVC_SEI and _recovery(unescape(unit[2:])) is not None:
                starts = True
    unneeded = codec == "h264" and picture and not reference
    if starts or recovery == 0 or (recovery is None and not picture):
        return "Refresh", None, unneeded
    return ("Recovery", recovery, unneeded) if recovery else ("Dependent", None, unneeded)


def entries(codec: Column, data: Column, length_size: int = 0) -> Column:
    """``struct<entry, frames, unneeded>`` of packets."""

    @F.pandas_udf("entry string, frames int, unneeded boolean")
    def classify(codecs: pd.Series, packets: pd.Series) -> pd.DataFrame:
        rows = [entry(c, bytes(d or b""), length_size) for c, d in zip(codecs, packets)]
        return pd.DataFrame(rows, columns=["entry", "frames", "unneeded"]).astype({"frames": "Int32"})

    return classify(codec, data)


def _bytes_udf(function, kind: str):
    @F.pandas_udf(kind)
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else function(bytes(b)))

    return run


def escaped(data: Column) -> Column:
    return _bytes_udf(escape, "binary")(data)


def unescaped(data: Column) -> Column:
    return _bytes_udf(unescape, "binary")(data)


def checksum(data: Column) -> Column:
    return _bytes_udf(crc32_mpeg, "long")(data)
