"""Media columns: bytes kept as WAV sound, read back, and fingerprinted by spectral-peak pairs.

The payload of a text is its UTF-8 bytes and zero bytes up to a positive multiple of
64, stored losslessly as mono 8-bit samples by the standard ``wave`` module.  Features
come from the samples as read back: a short-time Fourier transform (Hann window), in each
frame the two strongest local maxima of the spectrum, and pairs of those: the two of one frame, and
the strongest one with that of each of the next frames.  A pair is a (time, code)
entry of a time-coded array, the code holding both frequencies and their distance in time.

Defined results: null and empty text are 64 zero bytes, which are silence and have no
pairs; equal texts give equal media and features, repeated rows too; of equally strong maxima the lower frequency counts; an empty
table gives an empty result, and other columns don't matter, whatever their names; texts of any length are stored and
analysed whole, in blocks of frames, so that memory beside the payload is bounded.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .runtime import map_columns, text_or_empty

UNIT, RATE, FRAME, HOP, AHEAD, BLOCK = 64, 8000, 256, 128, 3, 2048
_WINDOW = np.hanning(FRAME).astype(np.float32)


def payload(text: str) -> tuple[int, bytes]:
    """Bytes of the text, and those padded to a positive multiple of UNIT."""
    data = text.encode()
    return len(data), data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def to_wav(data: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(data)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def _peaks(spectrum: np.ndarray) -> np.ndarray:
    """Frequencies of the two strongest local maxima in each row, -1 where there is none."""
    inner = spectrum[:, 1:-1]
    tops = np.where((inner > spectrum[:, :-2]) & (inner >= spectrum[:, 2:]) & (inner > 1e-3), inner, 0.0)
    rows = np.arange(len(tops))
    out = np.full((len(tops), 2), -1, dtype=np.int64)
    for k in range(2):
        best = tops.argmax(axis=1)
        found = tops[rows, best] > 0
        out[found, k] = best[found] + 1
        tops[rows, best] = 0.0
    return out


def fingerprint(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times and codes of the peak pairs of 8-bit samples, by time, then distance."""
    samples = np.frombuffer(data, dtype=np.uint8)
    count = 1 + max(0, -(-(len(samples) - FRAME) // HOP))
    found = []
    for start in range(0, count, BLOCK):
        stop = min(count, start + BLOCK)
        part = samples[start * HOP : (stop - 1) * HOP + FRAME].astype(np.float32)
        # only the last frame of all can be short: it goes on with its mean, and each frame's mean is taken off
        last = (stop - start - 1) * HOP
        part = np.pad(part, (0, last + FRAME - len(part)), constant_values=part[last:].mean())
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        frames = frames - frames.mean(axis=1, keepdims=True)
        found.append(_peaks(np.abs(np.fft.rfft(frames * _WINDOW, axis=1))))
    peaks = np.concatenate(found)
    times, codes = [], []
    for ahead in range(AHEAD + 1):
        first, second = (peaks[:, 0], peaks[:, 1]) if not ahead else (peaks[:-ahead, 0], peaks[ahead:, 0])
        at = np.flatnonzero((first >= 0) & (second >= 0))
        times.append(at)
        codes.append((first[at] << 16) | (second[at] << 8) | ahead)
    times, codes = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((codes & 0xFF, times))
    return times[order].astype(np.int32), codes[order].astype(np.int32)


def media_columns(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, n_bytes, media binary, times array<int>, codes array<int>)`` of every row."""

    def kernel(ids, texts):
        sizes, media, times, codes = [], [], [], []
        for text in texts:
            n, data = payload(text)
            wav = to_wav(data)
            t, c = fingerprint(from_wav(wav))
            sizes.append(n)
            media.append(wav)
            times.append(t)
            codes.append(c)
        return ids, sizes, media, times, codes

    kind = docs.schema[id_column].dataType.simpleString()
    return map_columns(docs, [docs[id_column], text_or_empty(docs, text_column).alias("text")], f"{id_column} {kind}, n_bytes long, media binary, times array<int>, codes array<int>", kernel)


def digests(columns: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Digests of ``media_columns``: the stored form is read back once more, from the column."""

    def kernel(ids, sizes, media, times, codes):
        rows = []
        for n, wav, t, c in zip(sizes, media, times, codes):
            data = from_wav(wav)
            feature = hashlib.sha256(np.array(t, dtype="<i4").tobytes() + np.array(c, dtype="<i4").tobytes()).hexdigest()
            rows.append((n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(wav), hashlib.sha256(wav).hexdigest(), f"{len(t)}:{feature}", len(t)))
        return [ids, *map(list, zip(*rows))]

    kind = columns.schema[id_column].dataType.simpleString()
    schema = f"{id_column} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pairs long"
    return map_columns(columns, [id_column, "n_bytes", "media", "times", "codes"], schema, kernel)
