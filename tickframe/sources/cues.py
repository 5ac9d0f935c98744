"""Text cues: subtitle files to interval rows.

``read_cues`` reads whole files as bytes and gives a row a cue: (path, seq, start_us, end_us, text), end_us null
where the file leaves it open.  A parser is a generator over the decoded text; what it can't
read it skips, so a damaged file gives the cues that are whole.  Files are parsed one in a task's row, never gathered.
"""

from __future__ import annotations

import html
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Cue = tuple[int, int | None, str]
SCHEMA = "path string, seq int, start_us long, end_us long, text string"
PARSERS: dict[str, Callable[[str], Iterator[Cue]]] = {}
#: File extensions of the formats.
EXTENSIONS = {"srt": "srt", "vtt": "webvtt", "webvtt": "webvtt", "ass": "ass", "ssa": "ass", "smi": "sami", "sami": "sami", "ttml": "ttml", "dfxp": "ttml", "vpl": "vplayer", "usf": "usf", "cmml": "cmml", "scc": "scc"}


def parser(name: str):
    def add(function):
        PARSERS[name] = function
        return function

    return add


def decode(data: bytes, fallback: str = "cp1250") -> str:
    """UTF-16 by its mark, UTF-8 where valid, else the older code page; line ends made alike."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        text = data.decode("utf-16", "replace")
    else:
        try:
            text = data.decode("utf-8-sig")
        except UnicodeDecodeError:
            text = data.decode(fallback, "replace")
    return text.replace("\r\n", "\n").replace("\r", "\n")


def _us(h, m, s, fraction: str = "0") -> int:
    digits = (fraction + "000000")[:6]
    return ((int(h or 0) * 60 + int(m)) * 60 + int(s)) * 1_000_000 + int(digits)


_SRT = re.compile(r"\s*(\d+):(\d+):(\d+)[,.](\d+)\s*-->\s*(\d+):(\d+):(\d+)[,.](\d+)")
_NUMBER = re.compile(r"\s*\+?\d+")


def _srt_time(h: str, m: str, s: str, ms: str) -> int:
    """The last part counts milliseconds, however many digits it has."""
    return (((int(h) * 60 + int(m)) * 60 + int(s)) * 1000 + int(ms)) * 1000


@parser("srt")
def srt(text: str) -> Iterator[Cue]:
    """Timing lines divide cues; blank lines don't, and aren't kept.  A line that begins with a number is text only
    if text follows it, as the next cue's number doesn't; at the end of the file it is text, and so
    is one that isn't a number alone where the cue has no other text.  Cues without text are left out."""
    cue: tuple[int, int] | None = None
    body: list[str] = []
    number: str | None = None
    for line in [*text.split("\n"), None]:
        if not line and line is not None:
            continue
        m = _SRT.match(line) if line is not None else None
        if line is not None and not m:
            if cue is None:
                continue
            if number is not None:
                body.append(number)
            number = line if _NUMBER.match(line) else None
            if number is None:
                body.append(line)
            continue
        if cue is not None:
            alone = number is not None and _NUMBER.fullmatch(number)
            if number is not None and (line is None or not (body or alone)):
                body.append(number)
            if body:
                yield *cue, "\n".join(body)
        if m:
            g = m.groups()
            cue, body, number = (_srt_time(*g[:4]), _srt_time(*g[4:])), [], None


_VTT = re.compile(r"(?:(\d+):)?(\d{2}):(\d{2})\.(\d{3})\s+-->\s+(?:(\d+):)?(\d{2}):(\d{2})\.(\d{3})")


@parser("webvtt")
def webvtt(text: str) -> Iterator[Cue]:
    if not text.lstrip("﻿").startswith("WEBVTT"):
        return
    for block in re.split(r"\n{2,}", text):
        lines = block.strip("\n").split("\n")
        for i, line in enumerate(lines[:2]):
            if m := _VTT.match(line):
                g = m.groups()
                yield _us(*g[:4]), _us(*g[4:]), "\n".join(lines[i + 1 :])
                break


def _rational(text: str, most: int = 100_000) -> Fraction:
    """A frame rate as a fraction with a bounded denominator."""
    return Fraction(text).limit_denominator(most)


@parser("microdvd")
def microdvd(text: str, rate: str = "24000/1001") -> Iterator[Cue]:
    fps = _rational(rate)
    for line in text.split("\n"):
        m = re.match(r"^\{(\d+)\}\{(\d*)\}(.*)$", line.strip())
        if not m:
            continue
        if m[1] == m[2] == "1" and re.fullmatch(r"\d+(\.\d+)?", m[3].strip()):
            fps = _rational(m[3].strip())
            continue
        at = lambda n: round(int(n) * 1_000_000 / fps)
        yield at(m[1]), at(m[2]) if m[2] else None, re.sub(r"\{[^}]*\}", "", m[3]).replace("|", "\n")


@parser("subviewer2")
def subviewer2(text: str) -> Iterator[Cue]:
    stamp = re.compile(r"^(\d+):(\d+):(\d+)\.(\d+),(\d+):(\d+):(\d+)\.(\d+)\s*$")
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if m := stamp.match(line):
            body = []
            for following in lines[i + 1 :]:
                if not following.strip() or stamp.match(following):
                    break
                body.append(following)
            g = m.groups()
            yield _us(*g[:4]), _us(*g[4:]), "\n".join(body).replace("[br]", "\n")


@parser("subviewer1")
def subviewer1(text: str) -> Iterator[Cue]:
    """A cue ends where the next begins; an empty one only ends the one before."""
    found = []
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if m := re.match(r"^\[(\d+):(\d+):(\d+)\]\s*$", line):
            found.append((_us(*m.groups()), lines[i + 1].strip() if i + 1 < len(lines) and not lines[i + 1].startswith("[") else ""))
    for (start, body), following in zip(found, [*found[1:], (None, "")]):
        if body:
            yield start, following[0], body.replace("|", "\n")


@parser("vplayer")
def vplayer(text: str) -> Iterator[Cue]:
    rows = []
    for line in text.split("\n"):
        if m := re.match(r"^(\d+):(\d+):(\d+)(?:\.(\d+))?[:= ](.*)$", line):
            rows.append((_us(m[1], m[2], m[3], m[4] or "0"), m[5]))
    for (start, body), following in zip(rows, [*rows[1:], (None, "")]):
        if body.strip():
            yield start, following[0], body.replace("|", "\n")


@parser("ass")
def ass(text: str) -> Iterator[Cue]:
    """Dialogue rows by the columns their section names; override codes and line breaks resolved."""
    columns, inside = None, False
    for line in text.split("\n"):
        if line.startswith("["):
            inside = line.strip().lower() == "[events]"
        elif inside and line.startswith("Format:"):
            columns = [c.strip().lower() for c in line[7:].split(",")]
        elif inside and line.startswith("Dialogue:"):
            names = columns or "layer start end style name marginl marginr marginv effect text".split()
            row = dict(zip(names, line[9:].lstrip().split(",", len(names) - 1)))
            stamps = [re.fullmatch(r"(\d+):(\d+):(\d+)\.(\d+)", row.get(k, "").strip()) for k in ("start", "end")]
            if all(stamps):
                body = re.sub(r"\{[^}]*\}", "", row.get("text", ""))
                yield _us(*stamps[0].groups()), _us(*stamps[1].groups()), body.replace("\\N", "\n").replace("\\n", "\n").replace("\\h", " ")


@parser("sami")
def sami(text: str) -> Iterator[Cue]:
    """Each sync point shows until the next; one with only a hard space clears."""
    parts = re.split(r"<\s*sync\b[^>]*?start\s*=\s*[\"']?(\d+)[^>]*>", text, flags=re.I)
    rows = []
    for stamp, body in zip(parts[1::2], parts[2::2]):
        body = re.sub(r"<\s*br\s*/?>", "\n", body.replace("\n", " "), flags=re.I)
        shown = html.unescape(re.sub(r"<[^>]*>", "", body)).replace("\xa0", " ")
        rows.append((int(stamp) * 1000, "\n".join(line.strip() for line in shown.split("\n")).strip()))
    for (start, body), following in zip(rows, [*rows[1:], (None, "")]):
        if body:
            yield start, following[0], body


def _clock(value: str | None) -> int | None:
    if not value:
        return None
    if m := re.fullmatch(r"(?:npt:)?(\d+):(\d+):(\d+)(?:\.(\d+))?", value):
        return _us(m[1], m[2], m[3], m[4] or "0")
    if m := re.fullmatch(r"(?:npt:)?(\d+(?:\.\d+)?)(h|m|s|ms)?", value):
        return round(Fraction(m[1]) * {"h": 3_600_000_000, "m": 60_000_000, "ms": 1000}.get(m[2] or "s", 1_000_000))
    return None


def _elements(text: str, name: str):
    try:
        root = ET.fromstring(text.strip())
    except ET.ParseError:
        return
    for e in root.iter():
        if isinstance(e.tag, str) and e.tag.rpartition("}")[2] == name:
            yield e


def _inner(e) -> str:
    out = [e.text or ""]
    for child in e:
        out.append("\n" if child.tag.rpartition("}")[2] == "br" else _inner(child))
        out.append(child.tail or "")
    return "".join(out)


@parser("ttml")
def ttml(text: str) -> Iterator[Cue]:
    """Paragraphs by their begin, in document order where that is the same."""
    found = []
    for p in _elements(text, "p"):
        begin, end, length = (_clock(p.get(k)) for k in ("begin", "end", "dur"))
        begin = begin or 0
        found.append((begin, end if end is not None else begin + length if length is not None else None, re.sub(r"[ \t]*\n[ \t]*", "\n", _inner(p)).strip()))
    yield from sorted(found, key=lambda cue: cue[0])


@parser("usf")
def usf(text: str) -> Iterator[Cue]:
    for e in _elements(text, "subtitle"):
        start, stop = _clock(e.get("start")), _clock(e.get("stop"))
        if start is not None:
            yield start, stop, _inner(e).strip()


@parser("cmml")
def cmml(text: str) -> Iterator[Cue]:
    rows = [(_clock(e.get("start")), _clock(e.get("end")), "".join(_inner(d) for d in e if d.tag.rpartition("}")[2] == "desc").strip()) for e in _elements(text, "clip")]
    for (start, end, body), following in zip(rows, [*rows[1:], (None, None, "")]):
        if start is not None and body:
            yield start, end if end is not None else following[0], body


@parser("scc")
def scc(text: str) -> Iterator[Cue]:
    """Line 21 byte pairs with their times, parity bits removed, as hexadecimal; a drop-frame clock is followed by its own rate."""
    for m in re.finditer(r"^(\d+):(\d+):(\d+)([:;])(\d+)\s+([0-9a-fA-F ]+)$", text, re.M):
        h, mi, s, mark, f = int(m[1]), int(m[2]), int(m[3]), m[4], int(m[5])
        frames = (h * 3600 + mi * 60 + s) * 30 + f
        if mark == ";":
            minutes = h * 60 + mi
            frames -= 2 * (minutes - minutes // 10)
        pairs = [bytes(b & 0x7F for b in bytes.fromhex(p)).hex() for p in m[6].split() if len(p) == 4]
        yield frames * 1_001_000 // 30, None, " ".join(pairs)


def sniff(path: str, text: str) -> str | None:
    """The format: by content where it shows, else by extension."""
    head = text[:4096]
    if head.lstrip("﻿").startswith("WEBVTT"):
        return "webvtt"
    if head.startswith("Scenarist_SCC"):
        return "scc"
    for name, pattern in (("ass", r"^\[Script Info\]"), ("sami", r"<\s*sami\b"), ("ttml", r"<(?:\w+:)?tt\b"), ("usf", r"<USFSubtitles\b"), ("cmml", r"<cmml\b"), ("srt", r"\d+:\d+:\d+[,.]\d+\s*-->"), ("microdvd", r"^\{\d+\}\{\d*\}"), ("subviewer2", r"^\d+:\d+:\d+\.\d+,\d+:\d+:\d+\.\d+"), ("subviewer1", r"^\[\d+:\d+:\d+\]")):
        if re.search(pattern, head, re.I | re.M):
            return name
    return EXTENSIONS.get(path.rpartition(".")[2].lower())


def parse(path: str, data: bytes, kind: str | None = None) -> list[Cue]:
    text = decode(data)
    kind = kind or sniff(path, text)
    return list(PARSERS[kind](text)) if kind in PARSERS else []


def parse_files(files: DataFrame, kind: str | None = None) -> DataFrame:
    """Cues of a table of files (path, content)."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(p, i, *cue) for p, data in zip(pdf["path"], pdf["content"]) for i, cue in enumerate(parse(p, bytes(data or b""), kind))]
            out = pd.DataFrame(rows, columns=["path", "seq", "start_us", "end_us", "text"])
            yield out.astype({"end_us": "Int64"})

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def read_cues(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    return parse_files(spark.read.format("binaryFile").load(path), kind)


def to_srt(start_us: int, end_us: int, text: str) -> str:
    stamp = lambda t: f"{t // 3_600_000_000:02d}:{t // 60_000_000 % 60:02d}:{t // 1_000_000 % 60:02d},{t // 1000 % 1000:03d}"
    return f"{stamp(start_us)} --> {stamp(end_us)}\n{text}\n"


def with_unfolded_ends(cues: DataFrame) -> DataFrame:
    """Open ends filled from the next cue of the file; the last stays open."""
    from pyspark.sql import Window

    return cues.withColumn("end_us", F.coalesce("end_us", F.lead("start_us").over(Window.partitionBy("path").orderBy("start_us", "seq"))))
