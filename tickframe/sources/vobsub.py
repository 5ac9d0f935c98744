"""Index files of picture subtitles: the times and file positions of each track's packets.

An index file (``.idx``) stands beside the stream (``.sub``) it points into.  A damaged index is reported, not half read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format.
MARK, TRACKS, LONGEST = "# VobSub index file,", 32, 8 << 20
SCHEMA = "path string, track int, id int, language string, pts_ms long, position long, error string"
_CLOCK = re.compile(r"\s*(\d+):(\d+):(\d+):(\d+)\s*")


def _ms(text: str) -> int:
    m = _CLOCK.fullmatch(text)
    h, minutes, s, ms = map(int, m.groups()) if m else (0, 60, 60, 1000)
    if minutes > 59 or s > 59 or ms > 999:
        raise ValueError(f"time {text.strip()!r}")
    return ((h * 60 + minutes) * 60 + s) * 1000 + ms


def _pair(text: str, mark: str) -> tuple[str, str]:
    before, found, after = text.partition(mark)
    if not found:
        raise ValueError(f"no {mark.strip(', :')} in {text.strip()!r}")
    return before, after


def read_index(text: str, size: int) -> list[tuple[int, int, str, int, int]]:
    """(track, id, language, pts, position), tracks by first appearance and packets by position, then time.  A delay holds for what
    follows it.  ``size``: of the stream that positions point into."""
    if len(text.encode()) > LONGEST or not text.startswith(MARK):
        raise ValueError("no index file")
    tracks: dict[int, list] = {}
    current, delay = None, 0
    for line in text.splitlines():
        key, colon, value = line.partition(":")
        if not colon:
            continue
        if key == "id":
            language, index = _pair(value, ", index:")
            if not index.strip().isdecimal() or int(index) >= TRACKS:
                raise ValueError(f"index {index.strip()!r}")
            current = int(index), language.strip()
        elif key == "delay":
            sign = -1 if value.strip().startswith("-") else 1
            delay = sign * _ms(value.strip().lstrip("+-"))
        elif key == "timestamp":
            if current is None:
                raise ValueError("a time before any track")
            time, place = _pair(value, ", filepos:")
            if not re.fullmatch(r"[0-9a-fA-F]+", place.strip()) or int(place, 16) > size:
                raise ValueError(f"position {place.strip()!r}")
            found = tracks.setdefault(current[0], [current[1]])
            found.append((int(place, 16), _ms(time) + delay))
    if not tracks:
        raise ValueError("no tracks")
    return [(track, number, language, pts, position) for track, (number, (language, *packets)) in enumerate(tracks.items()) for position, pts in sorted(packets)]


def read_pairs(files: DataFrame) -> DataFrame:
    """Packets of the index files among ``files`` (path, content), each with the stream of the same name; an index that can't be read, or has
    no stream, is one row with an error."""
    stem = F.regexp_replace("path", r"\.[^.]*$", "")
    index = files.filter(F.lower("path").endswith(".idx")).select(stem.alias("stem"), "path", "content")
    streams = files.filter(F.lower("path").endswith(".sub")).select(stem.alias("stem"), F.length("content").alias("size"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for path, content, size in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    if size is None:
                        raise ValueError("no stream beside it")
                    rows += [(path, *packet, None) for packet in read_index((content or b"").decode("utf-8", "replace"), size)]
                except ValueError as error:
                    rows.append((path, None, None, None, None, None, str(error)))
            types = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string())
            columns = list(zip(*rows)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(columns, types)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return index.join(streams, "stem", "left").select("path", "content", "size").mapInArrow(run, SCHEMA)
