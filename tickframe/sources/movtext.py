"""Timed text samples of MP4 files: a length, the text, and boxes that style parts of it."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame

#: Style flags.
BOLD, ITALIC, UNDERLINE = 1, 2, 4
SCHEMA = "text string, first int, stop int, bold boolean, italic boolean, underline boolean, size int, color string, error string"


def read_sample(data: bytes) -> tuple[str, list[tuple[int, int, int, int, str]]]:
    """The text, and (first, stop, flags, size, colour) by character of its style records.  Text that is longer than the sample
    says nothing that can be trusted: an error; a box that breaks off ends the boxes."""
    if len(data) < 2:
        raise ValueError("no length")
    length, = struct.unpack_from(">H", data)
    if len(data) < 2 + length:
        raise ValueError(f"{length} bytes of text in {len(data) - 2}")
    body = data[2 : 2 + length]
    text = body.decode("utf-16" if body[:2] in (b"\xfe\xff", b"\xff\xfe") else "utf-8", "replace")
    styles, at = [], 2 + length
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if size < 8 or at + size > len(data):
            break
        if kind == b"styl" and size >= 10:
            count, = struct.unpack_from(">H", data, at + 8)
            for k in range(min(count, (size - 10) // 12)):
                first, stop, _, flags, points, color = struct.unpack_from(">HHHBB4s", data, at + 10 + 12 * k)
                if first < stop:
                    styles.append((first, min(stop, len(text)), flags, points, color.hex()))
        at += size
    return text, styles


def _rows(data: bytes) -> Iterator[tuple]:
    try:
        text, styles = read_sample(data)
    except ValueError as error:
        yield None, None, None, None, None, None, None, None, str(error)
        return
    if not styles:
        yield text, None, None, None, None, None, None, None, None
    for first, stop, flags, size, color in styles:
        yield text, first, stop, bool(flags & BOLD), bool(flags & ITALIC), bool(flags & UNDERLINE), size, color, None


def read_samples(samples: DataFrame, data: str) -> DataFrame:
    """A row for each style record of a table's samples, one with the text alone where there is none; other columns are kept."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    from ..session import ship

    ship(samples.sparkSession)
    kept = [c for c in samples.columns if c != data]
    own = StructType.fromDDL(SCHEMA)
    schema = StructType([*(samples.schema[c] for c in kept), *own.fields])
    types = [to_arrow_type(f.dataType) for f in own.fields]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at, rows = [], []
            for i, content in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                for row in _rows(content or b""):
                    at.append(i)
                    rows.append(row)
            columns = list(zip(*rows)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(at, pa.int32())) for i in range(len(kept))), *(pa.array(v, type=t) for v, t in zip(columns, types))], names=schema.names)

    return samples.select(*kept, data).mapInArrow(run, schema)
