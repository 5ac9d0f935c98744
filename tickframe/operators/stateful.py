"""Left folds over the rows of a stream that no window function expresses.

Each is a generator over one group's rows in order; ``fold`` runs it.  Rows are dealt by group, sorted there
by Spark, which spills, and read batch by batch, so that a worker holds the operator's own window (a reorder buffer,
the packets not yet used up) and not the stream.  A stream is one task, as a fold needs the row before.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator
from heapq import heappop, heappush
from itertools import groupby, islice

from pyspark.sql import DataFrame

from ..session import ship

#: Rows handed on at once.
CHUNK = 8192


def sorted_groups(df: DataFrame, by: list[str], order: list[str], schema: str, each: Callable[[Iterator], Iterator[tuple]]) -> DataFrame:
    """``each(rows in order) -> tuples`` for every group; rows have the columns of ``df`` as attributes."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    ship(df.sparkSession)
    fields = StructType.fromDDL(schema).fields
    names, types = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]
    at = [df.columns.index(c) for c in by]
    columns = df.columns

    def run(batches):
        import pyarrow as pa

        row = namedtuple("Row", columns)
        rows = (row(*values) for batch in batches for values in zip(*(c.to_pylist() for c in batch.columns)))
        out = (found for _, group in groupby(rows, key=lambda r: [r[i] for i in at]) for found in each(group))
        while part := list(islice(out, CHUNK)):
            yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(zip(*part), types)], names=names)

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def fold(df: DataFrame, by: list[str], order: list[str], schema: str, step: Callable) -> DataFrame:
    """Applies ``step(rows) -> rows`` (tuples by column order) to each group's rows in order."""
    return sorted_groups(df, by, order, schema, step)


def _clock(rows):
    """Frame times with durations that change."""
    last = step = None
    for r in rows:
        at = r.pts if r.pts is not None else last + (step or 0) if last is not None else r.packet_pts if r.packet_pts is not None else 0
        at = max(0, int(at))
        yield r.stream, r.seq, at
        last = at
        if r.duration is not None and r.duration > 0:
            step = int(r.duration)


def clock(frames: DataFrame) -> DataFrame:
    return fold(frames.select("stream", "seq", "pts", "packet_pts", "duration"), ["stream"], ["seq"], "stream long, seq long, time long", _clock)


def reorder(depth: int):
    """A display-order buffer: once more than ``depth`` pictures wait, the smallest goes; a new period lets all go."""

    def step(rows):
        waiting, period, out = [], None, 0
        for r in rows:
            if period is not None and r.period != period:
                while waiting:
                    _, seq, poc = heappop(waiting)
                    yield r.stream, seq, poc, out
                    out += 1
            period = r.period
            heappush(waiting, (r.poc, r.seq, r.poc))
            while len(waiting) > depth:
                _, seq, poc = heappop(waiting)
                yield r.stream, seq, poc, out
                out += 1
        while waiting:
            _, seq, poc = heappop(waiting)
            yield r.stream, seq, poc, out
            out += 1

    return step


def display_order(pictures: DataFrame, depth: int) -> DataFrame:
    """``(stream, seq, poc, position)`` of ``(stream, seq, period, poc)``."""
    return fold(pictures.select("stream", "seq", "period", "poc"), ["stream"], ["seq"], "stream long, seq long, poc long, position long", reorder(depth))


def associate(frames: DataFrame, packets: DataFrame) -> DataFrame:
    """The packet of each frame: the one with its time; else the current one while its declared duration lasts, then the next; else the last."""
    import pandas as pd

    def run(key, f: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("seq")
        seqs, ends = p["seq"].tolist(), p["duration"].tolist()
        at = {int(t): i for i, t in reversed(list(enumerate(p["pts"].tolist()))) if t == t and t is not None}
        i, used, rows = 0, 0, []
        for r in f.sort_values("frame").itertuples():
            known = r.pts is not None and r.pts == r.pts
            if known and int(r.pts) in at:
                i, used = at[int(r.pts)], 0
            elif seqs:
                while i + 1 < len(seqs) and used >= ends[i]:
                    used -= ends[i]
                    i += 1
            used += int(r.length)
            rows.append((key[0], int(r.frame), seqs[min(i, len(seqs) - 1)] if seqs else None))
        return pd.DataFrame(rows, columns=["stream", "frame", "packet"]).astype({"packet": "Int64"})

    return frames.groupBy("stream").cogroup(packets.groupBy("stream")).applyInPandas(run, "stream long, frame long, packet long")
