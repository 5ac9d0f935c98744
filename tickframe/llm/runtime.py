"""How the Python kernels of this subpackage run on executors.

Every kernel is a plain function from a few input columns to output columns.
``map_columns`` feeds it Arrow batches in slices of bounded size, so that a
worker holds a few megabytes of Python objects however long a batch is, and
one very long text at a time.
"""

from __future__ import annotations

import weakref
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import delete_folder, new_folder, shared_folder, ship

#: What a "word" is everywhere in this subpackage.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and text bytes of one slice handed to a kernel.
SLICE_ROWS, SLICE_BYTES = 512, 4 << 20

def slices(batch) -> Iterator:
    """Cut an Arrow batch into pieces of at most SLICE_ROWS rows and about SLICE_BYTES bytes."""
    rows = batch.num_rows
    if not rows:
        return
    step = max(1, min(SLICE_ROWS, int(rows * SLICE_BYTES / max(1, batch.nbytes))))
    for start in range(0, rows, step):
        yield batch.slice(start, step)


def map_columns(df: DataFrame, columns: list, schema: str, kernel: Callable) -> DataFrame:
    """Apply ``kernel(list, list, ...) -> list of lists`` to slices of the given columns.

    ``columns`` are the only ones read; the result has exactly those of ``schema``,
    so other columns of ``df``, whatever their names, don't matter."""
    ship(df.sparkSession)
    source = df.select(*columns)
    names = [f.name for f in _parse(schema)]
    types = _arrow(schema)

    name = f"{kernel.__module__}.{kernel.__qualname__}"

    def run(batches):
        import pyarrow as pa

        begin(name)
        for batch in batches:
            for part in slices(batch):
                out = kernel(*(part.column(i).to_pylist() for i in range(part.num_columns)))
                yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(out, types)], names=names)

    return source.mapInArrow(run, schema)


def _parse(schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema)


def _arrow(schema: str):
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in _parse(schema)]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_empty(df: DataFrame, column: str = "text"):
    return F.coalesce(df[column].cast("string"), F.lit(""))


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of a table of any types: write it once to the shared folder and go on from the files.
    Those go with the DataFrame where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """The same for an intermediate table, as Parquet: its size is known to the planner, its small files are read by few
    tasks, and ``drop`` deletes it.  What isn't dropped goes when the application ends."""
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.kept_path = path
    return found


def drop(*tables: DataFrame) -> None:
    """Delete tables of ``keep``; anything else is left alone."""
    for df in tables:
        path = df.__dict__.get("kept_path")
        if path:
            delete_folder(df.sparkSession, path)


_running = ""
_memos: weakref.WeakValueDictionary = weakref.WeakValueDictionary()


def begin(kernel: str) -> None:
    """A worker lives on for other kernels: what the last one remembered is forgotten when another begins."""
    global _running
    if kernel != _running:
        _running = kernel
        for memo in list(_memos.values()):
            memo.clear()


class Memo(dict):
    """A bounded cache around a function of one key; forgets all when full, and when a worker goes on to another kernel."""

    def __init__(self, function: Callable, entries: int, longest: int):
        super().__init__()
        _memos[id(self)] = self
        self.function, self.entries, self.longest = function, entries, longest

    def __missing__(self, key):
        value = self.function(key)
        if len(key) <= self.longest:
            if len(self) >= self.entries:
                self.clear()
            self[key] = value
        return value
