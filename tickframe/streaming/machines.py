"""State machines over a stream's rows in order.

A machine is ``initial()`` and ``step(state, row) -> rows``; the state is a plain dict that JSON holds, of
bounded size.  ``run_batch`` folds one over each group of a table, reading the sorted rows batch by batch, ``run_stream`` over a streaming one, with the state kept
by Spark between micro-batches; both give the same rows for rows that arrive in order.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from ..operators.stateful import sorted_groups

#: Batches that may wait, and ticks of the buffering rules.
WAITING = 16
AHEAD_AT_START, AHEAD_AFTER_STARVING = 1_000_000, 2_500_000


@dataclass(frozen=True)
class Machine:
    initial: Callable[[], dict]
    step: Callable[[dict, dict], Iterable[tuple]]
    finish: Callable[[dict], Iterable[tuple]]
    output: str


def _release_step(state: dict, row: dict):
    """Caption batches: the earliest goes once its time is before the current decode time, or when too many wait.

    A batch without a time takes the decode time of the next row without one."""
    waiting = state["waiting"]
    if row["ts"] is None and row["dts"] is not None and state["untimed"] is not None:
        waiting.append([row["dts"], state["untimed"][0], state["untimed"][1]])
        state["untimed"] = None
    if row["ts"] is None:
        state["untimed"] = [row["seq"], row["size"]]
    else:
        waiting.append([row["ts"], row["seq"], row["size"]])
    waiting.sort()
    while waiting and ((row["dts"] is not None and waiting[0][0] < row["dts"]) or len(waiting) > WAITING):
        ts, seq, size = waiting.pop(0)
        if size:
            yield ts, seq


def _release_finish(state: dict):
    for ts, seq, size in state["waiting"]:
        if size:
            yield ts, seq
    if state["untimed"] and state["untimed"][1]:
        yield None, state["untimed"][0]


release = Machine(lambda: {"waiting": [], "untimed": None}, _release_step, _release_finish, "ts long, seq long")


def _hold_step(state: dict, row: dict):
    """Buffering: hold when starved before the end; go on when all are primed and far enough ahead, or at the end."""
    now, horizon = row["now"], row["horizon"]
    if not state["held"]:
        if row["starved"] and row["source_starved"] and not row["eof"]:
            state["held"], state["floor"] = True, now + AHEAD_AFTER_STARVING
            yield row["seq"], "hold"
    else:
        target = max(state["floor"], now + AHEAD_AFTER_STARVING) if state["floor"] is not None else now + AHEAD_AT_START
        ready = row["primed"] and (row["eof"] or horizon >= target)
        if ready or (row["full"] and (row["primed"] or row["starved"])):
            state["held"], state["floor"] = False, None
            yield row["seq"], "play"


buffering = Machine(lambda: {"held": True, "floor": None}, _hold_step, lambda s: (), "seq long, action string")


def _switch_step(state: dict, row: dict):
    """Selection: control rows name the track played from then on; packets of others don't pass."""
    if row["select"] is not None:
        state["track"] = row["select"]
    elif row["track"] == state["track"]:
        yield row["seq"], row["track"]


selection = Machine(lambda: {"track": None}, _switch_step, lambda s: (), "seq long, track long")


def _plain(value):
    return None if value is None or value != value else value.item() if hasattr(value, "item") else value


def _rows(pdf, columns):
    for r in pdf.itertuples(index=False):
        yield {c: _plain(getattr(r, c)) for c in columns}


def _frame(key: tuple, found: list[tuple], names: list[str]):
    import pandas as pd

    return pd.DataFrame([(*key, *row) for row in found], columns=names).convert_dtypes()


def _schema(df: DataFrame, by: str, machine: Machine) -> str:
    return f"{by} {df.schema[by].dataType.simpleString()}, {machine.output}"


def run_batch(df: DataFrame, by: str, order: str, machine: Machine) -> DataFrame:
    def each(rows):
        state, key = machine.initial(), None
        for r in rows:
            row = r._asdict()
            key = row[by]
            for found in machine.step(state, row):
                yield (key, *found)
        for found in machine.finish(state):
            yield (key, *found)

    return sorted_groups(df, [by], [order], _schema(df, by, machine), each)


def run_stream(df: DataFrame, by: str, order: str, machine: Machine, idle_ms: int | None = None) -> DataFrame:
    """The same over a streaming table.  With ``idle_ms`` a group that is silent for so long is finished:
    what waits is released and its state dropped."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    columns, schema = df.columns, _schema(df, by, machine)
    names = [f.name for f in StructType.fromDDL(schema)]

    def run(key, parts, state):
        import pandas as pd

        held = json.loads(state.get[0]) if state.exists else machine.initial()
        if state.hasTimedOut:
            state.remove()
            yield _frame(key, list(machine.finish(held)), names)
            return
        found = []
        parts = list(parts)
        if parts:
            for row in _rows(pd.concat(parts).sort_values(order), columns):
                found += machine.step(held, row)
        state.update((json.dumps(held),))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield _frame(key, found, names)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return df.groupBy(by).applyInPandasWithState(run, schema, "state string", "append", timeout)
