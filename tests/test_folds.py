"""Folds against plain loops, and the buffer of a given depth against the true order."""

import random

from pyspark.sql import functions as F

from tickframe.functions import pcm
from tickframe.operators import selection, stateful
from tickframe.streaming import machines


def streams(r, n=3, rows=60):
    return [(s, q) for s in range(n) for q in range(rows)]


def test_frame_clock(spark):
    r = random.Random(1)
    rows = [(s, q, r.choice([None, 1000 * q - 300]), r.choice([None, 1000 * q]), r.choice([None, 0, -5, 900, 1100])) for s, q in streams(r)]
    want, last, step = [], {}, {}
    for s, q, pts, packet, duration in rows:
        if pts is not None:
            at = pts
        elif s in last:
            at = last[s] + step.get(s, 0)
        else:
            at = packet or 0
        last[s] = max(0, at)
        want.append((s, q, last[s]))
        if duration and duration > 0:
            step[s] = duration
    r.shuffle(rows)
    got = stateful.clock(spark.createDataFrame(rows, "stream long, seq long, pts long, packet_pts long, duration long"))
    assert sorted(map(tuple, got.collect())) == want


def test_reorder_buffer(spark):
    r = random.Random(2)
    rows = []
    for s in range(3):
        order = list(range(40))
        for i in range(0, 40, 4):
            part = order[i : i + 4]
            r.shuffle(part)
            order[i : i + 4] = part
        rows += [(s, q, q // 20, poc % 20) for q, poc in enumerate(order)]
    got = {(x.stream, x.seq): x.position for x in stateful.display_order(spark.createDataFrame(rows, "stream long, seq long, period long, poc long"), 4).collect()}
    for s in range(3):
        shown = sorted((p, poc, q) for st, q, p, poc in rows if st == s)
        assert [got[(s, q)] for _, _, q in shown] == list(range(40))


def test_frames_and_packets(spark):
    r = random.Random(3)
    packets = [(s, q, r.choice([None, 100 * q]), r.choice([0, 50, 100])) for s in range(3) for q in range(30)]
    frames = [(s, f, r.choice([None, 100 * f, 100 * f + 1]), r.choice([0, 25, 50, 100])) for s in range(4) for f in range(40)]
    want = set()
    for s in range(4):
        own = [p for p in packets if p[0] == s]
        i = used = 0
        for _, f, pts, length in [x for x in frames if x[0] == s]:
            hit = next((k for k, p in enumerate(own) if pts is not None and p[2] == pts), None)
            if hit is not None:
                i, used = hit, 0
            else:
                while i + 1 < len(own) and used >= own[i][3]:
                    used -= own[i][3]
                    i += 1
            used += length
            want.add((s, f, own[i][1] if own else None))
    got = stateful.associate(spark.createDataFrame(frames, "stream long, frame long, pts long, length long"), spark.createDataFrame(packets, "stream long, seq long, pts long, duration long"))
    assert {(x.stream, x.frame, x.packet) for x in got.collect()} == want


def test_buffering(spark):
    r = random.Random(4)
    rows = [(s, q, 100_000 * q, 100_000 * q + r.choice([0, 900_000, 1_100_000, 2_600_000]), r.random() < 0.3, r.random() < 0.6, q > 55, r.random() < 0.9, r.random() < 0.1) for s, q in streams(r)]
    want = []
    for s in range(3):
        held, floor = True, None
        for _, q, now, horizon, starved, source, eof, primed, full in [x for x in rows if x[0] == s]:
            if held:
                # at the start a second ahead, after a stop two and a half from then and from now
                due = now + 1_000_000 if floor is None else max(floor, now + 2_500_000)
                if (primed and (eof or horizon >= due)) or (full and (primed or starved)):
                    held, floor = False, None
                    want.append((s, q, "play"))
            elif starved and source and not eof:
                held, floor = True, now + 2_500_000
                want.append((s, q, "hold"))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "stream long, seq long, now long, horizon long, starved boolean, source_starved boolean, eof boolean, primed boolean, full boolean")
    assert sorted(map(tuple, machines.run_batch(df, "stream", "seq", machines.buffering).collect())) == sorted(want) and len(want) > 6


def test_release(spark):
    r = random.Random(5)
    rows = [(s, q, r.choice([None, 40 * q + r.randrange(200), 40 * q]), r.choice([None, 40 * q]), r.choice([0, 10])) for s, q in streams(r)]
    want = []
    for s in range(3):
        waiting, untimed = [], None
        for _, q, ts, dts, size in [x for x in rows if x[0] == s]:
            if ts is None:
                if untimed and dts is not None:
                    waiting.append((dts, *untimed))
                untimed = (q, size)
            else:
                waiting.append((ts, q, size))
            while waiting and (len(waiting) > machines.WAITING or (dts is not None and min(waiting)[0] < dts)):
                first = min(waiting)
                waiting.remove(first)
                want += [(s, first[0], first[1])] * (first[2] > 0)
        want += [(s, ts, q) for ts, q, size in waiting if size]
        if untimed and untimed[1]:
            want.append((s, None, untimed[0]))
    df = spark.createDataFrame(rows, "stream long, seq long, ts long, dts long, size long")
    key = lambda x: (x[0], x[2])
    assert sorted(map(tuple, machines.run_batch(df, "stream", "seq", machines.release).collect()), key=key) == sorted(want, key=key)


def test_ranks_over_ranges(spark):
    r = random.Random(6)
    rows = [(i, r.choice([None, 1.0, 2.0, r.random()])) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, v double")
    want = sorted(rows, key=lambda x: (float("inf") if x[1] is None else x[1], x[0]))
    got = {x.k: x.position for x in selection.ranked(df, F.col("v"), "k", 8).collect()}
    assert [got[k] for k, _ in want] == list(range(1, 501))
    assert selection.ranked(df.filter("false"), F.col("v"), "k").count() == 0


def test_mutations_keep_small_files_whole():
    assert all(pcm.mutate(b"", i) == b"" for i in range(pcm.MUTATIONS))
    assert pcm.mutate(b"ab", 18) == b"ab" and pcm.mutate(b"abcd", 18) == b"abc" + bytes([255 - ord("d")])
    assert pcm.mutate(bytes(100), 7) == bytes(1) and pcm.mutate(b"x" * 9000, 13) == b"x" * 2250 + bytes(4096) + b"x" * 2654
