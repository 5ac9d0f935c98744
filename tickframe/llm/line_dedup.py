"""Near-duplicate lines by a segment-partition edit join.

A line of length l is cut into EDITS + 1 segments.  Two lines within EDITS edits share one of them
unchanged, shifted by no more than the edits on either side of it allow, so a line probes the segments
of lines of its own length and up to EDITS shorter, at just those positions.  Keys hold the partner's length, the
segment's number and its text; lines with a key in common are candidates, and
are verified by a banded bit-parallel edit distance.  Linked lines form classes; of each class the
first line, by document id and place, stays, and the others go.

Lines are compared without white space at their ends; blank ones are left alone.  Lines of fewer than ``NEAR_CHARS``
characters are linked to equal lines only, by their hash: two edits make other words of so short a line, and its
segments are too short to tell lines apart.  Equal lines are those with
equal hashes of 96 bits; near ones are named by the first 64 of them.

Defined results: null and empty texts have no lines and stay as they are; a line of any length is compared
whole; rows that share an id are one document, rows
without id only if their texts are equal, and null sorts first among ids; a document left without words
by removals is dropped by ``dedup``; documents without removals are returned unchanged; equal lines of one document count as
any others; an empty table gives an empty result; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import functools
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .links import SMALL, among, resolve
from .runtime import WORD, begin, drop, fresh, keep, map_columns, ship, slices, text_or_empty

EDITS, MIN_CHARS, NEAR_CHARS = 2, 1, 15
SPACES = " \t\r\f\v"
#: Lines a worker remembers, so as not to send a repeated line's keys again.
RECENT = 100_000


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """Start and size of the edits + 1 segments of a line, the longer ones last."""
    size, longer = divmod(length, edits + 1)
    out, start = [], 0
    for i in range(edits + 1):
        own = size + (i > edits - longer)
        out.append((start, own))
        start += own
    return out


def probes(length: int, edits: int) -> list[tuple[int, int, int, int]]:
    """(partner's length, segment number, start, end) of all substrings to look up."""
    return [(int(o[0]), i, int(a[0]), int(b[0])) for _, o, i, a, b in _plans(np.array([length]), edits)]


def _plans(lengths: np.ndarray, edits: int):
    """Yields (rows, partner's length, segment number, start, end) of the substrings to look up, as arrays, for lines of these lengths."""
    for shift in range(edits + 1):
        other = lengths - shift
        size, longer = np.divmod(other, edits + 1)
        start = np.zeros_like(lengths)
        for i in range(edits + 1):
            own = size + (i > edits - longer)
            # at most i edits before the segment, or at most edits - i after it
            low = np.maximum(start - min(i, edits - i - shift), 0)
            high = np.minimum(start + min(i, edits - i + shift), lengths - own)
            for step in range(2 * edits + 1):
                rows = np.flatnonzero((low + step <= high) & (other > 0))
                if len(rows):
                    at = low[rows] + step
                    yield rows, other[rows], i, at, at + own[rows]
            start = start + own


def _common_start(one: str, two: str) -> int:
    """How many first characters two lines share: blocks of growing size are compared as a whole."""
    at, step, most = 0, 32, min(len(one), len(two))
    while at < most:
        if one[at : at + step] == two[at : at + step]:
            at, step = at + step, step * 2
        elif step == 1:
            return at
        else:
            step = max(1, step // 4)
    return most


def within(one: str, two: str, edits: int) -> bool:
    """Whether the edit distance is at most ``edits``.

    Along the text, bit k of level e says that the diagonal k - edits can be reached with e edits."""
    if abs(len(one) - len(two)) > edits:
        return False
    start = _common_start(one, two)
    one, two = one[start:][::-1], two[start:][::-1]
    end = _common_start(one, two)
    one, two = one[end:][::-1], two[end:][::-1]
    places: dict[str, int] = {}
    for i, c in enumerate(one):
        places[c] = places.get(c, 0) | 1 << (i + edits)
    band = (1 << (2 * edits + 1)) - 1
    levels = [((1 << (e + 1)) - 1) << edits for e in range(edits + 1)]
    for j, c in enumerate(two):
        match = (places.get(c, 0) >> j) & band
        before, now = 0, 0
        for e, level in enumerate(levels):
            # same character; substitution or insertion from one edit fewer; deletion
            now = (level & match) | before | (before >> 1) | (now << 1 & band)
            before, levels[e] = level, now
        if not levels[edits]:
            return False
    return bool(levels[edits] >> (len(one) - len(two) + edits) & 1)


#: Character cells of the filter before lines of two blocks are compared, and rows compared at once.
CELLS, STRIP = 64, 64


def near(edits: int):
    """Pairs of lines, of two lists or within one, within ``edits`` edits.

    An edit changes the counts of characters (in CELLS cells) by two at most, so pairs whose counts differ by more than 2 * edits
    aren't compared further."""

    def cells(lines: list[str]) -> np.ndarray:
        out = np.zeros((len(lines), CELLS), dtype=np.int32)
        for row, line in zip(out, lines):
            codes = np.frombuffer(line.encode("utf-32-le"), dtype=np.uint32)
            row += np.bincount((codes * np.uint32(2654435761)) >> np.uint32(26), minlength=CELLS).astype(np.int32)
        return out

    def linked(one: list[str], two: list[str] | None):
        ones = cells(one)
        other, twos = (one, ones) if two is None else (two, cells(two))
        for first in range(0, len(one), STRIP):
            far = np.abs(ones[first : first + STRIP, None, :] - twos[None, :, :]).sum(axis=2)
            for i, j in zip(*(x.tolist() for x in np.nonzero(far <= 2 * edits))):
                i += first
                if (two is not None or i < j) and within(one[i], other[j], edits):
                    yield i, j

    return linked


#: An odd factor, its inverse modulo 2**64, and a mixing factor.
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE, _MIX = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64)), np.uint64(0xBF58476D1CE4E5B9)
#: Characters hashed at once; a longer line is alone.
RUN = 1 << 18


@functools.lru_cache(maxsize=1)
def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(count, f), dtype=np.uint64)]) for f in (_FACTOR, _INVERSE))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def keys_of(lines: list[str], edits: int):
    """(row, key, whether it is the line's own segment) of all substrings that ``_plans`` names, as arrays.

    Substrings are hashed as polynomials over mixed characters, by differences of one running sum; different ones with
    one key only make further candidates."""
    lengths = np.array([len(line) for line in lines], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    codes = np.frombuffer("".join(lines).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    power, inverse = _powers(max(RUN, 1 << (len(codes) - 1).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed((codes + np.uint64(1)) * _FACTOR) * power[: len(codes)], dtype=np.uint64)])
    out = []
    for rows, other, i, a, b in _plans(lengths, edits):
        a, b = a + starts[rows], b + starts[rows]
        part = (sums[b] - sums[a]) * inverse[a]
        seed = (other.astype(np.uint64) << np.uint64(8) | np.uint64(i)) * _MIX
        own = (other == lengths[rows]) & (a - starts[rows] == _starts(other, i, edits))
        out.append((rows, _mixed(part + _mixed(seed)), own))
    return tuple(np.concatenate(x) for x in zip(*out))


def _starts(lengths: np.ndarray, i: int, edits: int) -> np.ndarray:
    size, longer = np.divmod(lengths, edits + 1)
    return i * size + np.maximum(0, i - (edits + 1 - longer))


def _runs(lines: list[str]):
    """Lines in lists of RUN characters at most, or one line."""
    run, chars = [], 0
    for line in lines:
        if run and chars + len(line) > RUN:
            yield run
            run, chars = [], 0
        run.append(line)
        chars += len(line)
    if run:
        yield run


def _keys(batches, edits: int):
    """(key, node, size, own) of the lines of texts that may have near ones."""
    import pyarrow as pa
    import xxhash

    begin(f"{__name__}.keys")
    recent: set[int] = set()
    node_of = xxhash.xxh64_intdigest
    for batch in batches:
        for part in slices(batch):
            lines, nodes = [], []
            for text in part.column(0).to_pylist():
                for line in text.split("\n"):
                    line = line.strip(SPACES)
                    if len(line) < NEAR_CHARS:
                        continue
                    node = node_of(line.encode(), 42)
                    if node in recent:
                        continue
                    if len(recent) >= RECENT:
                        recent.clear()
                    recent.add(node)
                    lines.append(line)
                    nodes.append(node)
            done = 0
            for run in _runs(lines):
                rows, keys, own = keys_of(run, edits)
                node = np.array(nodes[done : done + len(run)], dtype=np.uint64).view(np.int64)[rows]
                size = np.array([len(line) for line in run], dtype=np.int32)[rows]
                done += len(run)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(node), pa.array(size), pa.array(own)], names=["key", "node", "size", "own"])


def _own(docs: DataFrame, id_column: str, text_column: str) -> Column:
    """What tells rows without id apart: the hash of their text; null for rows with one."""
    return F.when(docs[id_column].isNull(), F.xxhash64(text_or_empty(docs, text_column)))


def _lines(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``(doc, own, pos, line, node)`` of the eligible lines; ``node`` is the hash that ``_keys`` gives."""
    split = F.split(text_or_empty(docs, text_column), "\n")
    lines = docs.select(docs[id_column].alias("doc"), _own(docs, id_column, text_column).alias("own"), F.posexplode(split).alias("pos", "raw"))
    # trimming is costly, and few lines need it
    ends = functools.reduce(or_, [f("raw", F.lit(c)) for c in SPACES for f in (F.startswith, F.endswith)])
    return lines.select("doc", "own", "pos", F.when(ends, F.btrim("raw", F.lit(SPACES))).otherwise(F.col("raw")).alias("line")).filter(F.length("line") >= MIN_CHARS).withColumn("node", F.xxhash64("line"))


def removals(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", edits: int = EDITS) -> DataFrame:
    """``(doc, own, removed array<struct<pos, first_doc, first_pos>>)`` of the documents that lose lines."""
    ship(docs.sparkSession)
    texts = docs.select(text_or_empty(docs, text_column).alias("text"))
    entries = texts.mapInArrow(lambda batches: _keys(batches, edits), "key long, node long, size int, own boolean")
    lines = _lines(docs, id_column, text_column)

    def payloads(used: DataFrame) -> DataFrame:
        """The lines that share a key with another one, once each, so that no step reads the documents again."""
        wanted = keep(used)
        found = keep(among(lines.select("node", F.col("line").alias("payload")), "node", wanted).distinct())
        drop(wanted)
        return found

    def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        one, two = (texts.select(F.col("node").alias(f"n{e}"), F.col("payload").alias(f"line{e}")) for e in "ab")
        full = pairs.join(one, F.col("a") == F.col("na")).join(two, F.col("b") == F.col("nb"))

        def kernel(a, b, la, lb):
            good = [within(x, y, edits) for x, y in zip(la, lb)]
            return [x for x, g in zip(a, good) if g], [x for x, g in zip(b, good) if g]

        return map_columns(full, ["a", "b", "linea", "lineb"], "a long, b long", kernel)

    labels = resolve(entries, payloads, confirm, str, near(edits), counts="own", fits=f"(own_a OR own_b) AND abs(size_a - size_b) <= {edits}")
    # equal lines are those with equal hashes of both kinds; what is linked to another line has its class's label instead
    slim = keep(lines.select("doc", "own", "pos", "node", F.hash("line").alias("check")))
    placed = slim
    if labels is not None:
        named = labels.select(F.col("node").alias("n"), "label")
        placed = slim.join(F.broadcast(named) if named.count() <= SMALL else named, F.col("node") == F.col("n"), "left").select("doc", "own", "pos", F.coalesce("label", "node").alias("node"), F.when(F.col("label").isNull(), F.col("check")).alias("check"))
    place = F.struct("doc", "own", "pos")
    # only lines that stand in several places are compared by place
    many = keep(placed.groupBy("node", "check").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("node").alias("c"), F.col("check").alias("k")))
    same = (F.col("node") == F.col("c")) & F.col("check").eqNullSafe(F.col("k"))
    again = keep(placed.join(F.broadcast(many) if many.count() <= SMALL else many, F.col("node") == F.col("c")).filter(F.col("check").eqNullSafe(F.col("k"))).drop("c", "k"))
    firsts = again.groupBy("node", "check").agg(F.min(place).alias("first")).select(F.col("node").alias("c"), F.col("check").alias("k"), "first")
    gone = again.join(firsts, same).filter(~place.eqNullSafe(F.col("first")))
    out = keep(gone.groupBy("doc", "own").agg(F.sort_array(F.collect_set(F.struct("pos", F.col("first.doc").alias("first_doc"), F.col("first.pos").alias("first_pos")))).alias("removed")))
    drop(slim, many, again, *([labels] if labels is not None else []))
    return out


def _without(text: Column, removed: Column) -> Column:
    """The text without the lines at the places removed."""
    places = F.transform(removed, lambda r: r["pos"])
    return F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(places, i)), "\n")


def _joined(docs: DataFrame, id_column: str, text_column: str, edits: int) -> tuple[DataFrame, str, str]:
    r, d, o, t = fresh(docs, "line_removed", "line_doc", "line_own", "line_text")
    cut = removals(docs, id_column, text_column, edits).select(F.col("doc").alias(d), F.col("own").alias(o), F.col("removed").alias(r))
    joined = docs.join(cut, docs[id_column].eqNullSafe(F.col(d)) & _own(docs, id_column, text_column).eqNullSafe(F.col(o)), "left").drop(d, o)
    return joined.withColumn(t, F.when(F.col(r).isNotNull(), _without(F.col(text_column), F.col(r))).otherwise(F.col(text_column))), r, t


def dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", edits: int = EDITS) -> DataFrame:
    """``docs`` with their own columns and shortened texts; a column n_chars is set to the new length."""
    joined, r, t = _joined(docs, id_column, text_column, edits)
    kept = joined.filter(F.col(r).isNull() | F.col(t).rlike(WORD))
    new = {text_column: F.col(t)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(r).isNull(), F.col("n_chars")).otherwise(F.length(t).cast(docs.schema["n_chars"].dataType))
    return kept.select(*(new.get(c, F.col(c)).alias(c) for c in docs.columns))


def report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", edits: int = EDITS) -> DataFrame:
    """A row for each document: its lines, those removed, where their first ones stand, and the rest's digest."""
    joined, r, t = _joined(docs.select(id_column, text_column), id_column, text_column, edits)
    n_removed = F.coalesce(F.size(r), F.lit(0))
    return joined.select(
        F.col(id_column).alias("doc_id"),
        F.when(F.col(text_column).isNull() | (F.col(text_column) == ""), 0).otherwise(F.size(F.split(text_column, "\n"))).cast("long").alias("n_lines"),
        n_removed.cast("long").alias("n_removed"),
        F.coalesce(F.transform(r, lambda x: x["pos"]), F.array().cast("array<int>")).alias("removed_lines"),
        F.coalesce(F.array_sort(F.array_distinct(F.transform(r, lambda x: x["first_doc"]))), F.array().cast("array<bigint>")).alias("first_doc_ids"),
        F.length(t).cast("long").alias("n_chars_left"),
        F.sha2(F.coalesce(F.col(t), F.lit("")), 256).alias("text_sha256"),
        ((n_removed == 0) | F.col(t).rlike(WORD)).alias("kept"),
    )
