"""Near-duplicate documents by SetSketch registers.

A document's set is its distinct shingles of five words.  Its sketch is one byte
a register: the smallest of the set's hashes under the register's own permutation,
taken as an exponential variable of rate ``RATE`` and rounded to a power of ``BASE`` (a truncated minimum).  The rate lifts the registers
of small sets off the floor: one of a single shingle is 0 with a probability of exp(-RATE).  Sketches merge
by the larger register, and two registers agree at least as often as their sets' similarity says.

Registers are banded: documents with equal values in all registers of a band are candidates.  From the registers of a
candidate pair and both set sizes the similarity is estimated by maximum likelihood; pairs
whose estimate is five standard deviations too low are dropped, and the rest is confirmed on the full sets,
read again from the texts.  Documents with equal sets are one node from the start.

The number of rows in a band is the largest with which a pair at the threshold is missed in all bands
with a probability below ``MISS``.

Defined results: null and empty texts, and texts without words, have an empty set and are linked with
nothing; texts of fewer than five words have one shingle, all their words; rows that share an id
are one document, linked by all its texts, so they have one component; rows with null id are linked through equal sets only and get the
smallest id among them, if any; an empty table gives an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .links import SMALL, among, resolve
from .runtime import Memo, begin, drop, keep, map_columns, ship, slices, text_or_empty

WORDS, REGISTERS, BASE, RATE, TOP, MISS = 5, 125, 1.1, 20, 255, 1e-6
BLOCK, COLUMNS = 4096, 4096
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEEDS = _mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * _MULTIPLY) | np.uint64(1)


@functools.lru_cache(maxsize=1)
def _word_hashes() -> Memo:
    import xxhash

    return Memo(xxhash.xxh3_64_intdigest, 250_000, 40)


def shingles(text: str) -> np.ndarray:
    """The set of a text: sorted distinct 64-bit hashes of its shingles."""
    words = text.encode().lower().split()  # bytes: only A to Z and ASCII white space
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_word_hashes().__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(WORDS, len(h))
    rolled = np.full(len(h) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        rolled = rolled * _MULTIPLY + h[i : len(h) - size + 1 + i]
    return np.unique(_mix(rolled))


def sketch(hashes: np.ndarray) -> bytes:
    """One byte a register; zeros for the empty set."""
    if not len(hashes):
        return bytes(REGISTERS)
    least = np.full(REGISTERS, np.iinfo(np.uint64).max)
    for start in range(0, len(hashes), BLOCK):
        least = np.minimum(least, np.multiply.outer(_SEEDS, hashes[start : start + BLOCK]).min(axis=1))
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64 * (1 - 1e-16))
    return np.clip(np.floor(1 - np.log(exponential / RATE) / np.log(BASE)), 0, TOP).astype(np.uint8).tobytes()


def merge_sketches(one: bytes, two: bytes) -> bytes:
    """The sketch of the union."""
    return np.maximum(np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)).tobytes()


def band_rows(threshold: float) -> int:
    fit = [r for r in range(1, 17) if (1 - threshold**r) ** (REGISTERS // r) <= MISS]
    if not fit:
        raise ValueError(f"no banding of {REGISTERS} registers finds pairs of similarity {threshold}")
    return max(fit)


_GRID = np.linspace(0, 1, 101)


def estimate(ones: np.ndarray, twos: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarities of pairs of sketches (rows) with known set sizes."""
    total = (n1 + n2).astype(np.float64)
    u, v = (n1 / total)[:, None], (n2 / total)[:, None]
    j = _GRID[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    above, below = p(u - v * j), p(v - u * j)
    more, less = (ones > twos).sum(axis=1)[:, None], (ones < twos).sum(axis=1)[:, None]
    same = ones.shape[1] - more - less
    tiny = 1e-12
    score = more * np.log(above + tiny) + less * np.log(below + tiny) + same * np.log(np.maximum(1 - above - below, tiny))
    return np.take_along_axis(j, score.argmax(axis=1)[:, None], axis=1)[:, 0]


def sketches(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, n_shingles, same binary, registers binary)``; equal sets have equal ``same``."""

    def kernel(ids, texts):
        import xxhash

        n, same, registers = [], [], []
        for text in texts:
            s = shingles(text)
            n.append(len(s))
            same.append(xxhash.xxh3_128_digest(s.astype("<u8").tobytes()))
            registers.append(sketch(s))
        return ids, n, same, registers

    kind = docs.schema[id_column].dataType.simpleString()
    return map_columns(docs, [docs[id_column], text_or_empty(docs, text_column).alias("text")], f"{id_column} {kind}, n_shingles long, same binary, registers binary", kernel)


def with_set(rows: DataFrame, text_column: str, key: str) -> DataFrame:
    """``rows`` and a column that is equal for equal sets, null for empty ones."""
    ship(rows.sparkSession)
    at = rows.columns.index(text_column)

    def run(batches):
        import pyarrow as pa
        import xxhash

        begin(f"{__name__}.with_set")
        for batch in batches:
            for part in slices(batch):
                sets = [shingles(text) for text in part.column(at).to_pylist()]
                same = [xxhash.xxh3_128_digest(s.astype("<u8").tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(same, pa.binary())], names=[*part.schema.names, key])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(key, T.BinaryType())]))


def _likely(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose estimated similarity may belong to one at the threshold."""
    slack = 5 * (threshold * (1 - threshold) / REGISTERS) ** 0.5
    one, two = (nodes.select(F.col("node").alias(f"n{e}"), F.col("n_shingles").alias(f"size{e}"), F.col("registers").alias(f"registers{e}")) for e in "ab")
    full = pairs.join(one, F.col("a") == F.col("na")).join(two, F.col("b") == F.col("nb"))

    def kernel(a, b, size_a, size_b, ra, rb):
        ones, twos = (np.frombuffer(b"".join(r), np.uint8).reshape(len(r), REGISTERS) for r in (ra, rb))
        good = estimate(ones, twos, np.array(size_a), np.array(size_b)) >= threshold - slack
        return [x for x, g in zip(a, good) if g], [x for x, g in zip(b, good) if g]

    return map_columns(full, ["a", "b", "sizea", "sizeb", "registersa", "registersb"], "a long, b long", kernel).distinct()


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union on the full sets of their texts (node, text)."""
    one, two = (texts.select(F.col("node").alias(f"n{e}"), F.col("text").alias(f"text{e}")) for e in "ab")
    full = pairs.join(two, F.col("b") == F.col("nb")).select("a", "b", "textb").join(one, F.col("a") == F.col("na"))

    def kernel(a, b, text_a, text_b):
        out, last, own = [], None, None
        for x, y, s, t in zip(a, b, text_a, text_b):
            if last is not s and last != s:
                last, own = s, shingles(s)
            other = shingles(t)
            common = len(np.intersect1d(own, other, assume_unique=True))
            if 100 * common >= percent * (len(own) + len(other) - common) > 0:
                out.append((x, y))
        return [x for x, _ in out], [y for _, y in out]

    return map_columns(full, ["a", "b", "texta", "textb"], "a long, b long", kernel).distinct()


def similar(percent: int):
    """Pairs of sets, of two lists or within one, with 100 * intersection >= percent * union.

    Intersections are counted for all pairs at once, by products of membership matrices over the shingles that
    more than one set has, some columns at a time."""

    def linked(one: list[np.ndarray], two: list[np.ndarray] | None):
        every = one + (two or [])
        sizes = np.array([len(s) for s in every])
        values, columns = np.unique(np.concatenate(every), return_inverse=True)
        shared = np.bincount(columns, minlength=len(values)) > 1
        number = np.cumsum(shared) - 1
        owners = np.repeat(np.arange(len(every)), sizes)
        keep = shared[columns]
        owners, columns = owners[keep], number[columns[keep]]
        split = len(one)
        common = np.zeros((split, len(every) - split if two is not None else split), dtype=np.float32)
        order = np.argsort(columns, kind="stable")
        owners, columns = owners[order], columns[order]
        for start in range(0, int(shared.sum()), COLUMNS):
            a, b = np.searchsorted(columns, [start, start + COLUMNS])
            part = np.zeros((len(every), COLUMNS), dtype=np.float32)
            part[owners[a:b], columns[a:b] - start] = 1
            common += part[:split] @ (part[split:] if two is not None else part).T
        n1, n2 = sizes[:split, None], (sizes[split:] if two is not None else sizes)[None, :]
        hit = 100 * common >= percent * (n1 + n2 - common)
        if two is None:
            hit = np.triu(hit, 1)
        yield from zip(*(x.tolist() for x in np.nonzero(hit)))

    return linked


def classes(docs: DataFrame, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every row; the smallest id of a class is kept.

    Ids must be integers.  An empty table gives an empty result; other columns of ``docs`` don't matter, whatever their names."""
    threshold = percent / 100
    rows = band_rows(threshold)
    base = docs.select(docs[id_column].cast("long").alias("doc_id"), text_or_empty(docs, text_column).alias("text"))
    drawn = keep(sketches(base))
    # one node for equal sets, which have equal sizes and registers
    nodes = keep(drawn.filter("n_shingles > 0").groupBy("same", "n_shingles", "registers").agg(F.min("doc_id").alias("node")))
    to_node = nodes.select(F.col("same").alias("s"), "node")
    placed = keep(drawn.select("doc_id", "n_shingles", "same").join(to_node, (F.col("same") == F.col("s")) & (F.col("n_shingles") > 0), "left").select("doc_id", "n_shingles", "node"))
    drop(drawn)
    usable = nodes.filter("node IS NOT NULL")
    # rows that share an id: their nodes are linked
    again = keep(placed.filter("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("node").alias("first")).filter("n > 1").select(F.col("doc_id").alias("again"), "first"))
    repeated = not again.isEmpty()
    bands = F.array(*[F.xxhash64(F.lit(i), F.substring(F.col("registers"), i * rows + 1, rows)) for i in range(REGISTERS // rows)])
    entries = usable.select("node", F.col("n_shingles").alias("size"), F.explode(bands).alias("key")).select("key", "node", "size")

    def payloads(used: DataFrame) -> DataFrame:
        """Of each set the text of one document, the one with the smallest id."""
        wanted = keep(used)
        texts = among(base.select(F.col("doc_id").alias("node"), F.col("text").alias("payload")), "node", wanted)
        found = keep(texts.distinct() if repeated else texts)
        drop(wanted)
        return found

    def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        return _confirmed(_likely(pairs, usable, threshold), texts.withColumnRenamed("payload", "text"), percent)

    fits = "true" if repeated else f"100 * least(size_a, size_b) >= {percent} * greatest(size_a, size_b)"
    same_id = placed.join(F.broadcast(again) if again.count() <= SMALL else again, F.col("doc_id") == F.col("again")).filter("node > first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct() if repeated else None
    labels = resolve(entries, payloads, confirm, shingles, similar(percent), fits=fits, known=same_id)
    drop(nodes, again)
    found = placed
    if labels is not None:
        found = found.join(labels.select(F.col("node").alias("n"), "label"), F.col("node") == F.col("n"), "left")
    else:
        found = found.withColumn("label", F.lit(None).cast("long"))
    found = found.select("doc_id", "n_shingles", F.coalesce("label", "node", "doc_id").alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
