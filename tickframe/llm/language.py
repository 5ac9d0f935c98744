"""Language identification by nearest centroid over TF-IDF character n-grams.

A text's features are its byte trigrams (lower case, runs of anything but letters as one
space), hashed into ``DIM`` cells, with 1 + log(count) times the inverse document frequency,
scaled to length 1.  Each language has ``CENTROIDS`` centroids, clustered from its
labelled texts; a text goes to the language of the centroid with the largest cosine.  A text that is further
from it than nearly all labelled texts of that language are from theirs is ``rejected``.

The labelled sample is bounded: about ``SAMPLE`` rows of each language, those with the
smallest hashes of id and text; where there are so many languages that this makes more than ``SAMPLE_ROWS``, those
are shared among them, but no language gets fewer than ``LEAST``.  Every language is learned; a model has
CENTROIDS * DIM numbers for each, so ``lang`` is meant to be a label of some thousand values at most.

Defined results: null text and text without letters is ``und`` with score 0; texts of any length are read
whole, in blocks; rows with null lang are never learned from, rows with null id are, like any other; without labelled rows all is ``und``; equal
texts get equal results, and equal tables equal models, in whatever order; of languages at the same distance the first by name
counts; an empty table gives an empty result; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import functools
import pickle
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import map_columns, text_or_empty

DIM, CENTROIDS, ROUNDS = 4096, 4, 12
SAMPLE, SAMPLE_ROWS, LEAST = 300, 3000, 20
#: Share of a language's labelled texts that lie within its radius, and the slack added to it.
WITHIN, SLACK = 0.995, 0.05
UNKNOWN = "und"
BLOCK = 1 << 20

_other = re.compile(r"[\W\d_]+")


def counts(text: str) -> np.ndarray | None:
    """Hashed trigram counts of a whole text; None if it has no letters."""
    letters = _other.sub(" ", text.lower())
    if not letters.strip() or not any(c.isalpha() for c in letters):
        return None
    data = np.frombuffer(f" {letters} ".encode(), dtype=np.uint8)
    total = np.zeros(DIM)
    for start in range(0, max(1, len(data) - 2), BLOCK):
        part = data[start : start + BLOCK + 2].astype(np.uint32)
        grams = (part[:-2] << 16) | (part[1:-1] << 8) | part[2:]
        total += np.bincount((grams * np.uint32(2654435761)) >> np.uint32(20), minlength=DIM)
    return total


def weigh(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.where(rows > 0, 1 + np.log(np.maximum(rows, 1)), 0.0) * idf
    return out / np.maximum(np.linalg.norm(out, axis=-1, keepdims=True), 1e-12)


def cluster(rows: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; deterministic."""
    centres = [rows.mean(axis=0)]
    while len(centres) < min(k, len(rows)):
        centres.append(rows[np.argmin((rows @ np.array(centres).T).max(axis=1))])
    centres = np.array(centres)
    for _ in range(ROUNDS):
        near = (rows @ centres.T).argmax(axis=1)
        centres = np.array([rows[near == i].mean(axis=0) if (near == i).any() else centres[i] for i in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


class Model:
    def __init__(self, langs: list[str], rows: np.ndarray):
        """One label and one row of counts for each labelled text."""
        self.idf = np.log((1 + len(rows)) / (1 + (rows > 0).sum(axis=0))) + 1
        names = np.array(langs)
        self.langs = sorted(set(langs))
        centres, owner, self.radius = [], [], []
        for i, lang in enumerate(self.langs):
            own = weigh(rows[names == lang].astype(np.float64), self.idf)
            found = cluster(own, CENTROIDS)
            centres.append(found)
            owner += [i] * len(found)
            self.radius.append(1 - float(np.quantile((own @ found.T).max(axis=1), 1 - WITHIN)) + SLACK)
        self.centres, self.owner = np.concatenate(centres).astype(np.float32), np.array(owner)
        self.radius = np.array(self.radius)

    def predict(self, text: str) -> tuple[str, float, bool]:
        """Language, cosine, and whether the text lies outside the language's radius."""
        row = counts(text)
        if row is None:
            return UNKNOWN, 0.0, True
        cosines = self.centres @ weigh(row, self.idf).astype(np.float32)
        best = int(cosines.argmax())
        lang, score = self.owner[best], float(min(1.0, max(0.0, cosines[best])))
        return self.langs[lang], score, 1 - score > self.radius[lang]


def fit(labelled: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Model | None:
    """Learn from the rows given that have a language."""
    rows = labelled.select(labelled[id_column].alias("id"), labelled[lang_column].cast("string").alias("lang"), text_or_empty(labelled, text_column).alias("text")).filter("lang IS NOT NULL")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()
    if not sizes:
        return None
    each = min(SAMPLE, max(LEAST, SAMPLE_ROWS // len(sizes)))
    # a hash below each / n has about ``each`` rows; what is over is cut evenly, by how near to its language's limit a row is
    share = F.create_map(*[F.lit(v) for r in sizes for v in (r["lang"], min(1.0, each / r["n"]))])
    unit = F.pmod(F.xxhash64(F.col("id").cast("string"), F.col("text"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.withColumn("near", unit / share[F.col("lang")]).filter("near < 1")

    def kernel(near, langs, texts):
        out = [(n, lang, c) for n, lang, text in zip(near, langs, texts) if (c := counts(text)) is not None]
        return [n for n, _, _ in out], [lang for _, lang, _ in out], [np.flatnonzero(c).tolist() for _, _, c in out], [c[np.flatnonzero(c)].astype(int).tolist() for _, _, c in out]

    sparse = map_columns(picked, ["near", "lang", "text"], "near double, lang string, cells array<int>, ns array<int>", kernel)
    first = sparse.distinct().orderBy("near", "lang", "cells", "ns").limit(max(SAMPLE_ROWS, each * len(sizes)))
    found = sorted(((r["lang"], r["cells"], r["ns"]) for r in first.collect()))
    if not found:
        return None
    table = np.zeros((len(found), DIM), dtype=np.float32)
    for i, (_, cells, ns) in enumerate(found):
        table[i, cells] = ns
    return Model([lang for lang, _, _ in found], table)


@functools.lru_cache(maxsize=4)
def _model(data: bytes) -> Model:
    return pickle.loads(data)


def predict(docs: DataFrame, model: Model | None, id_column: str = "doc_id", text_column: str = "text", reject: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, kept columns, lang_pred, score, rejected)``; with ``reject`` the language of rejected texts is ``und``."""
    data = pickle.dumps(model)

    def kernel(*columns):
        m = _model(data)
        rows = [m.predict(t) if m else (UNKNOWN, 0.0, True) for t in columns[-1]]
        return (*columns[:-1], [UNKNOWN if reject and bad else lang for lang, _, bad in rows], [s for _, s, _ in rows], [bool(bad) for _, _, bad in rows])

    names = [id_column, *keep]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names), "lang_pred string, score double, rejected boolean"])
    return map_columns(docs, [*(docs[c] for c in names), text_or_empty(docs, text_column).alias("text")], schema, kernel)


def held_out(docs: DataFrame, id_column: str = "doc_id", folds: int = 5) -> Column:
    return F.coalesce(F.crc32(docs[id_column].cast("string")) % folds == 0, F.lit(False))
