"""Quality rules: how far a document's character and word distributions lie from a language's.

References are learned from all documents: for each language with at least a thousandth
of all words, a histogram over character classes and one over its common words (those
that make up at least ``COMMON`` of the language's words, so at most 1 / COMMON of them) and the rest.
That bounds what is sent to the workers: at most 1000 languages of 1 / COMMON words.

A document is compared with each reference by Jensen-Shannon distance (square root of the divergence
in bits, 0 to 1), in both histograms; the nearest language counts.  It is rejected when a
distance is above its limit.  Documents of a language without a reference aren't judged by distances, as other
languages' references say nothing about them: the base rules alone decide.  Guards: below ``MIN_WORDS`` words no distance is judged, and a short text
isn't judged by its length: from the square of its distance in words is taken what a sample of so many words from the reference itself would have
on average, which is the sum over words of what a Poisson count around the expected one is away.

Base rules: too few words, or too many words in repeated 3-word windows.

Defined results: null and empty texts have no words and fail the base; null lang is a
language of its own for reference; texts of any length are measured whole; without any reference nothing is
rejected beyond the base; of references at the same distance it doesn't matter which is nearest; repeated rows are counted and judged each;
an empty table gives an empty result; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import functools
import itertools
import pickle
import unicodedata
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import begin, drop, fresh, keep, map_columns, ship, slices, text_or_empty

MIN_WORDS, MAX_REPEATED = 50, 50
COMMON, LEAST_SHARE = 1 / 400, 1 / 1000
#: Limits of the distances; the one for words holds beyond the sampling noise.
CLASS_LIMIT, WORD_LIMIT = 0.28, 0.225
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\v\f\r"
CLASSES = ("lower", "upper", "letter", "digit", "space", "line end", "stop", "quote", "symbol", "control")
#: Words a worker counts before it hands its counts on.
FLUSH = 300_000

@functools.lru_cache(maxsize=1)
def _class_table() -> np.ndarray:
    """The class of each code point of the first plane."""
    table = np.zeros(0x10000, dtype=np.uint8)
    at = {name: i for i, name in enumerate(CLASSES)}
    for code in range(0x10000):
        c = chr(code)
        kind = unicodedata.category(c)
        if c == "\n":
            name = "line end"
        elif c.isspace():
            name = "space"
        elif kind == "Ll":
            name = "lower"
        elif kind == "Lu":
            name = "upper"
        elif kind[0] in "LM":
            name = "letter"
        elif kind[0] == "N":
            name = "digit"
        elif c in ".,;:?":
            name = "stop"
        elif c in "'\"()-" or kind in ("Pi", "Pf", "Pd"):
            name = "quote"
        elif kind[0] == "C":
            name = "control"
        else:
            name = "symbol"
        table[code] = at[name]
    return table


def class_counts(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    return np.bincount(_class_table()[np.minimum(codes, 0xFFFF)], minlength=len(CLASSES))


def words_of(text: str) -> list[bytes]:
    """The words as UTF-8: bytes are split at the six ASCII white-space characters, which WORD leaves out."""
    return text.encode().split()


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    h = np.array(list(map(hash, words)), dtype=np.int64)
    w = h[:-2] * np.int64(1_000_003) + h[1:-1] * np.int64(69_069) + h[2:]
    if len(np.unique(w)) == len(w):
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    often = {w for w, n in Counter(windows).items() if n > 1}
    marks = bytearray(len(words))
    for i, w in enumerate(windows):
        if w in often:
            marks[i : i + 3] = b"\1\1\1"
    return sum(marks)


def repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of the rows of p from those of q, which sum to 1; base 2."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0.0).sum(axis=-1)
        right = np.where(q > 0, q * np.log2(q / m), 0.0).sum(axis=-1)
    return np.sqrt(np.clip((left + right) / 2, 0.0, 1.0))


#: Expected counts of the table of sampling noise.
_RATES = np.concatenate([[0.0], np.geomspace(1e-3, 300.0, 120)])


@functools.lru_cache(maxsize=1)
def _noise_table() -> np.ndarray:
    """Mean Jensen-Shannon divergence, in bits and counts, of a Poisson count from each of _RATES."""
    out = np.zeros(len(_RATES))
    for i, rate in enumerate(_RATES[1:], 1):
        counts = np.arange(int(rate + 12 * rate**0.5 + 20))
        chance = np.exp(np.cumsum(np.concatenate([[-rate], np.log(rate) - np.log(np.maximum(counts[1:], 1))])))
        with np.errstate(divide="ignore", invalid="ignore"):
            own = np.where(counts > 0, counts * np.log2(2 * counts / (counts + rate)), 0.0)
        out[i] = (chance * (own + rate * np.log2(2 * rate / (counts + rate)))).sum() / 2
    return out


def sampling_noise(shares: np.ndarray, n: int) -> np.ndarray:
    """Mean divergence of a sample of n words from the rows of ``shares`` it is drawn from."""
    return np.interp(shares * n, _RATES, _noise_table()).sum(axis=-1) / n


def _count(batches):
    """Counts of (lang, kind, key): words, and the character classes under their number."""
    import pyarrow as pa

    words: dict = defaultdict(Counter)
    classes: dict = {}

    def out():
        """A batch a language: its words' counts and its classes'."""
        for lang in [*words, *(x for x in classes if x not in words)]:
            found, shape = words.pop(lang, {}), classes.pop(lang, ())
            keys = pa.concat_arrays([pa.array(list(found), pa.binary()).cast(pa.string()), pa.array([str(i) for i in range(len(shape))], pa.string())])
            kinds = pa.array(["w", "c"]).take(pa.array(np.repeat([0, 1], [len(found), len(shape)])))
            n = np.concatenate([np.fromiter(found.values(), np.int64, len(found)), np.asarray(shape, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(n), np.int64))), kinds, keys, pa.array(n)], names=["lang", "kind", "key", "n"])

    begin(f"{__name__}.count")
    for batch in batches:
        for part in slices(batch):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                words[lang].update(words_of(text.lower()))
                classes[lang] = classes.get(lang, 0) + class_counts(text)
            if sum(map(len, words.values())) > FLUSH:
                yield from out()
    yield from out()


def references(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> list[tuple]:
    """``[(lang, class shares, {common word: share})]`` over all documents."""
    ship(docs.sparkSession)
    counts = docs.select(docs[lang_column].cast("string").alias("lang"), text_or_empty(docs, text_column).alias("text")).mapInArrow(_count, "lang string, kind string, key string, n long")
    sums = keep(counts.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")))
    totals = keep(sums.filter("kind = 'w'").groupBy("lang").agg(F.sum("n").alias("words")))
    every = totals.agg(F.sum("words")).first()[0] or 0
    # at most 1 / LEAST_SHARE languages can have that share of all words, and 1 / COMMON words that share of one
    large = totals.filter(F.col("words") >= LEAST_SHARE * every)
    kept = {row["lang"]: row["words"] for row in large.collect()}
    if not kept:
        return []
    # broadcast: at most 1 / LEAST_SHARE rows, and the few languages don't become the few tasks of a join
    big = sums.join(F.broadcast(large.withColumnRenamed("lang", "l")), F.col("lang").eqNullSafe(F.col("l")))
    rows = big.filter((F.col("kind") == "c") | (F.col("n") >= COMMON * F.col("words"))).select("lang", "kind", "key", "n").collect()
    drop(sums, totals)
    found = []
    for lang, total in sorted(kept.items(), key=lambda x: (x[0] is None, x[0])):
        shape = np.zeros(len(CLASSES))
        common = {}
        for r in rows:
            if r["lang"] == lang:
                if r["kind"] == "c":
                    shape[int(r["key"])] = r["n"]
                else:
                    common[r["key"]] = r["n"] / total
        found.append((lang, shape / max(1.0, shape.sum()), common))
    return found


class Judge:
    """Distances of documents from all references at once."""

    def __init__(self, refs: list[tuple]):
        self.shapes = np.array([shape for _, shape, _ in refs])
        words = sorted(set(itertools.chain.from_iterable(c for _, _, c in refs)))
        self.index = {w.encode(): i + 1 for i, w in enumerate(words)}
        # a row for each language: the places of its common words, padded with one that no word has; the
        # last column is for all its other words
        widest = max(len(c) for _, _, c in refs)
        self.none = len(words) + 1
        self.at = np.full((len(refs), widest), self.none)
        self.share = np.zeros((len(refs), widest + 1))
        for row, (_, _, common) in enumerate(refs):
            for column, (word, share) in enumerate(common.items()):
                self.at[row, column] = self.index[word.encode()]
                self.share[row, column] = share
            self.share[row, -1] = max(0.0, 1 - sum(common.values()))

    def distances(self, text: str) -> tuple[float, float, float]:
        """Of the nearest reference by the larger of both: in characters, in words, and the latter without its noise."""
        shape = class_counts(text)
        near = js_distance(shape / max(1, shape.sum()), self.shapes)
        seen = np.bincount(list(map(self.index.get, words_of(text.lower()), itertools.repeat(0))), minlength=self.none + 1)
        mine = seen[self.at] / max(1, seen.sum())
        far = js_distance(np.concatenate([mine, 1 - mine.sum(axis=1, keepdims=True)], axis=1), self.share)
        excess = np.sqrt(np.maximum(far**2 - sampling_noise(self.share, int(seen.sum())), 0.0))
        return min(zip(near.tolist(), far.tolist(), excess.tolist()), key=lambda d: max(d[:2]))


@functools.lru_cache(maxsize=4)
def _judge(key: bytes) -> Judge:
    return Judge(pickle.loads(key))


_MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"


def _measure(text: str, judge: Judge | None) -> tuple:
    """``judge`` is None where the text's language has no reference."""
    words = words_of(text)
    n = len(words)
    repeated = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEATED * n
    of_class = of_words = None
    kept = not failed
    if n >= MIN_WORDS and judge:
        of_class, of_words, excess = judge.distances(text)
        kept = kept and of_class <= CLASS_LIMIT and excess <= WORD_LIMIT
    return n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), repeated_lines(text), repeated, failed, kept, of_class, of_words


def measure(docs: DataFrame, refs: list[tuple], id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """All measures and both verdicts of every row; the distances are null where guards keep them from being judged."""
    key = pickle.dumps(refs)
    known = {lang for lang, _, _ in refs}

    def kernel(ids, langs, texts):
        judge = _judge(key) if refs else None
        return [ids, *map(list, zip(*(_measure(text, judge if lang in known else None) for lang, text in zip(langs, texts))))]

    kind = docs.schema[id_column].dataType.simpleString()
    return map_columns(docs, [docs[id_column], docs[lang_column].cast("string").alias("lang"), text_or_empty(docs, text_column).alias("text")], f"{id_column} {kind}, {_MEASURES}", kernel)


def keep_good(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns, judged where they lie: no join."""
    refs = references(docs, text_column, lang_column)
    key = pickle.dumps(refs)
    known = {lang for lang, _, _ in refs}
    own_lang, own = fresh(docs, "quality_lang", "quality_text")
    names = docs.columns

    def run(batches):
        import pyarrow as pa

        begin(f"{__name__}.keep_good")
        judge = _judge(key) if refs else None
        for batch in batches:
            for part in slices(batch):
                langs, texts = (part.column(part.num_columns - i).to_pylist() for i in (2, 1))
                good = [_measure(text, judge if lang in known else None)[6] for lang, text in zip(langs, texts)]
                yield part.filter(pa.array(good, pa.bool_())).select(names)

    return docs.withColumn(own_lang, F.col(lang_column).cast("string")).withColumn(own, text_or_empty(docs, text_column)).mapInArrow(run, docs.schema)


def judge_documents(docs: DataFrame) -> DataFrame:
    return measure(docs, references(docs))
