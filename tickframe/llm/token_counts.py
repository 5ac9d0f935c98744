"""Token counts of whole texts under a sentence-piece BPE vocabulary, without ids.

A text's symbols are its characters, spaces written as U+2581 with one before
the text.  The lowest-rank adjacent pair is merged, again and again, off a heap
over a linked list; the count is the initial symbols minus the merges, where a
character outside the vocabulary stands for its UTF-8 bytes.

No piece of such a vocabulary holds a space mark after another character, so no merge
crosses the start of a run of marks; loading proves this for the vocabulary at hand, and
likewise which other characters merges never cross.  The stretches between
are counted apart and remembered, which gives the count of the whole text exactly.

Defined results: null and empty text have no tokens; a text of any length is counted whole;
special strings in a text are ordinary characters; of equal ranks the first pair in the text is merged, as the library does;
repeated rows are counted each, an empty table gives an empty result, and other columns don't matter, whatever their names.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merging import merge
from .runtime import Memo, map_columns, text_or_empty

MARK = "▁"
#: Remembered stretches in a worker, and the longest remembered.
ENTRIES, LONGEST = 1_000_000, 48
LETTER = re.compile(r"[^\W\d_]")


class PieceCounter:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec = model.normalizer_spec
        kinds = {p.type for p in model.pieces}
        # 1 normal, 2 unknown, 3 control, 6 byte: the kinds without rules of their own inside texts
        if kinds - {1, 2, 3, 6} or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError(f"{path}: only byte-fallback BPE without normalisation is supported")
        self.prefix = MARK if spec.add_dummy_prefix else ""
        self.rank = {p.piece: -p.score for p in model.pieces if p.type == 1}
        self.known = {p for p in self.rank if len(p) == 1}
        inside = [p for p in self.rank if len(p) > 1]
        if any(p.lstrip(MARK).count(MARK) for p in inside):
            raise ValueError(f"{path}: a piece has a space mark after another character")
        # what a stretch may end at: a mark; line ends and tabs, if no longer piece has them; the end of
        # a run of letters, unless some piece goes on from a letter with that very character
        pairs = {(x, y) for p in inside for x, y in zip(p, p[1:])}
        cut = "".join(c for c in "\n\t\r" if not any(c in pair for pair in pairs))
        # word characters that aren't letters, such as fractions, stay out of the runs
        odd = "".join(sorted({c for pair in pairs for c in pair if LETTER.match(c) and not c.isalpha()}))
        letter = re.compile(rf"[^\W\d_{odd}]")
        joins = "".join(sorted({y for x, y in pairs if letter.match(x) and not letter.match(y) and y != MARK}))
        rest = f"[^{MARK}{re.escape(cut)}]"
        on = f"(?![{re.escape(joins)}])" if joins else ""
        self.stretch = re.compile(f"{MARK}*{letter.pattern}++{on}|{MARK}+{rest}*|{rest}+" + (f"|[{re.escape(cut)}]+" if cut else ""))
        self.memo = Memo(self.count_stretch, ENTRIES, LONGEST)

    def count_stretch(self, stretch: str) -> int:
        """Initial symbols minus merges."""
        after = merge(stretch, self.rank.get)
        merges = after.count(0)
        count = len(stretch) - merges
        if not self.known.issuperset(stretch):
            for i, c in enumerate(stretch):
                if after[i] == i + 1 and c not in self.known:
                    count += len(c.encode()) - 1
        return count

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = self.prefix + text.replace(" ", MARK)
        return sum(map(self.memo.__getitem__, self.stretch.findall(marked)))


@functools.lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens)`` of every row; ``path`` is the vocabulary's place on the executors."""

    def kernel(ids, texts):
        c = counter(path)
        return ids, [len(t.encode()) for t in texts], [c.count(t) for t in texts]

    kind = docs.schema[id_column].dataType.simpleString()
    return map_columns(docs, [docs[id_column], text_or_empty(docs, text_column).alias("text")], f"{id_column} {kind}, n_bytes long, n_tokens long", kernel)


def within_limit(counts: DataFrame, limit: int) -> DataFrame:
    return counts.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
