"""Byte-level BPE as a monoid: texts are encoded by tree reduction, decoded by concatenation.

A match of the split pattern is cut in halves down to small leaves; a leaf is merged
directly.  Two neighbouring encodings L and R are joined by encoding afresh a window of
the last tokens of L and the first of R.  The window grows on a side until its
outermost token there comes out as it was.  Then every adjacent pair of the joined row is a
pair that encodes to itself: pairs outside the window as before, pairs inside by
construction.  A row of tokens whose adjacent pairs all encode to themselves is the
encoding of its bytes (the first merge across a border would also have happened in that
pair alone), so the tokens outside are proved stable and the result is that of merging the whole match.

Decoding maps ids to bytes and concatenates them up the same kind of tree.

Defined results: null and empty text encode to no ids; a text of any length is encoded whole,
a match of a million bytes in O(n log^2 n); special strings are ordinary text; of equal ranks the first pair is merged; repeated rows are encoded each, an empty table gives an
empty result, and other columns don't matter, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame

from .merging import merge, symbols
from .runtime import Memo, map_columns, text_or_empty

#: Bytes of a leaf; remembered matches, leaves and windows in a worker; the longest remembered, in bytes.
LEAF, ENTRIES, PARTS, LONGEST = 12, 900_000, 300_000, 48
#: Ids that one leaf of the decoding tree concatenates.
DECODE_LEAF = 4096


def _ranges(characters: str) -> str:
    """Sorted characters as the inside of a character class."""
    out, start, last = [], None, None
    for c in map(ord, characters):
        if start is None or c != last + 1:
            if start is not None:
                out.append((start, last))
            start = c
        last = c
    if start is not None:
        out.append((start, last))
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


class ByteBPE:
    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as file:
            rows = (line.split() for line in file if line.strip())
            self.rank = {base64.b64decode(token): int(rank) for token, rank in rows}
        missing = [b for b in range(256) if bytes([b]) not in self.rank]
        if missing:
            raise ValueError(f"{path}: {len(missing)} single bytes have no rank")
        # the ranks' own library takes white space as the Unicode property does
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"(?!\S)", r"(?!\P{White_Space})"))
        self.quick, self.unusual = self._quick(pattern)
        self.tokens = {rank: token for token, rank in self.rank.items()}
        self.packed = {token: rank.to_bytes(4, "little") for token, rank in self.rank.items()}
        self.direct = Memo(self._direct, PARTS, LONGEST)
        self.memo = Memo(self.encode_match, ENTRIES, LONGEST)

    @staticmethod
    def _quick(pattern: str):
        """The same pattern for the standard library's faster matcher, and what texts must not hold for
        it to agree: numbers that aren't decimal digits, characters it may be too old or too young
        to class alike, and its four extra kinds of white space."""
        plain = pattern.replace(r"[^\s\p{L}\p{N}]+", r"(?:[^\s\w]|_)+").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
        if r"\p" in plain:
            return None, None
        odd = "".join(c for c in map(chr, range(0x10000)) if c.isnumeric() and not c.isdecimal() and not c.isalpha() or unicodedata.category(c) == "Cn")
        return re.compile(plain), re.compile(f"[\x1c-\x1f{_ranges(odd)}\U00010000-\U0010ffff]")

    def matches(self, text: str) -> list[str]:
        if self.quick is None or self.unusual.search(text):
            return self.split.findall(text)
        return self.quick.findall(text)

    def _direct(self, data: bytes) -> list[bytes]:
        return symbols(data, merge(data, self.rank.get))

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        if not left or not right:
            return left or right
        a = b = 1
        while True:
            window = self.direct[b"".join(left[-a:]) + b"".join(right[:b])]
            firm_left = a >= len(left) or window[0] == left[-a]
            firm_right = b >= len(right) or window[-1] == right[b - 1]
            if firm_left and firm_right:
                return left[: max(0, len(left) - a)] + window + right[b:]
            if not firm_left:
                a *= 2
            if not firm_right:
                b *= 2

    def tree(self, data: bytes) -> list[bytes]:
        if len(data) <= LEAF:
            return self.direct[data]
        half = len(data) // 2
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def encode_match(self, match: str) -> bytes:
        """Ids of one match of the pattern, as little-endian unsigned 32-bit integers."""
        data = match.encode()
        whole = self.packed.get(data)
        return whole if whole is not None else b"".join(map(self.packed.__getitem__, self.tree(data)))

    def encode_packed(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, self.matches(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype="<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        level = [b"".join(map(self.tokens.__getitem__, ids[i : i + DECODE_LEAF])) for i in range(0, len(ids), DECODE_LEAF)]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, ids array<int>)`` of every row."""

    def kernel(keys, texts):
        c = codec(path, pattern)
        return keys, [c.encode(t) for t in texts]

    kind = docs.schema[id_column].dataType.simpleString()
    return map_columns(docs, [docs[id_column], text_or_empty(docs, text_column).alias("text")], f"{id_column} {kind}, ids array<int>", kernel)


def decode(encoded: DataFrame, path: str, pattern: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """``(id, data binary)`` of every row of ids; null ids decode to no bytes."""

    def kernel(keys, rows):
        c = codec(path, pattern)
        return keys, [c.decode(ids or []) for ids in rows]

    kind = encoded.schema[id_column].dataType.simpleString()
    return map_columns(encoded, [encoded[id_column], encoded[ids_column]], f"{id_column} {kind}, data binary", kernel)


def round_trip(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode, then decode the ids, and keep digests of both: ``(id, n_tokens, ids_sha256, decoded_sha256)``.

    One pass of ``encode`` and ``decode`` in the same worker, so the ids of a text never
    travel further than its own row."""

    def kernel(keys, texts):
        c = codec(path, pattern)
        n, ids_sha, data_sha = [], [], []
        for text in texts:
            packed = c.encode_packed(text)
            ids = np.frombuffer(packed, dtype="<u4").tolist()
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(packed).hexdigest())
            data_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
        return keys, n, ids_sha, data_sha

    kind = docs.schema[id_column].dataType.simpleString()
    return map_columns(docs, [docs[id_column], text_or_empty(docs, text_column).alias("text")], f"{id_column} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", kernel)
