"""Samples, rationals and damaged bytes."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sample formats, as numpy type, zero and full scale.
FORMATS = {"U8": ("u1", 128, 128), "S16": ("<i2", 0, 2**15), "S32": ("<i4", 0, 2**31), "F32": ("<f4", 0, 1), "F64": ("<f8", 0, 1)}


def to_float(data: bytes, kind: str) -> list[float]:
    """Whole samples of little-endian bytes, scaled to one."""
    import numpy as np

    if kind == "S24":
        raw = np.frombuffer(data[: len(data) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        return (((raw[:, 2] << 24 | raw[:, 1] << 16 | raw[:, 0] << 8) >> 8) / float(2**23)).tolist()
    dtype, zero, full = FORMATS[kind]
    width = np.dtype(dtype).itemsize
    return ((np.frombuffer(data[: len(data) // width * width], dtype).astype(float) - zero) / full).tolist()


def decoder(kind: str):
    """A vectorised function from bytes to samples."""

    @F.pandas_udf("array<double>")
    def decode(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else to_float(bytes(b), kind))

    return decode


def reduce(num: Column, den: Column) -> Column:
    """``struct<num, den>`` in lowest terms; the divisor by Euclid's steps, enough for any 64-bit pair."""
    start = F.struct(F.abs(num).alias("a"), F.abs(den).alias("b"))
    step = lambda s, _: F.when(s["b"] != 0, F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b"))).otherwise(s)
    divisor = F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step)["a"]
    divide = lambda x: F.call_function("div", x, F.when(divisor != 0, divisor))
    return F.struct(divide(num).alias("num"), divide(den).alias("den"))




#: What each of the twenty damaged versions does.
KEPT_PARTS = (1, 1, 2, 4, 8, 16, 32, 64)  # 0 to 7: the first n-th part, one byte at least
STRIDES, FLIPPED = (7, 10, 13, 16), 64 * 1024  # 8 to 11: every so many bytes of the first 64 KiB are inverted
ZEROED = 4096  # 12 to 15: so many bytes from a quarter's start are zeroed
MUTATIONS = 20  # 16 to 19: the first, middle, fourth and last byte is inverted


def mutate(data: bytes, i: int) -> bytes:
    """The i-th damaged version of a file; an empty one stays so, and so does one without the byte to invert."""
    n = len(data)
    if not n:
        return data
    if i < 8:
        return data[: max(1, n // KEPT_PARTS[i])]
    out = bytearray(data)
    if i < 12:
        places = range(0, min(n, FLIPPED), STRIDES[i - 8])
    elif i < 16:
        start = min((i - 12) * (n // 4), n - 1)
        stop = min(n, start + ZEROED)
        out[start:stop] = bytes(stop - start)
        return bytes(out)
    else:
        places = (p for p in ((0, n // 2, 3, n - 1)[i - 16],) if p < n)
    for p in places:
        out[p] = 255 - out[p]
    return bytes(out)


def mutated(df: DataFrame, content: str, count: int = MUTATIONS) -> DataFrame:
    @F.pandas_udf("binary")
    def damage(data: pd.Series, i: pd.Series) -> pd.Series:
        return pd.Series([mutate(bytes(b), int(k)) for b, k in zip(data, i)])

    rows = df.withColumn("mutation", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    return rows.withColumn(content, damage(F.col(content), F.col("mutation")))
