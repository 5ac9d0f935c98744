"""Exact rational time: ticks are integers in a base of num/den seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOWEST = -(2**63)


def _wide(c: Column) -> Column:
    return c.cast("decimal(19,0)").cast("decimal(38,0)")


def rescale(a: Column, b: Column, c: Column) -> Column:
    """a * b / c to the nearest integer, halves away from zero; the lowest long if b < 0, c <= 0 or the result
    doesn't fit.  Exact: products are decimals of 38 digits."""
    wide = lambda x: x.cast("decimal(38,0)")
    divisor = F.when(c > 0, c)
    product = wide(F.abs(_wide(a)).cast("decimal(19,0)") * b.cast("decimal(19,0)")) + wide(F.call_function("div", divisor, F.lit(2).cast("long")))
    product = wide(product)
    # the remainder is exact, and so is the division of what is left
    quotient = wide((product - wide(product % wide(divisor))) / wide(divisor))
    signed = F.when(a < 0, -quotient).otherwise(quotient)
    fits = (b >= 0) & (c > 0) & (signed <= wide(F.lit(2**63 - 1))) & (signed >= wide(F.lit(LOWEST)))
    return F.when(fits, signed.try_cast("long")).otherwise(F.lit(LOWEST))


def srt_time(us: Column) -> Column:
    """``HH:MM:SS,mmm`` of microseconds, rounded to milliseconds; negative is zero."""
    ms = F.floor((F.greatest(us, F.lit(0)) + 500) / 1000).cast("long")
    return srt_clock(ms)


def srt_clock(ms: Column) -> Column:
    s = F.floor(ms / 1000).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(s / 3600).cast("long"), F.floor(s / 60).cast("long") % 60, s % 60, ms % 1000)


def srt_end(start_us: Column, end_us: Column) -> Column:
    """An open end (null) is shown as the start plus 2^32 - 1 milliseconds."""
    open_end = srt_clock(F.floor((F.greatest(start_us, F.lit(0)) + 500) / 1000).cast("long") + F.lit(2**32 - 1))
    return F.when(end_us.isNull(), open_end).otherwise(srt_time(end_us))


def srt_parse(line: Column) -> tuple[Column, Column]:
    """Start and duration in milliseconds of a SubRip timing line, null if it isn't one; durations wrap to 32 bits."""
    p = r"^\s*(\d+):(\d+):(\d+)[,.](\d+)\s*-->\s*(\d+):(\d+):(\d+)[,.](\d+)"
    n = [F.regexp_extract(line, p, i).try_cast("long") for i in range(1, 9)]
    ms = lambda x: ((x[0] * 60 + x[1]) * 60 + x[2]) * 1000 + x[3]
    start, length = ms(n[:4]), ms(n[4:]) - ms(n[:4])
    return start, F.pmod(length + 2**31, F.lit(2**32)) - 2**31


def cd_time(text: Column) -> Column:
    """Nanoseconds of ``MM:SS:FF`` with 75 frames a second; null if malformed or out of range."""
    part = lambda i: F.regexp_extract(text, r"^(\d+):(\d+):(\d+)$", i).try_cast("long")
    m, s, f = part(1), part(2), part(3)
    return F.when((s < 60) & (f < 75), (m * 60 + s) * 1_000_000_000 + F.floor(f * 1_000_000_000 / 75).cast("long"))


def media_time(ticks: Column, num: Column, den: Column) -> Column:
    """Nanoseconds, 0 for ticks at or below 0 or an invalid base."""
    return F.when((ticks > 0) & (num > 0) & (den > 0), rescale(ticks, num * 1_000_000_000, den)).otherwise(F.lit(0).cast("long"))


def seconds(ticks: Column, num: Column, den: Column) -> Column:
    return F.when((num > 0) & (den > 0), ticks * num / den)
