"""Expressions on URLs and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def sub_beside_idx(url: Column) -> Column:
    """The data file of a subtitle index, null if it isn't one; query and fragment stay."""
    upper = F.regexp_replace(url, r"^([^?#]*)\.IDX(?=$|[?#])", "$1.SUB")
    lower = F.regexp_replace(url, r"(?i)^([^?#]*)\.idx(?=$|[?#])", "$1.sub")
    return F.when(url.rlike(r"^[^?#]*\.IDX($|[?#])"), upper).when(url.rlike(r"(?i)^[^?#]*\.idx($|[?#])"), lower)


def sibling(url: Column, name: Column) -> Column:
    """A file beside ``url``; null for names that hold separators, a drive, NUL, or are ``.`` or ``..``."""
    safe = (F.length(name) > 0) & ~name.rlike(r"[/\\:\x00]") & ~name.isin(".", "..") & ~F.contains(name, F.lit(".."))
    return F.when(safe, F.concat(F.regexp_extract(url, r"^([^?#]*/)", 1), name, F.regexp_extract(url, r"([?#].*)?$", 0)))


def byte_range(header: Column, size: Column) -> tuple[Column, Column]:
    """First and last byte of a ``Range`` header, null if it asks for nothing that exists."""
    p = r"^bytes=(\d*)-(\d*)$"
    a, b = (F.regexp_extract(header, p, i).try_cast("long") for i in (1, 2))
    last = size - 1
    suffix = a.isNull() & (b > 0)
    whole = (a < size) & (b.isNull() | (b >= a))
    return F.when(suffix, F.greatest(size - b, F.lit(0))).when(whole, a), F.when(suffix, last).when(whole, F.least(F.coalesce(b, last), last))
