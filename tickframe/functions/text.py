"""Expressions on cue texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plain(text: Column) -> Column:
    """Without tags in ``<>`` and ``{}``; hard spaces made so; lines trimmed, empty ones dropped."""
    bare = F.regexp_replace(F.replace(text, F.lit("\\h"), F.lit(" ")), r"<[^>]*>|\{[^}]*\}", "")
    lines = F.transform(F.split(bare, "\n"), lambda x: F.btrim(x, F.lit(" \t\r")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def decoded(raw: Column, fallback: str = "ISO-8859-1") -> Column:
    """Valid UTF-8 as it is, other bytes by a code page; CR LF and CR become LF."""
    text = F.coalesce(F.try_validate_utf8(raw.cast("string")), F.decode(raw, fallback))
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def policies(df: DataFrame, token: str) -> DataFrame:
    """``kind:policy[:decibels]``: parsed and judged; decibels must be finite and at least 90."""
    t = F.col(token)
    part = lambda i: F.try_element_at(F.split(t, ":"), F.lit(i))
    two = F.size(F.split(t, ":")) >= 2
    db = part(3).try_cast("double")
    good = F.coalesce((db >= 90) & (db < float("inf")) & ~F.isnan(db), F.lit(False))
    snr = F.coalesce(part(2) == "snr", F.lit(False))
    return df.select(t.alias("token"), F.when(two, part(1)).alias("kind"), F.when(two, part(2)).alias("policy"), F.when(snr & good, db).alias("db"), (two & (~snr | good)).alias("valid"))
