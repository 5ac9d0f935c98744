"""Records of the verification harness: manifests, pins, journals, a reference's JSON and hash lists, cue sheets."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "path string, rows array<string>, compare array<string>, streams map<string,int>"


def read_manifest(spark: SparkSession, text: str, rubric: list[str]) -> tuple[DataFrame, list[str]]:
    """Entries of a TOML manifest and what is wrong with it.  A manifest is a configuration file that is read on the driver."""
    import tomllib

    entries, errors = [], []
    for i, e in enumerate(tomllib.loads(text).get("sample", [])):
        extra = set(e) - {"path", "rows", "compare", "streams"}
        if extra:
            errors.append(f"entry {i}: unknown {', '.join(sorted(extra))}")
        if not re.match(r"^(fate|gen|samples):.", e.get("path", "")):
            errors.append(f"entry {i}: path {e.get('path')!r}")
        errors += [f"entry {i}: no row {r!r}" for r in e.get("rows", []) if r not in rubric]
        entries.append((e.get("path"), e.get("rows", []), e.get("compare", []), e.get("streams", {})))
    return spark.createDataFrame(entries, MANIFEST), errors


def pin_mismatches(files: DataFrame, pins: DataFrame) -> DataFrame:
    """Files (path, content) that have no pin (path, sha256) or another one."""
    hashed = files.select("path", F.sha2("content", 256).alias("found"))
    return hashed.join(pins, "path", "left").filter(~F.coalesce(F.col("found") == F.col("sha256"), F.lit(False))).select("path", "found", "sha256")


def journalled(lines: DataFrame, schema: str) -> DataFrame:
    """Whole records of a journal of JSON lines; a torn last line doesn't parse and is dropped."""
    parsed = lines.select(F.from_json("value", f"{schema}, _torn string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_torn"}).alias("r"))
    return parsed.filter("r IS NOT NULL AND r._torn IS NULL").select("r.*").drop("_torn")


def remaining(inputs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs the journal doesn't have yet."""
    return inputs.join(done.select(*keys).distinct(), keys, "left_anti")


PROBE = "streams array<struct<index:int,codec_type:string,codec_name:string,sample_rate:string,channels:int,disposition:struct<attached_pic:int>>>"


def probe_streams(df: DataFrame, json: str) -> DataFrame:
    """A row a stream of a probe's JSON; attached pictures aren't streams."""
    rows = df.withColumn("_s", F.explode(F.from_json(json, PROBE)["streams"]))
    return rows.filter(F.coalesce(F.col("_s.disposition.attached_pic"), F.lit(0)) == 0).select(*(c for c in df.columns if c != json), "_s.index", "_s.codec_type", "_s.codec_name", F.col("_s.sample_rate").try_cast("int").alias("sample_rate"), "_s.channels")


def frame_hashes(df: DataFrame, text: str) -> DataFrame:
    """Rows of a hash list: ``stream, dts, pts, duration, size, hash``, ``#`` for comments."""
    lines = df.select(*(c for c in df.columns if c != text), F.posexplode(F.split(text, "\n")).alias("_i", "_l")).filter("_l <> '' AND NOT startswith(_l, '#')")
    p = F.split("_l", r"\s*,\s*")
    return lines.select(*(c for c in df.columns if c != text), F.col("_i").alias("line"), F.btrim(p[0]).cast("int").alias("stream"), F.btrim(p[2]).cast("long").alias("pts"), F.btrim(p[5]).alias("hash")).filter("hash IS NOT NULL")


def parse_cue_sheet(text: str) -> list[tuple]:
    """(n, title, performer, start_ns) of a disc's tracks: index 01, else 00; the performer is the disc's where a track has none."""
    disc = {"TITLE": None, "PERFORMER": None}
    tracks: list[dict] = []
    for line in text.splitlines():
        m = re.match(r'^\s*(\w+)\s+(?:"([^"]*)"|(.*?))\s*$', line)
        if not m:
            continue
        word, value = m[1].upper(), m[2] if m[2] is not None else m[3]
        if word == "TRACK":
            tracks.append({"n": int(value.split()[0])})
        elif word in disc:
            (tracks[-1] if tracks else disc)[word] = value
        elif word == "INDEX" and tracks:
            number, _, stamp = value.partition(" ")
            t = re.fullmatch(r"(\d+):(\d+):(\d+)", stamp.strip())
            if t and int(t[2]) < 60 and int(t[3]) < 75 and int(number) in (0, 1):
                tracks[-1].setdefault("at", {})[int(number)] = (int(t[1]) * 60 + int(t[2])) * 10**9 + int(t[3]) * 10**9 // 75
    return [(t["n"], t.get("TITLE"), t.get("PERFORMER", disc["PERFORMER"]), t["at"].get(1, t["at"].get(0))) for t in tracks if t.get("at")]


def read_cue_sheets(files: DataFrame) -> DataFrame:
    """Chapters of a table of sheets (path, content)."""
    from .cues import decode

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(p, *row) for p, data in zip(pdf["path"], pdf["content"]) for row in parse_cue_sheet(decode(bytes(data or b"")))]
            yield pd.DataFrame(rows, columns=["path", "n", "title", "performer", "start_ns"])

    return files.select("path", "content").mapInPandas(run, "path string, n int, title string, performer string, start_ns long")
