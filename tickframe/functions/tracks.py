"""Expressions on track descriptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The largest side and area of a picture, standard frame rates and how near one must be.
SIDE, AREA = 16384, 8192 * 8192
CADENCES = [24000 / 1001, 24.0, 25.0, 30000 / 1001, 30.0, 50.0, 60000 / 1001, 60.0]
NEAR = 0.0025


def offered(kind: Column, width: Column, height: Column) -> Column:
    """Audio, subtitles and video of a sane size."""
    huge = (width > SIDE) | (height > SIDE) | (width.cast("long") * height > AREA)
    return kind.isin("audio", "video", "subtitle") & ~((kind == "video") & F.coalesce(huge, F.lit(False)))


def snap_fps(measured: Column) -> Column:
    """The nearest standard rate within a quarter of a percent, else the rate as measured."""
    near = F.filter(F.transform(F.array(*[F.lit(c) for c in CADENCES]), lambda c: F.struct((F.abs(measured - c) / c).alias("error"), c.alias("rate"))), lambda x: x["error"] <= NEAR)
    return F.coalesce(F.array_min(near)["rate"], measured)


def floor_for(kind: Column, lines: Column) -> Column:
    """Times real time a decoder has to reach."""
    return F.when(kind == "audio", 10.0).when(lines > 576, 2.0).otherwise(4.0)


def signal(transfer: Column, depth: Column, chroma: Column) -> Column:
    light = F.when(transfer == "pq", "HDR10").when(transfer == "hlg", "HLG").when(transfer == "dolby", "Dolby Vision").otherwise("SDR")
    layout = F.when(chroma == 0, "4:2:0").when(chroma == 1, "4:2:2").otherwise("4:4:4")
    return F.concat(light, F.lit(" "), depth.cast("string"), F.lit("-bit "), layout)


def fit(width: Column, height: Column, canvas_width: int, canvas_height: int) -> tuple[Column, Column, Column]:
    scale = F.least(F.try_divide(F.lit(float(canvas_width)), width), F.try_divide(F.lit(float(canvas_height)), height))
    return scale, F.floor(width * scale + 0.5).cast("long"), F.floor(height * scale + 0.5).cast("long")
