"""Rotated views of volumes (plane, y, x, v)."""

from __future__ import annotations

from math import ceil, cos, radians, sin

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.functions import stats
from stackloom.operators import chunks, volume

AXES = ("plane", "y", "x")


def shape_of(vol: DataFrame) -> tuple[int, int, int]:
    """Voxels along each axis; coordinates count from 0."""
    return tuple(n + 1 for n in vol.agg(*(F.max(c) for c in AXES)).first())


def turn(rows: int, columns: int, angle: float) -> tuple[float, float, tuple[int, int], tuple[float, float]]:
    """Cosine, sine, size of the turned image that holds all of a rows x columns one, and the offsets of source coordinates.

    The source of a target (i, j) is (c i + s j + a, c j - s i + b); both centres coincide.
    """
    c, s = round(cos(radians(angle)), 15), round(sin(radians(angle)), 15)
    size = int(abs(c) * rows + abs(s) * columns + 0.5), int(abs(c) * columns + abs(s) * rows + 0.5)
    mid = (size[0] - 1) / 2, (size[1] - 1) / 2
    return c, s, size, ((rows - 1) / 2 - c * mid[0] - s * mid[1], (columns - 1) / 2 - c * mid[1] + s * mid[0])


def rotate(vol: DataFrame, angle: float, axes: tuple[str, str] = ("y", "x"), nearest: bool = False) -> DataFrame:
    """Each volume turned by degrees in the plane of two axes, grown to hold all of it.

    Linear interpolation, or the nearest voxel for masks; 0 where the source lies outside.
    """
    return chunks.turned(vol, axes, nearest, lambda rows, columns: turn(rows, columns, angle))


def turned_shape(shape: tuple[int, int, int], angle: float, axes: tuple[str, str] = ("y", "x")) -> tuple[int, int, int]:
    p, q = (AXES.index(a) for a in axes)
    out = list(shape)
    out[p], out[q] = turn(shape[p], shape[q], angle)[2]
    return tuple(out)


def dilate(mask: DataFrame, shape: tuple[int, int], steps: int = 1) -> DataFrame:
    """Pixels (y, x) within so many steps along rows and columns of those of a mask; other columns name the image."""
    keys = [c for c in mask.columns if c not in ("y", "x")]
    reach = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-steps, steps + 1) for j in range(-steps, steps + 1) if abs(i) + abs(j) <= steps))
    d = mask.select(*keys, "y", "x", F.explode(reach).alias("o")).select(*keys, (F.col("y") + F.col("o.i")).alias("y"), (F.col("x") + F.col("o.j")).alias("x"))
    return d.where(F.col("y").between(0, shape[0] - 1) & F.col("x").between(0, shape[1] - 1)).distinct()


def crop_nonzero(image: DataFrame, threshold: float, pad: int = 0) -> DataFrame:
    """Images (y, x, v), each cut to the padded bounding box of what is above a threshold and counted from 0; nothing of one where nothing is.

    Other columns name the image."""
    keys = [c for c in image.columns if c not in ("y", "x", "v")]
    box = image.where(F.col("v") > threshold).groupBy(*keys).agg(*(f(c).alias(f"{n}_{c}") for c in ("y", "x") for n, f in (("lo", F.min), ("hi", F.max)))).where("lo_y is not null")
    size = image.groupBy(*keys).agg(F.max("y").alias("top_y"), F.max("x").alias("top_x"))
    d = image.join(box, keys).join(size, keys) if keys else image.join(F.broadcast(box)).join(F.broadcast(size))  # one row each, or none
    lo, hi = (lambda c: F.greatest(F.col(f"lo_{c}") - pad, F.lit(0))), (lambda c: F.least(F.col(f"hi_{c}") + pad, F.col(f"top_{c}")))
    return d.where(F.col("y").between(lo("y"), hi("y")) & F.col("x").between(lo("x"), hi("x"))).select(*keys, (F.col("y") - lo("y")).alias("y"), (F.col("x") - lo("x")).alias("x"), "v")


def _turned(vol: DataFrame, azimuth: float, elevation: float, nearest: bool = False) -> DataFrame:
    return rotate(rotate(vol, azimuth, ("y", "x"), nearest), elevation, ("plane", "y"), nearest)


def _ones(vol: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    n = shape[0] * shape[1] * shape[2]
    return vol.sparkSession.range(n).select(F.floor(F.col("id") / (shape[1] * shape[2])).alias("plane"), (F.floor(F.col("id") / shape[2]) % shape[1]).alias("y"), (F.col("id") % shape[2]).alias("x"), F.lit(1.0).alias("v"))


def views(vol: DataFrame, z_step_um: float, pixel_um: float, azimuth: float = -20.0, elevation: float = 28.0, pad: int = 4) -> DataFrame:
    """(view, y, x, v): maximum projections of a display volume along Z, along Y, and obliquely.

    Side and oblique views come from planes resampled to the pixel size. The oblique one is cut to the footprint of the
    turned cuboid, with a margin, and NaN outside of it.
    """
    n = shape_of(vol)
    size = (max(2, round(n[0] * z_step_um / pixel_um)), n[1], n[2])
    iso = volume.resample(vol, size)
    seen, feet = _turned(iso, azimuth, elevation), _turned(_ones(vol, size), azimuth, elevation, nearest=True)
    flat = lambda d: d.groupBy("y", "x").agg(F.max("v").alias("v"))
    both = flat(seen).join(flat(feet).withColumnRenamed("v", "foot"), ["y", "x"])
    box = both.where("foot > 0").agg(*(f(c).alias(f"{k}_{c}") for c in ("y", "x") for k, f in (("lo", F.min), ("hi", F.max))))
    low = {c: F.greatest(F.col(f"lo_{c}") - pad, F.lit(0)) for c in ("y", "x")}
    both = both.join(F.broadcast(box)).where(F.col("y").between(low["y"], F.col("hi_y") + pad) & F.col("x").between(low["x"], F.col("hi_x") + pad))  # one row
    oblique = both.select(F.lit("oblique").alias("view"), (F.col("y") - low["y"]).alias("y"), (F.col("x") - low["x"]).alias("x"), F.when(F.col("foot") > 0, F.col("v")).otherwise(stats.nan()).alias("v"))
    axial = flat(vol).select(F.lit("axial").alias("view"), "y", "x", "v")
    side = iso.groupBy("plane", "x").agg(F.max("v").alias("v")).select(F.lit("side").alias("view"), F.col("plane").alias("y"), "x", "v")
    return axial.unionByName(side).unionByName(oblique)


def cuboid(vol: DataFrame, spacing_zyx_um: tuple[float, float, float], most: int = 360, azimuth: float = -35.0, elevation: float = 32.0, threshold: float = 0.24, opacity: float = 0.14, thickness: int = 1, dilation: int = 1, padding: float = 0.12) -> DataFrame:
    """(y, x, v, support, edge): the turned physical cuboid of a display volume, composited front to back, with its twelve edges.

    All layers are cut to the footprint and get a margin of a share of the longer side, at least 12 pixels; v is NaN
    outside the footprint.
    """
    n = shape_of(vol)
    spans = [a * b for a, b in zip(n, spacing_zyx_um, strict=True)]
    step = max(min(spacing_zyx_um), max(spans) / most)
    size = tuple(max(2, round(s / step)) for s in spans)
    iso = volume.resample(vol, size)
    full = turned_shape(turned_shape(size, azimuth), elevation, ("plane", "y"))
    seen, feet = _turned(iso, azimuth, elevation), _turned(_ones(vol, size), azimuth, elevation, nearest=True)
    lines = _turned(volume.cuboid_edges(_ones(vol, size), thickness).withColumn("v", F.lit(1.0)), azimuth, elevation, nearest=True)
    signal = F.least(F.greatest((F.col("v") - threshold) / (1 - threshold), F.lit(0.0)), F.lit(1.0))
    shown = volume.alpha_composite(seen.withColumn("v", signal), opacity)
    foot = feet.where("v > 0").select("y", "x").distinct().withColumn("support", F.lit(True))
    edge = dilate(lines.where("v > 0").select("y", "x").distinct(), full[1:], dilation).withColumn("edge", F.lit(True))
    lo_y, hi_y, lo_x, hi_x = foot.agg(F.min("y"), F.max("y"), F.min("x"), F.max("x")).first()
    high, wide = hi_y - lo_y + 1, hi_x - lo_x + 1
    margin = max(12, ceil(max(high, wide) * padding))
    canvas = vol.sparkSession.range((high + 2 * margin) * (wide + 2 * margin)).select(F.floor(F.col("id") / (wide + 2 * margin)).alias("to_y"), (F.col("id") % (wide + 2 * margin)).alias("to_x"))
    canvas = canvas.withColumns({"y": F.col("to_y") + (lo_y - margin), "x": F.col("to_x") + (lo_x - margin)})
    out = canvas.join(foot, ["y", "x"], "left").join(edge, ["y", "x"], "left").join(shown, ["y", "x"], "left")
    cut = F.col("y").between(lo_y, hi_y) & F.col("x").between(lo_x, hi_x)
    support = F.coalesce("support", F.lit(False))
    return out.select(F.col("to_y").alias("y"), F.col("to_x").alias("x"), F.when(support, F.col("v")).otherwise(stats.nan()).alias("v"), support.alias("support"), (F.coalesce("edge", F.lit(False)) & cut).alias("edge"))
