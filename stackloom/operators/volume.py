"""Volumes (scan_id, plane, y, x, v): projections, slabs, comparisons of planes, composites, merging, resampling.

Everything is done stack by stack, for all stacks of a table at once; a table without scan_id is one stack.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackloom.functions import scalar, stats
from stackloom.operators import chunks
from stackloom.operators.stacks import AXES, stack, with_each
from stackloom.runtime import keep


def projections(vol: DataFrame) -> DataFrame:
    """name, i, j, mean, max along each axis, in one pass over the volume."""
    v, keys = stats.skip_nan(F.col("v")), stack(vol)
    sets = [[*keys, "y", "x"], [*keys, "plane", "x"], [*keys, "plane", "y"]]
    g = vol.groupingSets([[F.col(c) for c in x] for x in sets], *keys, "plane", "y", "x").agg(F.avg(v).alias("mean"), F.max(v).alias("max"), F.grouping("plane").alias("gp"), F.grouping("y").alias("gy"))
    name = F.when(F.col("gp") == 1, "xy").when(F.col("gy") == 1, "xz").otherwise("yz")
    return g.select(*keys, name.alias("name"), F.when(name == "xy", F.col("y")).otherwise(F.col("plane")).alias("i"), F.when(name == "yz", F.col("y")).otherwise(F.col("x")).alias("j"), F.coalesce("mean", stats.nan()).alias("mean"), F.coalesce("max", stats.nan()).alias("max"))


def projection_summary(vol: DataFrame) -> DataFrame:
    keys = stack(vol)
    long = projections(vol).select(*keys, "name", F.stack(F.lit(2), F.lit("mean"), "mean", F.lit("max"), "max").alias("kind", "v"))
    return long.groupBy(*keys, "name", "kind").agg(F.min("v").alias("minimum"), F.avg("v").alias("mean"), F.max("v").alias("maximum"))


def slab_mip(vol: DataFrame, centre: Column, half: int) -> DataFrame:
    """Maximum over the planes within ``half`` of a centre."""
    return vol.where(F.col("plane").between(centre - half, centre + half)).groupBy(*stack(vol), "y", "x").agg(stats.nan_max(F.col("v")).alias("v"))


def slab_panels(vol: DataFrame, fractions: list[float], half: int) -> DataFrame:
    """A slab projection around each fraction of the depth; centres by half-even rounding."""
    depth = vol.groupBy(*stack(vol)).agg(F.max("plane").alias("top_"))
    centre = F.rint(F.col("fraction") * F.col("top_")).cast("long")
    d = with_each(vol, depth).withColumn("fraction", F.explode(F.array(*(F.lit(f) for f in fractions)))).withColumn("centre", centre)
    near = F.col("plane").between(F.col("centre") - half, F.col("centre") + half)
    return d.where(near).groupBy(*stack(vol), "fraction", "centre", "y", "x").agg(stats.nan_max(F.col("v")).alias("v"))


def ranged(vol: DataFrame, low: float, high: float) -> DataFrame:
    """Adds the percentiles ``lo`` and ``hi`` of all numbers of the stack."""
    return with_each(vol, stats.quantiles(vol, stack(vol), "v", {"lo": low, "hi": high}))


def display(vol: DataFrame, low: float = 0.01, high: float = 0.998, gamma: float = 0.75, asinh: float | None = None) -> DataFrame:
    d = ranged(vol, low, high)
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    return d.withColumn("shown", scalar.display_gamma(v, lo, hi, gamma) if asinh is None else scalar.display_asinh(v, lo, hi, asinh))


def clip_fractions(vol: DataFrame, low: float, high: float) -> DataFrame:
    """The display range, and the shares of finite values below and above it, and of finite ones among all."""
    ok = stats.finite(F.col("v"))
    part = lambda c: F.avg(F.when(ok, c.cast("double")))
    return ranged(vol, low, high).groupBy(*stack(vol)).agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"), part(F.col("v") < F.col("lo")).alias("clipped_low"), part(F.col("v") > F.col("hi")).alias("clipped_high"), F.avg(ok.cast("double")).alias("finite"))


def lag_correlation(vol: DataFrame, most: int = 1) -> DataFrame:
    """plane_a, plane_b, lag, corr of all pairs of planes up to a lag apart, from moments of tiles of all planes."""
    m = chunks.moments(vol, most)
    n, rounding = F.col("n"), 1e-13
    spread = lambda q, t: F.when(F.col(q) - F.col(t) * F.col(t) / n > rounding * F.col(q), F.col(q) - F.col(t) * F.col(t) / n)
    corr = (F.col("sab") - F.col("sa") * F.col("sb") / n) / F.sqrt(spread("saa", "sa") * spread("sbb", "sb"))
    return m.select(*stack(vol), "plane_a", "plane_b", "lag", F.when(n < 2, stats.nan()).otherwise(F.coalesce(corr, stats.nan())).alias("corr"))


def z_decay(vol: DataFrame, step_um: float, most: int = 10) -> DataFrame:
    c = stats.skip_nan(F.col("corr"))
    return lag_correlation(vol, most).groupBy(*stack(vol), "lag").agg((F.first("lag") * step_um).alias("lag_um"), F.count("*").alias("pairs"), F.avg(c).alias("mean"), F.median(c).alias("median"), stats.percentile(c, 0.05).alias("p05"), stats.percentile(c, 0.95).alias("p95"))


def volume_metrics(vols: dict[str, DataFrame], spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), row: float = 0.5, column: float = 0.5) -> DataFrame:
    """A row for each method and stack: adjacent-plane correlation, spread, share of numbers, and the scale-normalised
    Tenengrad of the XZ and YZ slices at given fractions of rows and columns (half-even) and of the axial maximum."""
    out = None
    for name, vol in vols.items():
        keys = stack(vol)
        v = stats.skip_nan(F.col("v"))
        whole = vol.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.avg(stats.finite(F.col("v")).cast("double")).alias("finite"))
        near = lag_correlation(vol).groupBy(*keys).agg(F.avg(stats.skip_nan(F.col("corr"))).alias("adjacent_mean"), F.median(stats.skip_nan(F.col("corr"))).alias("adjacent_median"))
        cut = with_each(vol, vol.groupBy(*keys).agg(F.rint(row * F.max("y")).cast("long").alias("row_"), F.rint(column * F.max("x")).cast("long").alias("column_")))
        whole_key = [*keys, "one_"]
        image = lambda d, y, x: d.select(*keys, F.lit(0).alias("one_"), F.col(y).alias("i"), F.col(x).alias("j"), "v")  # noqa: B023, E731
        sharp = {
            "tenengrad_xz": (image(cut.where("y = row_"), "plane", "x"), (spacing[0], spacing[2])),
            "tenengrad_yz": (image(cut.where("x = column_"), "plane", "y"), (spacing[0], spacing[1])),
            "tenengrad_axial": (image(vol.groupBy(*keys, "y", "x").agg(stats.nan_max(F.col("v")).alias("v")), "y", "x"), (spacing[1], spacing[2])),
        }
        line = with_each(whole, near)
        for n, (d, s) in sharp.items():
            line = with_each(line, stats.tenengrad(d, whole_key, "i", "j", "v", s).select(*keys, F.col("tenengrad").alias(n)))
        line = line.withColumn("method", F.lit(name))
        out = line if out is None else out.unionByName(line)
    return out


def attenuated_mip(vol: DataFrame, a: float) -> DataFrame:
    """Maximum of the signal weakened by what lies in front of it."""
    return chunks.composed(vol, lambda v: (v * np.exp(-a * _in_front(v))).max(0))


def alpha_composite(vol: DataFrame, opacity: float) -> DataFrame:
    """Front-to-back compositing in closed form."""
    return chunks.composed(vol, lambda v: (np.exp(-opacity * _in_front(v)) * (1 - np.exp(-opacity * v)) * v).sum(0))


def _in_front(v: np.ndarray) -> np.ndarray:
    """Sums of the planes before each."""
    return np.concatenate((np.zeros((1, *v.shape[1:])), np.cumsum(v[:-1], 0)))


def merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union of two stacks; planes that both have are averaged."""
    return first.unionByName(second).groupBy(*stack(first), "plane", "y", "x").agg(stats.nan_avg(F.col("v")).alias("v"), F.count("*").alias("sources"))


def boundary(first: DataFrame, second: DataFrame, zs: tuple[DataFrame, DataFrame], tolerance_um: float = 1e-6) -> DataFrame:
    """A row a stack: gap_um from the last plane of the first to the first plane of the second one, mean boundary z, planes in and out, and ``overlaps``.

    ``zs`` are rows (scan_id, plane, z_um) of both.
    """
    keys = stack(first)
    last = zs[0].groupBy(*keys).agg(F.max_by("z_um", "plane").alias("z_last"), F.count("*").alias("n_first"), F.max("plane").alias("last_plane"))
    begin = zs[1].groupBy(*keys).agg(F.min_by("z_um", "plane").alias("z_begin"), F.count("*").alias("n_second"), F.min("plane").alias("begin_plane"))
    d = with_each(last, begin).withColumn("gap_um", F.col("z_begin") - F.col("z_last"))
    return d.select(*keys, "gap_um", ((F.col("z_last") + F.col("z_begin")) / 2).alias("z_um"), (F.col("n_first") + F.col("n_second")).alias("planes_in"), (F.col("n_first") + F.col("n_second") - 1).alias("planes_out"), "last_plane", "begin_plane", (F.abs("gap_um") <= tolerance_um).alias("overlaps"))


def merge_adjacent(first: DataFrame, second: DataFrame, zs: tuple[DataFrame, DataFrame], shifts: DataFrame | None = None, tolerance_um: float = 1e-6, most: float = float("inf")) -> DataFrame:
    """scan_id, plane, z_um, y, x, v, source_role of two stacks merged around one shared plane, the second one moved first.

    ``shifts`` has dy, dx a stack, from the registration of the boundary planes (see register.boundary_shift); none means no move.
    Numbers of the shared plane are averaged, and its z is the mean of both. A gap above the tolerance, a shift longer
    than ``most``, or a plane without a z is an error.
    """
    keys = stack(first)
    at = boundary(first, second, zs, tolerance_um)
    at = with_each(at, shifts.select(*keys, "dy", "dx")) if shifts is not None else at.withColumns({"dy": F.lit(0.0), "dx": F.lit(0.0)})
    wrong = F.when(~F.col("overlaps"), F.raise_error(F.concat(F.lit("boundary planes do not overlap: gap "), F.col("gap_um"))).cast("long")).when(F.hypot("dy", "dx") > most, F.raise_error(F.concat(F.lit("boundary shift is too long: "), F.hypot("dy", "dx"))).cast("long"))
    # the checks are part of a value that every row needs
    at = keep(at.withColumn("offset_", F.coalesce(wrong, F.col("last_plane") - F.col("begin_plane"))).select(*keys, F.col("z_um").alias("z_shared"), "offset_", "last_plane", "dy", "dx"))

    def side(vol: DataFrame, z: DataFrame, offset: Column, role: str) -> DataFrame:
        known = F.when(F.col("z_um").isNull(), F.raise_error(F.concat(F.lit("a plane has no z: "), F.col("plane"))).cast("long")).otherwise(F.col("plane"))
        d = with_each(vol.join(z.select(*keys, "plane", "z_um"), [*keys, "plane"], "left"), at)
        return d.select(*keys, (known + offset).alias("plane"), "y", "x", "v", "z_um", "z_shared", "last_plane", F.lit(role).alias("role_"))

    moving = with_each(second, at.select(*keys, "dy", "dx"))
    a, b = side(first, zs[0], F.col("offset_") * 0, "first"), side(move(moving, F.col("dy"), F.col("dx")), zs[1], F.col("offset_"), "second")
    shared = F.col("plane") == F.col("last_plane")
    both = a.unionByName(b).groupBy(*keys, "plane", "y", "x").agg(F.first(F.when(shared, F.col("z_shared")).otherwise(F.col("z_um"))).alias("z_um"), stats.nan_avg(F.col("v")).alias("v"), F.first(F.when(shared, "overlap").otherwise(F.col("role_"))).alias("source_role"))
    return both.select(*keys, "plane", "z_um", "y", "x", "v", "source_role")


def slice_stats(vol: DataFrame) -> DataFrame:
    """A row a plane; of a merged volume with the role of its source."""
    v = stats.skip_nan(F.col("v"))
    p = lambda x: stats.percentile(v, x)
    role = [F.first("source_role").alias("source_role")] if "source_role" in vol.columns else []
    return vol.groupBy(*stack(vol), "plane").agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), p(0.01).alias("p01"), p(0.5).alias("p50"), p(0.99).alias("p99"), F.avg(stats.finite(F.col("v")).cast("double")).alias("finite"), *role)


def cumulative_drift(steps: DataFrame, k: float = 3.0, most: float = 10.0) -> DataFrame:
    """Adds ``reliable`` (finite correlation at or above the stack's robust bound, magnitude within ``most``) and running sums of the reliable steps."""
    keys = stack(steps)
    bound = stats.robust_bounds(steps, keys, "corr", k).select(*keys, "lower")
    s = with_each(steps, bound)
    s = s.withColumn("reliable", stats.finite(F.col("corr")) & (F.col("corr") >= F.col("lower")) & (F.hypot("dy", "dx") <= most)).drop("lower")
    w = Window.partitionBy(*keys).orderBy("plane").rowsBetween(Window.unboundedPreceding, 0)
    run = lambda c: F.sum(F.when(F.col("reliable"), F.col(c)).otherwise(0.0)).over(w)
    return s.withColumns({"cum_dy": run("dy"), "cum_dx": run("dx")})


def crop_box(vol: DataFrame, threshold: float, pad: int) -> DataFrame:
    """Pixels of the padded bounding box of what is above a threshold; values outside that support are NaN."""
    up = vol.where(F.col("v") > threshold)
    box = up.groupBy(*stack(vol)).agg(*(f(c).alias(f"{n}_{c}") for c in ("y", "x") for n, f in (("lo", F.min), ("hi", F.max))))
    inside = F.col("y").between(F.col("lo_y") - pad, F.col("hi_y") + pad) & F.col("x").between(F.col("lo_x") - pad, F.col("hi_x") + pad)
    return with_each(vol, box).where(inside).select(*stack(vol), "plane", "y", "x", F.when(F.col("v") > threshold, F.col("v")).otherwise(stats.nan()).alias("v"))


def cuboid_edges(vol: DataFrame, t: int) -> DataFrame:
    """Voxels within t of the twelve edges: at least two of three coordinates within t of a face."""
    top = vol.groupBy(*stack(vol)).agg(*(F.max(c).alias(f"top_{c}") for c in ("plane", "y", "x")))
    near = sum(((F.col(c) < t) | (F.col(c) > F.col(f"top_{c}") - t)).cast("int") for c in ("plane", "y", "x"))
    return with_each(vol, top).where(near >= 2).select(*stack(vol), "plane", "y", "x")


def move(vol: DataFrame, dy: Column, dx: Column, nearest: bool = False, order: int = 1) -> DataFrame:
    """Planes moved by (dy, dx), which may be columns of the plane, with splines of an ``order`` (1: linear); NaN where the source is outside, or,
    with ``nearest``, the pixel at the border. Planes are whole."""
    d = vol.select(*stack(vol), *AXES, "v", dy.alias("dy_"), dx.alias("dx_"))
    axes = (chunks.Same(), chunks.Shifted(order, "dy_", nearest), chunks.Shifted(order, "dx_", nearest))
    return chunks.separable(d, axes, ("dy_", "dx_"), sides=(1, *chunks.chunk_for(axes)[1:]))


def bilinear_shift(vol: DataFrame, dy: float, dx: float) -> DataFrame:
    """Every plane moved by (dy, dx) with linear interpolation; NaN where the source is outside."""
    return move(vol, F.lit(dy), F.lit(dx))


def move3(vol: DataFrame, shifts: DataFrame, order: int = 1) -> DataFrame:
    """Volumes moved by the (dz, dy, dx) of their stack, with splines of an ``order``; NaN where the source is outside."""
    tops = vol.groupBy(*stack(vol)).agg(*(F.max(c).alias(f"top_{c}") for c in AXES))
    tops = with_each(tops, shifts.select(*stack(vol), "dz", "dy", "dx"))
    return chunks.separable(vol, tuple(chunks.Shifted(order, c) for c in ("dz", "dy", "dx")), tops=tops)


def apply_drift(vol: DataFrame, drift: DataFrame) -> DataFrame:
    """The planes moved by their cumulative drift (plane, cum_dy, cum_dx), borders repeated; planes without one stay, as the first does."""
    keys = [*stack(vol), "plane"]
    d = vol.join(drift.select(*keys, "cum_dy", "cum_dx"), keys, "left")
    return move(d, F.coalesce("cum_dy", F.lit(0.0)), F.coalesce("cum_dx", F.lit(0.0)), nearest=True)


def resample(vol: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Trilinear resampling to a shape; first and last samples stay at the ends."""
    return chunks.separable(vol, tuple(chunks.Scaled(1, n) for n in shape), every=True)


def gaussian(vol: DataFrame, sigma: float | tuple[float, float, float], radius: int | None = None) -> DataFrame:
    """Separable Gaussian; edges repeat their outermost value. Sigmas are in voxels along plane, y, x; kernels end after four of them, or after ``radius``."""
    sigmas = (sigma,) * 3 if isinstance(sigma, int | float) else sigma
    return chunks.separable(vol, tuple(chunks.blur(s, radius) for s in sigmas))


def voxels_of(sizes_um: tuple[float, float, float], spacing_um: tuple[float, float, float]) -> tuple[float, float, float]:
    """Sizes in µm as (fractions of) voxels along plane, y, x."""
    return tuple(s / d for s, d in zip(sizes_um, spacing_um, strict=True))


def half_widths(sizes_um: tuple[float, float, float], spacing_um: tuple[float, float, float]) -> tuple[int, int, int]:
    """Half widths in whole voxels, half-even, at least one."""
    return tuple(max(1, round(v)) for v in voxels_of(sizes_um, spacing_um))


def footprint(distance_um: float, spacing_um: tuple[float, float, float]) -> list[tuple[int, int, int]]:
    """Offsets (plane, y, x) within an ellipsoid of a radius in µm, without the centre."""
    from itertools import product
    from math import ceil

    r = [max(1, ceil(distance_um / s)) for s in spacing_um]
    inside = lambda o: sum((i * s / distance_um) ** 2 for i, s in zip(o, spacing_um, strict=True)) <= 1.0
    return [o for o in product(*(range(-k, k + 1) for k in r)) if any(o) and inside(o)]


def band_passed(vol: DataFrame, feature: tuple[float, float, float], background: tuple[float, float, float]) -> DataFrame:
    """Adds to each voxel of a volume, NaN filled by the stack's median, its smoothed difference from the smoothed background, ``f``."""
    keys = stack(vol)
    fill = stats.quantiles(vol, keys, "v", {"fill_": 0.5})
    filled = with_each(vol, fill).select(*keys, *AXES, F.coalesce(stats.skip_nan(F.col("v")), "fill_").alias("v"))
    return chunks.band_pass(filled, feature, background).withColumn("f", F.round("f", 9))


def peaks(f: DataFrame, percentile: float, most: int, offsets: list[tuple[int, int, int]], border: tuple[int, int, int]) -> DataFrame:
    """The ``most`` strongest local maxima of each stack among voxels (plane, y, x, v, f), with ``rank_``: at or above the percentile of f, not beaten by a voxel at any of
    the offsets (of equal ones the first counts), and further than the border from every face."""
    keys = stack(f)
    bound = stats.quantiles(f, keys, "f", {"bound": percentile})
    top = f.groupBy(*keys).agg(*(F.max(c).alias(f"top_{c}") for c in AXES))
    inside = F.col("f") >= F.col("bound")
    for c, b in zip(AXES, border, strict=True):
        inside = inside & F.col(c).between(b, F.col(f"top_{c}") - b)
    rank = Window.partitionBy(*keys).orderBy(F.desc("f"), *AXES)
    return with_each(chunks.maxima(f, offsets), with_each(bound, top)).where(inside).withColumn("rank_", F.row_number().over(rank)).where(F.col("rank_") <= most)


def candidates(
    vol: DataFrame, percentile: float, most: int, spacing_um: tuple[float, float, float] = (1.0, 1.0, 1.0), feature_um: tuple[float, float, float] = (0.8,) * 3, background_um: tuple[float, float, float] = (2.0,) * 3,
    distance_um: float = 1.0, border_um: tuple[float, float, float] = (1.0, 1.0, 1.0), z_um: DataFrame | None = None,
) -> DataFrame:
    """Bright local maxima of a band-passed volume, the strongest first, ``most`` a stack; ties go to the lowest (plane, y, x).

    A maximum is at or above the percentile of the feature, larger than every voxel in an ellipsoid around it (of equal
    ones the first counts), and further than the border from every face. ``z_um`` has rows (scan_id, plane, z_scanimage_um); without it, Z counts from 0.
    """
    from math import ceil

    keys = stack(vol)
    f = keep(band_passed(vol, voxels_of(feature_um, spacing_um), voxels_of(background_um, spacing_um)))
    best = peaks(f, percentile, most, footprint(distance_um, spacing_um), tuple(ceil(b / s) for b, s in zip(border_um, spacing_um, strict=True)))
    z = best.join(z_um.select(*keys, "plane", "z_scanimage_um"), [*keys, "plane"], "left") if z_um is not None else best.withColumn("z_scanimage_um", F.col("plane") * F.lit(float(spacing_um[0])))
    at = [(F.col(c) * F.lit(float(s))).alias(n) for c, s, n in zip(AXES, spacing_um, ("z_relative_um", "y_um", "x_um"), strict=True)]
    return z.select(*keys, F.format_string("candidate_%02d", "rank_").alias("candidate_id"), *AXES, *at, "z_scanimage_um", F.col("f").alias("feature_score"), F.col("v").alias("source_intensity"))


def candidate_bounds(found: DataFrame, shape: tuple[int, int, int], half_um: tuple[float, float, float], spacing_um: tuple[float, float, float]) -> DataFrame:
    """Adds lo_* and hi_* (exclusive) of a box of half widths in µm around each candidate, clamped to the volume."""
    out = found
    for c, h, n in zip(AXES, half_widths(half_um, spacing_um), shape, strict=True):
        out = out.withColumns({f"lo_{c}": F.greatest(F.col(c) - h, F.lit(0)), f"hi_{c}": F.least(F.col(c) + h + 1, F.lit(n))})
    return out
