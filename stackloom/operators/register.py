"""Rigid registration by phase correlation, in Arrow batches of frames; gates, ranks and sums stay in SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackloom.functions import stats
from stackloom.operators import recon, volume
from stackloom.operators.recon import FRAME, PLANE
from stackloom.runtime import keep

#: How images are prepared: blur and border in pixels, scaling by the MAD, and a Hann window.
CONDITION = {"sigma": 1.0, "border": 32, "scale": True, "window": True}
#: Frames of a plane that one task registers.
BLOCK = 64
# Names of the reasons to reject a registered frame.
SHIFT, CORRELATION, ERROR, GAIN = "shift_exceeds_max", "post_correlation_low", "registration_error_high", "correlation_gain_low"


def phase_shift(reference: np.ndarray, moving: np.ndarray, upsample: int = 10) -> tuple[np.ndarray, float]:
    """The shift that moves ``moving`` onto ``reference``, to 1/upsample, for any number of axes, and the remaining error.

    The peak of the cross-correlation is found on the pixel grid, then on a fine grid around it by a matrix Fourier
    transform (Guizar-Sicairos et al., 2008).
    """
    a, b = np.fft.fftn(reference), np.fft.fftn(moving)
    cross = a * b.conj()
    peak = np.abs(np.fft.ifftn(cross))
    shape = np.array(reference.shape)
    shift = np.array(np.unravel_index(peak.argmax(), peak.shape), float)
    shift[shift > shape // 2] -= shape[shift > shape // 2]
    best = peak.max() * 1.0
    if upsample > 1:
        span = np.arange(-np.ceil(0.75 * upsample), np.ceil(0.75 * upsample) + 1) / upsample
        fine = cross / cross.size
        for axis, n in enumerate(reference.shape):
            at = shift[axis] + span
            kernel = np.exp(2j * np.pi * np.outer(at, np.fft.fftfreq(n)))
            fine = np.moveaxis(np.tensordot(kernel, fine, (1, axis)), 0, axis)
        spot = np.unravel_index(np.abs(fine).argmax(), fine.shape)
        best = float(np.abs(fine).max())
        shift = shift + span[list(spot)]
    power = np.sqrt((np.abs(a) ** 2).sum() * (np.abs(b) ** 2).sum()) / cross.size
    return shift, float(np.sqrt(max(0.0, 1 - (best / power) ** 2))) if power > 0 else float("nan")


def blurred(image: np.ndarray, sigma: float) -> np.ndarray:
    """A Gaussian along each axis, ended after four sigmas; borders are repeated."""
    r = int(4 * sigma + 0.5)
    if sigma <= 0 or r == 0:
        return image
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    for axis in range(image.ndim):
        p = np.pad(image, [(r, r) if a == axis else (0, 0) for a in range(image.ndim)], mode="edge")
        image = sum(k * np.take(p, range(i, i + image.shape[axis]), axis) for i, k in enumerate(w / w.sum()))
    return image


def conditioned(image: np.ndarray, sigma: float = 0.0, border: int = 0, scale: bool = True, window: bool = True) -> np.ndarray:
    """Blurred, cropped by a border, freed of its median and scaled by the MAD (an image whose MAD is 0 keeps its scale), under a Hann window."""
    image = np.where(np.isfinite(image), image, np.nanmedian(np.where(np.isfinite(image), image, np.nan))) if np.isfinite(image).any() else np.zeros(image.shape)
    image = blurred(image, sigma)
    if border:
        if min(image.shape) <= 2 * border + 8:
            raise ValueError(f"a border of {border} leaves too little of an image of {image.shape}")
        image = image[tuple(slice(border, n - border) for n in image.shape)]
    if scale:
        image = image - np.median(image)
        mad = np.median(np.abs(image))
        image = image / (stats.MAD_SCALE * mad) if mad > 0 else image
    if window:
        for axis, n in enumerate(image.shape):
            image = image * np.hanning(n).reshape([-1 if a == axis else 1 for a in range(image.ndim)])
    return image


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    ok = np.isfinite(a) & np.isfinite(b)
    if ok.sum() < 2:
        return float("nan")
    x, y = a[ok] - a[ok].mean(), b[ok] - b[ok].mean()
    d = np.sqrt((x * x).sum() * (y * y).sum())
    return float((x * y).sum() / d) if d > 0 else float("nan")


def moved(image: np.ndarray, dy: float, dx: float) -> np.ndarray:
    """Linear interpolation; NaN where the source is outside."""
    out = np.full(image.shape, np.nan)
    yy, xx = np.indices(image.shape)
    sy, sx = yy - dy, xx - dx
    ok = (sy >= 0) & (sx >= 0) & (sy <= image.shape[0] - 1) & (sx <= image.shape[1] - 1)
    y0, x0 = np.minimum(np.floor(sy[ok]).astype(int), max(0, image.shape[0] - 2)), np.minimum(np.floor(sx[ok]).astype(int), max(0, image.shape[1] - 2))
    y1, x1 = np.minimum(y0 + 1, image.shape[0] - 1), np.minimum(x0 + 1, image.shape[1] - 1)
    fy, fx = sy[ok] - y0, sx[ok] - x0
    out[ok] = image[y0, x0] * (1 - fy) * (1 - fx) + image[y1, x0] * fy * (1 - fx) + image[y0, x1] * (1 - fy) * fx + image[y1, x1] * fy * fx
    return out


def _per_frame(rows: DataFrame, f: Callable[[dict, np.ndarray], tuple], names: list[str], schema: str) -> DataFrame:
    """A row for each row, with FRAME and what ``f`` makes of it and its image (and ``reference``, an image too)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = {n: b.column(k) for k, n in enumerate(b.schema.names)}
            out = []
            for i in range(b.num_rows):
                width = at["width"][i].as_py()
                image = lambda c: np.asarray(at[c][i].values.to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)  # noqa: B023, E731
                out.append(f({n: image(n) if n in ("pixels", "reference") else at[n][i].as_py() for n in at if n not in FRAME}))
            cols = list(zip(*out, strict=True)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([*(at[n] for n in FRAME), *(recon.lists(list(c)) if n == "pixels" else pa.array(c, pa.int32() if n == "width" else pa.float64()) for n, c in zip(names, cols, strict=True))], [*FRAME, *names])

    return rows.mapInArrow(run, "scan_id string, plane long, local_index long, " + schema)


def with_reference(frames: DataFrame, images: DataFrame) -> DataFrame:
    """Frames with the image of their plane as ``reference``. The frames of a plane are dealt over tasks in blocks, each with a copy of the image."""
    block = F.floor(F.col("local_index") / BLOCK).alias("block_")
    refs = images.select(*PLANE, F.col("pixels").alias("reference")).join(frames.select(*PLANE, block).distinct(), PLANE)
    # sizes of images that a reader made are guessed, so no side may be broadcast on a guess
    return frames.select(*FRAME, "width", "pixels", block).hint("merge").join(refs, [*PLANE, "block_"]).drop("block_")


def estimate(frames: DataFrame, images: DataFrame, upsample: int = 10, condition: dict | None = None) -> DataFrame:
    """scan_id, plane, local_index, dy, dx, error, corr (unmoved) of every frame against the image of its plane."""

    def one(r: dict) -> tuple:
        a, b = (r["reference"], r["pixels"]) if condition is None else (conditioned(r["reference"], **condition), conditioned(r["pixels"], **condition))
        (dy, dx), e = phase_shift(a, b, upsample)
        return float(dy), float(dx), e, correlation(r["reference"], r["pixels"])

    return _per_frame(with_reference(frames, images), one, ["dy", "dx", "error", "corr"], "dy double, dx double, error double, corr double")


def registered(frames: DataFrame, shifts: DataFrame) -> DataFrame:
    """The frames moved by their shifts."""
    rows = frames.select(*FRAME, "width", "pixels").hint("merge").join(shifts.select(*FRAME, "dy", "dx"), FRAME)
    return _per_frame(rows, lambda r: (r["width"], moved(r["pixels"], r["dy"], r["dx"]).ravel()), ["width", "pixels"], "width int, pixels array<double>")


def frame_shifts(frames: DataFrame, upsample: int = 10, condition: dict | None = CONDITION, updates: int = 1) -> DataFrame:
    """dy, dx, error, corr_before, corr_after of every frame.

    The first reference of a plane is its median; after each of ``updates`` rounds it is the mean of the frames moved so
    far. corr_before is with the median, corr_after that of the moved frame with the last mean. ``condition`` says how images are prepared; None: not at all.
    """
    s = keep(estimate(frames, keep(recon.median_images(frames)), upsample, condition))
    before = s.select(*FRAME, F.col("corr").alias("corr_before"))
    mean = keep(recon.mean_images(registered(frames, s)))
    for _ in range(updates):
        s = keep(estimate(frames, mean, upsample, condition))
        mean = keep(recon.mean_images(registered(frames, s)))
    after = _per_frame(with_reference(registered(frames, s), mean), lambda r: (correlation(r["reference"], r["pixels"]),), ["corr_after"], "corr_after double")
    return keep(s.drop("corr").join(before, FRAME).join(after, FRAME))


def registration_keep(shifts: DataFrame, most: float = 8.0, corr_k: float = 3.0, error_k: float = 4.0, gain: float = -0.02, least: float = 0.3, least_corr: float | None = None, most_error: float | None = None) -> DataFrame:
    """Adds the shift's ``magnitude``, the correlation ``gain``, the bounds, ``keep``, ``relaxed`` and ``reasons``.

    Bounds come from the frames whose shift is valid, unless ``least_corr`` or ``most_error`` fix them. A frame of undefined
    correlation or error is never kept; if fewer than max(1, ceil(n * least)) pass, the best of the valid ones of defined
    correlation are kept instead, up to that many (``relaxed``). Reasons are named for every frame they hold for, kept or not;
    undefined values give none.
    """
    ok = stats.finite
    s = shifts.withColumns({"magnitude": F.hypot("dy", "dx"), "gain": F.col("corr_after") - F.col("corr_before")}).withColumn("valid", ok(F.col("magnitude")) & (F.col("magnitude") <= most))
    # robust_bounds of no valid frame accept nothing
    low = stats.robust_bounds(s.withColumn("c_", F.when(F.col("valid"), F.col("corr_after"))), PLANE, "c_", corr_k).select(*PLANE, F.col("lower").alias("corr_bound"))
    high = stats.robust_bounds(s.withColumn("e_", F.when(F.col("valid"), F.col("error"))), PLANE, "e_", error_k).select(*PLANE, F.col("upper").alias("error_bound"))
    s = s.join(low, PLANE).join(high, PLANE)
    if least_corr is not None:
        s = s.withColumn("corr_bound", F.lit(float(least_corr)))
    if most_error is not None:
        s = s.withColumn("error_bound", F.lit(float(most_error)))
    good = F.col("valid") & ok(F.col("corr_after")) & (F.col("corr_after") >= F.col("corr_bound")) & ok(F.col("error")) & (F.col("error") <= F.col("error_bound")) & ok(F.col("gain")) & (F.col("gain") >= gain)
    every = Window.partitionBy(*PLANE)
    may = F.col("valid") & ok(F.col("corr_after"))
    s = s.withColumns({"ok": good, "may": may}).withColumn("rank", F.row_number().over(every.orderBy(F.desc("may"), *recon.ranked("corr_after"))))
    need = F.greatest(F.lit(1), F.ceil(F.count("*").over(every) * F.lit(least)))
    s = s.withColumn("relaxed", F.sum(F.col("ok").cast("long")).over(every) < need).withColumn("keep", F.when(F.col("relaxed"), F.col("may") & (F.col("rank") <= need)).otherwise(F.col("ok")))
    why = F.concat_ws(";", F.when(ok(F.col("magnitude")) & (F.col("magnitude") > most), SHIFT), F.when(ok(F.col("corr_after")) & (F.col("corr_after") < F.col("corr_bound")), CORRELATION), F.when(ok(F.col("error")) & (F.col("error") > F.col("error_bound")), ERROR), F.when(ok(F.col("gain")) & (F.col("gain") < gain), GAIN))
    return s.withColumn("reasons", why).drop("ok", "may", "rank")


def in_um(shifts: DataFrame, pixel_y_um: float, pixel_x_um: float) -> DataFrame:
    """Adds the shift and its magnitude in µm."""
    return shifts.withColumns({"dy_um": F.col("dy") * pixel_y_um, "dx_um": F.col("dx") * pixel_x_um, "magnitude_um": F.hypot(F.col("dy") * pixel_y_um, F.col("dx") * pixel_x_um)})


def plane_status(kept: DataFrame) -> DataFrame:
    """scan_id, plane, frames, kept, status: ``nothing_kept`` where the rule leaves no frame of a plane, so that it has no D."""
    n = kept.groupBy(*PLANE).agg(F.count("*").alias("frames"), F.count_if("keep").alias("kept"))
    return n.withColumn("status", F.when(F.col("kept") == 0, "nothing_kept").otherwise("pass"))


def plane_methods(frames: DataFrame, kept: DataFrame, legacy: DataFrame) -> DataFrame:
    """scan_id, plane, method, y, x, v: A mean, B mean of the frames that ``legacy`` keeps, C mean of the moved frames, D of those of them that ``kept`` keeps.

    ``legacy`` is of recon.kept_frames() and ``kept`` of registration_keep(). A plane of which nothing is kept has no D; plane_status() and plane_summary() say so.
    """
    shifted = registered(frames, kept)
    only = lambda d, k: d.join(k.where("keep").select(*FRAME), FRAME, "left_semi")
    made = {"A": frames, "B": only(frames, legacy), "C": shifted, "D": only(shifted, kept)}
    out = None
    for name, f in made.items():
        v = recon.mean_volume(f).withColumn("method", F.lit(name))
        out = v if out is None else out.unionByName(v)
    return out.select(*PLANE, "method", "y", "x", "v")


def plane_summary(kept: DataFrame, legacy: DataFrame, methods: DataFrame, pixel_um: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """A row a plane: frames kept by both filters, bounds, shifts, correlations, errors, longest rejected runs, and the sharpness of each method."""
    k = in_um(kept, *pixel_um)
    p = stats.percentile
    rows = k.groupBy(*PLANE).agg(
        F.count("*").alias("frames"), F.count_if("keep").alias("kept"), F.when(F.count_if("keep") == 0, "nothing_kept").otherwise("pass").alias("status"), F.avg(F.col("keep").cast("double")).alias("kept_share"), F.bool_or("relaxed").alias("relaxed"), F.first("corr_bound").alias("corr_bound"), F.first("error_bound").alias("error_bound"),
        F.median("magnitude").alias("shift_p50"), p("magnitude", 0.95).alias("shift_p95"), F.max("magnitude").alias("shift_max"), p("magnitude_um", 0.95).alias("shift_um_p95"),
        F.avg("corr_before").alias("corr_before"), F.avg("corr_after").alias("corr_after"), F.avg("gain").alias("gain"), F.avg("error").alias("error_mean"), p("error", 0.95).alias("error_p95"),
    )
    old = legacy.groupBy(*PLANE).agg(F.count_if("keep").alias("legacy_kept"), F.avg(F.col("keep").cast("double")).alias("legacy_kept_share"), F.first("threshold").alias("legacy_bound"))
    out = rows.join(old, PLANE)
    for name, d in (("longest_rejected", kept), ("legacy_longest_rejected", legacy)):
        run = stats.longest_run(d.select(*FRAME, (~F.col("keep")).alias("off_")), PLANE, ["local_index"], "off_")
        out = out.join(run.withColumnRenamed("longest_run", name), PLANE)
    sharp = stats.tenengrad(methods, [*PLANE, "method"], "y", "x", "v", pixel_um).groupBy(*PLANE).pivot("method", list("ABCD")).agg(F.first("tenengrad"))
    return out.join(sharp.select(*PLANE, *(F.col(m).alias(f"sharpness_{m}") for m in "ABCD")), PLANE)


def stack_pass(frames: DataFrame, spacing_um: tuple[float, float, float] = (1.0, 1.0, 1.0), upsample: int = 10, condition: dict | None = CONDITION, updates: int = 1, most_lag: int = 10, positions: tuple[float, ...] = (0, 0.25, 0.5, 0.75, 1), rails: tuple[int, int] = (-32768, 32767), **rule: float) -> dict[str, DataFrame]:
    """All of a comparison of the four methods, stack by stack: ``frames`` with shifts, both filters' decisions and reasons, ``methods`` (volumes), ``planes``
    (plane_summary, with high raw intensities), ``volumes`` (volume_metrics of each method), ``decay`` (correlation by lag), ``representative`` (a raw frame), and
    ``histogram`` and ``saturation`` of the intensities of frames at ``positions`` of each plane."""
    from stackloom.operators import saturation

    counts = keep(saturation.histogram(saturation.sampled(frames, positions)))
    kept = keep(registration_keep(frame_shifts(frames, upsample, condition, updates), **rule))
    legacy = keep(recon.kept_frames(recon.frame_statistics(frames)))
    methods = keep(plane_methods(frames, kept, legacy))
    one = {m: methods.where(F.col("method") == m).drop("method") for m in "ABCD"}
    decay = None
    for m, v in one.items():
        d = volume.z_decay(v, spacing_um[0], most_lag).withColumn("method", F.lit(m))
        decay = d if decay is None else decay.unionByName(d)
    return {
        "frames": in_um(kept, *spacing_um[1:]).join(legacy.select(*FRAME, F.col("keep").alias("legacy_keep")), FRAME), "methods": methods, "planes": plane_summary(kept, legacy, methods, spacing_um[1:]).join(saturation.plane_levels(frames), PLANE),
        "volumes": volume.volume_metrics(one, spacing_um), "decay": decay, "representative": recon.representative(frames), "histogram": counts, "saturation": saturation.summary(counts, *rails),
    }


def plane_images(vol: DataFrame) -> DataFrame:
    """scan_id (if there), plane, width, pixels of a volume whose planes are whole."""
    keys = [*volume.stack(vol), "plane"]
    return vol.groupBy(*keys).agg((F.max("x") + 1).cast("int").alias("width"), F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "v"))), lambda s: s["v"]).alias("pixels"))


def drift_within(frames: DataFrame, n: int = 5, upsample: int = 10) -> DataFrame:
    """The shift of the mean of each plane's last n frames to that of its first n, with its error and correlations."""
    v = recon.early_late(frames, n)
    image = lambda c: plane_images(v.withColumnRenamed(c, "v")).withColumn("local_index", F.lit(0).cast("long"))
    s = estimate(image("late"), image("early"), upsample)
    after = _per_frame(with_reference(registered(image("late"), s), image("early")), lambda r: (correlation(r["reference"], r["pixels"]),), ["corr_after"], "corr_after double")
    return s.join(after, FRAME).select(*PLANE, "dy", "dx", F.hypot("dy", "dx").alias("magnitude"), "error", F.col("corr").alias("corr_before"), "corr_after")


def cross_plane(vol: DataFrame, k: float = 3.0, most: float = 10.0, upsample: int = 10) -> DataFrame:
    """scan_id, plane, dy, dx, error, corr, reliable, cum_dy, cum_dx: steps between raw neighbouring planes (corr is theirs, unmoved), gated and summed to drifts."""
    images = plane_images(vol).withColumn("local_index", F.lit(0).cast("long"))
    before = images.withColumn("plane", F.col("plane") + 1)
    return volume.cumulative_drift(estimate(images, before, upsample).drop("local_index"), k, most)


def corrected(vol: DataFrame, k: float = 3.0, most: float = 10.0, upsample: int = 10) -> DataFrame:
    """The volume with the drift that cross_plane() finds applied to each plane."""
    return volume.apply_drift(vol, keep(cross_plane(vol, k, most, upsample)))


def boundary_shift(first: DataFrame, second: DataFrame, upsample: int = 10) -> DataFrame:
    """A row a stack: dy, dx, error, corr_before, corr_after of the second stack's first plane against the last plane of the first."""
    edge = lambda d, f: volume.with_each(d, d.groupBy(*volume.stack(d)).agg(f("plane").alias("edge_"))).where("plane = edge_").drop("edge_").withColumn("plane", F.lit(0).cast("long"))
    image = lambda d: plane_images(d).withColumn("local_index", F.lit(0).cast("long"))
    a, b = image(edge(first, F.max)), image(edge(second, F.min))
    s = estimate(b, a, upsample)
    after = _per_frame(with_reference(registered(b, s), a), lambda r: (correlation(r["reference"], r["pixels"]),), ["corr_after"], "corr_after double")
    return s.join(after, FRAME).select("scan_id", "dy", "dx", "error", F.col("corr").alias("corr_before"), "corr_after")
