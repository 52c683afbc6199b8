"""Reconstruction of planes from repeated frames, and their quality control, for any number of stacks at once.

Frames are rows (scan_id, plane, local_index, width, pixels), pixels being an array row by row. Images are cut into tiles
before anything is shuffled; a task reduces the frames of one tile of one plane in NumPy, so no row is a pixel of a
frame. Volumes are rows (scan_id, plane, y, x, v).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackloom.functions import stats
from stackloom.operators.stacks import only

PLANE = ["scan_id", "plane"]
FRAME = [*PLANE, "local_index"]
PIXEL = [*PLANE, "y", "x"]
#: Most pixels of a tile, and pixels of all frames of a tile that a task should hold.
TILE, HELD = 4096, 1 << 23
#: Planes whose sums a task holds before it passes them on.
OPEN = 64


def tile_size(frames: DataFrame) -> int:
    """Pixels of a tile: fewer where a plane has many frames. Reads no pixels."""
    most = frames.groupBy(*PLANE).count().agg(F.max("count")).first()[0] or 1
    return max(1, min(TILE, HELD // most))


def tiles(frames: DataFrame, size: int) -> DataFrame:
    """Rows (scan_id, plane, tile, local_index, width, base, part): ``part`` are the pixels of a tile, ``base`` the frame's first one."""
    n = F.greatest(F.ceil(F.size("pixels") / size), F.lit(1)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice("pixels", i * size + 1, F.lit(size)))
    return frames.select(*FRAME, "width", F.get("pixels", F.lit(0)).alias("base"), F.posexplode(parts).alias("tile", "part"))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of equally long arrays as the rows of a matrix."""
    return np.stack([np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64) for c in column.chunks for x in c]) if len(column) else np.zeros((0, 0))


def lists(rows: list[np.ndarray], before: int = 0) -> pa.ListArray:
    """A column of ``before`` nulls and then the rows, from their buffers."""
    ends = np.cumsum([0, *(len(r) for r in rows)])
    offsets = pa.array([*([None] * before), *ends.tolist()], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(rows) if rows else np.zeros(0)))


_MOMENTS = ("n", "sa", "sb", "saa", "sbb", "sab", "total", "pixels_n")


def reduced(frames: DataFrame, stride: int = 1) -> DataFrame:
    """What each tile gives, in one shuffle: a row with its median image (local_index null), and one a frame with its sums.

    Sums are of products with the median on every stride-th pixel, both sides less a constant near their values, which
    keeps digits where the mean is large.
    """
    size = tile_size(frames)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        scan, plane, tile = (k.as_py() for k in key)
        t = t.sort_by("local_index")
        images = matrix(t["part"])
        middle = np.median(images, 0)
        base = np.nan_to_num(t["base"].to_numpy().astype(np.float64), nan=0.0, posinf=0.0, neginf=0.0)
        y, x = np.divmod(tile * size + np.arange(images.shape[1]), t["width"][0].as_py())
        on = (y % stride == 0) & (x % stride == 0)
        a, b = images[:, on] - base[:, None], np.broadcast_to(middle[on] - base[0], (len(images), int(on.sum())))
        ok = np.isfinite(a) & np.isfinite(b)
        a, b = np.where(ok, a, 0), np.where(ok, b, 0)
        sums = (ok.sum(1), a.sum(1), b.sum(1), (a * a).sum(1), (b * b).sum(1), (a * b).sum(1), images.sum(1), np.full(len(images), images.shape[1]))
        out = {n: np.append(np.asarray(s, np.float64), np.nan) for n, s in zip(_MOMENTS, sums, strict=True)}
        rows = len(images) + 1
        return pa.table({
            "scan_id": pa.array([scan] * rows, pa.string()), "plane": pa.array([plane] * rows, pa.int64()), "tile": pa.array([tile] * rows, pa.int32()), "width": pa.array([t["width"][0].as_py()] * rows, pa.int32()),
            "local_index": pa.array([*t["local_index"].to_pylist(), None], pa.int64()), **out, "part": lists([np.asarray(middle, np.float64)], rows - 1),
        })

    schema = "scan_id string, plane long, tile int, width int, local_index long, " + ", ".join(f"{m} double" for m in _MOMENTS) + ", part array<double>"
    return tiles(frames, size).groupBy(*PLANE, "tile").applyInArrow(run, schema).withColumn("first_", F.col("tile").cast("long") * size)


def pixels(parts: DataFrame) -> DataFrame:
    """A volume of rows (scan_id, plane, width, first_, part), where a part begins at pixel ``first_`` of its plane."""
    p = parts.select(*PLANE, "width", "first_", F.posexplode("part").alias("at", "v")).withColumn("at", F.col("first_") + F.col("at"))
    return p.select(*PLANE, F.floor(F.col("at") / F.col("width")).cast("long").alias("y"), (F.col("at") % F.col("width")).cast("long").alias("x"), "v")


def median_volume(frames: DataFrame) -> DataFrame:
    """Pixelwise median of all frames, exact; an even count gives the mean of the two in the middle."""
    return pixels(reduced(frames).where("local_index is null"))


def median_images(frames: DataFrame) -> DataFrame:
    """scan_id, plane, width, pixels: the median image of each plane, a row each."""
    parts = reduced(frames).where("local_index is null").groupBy(*PLANE).agg(F.first("width").alias("width"), F.array_sort(F.collect_list(F.struct("first_", "part"))).alias("p"))
    return parts.select(*PLANE, "width", F.flatten(F.transform("p", lambda x: x["part"])).alias("pixels"))


def mean_images(frames: DataFrame, discard: int = 0) -> DataFrame:
    """scan_id, plane, width, pixels: means of the finite values of each pixel, NaN where there is none, without the first ``discard`` frames.

    Each task adds up the planes it sees, so only sums are shuffled.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def out() -> pa.RecordBatch:
            scan, plane = zip(*held, strict=True)
            width, s, n = zip(*held.values(), strict=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(scan, pa.string()), pa.array(plane, pa.int64()), pa.array(width, pa.int32()), lists(list(s)), lists(list(n))], ["scan_id", "plane", "width", "s", "n"])

        for b in batches:
            for scan, plane, width, image in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                v = np.asarray(image.values.to_numpy(zero_copy_only=False), np.float64)
                ok = np.isfinite(v)
                if (scan, plane) in held:
                    h = held[scan, plane]
                    h[1] += np.where(ok, v, 0)
                    h[2] += ok
                else:
                    if len(held) == OPEN:
                        yield out()
                    held[scan, plane] = [width, np.where(ok, v, 0), ok.astype(np.int64)]
        if held:
            yield out()

    sums = frames.where(F.col("local_index") >= discard).select(*PLANE, "width", "pixels").mapInArrow(part, "scan_id string, plane long, width int, s array<double>, n array<long>")

    def total(key: tuple, t: pa.Table) -> pa.Table:
        s, n = matrix(t["s"]).sum(0), matrix(t["n"]).sum(0)
        mean = np.divide(s, n, out=np.full(len(s), np.nan), where=n > 0)
        return pa.table({"scan_id": pa.array([key[0].as_py()], pa.string()), "plane": pa.array([key[1].as_py()], pa.int64()), "width": pa.array([t["width"][0].as_py()], pa.int32()), "pixels": lists([mean])})

    return sums.groupBy(*PLANE).applyInArrow(total, "scan_id string, plane long, width int, pixels array<double>")


def mean_volume(frames: DataFrame, discard: int = 0) -> DataFrame:
    """The volume of mean_images()."""
    return pixels(mean_images(frames, discard).select("*", F.lit(0).alias("first_")).withColumnRenamed("pixels", "part"))


def _statistics(parts: DataFrame) -> DataFrame:
    s = parts.where("local_index is not null").groupBy(*FRAME).agg(*(F.sum(m).alias(m) for m in _MOMENTS))
    # what is left after the mean is taken away counts as no variance if it is rounding only
    spread = lambda q, m: F.when(F.col(q) - F.col(m) * F.col(m) / F.col("n") > 1e-13 * F.col(q), F.col(q) - F.col(m) * F.col(m) / F.col("n"))
    corr = (F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")) / F.sqrt(spread("saa", "sa") * spread("sbb", "sb"))
    return s.select(*FRAME, F.when(F.col("n") < 2, stats.nan()).otherwise(F.coalesce(corr, stats.nan())).alias("corr"), (F.col("total") / F.col("pixels_n")).alias("frame_mean"))


def frame_statistics(frames: DataFrame, stride: int = 1) -> DataFrame:
    """scan_id, plane, local_index, corr (with the plane's median, on every stride-th pixel) and frame_mean (of all pixels)."""
    return _statistics(reduced(frames, stride))


def flagged(frames: DataFrame, k: float) -> DataFrame:
    """Adds the plane's lower robust bound and whether a frame's finite correlation is below it; no frame is removed."""
    bound = stats.robust_bounds(frames, PLANE, "corr", k).select(*PLANE, F.col("lower").alias("threshold"))
    return frames.join(bound, PLANE).withColumn("low", stats.finite(F.col("corr")) & (F.col("corr") < F.col("threshold")))


def frame_qc(frames: DataFrame, k: float = 3.0, stride: int = 1) -> DataFrame:
    return flagged(frame_statistics(frames, stride), k)


def plane_qc(frames: DataFrame, k: float = 3.0, stride: int = 1) -> DataFrame:
    """A row for each plane: correlations, flags and their longest run, variation of frame means, and the median image."""
    parts = reduced(frames, stride)
    f = flagged(_statistics(parts), k)
    c = F.when(stats.finite(F.col("corr")), F.col("corr"))
    rows = f.groupBy(*PLANE).agg(
        F.count("*").alias("frames"),
        F.lit(0).cast("long").alias("frames_rejected"),
        F.coalesce(F.min(c), stats.nan()).alias("corr_min"),
        F.coalesce(stats.percentile(c, 0.05), stats.nan()).alias("corr_p05"),
        F.coalesce(F.median(c), stats.nan()).alias("corr_median"),
        F.coalesce(stats.percentile(c, 0.95), stats.nan()).alias("corr_p95"),
        F.first("threshold").alias("threshold"),
        F.count_if("low").alias("low_frames"),
        stats.cv("frame_mean").alias("frame_mean_cv"),
    )
    image = pixels(parts.where("local_index is null")).groupBy(*PLANE).agg(F.avg("v").alias("median_mean"), stats.percentile("v", 0.99).alias("median_p99"))
    return rows.join(stats.longest_run(f, PLANE, ["local_index"], "low"), PLANE).join(image, PLANE)


def ranked(value: str = "corr", order: str = "local_index") -> list[Column]:
    """Finite values first, the largest first; ties go to the later frame."""
    return [F.desc(F.when(stats.finite(F.col(value)), F.col(value)).otherwise(float("-inf"))), F.desc(order)]


def kept_frames(frames: DataFrame, k: float = 3.0, least: float = 0.3) -> DataFrame:
    """Adds ``threshold``, ``rank`` and ``keep``: finite correlation at or above the robust bound; if fewer than
    max(1, ceil(n * least)) pass, that many best ones instead, those of undefined correlation last."""
    bound = stats.robust_bounds(frames, PLANE, "corr", k).select(*PLANE, F.col("lower").alias("threshold"))
    every = Window.partitionBy(*PLANE)
    f = frames.join(bound, PLANE).withColumn("ok", stats.finite(F.col("corr")) & (F.col("corr") >= F.col("threshold"))).withColumn("rank", F.row_number().over(every.orderBy(*ranked())))
    need = F.greatest(F.lit(1), F.ceil(F.count("*").over(every) * F.lit(least)))
    return f.withColumn("keep", F.when(F.sum(F.col("ok").cast("long")).over(every) < need, F.col("rank") <= need).otherwise(F.col("ok"))).drop("ok")


def filtered_mean(frames: DataFrame, k: float = 3.0, least: float = 0.3) -> DataFrame:
    """Pixelwise mean of the frames that kept_frames() keeps."""
    kept = kept_frames(frame_statistics(frames), k, least).where("keep").select(*FRAME)
    return mean_volume(frames.join(kept, FRAME, "left_semi"))


def kept_summary(kept: DataFrame) -> DataFrame:
    """A row a plane: frames, kept, dropped, kept share, and the longest run of dropped ones."""
    run = stats.longest_run(kept.withColumn("dropped_", ~F.col("keep")), PLANE, ["local_index"], "dropped_").withColumnRenamed("longest_run", "longest_dropped")
    return kept.groupBy(*PLANE).agg(F.count("*").alias("frames"), F.count_if("keep").alias("kept"), F.count_if(~F.col("keep")).alias("dropped"), F.avg(F.col("keep").cast("double")).alias("kept_share")).join(run, PLANE)


def representative(frames: DataFrame, fraction: float = 0.5, discard: int = 0) -> DataFrame:
    """One raw frame a stack: of the plane at a fraction of the depth (half-even), the frame in the middle of those after the first ``discard``."""
    n = frames.groupBy(*PLANE).agg((F.max("local_index") - discard + 1).alias("n_"))
    at = n.groupBy("scan_id").agg(F.max("plane").alias("top_"))
    at = n.join(at, "scan_id").where(F.col("plane") == F.rint(F.lit(fraction) * F.col("top_")).cast("long"))
    return only(frames, at.select(*PLANE, (F.floor(F.col("n_") / 2).cast("long") + discard).alias("local_index")), FRAME)


def early_late(frames: DataFrame, n: int = 5) -> DataFrame:
    """Pixelwise means of the first and of the last n frames of each plane."""
    last = frames.groupBy(*PLANE).agg(F.max("local_index").alias("last_"))
    tail = frames.hint("merge").join(last, PLANE).where(F.col("local_index") > F.col("last_") - n)
    return mean_volume(frames.where(F.col("local_index") < n)).withColumnRenamed("v", "early").join(mean_volume(tail).withColumnRenamed("v", "late"), PIXEL)
