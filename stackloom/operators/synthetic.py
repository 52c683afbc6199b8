"""Frames with known motion, made in tasks from a seed, and the recovery of that motion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.operators import features, register
from stackloom.runtime import keep

# Frames, noise as a share of the image's deviation, and the displaced frames of each case.
CASES = {"motion_with_outliers": (48, 0.04, {7: (10.0, -9.0), 31: (-11.0, 10.0)}), "brightness_only": (36, 0.02, {}), "low_snr": (36, 1.0, {})}
BLOBS, LOW, HIGH = 28, 150.0, 1950.0
#: Acceptance: RMSE and p95 of shifts in pixels, and the share of frames kept.
MOST_RMSE, MOST_P95, LEAST_KEPT = 0.35, 0.5, 0.9


def reference(shape: tuple[int, int], seed: int) -> np.ndarray:
    """Elongated Gaussian spots over smooth noise, scaled to 150..1950; equal for equal seeds."""
    rng = np.random.default_rng(seed)
    y, x = np.indices(shape, float)
    n = np.array(shape)
    centres = rng.uniform(0.08, 0.92, (BLOBS, 2)) * n
    widths, heights = rng.uniform(1.4, 5.5, (BLOBS, 2)), rng.uniform(0.3, 1.0, BLOBS)
    image = sum(h * np.exp(-(((y - cy) / wy) ** 2 + ((x - cx) / wx) ** 2) / 2) for h, (cy, cx), (wy, wx) in zip(heights, centres, widths, strict=True))
    low = np.exp(-2 * (np.pi * 2.2) ** 2 * sum(f**2 for f in np.meshgrid(np.fft.fftfreq(shape[0]), np.fft.fftfreq(shape[1]), indexing="ij")))
    texture = np.fft.ifft2(np.fft.fft2(rng.normal(size=shape)) * low).real
    image = image + 0.12 * (texture - texture.min()) / np.ptp(texture)
    return LOW + (HIGH - LOW) * (image - image.min()) / np.ptp(image)


def displaced(image: np.ndarray, dy: float, dx: float) -> np.ndarray:
    """The image moved by (dy, dx): cubic convolution (Keys, 1981) along each axis, mirrored at the borders."""
    for axis, d in ((0, dy), (1, dx)):
        n = image.shape[axis]
        at = np.arange(n) - d
        low = np.floor(at).astype(int)
        out = 0.0
        for k in range(-1, 3):
            t = np.abs(at - low - k)
            w = np.where(t <= 1, 1.5 * t**3 - 2.5 * t**2 + 1, np.where(t < 2, -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2, 0))
            i = (low + k) % (2 * n)
            i = np.where(i < n, i, 2 * n - 1 - i)
            out = out + np.take(image, i, axis) * w.reshape([-1 if a == axis else 1 for a in range(2)])
        image = out
    return image


def frames(spark: SparkSession, shape: tuple[int, int] = (160, 160), seed: int = 3) -> DataFrame:
    """scan_id (the case), plane, local_index, width, true_dy, true_dx, outlier, pixels. ``true_*`` is the shift that puts a frame back."""
    names = list(CASES)
    rows = [(p, i) for p, c in enumerate(names) for i in range(CASES[c][0])]

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ref = reference(shape, seed)
        for b in batches:
            out = []
            for p, i in zip(b["case_"], b["local_index"], strict=True):
                n, noise, outliers = CASES[names[p]]
                rng = np.random.default_rng([seed, p, i])
                dy, dx = outliers.get(i, tuple(rng.uniform(-2, 2, 2)) if outliers else (0.0, 0.0))
                part = i / (n - 1)
                scale, offset = ((rng.uniform(0.65, 1.4), rng.uniform(-80, 80)), (0.45 + 1.2 * part, 240 * part - 120), (0.08, 0.0))[p]
                image = scale * displaced(ref, dy, dx) + offset + rng.normal(0, noise * ref.std(), shape)
                out.append((names[p], 0, i, shape[1], -dy, -dx, i in outliers, image.astype(np.float32).ravel()))
            yield pd.DataFrame(out, columns=["scan_id", "plane", "local_index", "width", "true_dy", "true_dx", "outlier", "pixels"])

    return spark.createDataFrame(rows, "case_ long, local_index long").repartition("case_", "local_index").mapInPandas(make, "scan_id string, plane long, local_index long, width int, true_dy double, true_dx double, outlier boolean, pixels array<float>")


def evaluate(spark: SparkSession, shape: tuple[int, int] = (160, 160), seed: int = 3, **bounds: float) -> DataFrame:
    """Per case: frames, kept share, outliers and those rejected, rmse and p95 of the centred shift error, and ``passed``.

    Errors are of frames that are no outliers, each side freed of its median over them. Frames of low signal are judged
    by nothing but what is recorded. ``bounds`` go to registration_keep; its robust bounds may drop the dimmest frames of the
    brightness ramp, whose correlation is high but lower than the others'.
    """
    f = keep(frames(spark, shape, seed))
    kept = register.registration_keep(register.frame_shifts(f, condition=register.CONDITION), **bounds)
    d = f.drop("pixels", "width").join(kept.select("scan_id", "plane", "local_index", "dy", "dx", "keep"), ["scan_id", "plane", "local_index"])
    error = features.centred_error(d, ["scan_id"], ~F.col("outlier"))
    s = d.groupBy("scan_id").agg(
        F.count("*").alias("frames"), F.avg(F.when(~F.col("outlier"), F.col("keep").cast("double"))).alias("kept"), F.count_if("outlier").alias("outliers"), F.count_if(F.col("outlier") & ~F.col("keep")).alias("rejected"),
    ).join(error, "scan_id").withColumnRenamed("scan_id", "case")
    still = (F.col("rmse") <= MOST_RMSE) & (F.col("rejected") == F.col("outliers")) & (F.col("kept") >= LEAST_KEPT)
    return s.withColumn("passed", F.when(F.col("case") == "motion_with_outliers", still).when(F.col("case") == "brightness_only", (F.col("p95") <= MOST_P95) & (F.col("kept") >= LEAST_KEPT)))
