"""Intensity histograms of sampled frames, and what they say of saturation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackloom.functions import stats
from stackloom.operators.recon import FRAME, PLANE
from stackloom.operators.stacks import only, with_each


def histogram(frames: DataFrame) -> DataFrame:
    """scan_id, value, n: counts of whole intensities. Each image gives its own counts first, so pixels are not shuffled."""
    v = frames.select("scan_id", F.explode("pixels").alias("v")).where(stats.finite(F.col("v")))
    return v.groupBy("scan_id", F.floor("v").cast("long").alias("value")).agg(F.count("*").alias("n"))


def sampled(frames: DataFrame, positions: tuple[float, ...], discard: int = 0) -> DataFrame:
    """The frames at normalised positions (0 to 1, half-even) among those of each plane after the first ``discard``; each once."""
    if not all(0 <= p <= 1 for p in positions):
        raise ValueError(f"positions {positions} are not all between 0 and 1")
    n = frames.groupBy(*PLANE).agg((F.max("local_index") - discard + 1).alias("n_")).where("n_ > 0")
    at = F.transform(F.lit([float(p) for p in positions]), lambda p: F.rint(p * (F.col("n_") - 1)).cast("long") + discard)
    return only(frames, n.select(*PLANE, F.explode(F.array_distinct(at)).alias("local_index")), FRAME)


def plane_levels(frames: DataFrame, share: float = 0.999, discard: int = 0) -> DataFrame:
    """scan_id, plane, a high percentile of all raw intensities of the plane, and their maximum."""
    v = frames.where(F.col("local_index") >= discard).select(*PLANE, F.explode("pixels").alias("v")).withColumn("v", F.col("v").cast("double")).where(stats.finite(F.col("v")))
    return stats.quantiles(v, PLANE, "v", {"p999": share}).join(v.groupBy(*PLANE).agg(F.max("v").alias("maximum")), PLANE)


def summary(counts: DataFrame, low_rail: int, high_rail: int, tail: float = 0.999, plateau: float = 0.2) -> DataFrame:
    """A row a stack: samples, minimum, median and high quantiles (the smallest value whose cumulative count reaches the share), maximum, its share, shares at the rails,
    the values at or above the tail quantile, their mode (the smallest of equal ones) and its share, and whether that is a ``plateau``."""
    w = Window.partitionBy("scan_id")
    d = counts.withColumns({"up_to": F.sum("n").over(w.orderBy("value")), "all": F.sum("n").over(w)})
    at = lambda p: F.min(F.when(F.col("up_to") >= F.col("all") * p, F.col("value")))
    q = d.groupBy("scan_id").agg(F.first("all").alias("samples"), at(0.5).alias("p50"), at(0.99).alias("p99"), at(0.999).alias("p999"), at(0.9999).alias("p9999"), F.min("value").alias("minimum"), at(tail).alias("tail_from"), F.max("value").alias("maximum"), F.sum(F.when(F.col("value") <= low_rail, F.col("n")).otherwise(0)).alias("low"), F.sum(F.when(F.col("value") >= high_rail, F.col("n")).otherwise(0)).alias("high"))
    t = with_each(counts, q).where(F.col("value") >= F.col("tail_from")).groupBy("scan_id").agg(F.sum("n").alias("tail_n"), F.max(F.struct("n", (-F.col("value")).alias("m"))).alias("x"), F.sum(F.when(F.col("value") == F.col("maximum"), F.col("n")).otherwise(0)).alias("at_max"))
    share = lambda c: F.col(c) / F.col("samples")
    out = q.join(t, "scan_id").select(
        "scan_id", "samples", "minimum", "p50", "p99", "p999", "p9999", "tail_from", "maximum", share("at_max").alias("at_max_share"), share("low").alias("low_rail_share"), share("high").alias("high_rail_share"), share("tail_n").alias("tail_share"),
        (-F.col("x.m")).alias("tail_mode"), (F.col("x.n") / F.col("tail_n")).alias("tail_mode_share"),
    )
    return out.withColumns({"rail_hit": (F.col("low_rail_share") > 0) | (F.col("high_rail_share") > 0), "plateau": F.col("tail_mode_share") >= plateau})
