"""Pairs of repeats, overlaps, and nearest landmarks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackloom.functions import stats
from stackloom.runtime import dealt_pairs, keep

#: Points of a block, blocks of a tile, and right blocks that a left one is compared with first.
BLOCK, TILE, FIRST = 256, 16, 4


def repeat_pairs(scans: DataFrame, keys: list[str], scan: str, more: list[str] | None = None) -> DataFrame:
    """Unordered pairs of scans with equal keys, by scan id, with columns ``more`` of both as ``_1`` and ``_2``; pairs are not shuffled."""
    side = lambda i, n, named: scans.select(*(F.col(k).alias(named(k)) for k in keys), F.col(scan).alias(n), *(F.col(c).alias(f"{c}_{i}") for c in more or []))
    pairs = dealt_pairs(side(1, "first", str), side(2, "second", lambda k: f"{k}_of_2"), keys, [f"{k}_of_2" for k in keys])
    return pairs.where("first < second").drop(*(f"{k}_of_2" for k in keys))


def overlap(pairs: DataFrame, axes: list[str], least: int, step: float) -> DataFrame:
    """Common interval of both sides per axis and its samples on a grid; ``usable`` if every axis has enough."""
    out = pairs
    for a in axes:
        lo, hi = F.greatest(f"{a}_lo_1", f"{a}_lo_2"), F.least(f"{a}_hi_1", f"{a}_hi_2")
        out = out.withColumns({f"{a}_lo": lo, f"{a}_hi": hi, f"{a}_n": F.greatest(F.floor((hi - lo) / step + 1e-9) + 1, F.lit(0)).cast("long")})
    return out.withColumn("usable", F.least(*(F.col(f"{a}_n") for a in axes), F.lit(least)) >= least)


def _curve(axes: list[str], low: list[float], high: list[float]) -> Column:
    """The place of a point on a curve through all points (bits of its coordinates in turn), so that neighbours on it are near each other."""
    bits = min(20, 62 // len(axes))

    @F.pandas_udf("long")
    def place(xs: pd.DataFrame) -> pd.Series:
        out = np.zeros(len(xs), dtype=np.int64)
        for i, (a, lo, hi) in enumerate(zip(axes, low, high, strict=True)):
            q = (np.clip((xs[a].to_numpy() - lo) / ((hi - lo) or 1.0), 0.0, 1.0) * (2**bits - 1)).astype(np.int64)
            for b in range(bits):
                out |= ((q >> b) & 1) << (b * len(axes) + i)
        return pd.Series(out)

    return place(F.struct(*axes))


def _blocks(points: DataFrame, axes: list[str]) -> DataFrame:
    """Points (k_, id, axes) in rows of at most ``BLOCK`` neighbours, by id, with the box around them; ``tile`` names blocks near each other."""
    shares = points.agg(F.count("*").alias("n"), *(F.percentile_approx(a, F.array(F.lit(0.001), F.lit(0.999))).alias(a) for a in axes)).first()
    low, high = ([(1.5 * s[i] - 0.5 * s[1 - i]) if (s := shares[a]) else 0.0 for a in axes] for i in (0, 1))
    d = points.withColumn("place_", _curve(axes, low, high)).repartitionByRange(max(1, -(-shares["n"] // (BLOCK * TILE))), "k_", "place_", "id").sortWithinPartitions("k_", "place_", "id")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, made = TaskContext.get().partitionId() << 24, 0
        whole = list(batches)
        for k, (name, of_key) in enumerate(pd.concat(whole).groupby("k_", sort=False)) if whole else ():
            for at in range(0, len(of_key), BLOCK):
                b = of_key.iloc[at : at + BLOCK].sort_values("id")
                row = {"k_": name, "tile": part + k, "block": part + made, "id": b["id"].to_numpy()}
                for a in axes:
                    row |= {a: b[a].to_numpy(), f"lo_{a}": b[a].min(), f"hi_{a}": b[a].max()}
                made += 1
                yield pd.DataFrame([row])

    kind = points.schema["id"].dataType.simpleString()
    return keep(d.mapInPandas(cut, f"k_ string, tile long, block long, id array<{kind}>, " + ", ".join(f"{a} array<double>, lo_{a} double, hi_{a} double" for a in axes)))


def _close(pairs: DataFrame, axes: list[str], radius: float, by: str) -> DataFrame:
    """Pairs of boxes (l_, r_) in which the nearest point to one of the left box may be, with their least distance ``near_``."""
    sides = [[F.col(f"{s}_{e}_{a}") for s in "lr" for e in ("lo", "hi")] for a in axes]
    size = lambda parts: F.sqrt(reduce(lambda x, y: x + y, (p * p for p in parts)))
    # bounds leave room for rounding
    near = size(F.greatest(rlo - lhi, llo - rhi, F.lit(0.0)) for llo, lhi, rlo, rhi in sides) * (1 - 1e-9)
    far = size(F.greatest(rhi - llo, lhi - rlo) for llo, lhi, rlo, rhi in sides) * (1 + 1e-9)
    d = pairs.withColumns({"near_": near, "far_": far}).where(F.col("near_") <= radius)
    return d.withColumn("far_", F.min("far_").over(Window.partitionBy(by))).where("near_ <= far_")


def block_pairs(left: DataFrame, right: DataFrame, axes: list[str], radius: float) -> DataFrame:
    """l_block, r_block, near_ and ``rank_`` (from 1, nearest first) of the blocks that are to be compared: tiles are paired first, then the blocks of those that are close."""
    box = lambda d, s, by: d.groupBy("k_", *by).agg(*(f(f"{e}_{a}").alias(f"{s}_{e}_{a}") for a in axes for e, f in (("lo", F.min), ("hi", F.max)))).withColumnsRenamed({b: f"{s}_{b}" for b in by})
    tiles = _close(box(left, "l", ["tile"]).join(box(right, "r", ["tile"]), "k_"), axes, radius, "l_tile").select("l_tile", "r_tile")
    pairs = _close(tiles.join(box(left, "l", ["tile", "block"]).drop("k_"), "l_tile").join(box(right, "r", ["tile", "block"]).drop("k_"), "r_tile"), axes, radius, "l_block")
    apart = reduce(lambda x, y: x + y, (F.abs(F.col(f"l_lo_{a}") + F.col(f"l_hi_{a}") - F.col(f"r_lo_{a}") - F.col(f"r_hi_{a}")) for a in axes))
    return pairs.select("l_block", "r_block", "near_", F.row_number().over(Window.partitionBy("l_block").orderBy("near_", apart, "r_block")).alias("rank_"))


def _compare(row: dict, axes: list[str], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance and id of the nearest right point of each of some left ones; right ones are by id, so ties go to the smaller."""
    with np.errstate(over="ignore"):
        d = np.sqrt(reduce(np.add, (np.square(row[a][rows, None] - row[f"r_{a}"][None, :]) for a in axes)))
    at = d.argmin(axis=1)
    return d[np.arange(len(d)), at], row["r_id"][at]


def nearest(left: DataFrame, right: DataFrame, axes: list[str], radius: float, keys: list[str] | None = None) -> DataFrame:
    """The nearest right landmark within a radius of each left one (of equal ``keys``). Ties go to the smaller id; left landmarks without a match are kept.

    Both sides are cut into blocks of near points, so that the work follows the number of points at any density. Each left block is compared with its
    ``FIRST`` nearest right ones, then with those only that are nearer to one of its points than what that has found.
    """
    keys = keys or []
    name = F.to_json(F.struct(*keys)) if keys else F.lit("")
    whole = reduce(lambda x, y: x & y, (*(F.col(k).isNotNull() for k in keys), *(F.abs(F.col(a).cast("double")) < float("inf") for a in axes)))
    points = lambda d: d.where(whole).select(name.alias("k_"), "id", *(F.col(a).cast("double").alias(a) for a in axes))
    of_l = _blocks(points(left), axes)
    of_r = _blocks(points(right).groupBy("k_", *axes).agg(F.min("id").alias("id")), axes)
    pairs = keep(block_pairs(of_l, of_r, axes, radius))
    r = of_r.select(F.col("block").alias("r_block"), F.col("id").alias("r_id"), *(F.col(c).alias(f"r_{c}") for a in axes for c in (a, f"lo_{a}", f"hi_{a}")))
    l = of_l.select("k_", F.col("block").alias("l_block"), "id", *axes)  # noqa: E741
    kinds = [d.schema["id"].dataType.simpleString() for d in (left, right)]

    def first(of_block: pd.DataFrame) -> pd.DataFrame:
        rows = of_block.to_dict("records")
        every = np.arange(len(rows[0]["id"]))
        best, match = np.full(len(every), np.inf), np.empty(len(every), dtype=object)
        for row in rows:
            d, to = _compare(row, axes, every)
            better = d < best
            better[d == best] = [m is None or t < m for t, m in zip(to[d == best], match[d == best], strict=True)]
            best[better], match[better] = d[better], to[better]
        best = np.where(best <= radius, best, np.inf)
        return pd.DataFrame([{**{c: rows[0][c] for c in ("k_", "l_block", "id", *axes)}, "best": best, "match": [m if b < np.inf else None for m, b in zip(match, best, strict=True)], "reach": min(best.max(), radius)}])

    def more(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                gaps = (np.maximum(np.maximum(row[f"r_lo_{a}"] - row[a], row[a] - row[f"r_hi_{a}"]), 0.0) for a in axes)
                rows = np.flatnonzero(np.sqrt(reduce(np.add, map(np.square, gaps))) * (1 - 1e-9) <= np.minimum(row["best"], radius))
                if len(rows):
                    d, to = _compare(row, axes, rows)
                    ok = (d <= radius) & (d <= row["best"][rows])
                    yield pd.DataFrame({"k_": row["k_"], "id": row["id"][rows[ok]], "distance": d[ok], "match": to[ok]})

    start = pairs.where(F.col("rank_") <= FIRST).join(l, "l_block").join(r, "r_block")
    found = keep(start.groupBy("l_block").applyInPandas(first, f"k_ string, l_block long, id array<{kinds[0]}>, " + "".join(f"{a} array<double>, " for a in axes) + f"best array<double>, match array<{kinds[1]}>, reach double"))
    rest = pairs.where(F.col("rank_") > FIRST).join(found.drop("match"), "l_block").where("near_ <= reach").join(r, "r_block")
    got = found.select("k_", F.explode(F.arrays_zip("id", "best", "match")).alias("p")).where("p.match is not null").select("k_", "p.id", F.col("p.best").alias("distance"), "p.match")
    got = got.unionByName(rest.mapInPandas(more, f"k_ string, id {kinds[0]}, distance double, match {kinds[1]}"))
    got = left.select(*keys, name.alias("k_"), "id").unionByName(got, allowMissingColumns=True).groupBy("k_", "id")
    best = F.min(F.when(F.col("distance").isNotNull(), F.struct("distance", "match"))).alias("b")
    return got.agg(*(F.first(k, True).alias(k) for k in keys), best).select(*keys, "id", F.col("b.match").alias("match"), F.col("b.distance").alias("distance"))


def landmark_summary(matches: DataFrame) -> DataFrame:
    d = F.col("distance")
    return matches.agg(F.count("*").alias("landmarks"), F.count(d).alias("matched"), F.coalesce(F.median(d), F.lit(float("nan"))).alias("error_median"), F.coalesce(F.percentile(d, F.lit(0.95)), F.lit(float("nan"))).alias("error_p95"))


def centred_error(rows: DataFrame, keys: list[str], compared: Column | None = None) -> DataFrame:
    """RMSE and p95 of the differences of two shifts, each freed of its median, over the rows that ``compared`` picks (all without it)."""
    d = rows if compared is None else rows.where(compared)
    mid = d.groupBy(*keys).agg(*(F.median(c).alias(f"m_{c}") for c in ("dy", "dx", "true_dy", "true_dx")))
    e = F.hypot(*((F.col(c) - F.col(f"m_{c}")) - (F.col(f"true_{c}") - F.col(f"m_true_{c}")) for c in ("dy", "dx")))
    return d.join(mid, keys).withColumn("e", e).groupBy(*keys).agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.percentile("e", F.lit(0.95)).alias("p95"))


def common_grid(pairs: DataFrame, spacing_um: float, least: int = 4) -> DataFrame:
    """Adds the common physical space of two volumes to pairs (z_um_1, z_um_2 arrays, fov_y_1, fov_x_1, fov_y_2, fov_x_2): z_start, z_stop,
    y_stop, x_stop, and n_z, n_y, n_x samples at a spacing; ``usable`` if they overlap and every axis has ``least`` of them."""
    first, last = (lambda i: F.element_at(f"z_um_{i}", 1)), (lambda i: F.element_at(f"z_um_{i}", -1))
    d = pairs.withColumns({"z_start": F.greatest(first(1), first(2)), "z_stop": F.least(last(1), last(2)), "y_stop": F.least("fov_y_1", "fov_y_2"), "x_stop": F.least("fov_x_1", "fov_x_2")})
    count = lambda span: F.greatest(F.ceil(span / spacing_um), F.lit(0)).cast("long")
    d = d.withColumns({"n_z": count(F.col("z_stop") - F.col("z_start") + spacing_um * 0.25), "n_y": count(F.col("y_stop")), "n_x": count(F.col("x_stop"))})
    return d.withColumn("usable", (F.col("z_stop") > F.col("z_start")) & (F.least("n_z", "n_y", "n_x") >= least))


def _blend(vol: DataFrame, targets: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """Weighted sums over the neighbours that ``targets`` names; NaN where a neighbour of weight is missing."""
    got = targets.join(vol, [*keys, *axes], "left")
    missing = F.max((F.col("v").isNull() & (F.col("w") > 0)).cast("int")) == 1
    return got.groupBy(*keys, *(f"to_{a}" for a in axes)).agg(F.when(missing, stats.nan()).otherwise(F.sum(F.coalesce(F.col("v") * F.col("w"), F.lit(0.0)))).alias("v"))


def _taps(df: DataFrame, axis: str, source: Column) -> DataFrame:
    """Two neighbours of a source coordinate with their weights."""
    low = F.floor(source)
    return df.withColumn("tap", F.explode(F.array(F.lit(0), F.lit(1)))).select("*", (low + F.col("tap")).cast("long").alias(axis), F.when(F.col("tap") == 0, 1 - (source - low)).otherwise(source - low).alias(f"w_{axis}")).drop("tap")


def on_grid(vol: DataFrame, grid: DataFrame, spacing_um: float) -> DataFrame:
    """A volume (scan_id, plane, y, x, v) resampled linearly to the grid of its stack: rows (scan_id, z_start, n_z, n_y, n_x, z_um, pixel_y, pixel_x).

    ``z_um`` are the positions of its planes, which rise; between them Z is interpolated piecewise. Outside, the border is repeated.
    """
    top = vol.groupBy("scan_id").agg(F.max("y").alias("top_y"), F.max("x").alias("top_x"))
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    t = grid.join(top, "scan_id").withColumn("to_plane", span("n_z")).repartition("scan_id", "to_plane").withColumn("to_y", span("n_y")).withColumn("to_x", span("n_x"))
    z = F.col("z_start") + F.col("to_plane") * spacing_um
    low = F.greatest(F.least(F.size(F.filter("z_um", lambda p: p <= z)), F.size("z_um") - 1), F.lit(1))
    part = F.least(F.greatest((z - F.element_at("z_um", low)) / (F.element_at("z_um", low + 1) - F.element_at("z_um", low)), F.lit(0.0)), F.lit(1.0))
    t = t.withColumns({"at_z": F.when(F.size("z_um") == 1, 0.0).otherwise(low - 1 + part), "at_y": F.least(F.col("to_y") * spacing_um / F.col("pixel_y"), F.col("top_y").cast("double")), "at_x": F.least(F.col("to_x") * spacing_um / F.col("pixel_x"), F.col("top_x").cast("double"))})
    t = t.select("scan_id", "to_plane", "to_y", "to_x", "at_z", "at_y", "at_x")
    t = _taps(_taps(_taps(t, "plane", F.col("at_z")), "y", F.col("at_y")), "x", F.col("at_x")).withColumn("w", F.col("w_plane") * F.col("w_y") * F.col("w_x"))
    return _blend(vol, t, ["scan_id"], ["plane", "y", "x"]).select("scan_id", F.col("to_plane").alias("plane"), F.col("to_y").alias("y"), F.col("to_x").alias("x"), "v")


def landmarks(vol: DataFrame, most: int = 30, distance: int = 6, percentile: float = 0.998) -> DataFrame:
    """scan_id, id, plane, y, x: the strongest local maxima of a difference of Gaussians, a cube of ``distance`` voxels apart and away from the faces."""
    from stackloom.operators import chunks, volume

    f = keep(chunks.band_pass(vol, (0.8,) * 3, (4.0,) * 3, difference=False).withColumn("f", F.round("f", 9)))
    offsets = [(a, b, c) for a in range(-distance, distance + 1) for b in range(-distance, distance + 1) for c in range(-distance, distance + 1) if (a, b, c) != (0, 0, 0)]
    best = volume.peaks(f, percentile, most, offsets, (max(2, distance),) * 3)
    return best.select("scan_id", F.col("rank_").cast("long").alias("id"), *volume.AXES)


def compare_repeats(first: DataFrame, second: DataFrame, spacing_um: float, most_um: float = 40.0, count: int = 30, distance_um: float = 12.0, radius_um: float = 20.0, upsample: int = 10, percentile: float = 0.998) -> DataFrame:
    """A row a pair of repeated volumes on their common grid (scan_id names the pair): the 3-D shift in µm and whether it is within the limit,
    the correlation before and after it is applied, and landmarks of both, those matched within a radius and their errors."""
    from stackloom.operators import spectra, volume

    shift = keep(spectra.shift_of_volumes(first, second, upsample))
    after = keep(volume.move3(second, shift))
    ncc = lambda b, n: first.withColumnRenamed("v", "a_").join(b.withColumnRenamed("v", "b_"), ["scan_id", *volume.AXES]).groupBy("scan_id").agg(stats.pearson(F.col("a_"), F.col("b_")).alias(n))
    um = {f"{c}_um": F.col(c) * spacing_um for c in ("dz", "dy", "dx")}
    out = shift.withColumns(um).withColumn("magnitude_um", F.sqrt(F.col("dz_um") * F.col("dz_um") + F.col("dy_um") * F.col("dy_um") + F.col("dx_um") * F.col("dx_um"))).withColumn("within_limit", F.col("magnitude_um") <= most_um)
    out = out.join(ncc(second, "ncc_before"), "scan_id").join(ncc(after, "ncc_after"), "scan_id")
    apart = max(1, round(distance_um / spacing_um))
    fill = keep(volume.with_each(after, stats.quantiles(after, ["scan_id"], "v", {"fill_": 0.5})).withColumn("v", F.coalesce(stats.skip_nan(F.col("v")), "fill_")).drop("fill_"))
    sides = [keep(landmarks(v, count, apart, percentile)).select("scan_id", F.concat_ws("/", "scan_id", "id").alias("id"), *((F.col(c) * spacing_um).alias(c) for c in volume.AXES)) for v in (first, fill)]
    found = nearest(sides[0], sides[1], list(volume.AXES), radius_um, ["scan_id"])
    n = [s.groupBy("scan_id").agg(F.count("*").alias(c)) for s, c in zip(sides, ("landmarks_first", "landmarks_second"), strict=True)]
    found = found.groupBy("scan_id").agg(F.count("distance").alias("landmarks_matched"), F.median("distance").alias("landmark_error_median_um"), F.percentile("distance", F.lit(0.95)).alias("landmark_error_p95_um"))
    for d in (*n, found):
        out = out.join(d, "scan_id", "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("landmarks_first", "landmarks_second", "landmarks_matched")}
    return out.withColumns(zero | {c: F.coalesce(c, stats.nan()) for c in ("landmark_error_median_um", "landmark_error_p95_um")})
