"""Registration of pairs of volumes by a distributed three-dimensional Fourier transform.

Planes are transformed where they are gathered, one a task; their frequencies are dealt in tiles, and each tile of all planes, a pencil, is transformed along Z.
There both volumes meet as a cross-spectrum, which goes back the same way. The peak is a maximum over planes; the fine grid around it is a
sum over pencils. No task holds more than a plane or a pencil of a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.functions import stats
from stackloom.operators import chunks, volume
from stackloom.operators.recon import lists
from stackloom.operators.stacks import AXES, STACK, with_each
from stackloom.runtime import keep

#: Frequencies of a pencil along Y and X.
TILE = 64
#: A chunk that is one whole plane.
PLANE = (1, 1 << 40, 1 << 40)


def conditioned(vol: DataFrame, sigma: float) -> DataFrame:
    """Volumes (scan_id, plane, y, x, v) blurred, undefined voxels filled by the median before, freed of their median and scaled by the MAD (if it is not 0)."""
    filled = with_each(vol, stats.quantiles(vol, [STACK], "v", {"fill_": 0.5})).select(STACK, *AXES, F.coalesce(F.when(stats.finite(F.col("v")), F.col("v")), "fill_").alias("v"))
    soft = keep(volume.gaussian(filled, sigma))
    middle = with_each(soft, stats.quantiles(soft, [STACK], "v", {"middle_": 0.5})).withColumn("v", F.col("v") - F.col("middle_"))
    middle = middle.withColumn("v", F.when(F.abs("v") > F.abs("middle_") * 1e-12, F.col("v")).otherwise(0.0))  # what is less is rounding
    wide = stats.quantiles(middle.withColumn("v", F.abs("v")), [STACK], "v", {"mad_": 0.5})
    return with_each(middle, wide).select(STACK, *AXES, F.when(F.col("mad_") > 0, F.col("v") / (F.col("mad_") * stats.MAD_SCALE)).otherwise(F.col("v")).alias("v"))


def hann(n: int) -> np.ndarray:
    return np.hanning(n)


def _cut(plane: np.ndarray, tile: int) -> Iterator[tuple[int, int, np.ndarray]]:
    for y in range(0, plane.shape[0], tile):
        for x in range(0, plane.shape[1], tile):
            yield y, x, plane[y : y + tile, x : x + tile].ravel()


def _joined(t: pa.Table) -> np.ndarray:
    """The complex numbers of a table's rows, one after another."""
    re, im = (np.concatenate([np.zeros(0), *(c.flatten().to_numpy(zero_copy_only=False) for c in t[n].chunks)]) for n in ("re", "im"))
    return re + 1j * im


def _pieces(rows: list[tuple], names: str) -> dict:
    """Columns of rows (whole numbers, and complex numbers at the end)."""
    *numbers, parts = zip(*rows, strict=True)
    out = {n: pa.array(c, pa.int64()) for n, c in zip(names.split(), numbers, strict=True)}
    return out | {"re": lists([np.ascontiguousarray(p.real) for p in parts]), "im": lists([np.ascontiguousarray(p.imag) for p in parts])}


_SIZE = ", ".join(f"top_{c} double" for c in AXES)


def shift_of_volumes(first: DataFrame, second: DataFrame, upsample: int = 10, sigma: float = 0.7) -> DataFrame:
    """scan_id, dz, dy, dx, error of pairs of volumes (scan_id names the pair) on a common grid: the shift that moves the second onto the first, to 1/upsample.

    Volumes are whole. Along an axis of one voxel there is no shift; constant volumes have an undefined error."""
    both = first.withColumn("side", F.lit("0")).unionByName(second.withColumn("side", F.lit("1"))).select(F.concat("side", STACK).alias(STACK), *AXES, "v")
    both = keep(both)
    tops = both.groupBy(F.substring(STACK, 2, 1 << 30).alias("pair")).agg(*(F.max(c).alias(f"top_{c}") for c in AXES))
    tops = tops.select(F.explode(F.array(F.lit("0"), F.lit("1"))).alias("side"), "*").select(F.concat("side", "pair").alias(STACK), *(f"top_{c}" for c in AXES))

    def planes(sources: list[np.ndarray], first_: tuple, spans: tuple, row: dict) -> dict:
        n = [int(row[f"top_{c}"]) + 1 for c in AXES]
        z = spans[0][0]
        image = np.nan_to_num(sources[0][0]) * hann(n[0])[z] * hann(n[1])[:, None] * hann(n[2])
        return _pieces([(z, y, x, p) for y, x, p in _cut(np.fft.fft2(image), TILE)], "z ty tx") | {f"top_{c}": [row[f"top_{c}"]] * len(range(0, n[1], TILE)) * len(range(0, n[2], TILE)) for c in AXES}

    tiles = f"z long, ty long, tx long, re array<double>, im array<double>, {_SIZE}"
    spectrum = chunks.gathered(conditioned(both, sigma), chunks.Layout((chunks.Same(),) * 3), planes, tiles, PLANE, tops=tops, every=True)
    spectrum = spectrum.select(F.substring(STACK, 1, 1).alias("side"), F.substring(STACK, 2, 1 << 30).alias("pair"), "z", "ty", "tx", "re", "im", *(f"top_{c}" for c in AXES))

    def cross(key: tuple, t: pa.Table) -> pa.Table:
        depth = int(t["top_plane"][0].as_py()) + 1
        t = t.sort_by([("side", "ascending"), ("z", "ascending")])
        a, b = np.fft.fft(_joined(t).reshape(2, depth, -1), axis=1)
        x = (a * b.conj()).ravel()
        size = {f"top_{c}": [t[f"top_{c}"][0].as_py()] for c in AXES}
        return pa.table({"pair": [key[0].as_py()], "ty": [key[1].as_py()], "tx": [key[2].as_py()], "re": lists([np.ascontiguousarray(x.real)]), "im": lists([np.ascontiguousarray(x.imag)]), "first_power": [float((np.abs(a) ** 2).sum())], "second_power": [float((np.abs(b) ** 2).sum())], **size})

    pencils = keep(spectrum.groupBy("pair", "ty", "tx").applyInArrow(cross, f"pair string, ty long, tx long, re array<double>, im array<double>, first_power double, second_power double, {_SIZE}"))

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                t = pa.Table.from_batches([b.slice(i, 1)])
                row = {c: t[c][0].as_py() for c in ("pair", "ty", "tx", *(f"top_{c}" for c in AXES))}
                x = np.fft.ifft(_joined(t).reshape(int(row["top_plane"]) + 1, -1), axis=0)
                cols = _pieces([(z, row["ty"], row["tx"], p) for z, p in enumerate(x)], "z ty tx")
                yield pa.RecordBatch.from_pydict({"pair": [row["pair"]] * len(x), **cols, **{f"top_{c}": [row[f"top_{c}"]] * len(x) for c in AXES}})

    def peak(key: tuple, t: pa.Table) -> pa.Table:
        ny, nx = (int(t[f"top_{c}"][0].as_py()) + 1 for c in ("y", "x"))
        image = np.zeros((ny, nx), complex)
        for i in range(t.num_rows):
            y, x = t["ty"][i].as_py(), t["tx"][i].as_py()
            image[y : y + TILE, x : x + TILE] = _joined(t.slice(i, 1)).reshape(min(TILE, ny - y), -1)
        there = np.abs(np.fft.ifft2(image))
        y, x = np.unravel_index(there.argmax(), there.shape)
        return pa.table({"pair": [key[0].as_py()], "z": [key[1].as_py()], "y": [int(y)], "x": [int(x)], "peak": [float(there.max())]})

    found = pencils.mapInArrow(back, f"pair string, {tiles}").groupBy("pair", "z").applyInArrow(peak, "pair string, z long, y long, x long, peak double")
    best = found.groupBy("pair").agg(F.max(F.struct("peak", *(F.negative(c).alias(c) for c in ("z", "y", "x")))).alias("b")).select("pair", *((-F.col(f"b.{c}")).alias(f"at_{a}") for c, a in zip("zyx", AXES, strict=True)), F.col("b.peak").alias("peak"))
    best = keep(best)
    half = lambda c: F.floor((F.col(f"top_{c}") + 1) / 2)
    at = pencils.withColumnRenamed("pair", STACK)
    at = with_each(at, best.withColumnRenamed("pair", STACK), written=True).withColumnsRenamed({STACK: "pair"})
    at = at.withColumns({f"at_{c}": F.when(F.col(f"at_{c}") > half(c), F.col(f"at_{c}") - F.col(f"top_{c}") - 1).otherwise(F.col(f"at_{c}")).cast("double") for c in AXES})
    reach = int(np.ceil(0.75 * upsample)) if upsample > 1 else 0
    span = np.arange(-reach, reach + 1) / max(1, upsample)

    def fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                t = pa.Table.from_batches([b.slice(i, 1)])
                r = {c: t[c][0].as_py() for c in t.column_names if c not in ("re", "im")}
                n = [int(r[f"top_{c}"]) + 1 for c in AXES]
                y, x = (np.arange(r[k], min(r[k] + TILE, m)) for k, m in (("ty", n[1]), ("tx", n[2])))
                out = _joined(t).reshape(n[0], len(y), len(x)) / np.prod(n, dtype=float)
                for axis, (c, k) in enumerate(zip(AXES, (np.arange(n[0]), y, x), strict=True)):
                    kernel = np.exp(2j * np.pi * np.outer(r[f"at_{c}"] + span, np.fft.fftfreq(n[axis])[k]))
                    out = np.moveaxis(np.tensordot(kernel, out, (1, axis)), 0, axis)
                yield pa.RecordBatch.from_pydict({"pair": [r["pair"]], "re": lists([np.ascontiguousarray(out.real).ravel()]), "im": lists([np.ascontiguousarray(out.imag).ravel()])})

    def top(key: tuple, t: pa.Table) -> pa.Table:
        total = np.abs(_joined(t).reshape(t.num_rows, -1).sum(0))
        z, y, x = np.unravel_index(total.argmax(), (len(span),) * 3)
        return pa.table({"pair": [key[0].as_py()], "z": [float(span[z])], "y": [float(span[y])], "x": [float(span[x])], "most": [float(total.max())]})

    power = at.groupBy("pair").agg(*(F.first(f"{n}_{c}").alias(f"{n}_{c}") for c in AXES for n in ("at", "top")), (F.sqrt(F.sum("first_power") * F.sum("second_power")) / F.first((F.col("top_plane") + 1) * (F.col("top_y") + 1) * (F.col("top_x") + 1))).alias("power"))
    refined = at.mapInArrow(fine, "pair string, re array<double>, im array<double>").groupBy("pair").applyInArrow(top, "pair string, z double, y double, x double, most double")
    ratio = F.col("most") / F.col("power")
    error = F.when(F.col("power") > 0, F.sqrt(F.greatest(F.lit(0.0), 1 - ratio * ratio))).otherwise(stats.nan())
    return refined.join(power, "pair").select(F.col("pair").alias(STACK), *(F.when(F.col(f"top_{a}") > 0, F.col(f"at_{a}") + F.col(c)).otherwise(0.0).alias(f"d{c}") for a, c in zip(AXES, "zyx", strict=True)), error.alias("error"))
