"""Volumes as chunks with halos: one shuffle brings each chunk of the target all source voxels that it needs, and NumPy does the rest.

An axis says how its targets come from its sources: it stays, is blurred, resampled, or shifted. From that follow the chunks that a voxel is
sent to (its own, and those whose halo it lies in), the box of sources that a chunk needs, and a matrix of weights, so that a
separable operation is three small matrix products. A task packs the voxels it has for a chunk into arrays before they are
shuffled. Chunks are dealt by their place, so a task holds one chunk and its halo, whatever the size of a volume.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil, comb, factorial, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.operators.stacks import AXES, STACK, stack, with_each
from stackloom.runtime import keep

#: Voxels of a chunk along plane, y and x, the most that it may have with its halo, and voxels that are packed together.
CHUNK, MOST, PACK = (128, 256, 256), 1 << 24, 1 << 18
#: What is left of a sample at the end of a spline's halo.
SPLINE_REST = 1e-12


@dataclass(frozen=True)
class Same:
    """The axis stays; a chunk gets ``halo`` voxels on either side."""

    halo: int = 0

    def targets(self, top: np.ndarray) -> np.ndarray:
        """The last target, from the last source."""
        return top

    def reach(self, at: np.ndarray, top: np.ndarray, by: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """First and last target that each source is needed for."""
        return np.maximum(at - self.halo, 0), np.minimum(at + self.halo, top)

    def box(self, low: int, high: int, top: int, by: float | None) -> tuple[int, int]:
        """First and last source that the targets from ``low`` to ``high`` need."""
        return max(low - self.halo, 0), min(high + self.halo, top)

    def weights(self, low: int, high: int, first: int, last: int, top: int, by: float | None) -> tuple[np.ndarray, np.ndarray]:
        """The weight of each source of the box (columns) in each target (rows), and which targets are defined."""
        w = np.zeros((high - low + 1, last - first + 1))
        w[np.arange(len(w)), np.arange(low, high + 1) - first] = 1
        return w, np.ones(len(w), bool)


@dataclass(frozen=True)
class Blur(Same):
    """A Gaussian of ``sigma`` voxels, ended after ``halo`` of them; edges repeat their outermost value."""

    sigma: float = 1.0

    def weights(self, low: int, high: int, first: int, last: int, top: int, by: float | None) -> tuple[np.ndarray, np.ndarray]:
        tap = np.arange(-self.halo, self.halo + 1)
        w = np.exp(-0.5 * (tap / self.sigma) ** 2)
        at = np.arange(low, high + 1)
        out = np.zeros((len(at), last - first + 1))
        np.add.at(out, (np.arange(len(at))[:, None], np.clip(at[:, None] + tap, 0, top) - first), w / w.sum())
        return out, np.ones(len(at), bool)


def blur(sigma: float, radius: int | None = None) -> Same:
    r = int(4 * sigma + 0.5) if radius is None else radius
    return Blur(r, sigma) if sigma > 0 and r else Same()


def spline(order: int, x: np.ndarray) -> np.ndarray:
    """The centred B-spline of an order."""
    t = x + (order + 1) / 2
    return sum((-1) ** k * comb(order + 1, k) * np.where(t >= k, (t - k) ** order, 0.0) for k in range(order + 2)) / factorial(order)


def spline_halo(order: int) -> int:
    """Sources beyond its taps that a spline's prefilter should see on either side: its largest pole says how fast they fade."""
    if order < 2:
        return 0
    half = order // 2
    poles = np.roots(spline(order, np.arange(-half, half + 1).astype(float)))
    return ceil(log(SPLINE_REST) / log(max(abs(p) for p in poles if abs(p) < 1)))


@dataclass(frozen=True)
class Sampled:
    """Targets interpolated at fractional sources by a spline of an ``order`` (1: linear); a target whose source is outside is undefined."""

    order: int = 1

    def source(self, t: np.ndarray, top: int, by: float | None) -> np.ndarray:
        raise NotImplementedError(type(self).__name__)

    @property
    def wide(self) -> int:
        return (self.order + 1) // 2 + 1 + spline_halo(self.order)

    def box(self, low: int, high: int, top: int, by: float | None) -> tuple[int, int]:
        s = np.clip(self.source(np.array([low, high], float), top, by), 0, top)
        return max(int(np.floor(s.min())) - self.wide, 0), min(int(np.ceil(s.max())) + self.wide, top)

    def weights(self, low: int, high: int, first: int, last: int, top: int, by: float | None) -> tuple[np.ndarray, np.ndarray]:
        s = self.source(np.arange(low, high + 1, dtype=float), top, by)
        ok = (s >= 0) & (s <= top)
        s, rows = np.where(ok, s, first), np.arange(len(s))
        out = np.zeros((len(s), last - first + 1))
        if self.order == 1 or top == 0:
            f = np.floor(s).astype(int)
            np.add.at(out, (rows, f - first), 1 - (s - f))
            more = s > f
            np.add.at(out, (rows[more], f[more] + 1 - first), (s - f)[more])
            return out, ok
        start = np.floor(s - (self.order - 1) / 2).astype(int)
        for k in range(self.order + 1):
            self._add(out, rows, start + k, first, last, top, spline(self.order, s - start - k))
        samples = np.zeros((last - first + 1,) * 2)
        for k in range(-(self.order // 2), self.order // 2 + 1):
            i = np.arange(len(samples))
            self._add(samples, i, first + i + k, first, last, top, np.full(len(i), spline(self.order, np.array([float(k)]))[0]))
        return np.linalg.solve(samples.T, out.T).T, ok

    @staticmethod
    def _add(m: np.ndarray, rows: np.ndarray, at: np.ndarray, first: int, last: int, top: int, w: np.ndarray) -> None:
        """Weights at sources, mirrored at the volume's faces; what lies outside of the box fades out in the halo."""
        period = 2 * top
        at = at % period
        at = np.where(at > top, period - at, at)
        on = (at >= first) & (at <= last)
        np.add.at(m, (rows[on], at[on] - first), w[on])


@dataclass(frozen=True)
class Scaled(Sampled):
    """Resampled to ``size``; first and last samples stay at the ends."""

    size: int = 1

    def targets(self, top: np.ndarray) -> np.ndarray:
        return np.full_like(top, self.size - 1)

    def source(self, t: np.ndarray, top: int, by: float | None) -> np.ndarray:
        return t * (top / max(1, self.size - 1))

    def reach(self, at: np.ndarray, top: np.ndarray, by: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        step = np.where(top > 0, top, 1) / max(1, self.size - 1)
        low, high = np.ceil((at - self.wide) / step - 1e-6), np.floor((at + self.wide) / step + 1e-6)
        flat = top == 0
        return np.where(flat, 0, np.maximum(low, 0)).astype(np.int64), np.where(flat, self.size - 1, np.minimum(high, self.size - 1)).astype(np.int64)


@dataclass(frozen=True)
class Shifted(Sampled):
    """Moved by the value of a column of the stack or plane; with ``nearest`` sources outside become those at the border."""

    column: str = "by"
    nearest: bool = False

    def targets(self, top: np.ndarray) -> np.ndarray:
        return top

    def source(self, t: np.ndarray, top: int, by: float | None) -> np.ndarray:
        by = np.nan if by is None else by  # an unknown shift leaves nothing defined
        return np.clip(t - by, 0, top) if self.nearest else t - by

    def box(self, low: int, high: int, top: int, by: float | None) -> tuple[int, int]:
        return (low, low - 1) if by is None or not np.isfinite(by) else super().box(low, high, top, by)

    def reach(self, at: np.ndarray, top: np.ndarray, by: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        by = np.where(np.isfinite(by), by, 0)
        # the voxel's own place, too: a plane that is moved out of itself is still there
        low, high = np.clip(np.minimum(np.floor(at + by) - self.wide, at), 0, top), np.clip(np.maximum(np.ceil(at + by) + self.wide, at), 0, top)
        if self.nearest:
            low, high = np.where(at <= self.wide, 0, low), np.where(at >= top - self.wide, top, high)
        return low.astype(np.int64), high.astype(np.int64)


Axis = Same | Sampled


def chunk_for(axes: tuple[Axis, Axis, Axis], most: int = MOST) -> tuple[int, int, int]:
    """Sides of a chunk that has at most so many voxels with its halo: CHUNK, halved where that adds least to what is sent."""
    halo = [a.halo if isinstance(a, Same) else a.wide for a in axes]
    sides = list(CHUNK)
    whole = lambda s: np.prod([n + 2 * h for n, h in zip(s, halo, strict=True)], dtype=float)
    while whole(sides) > most and max(sides) > 1:
        cut = [[n // 2 if k == i else n for k, n in enumerate(sides)] for i in range(3) if sides[i] > 1]
        sides = min(cut, key=lambda s: whole(s) / np.prod(s, dtype=float))
    return tuple(sides)


Ranges = list[tuple[np.ndarray, np.ndarray]]
Kernel = Callable[[list[np.ndarray], tuple, tuple, dict], dict]


@dataclass(frozen=True)
class Layout:
    """How the targets of a volume lie to its sources, each axis by itself."""

    axes: tuple[Axis, Axis, Axis]

    def reach(self, t: dict) -> Ranges:
        """For each axis the first and the last target that the voxels of ``t`` (coordinates and tops by name) are needed for."""
        return [a.reach(t[c], t[f"top_{c}"].astype(np.int64), t.get(getattr(a, "column", ""))) for a, c in zip(self.axes, AXES, strict=True)]

    def boxes(self, spans: tuple, top: list[int], row: dict) -> list[tuple[int, int]]:
        return [a.box(lo, hi, n, row.get(getattr(a, "column", ""))) for a, (lo, hi), n in zip(self.axes, spans, top, strict=True)]

    def lasts(self, top: list[int]) -> list[int]:
        return [int(a.targets(np.array([n]))[0]) for a, n in zip(self.axes, top, strict=True)]


def gathered(vol: DataFrame, layout: Layout, kernel: Kernel, schema: str, sides: tuple[int, int, int], columns: tuple[str, ...] = (), tops: DataFrame | None = None, every: bool = False, values: tuple[str, ...] = ("v",), fill: float = np.nan) -> DataFrame:
    """What ``kernel`` makes of each chunk of the targets of a volume (scan_id, plane, y, x, and ``values``), with scan_id.

    It gets an array of the sources for each of ``values`` (``fill`` where there is none), their first corner, the chunk's ranges of targets, and the values
    ``top_plane``, ``top_y``, ``top_x``, other columns of ``tops``, and ``columns`` (constant in a chunk), and gives columns of ``schema``. ``tops`` has a row a
    stack, with its last coordinates (by default those found). With ``every``, chunks without any source are made, too.
    """
    keys = stack(vol)
    tops = tops if tops is not None else vol.groupBy(*keys).agg(*(F.max(c).cast("long").alias(f"top_{c}") for c in AXES))
    names = [c for c in tops.columns if c not in keys] + list(columns)
    tops = keep(tops.select(*keys, *(F.col(c).cast("double").alias(c) for c in tops.columns if c not in keys)).where("top_plane is not null"))
    name = F.col(STACK).cast("string").alias(STACK) if keys else F.lit("").alias(STACK)
    rows = with_each(vol, tops, written=True).select(name, *(F.col(c).cast("long").alias(c) for c in AXES), *(F.col(c).cast("double").alias(c) for c in (*values, *names)))

    def packed(t: pa.Table) -> pa.RecordBatch:
        scan = t[STACK].combine_chunks().dictionary_encode()
        x = {c: t[c].to_numpy() for c in (*AXES, *values, *names)}
        spans = [(lo // n, hi // n) for (lo, hi), n in zip(layout.reach(x), sides, strict=True)]
        row, place = np.arange(len(x["plane"])), []
        for lo, hi in spans:
            n = np.maximum(hi[row] - lo[row] + 1, 0)
            ends = np.cumsum(n)
            place = [p.repeat(n) for p in place]
            new = np.arange(n.sum()) - np.repeat(ends - n, n) + np.repeat(lo[row], n)
            row = row.repeat(n)
            place.append(new)
        code = scan.indices.to_numpy()[row]
        order = np.lexsort((*place[::-1], code))
        row = row[order]
        key = np.stack([code[order], *(p[order] for p in place)])
        new = np.flatnonzero(np.concatenate((np.ones(min(1, len(row)), bool), (key[:, 1:] != key[:, :-1]).any(0))))
        at = (x["plane"] * (x["top_y"].astype(np.int64) + 1) + x["y"]) * (x["top_x"].astype(np.int64) + 1) + x["x"]
        cuts = pa.array(np.append(new, len(row)), pa.int32())
        first = row[new]
        return pa.RecordBatch.from_arrays(
            [scan.dictionary.take(pa.array(key[0, new])).cast(pa.string()), *(pa.array(p) for p in key[1:4, new]), *(pa.ListArray.from_arrays(cuts, pa.array(a[row])) for a in (at, *(x[v] for v in values))), *(pa.array(x[c][first]) for c in names)],
            [STACK, "c0", "c1", "c2", "at", *values, *names],
        )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= PACK:
                yield packed(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield packed(pa.Table.from_batches(held))

    def empty(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for scan, *top in zip(*(c.to_pylist() for c in b.columns), strict=True):
                grid = np.indices([n // m + 1 for n, m in zip(layout.lasts([int(x) for x in top[:3]]), sides, strict=True)]).reshape(3, -1)
                n = grid.shape[1]
                none = pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([scan] * n, pa.string()), *(pa.array(g) for g in grid), none, *(none.cast(pa.list_(pa.float64())) for _ in values), *(pa.array([x] * n, pa.float64()) for x in top), *(pa.array([None] * n, pa.float64()) for _ in columns)],
                    [STACK, "c0", "c1", "c2", "at", *values, *names],
                )

    fields = [f.split() for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}

    def run(key: tuple, t: pa.Table) -> pa.Table:
        row = {c: next((x for x in t[c].to_pylist() if x is not None), None) for c in names}
        top = [int(row[f"top_{c}"]) for c in AXES]
        spans = tuple((k.as_py() * n, min(k.as_py() * n + n - 1, m)) for k, n, m in zip(key[1:], sides, layout.lasts(top), strict=True))
        boxes = layout.boxes(spans, top, row)
        shape = [max(0, hi - lo + 1) for lo, hi in boxes]
        at, *vs = (np.concatenate([np.zeros(0, kind), *(c.flatten().to_numpy(zero_copy_only=False) for c in t[n].chunks)]) for n, kind in [("at", np.int64), *((v, np.float64) for v in values)])
        rest, x = np.divmod(at, top[2] + 1)
        z, y = np.divmod(rest, top[1] + 1)
        here = [c - lo for c, (lo, _) in zip((z, y, x), boxes, strict=True)]
        ok = np.logical_and.reduce([(c >= 0) & (c < n) for c, n in zip(here, shape, strict=True)])
        sources = [np.full(shape, fill) for _ in values]
        for source, v in zip(sources, vs, strict=True):
            source[tuple(c[ok] for c in here)] = v[ok]
        out = kernel(sources, tuple(lo for lo, _ in boxes), spans, row)
        n = len(next(iter(out.values())))
        return pa.table({STACK: pa.array([key[0].as_py()] * n, pa.string()), **{f: out[f] if isinstance(out[f], pa.Array) else pa.array(out[f], kinds[k]) for f, k in fields}})

    packed_schema = f"{STACK} string, c0 long, c1 long, c2 long, at array<long>, " + ", ".join([*(f"{v} array<double>" for v in values), *(f"{c} double" for c in names)])
    pieces = rows.mapInArrow(pack, packed_schema)
    if every:
        pieces = pieces.unionByName(tops.select(name, *names[: len(names) - len(columns)]).mapInArrow(empty, packed_schema))
    got = pieces.groupBy(STACK, "c0", "c1", "c2").applyInArrow(run, f"{STACK} string, {schema}")
    return got if keys else got.drop(STACK)


BLOCK = "plane0 long, y0 long, x0 long, ny long, nx long, v array<double>"


def block(spans: tuple, **values: np.ndarray) -> dict:
    """A chunk of targets as a row of BLOCK, which may have more arrays."""
    (z, _), (y, _), (x, _) = spans
    flat = {n: np.ascontiguousarray(v, np.float64).ravel() for n, v in values.items()}
    shape = next(iter(values.values())).shape
    return {"plane0": [z], "y0": [y], "x0": [x], "ny": [shape[1]], "nx": [shape[2]], **{n: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for n, v in flat.items()}}


def voxels(blocks: DataFrame, *values: str) -> DataFrame:
    """The voxels of rows of BLOCK."""
    keys, values = stack(blocks), values or ("v",)
    d = blocks.select(*keys, "plane0", "y0", "x0", "ny", "nx", F.posexplode(F.arrays_zip(*values)).alias("i", "t"))
    i, area = F.col("i"), F.col("ny") * F.col("nx")
    return d.select(*keys, (F.col("plane0") + F.floor(i / area)).cast("long").alias("plane"), (F.col("y0") + F.floor(i % area / F.col("nx"))).cast("long").alias("y"), (F.col("x0") + i % F.col("nx")).cast("long").alias("x"), *(F.col(f"t.{v}").alias(v) for v in values))


def along(a: np.ndarray, matrices: list[np.ndarray]) -> np.ndarray:
    """Each axis of an array times its matrix. An undefined value makes all undefined that it has a weight in, and nothing else."""
    bad = ~np.isfinite(a)
    holes = bad.any()
    a = np.where(bad, 0.0, a) if holes else a
    for k, w in enumerate(matrices):
        a = np.moveaxis(np.tensordot(w, a, (1, k)), 0, k)
    if holes:
        hit = bad.astype(np.float64)
        for k, w in enumerate(matrices):
            hit = np.moveaxis(np.tensordot((w != 0).astype(np.float64), hit, (1, k)), 0, k)
        a = np.where(hit > 0, np.nan, a)
    return a


def separable(vol: DataFrame, axes: tuple[Axis, Axis, Axis], columns: tuple[str, ...] = (), tops: DataFrame | None = None, sides: tuple[int, int, int] | None = None, every: bool = False) -> DataFrame:
    """The volume after all three axes' operations, in one shuffle. With ``columns`` that differ by plane give ``sides`` of one plane."""

    def kernel(sources: list[np.ndarray], first: tuple, spans: tuple, row: dict) -> dict:
        made = [a.weights(lo, hi, f, f + n - 1, int(row[f"top_{c}"]), row.get(getattr(a, "column", ""))) for a, c, (lo, hi), f, n in zip(axes, AXES, spans, first, sources[0].shape, strict=True)]
        out = along(sources[0], [w for w, _ in made])
        z, y, x = (ok for _, ok in made)
        return block(spans, v=np.where(z[:, None, None] & y[:, None] & x, out, np.nan))

    return voxels(gathered(vol, Layout(axes), kernel, BLOCK, sides or chunk_for(axes), columns, tops, every))


@dataclass(frozen=True)
class Turn:
    """The layout of a volume turned in the plane of axes p and q. ``geometry`` gives, for numbers of rows and columns, cosine, sine, the
    new size, and the offsets of source coordinates (see render.turn())."""

    p: int
    q: int
    geometry: Callable[[int, int], tuple]

    def of(self, top: list[int]) -> tuple:
        return self.geometry(int(top[self.p]) + 1, int(top[self.q]) + 1)

    def reach(self, t: dict) -> Ranges:
        top = np.stack([t[f"top_{a}"] for a in AXES]).astype(np.int64)
        out = [(t[a].copy(), t[a].copy()) for a in AXES]
        for n in np.unique(top, axis=1).T:
            on = (top == n[:, None]).all(0)
            c, s, size, (a, b) = self.of(n)
            u, v = t[AXES[self.p]][on] - a, t[AXES[self.q]][on] - b
            wide = abs(c) + abs(s) + 1e-6
            for k, x, m in ((self.p, c * u - s * v, size[0]), (self.q, s * u + c * v, size[1])):
                out[k][0][on], out[k][1][on] = np.clip(np.floor(x - wide), 0, m - 1), np.clip(np.ceil(x + wide), 0, m - 1)
        return out

    def boxes(self, spans: tuple, top: list[int], row: dict) -> list[tuple[int, int]]:
        c, s, _, (a, b) = self.of(top)
        out = list(spans)
        i, j = np.meshgrid(spans[self.p], spans[self.q])
        for k, x in ((self.p, c * i + s * j + a), (self.q, c * j - s * i + b)):
            out[k] = max(0, int(np.floor(x.min())) - 1), min(top[k], int(np.ceil(x.max())) + 1)
        return out

    def lasts(self, top: list[int]) -> list[int]:
        out = list(top)
        out[self.p], out[self.q] = (n - 1 for n in self.of(top)[2])
        return out


def turned(vol: DataFrame, axes: tuple[str, str], nearest: bool, geometry: Callable[[int, int], tuple], tops: DataFrame | None = None, sides: tuple[int, int, int] | None = None) -> DataFrame:
    """The volume turned in the plane of two axes, by bilinear interpolation or the nearest voxel; 0 where the source lies outside, and for the nearest one where it is missing."""
    p, q = (AXES.index(a) for a in axes)
    layout = Turn(p, q, geometry)

    def kernel(sources: list[np.ndarray], first: tuple, spans: tuple, row: dict) -> dict:
        top = [int(row[f"top_{a}"]) for a in AXES]
        c, s, _, (a, b) = layout.of(top)
        i, j = (np.arange(lo, hi + 1) for lo, hi in (spans[p], spans[q]))
        i, j = np.meshgrid(i, j, indexing="ij")
        u, v = np.round(c * i + s * j + a, 9), np.round(c * j - s * i + b, 9)
        ok = (u >= 0) & (u <= top[p]) & (v >= 0) & (v <= top[q])
        u, v = np.where(ok, u - first[p], 0), np.where(ok, v - first[q], 0)
        image = np.moveaxis(sources[0], (p, q), (1, 2))
        out = np.zeros((len(image), *ok.shape))
        if nearest and ok.any():
            y, x = (np.minimum(np.floor(w + 0.5).astype(int), n - 1) for w, n in ((u, image.shape[1]), (v, image.shape[2])))
            out = np.where(ok, image[:, y, x], 0.0)
        elif ok.any():
            y, x = np.floor(u).astype(int), np.floor(v).astype(int)
            y1, x1 = np.minimum(y + 1, image.shape[1] - 1), np.minimum(x + 1, image.shape[2] - 1)
            fy, fx = u - y, v - x
            for w, r, k in (((1 - fy) * (1 - fx), y, x), ((1 - fy) * fx, y, x1), (fy * (1 - fx), y1, x), (fy * fx, y1, x1)):
                w = w * ok
                out += np.where(w > 0, w * image[:, r, k], 0.0)
        return block(spans, v=np.moveaxis(out, (1, 2), (p, q)))

    return voxels(gathered(vol, layout, kernel, BLOCK, sides or chunk_for((Same(2),) * 3), (), tops, every=True, fill=0.0 if nearest else np.nan))


#: Sides of chunks that hold all planes of a few pixels.
COLUMN = (1 << 40, 64, 64)


def composed(vol: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(scan_id, y, x, v): what ``f`` makes of all planes (axis 0, front first) of each pixel; a missing voxel counts as 0."""

    def kernel(sources: list[np.ndarray], first: tuple, spans: tuple, row: dict) -> dict:
        return block(((0, 0), *spans[1:]), v=f(sources[0])[None])

    return voxels(gathered(vol, Layout((Same(), Same(), Same())), kernel, BLOCK, COLUMN, fill=0.0)).drop("plane")


def moments(vol: DataFrame, most: int) -> DataFrame:
    """scan_id, plane_a, plane_b, lag, and sums over the pixels that are finite in both, of pairs of planes up to ``most`` apart.

    A task takes some pixels of all planes and gives the band of their Gram matrix, so only sums are shuffled after that. Sums are of values less
    the stack's mean, which keeps digits where it is large.
    """
    keys, names = stack(vol), ("n", "sa", "sb", "saa", "sbb", "sab")
    v = F.when(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != float("inf")), F.col("v"))
    tops = vol.groupBy(*keys).agg(*(F.max(c).alias(f"top_{c}") for c in AXES), F.coalesce(F.avg(v), F.lit(0.0)).alias("base"))

    def kernel(sources: list[np.ndarray], first: tuple, spans: tuple, row: dict) -> dict:
        a = sources[0].reshape(len(sources[0]), -1)
        there = (a != -np.inf).any(1)
        ok = np.isfinite(a)
        x, m = np.where(ok, a - row["base"], 0.0), ok.astype(np.float64)
        out: dict = {"plane_a": [], "plane_b": [], **{n: [] for n in names}}
        for s in range(0, len(a), 128):
            i, j = slice(s, s + 128), slice(s, s + 128 + most)
            grams = (m[i] @ m[j].T, x[i] @ m[j].T, m[i] @ x[j].T, (x[i] ** 2) @ m[j].T, m[i] @ (x[j] ** 2).T, x[i] @ x[j].T)
            p, q = np.indices(grams[0].shape)
            on = (q > p) & (q - p <= most) & there[i][:, None] & there[j][None]
            for n, g in zip(("plane_a", "plane_b", *names), (p + s, q + s, *grams), strict=True):
                out[n].append(g[on])
        return {n: np.concatenate(g) for n, g in out.items()}

    got = gathered(vol, Layout((Same(), Same(), Same())), kernel, "plane_a long, plane_b long, " + ", ".join(f"{n} double" for n in names), COLUMN, tops=tops, fill=-np.inf)
    return got.groupBy(*keys, "plane_a", "plane_b").agg(*(F.sum(n).alias(n) for n in names)).withColumn("lag", F.col("plane_b") - F.col("plane_a"))


def band_pass(vol: DataFrame, feature: tuple[float, float, float], background: tuple[float, float, float], difference: bool = True) -> DataFrame:
    """scan_id, plane, y, x, v, f in one shuffle: f is the volume less its smoothed background, smoothed; with ``difference`` off, the smoothed one less the background."""
    fine, wide = tuple(blur(s) for s in feature), tuple(blur(s) for s in background)
    axes = tuple(Same(a.halo + b.halo if difference else max(a.halo, b.halo)) for a, b in zip(fine, wide, strict=True))

    def kernel(sources: list[np.ndarray], first: tuple, spans: tuple, row: dict) -> dict:
        (v,), top = sources, [int(row[f"top_{c}"]) for c in AXES]
        at = [(f, f + n - 1) for f, n in zip(first, v.shape, strict=True)]
        within = [a.box(*s, n, None) for a, s, n in zip(fine, spans, top, strict=True)] if difference else list(spans)
        smooth = lambda x, blurs, to, of: along(x, [b.weights(*t, *o, n, None)[0] for b, t, o, n in zip(blurs, to, of, top, strict=True)])
        cut = lambda x, of, to: x[tuple(slice(lo - f, hi - f + 1) for (f, _), (lo, hi) in zip(of, to, strict=True))]
        back = smooth(v, wide, within, at)
        f = smooth(cut(v, at, within) - back, fine, spans, within) if difference else smooth(v, fine, spans, at) - back
        return block(spans, v=cut(v, at, spans), f=f)

    return voxels(gathered(vol, Layout(axes), kernel, BLOCK + ", f array<double>", chunk_for(axes)), "v", "f")


def _running(a: np.ndarray, before: int, after: int) -> np.ndarray:
    """Maxima along the last axis over the window from ``before`` items back to ``after`` items on, both inclusive, by doubling; the array's ends count as -inf."""
    n, size = a.shape[-1], before + after + 1
    if size <= 0:
        return np.full(a.shape, -np.inf)
    m = np.full((*a.shape[:-1], n + size - 1), -np.inf)
    to, of = max(0, before), max(0, -before)
    some = min(n - of, n + size - 1 - to)
    if some > 0:
        m[..., to : to + some] = a[..., of : of + some]
    width = 1
    while 2 * width <= size:
        m = np.maximum(m[..., :-width], m[..., width:])
        width *= 2
    if width < size:
        m = np.maximum(m[..., : n], m[..., size - width : size - width + n])
    return m[..., :n]


def rows_of(offsets: list[tuple[int, int, int]]) -> dict[tuple[int, int], int]:
    """Half length along x of each row (dz, dy) of a footprint whose rows are whole and centred."""
    out: dict[tuple[int, int], int] = {}
    for z, y, x in offsets:
        out[z, y] = max(out.get((z, y), 0), abs(x))
    if len(offsets) != sum(2 * n + 1 for n in out.values()) - ((0, 0) in out):
        raise ValueError("the footprint's rows have holes or are not centred")
    return out


def maxima(f: DataFrame, offsets: list[tuple[int, int, int]]) -> DataFrame:
    """The voxels (scan_id, plane, y, x, v, f) that no voxel at any of the offsets beats: by a larger f, or by an equal one that comes first in order of plane, y, x.

    A footprint is taken row by row: running maxima along x, one for each length of a row, are shifted and combined.
    """
    rows = rows_of(offsets)
    rows.setdefault((0, 0), 0)
    halo = [max((abs(o[k]) for o in offsets), default=0) for k in range(3)]
    axes = tuple(Same(h) for h in halo)

    def kernel(sources: list[np.ndarray], first: tuple, spans: tuple, row: dict) -> dict:
        v, f = sources
        own = [slice(lo - a, hi - a + 1) for (lo, hi), a in zip(spans, first, strict=True)]
        padded = np.full([hi - lo + 1 + 2 * h for (lo, hi), h in zip(spans, halo, strict=True)], -np.inf)
        at = [a - lo + h for a, (lo, _), h in zip(first, spans, halo, strict=True)]
        padded[tuple(slice(k, k + n) for k, n in zip(at, f.shape, strict=True))] = np.where(np.isnan(f), -np.inf, f)
        z, y, x = (hi - lo + 1 for lo, hi in spans)
        mine = padded[halo[0] : halo[0] + z, halo[1] : halo[1] + y, halo[2] : halo[2] + x]
        earlier, later = np.full(mine.shape, -np.inf), np.full(mine.shape, -np.inf)
        for length in sorted(set(rows.values())):
            run = _running(padded, length, length)
            for (dz, dy), n in rows.items():
                if n == length and (dz, dy) != (0, 0):
                    side = earlier if (dz, dy) < (0, 0) else later
                    np.maximum(side, run[halo[0] + dz : halo[0] + dz + z, halo[1] + dy : halo[1] + dy + y, halo[2] : halo[2] + x], out=side)
        line = padded[halo[0] : halo[0] + z, halo[1] : halo[1] + y]
        n = rows[0, 0]
        if n:
            np.maximum(earlier, _running(line, n, -1)[..., halo[2] : halo[2] + x], out=earlier)
            np.maximum(later, _running(line, -1, n)[..., halo[2] : halo[2] + x], out=later)
        best = np.nonzero((mine > earlier) & (mine >= later))
        return {**{c: k + lo for c, k, (lo, _) in zip(AXES, best, spans, strict=True)}, "v": v[tuple(own)][best], "f": mine[best]}

    return gathered(f, Layout(axes), kernel, "plane long, y long, x long, v double, f double", chunk_for(axes), values=("v", "f"))
