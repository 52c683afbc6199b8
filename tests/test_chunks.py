"""Chunks with halos against slow versions over whole arrays: small chunks, so that every halo is used, and stacks of several shapes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackloom.operators import chunks, render, volume

SHAPES = {"a": (5, 7, 6), "b": (3, 9, 11), "c": (1, 1, 4)}


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK", (2, 3, 4))
    monkeypatch.setattr(chunks, "COLUMN", (1 << 40, 3, 4))
    monkeypatch.setattr(chunks, "PACK", 50)


def arrays(seed=1, kind="normal"):
    r = np.random.default_rng(seed)
    return {k: r.normal(size=s) if kind == "normal" else r.integers(0, 4, s).astype(float) for k, s in SHAPES.items()}


def rows(spark, volumes, **of_stack):
    out = [(k, *map(int, i), float(v), *(float(c[k]) for c in of_stack.values())) for k, a in volumes.items() for i, v in np.ndenumerate(a)]
    return spark.createDataFrame(out, ", ".join(["scan_id string, plane long, y long, x long, v double", *(f"{c} double" for c in of_stack)])).repartition(3)


def back(df, shapes, name="v"):
    out = {k: np.full(s, -99.0) for k, s in shapes.items()}
    for r in df.collect():
        at = r["scan_id"], (r["plane"], r["y"], r["x"])
        assert out[at[0]][at[1]] == -99.0
        out[at[0]][at[1]] = r[name]
    return out


def equal(got, want):
    assert got.keys() == want.keys()
    for k in want:
        assert np.allclose(got[k], want[k], equal_nan=True, atol=1e-9), k


def blurred(a, sigmas, radius=None):
    for axis, s in enumerate(sigmas):
        r = int(4 * s + 0.5) if radius is None else radius
        w = np.exp(-0.5 * (np.arange(-r, r + 1) / s) ** 2)
        at = [np.clip(np.arange(a.shape[axis]) + o, 0, a.shape[axis] - 1) for o in range(-r, r + 1)]
        a = sum(k * np.take(a, i, axis) for k, i in zip(w / w.sum(), at, strict=True))
    return a


def test_gaussian(spark, small):
    v = arrays()
    equal(back(volume.gaussian(rows(spark, v), (0.6, 1.1, 0.4)), SHAPES), {k: blurred(a, (0.6, 1.1, 0.4)) for k, a in v.items()})
    equal(back(volume.gaussian(rows(spark, v), 1.5, 2), SHAPES), {k: blurred(a, (1.5,) * 3, 2) for k, a in v.items()})
    holes = {"a": v["a"].copy()}
    holes["a"][2, 3, 3] = np.nan
    got = back(volume.gaussian(rows(spark, holes), (0.3, 0.3, 0.3), 1), {"a": SHAPES["a"]})["a"]
    assert np.isnan(got).sum() == 27 and np.isfinite(got[0]).all()


def slow_linear(a, source):
    """Multilinear interpolation at sources (one array of coordinates an axis); NaN outside."""
    out = a
    for axis, s in enumerate(source):
        n = a.shape[axis]
        ok = (s >= 0) & (s <= n - 1)
        f = np.floor(np.where(ok, s, 0)).astype(int)
        w = np.where(ok, s, 0) - f
        shape = [-1 if k == axis else 1 for k in range(3)]
        out = np.take(out, f, axis) * (1 - w).reshape(shape) + np.take(out, np.minimum(f + 1, n - 1), axis) * w.reshape(shape)
        out = np.where(ok.reshape(shape), out, np.nan)
    return out


@pytest.mark.parametrize("shape", [(5, 5, 6), (9, 2, 13), (1, 1, 1)])
def test_resample(spark, small, shape):
    v = arrays()
    want = {k: slow_linear(a, [np.arange(n) * ((m - 1) / max(1, n - 1)) for n, m in zip(shape, a.shape, strict=True)]) for k, a in v.items()}
    equal(back(volume.resample(rows(spark, v), shape), dict.fromkeys(SHAPES, shape)), want)


@pytest.mark.parametrize("nearest", [False, True])
def test_move_by_plane_and_stack(spark, small, nearest):
    v = arrays()
    d = rows(spark, v).withColumns({"dy": F.col("plane") * 0.7 - 1, "dx": F.when(F.col("scan_id") == "a", 1.25).otherwise(-20.5)})
    want = {}
    for k, a in v.items():
        by = lambda z: (z * 0.7 - 1, 1.25 if k == "a" else -20.5)  # noqa: B023, E731
        src = lambda n, b: np.clip(np.arange(n) - b, 0, n - 1) if nearest else np.arange(n) - b
        want[k] = np.concatenate([slow_linear(a[z : z + 1], [np.zeros(1), src(a.shape[1], by(z)[0]), src(a.shape[2], by(z)[1])]) for z in range(a.shape[0])])
    equal(back(volume.move(d, F.col("dy"), F.col("dx"), nearest=nearest), SHAPES), want)


def test_move3(spark, small):
    v = arrays()
    shifts = spark.createDataFrame([("a", 0.5, -1.25, 2.0), ("b", -1.0, 0.0, 3.3), ("c", 0.0, 0.0, 0.5)], "scan_id string, dz double, dy double, dx double")
    by = {r["scan_id"]: (r["dz"], r["dy"], r["dx"]) for r in shifts.collect()}
    equal(back(volume.move3(rows(spark, v), shifts), SHAPES), {k: slow_linear(a, [np.arange(n) - b for n, b in zip(a.shape, by[k], strict=True)]) for k, a in v.items()})


def recursive_spline(line, s):
    """Cubic B-spline at sources s by the causal and anticausal recursion, mirrored at the ends."""
    n, pole = len(line), np.sqrt(3) - 2
    full = np.concatenate((line, line[-2:0:-1])) if n > 1 else line
    c = np.array([sum(full[(i - k) % len(full)] * pole**k for k in range(80)) for i in range(n)])
    out = np.empty(n)
    out[-1] = pole / (pole**2 - 1) * (c[-1] + pole * c[-2])
    for i in range(n - 2, -1, -1):
        out[i] = pole * (out[i + 1] - c[i])
    out *= 6
    mirror = lambda j: (2 * (n - 1) - j % (2 * (n - 1))) if j % (2 * (n - 1)) > n - 1 else j % (2 * (n - 1))
    beta = lambda x: (2 / 3 - x * x + abs(x) ** 3 / 2) if abs(x) < 1 else (2 - abs(x)) ** 3 / 6 if abs(x) < 2 else 0.0
    return np.array([sum(out[mirror(j)] * beta(t - j) for j in range(int(np.floor(t)) - 1, int(np.floor(t)) + 3)) if 0 <= t <= n - 1 else np.nan for t in s])


def test_cubic_splines_equal_the_recursion(spark, small):
    v = {"a": np.random.default_rng(4).normal(size=(2, 1, 70)), "b": np.random.default_rng(5).normal(size=(1, 12, 2))}
    d = rows(spark, v).withColumns({"dy": F.when(F.col("scan_id") == "b", 0.4).otherwise(0.0), "dx": F.when(F.col("scan_id") == "a", -2.3).otherwise(0.0)})
    got = back(volume.move(d, F.col("dy"), F.col("dx"), order=3), {k: a.shape for k, a in v.items()})
    want = {"a": np.stack([[recursive_spline(p[0], np.arange(70) + 2.3)] for p in v["a"]]), "b": np.stack([recursive_spline(v["b"][0, :, k], np.arange(12) - 0.4) for k in range(2)], 1)[None]}
    equal(got, want)


@pytest.mark.parametrize("order", [0, 1, 2, 3, 4, 5])
def test_splines_pass_through_their_samples_and_keep_polynomials(order):
    top = 200
    axis = chunks.Shifted(order, "d")
    f = np.polyval([1e-4, -0.01, 0.3, 2.0][-order - 1 if order < 3 else 0 :], np.arange(top + 1))
    for by in (0.0, 3.0, 0.37):
        lo, hi = 80, 110
        first, last = axis.box(lo, hi, top, by)
        w, ok = axis.weights(lo, hi, first, last, top, by)
        got = w @ f[first : last + 1]
        t = np.arange(lo, hi + 1) - by
        want = f[np.floor(t + 0.5).astype(int)] if order == 0 else np.polyval([1e-4, -0.01, 0.3, 2.0][-order - 1 if order < 3 else 0 :], t)
        assert ok.all() and np.allclose(got, want, atol=1e-6), (order, by)


def test_views_turn_each_stack_by_its_own_shape(spark, small):
    v = arrays()
    both = render.rotate(rows(spark, v), 30.0)
    for k, a in v.items():
        one = render.rotate(rows(spark, {k: a}).drop("scan_id"), 30.0)
        want = {(r["plane"], r["y"], r["x"]): r["v"] for r in one.collect()}
        got = {(r["plane"], r["y"], r["x"]): r["v"] for r in both.where(F.col("scan_id") == k).collect()}
        assert got.keys() == want.keys() and len(got) == np.prod(render.turned_shape(a.shape, 30.0))
        assert all(np.isclose(got[i], want[i]) for i in got)


def test_composites(spark, small):
    v = {k: np.abs(a) for k, a in arrays().items()}
    front = lambda a: np.cumsum(a, 0) - a
    flat = lambda df: back(df.withColumn("plane", F.lit(0)), {k: (1, *s[1:]) for k, s in SHAPES.items()})
    equal(flat(volume.attenuated_mip(rows(spark, v), 0.6)), {k: (a * np.exp(-0.6 * front(a))).max(0)[None] for k, a in v.items()})
    equal(flat(volume.alpha_composite(rows(spark, v), 0.2)), {k: (np.exp(-0.2 * front(a)) * (1 - np.exp(-0.2 * a)) * a).sum(0)[None] for k, a in v.items()})


def test_lag_correlation(spark, small):
    v = arrays()
    v["a"][1, 2, 2], v["a"][3, 0, 0] = np.nan, np.inf
    v["a"][4] = 7.0
    v["b"] += 1e6
    d = rows(spark, v).where("not (scan_id = 'b' and plane = 1)")
    got = {(r["scan_id"], r["plane_a"], r["plane_b"]): r["corr"] for r in volume.lag_correlation(d, 2).collect()}
    want = {}
    for k, a in v.items():
        planes = [z for z in range(len(a)) if (k, z) != ("b", 1)]
        for p in planes:
            for q in planes:
                if 0 < q - p <= 2:
                    ok = np.isfinite(a[p]) & np.isfinite(a[q])
                    x, y = a[p][ok], a[q][ok]
                    want[k, p, q] = np.corrcoef(x, y)[0, 1] if x.std() > 0 and y.std() > 0 else np.nan
    assert got.keys() == want.keys()
    assert all(np.isclose(got[k], want[k], equal_nan=True, atol=1e-7) for k in want)
    assert np.isnan(got["a", 3, 4]) and ("b", 0, 2) in got


@pytest.mark.parametrize("offsets", [volume.footprint(2.0, (1.0, 0.7, 0.9)), [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)], volume.footprint(1.0, (9.0, 9.0, 0.5)), []])
def test_maxima(spark, small, offsets):
    v = arrays(3, "few values, many ties")
    v["b"][0, 0, 0] = np.nan
    d = rows(spark, v).select("*", F.col("v").alias("f")).withColumn("v", F.col("f") * 2)
    want = set()
    for k, a in v.items():
        for i in np.ndindex(*a.shape):
            near = [tuple(np.add(i, o)) for o in offsets]
            near = [(a[n], n) for n in near if all(0 <= c < s for c, s in zip(n, a.shape, strict=True)) and not np.isnan(a[n])]
            if not np.isnan(a[i]) and not any(g > a[i] or (g == a[i] and n < i) for g, n in near):
                want.add((k, *i, a[i] * 2, a[i]))
    assert {tuple(r) for r in chunks.maxima(d, offsets).select("scan_id", "plane", "y", "x", "v", "f").collect()} == want


def test_band_pass_and_chunk_sizes(spark, small):
    v = arrays()
    got = chunks.band_pass(rows(spark, v), (0.3, 0.5, 0.5), (0.7, 1.0, 1.2))
    equal(back(got, SHAPES, "f"), {k: blurred(a - blurred(a, (0.7, 1.0, 1.2)), (0.3, 0.5, 0.5)) for k, a in v.items()})
    equal(back(got, SHAPES), v)
    got = chunks.band_pass(rows(spark, v), (0.3,) * 3, (0.8,) * 3, difference=False)
    equal(back(got, SHAPES, "f"), {k: blurred(a, (0.3,) * 3) - blurred(a, (0.8,) * 3) for k, a in v.items()})


def test_chunks_of_large_halos_send_little():
    """Sigmas of 5, 12 and 12 um at 2, 0.91 and 0.91 um: a volume of 100 x 512 x 512 is sent less than twice."""
    axes = tuple(chunks.blur(s / d) for s, d in zip((5, 12, 12), (2, 0.9104, 0.9104), strict=True))
    sides = chunks.chunk_for(axes)
    sent = 1.0
    for n, side, a in zip((100, 512, 512), sides, axes, strict=True):
        sent *= sum(len(range(max(0, lo - a.halo), min(n, lo + side + a.halo))) for lo in range(0, n, side)) / n
    assert sent < 2 and np.prod([s + 2 * a.halo for s, a in zip(sides, axes, strict=True)]) <= chunks.MOST
