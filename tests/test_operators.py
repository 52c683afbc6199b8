"""Small cases with known results for operators of the image stack and its records."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackloom.functions import scalar, stats
from stackloom.operators import features, gates, provenance, recon, register, render, synthetic, volume
from stackloom.sources import io
from stackloom.streaming import ingest


def frames(spark, images, plane=0, scan="s"):
    return spark.createDataFrame([(scan, plane, i, im.shape[1], [float(v) for v in im.ravel()]) for i, im in enumerate(images)], "scan_id string, plane long, local_index long, width int, pixels array<float>")


def vol(spark, a):
    return spark.createDataFrame([(*map(int, i), float(v)) for i, v in np.ndenumerate(a)], "plane long, y long, x long, v double")


def grid(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["plane"], r["y"], r["x"]] = r["v"]
    return out


def blob(n, dy=0.0, dx=0.0):
    y, x = np.indices((n, n))
    return sum(a * np.exp(-((y - cy - dy) ** 2 + (x - cx - dx) ** 2) / 18) for a, cy, cx in ((100, n * 0.35, n * 0.4), (60, n * 0.65, n * 0.6)))


def test_median_ignores_displaced_frames_and_mean_does_not(spark):
    im = np.zeros((12, 12))
    im[4:8, 4:8] = 10
    stack = [im] * 7 + [np.roll(im, 4, 0)] * 2
    v = frames(spark, stack)
    assert np.array_equal(grid(recon.median_volume(v), (1, 12, 12))[0], im)
    assert not np.array_equal(grid(recon.mean_volume(v), (1, 12, 12))[0], im)


def test_constant_images_have_undefined_correlation(spark):
    f = recon.frame_statistics(frames(spark, [np.ones((2, 2))] * 3))
    assert all(np.isnan(r["corr"]) for r in f.collect())


def test_nan_statistics(spark):
    d = spark.createDataFrame([(1, float("nan")), (1, 2.0), (2, float("nan"))], "k int, v double")
    got = {r["k"]: (r["a"], r["m"]) for r in d.groupBy("k").agg(stats.nan_avg(F.col("v")).alias("a"), stats.nan_max(F.col("v")).alias("m")).collect()}
    assert got[1] == (2.0, 2.0) and all(np.isnan(x) for x in got[2])
    b = {r["k"]: r for r in stats.robust_bounds(d, ["k"], "v", 3).collect()}
    assert b[2]["lower"] == np.inf and b[2]["upper"] == -np.inf


def test_longest_run(spark):
    d = spark.createDataFrame([(0, i, f) for i, f in enumerate([False, True, True, False, True])] + [(1, 0, False)], "k int, i int, f boolean")
    assert {r["k"]: r["longest_run"] for r in stats.longest_run(d, ["k"], ["i"], "f").collect()} == {0: 2, 1: 0}


def test_projections(spark):
    a = np.zeros((4, 3, 2))
    a[0] = 8
    got = {(r["name"], r["i"], r["j"]): r for r in volume.projections(vol(spark, a)).collect()}
    assert got["xy", 0, 0]["mean"] == 2 and got["xy", 2, 1]["max"] == 8 and got["xz", 1, 0]["max"] == 0
    assert len(got) == 6 + 8 + 12


@pytest.mark.parametrize("zs,step,status", [(range(5), 1, "pass"), (range(0, 10, 2), 2, "pass"), ((0, 1, 2.2), 1, "fail"), ((0,), 1, "fail"), ((2, 1, 0), 1, "fail")])
def test_z_geometry(spark, zs, step, status):
    d = spark.createDataFrame([(0, i, float(z)) for i, z in enumerate(zs)], "k int, i int, z double")
    assert gates.z_geometry(d, ["k"], "i", "z", step).first()["status"] == status


@pytest.mark.parametrize("zs,status", [((0, 0, 0, 1, 1, 1), "pass"), ((0, 1, 0, 1, 0, 1), "fail"), ((0, 0, 0, 1, 1), "fail")])
def test_page_grouping(spark, zs, status):
    d = spark.createDataFrame([(0, i, float(z)) for i, z in enumerate(zs)], "k int, i int, z double")
    assert gates.page_grouping(d, ["k"], "i", "z", 3).first()["status"] == status


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    lit = F.lit
    ints = lambda *v: F.array(*(lit(x).cast("long") for x in v))
    assert value(scalar.collapse_positions(F.array(*(lit(x) for x in (0.0, 0.0, 0.6e-6, 1.2e-6, 1.0, 1.0))))) == [0, 1.2e-6, 1]
    assert [value(scalar.stored_frames(lit(60), lit(f))) for f in (1, 60, 7)] == [60, 1, None]
    assert value(scalar.page_index(lit(17), lit(2), lit(1))) == 35
    assert value(scalar.resolve_channel(ints(3, 4), lit(4).cast("long"))) == 1
    assert value(scalar.resolve_channel(ints(3, 4), lit(None).cast("long"))) is None
    assert value(scalar.resolve_channel(ints(3), lit(None).cast("long"))) == 0
    assert value(scalar.resolve_offsets(ints(0, 25, 50, 75, 99), lit(60), lit(100))) == [0, 15, 30, 45, 59]
    assert value(scalar.odd_slab(lit(6.0), lit(1.2))) == 5
    assert value(scalar.normalize_setup(lit("My-BENCH_2P rig"))) == "bench2p"
    assert [value(scalar.positive_int(lit(x))) for x in ("2.5", "3.5", "-1", "x")] == [2, 4, None, None]
    assert [value(scalar.safe_relative(lit(p))) for p in ("a/b", "/a", "a/../b", "..x")] == [True, False, False, True]


def test_merge_averages_the_shared_plane(spark):
    a, b = np.ones((3, 2, 2)), np.full((3, 2, 2), 5.0)
    got = grid(volume.merge(vol(spark, a), vol(spark, b).withColumn("plane", F.col("plane") + 2)), (5, 2, 2))
    assert got[:, 0, 0].tolist() == [1, 1, 3, 5, 5]


def test_bright_candidate(spark):
    a = np.zeros((9, 12, 12))
    a[4, 6, 7] = 100
    got = volume.candidates(vol(spark, a), 0.99, 3).collect()
    assert [(r["plane"], r["y"], r["x"]) for r in got] == [(4, 6, 7)] and got[0]["candidate_id"] == "candidate_01" and got[0]["source_intensity"] == 100
    # spacing 2 µm in Z: a weaker spot 2 planes off lies outside of an ellipsoid of 3 µm, one 4 columns off (0.5 µm each) inside
    a[6, 6, 7], a[4, 6, 11] = 60, 50
    got = volume.candidates(vol(spark, np.pad(a, ((2, 2), (2, 2), (2, 4)))), 0.9, 5, (2.0, 0.5, 0.5), (0.5, 0.2, 0.2), (6.0, 3.0, 3.0), 3.0, (1.0, 0.5, 0.5)).collect()
    assert [(r["plane"], r["y"], r["x"]) for r in got][:2] == [(6, 8, 9), (8, 8, 9)] and (6, 8, 13) not in {(r["plane"], r["y"], r["x"]) for r in got}
    assert got[0]["z_relative_um"] == 12 and got[0]["y_um"] == 4 and got[0]["x_um"] == 4.5
    assert volume.half_widths((1.0, 2.5, 0.1), (1.0, 1.0, 1.0)) == (1, 2, 1)


def test_phase_shift_whole_and_fraction():
    im = np.random.default_rng(0).random((32, 32))
    shift, error = register.phase_shift(im, np.roll(im, (3, -2), (0, 1)), 10)
    assert np.allclose(shift, (-3, 2)) and error < 1e-3
    shift, _ = register.phase_shift(blob(64), blob(64, 1.3, -2.6), 10)
    assert np.abs(shift - (-1.3, 2.6)).max() < 0.35
    a = np.random.default_rng(1).random((6, 16, 16))
    assert np.allclose(register.phase_shift(a, np.roll(a, (1, -2, 3), (0, 1, 2)))[0], (-1, 2, -3))


def test_outlier_is_rejected_and_brightness_is_not(spark):
    images = [blob(48, 0.2 * (i % 3), -0.2 * (i % 2)) * (2 if i == 4 else 1) for i in range(11)] + [blob(48, 13, 0)]
    kept = {r["local_index"]: r for r in register.registration_keep(register.frame_shifts(frames(spark, images), condition=None)).collect()}
    assert not kept[11]["keep"] and register.SHIFT in kept[11]["reasons"] and kept[4]["keep"]


def test_undefined_correlation_is_never_kept(spark):
    """A constant frame has no correlation: both filters drop it, with no reason, unless too few others pass."""
    images = [blob(24, 0.1 * i, 0) for i in range(6)] + [np.full((24, 24), 7.0)]
    kept = {r["local_index"]: r["keep"] for r in recon.kept_frames(recon.frame_statistics(frames(spark, images)), 1000.0).collect()}
    assert kept == {**dict.fromkeys(range(6), True), 6: False}
    shifts = register.frame_shifts(frames(spark, images), condition=None)
    r = {r["local_index"]: r for r in register.registration_keep(shifts, corr_k=1000.0, error_k=1000.0, gain=-2.0).collect()}
    assert [r[i]["keep"] for i in range(7)] == [True] * 6 + [False] and register.CORRELATION not in r[6]["reasons"] and register.GAIN not in r[6]["reasons"]
    ranked = {r["local_index"]: r["rank"] for r in recon.kept_frames(recon.frame_statistics(frames(spark, images)), -1000.0).collect()}
    assert ranked[6] == 7


def test_the_floor_keeps_the_best_with_their_reasons(spark):
    rows = [("s", 0, i, 0.0, 0.0, 0.1, 0.9, 0.1 * i) for i in range(10)]
    d = spark.createDataFrame(rows, "scan_id string, plane long, local_index long, dy double, dx double, error double, corr_before double, corr_after double")
    got = {r["local_index"]: r for r in register.registration_keep(d, gain=0.5).collect()}
    assert {i for i, r in got.items() if r["keep"]} == {7, 8, 9} and all(r["relaxed"] and register.GAIN in r["reasons"] for r in got.values())


def test_cross_plane_drift_is_recovered_and_applied(spark):
    a = np.stack([blob(32, i * 1.0, i * -0.5) for i in range(6)])
    v = vol(spark, a).withColumn("scan_id", F.lit("s"))
    got = sorted((r["plane"], r["cum_dy"], r["cum_dx"]) for r in register.cross_plane(v, k=50.0).collect())
    assert len(got) == 5 and all(abs(dy + p) < 0.15 + 0.1 * p and abs(dx - p / 2) < 0.15 + 0.1 * p for p, dy, dx in got)
    c = grid(register.corrected(v, k=50.0), (6, 32, 32))
    assert np.abs(c[5, 8:-8, 8:-8] - a[0, 8:-8, 8:-8]).max() < 0.3 * np.abs(a[5, 8:-8, 8:-8] - a[0, 8:-8, 8:-8]).max()


def test_boundary_of_two_stacks(spark):
    one = vol(spark, np.stack([blob(32, 0, 0)] * 3)).withColumn("scan_id", F.lit("s"))
    two = vol(spark, np.stack([blob(32, 2, 1)] * 3)).withColumn("scan_id", F.lit("s"))
    z = lambda start: spark.createDataFrame([("s", i, start + 2.0 * i) for i in range(3)], "scan_id string, plane long, z_um double")
    shift = register.boundary_shift(one, two)
    r = shift.first()
    assert (r["dy"], r["dx"]) == pytest.approx((-2, -1), abs=0.15) and r["corr_after"] > r["corr_before"]
    m = volume.merge_adjacent(one, two, (z(0.0), z(4.0)), shift, 1e-6, 5.0)
    assert {(x["plane"], x["z_um"]) for x in m.select("plane", "z_um").distinct().collect()} == {(i, 2.0 * i) for i in range(5)}
    with pytest.raises(Exception, match="do not overlap"):
        volume.merge_adjacent(one, two, (z(0.0), z(4.1)), shift, 1e-6, 5.0).count()
    with pytest.raises(Exception, match="too long"):
        volume.merge_adjacent(one, two, (z(0.0), z(4.0)), shift, 1e-6, 1.0).count()


def test_registered_means_and_their_summary(spark):
    f = frames(spark, [blob(24, 2 * (i % 2), 0) for i in range(6)])
    kept = register.registration_keep(register.frame_shifts(f, condition=None, updates=2), corr_k=100.0, error_k=100.0)
    legacy = recon.kept_frames(recon.frame_statistics(f))
    m = register.plane_methods(f, kept, legacy)
    assert {r["method"]: r["count"] for r in m.groupBy("method").count().collect()} == dict.fromkeys("ABCD", 576)
    s = register.plane_summary(kept, legacy, m).first()
    assert s["frames"] == 6 and s["kept"] == 6 and s["longest_rejected"] == 0 and s["sharpness_C"] > s["sharpness_A"]


def test_two_scans_at_once_equal_the_single_ones(spark):
    rng = np.random.default_rng(5)
    a = [frames(spark, list(rng.random((7, 6, 5))), p, "a") for p in range(2)]
    b = [frames(spark, list(rng.random((4, 6, 5))), p, "b") for p in range(2)]
    join = lambda x: x[0].unionByName(x[1])
    both = join(a).unionByName(join(b))
    for f in (recon.median_volume, recon.mean_volume, recon.frame_qc, recon.plane_qc, recon.filtered_mean, lambda d: register.frame_shifts(d, condition=None)):
        want = sorted(map(str, [*f(join(a)).collect(), *f(join(b)).collect()]))
        assert sorted(map(str, f(both).collect())) == want


def test_tiles_of_any_size_give_the_same(spark, monkeypatch):
    f = frames(spark, list(np.random.default_rng(6).normal(1e3, 1e-2, (9, 7, 11))))
    whole = sorted(map(str, recon.median_volume(f).collect()))
    images = [np.asarray(r["pixels"]).reshape(7, 11) for r in f.orderBy("local_index").collect()]
    want = {i: register.correlation(np.median(images, 0), m) for i, m in enumerate(images)}
    for size in (10, 4096):
        monkeypatch.setattr(recon, "TILE", size)
        assert sorted(map(str, recon.median_volume(f).collect())) == whole
        got = {r["local_index"]: r["corr"] for r in recon.frame_statistics(f).collect()}
        assert all(abs(got[i] - want[i]) < 1e-6 for i in want)
    monkeypatch.setattr(recon, "HELD", 9)
    assert recon.tile_size(f) == 1


def test_quantiles_and_runs_of_large_groups(spark):
    rng = np.random.default_rng(8)
    rows = [(int(k), float(v)) for k, v in zip(rng.integers(0, 3, 5000), np.round(rng.exponential(2, 5000), 2), strict=True)] + [(0, float("nan")), (1, float("inf")), (3, 5.0)]
    d = spark.createDataFrame(rows, "k int, v double")
    ps = {"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.998, "e": 1.0}
    want = {k: np.quantile([v for i, v in rows if i == k and np.isfinite(v)], list(ps.values())) for k in range(4)}
    got = {r["k"]: [r[n] for n in ps] for r in stats.quantiles(d, ["k"], "v", ps).collect()}
    assert all(np.allclose(got[k], want[k]) for k in want) and len(got) == 4
    assert np.allclose(list(stats.quantiles(d, [], "v", ps).first()), np.quantile([v for _, v in rows if np.isfinite(v)], list(ps.values())))
    flags = [(k, i, bool(f)) for k in range(3) for i, f in enumerate(rng.random(400) < (0.9, 0.5, 1.0)[k])]
    f = spark.createDataFrame(flags, "k int, i long, f boolean")
    plain = {tuple(r) for r in stats.longest_run(f, ["k"], ["i"], "f").collect()}
    assert {tuple(r) for r in stats.longest_run_of_large(f, ["k"], ["i"], "f", 17).collect()} == plain and (2, 400) in plain


def test_repeats_are_compared_on_their_common_grid(spark):
    z = np.indices((20, 24, 24)).astype(float)
    spots = lambda d: sum(np.exp(-((z[0] - a - d[0]) ** 2 + (z[1] - b - d[1]) ** 2 + (z[2] - c - d[2]) ** 2) / 4) for a, b, c in ((7, 8, 9), (12, 15, 14)))
    named = lambda a: vol(spark, a).withColumn("scan_id", F.lit("p"))
    r = features.compare_repeats(named(spots((0, 0, 0))), named(spots((1, 2, -1))), 2.0, 40.0, 4, 4.0, 6.0, percentile=0.9).first()
    assert (r["dz"], r["dy"], r["dx"]) == pytest.approx((-1, -2, 1), abs=0.25) and r["within_limit"] and r["ncc_after"] > 0.95 > r["ncc_before"]
    assert r["magnitude_um"] == pytest.approx(2 * 6**0.5, abs=0.8) and r["landmarks_matched"] >= 1 and r["landmark_error_median_um"] <= 3
    pair = spark.createDataFrame([("p", [0.0, 2.0, 4.0, 8.0], 10.0, 10.0, [1.0, 3.0, 5.0, 7.0], 9.0, 12.0), ("q", [0.0, 1.0], 9.0, 9.0, [5.0, 6.0], 9.0, 9.0)], "scan_id string, z_um_1 array<double>, fov_y_1 double, fov_x_1 double, z_um_2 array<double>, fov_y_2 double, fov_x_2 double")
    g = {r["scan_id"]: r for r in features.common_grid(pair, 1.0).collect()}
    assert (g["p"]["z_start"], g["p"]["z_stop"], g["p"]["n_z"], g["p"]["n_y"], g["p"]["n_x"], g["p"]["usable"]) == (1, 7, 7, 9, 10, True) and not g["q"]["usable"]
    a = np.random.default_rng(3).random((4, 5, 5))
    grid_ = spark.createDataFrame([("p", 1.0, 7, 5, 5, [0.0, 2.0, 4.0, 8.0], 1.0, 1.0)], "scan_id string, z_start double, n_z long, n_y long, n_x long, z_um array<double>, pixel_y double, pixel_x double")
    got = grid(features.on_grid(named(a), grid_, 1.0), (7, 5, 5))
    at = np.interp(1.0 + np.arange(7), [0, 2, 4, 8], range(4))
    assert np.allclose(got, [a[int(k)] * (1 - k % 1) + a[min(3, int(k) + 1)] * (k % 1) for k in at])


def test_admission_and_outputs(spark):
    files = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 2)], "name string, size long")
    declared = spark.createDataFrame([("a", 1), ("b", 1), ("b", 1), ("d", 1)], "name string, size long")
    assert {r["name"]: r["reasons"] for r in provenance.admission(files, declared, ["name"], "size").collect()} == {"a": "", "b": "ambiguous", "c": "undeclared", "d": "size_differs"}
    d = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x")], "path string, size long, sha256 string")
    o = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("e", 1, "x")], "path string, size long, sha256 string")
    assert {r["path"]: r["errors"] for r in provenance.compare_outputs(d, o, "path").collect()} == {"b": "hash", "c": "missing", "e": "undeclared"}


def test_day_after(spark):
    d = spark.createDataFrame([("2026-09-05", "2026-09-01", None), ("2026-09-01", "2026-09-05", None), (None, "2026-09-01", None), ("2026-09-05", "2026-09-01", 5), ("2026-09-05", None, 9)], "a string, b string, c int").select(F.to_date("a").alias("a"), F.to_date("b").alias("b"), "c")
    day, error = provenance.day_after(F.col("a"), F.col("b"), F.col("c"))
    assert [tuple(r) for r in d.select(day, error).collect()] == [(4, None), (None, "negative_day"), (None, None), (None, "day_disagrees"), (9, None)]


def test_slug_and_digest(spark):
    import hashlib

    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    assert [value(scalar.slug(F.lit(t))) for t in (" Scan A_1: x ", "--", "é-B", None)] == ["Scan-A_1--x", "analysis", "é-B", "analysis"]
    want = hashlib.sha256(json.dumps({"b": None, "a": "x|y", "n": 3}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:8]
    assert value(scalar.stable_digest(a=F.lit("x|y"), b=F.lit(None).cast("string"), n=F.lit(3))) == want
    assert value(scalar.stable_digest(a=F.lit("a|b"), b=F.lit("c"))) != value(scalar.stable_digest(a=F.lit("a"), b=F.lit("b|c")))


def test_drift_is_gated_stack_by_stack(spark):
    rows = [(s, p, c, 1.0, 0.0) for s, base in (("a", 0.9), ("b", 0.2)) for p, c in enumerate((base, base + 0.01, base - 0.01, base - 0.15))]
    d = volume.cumulative_drift(spark.createDataFrame(rows, "scan_id string, plane long, corr double, dy double, dx double"), 3.0)
    assert {(r["scan_id"], r["plane"]): r["reliable"] for r in d.collect()} == {(s, p): p < 3 for s in "ab" for p in range(4)}


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    a, b = rng.uniform(0, 50, (40, 2)), rng.uniform(0, 50, (60, 2))
    df = lambda m: spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(m)], "id long, a double, b double")
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    want = {i: int(r.argmin()) if r.min() <= 6 else None for i, r in enumerate(d)}
    assert {r["id"]: r["match"] for r in features.nearest(df(a), df(b), ["a", "b"], 6.0).collect()} == want


def test_sources(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    r = io.hashed_files(spark, str(tmp_path / "a.bin")).first()
    assert r["size"] == 3 and r["sha256"].startswith("ba7816bf")
    assert io.the_only_file(spark, str(tmp_path / "*.bin")).endswith("a.bin")
    (tmp_path / "b.bin").write_bytes(b"x")
    with pytest.raises(ValueError):
        io.the_only_file(spark, str(tmp_path / "*.bin"))
    with pytest.raises(ValueError):
        io.write_rows(spark.range(0), str(tmp_path / "out"))
    (tmp_path / "flag.json").write_text(json.dumps({"subject": {"animal_id": "x"}, "status": "open"}, indent=1))
    assert io.json_documents(spark, str(tmp_path / "flag.json"), io.REVIEW_FLAG).first()["subject"]["animal_id"] == "x"


def test_streamed_ingest_waits_for_whole_scans(spark, tmp_path):
    """A scan whose pages land in two batches gets one median, of all of them; one that is not whole gets none."""
    expected = spark.createDataFrame([("s", 3), ("t", 2), ("u", 5)], "scan_id string, pages long")
    row = lambda s, i: (s, i, 0, i, 1, 1, 2, [float(i), 2.0])

    def land(rows):
        spark.createDataFrame(rows, io.FRAMES).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.reconstruct(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), expected).awaitTermination(120)
        return {(r["scan_id"], r["x"]): r["v"] for r in spark.read.parquet(str(tmp_path / "out" / "volumes")).collect()}

    assert land([row("s", 0), row("t", 0), row("t", 1), row("u", 0)]) == {("t", 0): 0.5, ("t", 1): 2.0}
    assert land([row("s", 1), row("s", 2), row("u", 1)]) == {("t", 0): 0.5, ("t", 1): 2.0, ("s", 0): 1.0, ("s", 1): 2.0}


def turned(a, angle, axes, nearest=False):
    """A slow rotation, one target voxel at a time."""
    c, s = np.cos(np.radians(angle)), np.sin(np.radians(angle))
    m = np.array([[c, s], [-s, c]])
    n = np.array([a.shape[k] for k in axes])
    corners = m @ np.array([[0, 0, n[0], n[0]], [0, n[1], 0, n[1]]])
    size = (np.ptp(corners, axis=1) + 0.5).astype(int)
    offset = (n - 1) / 2 - m @ ((size - 1) / 2)
    shape = list(a.shape)
    shape[axes[0]], shape[axes[1]] = size
    out = np.zeros(shape)
    for i in np.ndindex(*shape):
        p = np.round(m @ np.array([i[axes[0]], i[axes[1]]]) + offset, 9)
        if (p < 0).any() or (p > n - 1).any():
            continue
        low = np.floor(p + 0.5 if nearest else p).astype(int)
        for dy, dx in [(0, 0)] if nearest else [(0, 0), (0, 1), (1, 0), (1, 1)]:
            w = 1.0 if nearest else np.prod([f if d else 1 - f for d, f in zip((dy, dx), p - low, strict=True)])
            at = list(i)
            at[axes[0]], at[axes[1]] = low + (dy, dx)
            out[i] += w * a[tuple(at)] if w else 0
    return out


@pytest.mark.parametrize(("angle", "axes", "nearest"), [(30, (1, 2), False), (-20, (0, 1), False), (90, (1, 2), False), (33, (0, 1), True), (0, (1, 2), True)])
def test_rotation_equals_the_slow_one(spark, angle, axes, nearest):
    a = np.random.default_rng(1).normal(size=(3, 4, 5))
    names = ("plane", "y", "x")
    turn = tuple(names[k] for k in axes)
    want = turned(a, angle, axes, nearest)
    assert render.turned_shape(a.shape, angle, turn) == want.shape
    assert np.allclose(grid(render.rotate(vol(spark, a), angle, turn, nearest), want.shape), want)


def test_views_and_cuboid(spark):
    a = np.random.default_rng(2).uniform(size=(3, 4, 5))
    v = vol(spark, a)
    got = render.views(v, 1.0, 1.0, -20.0, 28.0).collect()
    flat = lambda name: {(r["y"], r["x"]): r["v"] for r in got if r["view"] == name}
    assert flat("axial") == {(y, x): a[:, y, x].max() for y in range(4) for x in range(5)}
    assert flat("side").keys() == {(z, x) for z in range(3) for x in range(5)}
    seen = turned(turned(a, -20.0, (1, 2)), 28.0, (0, 1)).max(0)
    feet = turned(turned(np.ones_like(a), -20.0, (1, 2), True), 28.0, (0, 1), True).max(0) > 0
    ys, xs = np.where(feet)
    y0, x0 = max(0, ys.min() - 4), max(0, xs.min() - 4)
    want = {(y - y0, x - x0): seen[y, x] if feet[y, x] else np.nan for y in range(y0, min(seen.shape[0], ys.max() + 5)) for x in range(x0, min(seen.shape[1], xs.max() + 5))}
    oblique = flat("oblique")
    assert oblique.keys() == want.keys() and all(np.isclose(oblique[k], want[k], equal_nan=True) for k in want)
    c = render.cuboid(v, (1.0, 1.0, 1.0), 64, 0.0, 0.0, 0.0, 0.5, dilation=0).collect()
    assert {(r["y"], r["x"]) for r in c} == {(y, x) for y in range(4 + 24) for x in range(5 + 24)}
    inner = {(r["y"] - 12, r["x"] - 12): r for r in c if r["support"]}
    light = np.cumprod(np.concatenate((np.ones((1, 4, 5)), np.exp(-0.5 * a)))[:3], 0)
    assert inner.keys() == {(y, x) for y in range(4) for x in range(5)}
    assert all(np.isclose(inner[y, x]["v"], (light * (1 - np.exp(-0.5 * a)) * a).sum(0)[y, x]) for y, x in inner)
    assert {k for k, r in inner.items() if r["edge"]} == {(y, x) for y in range(4) for x in range(5) if y in (0, 3) or x in (0, 4)}


def test_known_motion_is_recovered(spark):
    ref = synthetic.reference((64, 64), 1)
    assert np.array_equal(ref, synthetic.reference((64, 64), 1)) and ref.min() == 150 and np.isclose(ref.max(), 1950)
    assert np.allclose(synthetic.displaced(ref, 3, -2)[8:-8, 8:-8], np.roll(ref, (3, -2), (0, 1))[8:-8, 8:-8])
    got = {r["case"]: r for r in synthetic.evaluate(spark).collect()}
    assert got["motion_with_outliers"]["passed"] and got["low_snr"]["passed"] is None
    assert got["brightness_only"]["p95"] <= 0.5 and got["brightness_only"]["passed"] == (got["brightness_only"]["kept"] >= 0.9)
    assert got["motion_with_outliers"]["rejected"] == 2 and got["motion_with_outliers"]["rmse"] <= 0.35
    fixed = {r["case"]: r for r in synthetic.evaluate(spark, least_corr=0.95, most_error=0.2).collect()}
    assert fixed["brightness_only"]["passed"] and fixed["brightness_only"]["kept"] == 1
    assert [got[c]["frames"] for c in synthetic.CASES] == [48, 36, 36]
