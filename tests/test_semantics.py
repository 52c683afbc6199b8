"""Rules with their edge cases: plateaus, sampled frames, manifests of one file, runs without a status, chains of runs, planes without frames."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackloom.operators import provenance, recon, register, saturation, volume


def frames(spark, planes, scan="a"):
    """Planes (lists of images) as frames of one stack."""
    rows = [(scan, p, i, int(m.shape[1]), m.ravel().tolist()) for p, images in enumerate(planes) for i, m in enumerate(images)]
    return spark.createDataFrame(rows, "scan_id string, plane long, local_index long, width int, pixels array<double>")


def test_a_plateau_begins_at_its_threshold(spark):
    counts = spark.createDataFrame([("a", v, n) for v, n in ((1, 96), (5, 2), (6, 1), (7, 1))], "scan_id string, value long, n long")
    for threshold, plateau in ((0.5, True), (0.50001, False), (0.49999, True)):
        r = saturation.summary(counts, 0, 9, 0.97, threshold).first()
        assert r["tail_from"] == 5 and r["tail_mode_share"] == 0.5 and r["plateau"] is plateau
    assert (r["minimum"], r["p99"], r["p999"], r["p9999"], r["maximum"], r["rail_hit"]) == (1, 6, 7, 7, 7, False)


def test_sampled_and_representative_frames(spark):
    rng = np.random.default_rng(1)
    planes = [list(rng.integers(0, 50, (n, 2, 3)).astype(float)) for n in (7, 4, 1, 9)]
    f = frames(spark, planes)
    got = {(r["plane"], r["local_index"]) for r in saturation.sampled(f, (0.0, 0.5, 0.5, 1.0), 1).collect()}
    want = {(p, 1 + round(x * (len(i) - 2))) for p, i in enumerate(planes) for x in (0.0, 0.5, 1.0) if len(i) > 1}
    assert got == want
    with pytest.raises(ValueError):
        saturation.sampled(f, (1.5,))
    r = recon.representative(f, 0.5, 1).collect()
    assert r == []  # half-even: plane 2, which has no frame after the first
    r = recon.representative(f, 0.0, 1).first()
    assert (r["plane"], r["local_index"]) == (0, 1 + 6 // 2) and r["pixels"] == planes[0][4].ravel().tolist()
    levels = {x["plane"]: x for x in saturation.plane_levels(f, 0.9, 2).collect()}
    assert levels.keys() == {0, 1, 3}
    for p, x in levels.items():
        v = np.concatenate([i.ravel() for i in planes[p][2:]])
        assert np.isclose(x["p999"], np.quantile(v, 0.9)) and x["maximum"] == v.max()


def test_a_run_without_a_status_needs_review(spark):
    runs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "k long")
    up = spark.createDataFrame([(1, "pass"), (2, None), (3, "fail")], "k long, status string")
    assert {r["k"]: r["status"] for r in provenance.upstream_qc(runs, up, "k").collect()} == {1: "pass", 2: "needs_review", 3: "needs_review", 4: "error"}


def test_a_manifest_may_name_one_file_without_a_list(spark):
    def document(files):
        return json.dumps({"schema_version": "1", "acquisition_type": "stack", "setup_type": "rig", "scan_id": "scan7", "animal_id": "AB-1", "z_stack": {"step": 2}, "collected_files": files})

    one = {"name": "f", "bytes": 5}
    docs = {"list": [one], "object": one, "other": {"name": "g", "bytes": 5}, "size": {"name": "f", "bytes": 6}, "none": None, "twice": [one, one]}
    m = provenance.manifests(spark.createDataFrame([(k, document(v)) for k, v in docs.items()], "folder string, document string"))
    files = spark.createDataFrame([(k, "f", 5, "rig", "7", "XX-9") for k in docs], "folder string, name string, size long, setup string, scan_id string, animal_id string")
    got = {r["folder"]: r for r in provenance.manifest_admission(files, m, "1", "stack").collect()}
    assert {k: r["reasons"] for k, r in got.items()} == {"list": "", "object": "", "other": "not_unique", "size": "size_differs", "none": "not_unique", "twice": "not_unique"}
    r = got["object"]
    assert (r["status"], r["animal_id"], r["selected_file"]["bytes"], json.loads(r["z_stack"]), r["manifest_sha256"]) == ("pass", "AB-1", 5, {"step": 2}, hashlib.sha256(document(one).encode()).hexdigest())
    assert got["size"]["selected_file"] is None


def slow_chain(after, start):
    path = [start]
    while path[-1] in after and after[path[-1]] not in path:
        path.append(after[path[-1]])
    if path[-1] not in after:
        return path[-1], len(path) - 1, None
    return None, None, min(path[path.index(after[path[-1]]) :])


def test_chains_of_runs_with_circles(spark):
    r = random.Random(3)
    runs = {k: None for k in range(120)}
    for k in range(1, 40):
        runs[k] = k - 1  # a long chain
    for k in range(60, 67):
        runs[k] = 60 + (k - 59) % 7  # a circle of seven
    runs[70], runs[71], runs[72] = 70, 71, 999  # itself, itself, unknown
    for k in range(80, 120):
        runs[k] = r.randrange(80, 120)
    runs[50] = 38  # a second one that supersedes 38
    after = {}
    for k in sorted(runs, reverse=True):
        if runs[k] is not None and runs[k] != k:
            after[runs[k]] = k  # the smallest wins
    got = {x["analysis_id"]: (x["head"], x["steps"], x["cycle"]) for x in provenance.chains(spark.createDataFrame(list(runs.items()), "analysis_id long, supersedes long")).collect()}
    assert got == {k: slow_chain(after, k) for k in runs}
    assert got[0] == (39, 39, None) and got[61][2] == 60
    assert provenance.chains(spark.createDataFrame([], "analysis_id long, supersedes long")).collect() == []


def test_a_plane_of_which_nothing_is_kept_has_a_status(spark):
    nan = float("nan")
    rows = [("a", p, i, 0.0, 0.0, 0.1, 0.5, nan if p else 0.9) for p in (0, 1) for i in range(6)]
    shifts = spark.createDataFrame(rows, "scan_id string, plane long, local_index long, dy double, dx double, error double, corr_before double, corr_after double")
    got = {r["plane"]: (r["frames"], r["kept"], r["status"]) for r in register.plane_status(register.registration_keep(shifts)).collect()}
    assert got == {0: (6, 6, "pass"), 1: (6, 0, "nothing_kept")}


def test_a_plane_without_a_z_is_an_error(spark):
    rows = [("a", p, 0, 0, 1.0) for p in range(3)]
    vol = spark.createDataFrame(rows, "scan_id string, plane long, y long, x long, v double")
    z = lambda *at: spark.createDataFrame([("a", p, float(v)) for p, v in at], "scan_id string, plane long, z_um double")
    good = volume.merge_adjacent(vol, vol, (z((0, 0), (1, 2), (2, 4)), z((0, 4), (1, 6), (2, 8))))
    assert {r["plane"]: r["z_um"] for r in good.collect()} == {0: 0.0, 1: 2.0, 2: 4.0, 3: 6.0, 4: 8.0}
    with pytest.raises(Exception, match="a plane has no z: 1"):
        volume.merge_adjacent(vol, vol, (z((0, 0), (2, 4)), z((0, 4), (1, 6), (2, 8)))).count()


def test_plane_times(spark):
    from stackloom.functions import scalar

    r = spark.range(3).select(*scalar.plane_times(F.col("id"), F.lit(60), 30.0)).collect()
    assert [tuple(x) for x in r] == [(0.0, 59 / 30, 2.0), (2.0, 119 / 30, 2.0), (4.0, 179 / 30, 2.0)]
