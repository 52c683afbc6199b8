"""Image files: what is written is read back, headers give metadata, and bad files are errors."""

import struct
import zlib

import numpy as np
import pytest

from stackloom.sources import tiff

HEADER = """SI.VERSION_MAJOR = 2023
SI.VERSION_MINOR = 1
SI.VERSION_UPDATE = 0
SI.hChannels.channelSave = [1;3]
SI.hConfigurationSaver.cfgFilename = 'C:\\rigs\\Bench-2P\\a.cfg'
SI.hRoiManager.imagingFovUm = [-40 -30;40 -30;40 30;-40 30]
SI.hRoiManager.scanFrameRate = 29.97
SI.hScan2D.logAverageDisableDivide = false
SI.hScan2D.logAverageFactor = 2
SI.hStackManager.actualNumSlices = 3
SI.hStackManager.actualStackZStepSize = 2
SI.hStackManager.enable = true
SI.hStackManager.framesPerSlice = 4
SI.hStackManager.stackMode = 'slow'
SI.hStackManager.zs = [0 0 0 0 2 2 2 2 4 4 4 4]
"""
SESSION = "op_AB-1_2026-01-02_scan7_sessX"


def stack(path, images, header=HEADER, order="<", big=True, deflate=False, block=True):
    """A stack file as an acquisition program writes it: a header block or the software tag, a page an image."""
    o = {"<": b"II", ">": b"MM"}[order]
    text = header.encode() + b"\0"
    out = bytearray(struct.pack(f"{order}2sHHHQ", o, 43, 8, 0, 0) if big else struct.pack(f"{order}2sHI", o, 42, 0))
    if block:
        out += struct.pack(f"{order}4I", tiff.HEADER_MARK, 4, len(text), 0) + text
    out += b"\0" * (-len(out) % 8)
    link = 8 if big else 4
    num = "Q" if big else "I"
    for k, im in enumerate(images):
        half = max(1, im.shape[0] // 2)
        strips = [im[:half], im[half:]] if im.shape[0] > 1 else [im]
        data = [s.astype(im.dtype.newbyteorder(order)).tobytes() for s in strips]
        data = [zlib.compress(d) for d in data] if deflate else data
        offsets = []
        for d in data:
            offsets.append(len(out))
            out += d
        soft = None
        if not block and k == 0:
            soft, at = len(out), len(out)
            out += text
        lists = len(out)
        out += struct.pack(f"{order}{len(data)}{num}", *offsets) + struct.pack(f"{order}{len(data)}{num}", *(len(d) for d in data))
        out += b"\0" * (-len(out) % 8)
        width = struct.calcsize(num)
        rows = [(256, 4, 1, im.shape[1]), (257, 4, 1, im.shape[0]), (258, 3, 1, im.dtype.itemsize * 8), (259, 3, 1, 8 if deflate else 1)]
        one = len(data) == 1
        rows += [(273, 16 if big else 4, len(data), offsets[0] if one else lists), (279, 16 if big else 4, len(data), len(data[0]) if one else lists + width * len(data))]
        rows += [(305, 2, len(text), soft)] if soft else []
        rows += [(339, 3, 1, {"u": 1, "i": 2, "f": 3}[im.dtype.kind])]
        struct.pack_into(order + num, out, link, len(out))
        out += struct.pack(f"{order}{'Q' if big else 'H'}", len(rows))
        for tag, kind, count, value in sorted(rows):
            cell = struct.pack(f"{order}H", value) if kind == 3 else struct.pack(f"{order}I", value) if kind == 4 else struct.pack(order + num, value)
            out += struct.pack(f"{order}HH{num}", tag, kind, count) + cell.ljust(width, b"\0")
        link = len(out)
        out += b"\0" * width
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(out)
    return str(path)


def images(n, dtype="int16", shape=(4, 5)):
    return list((np.arange(n * shape[0] * shape[1]).reshape(n, *shape) - 7).astype(dtype))


@pytest.mark.parametrize("kind", [{}, {"big": False}, {"order": ">"}, {"deflate": True}, {"big": False, "order": ">", "block": False}])
def test_frames_are_placed_and_read_whole(spark, tmp_path, kind):
    im = images(12)
    path = stack(tmp_path / SESSION / "a.tif", im, **kind)
    got = tiff.frames(spark, path).orderBy("page_index").collect()
    assert [np.array(r["pixels"]).reshape(4, 5).tolist() for r in got] == [i.tolist() for i in im]
    assert [(r["plane_index"], r["local_index"], r["channel"]) for r in got] == [(p, s, c) for p in range(3) for s in range(2) for c in (1, 3)]
    assert {r["scan_id"] for r in got} == {"scan7"}
    some = tiff.frames(spark, path, channel=3, discard=1).collect()
    assert sorted(r["page_index"] for r in some) == [3, 7, 11]


def test_header_gives_metadata(spark, tmp_path):
    r = tiff.headers(spark, stack(tmp_path / SESSION / "a.tif", images(12))).head()
    assert r["errors"] == []
    assert (r["animal_id"], r["date"], r["scan_id"], r["session_id"], r["setup"]) == ("AB-1", "2026-01-02", "scan7", "sessX", "bench2p")
    assert (r["scanimage_version"], r["stack_mode"], r["stack_enabled"], r["saved_channels"]) == ("2023.1.0", "slow", True, [1, 3])
    assert (r["n_slices"], r["frames_per_slice"], r["stored_frames_per_slice"], r["storage_aggregation"]) == (3, 4, 2, "logged_mean")
    assert (r["expected_pages"], r["expected_tiff_pages"], r["height_px"], r["width_px"], r["dtype"]) == (12, 12, 4, 5, "int16")
    assert r["z_positions_um"] == [0, 2, 4] and (r["fov_x_um"], r["fov_y_um"], r["pixel_size_x_um"], r["pixel_size_y_um"]) == (80, 60, 16, 15)
    assert r["frame_rate_hz"] == 29.97 and r["z_step_um"] == 2


def test_what_a_header_lacks_is_named(spark, tmp_path):
    text = HEADER.replace("= [1;3]", "= [1;1]").replace("logAverageFactor = 2", "logAverageFactor = 3").replace("SI.hRoiManager.scanFrameRate", "other")
    path = stack(tmp_path / "elsewhere" / "a.tif", images(2), text)
    assert tiff.headers(spark, path).head()["errors"] == ["session folder name", "saved channels", "averaging factor", "frame rate"]
    with pytest.raises(Exception, match="lacks session folder name"):
        tiff.frames(spark, path).collect()


def test_a_wrong_number_of_pages_or_another_format_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="has pages: 11 expected: 12"):
        tiff.frames(spark, stack(tmp_path / SESSION / "a.tif", images(11))).collect()
    bad = tmp_path / "b.tif"
    bad.write_bytes(b"no image at all..")
    with pytest.raises(Exception, match="no TIFF file"):
        tiff.pages(spark, str(bad)).collect()


def test_volumes_round_trip_with_spacing(spark, tmp_path):
    a = np.random.default_rng(0).normal(size=(3, 4, 6)).astype(np.float32)
    rows = [(s, *map(int, i), float(v) + k) for k, s in enumerate(("s1", "s2")) for i, v in np.ndenumerate(a) if (s, i) != ("s2", (1, 2, 3))]
    d = spark.createDataFrame(rows, "scan_id string, plane long, y long, x long, v double")
    made = tiff.write_volumes(d, str(tmp_path), (2.0, 0.5, 0.25)).collect()
    assert sorted((r["path"], r["planes"]) for r in made) == [(f"{tmp_path}/s{k}.ome.tif", 3) for k in (1, 2)]
    assert tiff.physical_spacing(spark, f"{tmp_path}/s1.ome.tif") == (2.0, 0.5, 0.25)
    for k, s in enumerate(("s1", "s2")):
        got = np.empty(a.shape, np.float32)
        for r in tiff.volume(spark, f"{tmp_path}/{s}.ome.tif").collect():
            got[r["plane"], r["y"], r["x"]] = r["v"]
        want = (a.astype(float) + k).astype(np.float32)
        if s == "s2":
            want[1, 2, 3] = np.nan
        assert np.array_equal(got, want, equal_nan=True)
    with pytest.raises(Exception, match="s1.ome.tif"):
        tiff.write_volumes(d, str(tmp_path), (2.0, 0.5, 0.25))
    assert len(list(tmp_path.iterdir())) == 2


def test_spacing_of_other_files_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="no OME metadata"):
        tiff.physical_spacing(spark, stack(tmp_path / SESSION / "a.tif", images(12)))


def test_a_run_is_made_whole_and_every_damage_is_found(spark, tmp_path):
    import json

    from stackloom.plans.run import reconstruct
    from stackloom.sources import bundle

    im = images(12)
    path = stack(tmp_path / SESSION / "a.tif", im)
    run = reconstruct(spark, path, str(tmp_path / "runs"), channel=3, stride=1)
    assert bundle.validate(spark, run).collect() == []
    got = np.zeros((3, 4, 5))
    for r in tiff.volume(spark, f"{run}/volume/median.ome.tif").collect():
        got[r["plane"], r["y"], r["x"]] = r["v"]
    want = np.stack([np.median([im[4 * p + 1], im[4 * p + 3]], 0) for p in range(3)])
    assert np.array_equal(got, want)
    arrays = bundle.read_arrays(f"{run}/figures/fig_mean_projections.npz")
    assert np.allclose(arrays["mean_xy"], want.mean(0)) and np.allclose(arrays["mean_xz"], want.mean(1))
    with pytest.raises(FileExistsError):
        bundle.write_json(f"{run}/analysis_manifest.json", {})
    with pytest.raises(Exception, match="ome.tif"):
        reconstruct(spark, path, str(tmp_path / "runs"), channel=3, stride=1)
    with pytest.raises(ValueError, match="name one"):
        reconstruct(spark, path, str(tmp_path / "runs"))
    root = tmp_path / "runs" / run.rsplit("/", 1)[1]
    manifest = json.loads((root / "analysis_manifest.json").read_text())
    manifest["outputs"].append({"path": "../elsewhere", "size_bytes": 1, "sha256": "x"})
    del manifest["title"]
    (root / "analysis_manifest.json").write_text(json.dumps(manifest))
    (root / "figures" / "fig_mean_projections.png").unlink()
    (root / "figures" / "fig_mean_projections.npz").write_bytes(b"other")
    errors = {(r["path"], r["error"]) for r in bundle.validate(spark, run).collect()}
    assert {("analysis_manifest.json", "lacks title"), ("../elsewhere", "escapes the run"), ("figures/fig_mean_projections.json", "plotted data hash"), ("figures/fig_mean_projections.png", "missing")} <= errors
    assert any(p == "figures/fig_mean_projections.npz" and "hash" in e for p, e in errors)
    assert [tuple(r) for r in bundle.validate(spark, str(tmp_path)).collect()] == [("analysis_manifest.json", "missing")]


def test_a_batch_goes_on_after_an_error(spark, tmp_path):
    from stackloom.plans.run import batch, newest, volume_of

    good = stack(tmp_path / SESSION / "a.tif", images(12))
    bad = stack(tmp_path / SESSION.replace("scan7", "scan8") / "a.tif", images(11))
    got = {r["source"]: r for r in batch(spark, [bad, good], str(tmp_path / "runs"), channel=3, stride=1).collect()}
    assert got[good]["status"] == "pass" and got[bad]["status"] == "error" and got[bad]["run"] is None
    assert spark.read.option("header", True).csv(str(tmp_path / "runs" / "status")).count() == 2
    found = newest(spark, str(tmp_path / "runs")).collect()
    assert len(found) == 1 and found[0]["run"].endswith(got[good]["run"].rsplit("/", 1)[1])
    assert volume_of(spark, got[good]["run"]).endswith("median.ome.tif") and volume_of(spark, got[good]["run"], "other").endswith("median.ome.tif")
    with pytest.raises(Exception, match="volume"):
        volume_of(spark, str(tmp_path / "runs" / "none"))


def test_page_positions_and_sampled_frames(spark, tmp_path):
    from stackloom.operators import gates, saturation

    path = stack(tmp_path / SESSION / "a.tif", images(12))
    z = tiff.page_z(spark, path).orderBy("page").collect()
    assert [r["z_um"] for r in z] == [0.0] * 4 + [2.0] * 4 + [4.0] * 4
    assert gates.page_grouping(tiff.page_z(spark, path), ["source_path"], "page", "z_um", 4).first()["status"] == "pass"
    some = tiff.frames(spark, path, channel=1, offsets=[0]).collect()
    assert [(r["plane_index"], r["local_index"]) for r in some] == [(0, 0), (1, 0), (2, 0)]
    whole = tiff.frames(spark, path, channel=1, offsets=[0, 99], nominal=100)
    assert sorted({r["local_index"] for r in whole.collect()}) == [0, 1]
    h = {r["value"]: r["n"] for r in saturation.histogram(whole).collect()}
    values = np.concatenate([i.ravel() for k, i in enumerate(images(12)) if k % 2 == 0])
    assert h == dict(zip(*(x.tolist() for x in np.unique(values, return_counts=True)), strict=True))
    s = saturation.summary(saturation.histogram(whole), int(values.min()), 10_000).first()
    assert s["samples"] == len(values) and s["rail_hit"] and s["maximum"] == values.max() and s["p50"] == np.sort(values)[len(values) // 2 - 1]


def test_discovery_flags_and_code_hashes(spark, tmp_path):
    import hashlib
    import json

    from stackloom.sources import bundle, io

    path = stack(tmp_path / "a" / SESSION / "a.tif", images(1))
    assert io.discover(spark, str(tmp_path / "a"), "AB-1", "2026-01-02", "scan7").endswith("/a.tif")
    with pytest.raises(ValueError, match="0 folders"):
        io.discover(spark, str(tmp_path / "a"), "AB-1", "2026-01-02", "scan8")
    stack(tmp_path / "a" / SESSION / "b.tif", images(1))
    with pytest.raises(ValueError, match="2 stacks"):
        io.discover(spark, str(tmp_path / "a"), "AB-1", "2026-01-02", "scan7")
    flags = tmp_path / "flags"
    flags.mkdir()
    for n in ("b", "a"):
        (flags / f"{n}.json").write_text(json.dumps({"subject": {"animal_id": n}, "source_tiff": path, "status": "open"}))
    got = io.review_flags(spark, str(flags / "*.json")).collect()
    assert [r["subject"]["animal_id"] for r in got] == ["a", "b"] and got[0]["sha256"] == hashlib.sha256((flags / "a.json").read_bytes()).hexdigest()
    (tmp_path / "code" / "sub").mkdir(parents=True)
    (tmp_path / "code" / "x.py").write_text("1")
    (tmp_path / "code" / "sub" / "y.py").write_text("2")
    (tmp_path / "code" / "z.txt").write_text("3")
    assert [(r["path"], r["sha256"]) for r in bundle.code_hashes(spark, str(tmp_path / "code")).collect()] == [("sub/y.py", hashlib.sha256(b"2").hexdigest()), ("x.py", hashlib.sha256(b"1").hexdigest())]
