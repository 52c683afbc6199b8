"""One reconstruction from an image stack to a sealed run folder."""

from __future__ import annotations

from datetime import date

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.functions import scalar
from stackloom.operators import gates, recon, volume
from stackloom.sources import bundle, tiff
from stackloom.sources.io import listed_files, write_rows

PIPELINE, VERSION = "stackloom-median", "1"
#: Defaults of a reconstruction.
DEFAULTS = {"discard": 0, "stride": 4, "mad_k": 3.0, "z_tolerance_um": 1e-6, "low": 0.01, "high": 0.998, "gamma": 0.75, "representative": 0.5}


def _shown(panel: np.ndarray, low: float, high: float, gamma: float) -> np.ndarray:
    ok = panel[np.isfinite(panel)]
    lo, hi = np.quantile(ok, [low, high]) if ok.size else (0.0, 1.0)
    return np.clip((np.nan_to_num(panel, nan=lo) - lo) / max(hi - lo, 1e-12), 0, 1) ** gamma


def reconstruct(spark: SparkSession, source: str, out: str, channel: int | None = None, surgery: date | None = None, **config) -> str:
    """Reconstructs the one stack at ``source`` into ``<out>/<analysis id>``, which must not be there; returns that folder.

    Tables of frames, planes, neighbouring planes and projections, the median volume, three figures and the manifest are
    written. Frames of low correlation are flagged and all used. A wrong header or Z geometry is an error.
    """
    c = {**DEFAULTS, **config}
    found = tiff.headers(spark, source).take(2)
    if len(found) != 1:
        raise ValueError(f"{source} matches {'no stack' if not found else 'more than one stack'}")
    h = found[0]
    if h["errors"]:
        raise ValueError(f"{h['source_path']} lacks {', '.join(h['errors'])}")
    saved = h["saved_channels"]
    if channel is None and len(saved) != 1:
        raise ValueError(f"channels {saved} are saved; name one")
    channel = saved[0] if channel is None else channel
    if channel not in saved:
        raise ValueError(f"channel {channel} is not among {saved}")
    zs = h["z_positions_um"]
    z_rows = spark.createDataFrame([(h["scan_id"], i, z) for i, z in enumerate(zs)], "scan_id string, plane int, z double")
    gate = gates.z_geometry(z_rows, ["scan_id"], "plane", "z", h["z_step_um"], c["z_tolerance_um"]).first()
    if gate["status"] != "pass":
        raise ValueError(f"Z positions {zs} do not rise by {h['z_step_um']}: {gate['reasons']}")
    grouped = gates.page_grouping(tiff.page_z(spark, h["source_path"]), ["source_path"], "page", "z_um", h["frames_per_slice"], c["z_tolerance_um"]).first()
    if grouped is not None and grouped["status"] != "pass":
        raise ValueError(f"page positions of {source} do not come in planes of {h['frames_per_slice']}")
    day = (date.fromisoformat(h["date"]) - surgery).days if surgery else None
    if day is not None and day < 0:
        raise ValueError("the scan is earlier than the surgery")
    digest = spark.range(1).select(scalar.stable_digest(source=F.lit(h["source_path"]), size=F.lit(h["size_bytes"]), channel=F.lit(channel), **{f"config_{k}": F.lit(v) for k, v in c.items()})).head()[0]
    analysis = f"{h['animal_id']}-{h['scan_id']}-ch{channel}-{digest}"
    run = f"{out.rstrip('/')}/{analysis}"
    frames = tiff.frames(spark, h["source_path"], channel, c["discard"]).select("scan_id", F.col("plane_index").cast("long").alias("plane"), F.col("local_index").cast("long").alias("local_index"), "width", "pixels")
    spacing = (abs(h["z_step_um"]), h["pixel_size_y_um"], h["pixel_size_x_um"])
    written = tiff.write_volumes(recon.median_volume(frames).withColumn("scan_id", F.lit("median")), f"{run}/volume", spacing).head()["path"]
    vol = tiff.volume(spark, written).drop("path")  # what follows reads the volume instead of making it again
    identity = {
        "analysis_id": analysis, "pipeline_id": PIPELINE, "pipeline_version": VERSION, "animal_id": h["animal_id"], "acquisition_date": h["date"],
        "post_surgery_day": day, "scan_id": h["scan_id"], "session_id": h["session_id"], "source_channel": channel,
    }
    z = F.array(*(F.lit(float(x)) for x in zs))
    factor = h["log_average_factor"]
    first = F.col("local_index") * factor

    def table(name: str, rows: DataFrame) -> None:
        write_rows(rows.select(*(F.lit(v).cast("int" if k in ("post_surgery_day", "source_channel") else "string").alias(k) for k, v in identity.items()), "*").coalesce(1), f"{run}/tables/{name}.csv")

    fq = recon.frame_qc(frames, c["mad_k"], c["stride"])
    place = [F.get(z, F.col("plane").cast("int")).alias("z_scanimage_um"), (F.get(z, F.col("plane").cast("int")) - zs[0]).alias("z_relative_um")]
    table("frame_qc", fq.select("plane", *place, "local_index", first.alias("acquisition_frame_start"), (first + factor - 1).alias("acquisition_frame_end"), ((F.col("plane") * h["frames_per_slice"] + first) / h["frame_rate_hz"]).alias("frame_time_s"), "corr", "frame_mean", "low").orderBy("plane", "local_index"))
    table("plane_qc", recon.plane_qc(frames, c["mad_k"], c["stride"]).drop("scan_id").select("*", *place).orderBy("plane"))
    table("adjacent_planes", volume.lag_correlation(vol, 1).orderBy("plane_a"))
    table("projection_summary", volume.projection_summary(vol).orderBy("name", "kind"))
    flat = volume.projections(vol)
    panels = {f"{k}_{n}": bundle.image(flat.where(F.col("name") == n), "i", "j", k) for n in ("xy", "xz", "yz") for k in ("mean", "max")}
    shown = {k: _shown(p, c["low"], c["high"], c["gamma"]) for k, p in panels.items()}
    notes = f"{analysis}\n\nMedian of all frames; display from quantile {c['low']} to {c['high']}, gamma {c['gamma']}.\n"
    only = lambda d, p: {k: v for k, v in d.items() if k.startswith(p)}
    bundle.figure(run, "fig_mean_vs_max_projections", analysis, panels, shown, notes)
    bundle.figure(run, "fig_mean_projections", analysis, only(panels, "mean"), only(shown, "mean"), notes)
    middle = round(c["representative"] * (len(zs) - 1))
    plane = {f"plane_{middle}": bundle.image(vol.where(F.col("plane") == middle))}
    bundle.figure(run, "fig_representative_median_plane", analysis, plane, {k: _shown(p, c["low"], c["high"], c["gamma"]) for k, p in plane.items()}, notes)
    held = [] if day is not None else ["post-surgery day unknown"]
    bundle.seal(spark, run, {
        "analysis_id": analysis, "title": f"Median reconstruction of {h['scan_id']}", "question": "What is the pixelwise median of each plane?", "analysis_state": "complete",
        "pipeline": {"id": PIPELINE, "version": VERSION}, "identity": identity, "inputs": [{"path": h["source_path"], "size_bytes": h["size_bytes"], "sha256": bundle.sha256(h["source_path"])}],
        "eligibility": {"reconstruction": "eligible", "longitudinal": "hold" if held else "eligible", "reasons": held}, "analysis_units": "plane", "entry_script": "python -m stackloom reconstruct",
        "configs": c, "qc": {"planes": len(zs)}, "supported_interpretations": ["robust per-plane structure"], "unsupported_interpretations": ["motion-corrected intensity"],
    })
    return run


def batch(spark: SparkSession, sources: list[str], out: str, **config) -> DataFrame:
    """Reconstructs stacks one after another (each by jobs that use the whole cluster) and validates each run: rows (source, run, status, message).

    A source that fails does not stop the others; its error is the message. The table is also written to ``<out>/status``.
    """
    rows = []
    for source in sources:
        try:
            run = reconstruct(spark, source, out, **config)
            wrong = bundle.validate(spark, run).count()
            rows.append((source, run, "invalid" if wrong else "pass", f"{wrong} errors" if wrong else None))
        except Exception as e:  # noqa: BLE001  what is wrong with one source is a row
            rows.append((source, None, "error", str(e).split("\n", 1)[0]))
    table = spark.createDataFrame(rows, "source string, run string, status string, message string")
    write_rows(table.coalesce(1), f"{out.rstrip('/')}/status")
    return table


def newest(spark: SparkSession, out: str) -> DataFrame:
    """scan, run, modified: the newest run folder of each scan below ``out``, by its manifest's time."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", bundle.MANIFEST_NAME).load(out).select("path", "modificationTime")
    d = d.withColumn("run", F.regexp_replace("path", "/[^/]*$", "")).withColumn("scan", F.regexp_extract("run", r"([^/]+)-[0-9a-f]{8}$", 1))
    return d.groupBy("scan").agg(F.max_by("run", F.struct("modificationTime", "run")).alias("run"), F.max("modificationTime").alias("modified"))


def volume_of(spark: SparkSession, run: str, name: str = "median") -> str:
    """The path of a run's named volume or, where it is not there, of its only one; an error for none or several."""
    found = [r["path"] for r in listed_files(spark, f"{run.rstrip('/')}/volume/*.ome.tif").collect()]  # of one run
    exact = [p for p in found if p.endswith(f"/{name}.ome.tif")]
    if len(exact or found) != 1:
        raise ValueError(f"{run} has {len(found)} volumes, none of them named {name}")
    return (exact or found)[0]
