"""Run folders: tables, figures with the arrays they show, a manifest with hashes, and the check of all of these."""

from __future__ import annotations

import base64
import io
import json
import os
import platform
import struct
import subprocess
import sys
import zlib
from xml.sax.saxutils import escape

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.functions import scalar
from stackloom.operators.provenance import compare_outputs
from stackloom.runtime import keep
from stackloom.sources.files import opened, resolve, sha256, written
from stackloom.sources.io import hashed_files

# What a manifest, a table and a finished run must have.
MANIFEST = ("analysis_id", "title", "question", "analysis_state", "pipeline", "identity", "inputs", "eligibility", "analysis_units", "entry_script", "git", "configs", "qc", "outputs", "supersession", "supported_interpretations", "unsupported_interpretations")
IDENTITY = ("analysis_id", "pipeline_id", "pipeline_version", "animal_id", "acquisition_date", "post_surgery_day", "scan_id", "session_id", "source_channel")
FIGURES = ("fig_mean_vs_max_projections", "fig_mean_projections", "fig_representative_median_plane")
MANIFEST_NAME = "analysis_manifest.json"
MEMBERS = (".json", ".svg", ".png", ".md")
#: Pixels of an image that may come to the driver.
MOST_PIXELS = 1 << 26


def write_json(path: str, value: dict) -> None:
    """Keys sorted, indented by two."""
    with written(path) as out:
        out.write((json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False) + "\n").encode())


def write_arrays(path: str, arrays: dict[str, np.ndarray]) -> None:
    """A compressed NPZ of float32 arrays."""
    data = io.BytesIO()
    np.savez_compressed(data, **{k: np.asarray(a, np.float32) for k, a in arrays.items()})
    with written(path) as out:
        out.write(data.getvalue())


def read_arrays(path: str) -> dict[str, np.ndarray]:
    with opened(path) as f, np.load(io.BytesIO(f.read())) as z:
        return {k: z[k] for k in z.files}


def image(df: DataFrame, row: str = "y", column: str = "x", value: str = "v") -> np.ndarray:
    """An image on the driver, NaN where a pixel is missing; one of more than MOST_PIXELS is an error."""
    n = df.agg(F.max(row), F.max(column)).first()
    if n[0] is None:
        return np.zeros((0, 0), np.float32)
    if (n[0] + 1) * (n[1] + 1) > MOST_PIXELS:
        raise ValueError(f"an image of {n[0] + 1} x {n[1] + 1} pixels is too large for the driver")
    out = np.full((n[0] + 1, n[1] + 1), np.nan, np.float32)
    t = df.select(F.col(row).cast("long").alias("i"), F.col(column).cast("long").alias("j"), F.col(value).cast("double").alias("v")).toArrow()
    out[t["i"].to_numpy(), t["j"].to_numpy()] = t["v"].to_numpy()
    return out


def png(shown: np.ndarray) -> bytes:
    """An 8-bit grey PNG of values from 0 to 1; NaN is transparent."""
    ok = np.isfinite(shown)
    grey = np.rint(np.clip(np.where(ok, shown, 0), 0, 1) * 255).astype(np.uint8)
    rows = np.stack([grey, np.where(ok, 255, 0).astype(np.uint8)], -1).reshape(shown.shape[0], -1)
    raw = np.concatenate([np.zeros((shown.shape[0], 1), np.uint8), rows], 1).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", shown.shape[1], shown.shape[0], 8, 4, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def side_by_side(panels: list[np.ndarray], gap: int = 8) -> np.ndarray:
    high = max(p.shape[0] for p in panels)
    parts = []
    for p in panels:
        parts += [np.vstack([p, np.full((high - p.shape[0], p.shape[1]), np.nan)]), np.full((high, gap), np.nan)]
    return np.hstack(parts[:-1])


def figure(run: str, figure_id: str, analysis_id: str, panels: dict[str, np.ndarray], shown: dict[str, np.ndarray], notes: str) -> None:
    """Writes a figure's PNG, SVG, notes, the exact arrays of its panels, and a record of all with their hash."""
    base = f"{run}/figures/{figure_id}"
    write_arrays(f"{base}.npz", panels)
    picture = png(side_by_side(list(shown.values())))
    with written(f"{base}.png") as out:
        out.write(picture)
    x, parts, high = 0, [], max(p.shape[0] for p in shown.values())
    for name, p in shown.items():
        data = base64.b64encode(png(p)).decode()
        parts.append(f'<image x="{x}" y="20" width="{p.shape[1]}" height="{p.shape[0]}" href="data:image/png;base64,{data}"/><text x="{x}" y="14" font-size="12">{escape(name)}</text>')
        x += p.shape[1] + 8
    with written(f"{base}.svg") as out:
        out.write(f'<svg xmlns="http://www.w3.org/2000/svg" width="{x}" height="{high + 24}">{"".join(parts)}</svg>\n'.encode())
    with written(f"{base}.md") as out:
        out.write(notes.encode())
    write_json(f"{base}.json", {"figure_id": figure_id, "analysis_id": analysis_id, "panels": {k: list(a.shape) for k, a in panels.items()}, "exact_plotted_data": {"path": f"figures/{figure_id}.npz", "sha256": sha256(f"{base}.npz")}})


def environment() -> dict:
    import numpy
    import pyarrow
    import pyspark

    return {"python": sys.version.split()[0], "platform": platform.platform(), "packages": {m.__name__: m.__version__ for m in (numpy, pyarrow, pyspark)}}


def git_state(folder: str) -> dict:
    """Commit and whether the tree differs from it; both null where there is no repository."""
    def run(*args: str) -> str | None:
        done = subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, check=False)
        return done.stdout.strip() if done.returncode == 0 else None

    changed = run("status", "--porcelain")
    return {"commit": run("rev-parse", "HEAD"), "changed": None if changed is None else bool(changed)}


def code_hashes(spark: SparkSession, folder: str, glob: str = "*.py") -> DataFrame:
    """path, size, sha256 of the source files below a folder, by path."""
    return _inside(hashed_files(spark, folder, True).where(F.element_at(F.split("path", "/"), -1).rlike("^" + glob.replace(".", "[.]").replace("*", ".*") + "$")), folder).orderBy("path")


def _inside(files: DataFrame, run: str) -> DataFrame:
    """Files with their paths within a folder."""
    base = resolve(run)[1].rstrip("/")
    return files.withColumn("path", F.expr("substring(path, locate('{0}/', path) + length('{0}/'))".format(base.replace("'", "''"))))


def seal(spark: SparkSession, run: str, manifest: dict) -> None:
    """Writes the manifest, last, with the hash and size of all files that are there."""
    outputs = [{"path": r["path"], "size_bytes": r["size"], "sha256": r["sha256"]} for r in _inside(hashed_files(spark, run, True), run).orderBy("path").toLocalIterator()]
    full = {**dict.fromkeys(MANIFEST), "environment": environment(), "git": git_state(os.getcwd()), **manifest, "outputs": outputs}
    write_json(f"{run}/{MANIFEST_NAME}", full)


def validate(spark: SparkSession, run: str) -> DataFrame:
    """Every error of a run folder, as rows (path, error); none for a good one. Nothing is written.

    The manifest's outputs, the files that are there, the members each figure must have, its record, and the headers of tables are
    relations, and every check is a join of two of them or a filter of one.
    """
    everything = keep(_inside(hashed_files(spark, run, True), run))
    text = spark.read.text(f"{run.rstrip('/')}/{MANIFEST_NAME}", wholetext=True) if everything.where(F.col("path") == MANIFEST_NAME).count() else None
    none = "path string, error string"
    if text is None:
        return spark.createDataFrame([(MANIFEST_NAME, "missing")], none)
    files = everything.where(F.col("path") != MANIFEST_NAME)
    m = text.select(F.col("value").alias("m"))
    get = lambda c, k: F.get_json_object(c, f"$.{k}")
    whole = F.json_object_keys("m")
    of_manifest = m.select(F.explode(F.when(whole.isNull(), F.array(F.lit("no object"))).otherwise(F.transform(F.array_except(F.array(*(F.lit(k) for k in MANIFEST)), whole), lambda k: F.concat(F.lit("lacks "), k)))).alias("error")).select(F.lit(MANIFEST_NAME).alias("path"), "error")
    listed = m.select(F.explode(F.from_json(get("m", "outputs"), "array<struct<path:string,size_bytes:bigint,sha256:string>>")).alias("o")).select("o.*")
    nameless = listed.where("path is null").select(F.lit(MANIFEST_NAME).alias("path"), F.lit("output without a path").alias("error"))
    named = listed.where("path is not null").select("path", F.col("size_bytes").alias("size"), "sha256")
    safe = scalar.safe_relative(F.col("path"))
    escaping = named.where(~safe).select("path", F.lit("escapes the run").alias("error"))
    outputs = compare_outputs(named.where(safe), files, "path").where("errors <> 'undeclared'").withColumnRenamed("errors", "error")

    tables = spark.read.format("csv").option("header", False).option("sep", "\x01").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*.csv").load(f"{run.rstrip('/')}/tables") if files.where("path like 'tables/%.csv'").count() else None
    parts = [of_manifest, nameless, escaping, outputs]
    if tables is not None:
        # the first line of each file; a line never splits over tasks where each starts at the file's first byte
        head = tables.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.col("_c0").alias("line")).where("at = 0").groupBy("path").agg(F.first("line").alias("line"))
        lacks = F.array_except(F.array(*(F.lit(k) for k in IDENTITY)), F.split("line", ","))
        parts.append(_inside(head, run).where(F.size(lacks) > 0).select("path", F.concat(F.lit("lacks identity columns "), F.array_join(lacks, ", ")).alias("error")))

    # what must be there for each figure: those that every run has, and those that have a record
    ids = spark.createDataFrame([(f,) for f in FIGURES], "figure string").unionByName(files.select(F.regexp_extract("path", r"^figures/(fig_[^/]*)[.]json$", 1).alias("figure")).where("figure <> ''")).distinct()
    members = ids.select("figure", F.explode(F.array(*(F.lit(s) for s in MEMBERS))).alias("suffix")).select("figure", F.concat(F.lit("figures/"), "figure", "suffix").alias("path"))
    parts.append(members.join(files, "path", "left_anti").select("path", F.lit("missing").alias("error")).subtract(outputs.select("path", "error")))
    if files.where("path like 'figures/fig_%.json'").count():
        records = spark.read.option("pathGlobFilter", "fig_*.json").text(f"{run.rstrip('/')}/figures", wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("r"))
        own = F.regexp_extract("path", r"([^/]*)[.]json$", 1)
        r = _inside(records, run).select("path", own.alias("stem"), get("r", "figure_id").alias("figure_id"), get("r", "analysis_id").alias("analysis_id"), get("r", "exact_plotted_data.path").alias("data"), get("r", "exact_plotted_data.sha256").alias("hash"), F.json_object_keys(get("r", "panels")).alias("panels"))
        r = r.join(files.select(F.col("path").alias("data"), F.col("sha256").alias("there")), "data", "left").join(F.broadcast(m.select(get("m", "analysis_id").alias("run_id"))))  # one row
        found = F.array_compact(F.array(
            F.when(~F.col("figure_id").eqNullSafe(F.col("stem")), "figure_id differs from the name"), F.when(~F.col("analysis_id").eqNullSafe(F.col("run_id")), "analysis_id differs"), F.when(F.col("there").isNull(), "plotted data missing"),
            F.when(F.col("there") != F.coalesce("hash", F.lit("")), "plotted data hash"), F.when(F.coalesce(F.size("panels"), F.lit(0)) < 1, "no panels"),
        ))
        parts.append(r.select("path", F.explode(found).alias("error")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
