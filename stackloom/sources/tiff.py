"""Image stacks in TIFF and BigTIFF: page index, headers, frames, and OME volumes.

A first pass reads the directories of each file, one task a file, and gives a row for each page. Filters on pages and
channels apply to these rows, and only then are pixels read, in ranges of pages, so one large stack spreads over tasks.
Pages in strips are read, without compression or deflated; other pages are an error that names the file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import quoteattr

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.functions import scalar
from stackloom.sources.files import opened, written

# Tag numbers, field types and the mark of the acquisition header, as the formats define them.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION, STRIP_OFFSETS = 256, 257, 258, 259, 262, 270, 273
SAMPLES, STRIP_ROWS, STRIP_COUNTS, SOFTWARE, PREDICTOR, SAMPLE_FORMAT = 277, 278, 279, 305, 317, 339
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
HEADER_MARK = 117637889

PAGES = "path string, page_index int, height int, width int, dtype string, compression int, offsets array<long>, counts array<long>"
#: Pages that one read task takes in a row.
RANGE = 64
#: Texts for lengths in micrometres.
MICROMETRES = ("µm", "μm", "um", "micrometer", "micrometre")


class Reader:
    """The directories of one file."""

    def __init__(self, f):
        self.f = f
        head = f.read(16)
        self.order = {b"II": "<", b"MM": ">"}.get(head[:2])
        version = struct.unpack(f"{self.order or '<'}H", head[2:4])[0] if len(head) >= 8 else 0
        if self.order is None or version not in (42, 43):
            raise ValueError("no TIFF file")
        self.big = version == 43
        self.first = struct.unpack(f"{self.order}Q", head[8:16])[0] if self.big else struct.unpack(f"{self.order}I", head[4:8])[0]

    def _unpack(self, form: str, at: int) -> tuple:
        self.f.seek(at)
        return struct.unpack(self.order + form, self.f.read(struct.calcsize(self.order + form)))

    def directories(self) -> Iterator[dict[int, tuple[int, int, int]]]:
        """Per page, tag -> (type, count, where its values are)."""
        at, seen = self.first, set()
        entry, inline = (20, 8) if self.big else (12, 4)
        while at:
            if at in seen:
                raise ValueError("directories run in a circle")
            seen.add(at)
            n = self._unpack("Q" if self.big else "H", at)[0]
            start = at + (8 if self.big else 2)
            self.f.seek(start)
            raw = self.f.read(n * entry + inline)
            tags = {}
            for i in range(n):
                tag, kind, count = struct.unpack_from(f"{self.order}HHQ" if self.big else f"{self.order}HHI", raw, i * entry)
                size = count * struct.calcsize("=" + TYPES.get(kind, "B").replace("s", "B"))
                spot = i * entry + entry - inline
                tags[tag] = (kind, count, start + spot if size <= inline else struct.unpack_from(self.order + ("Q" if self.big else "I"), raw, spot)[0])
            yield tags
            at = struct.unpack_from(self.order + ("Q" if self.big else "I"), raw, n * entry)[0]

    def values(self, tags: dict, tag: int, default: tuple = ()) -> tuple:
        if tag not in tags:
            return default
        kind, count, at = tags[tag]
        return self._unpack(f"{count}{TYPES[kind]}", at)

    def text(self, tags: dict, tag: int) -> str:
        return b"".join(self.values(tags, tag)).rstrip(b"\0").decode("utf-8", "replace")

    def page(self, tags: dict) -> tuple:
        one = lambda tag, default=0: self.values(tags, tag, (default,))[0]
        if STRIP_OFFSETS not in tags or one(SAMPLES, 1) != 1 or one(PREDICTOR, 1) != 1:
            raise ValueError("only pages of one sample in strips, without predictor, can be read")
        dtype = np.dtype(f"{self.order}{'uif'[one(SAMPLE_FORMAT, 1) - 1]}{one(BITS, 1) // 8}").str
        return one(HEIGHT), one(WIDTH), dtype, one(COMPRESSION, 1), self.values(tags, STRIP_OFFSETS), self.values(tags, STRIP_COUNTS)

    def header(self, tags: dict) -> str:
        """The acquisition header: a block after the file's, else the software tag."""
        start = 16 if self.big else 8
        self.f.seek(start)
        block = self.f.read(16)
        if len(block) == 16:
            mark, _, size, _ = struct.unpack(f"{self.order}4I", block)
            if mark == HEADER_MARK:
                return self.f.read(size).rstrip(b"\0").decode("utf-8", "replace")
        return self.text(tags, SOFTWARE) if SOFTWARE in tags else ""


def listing(spark: SparkSession, glob: str) -> DataFrame:
    """path, size, modified of the files of a glob; their content is not read."""
    return spark.read.format("binaryFile").load(glob).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def _each(df: DataFrame, read, schema: str) -> DataFrame:
    """Rows of ``read(path)`` for each path, one task a file."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                rows: list[tuple] = []
                try:
                    for r in read(path):
                        rows.append((path, *r))
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows = []
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    raise ValueError(f"{path}: {e}") from e
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    arrow = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64())}
    kinds = [arrow[c.split()[1]] for c in schema.split(", ")]
    return df.select("path").repartition("path").mapInArrow(run, schema)


def _read_pages(path: str) -> Iterator[tuple]:
    with opened(path) as f:
        r = Reader(f)
        for i, tags in enumerate(r.directories()):
            height, width, dtype, compression, offsets, counts = r.page(tags)
            yield i, height, width, dtype, compression, list(offsets), list(counts)


def pages(spark: SparkSession, glob: str) -> DataFrame:
    """A row of PAGES for every page of the files of a glob."""
    return _each(listing(spark, glob), _read_pages, PAGES)


def _read_head(path: str) -> Iterator[tuple]:
    with opened(path) as f:
        r = Reader(f)
        tags = next(r.directories())
        height, width, dtype, *_ = r.page(tags)
        yield r.header(tags), r.text(tags, DESCRIPTION) if DESCRIPTION in tags else "", height, width, np.dtype(dtype).name


def _numbers(value: Column) -> Column:
    """The numbers of a scalar, vector or matrix, row by row."""
    return F.transform(F.regexp_extract_all(value, F.lit(r"([-+]?(?:[0-9]+\.?[0-9]*(?:[eE][-+]?[0-9]+)?|\.[0-9]+|Inf|NaN))"), F.lit(1)), lambda x: F.regexp_replace(x, "Inf", "Infinity").cast("double"))


def headers(spark: SparkSession, glob: str) -> DataFrame:
    """One row of acquisition metadata a file; ``errors`` names what is missing or contradictory, and what depends on it is null.

    The header's lines are ``key = value``; values are parsed by SQL expressions.
    """
    found = _each(listing(spark, glob), _read_head, "path string, header string, description string, height_px int, width_px int, dtype string")
    h = found.join(listing(spark, glob).withColumnRenamed("path", "path_"), F.col("path") == F.col("path_")).drop("path_")
    pairs = F.filter(F.transform(F.split("header", "\r?\n"), lambda x: F.split(x, " = ", 2)), lambda x: F.size(x) == 2)
    h = h.withColumn("kv", F.map_from_entries(F.transform(F.array_distinct(F.transform(pairs, lambda x: F.trim(x[0]))), lambda k: F.struct(k.alias("key"), F.trim(F.element_at(F.filter(pairs, lambda x: F.trim(x[0]) == k), -1)[1]).alias("value")))))
    get = lambda k: F.try_element_at("kv", F.lit(k))
    words = lambda k: F.coalesce(F.regexp_replace(get(k), "^'|'$", ""), F.lit(""))
    number = lambda k: F.get(_numbers(get(k)), 0)
    folder = F.element_at(F.split("path", "/"), -2)
    part = lambda i: F.nullif(F.regexp_extract(folder, r"^([^_]+)_([A-Z]+-\d+)_(\d{4}-\d{2}-\d{2})_(scan[^_]+)_(sess[^_]+)$", i), F.lit(""))
    h = h.select(
        F.col("path").alias("source_path"), F.regexp_replace("path", "/[^/]*$", "").alias("session_dir"),
        part(2).alias("animal_id"), part(3).alias("date"), part(4).alias("scan_id"), part(5).alias("session_id"),
        words("SI.hConfigurationSaver.cfgFilename").alias("scanimage_config_path"), words("SI.hConfigurationSaver.usrFilename").alias("scanimage_user_path"),
        F.concat_ws(".", *(words(f"SI.VERSION_{x}") for x in ("MAJOR", "MINOR", "UPDATE"))).alias("scanimage_version"),
        words("SI.hStackManager.stackMode").alias("stack_mode"), F.coalesce(get("SI.hStackManager.enable").isin("true", "1"), F.lit(False)).alias("stack_enabled"),
        F.transform(_numbers(get("SI.hChannels.channelSave")), lambda x: F.rint(x).cast("int")).alias("saved_channels"),
        scalar.positive_int(number("SI.hStackManager.actualNumSlices")).cast("int").alias("n_slices"),
        scalar.positive_int(number("SI.hStackManager.framesPerSlice")).cast("int").alias("frames_per_slice"),
        scalar.positive_int(F.coalesce(number("SI.hScan2D.logAverageFactor"), F.lit(1.0))).cast("int").alias("log_average_factor"),
        F.coalesce(get("SI.hScan2D.logAverageDisableDivide").isin("true", "1"), F.lit(False)).alias("log_average_disable_divide"),
        "height_px", "width_px", "dtype", number("SI.hStackManager.actualStackZStepSize").alias("z_step_um"),
        _numbers(get("SI.hStackManager.zs")).alias("zs"), _numbers(get("SI.hRoiManager.imagingFovUm")).alias("fov"),
        number("SI.hRoiManager.scanFrameRate").alias("frame_rate_hz"), F.col("size").alias("size_bytes"),
        (F.unix_micros("modified") * 1000).alias("mtime_ns"), "description", F.col("kv").alias("header"), folder.alias("folder"),
    )
    h = h.withColumn("setup", scalar.normalize_setup(F.concat_ws(" ", "scanimage_config_path", "scanimage_user_path", "folder")))
    h = h.withColumn("stored_frames_per_slice", scalar.stored_frames(F.col("frames_per_slice"), F.col("log_average_factor")).cast("int"))
    h = h.withColumn("storage_aggregation", F.when(F.col("stored_frames_per_slice").isNotNull(), scalar.storage_class(F.col("log_average_factor"), F.col("log_average_disable_divide"))))
    collapsed = scalar.collapse_positions(F.col("zs"))
    every = F.filter(F.col("zs"), lambda _, i: i % F.col("frames_per_slice") == 0)
    h = h.withColumn("z_positions_um", F.when((F.size(collapsed) == 1) & (F.size("zs") >= F.col("frames_per_slice")), every).otherwise(collapsed))
    h = h.withColumns({"expected_pages": F.col("n_slices") * F.col("frames_per_slice"), "expected_tiff_pages": F.col("n_slices") * F.col("stored_frames_per_slice") * F.size("saved_channels")})
    corner = lambda k: F.filter("fov", lambda _, i: i % 2 == k)
    span = lambda k: F.when(F.size("fov") == 8, F.array_max(corner(k)) - F.array_min(corner(k)))
    h = h.withColumns({"fov_x_um": span(0), "fov_y_um": span(1)})
    h = h.withColumns({"pixel_size_x_um": F.col("fov_x_um") / F.col("width_px"), "pixel_size_y_um": F.col("fov_y_um") / F.col("height_px")})
    channels = F.coalesce("saved_channels", F.array().cast("array<int>"))
    wrong = {
        "session folder name": F.col("animal_id").isNull(),
        "saved channels": (F.size(channels) == 0) | F.exists(channels, lambda c: c <= 0) | (F.size(F.array_distinct(channels)) != F.size(channels)),
        "number of slices": F.col("n_slices").isNull(),
        "frames per slice": F.col("frames_per_slice").isNull(),
        "averaging factor": F.col("stored_frames_per_slice").isNull(),
        "Z positions": F.coalesce(F.size("z_positions_um") != F.col("n_slices"), F.lit(True)),
        "field of view": F.col("fov_x_um").isNull(),
        "Z step": F.col("z_step_um").isNull(),
        "frame rate": F.col("frame_rate_hz").isNull(),
    }
    return h.withColumn("errors", F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in wrong.items())))).withColumnRenamed("zs", "page_z_um").drop("fov", "folder")


def page_z(spark: SparkSession, glob: str) -> DataFrame:
    """source_path, scan_id, page, z_um: the position of every acquired frame, where a header lists them all; no row of one that lists fewer."""
    h = headers(spark, glob).where(F.size("page_z_um") == F.col("expected_pages"))
    return h.select("source_path", "scan_id", F.posexplode("page_z_um").alias("page", "z_um"))


def pixels(index: DataFrame) -> DataFrame:
    """Adds ``pixels`` (array<float>, row by row) to rows that have PAGES; other columns stay. Files are read range by range."""
    keys = [c for c in index.columns if c not in ("offsets", "counts", "dtype", "compression")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema if f.name in keys) + ", pixels array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, name = None, None
        try:
            for b in batches:
                for s in range(0, b.num_rows, 8):
                    part = b.slice(s, 8)
                    out = []
                    for r in part.select(["path", "height", "width", "dtype", "compression", "offsets", "counts"]).to_pylist():
                        if r["path"] != name:
                            if f is not None:
                                f.close()
                            f, name = opened(r["path"]), r["path"]
                        if r["compression"] not in (1, 8, 32946):
                            raise ValueError(f"{name}: compression {r['compression']} is not supported")
                        data = []
                        for at, n in zip(r["offsets"], r["counts"], strict=True):
                            f.seek(at)
                            data.append(f.read(n) if r["compression"] == 1 else zlib.decompress(f.read(n)))
                        image = np.frombuffer(b"".join(data), r["dtype"]).astype(np.float32)
                        if len(image) != r["height"] * r["width"]:
                            raise ValueError(f"{name}: a page has {len(image)} pixels, not {r['height']} x {r['width']}")
                        out.append(image)
                    yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(k)) for k in keys), pa.array(out, pa.list_(pa.float32()))], [*keys, "pixels"])
        finally:
            if f is not None:
                f.close()

    spread = index.repartition("path", F.floor(F.col("page_index") / RANGE)).sortWithinPartitions("path", "page_index")
    return spread.mapInArrow(run, schema)


def frames(spark: SparkSession, glob: str, channel: int | None = None, discard: int = 0, offsets: list[int] | None = None, nominal: int = 100) -> DataFrame:
    """Frames of stacks (the schema FRAMES), by their headers; files whose header has errors or whose pages are too few or many are an error.

    Pages are ordered by plane, stored frame and saved channel. A channel, and the first ``discard`` images of each
    plane, are left out before any pixel is read. Without ``channel`` all saved channels come. With ``offsets`` only these images of each plane
    are read, or, where a plane has fewer, those at the same places of a plane of ``nominal`` images.
    """
    h = headers(spark, glob).select("source_path", "scan_id", "saved_channels", "stored_frames_per_slice", "expected_tiff_pages", "errors")
    p = pages(spark, glob)
    n = p.groupBy("path").agg(F.count("*").alias("n_pages"))
    h = h.join(n, F.col("source_path") == F.col("path")).drop("path")
    d = p.join(h, F.col("path") == F.col("source_path"))
    lacks = F.concat_ws(" ", F.col("path"), F.lit("lacks"), F.array_join("errors", ", "))
    differs = F.concat_ws(" ", F.col("path"), F.lit("has pages:"), F.col("n_pages"), F.lit("expected:"), F.col("expected_tiff_pages"))
    # the checks are part of a value that every row needs, so no filter can pass them by
    s = F.when(F.size("errors") > 0, F.raise_error(lacks).cast("int")).when(F.col("n_pages") != F.col("expected_tiff_pages"), F.raise_error(differs).cast("int")).otherwise(F.col("stored_frames_per_slice"))
    c = F.size("saved_channels")
    d = d.select(
        "scan_id", *(x.split()[0] for x in PAGES.split(", ")), F.floor(F.col("page_index") / (s * c)).cast("int").alias("plane_index"),
        F.floor((F.col("page_index") % (s * c)) / c).cast("int").alias("local_index"), F.get("saved_channels", F.col("page_index") % c).alias("channel"), s.alias("stored_"),
    ).where(F.col("local_index") >= discard)
    d = d if channel is None else d.where(F.col("channel") == channel)
    if offsets is not None:
        d = d.where(F.array_contains(scalar.resolve_offsets(F.array(*(F.lit(o).cast("long") for o in offsets)), F.col("stored_"), F.lit(nominal)), F.col("local_index").cast("long")))
    return pixels(d.drop("stored_")).select("scan_id", "page_index", "plane_index", "local_index", "channel", "height", "width", "pixels")


def _directory(big: bool, at: int, width: int, height: int, description: bytes | None, last: bool) -> tuple[bytes, int, int]:
    """The directory of a float page that stands at ``at``: its bytes, where pixels start, where the next one stands."""
    entry, inline, offset = (20, 8, "Q") if big else (12, 4, "I")
    rows = [(WIDTH, 4, 1, width), (HEIGHT, 4, 1, height), (BITS, 3, 1, 32), (COMPRESSION, 3, 1, 1), (PHOTOMETRIC, 3, 1, 1)]
    n = len(rows) + 5 + (description is not None)
    end = at + (8 if big else 2) + n * entry + inline
    if description is not None:
        rows.append((DESCRIPTION, 2, len(description), end))
        end += len(description)
    start = end + -end % 8
    size = width * height * 4
    following = start + size + -(start + size) % 8
    rows += [(STRIP_OFFSETS, 16 if big else 4, 1, start), (SAMPLES, 3, 1, 1), (STRIP_ROWS, 4, 1, height), (STRIP_COUNTS, 16 if big else 4, 1, size), (SAMPLE_FORMAT, 3, 1, 3)]
    out = struct.pack("<Q" if big else "<H", n)
    for tag, kind, count, value in rows:
        out += struct.pack(f"<HH{offset}", tag, kind, count) + struct.pack(f"<{offset}", value)
    out += struct.pack(f"<{offset}", 0 if last else following) + (description or b"")
    return out + b"\0" * (start - end), start, following


def ome_xml(shape: tuple[int, int, int], spacing_zyx_um: tuple[float, float, float], name: str = "volume") -> str:
    """OME metadata of a float volume with axes Z, Y, X."""
    sizes = " ".join(f'Size{a}="{n}"' for a, n in zip("ZYX", shape, strict=True))
    spacing = " ".join(f'PhysicalSize{a}="{float(s)!r}" PhysicalSize{a}Unit="µm"' for a, s in zip("ZYX", spacing_zyx_um, strict=True))
    return (
        '<?xml version="1.0" encoding="UTF-8"?><OME xmlns="http://www.openmicroscopy.org/Schemas/OME/2016-06">'
        f'<Image ID="Image:0" Name={quoteattr(name)}><Pixels ID="Pixels:0" DimensionOrder="XYZCT" Type="float" BigEndian="false" SizeC="1" SizeT="1" {sizes} {spacing}>'
        f'<Channel ID="Channel:0:0" SamplesPerPixel="1"/><TiffData IFD="0" PlaneCount="{shape[0]}"/></Pixels></Image></OME>'
    )


def write_volumes(volumes: DataFrame, folder: str, spacing_zyx_um: tuple[float, float, float], key: str = "scan_id", replace: bool = False) -> DataFrame:
    """Writes ``<folder>/<key>.ome.tif`` for each volume of (key, plane, y, x, v); path, planes and bytes of each.

    Planes are assembled by themselves and stream into their file in order, so a task holds one plane. Above 4 GiB the
    file is a BigTIFF. Voxels that are missing are NaN. Planes, rows and columns count from 0.
    """
    v = volumes.select(F.col(key).cast("string").alias("key"), "plane", "y", "x", F.col("v").cast("float").alias("v"))
    size = v.groupBy("key").agg(*((F.max(c) + 1).cast("long").alias(f"n_{c}") for c in ("plane", "y", "x"))).withColumnRenamed("key", "key_")
    planes = v.groupBy("key", "plane").agg(F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("p"))
    planes = planes.select("key", "plane", F.col("p.y").alias("y"), F.col("p.x").alias("x"), F.col("p.v").alias("v")).join(size, F.col("key") == F.col("key_")).drop("key_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for i in range(b.num_rows) for r in [{n: b.column(k)[i] for k, n in enumerate(b.schema.names)}])
        pending = next(rows, None)
        while pending is not None:
            name = pending["key"].as_py()
            shape = tuple(pending[f"n_{c}"].as_py() for c in ("plane", "y", "x"))
            blank = np.full(shape[1:], np.nan, "<f4")
            big = int(np.prod(shape)) * 4 + shape[0] * 512 > 1 << 32
            text = ome_xml(shape, spacing_zyx_um, name).encode() + b"\0"
            path = f"{folder.rstrip('/')}/{name}.ome.tif"
            with written(path, replace) as out:
                out.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) if big else struct.pack("<2sHI", b"II", 42, 8))
                at = 16 if big else 8
                for z in range(shape[0]):
                    image = blank
                    if pending is not None and pending["key"].as_py() == name and pending["plane"].as_py() == z:
                        image = blank.copy()
                        at_y, at_x, value = (pending[c].values.to_numpy(zero_copy_only=False) for c in ("y", "x", "v"))
                        image[at_y.astype(np.int64), at_x.astype(np.int64)] = value
                        pending = next(rows, None)
                    head, start, following = _directory(big, at, shape[2], shape[1], text if z == 0 else None, z == shape[0] - 1)
                    out.write(head)
                    out.write(image.tobytes())
                    out.write(b"\0" * (following - start - image.nbytes))
                    at = following
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([shape[0]], pa.int64()), pa.array([at], pa.int64())], ["path", "planes", "bytes"])

    done = planes.repartition("key").sortWithinPartitions("key", "plane").mapInArrow(run, "path string, planes long, bytes long")
    return done.sparkSession.createDataFrame(done.collect(), done.schema)  # a row for each file written


def physical_spacing(spark: SparkSession, path: str) -> tuple[float, float, float]:
    """Spacing (z, y, x) in µm of an OME volume; other axes or units are an error."""
    text = _each(listing(spark, path), _read_head, "path string, header string, description string, height_px int, width_px int, dtype string").select("description").head()[0]
    try:
        found = next((e for e in ElementTree.fromstring(text.encode()).iter() if e.tag.endswith("Pixels")), None)
    except ElementTree.ParseError:
        found = None
    if found is None:
        raise ValueError(f"{path} has no OME metadata")
    if any(int(found.get(f"Size{a}", 1)) != 1 for a in "CT") or int(found.get("SizeZ", 1)) < 2:
        raise ValueError(f"{path} is no volume of axes ZYX")
    out = []
    for a in "ZYX":
        value, unit = found.get(f"PhysicalSize{a}"), found.get(f"PhysicalSize{a}Unit", "µm")
        if value is None or unit not in MICROMETRES:
            raise ValueError(f"{path}: spacing along {a} is {value} {unit}")
        out.append(float(value))
    return tuple(out)


def volume(spark: SparkSession, path: str) -> DataFrame:
    """(path, plane, y, x, v) of volumes with a plane a page."""
    p = pixels(pages(spark, path)).select("path", F.col("page_index").cast("long").alias("plane"), "width", F.posexplode("pixels").alias("at", "v"))
    return p.select("path", "plane", F.floor(F.col("at") / F.col("width")).alias("y"), (F.col("at") % F.col("width")).cast("long").alias("x"), F.col("v").cast("double").alias("v"))
