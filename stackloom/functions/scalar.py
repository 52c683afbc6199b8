"""Scalar expressions of acquisition metadata and display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rig names as they occur in paths and headers once case and separators are gone.
SETUPS = ("bench2p", "mini2p1", "mini2p2")


def normalize_setup(text: Column) -> Column:
    """The first known rig name in a text, or ``unknown``."""
    t = F.regexp_replace(F.lower(text), "[-_]", "")
    out = F.lit("unknown")
    for name in reversed(SETUPS):
        out = F.when(t.contains(name), name).otherwise(out)
    return out


def session_part(path: Column, part: int) -> Column:
    """Part 1..5 of a folder named operator_animal_date_scan_session; empty if the name is different."""
    return F.regexp_extract(path, r"([^_/]+)_([^_/]+)_(\d{4}-\d{2}-\d{2})_([^_/]+)_([^_/]+)/?$", part)


def positive_int(v: Column) -> Column:
    """Half-even rounding of a number that must be positive; null for anything else."""
    n = F.rint(v.try_cast("double")).cast("long")
    return F.when(n > 0, n)


def stored_frames(frames: Column, factor: Column) -> Column:
    """Stored images of a plane: acquired frames over the averaging factor; null where that does not divide."""
    return F.when((factor > 0) & (frames % factor == 0), F.floor(frames / factor).cast("long"))


def storage_class(factor: Column, no_divide: Column) -> Column:
    return F.when(factor == 1, "raw_frame").when(no_divide, "logged_sum").otherwise("logged_mean")


def page_index(stored: Column, channels: Column, position: Column) -> Column:
    """Pages are ordered by stored frame, then channel."""
    return stored * channels + position


def resolve_channel(saved: Column, requested: Column) -> Column:
    """0-based position of the requested channel, or of the only saved one; null (an error) otherwise."""
    at = F.array_position(saved, requested)
    return F.when(requested.isNull(), F.when(F.size(saved) == 1, F.lit(0))).otherwise(F.when(at > 0, at - 1)).cast("long")


def collapse_positions(zs: Column, tolerance: float = 1e-6) -> Column:
    """Values that differ from the last kept one by more than the tolerance; slow creep is split in the end."""
    return F.aggregate(zs, F.array().cast("array<double>"), lambda a, z: F.when((F.size(a) == 0) | (F.abs(z - F.element_at(a, -1)) > tolerance), F.array_append(a, z)).otherwise(a))


def slug(text: Column) -> Column:
    """Letters, digits, ``-`` and ``_`` as they are, every other character as ``-``; ``analysis`` where nothing is left."""
    t = F.regexp_replace(F.regexp_replace(F.trim(text), r"[^\p{L}\p{N}_-]", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(t, F.lit("")), F.lit("analysis"))


def canonical_json(**parts: Column) -> Column:
    """A JSON object with sorted keys and no spaces; null parts are null."""
    return F.to_json(F.struct(*(parts[k].alias(k) for k in sorted(parts))), {"ignoreNullFields": "false"})


def stable_digest(length: int = 8, **parts: Column) -> Column:
    """First hex digits of the SHA-256 of the parts as canonical JSON."""
    return F.substring(F.sha2(canonical_json(**parts).cast("binary"), 256), 1, length)


def run_id(title: Column, scope: Column, made: Column, digest: Column) -> Column:
    """Title, scope, day of the analysis and digest, joined."""
    return F.concat_ws("__", slug(title), slug(scope), F.concat(F.lit("analyzed-"), F.date_format(made, "yyyyMMdd")), digest)


def unit(v: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - low) / F.nullif(high - low, F.lit(0.0))))


def display_gamma(v: Column, low: Column, high: Column, gamma: float) -> Column:
    """Clipped to the range and raised to gamma; NaN shows as 0."""
    return F.when(F.isnan(v), 0.0).otherwise(F.pow(unit(v, low, high), F.lit(gamma)))


def display_asinh(v: Column, low: Column, high: Column, k: float) -> Column:
    u = unit(v, low, high)
    return u if k == 0 else F.asinh(u * k) / F.asinh(F.lit(float(k)))


def odd_slab(thickness: Column, step: Column) -> Column:
    """The odd number of planes that is nearest to a thickness, at least one."""
    half = F.rint((thickness / step - 1) / 2)
    return (F.greatest(half, F.lit(0.0)) * 2 + 1).cast("long")


def resolve_offsets(wanted: Column, frames: Column, nominal: Column) -> Column:
    """Sample offsets as they are if they fit, else scaled to the stack's length; in order, without repeats."""
    scaled = F.transform(wanted, lambda o: F.rint(o * (frames - 1) / F.greatest(nominal - 1, F.lit(1))).cast("long"))
    return F.array_distinct(F.when(F.array_max(wanted) < frames, wanted).otherwise(scaled))


def safe_relative(path: Column) -> Column:
    """Whether a path stays inside its root."""
    return ~(path.startswith("/") | path.rlike(r"(^|/)\.\.(/|$)"))


def choose_channel(requested: Column, declared: Column, saved: Column) -> tuple[Column, Column]:
    """(channel, error): the requested channel, else the declared one, else the only saved one; a conflict of the first two, or one that is not saved, is named."""
    channel = F.coalesce(requested, declared, F.when(F.size(saved) == 1, F.element_at(saved, 1)))
    error = F.when(requested.isNotNull() & declared.isNotNull() & (requested != declared), "conflict").when(channel.isNull(), "ambiguous").when(~F.array_contains(saved, channel), "not_saved")
    return F.when(error.isNull(), channel), error


def to_um(dy: Column, dx: Column, py: float, px: float) -> Column:
    return F.hypot(dy * py, dx * px)


def plane_times(plane: Column, frames: Column, rate_hz: float) -> list[Column]:
    """start_s, end_s and duration_s of a plane of so many acquired frames: of its first frame, its last one, and all of them."""
    first = plane * frames
    return [(first / F.lit(rate_hz)).alias("start_s"), ((first + frames - 1) / F.lit(rate_hz)).alias("end_s"), (frames / F.lit(rate_hz)).alias("duration_s")]


def bookkeeping(plane: Column, local: Column, frames: int, factor: int, rate_hz: float, channels: int, position: int) -> list[Column]:
    """acquired_start, acquired_end, time_s and page of a stored image: its first and last acquired frame, the start's time, and its page among all channels."""
    start = plane * frames + local * factor
    return [start.alias("acquired_start"), (start + (factor - 1)).alias("acquired_end"), (start / F.lit(rate_hz)).alias("time_s"), page_index(plane * (frames // factor) + local, F.lit(channels), F.lit(position)).alias("page")]
