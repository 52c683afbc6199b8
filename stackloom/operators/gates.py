"""Gates over acquisition geometry and statuses; a gate returns its verdict and reasons, it does not drop rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reasons(**checks: Column) -> Column:
    """Names of the checks that hold, joined by ``;``."""
    return F.concat_ws(";", *(F.when(c, F.lit(n)) for n, c in checks.items()))


def z_geometry(zs: DataFrame, keys: list[str], order: str, z: str, step: float, tolerance: float = 1e-6, increasing: bool = True, positive: bool = False) -> DataFrame:
    """Whether the positions of each key move by the signed step each time: by +step where all rise, else by -step.

    At least two positions, all finite, are needed; with ``positive`` a step that is not above 0 fails.
    """
    d = F.col(z) - F.lag(z).over(Window.partitionBy(*keys).orderBy(order))
    finite = F.coalesce(F.abs(F.col(z).cast("double")) < float("inf"), F.lit(False))
    rows = zs.withColumn("d_", d).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.min("d_").alias("diff_min"),
        F.median("d_").alias("diff_median"),
        F.max("d_").alias("diff_max"),
        F.max(F.abs(F.col("d_") - F.lit(step))).alias("up_"),
        F.max(F.abs(F.col("d_") + F.lit(step))).alias("down_"),
        F.bool_and(finite).alias("finite"),
    )
    rises, falls = F.coalesce(F.col("diff_min") > 0, F.lit(False)), F.coalesce(F.col("diff_max") < 0, F.lit(False))
    rows = rows.withColumns({"residual": F.when(rises, F.col("up_")).otherwise(F.col("down_")), "strictly_increasing": rises, "strictly_monotonic": rises | falls}).drop("up_", "down_")
    rows = rows.withColumn("regular", F.coalesce(F.col("residual") <= tolerance, F.lit(False)))
    checks = {"too_few": F.col("n") < 2, "not_finite": ~F.col("finite"), "not_monotonic": ~F.col("strictly_increasing" if increasing else "strictly_monotonic"), "irregular_step": F.col("residual") > tolerance}
    checks |= {"step_not_positive": F.lit(not step > 0)} if positive else {}
    return rows.withColumn("reasons", reasons(**checks)).withColumn("status", F.when(F.col("reasons") == "", "pass").otherwise("fail"))


def page_grouping(zs: DataFrame, keys: list[str], order: str, z: str, frames: int, tolerance: float = 1e-6) -> DataFrame:
    """Whether pages come in blocks of ``frames`` with one position each."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = zs.withColumn("block_", F.floor((F.row_number().over(w) - 1) / frames))
    first = F.first_value(z).over(Window.partitionBy(*keys, "block_").orderBy(order))
    d = d.withColumn("off_", F.abs(F.col(z) - first))
    rows = d.groupBy(*keys).agg(F.count("*").alias("pages"), F.count_distinct("block_").alias("planes"), F.max("off_").alias("spread"))
    return rows.withColumn("status", F.when((F.col("pages") == F.col("planes") * frames) & (F.col("spread") <= tolerance), "pass").otherwise("fail"))


def count_gate(observed: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Compares ``n`` of both sides; a key that only one side has fails."""
    o, e = observed.withColumnRenamed("n", "observed"), expected.withColumnRenamed("n", "expected")
    return o.join(e, keys, "full_outer").withColumn("status", F.when(F.col("observed").eqNullSafe(F.col("expected")), "pass").otherwise("fail"))


def stack_set(stacks: DataFrame, keys: list[str], same: list[str], close: list[str], size: int = 2, tolerance: float = 1e-6) -> DataFrame:
    """Whether the stacks of a key can be merged: the right number, equal columns, near-equal spacings (also within 1e-5 of the value)."""
    aggs = [F.count("*").alias("n")]
    aggs += [(F.count_distinct(c) <= 1).alias(f"same_{c}") for c in same]
    aggs += [(F.max(c) - F.min(c) <= tolerance + 1e-5 * F.abs(F.max(c))).alias(f"close_{c}") for c in close]
    rows = stacks.groupBy(*keys).agg(*aggs)
    checks = {"wrong_number": F.col("n") != size} | {f"differs_{c}": ~F.col(f"same_{c}") for c in same} | {f"apart_{c}": ~F.col(f"close_{c}") for c in close}
    return rows.select(*keys, "n", reasons(**checks).alias("reasons")).withColumn("status", F.when(F.col("reasons") == "", "pass").otherwise("fail"))


def rollup(any_error: Column, needs_review: Column) -> Column:
    return F.when(any_error, "fail").when(needs_review, "needs_review").otherwise("pass")


def positions_normal_form(zs: DataFrame, keys: list[str], order: str, z: str) -> DataFrame:
    """Start, end, step and number of slices of expanded positions, with the checks that they are consistent."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = zs.withColumn("d_", F.col(z) - F.lag(z).over(w)).withColumn("moved_", F.when(F.col("d_") != 0, F.col("d_")))
    g = d.groupBy(*keys).agg(F.min_by(z, order).alias("start"), F.max_by(z, order).alias("end"), F.median("moved_").alias("step"), F.count_distinct(z).alias("slices"), F.count("*").alias("frames"))
    span = F.abs(F.col("start") + F.col("step") * (F.col("slices") - 1) - F.col("end")) <= 1e-6
    return g.select(*keys, "start", "end", "step", "slices", "frames", F.coalesce(span, F.lit(False)).alias("spans"), (F.col("frames") % F.col("slices") == 0).alias("divides"))


def single_stack(stacks: DataFrame, rig: str, modes: tuple[str, ...] | None = None) -> DataFrame:
    """Adds reasons and status of a stack (setup, stack_enabled, stack_mode): the right rig, stacking enabled, one of the modes if they are given."""
    checks = {"wrong_rig": ~F.col("setup").eqNullSafe(rig), "stack_disabled": ~F.coalesce("stack_enabled", F.lit(False))}
    checks |= {"wrong_mode": ~F.coalesce(F.col("stack_mode").isin(*modes), F.lit(False))} if modes else {}
    return stacks.withColumn("reasons", reasons(**checks)).withColumn("status", F.when(F.col("reasons") == "", "pass").otherwise("fail"))


def required_keys(document: Column, keys: tuple[str, ...]) -> Column:
    """Those of ``keys`` that a JSON object, as text, lacks, in order; all of them where it is no object."""
    return F.array_except(F.array(*(F.lit(k) for k in keys)), F.coalesce(F.json_object_keys(document), F.array().cast("array<string>")))


def analysis_spec(document: Column, keys: tuple[str, ...], pipeline: dict[str, str], states: tuple[str, ...]) -> Column:
    """Errors of an analysis specification (JSON text), joined: missing keys, another pipeline, an analysis state that is not allowed."""
    get = lambda path: F.get_json_object(document, path)
    lacks = required_keys(document, keys)
    return reasons(lacks_keys=F.size(lacks) > 0, other_pipeline=F.exists(F.array(*(get(f"$.pipeline.{k}").eqNullSafe(v) for k, v in pipeline.items())), lambda same: ~same), state_not_allowed=~F.coalesce(get("$.analysis_state").isin(*states), F.lit(False)))


def figure_style(document: Column, profile: str, version: str, least_dpi: int = 300) -> Column:
    """Errors of a figure style (JSON text): schema version, the profile, SVG among the editable formats, and enough dots per inch."""
    get = lambda path: F.get_json_object(document, path)
    formats = F.coalesce(F.from_json(get("$.output.editable_vector_formats"), "array<string>"), F.array().cast("array<string>"))
    return reasons(version=~get("$.schema_version").eqNullSafe(version), no_profile=get(f"$.profiles.{profile}").isNull(), no_svg=~F.array_contains(formats, "svg"), low_dpi=~F.coalesce(get("$.output.png_dpi").try_cast("double") >= least_dpi, F.lit(False)))
