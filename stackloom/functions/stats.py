"""Statistics as columns and aggregates. NaN means an undefined statistic, NULL an unknown value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAD_SCALE = 1.4826


def nan() -> Column:
    return F.lit(float("nan"))


def skip_nan(v: Column) -> Column:
    """NaN as NULL, so that aggregates skip it."""
    return F.nanvl(v, F.lit(None).cast("double"))


def nan_avg(v: Column) -> Column:
    """Mean of the numbers; NaN if there are none."""
    return F.coalesce(F.avg(skip_nan(v)), nan())


def nan_max(v: Column) -> Column:
    return F.coalesce(F.max(skip_nan(v)), nan())


def finite(v: Column) -> Column:
    """Whether a value is a number, neither NaN nor infinite nor null."""
    return F.coalesce(F.abs(v) < float("inf"), F.lit(False))


def pearson(a: Column, b: Column) -> Column:
    """Correlation over pairs that are both finite; NaN for fewer than two pairs or where a side is constant."""
    ok = finite(a) & finite(b)
    x, y = F.when(ok, a), F.when(ok, b)
    return F.when(F.count(x) < 2, nan()).otherwise(F.coalesce(F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)), nan()))


def robust_bounds(df: DataFrame, keys: list[str], value: str, k: float) -> DataFrame:
    """keys, centre, mad, lower, upper: median -/+ k scaled median absolute deviations of the finite values.

    Two aggregations on one partitioning. A group without a finite value accepts nothing: lower is +inf, upper -inf.
    """
    v = F.when(finite(F.col(value)), F.col(value))
    centre = df.groupBy(*keys).agg(F.median(v).alias("centre"))
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"{c}__"))
    d = df.join(centre.select("centre", *(F.col(c).alias(f"{c}__") for c in keys)), on).drop(*(f"{c}__" for c in keys))
    mad = d.groupBy(*keys).agg(F.first("centre").alias("centre"), F.median(F.abs(v - F.col("centre"))).alias("mad"))
    side = lambda sign: F.coalesce(F.col("centre") + sign * k * MAD_SCALE * F.col("mad"), F.lit(-sign * float("inf")))
    return mad.withColumns({"lower": side(-1), "upper": side(1)})


def quantiles(df: DataFrame, keys: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """keys and a column for each named share: exact percentiles, linearly interpolated, of the finite values of groups of any size.

    A sketch of each group gives two values that enclose the wanted ranks closely; a second pass counts what is below and
    ranks, by distinct value, only what is between. No task gets a whole group.
    """
    near = 2e-4
    v = F.col(value).cast("double")
    d = df.where(finite(v)).select(*keys, v.alias("v__"))
    ends = [min(1.0, max(0.0, p + e)) for p in ps.values() for e in (-near, near)]
    sketch = d.groupBy(*keys).agg(F.percentile_approx("v__", ends, 10_000).alias("e__"), F.min("v__").alias("min__"), F.max("v__").alias("max__"), F.count("*").alias("n__"))
    shares = F.lit(list(ps.values()))
    few = F.col("n__") < 4 / near  # where ranks are further apart than the sketch may err, all values are ranked
    low = lambda i: F.when(few | (F.get(shares, i) <= near), F.col("min__")).otherwise(F.get("e__", 2 * i))
    high = lambda i: F.when(few | (F.get(shares, i) >= 1 - near), F.col("max__")).otherwise(F.get("e__", 2 * i + 1))
    within = F.transform(F.sequence(F.lit(0), F.lit(len(ps) - 1)), lambda i: F.struct(low(i).alias("lo"), high(i).alias("hi")))
    sketch = sketch.select(*keys, "n__", within.alias("w__"))
    near_rows = (d.join(sketch, keys) if keys else d.join(F.broadcast(sketch))).select(*keys, "n__", "v__", F.posexplode("w__").alias("i__", "w__"))  # one row without keys
    below = F.col("v__") < F.col("w__.lo")
    counted = near_rows.where(F.col("v__") <= F.col("w__.hi")).groupBy(*keys, "n__", "i__", F.when(~below, F.col("v__")).alias("v__")).agg(F.count("*").alias("c__"))
    up_to = F.sum("c__").over(Window.partitionBy(*keys, "i__").orderBy(F.asc_nulls_first("v__")))
    rank = F.get(shares, F.col("i__")) * (F.col("n__") - 1)
    ranked = counted.withColumns({"top__": up_to, "rank__": rank})
    pick = lambda r: F.min(F.when(F.col("top__") > r, F.col("v__")))
    floor, ceil = F.floor("rank__"), F.ceil("rank__")
    one = ranked.groupBy(*keys, "i__").agg(pick(floor).alias("a__"), pick(ceil).alias("b__"), F.first(F.col("rank__") - floor).alias("f__")).withColumn("q__", F.col("a__") + (F.col("b__") - F.col("a__")) * F.col("f__"))
    return one.groupBy(*keys).agg(*(F.max(F.when(F.col("i__") == i, F.col("q__"))).alias(n) for i, n in enumerate(ps)))


def longest_run(df: DataFrame, keys: list[str], order: list[str], flag: str) -> DataFrame:
    """keys, longest_run: the most rows in a row, by the order, whose flag is true; 0 if there is none."""
    w = Window.partitionBy(*keys).orderBy(*order)
    island = F.row_number().over(w) - F.row_number().over(Window.partitionBy(*keys, flag).orderBy(*order))
    runs = df.withColumn("island_", island).groupBy(*keys, flag, "island_").agg(F.count("*").alias("n_"))
    return runs.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col(flag), F.col("n_"))), F.lit(0)).alias("longest_run"))


def longest_run_of_large(df: DataFrame, keys: list[str], order: list[str], flag: str, parts: int = 200) -> DataFrame:
    """longest_run() for groups of any size: the rows of a group are cut at quantiles of the first order column, which is a
    number or a time; each part gives its length, longest run and the runs at its ends, which are joined in order."""
    at = F.col(order[0]).cast("timestamp_ltz").cast("double") if dict(df.dtypes)[order[0]].startswith(("timestamp", "date")) else F.col(order[0]).cast("double")
    d = df.withColumn("at__", F.coalesce(at, F.lit(float("-inf"))))
    cuts = d.groupBy(*keys).agg(F.percentile_approx("at__", [i / parts for i in range(1, parts)], 10 * parts).alias("cuts__"))
    d = d.join(cuts, keys).withColumn("part__", F.size(F.filter("cuts__", lambda c: c <= F.col("at__")))).drop("cuts__")
    w = Window.partitionBy(*keys, "part__").orderBy(*order)
    d = d.withColumns({"row__": F.row_number().over(w), "end__": F.row_number().over(Window.partitionBy(*keys, "part__").orderBy(*(F.desc(c) for c in order)))})
    off = ~F.col(flag)
    ends = d.groupBy(*keys, "part__").agg(F.count("*").alias("n"), (F.coalesce(F.min(F.when(off, F.col("row__"))), F.count("*") + 1) - 1).alias("head"), (F.coalesce(F.min(F.when(off, F.col("end__"))), F.count("*") + 1) - 1).alias("tail"))
    inner = longest_run(df=d, keys=[*keys, "part__"], order=order, flag=flag)
    one = ends.join(inner, [*keys, "part__"]).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("part__", "n", "head", "tail", "longest_run"))).alias("parts__"))  # at most ``parts`` of a key
    start = F.struct(F.lit(0).cast("long").alias("best"), F.lit(0).cast("long").alias("open"))
    step = lambda a, p: F.struct(F.greatest(a["best"], p["longest_run"], a["open"] + p["head"]).alias("best"), F.when(p["head"] == p["n"], a["open"] + p["n"]).otherwise(p["tail"]).alias("open"))
    return one.select(*keys, F.aggregate("parts__", start, step, lambda a: a["best"]).alias("longest_run"))


def percentile(v: Column | str, p: float) -> Column:
    """Linear interpolation between order statistics; exact."""
    return F.percentile(v, F.lit(p))


def cv(v: Column | str) -> Column:
    return F.stddev_pop(v) / F.nullif(F.avg(v), F.lit(0.0))


def gradient(df: DataFrame, keys: list[str], axis: str, value: str, spacing: float, name: str) -> DataFrame:
    """Central differences along an axis, one-sided at its ends."""
    w = Window.partitionBy(*keys).orderBy(axis)
    before, after, here = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    g = F.when(before.isNull(), (after - here) / spacing).when(after.isNull(), (here - before) / spacing).otherwise((after - before) / (2 * spacing))
    return df.withColumn(name, g)


def tenengrad(df: DataFrame, keys: list[str], rows: str, cols: str, value: str, spacing: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """keys, tenengrad: mean squared gradient over the variance of each image; NaN pixels are filled with its median.

    NaN for fewer than four numbers and for constant images."""
    fill = df.groupBy(*keys).agg(F.median(skip_nan(F.col(value))).alias("fill_"))
    d = df.join(fill, keys).withColumn("v_", F.coalesce(skip_nan(F.col(value)), "fill_"))
    d = gradient(d, [*keys, cols], rows, "v_", spacing[0], "gy_")
    d = gradient(d, [*keys, rows], cols, "v_", spacing[1], "gx_")
    energy = F.avg(F.col("gy_") * F.col("gy_") + F.col("gx_") * F.col("gx_"))
    return d.groupBy(*keys).agg(F.when(F.count(skip_nan(F.col(value))) < 4, nan()).otherwise(F.coalesce(energy / F.nullif(F.var_pop("v_"), F.lit(0.0)), nan())).alias("tenengrad"))
