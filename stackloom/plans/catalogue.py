"""Catalogue of queries by name over the driver's tables, each with DuckDB SQL of the same rows.

``embeddings`` stand for two image stacks, of even and odd ids: the label is the plane, the order of ids the frame, the 64
values an image of 8 x 8. Their queries do both stacks at once, and the SQL is the one of a stack, for each of the two.
Other tables stand for records; what stands for what is said at each query. Integers are long, and doubles are rounded
to six digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stackloom.functions import scalar, stats
from stackloom.operators import features, gates, provenance, recon, register, render, synthetic, volume
from stackloom.plans import registration_sql as reg
from stackloom.plans import views_sql
from stackloom.runtime import delete, keep, scratch, ship
from stackloom.sources import io, tiff

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
Q = Callable[["Tables"], DataFrame]
WIDTH = 8


class Tables:
    """The tables of a folder by name, and the stack of ``embeddings``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def frames(self) -> DataFrame:
        """All rows of ``embeddings`` as two stacks."""
        return io.ragged(self.embeddings, "label", "vec_id", "embedding", WIDTH, F.when(F.col("vec_id") % 2 == 0, "even").otherwise("odd"))

    def med(self) -> DataFrame:
        return recon.median_volume(self.frames())

    def one(self) -> DataFrame:
        """All rows of ``embeddings`` as one stack."""
        return io.ragged(self.embeddings, "label", "vec_id", "embedding", WIDTH)

    def one_med(self) -> DataFrame:
        """The median volume of the one stack, without its name."""
        return recon.median_volume(self.one()).drop("scan_id")


def tidy(df: DataFrame) -> DataFrame:
    def one(name: str, kind: str) -> Column:
        if kind in ("double", "float"):
            return (F.round(F.col(name).cast("double"), 6) + F.lit(0.0)).alias(name)
        return F.col(name).cast("long").alias(name) if kind in ("int", "smallint", "tinyint") else F.col(name)

    return df.select(*(one(n, k) for n, k in df.dtypes))


# {of} chooses the rows of a stack
STACK = """fr AS (SELECT label::BIGINT AS plane, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS local_index FROM embeddings WHERE {of}),
vox AS (SELECT plane, local_index, px // 8 AS y, px % 8 AS x, v FROM (SELECT plane, local_index, unnest(generate_series(0, 63)) AS px, unnest(embedding)::DOUBLE AS v FROM fr)),
med AS (SELECT plane, y, x, median(v) AS v FROM vox GROUP BY ALL)"""
STACKS = {"even": "vec_id % 2 = 0", "odd": "vec_id % 2 = 1"}
# correlation by moments, so that constants give NaN
CORR = "CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) ELSE 'NaN'::DOUBLE END"


def query(name: str, sql: str | None, d: str = "", l: str = "", stack: bool | str = False, ctes: str = "") -> Callable[[Q], Q]:  # noqa: E741
    """Registers a query; ``d`` and ``l`` name the SQL's doubles to round and its integers to widen. With ``stack`` the SQL is
    that of one stack, and is repeated for both, or, where ``stack`` is ``one``, taken for all rows as one."""

    def put(f: Q) -> Q:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return tidy(f(Tables(spark, sf_dir)))

        QUERIES[name] = run
        if sql is not None:
            casts = [f"round({c}, 6) + 0.0 AS {c}" for c in d.split()] + [f"CAST({c} AS BIGINT) AS {c}" for c in l.split()]

            def whole(of: str | None) -> str:
                head = ", ".join(x for x in (STACK.replace("{of}", of) if of else "", ctes) if x)
                return (f"WITH {head} " if head else "") + f"SELECT *{f' REPLACE ({', '.join(casts)})' if casts else ''} FROM ({sql}) q_"

            ORACLE_SQL[name] = " UNION ALL ".join(f"SELECT '{n}' AS scan_id, * FROM ({whole(of)}) s_" for n, of in STACKS.items()) if stack is True else whole("true" if stack else None)
        return f

    return put


# --- reconstruction and its quality control -------------------------------------------------------------------------

FQ = f"""fs AS (SELECT v.plane, v.local_index, {CORR.format(a='v.v', b='m.v')} AS corr, avg(v.v) AS frame_mean FROM vox v JOIN med m USING (plane, y, x) GROUP BY 1, 2),
fs2 AS (SELECT v.plane, v.local_index, {CORR.format(a='v.v', b='m.v')} AS corr FROM vox v JOIN med m USING (plane, y, x) WHERE v.y % 2 = 0 AND v.x % 2 = 0 GROUP BY 1, 2)"""


def _bound(src: str, k: float) -> str:
    return f"(SELECT plane, coalesce(median(corr) FILTER (isfinite(corr)) - ({k}) * 1.4826 * mad(corr) FILTER (isfinite(corr)), 'Infinity'::DOUBLE) AS threshold FROM {src} GROUP BY plane)"


def _plane_qc_sql(src: str) -> str:
    return f"""SELECT a.*, r.longest_run, i.median_mean, i.median_p99 FROM (
      SELECT f.plane, count(*) AS frames, 0 AS frames_rejected, coalesce(min(f.corr) FILTER (isfinite(f.corr)), 'NaN'::DOUBLE) AS corr_min, coalesce(quantile_cont(f.corr, 0.05) FILTER (isfinite(f.corr)), 'NaN'::DOUBLE) AS corr_p05, coalesce(median(f.corr) FILTER (isfinite(f.corr)), 'NaN'::DOUBLE) AS corr_median, coalesce(quantile_cont(f.corr, 0.95) FILTER (isfinite(f.corr)), 'NaN'::DOUBLE) AS corr_p95,
             first(t.threshold) AS threshold, count(*) FILTER (isfinite(f.corr) AND f.corr < t.threshold) AS low_frames, stddev_pop(g.frame_mean) / avg(g.frame_mean) AS frame_mean_cv
      FROM {src} f JOIN {_bound(src, 1.0)} t USING (plane) JOIN fs g USING (plane, local_index) GROUP BY f.plane) a
    JOIN (SELECT plane, coalesce(max(n) FILTER (low), 0) AS longest_run FROM (
            SELECT plane, low, isl, count(*) AS n FROM (SELECT plane, low, row_number() OVER (PARTITION BY plane ORDER BY local_index) - row_number() OVER (PARTITION BY plane, low ORDER BY local_index) AS isl
              FROM (SELECT f.plane, f.local_index, isfinite(f.corr) AND f.corr < t.threshold AS low FROM {src} f JOIN {_bound(src, 1.0)} t USING (plane))) GROUP BY ALL) GROUP BY plane) r USING (plane)
    JOIN (SELECT plane, avg(v) AS median_mean, quantile_cont(v, 0.99) AS median_p99 FROM med GROUP BY plane) i USING (plane)"""


PQ = dict(d="corr_min corr_p05 corr_median corr_p95 threshold frame_mean_cv median_mean median_p99", l="frames frames_rejected low_frames longest_run", stack=True, ctes=FQ)

FRAME_QC = f"SELECT f.*, t.threshold, isfinite(f.corr) AND f.corr < t.threshold AS low FROM fs f JOIN {_bound('fs', 1.0)} t USING (plane)"
query("median_volume", "SELECT * FROM med", "v", "plane y x", True)(lambda t: t.med())
query("mean_volume", "SELECT plane, y, x, avg(v) AS v FROM vox GROUP BY ALL", "v", "plane y x", True)(lambda t: recon.mean_volume(t.frames()))
query("median_volume_all", "SELECT * FROM med", "v", "plane y x", "one")(lambda t: t.one_med())
query("mean_volume_all", "SELECT plane, y, x, avg(v) AS v FROM vox GROUP BY ALL", "v", "plane y x", "one")(lambda t: recon.mean_volume(t.one()).drop("scan_id"))
query("discard_mean", "SELECT plane, y, x, avg(v) AS v FROM vox WHERE local_index >= 3 GROUP BY ALL", "v", "plane y x", True)(lambda t: recon.mean_volume(t.frames(), 3))
query("frame_qc", FRAME_QC, "corr frame_mean threshold", "plane local_index", True, FQ)(lambda t: recon.frame_qc(t.frames(), 1.0))
query("plane_qc", _plane_qc_sql("fs"), **PQ)(lambda t: recon.plane_qc(t.frames(), 1.0))
query("frame_qc_all", FRAME_QC, "corr frame_mean threshold", "plane local_index", "one", FQ)(lambda t: recon.frame_qc(t.one(), 1.0).drop("scan_id"))
query("plane_qc_all", _plane_qc_sql("fs"), **(PQ | dict(stack="one")))(lambda t: recon.plane_qc(t.one(), 1.0).drop("scan_id"))
query("plane_qc_strided", _plane_qc_sql("fs2"), **PQ)(lambda t: recon.plane_qc(t.frames(), 1.0, 2))


def _kept_sql(k: float, least: float = 0.3) -> str:
    return f"""kp AS (SELECT *, CASE WHEN n_ok < need THEN rank <= need ELSE ok END AS keep FROM (SELECT *, row_number() OVER (PARTITION BY plane ORDER BY CASE WHEN isfinite(corr) THEN corr ELSE '-Infinity'::DOUBLE END DESC, local_index DESC) AS rank, sum(ok::INT) OVER (PARTITION BY plane) AS n_ok, greatest(1, ceil(count(*) OVER (PARTITION BY plane) * {least})) AS need
      FROM (SELECT f.*, t.threshold, isfinite(f.corr) AND f.corr >= t.threshold AS ok FROM fs f JOIN {_bound('fs', k)} t USING (plane)))), kept AS (SELECT plane, local_index FROM kp WHERE keep)"""


MEAN_KEPT = "SELECT plane, y, x, avg(v) AS v FROM vox SEMI JOIN kept USING (plane, local_index) GROUP BY ALL"
query("mad_filtered_mean", MEAN_KEPT, "v", "plane y x", True, FQ + ", " + _kept_sql(1.0))(lambda t: recon.filtered_mean(t.frames(), 1.0))
query("keep_floor_topk", "SELECT * FROM kept", "", "plane local_index", True, FQ + ", " + _kept_sql(-3.0))(lambda t: recon.kept_frames(recon.frame_statistics(t.frames()), -3.0).where("keep").select("scan_id", "plane", "local_index"))
query("keep_ranks", "SELECT plane, local_index, corr, frame_mean, threshold, rank, keep FROM kp", "corr frame_mean threshold", "plane local_index rank", True, FQ + ", " + _kept_sql(1.0))(lambda t: recon.kept_frames(recon.frame_statistics(t.frames()), 1.0))
query(
    "kept_summary",
    """SELECT plane, frames, kept, frames - kept AS dropped, kept / frames AS kept_share, longest_dropped FROM (SELECT plane, count(*) AS frames, count_if(keep) AS kept FROM kp GROUP BY plane)
      JOIN (SELECT plane, coalesce(max(n) FILTER (NOT keep), 0) AS longest_dropped FROM (SELECT plane, keep, isl, count(*) AS n FROM (SELECT plane, keep, row_number() OVER (PARTITION BY plane ORDER BY local_index) - row_number() OVER (PARTITION BY plane, keep ORDER BY local_index) AS isl FROM kp) GROUP BY ALL) GROUP BY plane) USING (plane)""",
    "kept_share", "plane frames kept dropped longest_dropped", True, FQ + ", " + _kept_sql(1.0),
)(lambda t: recon.kept_summary(recon.kept_frames(recon.frame_statistics(t.frames()), 1.0)))
query("robust_bounds", "SELECT user_id, median(value) AS centre, mad(value) AS mad, median(value) - 3 * 1.4826 * mad(value) AS lower, median(value) + 3 * 1.4826 * mad(value) AS upper FROM events GROUP BY user_id", "centre mad lower upper")(
    lambda t: stats.robust_bounds(t.events, ["user_id"], "value", 3.0)
)
query("frame_mean_cv", "SELECT plane, stddev_pop(m) / avg(m) AS cv FROM (SELECT plane, local_index, avg(v) AS m FROM vox GROUP BY ALL) GROUP BY plane", "cv", "plane", True)(
    lambda t: recon.frame_statistics(t.frames()).groupBy("scan_id", "plane").agg(stats.cv("frame_mean").alias("cv"))
)
query("early_late_means", "SELECT plane, y, x, avg(v) FILTER (local_index < 5) AS early, avg(v) FILTER (local_index >= f - 5) AS late FROM vox JOIN (SELECT plane, count(*) AS f FROM fr GROUP BY plane) USING (plane) GROUP BY ALL", "early late", "plane y x", True)(lambda t: recon.early_late(t.frames()))

# --- volumes ---------------------------------------------------------------------------------------------------------

PROJ = """proj AS (SELECT 'xy' AS name, y AS i, x AS j, avg(v) AS mean, max(v) AS max FROM med GROUP BY y, x UNION ALL SELECT 'xz', plane, x, avg(v), max(v) FROM med GROUP BY plane, x UNION ALL SELECT 'yz', plane, y, avg(v), max(v) FROM med GROUP BY plane, y)"""
query("projections", "SELECT * FROM proj", "mean max", "i j", True, PROJ)(lambda t: volume.projections(t.med()))
query("projection_summary", "SELECT name, kind, min(v) AS minimum, avg(v) AS mean, max(v) AS maximum FROM (SELECT name, 'mean' AS kind, mean AS v FROM proj UNION ALL SELECT name, 'max', max FROM proj) GROUP BY ALL", "minimum mean maximum", "", True, PROJ)(
    lambda t: volume.projection_summary(t.med())
)
query("thin_slab_mip", "SELECT y, x, max(v) AS v FROM med WHERE plane BETWEEN 3 AND 7 GROUP BY ALL", "v", "y x", True)(lambda t: volume.slab_mip(t.med(), F.lit(5), 2))
query(
    "slab_panels",
    "SELECT c.fraction, c.centre, m.y, m.x, max(m.v) AS v FROM med m JOIN (SELECT fr AS fraction, round_even(fr * (SELECT max(plane) FROM med), 0) AS centre FROM (VALUES (0.25::DOUBLE), (0.5), (0.75)) w(fr)) c ON m.plane BETWEEN c.centre - 1 AND c.centre + 1 GROUP BY ALL",
    "fraction v", "centre y x", True,
)(lambda t: volume.slab_panels(t.med(), [0.25, 0.5, 0.75], 1))
LIM = "lim AS (SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.998) AS hi FROM med)"
UNIT = "greatest(0.0, least(1.0, (v - lo) / (hi - lo)))"
query("display_gamma", f"SELECT plane, y, x, pow({UNIT}, 0.75) AS shown FROM med, lim", "shown", "plane y x", True, LIM)(lambda t: volume.display(t.med()).select("scan_id", "plane", "y", "x", "shown"))
query("display_asinh", f"SELECT plane, y, x, asinh(3.0 * {UNIT}) / asinh(3.0) AS shown FROM med, lim", "shown", "plane y x", True, LIM)(lambda t: volume.display(t.med(), asinh=3.0).select("scan_id", "plane", "y", "x", "shown"))
query("clip_fractions", "SELECT lo, hi, avg((v < lo)::INT) AS clipped_low, avg((v > hi)::INT) AS clipped_high, 1.0::DOUBLE AS finite FROM med, lim GROUP BY lo, hi", "lo hi clipped_low clipped_high", "", True, LIM)(lambda t: volume.clip_fractions(t.med(), 0.01, 0.998))


def _lags(src: str, most: int) -> str:
    return f"(SELECT a.plane AS plane_a, b.plane AS plane_b, b.plane - a.plane AS lag, {CORR.format(a='a.v', b='b.v')} AS corr FROM {src} a JOIN {src} b ON a.y = b.y AND a.x = b.x AND b.plane - a.plane BETWEEN 1 AND {most} GROUP BY ALL)"


query("adjacent_correlation", f"SELECT * FROM {_lags('med', 1)}", "corr", "plane_a plane_b lag", True)(lambda t: volume.lag_correlation(t.med()))
query("z_decay", f"SELECT lag, lag * 2.0::DOUBLE AS lag_um, count(*) AS pairs, avg(corr) AS mean, median(corr) AS median, quantile_cont(corr, 0.05) AS p05, quantile_cont(corr, 0.95) AS p95 FROM {_lags('med', 4)} GROUP BY lag", "lag_um mean median p05 p95", "lag pairs", True)(
    lambda t: volume.z_decay(t.med(), 2.0, 4)
)
MET = "avg_ AS (SELECT plane, y, x, avg(v) AS v FROM vox GROUP BY ALL)"


def _sharp(image: str, s0: float, s1: float) -> str:
    """Tenengrad of an image (i, j, v) in SQL, over spacings of rows and columns."""
    side = lambda c, s: f"CASE WHEN lag(v) OVER w{c} IS NULL THEN (lead(v) OVER w{c} - v) / {s} WHEN lead(v) OVER w{c} IS NULL THEN (v - lag(v) OVER w{c}) / {s} ELSE (lead(v) OVER w{c} - lag(v) OVER w{c}) / (2 * {s}) END"
    return f"(SELECT avg(gi * gi + gj * gj) / var_pop(v) FROM (SELECT v, {side('i', s0)} AS gi, {side('j', s1)} AS gj FROM ({image}) WINDOW wi AS (PARTITION BY j ORDER BY i), wj AS (PARTITION BY i ORDER BY j)))"


query(
    "volume_metrics",
    " UNION ALL ".join(
        f"""SELECT (SELECT avg(v) FROM {s}) AS mean, (SELECT stddev_pop(v) FROM {s}) AS std, 1.0::DOUBLE AS finite, avg(corr) AS adjacent_mean, median(corr) AS adjacent_median, '{n}' AS method,
          {_sharp(f"SELECT plane AS i, x AS j, v FROM {s} WHERE y = 4", 2.0, 0.5)} AS tenengrad_xz, {_sharp(f"SELECT plane AS i, y AS j, v FROM {s} WHERE x = 4", 2.0, 0.9)} AS tenengrad_yz, {_sharp(f"SELECT y AS i, x AS j, max(v) AS v FROM {s} GROUP BY ALL", 0.9, 0.5)} AS tenengrad_axial FROM {_lags(s, 1)}"""
        for n, s in (("median", "med"), ("mean", "avg_"))
    ),
    "mean std adjacent_mean adjacent_median tenengrad_xz tenengrad_yz tenengrad_axial", "", True, MET,
)(lambda t: volume.volume_metrics({"median": t.med(), "mean": recon.mean_volume(t.frames())}, (2.0, 0.9, 0.5)))
query(
    "tenengrad_by_plane",
    """SELECT plane, avg(gy * gy + gx * gx) / var_pop(v) AS tenengrad FROM (SELECT plane, v,
      CASE WHEN y = 0 THEN lead(v) OVER wy - v WHEN y = 7 THEN v - lag(v) OVER wy ELSE (lead(v) OVER wy - lag(v) OVER wy) / 2 END AS gy,
      CASE WHEN x = 0 THEN lead(v) OVER wx - v WHEN x = 7 THEN v - lag(v) OVER wx ELSE (lead(v) OVER wx - lag(v) OVER wx) / 2 END AS gx
      FROM med WINDOW wy AS (PARTITION BY plane, x ORDER BY y), wx AS (PARTITION BY plane, y ORDER BY x)) GROUP BY plane""",
    "tenengrad", "plane", True,
)(lambda t: stats.tenengrad(t.med(), ["scan_id", "plane"], "y", "x", "v"))
SHOWN = LIM + f", sh AS (SELECT plane, y, x, pow({UNIT}, 0.75) AS s FROM med, lim), ps AS (SELECT *, coalesce(sum(s) OVER (PARTITION BY y, x ORDER BY plane ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM sh)"
_shown = lambda t: volume.display(t.med()).select("scan_id", "plane", "y", "x", F.col("shown").alias("v"))
query("attenuated_mip", "SELECT y, x, max(s * exp(-0.6 * f)) AS v FROM ps GROUP BY ALL", "v", "y x", True, SHOWN)(lambda t: volume.attenuated_mip(_shown(t), 0.6))
query("alpha_composite", "SELECT y, x, sum(exp(-0.14 * f) * (1 - exp(-0.14 * s)) * s) AS v FROM ps GROUP BY ALL", "v", "y x", True, SHOWN)(lambda t: volume.alpha_composite(_shown(t), 0.14))
STEPS = f"""st AS (SELECT plane_b AS plane, corr FROM {_lags('med', 1)}), im AS (SELECT plane, avg(v) AS m, median(v) AS h FROM med GROUP BY plane),
sp AS (SELECT st.plane, st.corr, 20 * (b.m - a.m) AS dy, 20 * (b.h - a.h) AS dx FROM st JOIN im b ON b.plane = st.plane JOIN im a ON a.plane = st.plane - 1),
ok AS (SELECT *, isfinite(corr) AND corr >= (SELECT median(corr) - 0.5 * 1.4826 * mad(corr) FROM sp) AND sqrt(dy * dy + dx * dx) <= 10 AS reliable FROM sp)"""


def _steps(t: Tables) -> DataFrame:
    """Differences of plane means and medians stand for the shifts of neighbouring planes."""
    med = t.med()
    image = med.groupBy("scan_id", "plane").agg(F.avg("v").alias("m"), F.median("v").alias("h"))
    c = volume.lag_correlation(med).select("scan_id", F.col("plane_b").alias("plane"), "corr")
    before = image.select("scan_id", (F.col("plane") + 1).alias("plane"), F.col("m").alias("m0"), F.col("h").alias("h0"))
    s = c.join(image, ["scan_id", "plane"]).join(before, ["scan_id", "plane"])
    return volume.cumulative_drift(s.select("scan_id", "plane", "corr", (20 * (F.col("m") - F.col("m0"))).alias("dy"), (20 * (F.col("h") - F.col("h0"))).alias("dx")), 0.5)


query("step_reliability", "SELECT plane, corr, dy, dx, reliable FROM ok", "corr dy dx", "plane", True, STEPS)(lambda t: _steps(t).select("scan_id", "plane", "corr", "dy", "dx", "reliable"))
query("cumulative_drift", "SELECT plane, sum(CASE WHEN reliable THEN dy ELSE 0 END) OVER (ORDER BY plane) AS cum_dy, sum(CASE WHEN reliable THEN dx ELSE 0 END) OVER (ORDER BY plane) AS cum_dx FROM ok", "cum_dy cum_dx", "plane", True, STEPS)(
    lambda t: _steps(t).select("scan_id", "plane", "cum_dy", "cum_dx")
)
MERGED = "mg AS (SELECT plane, y, x, avg(v) AS v, count(*) AS sources FROM (SELECT * FROM med WHERE plane <= 5 UNION ALL SELECT plane, y, x, v * 1.5 FROM med WHERE plane >= 5) GROUP BY ALL)"
_merged = lambda t: volume.merge(t.med().where("plane <= 5"), t.med().where("plane >= 5").withColumn("v", F.col("v") * 1.5))
query("merge_boundary", "SELECT * FROM mg", "v", "plane y x sources", True, MERGED)(_merged)
query("combined_slice_stats", "SELECT plane, avg(v) AS mean, stddev_pop(v) AS std, quantile_cont(v, 0.01) AS p01, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.99) AS p99, 1.0::DOUBLE AS finite FROM mg GROUP BY plane", "mean std p01 p50 p99", "plane", True, MERGED)(
    lambda t: volume.slice_stats(_merged(t))
)
query(
    "crop_support",
    "SELECT plane, y, x, CASE WHEN v > 0.03 THEN v ELSE 'NaN'::DOUBLE END AS v FROM med, (SELECT min(y) AS ly, max(y) AS hy, min(x) AS lx, max(x) AS hx FROM med WHERE v > 0.03) WHERE y BETWEEN ly - 1 AND hy + 1 AND x BETWEEN lx - 1 AND hx + 1",
    "v", "plane y x", True,
)(lambda t: volume.crop_box(t.med(), 0.03, 1))
query("cuboid_edges", "SELECT plane, y, x FROM med WHERE (plane < 1 OR plane > 8)::INT + (y < 1 OR y > 6)::INT + (x < 1 OR x > 6)::INT >= 2", "", "plane y x", True)(lambda t: volume.cuboid_edges(t.med(), 1))
query(
    "bilinear_shift",
    """SELECT g.plane, g.y, g.x, CASE WHEN bool_or(m.v IS NULL AND w > 0) THEN 'NaN'::DOUBLE ELSE sum(coalesce(m.v * w, 0)) END AS v FROM (
      SELECT plane, y, x, floor(y - 1.25)::BIGINT + a AS sy, floor(x + 0.5)::BIGINT + b AS sx, (CASE a WHEN 0 THEN 0.25 ELSE 0.75 END) * (CASE b WHEN 0 THEN 0.5 ELSE 0.5 END) AS w
      FROM med, (VALUES (0), (1)) p(a), (VALUES (0), (1)) r(b)) g LEFT JOIN med m ON m.plane = g.plane AND m.y = g.sy AND m.x = g.sx GROUP BY ALL""",
    "v", "plane y x", True,
)(lambda t: volume.bilinear_shift(t.med(), 1.25, -0.5))
query(
    "trilinear_resample",
    """SELECT i AS plane, j AS y, k AS x, sum(coalesce(m.v, 0) * wz * wy * wx) AS v FROM (
      SELECT i, j, k, floor(i * 9 / 4.0)::BIGINT + a AS sz, floor(j * 7 / 4.0)::BIGINT + b AS sy, floor(k * 7 / 5.0)::BIGINT + c AS sx,
        abs(1 - a - (i * 9 / 4.0 - floor(i * 9 / 4.0))) AS wz, abs(1 - b - (j * 7 / 4.0 - floor(j * 7 / 4.0))) AS wy, abs(1 - c - (k * 7 / 5.0 - floor(k * 7 / 5.0))) AS wx
      FROM (SELECT unnest(range(5)) AS i), (SELECT unnest(range(5)) AS j), (SELECT unnest(range(6)) AS k), (VALUES (0), (1)) p(a), (VALUES (0), (1)) q(b), (VALUES (0), (1)) r(c)) g
      LEFT JOIN med m ON m.plane = sz AND m.y = sy AND m.x = sx GROUP BY ALL""",
    "v", "plane y x", True,
)(lambda t: volume.resample(t.med(), (5, 5, 6)))


def _gauss_sql(name: str, src: str, sigmas: tuple[float, float, float], radius: int | None = None) -> str:
    def one(out: str, src: str, axis: str, top: int, sigma: float) -> str:
        others = [c for c in ("plane", "y", "x") if c != axis]
        r = int(4 * sigma + 0.5) if radius is None else radius
        return f"{out} AS (SELECT {', '.join('g.' + c for c in others)}, g.{axis}, sum(m.v * k.w) AS v FROM {src} g, (SELECT o, exp(-0.5 * (o / {sigma}) ** 2) / (SELECT sum(exp(-0.5 * (o / {sigma}) ** 2)) FROM (SELECT unnest(range(-{r}, {r + 1}))::DOUBLE AS o)) AS w FROM (SELECT unnest(range(-{r}, {r + 1}))::DOUBLE AS o)) k JOIN {src} m ON m.{axis} = least(greatest(g.{axis} + k.o, 0), {top}) AND {' AND '.join(f'm.{c} = g.{c}' for c in others)} GROUP BY g.plane, g.y, g.x)"

    return ", ".join((one(f"{name}1", src, "plane", 9, sigmas[0]), one(f"{name}2", f"{name}1", "y", 7, sigmas[1]), one(name, f"{name}2", "x", 7, sigmas[2])))


query("gaussian_stencil", "SELECT plane, y, x, v FROM ga", "v", "plane y x", True, _gauss_sql("ga", "med", (1.2,) * 3, 3))(lambda t: volume.gaussian(t.med(), 1.2, 3))
# spacings 2, 0.5 and 0.5 µm; sigmas, distance and border in µm
BRIGHT = dict(spacing_um=(2.0, 0.5, 0.5), feature_um=(0.8, 0.4, 0.4), background_um=(3.0, 1.5, 1.5), distance_um=2.0, border_um=(1.0, 0.5, 0.5))
query(
    "bright_candidates",
    """SELECT printf('candidate_%02d', row_number() OVER (ORDER BY f DESC, plane, y, x)) AS candidate_id, plane, y, x, plane * 2.0::DOUBLE AS z_relative_um, y * 0.5::DOUBLE AS y_um, x * 0.5::DOUBLE AS x_um, plane * 2.0::DOUBLE AS z_scanimage_um, f AS feature_score, v AS source_intensity
      FROM (SELECT * FROM ft a WHERE f >= (SELECT quantile_cont(f, 0.9) FROM ft) AND plane BETWEEN 1 AND 8 AND y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6
      AND NOT EXISTS (SELECT 1 FROM ft b WHERE ((b.plane - a.plane) * 2.0 / 2) ** 2 + ((b.y - a.y) * 0.5 / 2) ** 2 + ((b.x - a.x) * 0.5 / 2) ** 2 <= 1 AND (b.f > a.f OR b.f = a.f AND (b.plane, b.y, b.x) < (a.plane, a.y, a.x))) ORDER BY f DESC, plane, y, x LIMIT 6)""",
    "z_relative_um y_um x_um z_scanimage_um feature_score source_intensity", "plane y x", True,
    _gauss_sql("bg", "med", (1.5, 3.0, 3.0)) + ", rs AS (SELECT med.plane, med.y, med.x, med.v - bg.v AS v FROM med JOIN bg USING (plane, y, x)), " + _gauss_sql("na", "rs", (0.4, 0.8, 0.8)) + ", ft AS (SELECT na.plane, na.y, na.x, med.v, round(na.v, 9) AS f FROM na JOIN med USING (plane, y, x))",
)(lambda t: volume.candidates(t.med(), 0.9, 6, **BRIGHT))
query("candidate_bounds", "SELECT plane, y, x, greatest(plane - 2, 0) AS lo_plane, least(plane + 3, 10) AS hi_plane, greatest(y - 3, 0) AS lo_y, least(y + 4, 8) AS hi_y, greatest(x - 3, 0) AS lo_x, least(x + 4, 8) AS hi_x FROM med", "", "plane y x lo_plane hi_plane lo_y hi_y lo_x hi_x", True)(
    lambda t: volume.candidate_bounds(t.med().drop("v"), (10, 8, 8), (4.0, 1.5, 1.5), (2.0, 0.5, 0.5))
)

# --- intensities: events stand for samples ---------------------------------------------------------------------------

HIST = "h AS (SELECT user_id, floor(value)::BIGINT AS v, count(*) AS n FROM events GROUP BY ALL)"
_samples = lambda t: t.events.select("user_id", F.floor("value").cast("long").alias("v"))
query("saturation_histogram", "SELECT v, sum(n) AS n FROM h GROUP BY v", "", "v n", ctes=HIST)(lambda t: _samples(t).groupBy("v").agg(F.count("*").alias("n")))
query("histogram_quantiles", "SELECT user_id, quantile_disc(floor(value)::BIGINT, 0.5) AS p50, quantile_disc(floor(value)::BIGINT, 0.99) AS p99, quantile_disc(floor(value)::BIGINT, 0.999) AS p999 FROM events GROUP BY user_id", "", "p50 p99 p999")(
    lambda t: _samples(t).groupBy("user_id").agg(*(F.expr(f"cast(percentile_disc({p}) WITHIN GROUP (ORDER BY v) as bigint)").alias(n) for p, n in ((0.5, "p50"), (0.99, "p99"), (0.999, "p999"))))
)


def _upper_tail(t: Tables) -> DataFrame:
    """Mode of the values at or above each user's p90: most frequent, then smallest; with its share of that tail."""
    s = _samples(t)
    bound = s.groupBy("user_id").agg(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY v)").alias("b"))
    h = s.join(bound, "user_id").where(F.col("v") >= F.col("b")).groupBy("user_id", "v").agg(F.count("*").alias("n"))
    g = h.groupBy("user_id").agg(F.sum("n").alias("tail"), F.max(F.struct("n", (-F.col("v")).alias("m"))).alias("x"))
    return g.select("user_id", "tail", (-F.col("x.m")).alias("mode"), (F.col("x.n") / F.col("tail")).alias("share"))


query(
    "upper_tail_mode",
    "SELECT user_id, tail, v AS mode, n / tail AS share FROM (SELECT h.user_id, h.v, h.n, sum(h.n) OVER (PARTITION BY h.user_id) AS tail, row_number() OVER (PARTITION BY h.user_id ORDER BY h.n DESC, h.v) AS rk FROM h JOIN (SELECT user_id, quantile_disc(floor(value)::BIGINT, 0.9) AS b FROM events GROUP BY user_id) USING (user_id) WHERE h.v >= b) WHERE rk = 1",
    "share", "tail mode", ctes=HIST,
)(_upper_tail)
query(
    "rail_fractions",
    "SELECT user_id, avg((v <= 0)::INT) AS low_rail, avg((v = mx)::INT) AS at_max, avg((v = mx)::INT) >= 0.01 AS plateau FROM (SELECT user_id, floor(value)::BIGINT AS v, max(floor(value)::BIGINT) OVER (PARTITION BY user_id) AS mx FROM events) GROUP BY user_id",
    "low_rail at_max",
)(
    lambda t: _samples(t).join(_samples(t).groupBy("user_id").agg(F.max("v").alias("mx")), "user_id").groupBy("user_id").agg(F.avg((F.col("v") <= 0).cast("double")).alias("low_rail"), F.avg((F.col("v") == F.col("mx")).cast("double")).alias("at_max")).withColumn("plateau", F.col("at_max") >= 0.01)
)
query(
    "saturation_offsets",
    "SELECT l_orderkey, n, array_to_string(CASE WHEN 99 < n THEN [0, 25, 50, 75, 99] ELSE list_transform(list_filter(list_transform([0, 25, 50, 75, 99], lambda o: round_even(o * (n - 1) / 99.0, 0)::BIGINT), lambda x, i: i = 1 OR x <> round_even([0, 25, 50, 75, 99][i - 1] * (n - 1) / 99.0, 0)::BIGINT), lambda x: x) END, ',') AS offsets FROM (SELECT l_orderkey, count(*) * 5 AS n FROM lineitem GROUP BY 1)",
    "", "n",
)(
    lambda t: t.lineitem.groupBy("l_orderkey").agg((F.count("*") * 5).alias("n")).select("l_orderkey", "n", F.array_join(scalar.resolve_offsets(F.array(*(F.lit(x).cast("long") for x in (0, 25, 50, 75, 99))), F.col("n"), F.lit(100)), ",").alias("offsets"))
)

# --- gates: order lines and conversations stand for pages --------------------------------------------------------------


def _geometry_sql(table: str, key: str, z: str, tie: str, increasing: bool = True) -> str:
    rule = "rises" if increasing else "rises OR falls"
    return f"""SELECT {key}, n, diff_min, diff_median, diff_max, residual, finite, strictly_increasing, strictly_monotonic, regular, reasons, CASE WHEN reasons = '' THEN 'pass' ELSE 'fail' END AS status FROM (
      SELECT *, rises AS strictly_increasing, rises OR falls AS strictly_monotonic, coalesce(residual <= 1e-6, false) AS regular, concat_ws(';', CASE WHEN n < 2 THEN 'too_few' END, CASE WHEN NOT finite THEN 'not_finite' END, CASE WHEN NOT ({rule}) THEN 'not_monotonic' END, CASE WHEN residual > 1e-6 THEN 'irregular_step' END) AS reasons
      FROM (SELECT *, coalesce(diff_min > 0, false) AS rises, coalesce(diff_max < 0, false) AS falls, CASE WHEN coalesce(diff_min > 0, false) THEN up ELSE down END AS residual
      FROM (SELECT {key}, count(*) AS n, min(d) AS diff_min, median(d) AS diff_median, max(d) AS diff_max, max(abs(d - 1)) AS up, max(abs(d + 1)) AS down, bool_and({z} IS NOT NULL) AS finite FROM (SELECT *, {z} - lag({z}) OVER (PARTITION BY {key} ORDER BY {tie}) AS d FROM {table}) GROUP BY {key})))"""


query("z_geometry_gate", _geometry_sql("conversations", "conv_id", "turn", "turn"), "diff_median", "n diff_min diff_max residual")(lambda t: gates.z_geometry(t.conversations, ["conv_id"], "turn", "turn", 1.0).withColumn("residual", F.col("residual").cast("long")))
query("z_geometry_lines", _geometry_sql("lineitem", "l_orderkey", "l_linenumber", "l_linenumber"), "diff_median", "n diff_min diff_max residual")(lambda t: gates.z_geometry(t.lineitem, ["l_orderkey"], "l_linenumber", "l_linenumber", 1.0).withColumn("residual", F.col("residual").cast("long")))
query("z_geometry_falling", _geometry_sql("(SELECT l_orderkey, l_linenumber AS i, CASE WHEN l_orderkey % 3 = 0 THEN l_linenumber ELSE -l_linenumber END AS z FROM lineitem)", "l_orderkey", "z", "i", False), "diff_median", "n diff_min diff_max residual")(
    lambda t: gates.z_geometry(t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("i"), F.when(F.col("l_orderkey") % 3 == 0, F.col("l_linenumber")).otherwise(-F.col("l_linenumber")).alias("z")), ["l_orderkey"], "i", "z", 1.0, increasing=False, positive=True).withColumn("residual", F.col("residual").cast("long"))
)
query(
    "page_grouping_gate",
    "SELECT conv_id, count(*) AS pages, count(DISTINCT b) AS planes, max(abs(z - z0)) AS spread, CASE WHEN count(*) = count(DISTINCT b) * 2 AND max(abs(z - z0)) <= 1e-6 THEN 'pass' ELSE 'fail' END AS status FROM (SELECT *, first_value(z) OVER (PARTITION BY conv_id, b ORDER BY turn) AS z0 FROM (SELECT conv_id, turn, floor(turn / 2) AS z, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2 AS b FROM conversations)) GROUP BY conv_id",
    "", "pages planes spread",
)(lambda t: gates.page_grouping(t.conversations.select("conv_id", "turn", F.floor(F.col("turn") / 2).alias("z")), ["conv_id"], "turn", "z", 2))
query(
    "page_count_gate",
    "SELECT coalesce(o.k, e.k) AS k, o.observed, e.expected, CASE WHEN o.observed IS NOT DISTINCT FROM e.expected THEN 'pass' ELSE 'fail' END AS status FROM (SELECT l_orderkey AS k, count(*) AS observed FROM lineitem GROUP BY 1) o FULL JOIN (SELECT o_orderkey AS k, o_orderkey % 7 + 1 AS expected FROM orders) e ON o.k = e.k",
    "", "observed expected",
)(lambda t: gates.count_gate(t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n")), t.orders.select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 7 + 1).alias("n")), ["k"]))
query(
    "stack_set_gate",
    """SELECT *, CASE WHEN reasons = '' THEN 'pass' ELSE 'fail' END AS status FROM (SELECT s_nationkey, count(*) AS n, concat_ws(';', CASE WHEN count(*) <> 2 THEN 'wrong_number' END, CASE WHEN count(DISTINCT s_suppkey % 3) > 1 THEN 'differs_shape' END, CASE WHEN NOT max(s_acctbal) - min(s_acctbal) <= 1e-6 + 1e-5 * abs(max(s_acctbal)) THEN 'apart_s_acctbal' END) AS reasons FROM supplier GROUP BY 1)""",
    "", "s_nationkey n",
)(lambda t: gates.stack_set(t.supplier.withColumn("shape", F.col("s_suppkey") % 3), ["s_nationkey"], ["shape"], ["s_acctbal"]))
query(
    "normalise_positions",
    "SELECT l_orderkey, arg_min(z, o) AS start, arg_max(z, o) AS \"end\", median(CASE WHEN d <> 0 THEN d END) AS step, count(DISTINCT z) AS slices, count(*) AS frames, coalesce(abs(arg_min(z, o) + median(CASE WHEN d <> 0 THEN d END) * (count(DISTINCT z) - 1) - arg_max(z, o)) <= 1e-6, false) AS spans, count(*) % count(DISTINCT z) = 0 AS divides FROM (SELECT *, z - lag(z) OVER (PARTITION BY l_orderkey ORDER BY o) AS d FROM (SELECT l_orderkey, l_linenumber AS z, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS o FROM lineitem)) GROUP BY l_orderkey",
    "step", 'start "end" slices frames',
)(lambda t: gates.positions_normal_form(t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("z"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")).alias("o")), ["l_orderkey"], "o", "z"))
query(
    "collapse_positions",
    "SELECT l_orderkey, n, len(list_reduce(zs, lambda a, z: CASE WHEN abs(z[1] - a[len(a)]) > 2.5 THEN list_append(a, z[1]) ELSE a END)) AS kept FROM (SELECT l_orderkey, count(*) AS n, list([l_quantity] ORDER BY l_quantity) AS zs FROM lineitem GROUP BY 1)",
    "", "n kept",
)(lambda t: t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("l_quantity")).alias("zs")).select("l_orderkey", "n", F.size(scalar.collapse_positions(F.col("zs"), 2.5)).alias("kept")))
query(
    "storage_layout",
    "SELECT l_orderkey, l_linenumber, CASE WHEN f > 0 AND q % f = 0 THEN q // f END AS stored, CASE WHEN f = 1 THEN 'raw_frame' WHEN l_returnflag = 'N' THEN 'logged_sum' ELSE 'logged_mean' END AS kind FROM (SELECT *, l_quantity::BIGINT AS q, l_linenumber::BIGINT AS f FROM lineitem)",
    "", "l_linenumber stored",
)(lambda t: t.lineitem.select("l_orderkey", "l_linenumber", scalar.stored_frames(F.col("l_quantity").cast("long"), F.col("l_linenumber")).alias("stored"), scalar.storage_class(F.col("l_linenumber"), F.col("l_returnflag") == "N").alias("kind")))
query("page_index", "SELECT l_orderkey, l_linenumber, l_quantity::BIGINT * 2 + l_linenumber % 2 AS page FROM lineitem", "", "l_linenumber page")(
    lambda t: t.lineitem.select("l_orderkey", "l_linenumber", scalar.page_index(F.col("l_quantity").cast("long"), F.lit(2), F.col("l_linenumber") % 2).alias("page"))
)
query(
    "channel_resolution",
    "SELECT o_orderkey, CASE WHEN req IS NULL THEN CASE WHEN len(saved) = 1 THEN 0 END ELSE nullif(coalesce(list_position(saved, req), 0), 0) - 1 END AS position FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN [3] ELSE [3, 4] END AS saved, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 3 ELSE 4 END AS req FROM orders)",
    "", "position",
)(
    lambda t: t.orders.select("o_orderkey", scalar.resolve_channel(F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit(3))).otherwise(F.array(F.lit(3), F.lit(4))), F.when(F.col("o_orderkey") % 3 == 1, 3).when(F.col("o_orderkey") % 3 == 2, 4)).alias("position"))
)
query("setup_normalise", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'bench2p' WHEN p_partkey % 3 = 1 THEN 'mini2p1' ELSE 'unknown' END AS setup FROM part")(
    lambda t: t.part.select("p_partkey", scalar.normalize_setup(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Rig BENCH-2P "), "p_name")).when(F.col("p_partkey") % 3 == 1, F.lit("x/mini_2P-1")).otherwise(F.lit("other"))).alias("setup"))
)
SESSION = "'op_' || replace(c_name, '#', '') || '_2026-09-' || lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0') || '_scan' || c_nationkey || '_S' || c_custkey"
_session = lambda: F.concat(F.lit("op_"), F.replace("c_name", F.lit("#"), F.lit("")), F.lit("_2026-09-"), F.lpad((F.col("c_custkey") % 28 + 1).cast("string"), 2, "0"), F.lit("_scan"), F.col("c_nationkey").cast("string"), F.lit("_S"), F.col("c_custkey").cast("string"))
query("session_parse", f"SELECT c_custkey, regexp_extract(s, '([^_/]+)_([^_/]+)_(\\d{{4}}-\\d{{2}}-\\d{{2}})_([^_/]+)_([^_/]+)/?$', 2) AS animal, CAST(strptime('2026-09-' || lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0'), '%Y-%m-%d') AS DATE)::VARCHAR AS day, 'scan' || c_nationkey AS scan FROM (SELECT *, {SESSION} AS s FROM customer)")(
    lambda t: t.customer.select("c_custkey", scalar.session_part(_session(), 2).alias("animal"), F.try_to_date(scalar.session_part(_session(), 3)).cast("string").alias("day"), scalar.session_part(_session(), 4).alias("scan"))
)
query("slug_digest", """SELECT p_partkey, coalesce(nullif(trim(regexp_replace(trim(p_name), '[^\\p{L}\\p{N}_-]', '-', 'g'), '-'), ''), 'analysis') AS slug, substr(sha256('{"brand":"' || p_brand || '","name":"' || p_name || '","size":' || p_size || '}'), 1, 8) AS digest FROM part""")(
    lambda t: t.part.select("p_partkey", scalar.slug(F.col("p_name")).alias("slug"), scalar.stable_digest(name=F.col("p_name"), size=F.col("p_size"), brand=F.col("p_brand")).alias("digest"))
)
query("run_ids", """SELECT o_orderkey, coalesce(nullif(trim(regexp_replace(trim(o_orderpriority), '[^\\p{L}\\p{N}_-]', '-', 'g'), '-'), ''), 'analysis') || '__c_' || o_custkey || '__analyzed-' || strftime(o_orderdate, '%Y%m%d') || '__' || substr(sha256('{"customer":' || o_custkey || ',"key":' || o_orderkey || '}'), 1, 8) AS run_id FROM orders""")(
    lambda t: t.orders.select("o_orderkey", scalar.run_id(F.col("o_orderpriority"), F.concat(F.lit("c_"), F.col("o_custkey").cast("string")), F.col("o_orderdate"), scalar.stable_digest(key=F.col("o_orderkey"), customer=F.col("o_custkey"))).alias("run_id"))
)
query(
    "source_channel",
    "SELECT o_orderkey, CASE WHEN error IS NULL THEN channel END AS channel, error FROM (SELECT *, CASE WHEN req IS NOT NULL AND dec IS NOT NULL AND req <> dec THEN 'conflict' WHEN channel IS NULL THEN 'ambiguous' WHEN NOT list_contains(saved, channel) THEN 'not_saved' END AS error FROM (SELECT *, coalesce(req, dec, CASE WHEN len(saved) = 1 THEN saved[1] END) AS channel FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN [3] ELSE [3, 4] END AS saved, CASE o_orderkey % 3 WHEN 1 THEN 3 WHEN 2 THEN 4 END AS req, CASE o_custkey % 3 WHEN 1 THEN 3 WHEN 2 THEN 4 END AS dec FROM orders)))",
    "", "channel",
)(lambda t: t.orders.select("o_orderkey", *(c.alias(n) for n, c in zip(("channel", "error"), scalar.choose_channel(F.when(F.col("o_orderkey") % 3 == 1, 3).when(F.col("o_orderkey") % 3 == 2, 4), F.when(F.col("o_custkey") % 3 == 1, 3).when(F.col("o_custkey") % 3 == 2, 4), F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit(3))).otherwise(F.array(F.lit(3), F.lit(4)))), strict=True))))
query("strict_casts", "SELECT l_orderkey, l_linenumber, CASE WHEN round_even(l_extendedprice / 1000 - 20, 0) > 0 THEN round_even(l_extendedprice / 1000 - 20, 0)::BIGINT END AS whole FROM lineitem", "", "l_linenumber")(
    lambda t: t.lineitem.select("l_orderkey", "l_linenumber", scalar.positive_int((F.col("l_extendedprice") / 1000 - 20).cast("string")).alias("whole"))
)
query(
    "frame_bookkeeping",
    "SELECT l_orderkey, l_linenumber, (l_orderkey % 100) * 60 + l_linenumber * 2 AS acquired_start, (l_orderkey % 100) * 60 + l_linenumber * 2 + 1 AS acquired_end, ((l_orderkey % 100) * 60 + l_linenumber * 2) / 29.97::DOUBLE AS time_s, ((l_orderkey % 100) * 30 + l_linenumber) * 3 + 1 AS page FROM lineitem",
    "time_s", "l_linenumber acquired_start acquired_end page",
)(lambda t: t.lineitem.select("l_orderkey", "l_linenumber", *scalar.bookkeeping(F.col("l_orderkey") % 100, F.col("l_linenumber"), 60, 2, 29.97, 3, 1)))
query("odd_slab", "SELECT p_size, (greatest(round_even((p_size / 1.2 - 1) / 2, 0), 0) * 2 + 1)::BIGINT AS planes, hypot_ AS shift_um FROM (SELECT DISTINCT p_size, sqrt((p_size * 0.9104) ** 2 + (p_size * 0.5) ** 2) AS hypot_ FROM part)", "shift_um", "p_size planes")(
    lambda t: t.part.select("p_size").distinct().select("p_size", scalar.odd_slab(F.col("p_size"), F.lit(1.2)).alias("planes"), scalar.to_um(F.col("p_size"), F.col("p_size"), 0.9104, 0.5).alias("shift_um"))
)
query("safe_paths", "SELECT page_id, NOT (p LIKE '/%' OR regexp_matches(p, '(^|/)\\.\\.(/|$)')) AS safe FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '../' ELSE '' END || regexp_extract(url, '://[^/]*(/.*)', 1) AS p FROM pages)")(
    lambda t: t.pages.select("page_id", scalar.safe_relative(F.concat(F.when(F.col("page_id") % 3 == 0, "../").otherwise(""), F.regexp_extract("url", "://[^/]*(/.*)", 1))).alias("safe"))
)

# --- provenance: orders stand for declarations, their lines for files --------------------------------------------------

query("post_event_day", "SELECT event_id, CASE WHEN d >= 0 AND d = declared THEN d END AS day, CASE WHEN d < 0 THEN 'negative_day' WHEN d <> declared THEN 'day_disagrees' END AS error FROM (SELECT event_id, ts::DATE - DATE '2024-01-10' AS d, (ts::DATE - DATE '2024-01-10') + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS declared FROM events)", "", "day")(
    lambda t: t.events.select("event_id", *(c.alias(n) for n, c in zip(("day", "error"), provenance.day_after(F.col("ts"), F.lit("2024-01-10").cast("date"), F.datediff("ts", F.lit("2024-01-10").cast("date")) + F.when(F.col("event_id") % 5 == 0, 1).otherwise(0)), strict=True)))
)
query("identity_relabel", "SELECT o_orderkey, CASE WHEN o_orderdate > TIMESTAMP '1995-06-17' THEN o_orderpriority ELSE o_orderstatus END AS label FROM orders")(
    lambda t: t.orders.select("o_orderkey", provenance.relabel(F.col("o_orderdate"), F.lit("1995-06-17").cast("timestamp_ntz"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("label"))
)
query(
    "manifest_admission",
    """SELECT *, reasons = '' AS admitted FROM (SELECT o.o_orderkey, coalesce(d.n, 0) AS entries, concat_ws(';', CASE WHEN d.n IS NULL THEN 'undeclared' END, CASE WHEN d.n > 1 THEN 'ambiguous' END, CASE WHEN d.n = 1 AND o.sz IS DISTINCT FROM d.sz THEN 'size_differs' END) AS reasons
      FROM (SELECT o_orderkey, o_orderkey % 7 + 1 AS sz FROM orders) o LEFT JOIN (SELECT l_orderkey, count(*) AS n, max(l_linenumber) AS sz FROM lineitem GROUP BY 1) d ON d.l_orderkey = o.o_orderkey)""",
    "", "entries",
)(lambda t: provenance.admission(t.orders.select("o_orderkey", (F.col("o_orderkey") % 7 + 1).alias("sz")), t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("long").alias("sz")), ["o_orderkey"], "sz").select("o_orderkey", "entries", "reasons", "admitted"))
query("stale_entries", "SELECT o_orderkey, o_custkey FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey")(lambda t: provenance.stale(t.orders.select("o_orderkey", "o_custkey"), t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"]))
query(
    "size_hash_check",
    """SELECT coalesce(d.doc_id, o.doc_id) AS doc_id, concat_ws(';', CASE WHEN o.doc_id IS NULL THEN 'missing' END, CASE WHEN d.doc_id IS NULL THEN 'undeclared' END, CASE WHEN d.size <> o.size THEN 'size' END, CASE WHEN d.h <> o.h THEN 'hash' END) AS errors
      FROM (SELECT doc_id, n_chars AS size, sha256(text) AS h FROM documents) d FULL JOIN (SELECT CASE WHEN doc_id % 7 = 0 THEN -1 - doc_id ELSE doc_id END AS doc_id, length(trim(text)) AS size, sha256(trim(text)) AS h FROM documents) o ON o.doc_id = d.doc_id
      WHERE o.doc_id IS NULL OR d.doc_id IS NULL OR d.size <> o.size OR d.h <> o.h""",
)(
    lambda t: provenance.compare_outputs(
        t.documents.select("doc_id", F.col("n_chars").alias("size"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256")),
        # each seventh file was renamed
        t.documents.select(F.expr("CASE WHEN doc_id % 7 = 0 THEN -1 - doc_id ELSE doc_id END").alias("doc_id"), F.char_length(F.trim("text")).cast("long").alias("size"), F.sha2(F.trim("text").cast("binary"), 256).alias("sha256")),
        "doc_id",
    )
)
query(
    "declaration_conflicts",
    "SELECT o_orderkey, array_to_string(list_sort(list_filter([CASE WHEN o_custkey % 25 <> c_nationkey THEN 'nation:' || (o_custkey % 25) || '|' || c_nationkey END, CASE WHEN (CASE o_orderstatus WHEN 'F' THEN 'BUILDING' ELSE 'MACHINERY' END) <> c_mktsegment THEN 'segment:' || (CASE o_orderstatus WHEN 'F' THEN 'BUILDING' ELSE 'MACHINERY' END) || '|' || c_mktsegment END], lambda x: x IS NOT NULL)), ';') AS conflicts FROM orders JOIN customer ON o_custkey = c_custkey",
)(
    lambda t: t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", provenance.conflict_text(provenance.conflicts([("nation", F.col("o_custkey") % 25, F.col("c_nationkey").cast("long")), ("segment", F.when(F.col("o_orderstatus") == "F", "BUILDING").otherwise("MACHINERY"), F.col("c_mktsegment"))])).alias("conflicts"))
)
query("review_flag_join", "SELECT DISTINCT s.s_suppkey, f.c_custkey AS flag_id FROM supplier s JOIN customer f ON (s.s_nationkey = f.c_nationkey AND s.s_suppkey % 5 = f.c_custkey % 5) OR s.s_suppkey = f.c_custkey % 100")(
    lambda t: provenance.review_flags(
        t.supplier.select("s_suppkey", F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 5).alias("part"), F.col("s_suppkey").alias("path")),
        t.customer.select(F.col("c_custkey").alias("flag_id"), F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 5).alias("part"), (F.col("c_custkey") % 100).alias("path")),
        ["nation", "part"], "path",
    ).select("s_suppkey", "flag_id")
)
query("eligibility", "SELECT doc_id, 'eligible' AS reconstruction, CASE WHEN reasons = '' THEN 'eligible' ELSE 'hold' END AS longitudinal, reasons FROM (SELECT d.doc_id, concat_ws(';', CASE WHEN l.doc_id IS NULL THEN 'day_unknown' END, CASE WHEN l.toxic = 1 THEN 'review_flag' END) AS reasons FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)")(
    lambda t: t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", *provenance.eligibility(F.col("quality").isNull(), F.coalesce(F.col("toxic") == 1, F.lit(False))))
)
query("dangling_assets", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 3)")(lambda t: provenance.dangling(t.lineitem.select("l_orderkey", F.col("l_partkey")), t.part.where("p_size > 3").select(F.col("p_partkey").alias("l_partkey")), "l_partkey").select("l_orderkey", "l_partkey"))

# --- runs, pairs, roll-ups ---------------------------------------------------------------------------------------------

RUN = """SELECT {k} coalesce(max(n) FILTER (hot), 0) AS longest_run FROM (SELECT {k} hot, isl, count(*) AS n FROM (SELECT {k} hot, row_number() OVER ({p} ORDER BY ts, event_id) - row_number() OVER (PARTITION BY {k} hot ORDER BY ts, event_id) AS isl FROM (SELECT *, value > 50 AS hot FROM events)) GROUP BY ALL) {g}"""
query("longest_run_by_key", RUN.format(k="user_id,", p="PARTITION BY user_id", g="GROUP BY user_id"), "", "longest_run")(lambda t: stats.longest_run(t.events.withColumn("hot", F.col("value") > 50), ["user_id"], ["ts", "event_id"], "hot"))
query("longest_run_by_type", RUN.format(k="event_type,", p="PARTITION BY event_type", g="GROUP BY event_type"), "", "longest_run")(lambda t: stats.longest_run_of_large(t.events.withColumn("hot", F.col("value") > 50), ["event_type"], ["ts", "event_id"], "hot", 20))
query("repeat_pairs", "SELECT a.s_nationkey, a.s_suppkey AS first, b.s_suppkey AS second FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey", "", "s_nationkey")(lambda t: features.repeat_pairs(t.supplier, ["s_nationkey"], "s_suppkey"))


def _overlaps(t: Tables) -> DataFrame:
    s = t.supplier.select("s_suppkey", "s_nationkey", (F.col("s_acctbal") / 100).alias("z_lo"), (F.col("s_acctbal") / 100 + 40).alias("z_hi"))
    return features.overlap(features.repeat_pairs(s, ["s_nationkey"], "s_suppkey", ["z_lo", "z_hi"]), ["z"], 4, 2.0).select("first", "second", "z_lo", "z_hi", "z_n", "usable")


query(
    "grid_overlap",
    "SELECT first, second, z_lo, z_hi, z_n, z_n >= 4 AS usable FROM (SELECT *, greatest(floor((z_hi - z_lo) / 2.0 + 1e-9) + 1, 0)::BIGINT AS z_n FROM (SELECT a.s_suppkey AS first, b.s_suppkey AS second, greatest(a.s_acctbal / 100, b.s_acctbal / 100) AS z_lo, least(a.s_acctbal / 100 + 40, b.s_acctbal / 100 + 40) AS z_hi FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey))",
    "z_lo z_hi",
)(_overlaps)
LM = """lm AS (SELECT vec_id AS id, label, embedding[1]::DOUBLE * 10 AS a, embedding[2]::DOUBLE * 10 AS b, embedding[3]::DOUBLE * 10 AS c FROM embeddings),
nn AS (SELECT l.id, arg_min(r.id, (d, r.id)) AS match, min(d) AS distance FROM (SELECT * FROM lm WHERE label % 2 = 0) l LEFT JOIN LATERAL (SELECT r.id, sqrt((l.a - r.a) ** 2 + (l.b - r.b) ** 2 + (l.c - r.c) ** 2) AS d FROM lm r WHERE r.label % 2 = 1) r ON d <= 8 GROUP BY l.id)"""


def _nearest(t: Tables) -> DataFrame:
    e = t.embeddings.select(F.col("vec_id").alias("id"), "label", *((F.get("embedding", F.lit(i)).cast("double") * 10).alias(n) for i, n in enumerate("abc")))
    return features.nearest(e.where("label % 2 = 0"), e.where("label % 2 = 1"), ["a", "b", "c"], 8.0)


query("nearest_landmark", "SELECT * FROM nn", "distance", "", ctes=LM)(_nearest)
query("landmark_summary", "SELECT count(*) AS landmarks, count(distance) AS matched, coalesce(median(distance), 'NaN'::DOUBLE) AS error_median, coalesce(quantile_cont(distance, 0.95), 'NaN'::DOUBLE) AS error_p95 FROM nn", "error_median error_p95", "landmarks matched", ctes=LM)(lambda t: features.landmark_summary(_nearest(t)))
query("status_rollup", "SELECT user_id, CASE WHEN bool_or(value < 0) THEN 'fail' WHEN quantile_cont(value, 0.95) > 95 THEN 'needs_review' ELSE 'pass' END AS status FROM events GROUP BY user_id")(
    lambda t: t.events.groupBy("user_id").agg(gates.rollup(F.bool_or(F.col("value") < 0), stats.percentile("value", 0.95) > 95).alias("status"))
)
query("retention_summary", f"SELECT count(*) AS planes, min(r) AS retained_min, avg(r) AS retained_mean, count_if(r < 0.9) AS relaxed, bool_or(r < 0.9) AS any_relaxed FROM (SELECT plane, avg((isfinite(f.corr) AND f.corr >= t.threshold)::INT) AS r FROM fs f JOIN {_bound('fs', 1.0)} t USING (plane) GROUP BY plane)", "retained_min retained_mean", "planes relaxed", True, FQ)(
    lambda t: recon.kept_frames(recon.frame_statistics(t.frames()), 1.0, 0.0).groupBy("scan_id", "plane").agg(F.avg(F.col("keep").cast("double")).alias("r")).groupBy("scan_id").agg(F.count("*").alias("planes"), F.min("r").alias("retained_min"), F.avg("r").alias("retained_mean"), F.count_if(F.col("r") < 0.9).alias("relaxed"), F.bool_or(F.col("r") < 0.9).alias("any_relaxed"))
)
query(
    "synthetic_gates",
    """WITH d AS (SELECT l_returnflag, l_quantity / 50 AS dy, l_discount AS dx, l_tax AS ty, 0.0::DOUBLE AS tx FROM lineitem WHERE l_linenumber <> 3), m AS (SELECT l_returnflag, median(dy) AS my, median(dx) AS mx, median(ty) AS mty FROM d GROUP BY 1)
      SELECT l_returnflag, sqrt(avg(e * e)) AS rmse, quantile_cont(e, 0.95) AS p95 FROM (SELECT l_returnflag, sqrt((dy - my - ty + mty) ** 2 + (dx - mx) ** 2) AS e FROM d JOIN m USING (l_returnflag)) GROUP BY 1""",
    "rmse p95",
)(lambda t: features.centred_error(t.lineitem.select("l_returnflag", "l_linenumber", (F.col("l_quantity") / 50).alias("dy"), F.col("l_discount").alias("dx"), F.col("l_tax").alias("true_dy"), F.lit(0.0).alias("true_dx")), ["l_returnflag"], F.col("l_linenumber") != 3))
query("newest_run", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")(lambda t: t.events.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id")))
query("pivot_methods", "SELECT label::BIGINT AS label, avg(embedding[1]::DOUBLE) FILTER (vec_id % 2 = 0) AS a, avg(embedding[1]::DOUBLE) FILTER (vec_id % 2 = 1) AS b FROM embeddings GROUP BY 1", "a b", "label")(
    lambda t: t.embeddings.select("label", F.when(F.col("vec_id") % 2 == 0, "a").otherwise("b").alias("method"), F.get("embedding", F.lit(0)).cast("double").alias("v")).groupBy("label").pivot("method", ["a", "b"]).agg(F.avg("v"))
)
query("set_difference", "SELECT p_partkey FROM part WHERE p_size > 10 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 49")(lambda t: t.part.where("p_size > 10").select("p_partkey").subtract(t.lineitem.where("l_quantity > 49").select("l_partkey")))
query("union_of_columns", "SELECT doc_id AS id, lang, NULL::VARCHAR AS url FROM documents UNION ALL SELECT page_id, NULL, url FROM pages")(lambda t: io.union_rows(t.documents.select(F.col("doc_id").alias("id"), "lang"), t.pages.select(F.col("page_id").alias("id"), "url")))

# --- registration: Fourier transforms in Arrow functions; as SQL they are joins (registration_sql) -----------------------

query("phase_shift", "SELECT * FROM fsh", "dy dx error corr_before corr_after", "plane local_index", True, reg.frame_shifts())(lambda t: register.frame_shifts(t.frames(), condition=None))
RULE = ", ".join((reg.frame_shifts(), reg.rule("fsh", 8.0, 3.0, 4.0, -0.02)))
query("registration_keep", "SELECT * FROM rule", "dy dx error corr_before corr_after magnitude gain corr_bound error_bound", "plane local_index", True, RULE)(lambda t: register.registration_keep(register.frame_shifts(t.frames(), condition=None)))
query("cross_plane_registration", "SELECT * FROM cp", "dy dx error corr cum_dy cum_dx", "plane", True, reg.cross_plane())(lambda t: register.cross_plane(t.med()))
query("drift_corrected", "SELECT plane, y, x, v FROM co", "v", "plane y x", True, reg.corrected())(lambda t: register.corrected(t.med()))
query("drift_within_planes", "SELECT * FROM dw", "dy dx magnitude error corr_before corr_after", "plane", True, reg.within())(lambda t: register.drift_within(t.frames()))


def _methods(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    f = t.frames()
    kept = keep(register.registration_keep(register.frame_shifts(f, condition=None)))
    legacy = keep(recon.kept_frames(recon.frame_statistics(f)))
    return kept, legacy, register.plane_methods(f, kept, legacy)


METHODS = ", ".join((FQ, _kept_sql(3.0), RULE, reg.methods()))
query("xy_methods", "SELECT * FROM me", "v", "plane y x", True, METHODS)(lambda t: _methods(t)[2])
query(
    "xy_plane_summary", reg.summary(), "kept_share corr_bound error_bound shift_p50 shift_p95 shift_max shift_um_p95 corr_before corr_after gain error_mean error_p95 legacy_kept_share legacy_bound sharpness_A sharpness_B sharpness_C sharpness_D",
    "plane frames kept legacy_kept longest_rejected legacy_longest_rejected", True, METHODS,
)(lambda t: register.plane_summary(*_methods(t)))


def _metrics_sql(tables: dict[str, str]) -> str:
    """volume_metrics() of volumes by name, at spacings of 2, 0.9 and 0.5."""
    return " UNION ALL ".join(
        f"""SELECT (SELECT avg(v) FILTER (isfinite(v)) FROM {s}) AS mean, (SELECT stddev_pop(v) FILTER (isfinite(v)) FROM {s}) AS std, (SELECT avg(isfinite(v)::INT) FROM {s}) AS finite, avg(corr) FILTER (isfinite(corr)) AS adjacent_mean, median(corr) FILTER (isfinite(corr)) AS adjacent_median, '{n}' AS method,
          {_sharp(f"SELECT plane AS i, x AS j, v FROM {s} WHERE y = 4", 2.0, 0.5)} AS tenengrad_xz, {_sharp(f"SELECT plane AS i, y AS j, v FROM {s} WHERE x = 4", 2.0, 0.9)} AS tenengrad_yz, {_sharp(f"SELECT y AS i, x AS j, max(v) AS v FROM {s} GROUP BY ALL", 0.9, 0.5)} AS tenengrad_axial FROM {_lags(s, 1)}"""
        for n, s in tables.items()
    )


query(
    "xy_volume_metrics", _metrics_sql({m: f"me_{m}" for m in "ABCD"}), "mean std finite adjacent_mean adjacent_median tenengrad_xz tenengrad_yz tenengrad_axial", "", True,
    METHODS + "".join(f", me_{m} AS (SELECT plane, y, x, v FROM me WHERE method = '{m}')" for m in "ABCD"),
)(lambda t: register.stack_pass(t.frames(), (2.0, 0.9, 0.5), condition=None, most_lag=4)["volumes"])
# lines stand for registered frames, so that the rule itself has SQL
KEEP = """sh AS (SELECT l_returnflag AS scan_id, l_suppkey % 5 AS plane, row_number() OVER (PARTITION BY l_returnflag, l_suppkey % 5 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS local_index, l_discount * 100 - 3 AS dy, l_tax * 100 - 4 AS dx, CASE WHEN l_quantity < 2 THEN 'NaN'::DOUBLE ELSE l_extendedprice / 10000 END AS error, 0.5::DOUBLE AS corr_before, CASE WHEN l_linenumber = 7 THEN 'NaN'::DOUBLE ELSE 1 - l_quantity / 100 END AS corr_after FROM lineitem),
v AS (SELECT *, sqrt(dy * dy + dx * dx) AS magnitude, corr_after - corr_before AS gain, sqrt(dy * dy + dx * dx) <= 5.5 AS valid FROM sh),
b AS (SELECT scan_id, plane, coalesce(median(corr_after) FILTER (valid AND isfinite(corr_after)) - 0.5 * 1.4826 * mad(corr_after) FILTER (valid AND isfinite(corr_after)), 'Infinity'::DOUBLE) AS corr_bound, coalesce(median(error) FILTER (valid AND isfinite(error)) + 0.5 * 1.4826 * mad(error) FILTER (valid AND isfinite(error)), '-Infinity'::DOUBLE) AS error_bound FROM v GROUP BY ALL),
o AS (SELECT v.*, corr_bound, error_bound, valid AND isfinite(corr_after) AND corr_after >= corr_bound AND isfinite(error) AND error <= error_bound AND isfinite(gain) AND gain >= 0.2 AS ok, valid AND isfinite(corr_after) AS may FROM v JOIN b USING (scan_id, plane)),
r AS (SELECT *, sum(ok::INT) OVER w < greatest(1, ceil(count(*) OVER w * 0.3)) AS relaxed, greatest(1, ceil(count(*) OVER w * 0.3)) AS need, row_number() OVER (PARTITION BY scan_id, plane ORDER BY may DESC, CASE WHEN isfinite(corr_after) THEN corr_after ELSE '-Infinity'::DOUBLE END DESC, local_index DESC) AS rk FROM o WINDOW w AS (PARTITION BY scan_id, plane))"""


def _line_shifts(t: Tables) -> DataFrame:
    nan = F.lit(float("nan"))
    at = F.row_number().over(Window.partitionBy("l_returnflag", F.col("l_suppkey") % 5).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1
    return t.lineitem.select(F.col("l_returnflag").alias("scan_id"), (F.col("l_suppkey") % 5).alias("plane"), at.cast("long").alias("local_index"), (F.col("l_discount") * 100 - 3).alias("dy"), (F.col("l_tax") * 100 - 4).alias("dx"), F.when(F.col("l_quantity") < 2, nan).otherwise(F.col("l_extendedprice") / 10000).alias("error"), F.lit(0.5).alias("corr_before"), F.when(F.col("l_linenumber") == 7, nan).otherwise(1 - F.col("l_quantity") / 100).alias("corr_after"))


query(
    "registration_rule",
    f"""SELECT scan_id, plane, local_index, dy, dx, error, corr_before, corr_after, magnitude, gain, valid, corr_bound, error_bound, relaxed, CASE WHEN relaxed THEN may AND rk <= need ELSE ok END AS keep,
      concat_ws(';', CASE WHEN magnitude > 5.5 THEN '{register.SHIFT}' END, CASE WHEN isfinite(corr_after) AND corr_after < corr_bound THEN '{register.CORRELATION}' END, CASE WHEN isfinite(error) AND error > error_bound THEN '{register.ERROR}' END, CASE WHEN isfinite(gain) AND gain < 0.2 THEN '{register.GAIN}' END) AS reasons FROM r""",
    "dy dx error corr_before corr_after magnitude gain corr_bound error_bound", "plane local_index", ctes=KEEP,
)(lambda t: register.registration_keep(_line_shifts(t), 5.5, 0.5, 0.5, 0.2))


NOTHING = KEEP.replace("CASE WHEN l_linenumber = 7 THEN", "CASE WHEN l_linenumber = 7 OR l_suppkey % 5 = 4 THEN")
query(
    "registration_status",
    "SELECT scan_id, plane, count(*) AS frames, count_if(keep) AS kept, CASE WHEN count_if(keep) = 0 THEN 'nothing_kept' ELSE 'pass' END AS status FROM (SELECT *, CASE WHEN relaxed THEN may AND rk <= need ELSE ok END AS keep FROM r) GROUP BY ALL",
    "", "plane frames kept", ctes=NOTHING,
)(lambda t: register.plane_status(register.registration_keep(_line_shifts(t).withColumn("corr_after", F.when(F.col("plane") == 4, float("nan")).otherwise(F.col("corr_after"))), 5.5, 0.5, 0.5, 0.2)))


def _repeats(t: Tables) -> DataFrame:
    """Even and odd frames of each stack stand for two repeats; spacing 1 µm everywhere."""
    f = t.frames()
    half = lambda i: recon.median_volume(f.where(F.col("local_index") % 2 == i))
    return features.compare_repeats(keep(half(0)), keep(half(1)), 1.0, most_um=4.0, count=5, distance_um=1.0, radius_um=3.0, percentile=0.9)


query("repeat_volumes", None)(_repeats)

query("synthetic_registration", None)(lambda t: synthetic.evaluate(t.spark))

# --- turned views --------------------------------------------------------------------------------------------------------

ANGLE = 30.0


def _turn_sql(nearest: bool) -> str:
    c, s, (rows, columns), (a, b) = render.turn(WIDTH, WIDTH, ANGLE)
    to = f"""SELECT plane, to_y, to_x, round({c!r} * to_y + {s!r} * to_x + {a!r}, 9) AS fy, round({c!r} * to_x - {s!r} * to_y + {b!r}, 9) AS fx
      FROM (SELECT DISTINCT plane FROM med), (SELECT unnest(generate_series(0, {rows - 1})) AS to_y), (SELECT unnest(generate_series(0, {columns - 1})) AS to_x)"""
    inside = f"fy BETWEEN 0 AND {WIDTH - 1} AND fx BETWEEN 0 AND {WIDTH - 1}"
    if nearest:
        return f"SELECT t.plane, to_y AS y, to_x AS x, CASE WHEN {inside} THEN coalesce(v, 0) ELSE 0 END AS v FROM ({to}) t LEFT JOIN med m ON m.plane = t.plane AND m.y = floor(fy + 0.5) AND m.x = floor(fx + 0.5)"
    return f"""SELECT g.plane, to_y AS y, to_x AS x, sum(coalesce(m.v * w, 0)) AS v FROM (
      SELECT plane, to_y, to_x, floor(fy) + i AS sy, floor(fx) + j AS sx, CASE WHEN {inside} THEN (CASE i WHEN 0 THEN 1 - fy + floor(fy) ELSE fy - floor(fy) END) * (CASE j WHEN 0 THEN 1 - fx + floor(fx) ELSE fx - floor(fx) END) ELSE 0 END AS w
      FROM ({to}), (VALUES (0), (1)) p(i), (VALUES (0), (1)) r(j)) g LEFT JOIN med m ON m.plane = g.plane AND m.y = g.sy AND m.x = g.sx GROUP BY ALL"""


query("rotate_planes", _turn_sql(False), "v", "plane y x", "one")(lambda t: render.rotate(t.one_med(), ANGLE))
query("rotate_mask", _turn_sql(True), "v", "plane y x", "one")(lambda t: render.rotate(t.one_med(), ANGLE, nearest=True))
query("edge_dilation", "SELECT DISTINCT plane, y + i AS y, x + j AS x FROM med, (VALUES (-2), (-1), (0), (1), (2)) p(i), (VALUES (-2), (-1), (0), (1), (2)) r(j) WHERE v > 0.03 AND abs(i) + abs(j) <= 2 AND y + i BETWEEN 0 AND 7 AND x + j BETWEEN 0 AND 7", "", "plane y x", True)(
    lambda t: render.dilate(t.med().where("v > 0.03").select("scan_id", "plane", "y", "x"), (WIDTH, WIDTH), 2)
)
query("crop_nonzero", "SELECT plane, y - greatest(ly - 1, 0) AS y, x - greatest(lx - 1, 0) AS x, v FROM med JOIN (SELECT plane, min(y) AS ly, max(y) AS hy, min(x) AS lx, max(x) AS hx FROM med WHERE v > 0.03 GROUP BY plane) USING (plane) WHERE y BETWEEN ly - 1 AND hy + 1 AND x BETWEEN lx - 1 AND hx + 1", "v", "plane y x", True)(
    lambda t: render.crop_nonzero(t.med(), 0.03, 1)
)
VIEWS, CUBOID = views_sql.views("med", (10, 8, 8), 2.0, 1.0), views_sql.cuboid("med", (10, 8, 8), (1.0, 1.0, 1.0), 64, 0.0)
query("oblique_views", VIEWS[1], "v", "y x", "one", VIEWS[0])(lambda t: render.views(t.one_med(), 2.0, 1.0))
query("cuboid_render", CUBOID[1], "v", "y x", "one", CUBOID[0])(lambda t: render.cuboid(t.one_med(), (1.0, 1.0, 1.0), most=64, threshold=0.0))

# --- files ---------------------------------------------------------------------------------------------------------------


def _ome(t: Tables) -> DataFrame:
    folder = scratch(t.spark)
    made = [r["path"] for r in tiff.write_volumes(t.med(), folder, (2.0, 0.5, 0.5)).collect()]  # a row a stack
    name = F.regexp_extract("path", r"([^/]+)\.ome\.tif$", 1)
    spacing = t.spark.createDataFrame([(p, *tiff.physical_spacing(t.spark, p)) for p in made], "path string, z double, py double, px double").withColumn("scan_id", name).drop("path")
    v = tiff.volume(t.spark, f"{folder}/*.ome.tif").withColumn("scan_id", name).join(F.broadcast(spacing), "scan_id")  # a row a stack
    out = v.select("scan_id", (F.col("plane") * F.col("z")).alias("z_um"), (F.col("y") * F.col("py")).alias("y_um"), (F.col("x") * F.col("px")).alias("x_um"), "v")
    out = keep(out)
    delete(t.spark, folder)
    return out


query("ome_round_trip", "SELECT plane * 2.0::DOUBLE AS z_um, y * 0.5::DOUBLE AS y_um, x * 0.5::DOUBLE AS x_um, v::FLOAT::DOUBLE AS v FROM med", "z_um y_um x_um v", "", True)(_ome)

from stackloom.plans import records  # noqa: E402, F401  registers its queries
