"""Queries of records: manifests, declarations, specifications, upstream runs, Z tables, saturation, merged stacks. Orders, lines and parts stand for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.functions import scalar
from stackloom.operators import gates, provenance, recon, saturation, volume
from stackloom.plans.catalogue import Tables, query
from stackloom.runtime import spread


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


# --- collection manifests: an order is a folder with one file, its lines the files that its manifest lists ----------------


def _manifest_admission(t: Tables) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    files = t.orders.select(key.alias("folder"), _text("f", key % 5).alias("name"), (key % 7 + 1).alias("size"), F.col("o_orderstatus").alias("setup"), _text("scan", cust).alias("scan_id"), _text("A-", cust % 10).alias("animal_id"))
    listed = t.lineitem.groupBy(F.col("l_orderkey").alias("k_")).agg(F.collect_list(F.struct(_text("f", F.col("l_linenumber")).alias("name"), (F.col("l_orderkey") % 7 + 1 + F.when(F.col("l_linenumber") == 3, 1).otherwise(0)).alias("bytes"))).alias("collected_files"))
    m = t.orders.where("o_orderkey % 4 <> 0").join(listed, key == F.col("k_"), "left").select(
        key.alias("folder"), F.when(key % 11 == 0, "2.0").otherwise("1.0").alias("schema_version"), F.lit("stack").alias("acquisition_type"), F.when(key % 13 == 0, "X").otherwise(F.col("o_orderstatus")).alias("setup_type"),
        F.when(cust % 17 == 0, "0").otherwise(cust.cast("string")).alias("scan_id"), F.when(key % 19 == 0, "bad").otherwise(_text("A-", cust % 9)).alias("animal_id"), "collected_files",
    )
    # a manifest of one file may name it without a list
    alone = F.when((F.size("collected_files") == 1) & (key % 2 == 0), F.to_json(F.struct(*(c for c in m.columns if c != "collected_files"), F.get("collected_files", F.lit(0)).alias("collected_files"))))
    documents = m.withColumnRenamed("folder", "o_orderkey").select(key.alias("folder"), F.coalesce(alone, F.to_json(F.struct(*(c for c in m.columns if c not in ("folder",))))).alias("document"))
    out = provenance.manifest_admission(files, provenance.manifests(documents), "1.0", "stack")
    return out.drop("setup", "scan_id", "manifest_sha256", "z_stack").withColumn("selected_file", F.concat_ws(":", "selected_file.name", F.col("selected_file.bytes").cast("string")))


query(
    "collection_manifest",
    """SELECT folder, name, size, status, reasons, CASE WHEN status = 'pass' THEN declared ELSE path_animal_id END AS animal_id, path_animal_id, declared AS declared_animal_id, CASE WHEN status = 'pass' THEN 'collection_manifest' ELSE 'session_path' END AS identity_source, status = 'pass' AND declared <> path_animal_id AS animal_id_corrected, CASE WHEN status = 'pass' THEN name || ':' || size ELSE '' END AS selected_file FROM (
      SELECT *, CASE WHEN NOT there THEN 'absent' WHEN reasons = '' THEN 'pass' ELSE 'fail' END AS status FROM (
      SELECT *, CASE WHEN there THEN concat_ws(';', CASE WHEN folder % 11 = 0 THEN 'version' END, CASE WHEN folder % 13 = 0 THEN 'rig' END, CASE WHEN cust % 17 = 0 AND cust <> 0 THEN 'scan' END, CASE WHEN hits <> 1 THEN 'not_unique' END, CASE WHEN hits = 1 AND listed <> size THEN 'size_differs' END, CASE WHEN declared = 'bad' THEN 'animal' END) ELSE '' END AS reasons FROM (
      SELECT o_orderkey AS folder, o_custkey AS cust, 'f' || (o_orderkey % 5) AS name, o_orderkey % 7 + 1 AS size, 'A-' || (o_custkey % 10) AS path_animal_id, o_orderkey % 4 <> 0 AS there, CASE WHEN o_orderkey % 4 <> 0 THEN CASE WHEN o_orderkey % 19 = 0 THEN 'bad' ELSE 'A-' || (o_custkey % 9) END END AS declared,
        coalesce(hits, 0) AS hits, listed FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS hits, max(l_orderkey % 7 + 1 + CASE WHEN l_linenumber = 3 THEN 1 ELSE 0 END) AS listed FROM lineitem WHERE l_linenumber = l_orderkey % 5 GROUP BY 1) ON l_orderkey = o_orderkey)))""",
    "", "size",
)(_manifest_admission)

# --- declarations of acquisitions ----------------------------------------------------------------------------------------

REQUIRED = ("schema_version", "data_kind", "animal_id", "acquisition_date", "scan_id", "source_tiff")


def _acquisitions(t: Tables) -> DataFrame:
    key, cust, day = F.col("o_orderkey"), F.col("o_custkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    scans = t.orders.select(key.alias("folder"), _text("A-", cust % 10).alias("animal_id"), day.alias("acquisition_date"), _text("scan", cust).alias("scan_id"), _text("s", key).alias("source_tiff"))
    days = F.datediff("o_orderdate", F.lit("1995-01-01").cast("date"))
    document = F.to_json(F.struct(
        F.when(key % 7 != 0, F.lit("v1")).alias("schema_version"), F.when(key % 11 == 0, "other").otherwise("stack").alias("data_kind"), _text("A-", F.when(key % 5 == 0, cust % 9).otherwise(cust % 10)).alias("animal_id"), day.alias("acquisition_date"),
        F.when(cust % 13 == 0, "scan0").otherwise(_text("scan", cust)).alias("scan_id"), _text("s", key).alias("source_tiff"), F.when(key % 2 == 0, F.lit("1995-01-01")).alias("surgery_date"), F.when(key % 23 == 0, days + 1).otherwise(days).alias("post_surgery_day"), F.lit(3).alias("source_channel"),
    ))
    d = t.orders.where("o_orderkey % 3 <> 0").select(key.alias("folder"), document.alias("document"))
    out = provenance.acquisition_context(scans, d, "folder", ["animal_id", "acquisition_date", "scan_id"], "source_tiff", REQUIRED, {"schema_version": "v1", "data_kind": "stack"})
    return out.select("folder", "status", "error", provenance.conflict_text(F.col("conflicts")).alias("conflicts"), "post_surgery_day", "declared_channel")


query(
    "acquisition_context",
    """SELECT folder, CASE WHEN NOT there THEN 'metadata_incomplete' WHEN error IS NULL THEN 'pass' ELSE 'fail' END AS status, CASE WHEN there THEN error END AS error, CASE WHEN there THEN conflicts END AS conflicts, CASE WHEN there AND error IS NULL THEN day END AS post_surgery_day, CASE WHEN there AND error IS NULL THEN 3 END AS declared_channel FROM (
      SELECT *, CASE WHEN folder % 7 = 0 THEN 'lacks schema_version' WHEN folder % 11 = 0 THEN 'unsupported' WHEN conflicts <> '' THEN 'conflicts' WHEN folder % 2 = 0 AND d < 0 THEN 'negative_day' WHEN folder % 2 = 0 AND folder % 23 = 0 THEN 'day_disagrees' END AS error, CASE WHEN folder % 2 = 0 THEN d WHEN folder % 23 = 0 THEN d + 1 ELSE d END AS day FROM (
      SELECT o_orderkey AS folder, o_orderkey % 3 <> 0 AS there, o_orderdate::DATE - DATE '1995-01-01' AS d, concat_ws(';', CASE WHEN o_orderkey % 5 = 0 AND o_custkey % 9 <> o_custkey % 10 THEN 'animal_id:A-' || (o_custkey % 9) || '|A-' || (o_custkey % 10) END, CASE WHEN o_custkey % 13 = 0 AND o_custkey <> 0 THEN 'scan_id:scan0|scan' || o_custkey END) AS conflicts FROM orders))""",
    "", "post_surgery_day declared_channel",
)(_acquisitions)

# --- single stacks, specifications, styles -------------------------------------------------------------------------------

query(
    "single_stack_gate",
    "SELECT p_partkey, reasons, CASE WHEN reasons = '' THEN 'pass' ELSE 'fail' END AS status FROM (SELECT p_partkey, concat_ws(';', CASE WHEN p_brand <> 'Brand#13' THEN 'wrong_rig' END, CASE WHEN p_size % 2 <> 0 THEN 'stack_disabled' END, CASE WHEN p_type NOT IN ('ECONOMY', 'LARGE') THEN 'wrong_mode' END) AS reasons FROM part)",
)(lambda t: gates.single_stack(t.part.select("p_partkey", F.col("p_brand").alias("setup"), (F.col("p_size") % 2 == 0).alias("stack_enabled"), F.col("p_type").alias("stack_mode")), "Brand#13", ("ECONOMY", "LARGE")).select("p_partkey", "reasons", "status"))


def _specs(t: Tables) -> DataFrame:
    size = F.col("p_size")
    document = F.to_json(F.struct(F.col("p_name").alias("title"), F.when(size % 3 != 0, F.lit("q")).alias("question"), F.when(size % 5 == 0, "draft").otherwise("exploratory").alias("analysis_state"), F.struct(F.lit("median").alias("id"), F.when(size % 7 == 0, "2").otherwise("1").alias("version")).alias("pipeline")))
    style = F.to_json(F.struct(F.when(size % 4 == 0, "v2").otherwise("v1").alias("schema_version"), F.struct(F.when(size % 6 == 0, F.array(F.lit("pdf"))).otherwise(F.array(F.lit("svg"), F.lit("pdf"))).alias("editable_vector_formats"), (size * 20).alias("png_dpi")).alias("output"), F.struct(F.lit("x").alias("qc")).alias("profiles")))
    return t.part.select("p_partkey", gates.analysis_spec(document, ("title", "question", "analysis_state", "pipeline"), {"id": "median", "version": "1"}, ("exploratory", "confirmatory")).alias("spec_errors"), gates.figure_style(style, "qc", "v1").alias("style_errors"))


query(
    "spec_validation",
    "SELECT p_partkey, concat_ws(';', CASE WHEN p_size % 3 = 0 THEN 'lacks_keys' END, CASE WHEN p_size % 7 = 0 THEN 'other_pipeline' END, CASE WHEN p_size % 5 = 0 THEN 'state_not_allowed' END) AS spec_errors, concat_ws(';', CASE WHEN p_size % 4 = 0 THEN 'version' END, CASE WHEN p_size % 6 = 0 THEN 'no_svg' END, CASE WHEN p_size * 20 < 300 THEN 'low_dpi' END) AS style_errors FROM part",
)(_specs)
query("json_properties", "SELECT event_type, count(*) AS n, sum(k) AS k_sum, count(DISTINCT k) AS k_values, min(canonical) AS first_document FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS canonical FROM events) GROUP BY event_type", "", "n k_sum k_values")(
    lambda t: t.events.select("event_type", F.from_json("props", "map<string,bigint>").alias("m")).groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.element_at("m", "k")).alias("k_sum"), F.count_distinct(F.element_at("m", "k")).alias("k_values"), F.min(F.to_json("m")).alias("first_document"))
)

# --- runs made from other runs, Z tables ---------------------------------------------------------------------------------

query("upstream_qc", "SELECT l_orderkey, upstream_status, CASE WHEN o_orderkey IS NULL THEN 'error' WHEN upstream_status = 'pass' THEN 'pass' ELSE 'needs_review' END AS status FROM (SELECT DISTINCT l_orderkey FROM lineitem) LEFT JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'pass' ELSE 'fail' END AS upstream_status FROM orders WHERE o_orderkey % 5 <> 0) ON o_orderkey = l_orderkey")(
    lambda t: provenance.upstream_qc(t.lineitem.select("l_orderkey").distinct(), t.orders.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderkey") % 7 == 0, F.lit(None)).when(F.col("o_orderstatus") == "F", "pass").otherwise("fail").alias("status")), "l_orderkey")
)


def _z_of_planes(t: Tables) -> DataFrame:
    lines = spread(t.lineitem.select("l_orderkey", F.col("l_linenumber").cast("long").alias("plane")), "l_orderkey", "plane").distinct()
    upstream = lines.where("l_orderkey % 3 <> 0 AND (l_orderkey % 4 <> 0 OR plane > 1)").withColumn("z_um", F.col("plane") * F.lit(2.0))
    return provenance.z_of_planes(lines, upstream, lines.withColumn("z_um", F.col("plane") + F.lit(0.5)), ["l_orderkey"])


query(
    "z_of_planes",
    """WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber::BIGINT AS plane FROM lineitem), u AS (SELECT *, plane * 2.0::DOUBLE AS z FROM l WHERE l_orderkey % 3 <> 0 AND (l_orderkey % 4 <> 0 OR plane > 1)), w AS (SELECT l_orderkey FROM l LEFT JOIN u USING (l_orderkey, plane) GROUP BY 1 HAVING count(*) = count(z))
      SELECT l.l_orderkey, l.plane, CASE WHEN w.l_orderkey IS NOT NULL THEN l.plane * 2.0::DOUBLE ELSE l.plane + 0.5::DOUBLE END AS z_um, CASE WHEN w.l_orderkey IS NOT NULL THEN 'upstream' ELSE 'header' END AS z_source FROM l LEFT JOIN w USING (l_orderkey)""",
    "z_um",
)(_z_of_planes)
query(
    "stacks_in_order_of_z",
    "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY zs[1], zs, o_orderkey) - 1 AS place FROM (SELECT o_custkey, o_orderkey, q || [o_orderkey::DOUBLE] AS zs FROM orders JOIN (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)",
    "", "place",
)(
    lambda t: provenance.in_order_of_z(
        t.lineitem.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda s: s["l_quantity"]).alias("q")).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "o_orderkey", F.concat("q", F.array(F.col("o_orderkey").cast("double"))).alias("z_um")), ["o_custkey"]
    ).select("o_custkey", "o_orderkey", "place")
)
query(
    "supersession",
    "SELECT a.o_orderkey AS analysis_id, a.s AS supersedes, b.n AS superseded_by, CASE WHEN a.s = a.o_orderkey THEN 'itself' WHEN a.s < 0 THEN 'unknown' END AS error FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN o_orderkey WHEN o_orderkey % 89 = 0 THEN -5 WHEN o_orderkey % 4 = 1 THEN o_orderkey - 1 END AS s FROM orders) a LEFT JOIN (SELECT s, min(o_orderkey) AS n FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN o_orderkey WHEN o_orderkey % 89 = 0 THEN -5 WHEN o_orderkey % 4 = 1 THEN o_orderkey - 1 END AS s FROM orders) GROUP BY s) b ON b.s = a.o_orderkey",
)(lambda t: provenance.superseded(t.orders.select(F.col("o_orderkey").alias("analysis_id"), F.expr("CASE WHEN o_orderkey % 97 = 0 THEN o_orderkey WHEN o_orderkey % 89 = 0 THEN -5 WHEN o_orderkey % 4 = 1 THEN o_orderkey - 1 END").alias("supersedes"))))

# chains of up to sixteen orders, each superseding the one before; in each fourth one the first supersedes the last
CHAIN = "CASE WHEN o_orderkey % 64 = 0 THEN o_orderkey + 15 WHEN o_orderkey % 16 <> 0 THEN o_orderkey - 1 END"
query(
    "supersession_heads",
    f"""WITH RECURSIVE nx AS (SELECT s AS id, min(id) AS nxt FROM (SELECT o_orderkey AS id, {CHAIN} AS s FROM orders) WHERE s <> id GROUP BY s),
    w AS (SELECT o_orderkey AS id, o_orderkey AS here, 0 AS steps, [o_orderkey] AS path FROM orders UNION ALL SELECT w.id, nxt, steps + 1, list_append(path, nxt) FROM w JOIN nx ON nx.id = w.here WHERE NOT list_contains(path, nxt))
    SELECT id AS analysis_id, CASE WHEN nxt IS NULL THEN here END AS head, CASE WHEN nxt IS NULL THEN steps END AS steps, CASE WHEN nxt IS NOT NULL THEN list_min(path[list_position(path, nxt):]) END AS cycle
      FROM (SELECT id, arg_max(here, steps) AS here, max(steps) AS steps, arg_max(path, steps) AS path FROM w GROUP BY id) e LEFT JOIN (SELECT id AS at_, nxt FROM nx) n ON n.at_ = e.here""",
    "", "analysis_id head steps cycle",
)(lambda t: provenance.chains(t.orders.select(F.col("o_orderkey").alias("analysis_id"), F.expr(CHAIN).alias("supersedes"))))

# --- saturation: the values of all frames, times 20, as whole intensities ------------------------------------------------

SATURATION = """hs AS (SELECT floor(v * 20)::BIGINT AS value, count(*) AS n FROM vox GROUP BY 1), cu AS (SELECT *, sum(n) OVER (ORDER BY value) AS up, sum(n) OVER () AS al FROM hs),
q AS (SELECT max(al) AS samples, min(value) AS minimum, min(value) FILTER (up >= al * 0.999) AS p999, min(value) FILTER (up >= al * 0.9999) AS p9999, min(value) FILTER (up >= al * 0.5) AS p50, min(value) FILTER (up >= al * 0.99) AS p99, min(value) FILTER (up >= al * 0.999) AS tail_from, max(value) AS maximum, sum(CASE WHEN value <= -8 THEN n ELSE 0 END) AS lo, sum(CASE WHEN value >= 12 THEN n ELSE 0 END) AS hi FROM cu),
tl AS (SELECT sum(n) AS tn, arg_min(value, (-n, value)) AS mode, max(n) AS mn, sum(CASE WHEN value = maximum THEN n ELSE 0 END) AS mx FROM hs, q WHERE value >= tail_from)"""
query(
    "saturation_summary",
    "SELECT samples, minimum, p50, p99, p999, p9999, tail_from, maximum, mx / samples AS at_max_share, lo / samples AS low_rail_share, hi / samples AS high_rail_share, tn / samples AS tail_share, mode AS tail_mode, mn / tn AS tail_mode_share, lo > 0 OR hi > 0 AS rail_hit, mn / tn >= 0.2 AS plateau FROM q, tl",
    "at_max_share low_rail_share high_rail_share tail_share tail_mode_share", "samples minimum p50 p99 p999 p9999 tail_from maximum tail_mode", True, SATURATION,
)(lambda t: saturation.summary(saturation.histogram(t.frames().withColumn("pixels", F.transform("pixels", lambda v: v.cast("double") * 20))), -8, 12))

query(
    "sampled_histogram",
    "SELECT floor(v * 20)::BIGINT AS value, count(*) AS n FROM vox JOIN (SELECT plane, count(*) AS f FROM fr GROUP BY plane) USING (plane) WHERE local_index IN (round_even(0.1 * (f - 1), 0), round_even(0.5 * (f - 1), 0), f - 1) GROUP BY 1", "", "value n", True,
)(lambda t: saturation.histogram(saturation.sampled(t.frames(), (0.1, 0.5, 1.0)).withColumn("pixels", F.transform("pixels", lambda v: v.cast("double") * 20))))
query(
    "plane_levels",
    "SELECT plane, quantile_cont(v, 0.999) AS p999, max(v) AS maximum, plane * 30 / 29.97::DOUBLE AS start_s, (plane * 30 + 29) / 29.97::DOUBLE AS end_s, 30 / 29.97::DOUBLE AS duration_s FROM vox GROUP BY plane", "p999 maximum start_s end_s duration_s", "plane", True,
)(lambda t: saturation.plane_levels(t.frames()).select("*", *scalar.plane_times(F.col("plane"), F.lit(30), 29.97)))
query(
    "representative_frame",
    "SELECT plane, local_index, y, x, v FROM vox JOIN (SELECT plane, count(*) AS f FROM fr GROUP BY plane) USING (plane) WHERE plane = (SELECT round_even(0.3 * max(plane), 0) FROM fr) AND local_index = 2 + (f - 2) // 2", "v", "plane local_index y x", True,
)(lambda t: recon.representative(t.frames(), 0.3, 2).select(*recon.FRAME, F.col("width"), F.posexplode("pixels").alias("at", "v")).select(*recon.FRAME, F.floor(F.col("at") / F.col("width")).alias("y"), (F.col("at") % F.col("width")).alias("x"), "v"))

# --- two stacks that share a plane ----------------------------------------------------------------------------------------


def _adjacent(t: Tables) -> DataFrame:
    """Planes to 5, 2 µm apart, and planes from 5, brighter, from 0.0004 µm beyond; the second ones move by half a row."""
    med = t.med()
    first, second = med.where("plane <= 5"), med.where("plane >= 5").select("scan_id", (F.col("plane") - 5).alias("plane"), "y", "x", (F.col("v") * 1.5).alias("v"))
    z = lambda d, start: d.select("scan_id", "plane").distinct().withColumn("z_um", F.col("plane") * 2.0 + start)
    shift = med.select("scan_id").distinct().select("scan_id", F.lit(0.5).alias("dy"), F.lit(0.0).alias("dx"))
    return volume.merge_adjacent(first, second, (z(first, 0.0), z(second, 10.0004)), shift, 1e-3, 3.0)


ADJACENT = """sc AS (SELECT a.plane, a.y, a.x, CASE WHEN b.v IS NULL THEN 'NaN'::DOUBLE ELSE 0.75 * (a.v + b.v) END AS v FROM med a LEFT JOIN med b ON b.plane = a.plane AND b.y = a.y - 1 AND b.x = a.x WHERE a.plane >= 5),
ad AS (SELECT plane, plane * 2.0::DOUBLE AS z_um, y, x, v, 'first' AS source_role FROM med WHERE plane < 5 UNION ALL SELECT plane, plane * 2.0::DOUBLE + 0.0004, y, x, v, 'second' FROM sc WHERE plane > 5
UNION ALL SELECT m.plane, 10.0002::DOUBLE, m.y, m.x, CASE WHEN isnan(s.v) THEN m.v ELSE (m.v + s.v) / 2 END, 'overlap' FROM med m JOIN sc s USING (plane, y, x) WHERE m.plane = 5)"""
query("merge_adjacent", "SELECT * FROM ad", "z_um v", "plane y x", True, ADJACENT)(_adjacent)
query(
    "merged_slices",
    "SELECT plane, coalesce(avg(v) FILTER (NOT isnan(v)), 'NaN'::DOUBLE) AS mean, stddev_pop(v) FILTER (NOT isnan(v)) AS std, quantile_cont(v, 0.01) FILTER (NOT isnan(v)) AS p01, quantile_cont(v, 0.5) FILTER (NOT isnan(v)) AS p50, quantile_cont(v, 0.99) FILTER (NOT isnan(v)) AS p99, avg((isfinite(v))::INT) AS finite, any_value(source_role) AS source_role FROM ad GROUP BY plane",
    "mean std p01 p50 p99 finite", "plane", True, ADJACENT,
)(lambda t: volume.slice_stats(_adjacent(t)))


def _drifted(t: Tables) -> DataFrame:
    """Planes moved by a drift of a quarter row and a half column a plane, borders repeated."""
    med = t.med()
    drift = med.select("scan_id", "plane").distinct().select("scan_id", "plane", (F.col("plane") * 0.25).alias("cum_dy"), (F.col("plane") * -0.5).alias("cum_dx")).where("plane > 0")
    return volume.apply_drift(med, drift)


query(
    "apply_drift",
    """SELECT plane, y, x, sum(m.v * w) AS v FROM (SELECT plane, y, x, floor(fy) + i AS sy, floor(fx) + j AS sx, (CASE i WHEN 0 THEN 1 - fy + floor(fy) ELSE fy - floor(fy) END) * (CASE j WHEN 0 THEN 1 - fx + floor(fx) ELSE fx - floor(fx) END) AS w
      FROM (SELECT plane, y, x, least(greatest(y - plane * 0.25::DOUBLE, 0.0), 7.0) AS fy, least(greatest(x + plane * 0.5::DOUBLE, 0.0), 7.0) AS fx FROM med), (VALUES (0), (1)) p(i), (VALUES (0), (1)) q(j)) g JOIN med m USING (plane) WHERE m.y = sy AND m.x = sx GROUP BY ALL""".replace("SELECT plane, y, x, sum(m.v * w)", "SELECT g.plane, g.y, g.x, sum(m.v * w)"),
    "v", "plane y x", True,
)(_drifted)
query("kept_frames_union", "SELECT plane, local_index, 'even_plane' AS part FROM fr WHERE plane % 2 = 0 UNION ALL SELECT plane, local_index, 'odd_plane' FROM fr WHERE plane % 2 = 1", "", "plane local_index", True)(
    lambda t: t.frames().where("plane % 2 = 0").select(*recon.FRAME, F.lit("even_plane").alias("part")).unionByName(t.frames().where("plane % 2 = 1").select(*recon.FRAME, F.lit("odd_plane").alias("part")))
)
