"""Reconciliation of manifests, declarations, review flags and hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackloom.operators.gates import reasons, required_keys
from stackloom.runtime import dealt_pairs, keep, spread


def admission(files: DataFrame, declared: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Each file with the number of manifest entries of its name: exactly one of the same size admits it."""
    d = declared.groupBy(*keys).agg(F.count("*").alias("entries"), F.max(size).alias("declared_size"))
    out = files.join(d, keys, "left").withColumn("entries", F.coalesce("entries", F.lit(0)))
    why = reasons(undeclared=F.col("entries") == 0, ambiguous=F.col("entries") > 1, size_differs=(F.col("entries") == 1) & ~F.col(size).eqNullSafe(F.col("declared_size")))
    return out.withColumn("reasons", why).withColumn("admitted", F.col("reasons") == "")


def stale(declared: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Entries that are declared and not there."""
    return declared.join(observed, keys, "left_anti")


def compare_outputs(declared: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """Every error of a run's outputs: missing, undeclared, wrong size, wrong hash."""
    d = declared.select(key, F.col("size").alias("d_size"), F.col("sha256").alias("d_hash"), F.lit(True).alias("d"))
    o = observed.select(key, F.col("size").alias("o_size"), F.col("sha256").alias("o_hash"), F.lit(True).alias("o"))
    both = F.col("d").isNotNull() & F.col("o").isNotNull()
    why = reasons(missing=F.col("o").isNull(), undeclared=F.col("d").isNull(), size=both & (F.col("d_size") != F.col("o_size")), hash=both & (F.col("d_hash") != F.col("o_hash")))
    return d.join(o, key, "full_outer").select(key, why.alias("errors")).where("errors <> ''")


def conflicts(pairs: list[tuple[str, Column, Column]]) -> Column:
    """A map from the fields whose two values differ to both; values are compared as text, null equals null."""
    text = lambda c: c.cast("string")
    made = F.array(*(F.when(~text(a).eqNullSafe(text(b)), F.struct(F.lit(n).alias("key"), F.struct(text(a).alias("declared"), text(b).alias("observed")).alias("value"))) for n, a, b in sorted(pairs)))
    return F.map_from_entries(F.array_compact(made))


def conflict_text(found: Column) -> Column:
    """A map of conflicts as ``field:declared|observed`` joined by ``;``, in order of the fields."""
    shown = lambda c: F.coalesce(c, F.lit("?"))
    return F.array_join(F.transform(F.array_sort(F.map_entries(found)), lambda e: F.concat(e["key"], F.lit(":"), shown(e["value"]["declared"]), F.lit("|"), shown(e["value"]["observed"]))), ";")


def day_after(event: Column, start: Column, declared: Column | None = None) -> tuple[Column, Column]:
    """(day, error): whole days since the start, or the declared day where there is no start. A negative day, and a declared one
    that disagrees, are errors, and give no day."""
    days = F.datediff(event, start).cast("long")
    error = F.when(days < 0, "negative_day")
    if declared is not None:
        error = F.when(days < 0, "negative_day").when(days.isNotNull() & (declared != days), "day_disagrees")
        days = F.coalesce(days, declared.cast("long"))
    return F.when(error.isNull(), days), error


def acquisition_context(scans: DataFrame, declarations: DataFrame, on: str, identity: list[str], source: str, required: tuple[str, ...], const: dict[str, str]) -> DataFrame:
    """Scans with the status of their declaration: ``metadata_incomplete`` where there is none, else ``pass``, or ``fail`` with the error.

    ``declarations`` are rows (``on``, document, a JSON object). A document must have the required keys and the constant fields, name the
    scan's identity and source, and its day must follow from its dates. The conflict map is kept.
    """
    # each document is parsed once, before the join, so that only its fields move
    later = list(dict.fromkeys([*identity, source, "acquisition_date", "surgery_date", "post_surgery_day", "source_channel"]))
    names = list(dict.fromkeys([*const, *later]))
    get = lambda k: F.col(f"json_{k}")
    fields = declarations.select(on, "document", F.json_tuple("document", *names).alias(*(f"json_{k}" for k in names)))
    other = F.lit(False)
    for k, v in const.items():
        other = other | ~get(k).eqNullSafe(v)
    fields = fields.select(on, F.col("document").isNotNull().alias("there_"), required_keys(F.col("document"), required).alias("lacks_"), other.alias("other_"), *map(get, later))
    d = scans.join(fields, on, "left")
    lacks, other = F.col("lacks_"), F.col("other_")
    found = conflicts([*((c, get(c), F.col(c)) for c in identity), (source, get(source), F.col(source))])
    day, wrong_day = day_after(F.try_to_date(get("acquisition_date")), F.try_to_date(get("surgery_date")), get("post_surgery_day").try_cast("long"))
    bad_date = F.try_to_date(get("acquisition_date")).isNull() | (get("surgery_date").isNotNull() & F.try_to_date(get("surgery_date")).isNull())
    error = F.when(F.size(lacks) > 0, F.concat(F.lit("lacks "), F.array_join(lacks, ","))).when(other, "unsupported").when(F.size(found) > 0, "conflicts").when(bad_date, "not_a_date").otherwise(wrong_day)
    there = F.coalesce("there_", F.lit(False))
    status = F.when(~there, "metadata_incomplete").when(error.isNull(), "pass").otherwise("fail")
    return d.select(*scans.columns, status.alias("status"), F.when(there, error).alias("error"), F.when(there, found).alias("conflicts"), F.when(there & error.isNull(), day).alias("post_surgery_day"), F.when(there & error.isNull(), get("source_channel").try_cast("int")).alias("declared_channel"))


def manifests(documents: DataFrame) -> DataFrame:
    """Collection manifests from rows (folder, document, a JSON object), as manifest_admission() takes them, with the document's SHA-256 and its ``z_stack``.

    ``collected_files`` may be a list or one object, which is a list of one."""
    get = lambda k: F.get_json_object("document", f"$.{k}")
    files = F.from_json(get("collected_files"), "array<struct<name:string,bytes:bigint>>")
    return documents.select("folder", *(get(k).alias(k) for k in ("schema_version", "acquisition_type", "setup_type", "scan_id", "animal_id", "z_stack")), files.alias("collected_files"), F.sha2(F.col("document").cast("binary"), 256).alias("manifest_sha256"))


def manifest_admission(files: DataFrame, manifests: DataFrame, version: str, kind: str, animal: str = r"[A-Z]+-[0-9]+") -> DataFrame:
    """Files (folder, name, size, setup, scan_id, animal_id) with the status of the manifest in their folder, and the identity it declares.

    ``manifests`` are rows (folder, schema_version, acquisition_type, setup_type, scan_id, animal_id, collected_files array<struct<name,bytes>>).
    ``absent`` where there is none; else it must have the version, kind, rig and scan (with or without its prefix), list the file exactly
    once with its size, and declare a well-formed animal, which then overrides that of the path.
    """
    more = [c for c in ("manifest_sha256", "z_stack") if c in manifests.columns]
    m = manifests.select("folder", *more, F.lit(True).alias("there_"), "schema_version", "acquisition_type", "setup_type", F.col("scan_id").alias("scan_"), F.col("animal_id").alias("declared_animal_id"), "collected_files")
    d = files.join(m, "folder", "left").withColumn("hits_", F.filter(F.coalesce("collected_files", F.array().cast("array<struct<name:string,bytes:bigint>>")), lambda f: f["name"] == F.col("name")))
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "^scan", "")
    why = reasons(
        version=~F.col("schema_version").eqNullSafe(version), type=~F.col("acquisition_type").eqNullSafe(kind), rig=~F.col("setup_type").eqNullSafe(F.col("setup")), scan=bare(F.col("scan_")) != bare(F.col("scan_id")),
        not_unique=F.size("hits_") != 1, size_differs=(F.size("hits_") == 1) & ~F.get("hits_", F.lit(0))["bytes"].eqNullSafe(F.col("size")), animal=~F.coalesce(F.col("declared_animal_id").rlike(f"^(?:{animal})$"), F.lit(False)),
    )
    d = d.withColumn("reasons", F.when(F.col("there_"), why).otherwise(""))
    status = F.when(F.col("there_").isNull(), "absent").when(F.col("reasons") == "", "pass").otherwise("fail")
    ok = status == "pass"
    return d.select(*(c for c in files.columns if c != "animal_id"), status.alias("status"), "reasons", F.when(ok, F.col("declared_animal_id")).otherwise(F.col("animal_id")).alias("animal_id"), F.col("animal_id").alias("path_animal_id"), F.when(F.col("there_"), F.col("declared_animal_id")).alias("declared_animal_id"), F.when(ok, "collection_manifest").otherwise("session_path").alias("identity_source"), (ok & (F.col("declared_animal_id") != F.col("animal_id"))).alias("animal_id_corrected"), F.when(ok, F.get("hits_", F.lit(0))).alias("selected_file"), *(F.when(ok, F.col(c)).alias(c) for c in more))


def upstream_qc(runs: DataFrame, upstream: DataFrame, on: str) -> DataFrame:
    """Runs with the status of the run they are made from (``upstream_status``); where there is no such run that is an ``error``, one that did not pass, or has
    no status, needs review."""
    u = upstream.select(F.col(on), F.col("status").alias("upstream_status"), F.lit(True).alias("there_"))
    return runs.join(u, on, "left").withColumn("status", F.when(F.col("there_").isNull(), "error").when(F.col("upstream_status").eqNullSafe("pass"), "pass").otherwise("needs_review")).drop("there_")


def z_of_planes(planes: DataFrame, upstream: DataFrame, header: DataFrame, keys: list[str]) -> DataFrame:
    """Planes (keys, plane) with their z_um: from an upstream table, else from the header's; and ``z_source``. A stack for which neither has one for every plane is an error."""
    d = spread(planes, *keys, "plane")
    d = d.join(upstream.select(*keys, "plane", F.col("z_um").alias("up_")), [*keys, "plane"], "left").join(header.select(*keys, "plane", F.col("z_um").alias("head_")), [*keys, "plane"], "left")
    n = d.groupBy(*keys).agg(F.count("*").alias("n_"), F.count("up_").alias("n_up_"), F.count("head_").alias("n_head_"))
    d = spread(d, *keys, like=planes).join(n, keys)
    lacks = F.raise_error(F.concat(F.lit("no Z of every plane of "), F.concat_ws("/", *keys)))
    return d.select(*keys, "plane", F.when(F.col("n_up_") == F.col("n_"), F.col("up_")).when(F.col("n_head_") == F.col("n_"), F.col("head_")).otherwise(lacks.cast("double")).alias("z_um"), F.when(F.col("n_up_") == F.col("n_"), "upstream").otherwise("header").alias("z_source"))


def in_order_of_z(stacks: DataFrame, keys: list[str], zs: str = "z_um") -> DataFrame:
    """Adds the place (from 0) of each stack among those of its key, by the first of its Z positions; ties by all of them."""
    return stacks.withColumn("place", (F.row_number().over(Window.partitionBy(*keys).orderBy(F.element_at(zs, 1), zs)) - 1).cast("long"))


def superseded(runs: DataFrame) -> DataFrame:
    """Runs (analysis_id, supersedes) with ``superseded_by``, and ``error`` where one supersedes itself or a run that does not exist."""
    # hashed before they are grouped: a scan's share of the rows would be held as a hash table
    links = spread(runs.where("supersedes is not null"), "supersedes", like=runs).groupBy(F.col("supersedes").alias("old_")).agg(F.min("analysis_id").alias("superseded_by"))
    known = spread(runs.select(F.col("analysis_id").alias("known_")), "known_", like=runs).distinct()
    # a run that supersedes nothing looks for itself: nulls would all meet in one task
    looked = F.coalesce("supersedes", "analysis_id")
    d = spread(runs, "analysis_id").join(links, F.col("analysis_id") == F.col("old_"), "left").drop("old_").withColumn("looked_", looked)
    d = spread(d, "looked_", like=runs).join(known, F.col("looked_") == F.col("known_"), "left").drop("looked_")
    why = F.when(F.col("supersedes") == F.col("analysis_id"), "itself").when(F.col("supersedes").isNotNull() & F.col("known_").isNull(), "unknown")
    return d.withColumn("error", why).drop("known_")


def chains(runs: DataFrame) -> DataFrame:
    """analysis_id, head, steps, cycle of every run (analysis_id, supersedes): the run that replaces it in the end, and how many replacements that takes.

    A run replaced by several goes on with the one of the smallest id. Where replacements lead into a circle there is no head, and ``cycle`` is the smallest id of
    that circle. Pointers are doubled, so a chain or circle of n runs takes about log2(n) joins; a run that supersedes one that is not there, or itself, replaces nothing.
    """
    known = runs.select("analysis_id").distinct()
    after = runs.where("supersedes is not null AND supersedes <> analysis_id").groupBy(F.col("supersedes").alias("analysis_id")).agg(F.min("analysis_id").alias("to"))
    d = known.join(after, "analysis_id", "left")
    d = keep(d.select("analysis_id", F.coalesce("to", "analysis_id").alias("to"), F.col("to").isNotNull().cast("long").alias("steps"), F.least("analysis_id", F.coalesce("to", "analysis_id")).alias("low"), F.col("to").isNull().alias("done"), F.lit(True).alias("lower")))
    ended, before, ends_before = d.where("done"), None, None
    while True:
        open_ = d.where("not done")
        left, lower = open_.agg(F.count("*"), F.count_if("lower")).first()
        if left == 0:
            break
        if left == before and not lower:
            # a chain would have shortened, so all that is left leads into circles; no pointer leads to a smaller id than it has passed, so
            # circles are passed whole; and where a further doubling leaves as many ends, these are in circles
            ends = open_.agg(F.count_distinct("to")).first()[0]
            if ends in (left, ends_before):
                break
            ends_before = ends
        ahead = ended.drop("lower").unionByName(open_.drop("lower")).withColumnsRenamed({"analysis_id": "at_", "to": "to_", "steps": "steps_", "low": "low_", "done": "done_"})
        d = keep(open_.join(ahead, F.col("to") == F.col("at_")).select("analysis_id", F.col("to_").alias("to"), (F.col("steps") + F.col("steps_")).alias("steps"), F.least("low", "low_").alias("low"), F.col("done_").alias("done"), (F.col("low_") < F.col("low")).alias("lower")))
        ended, before = ended.unionByName(d.where("done")), left
    circle = open_.select(F.col("analysis_id").alias("at_"), F.col("low").alias("cycle"))
    none = lambda c: F.lit(None).cast(d.schema[c].dataType)
    in_circles = open_.join(circle, F.col("to") == F.col("at_"), "left").select("analysis_id", none("to").alias("head"), none("steps").alias("steps"), "cycle")
    return ended.select("analysis_id", F.col("to").alias("head"), "steps", none("low").alias("cycle")).unionByName(in_circles)


def review_flags(scans: DataFrame, flags: DataFrame, identity: list[str], path: str) -> DataFrame:
    """Scans with the flags whose identity is wholly equal or whose path is equal, each pair once.

    Both joins are on equal values. Pairs may be far more than rows, so they are never shuffled: pairs of equal paths leave out those of equal
    identity, and only flags of which several rows share an id, which may name a pair twice, need a distinct. Large groups are dealt over tasks.
    """
    f = flags.select("flag_id", *(F.col(c).alias(f"f_{c}") for c in [*identity, path])).distinct()
    f = f.withColumn("same_", F.count("*").over(Window.partitionBy("flag_id")))
    s = scans.distinct()
    equal = F.lit(True)
    for c in identity:
        equal = equal & F.coalesce(F.col(c) == F.col(f"f_{c}"), F.lit(False))

    def pick(of: DataFrame) -> DataFrame:
        named = dealt_pairs(s, of, identity, [f"f_{c}" for c in identity])
        return named.unionByName(dealt_pairs(s, of, [path], [f"f_{path}"]).where(~equal)).select(*scans.columns, "flag_id")

    return pick(f.where("same_ = 1")).unionByName(pick(f.where("same_ > 1")).distinct())


def eligibility(day_unknown: Column, flagged: Column) -> list[Column]:
    """Reconstruction is always eligible; longitudinal use is held while a reason stands."""
    why = reasons(day_unknown=day_unknown, review_flag=flagged)
    return [F.lit("eligible").alias("reconstruction"), F.when(why == "", "eligible").otherwise("hold").alias("longitudinal"), why.alias("reasons")]


def relabel(ts: Column, cutoff: Column, before: Column, after: Column) -> Column:
    return F.when(ts > cutoff, after).otherwise(before)


def dangling(components: DataFrame, assets: DataFrame, key: str) -> DataFrame:
    """References of components to assets that do not exist."""
    return components.join(assets, key, "left_anti")
