"""Steps whose work is to grow no faster than their input or output."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackloom.operators import features, provenance


def points(spark, xyz, groups=0):
    rows = [(f"k{i % groups}" if groups else "k", i, *map(float, p)) for i, p in enumerate(xyz)]
    return spark.createDataFrame(rows, "k string, id long, a double, b double, c double")


def slow_nearest(left, right, radius, groups=0):
    out = {}
    for i, p in enumerate(left):
        d = np.sqrt(((p - right) ** 2).sum(axis=1))
        d = np.where((d <= radius) & (np.arange(len(right)) % (groups or 1) == i % (groups or 1)), d, np.inf)
        j = int(d.argmin())
        out[i] = (j, pytest.approx(float(d[j]))) if d[j] < np.inf else (None, None)
    return out


R = np.random.default_rng(1)
CASES = {
    "dense": (R.normal(0, 1.2, (1500, 3)), R.normal(0, 1.2, (1300, 3)), 8.0, 0),
    "ties and copies": (R.integers(0, 9, (1500, 3)), R.integers(0, 9, (1300, 3)), 2.0, 0),
    "keys": (R.normal(0, 1.2, (1500, 3)), R.normal(0, 1.2, (1300, 3)), 0.4, 3),
    "far, outliers, NaN": (R.normal(0, 1, (600, 3)) * [1, 0, 0] + [0, 50, 0], np.concatenate([R.normal(0, 1e-3, (1200, 3)), [[1e30, 0, 0], [np.nan, 0, 0]]]), 60.0, 0),
    "none": (R.normal(0, 1, (9, 3)), R.normal(99, 1, (9, 3)), 1.0, 0),
}


@pytest.mark.parametrize("name", CASES)
def test_nearest_equals_all_pairs(spark, name):
    left, right, radius, groups = CASES[name]
    got = features.nearest(points(spark, left, groups), points(spark, right, groups), ["a", "b", "c"], radius, ["k"] if groups else None)
    assert {r["id"]: (r["match"], r["distance"]) for r in got.collect()} == slow_nearest(left, right, radius, groups)


def test_nearest_compares_few_blocks_within_a_wide_radius(spark):
    """All points lie on a line, within the radius of each other: before, each met each."""
    n = 6 * features.TILE * features.BLOCK
    of = lambda seed: features._blocks(spark.range(n).selectExpr("'' AS k_", "id", f"rand({seed}) AS a", "0D AS b", "0D AS c"), ["a", "b", "c"])
    assert features.block_pairs(of(1), of(9), ["a", "b", "c"], 99.0).count() < 8 * (n / features.BLOCK)


def test_pairs_of_one_large_group_are_dealt_over_tasks(spark):
    """Before, one task made all pairs of a group."""
    scans = spark.range(400).selectExpr("IF(id < 0, 'b', 'a') AS key", "id", "id * 0.5D AS z")
    got = features.repeat_pairs(scans, ["key"], "id", ["z"])
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(sizes) == 400 * 399 // 2 and max(sizes) < 0.4 * sum(sizes)
    assert got.where("z_1 <> first * 0.5 OR z_2 <> second * 0.5 OR key <> 'a'").count() == 0


def test_review_flags_name_a_pair_once_without_a_shuffle_of_pairs(spark):
    scans = spark.createDataFrame([(1, "a", "p"), (2, "a", "q"), (3, None, "q"), (4, "b", None), (4, "b", None)], "scan long, animal string, path string")
    rows = [(10, "a", "p"), (10, "a", "p"), (11, "a", "q"), (12, None, "q"), (13, "b", "p"), (13, "a", "x"), (13, "c", "p"), (14, "b", None)]
    got = provenance.review_flags(scans, spark.createDataFrame(rows, "flag_id long, animal string, path string"), ["animal"], "path")
    want = {(s, f) for s, a, p in [(1, "a", "p"), (2, "a", "q"), (3, None, "q"), (4, "b", None)] for f, b, q in rows if (a and a == b) or (p and p == q)}
    assert sorted((r["scan"], r["flag_id"]) for r in got.collect()) == sorted(want)
    assert got._jdf.queryExecution().optimizedPlan().nodeName() == "Union"


def test_runs_that_supersede_nothing_do_not_meet_in_one_task(spark):
    """Before, the rows without a link were joined by null, in one partition."""
    runs = spark.range(4000).selectExpr("id AS analysis_id", "IF(id % 100 = 1, id - 1, NULL) AS supersedes")
    got = provenance.superseded(runs)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 0.5 * 4000
    assert got.where("error IS NOT NULL").count() == 0 and got.where("superseded_by = analysis_id + 1").count() == 40


def test_circles_of_runs_take_few_joins(spark, monkeypatch):
    """Before, doubling went on until pointers could pass as many runs as there are in all circles."""
    made = []
    monkeypatch.setattr(provenance, "keep", lambda d: made.append(1) or d.localCheckpoint())
    runs = spark.range(4096).selectExpr("id AS analysis_id", "IF(id % 4 = 0, id + 3, id - 1) AS supersedes")
    got = provenance.chains(runs)
    assert got.where("head IS NULL AND cycle = analysis_id - analysis_id % 4").count() == 4096 and len(made) <= 6


def test_duplicate_fields_of_a_document_are_read_once_and_the_last_counts(spark):
    """As a JSON reader of the reference does; before, the first one counted."""
    scans = spark.createDataFrame([("f", "A-1", "s")], "folder string, animal_id string, source_tiff string")
    doc = '{"v": "1", "animal_id": "A-2", "animal_id": "A-1", "source_tiff": "s", "acquisition_date": "1995-01-02"}'
    got = provenance.acquisition_context(scans, spark.createDataFrame([("f", doc)], "folder string, document string"), "folder", ["animal_id"], "source_tiff", ("v",), {"v": "1"})
    assert [r["status"] for r in got.collect()] == ["pass"]
