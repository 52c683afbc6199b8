"""The catalogue against DuckDB, and the entry without the optional subpackage."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from stackloom.plans.catalogue import ORACLE_SQL, QUERIES

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    return ("nan" if math.isnan(v) else f"{v + 0.0:.6f}") if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", [q for q in QUERIES if q in ORACLE_SQL])
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    rows = sorted(tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect())
    want = duck.sql(ORACLE_SQL[name])
    order = [want.columns.index(c) for c in sorted(want.columns)]
    assert sorted(got.columns) == sorted(want.columns)
    assert rows == sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())


@pytest.mark.parametrize("name", [q for q in QUERIES if q not in ORACLE_SQL])
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_all_queries_use_every_row(spark, duck):
    rows = dict(duck.sql("SELECT label::BIGINT, count(*) FROM embeddings GROUP BY 1").fetchall())
    assert len(set(rows.values())) > 1
    assert {r["plane"]: r["frames"] for r in QUERIES["plane_qc_all"](spark, DATA).collect()} == rows
    assert QUERIES["frame_qc_all"](spark, DATA).count() == QUERIES["frame_qc"](spark, DATA).count() == QUERIES["phase_shift"](spark, DATA).count() == sum(rows.values())


@pytest.mark.parametrize("left", ["all", "folder", "nothing"])
def test_entry_works_without_the_optional_parts(tmp_path, left):
    """The optional folder is deleted: with the pipeline's file left behind, with an empty folder too, or with neither."""
    shutil.copytree(ROOT / "stackloom", tmp_path / "stackloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if left != "nothing" and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    if left == "folder":
        (tmp_path / "stackloom" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'plane_qc' in q and 'pipeline' not in q and not any(k.startswith('op1_') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def test_other_import_errors_show(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "stackloom", tmp_path / "stackloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "stackloom" / "llm").mkdir()
    (tmp_path / "stackloom" / "llm" / "registry.py").write_text("import no_such_module\n")
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert run.returncode and "no_such_module" in run.stderr
