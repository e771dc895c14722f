import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"
SAMPLE = [
    "nodes", "per_window_ids", "sliding", "simple_digraph", "totals", "time_delta", "percentiles", "auroc", "rank_models",
    "ecs_events", "resolve_entities", "custom_json", "gat_layer", "expand_forward", "label_windows", "stream_counts",
]


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 200


def test_entry(spark):
    assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("name", SAMPLE)
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.collect(), df.columns) == rows(cur.fetchall(), names)


def test_the_rest_works_without_the_training_data_folder(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    code = "import __spark_entry__ as e; n = e.queries(); assert len(n) > 200 and not any(q.startswith('op') and q[2].isdigit() or q == 'pipeline' for q in n)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)})
