"""The driver contract: names, results against SQL, and work without the training-data folder."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from corpusveil.plans.queries import ORACLES, queries

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(set(ORACLES) - {"mask_short", "mask_none", "stable_markers"}))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    mine, theirs = queries()[name](spark, DATA).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    rows = lambda df: sorted(tuple(map(str, r)) for r in df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).itertuples(index=False))
    assert rows(mine) == rows(theirs)


def test_entry_imports_without_the_training_data_folder(tmp_path):
    for p in ("corpusveil", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / p), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "corpusveil/llm")], check=True)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.oracle_sql()))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert out.stdout.split() == [str(len(queries())), "False"]
