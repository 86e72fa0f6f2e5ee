"""The driver's contract, and queries against their SQL on the smallest tables."""

import os
import re
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from slackline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canonical(df: pd.DataFrame) -> list[tuple]:
    """Rows in order, numbers to nine digits, every kind of missing value alike."""
    df = df[sorted(df.columns)]
    cell = lambda x: None if x is None or x is pd.NaT or x != x else f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted((tuple(map(cell, r)) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and canonical(got) == canonical(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_outside_llm_imports_it():
    for folder, _, files in os.walk(os.path.join(REPO, "slackline")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                text = open(os.path.join(folder, f)).read()
                assert not re.search(r"(from|import) +(slackline)?\.?llm", text), f


def test_imports_without_llm(tmp_path):
    for name in ("slackline", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", os.path.join(REPO, name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "slackline" / "llm")], check=True)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k[:2] == 'op' and k[2].isdigit() for k in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert out.stdout.split() == [str(len(registry.queries())), "False"], out.stderr
