"""Every query with an oracle, against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from meshwork import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def value(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_its_oracle(spark, duck, name):
    got = entry_point.queries()[name](spark, SF)
    r = duck.execute(entry_point.oracle_sql()[name])
    cols = sorted(x[0] for x in r.description)
    order = [[x[0] for x in r.description].index(c) for c in cols]
    assert cols == sorted(got.columns)
    want = sorted([tuple(value(row[k]) for k in order) for row in r.fetchall()], key=repr)
    assert sorted([tuple(value(row[c]) for c in cols) for row in got.collect()], key=repr) == want


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_entry(spark):
    assert sorted(entry_point.entry(spark).groupBy("role").count().collect()) == [("border", 64), ("core", 112), ("none", 24)]


def test_works_without_the_corpus_operators():
    import subprocess
    import sys
    from pathlib import Path

    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "meshwork.llm":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.corpus is None and "clustering" in e.queries() and not any(n.startswith("op") and n[2].isdigit() for n in e.oracle_sql())
"""
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True)
