"""The driver's contract: names, oracles, independence of the optional package, and each oracle at the smallest size."""

from __future__ import annotations

import math
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT, DATA = Path(__file__).resolve().parent.parent, "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
GRAPH = sorted(k for k in entry.graph_queries.ORACLE_SQL)


def same(rows):
    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 6) + 0.0
        return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v

    return sorted((tuple(plain(v) for v in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", GRAPH)
def test_query_matches_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    got, cols = df.collect(), sorted(df.columns)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == cols
    rows, at = want.fetchall(), [want.columns.index(c) for c in cols]
    assert same([[r[c] for c in cols] for r in got]) == same([[r[i] for i in at] for r in rows])
    spark.catalog.clearCache()


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns[0] == "symbol_id"


def test_nothing_else_imports_the_optional_package():
    for p in (ROOT / "sparkloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "sparkloom.llm" not in p.read_text(), p


def test_entry_without_the_optional_package(tmp_path):
    import shutil

    shutil.copytree(ROOT / "sparkloom", tmp_path / "sparkloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'g1_reverse_reachability' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
