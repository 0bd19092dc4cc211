"""Every core query with SQL gives the rows of its SQL."""

import glob
import os
import re

import duckdb
import pytest

from stratagraph.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    return str(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, data, name):
    df = QUERIES[name](spark, data)
    got = sorted([tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()])
    if name not in SQL:
        return
    r = duck.sql(SQL[name])
    cols = r.columns
    assert sorted(cols) == sorted(df.columns)
    want = sorted(tuple(plain(x[cols.index(c)]) for c in sorted(cols)) for x in r.fetchall())
    assert got == want


def test_core_does_not_import_llm():
    import pathlib

    import stratagraph

    root = pathlib.Path(stratagraph.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"^\s*(?:from|import)\b.*\bllm\b", p.read_text(), re.M), p
