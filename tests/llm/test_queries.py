import glob
import os

import duckdb
import pytest

from stratagraph.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, data, name):
    df = Q.QUERIES[name](spark, data)
    got = df.collect()
    if name in Q.SQL:
        c = duckdb.connect()
        for f in glob.glob(f"{data}/*.parquet"):
            c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        r = c.sql(Q.SQL[name])
        cols = r.columns
        assert sorted(tuple(str(x[k]) for k in sorted(df.columns)) for x in got) == sorted(tuple(str(x[cols.index(k)]) for k in sorted(cols)) for x in r.fetchall())


def test_shapes(spark, data):
    want = {"p1_found": ["file_id"], "p2_found": ["chunk_id"], "p3_found": ["entity_id"], "p5_found": ["tab", "row_id"], "p6_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "subject"]}
    for name, cols in want.items():
        assert Q.QUERIES[name](spark, data).columns == cols
