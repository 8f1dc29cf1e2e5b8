import math
import os

import duckdb
import pytest

from threadloom.plans import catalog

DIR = "/root/testdata/sf0.001"


def norm(v):
    return round(v, 4) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    df = catalog.QUERIES[name](spark, DIR)
    cur = con.execute(catalog.ORACLE_SQL[name])
    cols = [c[0] for c in cur.description]
    want = sorted((tuple(norm(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall()), key=repr)
    assert sorted(cols) == sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in sorted(cols)) for r in df.collect()), key=repr)
    assert got == want
