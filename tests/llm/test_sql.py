"""The registered queries against their SQL at the smallest scale: whole rows, as multisets."""

from collections import Counter

import duckdb
import pytest

from chunkyard.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    got = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(got.fetchall())
    assert Counter(tuple(r) for r in df.select(*names).collect()) == want
    assert want or name == "op3_license_scans"  # few notices at this scale
