"""Every registered query against its SQL equivalent at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from chunkyard.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(tuple("" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v).lower() for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    names = sorted(df.columns)
    rows = df.select(*names).collect()
    assert rows or name in ("version_overlap", "fixed_chunk_dedup")
    if name in ORACLE_SQL:
        got = con.execute(ORACLE_SQL[name])
        want_names = [d[0] for d in got.description]
        assert sorted(want_names) == names
        order = [want_names.index(n) for n in names]
        assert plain(rows) == plain([[r[i] for i in order] for r in got.fetchall()])


def test_entry(spark):
    assert entry.entry(spark).count() == 200
