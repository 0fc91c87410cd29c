"""Every formula query against its SQL in DuckDB."""

import math

import duckdb
import pytest

from gridloom.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


def _key(row):
    return tuple("" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    wanted = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    got = [tuple(r) for r in found.select(columns).collect()]
    assert len(got) == len(wanted)
    for a, b in zip(sorted(got, key=_key), sorted(wanted, key=_key)):
        for x, y in zip(a, b):
            same = x == y or (isinstance(x, float) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9))
            assert same, (name, columns, a, b)
