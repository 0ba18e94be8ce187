"""Every registered revision query: the SQL oracle where there is one, rows otherwise."""

import duckdb
import pytest

from palimpsest.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "conversations", "pages", "nation", "part")


def norm(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    rows = sorted((tuple(norm(r[c]) for c in columns) for r in frame.collect()), key=repr)
    if name in ORACLES:
        found = duck.sql(ORACLES[name])
        assert sorted(found.columns) == columns
        want = found.project(", ".join(f'"{c}"' for c in columns)).fetchall()
        assert rows == sorted((tuple(map(norm, r)) for r in want), key=repr)
    else:
        assert rows
