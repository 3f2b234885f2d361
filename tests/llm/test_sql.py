"""The corpus queries against their SQL, run by another engine on the same tables."""

from pathlib import Path

import duckdb
import pytest

from matchlake.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query(spark, duck, name):
    result = duck.execute(ORACLE_SQL[name])
    names = sorted(x[0] for x in result.description)
    at = [[x[0] for x in result.description].index(c) for c in names]
    found = QUERIES[name](spark, SF)
    assert sorted(found.columns) == names
    assert sorted(map(repr, map(tuple, found.select(*names).collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in result.fetchall())
