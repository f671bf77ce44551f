"""Every registered query of the document operators against its SQL, on the small tables."""

import math
from pathlib import Path

import duckdb
import pytest

from docwright.extraction_queries import ORACLES, QUERIES, WITHOUT_SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    yield con
    con.close()


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: round(x, 9) if isinstance(x, float) and math.isfinite(x) else x
    return [columns[i] for i in order], sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", [q for q in QUERIES if q not in WITHOUT_SQL])
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLES[name])
    want = table([c[0] for c in cur.description], cur.fetchall())
    got = table(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1]) > 0
    assert got[1] == want[1]


def test_every_query_has_sql():
    assert set(QUERIES) - WITHOUT_SQL == set(ORACLES)
