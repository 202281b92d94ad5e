"""Every query of the engine against its SQL in DuckDB, value by value."""

import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from tapedeck import queries, queries_more  # noqa: E402, F401


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def compare(spark, sf_dir, name, run, sql):
    c = duckdb.connect()
    for p in Path(sf_dir).iterdir():
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'" if p.is_file() else f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}/*.parquet'")
    want = c.execute(sql)
    columns = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(x) for x in columns]
    expected = sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr)
    df = run(spark, sf_dir)
    assert sorted(df.columns) == columns
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*[f"`{x}`" for x in columns]).collect()), key=repr)
    assert len(got) == len(expected) and len(got) > 0
    assert got == expected


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, sf_dir, name):
    compare(spark, sf_dir, name, queries.QUERIES[name], queries.SQL[name])
