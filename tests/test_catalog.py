"""Every registered query of the table language against its SQL."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from quern.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the test tables are absent")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 9))
    return str(tuple(x)) if isinstance(x, (list, tuple)) else str(x)


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    assert got == sorted(tuple(map(plain, r)) for r in want.fetchall())


def test_arithmetic_of_missing_values_and_long_ids(spark, duck, tmp_path):
    path = f"{tmp_path}/events.parquet"
    values = "(null), ('0'), ('-0.0'), ('1.5'), ('-2.5'), ('41'), ('nan'), ('infinity'), ('-infinity')"
    users = "(null), (0), (30), (31), (50), (9007199254740993), (9007199254741023), (9223372036854775807), (-9223372036854775808)"
    duck.execute(f"""copy (select row_number() over () as event_id, user_id::bigint as user_id, value::double as value
        from (values {values}) v(value), (values {users}) u(user_id)) to '{path}'""")
    df = catalog.QUERIES["arith_f64"](spark, str(tmp_path))
    want = duck.execute(f"with events as (from '{path}') from ({catalog.ORACLE_SQL['arith_f64']})").fetchall()
    assert len(want) == 81
    assert sorted(tuple(map(plain, r)) for r in df.collect()) == sorted(tuple(map(plain, r)) for r in want)
