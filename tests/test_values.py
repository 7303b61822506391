"""Functions of single values on rows with missing values."""

from __future__ import annotations

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quern.functions import values as V
from quern.operators.table import Table


def column(df, c):
    return [r[0] for r in df.select(c).collect()]


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame([(0, 1.5, 10), (1, -2.5, None), (2, float("nan"), 3), (3, None, 0), (None, 0.0, -1)], "i int, d double, n int").coalesce(1)


def test_three_valued_logic(spark):
    df = spark.createDataFrame([(True,), (None,), (False,)], "p boolean").coalesce(1)
    for known, both, either in ((True, [True, None, False], [True, True, True]), (False, [False] * 3, [True, None, False]), (None, [None, None, False], [True, None, None])):
        c = F.lit(known).cast("boolean")
        assert column(df, F.col("p") & c) == both
        assert column(df, F.col("p") | c) == either
    assert column(df, ~F.col("p")) == [False, None, True]


def test_missing_double_is_nan_or_null(numbers):
    assert column(numbers, V.is_missing("d", double=True)) == [False, False, True, True, False]
    assert column(Table.of(numbers).df, "d") == [1.5, -2.5, None, None, 0.0]


def test_comparisons_give_missing(numbers):
    t = Table.of(numbers).df
    assert column(t, t["d"] > 0) == [True, False, None, None, False]
    assert column(t, t["i"] == t["n"]) == [False, None, False, False, None]


def test_membership(numbers):
    assert column(numbers, V.is_in("i", {1, 3, None})) == [False, True, False, True, None]
    assert column(numbers, V.is_in("i", set())) == [False, False, False, False, None]


def test_choose(numbers):
    c = V.choose(F.col("n") > 0, F.col("i"), -1)
    assert column(numbers, c) == [0, None, 2, -1, -1]


def test_rounding_goes_up_at_halves(numbers):
    assert column(Table.of(numbers).df, V.round_int("d")) == [2, -2, None, None, 0]
    assert column(Table.of(numbers).df, V.round_double("d")) == [2.0, -2.0, None, None, 0.0]


def test_division_is_ieee(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (3.0, 2.0), (None, 0.0), (1.0, None)], "a double, b double").coalesce(1)
    assert column(df, V.divide("a", F.col("b"))) == [math.inf, -math.inf, None, 1.5, None, None]


def test_parsing(spark):
    df = spark.createDataFrame([("12",), (" 7 ",), ("NA",), ("1.5",), ("",), (None,), ("NaN",)], "s string").coalesce(1)
    assert column(df, V.to_int("s"))[:3] == [12, 7, None]
    assert column(df, V.to_double("s")) == [12.0, 7.0, None, 1.5, None, None, None]
    assert column(df, V.to_long("s"))[5] is None


def test_printf_of_missing(numbers):
    assert column(numbers, V.printf("i", "%03d")) == ["000", "001", "002", "003", "NA"]


def test_strings(spark):
    df = spark.createDataFrame([("foo123",), ("bar456",), ("baz\n",), (None,), ("",)], "s string").coalesce(1)
    assert column(df, V.matches("s", "[a-z]+[0-9]*")) == [True, True, False, None, False]
    assert column(df, V.replace_match("s", "foo.*", "$1x")) == ["$1x", "bar456", "baz\n", None, ""]
    assert column(df, V.substring("s", 1, 3)) == ["oo1", "ar4", "az\n", None, ""]
    assert column(df, V.substring("s", -1, 3)) == ["fo", "ba", "ba", None, ""]
    assert column(df, V.substring("s", -3, 2)) == ["", "", "", None, ""]
    assert column(df, V.concatenate("s", "!")) == ["foo123!", "bar456!", "baz\n!", None, "!"]
    assert column(df, V.is_nonempty("s")) == [True, True, True, None, False]


def test_instants(spark):
    df = spark.createDataFrame([(datetime(2021, 3, 4, 5, 6, 7, 89_999),), (datetime(1960, 2, 29, 23, 59, 59),), (None,)], "t timestamp_ntz").coalesce(1)
    t = Table.of(df).df
    assert column(t, V.to_iso("t")) == ["2021-03-04T05:06:07.089Z", "1960-02-29T23:59:59Z", None]
    assert column(t, V.nanoseconds("t")) == [89_000_000, 0, None]
    assert [column(t, f("t"))[0] for f in (V.years, V.months, V.days, V.hours, V.minutes, V.seconds)] == [2021, 3, 4, 5, 6, 7]
    assert column(t, V.to_iso(V.round_to("t", "month"))) == ["2021-03-01T00:00:00Z", "1960-02-01T00:00:00Z", None]
    assert column(t, V.to_iso(V.minus_days(V.plus_seconds("t", 60), 1)))[0] == "2021-03-03T05:07:07.089Z"
    assert column(t, F.col("t") == V.instant("2021-03-04T05:06:07.089Z")) == [True, False, None]
    assert column(t, V.epoch_millis(V.plus_millis("t", 1)) - V.epoch_millis("t")) == [1, 1, None]
    with pytest.raises(ValueError):
        V.round_to("t", "week")
