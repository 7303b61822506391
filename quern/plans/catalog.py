"""The registered queries of the table language, each with its SQL.

A query takes (spark, folder of the Parquet tables). Counts and sums are cast to
types both engines agree on; instants leave as timestamps without zone; sums of
doubles are rounded, as their last bits depend on the order of addition.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import aggregates as A
from quern.functions import values as V
from quern.operators.select import S
from quern.operators.table import Table
from quern.sources import csv, rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def scan(spark: SparkSession, sf: str, name: str, *, clean: bool = True) -> Table:
    """A table of the folder. The given tables hold no NaN, so scans are taken as clean by default."""
    return Table.of(spark.read.parquet(f"{sf}/{name}.parquet"), clean=clean)


def ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def long(c: Column) -> Column:
    return c.cast("long")


def r2(c: Column) -> Column:
    return F.round(c, 2)


def folder(spark: SparkSession) -> str:
    """A fresh path in the session's shared folder, or in its warehouse, removed when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/quern-csv-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


# -- filters and projections ----------------------------------------------------


@query("select l_orderkey, l_partkey, l_quantity * l_extendedprice as worth from lineitem where l_quantity < 10 and l_returnflag = 'A'")
def filter_project(spark, sf):
    t = scan(spark, sf, "lineitem")
    return t.query(S.extend("l_orderkey", "l_partkey", (t["l_quantity"] * t["l_extendedprice"]).alias("worth")).where(t["l_quantity"] < 10).where(t["l_returnflag"] == "A")).df


@query("select p_partkey, p_size, p_brand from part where p_size in (1, 5, 9, 40) and p_brand in ('Brand#2', 'Brand#17', 'Brand#9')")
def filter_in(spark, sf):
    t = scan(spark, sf, "part")
    s = S.extend("p_partkey", "p_size", "p_brand").where(V.is_in("p_size", {1, 5, 9, 40, None})).where(V.is_in("p_brand", ["Brand#2", "Brand#17", "Brand#9"]))
    return t.query(s).df


@query(
    """with t as (select p_partkey, nullif(p_size, 11) as a, nullif(p_brand, 'Brand#17') as b from part)
    select p_partkey, cast(a < 20 and b = 'Brand#2' as int) as both_, cast(a < 20 or b = 'Brand#2' as int) as either_, cast(not (a < 20) as int) as not_
    from t where a < 30 or b = 'Brand#3'"""
)
def filter_3vl_and_or_not(spark, sf):
    t = scan(spark, sf, "part").query("p_partkey", F.nullif("p_size", F.lit(11)).alias("a"), F.nullif("p_brand", F.lit("Brand#17")).alias("b"))
    small, brand = t["a"] < 20, t["b"] == "Brand#2"
    s = S.extend("p_partkey", V.flag(small & brand).alias("both_"), V.flag(small | brand).alias("either_"), V.flag(~small).alias("not_"))
    return t.query(s.where((t["a"] < 30) | (t["b"] == "Brand#3"))).df


@query(
    """with t as (select event_id, nullif(user_id, 8) as u, nullif(value, 6.55) as v, nullif(event_type, 'error') as e, nullif(ts, (select min(ts) from events)) as i from events)
    select event_id, cast(u is null as int) as mu, cast(v is null as int) as mv, cast(e is null as int) as me, cast(i is null as int) as mi, cast(cast(u as int) is null as int) as mn from t"""
)
def is_missing(spark, sf):
    t = scan(spark, sf, "events")
    least = t.df.agg(F.min("ts").alias("least")).scalar()
    t = t.query("event_id", F.nullif("user_id", F.lit(8)).alias("u"), F.nullif("value", F.lit(6.55)).alias("v"), F.nullif("event_type", F.lit("error")).alias("e"), F.nullif("ts", least).alias("i"))
    return t.query("event_id", *(V.flag(V.is_missing(c, double=c == "v")).alias("m" + c) for c in "uvei"), V.flag(V.is_missing(V.to_int("u"))).alias("mn")).df


@query(
    """with t as (select event_id, value, user_id, ts, case when user_id = 3 then null else cast(user_id > 50 as int) end as c, event_type from events)
    select event_id, case when c is null then null when c > 0 then value else 0.5 end as d, case when c is null then null when c > 0 then user_id else -1 end as l,
    case when c is null then null when c > 0 then 1 else 2 end as i, case when c is null then null when c > 0 then event_type else 'none' end as s,
    case when c is null then null when c > 0 then date_trunc('millisecond', ts) else timestamp '2020-01-01' end as t from t"""
)
def ifelse_types(spark, sf):
    t = scan(spark, sf, "events", clean=False)
    c = F.when(t["user_id"] == 3, None).otherwise((t["user_id"] > 50).cast("int"))
    yes = V.truth(c)
    return t.query(
        "event_id", V.choose(yes, t["value"], 0.5).alias("d"), V.choose(yes, t["user_id"], F.lit(-1).cast("long")).alias("l"), V.choose(yes, 1, 2).alias("i"),
        V.choose(yes, t["event_type"], "none").alias("s"), ntz(V.choose(yes, t["ts"], V.instant("2020-01-01T00:00:00Z"))).alias("t"),
    ).df


@query(
    """with t as (select event_id, case when value > 40 then 0 else value end as a, case when user_id < 20 then 0.0 when user_id = 50 then null else user_id - 30.0 end as b from events)
    select event_id, cast(a + b as double) as add_, cast(a - b as double) as sub_, cast(a * b as double) as mul_,
    case when b is null then null when b = 0 and a = 0 then null when b = 0 and a > 0 then 'infinity'::double when b = 0 then '-infinity'::double else cast(a as double) / cast(b as double) end as div_ from t"""
)
def arith_f64(spark, sf):
    t = scan(spark, sf, "events")
    a = F.when(t["value"] > 40, 0.0).otherwise(t["value"])
    b = F.when(t["user_id"] < 20, 0.0).when(t["user_id"] == 50, None).otherwise((t["user_id"] - 30).cast("double"))  # SQL subtracts exactly, then makes a double
    t = t.query("event_id", a.alias("a"), b.alias("b"))
    div = F.when(t["a"].isNull() & (t["b"] == 0), float("-inf")).otherwise(V.divide("a", t["b"]))  # a missing a falls to the last b = 0 of the SQL
    return t.query("event_id", (t["a"] + t["b"]).alias("add_"), (t["a"] - t["b"]).alias("sub_"), (t["a"] * t["b"]).alias("mul_"), div.alias("div_")).df


@query("select c_custkey, floor(c_acctbal / 4 + 0.5) as d, cast(floor(c_acctbal / 4 + 0.5) as int) as i from customer")
def round_half_up(spark, sf):
    t = scan(spark, sf, "customer")
    return t.query("c_custkey", V.round_double(t["c_acctbal"] / 4).alias("d"), V.round_int(t["c_acctbal"] / 4).alias("i")).df


@query("select c_custkey, abs(c_acctbal - 4000) as d, abs(c_nationkey - 12) as i from customer")
def absolute(spark, sf):
    t = scan(spark, sf, "customer")
    return t.query("c_custkey", V.absolute(t["c_acctbal"] - 4000).alias("d"), V.absolute(t["c_nationkey"] - 12).alias("i")).df


@query("select user_id, cast(user_id as double) as d, cast(event_id as int) as i, cast(event_id % 7 as double) as m from events")
def casts(spark, sf):
    t = scan(spark, sf, "events")
    return t.query("user_id", V.to_double("user_id").alias("d"), V.to_int("event_id").alias("i"), V.to_double(t["event_id"] % 7).alias("m")).df


# comparisons of every type, with columns and with constants
@query(
    """select l_orderkey, l_linenumber, cast(l_linenumber = l_quantity as int) as a, cast(l_linenumber <> 3 as int) as b, cast(l_partkey <= l_suppkey as int) as c, cast(l_partkey > 100 as int) as d,
    cast(l_discount < l_tax as int) as e, cast(l_tax >= 0.05 as int) as f, cast(l_returnflag < l_linestatus as int) as g, cast(l_returnflag >= 'N' as int) as h,
    cast(l_shipdate > timestamp '1996-01-01' as int) as i, cast(l_shipdate <> timestamp '1997-03-04' as int) as j, cast(l_orderkey = l_partkey as int) as k from lineitem"""
)
def comparisons(spark, sf):
    t = scan(spark, sf, "lineitem", clean=False)
    ps = {
        "a": t["l_linenumber"] == t["l_quantity"], "b": t["l_linenumber"] != 3, "c": t["l_partkey"] <= t["l_suppkey"], "d": t["l_partkey"] > 100,
        "e": t["l_discount"] < t["l_tax"], "f": t["l_tax"] >= 0.05, "g": t["l_returnflag"] < t["l_linestatus"], "h": t["l_returnflag"] >= "N",
        "i": t["l_shipdate"] > V.instant("1996-01-01T00:00:00Z"), "j": t["l_shipdate"] != V.instant(857433600000), "k": t["l_orderkey"] == t["l_partkey"],
    }
    return t.query("l_orderkey", "l_linenumber", *(V.flag(p).alias(n) for n, p in ps.items())).df


# the matrix of types: for each, two columns with missing values and a constant, in SQL and here
_TYPES = {
    "int": ("case when l_linenumber = 5 then null else l_linenumber end", "case when l_tax > 0.07 then null else cast(floor(l_quantity / 8) as int) end", "3"),
    "long": ("nullif(l_suppkey, 3)", "case when l_tax > 0.07 then null else l_partkey // 20 end", "4"),
    "double": ("nullif(l_discount, 0.01)", "case when l_linenumber = 5 then null else l_tax end", "0.05"),
    "string": ("nullif(l_returnflag, 'R')", "case when l_linenumber = 5 then null else l_linestatus end", "'N'"),
    "instant": ("case when l_linenumber = 5 then null else l_shipdate end", "case when l_tax > 0.07 then null else date_trunc('month', l_shipdate) end", "timestamp '1997-01-01'"),
}
_SIGNS = {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}


def _typed(spark, sf, kind) -> tuple[Table, list]:
    """The table of ``_TYPES`` of one kind, and its constant in every form the language takes."""
    t = scan(spark, sf, "lineitem", clean=False)
    odd, taxed = t["l_linenumber"] == 5, t["l_tax"] > 0.07
    a, b, cs = {
        "int": (F.when(~odd, t["l_linenumber"]), F.when(~taxed, F.floor(t["l_quantity"] / 8).cast("int")), [3]),
        "long": (F.nullif(t["l_suppkey"], F.lit(3)), F.when(~taxed, F.floor(t["l_partkey"] / 20)), [4]),
        "double": (F.nullif(t["l_discount"], F.lit(0.01)), F.when(~odd, t["l_tax"]), [0.05]),
        "string": (F.nullif(t["l_returnflag"], F.lit("R")), F.when(~odd, t["l_linestatus"]), ["N"]),
        "instant": (F.when(~odd, t["l_shipdate"]), F.when(~taxed, V.round_to("l_shipdate", "month")), [V.instant("1997-01-01T00:00:00Z"), V.instant(852076800000)]),
    }[kind]
    return t.query("l_orderkey", "l_linenumber", "l_partkey", a.alias("a"), b.alias("b")), cs


def _typed_sql(kind: str) -> str:
    a, b, _ = _TYPES[kind]
    return f"with t as (select l_orderkey, l_linenumber, l_partkey, {a} as a, {b} as b from lineitem)"


def _compare(kind):
    def run(spark, sf):
        t, cs = _typed(spark, sf, kind)
        a, b = t["a"], t["b"]
        signs = {"eq": Column.__eq__, "ne": Column.__ne__, "lt": Column.__lt__, "le": Column.__le__, "gt": Column.__gt__, "ge": Column.__ge__}
        out = [V.flag(f(a, x)).alias(f"{n}_{k}") for n, f in signs.items() for k, x in (("col", b), *((f"const{i}", c) for i, c in enumerate(cs)))]
        return t.query("l_orderkey", "l_linenumber", *out).df

    run.__name__ = f"compare_{kind}"
    n = 2 if kind == "instant" else 1
    out = [f"cast(a {s} {x} as int) as {name}_{k}" for name, s in _SIGNS.items() for k, x in (("col", "b"), *((f"const{i}", _TYPES[kind][2]) for i in range(n)))]
    return query(f"{_typed_sql(kind)} select l_orderkey, l_linenumber, {', '.join(out)} from t")(run)


def _choose(kind):
    """Column and column, constant and column, column and constant, two constants."""
    more = {"int": ("9", 9), "long": ("9", lambda: F.lit(9).cast("long")), "double": ("0.5", 0.5), "string": ("'z'", "z"), "instant": ("timestamp '2001-02-03'", lambda: V.instant("2001-02-03T00:00:00Z"))}[kind]

    def run(spark, sf):
        t, cs = _typed(spark, sf, kind)
        c, d = cs[-1], more[1]() if callable(more[1]) else more[1]
        c = F.lit(c).cast("long") if kind == "long" else c
        p = F.when(t["l_partkey"] % 10 != 0, t["l_partkey"] % 10 > 4)
        show = ntz if kind == "instant" else lambda x: x
        forms = {"cc": (t["a"], t["b"]), "kc": (c, t["b"]), "ck": (t["a"], c), "kk": (c, d)}
        return t.query("l_orderkey", "l_linenumber", *(show(V.choose(p, x, y)).alias(n) for n, (x, y) in forms.items())).df

    run.__name__ = f"choose_{kind}"
    c = _TYPES[kind][2]
    forms = {"cc": ("a", "b"), "kc": (c, "b"), "ck": ("a", c), "kk": (c, more[0])}
    cast = {"int": "int", "long": "bigint", "double": "double", "string": "varchar", "instant": "timestamp"}[kind]
    cases = ", ".join(f"cast(case when l_partkey % 10 = 0 then null when l_partkey % 10 > 4 then {x} else {y} end as {cast}) as {n}" for n, (x, y) in forms.items())
    return query(f"{_typed_sql(kind)} select l_orderkey, l_linenumber, {cases} from t")(run)


def _aggregate(kind):
    """All aggregates of a type; ``first`` of a value that is the same throughout its group."""

    def run(spark, sf):
        t, _ = _typed(spark, sf, kind)
        show = ntz if kind == "instant" else lambda x: x
        same = {"int": V.to_int("l_partkey"), "long": F.col("l_partkey"), "double": V.to_double("l_partkey"), "string": V.printf("l_partkey", "p%d"), "instant": V.from_epoch_millis("l_partkey")}[kind]
        t = t.query(t.all().extend(same.alias("same")))
        return t.group_by("l_partkey").reduce_total(
            A.key("l_partkey").alias("l_partkey"), A.count("a").alias("n"), A.count_distinct("a").alias("d"), A.has_missing("a").alias("m"),
            show(A.least("a")).alias("lo"), show(A.greatest("a")).alias("hi"), show(A.first("same")).alias("same"),
        ).df

    run.__name__ = f"aggregate_{kind}"
    same = {"int": "cast(l_partkey as int)", "long": "l_partkey", "double": "cast(l_partkey as double)", "string": "'p' || l_partkey", "instant": "make_timestamp(l_partkey * 1000)"}[kind]
    return query(f"{_typed_sql(kind)} select l_partkey, count(a) as n, count(distinct a) as d, max(cast(a is null as int)) as m, min(a) as lo, max(a) as hi, {same} as same from t group by l_partkey")(run)


for _kind in _TYPES:
    _compare(_kind)
    _choose(_kind)
    _aggregate(_kind)


@query("select p_partkey, 5 as i, cast(6 as bigint) as l, 0.25::double as d, 'x' as s, timestamp '2020-01-02 03:04:05' as t, cast(null as double) as m from part")
def constants(spark, sf):
    cs = {"i": V.const(5), "l": V.const(6).cast("long"), "d": V.const(0.25), "s": V.const("x"), "t": ntz(V.const(datetime(2020, 1, 2, 3, 4, 5))), "m": V.const(float("nan")).cast("double")}
    return scan(spark, sf, "part").query("p_partkey", *(c.alias(n) for n, c in cs.items())).df


@query(
    """select event_id, cast(user_id in (3, 8, 40) as int) as l, cast(cast(user_id as int) in (3, 8, 40) as int) as i, cast(value in (6.55, 8.5, 9.25) as int) as d, cast(event_type in ('click', 'error') as int) as s,
    cast(date_trunc('day', ts) in (timestamp '2024-01-01', timestamp '2024-01-03') as int) as t, cast(case when nullif(event_type, 'click') is not null then false end as int) as none from events"""
)
def members(spark, sf):
    t = scan(spark, sf, "events", clean=False)
    flags = {
        "l": V.is_in("user_id", {3, 8, 40}), "i": V.is_in(V.to_int("user_id"), {3, 8, 40, None}), "d": V.is_in("value", {6.55, 8.5, 9.25, float("nan")}), "s": V.is_in("event_type", {"click", "error"}),
        "t": V.is_in(V.round_to("ts", "day"), {datetime(2024, 1, 1), datetime(2024, 1, 3)}), "none": V.is_in(F.nullif("event_type", F.lit("click")), ()),
    }
    return t.query("event_id", *(V.flag(p).alias(n) for n, p in flags.items())).df


# -- strings ------------------------------------------------------------------------


@query("select p_partkey, p_name from part where regexp_full_match(p_name, '(small|red) [a-z]+')")
def str_matches(spark, sf):
    t = scan(spark, sf, "part")
    return t.query(S.extend("p_partkey", "p_name").where(V.matches("p_name", "(small|red) [a-z]+"))).df


@query("select p_partkey, case when regexp_full_match(p_type, 'E.*|S.*') then 'x$1' else p_type end as t from part")
def str_match_replace(spark, sf):
    return scan(spark, sf, "part").query("p_partkey", V.replace_match("p_type", "E.*|S.*", "x$1").alias("t")).df


@query("select p_partkey, substring(p_name, 3, 4) as s, substring(p_brand, 7, 20) as b, p_name[1:2] as before from part")
def str_substring(spark, sf):
    return scan(spark, sf, "part").query("p_partkey", V.substring("p_name", 2, 4).alias("s"), V.substring("p_brand", 6, 20).alias("b"), V.substring("p_name", -3, 5).alias("before")).df


@query("select p_partkey, p_name || p_type as a, nullif(p_brand, 'Brand#2') || '!' as b from part")
def str_concat(spark, sf):
    t = scan(spark, sf, "part")
    return t.query("p_partkey", V.concatenate("p_name", t["p_type"]).alias("a"), V.concatenate(F.nullif("p_brand", F.lit("Brand#2")), "!").alias("b")).df


@query("select p_partkey, cast(length(p_name) as int) as n, cast(length(p_name) > 0 as int) as some from part")
def str_length(spark, sf):
    return scan(spark, sf, "part").query("p_partkey", V.length("p_name").alias("n"), V.flag(V.is_nonempty("p_name")).alias("some")).df


@query(
    """with t as (select p_partkey, substring(p_brand, 7) as n, p_name from part)
    select p_partkey, try_cast(n as int) as i, try_cast(n as bigint) as l, try_cast(n || '.5' as double) as d, try_cast(p_name as int) as bad from t"""
)
def str_parse(spark, sf):
    t = scan(spark, sf, "part").query("p_partkey", V.substring("p_brand", 6, 9).alias("n"), "p_name")
    return t.query("p_partkey", V.to_int("n").alias("i"), V.to_long("n").alias("l"), V.to_double(V.concatenate("n", ".5")).alias("d"), V.to_int("p_name").alias("bad")).df


@query(
    """with t as (select p_partkey, nullif(p_size, 11) as s, p_retailprice as p from part)
    select p_partkey, coalesce(printf('%05d', s), 'NA') as i, printf('<%d>', p_partkey) as l, printf('%.1f', floor(p)) as d from t"""
)
def printf(spark, sf):
    t = scan(spark, sf, "part").query("p_partkey", F.nullif("p_size", F.lit(11)).alias("s"), F.floor("p_retailprice").cast("double").alias("p"))
    return t.query("p_partkey", V.printf("s", "%05d").alias("i"), V.printf("p_partkey", "<%d>").alias("l"), V.printf("p", "%.1f").alias("d")).df


# -- instants -----------------------------------------------------------------------


@query(
    """select event_id, cast(year(ts) as int) as y, cast(month(ts) as int) as mo, cast(day(ts) as int) as d, cast(hour(ts) as int) as h, cast(minute(ts) as int) as mi,
    cast(second(ts) as int) as s, cast(epoch_us(ts) // 1000 % 1000 * 1000000 as int) as n from events"""
)
def date_parts(spark, sf):
    t = scan(spark, sf, "events", clean=False)
    parts = {"y": V.years, "mo": V.months, "d": V.days, "h": V.hours, "mi": V.minutes, "s": V.seconds, "n": V.nanoseconds}
    return t.query("event_id", *(f("ts").alias(n) for n, f in parts.items())).df


@query("select event_id, " + ", ".join(f"cast(date_trunc('{u}', ts) as timestamp) as {u}_" for u in ("year", "month", "day", "hour", "minute", "second")) + " from events")
def date_truncate(spark, sf):
    t = scan(spark, sf, "events", clean=False)
    return t.query("event_id", *(ntz(V.round_to("ts", u)).alias(u + "_") for u in ("year", "month", "day", "hour", "minute", "second"))).df


@query(
    """with t as (select event_id, date_trunc('millisecond', ts) as ts from events) select event_id, ts + interval 90 second as a, ts - interval 90 second as b, ts + interval 40 day as c,
    ts - interval 40 day as d, ts + interval 1234 millisecond as e, ts - interval 1234 millisecond as f from t"""
)
def date_plus_minus(spark, sf):
    t = scan(spark, sf, "events", clean=False)
    cs = {"a": V.plus_seconds("ts", 90), "b": V.minus_seconds("ts", 90), "c": V.plus_days("ts", 40), "d": V.minus_days("ts", 40), "e": V.plus_millis("ts", 1234), "f": V.minus_millis("ts", 1234)}
    return t.query("event_id", *(ntz(c).alias(n) for n, c in cs.items())).df


@query("select event_id, epoch_us(ts) // 1000 as l, cast(epoch_us(ts) // 1000 as double) as d, make_timestamp(epoch_us(ts) // 1000 * 1000) as back from events")
def epoch_millis(spark, sf):
    t = scan(spark, sf, "events", clean=False)
    ms = V.epoch_millis("ts")
    return t.query("event_id", ms.alias("l"), V.to_double(ms).alias("d"), ntz(V.from_epoch_millis(ms)).alias("back")).df


@query(
    """with t as (select event_id, case when event_id % 3 = 0 then date_trunc('second', ts) else date_trunc('millisecond', ts) end as x from events)
    select event_id, case when epoch_ms(x) % 1000 = 0 then strftime(x, '%Y-%m-%dT%H:%M:%SZ') else strftime(x, '%Y-%m-%dT%H:%M:%S.%gZ') end as iso from t"""
)
def to_iso(spark, sf):
    t = scan(spark, sf, "events", clean=False)
    x = F.when(t["event_id"] % 3 == 0, V.round_to("ts", "second")).otherwise(t["ts"])
    return t.query("event_id", V.to_iso(x).alias("iso")).df


@query("select event_id, date_trunc('millisecond', ts) as a, cast(date_trunc('day', ts) as timestamp) as b from events")
def parse_instant(spark, sf):
    t = scan(spark, sf, "events", clean=False)
    text, day = V.to_iso("ts"), F.date_format("ts", "yyyy/MM/dd")
    return t.query("event_id", ntz(V.parse_instant(text)).alias("a"), ntz(V.parse_instant(day, "yyyy/MM/dd")).alias("b")).df


# -- counts, reductions, groups -------------------------------------------------------


@query("select count(*) as count from lineitem where l_discount > 0.05 and l_shipdate < timestamp '1997-01-01'")
def simple_count(spark, sf):
    t = scan(spark, sf, "lineitem")
    return t.count((t["l_discount"] > 0.05) & (t["l_shipdate"] < F.lit("1997-01-01").cast("timestamp_ntz"))).df


@query("select round(sum(l_quantity), 2) as q, count(l_tax) as n, min(l_shipdate) as lo, max(l_shipdate) as hi, round(avg(l_discount), 8) as m, cast(sum(l_linenumber) as bigint) as s from lineitem")
def reduce_total(spark, sf):
    t = scan(spark, sf, "lineitem")
    return t.reduce(
        r2(A.total("l_quantity")).alias("q"), A.count("l_tax").alias("n"), A.least("l_shipdate").alias("lo"), A.greatest("l_shipdate").alias("hi"),
        F.round(A.mean("l_discount"), 8).alias("m"), A.total("l_linenumber").alias("s"),
    ).df


@query("select round(sum(l_quantity), 2) as q, count(*) as n, max(l_extendedprice) as hi from lineitem")
def partial_reduce_then_reduce(spark, sf):
    p = scan(spark, sf, "lineitem").partial_reduce(A.total("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"), A.greatest("l_extendedprice").alias("hi"))
    return p.reduce(r2(A.total("q")).alias("q"), A.total("n").alias("n"), A.greatest("hi").alias("hi")).df


@query(
    """select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc,
    round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) as sum_charge, round(avg(l_quantity), 6) as avg_qty, round(avg(l_extendedprice), 4) as avg_price,
    round(avg(l_discount), 8) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2"""
)
def pricing_summary(spark, sf):
    t = scan(spark, sf, "lineitem")
    price, disc, tax = t["l_extendedprice"], t["l_discount"], t["l_tax"]
    return (
        t.where(t["l_shipdate"] <= F.lit("1998-09-02").cast("timestamp_ntz"))
        .group_by("l_returnflag", "l_linestatus")
        .reduce_total(
            A.key("l_returnflag").alias("l_returnflag"), A.key("l_linestatus").alias("l_linestatus"), r2(A.total("l_quantity")).alias("sum_qty"), r2(A.total(price)).alias("sum_base"),
            r2(A.total(price * (1 - disc))).alias("sum_disc"), r2(A.total(price * (1 - disc) * (1 + tax))).alias("sum_charge"), F.round(A.mean("l_quantity"), 6).alias("avg_qty"),
            F.round(A.mean(price), 4).alias("avg_price"), F.round(A.mean(disc), 8).alias("avg_disc"), F.count(F.lit(1)).alias("n"),
        ).df
    )


@query("select user_id, round(sum(value), 2) as s, count(*) as n, min(value) as lo, max(value) as hi, round(avg(value), 6) as m from events group by user_id")
def group_total(spark, sf):
    t = scan(spark, sf, "events")
    return t.group_by("user_id").reduce_total(A.key("user_id").alias("user_id"), r2(A.total("value")).alias("s"), A.count("event_id").alias("n"), A.least("value").alias("lo"), A.greatest("value").alias("hi"), F.round(A.mean("value"), 6).alias("m")).df


@query("select user_id, event_type, count(value) as n, min(ts) as lo, max(ts) as hi from events group by user_id, event_type")
def group_multi_key(spark, sf):
    t = scan(spark, sf, "events")
    return t.group_by("user_id").by("event_type").reduce_total(A.key("user_id").alias("user_id"), A.key("event_type").alias("event_type"), A.count("value").alias("n"), A.least("ts").alias("lo"), A.greatest("ts").alias("hi")).df


@query("select l_partkey, round(sum(l_quantity), 2) as q from lineitem group by l_partkey having sum(l_quantity) > 800 and count(*) >= 30")
def group_having(spark, sf):
    t = scan(spark, sf, "lineitem")
    program = S.extend(A.key("l_partkey").alias("l_partkey"), r2(A.total("l_quantity")).alias("q")).where(A.total("l_quantity") > 800).where(A.count("l_orderkey") >= 30)
    return t.group_by("l_partkey").reduce_total(program).df


@query("select l_suppkey, round(sum(l_quantity), 2) as q, count(*) as n from lineitem group by l_suppkey")
def group_partial_then_total(spark, sf):
    p = scan(spark, sf, "lineitem").group_by("l_suppkey").reduce_partial(A.key("l_suppkey").alias("l_suppkey"), A.total("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"))
    return p.group_by("l_suppkey").reduce_total(A.key("l_suppkey").alias("l_suppkey"), r2(A.total("q")).alias("q"), A.total("n").alias("n")).df


@query("select count(*) as count from (select l_partkey from lineitem group by l_partkey having sum(l_quantity) > 700)")
def group_count(spark, sf):
    return scan(spark, sf, "lineitem").group_by("l_partkey").count(S.where(A.total("l_quantity") > 700)).df


@query("with t as (select nullif(event_type, 'click') as e, value from events) select e, count(*) as n, round(sum(value), 2) as s from t group by e")
def group_missing_key(spark, sf):
    t = scan(spark, sf, "events").query(F.nullif("event_type", F.lit("click")).alias("e"), "value")
    return t.group_by("e").reduce_total(A.key("e").alias("e"), F.count(F.lit(1)).alias("n"), r2(A.total("value")).alias("s")).df


@query(
    """with t as (select user_id, case when value > 90 then null else cast(value > 0.5 as int) end as f, cast(value > 80 as int) as g from events)
    select user_id, min(coalesce(cast(f <> 0 as int), 0)) as all_, max(coalesce(cast(g = 1 as int), 0)) as any_, 1 - max(coalesce(cast(g = 1 as int), 0)) as none_ from t group by user_id"""
)
def agg_all_any_none(spark, sf):
    t = scan(spark, sf, "events")
    t = t.query("user_id", F.when(t["value"] > 90, None).otherwise((t["value"] > 0.5).cast("int")).alias("f"), (t["value"] > 80).cast("int").alias("g"))
    return t.group_by("user_id").reduce_total(A.key("user_id").alias("user_id"), A.all_true("f").alias("all_"), A.any_true("g").alias("any_"), A.none_true("g").alias("none_")).df


@query(
    """with t as (select user_id, nullif(event_type, 'error') as e, case when value > 70 then null else value end as v from events)
    select user_id, max(cast(e is null as int)) as he, max(cast(v is null as int)) as hv, count(e) as ce, count(v) as cv, round(sum(v), 2) as sv, min(v) as lo, max(v) as hi from t group by user_id"""
)
def agg_has_missing(spark, sf):
    t = scan(spark, sf, "events")
    t = t.query("user_id", F.nullif("event_type", F.lit("error")).alias("e"), F.when(t["value"] <= 70, t["value"]).alias("v"))
    return t.group_by("user_id").reduce_total(A.key("user_id").alias("user_id"), A.has_missing("e").alias("he"), A.has_missing("v").alias("hv"), A.count("e").alias("ce"), A.count("v").alias("cv"), r2(A.total("v")).alias("sv"), A.least("v").alias("lo"), A.greatest("v").alias("hi")).df


@query("select o_custkey, any_value(o_custkey) as k, count(*) as n from orders group by o_custkey")
def agg_first_key(spark, sf):
    return scan(spark, sf, "orders").group_by("o_custkey").reduce_total(A.key("o_custkey").alias("o_custkey"), A.first("o_custkey").alias("k"), A.count("o_orderkey").alias("n")).df


@query("with t as (select user_id, nullif(event_type, 'error') as e, value, ts from events) select user_id, count(distinct e) as e, count(distinct value) as v, count(distinct ts) as t from t group by user_id")
def count_distinct(spark, sf):
    t = scan(spark, sf, "events").query("user_id", F.nullif("event_type", F.lit("error")).alias("e"), "value", "ts")
    return t.group_by("user_id").reduce_total(A.key("user_id").alias("user_id"), A.count_distinct("e").alias("e"), A.count_distinct("value").alias("v"), A.count_distinct("ts").alias("t")).df


@query("select distinct p_brand from part")
def distinct_via_group(spark, sf):
    return scan(spark, sf, "part").group_by("p_brand").reduce_total(A.key("p_brand").alias("p_brand")).df


@query("select distinct p_brand, p_type from part")
def distinct(spark, sf):
    return scan(spark, sf, "part").distinct("p_brand", "p_type").df


# -- joins ----------------------------------------------------------------------------


@query("select o_orderkey, c_name, o_totalprice from orders join customer on o_custkey = c_custkey")
def join_inner(spark, sf):
    o, c = scan(spark, sf, "orders"), scan(spark, sf, "customer")
    return o.on("o_custkey").inner(c, "c_custkey").select(lambda o, c: S.extend(o["o_orderkey"], c["c_name"], o["o_totalprice"])).df


# keys without a match and missing keys on both sides, by value: whole tables are joined
_SIDES = "with o as (select o_orderkey, nullif(o_custkey, 7) + 100 as k from orders), c as (select nullif(c_custkey, 105) as k, c_name from customer)"


def _sides(spark, sf):
    o, c = scan(spark, sf, "orders"), scan(spark, sf, "customer")
    o = o.query("o_orderkey", (F.nullif("o_custkey", F.lit(7)) + 100).alias("k"))
    return o, c.query(F.nullif("c_custkey", F.lit(105)).alias("k"), "c_name")


def _pair(o, c):
    return S.extend(o["o_orderkey"], o["k"].alias("a"), c["k"].alias("b"), c["c_name"])


@query(_SIDES + " select o_orderkey, o.k as a, c.k as b, c_name from o left join c on o.k = c.k")
def join_left(spark, sf):
    o, c = _sides(spark, sf)
    return o.on("k").left(c, "k").select(_pair).df


@query(_SIDES + " select o_orderkey, o.k as a, c.k as b, c_name from o right join c on o.k = c.k")
def join_right(spark, sf):
    o, c = _sides(spark, sf)
    return o.on("k").right(c, "k").select(_pair).df


@query(_SIDES + " select o_orderkey, coalesce(o.k, c.k) as k, c_name from o full join c on o.k = c.k")
def join_outer(spark, sf):
    o, c = _sides(spark, sf)
    return o.on("k").outer(c, "k").select(lambda o, c: S.extend(o["o_orderkey"], V.choose(V.is_missing(o["k"]), c["k"], o["k"]).alias("k"), c["c_name"])).df


@query(_SIDES + " select count(*) as n, count(o.k) as a, count(c.k) as b from o full join c on o.k = c.k where o.k is null or c.k is null")
def join_missing_keys(spark, sf):
    o, c = _sides(spark, sf)
    t = o.on("k").outer(c, "k").select(lambda o, c: S.extend(o["k"].alias("a"), c["k"].alias("b")).where(V.is_missing(o["k"]) | V.is_missing(c["k"])))
    return t.reduce(F.count(F.lit(1)).alias("n"), A.count("a").alias("a"), A.count("b").alias("b")).df


@query("select l_orderkey, l_linenumber, o_orderdate, p_name from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey")
def join_3way(spark, sf):
    li, o, p = scan(spark, sf, "lineitem"), scan(spark, sf, "orders"), scan(spark, sf, "part")
    li = li.query("l_orderkey", "l_linenumber", "l_partkey")
    t = li.on("l_orderkey").inner(o, "o_orderkey").select(lambda a, o: S.extend(a["l_orderkey"], a["l_linenumber"], a["l_partkey"], o["o_orderdate"]))
    return t.on("l_partkey").inner(p, "p_partkey").select(lambda t, p: S.extend(t["l_orderkey"], t["l_linenumber"], t["o_orderdate"], p["p_name"])).df


_THREE = """with a as (select c_custkey * 2 as k, c_name as n from customer), b as (select o_custkey * 3 as k, count(*) as m from orders group by 1),
    c as (select s_suppkey as k, s_name as s from supplier) select a.k as ak, b.k as bk, c.k as ck, m, s from a full join b on a.k = b.k left join c on """


def _three(spark, sf, against):
    a, b, c = scan(spark, sf, "customer"), scan(spark, sf, "orders"), scan(spark, sf, "supplier")
    a = a.query((F.col("c_custkey") * 2).alias("k"), F.col("c_name").alias("n"))
    b = b.query((F.col("o_custkey") * 3).alias("k")).group_by("k").reduce_total(A.key("k").alias("k"), F.count(F.lit(1)).alias("m"))
    c = c.query(F.col("s_suppkey").alias("k"), F.col("s_name").alias("s"))
    return a.on("k").outer(b, "k").left(c, "k", against=against).select(lambda a, b, c: S.extend(a["k"].alias("ak"), b["k"].alias("bk"), c["k"].alias("ck"), b["m"], c["s"])).df


@query(_THREE + "a.k = c.k")
def join_against_first(spark, sf):
    return _three(spark, sf, 0)


@query(_THREE + "b.k = c.k")
def join_against_other(spark, sf):
    return _three(spark, sf, 1)


@query("select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where c_acctbal > 5000 and o_totalprice < c_acctbal * 10")
def join_where(spark, sf):
    o, c = scan(spark, sf, "orders"), scan(spark, sf, "customer")
    return o.on("o_custkey").inner(c, "c_custkey").select(lambda o, c: S.extend(o["o_orderkey"], c["c_name"]).where(c["c_acctbal"] > 5000).where(o["o_totalprice"] < c["c_acctbal"] * 10)).df


@query("with o as (select o_orderkey, printf('Customer#%09d', o_custkey + 40) as k from orders) select o_orderkey, c_custkey from o join customer on k = c_name")
def join_string_key(spark, sf):
    o, c = scan(spark, sf, "orders"), scan(spark, sf, "customer")
    o = o.query("o_orderkey", V.printf(o["o_custkey"] + 40, "Customer#%09d").alias("k"))
    return o.on("k").inner(c, "c_name").select(lambda o, c: S.extend(o["o_orderkey"], c["c_custkey"])).df


@query(
    """with a as (select l_discount as k, count(*) as n from lineitem group by 1), b as (select nullif(l_tax, 0.03) as k, count(*) as m from lineitem group by 1)
    select a.k as a, b.k as b, n, m from a full join b on a.k = b.k"""
)
def join_double_key(spark, sf):
    t = scan(spark, sf, "lineitem", clean=False)
    a = t.group_by("l_discount").reduce_total(A.key("l_discount").alias("k"), A.count("l_orderkey").alias("n"))
    b = t.query(F.nullif("l_tax", F.lit(0.03)).alias("k")).group_by("k").reduce_total(A.key("k").alias("k"), F.count(F.lit(1)).alias("m"))
    return a.on("k").outer(b, "k").select(lambda a, b: S.extend(a["k"].alias("a"), b["k"].alias("b"), a["n"], b["m"])).df


@query(
    """with a as (select l_shipdate as k, count(*) as n from lineitem group by 1), b as (select o_orderdate as k, count(*) as m from orders group by 1)
    select a.k as a, b.k as b, n, m from a left join b on a.k = b.k"""
)
def join_instant_key(spark, sf):
    a, b = scan(spark, sf, "lineitem", clean=False), scan(spark, sf, "orders", clean=False)
    a = a.group_by("l_shipdate").reduce_total(A.key("l_shipdate").alias("k"), A.count("l_orderkey").alias("n"))
    b = b.group_by("o_orderdate").reduce_total(A.key("o_orderdate").alias("k"), A.count("o_orderkey").alias("m"))
    return a.on("k").left(b, "k").select(lambda a, b: S.extend(ntz(a["k"]).alias("a"), ntz(b["k"]).alias("b"), a["n"], b["m"])).df


@query("select a.n_nationkey as a, b.n_nationkey as b from nation a join nation b on a.n_regionkey = b.n_regionkey")
def self_join(spark, sf):
    n = scan(spark, sf, "nation")
    return n.on("n_regionkey").inner(n, "n_regionkey").select(lambda a, b: S.extend(a["n_nationkey"].alias("a"), b["n_nationkey"].alias("b"))).df


@query("select o_custkey, count(*) as n, max(c_name) as c from orders join customer on o_custkey = c_custkey group by o_custkey")
def join_after_partition(spark, sf):
    o, c = scan(spark, sf, "orders").query("o_custkey", "o_orderkey").partition_by("o_custkey"), scan(spark, sf, "customer")
    t = o.on("o_custkey").inner(c, "c_custkey").select(lambda o, c: S.extend(o["o_custkey"], c["c_name"]))
    return t.group_by("o_custkey").reduce_total(A.key("o_custkey").alias("o_custkey"), F.count(F.lit(1)).alias("n"), A.greatest("c_name").alias("c")).df


# -- whole tables -----------------------------------------------------------------------


@query("select n_nationkey as k, n_name as n from nation union all select r_regionkey, r_name from region union all select n_nationkey, n_name from nation")
def concat(spark, sf):
    n, r = scan(spark, sf, "nation").query("n_nationkey", "n_name").rename("k", "n"), scan(spark, sf, "region").rename("k", "n")
    return n.concat(r, n).df


@query("select r_regionkey as a, r_name as b from region")
def rename(spark, sf):
    return scan(spark, sf, "region").rename("a", "b").df


@query("select r_regionkey as x_r_regionkey, r_name as x_r_name, r_regionkey, r_name, 7 as c from region where r_regionkey > 1 and r_regionkey < 4")
def select_all_prefix(spark, sf):
    t = scan(spark, sf, "region")
    return t.query(t.all_with_prefix("x_").where(t["r_regionkey"] > 1).concat(t.all().where(t["r_regionkey"] < 4)).extend(F.lit(7).alias("c"))).df


@query("select vec_id, label, embedding from embeddings where label = 3")
def pass_through_arrays(spark, sf):
    t = scan(spark, sf, "embeddings")
    return t.query(S.extend("vec_id", "label", "embedding").where(t["label"] == 3)).df


@query("select l_orderkey, l_linenumber, q from (select *, nullif(l_quantity, 1) as q from lineitem) where q <= (select max(q) from (select nullif(l_quantity, 1) as q from lineitem where l_quantity <> 1 order by q limit 25))")
def topk_asc_ties(spark, sf):
    t = scan(spark, sf, "lineitem").query("l_orderkey", "l_linenumber", F.nullif("l_quantity", F.lit(1.0)).alias("q"))
    return t.top_k("q", 25).df


@query("select o_orderkey, o_totalprice from orders where o_totalprice >= (select min(o_totalprice) from (select o_totalprice from orders order by o_totalprice desc limit 40))")
def topk_desc_ties(spark, sf):
    return scan(spark, sf, "orders").query("o_orderkey", "o_totalprice").top_k("o_totalprice", 40, ascending=False).df


@query("select o_orderkey, o_totalprice from orders where o_totalprice >= (select min(o_totalprice) from (select o_totalprice from orders order by o_totalprice desc limit 40))")
def topk_approximate(spark, sf):
    """A sketch narrows the rows, then the exact cut-off is taken among those."""
    t = scan(spark, sf, "orders").query("o_orderkey", "o_totalprice")
    return t.top_k("o_totalprice", 40, ascending=False, approximate=True).top_k("o_totalprice", 40, ascending=False).df


# -- sources and sinks ---------------------------------------------------------------------


def _odd_text(x: Column, case: Column) -> Column:
    """Strings that a careless writer or reader of delimited text changes."""
    forms = [F.concat(F.lit(" "), x, F.lit("  ")), F.concat(F.lit("a\n"), x), F.concat(x, F.lit("\r\nb")), F.concat(F.lit('a "'), x, F.lit('", b')), F.lit(""), F.lit("NA")]
    out = F
    for i, form in enumerate(forms):
        out = out.when(case == i, form)
    return out.otherwise(F.concat(F.lit("\t"), x))


@query(
    """select event_id, cast(nullif(user_id, 8) as int) as u, nullif(value, 6.55) as v, nullif(event_type, 'error') as e, date_trunc('millisecond', ts) as t, props,
    case user_id % 7 when 0 then ' ' || event_type || '  ' when 1 then 'a' || chr(10) || event_type when 2 then event_type || chr(13) || chr(10) || 'b' when 3 then 'a "' || event_type || '", b' when 4 then '' when 5 then 'NA' else chr(9) || event_type end as s
    from events"""
)
def csv_roundtrip(spark, sf):
    t = scan(spark, sf, "events", clean=False)
    t = t.query("event_id", V.to_int(F.nullif("user_id", F.lit(8))).alias("u"), F.nullif("value", F.lit(6.55)).alias("v"), F.nullif("event_type", F.lit("error")).alias("e"), F.col("ts").alias("t"), "props", _odd_text(t["event_type"], t["user_id"] % 7).alias("s"))
    path = folder(spark)
    csv.export_csv(t, path)
    back = {"event_id": csv.long_field(0), "u": csv.int_field(1), "v": csv.double_field(2), "e": csv.str_field(3, "NA"), "t": csv.instant_field(4), "props": csv.str_field(5), "s": csv.str_field(6)}
    out = csv.import_csv(spark, path, back, record_separator="\r\n", line_breaks=True).df
    return out.withColumn("t", ntz(F.col("t")))


@query("select n_nationkey as k, n_name as n, cast(n_regionkey as double) / 2 as d from nation")
def rows_roundtrip(spark, sf):
    t = scan(spark, sf, "nation")
    t = t.query("n_nationkey", "n_name", (V.to_double("n_regionkey") / 2).alias("d"))
    return rows.import_rows(spark, rows.export_rows(t), "k int, n string, d double").df


# -- pipelines ---------------------------------------------------------------------------------


@query(
    """with o as (select l_suppkey as k, avg(l_extendedprice) as a, count(*) as n from lineitem group by 1), i as (select l_partkey as k, avg(l_quantity) as a, count(*) as n from lineitem group by 1)
    select coalesce(o.k, i.k) as k, round(o.a, 4) as avg_out, round(i.a, 4) as avg_in, o.n as n_out, i.n as n_in from o full join i on o.k = i.k"""
)
def pipeline_in_out_avg(spark, sf):
    t = scan(spark, sf, "lineitem")

    def average(t, key, value):
        p = t.group_by(key).reduce_partial(A.key(key).alias("k"), A.total(value).alias("s"), A.count(value).alias("n"))
        return p.group_by("k").reduce_total(A.key("k").alias("k"), V.divide(A.total("s"), A.total("n")).alias("a"), A.total("n").alias("n"))

    out, into = average(t, "l_suppkey", "l_extendedprice"), average(t, "l_partkey", "l_quantity")
    return out.on("k").outer(into, "k").select(
        lambda o, i: S.extend(V.choose(V.is_missing(o["k"]), i["k"], o["k"]).alias("k"), F.round(o["a"], 4).alias("avg_out"), F.round(i["a"], 4).alias("avg_in"), o["n"].alias("n_out"), i["n"].alias("n_in"))
    ).df


@query(
    """with m as (select event_type, min(value) as lo, max(value) as hi from events group by 1)
    select e.event_id, e.event_type, e.value from events e join m on e.event_type = m.event_type where e.value = m.lo or e.value = m.hi"""
)
def pipeline_min_max_rows(spark, sf):
    t = scan(spark, sf, "events")
    ends = t.group_by("event_type").reduce_total(A.key("event_type").alias("e"), A.least("value").alias("lo"), A.greatest("value").alias("hi"))
    return t.on("event_type").inner(ends, "e").select(lambda t, m: S.extend(t["event_id"], t["event_type"], t["value"]).where((t["value"] == m["lo"]) | (t["value"] == m["hi"]))).df


@query("select event_type, min(value) as lo, round(avg(value), 3) as m, max(value) as hi from events group by 1")
def station_summary(spark, sf):
    return scan(spark, sf, "events").group_by("event_type").reduce_total(A.key("event_type").alias("event_type"), A.least("value").alias("lo"), F.round(A.mean("value"), 3).alias("m"), A.greatest("value").alias("hi")).df


@query("select o_custkey, count(*) as n from (select distinct o_custkey, o_orderstatus from orders) group by 1")
def let_shared(spark, sf):
    t = scan(spark, sf, "orders").distinct("o_custkey", "o_orderstatus")
    return t.let(lambda d: d.group_by("o_custkey").reduce_total(A.key("o_custkey").alias("o_custkey"), F.count(F.lit(1)).alias("n"))).df
