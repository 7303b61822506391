"""Table operators, on several partitions, with joins both ways."""

from __future__ import annotations

from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quern.functions import aggregates as A
from quern.functions import values as V
from quern.operators.select import S
from quern.operators.table import Table, concatenate
from quern.plans.metrics import measured
from quern.plans.render import count_operators


def rows(t):
    return sorted((tuple(r) for r in t.df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(params=["-1", "10m"], ids=["merge", "broadcast"])
def joins(spark, request):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def table(spark, data, schema):
    return Table.of(spark.createDataFrame(data, schema).repartition(3))


def test_query_ands_predicates(spark):
    t = table(spark, [(i, i * 10) for i in range(10)], "a int, b int")
    assert rows(t.query(t.all().where(t["a"] > 3).where(t["b"] < 70))) == [(4, 40), (5, 50), (6, 60)]
    assert t.query(S.extend("a").where(t["a"] > 3).concat(S.extend("b").where(t["a"] < 6))).df.columns == ["a", "b"]


def test_missing_predicate_drops_the_row(spark):
    t = table(spark, [(1,), (None,), (3,)], "a int")
    assert rows(t.where(~(t["a"] == 1))) == [(3,)]
    assert rows(t.count(t["a"] > 0)) == [(2,)]


def test_groups(spark):
    t = table(spark, [("a", 1.0), ("a", None), ("a", 3.0), ("b", None), ("b", float("nan")), (None, 5.0), (None, 6.0)], "k string, v double")
    out = t.group_by("k").reduce_total(A.key("k").alias("k"), A.total("v").alias("s"), A.count("v").alias("n"), A.has_missing("v").alias("m"), A.least("v").alias("lo"))
    assert rows(out) == [("a", 4.0, 2, 1, 1.0), ("b", None, 0, 1, None), (None, 11.0, 2, 0, 5.0)]
    assert rows(t.group_by("k").count()) == [(3,)]
    assert rows(t.group_by("k").count(S.where(A.count("v") > 0))) == [(2,)]
    assert rows(t.group_by("k").reduce_total(S.extend(A.key("k").alias("k")).where(A.total("v") > 4))) == [(None,)]


def test_flags(spark):
    t = table(spark, [(0, 1), (0, 1), (1, 1), (1, None), (2, 0), (2, 0)], "k int, f int")
    out = t.group_by("k").reduce_total(A.key("k").alias("k"), A.all_true("f").alias("a"), A.any_true("f").alias("b"), A.none_true("f").alias("c"))
    assert rows(out) == [(0, 1, 1, 0), (1, 0, 1, 0), (2, 0, 0, 1)]


def test_partial_then_total(spark):
    t = table(spark, [(i % 4, float(i)) for i in range(100)], "k int, v double")
    p = t.group_by("k").reduce_partial(A.key("k").alias("k"), A.total("v").alias("s"))
    assert 4 <= p.n_rows() <= 12
    assert rows(p.group_by("k").reduce_total(A.key("k").alias("k"), A.total("s").alias("s"))) == rows(t.group_by("k").reduce_total(A.key("k").alias("k"), A.total("v").alias("s")))
    assert t.partial_reduce(A.count("v").alias("n")).reduce(A.total("n").alias("n")).df.first()[0] == 100


def test_column_that_is_no_aggregate(spark):
    t = table(spark, [(1, 2)], "k int, v int")
    with pytest.raises(AnalysisException):
        t.group_by("k").reduce_total(F.col("v"))


A_ROWS = [(1, "a"), (1, "b"), (2, "c"), (None, "d"), (4, "e")]
B_ROWS = [(1, "x"), (2, "y"), (2, "z"), (3, "w"), (None, "v")]


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_join_kinds(spark, joins, how):
    a, b = table(spark, A_ROWS, "k int, n string"), table(spark, B_ROWS, "k int, m string")
    got = rows(getattr(a.on("k"), how)(b, "k").select(lambda a, b: S.extend(a["k"].alias("ak"), a["n"], b["k"].alias("bk"), b["m"])))
    want = [(k, n, j, m) for k, n in A_ROWS for j, m in B_ROWS if k is not None and k == j]
    if how in ("left", "outer"):
        want += [(k, n, None, None) for k, n in A_ROWS if k is None or all(k != j for j, _ in B_ROWS)]
    if how in ("right", "outer"):
        want += [(None, None, j, m) for j, m in B_ROWS if j is None or all(k != j for k, _ in A_ROWS)]
    assert Counter(got) == Counter(want)


def test_join_where_and_self_join(spark, joins):
    t = table(spark, [("a", 1), ("b", 2), ("a", 3)], "k string, v int")
    pair = t.on("k").inner(t, "k").select(lambda x, y: S.extend(x["k"], x["v"].alias("v"), y["v"].alias("w")))
    assert len(rows(pair)) == 5
    less = t.on("k").inner(t, "k").select(lambda x, y: S.extend(x["v"].alias("v"), y["v"].alias("w")).where(x["v"] < y["v"]))
    assert rows(less) == [(1, 3)]


def test_join_against(spark, joins):
    a, b, c = table(spark, [(1,), (2,)], "k int"), table(spark, [(2,), (3,)], "k int"), table(spark, [(3,), (1,)], "k int")
    first = a.on("k").outer(b, "k").left(c, "k").select(lambda a, b, c: S.extend(a["k"].alias("a"), b["k"].alias("b"), c["k"].alias("c")))
    other = a.on("k").outer(b, "k").left(c, "k", against=1).select(lambda a, b, c: S.extend(a["k"].alias("a"), b["k"].alias("b"), c["k"].alias("c")))
    assert rows(first) == [(1, None, 1), (2, 2, None), (None, 3, None)]
    assert rows(other) == [(1, None, None), (2, 2, None), (None, 3, 3)]


def test_join_errors(spark):
    a, b = table(spark, [(1,)], "k int"), table(spark, [("1",)], "k string")
    with pytest.raises(ValueError):
        a.on("k").inner(b, "k")
    with pytest.raises(KeyError):
        a.on("k").inner(a, "k").select(lambda x, y: S.extend(x["nothing"]))


keys = st.lists(st.one_of(st.none(), st.integers(0, 5)), max_size=12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(keys, keys)
def test_join_cardinality(spark, left, right):
    a, b = table(spark, [(k,) for k in left], "k int"), table(spark, [(k,) for k in right], "k int")
    cl, cr = Counter(left), Counter(right)
    for how, count in (("inner", lambda x: cl[x] * cr[x]), ("left", lambda x: cl[x] * max(1, cr[x])), ("outer", lambda x: max(cl[x], 1) * max(cr[x], 1) if cl[x] or cr[x] else 0)):
        t = getattr(a.on("k"), how)(b, "k").select(lambda x, y: S.extend(V.first_present(x["k"], y["k"]).alias("k")))
        got = Counter(r[0] for r in rows(t))
        for x in set(cl) | set(cr) - {None}:
            if x is not None:
                assert got[x] == count(x), (how, x)


def test_top_k_keeps_ties_and_no_missing(spark):
    t = table(spark, [(0,), (0,), (1,), (None,), (2,), (3,), (4,), (5,), (0,), (9,), (9,)], "v int")
    assert rows(t.top_k("v", 3)) == [(0,), (0,), (0,)]
    assert rows(t.top_k("v", 4)) == [(0,), (0,), (0,), (1,)]
    assert rows(t.top_k("v", 1, ascending=False)) == [(9,), (9,)]
    assert rows(t.top_k("v", 50)) == rows(t.where(t["v"].isNotNull()))
    assert set(rows(t.top_k("v", 3))) <= set(rows(t.top_k("v", 3, approximate=True)))
    assert rows(t.where(t["v"] > 100).top_k("v", 3)) == []


def test_concat_and_rename(spark):
    a, b = table(spark, [(1, "x")], "k int, s string"), table(spark, [(2, "y")], "k int, s string")
    assert rows(a.concat(b, a)) == [(1, "x"), (1, "x"), (2, "y")]
    with pytest.raises(ValueError):
        a.concat(b.rename("k", "other"))
    with pytest.raises(ValueError):
        a.concat(table(spark, [("1", "x")], "k string, s string"))
    with pytest.raises(ValueError):
        a.rename("one")


def test_prefix_and_schema(spark):
    t = table(spark, [(1, "x")], "k int, s string")
    assert t.query(t.all_with_prefix("p_").extend(F.lit(3).alias("c"))).df.columns == ["p_k", "p_s", "c"]
    assert Table.of(t.df, {"k": "int", "s": "string"}).columns == ["k", "s"]
    with pytest.raises(ValueError):
        Table.of(t.df, {"k": "bigint", "s": "string"})


def test_partitioned_tables_are_not_exchanged_again(spark):
    t = table(spark, [(i % 7, float(i)) for i in range(50)], "k int, v double").partition_by("k", partitions=5)
    plan = count_operators(t.group_by("k").reduce_total(A.total("v").alias("s")).df)
    assert plan["Exchange hashpartitioning"] == 1


def test_columns_are_pruned_and_predicates_pushed(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select("id", (F.col("id") * 2).alias("b"), F.lit("x").alias("c")).write.parquet(path)
    t = Table.of(spark.read.parquet(path), clean=True)
    plan = t.query(S.extend("b").where(t["id"] > 50)).render()
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,50)]" in plan
    assert "ReadSchema: struct<id:bigint,b:bigint>" in plan


def test_empty_tables(spark):
    t = table(spark, [], "k int, v double")
    assert rows(t.group_by("k").reduce_total(A.total("v").alias("s"))) == []
    assert rows(t.reduce(A.total("v").alias("s"), A.count("v").alias("n"))) == [(None, 0)]
    assert rows(t.group_by("k").count()) == [(0,)]
    assert rows(t.on("k").outer(t, "k").select(lambda a, b: a.all())) == []


def test_reading_results(spark, caplog):
    t = table(spark, [(i,) for i in range(25)], "v int")
    assert sorted(x for a in t.column_arrays(10) for x in a.to_pylist()) == list(range(25))
    assert sum(1 for _ in t.rows()) == 25
    with caplog.at_level("INFO"):
        assert t.tap("here", 2) is t
    assert "here" in caplog.text
    assert t.let(lambda x: x.count()).df.first()[0] == 25


def test_groups_in_folders(spark, tmp_path):
    t = table(spark, [("a", 1), ("b", 2), ("a", 3), (None, 4)], "k string, v int")
    back = t.groups("k", str(tmp_path / "g"))
    assert rows(back) == rows(t)
    one = back.where(back["k"] == "a")
    assert rows(one) == [("a", 1), ("a", 3)]
    assert "PartitionFilters: [isnotnull(k" in one.render()
    assert rows(concatenate(t, t)) == rows(t.concat(t))
    assert "a" in t.show_sample(4) and t.n_columns() == 2


def test_grouping_keys_need_no_aggregate(spark):
    t = table(spark, [("a", 1.0), ("b", 2.0), ("a", 3.0)], "k string, v double")
    total = t.group_by("k").reduce_total(A.key("k").alias("k"), A.total("v").alias("s"))
    assert rows(total) == [("a", 4.0), ("b", 2.0)]
    assert count_operators(total.df)["SortAggregate"] == 0
    by = t.group_by(F.upper("k")).reduce_total(S.extend(A.key(F.upper("k")).alias("u")).where(A.count("v") > 1))
    assert rows(by) == [("A",)]


def test_partial_and_total_share_one_exchange(spark):
    t = Table.of(spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v")))
    p = t.group_by("k").reduce_partial(A.key("k").alias("k"), A.total("v").alias("s"))
    total = p.group_by("k").reduce_total(A.key("k").alias("k"), A.total("s").alias("s"))
    assert count_operators(total.df)["Exchange hashpartitioning"] == 1
    assert rows(total) == rows(t.group_by("k").reduce_total(A.key("k").alias("k"), A.total("v").alias("s")))


def test_top_k_is_a_filter_of_the_scan(spark, tmp_path):
    spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"), F.lit("x").alias("c")).write.parquet(str(tmp_path / "t"))
    t = Table.of(spark.read.parquet(str(tmp_path / "t")), clean=True)
    best = t.top_k("v", 10, ascending=False)
    assert sorted(r[0] for r in best.df.collect()) == list(range(4990, 5000))
    assert count_operators(best.df)["BroadcastNestedLoopJoin"] == 0
    near = t.top_k("v", 10, approximate=True, accuracy=2000).n_rows()
    assert 10 <= near <= 30
    assert 0 < t.top_k("v", 100, approximate=True, coverage=0.5).n_rows() < 1000


def test_programs_of_no_or_another_table_are_refused(spark):
    a, b = table(spark, [(1,)], "k int"), table(spark, [(2,)], "k int")
    with pytest.raises(ValueError):
        a.query(F.lit(1).alias("one"))
    with pytest.raises(ValueError):
        a.query(b["k"])
    with pytest.raises(ValueError):
        a.query(S.extend("k").where(b["k"] > 1))


def test_small_sides_are_broadcast_by_their_size(spark, monkeypatch):
    monkeypatch.setattr("quern.operators.joining.Join.SMALL", 1000)
    a = Table.of(spark.range(10).withColumnRenamed("id", "k"))
    small, large = Table.of(spark.range(20).withColumnRenamed("id", "k")), Table.of(spark.range(5000).withColumnRenamed("id", "k"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for other, n in ((small, 1), (large, 0)):
            t = a.on("k").inner(other, "k", small=True).select(lambda x, y: S.extend(x["k"]))
            assert count_operators(t.df)["BroadcastHashJoin"] == n and t.n_rows() == 10
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_expressions_are_tapped_and_queries_rendered(spark, caplog):
    t = table(spark, [(1,), (3,)], "v int")
    with caplog.at_level("INFO"):
        assert rows(t.query(V.tap(t["v"] + 1, "sum").alias("w"))) == [(2,), (4,)]
    assert "sum" in caplog.text
    text = t.where(t["v"] > 1).count().render("query")
    assert text.index("Aggregate") < text.index("Filter")


def test_batches(spark):
    t = table(spark, [(i, f"s{i}", None if i == 3 else i / 2) for i in range(30)], "i int, s string, d double")
    got = [tuple(r.values()) for b in t.batches() for r in b.to_pylist()]
    assert sorted(got)[2:4] == [(2, "s2", 1.0), (3, "s3", None)] and len(got) == 30
    assert max(map(len, table(spark, [(i,) for i in range(30)], "i int").column_arrays(4))) <= 4


def test_measured(spark, tmp_path):
    with measured(spark, "write") as m:
        spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count().write.parquet(str(tmp_path / "t"))
    assert m.seconds > 0 and m.jobs >= 1 and m.output_bytes > 0 and m.shuffle_bytes > 0
