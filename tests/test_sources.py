"""Files and rows, in and out, and streams."""

from __future__ import annotations

import gzip
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quern.functions import aggregates as A
from quern.operators.select import S
from quern.operators.table import Table
from quern.sources import csv, rows
from quern.streaming import tables as streams


def test_csv_round_trip_of_all_types(spark, tmp_path):
    data = [(1, 2**40, 1.5, 'a,"b', datetime(2020, 1, 2, 3, 4, 5, 6000)), (None, None, None, None, None), (-3, 0, float("nan"), "x", datetime(1999, 1, 1))]
    t = Table.of(spark.createDataFrame(data, "i int, l long, d double, s string, t timestamp").coalesce(1))
    csv.export_csv(t, str(tmp_path / "out"))
    fields = {"i": csv.int_field(0), "l": csv.long_field(1), "d": csv.double_field(2), "s": csv.str_field(3, "NA"), "t": csv.instant_field(4)}
    back = csv.import_csv(spark, str(tmp_path / "out"), fields, record_separator="\r\n")
    assert sorted(map(str, back.df.collect())) == sorted(map(str, t.df.collect()))


def test_csv_fields_by_place_header_and_missing(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv.gz"
    a.write_text('x;y;z\n1;"p;q";2.5\nNA;;\n')
    b.write_bytes(gzip.compress(b"x;y;z\n7;r;\n"))
    t = csv.import_csv(spark, [str(a), str(b)], [csv.double_field(2), csv.int_field(0), csv.str_field(1)], separator=";", header=True)
    assert t.columns == ["x", "y", "z"]
    assert sorted(map(tuple, t.df.collect()), key=str) == sorted([(1, "p;q", 2.5), (None, "", None), (7, "r", None)], key=str)
    plain = csv.import_csv(spark, str(a), [csv.str_field(0)], separator=";")
    assert plain.columns == ["V0"]
    assert csv.import_csv(spark, str(a), [csv.int_field(0)], separator=";", header=True, max_lines=2).n_rows() == 1


def test_csv_line_of_wrong_length(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,2\n3\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        csv.import_csv(spark, str(tmp_path / "a.csv"), [csv.int_field(0), csv.int_field(1)]).df.collect()


ODD = [" pad ", "a\nb", "c\r\nd", "e\rf", 'say "x", y', "", "NA", "\t", " ", '"', ",", "plain"]


def test_csv_strings_come_back_as_they_went(spark, tmp_path):
    t = Table.of(spark.createDataFrame([(i, s) for i, s in enumerate(ODD)], "i int, s string").repartition(3))
    csv.export_csv(t, str(tmp_path / "out"))
    back = csv.import_csv(spark, str(tmp_path / "out"), {"i": csv.int_field(0), "s": csv.str_field(1)}, record_separator="\r\n", line_breaks=True)
    assert [r.s for r in back.df.orderBy("i").collect()] == ODD
    alone = Table.of(spark.createDataFrame([("",), ("x",)], "s string").coalesce(1))
    csv.export_csv(alone, str(tmp_path / "alone"))
    assert csv.import_csv(spark, str(tmp_path / "alone"), {"s": csv.str_field(0)}, record_separator="\r\n").n_rows() == 2


def test_csv_bytes_of_another_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("1,caf\u00e9\n".encode("iso-8859-1"))
    fields = {"i": csv.int_field(0), "s": csv.str_field(1)}
    read = lambda **o: csv.import_csv(spark, str(tmp_path / "a.csv"), fields, **o).df.first().s
    assert read(encoding="iso88591", strict=True) == "caf\u00e9"
    for encoding in ("utf8", "ascii"):
        assert read(encoding=encoding) == "caf\ufffd"
        with pytest.raises(Exception, match="bytes that are not"):
            read(encoding=encoding, strict=True)


def test_csv_max_lines_are_the_first_of_each_file(spark, tmp_path):
    for name, start in (("a", 0), ("b", 1000)):
        (tmp_path / f"{name}.csv").write_text("v\n" + "".join(f"{start + i}\n" for i in range(900)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")  # many parts a file
    try:
        t = csv.import_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], {"v": csv.int_field(0)}, header=True, max_lines=201)
        assert sorted(r.v for r in t.df.collect()) == [*range(200), *range(1000, 1200)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_csv_pattern_of_instants(spark, tmp_path):
    (tmp_path / "a.csv").write_text("2020/05/06 07:08\nNA\n")
    t = csv.import_csv(spark, str(tmp_path / "a.csv"), {"t": csv.instant_field(0, "yyyy/MM/dd HH:mm")})
    assert [r[0] for r in t.df.select(F.date_format("t", "yyyy-MM-dd HH:mm")).collect()] == ["2020-05-06 07:08", None]


def test_rows(spark):
    t = rows.import_rows(spark, ((i, f"k{i % 5}", float("nan") if i == 3 else i / 2) for i in range(500)), "i int, k string, v double", batch=70)
    assert t.n_rows() == 500
    assert t.where(t["v"].isNull()).n_rows() == 1
    assert sorted(rows.export_rows(t), key=lambda r: r[0])[2] == (2, "k2", 1.0)
    assert rows.import_rows(spark, [], "i int").n_rows() == 0
    every = [(1, 2**40, 1.5, "é", datetime(2020, 1, 2, 3, 4, 5, 6000)), (None,) * 5]
    back = list(rows.export_rows(rows.import_rows(spark, every, "i int, l long, d double, s string, t timestamp")))
    assert sorted(back, key=str) == sorted(every, key=str)


def test_streams(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([(i, datetime(2024, 1, 1, 0, i % 20)) for i in range(40)], "v int, t timestamp").write.parquet(src)
    stream = spark.readStream.schema("v int, t timestamp").parquet(src)
    q = streams.land(streams.query_stream(stream, S.extend("v").where(F.col("v") >= 30)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(30, 40))
    q = streams.reduce_windows(stream, "t", "1 minute", "10 minutes", [], [A.count("v").alias("n")]).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert [r[0] for r in spark.sql("select n from counts").collect()] == [20, 20]
