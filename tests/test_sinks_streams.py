import pytest
import csv
import datetime
import glob
import io
import json

from pyspark.sql import functions as F

from sparkwright.operators.reconcile import reconcile
from sparkwright.sources import sinks
from sparkwright.streaming import checks


def text(path):
    return "".join(open(p, newline="").read() for p in sorted(glob.glob(f"{path}/part-*")))


def rows(spark):
    return spark.createDataFrame([(1, 'a "quoted", one', None), (2, "plain", "x")], "id int, name string, note string").coalesce(1)


def test_csv(spark, tmp_path):
    sinks.write_csv(rows(spark), str(tmp_path / "c"))
    raw = text(tmp_path / "c")
    assert raw.count("\r\n") == 3 and list(csv.reader(io.StringIO(raw))) == [["id", "name", "note"], ["1", 'a "quoted", one', ""], ["2", "plain", "x"]]


def test_json(spark, tmp_path):
    sinks.write_json(rows(spark), str(tmp_path / "j"))
    assert [json.loads(x) for x in text(tmp_path / "j").splitlines()][0] == {"id": 1, "name": 'a "quoted", one', "note": None}


def test_xml(spark, tmp_path):
    sinks.write_xml(rows(spark).withColumnRenamed("id", "_id"), str(tmp_path / "x"), "items", "item")
    back = spark.read.format("xml").option("rowTag", "item").load(str(tmp_path / "x"))
    assert {(r["_id"], r["name"]) for r in back.collect()} == {(1, 'a "quoted", one'), (2, "plain")}


def test_reconcile_cases(spark):
    orders = spark.createDataFrame([(1, 119.0), (2, 120.0), (3, 118.98), (4, 5.0), (5, 119.01)], "o_orderkey long, o_totalprice double")
    lines = spark.createDataFrame([(k, 100.0, 0.0, 0.19) for k in (1, 2, 3, 5)] + [(9, 1.0, 0.0, 0.0)], "l_orderkey long, l_extendedprice double, l_discount double, l_tax double")
    got = {r.o_orderkey: r.status for r in reconcile(orders, lines).collect()}
    assert got == {1: "balanced", 2: "over", 3: "under", 4: "no_lines", 5: "balanced"}


def test_stream(spark, tmp_path):
    t = datetime.datetime(2024, 5, 1, 10, 5)
    data = [(1, "DE89370400440532013000", t), (2, "DE89370400440532013001", t), (3, None, t), (4, "GB82WEST12345698765432", t.replace(hour=11)), (5, "x", t.replace(hour=23))]
    spark.createDataFrame(data, "id long, code string, arrived timestamp").write.parquet(str(tmp_path / "in"))
    counts = checks.valid_per_hour(checks.read_codes(spark, str(tmp_path / "in")))
    checks.start(counts, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {(r.hour.hour, r.valid): r.n for r in spark.read.parquet(str(tmp_path / "out")).select(F.col("hour"), "valid", "n").collect()}
    assert got[10, True] == 1 and got[10, False] == 2 and got[11, True] == 1


def test_no_local_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from sparkwright.sources.tables import new_folder

    assert new_folder(spark) != new_folder(spark)
    for master, conf in (("yarn", None), ("local-cluster[2,1,1024]", None), ("yarn", "hdfs://x/shared/")):
        other = SimpleNamespace(sparkContext=SimpleNamespace(master=master), conf=SimpleNamespace(get=lambda k, d, conf=conf: conf))
        if conf:
            assert new_folder(other).startswith("hdfs://x/shared/") and "//" not in new_folder(other)[7:]
        else:
            with pytest.raises(ValueError, match="checkpoint"):
                new_folder(other)


def test_csv_tells_null_from_empty(spark, tmp_path):
    data = [("1", None, "a"), ("2", "", None), ("3", 'x "y", z', ""), ("4", "two\r\nlines", " ")]
    df = spark.createDataFrame(data, "key string, name string, note string").coalesce(1)
    sinks.write_csv(df, str(tmp_path / "c"))
    assert '1,,a\r\n2,"",\r\n' in text(tmp_path / "c")
    two = sinks.read_csv(spark, str(tmp_path / "c"), "key string, name string, note string").collect()
    assert {tuple(r) for r in two} >= set(data[:3])


def test_nested(spark, tmp_path):
    orders = spark.createDataFrame([(1, "a"), (2, None), (None, "n")], "id int, name string")
    lines = spark.createDataFrame([(1, 2, "y"), (1, 1, "x"), (1, 1, "x"), (1, 3, None), (9, 1, "lost"), (None, 1, "lost")], "of int, at int, what string")
    made = sinks.nested(orders, lines, "id", "of", "line").coalesce(1)
    assert {r.id: [tuple(x) for x in r.line] for r in made.collect()} == {1: [(1, "x"), (1, "x"), (2, "y"), (3, None)], 2: [], None: []}
    sinks.write_json(made, str(tmp_path / "j"))
    assert {json.loads(x)["id"]: json.loads(x)["line"] for x in text(tmp_path / "j").splitlines()}[1][3] == {"at": 3, "what": None}
    sinks.write_xml(made.withColumnRenamed("id", "_id"), str(tmp_path / "x"), "orders", "order")
    raw = text(tmp_path / "x")
    assert raw.count("<line>") == 4 and '<order id="1">' in raw


def test_the_last_row_ends_all_hours(spark, tmp_path):
    t = datetime.datetime(2024, 5, 1, 10, 59)
    codes = spark.createDataFrame([(1, "DE89370400440532013000", t), (2, "x", t.replace(hour=23)), (3, None, t.replace(hour=23))], "id long, code string, arrived timestamp")
    codes.write.parquet(str(tmp_path / "in"))
    assert checks.closing(codes.filter("false")).count() == 0
    checks.closing(codes).write.mode("append").parquet(str(tmp_path / "in"))
    counts = checks.valid_per_hour(checks.read_codes(spark, str(tmp_path / "in")))
    checks.start(counts, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert {(r.hour.hour, r.valid, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(10, True, 1), (23, False, 2)}


def test_xml_files_are_bounded(spark, tmp_path):
    """A partition of many rows becomes several files, each of which a task reads whole, and all rows come back."""
    sinks.write_xml(spark.range(120_000).coalesce(1), path := str(tmp_path / "x"))
    assert len(list((tmp_path / "x").glob("part-*"))) == 3
    assert spark.read.format("xml").option("rowTag", "row").schema("id long").load(path).distinct().count() == 120_000
