"""Stores of objects, addresses and JSON: wanted ones only, missing ones, and what is too much."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import reporting, shapes
from weftline.sources import tables


def test_objects_of_the_first_bucket_that_has_them(spark, tmp_path):
    one, two = str(tmp_path / "one"), f"file://{tmp_path}/two"
    rows = spark.createDataFrame([("a.txt", b"first"), ("p.jpg", b"\xff\xd8"), ("n.txt", None)], "k string, body binary").repartition(3)
    assert tables.put_objects(rows, "k", "body", one) == 3 and tables.put_objects(rows.where("k = 'a.txt'").unionByName(spark.createDataFrame([("b.txt", "zwei ü".encode())], "k string, body binary")), "k", "body", two) == 2
    (tmp_path / "one/unwanted").mkdir()
    keys = spark.createDataFrame([("a.txt",), ("a.txt",), ("b.txt",), ("p.jpg",), ("n.txt",), ("gone",), (None,)], "k string")
    got = {r.k: (r.bucket, bytes(r.content), r.text) for r in tables.binary_objects(spark, [one, two], keys, "k").collect()}
    assert got == {"a.txt": (0, b"first", "first"), "b.txt": (1, "zwei ü".encode(), "zwei ü"), "p.jpg": (0, b"\xff\xd8", None), "n.txt": (0, b"", "")}
    assert tables.binary_objects(spark, [one], keys.limit(0), "k").count() == 0 and tables.put_objects(rows.limit(0), "k", "body", str(tmp_path / "none")) == 0


def test_addresses_answer_fail_or_are_none(spark, tmp_path):
    (tmp_path / "x.html").write_text("ja")
    urls = spark.createDataFrame([(1, f"file://localhost{tmp_path}/x.html"), (2, f"file://localhost{tmp_path}/y.html"), (3, "nowhere"), (4, None)], "i int, url string")
    got = {r.i: (r.response, r.error) for r in tables.fetch(urls, "url", tables.url_client).collect()}
    assert got[1] == ("ja", None) and got[2][0] is None and "y.html" in got[2][1] and got[3] == got[4] == (None, "no address")


def test_json_of_too_many_keys_is_an_error(spark, monkeypatch):
    df = spark.createDataFrame([(1, '{"a": 1, "b": 2}'), (2, None), (3, "no json")], "i int, doc string")
    assert [tuple(r) for r in shapes.flatten_json(df, "doc", ["i"]).orderBy("i").collect()] == [(1, 1.0, 2.0), (2, None, None), (3, None, None)]
    monkeypatch.setattr(shapes, "MOST_KEYS", 1)
    with pytest.raises(ValueError, match="more than 1 keys"):
        shapes.flatten_json(df, "doc", ["i"])


def test_a_report_without_validation_rows(spark):
    rows = [("train", float(i), 3, i % 2) for i in range(20)] + [("train", None, 4, 1)]
    values = spark.createDataFrame(rows, "grp string, value double, good long, bad long")
    got = {(r.section, r.name): r.value for r in reporting.numbers(values).collect()}
    assert got[("summary train", "total")] == got[("summary total", "total")] == 75 and ("summary valid", "total") not in got and got[("score", "psi")] is None
    assert set(reporting.cut_points(values)) == {"train", "equal"}
    bins = reporting.bins(values)
    assert bins.where("scheme = 'equal'").agg(F.sum("total")).first()[0] == 70
