"""Batches that run again, progress that is lost, and bases that batches are folded into."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.streaming import increments

ROWS = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.LongType()), T.StructField("version", T.IntegerType())])


def deliver(spark, folder, rows):
    spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(folder)


def now(spark, path):
    return {r.id: (r.v, r.version) for r in increments.latest(increments.stored(spark, path, ROWS), ["id"], "version").collect()}


def test_each_delivery_counts_once(spark, tmp_path):
    into, path, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    assert increments.stored(spark, path, ROWS).count() == 0
    take = lambda: increments.take(increments.arrivals(spark, into, ROWS), path, progress)
    deliver(spark, into, [(1, 10, 1), (2, 20, 1), (None, 5, 1)])
    first = take()
    deliver(spark, into, [(2, 21, 2), (3, 30, 1)])
    assert take() == first
    assert increments.stored(spark, path, ROWS).count() == 5 and now(spark, path) == {1: (10, 1), 2: (21, 2), 3: (30, 1), None: (5, 1)}
    for _ in range(3):  # written, then lost before it was committed
        increments.forget_commit(spark, progress, 1)
        take()
    assert increments.stored(spark, path, ROWS).count() == 5
    increments.fold_back(spark, path, ROWS, lambda rows: increments.latest(rows, ["id"], "version"), 1)
    assert increments.stored(spark, path, ROWS).count() == 4 and now(spark, path)[2] == (21, 2)
    increments.forget_commit(spark, progress, 1)
    take()  # a batch below the base runs again and isn't read
    assert increments.stored(spark, path, ROWS).count() == 4
    deliver(spark, into, [(1, 11, 3)])
    take()
    assert now(spark, path) == {1: (11, 3), 2: (21, 2), 3: (30, 1), None: (5, 1)}
    increments.fold_back(spark, path, ROWS, lambda rows: increments.latest(rows, ["id"], "version"), 2)
    increments.fold_back(spark, path, ROWS, lambda rows: increments.latest(rows, ["id"], "version"), 1)  # already below
    assert increments.stored(spark, path, ROWS).count() == 4 and now(spark, path)[1] == (11, 3)


def test_lost_progress_begins_a_generation_that_readers_see_when_it_is_whole(spark, tmp_path):
    into, path = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(3):
        deliver(spark, into, [(i, i, 1)])
    shape = lambda b: b.groupBy("version").agg(F.count("*").alias("n"))
    kept = T.StructType([T.StructField("version", T.IntegerType()), T.StructField("n", T.LongType())])
    a = increments.take(increments.arrivals(spark, into, ROWS, 1), path, str(tmp_path / "a"), shape)
    total = lambda: [r.n for r in increments.added(increments.stored(spark, path, kept), ["version"], {"n": "sum"}).collect()]
    assert total() == [3]

    def breaks(batch):
        if batch.count() and batch.first().id == 2:
            raise RuntimeError("the third batch fails")
        return shape(batch)

    try:
        increments.take(increments.arrivals(spark, into, ROWS, 1), path, str(tmp_path / "b"), breaks)
        raise AssertionError("the run should fail")
    except Exception as e:  # noqa: BLE001
        assert "third batch" in str(e)
    assert total() == [3]  # the half-done generation isn't seen
    b = increments.take(increments.arrivals(spark, into, ROWS, 1), path, str(tmp_path / "b"), shape)
    assert total() == [3] and a != b
