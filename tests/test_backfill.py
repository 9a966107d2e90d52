"""Slices that break, are tried again, and are left alone when they are done."""

from pyspark.sql import functions as F

from weftline.sources import backfill


def test_a_broken_run_is_gone_on_with(spark, tmp_path):
    path, book = str(tmp_path / "out"), str(tmp_path / "ledger")
    slices = [f"s{i}" for i in range(9)]
    asked = []

    def building(broken):
        def build(some):
            asked.append(list(some))
            if set(some) & set(broken):
                raise RuntimeError("away\nand more")
            return spark.createDataFrame([(s, i) for s in some for i in range(3)], "slice string, v int")

        return build

    assert backfill.run_slices(spark, slices, building({"s2", "s7"}), path, book, wave=4) == 2
    assert max(map(len, asked)) == 4 and spark.read.parquet(path).count() == 21
    now = {r.slice: r for r in backfill.states(spark, book).collect()}
    assert {s for s in now if now[s].state == "failed"} == {"s2", "s7"} and now["s2"].error == "away" and now["s0"].error is None
    asked.clear()
    assert backfill.run_slices(spark, slices, building({"s7"}), path, book, tries=2) == 1
    assert asked == [["s2", "s7"], ["s2"], ["s7"]]  # what is done isn't built again
    asked.clear()
    assert backfill.run_slices(spark, slices, building({"s7"}), path, book, tries=2) == 0 and asked == []  # two attempts were enough, and a run without work is none
    assert backfill.run_slices(spark, slices, building(()), path, book, tries=3) == 0
    now = {r.slice: (r.state, r.attempt, r.run) for r in backfill.states(spark, book).collect()}
    assert now["s7"] == ("done", 3, 3) and now["s2"] == ("done", 2, 2) and now["s0"] == ("done", 1, 1)
    # a slice that was written but not put down is written over itself
    backfill.run_slices(spark, slices[:2], building(()), path, book, mode="overwrite")
    got = spark.read.parquet(path).groupBy("slice").agg(F.count("*").alias("n"))
    assert got.where("n <> 3").count() == 0 and got.count() == 9
    assert backfill.run_slices(spark, [], building(()), path, str(tmp_path / "none")) == 0
