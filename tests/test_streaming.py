"""Event streams run to their end over files: counts per window, each event once, and writes that a second run doesn't repeat."""

import os

from pyspark.sql import functions as F

from weftline.streaming import events

SF = "/root/testdata/sf0.001"


def source(spark, folder):
    e = spark.read.parquet(f"{SF}/events.parquet")
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    e.where(F.col("ts") < cut).coalesce(1).write.mode("append").parquet(folder)
    e.where(F.col("ts") >= cut).coalesce(1).write.mode("append").parquet(folder)
    return e


def drained(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_each_event_once(spark, tmp_path):
    folder = f"{tmp_path}/in"
    e = source(spark, folder)
    e.limit(50).coalesce(1).write.mode("append").parquet(folder)  # delivered again
    got = drained(events.first_seen(events.read(spark, folder), "60 days"), "once")
    assert got.count() == e.count() == got.select("event_id").distinct().count()


def test_windows_that_are_over_are_counted(spark, tmp_path):
    folder = f"{tmp_path}/in"
    e = source(spark, folder)
    got = {(str(r.window.start)[:10], r.event_type): (r.n, round(r.total, 6)) for r in drained(events.per_window(events.read(spark, folder, 1), "1 day", "20 days"), "windows").collect()}
    want = {(str(r.day), r.event_type): (r.n, round(r.total, 6)) for r in e.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_a_second_run_repeats_nothing(spark, tmp_path):
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    e = source(spark, folder)
    for checkpoint in ("a", "a", "b"):  # run, run again, and run with the progress lost
        events.replace_days(events.read(spark, folder, 1000), out, f"{tmp_path}/{checkpoint}").awaitTermination()
        got = spark.read.parquet(out)
        assert got.count() == e.count() and got.select("event_id").distinct().count() == e.count()
    assert len([d for d in os.listdir(out) if d.startswith("day=")]) == e.select(F.to_date("ts")).distinct().count()
