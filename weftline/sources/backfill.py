"""Backfills in slices that a broken run goes on with: a ledger says what is done, what failed and why.

Slices that are left are built in waves, one job each. If a wave fails, its halves are
tried, until the slices that fail stand alone; they are put down with their error and
tried again in later runs, up to a number of attempts. The ledger is a table that is
only added to, written after the slice's own partition: a slice that was written but
not put down is written again, over itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.sources.tables import write_partitions

LEDGER = T.StructType([T.StructField("slice", T.StringType()), T.StructField("state", T.StringType()), T.StructField("attempt", T.IntegerType()), T.StructField("run", T.IntegerType()), T.StructField("error", T.StringType())])

#: Slices of a wave, and characters of an error that are put down.
WAVE, ERROR = 64, 300


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Everything that was put down."""
    return spark.read.schema(LEDGER).parquet(path) if _exists(spark, path) else spark.createDataFrame([], LEDGER)


def states(spark: SparkSession, path: str) -> DataFrame:
    """(slice, state, attempt, run, error): the last word on each slice; a slice that was done stays done."""
    rank = F.struct((F.col("state") == "done").alias("d"), "attempt", "run", "state", "error")
    return ledger(spark, path).groupBy("slice").agg(F.max(rank).alias("m")).select("slice", "m.state", "m.attempt", "m.run", "m.error")


def run_slices(spark: SparkSession, slices: list[str], build: Callable[[list[str]], DataFrame], path: str, put_down: str, by: str = "slice", tries: int = 3, mode: str = "increment", wave: int = WAVE) -> int:
    """One run over the slices that aren't done and haven't failed ``tries`` times; gives how many are still not done.

    build gives the rows of some slices, with column ``by``; mode overwrite builds all slices anew.
    """
    known = {r.slice: r for r in states(spark, put_down).where(F.col("slice").isin(slices)).collect()} if slices else {}  # a row per slice that was asked for
    number = (ledger(spark, put_down).agg(F.max("run")).first()[0] or 0) + 1
    open_ = [s for s in slices if mode == "overwrite" or s not in known or (known[s].state != "done" and known[s].attempt < tries)]
    attempt = {s: (known[s].attempt if s in known else 0) + 1 for s in open_}

    def put(rows: list[tuple]) -> None:
        spark.createDataFrame(rows, LEDGER).coalesce(1).write.mode("append").parquet(put_down)

    left = 0
    waves = [open_[i : i + wave] for i in range(0, len(open_), wave)]
    while waves:
        now = waves.pop(0)
        try:
            write_partitions(build(now), path, [by])
        except Exception as e:  # noqa: BLE001  a slice's error is its result
            if len(now) > 1:
                waves[:0] = [now[: len(now) // 2], now[len(now) // 2 :]]
            else:
                left += 1
                put([(now[0], "failed", attempt[now[0]], number, str(e).split("\n")[0][:ERROR])])
        else:
            put([(s, "done", attempt[s], number, None) for s in now])
    return left
