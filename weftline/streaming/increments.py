"""Increments of a table, each taken exactly once, however often a batch is run.

A run takes what has arrived since the last one and ends (availableNow). A batch
writes its rows under its own number and the stream's own id (generation), so a batch
that ran but wasn't committed replaces what it wrote before. A generation is seen
once its run is over: a pointer file names it. If a checkpoint is lost, a new one
begins a new generation, and readers stay with the old one until it has caught up.
Old batches are folded into a base that the pointer then names too; batches that are
repeated later are below the base and not read.

What is stored is either versions of rows, of which the last one of a key counts, or
partial aggregates that add up.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIVE = "_live.json"

#: How partial aggregates of a column are put together.
MERGE: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "min": F.min, "max": F.max}


def arrivals(spark: SparkSession, folder: str, schema: T.StructType | str, files_per_trigger: int = 1000) -> DataFrame:
    """Files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def _file(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _live(spark: SparkSession, path: str) -> dict:
    files, place = _file(spark, f"{path}/{LIVE}")
    if not files.exists(place):
        return {}
    stream = files.open(place)  # Spark's readers pass over names that begin with _
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _point(spark: SparkSession, path: str, live: dict) -> None:
    """Replace the pointer by renaming, so that a reader sees the old or the new one."""
    files, place = _file(spark, f"{path}/{LIVE}")
    _, new = _file(spark, f"{path}/{LIVE}.new")
    out = files.create(new, True)
    out.write(bytearray(json.dumps(live).encode()))
    out.close()
    if files.exists(place):
        files.delete(place, False)
    files.rename(new, place)


def take(arriving: DataFrame, path: str, checkpoint: str, shape: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> str:
    """Run until all that has arrived is taken; gives the generation. ``shape`` turns a batch into the rows to store."""

    def put(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        rows = shape(batch).withColumns({"generation": F.lit(own), "batch": F.lit(number).cast("long")})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("generation", "batch").parquet(path)

    running = arriving.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.awaitTermination()
    spark, live = arriving.sparkSession, _live(arriving.sparkSession, path)
    if live.get("generation") != running.id:
        _point(spark, path, {"generation": running.id, "base": None, "after": -1})
    return running.id


def stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of the base and of the batches after it; other generations aren't read."""
    live = _live(spark, path)
    layout = T.StructType([*schema.fields, T.StructField("generation", T.StringType()), T.StructField("batch", T.LongType())])
    if not live:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(layout).parquet(path)
    own = (F.col("generation") == live["generation"]) & (F.col("batch") > live["after"])
    if live["base"]:
        own = own | (F.col("generation") == live["base"])
    return rows.where(own).drop("generation", "batch")


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The last version of each key. Only one row of a key leaves a map task."""
    others = [c for c in rows.columns if c not in keys and c != version]
    last = rows.groupBy(*keys).agg(F.max(F.struct(version, *others)).alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rows.columns if c not in keys])


def added(rows: DataFrame, keys: list[str], how: dict[str, str]) -> DataFrame:
    """Partial aggregates put together: how names sum, min or max for each column."""
    return rows.groupBy(*keys).agg(*[MERGE[kind](c).alias(c) for c, kind in how.items()])


def fold_back(spark: SparkSession, path: str, schema: T.StructType, merged: Callable[[DataFrame], DataFrame], upto: int) -> None:
    """Fold the base and the batches up to a number into a new base."""
    live = _live(spark, path)
    if not live or upto <= live["after"]:
        return
    layout = T.StructType([*schema.fields, T.StructField("generation", T.StringType()), T.StructField("batch", T.LongType())])
    rows = spark.read.schema(layout).parquet(path)
    own = (F.col("generation") == live["generation"]) & (F.col("batch") > live["after"]) & (F.col("batch") <= upto)
    if live["base"]:
        own = own | (F.col("generation") == live["base"])
    base = f"{live['generation']}-to-{upto}"
    folded = merged(rows.where(own).drop("generation", "batch")).select(*[f.name for f in schema.fields])
    folded.withColumns({"generation": F.lit(base), "batch": F.lit(upto).cast("long")}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("generation", "batch").parquet(path)
    _point(spark, path, live | {"base": base, "after": upto})


def forget_commit(spark: SparkSession, checkpoint: str, number: int) -> None:
    """Put a checkpoint into the state after a crash between a batch's write and its commit: the batch runs again."""
    files, place = _file(spark, f"{checkpoint}/commits/{number}")
    if not files.delete(place, False):
        raise FileNotFoundError(f"batch {number} isn't committed in {checkpoint}")
