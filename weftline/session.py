"""A Spark session with the settings that the queries assume."""

from __future__ import annotations

import os
import shutil
import site
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(name: str = "weftline", master: str | None = None, partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.parquet.compression.codec", "zstd")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master or "SPARK_MASTER" in os.environ:
        builder = builder.master(master or os.environ["SPARK_MASTER"])
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def ship(spark: SparkSession) -> str:
    """Send this package to the Python workers, once for an application; gives the archive's place.

    The archive lies in the folder that driver and executors share, for executors fetch
    it whenever they start, as long as the application lives.
    """
    from weftline.sources.tables import fresh_path

    context = spark.sparkContext
    if found := getattr(context, "_weftline_archive", None):
        return found
    root = Path(__file__).resolve().parent
    path = spark._jvm.org.apache.hadoop.fs.Path
    place = path(f"{fresh_path(spark, 'package')}/{root.name}.zip")
    with tempfile.TemporaryDirectory() as folder:
        archive = shutil.make_archive(f"{folder}/{root.name}", "zip", root.parent, root.name)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        files.copyFromLocalFile(path(f"file://{archive}"), place)
    context._weftline_archive = str(files.makeQualified(place).toString())
    context.addPyFile(context._weftline_archive)
    return context._weftline_archive


def workers_find_package() -> bool:
    """Whether Python workers that start as this process did import this package without its being sent."""
    root = Path(__file__).resolve().parent.parent
    places = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep), *site.getsitepackages()]
    return any(p and Path(p).resolve() == root for p in places)
