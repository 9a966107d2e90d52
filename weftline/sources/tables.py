"""Scans and sinks: pruned scans, work-lists, partition-wise replacement, external calls."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: File name endings that a directory scan accepts (fixed values).
SUFFIXES = (".feather", ".fth", ".pqt", ".parquet", ".csv", ".xlsx", ".pickle", ".pkl")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; columns and rows are pruned by what is asked of it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, paths: Iterable[str], file_format: str = "parquet") -> DataFrame:
    """Many files as one table, columns matched by name, unreadable files skipped."""
    reader = spark.read.option("mergeSchema", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    return reader.format(file_format).load(list(paths))


def named_between(spark: SparkSession, path: str, flags: Iterable[str], start: str, end: str, file_format: str = "parquet") -> DataFrame:
    """Rows of a directory's data files whose names hold one of the flags and a date from start to end, both included; adds file_name."""
    df = spark.read.format(file_format).option("recursiveFileLookup", "true").load(path)
    name = F.col("_metadata.file_name")
    day = F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})", 1)
    wanted, known = F.lit(False), F.lit(False)
    for flag in flags:
        wanted = wanted | name.contains(flag)
    for suffix in SUFFIXES:
        known = known | name.endswith(suffix)
    return df.select("*", name.alias("file_name")).where(wanted & known & (day >= start) & (day <= end))


def write_named(df: DataFrame, folder: str, name: str, file_format: str = "parquet", **options: str) -> None:
    """One small file of a given name, as daily extracts are; df is one task's work."""
    spark = df.sparkSession
    part = f"{folder}/.{uuid.uuid4().hex}"
    df.coalesce(1).write.format(file_format).options(**options).save(part)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files_ = path(part).getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in files_.listStatus(path(part)) if s.getPath().getName().startswith("part-")]
    files_.rename(found[0], path(f"{folder}/{name}"))
    files_.delete(path(part), True)


def partition_values(path: Column) -> Column:
    """The k=v parts of a path as a map."""
    pairs = F.regexp_extract_all(path, F.lit(r"([^/=]+=[^/=]+)"), F.lit(1))
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1), F.substring_index(p, "=", -1))))


def jdbc(spark: SparkSession, query: str, options: dict[str, str], types: str | None = None) -> DataFrame:
    """A SQL store's answer; url, user and password come from the caller, ids are kept as text through ``types``."""
    reader = spark.read.format("jdbc").options(**options).option("query", query)
    return (reader.option("customSchema", types) if types else reader).load()


def only_ids(df: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is in ids; replaces IN lists cut into chunks."""
    return df.join(ids.select(*on).distinct(), on, "left_semi")


def work_list(wanted: DataFrame, done: DataFrame, on: list[str], mode: str = "increment") -> DataFrame:
    """What is left to do: all of it, or what is not materialised yet."""
    return wanted if mode == "overwrite" else wanted.join(done.select(*on).distinct(), on, "left_anti")


def write_partitions(df: DataFrame, path: str, by: list[str], codec: str = "zstd") -> None:
    """Replaces the partitions that df has and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", codec).partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV whose header begins with a byte order mark, so that spreadsheets read it as UTF-8."""
    first, *others = df.columns
    df.select(F.col(f"`{first}`").alias("\ufeff" + first), *[F.col(f"`{c}`") for c in others]).write.mode("overwrite").option("header", "true").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with or without a byte order mark."""
    return spark.read.option("header", "true").option("enforceSchema", "true").schema(schema).csv(path)


def is_url(c: Column) -> Column:
    """Has a scheme and a host."""
    return F.coalesce(c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+"), F.lit(False))


def fetch(df: DataFrame, url: str, make_client: Callable[[], Callable[[dict], str]], tries: int = 3) -> DataFrame:
    """call_per_row for addresses; what is no address isn't called and stays with an error."""
    good = call_per_row(df.where(is_url(F.col(url))), make_client, tries=tries)
    bad = df.where(~is_url(F.col(url))).select("*", F.lit(None).cast("string").alias("response"), F.lit("no address").alias("error"))
    return good.unionByName(bad)


def call_per_row(df: DataFrame, make_client: Callable[[], Callable[[dict], str]], result: str = "response", error: str = "error", tries: int = 3) -> DataFrame:
    """Calls an external service once per row, one client per partition; rows that fail stay, with their error."""
    schema = T.StructType([*df.schema.fields, T.StructField(result, T.StringType()), T.StructField(error, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for batch in batches:
            got, bad = [], []
            for row in batch.to_dict("records"):
                answer, problem = None, None
                for _ in range(tries):
                    try:
                        answer, problem = client(row), None
                        break
                    except Exception as e:  # noqa: BLE001  the error is the row's result
                        problem = str(e)
                got.append(answer)
                bad.append(problem)
            yield batch.assign(**{result: got, error: bad})

    return df.mapInPandas(run, schema)


def put_objects(df: DataFrame, key: str, content: str, folder: str) -> int:
    """One object per row under folder, named by its key; gives how many. A task that runs again writes the same objects again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = store_of(folder)
        files.create_dir(top, recursive=True)
        n = 0
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with files.open_output_stream(f"{top}/{name}") as out:
                    out.write(body or b"")
                n += 1
        yield pa.record_batch([pa.array([n])], names=["n"])

    return df.select(F.col(key).cast("string"), F.col(content).cast("binary")).mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that a path or address belongs to, and its place there."""
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def binary_objects(spark: SparkSession, buckets: list[str], keys: DataFrame, key: str) -> DataFrame:
    """(key, bucket, content, text) of a store's objects from the first bucket that has the key; text is null for pictures (.jpg).

    Names are listed first, a task per bucket, which reads no object; what is opened are
    the wanted keys' objects in their first bucket and nothing else.
    """
    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, bucket in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                files, top = store_of(bucket)
                for x in files.get_file_info(fs.FileSelector(top)):
                    if x.type == fs.FileType.File:
                        yield pa.record_batch([pa.array([x.base_name]), pa.array([i], pa.int32()), pa.array([f"{bucket}/{x.base_name}"])], names=[key, "bucket", "path"])

    each = spark.createDataFrame(list(enumerate(buckets)), "bucket int, name string").repartition(max(1, len(buckets)), "bucket")
    found = each.mapInArrow(names, f"{key} string, bucket int, path string").select(key, F.struct("bucket", "path").alias("at"))
    wanted = found.join(keys.select(key).distinct(), key, "left_semi")
    first = wanted.groupBy(key).agg(F.min("at").alias("at")).select(key, "at.bucket", "at.path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, path in enumerate(batch.column(2).to_pylist()):
                files, name = store_of(path)
                with files.open_input_stream(name) as f:
                    yield pa.record_batch([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([f.read()])], names=[key, "bucket", "content"])

    kind = keys.schema[key].dataType.simpleString()
    got = first.repartition(F.col(key)).mapInArrow(run, f"{key} {kind}, bucket int, content binary")
    return got.withColumn("text", F.when(~F.col(key).endswith(".jpg"), F.col("content").cast("string")))


def url_client(timeout: float = 10.0) -> Callable[[dict], str]:
    """A client for fetch: what an address answers, as text; addresses of stores are opened as such."""
    from urllib.request import urlopen

    def ask(row: dict) -> str:
        if row["url"].split(":")[0].lower() not in ("http", "https", "file"):
            files, name = store_of(row["url"])
            with files.open_input_stream(name) as answer:
                return answer.read().decode("utf-8", "replace")
        with urlopen(row["url"], timeout=timeout) as answer:  # noqa: S310  addresses come from the caller's table
            return answer.read().decode("utf-8", "replace")

    return ask


def paged(spark: SparkSession, total: int, size: int, make_client: Callable[[], Callable[[int], list[dict]]], schema: str) -> DataFrame:
    """All rows of a paged listing: a row per page number, dealt out, each task asking for its own pages."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for batch in batches:
            for page in batch["page"]:
                yield pd.DataFrame(client(int(page)))

    pages = spark.range(1, -(-total // size) + 1, numPartitions=min(64, max(1, -(-total // size)))).withColumnRenamed("id", "page")
    return pages.mapInPandas(run, schema)


def pages_of(total: int, size: int) -> list[int]:
    """Page numbers of a paged listing."""
    return list(range(1, -(-total // size) + 1))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where it is unset, a session in one process gets a folder of its own; on a
    cluster that would be a disk of one machine, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="weftline-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new place in the shared folder. What lies there is deleted when the application ends."""
    app = f"{shared_folder(spark)}/weftline-{spark.sparkContext.applicationId}"
    place = spark._jvm.org.apache.hadoop.fs.Path(app)
    files_ = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files_.mkdirs(place)
    files_.deleteOnExit(place)
    return f"{app}/{tag}-{uuid.uuid4().hex}"


def kept(df: DataFrame, tag: str, codec: str | None = None) -> DataFrame:
    """Written to the shared folder and read again: lineage ends there, a lost executor costs nothing, and what uses it twice doesn't work it out twice."""
    spark = df.sparkSession
    path = fresh_path(spark, tag) + ".parquet"
    writer = df.write.option("compression", codec) if codec else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of one side of a join that may be broadcast; each is a few dozen bytes to a few hundred.
BROADCAST_ROWS = 200_000


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if df is counted and small; otherwise leave the join to a shuffle. df should be cheap to read."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Rows that a task is dealt where their number is known.
ROWS_PER_TASK = 500_000


def tasks_for(spark: SparkSession, rows: int) -> int | None:
    """Tasks that so many rows need; None if the session runs as many at once anyway."""
    n = -(-rows // ROWS_PER_TASK)
    return n if n > spark.sparkContext.defaultParallelism else None


def dealt(df: DataFrame, tasks: int | None, *on: str) -> DataFrame:
    """df dealt out by its key to a number of tasks that goes with its rows, so that none gets more of a larger table; None leaves the number to the session."""
    return df.repartition(tasks, *on) if tasks else df.repartition(*on)
