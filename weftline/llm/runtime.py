"""Small helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.tables import kept, shared_folder

__all__ = ["checked_broadcast", "documents", "held_out", "kept", "n_words", "shared_folder", "small_batches", "words"]

#: What counts as white space between words, in regular expressions.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: Rows of one side that may be broadcast; each is a few dozen bytes.
BROADCAST_ROWS = 200_000

#: Rows and bytes of an Arrow batch: long texts then stay within a worker's memory.
ARROW_ROWS, ARROW_BYTES = 512, 32 << 20


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if df is counted and small; otherwise leave the join to a shuffle. df should be cheap to read."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Places of a table of bits that tells which keys may be asked for, 8 MB in all.
BITS = 1 << 26


def may_be_in(df: DataFrame, key: Column, keys: DataFrame, wanted: Column, name: str = "maybe") -> DataFrame:
    """Adds whether a row's key may be among keys' wanted ones: never false for one that is, and seldom true for another.

    What is broadcast is a table of bits of a fixed size, however many keys there are,
    so that a shuffle after it carries little more than the rows that are asked for.
    """
    place = lambda c: F.pmod(F.xxhash64(F.lit(41), c), F.lit(BITS)) + 1
    at = keys.select(place(wanted).alias("p"))
    bits = at.groupBy(F.bitmap_bucket_number("p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_bits"))
    told = df.withColumn("_place", place(key)).join(F.broadcast(bits), F.bitmap_bucket_number("_place") == F.col("_bucket"), "left")  # BITS / 32,768 rows
    bit = F.bitmap_bit_position("_place")
    byte = F.conv(F.hex(F.substring("_bits", F.expr("cast(bitmap_bit_position(_place) div 8 + 1 AS int)"), F.lit(1))), 16, 10).cast("int")
    return told.withColumn(name, F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))).drop("_place", "_bucket", "_bits")


@contextmanager
def sizes_unpacked(spark: SparkSession) -> Iterator[None]:
    """Within it, a written table counts for broadcasts as what it takes in memory: running ids are packed to a fraction of that in files."""
    name = "spark.sql.sources.fileCompressionFactor"
    before = spark.conf.get(name)
    spark.conf.set(name, "16")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes that reach a Python worker at once, for all later queries of the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def words(text: Column) -> Column:
    """The words of a text as an array; none for a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
