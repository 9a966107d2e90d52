"""The modelling sample that most queries start from, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import binning, clean
from weftline.sources.tables import kept, table

FEATURES = ("l_extendedprice", "l_quantity", "l_discount", "c_acctbal")
SPLIT = "1998-01-01"


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their customer's balance; target 1 (bad) is a returned item, train is shipped before SPLIT."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    owned = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))  # first, so that line items are shuffled once
    x = lines.join(owned, F.col("l_orderkey") == F.col("o_orderkey"))
    return x.withColumns({"target": (F.col("l_returnflag") == "R").cast("int"), "train": (F.col("l_shipdate") < F.lit(SPLIT).cast("timestamp_ntz")).cast("int")})


def long_sample(spark: SparkSession, sf_dir: str, negative_missing: bool = True, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """(feature, value, target, train); a missing value is null."""
    x = clean.long_form(sample(spark, sf_dir), list(features), ["target", "train"])
    return x.withColumn("value", clean.present(F.col("value"), negative_missing))


def value_counts(spark: SparkSession, sf_dir: str, negative_missing: bool = True, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """(feature, value, target, train, n): how many rows have each value. Written once; edges, bins and measures all follow from it."""
    return kept(long_sample(spark, sf_dir, negative_missing, features).groupBy("feature", "value", "target", "train").agg(F.count("*").alias("n")), "value-counts")


def binned(long: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds bin by quantile edges; 0 is the bin of missing values. Edges are a row per feature."""
    return long.join(F.broadcast(edges), "feature").withColumn("bin", F.coalesce(binning.bin_of_quantile(F.col("value"), F.col("edges")), F.lit(0)))


SAMPLE_SQL = """sample AS (SELECT l_orderkey, l_linenumber, l_linestatus, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, c_acctbal,
  (l_returnflag = 'R')::INT AS target, (l_shipdate < TIMESTAMP '1998-01-01')::INT AS train
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


def long_sql(negative_missing: bool = True) -> str:
    value = "CASE WHEN {f} >= 0 THEN {f} END" if negative_missing else "{f}"
    parts = " UNION ALL ".join(f"SELECT '{f}' AS feature, {value.format(f=f)} AS value, target, train FROM sample" for f in FEATURES)
    return f"{SAMPLE_SQL}, long AS ({parts})"


def binned_sql(n: int = 10, where: str = "TRUE", negative_missing: bool = True) -> str:
    """CTEs up to ``binned`` (feature, value, target, train, bin): quantile edges of the rows in ``where``."""
    at = ", ".join(repr(i / n) for i in range(n + 1))
    return f"""{long_sql(negative_missing)}, edges AS (SELECT feature, list_distinct(quantile_cont(value, [{at}])) AS edges FROM long WHERE value IS NOT NULL AND {where} GROUP BY feature),
binned AS (SELECT long.*, CASE WHEN value IS NULL THEN 0 ELSE greatest(1, len(list_filter(edges, lambda e: e < value))) END AS bin FROM long JOIN edges USING (feature))"""
