"""Increments that arrive, run again and are corrected: what is stored equals one batch over everything."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.plans.registry import query
from weftline.sources.tables import fresh_path, table
from weftline.streaming import increments

ORDERS = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_orderstatus", T.StringType()), T.StructField("o_totalprice", T.DoubleType()), T.StructField("year", T.IntegerType()), T.StructField("version", T.IntegerType())])


def _delivered(spark, sf_dir):
    """Three deliveries of orders: by year, the last one with orders whose state was pending and is final now."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.year("o_orderdate").alias("year"), F.lit(1).alias("version"))
    settled = o.where("o_orderstatus = 'P'").withColumns({"o_orderstatus": F.lit("F"), "version": F.lit(2)})
    return [o.where("year <= 1996"), o.where("year in (1997, 1998)"), o.where("year > 1998").unionByName(settled)]


YEARS_SQL = """WITH o AS (SELECT CASE WHEN o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, year(o_orderdate)::INT AS year, (CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END)::INT AS version FROM orders)
SELECT o_orderstatus, year, count(*) AS n, round(sum(o_totalprice), 2) AS total, max(version) AS version FROM o GROUP BY ALL"""


@query("increments_latest", YEARS_SQL)
def increments_latest(spark, sf_dir):
    """Versions of rows: a delivery a run, the second one run twice, the first two folded into a base, a last version of each order."""
    into, path, checkpoint = fresh_path(spark, "arrived"), fresh_path(spark, "orders"), fresh_path(spark, "progress")
    for i, part in enumerate(_delivered(spark, sf_dir)):
        part.write.mode("append").parquet(into)
        increments.take(increments.arrivals(spark, into, ORDERS), path, checkpoint)
        if i == 1:
            increments.forget_commit(spark, checkpoint, 1)
            increments.take(increments.arrivals(spark, into, ORDERS), path, checkpoint)
            increments.fold_back(spark, path, ORDERS, lambda rows: increments.latest(rows, ["o_orderkey"], "version"), 1)
    now = increments.latest(increments.stored(spark, path, ORDERS), ["o_orderkey"], "version")
    return now.groupBy("o_orderstatus", "year").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("version").alias("version"))


SUMS = T.StructType([T.StructField("l_returnflag", T.StringType()), T.StructField("month", T.StringType()), T.StructField("n", T.LongType()), T.StructField("quantity", T.DoubleType()), T.StructField("least", T.DoubleType()), T.StructField("most", T.DoubleType())])


@query("increments_added", "SELECT l_returnflag, strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n, sum(l_quantity) AS quantity, min(l_extendedprice) AS least, max(l_extendedprice) AS most FROM lineitem GROUP BY ALL")
def increments_added(spark, sf_dir):
    """Partial aggregates: line items arrive by return flag, a batch runs again, and the progress is lost and made anew."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", F.date_format("l_shipdate", "yyyy-MM").alias("month"), "l_quantity", "l_extendedprice")
    into, path, checkpoint, again = (fresh_path(spark, t) for t in ("arrived", "sums", "progress", "progress"))
    keys, how = ["l_returnflag", "month"], {"n": "sum", "quantity": "sum", "least": "min", "most": "max"}

    def partial(batch):
        return batch.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.min("l_extendedprice").alias("least"), F.max("l_extendedprice").alias("most"))

    for flags in (["R"], ["A"], ["N"]):
        lines.where(F.col("l_returnflag").isin(flags)).write.mode("append").parquet(into)
        increments.take(increments.arrivals(spark, into, lines.schema), path, checkpoint, partial)
    increments.forget_commit(spark, checkpoint, 2)
    increments.take(increments.arrivals(spark, into, lines.schema), path, checkpoint, partial)
    increments.fold_back(spark, path, SUMS, lambda rows: increments.added(rows, keys, how), 1)
    increments.take(increments.arrivals(spark, into, lines.schema, 2), path, again, partial)
    return increments.added(increments.stored(spark, path, SUMS), keys, how)
