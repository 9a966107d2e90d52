"""Out-of-fold dictionaries of list items and senders at several ages, from one pass over the lists."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import times
from weftline.operators import text
from weftline.plans.registry import query
from weftline.sources.tables import dealt, table, tasks_for

#: Ages in days that lists are cut at, and folds (fixed values).
SPANS, FOLDS = [3, 7, 15, 30, 90, 180], 20


def _lists(spark, sf_dir, item):
    """Entries of each customer's list, aged by the day of the last order, the customers with their target, and the tasks that so many lines need."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate")
    tasks = tasks_for(spark, lines.count())
    by = lambda df, key: dealt(df, tasks, key) if tasks else df
    meeting = lambda df, key: by(df, key).hint("merge") if tasks else df  # noqa: E731  small tables may be broadcast
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("id"), "o_orderdate").where("id IS NOT NULL")
    o = by(orders, "id").select("o_orderkey", "id", F.max("o_orderdate").over(W.partitionBy("id")).alias("applied"))
    x = by(lines, "l_partkey").join(meeting(parts, "p_partkey"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_shipdate", item.alias("item"))
    x = by(x, "l_orderkey").join(meeting(o, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    entries = x.select("id", "item", ((times.micros(F.col("applied")) - times.micros(F.col("l_shipdate"))) / F.lit(86400e6)).alias("age"))
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") < 500).cast("int").alias("target"))
    return entries, ids, tasks


def _lists_sql(item: str, first_only: bool = False) -> str:
    entries = "SELECT id, item, max(age) AS age FROM e0 GROUP BY ALL" if first_only else "SELECT * FROM e0"
    return f"""a0 AS (SELECT o_custkey AS id, max(o_orderdate) AS applied FROM orders GROUP BY 1),
e0 AS (SELECT id, {item} AS item, (epoch_us(applied) - epoch_us(l_shipdate)) / 86400e6 AS age FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN a0 ON id = o_custkey JOIN part ON p_partkey = l_partkey),
e AS ({entries}), ids AS (SELECT c_custkey AS id, (c_acctbal < 500)::INT AS target, c_custkey % {FOLDS} AS fold FROM customer),
c AS (SELECT span, id, item, count(*) AS n FROM e, (SELECT unnest({SPANS}) AS span) WHERE age <= span GROUP BY ALL),
l AS (SELECT span, id, sum(n) AS len FROM c GROUP BY ALL),
f AS (SELECT DISTINCT fold FROM ids UNION ALL SELECT -1),
a AS (SELECT f.fold, count(*) FILTER (target = 0) AS all_0, count(*) FILTER (target = 1) AS all_1 FROM f JOIN ids ON f.fold <> ids.fold GROUP BY 1),
p AS (SELECT f.fold, span, item, count(*) AS orders, count(*) FILTER (target = 0) AS orders_0, count(*) FILTER (target = 1) AS orders_1, coalesce(sum(n / len) FILTER (target = 0), 0) AS weight_0, coalesce(sum(n / len) FILTER (target = 1), 0) AS weight_1
  FROM c JOIN l USING (span, id) JOIN ids USING (id) JOIN f ON f.fold <> ids.fold GROUP BY ALL)"""


BRAND = "p_brand || '/' || p_type"


@query("item_dictionary_spans", f"WITH {_lists_sql(BRAND)} SELECT span::INT AS span, fold::INT AS fold, item, orders_0, orders_1, round(weight_0, 6) AS weight_0, round(weight_1, 6) AS weight_1, all_0, all_1 FROM p JOIN a USING (fold)")
def item_dictionary_spans(spark, sf_dir):
    """Lists of brands and types bought, cut at six ages: lists, weights and totals of the other 19 folds and of all."""
    entries, ids, tasks = _lists(spark, sf_dir, F.concat("p_brand", F.lit("/"), "p_type"))
    stats = text.items_of_spans(entries, ids, SPANS, FOLDS, tasks=tasks)
    return stats.select("span", "fold", "item", "orders_0", "orders_1", F.round("weight_0", 6).alias("weight_0"), F.round("weight_1", 6).alias("weight_1"), "all_0", "all_1")


_LEVELS = """q AS (SELECT *, (orders_1 / orders) / (all_1 / (all_0 + all_1)) AS lift FROM p JOIN a USING (fold) WHERE orders > 0.002 * (all_0 + all_1)),
r AS (SELECT *, row_number() OVER (PARTITION BY span, fold ORDER BY lift, item) AS low, row_number() OVER (PARTITION BY span, fold ORDER BY lift DESC, item DESC) AS high, row_number() OVER (PARTITION BY span, fold ORDER BY orders DESC, item) AS many FROM q WHERE lift < 0.9 OR lift > 1.1),
k AS (SELECT *, (lift > 1.1)::INT AS side, min((lift > 1.1)::INT) OVER (PARTITION BY span, fold) = 0 AS below FROM r WHERE low <= 1000 OR high <= 1000 OR many <= 1000),
g AS (SELECT span, fold, side, list_distinct(quantile_cont(lift, [0.0, 0.5, 1.0])) AS edges FROM k GROUP BY ALL)
SELECT span::INT AS span, fold::INT AS fold, item, orders, lift, (greatest(1, len(list_filter(edges, lambda x: x < lift))) - 1 + CASE WHEN below THEN side * 2 ELSE 0 END)::INT AS level FROM k JOIN g USING (span, fold, side)"""


@query("item_levels_spans", f"WITH {_lists_sql(BRAND)}, {_LEVELS}")
def item_levels_spans(spark, sf_dir):
    """Items of those lists that are often enough and of a lift that says something, with a level."""
    entries, ids, tasks = _lists(spark, sf_dir, F.concat("p_brand", F.lit("/"), "p_type"))
    return text.select_items(text.items_of_spans(entries, ids, SPANS, FOLDS, tasks=tasks), ["span", "fold"])


@query("sender_levels_spans", f"WITH {_lists_sql('l_suppkey', True)}, {_LEVELS}")
def sender_levels_spans(spark, sf_dir):
    """The same for distinct senders, each at the age of its first message: suppliers stand for them."""
    entries, ids, tasks = _lists(spark, sf_dir, F.col("l_suppkey"))
    stats = text.items_of_spans(entries, ids, SPANS, FOLDS, first_only=True, tasks=tasks)
    return text.select_items(stats, ["span", "fold"])
