"""Reports over all columns of a table, and measures over bins that may be empty."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import binning, clean, prefix, profiles, woe
from weftline.plans.base import SAMPLE_SQL, sample
from weftline.plans.bins import GUARD_SQL
from weftline.plans.registry import query
from weftline.sources.tables import kept, table

#: Every numeric column of the sample but its target and set, one that is constant and one that is missing throughout.
COLUMNS = ("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "c_acctbal", "flat", "gone")
MOST, LEAST = 20, 4

_LONG = " UNION ALL ".join(f"SELECT '{c}' AS feature, CASE WHEN {c} >= 0 THEN {c}::DOUBLE END AS value, target FROM y" for c in COLUMNS)
_EDGES = " UNION ALL ".join(f"SELECT feature, {n} AS n, list_distinct(quantile_cont(value, [{', '.join(repr(i / n) for i in range(n + 1))}])) AS edges FROM u WHERE value IS NOT NULL GROUP BY feature" for n in range(LEAST, MOST + 1))


@query(
    "monotone_columns",
    f"""WITH {SAMPLE_SQL}, y AS (SELECT *, 7.0 AS flat, NULL::DOUBLE AS gone FROM sample), u AS MATERIALIZED ({_LONG}), v AS MATERIALIZED (SELECT feature, value, count(*) FILTER (target = 0) AS good, count(*) FILTER (target = 1) AS bad FROM u GROUP BY ALL),
edges AS ({_EDGES}),
c AS (SELECT feature, n, CASE WHEN value IS NULL THEN 0 ELSE greatest(1, len(list_filter(edges, lambda e: e < value))) END AS bin, sum(good) AS good, sum(bad) AS bad FROM v JOIN edges USING (feature) GROUP BY ALL),
s AS (SELECT *, good / sum(good) OVER w AS g, bad / sum(bad) OVER w AS b FROM c WINDOW w AS (PARTITION BY feature, n)),
t AS (SELECT feature, n, bin, {GUARD_SQL} AS woe FROM s WHERE bin > 0),
d AS (SELECT *, woe - lag(woe) OVER w AS d, (woe * lag(woe) OVER w < 0)::INT AS crossed FROM t WINDOW w AS (PARTITION BY feature, n ORDER BY bin)),
p AS (SELECT feature, n, count(*) AS bins, coalesce(sum(crossed), 0) AS crossings, coalesce(CASE WHEN count(*) FILTER (d >= 0) >= count(*) FILTER (d < 0) THEN sum(greatest(-d, 0)) ELSE sum(greatest(d, 0)) END, 0) AS broken FROM d GROUP BY ALL),
r AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY feature ORDER BY (broken > 1e-12)::INT, CASE WHEN broken > 1e-12 THEN round(broken, 9) ELSE 0 END, -n) = 1),
k AS (SELECT feature, n::INT AS n, bins::INT AS bins, crossings::INT AS crossings, round(CASE WHEN broken > 1e-12 THEN broken ELSE 0 END, 6) AS broken, CASE WHEN bins < 2 THEN 'one bin' WHEN broken <= 1e-12 THEN 'monotone' WHEN crossings = 1 THEN 'crosses zero once' WHEN crossings = 0 THEN 'never crosses zero' ELSE 'crosses zero often' END AS reason FROM r)
SELECT *, reason IN ('never crosses zero', 'crosses zero often') AS is_bad FROM k UNION ALL SELECT DISTINCT feature, NULL::INT, 0, NULL::INT, NULL::DOUBLE, 'no values', TRUE FROM u WHERE feature NOT IN (SELECT feature FROM k)""",
)
def monotone_columns(spark, sf_dir):
    """For every column the most bins whose weights of evidence rise or fall throughout, else those that break least, and why a column is bad."""
    x = sample(spark, sf_dir).withColumns({"flat": F.lit(7.0), "gone": F.lit(None).cast("double")})
    x = x.select("target", *[clean.present(F.col(c).cast("double"), True).alias(c) for c in COLUMNS])
    per = kept(woe.value_classes(clean.long_form(x, list(COLUMNS), ["target"])), "column-values")
    return woe.monotone_report(per, binning.quantile_edges_of(per.where("value IS NOT NULL"), list(range(LEAST, MOST + 1)), rows="rows"), sum(n + 1 for n in range(LEAST, MOST + 1)))


WIDTH = 500


@query(
    "auc_filled",
    f"""WITH x AS (SELECT o_orderpriority AS grp, floor(o_totalprice / {WIDTH})::BIGINT AS bin, o_totalprice AS value, (o_orderstatus = 'F')::INT AS target FROM orders),
v AS (SELECT grp, bin, value, count(*) FILTER (target = 0) AS good, count(*) FILTER (target = 1) AS bad FROM x GROUP BY ALL),
w AS (SELECT *, sum(good) OVER (PARTITION BY grp ORDER BY value) AS upto FROM v),
b AS (SELECT grp, bin, sum(good) AS good, sum(bad) AS bad, sum(bad * (upto - good) + bad * good / 2) AS wins FROM w GROUP BY ALL),
g AS (SELECT grp, unnest(range(min(bin), max(bin) + 1)) AS bin FROM b GROUP BY grp),
c AS (SELECT grp, bin, b.good IS NOT NULL AS filled, sum(coalesce(good, 0)) OVER o AS cg, sum(coalesce(bad, 0)) OVER o AS cb, sum(coalesce(wins, 0)) OVER o AS cw FROM g LEFT JOIN b USING (grp, bin) WINDOW o AS (PARTITION BY grp ORDER BY bin)),
a AS (SELECT grp, bin, CASE WHEN filled AND cg > 0 AND cb > 0 THEN greatest(cw / (cb * cg), 1 - cw / (cb * cg)) END AS auc FROM c)
SELECT grp, bin, round(auc, 9) AS auc, round(last_value(auc IGNORE NULLS) OVER (PARTITION BY grp ORDER BY bin ROWS UNBOUNDED PRECEDING), 9) AS auc_filled FROM a""",
)
def auc_filled(spark, sf_dir):
    """AUC of the values up to each of the bins of a fixed width; a bin without rows, or before both classes are seen, takes the last one known."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_totalprice").alias("value"), (F.col("o_orderstatus") == "F").cast("int").alias("target"))
    values = profiles.value_table(rows, ["grp"]).withColumn("bin", F.floor(F.col("value") / WIDTH))
    found = profiles.bins_of(values, ["grp"])
    grid = found.groupBy("grp").agg(F.min("bin").alias("low"), F.max("bin").alias("high")).select("grp", F.explode(F.sequence("low", "high")).alias("bin"))
    full = grid.join(found, ["grp", "bin"], "left").withColumn("filled", F.col("good").isNotNull()).na.fill(0, ["good", "bad", "wins"])
    upto = prefix.running(kept(full, "auc-bins"), "bin", {"cg": "good", "cb": "bad", "cw": "wins"}, ["grp"])
    auc = F.try_divide(F.col("cw"), F.col("cb") * F.col("cg"))
    told = kept(upto.select("grp", "bin", F.when(F.col("filled"), F.greatest(auc, 1 - auc)).alias("auc")), "auc-prefix")
    return prefix.last_known(told, "bin", "auc", "auc_filled", ["grp"]).select("grp", "bin", F.round("auc", 9).alias("auc"), F.round("auc_filled", 9).alias("auc_filled"))
