"""Runs over configured models, resumable backfills, and lookups of systems."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import monitor
from weftline.plans.loanbook import _REPORT, PERIOD_SQL
from weftline.plans.registry import oracle_sql, query
from weftline.sources import backfill
from weftline.sources.tables import fresh_path, table

#: model, system, customer status, score, days until the label shows, exchange rate.
MODELS = [
    ("north-new", "north", 0, "price", 1, 2.0), ("north-old", "north", 1, "price", 7, 2.0), ("north-semi", "north", 2, "balance", 15, 2.0), ("north-new-balance", "north", 0, "balance", 30, 2.0),
    ("south-new", "south", 0, "price", 1, 4.0), ("south-old", "south", 1, "balance", 7, 4.0), ("south-semi", "south", 2, "price", 3, 4.0), ("west-new", "west", 0, "price", 7, 1.0),
]
DAYS, PERIODS, AS_OF = 600, 4, "2001-08-01"

_VALUES = ", ".join(f"('{m}', '{s}', {k}, '{f}', {d}, {r!r}::DOUBLE)" for m, s, k, f, d, r in MODELS)
_CONFIGURED = f"""cf(model, system, status, score_name, performance_days, rate) AS (VALUES {_VALUES}),
sc AS (SELECT CASE WHEN c_nationkey % 2 = 0 THEN 'north' ELSE 'south' END AS system, c_custkey % 3 AS status, o_orderdate::DATE AS day, (o_orderstatus = 'F')::INT AS target, o_totalprice::DECIMAL(18,2) AS amount, o_totalprice / 1000 AS price, c_acctbal AS balance FROM orders JOIN customer ON o_custkey = c_custkey),
al AS (SELECT model, rate, CASE WHEN score_name = 'price' THEN price ELSE balance END AS score, target, amount, (date_diff('day', day, DATE '{AS_OF}' - performance_days::INT) - 1) // {DAYS} AS k, date_diff('day', day, DATE '{AS_OF}' - performance_days::INT) AS ago FROM sc JOIN cf USING (system, status)),
rw AS MATERIALIZED (SELECT *, model || '|' || k AS period FROM al WHERE ago >= 1 AND ago <= {DAYS * PERIODS} AND score >= 0 AND model IN (SELECT model FROM al WHERE k = 0 AND ago >= 1 AND score >= 0 GROUP BY 1 HAVING count(*) > 50)),
me AS MATERIALIZED (SELECT model, CASE WHEN count(*) >= 1000 THEN list_sort(list_distinct(quantile_cont(score, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) ELSE list_sort(list_distinct(quantile_cont(score, [0, 0.2, 0.4, 0.6, 0.8, 1.0]))) END AS e FROM rw WHERE k = 0 GROUP BY 1)"""
_REPORTED = (
    oracle_sql()["score_report"]
    .replace(PERIOD_SQL, f"{_CONFIGURED}, o AS (SELECT period, score, target, amount FROM rw), ed AS (SELECT DISTINCT period, e FROM rw JOIN me USING (model))")
    .replace("JOIN n USING (period), ed WHERE", "JOIN n USING (period) JOIN ed USING (period) WHERE")
    .replace("FROM n, ed)", "FROM n JOIN ed USING (period))")
    .replace("/ 2 AS amt", "AS amt")
    .replace("/ 2 AS bamt", "AS bamt")
)
_MONEY = ("amount_sum", "amount_mean", "good_amount_sum", "bad_amount_sum")


@query(
    "model_reports",
    f"""WITH {_CONFIGURED}, sh AS (SELECT model, k, greatest(1, len(list_filter(e, lambda x: x < score))) AS bin, count(*) AS n FROM rw JOIN me USING (model) WHERE score > e[1] AND score <= e[len(e)] GROUP BY ALL),
gd AS (SELECT DISTINCT model, k, period, unnest(range(1, len(e))) AS bin FROM rw JOIN me USING (model)),
pq AS (SELECT period, gd.k, gd.bin, coalesce(coalesce(a.n, 0) / sum(coalesce(a.n, 0)) OVER w, 0) AS p, coalesce(coalesce(b.n, 0) / nullif(sum(coalesce(b.n, 0)) OVER w, 0), 0) AS q FROM gd LEFT JOIN sh a ON a.model = gd.model AND a.k = gd.k AND a.bin = gd.bin LEFT JOIN sh b ON b.model = gd.model AND b.k = {PERIODS - 1} AND b.bin = gd.bin WINDOW w AS (PARTITION BY gd.model, gd.k)),
ps AS (SELECT period, bin, CASE WHEN k = {PERIODS - 1} THEN 0 ELSE (CASE WHEN p = 0 THEN 1e-4 ELSE p END - CASE WHEN q = 0 THEN 1e-4 ELSE q END) * ln(CASE WHEN p = 0 THEN 1e-4 ELSE p END / CASE WHEN q = 0 THEN 1e-4 ELSE q END) END AS psi FROM pq),
pt AS (SELECT period, bin::INT AS bin, psi FROM ps UNION ALL SELECT period, 0, sum(psi) FROM ps GROUP BY 1)
SELECT split_part(period, '|', 1) AS model, split_part(period, '|', 2)::INT AS period, bin, {', '.join(f'{c} / rate AS {c}' if c in _MONEY else c for c in _REPORT)}, psi
FROM ({_REPORTED}) r LEFT JOIN pt USING (period, bin) JOIN cf ON cf.model = split_part(period, '|', 1)""",
)
def model_reports(spark, sf_dir):
    """Every configured model's report over four periods before its labels show, with the shift against the oldest one; models with too few rows are left out."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    scores = F.inline(F.array(F.struct(F.lit("price").alias("score_name"), (F.col("o_totalprice") / 1000).alias("score")), F.struct(F.lit("balance").alias("score_name"), F.col("c_acctbal").alias("score"))))
    scored = o.select(F.when(F.col("c_nationkey") % 2 == 0, "north").otherwise("south").alias("system"), (F.col("c_custkey") % 3).cast("int").alias("status"), F.col("o_orderdate").cast("date").alias("day"), (F.col("o_orderstatus") == "F").cast("int").alias("target"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), scores)
    config = spark.createDataFrame(MODELS, "model string, system string, status int, score_name string, performance_days int, rate double")
    told = monitor.model_reports(scored, config, ["system", "status", "score_name"], F.lit(AS_OF).cast("date"), DAYS, PERIODS)
    return told.select("model", "period", "bin", *_REPORT, "psi")


#: model, kind of result, customer status, days before, threshold.
WATCHED = [("click-0", "click", 0, 3, 0.1), ("click-1", "click", 1, 4, 0.05), ("view-0", "view", 0, 3, 0.02), ("view-2", "view", 2, 4, 0.1), ("error-1", "error", 1, 3, 0.1), ("purchase-2", "purchase", 2, 4, 0.2), ("none-0", "none", 0, 3, 0.1)]
TODAY = "2024-01-20"
_WATCHED = ", ".join(f"('{m}', '{t}', {s}, {d}, {x!r}::DOUBLE)" for m, t, s, d, x in WATCHED)


@query(
    "drift_configured",
    f"""WITH cf(model, event_type, status, days_before, threshold) AS (VALUES {_WATCHED}),
x AS (SELECT model, threshold, date_diff('day', ts::DATE, DATE '{TODAY}') = 1 AS now, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, value AS v_score, CASE WHEN value > 20 THEN floor(value) END AS high_score, event_id FROM events JOIN cf ON cf.event_type = events.event_type AND cf.status = user_id % 3
  WHERE date_diff('day', ts::DATE, DATE '{TODAY}') BETWEEN 1 AND 1 + days_before),
n AS (SELECT model, threshold, count(*) FILTER (NOT now) AS n_before, count(*) FILTER (now) AS n_day FROM x GROUP BY ALL),
l AS (SELECT model, now, 'k' AS feature, k AS value FROM x UNION ALL SELECT model, now, 'v_score', v_score FROM x UNION ALL SELECT model, now, 'high_score', high_score FROM x),
f AS (SELECT model, feature FROM l WHERE value IS NOT NULL GROUP BY ALL HAVING count(DISTINCT now) = 2),
s AS (SELECT model, feature, list_sort(list(value)) AS v FROM l JOIN f USING (model, feature) WHERE NOT now AND value IS NOT NULL GROUP BY ALL),
u AS (SELECT model, feature, list_sort(list_distinct(list_transform(range(0, 11), lambda i: v[(i * (len(v) - 1)) // 10 + 1]))) AS u FROM s),
e AS (SELECT model, feature, CASE WHEN len(u) < 11 THEN list_concat(['-infinity'::DOUBLE], u[1:len(u) - 1], ['infinity'::DOUBLE]) ELSE list_concat(['-infinity'::DOUBLE], u[2:len(u) - 1], ['infinity'::DOUBLE]) END AS e FROM u),
b AS (SELECT model, feature, len(list_filter(e, lambda x: x < coalesce(value, -999.0))) AS bin, count(*) FILTER (NOT now) AS a, count(*) FILTER (now) AS z FROM l JOIN e USING (model, feature) GROUP BY ALL),
p AS (SELECT model, feature, a / sum(a) OVER w AS p, z / sum(z) OVER w AS q FROM b WINDOW w AS (PARTITION BY model, feature)),
r AS (SELECT model, feature, sum((p - q) * ln((p + 0.001) / (q + 0.001))) AS psi FROM p GROUP BY ALL)
SELECT model, feature, psi, n_before, n_day, feature LIKE '%\\_score' ESCAPE '\\' AND psi > threshold AS alert FROM r JOIN n USING (model)""",
)
def drift_configured(spark, sf_dir):
    """Yesterday's results of every configured model against the days before, with thresholds and windows of its own; only scores raise alerts."""
    e = table(spark, sf_dir, "events")
    high = F.when(F.col("value") > 20, F.create_map(F.lit("high_score"), F.floor("value").cast("double"))).otherwise(F.expr("cast(map() as map<string,double>)"))
    doc = F.map_concat(F.from_json("props", "map<string,double>"), F.create_map(F.lit("v_score"), F.col("value")), high)
    results = e.select("event_type", (F.col("user_id") % 3).cast("int").alias("status"), F.col("ts").cast("date").alias("day"), doc.alias("doc"))
    config = spark.createDataFrame(WATCHED, "model string, event_type string, status int, days_before int, threshold double")
    return monitor.drift_run(results, config, ["event_type", "status"], F.lit(TODAY).cast("date"))


_SLICES = "strftime(o_orderdate, '%Y-%m') || '/' || o_orderstatus"


@query(
    "backfill_resumed",
    f"""WITH o AS (SELECT {_SLICES} AS slice, o_totalprice FROM orders), s AS (SELECT DISTINCT slice FROM o)
SELECT slice, CASE WHEN slice LIKE '1999-12/P' THEN 'failed' ELSE 'done' END AS state, CASE WHEN slice LIKE '1999-12/P' THEN 2 WHEN slice LIKE '1996-06/%' THEN 2 ELSE 1 END::INT AS attempt, n, total
FROM s LEFT JOIN (SELECT slice, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM o WHERE NOT slice LIKE '1999-12/P' GROUP BY 1) USING (slice)""",
)
def backfill_resumed(spark, sf_dir):
    """Slices by month and status: a run in which those of one June break, a second one that goes on with what is left, those pending in one December breaking in both."""
    o = table(spark, sf_dir, "orders").select(F.concat_ws("/", F.date_format("o_orderdate", "yyyy-MM"), "o_orderstatus").alias("slice"), "o_orderkey", "o_totalprice")
    slices = sorted(r.slice for r in o.select("slice").distinct().collect())  # a row per month and status
    path, book = fresh_path(spark, "backfill"), fresh_path(spark, "ledger")

    def building(broken):
        def build(some):
            stop = F.raise_error(F.lit("the source is away"))
            bad = F.lit(False)
            for pattern in broken:
                bad = bad | F.col("slice").like(pattern)
            return o.where(F.col("slice").isin(some)).withColumn("o_totalprice", F.when(bad, stop.cast("double")).otherwise(F.col("o_totalprice")))

        return build

    backfill.run_slices(spark, slices, building(["1996-06/%", "1999-12/P"]), path, book, tries=2)
    backfill.run_slices(spark, slices, building(["1999-12/P"]), path, book, tries=2)
    assert backfill.run_slices(spark, slices, building([]), path, book, tries=2) == 0  # what has failed twice isn't tried again
    rows = spark.read.schema("o_orderkey bigint, o_totalprice double, slice string").parquet(path).groupBy("slice").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return backfill.states(spark, book).select("slice", "state", "attempt").join(rows, "slice", "left")
