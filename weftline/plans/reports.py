"""Loan labels, funnels, monitors, documents and dictionaries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import times, tokens
from weftline.operators import drift, loans, text
from weftline.plans.registry import query
from weftline.sources.tables import table

AS_OF = "2001-06-01"


def _loans(spark, sf_dir):
    """Orders as loans: due 30 days after the order, settled when the last item ships."""
    done = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("settled"))
    o = table(spark, sf_dir, "orders").join(done, "o_orderkey", "left")
    return o.withColumns({"due": F.col("o_orderdate") + F.expr("INTERVAL 30 DAY"), "as_of": F.lit(AS_OF).cast("timestamp_ntz"), "month": F.date_format("o_orderdate", "yyyy-MM"), "amount": F.col("o_totalprice").cast("decimal(18,2)")})


LOANS_SQL = f"""s AS (SELECT l_orderkey AS o_orderkey, max(l_shipdate) AS settled FROM lineitem GROUP BY 1),
d AS (SELECT *, o_orderdate + INTERVAL 30 DAY AS due, strftime(o_orderdate, '%Y-%m') AS month, o_totalprice::DECIMAL(18,2) AS amount FROM orders LEFT JOIN s USING (o_orderkey)),
e AS (SELECT *, floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(due)) / 86400e6) AS age, floor((epoch_us(settled) - epoch_us(due)) / 86400e6) AS late FROM d)"""


def _flag_sql():
    return ", ".join(f"(age >= {d})::INT AS agr_pd{n}, (age >= {d} AND (late IS NULL OR late >= {d}))::INT AS def_pd{n}" for n, d in loans.PAST_DUE.items())


@query("loan_flags", f"WITH {LOANS_SQL} SELECT o_orderkey, {_flag_sql()} FROM e")
def loan_flags(spark, sf_dir):
    return _loans(spark, sf_dir).select("o_orderkey", *[c.alias(k) for k, c in loans.flags(F.col("due"), F.col("settled"), F.col("as_of")).items()])


@query(
    "vintage_stats",
    f"WITH {LOANS_SQL}, f AS (SELECT month, {_flag_sql()} FROM e) SELECT month, count(*) AS n, " + ", ".join(f"sum(agr_pd{n})::BIGINT AS agr_pd{n}, sum(def_pd{n})::BIGINT AS def_pd{n}, coalesce(sum(def_pd{n}) / nullif(sum(agr_pd{n}), 0), -1) AS rate_pd{n}" for n in loans.PAST_DUE) + " FROM f GROUP BY month",
)
def vintage_stats(spark, sf_dir):
    x = _loans(spark, sf_dir)
    return loans.vintage(x.select("month", *[c.alias(k) for k, c in loans.flags(F.col("due"), F.col("settled"), F.col("as_of")).items()]), ["month"]).na.fill(-1.0)


def _horizon_sql():
    out = []
    for h in loans.HORIZONS:
        x = f"m{-h}" if h < 0 else f"p{h}"
        out.append(f"sum((age >= {h})::INT)::BIGINT AS due_{x}, sum((age >= {h} AND late IS NOT NULL AND late <= {h})::INT)::BIGINT AS finish_{x}, sum(CASE WHEN age >= {h} THEN amount ELSE 0 END)::DOUBLE AS due_amount_{x}, sum(CASE WHEN age >= {h} AND late <= {h} THEN amount ELSE 0 END)::DOUBLE AS finish_amount_{x}")
    return ", ".join(out)


def _performed(spark, sf_dir):
    x = _loans(spark, sf_dir)
    return x.select("o_orderpriority", *[c.alias(k) for k, c in loans.horizons(F.col("due"), F.col("settled"), F.col("as_of"), F.col("amount")).items()])


@query("loan_perf_horizons", f"WITH {LOANS_SQL} SELECT o_orderpriority, {_horizon_sql()} FROM e GROUP BY 1")
def loan_perf_horizons(spark, sf_dir):
    x = _performed(spark, sf_dir)
    return x.groupBy("o_orderpriority").agg(*[(F.sum(c).cast("double") if "amount" in c else F.sum(c)).alias(c) for c in x.columns[1:]])


@query("risk_report", f"WITH {LOANS_SQL}, h AS (SELECT o_orderpriority, {_horizon_sql()} FROM e GROUP BY 1) SELECT o_orderpriority, (due_p7 - finish_p7) / due_p7 AS bad_p7, (due_p15 - finish_p15) / due_p15 AS bad_p15, (due_amount_p7 - finish_amount_p7) / due_amount_p7 AS bad_amount_p7 FROM h")
def risk_report(spark, sf_dir):
    return loans.risk_report(_performed(spark, sf_dir), ["o_orderpriority"]).select("o_orderpriority", "bad_p7", "bad_p15", F.col("bad_amount_p7").cast("double").alias("bad_amount_p7"))


@query(
    "point_in_time_rewind",
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey % 3 AS extension, l_shipdate AS settled, o_orderdate + INTERVAL 60 DAY AS applied, l_extendedprice AS repaid, max(l_partkey % 3) OVER (PARTITION BY l_orderkey) AS m, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT l_orderkey, l_linenumber, CASE WHEN settled > applied AND (n = 1 OR extension = m) THEN 1 ELSE 2 END AS status, CASE WHEN settled > applied AND (n = 1 OR extension = m) THEN 0.0 ELSE repaid END AS repaid FROM x""",
)
def point_in_time_rewind(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 3).alias("extension"), F.col("l_shipdate").alias("settled"), (F.col("o_orderdate") + F.expr("INTERVAL 60 DAY")).alias("applied"), F.col("l_extendedprice").alias("repaid"), F.lit(2).alias("status"))
    return loans.rewind(x, "settled", "applied", "l_orderkey", "extension", ["repaid"]).select("l_orderkey", "l_linenumber", "status", "repaid")


@query("orders_seen_at", "SELECT o_custkey, o_orderkey AS own_id, count(*) OVER w AS n, string_agg(o_orderkey::VARCHAR, ',') OVER w AS ids FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)")
def orders_seen_at(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("s", F.when(F.col("o_orderstatus") == "F", 90).otherwise(10))
    got = loans.orders_seen_at(o, "o_custkey", "o_orderkey", "s")
    return got.select("o_custkey", "own_id", F.size("history").cast("long").alias("n"), F.array_join(F.transform("history", lambda e: e.id.cast("string")), ",").alias("ids"))


STAGES = {"pass": ["F", "O"], "reject": ["P"]}
_FUNNEL = "count(*) AS n_orders, count(DISTINCT o_custkey) AS n_users, count(*) FILTER (o_orderstatus IN ('F', 'O')) AS n_pass, count(DISTINCT CASE WHEN o_orderstatus IN ('F', 'O') THEN o_custkey END) AS users_pass, count(*) FILTER (o_orderstatus = 'P') AS n_reject"


def _applied(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))


@query("apply_funnel", f"SELECT o_orderpriority, {_FUNNEL}, n_pass / n_orders AS rate_pass FROM orders GROUP BY 1")
def apply_funnel(spark, sf_dir):
    return loans.funnel(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus", "o_custkey", STAGES).select("o_orderpriority", "n_orders", "n_users", "n_pass", "users_pass", "n_reject", "rate_pass")


@query("apply_funnel_margins", "SELECT coalesce(o_orderpriority, '1ALL') AS o_orderpriority, c_mktsegment, count(*) AS n, count(*) FILTER (o_orderstatus <> 'P') AS n_pass FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY GROUPING SETS ((o_orderpriority, c_mktsegment), (c_mktsegment))")
def apply_funnel_margins(spark, sf_dir):
    return loans.subtotals(_applied(spark, sf_dir), "o_orderpriority", "c_mktsegment", {"n": F.count("*"), "n_pass": F.count_if(F.col("o_orderstatus") != "P")})


@query("due_risk_subtotals", f"WITH {LOANS_SQL} SELECT coalesce(o_orderpriority, '1ALL') AS o_orderpriority, c_mktsegment, sum((age >= 8)::INT)::BIGINT AS due, sum((age >= 8 AND (late IS NULL OR late > 7))::INT)::BIGINT AS bad, sum(amount)::DOUBLE AS amount FROM e JOIN customer ON o_custkey = c_custkey GROUP BY GROUPING SETS ((o_orderpriority, c_mktsegment), (c_mktsegment))")
def due_risk_subtotals(spark, sf_dir):
    x = _loans(spark, sf_dir).join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    age, late = times.whole_days(F.col("due"), F.col("as_of")), times.whole_days(F.col("due"), F.col("settled"))
    return loans.subtotals(x, "o_orderpriority", "c_mktsegment", {"due": F.sum((age >= 8).cast("long")), "bad": F.sum(((age >= 8) & (late.isNull() | (late > 7))).cast("long")), "amount": F.sum("amount").cast("double")})


@query("due_risk_pivot", "SELECT c_mktsegment, count(*) FILTER (o_orderstatus = 'F') AS n_F, count(*) FILTER (o_orderstatus = 'O') AS n_O, count(*) FILTER (o_orderstatus = 'P') AS n_P FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def due_risk_pivot(spark, sf_dir):
    got = _applied(spark, sf_dir).groupBy("c_mktsegment").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return got.select("c_mktsegment", *[F.coalesce(F.col(s), F.lit(0)).alias(f"n_{s}") for s in "FOP"])


@query(
    "rejection_by_bin",
    """WITH x AS (SELECT *, floor(o_totalprice / 100000)::BIGINT AS bin FROM orders JOIN customer ON o_custkey = c_custkey), t AS (SELECT c_mktsegment, count(*) AS n_orders, count(DISTINCT o_custkey) AS n_users FROM x GROUP BY 1)
    SELECT c_mktsegment, bin, count(*) FILTER (o_orderstatus = 'P') AS n_rejected, count(DISTINCT CASE WHEN o_orderstatus = 'P' THEN o_custkey END) AS users_rejected, max(n_orders) AS n_orders, max(n_users) AS n_users, n_rejected / max(n_orders) AS reject_rate, users_rejected / max(n_users) AS user_reject_rate FROM x JOIN t USING (c_mktsegment) GROUP BY 1, 2""",
)
def rejection_by_bin(spark, sf_dir):
    x = _applied(spark, sf_dir).withColumn("bin", F.floor(F.col("o_totalprice") / 100000))
    return loans.rejections(x, "c_mktsegment", "bin", F.col("o_orderstatus") == "P", "o_custkey")


@query(
    "period_model_report",
    """WITH x AS (SELECT *, floor(o_totalprice / 50000)::BIGINT AS bin, (date_diff('day', o_orderdate::DATE, DATE '2000-01-01') - 1) // 30 AS period FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' AND o_orderdate >= TIMESTAMP '1999-10-03')
    SELECT coalesce(bin, -1) AS bin, period, count(*) AS n, sum((o_orderstatus = 'P')::INT)::BIGINT AS bad, avg((o_orderstatus = 'P')::INT) AS bad_rate FROM x GROUP BY GROUPING SETS ((period, bin), (period))""",
)
def period_model_report(spark, sf_dir):
    end = F.lit("2000-01-01").cast("date")
    spans = spark.range(1).select(F.posexplode(times.periods_back(end, 3, 30)).alias("period", "span"))
    o = table(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("date")).join(F.broadcast(spans), F.col("day").between(F.col("span.start"), F.col("span.end")))
    x = o.select(F.floor(F.col("o_totalprice") / 50000).alias("bin"), F.col("period").cast("long").alias("period"), (F.col("o_orderstatus") == "P").cast("int").alias("bad"))
    got = x.groupingSets([[F.col("period"), F.col("bin")], [F.col("period")]], "period", "bin").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    return got.select(F.coalesce("bin", F.lit(-1)).alias("bin"), "period", "n", "bad", (F.col("bad") / F.col("n")).alias("bad_rate"))


@query("missing_rate_monitor", "SELECT c_mktsegment, avg((c_acctbal < 0)::INT) AS missing_rate, count(*) AS n FROM customer GROUP BY 1")
def missing_rate_monitor(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.coalesce(F.avg((F.col("c_acctbal") < 0).cast("int")), F.lit(0.0)).alias("missing_rate"), F.count("*").alias("n"))


@query(
    "datasource_weekly",
    """WITH d AS (SELECT user_id, event_type, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, count(*) AS n, count(*) FILTER (value > 50) AS n_high FROM events GROUP BY ALL),
    r AS (SELECT *, dense_rank() OVER (ORDER BY week DESC) AS k FROM d) SELECT event_type, week, avg(n) AS mean_size, avg(n_high) AS mean_high FROM r WHERE k BETWEEN 2 AND 9 GROUP BY ALL""",
)
def datasource_weekly(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("week", times.week_start(F.col("ts")))
    sizes = e.groupBy("user_id", "event_type", "week").agg(F.count("value").alias("n"), F.count_if(F.col("value") > 50).alias("n_high"))
    weekly = sizes.groupBy("event_type", "week").agg(F.avg("n").alias("mean_size"), F.avg("n_high").alias("mean_high"))
    return weekly.withColumn("k", F.dense_rank().over(W.orderBy(F.col("week").desc()))).where("k BETWEEN 2 AND 9").drop("k")  # a row per type and week


@query("last_n_weeks", "WITH w AS (SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, count(*) AS n FROM events GROUP BY 1), r AS (SELECT *, dense_rank() OVER (ORDER BY week DESC) AS k FROM w) SELECT week, n FROM r WHERE k BETWEEN 2 AND 4")
def last_n_weeks(spark, sf_dir):
    w = table(spark, sf_dir, "events").groupBy(times.week_start(F.col("ts")).alias("week")).agg(F.count("*").alias("n"))
    return w.withColumn("k", F.dense_rank().over(W.orderBy(F.col("week").desc()))).where("k BETWEEN 2 AND 4").drop("k")


@query("summary_rollup", "SELECT coalesce(l_returnflag, 'total') AS l_returnflag, coalesce(l_linestatus, 'total') AS l_linestatus, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def summary_rollup(spark, sf_dir):
    got = table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))
    return got.select(F.coalesce("l_returnflag", F.lit("total")).alias("l_returnflag"), F.coalesce("l_linestatus", F.lit("total")).alias("l_linestatus"), "n", "quantity")


@query("distribution_compare", "SELECT l_linestatus, round(avg(l_extendedprice), 6) AS mean, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1")
def distribution_compare(spark, sf_dir):
    from weftline.operators.binning import quantiles

    x = table(spark, sf_dir, "lineitem").select("l_linestatus", F.col("l_extendedprice").alias("value"))
    v = F.col("value")
    ends = x.groupBy("l_linestatus").agg(F.round(F.avg(v), 6).alias("mean"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    middle = quantiles(x, [0.5], ["l_linestatus"])  # no column is gathered in one buffer
    return ends.join(middle, "l_linestatus").select("l_linestatus", "mean", F.round(F.col("q")[0], 6).alias("median"), "lo", "hi")


@query("json_extract", "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), -999.0) AS k, coalesce(TRY_CAST(json_extract_string(props, '$.none') AS DOUBLE), -999.0) AS none FROM events")
def json_extract(spark, sf_dir):
    score = lambda path: F.coalesce(F.get_json_object("props", path).try_cast("double"), F.lit(-999.0))
    return table(spark, sf_dir, "events").select("event_id", score("$.k").alias("k"), score("$.none").alias("none"))


@query(
    "json_feature_psi",
    """WITH x AS (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS v, (ts < TIMESTAMP '2024-01-15')::INT AS t FROM events), n AS (SELECT event_type, floor(v / 10) AS bin, sum(t) AS a, sum(1 - t) AS z FROM x GROUP BY ALL),
    s AS (SELECT event_type, a / sum(a) OVER w AS p, z / sum(z) OVER w AS q FROM n WINDOW w AS (PARTITION BY event_type)), r AS (SELECT event_type, sum((p - q) * ln((p + 0.001) / (q + 0.001))) AS psi FROM s GROUP BY 1) SELECT event_type, 'k' AS feature, psi, psi > 0.1 AS alert FROM r""",
)
def json_feature_psi(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    x = e.select("event_type", "ts", F.explode(F.from_json("props", "map<string,double>")).alias("feature", "v"))
    x = x.select("event_type", "feature", F.floor(F.col("v") / 10).alias("bin"), (F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")).alias("first"))
    return drift.psi(drift.shares(x, F.col("first"), ["event_type", "feature"]), "lambda", ["event_type", "feature"]).withColumn("alert", F.col("psi") > 0.1)


@query("nested_document", "SELECT o_orderkey, count(*) AS n_lines, sum(l_quantity::BIGINT)::BIGINT AS quantity, min(l_linenumber) AS first_line FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def nested_document(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("lines"))
    doc = table(spark, sf_dir, "orders").join(lines, "o_orderkey").select("o_orderkey", F.to_json(F.struct(F.struct("o_custkey", "o_orderstatus").alias("base_info"), F.struct("lines").alias("data_sources"))).alias("doc"))
    back = doc.withColumn("d", F.from_json("doc", "base_info struct<o_custkey:bigint,o_orderstatus:string>, data_sources struct<lines:array<struct<l_linenumber:int,l_quantity:double>>>"))
    return back.select("o_orderkey", F.size("d.data_sources.lines").cast("long").alias("n_lines"), F.aggregate("d.data_sources.lines", F.lit(0).cast("bigint"), lambda n, x: n + x.l_quantity.cast("bigint")).alias("quantity"), F.col("d.data_sources.lines")[0].l_linenumber.alias("first_line"))


def _event_lists(spark, sf_dir):
    entry = F.struct(times.micros(F.col("ts")).alias("us"), "event_type", "value")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(entry)).alias("events"))


@query("explode_arrays", "SELECT user_id, event_type, count(*) AS n, max(value) AS top FROM events GROUP BY ALL")
def explode_arrays(spark, sf_dir):
    lists = _event_lists(spark, sf_dir).select("user_id", F.transform("events", lambda e: e.event_type).alias("event_type"), F.transform("events", lambda e: e.value).alias("value"))
    flat = lists.select("user_id", F.inline(F.arrays_zip("event_type", "value")))
    return flat.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("value").alias("top"))


@query("rule_unnest", "SELECT event_id, 'R_' || event_type AS rule, 'type ' || substr(event_type, 1, 2) AS kind, value <= 50 AS pass FROM events")
def rule_unnest(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rules = F.create_map(F.concat(F.lit("R_"), "event_type"), F.struct(F.substring("event_type", 1, 2).alias("group"), (F.col("value") <= 50).alias("pass")))
    kept = e.select("event_id", F.to_json(rules).alias("rules"))
    flat = kept.select("event_id", F.explode(F.from_json("rules", "map<string,struct<group:string,pass:boolean>>")).alias("rule", "r"))
    return flat.select("event_id", "rule", F.concat(F.lit("type "), "r.group").alias("kind"), "r.pass")


@query("array_lookback_filter", "WITH m AS (SELECT user_id, max(ts) AS t FROM events GROUP BY 1) SELECT user_id, count(*) FILTER (epoch_us(ts) >= epoch_us(t) - 7 * 86400000000) AS n_7d, count(*) AS n FROM events JOIN m USING (user_id) GROUP BY 1")
def array_lookback_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", times.micros(F.col("ts")).alias("us"))
    aged = e.join(e.groupBy("user_id").agg(F.max("us").alias("last")), "user_id")
    return aged.groupBy("user_id").agg(F.count_if(F.col("us") >= F.col("last") - 7 * times.DAY_US).alias("n_7d"), F.count("*").alias("n"))


@query("first_per_sender", "SELECT user_id, event_type, min(epoch_us(ts)) AS first_us FROM events GROUP BY ALL")
def first_per_sender(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min(times.micros(F.col("ts"))).alias("first_us"))


@query("epoch_localize", "SELECT event_id, strftime(make_timestamp(epoch_us(ts)) + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS local_text FROM events")
def epoch_localize(spark, sf_dir):
    ms = F.floor(times.micros(F.col("ts")) / 1000)
    return table(spark, sf_dir, "events").select("event_id", times.local_text(ms, "Asia/Shanghai").alias("local_text"))


@query("zone_convert", "SELECT event_id, strftime(ts + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M') AS moved FROM events")
def zone_convert(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.date_format(times.rezoned(F.col("ts"), "Asia/Bangkok", "Asia/Tokyo"), "yyyy-MM-dd HH:mm").alias("moved"))


@query("whole_day_diff", "SELECT event_id, floor((epoch_us(TIMESTAMP '2024-02-01 23:00:00') - epoch_us(ts)) / 86400e6)::BIGINT AS days FROM events")
def whole_day_diff(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", times.whole_days(F.col("ts"), F.lit("2024-02-01 23:00:00").cast("timestamp_ntz")).alias("days"))


@query("week_keys", "SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS week_start, strftime(date_trunc('week', o_orderdate) + INTERVAL 6 DAY, '%Y-%m-%d') AS week_end FROM orders")
def week_keys(spark, sf_dir):
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(F.date_format(d, "yyyy-MM-dd").alias("day"), times.week_start(d).alias("week_start"), times.week_end(d).alias("week_end")).distinct()


@query("date_ranges", "SELECT strftime(x, '%Y-%m-%d') AS day FROM (SELECT unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY)) AS x FROM events)")
def date_ranges(spark, sf_dir):
    ends = table(spark, sf_dir, "events").agg(F.min("ts").cast("date").alias("a"), F.max("ts").cast("date").alias("b"))
    return ends.select(F.explode(F.sequence("a", "b")).alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("day"))


@query("multi_format_time", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN epoch_us(ts) // 1000000 WHEN 1 THEN epoch_us(ts) // 1000000 ELSE 4102358400 END AS seconds FROM events")
def multi_format_time(spark, sf_dir):
    us = times.micros(F.col("ts"))
    written = F.when(F.col("event_id") % 3 == 0, F.floor(us / 1000000).cast("string")).when(F.col("event_id") % 3 == 1, F.floor(us / 1000).cast("string")).otherwise(F.lit("unreadable"))
    return table(spark, sf_dir, "events").select("event_id", F.unix_seconds(times.any_format(written)).alias("seconds"))


@query("url_validity", "SELECT page_id, coalesce(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '') AS host, regexp_matches(url, '^[a-z]+://[^/?#:]+') AS valid FROM pages")
def url_validity(spark, sf_dir):
    host = F.try_parse_url("url", F.lit("HOST"))
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(host, F.lit("")).alias("host"), host.isNotNull().alias("valid"))


TOKENS_SQL = r"list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '')"
BAG_SQL = f"t AS (SELECT doc_id, {TOKENS_SQL} AS w FROM documents), g AS (SELECT doc_id, unnest(range(1, len(w))) AS i, w FROM t WHERE len(w) >= 2), b AS (SELECT doc_id, w[i] || ' ' || w[i + 1] AS token, count(*) AS n FROM g GROUP BY ALL)"


@query("ngram_counts", f"WITH {BAG_SQL} SELECT token, sum(n)::BIGINT AS n, count(*) AS n_docs FROM b GROUP BY 1 HAVING count(*) >= 5")
def ngram_counts(spark, sf_dir):
    b = text.marked(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", 2)
    return b.groupBy("token").agg(F.count("*").alias("n"), F.count_if("first").alias("n_docs")).where("n_docs >= 5")


UNI_BAG = f"t AS (SELECT doc_id, unnest({TOKENS_SQL}) AS token FROM documents), b AS (SELECT doc_id, token, count(*) AS n FROM t GROUP BY ALL), x AS (SELECT b.*, toxic AS target FROM b JOIN labels USING (doc_id))"


def _labelled_bag(spark, sf_dir):
    b = text.bag(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", 1)
    return b, table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("target"))


@query("token_stats", f"WITH {UNI_BAG} SELECT token, sum(CASE WHEN target = 0 THEN n ELSE 0 END)::BIGINT AS n_0, sum(CASE WHEN target = 1 THEN n ELSE 0 END)::BIGINT AS n_1, count(*) FILTER (target = 0) AS orders_0, count(*) FILTER (target = 1) AS orders_1 FROM x GROUP BY 1")
def token_stats(spark, sf_dir):
    return text.token_stats(*_labelled_bag(spark, sf_dir), "doc_id")


OOF_SQL = "p AS (SELECT token, doc_id % 5 AS fold, count(*) AS orders, sum(target) AS bad FROM x GROUP BY ALL), a AS (SELECT token, sum(orders) AS orders, sum(bad) AS bad FROM p GROUP BY 1), f AS (SELECT DISTINCT fold FROM p), l AS (SELECT a.token, f.fold, (a.orders - coalesce(p.orders, 0))::BIGINT AS orders, (a.bad - coalesce(p.bad, 0))::BIGINT AS bad FROM a CROSS JOIN f LEFT JOIN p ON p.token = a.token AND p.fold = f.fold UNION ALL SELECT token, -1, orders::BIGINT, bad::BIGINT FROM a), o AS (SELECT *, bad / orders AS bad_rate, (bad / orders) / (sum(bad) OVER (PARTITION BY fold) / sum(orders) OVER (PARTITION BY fold)) AS lift FROM l WHERE orders > 0)"


def _oof(spark, sf_dir):
    t = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("target"))
    known = table(spark, sf_dir, "documents").select("doc_id", "text").join(t.select("doc_id").distinct(), "doc_id", "left_semi")
    b = text.marked(known, "doc_id", "text", 1).where("first").select("doc_id", "token")
    per = b.join(t, "doc_id").groupBy("token", text.fold_of(F.col("doc_id"), 5).cast("long").alias("fold")).agg(F.count("*").alias("orders"), F.sum("target").alias("bad"))
    return text.oof_dictionary(per, ["token"], "fold")


@query("oof_token_dictionary", f"WITH {UNI_BAG}, {OOF_SQL} SELECT token, fold, orders, bad, bad_rate, lift FROM o")
def oof_token_dictionary(spark, sf_dir):
    return _oof(spark, sf_dir)


@query(
    "token_select_levels",
    f"""WITH {UNI_BAG}, {OOF_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY lift, token) AS low, row_number() OVER (PARTITION BY fold ORDER BY lift DESC, token) AS high, row_number() OVER (PARTITION BY fold ORDER BY orders DESC, token) AS many FROM o WHERE orders >= 20),
    k AS (SELECT fold, token, orders, bad, lift, (lift > 1)::INT AS side FROM r WHERE low <= 30 OR high <= 30 OR many <= 30)
    SELECT fold, token, orders, bad, (least(floor((rank() OVER (PARTITION BY fold, side ORDER BY lift) - 1) * 5 / count(*) OVER (PARTITION BY fold, side)), 4) + side * 5)::INT AS level FROM k""",
)
def token_select_levels(spark, sf_dir):
    return text.select_levels(_oof(spark, sf_dir), ["fold"], 20, 30, 5).select("fold", "token", "orders", "bad", "level")


def _rules_sql(share: float, heavy: str) -> str:
    """Selection by the reference's conditions, sums over the other folds taken directly."""
    cuts = ", ".join(repr(i / 5) for i in range(6))
    return f"""WITH t AS (SELECT doc_id, unnest({TOKENS_SQL}) AS token FROM documents), b AS (SELECT doc_id, token, count(*) AS n FROM t GROUP BY ALL), d AS (SELECT doc_id, doc_id % 5 AS fold, toxic AS target FROM documents JOIN labels USING (doc_id)),
    f AS (SELECT DISTINCT fold FROM d UNION ALL SELECT -1), a AS (SELECT f.fold, count(*) AS n_all, sum(target) AS bad_all FROM f JOIN d ON f.fold <> d.fold GROUP BY 1),
    p AS (SELECT f.fold, token, count(*) AS orders, sum(target) AS bad, sum(n * (1 - target)) AS w0, sum(n * target) AS w1, sum(n) AS w FROM b JOIN d USING (doc_id) JOIN f ON f.fold <> d.fold GROUP BY ALL),
    q AS (SELECT fold, quantile_cont(w0, 0.95) AS q0, quantile_cont(w1, 0.95) AS q1, quantile_cont(w, 0.95) AS q FROM p GROUP BY 1),
    c AS (SELECT fold, token, orders, (bad / orders) / (bad_all / n_all) AS lift FROM p JOIN q USING (fold) JOIN a USING (fold) WHERE {heavy} AND orders > {share} * n_all),
    r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY lift, token) AS low, row_number() OVER (PARTITION BY fold ORDER BY lift DESC, token DESC) AS high, row_number() OVER (PARTITION BY fold ORDER BY orders DESC, token) AS many FROM c WHERE lift < 0.9 OR lift > 1.1),
    k AS (SELECT *, (lift > 1.1)::INT AS side FROM r WHERE low <= 5000 OR high <= 5000 OR many <= 5000), e AS (SELECT fold, side, list_distinct(quantile_cont(lift, [{cuts}])) AS e FROM k GROUP BY ALL)
    SELECT fold, token, orders::BIGINT AS orders, lift, (greatest(1, len(list_filter(e, lambda x: x < lift))) - 1 + side * 5)::INT AS level FROM k JOIN e USING (fold, side)"""


def _rule_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("target")), "doc_id")
    return text.oof_weights(d.select("doc_id", "target", tokens.tokens(F.col("text")).alias("words")), "doc_id", 5)


@query("token_select_rules", _rules_sql(0.005, "w > q"))
def token_select_rules(spark, sf_dir):
    return text.select_by_rules(_rule_stats(spark, sf_dir), ["fold"])


@query("token_select_rules_by_class", _rules_sql(0.03, "(w0 > q0 OR w1 > q1)"))
def token_select_rules_by_class(spark, sf_dir):
    return text.select_by_rules(_rule_stats(spark, sf_dir), ["fold"], least_share=0.03, per_class=True)


SPANS = (3, 7, 15, 30)
LOOK_SQL = "m AS (SELECT user_id, max(ts) AS t, max((event_type = 'error')::INT) AS target FROM events GROUP BY 1), e AS (SELECT user_id, event_type AS item, target, floor((epoch_us(t) - epoch_us(ts)) / 86400e6) AS age FROM events JOIN m USING (user_id)), y AS (SELECT DISTINCT user_id, item, target, span FROM e, (SELECT unnest([3, 7, 15, 30]) AS span) WHERE age <= span)"
LOOK_OOF = "p AS (SELECT span, item, user_id % 5 AS fold, count(*) AS orders, sum(target) AS bad FROM y GROUP BY ALL), a AS (SELECT span, item, sum(orders) AS orders, sum(bad) AS bad FROM p GROUP BY ALL), f AS (SELECT DISTINCT fold FROM p)"


def _looked_back(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    last = e.groupBy("user_id").agg(F.max("ts").alias("t"), F.max((F.col("event_type") == "error").cast("int")).alias("target"))
    aged = e.join(last, "user_id").select("user_id", F.col("event_type").alias("item"), "target", times.whole_days(F.col("ts"), F.col("t")).alias("age"))
    return aged.select("user_id", "item", "target", text.lookbacks(F.col("age"), list(SPANS)).alias("span")).distinct()


@query("oof_lookback_dictionary", f"WITH {LOOK_SQL}, {LOOK_OOF}, l AS (SELECT a.span, a.item, f.fold, (a.orders - coalesce(p.orders, 0))::BIGINT AS orders, (a.bad - coalesce(p.bad, 0))::BIGINT AS bad FROM a CROSS JOIN f LEFT JOIN p ON p.span = a.span AND p.item = a.item AND p.fold = f.fold UNION ALL SELECT span, item, -1, orders::BIGINT, bad::BIGINT FROM a) SELECT * FROM l WHERE orders > 0")
def oof_lookback_dictionary(spark, sf_dir):
    from weftline.operators.joins import leave_one_out

    per = _looked_back(spark, sf_dir).groupBy("span", "item", F.pmod("user_id", F.lit(5)).alias("fold")).agg(F.count("*").alias("orders"), F.sum("target").alias("bad"))
    return leave_one_out(per, ["span", "item"], "fold", ["orders", "bad"])


@query("oof_item_dictionary", "WITH d AS (SELECT DISTINCT user_id, event_type AS item FROM events), s AS (SELECT user_id, count(*) AS k FROM d GROUP BY 1), m AS (SELECT user_id, max((value > 99)::INT) AS target FROM events GROUP BY 1) SELECT item, count(DISTINCT user_id) AS n_orders, round(sum(1.0 / k), 6) AS weight, sum(target)::BIGINT AS bad FROM d JOIN s USING (user_id) JOIN m USING (user_id) GROUP BY 1")
def oof_item_dictionary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    per = e.groupBy("user_id").agg(F.collect_set("event_type").alias("items"), F.max((F.col("value") > 99).cast("int")).alias("target"))
    flat = per.select("user_id", "target", (F.lit(1.0) / F.size("items")).alias("w"), F.explode("items").alias("item"))
    return flat.groupBy("item").agg(F.count_distinct("user_id").alias("n_orders"), F.round(F.sum("w"), 6).alias("weight"), F.sum("target").alias("bad"))


@query("partition_overwrite", "SELECT o_orderstatus, count(*) AS n, CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE max(o_totalprice) END AS top FROM orders GROUP BY 1")
def partition_overwrite(spark, sf_dir):
    from weftline.sources.tables import fresh_path, write_partitions

    path = fresh_path(spark, "orders-by-status")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    write_partitions(o, path, ["o_orderstatus"])
    write_partitions(o.where("o_orderstatus = 'P'").withColumn("o_totalprice", F.lit(0.0)), path, ["o_orderstatus"])
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))


@query("ml_grid")
def ml_grid(spark, sf_dir):
    from weftline.operators.ml import grid

    from weftline.plans.base import FEATURES, sample

    return grid(sample(spark, sf_dir).select("target", "train", *FEATURES), list(FEATURES), "target", "train", [{"maxDepth": 2, "maxIter": 3}, {"maxDepth": 3, "maxIter": 5}])


@query("ml_fusion")
def ml_fusion(spark, sf_dir):
    from weftline.operators.ml import fusion
    from weftline.plans.base import FEATURES, sample

    return fusion(sample(spark, sf_dir).select("target", "train", *FEATURES[:3]), list(FEATURES[:3]), "target", "train", 2)


@query("ml_importances")
def ml_importances(spark, sf_dir):
    """What each feature adds to the trees."""
    from weftline.operators.ml import importances
    from weftline.plans.base import FEATURES, sample

    found = importances(sample(spark, sf_dir).select("target", "train", *FEATURES), list(FEATURES), "target", maxDepth=3, maxIter=3)
    return spark.createDataFrame(found, "feature string, importance double")


@query("ml_predictions")
def ml_predictions(spark, sf_dir):
    """Rows with the model's probability and their set, kept; summed up per set."""
    from weftline.operators.ml import scored
    from weftline.plans.base import FEATURES, sample
    from weftline.sources.tables import fresh_path

    got = scored(sample(spark, sf_dir).select("target", "train", *FEATURES), list(FEATURES), "target", "train", fresh_path(spark, "predictions"), maxDepth=3, maxIter=3)
    return got.groupBy("sample_type").agg(F.count("*").alias("n"), F.round(F.avg("p"), 4).alias("mean_p"), F.round(F.avg("target"), 4).alias("bad_rate"))
