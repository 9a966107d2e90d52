"""Scheduled runs over configured models: reports over periods, and drift of the latest day.

A configuration is a table, a row per model: which system, customers and score it
speaks of, how long its label takes to show, and its thresholds. It is joined to the
scored rows once; models, periods and features are groups of one plan, not runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators import binning, clean, drift, loanbook, profiles
from weftline.sources.tables import checked_broadcast, kept

#: Rows that a model's latest period has more than, or there is no report (fixed value).
LEAST_ROWS = 50


def configured(rows: DataFrame, config: DataFrame, on: list[str]) -> DataFrame:
    """Rows of the configured models, with their configuration; a row may belong to several models."""
    return rows.join(checked_broadcast(config), on)


def period_of(day: Column, end: Column, days: int, n: int) -> Column:
    """Which of the n periods of so many days before ``end`` a day is in, 0 the latest; null outside."""
    ago = F.datediff(end, day)
    return F.when((ago >= 1) & (ago <= days * n), F.floor((ago - 1) / days).cast("int"))


def model_reports(scored: DataFrame, config: DataFrame, on: list[str], as_of: Column, days: int, n: int) -> DataFrame:
    """(model, period, bin, ..., psi): every model's report over its last n periods, those before the day whose labels have shown.

    scored: what ``on`` names, day, score, target, amount; config: ``on``, model,
    performance_days, rate. Scores below 0 are missing. Cut points are those of the
    latest period, 10 bins from 1,000 rows on, else 5; a model whose latest period has
    LEAST_ROWS rows or fewer gets no report, nor does such a period of other models.
    psi is a bin's part of the shift against the oldest period, 0 for that one; the
    least score lies outside there, as it does in the reports' own bins for shares.
    """
    rows = configured(scored, config, on)
    end = F.date_sub(as_of, F.col("performance_days"))
    rows = rows.withColumn("period", period_of(F.col("day"), end, days, n)).where(F.col("period").isNotNull() & (F.col("score") >= 0))
    rows = rows.select("model", "rate", F.col("period").alias("k"), F.concat_ws("|", "model", F.col("period")).alias("period"), "score", "target", "amount")
    rows = kept(rows, "monitor-rows")
    busy = rows.where("k = 0").groupBy("model").agg(F.count("*").alias("n")).where(F.col("n") > LEAST_ROWS).select("model")
    rows = rows.join(checked_broadcast(busy), "model", "left_semi")
    edges = kept(loanbook.cut_points(rows, F.col("k") == 0, by="model"), "monitor-edges")
    keys = rows.select("model", "k", "period").distinct()
    told = loanbook.score_report(rows, keys.join(checked_broadcast(edges), "model").select("period", "edges"), least_rows=LEAST_ROWS)

    inside = (F.col("score") > F.element_at("edges", 1)) & (F.col("score") <= F.element_at("edges", -1))
    shares = rows.join(checked_broadcast(edges), "model").where(inside).groupBy("model", "k", binning.bin_of_quantile(F.col("score"), F.col("edges")).alias("bin")).agg(F.count("*").alias("n"))
    oldest = shares.where(F.col("k") == n - 1).select("model", "bin", F.col("n").alias("first"))
    grid = keys.join(checked_broadcast(edges), "model").select("model", "k", "period", F.explode(F.sequence(F.lit(1), F.size("edges") - 1)).alias("bin"))
    every = grid.join(shares, ["model", "k", "bin"], "left").join(oldest, ["model", "bin"], "left").na.fill(0, ["n", "first"])  # a row per model, period and bin
    part = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.sum(c).over(W.partitionBy("model", "k"))), F.lit(0.0))
    psi = every.withColumns({"p": part("n"), "q": part("first")}).select("period", "bin", F.when(F.col("k") == n - 1, 0.0).otherwise(drift.term(F.col("p"), F.col("q"), "floor")).alias("psi"))
    whole = psi.groupBy("period").agg(F.lit(0).alias("bin"), F.sum("psi").alias("psi"))
    out = told.join(psi.unionByName(whole), ["period", "bin"], "left")
    out = out.withColumns({"model": F.substring_index("period", "|", 1), "period": F.substring_index("period", "|", -1).cast("int")})
    out = out.join(checked_broadcast(rows.select("model", "rate").distinct()), "model")
    return out.withColumns({c: F.col(c) / F.col("rate") for c in ("amount_sum", "amount_mean", "good_amount_sum", "bad_amount_sum")}).drop("rate")


def drift_run(results: DataFrame, config: DataFrame, on: list[str], as_of: Column, n_bins: int = 10) -> DataFrame:
    """(model, feature, psi, n_before, n_day, alert): the day before as_of against the days before it, for every feature of every configured model's results.

    results: what ``on`` names, day, doc (map of numbers); config: ``on``, model,
    days_before, threshold. Bins have the frequency edges of the days before; a feature
    that a result lacks counts as the sentinel in them. Only features that both sides
    have are told of, and only those named ..._score raise an alert.
    """
    ago = F.datediff(as_of, F.col("day"))
    rows = configured(results, config, on).withColumn("before", F.when(ago == 1, False).when((ago >= 2) & (ago <= 1 + F.col("days_before")), True)).where(F.col("before").isNotNull())
    rows = kept(rows.select("model", "threshold", "before", "doc"), "drift-rows")
    counts = rows.groupBy("model", "threshold").agg(F.count_if("before").alias("n_before"), F.count_if(~F.col("before")).alias("n_day"))
    by = ["model", "feature"]
    values = rows.select("model", "before", F.explode("doc").alias("feature", "value")).withColumn("value", clean.finite(F.col("value")))
    values = kept(values.groupBy(*by, "before", "value").agg(F.count("*").alias("n_rows")), "drift-values")
    shared = values.groupBy(*by).agg(F.count_distinct("before").alias("sides")).where("sides = 2").select(*by)
    known = values.where("value IS NOT NULL").join(checked_broadcast(shared), by)
    edges = binning.frequency_edges(known.where("before").select(*by, "value", "n_rows"), n_bins, by)
    edges = kept(shared.join(edges, by, "left").withColumn("edges", F.coalesce("edges", F.array(F.lit(float("-inf")), F.lit(float("inf"))))), "drift-edges")
    found = known.groupBy(*by, "before").agg(F.sum("n_rows").alias("n_rows"))
    lacking = shared.withColumn("before", F.explode(F.array(F.lit(True), F.lit(False)))).join(found, [*by, "before"], "left").join(checked_broadcast(counts), "model")
    lacking = lacking.select(*by, "before", F.lit(clean.SENTINEL).alias("value"), (F.when(F.col("before"), F.col("n_before")).otherwise(F.col("n_day")) - F.coalesce("n_rows", F.lit(0))).alias("n_rows")).where("n_rows > 0")
    every = known.select(*by, "before", "value", "n_rows").unionByName(lacking).join(checked_broadcast(edges), by)
    binned = every.withColumn("bin", binning.bin_of(F.col("value"), F.col("edges"))).groupBy(*by, "bin", "before").agg(F.sum("n_rows").alias("n"))
    psi = profiles.lambda_psi(binned, by, F.col("before"))
    out = psi.join(checked_broadcast(counts), "model")
    return out.select(*by, "psi", "n_before", "n_day", (F.col("feature").endswith("_score") & (F.col("psi") > F.col("threshold"))).alias("alert"))
