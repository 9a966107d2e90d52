"""KS, AUC, lift and ROC from counts per distinct score: ties are one step, rows are never sorted one by one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators.prefix import running, with_totals


def per_score(rows: DataFrame, score: str, target: str, by: list[str]) -> DataFrame:
    """(by..., score, n0, n1) of the rows that have a score."""
    return rows.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("score")).agg(F.sum((F.col(target) == 0).cast("long")).alias("n0"), F.sum((F.col(target) == 1).cast("long")).alias("n1"))


def curve(counted: DataFrame, by: list[str]) -> DataFrame:
    """Adds the running shares cdf0 and cdf1 and their distance gap."""
    x = running(with_totals(counted, {"t0": "n0", "t1": "n1"}, by), "score", {"c0": "n0", "c1": "n1"}, by)
    return x.withColumns({"cdf0": F.try_divide(F.col("c0"), F.col("t0")), "cdf1": F.try_divide(F.col("c1"), F.col("t1"))}).withColumn("gap", F.abs(F.col("cdf1") - F.col("cdf0")))


def ks_auc(counted: DataFrame, by: list[str]) -> DataFrame:
    """(by..., ks, auc): the greatest gap, and the chance that a 1 scores above a 0, ties half."""
    x = curve(counted, by)
    wins = F.sum(F.col("n1") * (F.col("c0") - F.col("n0")) + F.col("n1") * F.col("n0") / 2)
    return x.groupBy(*by).agg(F.max("gap").alias("ks"), F.try_divide(wins, F.max("t0") * F.max("t1")).alias("auc"))


def roc_points(rows: DataFrame, score: str, target: str, step: float = 0.01) -> DataFrame:
    """(threshold_index, tp, fp, fn, tn) on a fixed grid: counts per grid cell first, running sums over the grid after."""
    n = round(1 / step)
    cell = F.least(F.greatest(F.floor(F.col(score) / step + 1e-9), F.lit(0)), F.lit(n))
    cells = rows.where(F.col(score).isNotNull()).groupBy(cell.alias("i")).agg(F.sum((F.col(target) == 1).cast("long")).alias("n1"), F.sum((F.col(target) != 1).cast("long")).alias("n0"))
    grid = rows.sparkSession.range(n + 1).withColumnRenamed("id", "i").join(cells, "i", "left").na.fill(0)
    tail, all_ = W.orderBy("i").rowsBetween(0, W.unboundedFollowing), W.partitionBy()
    return grid.select(F.col("i").alias("threshold_index"), F.sum("n1").over(tail).alias("tp"), F.sum("n0").over(tail).alias("fp"), (F.sum("n1").over(all_) - F.sum("n1").over(tail)).alias("fn"), (F.sum("n0").over(all_) - F.sum("n0").over(tail)).alias("tn"))


def univariate(table: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adds cumulative rates, lift, running KS and prefix AUC to (by..., bin, good, bad), in bin order."""
    by = by or ["feature"]
    w = W.partitionBy(*by)
    up = w.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    x = table.withColumns({"total": F.col("good") + F.col("bad"), "cum_good": F.sum("good").over(up), "cum_bad": F.sum("bad").over(up), "all_good": F.sum("good").over(w), "all_bad": F.sum("bad").over(w)})
    x = x.withColumn("wins", F.col("bad") * (F.col("cum_good") - F.col("good")) + F.col("bad") * F.col("good") / 2)
    return x.select(
        *by, "bin", "good", "bad", "total",
        (F.col("bad") / F.col("total")).alias("bad_rate"),
        (F.col("total") / (F.col("all_good") + F.col("all_bad"))).alias("total_rate"),
        (F.col("cum_bad") / (F.col("cum_good") + F.col("cum_bad"))).alias("cum_bad_rate"),
        F.try_divide(F.col("bad") / F.col("total"), F.col("all_bad") / (F.col("all_good") + F.col("all_bad"))).alias("lift"),
        F.abs(F.try_divide(F.col("cum_bad"), F.col("all_bad")) - F.try_divide(F.col("cum_good"), F.col("all_good"))).alias("ks"),
        F.try_divide(F.sum("wins").over(up), F.col("cum_bad") * F.col("cum_good")).alias("auc_cum"),
    )


def confusion(rows: DataFrame, score: str, target: str, threshold: float) -> DataFrame:
    """One row: tp, fp, fn, tn, accuracy, precision and recall."""
    hit, bad = F.col(score) >= threshold, F.col(target) == 1
    n = rows.agg(F.count_if(hit & bad).alias("tp"), F.count_if(hit & ~bad).alias("fp"), F.count_if(~hit & bad).alias("fn"), F.count_if(~hit & ~bad).alias("tn"))
    return n.withColumns({"accuracy": (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), "precision": F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), "recall": F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))})


def weighted_box(per: DataFrame, n: int) -> DataFrame:
    """(bin, bad, good, badrate, population_pct, cumsum_pct, median) of (score, bad, good, n) per distinct score.

    Bands of equal weight end at the greatest whole point in them, half up.
    Scores below 0 are missing: a bin -1 of their own, whose median is -9999979.
    Shares are summed up from the other end where the bad rate rises more often
    than it falls.
    """
    from weftline.operators.binning import quantiles

    w = F.col("bad") + F.col("good")
    normal = per.where("score >= 0").withColumn("w", w)
    run = running(with_totals(normal, {"t": "w"}), "score", {"u": "w"})
    band = F.least(F.floor(F.col("u") * n / F.col("t")), F.lit(n - 1))
    tops = run.where(band < n - 1).groupBy(band.alias("band")).agg(F.max(F.floor(F.col("score") + 0.5)).alias("top"))
    edges = tops.agg(F.collect_set("top").alias("edges"))  # a value per band
    binned = normal.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("edges", lambda e: e <= F.col("score"))))
    medians = quantiles(binned.select("bin", F.col("score").alias("value"), "n"), [0.5], ["bin"], rows="n").select("bin", F.col("q")[0].alias("median"))
    box = binned.groupBy("bin").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).join(medians, "bin")
    gone = per.where("score < 0 OR score IS NULL").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where("bad + good > 0")
    box = box.select("bin", "bad", "good", "median").unionByName(gone.select(F.lit(-1).alias("bin"), "bad", "good", F.lit(-9999979.0).alias("median")))
    box = box.withColumn("badrate", F.try_divide(F.col("bad"), w))  # a row per band from here on
    step = F.when((F.col("bin") >= 0) & (F.lag("bin").over(W.orderBy("bin")) >= 0), F.col("badrate") - F.lag("badrate").over(W.orderBy("bin")))
    box = box.withColumn("step", step).withColumn("falling", F.count_if(F.col("step") < 0).over(W.partitionBy()) >= F.count_if(F.col("step") >= 0).over(W.partitionBy()))
    box = box.withColumns({"population_pct": w / F.sum(w).over(W.partitionBy()), "place": F.when(F.col("falling"), F.col("median")).otherwise(-F.col("median"))})
    rest = W.orderBy("place").rowsBetween(0, W.unboundedFollowing)
    return box.select("bin", "bad", "good", "badrate", "population_pct", F.sum("population_pct").over(rest).alias("cumsum_pct"), "median")


def points(probability: Column, base: float = 550.0, doubling: float = 60.0) -> Column:
    """A probability as a score: base minus doubling per doubling of the odds, half to even."""
    return F.bround(F.lit(base) - F.lit(doubling) / F.ln(F.lit(2.0)) * F.ln(probability / (1 - probability)), 0)
