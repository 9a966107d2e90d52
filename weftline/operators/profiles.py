"""Whole profiles of features: bins with rates, lift, WOE, KS, IV and AUC of the raw values, for any number of features and sets at once.

Everything follows from counts per distinct value, (by..., value, good, bad):
the order of the bins from the sign of the correlation, the AUC of a prefix of
bins from running counts along the values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators.prefix import running
from weftline.operators.woe import ALPHA, LAMBDA
from weftline.sources.tables import kept


def value_table(rows: DataFrame, by: list[str], extra: dict[str, Column] | None = None) -> DataFrame:
    """(by..., value, good, bad, extra sums) of rows with value and target (1 is bad), written once."""
    t = F.col("target")
    return kept(rows.groupBy(*by, "value").agg(F.count_if(t == 0).alias("good"), F.count_if(t == 1).alias("bad"), *[F.sum(c).alias(n) for n, c in (extra or {}).items()]), "value-table")


def direction(values: DataFrame, by: list[str]) -> DataFrame:
    """(by..., slope): the sign's measure of the correlation of value and target, n * sum(xy) - sum(x) * sum(y), over rows with a value."""
    x, n = F.col("value").cast("double"), F.col("good") + F.col("bad")
    s = values.where("value IS NOT NULL").groupBy(*by).agg(F.sum(n).alias("n"), F.sum(x * F.col("bad")).alias("xy"), F.sum(x * n).alias("x"), F.sum("bad").alias("y"))
    return s.select(*by, (F.col("n") * F.col("xy") - F.col("x") * F.col("y")).alias("slope"))


def bins_of(values: DataFrame, by: list[str], extra: list[str] | None = None) -> DataFrame:
    """(by..., bin, good, bad, wins, extra): per bin, of a value_table with a bin; wins counts pairs of a bad above a good, ties half, goods of lower bins included."""
    ran = running(values.where("value IS NOT NULL"), "value", {"upto_good": "good"}, by)
    wins = F.sum(F.col("bad") * (F.col("upto_good") - F.col("good") / 2))
    return ran.groupBy(*by, "bin").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), wins.alias("wins"), *[F.sum(e).alias(e) for e in extra or []])


def profile(bins: DataFrame, by: list[str], totals: DataFrame, slopes: DataFrame, policy: str = "lambda", prefix_auc: bool = True) -> DataFrame:
    """Adds total, total_rate, brate, brate_cum, lift, woe, ks, iv (of the feature) and AUC to bins.

    totals has (by..., all_good, all_bad) and may count rows outside the bins.
    Bins are taken from below, from above where the correlation is negative.
    ``lambda``: ln((good% + 0.001) / (bad% + 0.001)); ``alpha``: ln(bad' / good')
    with 0.1 added to each count. auc_cum is of the raw values in the bins so
    far, or so far from the other end, flipped above one half, 0 for one class.
    """
    x = bins.join(F.broadcast(totals), by).join(F.broadcast(slopes), by)  # a row per feature and set
    w = W.partitionBy(*by)
    rank = F.when(F.col("slope") < 0, -F.col("bin")).otherwise(F.col("bin"))
    x = x.withColumn("rank", rank)
    sofar = w.orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumns({"total": F.col("good") + F.col("bad"), "cum_good": F.sum("good").over(sofar), "cum_bad": F.sum("bad").over(sofar)})
    rate = F.col("all_bad") / (F.col("all_good") + F.col("all_bad"))
    if policy == "alpha":
        k = F.count("*").over(w)
        g = (F.col("good") + ALPHA) / (F.sum("good").over(w) + ALPHA * k)
        b = (F.col("bad") + ALPHA) / (F.sum("bad").over(w) + ALPHA * k)
        woe, diff = F.ln(b / g), b - g
    else:
        g, b = F.col("good") / F.col("all_good"), F.col("bad") / F.col("all_bad")
        woe, diff = F.ln((g + LAMBDA) / (b + LAMBDA)), g - b
    x = x.withColumns({
        "total_rate": F.col("total") / (F.col("all_good") + F.col("all_bad")),
        "brate": F.try_divide(F.col("bad"), F.col("total")),
        "brate_cum": F.try_divide(F.col("cum_bad"), F.col("cum_bad") + F.col("cum_good")),
        "woe": woe,
        "ks": F.abs(F.col("cum_bad") / F.col("all_bad") - F.col("cum_good") / F.col("all_good")),
        "bin_iv": diff * woe,
    })
    x = x.withColumns({"lift": F.try_divide(F.col("brate"), rate), "iv": F.sum("bin_iv").over(w)})
    if prefix_auc:
        up, down = w.orderBy("bin").rowsBetween(W.unboundedPreceding, 0), w.orderBy("bin").rowsBetween(0, W.unboundedFollowing)
        below = F.sum("good").over(up) - F.col("good")
        from_below = F.try_divide(F.sum("wins").over(up), (F.sum("good").over(up) * F.sum("bad").over(up)).cast("double"))
        from_above = F.try_divide(F.sum("wins").over(down) - below * F.sum("bad").over(down), (F.sum("good").over(down) * F.sum("bad").over(down)).cast("double"))
        x = x.withColumn("auc", F.when(F.col("slope") > 0, from_below).otherwise(from_above))
        x = x.withColumn("auc_cum", F.coalesce(F.greatest("auc", 1 - F.col("auc")), F.lit(0.0)))
    return x.drop("rank", "cum_good", "cum_bad", "slope", "wins", "auc", "all_good", "all_bad")


def class_totals(values: DataFrame, by: list[str]) -> DataFrame:
    return values.groupBy(*by).agg(F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"))


def auc(bins: DataFrame, by: list[str]) -> DataFrame:
    """(by..., auc) of the raw values over all bins."""
    return bins.groupBy(*by).agg(F.try_divide(F.sum("wins"), (F.sum("good") * F.sum("bad")).cast("double")).alias("auc"))


def lambda_psi(counts: DataFrame, by: list[str], first: Column, n: str = "n") -> DataFrame:
    """(by..., psi) of (by..., bin, n) over two sets: shares of all rows, (p - q) * ln((p + 0.001) / (q + 0.001))."""
    w = W.partitionBy(*by)
    c = counts.groupBy(*by, "bin").agg(F.sum(F.when(first, F.col(n)).otherwise(0)).alias("a"), F.sum(F.when(first, 0).otherwise(F.col(n))).alias("z"))
    c = c.withColumns({"p": F.try_divide(F.col("a"), F.sum("a").over(w)), "q": F.try_divide(F.col("z"), F.sum("z").over(w))})
    return c.groupBy(*by).agg(F.sum((F.col("p") - F.col("q")) * F.ln((F.col("p") + LAMBDA) / (F.col("q") + LAMBDA))).alias("psi"))
