"""Weight of evidence and information value over (feature, bin) counts, under named policies.

Policies differ in what they do with empty cells and in their sign:
guard1  ln(good% / bad%), 1 where bad% is 0 and -1 where good% is 0
eps     ln(bad% / good%), shares of 0 become 1e-4
lambda  ln((good% + 0.001) / (bad% + 0.001))
alpha   ln(bad' / good') with 0.1 added to every count
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EPS, LAMBDA, ALPHA = 1e-4, 0.001, 0.1


def weights(target: Column, by_class: tuple[float, float] | None = None, column: Column | None = None, good_event: int = 0) -> Column:
    """1, a weight per class (good, bad), or a column."""
    if column is not None:
        return column.cast("double")
    if by_class:
        return F.when(target == good_event, F.lit(float(by_class[0]))).otherwise(F.lit(float(by_class[1])))
    return F.lit(1.0)


def counts(rows: DataFrame, by: list[str], target: str = "target", weight: Column | None = None, good_event: int = 0) -> DataFrame:
    """(by..., good, bad): weighted sums of both classes; one aggregate for all features."""
    w = F.lit(1) if weight is None else weight
    t = F.col(target)
    return rows.groupBy(*by).agg(F.sum(F.when(t == good_event, w).otherwise(0)).alias("good"), F.sum(F.when(t != good_event, w).otherwise(0)).alias("bad"))


def guard1(a: Column, b: Column, default: float = 1.0) -> Column:
    """ln(a / b), ``default`` where b is 0 and minus that where a is 0."""
    return F.when(b == 0, F.lit(default)).when(a == 0, F.lit(-default)).otherwise(F.ln(a / F.nullif(b, F.lit(0.0))))


def bin_table(found: DataFrame, policy: str = "guard1", feature: list[str] | None = None) -> DataFrame:
    """Adds total, bad_rate, odds, shares, woe and iv to (feature, bin, good, bad); bins without rows go."""
    w = W.partitionBy(*(feature or ["feature"]))
    x = found.where("good + bad > 0").withColumns({"total": F.col("good") + F.col("bad"), "good_sum": F.sum("good").over(w), "bad_sum": F.sum("bad").over(w)})
    share = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col(f"{c}_sum")), F.lit(0.0))
    x = x.withColumns({"good_pct": share("good"), "bad_pct": share("bad"), "total_pct": F.col("total") / (F.col("good_sum") + F.col("bad_sum")), "bad_rate": F.col("bad") / F.col("total"), "odds": F.try_divide(F.col("good").cast("double"), F.col("bad"))})
    g, b = F.col("good_pct"), F.col("bad_pct")
    if policy == "guard1":
        woe, diff = guard1(g, b), g - b
    elif policy == "eps":
        g, b = F.when(g == 0, EPS).otherwise(g), F.when(b == 0, EPS).otherwise(b)
        woe, diff = F.ln(b / g), b - g
    elif policy == "lambda":
        woe, diff = F.ln((g + LAMBDA) / (b + LAMBDA)), g - b
    elif policy == "alpha":
        bins = F.count("*").over(w)
        g, b = (F.col("good") + ALPHA) / (F.col("good_sum") + ALPHA * bins), (F.col("bad") + ALPHA) / (F.col("bad_sum") + ALPHA * bins)
        woe, diff = F.ln(b / g), b - g
    else:
        raise ValueError(f"unknown policy {policy!r}")
    return x.withColumn("woe", woe).withColumn("iv", diff * F.col("woe")).drop("good_sum", "bad_sum")


def information_value(table: DataFrame, feature: list[str] | None = None) -> DataFrame:
    return table.groupBy(*(feature or ["feature"])).agg(F.sum("iv").alias("iv"))


def monotone_choice(tables: DataFrame, by_majority: bool = False) -> DataFrame:
    """(feature, n, is_monotone): of (feature, n, bin, woe), the largest n whose woe rises or falls throughout, else the one that breaks least.

    What breaks are the falls or the rises, whichever sum is less; or, by
    majority, whichever are fewer, the falls where they are as many.
    """
    w = W.partitionBy("feature", "n").orderBy("bin")
    step = tables.withColumn("d", F.col("woe") - F.lag("woe").over(w))
    per = step.groupBy("feature", "n").agg(F.sum(F.greatest(F.col("d"), F.lit(0.0))).alias("up"), F.sum(F.greatest(-F.col("d"), F.lit(0.0))).alias("down"), F.count_if(F.col("d") >= 0).alias("rises"), F.count_if(F.col("d") < 0).alias("falls"))
    broken = F.when(F.col("rises") >= F.col("falls"), F.col("down")).otherwise(F.col("up")) if by_majority else F.least("up", "down")
    per = per.withColumn("broken", F.coalesce(broken, F.lit(0.0)))
    best = F.min(F.struct((F.col("broken") > 1e-12).cast("int").alias("bad"), F.when(F.col("broken") > 1e-12, F.col("broken")).otherwise(0.0).alias("broken"), (-F.col("n")).alias("m")))
    return per.groupBy("feature").agg(best.alias("b")).select("feature", (-F.col("b.m")).alias("n"), (F.col("b.bad") == 0).alias("is_monotone"))


def value_classes(long: DataFrame) -> DataFrame:
    """(feature, value, good, bad, rows) of (feature, value, target), target 1 bad; missing values are null."""
    return long.groupBy("feature", "value").agg(F.count_if(F.col("target") == 0).alias("good"), F.count_if(F.col("target") == 1).alias("bad"), F.count("*").alias("rows"))


def monotone_report(per: DataFrame, edges: DataFrame, most: int = 256) -> DataFrame:
    """(feature, n, bins, crossings, broken, reason, is_bad): the number of bins that monotone_choice would take by majority, and what to hold of it.

    per: value_classes; edges: (feature, n, edges), ``most`` different ones of a feature. Weights are of all rows, missing
    ones included, which have no bin of their own here. A feature that neither rises or
    falls throughout nor crosses zero exactly once is bad, and one without values.
    """
    from weftline.operators import binning

    counted = binning.counts_by_edges(per, edges, ["good", "bad"], most)
    told = bin_table(counted, feature=["feature", "n"]).where("bin > 0").select("feature", "n", "bin", "woe")
    w = W.partitionBy("feature", "n").orderBy("bin")  # n bins at most
    step = told.withColumns({"d": F.col("woe") - F.lag("woe").over(w), "crossed": (F.col("woe") * F.lag("woe").over(w) < 0).cast("int")})
    up, down = F.sum(F.greatest(F.col("d"), F.lit(0.0))), F.sum(F.greatest(-F.col("d"), F.lit(0.0)))
    broken = F.coalesce(F.when(F.count_if(F.col("d") >= 0) >= F.count_if(F.col("d") < 0), down).otherwise(up), F.lit(0.0))
    by = step.groupBy("feature", "n").agg(F.count("*").cast("int").alias("bins"), F.coalesce(F.sum("crossed"), F.lit(0)).cast("int").alias("crossings"), broken.alias("broken"))
    by = by.withColumn("broken", F.when(F.col("broken") > 1e-12, F.col("broken")).otherwise(0.0))
    best = by.groupBy("feature").agg(F.min(F.struct((F.col("broken") > 0).alias("o"), F.round("broken", 9).alias("p"), (-F.col("n")).alias("q"), "bins", "crossings", "broken")).alias("b"))
    reason = F.when(F.col("b.bins") < 2, "one bin").when(F.col("b.broken") == 0, "monotone").when(F.col("b.crossings") == 1, "crosses zero once").when(F.col("b.crossings") == 0, "never crosses zero").otherwise("crosses zero often")
    good = best.select("feature", (-F.col("b.q")).cast("int").alias("n"), "b.bins", "b.crossings", F.round("b.broken", 6).alias("broken"), reason.alias("reason"))
    every = per.select("feature").distinct().join(good, "feature", "left")
    return every.withColumns({"bins": F.coalesce("bins", F.lit(0)), "reason": F.coalesce("reason", F.lit("no values")), "is_bad": F.coalesce(F.col("reason").isin("never crosses zero", "crosses zero often"), F.lit(True))})
