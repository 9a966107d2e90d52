"""Feature gates and correlation pruning on small tables of features."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gate(stats: DataFrame, least_iv: float = 0.01, least_ratio: float = 0.7, most_csi: float = 0.2) -> DataFrame:
    """Features with enough information in both sets, that keep it and don't drift: of (feature, iv_train, iv_valid, csi)."""
    return stats.where((F.col("iv_train") > least_iv) & (F.col("iv_valid") > least_iv) & (F.try_divide(F.col("iv_valid"), F.col("iv_train")) > least_ratio) & (F.col("csi") < most_csi))


def correlated_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(first, second, corr) of all pairs, from one aggregate."""
    pairs = list(combinations(columns, 2))
    wide = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])))


def prune(ranked: DataFrame, pairs: DataFrame, most: float = 0.8) -> DataFrame:
    """(feature, selected): of a pair too much alike the one with less information goes, even if its partner goes too."""
    high = pairs.where(F.abs("corr") >= most)
    both = high.select(F.col("first").alias("feature"), F.col("second").alias("partner")).union(high.select("second", "first"))
    other = ranked.select(F.col("feature").alias("partner"), F.col("iv").alias("partner_iv"))
    lost = both.join(other, "partner").join(ranked, "feature").where((F.col("partner_iv") > F.col("iv")) | ((F.col("partner_iv") == F.col("iv")) & (F.col("partner") < F.col("feature")))).select("feature").distinct()
    return ranked.select("feature").join(lost.withColumn("out", F.lit(True)), "feature", "left").select("feature", F.col("out").isNull().alias("selected"))


def gate_and_prune(stats: DataFrame, pairs: DataFrame, most: float = 0.8) -> DataFrame:
    """(feature, iv_train, iv_valid, csi, gated, selected): the gate first, then only pairs of gated features decide."""
    good = gate(stats)
    left = prune(good.select("feature", F.col("iv_train").alias("iv")), pairs, most)
    return stats.join(left, "feature", "left").select("feature", "iv_train", "iv_valid", "csi", F.col("selected").isNotNull().alias("gated"), F.coalesce("selected", F.lit(False)).alias("selected"))
