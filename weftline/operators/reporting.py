"""A model's report as tables: what the sets hold, how well the score ranks and drifts, and its bins by three sets of cut points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import binning, profiles
from weftline.operators.ranking import ks_auc
from weftline.sources.tables import kept

BINS = 10


def numbers(values: DataFrame) -> DataFrame:
    """(section, name, value) of a value_table with grp train and valid: counts and bad rates, KS, AUC and PSI of the score."""
    g, b = F.sum("good"), F.sum("bad")
    sums = values.groupBy("grp").agg(g.alias("good"), b.alias("bad"))
    whole = sums.unionByName(sums.agg(g.alias("good"), b.alias("bad")).withColumn("grp", F.lit("total")))
    counted = whole.select(F.concat(F.lit("summary "), "grp").alias("section"), F.inline(F.array(*[F.struct(F.lit(n).alias("name"), c.cast("double").alias("value")) for n, c in (("total", F.col("good") + F.col("bad")), ("good", F.col("good")), ("bad", F.col("bad")), ("bad_rate", F.try_divide(F.col("bad"), F.col("good") + F.col("bad"))))])))
    ranked = ks_auc(values.select("grp", F.col("value").alias("score"), F.col("good").alias("n0"), F.col("bad").alias("n1")).where("score IS NOT NULL"), ["grp"])
    told = ranked.select(F.lit("score").alias("section"), F.inline(F.array(F.struct(F.concat(F.lit("ks_"), "grp").alias("name"), F.col("ks").alias("value")), F.struct(F.concat(F.lit("auc_"), "grp").alias("name"), F.col("auc").alias("value")))))
    rows = values.withColumn("n", F.col("good") + F.col("bad"))
    edges = binning.frequency_edges(rows.where("grp = 'train' AND value IS NOT NULL").select(F.lit("score").alias("feature"), "value", F.col("n").alias("n_rows")), BINS).first()
    if edges is None:
        return counted.unionByName(told)
    at = F.array(*[F.lit(float(e)) for e in edges.edges])
    binned = rows.select(F.lit("score").alias("feature"), "grp", "n", binning.bin_of(F.coalesce("value", F.lit(-999.0)), at).alias("bin"))
    psi = profiles.lambda_psi(binned, ["feature"], F.col("grp") == "train")
    return counted.unionByName(told).unionByName(psi.select(F.lit("score").alias("section"), F.lit("psi").alias("name"), F.col("psi").alias("value")))


def cut_points(values: DataFrame) -> dict[str, list[float]]:
    """Edges by the training rows' quantiles, by equal parts of their range, and by the validation rows' quantiles; ends are open."""
    known = values.where("value IS NOT NULL").withColumn("n", F.col("good") + F.col("bad"))
    found = {r.grp: r.edges for r in binning.quantile_edges(known, BINS, ["grp"], rows="n").collect()}  # two rows
    if "train" in found:
        low, high = found["train"][0], found["train"][-1]
        found["equal"] = [low + i * (high - low) / BINS for i in range(BINS + 1)]
    return {k: [float("-inf"), *e[1:-1], float("inf")] for k, e in found.items()}


def bins(values: DataFrame) -> DataFrame:
    """(scheme, grp, bin, ...): profiles of both sets by each of the cut points."""
    schemes = F.array(*[F.struct(F.lit(k).alias("scheme"), F.array(*[F.lit(float(e)) for e in edges]).alias("edges")) for k, edges in cut_points(values).items()])
    rows = values.select("grp", "value", "good", "bad", F.inline(schemes)).where("value IS NOT NULL")
    rows = kept(rows.withColumn("bin", binning.bin_of(F.col("value"), F.col("edges"))).drop("edges"), "report-values")
    by = ["scheme", "grp"]
    return profiles.profile(kept(profiles.bins_of(rows, by), "report-bins"), by, profiles.class_totals(rows, by), profiles.direction(rows, by))
