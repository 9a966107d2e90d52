"""Training helpers on pyspark.ml: a small grid of boosted trees, and fusion of score combinations."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.ranking import ks_auc, per_score
from weftline.sources.tables import kept


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="x", handleInvalid="keep").transform(df)


def _measured(scored: DataFrame, target: str, train: str) -> DataFrame:
    """(train, ks, auc) of column probability."""
    rows = scored.withColumn("p", F.round(vector_to_array("probability")[1], 6))
    return ks_auc(per_score(rows, "p", target, [train]), [train])


def grid(df: DataFrame, features: list[str], target: str, train: str, settings: list[dict], seed: int = 42) -> DataFrame:
    """(setting, train, ks, auc) for each setting of the trees; the rows are assembled once."""
    x = _assembled(kept(df, "grid-rows"), features)
    out = []
    for i, s in enumerate(settings):
        model = GBTClassifier(featuresCol="x", labelCol=target, seed=seed, **s).fit(x.where(F.col(train) == 1))
        out.append(_measured(model.transform(x), target, train).withColumn("setting", F.lit(i)))
    return reduce(DataFrame.unionByName, out)


def scored(df: DataFrame, features: list[str], target: str, train: str, path: str, seed: int = 42, **settings) -> DataFrame:
    """df's rows with a model's probability p and the set they belong to, written to ``path`` and read back."""
    x = _assembled(kept(df, "rows-to-score"), features)
    model = GBTClassifier(featuresCol="x", labelCol=target, seed=seed, **settings).fit(x.where(F.col(train) == 1))
    part = F.when(F.col(train) == 1, "train").otherwise("valid").alias("sample_type")
    model.transform(x).select(*df.columns, vector_to_array("probability")[1].alias("p"), part).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def importances(df: DataFrame, features: list[str], target: str, seed: int = 42, **settings) -> list[tuple[str, float]]:
    model = GBTClassifier(featuresCol="x", labelCol=target, seed=seed, **settings).fit(_assembled(kept(df, "rows-to-fit"), features))
    return sorted(zip(features, model.featureImportances.toArray().tolist(), strict=True), key=lambda x: -x[1])


def fusion(df: DataFrame, scores: list[str], target: str, train: str, size: int) -> DataFrame:
    """(scores, train, ks, auc) of a logistic model for every combination of ``size`` scores; the rows are written once, as every model reads them several times."""
    df, out = kept(df, "fusion-rows"), []
    for chosen in combinations(scores, size):
        x = _assembled(df, list(chosen))
        model = LogisticRegression(featuresCol="x", labelCol=target, maxIter=5).fit(x.where(F.col(train) == 1))
        out.append(_measured(model.transform(x), target, train).withColumn("scores", F.lit("+".join(chosen))))
    return reduce(DataFrame.unionByName, out)
