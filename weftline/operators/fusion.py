"""Fusion of scores: every combination of them as a model of its own, from statistics that all combinations share.

A linear fusion of any subset follows from the products of all scores with each other
and with the target, one aggregate over the rows. A logistic one takes a pass per
iteration for all subsets together, whose tasks add up weighted products; what reaches
the driver is a small matrix per subset, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.ranking import ks_auc
from weftline.sources.tables import kept

#: Subsets that rows are scored by in one pass; each makes a number per row.
SUBSETS_AT_ONCE = 256


def subsets(scores: list[str], least: int = 2, most: int | None = None) -> list[tuple[str, ...]]:
    """All combinations of at least so many scores, up to all of them, small ones first."""
    if len(scores) < least:
        raise ValueError(f"{len(scores)} scores can't be combined by {least}")
    return [c for n in range(least, (most or len(scores)) + 1) for c in combinations(scores, n)]


def standardised(df: DataFrame, scores: list[str], train: Column) -> dict[str, Column]:
    """Each score less its training mean, in deviations; a missing score is at the mean, a constant one 0."""
    told = df.where(train).agg(*[F.avg(s).alias(f"m_{s}") for s in scores], *[F.stddev_pop(s).alias(f"s_{s}") for s in scores]).first()
    z = lambda s: (F.col(s) - F.lit(told[f"m_{s}"])) / F.lit(told[f"s_{s}"]) if told[f"s_{s}"] else F.lit(0.0)
    return {s: F.coalesce(z(s), F.lit(0.0)) for s in scores}


def gram(df: DataFrame, columns: dict[str, Column], target: Column) -> np.ndarray:
    """Sums of the products of 1, the columns and the target with each other."""
    every = [F.lit(1.0), *columns.values(), target.cast("double")]
    n = len(every)
    at = [(i, j) for i in range(n) for j in range(i, n)]
    told = df.agg(*[F.coalesce(F.sum(every[i] * every[j]), F.lit(0.0)).alias(f"g_{i}_{j}") for i, j in at]).first()
    out = np.zeros((n, n))
    for (i, j), v in zip(at, told, strict=True):
        out[i, j] = out[j, i] = float(v)
    return out


def least_squares(products: np.ndarray, scores: list[str], chosen: list[tuple[str, ...]]) -> dict[tuple[str, ...], np.ndarray]:
    """For each subset its constant and weights, the shortest of the best ones where scores depend on each other."""
    out = {}
    for c in chosen:
        at = [0, *[1 + scores.index(s) for s in c]]
        out[c] = np.linalg.lstsq(products[np.ix_(at, at)], products[at, -1], rcond=1e-12)[0]
    return out


def logistic(df: DataFrame, columns: dict[str, Column], target: Column, chosen: list[tuple[str, ...]], iterations: int = 8, ridge: float = 1e-9) -> dict[tuple[str, ...], np.ndarray]:
    """For each subset the constant and weights of a logistic model, by Newton's steps."""
    scores = list(columns)
    at = [[0, *[1 + scores.index(s) for s in c]] for c in chosen]
    rows = kept(df.select(F.array(F.lit(1.0), *columns.values()).alias("x"), target.cast("double").alias("y")), "fusion-rows")
    weights = [np.zeros(len(a)) for a in at]
    places = np.cumsum([0, *[len(a) * (len(a) + 1) for a in at]])
    for _ in range(iterations):
        now = [w.copy() for w in weights]

        def run(batches: Iterator[pa.RecordBatch], now: list[np.ndarray] = now) -> Iterator[pa.RecordBatch]:
            total = np.zeros(places[-1])
            for batch in batches:
                x, y = batch.column(0).flatten().to_numpy().reshape(-1, len(scores) + 1), batch.column(1).to_numpy()
                for k, a in enumerate(at):
                    mine = x[:, a]
                    p = 1 / (1 + np.exp(-mine @ now[k]))
                    total[places[k] : places[k + 1]] += np.column_stack([(mine * (p * (1 - p))[:, None]).T @ mine, mine.T @ (y - p)]).reshape(-1)
            yield pa.record_batch([pa.array(np.arange(places[-1])), pa.array(total)], names=["place", "v"])

        told = rows.mapInArrow(run, "place bigint, v double").groupBy("place").agg(F.sum("v").alias("v")).toPandas()
        total = np.zeros(places[-1])
        total[told["place"].to_numpy()] = told["v"].to_numpy()
        for k, a in enumerate(at):
            step = total[places[k] : places[k + 1]].reshape(len(a), len(a) + 1)
            weights[k] = weights[k] + np.linalg.lstsq(step[:, :-1] + ridge * np.eye(len(a)), step[:, -1], rcond=1e-12)[0]
    return dict(zip(chosen, weights, strict=True))


def measured(df: DataFrame, columns: dict[str, Column], weights: dict[tuple[str, ...], np.ndarray], target: str, part: str) -> DataFrame:
    """(n_scores, scores, part, ks, auc) of every subset's score, ties to six digits."""
    rows = df.select(F.col(part).alias("part"), F.col(target).cast("int").alias("y"), *[c.alias(n) for n, c in columns.items()])
    told, every = None, list(weights.items())
    for i in range(0, len(every), SUBSETS_AT_ONCE):
        each = []
        for c, w in every[i : i + SUBSETS_AT_ONCE]:
            score = F.lit(float(w[0]))
            for s, v in zip(c, w[1:], strict=True):
                score = score + F.lit(float(v)) * F.col(s)
            each.append(F.struct(F.lit(len(c)).alias("n_scores"), F.lit("+".join(c)).alias("scores"), F.round(score, 6).alias("score")))
        counted = rows.select("part", "y", F.inline(F.array(*each))).groupBy("n_scores", "scores", "part", "score")
        counted = counted.agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1"))
        told = counted if told is None else told.unionByName(counted)
    return ks_auc(kept(told, "fusion-scores"), ["n_scores", "scores", "part"])
