"""Boosted trees on histograms, for a whole grid of settings at once.

Rows are binned once and put together to cells: rows whose bins and set agree are one
row with its counts of both classes. A split of all trees of all settings is one pass
over the cells: each task adds up gradients by (feature, bin) as products of matrices
with a column per model, tasks' sums meet in one aggregate, and what reaches the driver
is a number per model, feature and bin, however many rows there are.

Models that differ in the number of trees only are one model, scored on the way.
Trees grow by leaves: of all leaves the one whose best split gains most is split. A
missing value's bin is 0 and goes left. With T(G) = sign(G) * max(|G| - alpha, 0), a
split gains T(GL)^2 / (HL + lambda) + T(GR)^2 / (HR + lambda) - T(G)^2 / (H + lambda)
and a leaf says -rate * T(G) / (H + lambda). Among equal gains (to nine digits) the
earlier leaf, feature and bin is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.ranking import ks_auc
from weftline.sources.tables import kept

#: Trees that are put on top of stored margins in a pass before margins are stored anew.
PENDING = 16


@dataclass(frozen=True)
class Setting:
    """leaves per tree, penalties on leaves (first and second order), learning rate, rows that a leaf has at least."""

    leaves: int
    alpha: float
    lam: float
    rate: float
    least_rows: int = 1


@dataclass
class Tree:
    """One tree of each model: splits in order, (leaf, feature, bin, gain, rows, g, h) per model, and the leaves' values and rows."""

    splits: list[np.ndarray] = field(default_factory=list)
    values: np.ndarray | None = None
    stats: list[np.ndarray] = field(default_factory=list)


@dataclass
class Ensemble:
    """What fit() gives: base margin, trees in order, and cells with margins of the stages."""

    features: list[str]
    settings: list[Setting]
    base: float
    trees: list[Tree]

    def nodes(self) -> list[tuple]:
        """(model, tree, split, leaf, feature, bin, gain, rows, g, h) of every split."""
        out = []
        for t, tree in enumerate(self.trees):
            for k, (where, told) in enumerate(zip(tree.splits, tree.stats, strict=True)):
                for m in range(len(self.settings)):
                    leaf, f, b = (int(x) for x in where[m])
                    if f >= 0:
                        out.append((m, t, k, leaf, self.features[f], b, *(float(x) for x in told[m])))
        return out


NODES = "model int, tree int, split int, leaf int, feature string, bin int, gain double, rows double, g double, h double"


def cells(df: DataFrame, bins: dict[str, Column], target: str, part: str) -> DataFrame:
    """(bins, part, n0, n1): rows of equal bins and set as one, written once."""
    counted = df.groupBy(F.array(*[c.cast("int").alias(n) for n, c in bins.items()]).alias("bins"), F.col(part).alias("part"))
    return kept(counted.agg(F.sum((F.col(target) == 0).cast("long")).alias("n0"), F.sum((F.col(target) == 1).cast("long")).alias("n1")), "boost-cells")


def _soft(g: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def _leaves(x: np.ndarray, splits: list[np.ndarray], n_models: int) -> np.ndarray:
    """The leaf of each row in each model's tree so far."""
    leaf = np.zeros((len(x), n_models), dtype=np.int8)
    for k, where in enumerate(splits):
        at, f, b = where.T
        leaf[(leaf == at) & (f >= 0) & (x[:, np.maximum(f, 0)] > b)] = k + 1
    return leaf


def _margins(x: np.ndarray, start: np.ndarray, trees: list[Tree]) -> np.ndarray:
    out = start.copy()
    for tree in trees:
        out += np.take_along_axis(tree.values, _leaves(x, tree.splits, out.shape[1]).astype(np.int64).T, axis=1).T
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _sums(state: DataFrame, base: float, n_models: int, n_features: int, n_bins: int, trees: list[Tree], splits: list[np.ndarray], leaf: int, stored: bool) -> np.ndarray:
    """[model, feature, bin, (g, h, rows)] over the training cells of one leaf of the tree that is growing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, n_features, n_bins, n_models))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0), n_features)
            n0, n1 = (batch.column(i).to_numpy().astype(float)[:, None] for i in (1, 2))
            start = _matrix(batch.column(3), n_models) if stored else np.full((len(x), n_models), base)
            p = 1 / (1 + np.exp(-_margins(x, start, trees)))
            inside = (_leaves(x, splits, n_models) == leaf).astype(float)
            g, h, n = ((n0 + n1) * p - n1) * inside, (n0 + n1) * p * (1 - p) * inside, (n0 + n1) * inside
            for f in range(n_features):
                hot = (x[:, f][None, :] == np.arange(n_bins)[:, None]).astype(float)
                for i, v in enumerate((g, h, n)):
                    total[i, f] += hot @ v
        place = np.flatnonzero(total[2].reshape(-1))
        yield pa.record_batch([pa.array(place), *[pa.array(total[i].reshape(-1)[place]) for i in range(3)]], names=["place", "g", "h", "n"])

    columns = ["bins", "n0", "n1", "margins"] if stored else ["bins", "n0", "n1"]
    told = state.where("part = 'train'").select(*columns).mapInArrow(run, "place bigint, g double, h double, n double")
    rows = told.groupBy("place").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toPandas()  # models x features x bins at most
    out = np.zeros((n_features * n_bins * n_models, 3))
    out[rows["place"].to_numpy()] = rows[["g", "h", "n"]].to_numpy()
    return out.reshape(n_features, n_bins, n_models, 3).transpose(2, 0, 1, 3)


def _best(hist: np.ndarray, settings: list[Setting]) -> np.ndarray:
    """[model, (feature, bin, gain, rows, g, h)] of a leaf's best split; feature -1 where none gains."""
    alpha, lam = (np.array([getattr(s, k) for s in settings])[:, None, None] for k in ("alpha", "lam"))
    least = np.array([s.least_rows for s in settings])[:, None, None]
    total = hist[:, :1].sum(axis=2, keepdims=True)  # of the first feature: every row has a bin
    left = hist.cumsum(axis=2)
    right = total - left
    score = lambda s: _soft(s[..., 0], alpha) ** 2 / (s[..., 1] + lam)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = score(left) + score(right) - score(total)
    gain = np.where((left[..., 2] >= least - 0.5) & (right[..., 2] >= least - 0.5) & np.isfinite(gain), np.round(gain, 9), -1.0)
    flat = gain.reshape(len(settings), -1)
    at = flat.argmax(axis=1)
    top = flat[np.arange(len(settings)), at]
    f, b = np.divmod(at, hist.shape[2])
    none = top <= 0
    return np.column_stack([np.where(none, -1, f), np.where(none, 0, b), np.where(none, -1, top), total[:, 0, 0, 2], total[:, 0, 0, 0], total[:, 0, 0, 1]])


def fit(cell: DataFrame, features: list[str], n_bins: int, settings: list[Setting], rounds: int) -> tuple[Ensemble, DataFrame]:
    """The models of all settings after so many trees, learned from the cells of part 'train', and the cells as they are stored."""
    counted = cell.where("part = 'train'").agg(F.sum("n0"), F.sum("n1")).first()
    n0, n1 = (float(c or 0) for c in counted)
    base = float(np.log(n1 / n0)) if n0 and n1 else 0.0
    models, deep = len(settings), max(s.leaves for s in settings)
    want = np.array([s.leaves for s in settings])
    trees: list[Tree] = []
    state, done = cell, 0
    for _ in range(rounds):
        tree = Tree()
        pending = trees[done:]
        hists: list[np.ndarray] = []
        for k in range(deep - 1):
            fresh = _sums(state, base, models, len(features), n_bins, pending, tree.splits, k, done > 0)
            if k:  # the new leaf has what it has, the leaf that was split what is left of it
                split = tree.splits[-1][:, 0]
                for m in range(models):
                    if tree.splits[-1][m, 1] >= 0:
                        hists[split[m]][m] -= fresh[m]
            hists.append(fresh)
            best = np.stack([_best(h, settings) for h in hists])  # leaf, model, ...
            leaf = best[:, :, 2].argmax(axis=0)
            chosen = best[leaf, np.arange(models)]
            chosen[want < k + 2, 0] = -1
            tree.splits.append(np.column_stack([leaf, chosen[:, :2]]).astype(np.int64))
            tree.stats.append(chosen[:, 2:])
        last = _sums(state, base, models, len(features), n_bins, pending, tree.splits, deep - 1, done > 0)
        split = tree.splits[-1][:, 0]
        for m in range(models):
            if tree.splits[-1][m, 1] >= 0:
                hists[split[m]][m] -= last[m]
        hists.append(last)
        ends = np.stack([h[:, 0].sum(axis=1) for h in hists], axis=1)  # model, leaf, (g, h, rows)
        alpha, lam, rate = (np.array([getattr(s, n) for s in settings])[:, None] for n in ("alpha", "lam", "rate"))
        with np.errstate(divide="ignore", invalid="ignore"):
            tree.values = np.where(ends[..., 2] > 0.5, -rate * _soft(ends[..., 0], alpha) / (ends[..., 1] + lam), 0.0)
        tree.values = np.nan_to_num(tree.values, nan=0.0, posinf=0.0, neginf=0.0)
        trees.append(tree)
        if len(trees) - done >= PENDING:
            state, done = kept(with_margins(state, base, len(features), models, trees[done:], done > 0), "boost-margins"), len(trees)
    return Ensemble(features, settings, base, trees), cell


def with_margins(state: DataFrame, base: float, n_features: int, n_models: int, trees: list[Tree], stored: bool) -> DataFrame:
    """Cells with the margins of all models."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0), n_features)
            start = _matrix(batch.column(4), n_models) if stored else np.full((len(x), n_models), base)
            out = _margins(x, start, trees)
            margins = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * n_models, pa.int32()), pa.array(out.reshape(-1)))
            yield pa.record_batch([*batch.columns[:4], margins], names=["bins", "part", "n0", "n1", "margins"])

    columns = ["bins", "part", "n0", "n1", *["margins"] * stored]
    return state.select(*columns).mapInArrow(run, "bins array<int>, part string, n0 bigint, n1 bigint, margins array<double>")


def staged(model: Ensemble, cell: DataFrame, stages: list[int]) -> DataFrame:
    """(model, trees, part, score, n0, n1): counts per distinct probability of each model after each number of trees."""
    n_features, n_models = len(model.features), len(model.settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, margin, before = _matrix(batch.column(0), n_features), np.full((batch.num_rows, n_models), model.base), 0
            for stage in stages:
                margin = _margins(x, margin, model.trees[before:stage])
                before = stage
                p = np.round(1 / (1 + np.exp(-margin)), 9)
                rows = np.repeat(np.arange(len(x)), n_models)
                yield pa.record_batch(
                    [pa.array(np.tile(np.arange(n_models, dtype=np.int32), len(x))), pa.array(np.full(len(rows), stage, dtype=np.int32)), batch.column(1).take(pa.array(rows)), pa.array(p.reshape(-1)), batch.column(2).take(pa.array(rows)), batch.column(3).take(pa.array(rows))],
                    names=["model", "trees", "part", "score", "n0", "n1"],
                )

    told = cell.select("bins", "part", "n0", "n1").mapInArrow(run, "model int, trees int, part string, score double, n0 bigint, n1 bigint")
    return told.groupBy("model", "trees", "part", "score").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def measured(model: Ensemble, cell: DataFrame, stages: list[int]) -> DataFrame:
    """(model, trees, part, ks, auc)."""
    by = ["model", "trees", "part"]
    return ks_auc(kept(staged(model, cell, stages), "boost-scores"), by)


def importances(nodes: DataFrame) -> DataFrame:
    """(model, feature, splits, gain, place): how often a feature splits and what it gains, features without a split left out; place by gain."""
    from pyspark.sql import Window as W

    told = nodes.groupBy("model", "feature").agg(F.count("*").alias("splits"), F.sum("gain").alias("gain"))
    return told.withColumn("place", F.row_number().over(W.partitionBy("model").orderBy(F.desc(F.round("gain", 6)), "feature")))


def probability(model: Ensemble, which: int, trees: int, bins: dict[str, Column]) -> Column:
    """One model's probability as an expression over bin columns; needs no Python."""
    margin = F.lit(model.base)
    for tree in model.trees[:trees]:
        leaf: Column = F.lit(0)
        for k, where in enumerate(tree.splits):
            at, f, b = (int(x) for x in where[which])
            if f >= 0:
                leaf = F.when((leaf == at) & (bins[model.features[f]] > b), k + 1).otherwise(leaf)
        value = F.lit(float(tree.values[which][0]))
        for k in range(1, tree.values.shape[1]):
            value = F.when(leaf == k, float(tree.values[which][k])).otherwise(value)
        margin = margin + value
    return 1 / (1 + F.exp(-margin))
