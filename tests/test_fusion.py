"""Fusion of all subsets against fits of each by itself."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import fusion


def rows(n=500):
    rng = random.Random(3)
    out = []
    for _ in range(n):
        a, b = rng.gauss(5, 2), rng.gauss(-1, 1)
        c = a + b  # depends on the others
        y = int(rng.random() < 1 / (1 + np.exp(-(a - 5 + b + 1))))
        out.append((a if rng.random() > 0.1 else None, b, c, 3.0, y, rng.choice(["train", "test"])))
    return out


@pytest.fixture(scope="module")
def data(spark):
    got = rows()
    return got, spark.createDataFrame(got, "a double, b double, c double, flat double, y int, part string").repartition(3)


def matrix(got, z):
    train = [r for r in got if r[5] == "train"]
    x = np.array([[np.nan if v is None else v for v in r[:4]] for r in train])
    mean, dev = np.nanmean(x, axis=0), np.nanstd(x, axis=0)
    dev[dev == 0] = np.inf
    return np.nan_to_num((x - mean) / dev), np.array([r[4] for r in train], dtype=float)


def test_every_subset_is_the_fit_of_its_own(data):
    got, df = data
    z = fusion.standardised(df, ["a", "b", "c", "flat"], F.col("part") == "train")
    x, y = matrix(got, z)
    chosen = fusion.subsets(list(z))
    assert len(chosen) == 11 and chosen[0] == ("a", "b") and chosen[-1] == ("a", "b", "c", "flat")
    train = df.where("part = 'train'")
    linear = fusion.least_squares(fusion.gram(train, z, F.col("y")), list(z), chosen)
    curved = fusion.logistic(train, z, F.col("y"), chosen, iterations=12)
    for c in chosen:
        mine = np.column_stack([np.ones(len(x)), x[:, [list(z).index(s) for s in c]]])
        want = np.linalg.lstsq(mine, y, rcond=None)[0]
        assert np.allclose(mine @ linear[c], mine @ want, atol=1e-7)
        p = 1 / (1 + np.exp(-mine @ curved[c]))
        assert np.abs(mine.T @ (y - p)).max() < 1e-4  # the likelihood's slope


def test_a_closed_case(spark):
    df = spark.createDataFrame([(0.0, 0), (0.0, 0), (0.0, 1), (1.0, 1), (1.0, 1), (1.0, 0)], "s double, y int")
    w = fusion.logistic(df, {"s": F.col("s")}, F.col("y"), [("s",)], iterations=20)[("s",)]
    assert np.allclose(w, [np.log(1 / 2), np.log(2) - np.log(1 / 2)], atol=1e-6)
    w = fusion.least_squares(fusion.gram(df, {"s": F.col("s")}, F.col("y")), ["s"], [("s",)])[("s",)]
    assert np.allclose(w, [1 / 3, 1 / 3])


def test_measures_in_blocks(data, monkeypatch):
    _, df = data
    z = fusion.standardised(df, ["a", "b", "c"], F.col("part") == "train")
    weights = {c: np.arange(len(c) + 1.0) for c in fusion.subsets(list(z))}
    once = {tuple(r) for r in fusion.measured(df, z, weights, "y", "part").collect()}
    monkeypatch.setattr(fusion, "SUBSETS_AT_ONCE", 3)
    assert {tuple(r) for r in fusion.measured(df, z, weights, "y", "part").collect()} == once and len(once) == 8
    with pytest.raises(ValueError, match="can't be combined"):
        fusion.subsets(["a"])
