"""Boosted trees against a plain version that looks at one row and one model at a time."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import boosting
from weftline.operators.boosting import Setting

FEATURES, BINS = ["a", "b", "c"], 5


def rows(seed, n=400):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a, b, c = rng.randrange(BINS), rng.randrange(BINS), 2  # c says nothing
        y = int(rng.random() < 0.15 + 0.12 * a + (0.3 if b == 4 and a < 2 else 0))
        out.append((a, b, c, y, rng.choice(["train", "train", "test", "valid"])))
    return out


def plain(data, s, rounds):
    """Margins of the rows and the splits of one model."""
    soft = lambda g: math.copysign(max(abs(g) - s.alpha, 0), g)
    train = [i for i, r in enumerate(data) if r[4] == "train"]
    bad = sum(data[i][3] for i in train)
    margin = [math.log(bad / (len(train) - bad))] * len(data)
    told = []
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g, h = [p[i] - data[i][3] for i in range(len(data))], [x * (1 - x) for x in p]
        leaf = [0] * len(data)
        for k in range(s.leaves - 1):
            best = None
            for at in range(k + 1):
                mine = [i for i in train if leaf[i] == at]
                score = lambda ids: soft(sum(g[i] for i in ids)) ** 2 / (sum(h[i] for i in ids) + s.lam)  # noqa: B023, E731
                for f in range(3):
                    for b in range(BINS):
                        left, right = [i for i in mine if data[i][f] <= b], [i for i in mine if data[i][f] > b]
                        if len(left) >= s.least_rows and len(right) >= s.least_rows:
                            gain = round(score(left) + score(right) - score(mine), 9)
                            if gain > 0 and (best is None or gain > best[0]):
                                best = (gain, at, f, b, len(mine))
            if best is None:
                break
            told.append(best)
            leaf = [k + 1 if leaf[i] == best[1] and data[i][best[2]] > best[3] else leaf[i] for i in range(len(data))]
        for at in set(leaf):
            mine = [i for i in train if leaf[i] == at]
            v = -s.rate * soft(sum(g[i] for i in mine)) / (sum(h[i] for i in mine) + s.lam) if mine else 0.0
            margin = [m + v if leaf[i] == at else m for i, m in enumerate(margin)]
    return margin, told


SETTINGS = [Setting(2, 0, 0, 0.3), Setting(3, 1, 2, 0.3, 20), Setting(4, 0, 1, 0.1, 5), Setting(3, 1000, 0, 0.3)]


@pytest.mark.parametrize("pending", [16, 2])
def test_all_settings_against_a_plain_version(spark, monkeypatch, pending):
    monkeypatch.setattr(boosting, "PENDING", pending)
    data = rows(pending)
    df = spark.createDataFrame(data, "a int, b int, c int, y int, part string").repartition(3)
    cell = boosting.cells(df, {f: F.col(f) for f in FEATURES}, "y", "part")
    model, cell = boosting.fit(cell, FEATURES, BINS, SETTINGS, 5)
    nodes = {}
    for m, tree, split, leaf, feature, b, gain, n, *_ in model.nodes():
        nodes.setdefault(m, []).append((gain, leaf, FEATURES.index(feature), b, n))
    scores = {(r.model, r.part): {} for r in boosting.staged(model, cell, [5]).collect()}
    for r in boosting.staged(model, cell, [5]).collect():
        scores[(r.model, r.part)][r.score] = (r.n0, r.n1)
    for i, s in enumerate(SETTINGS):
        margin, told = plain(data, s, 5)
        got = nodes.get(i, [])
        assert [x[1:4] for x in got] == [x[1:4] for x in told] and np.allclose([x[0] for x in got], [x[0] for x in told], atol=1e-7) and [x[4] for x in got] == [x[4] for x in told]
        for part in ("train", "test", "valid"):
            want = {}
            for r, m in zip(data, margin, strict=True):
                if r[4] == part:
                    p = round(1 / (1 + math.exp(-m)), 7)
                    n0, n1 = want.get(p, (0, 0))
                    want[p] = (n0 + 1 - r[3], n1 + r[3])
            merged = {}
            for p, (n0, n1) in scores[(i, part)].items():
                a, b = merged.get(round(p, 7), (0, 0))
                merged[round(p, 7)] = (a + n0, b + n1)
            assert merged == want
        one = df.select(boosting.probability(model, i, 5, {f: F.col(f) for f in FEATURES}).alias("p"), "a", "b", "c", "y", "part").collect()
        by = {tuple(r[:5]): m for r, m in zip(data, margin, strict=True)}
        assert all(abs(r.p - 1 / (1 + math.exp(-by[tuple(r)[1:]]))) < 1e-9 for r in one)
    assert 3 not in nodes  # a penalty that nothing is worth


def test_without_training_rows_or_classes_nothing_splits(spark):
    df = spark.createDataFrame([(1, 0, 0, 1, "test"), (2, 0, 0, 0, "valid")], "a int, b int, c int, y int, part string")
    for d in (df, df.limit(0), df.withColumn("part", F.lit("train")).withColumn("y", F.lit(1))):
        model, cell = boosting.fit(boosting.cells(d, {f: F.col(f) for f in FEATURES}, "y", "part"), FEATURES, BINS, SETTINGS[:2], 2)
        assert model.nodes() == [] and model.base == 0.0


def test_importances_leave_out_what_never_splits(spark):
    nodes = spark.createDataFrame([(0, 0, 0, 0, "a", 1, 2.0, 9.0, 0.0, 1.0), (0, 1, 0, 0, "b", 1, 5.0, 9.0, 0.0, 1.0), (0, 2, 0, 0, "a", 2, 1.0, 9.0, 0.0, 1.0)], boosting.NODES)
    assert [tuple(r) for r in boosting.importances(nodes).orderBy("place").collect()] == [(0, "b", 1, 5.0, 1), (0, "a", 2, 3.0, 2)]
