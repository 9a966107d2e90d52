import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import toxicity as T
from weftline.llm.runtime import held_out

SF = "/root/testdata/sf0.01"
WORDS = "alpha beta gamma delta river stone cloud table paper light".split()


def corpus(n=600):
    rng = np.random.default_rng(1)
    docs, labels = [], []
    for i in range(n):
        words = list(rng.choice(WORDS, 30))
        bad = i % 4 == 0
        if bad:
            words[int(rng.integers(30))] = "grobnik" + str(rng.choice(["en", "ov", "is"]))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_learned_lexicon_generalises(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = T.fit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = d.select("doc_id", held_out(F.col("doc_id")).alias("h"), T.score(F.col("text"), model).alias("t")).select("doc_id", "h", "t.*").toPandas()
    out = got[got.h]
    assert len(out) > 100
    assert ((out.doc_id % 4 == 0) == (out.predicted == 1)).mean() > 0.97
    assert got.score.between(0, 1).all() and ((got.score >= T.THRESHOLD) == (got.predicted == 1)).all()


def test_nulls_empties_and_no_labels(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 50_000), (None, "idiot"), (3, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = T.fit(d, none)
    got = d.select(T.score(F.col("text"), model).alias("t")).select("t.*").collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert d.limit(0).select(T.score(F.col("text"), model)).count() == 0


def test_calibration_is_monotone():
    rng = np.random.default_rng(0)
    s = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-s))).astype(float)
    cal = T.Isotonic().fit(s, y)
    grid = cal(np.linspace(-3, 3, 100))
    assert (np.diff(grid) >= 0).all() and grid[0] < grid[-1]


def test_trees_fit_a_step():
    x = np.linspace(0, 1, 200)[:, None]
    y = (x[:, 0] > 0.5).astype(float)
    raw = T.Trees().fit(x, y).raw(x)
    assert ((raw > 0) == (y == 1)).mean() > 0.95


@pytest.mark.parametrize("raw, shown", [("1d10t", "idiot"), ("m.o.r.o.n", "moron"), ("plain", ""), ("well,", "")])
def test_disguises(raw, shown):
    assert T._revealed(raw) == shown
