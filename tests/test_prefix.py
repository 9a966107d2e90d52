"""Places among sorted numbers, and counts under many edges at once, against plain versions."""

import bisect
import random

from pyspark.sql import functions as F

from weftline.operators import binning, prefix


def test_places_among_numbers(spark):
    r = random.Random(5)
    for most in (0, 1, 2, 3, 19, 399):
        cuts = sorted(r.choice([r.uniform(-5, 5), float(r.randint(-3, 3))]) for _ in range(most))
        values = [None, -9.0, 9.0, 0.0, *cuts[:50], *[r.uniform(-6, 6) for _ in range(50)]]
        df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("c", F.lit(cuts).cast("array<double>") if cuts else F.array().cast("array<double>"))
        got = [(x.v, x.n) for x in df.select("v", prefix.n_below(F.col("c"), F.col("v"), most).alias("n")).collect()]
        assert got == [(v, 0 if v is None else bisect.bisect_left(cuts, v)) for v in values]


def test_counts_under_the_edges_of_every_number(spark):
    r = random.Random(7)
    rows = [(f, v, r.randint(0, 3), r.randint(0, 3)) for f in ("a", "b") for v in [None, *sorted({round(r.uniform(-2, 2), 2) for _ in range(200)})]]
    per = spark.createDataFrame(rows, "feature string, value double, good long, bad long")
    edges = {("a", 2): [-1.0, 0.0, 1.0], ("a", 3): [-1.5, -0.25, 0.5, 1.75], ("b", 2): [0.11, 0.12]}
    table = spark.createDataFrame([(f, n, e) for (f, n), e in edges.items()], "feature string, n int, edges array<double>")
    want = {}
    for (f, n), e in edges.items():
        for g, v, good, bad in rows:
            if g == f:
                k = (f, n, 0 if v is None else max(1, bisect.bisect_left(e, v)))
                want[k] = (want.get(k, (0, 0))[0] + good, want.get(k, (0, 0))[1] + bad)
    got = {(x.feature, x.n, x.bin): (x.good, x.bad) for x in binning.counts_by_edges(per, table, ["good", "bad"], 7).collect()}
    assert got == want


def test_quantiles_look_at_few_values(spark):
    """Values that can't hold a position are left out by arithmetic; those that hold one never are."""
    for total in (1, 2, 5, 37, 1000, 99991):
        r = random.Random(total)
        cuts = sorted({0, total, *[r.randint(0, total) for _ in range(300)]})
        for n in (1, 2, 10, 20):
            rows = [(b, b - a, total) for a, b in zip(cuts, cuts[1:])]
            df = spark.createDataFrame(rows, "u long, k long, t long")
            kept = {x.u for x in df.where(binning._may_hold(F.col("u"), F.col("k"), F.col("t"), [n])).collect()}
            at = {p for i in range(n + 1) for p in (int((total - 1) * (i / n)), -int(-(total - 1) * (i / n) // 1), i * (total - 1) // n)}
            assert {u for u, k, _ in rows if any(u - k <= p < u for p in at)} <= kept
            assert total < 1000 or len(kept) < 6 * (n + 1) + 6
