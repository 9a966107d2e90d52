"""Hand-computed cases of the formulas, so that a shared mistake with the oracle shows."""

import math

import pytest
from pyspark.sql import functions as F

from weftline.functions import times, tokens
from weftline.operators import binning, drift, joins, ranking, select, text, woe
from weftline.plans import registry
from weftline.sources import tables


def frame(spark, values, feature="f"):
    return spark.createDataFrame([(feature, float(v) if v is not None else None) for v in values], "feature string, value double")


def test_quantiles_drop_ties(spark):
    edges = binning.quantile_edges(frame(spark, [0] * 8 + [1, 2]), 10).first().edges
    assert edges == pytest.approx([0, 0.2, 1.1, 2])


@pytest.mark.parametrize("values, edges, left", [([0] * 99 + [3], [-math.inf, 0, 3, math.inf], False), ([5] * 10, [-math.inf, 5, math.inf], True), (range(11), [-math.inf, *range(1, 10), math.inf], False)])
def test_library_edges(spark, values, edges, left):
    got = binning.library_edges(frame(spark, values), 10).first()
    assert got.edges == pytest.approx(edges) and got.left_closed is left


def test_frequency_edges(spark):
    counted = spark.createDataFrame([("f", float(v), 1) for v in range(11)], "feature string, value double, n_rows long")
    assert binning.frequency_edges(counted, 10).first().edges == [-math.inf, *map(float, range(1, 10)), math.inf]


def test_adaptive_edges(spark):
    one = spark.range(1)
    of = lambda c: one.select(c.alias("e")).first().e
    lit = lambda x: F.lit(float(x))
    assert of(binning.adaptive_edge_array(lit(0), lit(1000), 10.0)) == [0.0, *[80.0 * k for k in range(1, 13)], math.inf]
    assert of(binning.adaptive_edge_array(lit(0), lit(30), 40.0)) == [0.0, 5.0, 10.0, 15.0, 20.0, 25.0, 30.0, math.inf]
    assert of(binning.adaptive_edge_array(lit(0), lit(3), 3.0)) == [0.0, 3.0, math.inf]  # half of it is below 2
    assert of(binning.score_edge_array(lit(0), lit(35), 10.0)) == [-math.inf, 10, 20, 30, math.inf]
    assert of(binning.score_edge_array(lit(1), lit(3), 10.0)) == [-math.inf, math.inf]


def test_woe_guards(spark):
    c = spark.createDataFrame([("f", 1, 10, 0), ("f", 2, 0, 5), ("f", 3, 10, 5)], "feature string, bin int, good long, bad long")
    got = {r.bin: r for r in woe.bin_table(c).collect()}
    assert got[1].woe == 1 and got[2].woe == -1 and got[3].woe == pytest.approx(0)
    assert got[1].iv == pytest.approx(0.5) and got[2].iv == pytest.approx(0.5)
    eps = {r.bin: r.woe for r in woe.bin_table(c, "eps").collect()}
    assert eps[1] == pytest.approx(math.log(1e-4 / 0.5))


@pytest.mark.parametrize("policy", ["guard1", "raw", "lambda", "floor"])
def test_psi_of_itself_is_zero(spark, policy):
    rows = spark.createDataFrame([("f", i % 3, k) for i in range(30) for k in (0, 1)], "feature string, bin int, k int")
    assert drift.psi(drift.shares(rows, F.col("k") == 0), policy).first().psi == pytest.approx(0)


def test_auc_and_ks_with_ties(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.4, 1)], "s double, t int")
    got = ranking.ks_auc(ranking.per_score(rows, "s", "t", []), []).first()
    assert got.auc == pytest.approx(0.75) and 0 <= got.ks <= 1
    turned = ranking.ks_auc(ranking.per_score(rows.withColumn("s", -F.col("s")), "s", "t", []), []).first()
    assert turned.auc == pytest.approx(0.25)


@pytest.mark.parametrize("day, monday", [("2024-12-30", "2024-12-30"), ("2025-01-01", "2024-12-30"), ("2026-01-01", "2025-12-29"), ("2020-01-01", "2019-12-30")])
def test_week_start(spark, day, monday):
    assert spark.range(1).select(times.week_start(F.lit(day).cast("date")).alias("w")).first().w == monday


def test_whole_days_are_floored(spark):
    got = spark.sql("SELECT timestamp_ntz'2024-01-01 23:00:00' a, timestamp_ntz'2024-01-02 00:00:00' b").select(times.whole_days(F.col("a"), F.col("b")).alias("d"))
    assert got.first().d == 0


@pytest.mark.parametrize("words, n, want", [(["a"], 2, []), ([], 1, []), (["a", "b", "c"], 2, ["a b", "b c"]), (["a"], 1, ["a"])])
def test_ngrams(spark, words, n, want):
    df = spark.createDataFrame([(words,)], "w array<string>")
    assert df.select(tokens.ngrams(F.col("w"), n).alias("g")).first().g == want


def test_leave_one_out_is_total_minus_own(spark):
    rows = spark.createDataFrame([("a", 0, 2, 1), ("a", 1, 3, 0), ("only", 2, 4, 4)], "token string, fold int, orders long, bad long")
    got = {(r.token, r.fold): (r.orders, r.bad) for r in joins.leave_one_out(rows, ["token"], "fold", ["orders", "bad"]).collect()}
    assert got[("a", 0)] == (3, 0) and got[("a", 1)] == (2, 1) and got[("a", 2)] == (5, 1) and got[("a", -1)] == (5, 1)
    assert ("only", 2) not in got and got[("only", 0)] == (4, 4)
    assert text.oof_dictionary(rows, ["token"], "fold").count() == len(got)


def test_tokens_are_selected_by_rules(spark):
    # 100 rows, 50 bad; light tokens hold the quantile down, one has a lift of 1
    rows = [(0, f"light{i}", 1, 0, 1, 0, 50, 50) for i in range(900)]
    rows += [(0, f"low{i:02}", 50, 50, 20, 1 + i % 8, 50, 50) for i in range(16)] + [(0, f"high{i:02}", 50, 50, 1 + i % 8, 20, 50, 50) for i in range(16)]
    rows += [(0, "even", 50, 50, 20, 20, 50, 50), (0, "one_class", 0, 90, 2, 20, 50, 50)]
    stats = spark.createDataFrame(rows, "fold int, token string, weight_0 long, weight_1 long, orders_0 long, orders_1 long, all_0 long, all_1 long")
    got = {r.token: r.level for r in text.select_by_rules(stats, ["fold"]).collect()}
    assert set(got) == {f"{k}{i:02}" for k in ("low", "high") for i in range(16)} | {"one_class"}
    assert {v for k, v in got.items() if k.startswith("low")} == {0, 1, 2, 3, 4} and {v for k, v in got.items() if k.startswith("high")} == {5, 6, 7, 8, 9}
    assert got["low00"] == got["low08"] == 0 and got["high00"] == 9
    assert not [k for k in {r.token for r in text.select_by_rules(stats, ["fold"], least_share=0.25).collect()} if k in ("low00", "high00", "one_class")]
    assert text.select_by_rules(stats, ["fold"], n_ends=2).count() < len(got)


def test_every_number_of_bins_is_tried(spark):
    woes = {20: [0, 1, 0.5], 7: [0, 1, 2], 6: [0, 1, 2], 4: [0, 1]}
    rows = [("f", n, i, float(w)) for n, ws in woes.items() for i, w in enumerate(ws)] + [("g", n, i, float(w)) for n, ws in {9: [0, 5, 4, 3], 5: [0, 1, -2, 3]}.items() for i, w in enumerate(ws)]
    got = {r.feature: r for r in woe.monotone_choice(spark.createDataFrame(rows, "feature string, n int, bin int, woe double"), by_majority=True).collect()}
    assert got["f"].n == 7 and got["f"].is_monotone and got["g"].n == 5 and not got["g"].is_monotone
    many = {r.n: r.edges for r in binning.quantile_edges_of(frame(spark, range(101)), list(range(4, 21))).collect()}
    assert sorted(many) == list(range(4, 21)) and many[7] == pytest.approx([i * 100 / 7 for i in range(8)])
    q = registry.queries()["monotone_binning_all"](spark, "/root/testdata/sf0.001")
    assert {r.feature: r.n for r in q.collect()}["l_extendedprice"] == 7


def test_gate_comes_before_pruning(spark):
    stats = spark.createDataFrame([("weak", 0.0002, 0.5, 0.0), ("strong", 0.5, 0.45, 0.0), ("twin", 0.4, 0.39, 0.0), ("drifts", 0.9, 0.9, 0.3), ("beside", 0.3, 0.29, 0.0), ("lost", 0.3, 0.1, 0.0)], "feature string, iv_train double, iv_valid double, csi double")
    pairs = spark.createDataFrame([("strong", "twin", -0.9), ("drifts", "beside", 0.95), ("beside", "strong", 0.2)], "first string, second string, corr double")
    got = {r.feature: (r.gated, r.selected) for r in select.gate_and_prune(stats, pairs).collect()}
    assert {f for f, x in got.items() if x[0]} == {"strong", "twin", "beside"} and {f for f, x in got.items() if x[1]} == {"strong", "beside"} and len(got) == 6


def test_as_of_strict_and_inner(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 1, "a"), (1, 5, "b")], "k int, rt int, v string")
    exact = {(r.k, r.t): r.v for r in joins.as_of(left, right, "k", "t", "rt", ["v"]).collect()}
    assert exact == {(1, 5): "b", (1, 1): "a", (2, 9): None}
    strict = {(r.k, r.t): r.v for r in joins.as_of(left, right, "k", "t", "rt", ["v"], exact=False, how="inner").collect()}
    assert strict == {(1, 5): "a"}


def test_partition_scan_is_pruned(spark, tmp_path):
    path = str(tmp_path / "p")
    tables.write_partitions(spark.range(10).withColumn("d", F.col("id") % 3), path, ["d"])
    plan = spark.read.parquet(path).where("d = 1")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(d" in plan
    got = spark.range(1).select(tables.partition_values(F.lit("x/a=1/b=2")).alias("m")).first().m
    assert got == {"a": "1", "b": "2"}


def test_calls_keep_failed_rows(spark):
    def client():
        def call(row):
            if row["id"] == 1:
                raise ValueError("no")
            return str(row["id"])

        return call

    got = {r.id: (r.response, r.error) for r in tables.call_per_row(spark.range(3), client).collect()}
    assert got[0] == ("0", None) and got[1] == (None, "no")


def test_stream_counts(spark, tmp_path):
    from weftline.streaming import events

    src = str(tmp_path / "events")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(src)
    q = events.per_window(events.read(spark, src)).writeStream.outputMode("complete").format("memory").queryName("weft_counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) AS n FROM weft_counts").first().n == spark.read.parquet(src).count()
