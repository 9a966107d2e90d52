"""Binning, weight of evidence and stability queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators import binning, clean, drift, ranking, woe
from weftline.operators.prefix import running, with_totals
from weftline.plans.base import FEATURES, SAMPLE_SQL, binned, binned_sql, long_sample, long_sql, sample, value_counts
from weftline.plans.registry import query
from weftline.sources.tables import kept, table

COUNT_SQL = "c AS (SELECT feature, bin, sum((target = 0)::INT)::BIGINT AS good, sum((target = 1)::INT)::BIGINT AS bad FROM binned GROUP BY ALL), s AS (SELECT *, good / sum(good) OVER (PARTITION BY feature) AS g, bad / sum(bad) OVER (PARTITION BY feature) AS b FROM c)"
GUARD_SQL = "CASE WHEN b = 0 THEN 1.0 WHEN g = 0 THEN -1.0 ELSE ln(g / b) END"


def counted(spark, sf_dir, n=10, negative_missing=True):
    per = value_counts(spark, sf_dir, negative_missing)
    return woe.counts(binned(per, binning.quantile_edges(per, n, rows="n")), ["feature", "bin"], weight=F.col("n"))


@query("woe_table", f"WITH {binned_sql()}, {COUNT_SQL} SELECT feature, bin::INT AS bin, good, bad, {GUARD_SQL} AS woe, (g - b) * {GUARD_SQL} AS iv FROM s")
def woe_table(spark, sf_dir):
    return woe.bin_table(counted(spark, sf_dir)).select("feature", "bin", "good", "bad", "woe", "iv")


@query("iv_by_feature", f"WITH {binned_sql()}, {COUNT_SQL} SELECT feature, sum((g - b) * {GUARD_SQL}) AS iv FROM s GROUP BY feature")
def iv_by_feature(spark, sf_dir):
    return woe.information_value(woe.bin_table(counted(spark, sf_dir)))


@query("qcut_edges", f"WITH {binned_sql()} SELECT feature, bin::INT AS bin, count(*) AS n, min(value) AS lo, max(value) AS hi FROM binned GROUP BY ALL")
def qcut_edges(spark, sf_dir):
    per = value_counts(spark, sf_dir)
    return binned(per, binning.quantile_edges(per, 10, rows="n")).groupBy("feature", "bin").agg(F.sum("n").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))


LIB_LONG = "long AS (SELECT 'price' AS feature, l_extendedprice AS value FROM lineitem UNION ALL SELECT 'constant', 5.0 FROM lineitem UNION ALL SELECT 'spike', CASE WHEN l_orderkey % 100 = 0 AND l_linenumber = 1 THEN 3.0 ELSE 0.0 END FROM lineitem)"


@query(
    "lib_bins",
    f"""WITH {LIB_LONG}, e AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM long GROUP BY feature),
    i AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1.0]))) AS i FROM long JOIN e USING (feature) WHERE len(e) = 2 AND value > e[1] AND value < e[2] GROUP BY feature),
    f AS (SELECT feature, CASE WHEN len(e) > 2 THEN e[2:len(e) - 1] WHEN len(e) = 2 AND i IS NOT NULL THEN list_concat(e[1:1], i[2:len(i) - 1], e[2:2]) ELSE e END AS inner_e, len(e) < 2 AS left_closed FROM e LEFT JOIN i USING (feature))
    SELECT feature, (1 + len(list_filter(inner_e, lambda x: CASE WHEN left_closed THEN x <= value ELSE x < value END)))::INT AS bin, left_closed, count(*) AS n FROM long JOIN f USING (feature) GROUP BY ALL""",
)
def lib_bins(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    wide = lines.select(F.col("l_extendedprice").alias("price"), F.lit(5.0).alias("constant"), F.when((F.col("l_orderkey") % 100 == 0) & (F.col("l_linenumber") == 1), 3.0).otherwise(0.0).alias("spike"))
    long = clean.long_form(wide, ["price", "constant", "spike"], [])
    edges = binning.library_edges(long, 10)
    got = long.join(F.broadcast(edges), "feature")
    return got.withColumn("bin", binning.bin_of(F.col("value"), F.col("edges"), F.col("left_closed"))).groupBy("feature", "bin", "left_closed").agg(F.count("*").alias("n"))


@query("score_bins_fixed", "SELECT (floor(o_totalprice / 50000) * 50000)::BIGINT AS low, count(*) AS n FROM orders GROUP BY 1")
def score_bins_fixed(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy((F.floor(F.col("o_totalprice") / 50000) * 50000).cast("long").alias("low")).agg(F.count("*").alias("n"))


@query(
    "score_bins_adaptive",
    """WITH m AS (SELECT min(o_totalprice / 1000) AS lo, max(o_totalprice / 1000) AS hi FROM orders),
    c AS (SELECT 10.0 * 2 ** k AS cut FROM (SELECT unnest(range(0, 12)) AS k), m WHERE floor(hi / (10.0 * 2 ** k)) - floor(lo / (10.0 * 2 ** k)) <= 20 ORDER BY k LIMIT 1)
    SELECT (floor(o_totalprice / 1000 / cut))::BIGINT AS bin, count(*) AS n FROM orders, c GROUP BY 1""",
)
def score_bins_adaptive(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_totalprice") / 1000).alias("score"))
    edges = o.agg(F.min("score").alias("lo"), F.max("score").alias("hi")).select(binning.adaptive_edge_array(F.col("lo"), F.col("hi"), 10.0).alias("edges"))
    width = F.col("edges")[2] - F.col("edges")[1]
    first = F.floor(F.col("edges")[1] / width) - 1
    return o.crossJoin(F.broadcast(edges)).groupBy((binning.bin_of(F.col("score"), F.col("edges"), True) - 1 + first).cast("long").alias("bin")).agg(F.count("*").alias("n"))  # one row of edges


@query(
    "weighted_bins",
    """WITH p AS (SELECT l_extendedprice AS s, sum(l_quantity::BIGINT) AS w FROM lineitem GROUP BY 1), r AS (SELECT s, sum(w) OVER (ORDER BY s) AS u, sum(w) OVER () AS t FROM p)
    SELECT least(ceil(u * 10 / t), 10)::INT AS band, max(s) AS edge FROM r GROUP BY 1""",
)
def weighted_bins(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").withColumn("w", F.col("l_quantity").cast("long"))
    return binning.weighted_edges(x, "l_extendedprice", "w", 10)


@query(
    "freq_index_bins",
    f"""WITH {long_sql()}, v AS (SELECT feature, list_sort(list(value)) AS v FROM long WHERE value IS NOT NULL GROUP BY feature),
    u AS (SELECT feature, list_sort(list_distinct(list_transform(range(0, 11), lambda i: v[(floor(i * (len(v) - 1) / 10.0))::INT + 1]))) AS u FROM v),
    e AS (SELECT feature, unnest(CASE WHEN len(u) < 11 THEN u[1:len(u) - 1] ELSE u[2:len(u) - 1] END) AS edge FROM u) SELECT feature, edge FROM e""",
)
def freq_index_bins(spark, sf_dir):
    long = long_sample(spark, sf_dir).where("value IS NOT NULL")
    edges = binning.frequency_edges(long.groupBy("feature", "value").agg(F.count("*").alias("n_rows")), 10)
    return edges.select("feature", F.explode("edges").alias("edge")).where(F.abs("edge") < float("inf"))


@query("equal_width_bins", "WITH m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT least(greatest(ceil((l_extendedprice - lo) / ((hi - lo) / 10)), 1), 10)::INT AS bin, count(*) AS n FROM lineitem, m GROUP BY 1")
def equal_width_bins(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_extendedprice")
    ends = x.agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi")).withColumn("edges", binning.equal_width(F.col("lo"), F.col("hi"), 10, "lowered"))
    return x.crossJoin(F.broadcast(ends)).groupBy(binning.bin_of(F.col("l_extendedprice"), F.col("edges")).alias("bin")).agg(F.count("*").alias("n"))


@query(
    "safe_bins",
    f"""WITH {long_sql()}, q AS (SELECT feature, count(DISTINCT value) AS u, quantile_cont(value, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS a,
      quantile_cont(value, [{', '.join(repr(i / 9) for i in range(10))}]) AS b FROM long WHERE value IS NOT NULL GROUP BY feature)
    SELECT feature, CASE WHEN u <= 10 THEN 'identity' WHEN len(list_distinct(a)) = 11 THEN 'n' WHEN len(list_distinct(b)) = 10 THEN 'n-1' ELSE 'median' END AS rung FROM q""",
)
def safe_bins(spark, sf_dir):
    return binning.safe_edges(long_sample(spark, sf_dir), 10).select("feature", "rung")


def _monotone_sql(ns=(4, 6, 8, 10), broken="least(sum(greatest(d, 0)), sum(greatest(-d, 0)))") -> str:
    parts = []
    for n in ns:
        parts.append(f"SELECT * FROM (WITH {binned_sql(n)}, {COUNT_SQL} SELECT feature, {n} AS n, bin, {GUARD_SQL} AS woe FROM s WHERE bin > 0)")
    return f"""WITH t AS ({' UNION ALL '.join(parts)}), d AS (SELECT *, woe - lag(woe) OVER (PARTITION BY feature, n ORDER BY bin) AS d FROM t),
    p AS (SELECT feature, n, coalesce({broken}, 0) AS broken FROM d GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY (broken > 1e-12)::INT, CASE WHEN broken > 1e-12 THEN broken ELSE 0 END, -n) AS k FROM p)
    SELECT feature, n, broken <= 1e-12 AS is_monotone FROM r WHERE k = 1"""


@query("monotone_binning", _monotone_sql())
def monotone_binning(spark, sf_dir):
    return woe.monotone_choice(_tables_by_number(spark, sf_dir, [4, 6, 8, 10]))


def _tables_by_number(spark, sf_dir, ns):
    """(feature, n, bin, woe) for every number of bins, from one pass over counts per distinct value."""
    per = kept(value_counts(spark, sf_dir).where("value IS NOT NULL").groupBy("feature", "value").agg(F.sum(F.when(F.col("target") == 0, F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("target") == 0, 0).otherwise(F.col("n"))).alias("bad"), F.sum("n").alias("rows")), "class-counts")
    found = binning.counts_by_edges(per, binning.quantile_edges_of(per, ns, rows="rows"), ["good", "bad"], sum(n + 1 for n in ns))
    return woe.bin_table(found, feature=["feature", "n"]).select("feature", "n", "bin", "woe")


@query("monotone_binning_all", _monotone_sql(range(4, 21), "CASE WHEN count(*) FILTER (d >= 0) >= count(*) FILTER (d < 0) THEN sum(greatest(-d, 0)) ELSE sum(greatest(d, 0)) END"))
def monotone_binning_all(spark, sf_dir):
    """Every number of bins from 20 down to 4, from counts per distinct value."""
    return woe.monotone_choice(_tables_by_number(spark, sf_dir, list(range(4, 21))), by_majority=True)


SETS_SQL = "c AS (SELECT feature, bin, train, sum((target = 0)::INT) AS good, sum((target = 1)::INT) AS bad FROM binned GROUP BY ALL), s AS (SELECT *, good / sum(good) OVER (PARTITION BY feature, train) AS g, bad / sum(bad) OVER (PARTITION BY feature, train) AS b FROM c)"


@query("iv_train_valid", f"WITH {binned_sql(10, 'train = 1')}, {SETS_SQL} SELECT feature, sum(CASE WHEN train = 1 THEN (g - b) * {GUARD_SQL} END) AS iv_train, sum(CASE WHEN train = 0 THEN (g - b) * {GUARD_SQL} END) AS iv_valid FROM s GROUP BY feature")
def iv_train_valid(spark, sf_dir):
    per = value_counts(spark, sf_dir)
    rows = binned(per, binning.quantile_edges(per.where("train = 1"), 10, rows="n"))
    t = woe.bin_table(woe.counts(rows, ["feature", "train", "bin"], weight=F.col("n")), feature=["feature", "train"])
    return t.groupBy("feature").agg(F.sum(F.when(F.col("train") == 1, F.col("iv"))).alias("iv_train"), F.sum(F.when(F.col("train") == 0, F.col("iv"))).alias("iv_valid"))


@query("iv_eps", f"WITH {binned_sql(10, 'TRUE', False)}, {COUNT_SQL}, e AS (SELECT *, CASE WHEN g = 0 THEN 1e-4 ELSE g END AS ge, CASE WHEN b = 0 THEN 1e-4 ELSE b END AS be FROM s) SELECT feature, sum((be - ge) * ln(be / ge)) AS iv FROM e GROUP BY feature")
def iv_eps(spark, sf_dir):
    return woe.information_value(woe.bin_table(counted(spark, sf_dir, 10, False), "eps"))


@query("iv_lambda", f"WITH {binned_sql()}, {COUNT_SQL} SELECT feature, sum((g - b) * ln((g + 0.001) / (b + 0.001))) AS iv FROM s GROUP BY feature")
def iv_lambda(spark, sf_dir):
    return woe.information_value(woe.bin_table(counted(spark, sf_dir), "lambda"))


SHARE_SQL = "n AS (SELECT feature, bin, sum(train) AS a, sum(1 - train) AS z FROM binned GROUP BY ALL), s AS (SELECT *, a / sum(a) OVER (PARTITION BY feature) AS p, z / sum(z) OVER (PARTITION BY feature) AS q FROM n)"


def _shares(spark, sf_dir, only_train, n=10):
    per = value_counts(spark, sf_dir)
    edges = binning.quantile_edges(per.where("train = 1") if only_train else per, n, rows="n")
    return drift.shares(binned(per, edges), F.col("train") == 1, weight=F.col("n"))


@query("csi_guard", f"WITH {binned_sql()}, {SHARE_SQL} SELECT feature, sum((p - q) * CASE WHEN q = 0 THEN 1.0 WHEN p = 0 THEN -1.0 ELSE ln(p / q) END) AS psi FROM s GROUP BY feature")
def csi_guard(spark, sf_dir):
    return drift.psi(_shares(spark, sf_dir, False), "guard1")


@query("csi_raw", f"WITH {binned_sql(10, 'train = 1')}, {SHARE_SQL} SELECT feature, sum(CASE WHEN p > 0 AND q > 0 THEN (p - q) * ln(p / q) END) AS psi FROM s GROUP BY feature")
def csi_raw(spark, sf_dir):
    return drift.psi(_shares(spark, sf_dir, True), "raw")


@query("psi_lambda", f"WITH {binned_sql(10, 'train = 1')}, {SHARE_SQL} SELECT feature, sum((p - q) * ln((p + 0.001) / (q + 0.001))) AS psi FROM s GROUP BY feature")
def psi_lambda(spark, sf_dir):
    return drift.psi(_shares(spark, sf_dir, True), "lambda")


@query(
    "psi_density",
    """WITH m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
    b AS (SELECT least(floor((l_extendedprice - lo) / ((hi - lo) / 10)), 9) AS bin, (hi - lo) / 10 AS width, (l_shipdate < TIMESTAMP '1998-01-01')::INT AS t FROM lineitem, m),
    n AS (SELECT bin, width, sum(t) AS a, sum(1 - t) AS z FROM b GROUP BY ALL), s AS (SELECT width, a / sum(a) OVER () AS p, z / sum(z) OVER () AS q FROM n),
    d AS (SELECT CASE WHEN p = 0 THEN 1e-6 ELSE p / width END AS p, CASE WHEN q = 0 THEN 1e-6 ELSE q / width END AS q FROM s)
    SELECT 'l_extendedprice' AS feature, sum((p - q) * ln(p / q)) AS psi FROM d""",
)
def psi_density(spark, sf_dir):
    x = sample(spark, sf_dir).select(F.lit("l_extendedprice").alias("feature"), F.col("l_extendedprice").alias("value"), "train")
    ends = x.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    b = x.crossJoin(F.broadcast(ends)).withColumn("width", (F.col("hi") - F.col("lo")) / 10).withColumn("bin", F.least(F.floor((F.col("value") - F.col("lo")) / F.col("width")), F.lit(9)))
    s = drift.shares(b, F.col("train") == 1, ["feature", "width"])
    return drift.psi(s, "density", ["feature"], F.col("width"))


@query(
    "psi_floor_report",
    f"WITH {binned_sql(5, 'train = 1')}, {SHARE_SQL}, f AS (SELECT feature, bin, CASE WHEN p = 0 THEN 1e-4 ELSE p END AS p, CASE WHEN q = 0 THEN 1e-4 ELSE q END AS q FROM s), t AS (SELECT feature, bin::INT AS bin, (p - q) * ln(p / q) AS psi FROM f) SELECT * FROM t UNION ALL SELECT feature, -1, sum(psi) FROM t GROUP BY feature",
)
def psi_floor_report(spark, sf_dir):
    t = _shares(spark, sf_dir, True, 5).select("feature", "bin", drift.term(F.col("p"), F.col("q"), "floor").alias("psi"))
    return t.unionByName(t.groupBy("feature").agg(F.lit(-1).alias("bin"), F.sum("psi").alias("psi")))


SCORE_SQL = "x AS (SELECT floor(o_totalprice / 1000 / 40) AS bin, (o_orderdate < TIMESTAMP '1998-01-01')::INT AS t, (o_orderstatus = 'P')::INT AS bad FROM orders)"


@query("score_psi", f"WITH {SCORE_SQL}, n AS (SELECT bin, sum(t) AS a, sum(1 - t) AS z FROM x GROUP BY 1), s AS (SELECT a / sum(a) OVER () AS p, z / sum(z) OVER () AS q FROM n) SELECT 'score' AS feature, sum((p - q) * CASE WHEN q = 0 THEN 1.0 WHEN p = 0 THEN -1.0 ELSE ln(p / q) END) AS psi FROM s")
def score_psi(spark, sf_dir):
    return drift.psi(drift.shares(_scored(spark, sf_dir), F.col("train") == 1), "guard1")


def _scored(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.lit("score").alias("feature"), F.floor(F.col("o_totalprice") / 1000 / 40).alias("bin"), (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")).cast("int").alias("train"), (F.col("o_orderstatus") == "P").cast("int").alias("target"))


@query("score_distribution", f"WITH {SCORE_SQL} SELECT bin::BIGINT AS bin, t AS train, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY t) AS share FROM x GROUP BY bin, t")
def score_distribution(spark, sf_dir):
    n = _scored(spark, sf_dir).groupBy("bin", "train").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("train")))


UNI_SQL = """u AS (SELECT *, good + bad AS total, sum(good) OVER w AS cg, sum(bad) OVER w AS cb, sum(good) OVER (PARTITION BY feature) AS ag, sum(bad) OVER (PARTITION BY feature) AS ab FROM c WINDOW w AS (PARTITION BY feature ORDER BY bin ROWS UNBOUNDED PRECEDING))
SELECT feature, bin::INT AS bin, good, bad, total, bad / total AS bad_rate, total / (ag + ab) AS total_rate, cb / (cg + cb) AS cum_bad_rate, (bad / total) / (ab / (ag + ab)) AS lift, abs(cb / ab - cg / ag) AS ks,
  sum(bad * (cg - good) + bad * good / 2) OVER (PARTITION BY feature ORDER BY bin ROWS UNBOUNDED PRECEDING) / nullif(cb * cg, 0) AS auc_cum FROM u"""


@query("univariate_table", f"WITH {binned_sql()}, {COUNT_SQL}, {UNI_SQL}")
def univariate_table(spark, sf_dir):
    return ranking.univariate(counted(spark, sf_dir))


@query("univariate_alpha", f"WITH {binned_sql()}, {COUNT_SQL}, a AS (SELECT feature, bin, (good + 0.1) / (sum(good) OVER w + 0.1 * count(*) OVER w) AS g, (bad + 0.1) / (sum(bad) OVER w + 0.1 * count(*) OVER w) AS b FROM c WINDOW w AS (PARTITION BY feature)) SELECT feature, bin::INT AS bin, ln(b / g) AS woe, (b - g) * ln(b / g) AS iv FROM a")
def univariate_alpha(spark, sf_dir):
    return woe.bin_table(counted(spark, sf_dir), "alpha").select("feature", "bin", "woe", "iv")


@query(
    "univariate_sets",
    f"""WITH {binned_sql(10, 'train = 1')}, c AS (SELECT feature, train, bin, sum((target = 0)::INT) AS good, sum((target = 1)::INT) AS bad FROM binned GROUP BY ALL),
    s AS (SELECT *, good / sum(good) OVER w AS g, bad / sum(bad) OVER w AS b, sum(good) OVER u / sum(good) OVER w AS cg, sum(bad) OVER u / sum(bad) OVER w AS cb FROM c WINDOW w AS (PARTITION BY feature, train), u AS (PARTITION BY feature, train ORDER BY bin ROWS UNBOUNDED PRECEDING))
    SELECT feature, train, sum((g - b) * ln((g + 0.001) / (b + 0.001))) AS iv, max(abs(cg - cb)) AS ks FROM s GROUP BY ALL""",
)
def univariate_sets(spark, sf_dir):
    per = value_counts(spark, sf_dir)
    c = woe.counts(binned(per, binning.quantile_edges(per.where("train = 1"), 10, rows="n")), ["feature", "train", "bin"], weight=F.col("n"))
    by = ["feature", "train"]
    iv = woe.information_value(woe.bin_table(c, "lambda", by), by)
    return iv.join(ranking.univariate(c, by).groupBy(*by).agg(F.max("ks").alias("ks")), by)


RANK_SQL = "p AS (SELECT l_discount AS score, sum((l_returnflag <> 'R')::INT) AS n0, sum((l_returnflag = 'R')::INT) AS n1 FROM lineitem GROUP BY 1), r AS (SELECT *, sum(n0) OVER (ORDER BY score) AS c0, sum(n1) OVER (ORDER BY score) AS c1, sum(n0) OVER () AS t0, sum(n1) OVER () AS t1 FROM p)"


def _ranked(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_discount", (F.col("l_returnflag") == "R").cast("int").alias("target"))
    return ranking.per_score(x, "l_discount", "target", [])


@query("ks_two_sample", f"WITH {RANK_SQL} SELECT max(abs(c1 / t1 - c0 / t0)) AS ks FROM r")
def ks_two_sample(spark, sf_dir):
    return ranking.ks_auc(_ranked(spark, sf_dir), []).select("ks")


@query("ks_curve", f"WITH {RANK_SQL} SELECT score, c0 / t0 AS cdf0, c1 / t1 AS cdf1, abs(c1 / t1 - c0 / t0) AS gap FROM r")
def ks_curve(spark, sf_dir):
    return ranking.curve(_ranked(spark, sf_dir), []).select("score", "cdf0", "cdf1", "gap")


@query("auc_rank", f"WITH {RANK_SQL} SELECT sum(n1 * (c0 - n0) + n1 * n0 / 2) / max(t0 * t1) AS auc FROM r")
def auc_rank(spark, sf_dir):
    return ranking.ks_auc(_ranked(spark, sf_dir), []).select("auc")


@query("prefix_auc", f"WITH {binned_sql()}, {COUNT_SQL}, r AS (SELECT *, sum(good) OVER w AS cg, sum(bad) OVER w AS cb FROM c WINDOW w AS (PARTITION BY feature ORDER BY bin ROWS UNBOUNDED PRECEDING)) SELECT feature, bin::INT AS bin, sum(bad * (cg - good) + bad * good / 2) OVER (PARTITION BY feature ORDER BY bin ROWS UNBOUNDED PRECEDING) / nullif(cb * cg, 0) AS auc_cum FROM r")
def prefix_auc(spark, sf_dir):
    return ranking.univariate(counted(spark, sf_dir)).select("feature", "bin", "auc_cum")


@query("roc_points", "WITH x AS (SELECT (l_returnflag = 'R') AS t, floor(l_discount * 10 / 0.01 + 1e-9) AS i FROM lineitem), g AS (SELECT unnest(range(0, 101)) AS k) SELECT k AS threshold_index, sum((i >= k AND t)::INT)::BIGINT AS tp, sum((i >= k AND NOT t)::INT)::BIGINT AS fp, sum((i < k AND t)::INT)::BIGINT AS fn, sum((i < k AND NOT t)::INT)::BIGINT AS tn FROM x, g GROUP BY 1")
def roc_points(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("s"), (F.col("l_returnflag") == "R").cast("int").alias("t"))
    return ranking.roc_points(x, "s", "t")


@query("confusion_counts", "WITH c AS (SELECT count(*) FILTER (l_discount >= 0.05 AND l_returnflag = 'R') AS tp, count(*) FILTER (l_discount >= 0.05 AND l_returnflag <> 'R') AS fp, count(*) FILTER (l_discount < 0.05 AND l_returnflag = 'R') AS fn, count(*) FILTER (l_discount < 0.05 AND l_returnflag <> 'R') AS tn FROM lineitem) SELECT *, (tp + tn) / (tp + fp + fn + tn) AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM c")
def confusion_counts(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_discount", (F.col("l_returnflag") == "R").cast("int").alias("t"))
    return ranking.confusion(x, "l_discount", "t", 0.05)


@query("score_box", f"WITH {SCORE_SQL}, n AS (SELECT bin::BIGINT AS bin, t AS train, count(*) AS total, sum(bad)::BIGINT AS bad FROM x GROUP BY ALL) SELECT *, bad / total AS bad_rate, sum(total) OVER (PARTITION BY train ORDER BY bin ROWS UNBOUNDED PRECEDING) / sum(total) OVER (PARTITION BY train) AS cum_share FROM n")
def score_box(spark, sf_dir):
    n = _scored(spark, sf_dir).groupBy("bin", "train").agg(F.count("*").alias("total"), F.sum("target").alias("bad"))
    w = W.partitionBy("train")
    return n.withColumns({"bad_rate": F.col("bad") / F.col("total"), "cum_share": F.sum("total").over(w.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)) / F.sum("total").over(w)})


@query(
    "score_box_pct",
    """WITH p AS (SELECT o_totalprice AS s, count(*) AS w, sum((o_orderstatus = 'P')::INT) AS bad FROM orders GROUP BY 1), r AS (SELECT *, sum(w) OVER (ORDER BY s) AS u, sum(w) OVER () AS t FROM p),
    b AS (SELECT least(ceil(u * 10 / t), 10)::INT AS band, min(s) AS lo, max(s) AS hi, sum(w)::BIGINT AS total, sum(bad)::BIGINT AS bad FROM r GROUP BY 1)
    SELECT *, sum(bad) OVER w / sum(total) OVER w AS tail_bad_rate FROM b WINDOW w AS (ORDER BY band ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
)
def score_box_pct(spark, sf_dir):
    p = table(spark, sf_dir, "orders").groupBy(F.col("o_totalprice").alias("s")).agg(F.count("*").alias("w"), F.sum((F.col("o_orderstatus") == "P").cast("int")).alias("b"))
    r = running(with_totals(p, {"t": "w"}), "s", {"u": "w"})
    band = F.least(F.ceil(F.col("u") * 10 / F.col("t")), F.lit(10)).cast("int")
    n = r.groupBy(band.alias("band")).agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.sum("w").alias("total"), F.sum("b").alias("bad"))
    tail = W.orderBy("band").rowsBetween(0, W.unboundedFollowing)
    return n.withColumn("tail_bad_rate", F.sum("bad").over(tail) / F.sum("total").over(tail))


@query("risk_tail_badrate", f"WITH {SCORE_SQL}, n AS (SELECT bin::BIGINT AS bin, count(*) AS total, sum(bad)::BIGINT AS bad FROM x GROUP BY 1) SELECT *, sum(bad) OVER w / sum(total) OVER w AS tail_bad_rate FROM n WINDOW w AS (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")
def risk_tail_badrate(spark, sf_dir):
    n = _scored(spark, sf_dir).groupBy("bin").agg(F.count("*").alias("total"), F.sum("target").alias("bad"))
    tail = W.orderBy("bin").rowsBetween(0, W.unboundedFollowing)
    return n.withColumn("tail_bad_rate", F.sum("bad").over(tail) / F.sum("total").over(tail))


@query("prob_to_score", "SELECT l_orderkey, l_linenumber, round_even(550 - 60 / ln(2) * ln((l_discount * 5 + 0.1) / (1 - (l_discount * 5 + 0.1))), 0) AS score FROM lineitem")
def prob_to_score(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ranking.points(F.col("l_discount") * 5 + 0.1).alias("score"))


@query("period_offset_report", f"WITH {binned_sql(10, 'train = 1')}, n AS (SELECT feature, bin, train, count(*) AS n, avg(target) AS bad_rate FROM binned GROUP BY ALL) SELECT feature, bin::INT AS bin, sum(CASE WHEN train = 1 THEN n ELSE 0 END)::BIGINT AS n_base, sum(CASE WHEN train = 0 THEN n ELSE 0 END)::BIGINT AS n_now, max(CASE WHEN train = 0 THEN bad_rate END) - max(CASE WHEN train = 1 THEN bad_rate END) AS shift FROM n GROUP BY ALL")
def period_offset_report(spark, sf_dir):
    per = value_counts(spark, sf_dir)
    rows = binned(per, binning.quantile_edges(per.where("train = 1"), 10, rows="n"))
    base, now, n = F.col("train") == 1, F.col("train") == 0, F.col("n")
    of = lambda c, v: F.sum(F.when(c, v))
    return rows.groupBy("feature", "bin").agg(F.coalesce(of(base, n), F.lit(0)).alias("n_base"), F.coalesce(of(now, n), F.lit(0)).alias("n_now"), (of(now, n * F.col("target")) / of(now, n) - of(base, n * F.col("target")) / of(base, n)).alias("shift"))


@query("corr_matrix", f"WITH {SAMPLE_SQL} SELECT corr(l_extendedprice, l_quantity) AS price_quantity, corr(l_extendedprice, l_discount) AS price_discount, corr(l_quantity, c_acctbal) AS quantity_balance FROM sample")
def corr_matrix(spark, sf_dir):
    x = sample(spark, sf_dir)
    return x.agg(F.corr("l_extendedprice", "l_quantity").alias("price_quantity"), F.corr("l_extendedprice", "l_discount").alias("price_discount"), F.corr("l_quantity", "c_acctbal").alias("quantity_balance"))


@query(
    "feature_gate",
    f"""WITH {binned_sql(10, 'train = 1')}, {SETS_SQL}, i AS (SELECT feature, sum(CASE WHEN train = 1 THEN (g - b) * {GUARD_SQL} END) AS iv FROM s GROUP BY feature), k AS (SELECT abs(corr(l_extendedprice, l_quantity)) AS c FROM sample),
    o AS (SELECT feature, iv, CASE WHEN feature = 'l_extendedprice' THEN 'l_quantity' WHEN feature = 'l_quantity' THEN 'l_extendedprice' END AS partner FROM i)
    SELECT o.feature, NOT coalesce(c >= 0.8 AND p.iv > o.iv, FALSE) AS selected FROM o CROSS JOIN k LEFT JOIN i p ON p.feature = o.partner""",
)
def feature_gate(spark, sf_dir):
    from weftline.operators.select import correlated_pairs, prune

    per = value_counts(spark, sf_dir)
    rows = binned(per, binning.quantile_edges(per.where("train = 1"), 10, rows="n"))
    iv = woe.information_value(woe.bin_table(woe.counts(rows.where("train = 1"), ["feature", "bin"], weight=F.col("n"))))
    pairs = correlated_pairs(sample(spark, sf_dir), ["l_extendedprice", "l_quantity"])
    return prune(iv, pairs, 0.8)


def _gate_sql() -> str:
    pairs = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS c FROM sample" for a in FEATURES for b in FEATURES if a != b)
    return f"""WITH {binned_sql(10, 'train = 1')}, {SETS_SQL}, i AS (SELECT feature, sum(CASE WHEN train = 1 THEN (g - b) * {GUARD_SQL} END) AS iv_train, sum(CASE WHEN train = 0 THEN (g - b) * {GUARD_SQL} END) AS iv_valid FROM s GROUP BY feature),
    n AS (SELECT feature, bin, sum(train) AS a, sum(1 - train) AS z FROM binned GROUP BY ALL), h AS (SELECT *, a / sum(a) OVER (PARTITION BY feature) AS p, z / sum(z) OVER (PARTITION BY feature) AS q FROM n),
    v AS (SELECT feature, sum(CASE WHEN p > 0 AND q > 0 THEN (p - q) * ln(p / q) END) AS csi FROM h GROUP BY feature), k AS ({pairs}),
    y AS (SELECT * FROM i JOIN v USING (feature) WHERE iv_train > 0.01 AND iv_valid > 0.01 AND iv_valid / iv_train > 0.7 AND csi < 0.2),
    l AS (SELECT y.feature FROM y JOIN k ON k.a = y.feature JOIN y o ON o.feature = k.b WHERE abs(c) >= 0.8 AND (o.iv_train > y.iv_train OR (o.iv_train = y.iv_train AND o.feature < y.feature)))
    SELECT feature, iv_train, iv_valid, csi, feature IN (SELECT feature FROM y) AS gated, feature IN (SELECT feature FROM y) AND feature NOT IN (SELECT feature FROM l) AS selected FROM i JOIN v USING (feature)"""


@query("feature_gate_all", _gate_sql())
def feature_gate_all(spark, sf_dir):
    from weftline.operators.select import correlated_pairs, gate_and_prune

    stats = iv_train_valid(spark, sf_dir).join(csi_raw(spark, sf_dir).withColumnRenamed("psi", "csi"), "feature")
    return gate_and_prune(kept(stats, "gate-stats"), correlated_pairs(sample(spark, sf_dir), list(FEATURES)))


@query(
    "bin_upper_edges",
    f"""WITH {long_sql()}, v AS (SELECT feature, list_sort(list(value)) AS v FROM long WHERE value IS NOT NULL GROUP BY feature),
    u AS (SELECT feature, list_sort(list_distinct(list_transform(range(0, 11), lambda i: v[(floor(i * (len(v) - 1) / 10.0))::INT + 1]))) AS u FROM v), e AS (SELECT feature, CASE WHEN len(u) < 11 THEN u[1:len(u) - 1] ELSE u[2:len(u) - 1] END AS e FROM u),
    x AS (SELECT long.feature, CASE WHEN value IS NULL THEN -999.0 ELSE coalesce(list_filter(e, lambda k: k >= value)[1], 1e308) END AS upper FROM long JOIN e ON long.feature = e.feature)
    SELECT feature, upper, count(*) AS n FROM x GROUP BY ALL""",
)
def bin_upper_edges(spark, sf_dir):
    long = long_sample(spark, sf_dir)
    edges = binning.frequency_edges(long.where("value IS NOT NULL").groupBy("feature", "value").agg(F.count("*").alias("n_rows")), 10)
    upper = binning.upper_edge(F.col("value"), F.col("edges"))
    got = long.join(F.broadcast(edges), "feature").select("feature", F.when(upper == float("inf"), F.lit(1e308)).otherwise(upper).alias("upper"))  # a row per feature
    return got.groupBy("feature", "upper").agg(F.count("*").alias("n"))


@query(
    "ks_buckets",
    """WITH b AS (SELECT greatest(ceil(l_discount * 200)::BIGINT, 1) AS bucket, count(*) FILTER (l_returnflag <> 'R') AS n0, count(*) FILTER (l_returnflag = 'R') AS n1 FROM lineitem GROUP BY 1)
    SELECT bucket, n0, n1, abs(sum(n1) OVER w / sum(n1) OVER () - sum(n0) OVER w / sum(n0) OVER ()) AS gap FROM b WINDOW w AS (ORDER BY bucket ROWS UNBOUNDED PRECEDING)""",
)
def ks_buckets(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("s"), (F.col("l_returnflag") == "R").cast("int").alias("t"))
    per = x.groupBy(F.greatest(F.ceil(F.col("s") * 20), F.lit(1)).alias("score")).agg(F.sum((F.col("t") == 0).cast("long")).alias("n0"), F.sum("t").alias("n1"))
    return ranking.curve(per, []).select(F.col("score").alias("bucket"), "n0", "n1", "gap")
