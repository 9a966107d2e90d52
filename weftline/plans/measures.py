"""Feature reports over whole rules: weights, categories, own bins per set, three sets, raw AUC."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import binning, clean, drift, profiles, woe
from weftline.plans.base import FEATURES, SAMPLE_SQL, sample
from weftline.plans.bins import GUARD_SQL
from weftline.plans.registry import query
from weftline.sources.tables import kept

LAMB = "ln((g + 0.001) / (b + 0.001))"


def sets_sql() -> str:
    """long3 (feature, value, target, grp, weight, tax): train and test by order number before the split, oot after it."""
    grp = "CASE WHEN train = 0 THEN 'oot' WHEN l_orderkey % 10 < 7 THEN 'train' ELSE 'test' END"
    parts = " UNION ALL ".join(f"SELECT '{f}' AS feature, CASE WHEN {f} >= 0 THEN {f} END AS value, target, {grp} AS grp, l_quantity AS weight, l_tax AS tax FROM sample" for f in FEATURES)
    return f"{SAMPLE_SQL}, long3 AS ({parts})"


def long3(spark, sf_dir, columns=()):
    x = sample(spark, sf_dir)
    grp = F.when(F.col("train") == 0, "oot").when(F.col("l_orderkey") % 10 < 7, "train").otherwise("test")
    keep = x.withColumns({"grp": grp, "weight": F.col("l_quantity"), "tax": F.col("l_tax")})
    long = clean.long_form(keep, list(FEATURES), ["target", "grp", *columns])
    return long.withColumn("value", clean.present(F.col("value")))


def _quantile_sql(source: str, n: int = 10, by: str = "feature") -> str:
    at = ", ".join(repr(i / n) for i in range(n + 1))
    return f"SELECT {by}, list_distinct(quantile_cont(value, [{at}])) AS edges FROM {source} WHERE value IS NOT NULL GROUP BY ALL"


def _index_sql(source: str, value: str = "value", by: str = "feature") -> str:
    """Index-based frequency edges: values at int(i * (n - 1) / 10) of the sorted column, unique, open ends left out."""
    return f"""SELECT {by}, CASE WHEN len(u) < 11 THEN u[1:len(u) - 1] ELSE u[2:len(u) - 1] END AS inner_e FROM (SELECT {by}, list_sort(list_distinct(list_transform(range(0, 11), lambda i: v[(floor(i * (len(v) - 1) / 10.0))::INT + 1]))) AS u
    FROM (SELECT {by}, list_sort(list({value})) AS v FROM {source} GROUP BY ALL))"""


# bin tables with weights


@query(
    "woe_table_weighted",
    f"""WITH {sets_sql()}, e AS ({_quantile_sql('long3')}), x AS (SELECT feature, target, weight, CASE WHEN value IS NULL THEN 0 ELSE greatest(1, len(list_filter(edges, lambda k: k < value))) END AS bin FROM long3 JOIN e USING (feature)),
    c AS (SELECT feature, bin, sum(CASE WHEN target = 1 THEN weight ELSE 0 END) AS bad, sum(CASE WHEN target = 0 THEN weight ELSE 0 END) AS good FROM x GROUP BY ALL), s AS (SELECT *, good / sum(good) OVER w AS g, bad / sum(bad) OVER w AS b, sum(good + bad) OVER w AS t FROM c WINDOW w AS (PARTITION BY feature))
    SELECT feature, bin::INT AS bin, bad, good, bad / (good + bad) AS bad_rate, good + bad AS total, g AS good_pct, b AS bad_pct, (good + bad) / t AS total_pct, good / nullif(bad, 0) AS odds, {GUARD_SQL} AS woe, (g - b) * {GUARD_SQL} AS iv FROM s""",
)
def woe_table_weighted(spark, sf_dir):
    """The whole bin table, by a weight column."""
    per = kept(long3(spark, sf_dir, ["weight"]).groupBy("feature", "value", "target").agg(F.count("*").alias("n"), F.sum(woe.weights(F.col("target"), column=F.col("weight"))).alias("w")), "weighted-counts")
    rows = per.join(F.broadcast(binning.quantile_edges(per, 10, rows="n")), "feature").withColumn("bin", F.coalesce(binning.bin_of_quantile(F.col("value"), F.col("edges")), F.lit(0)))
    t = woe.bin_table(woe.counts(rows, ["feature", "bin"], weight=F.col("w")))
    return t.select("feature", "bin", "bad", "good", "bad_rate", "total", "good_pct", "bad_pct", "total_pct", "odds", "woe", "iv")


@query(
    "csi_guard_weighted",
    f"""WITH {sets_sql()}, e AS ({_quantile_sql('long3')}), x AS (SELECT feature, grp, CASE WHEN target = 0 THEN 1.0::DOUBLE ELSE 3.0 END AS w, CASE WHEN value IS NULL THEN 0 ELSE greatest(1, len(list_filter(edges, lambda k: k < value))) END AS bin FROM long3 JOIN e USING (feature)),
    n AS (SELECT feature, bin, sum(CASE WHEN grp = 'oot' THEN 0.0::DOUBLE ELSE w END) AS a, sum(CASE WHEN grp = 'oot' THEN w ELSE 0.0::DOUBLE END) AS z FROM x GROUP BY ALL), s AS (SELECT *, a / sum(a) OVER (PARTITION BY feature) AS p, z / sum(z) OVER (PARTITION BY feature) AS q FROM n)
    SELECT feature, bin::INT AS bin, a AS mdl, z AS vld, p AS mdl_pct, q AS vld_pct, (p - q) * CASE WHEN q = 0 THEN 1.0 WHEN p = 0 THEN -1.0 ELSE ln(p / q) END AS csi FROM s""",
)
def csi_guard_weighted(spark, sf_dir):
    """Stability in detail on pooled edges, with a weight per class."""
    per = kept(long3(spark, sf_dir).groupBy("feature", "value", "target", "grp").agg(F.count("*").alias("n")), "set-counts")
    rows = per.join(F.broadcast(binning.quantile_edges(per, 10, rows="n")), "feature").withColumn("bin", F.coalesce(binning.bin_of_quantile(F.col("value"), F.col("edges")), F.lit(0)))
    s = drift.shares(rows, F.col("grp") != "oot", weight=F.col("n") * woe.weights(F.col("target"), by_class=(1.0, 3.0)))
    return s.select("feature", "bin", F.col("n_first").alias("mdl"), F.col("n_second").alias("vld"), F.col("p").alias("mdl_pct"), F.col("q").alias("vld_pct"), drift.term(F.col("p"), F.col("q"), "guard1").alias("csi"))


# information value: own edges, categories, frequency bins

OWN_SQL = f"""long AS (SELECT 'price' AS feature, l_extendedprice AS value, target, train FROM sample UNION ALL SELECT 'late', CASE WHEN train = 0 THEN l_quantity END, target, train FROM sample),
    e1 AS ({_quantile_sql('(SELECT * FROM long WHERE train = 1)')}), e2 AS ({_quantile_sql('(SELECT * FROM long WHERE train = 0)')}),
    e AS (SELECT feature, coalesce(e1.edges, e2.edges) AS edges FROM e2 LEFT JOIN e1 USING (feature))"""


@query(
    "iv_own_edges",
    f"""WITH {SAMPLE_SQL}, {OWN_SQL}, x AS (SELECT long.*, CASE WHEN value IS NULL THEN 0 ELSE greatest(1, len(list_filter(edges, lambda k: k < value))) END AS bin FROM long JOIN e USING (feature)),
    c AS (SELECT feature, train, bin, sum((target = 0)::INT) AS good, sum((target = 1)::INT) AS bad FROM x GROUP BY ALL), s AS (SELECT *, good / sum(good) OVER w AS g, bad / sum(bad) OVER w AS b FROM c WINDOW w AS (PARTITION BY feature, train))
    SELECT feature, sum(CASE WHEN train = 1 THEN (g - b) * {GUARD_SQL} END) AS iv_train, sum(CASE WHEN train = 0 THEN (g - b) * {GUARD_SQL} END) AS iv_valid FROM s GROUP BY 1""",
)
def iv_own_edges(spark, sf_dir):
    """Train's edges for both sets; where train lacks the feature, valid's own."""
    x = sample(spark, sf_dir).select("target", "train", F.col("l_extendedprice").alias("price"), F.when(F.col("train") == 0, F.col("l_quantity")).alias("late"))
    per = kept(clean.long_form(x, ["price", "late"], ["target", "train"]).groupBy("feature", "value", "target", "train").agg(F.count("*").alias("n")), "own-counts")
    by_set = kept(binning.quantile_edges(per, 10, ["feature", "train"], rows="n"), "own-edges")
    edges = by_set.groupBy("feature").agg(F.max_by("edges", "train").alias("edges"))
    rows = per.join(F.broadcast(edges), "feature").withColumn("bin", F.coalesce(binning.bin_of_quantile(F.col("value"), F.col("edges")), F.lit(0)))
    t = woe.bin_table(woe.counts(rows, ["feature", "train", "bin"], weight=F.col("n")), feature=["feature", "train"])
    return t.groupBy("feature").agg(F.sum(F.when(F.col("train") == 1, F.col("iv"))).alias("iv_train"), F.sum(F.when(F.col("train") == 0, F.col("iv"))).alias("iv_valid"))


CATEGORY_SQL = """cats AS (SELECT (o_orderstatus = 'P')::INT AS target, (o_orderdate < TIMESTAMP '1998-01-01')::INT AS train, o_orderpriority, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey),
    long AS (SELECT 'o_orderpriority' AS feature, o_orderpriority AS bin, target, train FROM cats UNION ALL SELECT 'c_mktsegment', c_mktsegment, target, train FROM cats)"""


def _categories(spark, sf_dir):
    from weftline.sources.tables import table

    x = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    x = x.select((F.col("o_orderstatus") == "P").cast("int").alias("target"), (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")).cast("int").alias("train"), "o_orderpriority", "c_mktsegment")
    return clean.long_form(x, ["o_orderpriority", "c_mktsegment"], ["target", "train"]).withColumnRenamed("value", "bin")


@query(
    "iv_categories",
    f"""WITH {CATEGORY_SQL}, c AS (SELECT feature, train, bin, sum((target = 0)::INT) AS good, sum((target = 1)::INT) AS bad FROM long GROUP BY ALL), s AS (SELECT *, good / sum(good) OVER w AS g, bad / sum(bad) OVER w AS b FROM c WINDOW w AS (PARTITION BY feature, train))
    SELECT feature, sum(CASE WHEN train = 1 THEN (g - b) * {GUARD_SQL} END) AS iv_train, sum(CASE WHEN train = 0 THEN (g - b) * {GUARD_SQL} END) AS iv_valid FROM s GROUP BY 1""",
)
def iv_categories(spark, sf_dir):
    """A category is its own bin."""
    t = woe.bin_table(woe.counts(_categories(spark, sf_dir), ["feature", "train", "bin"]), feature=["feature", "train"])
    return t.groupBy("feature").agg(F.sum(F.when(F.col("train") == 1, F.col("iv"))).alias("iv_train"), F.sum(F.when(F.col("train") == 0, F.col("iv"))).alias("iv_valid"))


@query("psi_categories", f"WITH {CATEGORY_SQL}, n AS (SELECT feature, bin, sum(train) AS a, sum(1 - train) AS z FROM long GROUP BY ALL), s AS (SELECT feature, a / sum(a) OVER (PARTITION BY feature) AS p, z / sum(z) OVER (PARTITION BY feature) AS q FROM n) SELECT feature, sum((p - q) * ln((p + 0.001) / (q + 0.001))) AS psi FROM s GROUP BY 1")
def psi_categories(spark, sf_dir):
    return profiles.lambda_psi(_categories(spark, sf_dir).withColumn("n", F.lit(1)), ["feature"], F.col("train") == 1)


def _filled(spark, sf_dir):
    """Counts per value and set; a missing value is -999."""
    return profiles.value_table(long3(spark, sf_dir).withColumn("value", F.coalesce("value", F.lit(clean.SENTINEL))), ["feature", "grp"])


def _frequency(values, by, of=None):
    """Frequency edges of counted values, as a table of (by..., edges)."""
    counted = (values if of is None else values.where(of)).groupBy(*by, "value").agg(F.sum(F.col("good") + F.col("bad")).alias("n_rows"))
    return binning.frequency_edges(counted, 10, by)


FILLED = "filled AS (SELECT feature, coalesce(value, -999.0) AS value, target, grp FROM long3)"


@query(
    "iv_frequency_bins",
    f"""WITH {sets_sql()}, {FILLED}, e AS ({_index_sql('filled', by='feature, grp')}), x AS (SELECT feature, grp, target, len(list_filter(inner_e, lambda k: k < value)) AS bin FROM filled JOIN e USING (feature, grp)),
    c AS (SELECT feature, grp, bin, sum((target = 0)::INT) AS good, sum((target = 1)::INT) AS bad FROM x GROUP BY ALL), s AS (SELECT *, good / sum(good) OVER w AS g, bad / sum(bad) OVER w AS b FROM c WINDOW w AS (PARTITION BY feature, grp)) SELECT feature, grp, sum((g - b) * {LAMB}) AS iv FROM s GROUP BY ALL""",
)
def iv_frequency_bins(spark, sf_dir):
    """Each set on its own frequency bins."""
    by = ["feature", "grp"]
    values = _filled(spark, sf_dir)
    rows = values.join(F.broadcast(_frequency(values, by)), by).withColumn("bin", binning.bin_of(F.col("value"), F.col("edges")))
    t = woe.bin_table(rows.groupBy(*by, "bin").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "lambda", by)
    return woe.information_value(t, by)


@query(
    "psi_frequency_bins",
    f"""WITH {sets_sql()}, e AS ({_index_sql("(SELECT * FROM long3 WHERE grp = 'train' AND value IS NOT NULL)")}), x AS (SELECT feature, grp, len(list_filter(inner_e, lambda k: k < coalesce(value, -999.0))) AS bin FROM long3 JOIN e USING (feature)),
    n AS (SELECT feature, bin, count(*) FILTER (grp = 'train') AS a, count(*) FILTER (grp = 'test') AS z, count(*) FILTER (grp = 'oot') AS o FROM x GROUP BY ALL), s AS (SELECT feature, a / sum(a) OVER w AS p, z / sum(z) OVER w AS q, o / sum(o) OVER w AS r FROM n WINDOW w AS (PARTITION BY feature))
    SELECT feature, sum((p - q) * ln((p + 0.001) / (q + 0.001))) AS psi_test, sum((p - r) * ln((p + 0.001) / (r + 0.001))) AS psi_oot FROM s GROUP BY 1""",
)
def psi_frequency_bins(spark, sf_dir):
    """Train's frequency bins; missing rows count, below the first edge."""
    rows = _train_binned(_filled(spark, sf_dir))
    psi = lambda other: profiles.lambda_psi(rows.where(F.col("grp").isin("train", other)).withColumn("n", F.col("good") + F.col("bad")), ["feature"], F.col("grp") == "train").withColumnRenamed("psi", f"psi_{other}")
    return psi("test").join(psi("oot"), "feature")


def _train_binned(values):
    edges = _frequency(values, ["feature"], (F.col("grp") == "train") & (F.col("value") != clean.SENTINEL))
    return kept(values.join(F.broadcast(edges), "feature").withColumn("bin", binning.bin_of(F.col("value"), F.col("edges"))).drop("edges"), "train-binned")


# univariate tables

_AUC_SQL = """p AS (SELECT feature, bin, value, sum(1 - target) AS n0, sum(target) AS n1 FROM binned3 GROUP BY ALL),
    r AS (SELECT k.feature, k.bin AS upto, n1, n0, sum(n0) OVER (PARTITION BY k.feature, k.bin ORDER BY value) AS c0 FROM (SELECT DISTINCT feature, bin FROM p) k JOIN d USING (feature) JOIN p ON p.feature = k.feature AND CASE WHEN slope > 0 THEN p.bin <= k.bin ELSE p.bin >= k.bin END),
    a AS (SELECT feature, upto AS bin, sum(n1 * (c0 - n0 / 2)) / nullif(sum(n0) * sum(n1), 0) AS auc FROM r GROUP BY ALL)"""


@query(
    "univariate_whole",
    f"""WITH {sets_sql()}, e AS ({_quantile_sql('long3')}), binned3 AS (SELECT feature, value, target, tax, greatest(1, len(list_filter(edges, lambda k: k < value))) AS bin FROM long3 JOIN e USING (feature) WHERE value IS NOT NULL),
    t AS (SELECT feature, sum(1 - target) AS ag, sum(target) AS ab FROM long3 GROUP BY 1), d AS (SELECT feature, corr(value, target) AS slope FROM long3 GROUP BY 1), {_AUC_SQL},
    c AS (SELECT feature, bin, sum(1 - target) AS good, sum(target) AS bad, avg(tax) AS mean_tax FROM binned3 GROUP BY ALL),
    u AS (SELECT c.*, ag, ab, good / ag AS g, bad / ab AS b, sum(good) OVER w AS cg, sum(bad) OVER w AS cb FROM c JOIN t USING (feature) JOIN d USING (feature) WINDOW w AS (PARTITION BY feature ORDER BY CASE WHEN slope < 0 THEN -bin ELSE bin END ROWS UNBOUNDED PRECEDING))
    SELECT feature, bin::INT AS bin, bad::BIGINT AS bad, (good + bad)::BIGINT AS total, (good + bad) / (ag + ab) AS total_rate, bad / (good + bad) AS brate, cb / (cg + cb) AS brate_cum, (bad / (good + bad)) / (ab / (ag + ab)) AS lift, {LAMB} AS woe, abs(cb / ab - cg / ag) AS ks,
      sum((g - b) * {LAMB}) OVER (PARTITION BY feature) AS iv, coalesce(greatest(auc, 1 - auc), 0) AS auc_cum, round(mean_tax, 6) AS mean_tax FROM u JOIN a USING (feature, bin)""",
)
def univariate_whole(spark, sf_dir):
    """Quantile bins in the order of the correlation's sign, AUC of the raw values per prefix, the mean of another column."""
    by = ["feature"]
    values = profiles.value_table(long3(spark, sf_dir, ["tax"]), by, {"tax": F.col("tax")})
    counted = values.withColumn("n", F.col("good") + F.col("bad"))
    rows = values.join(F.broadcast(binning.quantile_edges(counted, 10, rows="n")), "feature").withColumn("bin", binning.bin_of_quantile(F.col("value"), F.col("edges")))
    bins = kept(profiles.bins_of(rows, by, ["tax"]), "bins")
    got = profiles.profile(bins, by, profiles.class_totals(values, by), profiles.direction(values, by))
    return got.select("feature", "bin", "bad", "total", "total_rate", "brate", "brate_cum", "lift", "woe", "ks", "iv", "auc_cum", F.round(F.col("tax") / F.col("total"), 6).alias("mean_tax"))


@query(
    "univariate_alpha_whole",
    f"""WITH {sets_sql()}, {FILLED}, e AS ({_index_sql("(SELECT * FROM long3 WHERE value IS NOT NULL)")}), binned3 AS (SELECT feature, value, target, len(list_filter(inner_e, lambda k: k < value)) + 1 AS bin FROM filled JOIN e USING (feature)),
    d AS (SELECT feature, corr(value, target) AS slope FROM filled GROUP BY 1), p AS (SELECT feature, value, sum(1 - target) AS n0, sum(target) AS n1 FROM filled GROUP BY ALL), r AS (SELECT *, sum(n0) OVER (PARTITION BY feature ORDER BY value) AS c0 FROM p), a AS (SELECT feature, sum(n1 * (c0 - n0 / 2)) / (sum(n0) * sum(n1)) AS auc FROM r GROUP BY 1),
    c AS (SELECT feature, bin, sum(1 - target) AS good, sum(target) AS bad FROM binned3 GROUP BY ALL), u AS (SELECT c.*, slope, sum(good) OVER t AS ag, sum(bad) OVER t AS ab, (good + 0.1) / (sum(good) OVER t + 0.1 * count(*) OVER t) AS g, (bad + 0.1) / (sum(bad) OVER t + 0.1 * count(*) OVER t) AS b, sum(good) OVER w AS cg, sum(bad) OVER w AS cb
      FROM c JOIN d USING (feature) WINDOW t AS (PARTITION BY feature), w AS (PARTITION BY feature ORDER BY CASE WHEN slope < 0 THEN -bin ELSE bin END ROWS UNBOUNDED PRECEDING))
    SELECT feature, bin::INT AS bin, bad::BIGINT AS bad, (good + bad)::BIGINT AS total, (good + bad) / (ag + ab) AS pct, bad / (good + bad) AS brate, cb / (cg + cb) AS brate_cum, (bad / (good + bad)) / (ab / (ag + ab)) AS lift, ln(b / g) AS woe, abs(cb / ab - cg / ag) AS ks, sum((b - g) * ln(b / g)) OVER (PARTITION BY feature) AS iv, CASE WHEN slope < 0 THEN 1 - auc ELSE auc END AS auc FROM u JOIN a USING (feature)""",
)
def univariate_alpha_whole(spark, sf_dir):
    """Frequency bins, additive smoothing, AUC with the correlation's sign; missing values are -999."""
    by = ["feature"]
    values = profiles.value_table(long3(spark, sf_dir).withColumn("value", F.coalesce("value", F.lit(clean.SENTINEL))), by)
    edges = _frequency(values, by, F.col("value") != clean.SENTINEL)
    bins = kept(profiles.bins_of(values.join(F.broadcast(edges), "feature").withColumn("bin", binning.bin_of(F.col("value"), F.col("edges"))), by), "bins")
    slopes = kept(profiles.direction(values, by), "slopes")
    got = profiles.profile(bins, by, profiles.class_totals(values, by), slopes, "alpha", prefix_auc=False)
    auc = profiles.auc(bins, by).join(slopes, "feature").select("feature", F.when(F.col("slope") < 0, 1 - F.col("auc")).otherwise(F.col("auc")).alias("auc"))
    return got.join(F.broadcast(auc), "feature").select("feature", "bin", "bad", "total", F.col("total_rate").alias("pct"), "brate", "brate_cum", "lift", "woe", "ks", "iv", "auc")


_GROUP_SQL = f"""c AS (SELECT feature, grp, bin, sum(1 - target) AS good, sum(target) AS bad FROM binned3 GROUP BY ALL),
    u AS (SELECT *, good / sum(good) OVER t AS g, bad / sum(bad) OVER t AS b, sum(good) OVER t AS ag, sum(bad) OVER t AS ab, sum(good) OVER w AS cg, sum(bad) OVER w AS cb FROM c WINDOW t AS (PARTITION BY feature, grp), w AS (PARTITION BY feature, grp ORDER BY bin ROWS UNBOUNDED PRECEDING)),
    q AS (SELECT feature, grp, bin, bad, good + bad AS total, (good + bad) / (ag + ab) AS pct, bad / (good + bad) AS brate, (bad / (good + bad)) / (ab / (ag + ab)) AS lift, {LAMB} AS woe, abs(cb / ab - cg / ag) AS ks, (g - b) * {LAMB} AS iv FROM u)"""
_TABLE_COLUMNS = ("bad", "total", "total_pct", "brate", "lift", "woe", "ks", "iv")


@query(
    "univariate_bin_tables",
    f"""WITH {sets_sql()}, f AS (SELECT feature, value, target, CASE WHEN grp = 'oot' THEN 'valid' ELSE 'train' END AS grp FROM (SELECT feature, coalesce(value, -999.0) AS value, target, grp FROM long3)), e AS ({_index_sql("(SELECT * FROM f WHERE grp = 'train')")}),
    binned3 AS (SELECT f.*, len(list_filter(inner_e, lambda k: k < value)) + 1 AS bin FROM f JOIN e USING (feature)), {_GROUP_SQL}
    SELECT coalesce(t.feature, v.feature) AS feature, coalesce(t.bin, v.bin)::INT AS bin, {", ".join(f"{s}.{'pct' if c == 'total_pct' else c}{'::BIGINT' if c in ('bad', 'total') else ''} AS {c}_{n}" for s, n in (("t", "train"), ("v", "valid")) for c in _TABLE_COLUMNS)}
    FROM (SELECT * FROM q WHERE grp = 'train') t FULL JOIN (SELECT * FROM q WHERE grp = 'valid') v ON t.feature = v.feature AND t.bin = v.bin""",
)
def univariate_bin_tables(spark, sf_dir):
    """Train's and valid's bin tables side by side, a bin that only one of them has included."""
    by = ["feature", "grp"]
    long = long3(spark, sf_dir).withColumns({"value": F.coalesce("value", F.lit(clean.SENTINEL)), "grp": F.when(F.col("grp") == "oot", "valid").otherwise("train")})
    values = profiles.value_table(long, by)
    edges = _frequency(values, ["feature"], F.col("grp") == "train")
    c = values.join(F.broadcast(edges), "feature").withColumn("bin", binning.bin_of(F.col("value"), F.col("edges"))).groupBy(*by, "bin").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.lit(0).alias("wins"))
    flat = kept(values.select(*by).distinct().withColumn("slope", F.lit(1)), "flat")
    t = kept(profiles.profile(c, by, profiles.class_totals(values, by), flat, prefix_auc=False).withColumn("iv", F.col("bin_iv")).withColumnRenamed("total_rate", "total_pct"), "tables")
    side = lambda s: t.where(F.col("grp") == s).select("feature", "bin", *[F.col(x).alias(f"{x}_{s}") for x in _TABLE_COLUMNS])
    return side("train").join(side("valid"), ["feature", "bin"], "full")


@query(
    "univariate_three_sets",
    f"""WITH {sets_sql()}, {FILLED}, e AS ({_index_sql("(SELECT * FROM long3 WHERE grp = 'train' AND value IS NOT NULL)")}), binned3 AS (SELECT feature, grp, value, target, len(list_filter(inner_e, lambda k: k < value)) + 1 AS bin FROM filled JOIN e USING (feature)),
    c AS (SELECT feature, grp, bin, sum(1 - target) AS good, sum(target) AS bad FROM binned3 GROUP BY ALL), k AS (SELECT *, (good + 0.1) / (sum(good) OVER t + 0.1 * count(*) OVER t) AS g, (bad + 0.1) / (sum(bad) OVER t + 0.1 * count(*) OVER t) AS b, (good + bad) / sum(good + bad) OVER t AS pct FROM c WINDOW t AS (PARTITION BY feature, grp)),
    q AS (SELECT feature, grp, bin, bad, good + bad AS total, pct, bad / (good + bad) AS brate, ln(b / g) AS woe, sum((b - g) * ln(b / g)) OVER (PARTITION BY feature, grp) AS iv FROM k)
    SELECT t.feature, t.bin::INT AS bin, {", ".join(f"{'t' if n == 'train' else n}.{c}{'::BIGINT' if c in ('bad', 'total') else ''} AS {c}_{n}" for n in ("train", "test", "oot") for c in ("bad", "total", "pct", "brate", "woe", "iv"))}
    FROM (SELECT * FROM q WHERE grp = 'train') t LEFT JOIN (SELECT * FROM q WHERE grp = 'test') test ON test.feature = t.feature AND test.bin = t.bin LEFT JOIN (SELECT * FROM q WHERE grp = 'oot') oot ON oot.feature = t.feature AND oot.bin = t.bin""",
)
def univariate_three_sets(spark, sf_dir):
    """Train, test and oot on train's bins, merged on the bin."""
    t = _three_sets(_filled(spark, sf_dir))
    side = lambda s: t.where(F.col("grp") == s).select("feature", "bin", *[F.col(x).alias(f"{x}_{s}") for x in ("bad", "total", "pct", "brate", "woe", "iv")])
    return side("train").join(side("test"), ["feature", "bin"], "left").join(side("oot"), ["feature", "bin"], "left")


def _three_sets(values):
    by = ["feature", "grp"]
    c = _train_binned(values).groupBy(*by, "bin").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.lit(0).alias("wins"))
    flat = kept(values.select(*by).distinct().withColumn("slope", F.lit(1)), "flat")
    return kept(profiles.profile(c, by, profiles.class_totals(values, by), flat, "alpha", prefix_auc=False).withColumnRenamed("total_rate", "pct"), "three-sets")


@query(
    "feature_report",
    f"""WITH {sets_sql()}, {FILLED}, v AS (SELECT feature, value, target, CASE WHEN grp = 'oot' THEN 'valid' ELSE 'train' END AS grp FROM filled),
    e AS ({_index_sql('v', by='feature, grp')}), x AS (SELECT feature, grp, target, len(list_filter(inner_e, lambda k: k < value)) AS bin FROM v JOIN e USING (feature, grp)), c AS (SELECT feature, grp, bin, sum(1 - target) AS good, sum(target) AS bad FROM x GROUP BY ALL),
    s AS (SELECT *, good / sum(good) OVER w AS g, bad / sum(bad) OVER w AS b FROM c WINDOW w AS (PARTITION BY feature, grp)), iv AS (SELECT feature, sum(CASE WHEN grp = 'train' THEN (g - b) * {LAMB} END) AS iv_train, sum(CASE WHEN grp = 'valid' THEN (g - b) * {LAMB} END) AS iv_valid FROM s GROUP BY 1),
    p AS (SELECT feature, grp, value, sum(1 - target) AS n0, sum(target) AS n1 FROM v GROUP BY ALL), r AS (SELECT *, sum(n0) OVER w / sum(n0) OVER t AS c0, sum(n1) OVER w / sum(n1) OVER t AS c1 FROM p WINDOW w AS (PARTITION BY feature, grp ORDER BY value), t AS (PARTITION BY feature, grp)),
    ks AS (SELECT feature, max(CASE WHEN grp = 'train' THEN abs(c1 - c0) END) AS ks_train, max(CASE WHEN grp = 'valid' THEN abs(c1 - c0) END) AS ks_valid FROM r GROUP BY 1),
    y AS (SELECT v.feature, v.grp, len(list_filter(inner_e, lambda k: k < value)) AS bin FROM v JOIN e ON e.feature = v.feature AND e.grp = 'train'), n AS (SELECT feature, bin, count(*) FILTER (grp = 'train') AS a, count(*) FILTER (grp = 'valid') AS z FROM y GROUP BY ALL),
    h AS (SELECT feature, a / sum(a) OVER (PARTITION BY feature) AS p, z / sum(z) OVER (PARTITION BY feature) AS q FROM n), psi AS (SELECT feature, sum((p - q) * ln((p + 0.001) / (q + 0.001))) AS csi FROM h GROUP BY 1)
    SELECT feature, iv_train, iv_valid, ks_train, ks_valid, csi, iv_valid / iv_train AS ratio FROM iv JOIN ks USING (feature) JOIN psi USING (feature)""",
)
def feature_report(spark, sf_dir):
    """One row per feature: IV on each set's own bins, KS of the raw values, drift on train's bins, and the ratio of IVs."""
    from weftline.operators.ranking import curve

    by = ["feature", "grp"]
    long = long3(spark, sf_dir).withColumns({"value": F.coalesce("value", F.lit(clean.SENTINEL)), "grp": F.when(F.col("grp") == "oot", "valid").otherwise("train")})
    values = profiles.value_table(long, by)
    edges = kept(_frequency(values, by), "set-edges")
    own = values.join(F.broadcast(edges), by).withColumn("bin", binning.bin_of(F.col("value"), F.col("edges"))).groupBy(*by, "bin").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    iv = woe.information_value(woe.bin_table(own, "lambda", by), by)
    ks = curve(values.select(*by, F.col("value").alias("score"), F.col("good").alias("n0"), F.col("bad").alias("n1")), by).groupBy(*by).agg(F.max("gap").alias("ks"))
    of_train = edges.where("grp = 'train'").drop("grp")
    psi = profiles.lambda_psi(values.join(F.broadcast(of_train), "feature").withColumn("bin", binning.bin_of(F.col("value"), F.col("edges"))).withColumn("n", F.col("good") + F.col("bad")), ["feature"], F.col("grp") == "train")
    pick = lambda c, s: F.max(F.when(F.col("grp") == s, F.col(c))).alias(f"{c}_{s}")
    wide = iv.join(ks, by).groupBy("feature").agg(*[pick(c, s) for c in ("iv", "ks") for s in ("train", "valid")])
    return wide.join(psi.withColumnRenamed("psi", "csi"), "feature").withColumn("ratio", F.try_divide(F.col("iv_valid"), F.col("iv_train")))


@query(
    "feature_summary_sets",
    f"""WITH {sets_sql()}, {FILLED}, e AS ({_index_sql("(SELECT * FROM long3 WHERE grp = 'train' AND value IS NOT NULL)")}), x AS (SELECT feature, grp, target, len(list_filter(inner_e, lambda k: k < value)) AS bin FROM filled JOIN e USING (feature)), c AS (SELECT feature, grp, bin, sum(1 - target) AS good, sum(target) AS bad FROM x GROUP BY ALL),
    k AS (SELECT feature, grp, bin, (good + 0.1) / (sum(good) OVER t + 0.1 * count(*) OVER t) AS g, (bad + 0.1) / (sum(bad) OVER t + 0.1 * count(*) OVER t) AS b, (good + bad) / sum(good + bad) OVER t AS p FROM c WINDOW t AS (PARTITION BY feature, grp)), i AS (SELECT feature, grp, sum((b - g) * ln(b / g)) AS iv FROM k GROUP BY ALL),
    w AS (SELECT feature, bin, coalesce(max(CASE WHEN grp = 'train' THEN p END), 0) AS a, coalesce(max(CASE WHEN grp = 'test' THEN p END), 0) AS t, coalesce(max(CASE WHEN grp = 'oot' THEN p END), 0) AS o FROM k GROUP BY ALL),
    s AS (SELECT feature, sum((a - t) * ln((a + 0.001) / (t + 0.001))) AS csi_test, sum((a - o) * ln((a + 0.001) / (o + 0.001))) AS csi_oot FROM w GROUP BY 1), v AS (SELECT feature, max(CASE WHEN grp = 'train' THEN iv END) AS iv_train, max(CASE WHEN grp = 'test' THEN iv END) AS iv_test, max(CASE WHEN grp = 'oot' THEN iv END) AS iv_oot FROM i GROUP BY 1)
    SELECT feature, iv_train, iv_test, iv_oot, csi_test, csi_oot, iv_oot / iv_train AS ratio FROM v JOIN s USING (feature)""",
)
def feature_summary_sets(spark, sf_dir):
    values = _filled(spark, sf_dir)
    t = _three_sets(values)
    rows = _train_binned(values).withColumn("n", F.col("good") + F.col("bad"))
    psi = lambda other: profiles.lambda_psi(rows.where(F.col("grp").isin("train", other)), ["feature"], F.col("grp") == "train").withColumnRenamed("psi", f"csi_{other}")
    iv = t.groupBy("feature").agg(*[F.max(F.when(F.col("grp") == s, F.col("iv"))).alias(f"iv_{s}") for s in ("train", "test", "oot")])
    return iv.join(psi("test"), "feature").join(psi("oot"), "feature").withColumn("ratio", F.try_divide(F.col("iv_oot"), F.col("iv_train")))
