"""Boosted trees over a grid of settings, their importances and predictions, and fusion of all score subsets."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from weftline.operators import binning, boosting, clean
from weftline.plans.base import FEATURES, SAMPLE_SQL, sample
from weftline.plans.registry import query
from weftline.sources.tables import fresh_path

#: The grid: leaves per tree, both penalties, learning rates, rows of a leaf at least (fixed values); numbers of trees.
LEAVES, ALPHAS, LAMBDAS, RATES, LEAST = (2, 3), (0, 10, 20, 30, 40), (0, 10, 20, 30, 40), (0.03, 0.04, 0.05), 100
STAGES = (3, 4, 5)
BINS = 6

GRID = [boosting.Setting(leaves, float(a), float(m), r, LEAST) for leaves, a, m, r in product(LEAVES, ALPHAS, LAMBDAS, RATES)]
FEW = [boosting.Setting(2, 0.0, 10.0, 0.05, LEAST), boosting.Setting(3, 0.0, 0.0, 0.3, LEAST), boosting.Setting(3, 20.0, 10.0, 0.3, LEAST)]


def _part():
    day = F.col("l_shipdate")
    return F.when(day < F.lit("1997-01-01").cast("timestamp_ntz"), "train").when(day < F.lit("1998-01-01").cast("timestamp_ntz"), "test").otherwise("valid")


def _rows(spark, sf_dir):
    """The sample with part, missing values null, and the bin of each feature by the training rows' edges."""
    x = sample(spark, sf_dir).withColumns({"part": _part()} | {f: clean.present(F.col(f).cast("double"), True) for f in FEATURES})
    long = clean.long_form(x.where("part = 'train'"), list(FEATURES), [])
    edges = {r.feature: r.edges for r in binning.quantile_edges(long, BINS).collect()}  # a row per feature
    return x, {f: F.coalesce(binning.bin_of_quantile(F.col(f), F.array(*[F.lit(e) for e in edges[f]])), F.lit(0)) for f in FEATURES}


def _fit(spark, sf_dir, settings, rounds):
    x, bins = _rows(spark, sf_dir)
    cell = boosting.cells(x, bins, "target", "part")
    model, cell = boosting.fit(cell, list(FEATURES), BINS + 1, settings, rounds)
    return x, bins, model, cell


def _boost_sql(settings, rounds: int) -> str:
    """CTEs up to m{rounds}: margins of all cells and models, and k{r} and s{r}, the splits of tree r."""
    at = ", ".join(repr(i / BINS) for i in range(BINS + 1))
    bin_ = lambda f: f"CASE WHEN {f} IS NULL THEN 0 ELSE greatest(1, len(list_filter(e_{f}, lambda e: e < {f}))) END"
    out = [
        SAMPLE_SQL,
        "x AS (SELECT l_orderkey, l_linenumber, target, CASE WHEN l_shipdate < TIMESTAMP '1997-01-01' THEN 'train' WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 'test' ELSE 'valid' END AS part, " + ", ".join(f"CASE WHEN {f} >= 0 THEN {f}::DOUBLE END AS {f}" for f in FEATURES) + " FROM sample)",
        "edges AS (SELECT " + ", ".join(f"list_distinct(quantile_cont({f}, [{at}])) AS e_{f}" for f in FEATURES) + " FROM x WHERE part = 'train')",
        "rb AS MATERIALIZED (SELECT l_orderkey, l_linenumber, target, part, [" + ", ".join(bin_(f) for f in FEATURES) + "] AS bins FROM x, edges)",
        "cell AS MATERIALIZED (SELECT row_number() OVER () AS c, bins, part, count(*) FILTER (target = 0) AS n0, count(*) FILTER (target = 1) AS n1 FROM rb GROUP BY bins, part)",
        f"cb AS MATERIALIZED (SELECT c, i - 1 AS f, bins[i] AS b FROM cell, (SELECT unnest(range(1, {len(FEATURES) + 1})) AS i) WHERE part = 'train')",
        "st(model, leaves, alpha, lam, rate, least) AS (VALUES " + ", ".join(f"({i}, {s.leaves}, {s.alpha!r}::DOUBLE, {s.lam!r}::DOUBLE, {s.rate!r}::DOUBLE, {s.least_rows})" for i, s in enumerate(settings)) + ")",
        "m0 AS MATERIALIZED (SELECT c, model, (SELECT ln(sum(n1)::DOUBLE / sum(n0)::DOUBLE) FROM cell WHERE part = 'train') AS margin FROM cell, st)",
    ]
    soft = lambda g: f"(sign({g}) * greatest(abs({g}) - alpha, 0))"
    score = lambda g, h: f"{soft(g)} * {soft(g)} / ({h} + lam)"

    def best(name: str, grads: str, leaf: str, only: str) -> str:
        """The best split of every model, over the leaves of a table of gradients."""
        return f"""{name} AS MATERIALIZED (SELECT model, leaf, f, b, round(gain, 9) AS gain, tn, tg, th FROM (
  SELECT *, {score("lg", "lh")} + {score("tg - lg", "th - lh")} - {score("tg", "th")} AS gain FROM (
    SELECT model, leaf, f, b, sum(g) OVER up AS lg, sum(h) OVER up AS lh, sum(n) OVER up AS ln_, sum(g) OVER al AS tg, sum(h) OVER al AS th, sum(n) OVER al AS tn
    FROM (SELECT model, {leaf} AS leaf, f, b, sum(g) AS g, sum(h) AS h, sum(n) AS n FROM {grads} JOIN cb USING (c) GROUP BY ALL)
    WINDOW up AS (PARTITION BY model, leaf, f ORDER BY b), al AS (PARTITION BY model, leaf, f)) JOIN st USING (model) WHERE ln_ >= least AND tn - ln_ >= least{only})
  WHERE round(gain, 9) > 0 QUALIFY row_number() OVER (PARTITION BY model ORDER BY round(gain, 9) DESC, leaf, f, b) = 1)"""

    for r in range(rounds):
        out.append(f"g{r} AS MATERIALIZED (SELECT c, model, (n0 + n1) * p - n1 AS g, (n0 + n1) * p * (1 - p) AS h, n0 + n1 AS n FROM (SELECT c, model, n0, n1, 1 / (1 + exp(-margin)) AS p FROM m{r} JOIN cell USING (c) WHERE part = 'train'))")
        out.append(best(f"k{r}", f"g{r}", "0", ""))
        out.append(f"l{r} AS MATERIALIZED (SELECT c, st.model, CASE WHEN bins[f + 1] > b THEN 1 ELSE 0 END AS leaf FROM cell CROSS JOIN st LEFT JOIN k{r} ON k{r}.model = st.model)")
        out.append(f"gl{r} AS MATERIALIZED (SELECT g{r}.*, leaf FROM g{r} JOIN l{r} USING (c, model))")
        out.append(best(f"s{r}", f"gl{r}", "leaf", " AND leaves > 2"))
        out.append(f"e{r} AS MATERIALIZED (SELECT l{r}.c, l{r}.model, CASE WHEN s.leaf = l{r}.leaf AND bins[s.f + 1] > s.b THEN 2 ELSE l{r}.leaf END AS leaf FROM l{r} JOIN cell USING (c) LEFT JOIN s{r} s ON s.model = l{r}.model)")
        out.append(f"v{r} AS MATERIALIZED (SELECT model, leaf, -rate * {soft('g')} / (h + lam) AS v FROM (SELECT e{r}.model, leaf, sum(g) AS g, sum(h) AS h FROM e{r} JOIN g{r} USING (c, model) GROUP BY ALL) JOIN st USING (model))")
        out.append(f"m{r + 1} AS MATERIALIZED (SELECT m{r}.c, m{r}.model, margin + coalesce(v, 0) AS margin FROM m{r} JOIN e{r} USING (c, model) LEFT JOIN v{r} USING (model, leaf))")
    return "WITH " + ",\n".join(out)


_STAGED = " UNION ALL ".join(f"SELECT model, {t} AS trees, part, round(1 / (1 + exp(-margin)), 9) AS score, n0, n1 FROM m{t} JOIN cell USING (c)" for t in STAGES)


@query(
    "boosted_grid",
    f"""{_boost_sql(GRID, max(STAGES))},
p AS (SELECT model, trees, part, score, sum(n0) AS n0, sum(n1) AS n1 FROM ({_STAGED}) GROUP BY ALL),
q AS (SELECT model, trees, part, abs(sum(n1) OVER up / sum(n1) OVER al - sum(n0) OVER up / sum(n0) OVER al) AS gap FROM p WINDOW up AS (PARTITION BY model, trees, part ORDER BY score), al AS (PARTITION BY model, trees, part)),
w AS (SELECT model, trees, round(max(gap) FILTER (part = 'train'), 6) AS train_ks, round(max(gap) FILTER (part = 'test'), 6) AS test_ks, round(max(gap) FILTER (part = 'valid'), 6) AS valid_ks FROM q GROUP BY ALL)
SELECT leaves::INT AS leaves, alpha, lam, rate, trees::INT AS trees, train_ks, test_ks, valid_ks, row_number() OVER (ORDER BY valid_ks DESC, model, trees)::INT AS place FROM w JOIN st USING (model)""",
)
def boosted_grid(spark, sf_dir):
    """KS on training, test and validation rows of 450 settings: 150 models in one course of passes, each scored after three numbers of trees."""
    *_, model, cell = _fit(spark, sf_dir, GRID, max(STAGES))
    told = boosting.measured(model, cell, list(STAGES)).groupBy("model", "trees")
    wide = told.agg(*[F.round(F.max(F.when(F.col("part") == p, F.col("ks"))), 6).alias(f"{p}_ks") for p in ("train", "test", "valid")])
    settings = spark.createDataFrame([(i, s.leaves, s.alpha, s.lam, s.rate) for i, s in enumerate(GRID)], "model int, leaves int, alpha double, lam double, rate double")
    from pyspark.sql import Window as W

    placed = wide.join(F.broadcast(settings), "model").withColumn("place", F.row_number().over(W.orderBy(F.desc("valid_ks"), "model", "trees")))  # a row per setting
    return placed.select("leaves", "alpha", "lam", "rate", "trees", "train_ks", "test_ks", "valid_ks", "place")


ROUNDS = 4
_NODES = " UNION ALL ".join(
    f"SELECT model, {r} AS tree, 0 AS split, leaf, f, b, gain, tn, tg, th FROM k{r} UNION ALL SELECT model, {r}, 1, leaf, f, b, gain, tn, tg, th FROM s{r}" for r in range(ROUNDS)
)
_NAMES = "[" + ", ".join(f"'{f}'" for f in FEATURES) + "]"


@query("boosted_nodes", f"{_boost_sql(FEW, ROUNDS)} SELECT model::INT AS model, tree::INT AS tree, split::INT AS split, leaf::INT AS leaf, {_NAMES}[f + 1] AS feature, b::INT AS bin, round(gain, 6) AS gain, tn::BIGINT AS rows, round(tg, 6) + 0.0 AS g, round(th, 6) AS h FROM ({_NODES})")
def boosted_nodes(spark, sf_dir):
    """Every split of three models: where it is, what it gains, and what its leaf held. A sum that rounds to nothing is 0, not -0."""
    *_, model, _ = _fit(spark, sf_dir, FEW, ROUNDS)
    told = spark.createDataFrame(model.nodes(), boosting.NODES)
    return told.withColumns({"gain": F.round("gain", 6), "rows": F.col("rows").cast("long"), "g": F.round("g", 6) + F.lit(0.0), "h": F.round("h", 6)})


@query(
    "boosted_importances",
    f"{_boost_sql(FEW, ROUNDS)} SELECT model::INT AS model, {_NAMES}[f + 1] AS feature, count(*) AS splits, round(sum(gain), 4) AS gain, row_number() OVER (PARTITION BY model ORDER BY round(sum(gain), 6) DESC, {_NAMES}[f + 1])::INT AS place FROM ({_NODES}) GROUP BY model, f",
)
def boosted_importances(spark, sf_dir):
    """Features of three models by the number of their splits and by what these gain."""
    *_, model, _ = _fit(spark, sf_dir, FEW, ROUNDS)
    return boosting.importances(spark.createDataFrame(model.nodes(), boosting.NODES)).withColumn("gain", F.round("gain", 4))


@query(
    "boosted_predictions",
    f"{_boost_sql(FEW, ROUNDS)} SELECT l_orderkey, l_linenumber, rb.part AS sample_type, rb.target::INT AS target, round(1 / (1 + exp(-margin)), 6) AS p, round_even(550 - 60 / ln(2) * margin, 0) AS score FROM rb JOIN cell ON cell.bins = rb.bins AND cell.part = rb.part JOIN m{ROUNDS} m ON m.c = cell.c AND m.model = 2",
)
def boosted_predictions(spark, sf_dir):
    """Rows with a model's probability, its points and their set, kept by set and read back; the model is an expression."""
    from weftline.operators.ranking import points
    from weftline.sources.tables import write_partitions

    x, bins, model, _ = _fit(spark, sf_dir, FEW, ROUNDS)
    binned = x.select("l_orderkey", "l_linenumber", "target", F.col("part").alias("sample_type"), *[c.alias(f"b_{f}") for f, c in bins.items()])
    p = boosting.probability(model, 2, ROUNDS, {f: F.col(f"b_{f}") for f in FEATURES})
    path = fresh_path(spark, "boosted-predictions")
    write_partitions(binned.withColumn("p", p).select("l_orderkey", "l_linenumber", "target", F.round("p", 6).alias("p"), points(F.col("p")).alias("score"), "sample_type"), path, ["sample_type"])
    return spark.read.parquet(path)


def _fusion_sql() -> str:
    """Every subset's weights by elimination on the sums of products, step by step."""
    from weftline.operators.fusion import subsets

    names = list(FEATURES)
    z = {f: f"z{i}" for i, f in enumerate(names)}
    products = [f"sum({z[a]} * {z[b]}) AS {z[a]}_{z[b]}" for i, a in enumerate(names) for b in names[i:]]
    out = [
        SAMPLE_SQL,
        "x AS (SELECT target, CASE WHEN l_shipdate < TIMESTAMP '1997-01-01' THEN 'train' WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 'test' ELSE 'valid' END AS part, " + ", ".join(f"CASE WHEN {f} >= 0 THEN {f}::DOUBLE END AS {f}" for f in names) + " FROM sample)",
        "s AS (SELECT " + ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in names) + " FROM x WHERE part = 'train')",
        "z AS MATERIALIZED (SELECT target, part, " + ", ".join(f"coalesce(({f} - m_{f}) / s_{f}, 0) AS {z[f]}" for f in names) + " FROM x, s)",
        "g AS MATERIALIZED (SELECT count(*)::DOUBLE AS one_one, sum(target)::DOUBLE AS one_y, " + ", ".join(f"sum({z[f]}) AS one_{z[f]}, sum({z[f]} * target) AS {z[f]}_y" for f in names) + ", " + ", ".join(products) + " FROM z WHERE part = 'train')",
    ]
    scored = []
    for i, chosen in enumerate(subsets(names)):
        columns = ["one", *[z[f] for f in chosen]]
        at = lambda a, b, c=columns: f"{a}_{b}" if b == "y" or c.index(a) <= c.index(b) else f"{b}_{a}"
        k, before = len(columns), f"w{i}_start"
        out.append(f"{before} AS (SELECT " + ", ".join(f"{at(columns[r], c)} AS a{r}_{j}" for r in range(k) for j, c in enumerate([*columns, "y"])) + " FROM g)")
        for p in range(k):
            now = f"w{i}_{p}"
            out.append(f"{now} AS MATERIALIZED (SELECT " + ", ".join(f"a{r}_{j}" if r == p else f"a{r}_{j} - a{r}_{p} * a{p}_{j} / a{p}_{p} AS a{r}_{j}" for r in range(k) for j in range(k + 1)) + f" FROM {before})")
            before = now
        terms = " + ".join(f"a{r}_{k} / a{r}_{r}" + ("" if r == 0 else f" * {columns[r]}") for r in range(k))
        scored.append(f"SELECT {len(chosen)} AS n_scores, '{'+'.join(chosen)}' AS scores, part, target, round({terms}, 6) AS score FROM z, {before}")
    return "WITH " + ",\n".join(out) + f""",
p AS (SELECT n_scores, scores, part, score, count(*) FILTER (target = 0) AS n0, count(*) FILTER (target = 1) AS n1 FROM ({' UNION ALL '.join(scored)}) GROUP BY ALL),
q AS (SELECT n_scores, scores, part, abs(sum(n1) OVER up / sum(n1) OVER al - sum(n0) OVER up / sum(n0) OVER al) AS gap FROM p WINDOW up AS (PARTITION BY scores, part ORDER BY score), al AS (PARTITION BY scores, part))
SELECT n_scores::INT AS n_scores, scores, round(max(gap) FILTER (part = 'train'), 6) AS train_ks, round(max(gap) FILTER (part = 'test'), 6) AS test_ks, round(max(gap) FILTER (part = 'valid'), 6) AS valid_ks FROM q GROUP BY ALL"""


def _fused(spark, sf_dir):
    from weftline.operators import fusion

    x = sample(spark, sf_dir).withColumns({"part": _part()} | {f: clean.present(F.col(f).cast("double"), True) for f in FEATURES})
    return x, fusion.standardised(x, list(FEATURES), F.col("part") == "train")


def _wide_ks(told):
    return told.groupBy("n_scores", "scores").agg(*[F.round(F.max(F.when(F.col("part") == p, F.col("ks"))), 6).alias(f"{p}_ks") for p in ("train", "test", "valid")])


@query("fusion_subsets", _fusion_sql())
def fusion_subsets(spark, sf_dir):
    """KS of the linear fusion of every combination of two scores or more, all from one table of products."""
    from weftline.operators import fusion

    x, z = _fused(spark, sf_dir)
    products = fusion.gram(x.where("part = 'train'"), z, F.col("target"))
    weights = fusion.least_squares(products, list(z), fusion.subsets(list(z)))
    return _wide_ks(fusion.measured(x, z, weights, "target", "part"))


@query("fusion_subsets_logistic")
def fusion_subsets_logistic(spark, sf_dir):
    """As fusion_subsets with logistic models; a pass an iteration for all combinations."""
    from weftline.operators import fusion

    x, z = _fused(spark, sf_dir)
    weights = fusion.logistic(x.where("part = 'train'"), z, F.col("target"), fusion.subsets(list(z)))
    return _wide_ks(fusion.measured(x, z, weights, "target", "part"))
