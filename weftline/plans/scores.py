"""Score bins and boxes, edges by every rule, text statistics, drift over JSON results, and the named score datasets."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import times, tokens
from weftline.operators import binning, clean, drift, joins, profiles, ranking, text
from weftline.operators.prefix import running, with_totals
from weftline.plans.bins import GUARD_SQL
from weftline.plans.base import FEATURES, long_sample, long_sql, value_counts
from weftline.plans.registry import query
from weftline.sources.tables import kept, table

SCORES_SQL = "x AS (SELECT o_totalprice / 1000 AS score, (o_orderstatus = 'P')::INT AS target, (o_orderdate < TIMESTAMP '1998-01-01')::INT AS train, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS weight FROM orders)"


def _scores(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select((F.col("o_totalprice") / 1000).alias("score"), (F.col("o_orderstatus") == "P").cast("int").alias("target"), (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")).cast("int").alias("train"), F.when(F.col("o_orderkey") % 3 == 0, 2).otherwise(1).alias("weight"))


def _ends(x):
    return x.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))


@query("score_bins_open", f"WITH {SCORES_SQL}, m AS (SELECT min(score) AS lo, max(score) AS hi FROM x), e AS (SELECT list_transform(range(floor(lo / 40)::BIGINT + 1, floor(hi / 40)::BIGINT + 1), lambda k: k * 40.0) AS e FROM m) SELECT (len(list_filter(e, lambda k: k <= score)) + 1)::INT AS bin, count(*) AS n, max(len(e))::INT AS n_edges FROM x, e GROUP BY 1")
def score_bins_open(spark, sf_dir):
    """Multiples of a width strictly above the least and up to the greatest score, open ends, closed on the left."""
    x = _scores(spark, sf_dir)
    edges = _ends(x).select(binning.score_edge_array(F.col("lo"), F.col("hi"), 40.0).alias("edges"))
    return x.crossJoin(F.broadcast(edges)).groupBy(binning.bin_of(F.col("score"), F.col("edges"), True).alias("bin")).agg(F.count("*").alias("n"), F.max(F.size("edges") - 2).alias("n_edges"))  # one row of edges


ADAPT_SQL = """m AS (SELECT min(score) AS lo, max(score) AS hi FROM x), w AS (SELECT {cut} * power(2.0, k) AS cut, k FROM (SELECT unnest(range(-12, 13)) AS k)),
    c AS (SELECT cut, k, floor(hi / cut) - floor(lo / cut) AS n FROM w, m), dn AS (SELECT coalesce(max(k) FILTER (n >= 5 AND k <= 0), -99) AS k, min(k) FILTER (cut >= 2 AND k <= 0) AS least FROM c), s AS (SELECT greatest(k, least) AS k FROM dn),
    ch AS (SELECT min(c.k) AS k FROM c, s WHERE c.k >= s.k AND n <= 20), e AS (SELECT list_filter(list_transform(range(floor(lo / cut)::BIGINT + 1, floor(hi / cut)::BIGINT + 1), lambda i: i * cut), lambda v: v > 0) AS e FROM c, ch, m WHERE c.k = ch.k)"""


@query("score_psi_adaptive", f"WITH {SCORES_SQL}, {ADAPT_SQL.format(cut='320.0')}, b AS (SELECT len(list_filter(e, lambda v: v <= score)) + 1 AS bin, train FROM x, e), n AS (SELECT bin, sum(train) AS a, sum(1 - train) AS z FROM b GROUP BY 1), q AS (SELECT bin, a, z, a / sum(a) OVER () AS p, z / sum(z) OVER () AS q FROM n) SELECT bin::INT AS bin, a::BIGINT AS n_base, z::BIGINT AS n_now, p AS base_share, q AS now_share, sum((p - q) * CASE WHEN q = 0 THEN 1.0 WHEN p = 0 THEN -1.0 ELSE ln(p / q) END) OVER () AS psi FROM q")
def score_psi_adaptive(spark, sf_dir):
    """Drift of a score and its distribution on bins whose width is halved from 320 until there are 5 edges, or doubled until there are 20 at most."""
    x = _scores(spark, sf_dir)
    edges = _ends(x).select(binning.adaptive_edge_array(F.col("lo"), F.col("hi"), 320.0).alias("edges"))
    b = x.crossJoin(F.broadcast(edges)).select(F.lit("score").alias("feature"), binning.bin_of(F.col("score"), F.col("edges"), True).alias("bin"), "train")  # one row of edges
    s = kept(drift.shares(b, F.col("train") == 1), "score-shares")
    return s.crossJoin(F.broadcast(drift.psi(s, "guard1").select("psi"))).select("bin", F.col("n_first").alias("n_base"), F.col("n_second").alias("n_now"), F.col("p").alias("base_share"), F.col("q").alias("now_share"), "psi")


@query("score_bins_doubled", f"WITH {SCORES_SQL}, {ADAPT_SQL.format(cut='3.0')} SELECT (len(list_filter(e, lambda v: v <= score)) + 1)::INT AS bin, count(*) AS n FROM x, e GROUP BY 1")
def score_bins_doubled(spark, sf_dir):
    x = _scores(spark, sf_dir)
    edges = _ends(x).select(binning.adaptive_edge_array(F.col("lo"), F.col("hi"), 3.0).alias("edges"))
    return x.crossJoin(F.broadcast(edges)).groupBy(binning.bin_of(F.col("score"), F.col("edges"), True).alias("bin")).agg(F.count("*").alias("n"))  # one row of edges


@query("equal_width_ends", "WITH m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), e AS (SELECT list_transform(range(0, 11), lambda i: lo + i * (hi - lo) / 10) AS e FROM m), b AS (SELECT CASE WHEN l_extendedprice > e[1] AND l_extendedprice <= e[11] THEN len(list_filter(e, lambda v: v < l_extendedprice)) END AS finite, least(greatest(len(list_filter(e[2:10], lambda v: v < l_extendedprice)) + 1, 1), 10) AS open FROM lineitem, e) SELECT finite::INT AS finite, open::INT AS open, count(*) AS n FROM b GROUP BY ALL")
def equal_width_ends(spark, sf_dir):
    """Equal widths with finite ends, which the least value falls out of, and with open ends."""
    x = table(spark, sf_dir, "lineitem").select("l_extendedprice")
    ends = x.agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))
    e = ends.select(binning.equal_width(F.col("lo"), F.col("hi"), 10).alias("f"), binning.equal_width(F.col("lo"), F.col("hi"), 10, "open").alias("o"))
    v = F.col("l_extendedprice")
    return x.crossJoin(F.broadcast(e)).groupBy(binning.bin_of(v, F.col("f")).alias("finite"), binning.bin_of(v, F.col("o")).alias("open")).agg(F.count("*").alias("n"))  # one row of edges


@query("floor_edges", f"WITH {long_sql()}, e AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e, min(value) AS least FROM long WHERE value IS NOT NULL GROUP BY 1) SELECT feature, CASE WHEN e[2] <> 0 AND least > 0 THEN 0.0::DOUBLE ELSE -0.001 END AS first_edge, e[2] AS second_edge FROM e")
def floor_edges(spark, sf_dir):
    """The first edge where negatives are missing."""
    per = value_counts(spark, sf_dir).where("value IS NOT NULL")
    e = binning.quantile_edges(per, 5, rows="n").join(per.groupBy("feature").agg(F.min("value").alias("least")), "feature")
    fixed = binning.floor_edge(F.col("edges"), F.col("least"))
    return e.select("feature", fixed[0].alias("first_edge"), fixed[1].alias("second_edge"))


@query("upper_edges_clipped", "WITH v AS (SELECT list_sort(list(l_extendedprice)) AS v FROM lineitem WHERE l_linestatus = 'F'), u AS (SELECT list_sort(list_distinct(list_transform(range(0, 11), lambda i: v[(floor(i * (len(v) - 1) / 10.0))::INT + 1]))) AS u FROM v) SELECT CASE WHEN l_extendedprice IS NULL THEN -999.0 ELSE coalesce(list_filter(u, lambda k: k >= l_extendedprice)[1], u[len(u)]) END AS upper, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 0 END AS code, count(*) AS n FROM lineitem, u GROUP BY ALL")
def upper_edges_clipped(spark, sf_dir):
    """Values beyond the greatest edge are clipped to it; a category's code, 0 for one that isn't known."""
    x = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_returnflag", "l_linestatus")
    counted = x.where("l_linestatus = 'F'").groupBy(F.lit("p").alias("feature"), F.col("l_extendedprice").alias("value")).agg(F.count("*").alias("n_rows"))
    run = running(with_totals(counted, {"total": "n_rows"}, ["feature"]), "value", {"upto": "n_rows"}, ["feature"])
    place = F.floor(F.col("i") * (F.col("total") - 1) / 10)
    at = run.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(10)))).where((place < F.col("upto")) & (place >= F.col("upto") - F.col("n_rows")))
    edges = at.agg(F.array_sort(F.collect_set("value")).alias("edges"))  # eleven values
    upper = binning.upper_edge(F.col("l_extendedprice"), F.col("edges"))
    return x.crossJoin(F.broadcast(edges)).groupBy(upper.alias("upper"), binning.code_of(F.col("l_returnflag"), {"A": 1, "R": 2}).alias("code")).agg(F.count("*").alias("n"))


_TENTHS, _NINTHS = ", ".join(repr(i / 10) for i in range(11)), ", ".join(repr(i / 9) for i in range(10))


@query(
    "safe_bin_edges",
    f"""WITH {long_sql()}, q AS (SELECT feature, count(DISTINCT value) AS u, quantile_cont(value, [{_TENTHS}]) AS a, quantile_cont(value, [{_NINTHS}]) AS b, quantile_cont(value, [0, 0.5, 1.0]) AS m FROM long WHERE value IS NOT NULL GROUP BY feature),
    r AS (SELECT *, CASE WHEN u <= 10 THEN 'identity' WHEN len(list_distinct(a)) = 11 THEN 'n' WHEN len(list_distinct(b)) = 10 THEN 'n-1' ELSE 'median' END AS rung FROM q)
    SELECT feature, rung, unnest(CASE rung WHEN 'n' THEN a WHEN 'n-1' THEN b WHEN 'median' THEN list_distinct(m) ELSE [NULL] END) AS edge FROM r""",
)
def safe_bin_edges(spark, sf_dir):
    return binning.safe_edges(long_sample(spark, sf_dir), 10).select("feature", "rung", F.explode(F.coalesce("edges", F.array(F.lit(None).cast("double")))).alias("edge"))


# boxes and metrics


@query("score_box_sets", f"WITH {SCORES_SQL}, n AS (SELECT floor(score / 40)::BIGINT AS bin, train, sum(1 - target)::BIGINT AS good, sum(target)::BIGINT AS bad FROM x GROUP BY ALL), b AS (SELECT *, bad / (good + bad) AS badrate, (good + bad) / sum(good + bad) OVER (PARTITION BY train) AS population_pct, sum(good + bad) OVER (PARTITION BY train ORDER BY bin ROWS UNBOUNDED PRECEDING) / sum(good + bad) OVER (PARTITION BY train) AS cumsum_pct FROM n) SELECT coalesce(t.bin, v.bin) AS bin, {', '.join(f'{s}.{c} AS {c}_{n}' for s, n in (('t', 'train'), ('v', 'valid')) for c in ('good', 'bad', 'badrate', 'population_pct', 'cumsum_pct'))} FROM (SELECT * FROM b WHERE train = 1) t FULL JOIN (SELECT * FROM b WHERE train = 0) v ON t.bin = v.bin")
def score_box_sets(spark, sf_dir):
    """Train's and valid's score boxes side by side."""
    n = _scores(spark, sf_dir).groupBy(F.floor(F.col("score") / 40).alias("bin"), "train").agg(F.sum(1 - F.col("target")).alias("good"), F.sum("target").alias("bad"))
    w, total = W.partitionBy("train"), F.col("good") + F.col("bad")
    b = kept(n.withColumns({"badrate": F.col("bad") / total, "population_pct": total / F.sum(total).over(w), "cumsum_pct": F.sum(total).over(w.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)) / F.sum(total).over(w)}), "score-box")
    side = lambda t, s: b.where(F.col("train") == t).select("bin", *[F.col(c).alias(f"{c}_{s}") for c in ("good", "bad", "badrate", "population_pct", "cumsum_pct")])
    return side(1, "train").join(side(0, "valid"), "bin", "full")


@query(
    "score_box_weighted",
    """WITH x AS (SELECT CASE WHEN o_orderkey % 17 = 0 THEN -1.0 ELSE o_totalprice / 1000 END AS score, (o_orderstatus = 'P')::INT AS target, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS weight FROM orders),
    p AS (SELECT score, floor(score + 0.5) AS points, sum(weight) AS w FROM x WHERE score >= 0 GROUP BY ALL), r AS (SELECT *, sum(w) OVER (ORDER BY score) AS u, sum(w) OVER () AS t FROM p), k AS (SELECT least(floor(u * 10 / t), 9) AS band, points FROM r),
    e AS (SELECT list_sort(list_distinct(list(top))) AS e FROM (SELECT band, max(points) AS top FROM k WHERE band < 9 GROUP BY 1)), b AS (SELECT len(list_filter(e, lambda v: v <= score)) AS bin, score, target, weight FROM x, e WHERE score >= 0),
    n AS (SELECT bin, sum(CASE WHEN target = 1 THEN weight ELSE 0 END)::BIGINT AS bad, sum(CASE WHEN target = 0 THEN weight ELSE 0 END)::BIGINT AS good, quantile_cont(score, 0.5) AS median FROM b GROUP BY 1 UNION ALL SELECT -1, sum(CASE WHEN target = 1 THEN weight ELSE 0 END)::BIGINT, sum(CASE WHEN target = 0 THEN weight ELSE 0 END)::BIGINT, -9999979 FROM x WHERE score < 0),
    d AS (SELECT *, bad / (good + bad) AS badrate FROM n), st AS (SELECT badrate - lag(badrate) OVER (ORDER BY bin) AS s FROM d WHERE bin >= 0), o AS (SELECT count(*) FILTER (s < 0) >= count(*) FILTER (s >= 0) AS falling FROM st),
    z AS (SELECT d.*, (good + bad) / sum(good + bad) OVER () AS population_pct, CASE WHEN falling THEN median ELSE -median END AS place FROM d, o)
    SELECT bin::INT AS bin, bad, good, badrate, population_pct, sum(population_pct) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS cumsum_pct, median FROM z""",
)
def score_box_weighted(spark, sf_dir):
    """Bands of equal weight on whole points, a row of missing scores, medians, shares from the end that the bad rate falls to."""
    x = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 17 == 0, -1.0).otherwise(F.col("o_totalprice") / 1000).alias("score"), (F.col("o_orderstatus") == "P").cast("int").alias("target"), F.when(F.col("o_orderkey") % 3 == 0, 2).otherwise(1).alias("weight"))
    per = kept(x.groupBy("score").agg(F.sum(F.col("weight") * F.col("target")).alias("bad"), F.sum(F.col("weight") * (1 - F.col("target"))).alias("good"), F.count("*").alias("n")), "box-scores")
    return ranking.weighted_box(per, 10)


@query(
    "fit_summary",
    """WITH x AS (SELECT l_discount AS s, (l_returnflag = 'R')::INT AS t, CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 'train' ELSE 'valid' END AS part, l_orderkey % 5 AS fold FROM lineitem), p AS (SELECT part, s, sum(1 - t) AS n0, sum(t) AS n1 FROM x GROUP BY ALL), r AS (SELECT *, sum(n0) OVER w AS c0, sum(n1) OVER w AS c1, sum(n0) OVER a AS t0, sum(n1) OVER a AS t1 FROM p WINDOW w AS (PARTITION BY part ORDER BY s), a AS (PARTITION BY part)),
    m AS (SELECT part, max(abs(c1 / t1 - c0 / t0)) AS ks, sum(n1 * (c0 - n0 / 2)) / max(t0 * t1) AS auc FROM r GROUP BY 1), f AS (SELECT fold, s, sum(1 - t) AS n0, sum(t) AS n1 FROM x GROUP BY ALL), g AS (SELECT *, sum(n0) OVER (PARTITION BY fold ORDER BY s) AS c0 FROM f), h AS (SELECT fold, sum(n1 * (c0 - n0 / 2)) / (sum(n0) * sum(n1)) AS auc FROM g GROUP BY 1),
    w AS (SELECT max(CASE WHEN part = 'train' THEN ks END) AS ks_train, max(CASE WHEN part = 'valid' THEN ks END) AS ks_valid, max(CASE WHEN part = 'train' THEN auc END) AS auc_train, max(CASE WHEN part = 'valid' THEN auc END) AS auc_valid FROM m)
    SELECT w.*, (ks_train - ks_valid) / ks_train AS ks_loss, (auc_train - auc_valid) / auc_train AS auc_loss, cv_auc FROM w, (SELECT avg(auc) AS cv_auc FROM h)""",
)
def fit_summary(spark, sf_dir):
    """KS and AUC of both sets, the share of them that is lost, and the mean AUC over folds."""
    x = table(spark, sf_dir, "lineitem").select("l_discount", (F.col("l_returnflag") == "R").cast("int").alias("t"), F.when(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz"), "train").otherwise("valid").alias("part"), (F.col("l_orderkey") % 5).alias("fold"))
    m = ranking.ks_auc(ranking.per_score(x, "l_discount", "t", ["part"]), ["part"])
    pick = lambda c, s: F.max(F.when(F.col("part") == s, F.col(c))).alias(f"{c}_{s}")
    w = m.agg(*[pick(c, s) for c in ("ks", "auc") for s in ("train", "valid")])
    cv = ranking.ks_auc(ranking.per_score(x, "l_discount", "t", ["fold"]), ["fold"]).agg(F.avg("auc").alias("cv_auc"))
    return w.withColumns({f"{c}_loss": (F.col(f"{c}_train") - F.col(f"{c}_valid")) / F.col(f"{c}_train") for c in ("ks", "auc")}).crossJoin(cv)


@query("woe_export", f"WITH {long_sql()}, s3 AS (SELECT feature, value, target, train FROM long), e AS (SELECT feature, list_distinct(quantile_cont(value, [{_TENTHS}])) AS edges FROM s3 WHERE value IS NOT NULL AND train = 1 GROUP BY 1), bb AS (SELECT s3.*, CASE WHEN value IS NULL THEN 0 ELSE greatest(1, len(list_filter(edges, lambda k: k < value))) END AS bin FROM s3 JOIN e USING (feature)), c AS (SELECT feature, train, bin, sum(1 - target) AS good, sum(target) AS bad FROM bb GROUP BY ALL), s AS (SELECT *, good / sum(good) OVER w AS g, bad / sum(bad) OVER w AS b FROM c WINDOW w AS (PARTITION BY feature, train)) SELECT feature, bin::INT AS bin, max(CASE WHEN train = 1 THEN {GUARD_SQL} END) AS woe_train, max(CASE WHEN train = 0 THEN {GUARD_SQL} END) AS woe_valid, max(CASE WHEN train = 1 THEN (g - b) * {GUARD_SQL} END) AS iv_train, max(CASE WHEN train = 0 THEN (g - b) * {GUARD_SQL} END) AS iv_valid FROM s GROUP BY ALL")
def woe_export(spark, sf_dir):
    """WOE and IV of every bin and set in one table."""
    from weftline.operators import woe
    from weftline.plans.base import binned

    per = value_counts(spark, sf_dir)
    rows = binned(per, binning.quantile_edges(per.where("train = 1"), 10, rows="n"))
    t = woe.bin_table(woe.counts(rows, ["feature", "train", "bin"], weight=F.col("n")), feature=["feature", "train"])
    pick = lambda c, k, s: F.max(F.when(F.col("train") == k, F.col(c))).alias(f"{c}_{s}")
    return t.groupBy("feature", "bin").agg(*[pick(c, k, s) for c in ("woe", "iv") for k, s in ((1, "train"), (0, "valid"))])


# text

TOKENS_SQL = r"list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '')"


@query("token_stats_per_document", f"WITH t AS (SELECT doc_id, toxic AS target, unnest({TOKENS_SQL}) AS token FROM documents JOIN labels USING (doc_id)), n AS (SELECT target, count(DISTINCT doc_id) AS docs FROM t GROUP BY 1), c AS (SELECT token, target, count(*) AS n, count(DISTINCT doc_id) AS orders FROM t GROUP BY ALL) SELECT token, {', '.join(f'coalesce(max(CASE WHEN target = {k} THEN c.n END), 0) AS n_{k}, coalesce(max(CASE WHEN target = {k} THEN c.n / docs END), 0) AS mean_{k}, coalesce(max(CASE WHEN target = {k} THEN orders END), 0) AS orders_{k}' for k in (0, 1))} FROM c JOIN n USING (target) GROUP BY 1")
def token_stats_per_document(spark, sf_dir):
    """Counts, counts per document of the class, and documents, by class; a class without the token has 0."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("target"))
    s = text.token_stats(text.bag(d, "doc_id", "text", 1), labels, "doc_id")
    has = d.join(labels, "doc_id").where(F.size(tokens.tokens(F.col("text"))) > 0).agg(*[F.count_if(F.col("target") == k).alias(f"docs_{k}") for k in (0, 1)])
    x = s.crossJoin(F.broadcast(has))  # one row
    return x.select("token", *[c.alias(n) for k in (0, 1) for n, c in ((f"n_{k}", F.col(f"n_{k}")), (f"mean_{k}", F.coalesce(F.try_divide(F.col(f"n_{k}"), F.col(f"docs_{k}")), F.lit(0.0))), (f"orders_{k}", F.col(f"orders_{k}")))])


@query(
    "latest_messages_bag",
    r"""WITH r AS (SELECT user_id, event_type, event_type || ' at ' || (value::INT % 7)::VARCHAR AS body, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events), l AS (SELECT * FROM r WHERE k <= 8), g AS (SELECT user_id, 'gram1' AS kind, unnest(string_split(body, ' ')) AS token FROM l UNION ALL SELECT user_id, 'gram2', unnest([string_split(body, ' ')[1] || ' ' || string_split(body, ' ')[2], string_split(body, ' ')[2] || ' ' || string_split(body, ' ')[3]]) FROM l UNION ALL SELECT user_id, 'sender', event_type FROM l)
    SELECT user_id, kind, token, count(*) AS n FROM g GROUP BY ALL""",
)
def latest_messages_bag(spark, sf_dir):
    """n-grams and senders of each user's latest messages, eight of them here."""
    e = table(spark, sf_dir, "events")
    body = F.concat("event_type", F.lit(" at "), (F.bround("value").cast("int") % 7).cast("string"))
    m = e.select("user_id", "ts", "event_id", F.col("event_type").alias("sender"), body.alias("body"))
    return text.latest_bag(m, "user_id", ["ts", "event_id"], "sender", "body", 8, 2)


@query("array_lookback_open", "WITH m AS (SELECT user_id, max(ts) AS t FROM events GROUP BY 1), x AS (SELECT user_id, floor((epoch_us(t) - epoch_us(ts)) / 86400e6) AS age FROM events JOIN m USING (user_id)) SELECT user_id, span, count(*) FILTER (age <= span) AS n FROM x, (SELECT unnest([7, 10000]) AS span) GROUP BY ALL")
def array_lookback_open(spark, sf_dir):
    """Events within so many days; 10,000 days are no limit. Counted, never gathered."""
    e = table(spark, sf_dir, "events").select("user_id", "ts")
    last = e.groupBy("user_id").agg(F.max("ts").alias("t"))
    aged = e.join(last, "user_id").withColumn("age", times.whole_days(F.col("ts"), F.col("t")))
    return aged.select("user_id", F.explode(F.array(F.lit(7), F.lit(10000))).alias("span"), "age").groupBy("user_id", "span").agg(F.count_if((F.col("span") == 10000) | (F.col("age") <= F.col("span"))).alias("n"))


@query("dedup_first_and_whole", "WITH d AS (SELECT DISTINCT user_id, event_type, CAST(value AS INT) AS v FROM events), f AS (SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL) SELECT user_id, event_type, event_id, n FROM f JOIN (SELECT user_id, event_type, count(*) AS n FROM d GROUP BY ALL) USING (user_id, event_type)")
def dedup_first_and_whole(spark, sf_dir):
    """The first row of a key, and how many rows of it differ."""
    e = table(spark, sf_dir, "events")
    first = e.groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    whole = e.select("user_id", "event_type", F.bround("value").cast("int").alias("v")).distinct().groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return first.join(whole, ["user_id", "event_type"])


# drift over results, and named datasets


@query(
    "model_drift_report",
    """WITH x AS (SELECT event_type AS model, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, value AS v, (ts < TIMESTAMP '2024-01-15')::INT AS t FROM events), l AS (SELECT model, 'k' AS feature, k AS value, t FROM x UNION ALL SELECT model, 'v', v, t FROM x), n AS (SELECT model, feature, floor(value / 10) AS bin, sum(t) AS a, sum(1 - t) AS z FROM l GROUP BY ALL),
    s AS (SELECT model, feature, a / sum(a) OVER w AS p, z / sum(z) OVER w AS q FROM n WINDOW w AS (PARTITION BY model, feature)), r AS (SELECT model, feature, sum((p - q) * ln((p + 0.001) / (q + 0.001))) AS psi FROM s GROUP BY ALL), m AS (SELECT model, feature, sum(t)::BIGINT AS n_base, sum(1 - t)::BIGINT AS n_now, round(avg(value) FILTER (t = 1), 6) AS mean_base, round(avg(value) FILTER (t = 0), 6) AS mean_now FROM l GROUP BY ALL)
    SELECT model, feature, psi, n_base, n_now, mean_base, mean_now, psi > 0.1 AS alert FROM r JOIN m USING (model, feature)""",
)
def model_drift_report(spark, sf_dir):
    """Drift of every feature of every model's JSON results, with samples, means and alerts, in one pass."""
    e = table(spark, sf_dir, "events")
    doc = F.map_concat(F.from_json("props", "map<string,double>"), F.create_map(F.lit("v"), F.col("value")))
    x = kept(e.select(F.col("event_type").alias("model"), (F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")).alias("base"), F.explode(doc).alias("feature", "value")), "model-results")
    by = ["model", "feature"]
    psi = profiles.lambda_psi(x.groupBy(*by, F.floor(F.col("value") / 10).alias("bin"), "base").agg(F.count("*").alias("n")), by, F.col("base"))
    m = x.groupBy(*by).agg(F.count_if("base").alias("n_base"), F.count_if(~F.col("base")).alias("n_now"), F.round(F.avg(F.when(F.col("base"), F.col("value"))), 6).alias("mean_base"), F.round(F.avg(F.when(~F.col("base"), F.col("value"))), 6).alias("mean_now"))
    return psi.join(m, by).withColumn("alert", F.col("psi") > 0.1)


@query(
    "third_party_nearest",
    """WITH ids AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'), logs AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'view' UNION ALL SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'error'), p AS (SELECT event_id AS order_id, user_id, ts FROM events WHERE event_type = 'purchase'),
    c AS (SELECT order_id, l.event_id AS log_id, l.value, row_number() OVER (PARTITION BY order_id ORDER BY abs(epoch_us(l.ts) - epoch_us(p.ts)), l.ts, l.event_id) AS k FROM p JOIN logs l USING (user_id) WHERE user_id IN (SELECT user_id FROM ids)) SELECT order_id, log_id, value FROM c WHERE k = 1""",
)
def third_party_nearest(spark, sf_dir):
    """Two stores' logs of the wanted ids together, and each order's nearest entry."""
    e = table(spark, sf_dir, "events").withColumn("us", times.micros(F.col("ts")))
    pick = lambda kind: e.where(F.col("event_type") == kind).select("user_id", F.col("us").alias("log_us"), F.col("event_id").alias("log_id"), "value")
    orders = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("order_id"), "us")
    logs = pick("view").union(pick("error")).join(orders.select("user_id").distinct(), "user_id", "left_semi")
    return joins.nearest(orders, logs, "user_id", "order_id", "us", "log_us", ["log_id", "value"]).select("order_id", "log_id", "value")


MODULE_SQL = "mod AS (SELECT event_id, user_id AS order_id, event_type AS module_name, ts AS request_time, props FROM events)"


def _modules(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("order_id"), F.col("event_type").alias("module_name"), F.col("ts").alias("request_time"), "props")


@query("module_results", f"WITH {MODULE_SQL} SELECT order_id, c_name, request_time, (json_extract_string(props, '$.k'))::DOUBLE AS k FROM mod JOIN customer ON c_custkey = order_id WHERE module_name = 'view' AND order_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def module_results(spark, sf_dir):
    """One module's results for a list of orders, its JSON as columns."""
    from weftline.operators.shapes import flatten_json
    from weftline.sources.tables import only_ids

    ids = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("order_id"))
    got = only_ids(_modules(spark, sf_dir).where("module_name = 'view'"), ids, ["order_id"]).join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("order_id"), "c_name"), "order_id")
    return flatten_json(got, "props", ["order_id", "c_name", "request_time"])


@query("scores_for_applications", f"WITH {MODULE_SQL} SELECT m.event_id, o_orderkey, n_name, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), -999.0) AS score, strftime(request_time, '%Y-%m-%d') AS day FROM mod m JOIN orders ON o_orderkey = m.event_id JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE request_time >= TIMESTAMP '2024-01-03' AND request_time < TIMESTAMP '2024-01-20' AND o_orderdate >= TIMESTAMP '1996-01-01'")
def scores_for_applications(spark, sf_dir):
    """Requests, orders and customers, each bounded by its date, with the score of the result."""
    m = _modules(spark, sf_dir).where("request_time >= timestamp_ntz'2024-01-03' AND request_time < timestamp_ntz'2024-01-20'")
    o = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp_ntz'1996-01-01'").select(F.col("o_orderkey").alias("event_id"), "o_custkey", F.col("o_orderkey"))
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")), "c_nationkey")  # 25 nations
    x = m.join(o, "event_id").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return x.select("event_id", "o_orderkey", "n_name", F.coalesce(F.get_json_object("props", "$.k").try_cast("double"), F.lit(clean.SENTINEL)).alias("score"), F.date_format("request_time", "yyyy-MM-dd").alias("day"))


LOAN_SCORES = "WITH {m}, r AS (SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderkey % 3 = 0), s AS (SELECT order_id, module_name, props, row_number() OVER (PARTITION BY order_id ORDER BY request_time DESC, event_id DESC) AS k FROM mod)"


def _last_loans(spark, sf_dir):
    """Each user's latest original loan."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0")
    return o.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("o")).select("o_custkey", "o.*")


@query("scores_for_loans", LOAN_SCORES.format(m=MODULE_SQL) + " SELECT r.o_orderkey, o_custkey, module_name, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), -999.0) AS score FROM r JOIN s ON order_id = o_custkey AND k = 1 WHERE rn = 1")
def scores_for_loans(spark, sf_dir):
    """A user's latest original loan with the latest result."""
    s = _modules(spark, sf_dir).groupBy(F.col("order_id").alias("o_custkey")).agg(F.max_by(F.struct("module_name", "props"), F.struct("request_time", "event_id")).alias("m"))
    return _last_loans(spark, sf_dir).join(s, "o_custkey").select("o_orderkey", "o_custkey", "m.module_name", F.coalesce(F.get_json_object("m.props", "$.k").try_cast("double"), F.lit(clean.SENTINEL)).alias("score"))


@query("loans_with_module_log", f"WITH {MODULE_SQL}, l AS (SELECT o_orderkey, o_custkey, (o_orderstatus = 'P')::INT AS label FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01') SELECT o_orderkey, label, module_name, strftime(request_time, '%Y-%m-%d') AS day, (json_extract_string(props, '$.k'))::DOUBLE AS k FROM l JOIN mod ON order_id = o_custkey AND event_id % 50 = o_orderkey % 50")
def loans_with_module_log(spark, sf_dir):
    """Labelled loans joined to a module log by the request that they came from."""
    loans = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp_ntz'1998-01-01'").select("o_orderkey", F.col("o_custkey").alias("order_id"), (F.col("o_orderstatus") == "P").cast("int").alias("label"), (F.col("o_orderkey") % 50).alias("tx"))
    log = _modules(spark, sf_dir).withColumn("tx", F.col("event_id") % 50)
    return loans.join(log, ["order_id", "tx"]).select("o_orderkey", "label", "module_name", F.date_format("request_time", "yyyy-MM-dd").alias("day"), F.get_json_object("props", "$.k").cast("double").alias("k"))


@query("online_scores_two_logs", f"WITH {MODULE_SQL}, u AS (SELECT * FROM mod WHERE event_id % 2 = 0 UNION ALL SELECT * FROM mod WHERE event_id % 2 = 1) SELECT event_id, o_orderkey, json_extract_string(props, '$.k') AS \"k\", NULL::VARCHAR AS \"a.b\" FROM u JOIN orders ON o_orderkey = event_id")
def online_scores_two_logs(spark, sf_dir):
    """Two shards of a log together, mapped to orders, with the asked paths."""
    from weftline.operators.shapes import json_paths

    m = _modules(spark, sf_dir)
    u = m.where("event_id % 2 = 0").union(m.where("event_id % 2 = 1"))
    x = u.join(table(spark, sf_dir, "orders").select("o_orderkey"), F.col("event_id") == F.col("o_orderkey"))
    return x.select("event_id", "o_orderkey", *[c.alias(p) for p, c in json_paths("props", ["k", "a.b"]).items()])


@query("daily_module_pulls", f"WITH {MODULE_SQL} SELECT strftime(request_time, '%Y-%m-%d') AS day, event_id, order_id, (json_extract_string(props, '$.k'))::DOUBLE AS k FROM mod JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') ON o_custkey = order_id WHERE request_time >= TIMESTAMP '2024-01-05' AND request_time < TIMESTAMP '2024-01-08' AND module_name = 'click'")
def daily_module_pulls(spark, sf_dir):
    """A module's results of some days for a sample, from a table partitioned by day."""
    from weftline.sources.tables import fresh_path, write_partitions

    path = fresh_path(spark, "module-days")
    write_partitions(_modules(spark, sf_dir).withColumn("day", F.date_format("request_time", "yyyy-MM-dd")), path, ["day"])
    days = spark.read.parquet(path).where("day BETWEEN '2024-01-05' AND '2024-01-07' AND module_name = 'click'")
    sample = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("order_id")).distinct()
    x = days.join(sample, "order_id", "left_semi")
    return x.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_id", "order_id", F.from_json("props", "map<string,double>")["k"].alias("k"))


@query("missing_scores_by_model", f"WITH {MODULE_SQL} SELECT module_name AS model, strftime(request_time, '%Y-%m-%d') AS day, avg(CASE WHEN event_id % 11 = 0 OR TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) < 10 THEN 1 ELSE 0 END) AS missing_rate, count(*) AS n, avg(CASE WHEN event_id % 11 = 0 OR TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) < 10 THEN 1 ELSE 0 END) > 0.2 AS alert FROM mod GROUP BY ALL")
def missing_scores_by_model(spark, sf_dir):
    """Share of scores below zero, or missing, per configured model and day."""
    score = F.when(F.col("event_id") % 11 == 0, None).otherwise(F.get_json_object("props", "$.k").try_cast("double") - 10)
    x = _modules(spark, sf_dir).select(F.col("module_name").alias("model"), F.date_format("request_time", "yyyy-MM-dd").alias("day"), F.coalesce(score, F.lit(clean.SENTINEL)).alias("score"))
    rate = F.avg((F.col("score") < 0).cast("int"))
    return x.groupBy("model", "day").agg(rate.alias("missing_rate"), F.count("*").alias("n")).withColumn("alert", F.col("missing_rate") > 0.2)


@query("loans_scores_device", LOAN_SCORES.format(m=MODULE_SQL) + " SELECT r.o_orderkey, c_mktsegment AS device, (o_totalprice > 200000)::INT AS label, (json_extract_string(props, '$.k'))::DOUBLE AS score FROM r JOIN s ON order_id = o_custkey AND k = 1 JOIN customer ON c_custkey = o_custkey WHERE rn = 1 AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def loans_scores_device(spark, sf_dir):
    """Latest original loans of some devices with labels and the latest score; columns that both sides have are the key."""
    loans = _last_loans(spark, sf_dir).select("o_orderkey", F.col("o_custkey").alias("order_id"), (F.col("o_totalprice") > 200000).cast("int").alias("label"))
    device = table(spark, sf_dir, "customer").where("c_mktsegment IN ('BUILDING', 'MACHINERY')").select(F.col("c_custkey").alias("order_id"), F.col("c_mktsegment").alias("device"))
    s = _modules(spark, sf_dir).groupBy("order_id").agg(F.max_by("props", F.struct("request_time", "event_id")).alias("props")).select("order_id", F.get_json_object("props", "$.k").cast("double").alias("score"))
    return joins.natural(joins.natural(loans, device), s).select("o_orderkey", "device", "label", "score")


@query("features_two_periods", "WITH a AS (SELECT o_orderkey AS k, o_orderdate, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'), f1 AS (SELECT l_orderkey AS k, sum(l_quantity::BIGINT) AS quantity FROM lineitem GROUP BY 1), f2 AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1), j AS (SELECT * FROM a JOIN f1 USING (k) JOIN f2 USING (k)) SELECT strftime(o_orderdate, '%Y') AS period, count(*) AS n_orders, round(avg(quantity), 6) AS mean_quantity, quantile_cont(quantity, 0.5) AS median_quantity, round(avg(n), 6) AS mean_lines FROM j GROUP BY 1")
def features_two_periods(spark, sf_dir):
    """Applications of a span, their modules' features joined, and two periods compared."""
    a = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp_ntz'1996-01-01' AND o_orderdate < timestamp_ntz'1998-01-01'").select(F.col("o_orderkey").alias("k"), F.date_format("o_orderdate", "yyyy").alias("period"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"))
    x = kept(joins.join_all([a, lines.agg(F.sum(F.col("l_quantity").cast("long")).alias("quantity")), lines.agg(F.count("*").alias("n"))], ["k"]), "period-features")
    median = binning.quantiles(x.select("period", F.col("quantity").cast("double").alias("value")), [0.5], ["period"])
    return x.groupBy("period").agg(F.count("*").alias("n_orders"), F.round(F.avg("quantity"), 6).alias("mean_quantity"), F.round(F.avg("n"), 6).alias("mean_lines")).join(median, "period").select("period", "n_orders", "mean_quantity", F.col("q")[0].alias("median_quantity"), "mean_lines")


@query(
    "application_scores_wide",
    f"""WITH {MODULE_SQL}, cf(system, country, zone, hours, nations) AS (VALUES ('even', 'N', 'UTC+1', 1, 0), ('odd', 'S', 'UTC-6', -6, 1))
    SELECT system, country, m.event_id, m.order_id, m.module_name, strftime(request_time + to_hours(hours::BIGINT), '%Y-%m-%d %H:%M:%S') AS local_time, o_orderkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS order_day, c_name, c_mktsegment, c_custkey % 3 AS status, CASE c_custkey % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'old' ELSE 'semi-new' END AS customer_type, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), -999.0) AS score
    FROM mod m JOIN orders ON o_orderkey = m.event_id JOIN customer ON c_custkey = o_custkey JOIN cf ON nations = c_nationkey % 2
    WHERE request_time >= TIMESTAMP '2024-01-03' AND request_time < TIMESTAMP '2024-01-24' AND m.module_name = 'view' AND c_custkey % 3 IN (0, 1)""",
)
def application_scores_wide(spark, sf_dir):
    """Every column of a module's requests, their orders and customers, with the score, the system's country and local time and the customer type by name."""
    systems = spark.createDataFrame([("even", "N", "UTC+1", 1, 0), ("odd", "S", "UTC-6", -6, 1)], "system string, country string, zone string, hours int, nations int")  # a row per system
    types = F.create_map(F.lit(0), F.lit("new"), F.lit(1), F.lit("old"), F.lit(2), F.lit("semi-new"))
    m = _modules(spark, sf_dir).where("module_name = 'view' AND request_time >= timestamp_ntz'2024-01-03' AND request_time < timestamp_ntz'2024-01-24'")
    o = table(spark, sf_dir, "orders").withColumn("event_id", F.col("o_orderkey"))
    c = table(spark, sf_dir, "customer").withColumns({"nations": F.col("c_nationkey") % 2, "status": F.col("c_custkey") % 3}).where(F.col("status").isin(0, 1))
    x = m.join(o, "event_id").join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(systems), "nations")
    local = F.date_format(F.col("request_time") + F.make_interval(hours="hours"), "yyyy-MM-dd HH:mm:ss")
    score = F.coalesce(F.get_json_object("props", "$.k").try_cast("double"), F.lit(clean.SENTINEL))
    return x.select("system", "country", "event_id", "order_id", "module_name", local.alias("local_time"), "o_orderkey", "o_orderstatus", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_day"), "c_name", "c_mktsegment", "status", types[F.col("status").cast("int")].alias("customer_type"), score.alias("score"))
