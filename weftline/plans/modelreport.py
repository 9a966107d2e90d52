"""The report of one model's score: numbers of the sets, and bins by three sets of cut points."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import profiles, reporting
from weftline.plans.measures import _AUC_SQL, LAMB, _index_sql, long3, sets_sql
from weftline.plans.registry import query

_S = f"""{sets_sql()}, s AS MATERIALIZED (SELECT value, target, CASE WHEN grp = 'oot' THEN 'valid' ELSE 'train' END AS grp FROM long3 WHERE feature = 'l_extendedprice')"""


def _values(spark, sf_dir):
    rows = long3(spark, sf_dir).where("feature = 'l_extendedprice'").select(F.when(F.col("grp") == "oot", "valid").otherwise("train").alias("grp"), F.col("value").cast("double").alias("value"), "target")
    return profiles.value_table(rows, ["grp"])


@query(
    "model_report_numbers",
    f"""WITH {_S}, c AS (SELECT grp, sum(1 - target) AS good, sum(target) AS bad FROM s GROUP BY 1 UNION ALL SELECT 'total', sum(1 - target), sum(target) FROM s),
p AS (SELECT grp, value, sum(1 - target) AS n0, sum(target) AS n1 FROM s WHERE value IS NOT NULL GROUP BY ALL),
q AS (SELECT grp, n0, n1, sum(n0) OVER u AS c0, sum(n1) OVER u AS c1, sum(n0) OVER a AS t0, sum(n1) OVER a AS t1 FROM p WINDOW u AS (PARTITION BY grp ORDER BY value), a AS (PARTITION BY grp)),
r AS (SELECT grp, max(abs(c1 / t1 - c0 / t0)) AS ks, sum(n1 * (c0 - n0) + n1 * n0 / 2) / (max(t0) * max(t1)) AS auc FROM q GROUP BY 1),
e AS ({_index_sql("(SELECT 'score' AS feature, value FROM s WHERE grp = 'train' AND value IS NOT NULL)")}),
b AS (SELECT len(list_filter(inner_e, lambda k: k < coalesce(value, -999.0))) AS bin, count(*) FILTER (grp = 'train') AS x, count(*) FILTER (grp = 'valid') AS z FROM s, e GROUP BY ALL),
v AS (SELECT x / sum(x) OVER () AS p, z / sum(z) OVER () AS q FROM b)
SELECT 'summary ' || grp AS section, unnest(['total', 'good', 'bad', 'bad_rate']) AS name, unnest([(good + bad)::DOUBLE, good::DOUBLE, bad::DOUBLE, bad / (good + bad)]) AS value FROM c
UNION ALL SELECT 'score', unnest(['ks_' || grp, 'auc_' || grp]), unnest([ks, auc]) FROM r
UNION ALL SELECT 'score', 'psi', sum((p - q) * ln((p + 0.001) / (q + 0.001))) FROM v""",
)
def model_report_numbers(spark, sf_dir):
    """What training and validation rows hold, together too, and the score's KS, AUC and PSI."""
    return reporting.numbers(_values(spark, sf_dir))


_AT = ", ".join(repr(i / 10) for i in range(11))


@query(
    "model_report_bins",
    f"""WITH {_S}, k AS (SELECT * FROM s WHERE value IS NOT NULL),
ed AS (SELECT grp AS scheme, list_distinct(quantile_cont(value, [{_AT}])) AS e FROM k GROUP BY 1 UNION ALL SELECT 'equal', list_transform(range(0, 11), lambda i: low + i * (high - low) / 10) FROM (SELECT min(value) AS low, max(value) AS high FROM k WHERE grp = 'train')),
binned3 AS (SELECT scheme || '|' || grp AS feature, value, target, greatest(1, least(len(e) - 1, len(list_filter(e, lambda k: k < value)))) AS bin FROM k, ed),
t AS (SELECT feature, sum(1 - target) AS ag, sum(target) AS ab FROM binned3 GROUP BY 1), d AS (SELECT feature, corr(value, target) AS slope FROM binned3 GROUP BY 1), {_AUC_SQL},
c AS (SELECT feature, bin, sum(1 - target) AS good, sum(target) AS bad FROM binned3 GROUP BY ALL),
u AS (SELECT c.*, ag, ab, good / ag AS g, bad / ab AS b, sum(good) OVER w AS cg, sum(bad) OVER w AS cb FROM c JOIN t USING (feature) JOIN d USING (feature) WINDOW w AS (PARTITION BY feature ORDER BY CASE WHEN slope < 0 THEN -bin ELSE bin END ROWS UNBOUNDED PRECEDING))
SELECT split_part(feature, '|', 1) AS scheme, split_part(feature, '|', 2) AS grp, bin::INT AS bin, bad::BIGINT AS bad, (good + bad)::BIGINT AS total, (good + bad) / (ag + ab) AS total_rate, bad / (good + bad) AS brate, cb / (cg + cb) AS brate_cum, (bad / (good + bad)) / (ab / (ag + ab)) AS lift, {LAMB} AS woe, abs(cb / ab - cg / ag) AS ks,
  sum((g - b) * {LAMB}) OVER (PARTITION BY feature) AS iv, coalesce(greatest(auc, 1 - auc), 0) AS auc_cum FROM u JOIN a USING (feature, bin)""",
)
def model_report_bins(spark, sf_dir):
    """Both sets by the training rows' quantiles, by equal parts of their range, and by the validation rows' quantiles."""
    return reporting.bins(_values(spark, sf_dir)).select("scheme", "grp", "bin", "bad", "total", "total_rate", "brate", "brate_cum", "lift", "woe", "ks", "iv", "auc_cum")
