"""Scans, joins, projections and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import times, tokens
from weftline.operators import clean, joins
from weftline.plans.registry import query
from weftline.sources import tables
from weftline.sources.tables import table


@query("scan_filter_project", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.05 THEN 'high' WHEN l_discount > 0 THEN 'low' ELSE 'none' END AS level FROM lineitem WHERE l_quantity > 40 AND l_returnflag IN ('A', 'R') AND l_linestatus NOT IN ('O')")
def scan_filter_project(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").where((F.col("l_quantity") > 40) & F.col("l_returnflag").isin("A", "R") & ~F.col("l_linestatus").isin("O"))
    return x.select("l_orderkey", "l_linenumber", F.when(F.col("l_discount") > 0.05, "high").when(F.col("l_discount") > 0, "low").otherwise("none").alias("level"))


@query("scan_date_pruned", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31' AND o_orderstatus <> 'P' GROUP BY 1")
def scan_date_pruned(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderdate BETWEEN timestamp_ntz'1996-01-01' AND timestamp_ntz'1996-12-31' AND o_orderstatus <> 'P'")
    return o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@query("semi_join_ids", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_join_ids(spark, sf_dir):
    ids = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return tables.only_ids(table(spark, sf_dir, "orders"), ids, ["o_custkey"]).select("o_orderkey", "o_custkey")


@query("anti_join_keys", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def anti_join_keys(spark, sf_dir):
    used = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(used, "c_custkey", "left_anti")


@query("incremental_worklist", "SELECT DISTINCT o_orderstatus, strftime(o_orderdate, '%Y-%m') AS month FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'")
def incremental_worklist(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderstatus", F.date_format("o_orderdate", "yyyy-MM").alias("month")).distinct()
    return tables.work_list(o, o.where("month < '2000-01'"), ["o_orderstatus", "month"])


@query("dedup_keep_last", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def dedup_keep_last(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    w = W.partitionBy("user_id", "event_type").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return e.withColumn("k", F.row_number().over(w)).where("k = 1").select("user_id", "event_type", "event_id", "value")


@query(
    "impute_const_mode_mean",
    """WITH m AS (SELECT avg(c_acctbal) FILTER (c_acctbal >= 0 AND c_custkey % 10 < 7) AS mean FROM customer), d AS (SELECT c_mktsegment AS mode FROM customer WHERE c_acctbal >= 0 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal ELSE -999.0 END AS sentinel, CASE WHEN c_acctbal >= 0 THEN c_acctbal ELSE mean END AS by_mean, CASE WHEN c_acctbal >= 0 THEN c_mktsegment ELSE mode END AS by_mode FROM customer, m, d""",
)
def impute_const_mode_mean(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("v", clean.present(F.col("c_acctbal"))).withColumn("s", F.when(F.col("v").isNotNull(), F.col("c_mktsegment")))
    fitted = c.agg(F.avg(F.when(F.col("c_custkey") % 10 < 7, F.col("v"))).alias("mean")).crossJoin(clean.modes(c.where("s IS NOT NULL"), ["s"]).withColumnRenamed("s", "mode"))
    return c.crossJoin(F.broadcast(fitted)).select("c_custkey", clean.with_sentinel(F.col("c_acctbal")).alias("sentinel"), F.coalesce("v", "mean").alias("by_mean"), F.coalesce("s", "mode").alias("by_mode"))


@query("drop_constant_columns", "WITH x AS (SELECT count(DISTINCT l_quantity) AS a, count(DISTINCT l_discount) AS b FROM lineitem) SELECT 'l_quantity' AS feature, a AS n_values, a <= 1 AS is_constant FROM x UNION ALL SELECT 'l_discount', b, b <= 1 FROM x UNION ALL SELECT 'fixed', 1, TRUE")
def drop_constant_columns(spark, sf_dir):
    return clean.constant(table(spark, sf_dir, "lineitem").withColumn("fixed", F.lit(5)), ["l_quantity", "l_discount", "fixed"])


@query("parse_module_names", "SELECT array_to_string(string_split(replace(p_name, ' ', '_'), '_')[1:2], '_') AS module, count(*) AS n FROM part GROUP BY 1")
def parse_module_names(spark, sf_dir):
    name = F.regexp_replace("p_name", " ", "_")
    return table(spark, sf_dir, "part").groupBy(tokens.module_of(name).alias("module")).agg(F.count("*").alias("n"))


@query(
    "asof_registration",
    "SELECT p.event_id, p.user_id, coalesce(epoch_us(s.ts), -1) AS registered_us FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts FROM events WHERE event_type = 'signup') s ON p.user_id = s.user_id AND p.ts >= s.ts",
)
def asof_registration(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    got = joins.as_of(e.where("event_type = 'purchase'"), e.where("event_type = 'signup'"), "user_id", "ts", "ts", [])
    return got.select("event_id", "user_id", F.coalesce(times.micros(F.col("asof_ts")), F.lit(-1)).alias("registered_us"))


@query(
    "nearest_match",
    """WITH x AS (SELECT p.event_id, p.user_id, epoch_us(e.ts) AS error_us, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(epoch_us(p.ts) - epoch_us(e.ts)), epoch_us(e.ts)) AS k
    FROM events p JOIN events e ON p.user_id = e.user_id WHERE p.event_type = 'purchase' AND e.event_type = 'error') SELECT event_id, user_id, error_us FROM x WHERE k = 1""",
)
def nearest_match(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", times.micros(F.col("ts")).alias("us"), "event_type")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", F.col("us").alias("at_us"))
    right = e.where("event_type = 'error'").select("user_id", F.col("us").alias("error_us"))
    return joins.nearest(left, right, "user_id", "event_id", "at_us", "error_us", []).select("event_id", "user_id", "error_us")


@query("ltv_30d", "SELECT a.o_orderkey, sum(b.o_totalprice::DECIMAL(18,2))::DOUBLE AS ltv FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate >= a.o_orderdate AND b.o_orderdate < a.o_orderdate + INTERVAL 31 DAY GROUP BY 1")
def ltv_30d(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", joins.leading_sum("o_custkey", times.micros(F.col("o_orderdate")), 31, F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("ltv"))


@query(
    "star_join",
    """SELECT n_name, r_name, count(*) AS n, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON l_suppkey = s_suppkey WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY ALL""",
)
def star_join(spark, sf_dir):
    names = ("lineitem", "orders", "customer", "nation", "region", "supplier")
    return spark.sql(
        """SELECT n_name, r_name, count(*) AS n, cast(sum(cast(l_extendedprice AS decimal(18,2))) AS double) AS revenue
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
        JOIN {region} ON n_regionkey = r_regionkey LEFT JOIN {supplier} ON l_suppkey = s_suppkey WHERE o_orderdate < timestamp_ntz'1998-01-01' GROUP BY n_name, r_name""",
        **{n: table(spark, sf_dir, n) for n in names},
    )


@query("reduce_join", "SELECT k AS o_orderkey, a, b, c FROM (SELECT l_orderkey AS k, count(*) AS a FROM lineitem GROUP BY 1) JOIN (SELECT l_orderkey AS k, max(l_discount) AS b FROM lineitem GROUP BY 1) USING (k) JOIN (SELECT o_orderkey AS k, o_orderstatus AS c FROM orders) USING (k)")
def reduce_join(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    parts = [lines.groupBy("o_orderkey").agg(F.count("*").alias("a")), lines.groupBy("o_orderkey").agg(F.max("l_discount").alias("b")), table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("c"))]
    return joins.join_all(parts, ["o_orderkey"])


@query(
    "blacklist_hit",
    """WITH l AS (SELECT md5(c_name) AS hn, md5(c_custkey::VARCHAR) AS hk, c_custkey % 28 + 1 AS day FROM customer WHERE c_custkey % 7 = 0), x AS (SELECT c_custkey, least(a.d, b.d) AS f FROM customer
      LEFT JOIN (SELECT hn, min(day) AS d FROM l GROUP BY 1) a ON md5(c_name) = hn LEFT JOIN (SELECT hk, min(day) AS d FROM l GROUP BY 1) b ON md5((c_custkey + 7)::VARCHAR) = hk)
    SELECT c_custkey, coalesce(f, -1) AS first_listed, coalesce(15 > f, FALSE) AS hit FROM x""",
)
def blacklist_hit(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    listed = c.where("c_custkey % 7 = 0").select(F.md5("c_name").alias("hn"), F.md5(F.col("c_custkey").cast("string")).alias("hk"), (F.col("c_custkey") % 28 + 1).alias("day"))
    left = c.select("c_custkey", F.md5("c_name").alias("mn"), F.md5((F.col("c_custkey") + 7).cast("string")).alias("mk"))
    got = joins.either_key_hit(left, listed, ["mn", "mk"], ["hn", "hk"], "day")
    return got.select("c_custkey", F.coalesce("first_listed", F.lit(-1)).alias("first_listed"), F.coalesce(F.lit(15) > F.col("first_listed"), F.lit(False)).alias("hit"))


@query("md5_columns", "SELECT c_custkey, md5(c_name) AS h32, substr(md5(c_name), 9, 16) AS h16, upper(md5(c_name)) AS upper32 FROM customer")
def md5_columns(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.md5("c_name").alias("h32"), tokens.md5_16(F.col("c_name")).alias("h16"), F.upper(F.md5("c_name")).alias("upper32"))


@query("dict_lookup", "SELECT c_custkey, coalesce(n_name, 'unknown') AS nation, CASE c_mktsegment WHEN 'BUILDING' THEN 'b' WHEN 'MACHINERY' THEN 'm' ELSE 'other' END AS code FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def dict_lookup(spark, sf_dir):
    names = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))  # 25 rows
    code = F.coalesce(F.create_map(F.lit("BUILDING"), F.lit("b"), F.lit("MACHINERY"), F.lit("m"))[F.col("c_mktsegment")], F.lit("other"))
    return table(spark, sf_dir, "customer").join(names, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("n_name", F.lit("unknown")).alias("nation"), code.alias("code"))


@query("topk_rows", "SELECT l_orderkey, l_linenumber, l_extendedprice, rank() OVER (ORDER BY l_extendedprice DESC) AS place FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20")
def topk_rows(spark, sf_dir):
    top = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber").limit(20)
    return top.withColumn("place", F.rank().over(W.orderBy(F.col("l_extendedprice").desc())))


@query("union_by_name", "SELECT o_orderkey AS id, o_totalprice AS amount, NULL::VARCHAR AS kind FROM orders UNION ALL SELECT event_id, value, event_type FROM events")
def union_by_name(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    b = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("value").alias("amount"), F.col("event_type").alias("kind"))
    return a.unionByName(b, allowMissingColumns=True)


@query("union_all_distinct", "SELECT DISTINCT k FROM (SELECT o_custkey AS k FROM orders UNION ALL SELECT user_id FROM events)")
def union_all_distinct(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).union(table(spark, sf_dir, "events").select("user_id")).distinct()


@query(
    "standardize",
    "WITH f AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01') SELECT l_orderkey, l_linenumber, round((l_quantity - m) / s, 6) AS z FROM lineitem, f",
)
def standardize(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    got = clean.standardise(x, ["l_quantity"], F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    return got.select("l_orderkey", "l_linenumber", F.round("z_l_quantity", 6).alias("z"))


@query("group_split", "WITH o AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01') SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '2001-01-01' THEN 'oot' WHEN o_custkey IN (SELECT * FROM o) THEN 'dropped' WHEN o_custkey % 10 < 3 THEN 'test' ELSE 'train' END AS part FROM orders")
def group_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz")).alias("late"))
    late = o.where("late").select(F.col("o_custkey").alias("k")).distinct().withColumn("seen", F.lit(True))
    part = F.when(F.col("late"), "oot").when(F.col("seen"), "dropped").when(F.col("o_custkey") % 10 < 3, "test").otherwise("train")
    return o.join(late, F.col("o_custkey") == F.col("k"), "left").select("o_orderkey", part.alias("part"))


@query("kfold_assign", "SELECT o_custkey % 5 AS fold, count(*) AS n, count(DISTINCT o_custkey) AS n_entities FROM orders GROUP BY 1")
def kfold_assign(spark, sf_dir):
    from weftline.operators.text import fold_of

    return table(spark, sf_dir, "orders").groupBy(fold_of(F.col("o_custkey"), 5).cast("long").alias("fold")).agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("n_entities"))


@query("random_split")
def random_split(spark, sf_dir):
    from weftline.operators.text import hashed_fold

    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(hashed_fold(F.col("o_orderkey"), 100) < 70, "train").otherwise("test").alias("part"))
