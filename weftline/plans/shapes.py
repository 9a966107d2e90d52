"""Reshaping, splitting, documents, times and text matching, each by its whole rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import times
from weftline.operators import joins, profiles, ranking, shapes
from weftline.plans.registry import query
from weftline.sources.tables import table


@query("constants_dropped", "SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_linenumber = 1 THEN 5 END AS sometimes FROM lineitem")
def constants_dropped(spark, sf_dir):
    """Columns of one value go; with null counting as a value, a column of one value and nulls stays."""
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.lit(5).alias("always"), F.lit(None).cast("double").alias("never"), F.when(F.col("l_linenumber") == 1, 5).alias("sometimes"))
    return shapes.drop_constant(x, ["l_quantity", "always", "never", "sometimes"])


@query("constants_dropped_nulls_ignored", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def constants_dropped_nulls_ignored(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.lit(5).alias("always"), F.when(F.col("l_linenumber") == 1, 5).alias("sometimes"))
    return shapes.drop_constant(x, ["l_quantity", "always", "sometimes"], count_null=False)


@query("infinite_and_sentinel", "SELECT c_custkey, CASE WHEN c_custkey % 5 IN (0, 1, 2) THEN NULL WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS clean, CASE WHEN c_custkey % 5 IN (0, 1, 2) OR c_acctbal < 0 THEN -999.0 ELSE c_acctbal END AS filled FROM customer")
def infinite_and_sentinel(spark, sf_dir):
    """NaN, both infinities and the sentinel become null, and missing values the sentinel."""
    from weftline.operators import clean

    k = F.col("c_custkey") % 5
    v = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf")).when(F.col("c_acctbal") < 0, clean.SENTINEL).otherwise(F.col("c_acctbal"))
    x = table(spark, sf_dir, "customer").select("c_custkey", v.alias("v"))
    return x.select("c_custkey", clean.from_sentinel(clean.finite(F.col("v"))).alias("clean"), clean.with_sentinel(F.col("v")).alias("filled"))


@query("json_flattened", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN value END AS even, CASE WHEN event_id % 2 = 1 THEN value END AS odd, (json_extract_string(props, '$.k'))::DOUBLE AS k FROM events")
def json_flattened(spark, sf_dir):
    """Objects with differing keys become columns."""
    e = table(spark, sf_dir, "events")
    name = F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd")
    doc = F.to_json(F.map_concat(F.create_map(name, F.col("value")), F.create_map(F.lit("k"), F.get_json_object("props", "$.k").cast("double"))))
    return shapes.flatten_json(e.select("event_id", doc.alias("doc")), "doc", ["event_id"])


@query("json_dotted_paths", "SELECT event_id, event_type AS \"a.kind\", json_extract_string(props, '$.k') AS \"a.b.k\", NULL::VARCHAR AS \"a.none\" FROM events")
def json_dotted_paths(spark, sf_dir):
    doc = F.to_json(F.struct(F.struct(F.col("event_type").alias("kind"), F.struct(F.get_json_object("props", "$.k").cast("int").alias("k")).alias("b")).alias("a")))
    x = table(spark, sf_dir, "events").select("event_id", doc.alias("doc"))
    return x.select("event_id", *[c.alias(p) for p, c in shapes.json_paths("doc", ["a.kind", "a.b.k", "a.none"]).items()])


@query("first_of_senders", "WITH f AS (SELECT user_id, event_type AS s, min(epoch_us(ts)) AS t FROM events GROUP BY ALL) SELECT user_id, count(*) AS n, string_agg(s, ',' ORDER BY t, s) AS names, string_agg(t::VARCHAR, ',' ORDER BY t, s) AS first_times FROM f GROUP BY 1")
def first_of_senders(spark, sf_dir):
    """The reshaped array itself, read back."""
    x = shapes.first_of_senders(table(spark, sf_dir, "events").withColumn("us", times.micros(F.col("ts"))), "user_id", "event_type", "us")
    text = lambda f: F.array_join(F.transform("apps", f), ",")
    return x.select("user_id", F.size("apps").cast("long").alias("n"), text(lambda a: a.app_package).alias("names"), text(lambda a: a.lu_time.cast("string")).alias("first_times"))


OWN_SQL = "own AS (SELECT o_custkey, o_orderkey AS own_id, o_orderdate AS apply_time FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k = 2)"


def _own(spark, sf_dir):
    """A user's order before the last one."""
    two = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("last"))
    o = table(spark, sf_dir, "orders").join(two, "o_custkey").where(F.col("o_orderkey") < F.col("last"))
    return o.groupBy("o_custkey").agg(F.max(F.struct(F.col("o_orderkey").alias("own_id"), F.col("o_orderdate").alias("apply_time"))).alias("o")).select("o_custkey", "o.own_id", "o.apply_time")


@query("order_history_status", f"WITH {OWN_SQL} SELECT o_custkey, own_id, o_orderkey, CASE WHEN o_orderkey = own_id THEN 20 WHEN o_orderstatus = 'F' THEN 90 ELSE 10 END AS status FROM orders JOIN own USING (o_custkey) WHERE o_orderkey <= own_id")
def order_history_status(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "F", 90).otherwise(10).alias("status"))
    return shapes.history_rows(o, _own(spark, sf_dir).drop("apply_time"), "o_custkey", "o_orderkey", "status").select("o_custkey", "own_id", "o_orderkey", "status")


@query(
    "instalments_rewound",
    f"""WITH {OWN_SQL}, c AS (SELECT l_orderkey, max(l_shipdate) AS settlement_time FROM lineitem GROUP BY 1),
    x AS (SELECT o.o_custkey, l.l_orderkey, l_linenumber, l_partkey % 3 AS ext, l_suppkey % 4 AS stype, l_tax AS fee, l_extendedprice AS repaid, settlement_time > apply_time AS later, count(*) OVER w AS n, max(l_partkey % 3) OVER w AS m
      FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey JOIN own USING (o_custkey) JOIN c ON c.l_orderkey = l.l_orderkey WHERE l.l_orderkey <= own_id WINDOW w AS (PARTITION BY o.o_custkey, l.l_orderkey))
    SELECT l_orderkey, l_linenumber, CASE WHEN later AND (n = 1 OR ext = m) THEN 1 ELSE 2 END AS status, (CASE WHEN later AND (n = 1 OR ext = m) THEN 0 ELSE stype END)::BIGINT AS settlement_type, CASE WHEN later AND (n = 1 OR ext = m) THEN 0.0 ELSE fee END AS extension_fee, CASE WHEN later THEN 0.0 ELSE repaid END AS repaid_principal, 0 AS overdue_days, 0.0::DOUBLE AS overdue_interest FROM x""",
)
def instalments_rewound(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    x = lines.select("o_custkey", "l_orderkey", "l_linenumber", (F.col("l_partkey") % 3).alias("extension_count"), (F.col("l_suppkey") % 4).alias("settlement_type"), F.lit(2).alias("status"), F.col("l_tax").alias("extension_fee"), F.col("l_extendedprice").alias("repaid_principal"), F.col("l_shipdate").alias("settlement_time"))
    contracts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("settlement_time"))
    got = shapes.rewind_instalments(x, contracts, _own(spark, sf_dir), "o_custkey", "l_orderkey", "extension_count", ["repaid_principal"])
    return got.select("l_orderkey", "l_linenumber", "status", "settlement_type", "extension_fee", "repaid_principal", "overdue_days", "overdue_interest")


@query(
    "request_document",
    f"""WITH {OWN_SQL}, h AS (SELECT o_custkey, own_id, count(*) AS n_orders, sum(o_orderkey) AS order_sum FROM orders JOIN own USING (o_custkey) WHERE o_orderkey <= own_id GROUP BY ALL), i AS (SELECT o_custkey, count(*) AS n_lines, sum(l_quantity::BIGINT) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN own USING (o_custkey) WHERE l_orderkey <= own_id GROUP BY 1)
    SELECT h.own_id AS order_id, c_name AS phone, n_name AS country, n_orders, order_sum::BIGINT AS order_sum, n_lines, quantity::BIGINT AS quantity FROM h JOIN i USING (o_custkey) JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""",
)
def request_document(spark, sf_dir):
    """The whole document of an own order, base_info and data_sources, as JSON, and read back."""
    own = _own(spark, sf_dir)
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.lit(10).alias("status"))
    orders = shapes.history_rows(o, own.drop("apply_time"), "o_custkey", "o_orderkey", "status").groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), "status")).alias("order_data_a"))
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").join(own.drop("apply_time"), "o_custkey").where("l_orderkey <= own_id")
    inst = lines.groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("quantity"))).alias("installments_data_a"))
    who = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")), "c_nationkey").withColumnRenamed("c_custkey", "o_custkey")  # 25 nations
    base = F.struct(F.col("own_id").alias("order_id"), F.col("c_name").alias("phone"), F.col("n_name").alias("country"), F.col("apply_time").cast("string").alias("apply_time"))
    doc = own.join(orders, "o_custkey").join(inst, "o_custkey").join(who, "o_custkey").select(F.to_json(F.struct(base.alias("base_info"), F.struct("order_data_a", "installments_data_a").alias("data_sources"))).alias("doc"))
    d = F.from_json("doc", "base_info struct<order_id:bigint,phone:string,country:string>, data_sources struct<order_data_a:array<struct<id:bigint,status:int>>,installments_data_a:array<struct<id:bigint,quantity:double>>>").alias("d")
    total = lambda a, f: F.aggregate(a, F.lit(0).cast("bigint"), lambda n, x: n + f(x))
    s = "d.data_sources"
    return doc.select(d).select("d.base_info.*", F.size(f"{s}.order_data_a").cast("long").alias("n_orders"), total(f"{s}.order_data_a", lambda x: x.id).alias("order_sum"), F.size(f"{s}.installments_data_a").cast("long").alias("n_lines"), total(f"{s}.installments_data_a", lambda x: x.quantity.cast("bigint")).alias("quantity"))


@query("payload_by_module", "SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 'app_v1' WHEN user_id % 3 = 1 THEN 'sms_v1' ELSE 'loan_v1' END AS module, CASE WHEN user_id % 3 = 0 THEN 'applist_data' WHEN user_id % 3 = 1 THEN 'sms_data' ELSE 'installments_data_a,order_data_a' END AS sources, count(*) AS n FROM events GROUP BY ALL")
def payload_by_module(spark, sf_dir):
    """Of a document only the sources that a module's prefix asks for are sent."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    module = F.when(F.col("user_id") % 3 == 0, "app_v1").when(F.col("user_id") % 3 == 1, "sms_v1").otherwise("loan_v1")
    source = F.array(F.struct(F.col("n")))
    doc = F.struct(*[source.alias(k) for k in ("applist_data", "sms_data", "calllog_data", "installments_data_a", "order_data_a")])
    wanted = {"app_": ["applist_data"], "sms_": ["sms_data"], "loan_": ["installments_data_a", "order_data_a"]}
    sent = e.select("user_id", "n", module.alias("module"), doc.alias("doc"))
    pruned = F.lit(None).cast("string")
    for prefix, names in wanted.items():
        pruned = F.when(F.col("module").startswith(prefix), F.to_json(F.struct(*[F.col(f"doc.{n}").alias(n) for n in names]))).otherwise(pruned)
    got = sent.select("user_id", "module", "n", pruned.alias("payload"))
    return got.select("user_id", "module", F.array_join(F.sort_array(F.json_object_keys("payload")), ",").alias("sources"), "n")


MD5_POSITION = "(row_number() OVER (ORDER BY md5('42|' || {k}::VARCHAR), {k}) - 1)"


@query("kfold_shuffled", f"SELECT o_custkey, ({MD5_POSITION.format(k='o_custkey')} % 5)::INT AS fold FROM (SELECT DISTINCT o_custkey FROM orders)")
def kfold_shuffled(spark, sf_dir):
    """Shuffled by a seed, and balanced."""
    return shapes.folds(table(spark, sf_dir, "orders"), "o_custkey", 5)


@query(
    "sample_split_sets",
    f"""WITH l AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-05-01'), e AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '2001-05-01' AND o_custkey NOT IN (SELECT o_custkey FROM l)),
    f AS (SELECT o_custkey, {MD5_POSITION.format(k='o_custkey')} % 10 AS fold FROM e) SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '2001-05-01' THEN 'oot' WHEN l.o_custkey IS NOT NULL THEN NULL WHEN fold < 3 THEN 'test' ELSE 'train' END AS sample_type FROM orders LEFT JOIN l USING (o_custkey) LEFT JOIN f USING (o_custkey)""",
)
def sample_split_sets(spark, sf_dir):
    """oot by time, users of oot out of the rest, three of ten shuffled folds of users as test."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return shapes.split_sets(o, "o_custkey", F.col("o_orderdate") >= F.lit("2001-05-01").cast("timestamp_ntz")).select("o_orderkey", "sample_type")


@query("random_split_rows", "SELECT o_orderkey, CASE WHEN ('0x' || substr(md5('42|' || o_orderkey::VARCHAR), 1, 8))::BIGINT % 100 < 70 THEN 'train' ELSE 'test' END AS part FROM orders")
def random_split_rows(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(shapes.hashed_share(F.col("o_orderkey")) < 70, "train").otherwise("test").alias("part"))


_PIVOT = [("F", "n", "count(*) FILTER (o_orderstatus = 'F')"), ("O", "n", "count(*) FILTER (o_orderstatus = 'O')"), ("P", "n", "count(*) FILTER (o_orderstatus = 'P')"), ("F", "top", "max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END)"), ("O", "top", "max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END)"), ("P", "top", "max(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END)")]


def _pivoted(spark, sf_dir, swap):
    got = shapes.pivot_metrics(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"], {"n": F.count(F.lit(1)), "top": F.max("o_totalprice")}, swap)
    return got.na.fill(0, [c for c in got.columns if c.endswith("_n") or c.startswith("n_")])


@query("pivot_levels", f"SELECT o_orderpriority, {', '.join(f'{c} AS {v}_{m}' for v, m, c in _PIVOT)} FROM orders GROUP BY 1")
def pivot_levels(spark, sf_dir):
    return _pivoted(spark, sf_dir, False)


@query("pivot_levels_swapped", f"SELECT o_orderpriority, {', '.join(f'{c} AS {m}_{v}' for v, m, c in _PIVOT)} FROM orders GROUP BY 1")
def pivot_levels_swapped(spark, sf_dir):
    return _pivoted(spark, sf_dir, True)


@query(
    "order_info",
    """WITH r AS (SELECT o_custkey AS u, o_orderdate AS reg_time FROM orders WHERE o_orderkey % 4 = 0), t AS (SELECT l_orderkey, count(*) AS term, min(l_shipdate) AS activation FROM lineitem GROUP BY 1),
    j AS (SELECT o_orderkey, o_custkey, o_orderdate, max(reg_time) AS reg FROM orders LEFT JOIN r ON u = o_custkey AND reg_time <= o_orderdate GROUP BY ALL)
    SELECT o_orderkey, strftime(reg, '%Y-%m-%d') AS registered, strftime(reg + INTERVAL 1 HOUR * (o_orderkey % 24), '%Y-%m-%d %H:%M') AS filled, term, strftime(activation, '%Y-%m-%d') AS activated, c_mktsegment AS work FROM j LEFT JOIN t ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey""",
)
def order_info(spark, sf_dir):
    """Orders with what their request's JSON, the latest registration and the contract say."""
    o = table(spark, sf_dir, "orders")
    reg = o.where("o_orderkey % 4 = 0").select("o_custkey", F.col("o_orderdate").alias("reg_time")).groupBy("o_custkey", "reg_time").agg(F.lit(1).alias("one"))
    req = o.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey").select("o_orderkey", "o_custkey", "o_orderdate", F.to_json(F.struct(F.struct(F.col("c_mktsegment").alias("work")).alias("info"), (F.col("o_orderkey") % 24).alias("hours"))).alias("req"))
    x = joins.as_of(req, reg, "o_custkey", "o_orderdate", "reg_time", ["one"])
    parsed = x.withColumn("q", F.from_json("req", "info struct<work:string>, hours int"))
    contract = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("term"), F.min("l_shipdate").alias("activation"))
    filled = F.col("asof_reg_time") + F.make_dt_interval(hours=F.col("q.hours"))
    return parsed.join(contract, "o_orderkey", "left").select("o_orderkey", F.date_format("asof_reg_time", "yyyy-MM-dd").alias("registered"), F.date_format(filled, "yyyy-MM-dd HH:mm").alias("filled"), "term", F.date_format("activation", "yyyy-MM-dd").alias("activated"), F.col("q.info.work").alias("work"))


@query("suffix_join", "SELECT o.o_orderkey AS k, o.o_totalprice AS amount_drop, l.amount AS amount, n FROM orders o LEFT JOIN (SELECT l_orderkey, max(l_extendedprice) AS amount, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1) l ON o_orderkey = l_orderkey")
def suffix_join(spark, sf_dir):
    left = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("amount"))
    right = table(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_extendedprice").alias("amount"), F.count("*").alias("n"))
    return shapes.suffixed_join(left, right, ["k"], "left", ("_drop", ""))


@query("natural_join", "SELECT o_custkey AS k, o_orderpriority AS p, o_orderkey, n FROM orders JOIN (SELECT o_custkey AS c, o_orderpriority AS q, count(*) AS n FROM orders GROUP BY ALL) ON c = o_custkey AND q = o_orderpriority")
def natural_join(spark, sf_dir):
    """On the columns that both sides have."""
    left = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("p"), "o_orderkey")
    return joins.natural(left, left.groupBy("k", "p").agg(F.count("*").alias("n")))


@query("round_half_up", "SELECT l_orderkey, l_linenumber, floor(l_quantity / 4 + 0.5)::BIGINT AS points FROM lineitem")
def round_half_up(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.floor(F.col("l_quantity") / 4 + 0.5).alias("points"))


@query("epoch_zoned", "SELECT event_id, epoch_us(ts) // 1000 * 1000 AS utc_us, epoch_us(ts + INTERVAL 8 HOUR) // 1000 * 1000 AS local_us FROM events")
def epoch_zoned(spark, sf_dir):
    """Epoch milliseconds as a zoned time and as the zone's wall clock."""
    zoned = F.timestamp_millis(F.floor(times.micros(F.col("ts")) / 1000))
    wall = F.convert_timezone(F.lit("UTC"), F.lit("Asia/Manila"), zoned.cast("timestamp_ntz"))
    return table(spark, sf_dir, "events").select("event_id", F.unix_micros(zoned).alias("utc_us"), times.micros(wall).alias("local_us"))


@query("local_now", "SELECT n_nationkey, strftime(TIMESTAMP '2024-03-01 02:30:00' + INTERVAL 1 HOUR * (n_regionkey - 4), '%Y-%m-%d %H:%M:%S') AS country_time, strftime(TIMESTAMP '2024-03-01 02:30:00' + INTERVAL 1 HOUR * (n_regionkey - 4), '%Y-%m-%d') AS country_day FROM nation")
def local_now(spark, sf_dir):
    """A country's business time by its fixed offset in hours; now is an argument."""
    local = times.shifted(F.lit("2024-03-01 02:30:00").cast("timestamp_ntz"), F.col("n_regionkey") - 4)
    return table(spark, sf_dir, "nation").select("n_nationkey", F.date_format(local, "yyyy-MM-dd HH:mm:ss").alias("country_time"), F.date_format(local, "yyyy-MM-dd").alias("country_day"))


@query("time_formats", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch_us(ts) // 1000000 + 7 * 3600 WHEN 1 THEN epoch_us(ts) // 1000000 + 7 * 3600 WHEN 2 THEN epoch_us(ts) // 1000000 - 8 * 3600 ELSE epoch_us(TIMESTAMP '2099-12-31 23:59:59') // 1000000 END AS seconds FROM events")
def time_formats(spark, sf_dir):
    """10 and 13 digits moved by a country's hours, the 34-character form by its own zone, anything else the far future."""
    us, k = times.micros(F.col("ts")), F.col("event_id") % 4
    text = F.when(k == 0, F.floor(us / 1000000).cast("string")).when(k == 1, F.floor(us / 1000).cast("string")).when(k == 2, F.date_format("ts", "EEE MMM dd HH:mm:ss 'GMT+08:00' yyyy")).otherwise("unreadable")
    return table(spark, sf_dir, "events").select("event_id", F.unix_seconds(times.any_local_format(text, 7)).alias("seconds"))


@query("regex_find_all", r"SELECT doc_id, len(regexp_extract_all(text, '[A-Z][a-z]+')) AS n, array_to_string(regexp_extract_all(text, '[A-Z][a-z]+'), '|') AS found, regexp_extract(text, '([a-z]+)\.', 1) AS first_end FROM documents")
def regex_find_all(spark, sf_dir):
    all_ = F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(all_).cast("long").alias("n"), F.array_join(all_, "|").alias("found"), F.regexp_extract("text", r"([a-z]+)\.", 1).alias("first_end"))


@query("score_by_function", "SELECT l_orderkey, l_linenumber, round_even(600 - 50 / ln(2) * ln((l_discount * 5 + 0.1) / (1 - (l_discount * 5 + 0.1))), 0) AS given, floor((l_discount * 5 + 0.1) * 100) AS own FROM lineitem")
def score_by_function(spark, sf_dir):
    """A score function that the caller brings: any function of columns."""
    p = F.col("l_discount") * 5 + 0.1
    with_score = lambda fn, name: fn(p).alias(name)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", with_score(lambda c: ranking.points(c, 600.0, 50.0), "given"), with_score(lambda c: F.floor(c * 100).cast("double"), "own"))


@query(
    "day_against_before",
    """WITH x AS (SELECT event_type, floor(value / 20) AS bin, date_diff('day', ts::DATE, DATE '2024-01-20') AS ago FROM events), n AS (SELECT event_type, bin, count(*) FILTER (ago BETWEEN 2 AND 4) AS a, count(*) FILTER (ago = 1) AS z FROM x WHERE ago BETWEEN 1 AND 4 GROUP BY ALL),
    s AS (SELECT event_type, a / sum(a) OVER w AS p, z / sum(z) OVER w AS q, sum(a) OVER w AS n_before, sum(z) OVER w AS n_day FROM n WINDOW w AS (PARTITION BY event_type)) SELECT event_type, sum((p - q) * ln((p + 0.001) / (q + 0.001))) AS psi, max(n_before)::BIGINT AS n_before, max(n_day)::BIGINT AS n_day FROM s GROUP BY 1""",
)
def day_against_before(spark, sf_dir):
    """Yesterday against the three days before it; today is an argument."""
    ago = F.datediff(F.lit("2024-01-20").cast("date"), F.col("ts").cast("date"))
    x = table(spark, sf_dir, "events").withColumn("ago", ago).where("ago BETWEEN 1 AND 4").groupBy("event_type", F.floor(F.col("value") / 20).alias("bin"), (F.col("ago") > 1).alias("before")).agg(F.count("*").alias("n"))
    psi = profiles.lambda_psi(x, ["event_type"], F.col("before"))
    n = x.groupBy("event_type").agg(F.sum(F.when(F.col("before"), F.col("n"))).alias("n_before"), F.sum(F.when(~F.col("before"), F.col("n"))).alias("n_day"))
    return psi.join(n, "event_type")


_INDEXES = [("priority", "o_orderpriority", "o_orderpriority"), ("month", "strftime(o_orderdate, '%Y-%m')", "date_format(o_orderdate, 'yyyy-MM')"), ("day", "strftime(o_orderdate, '%d')", "date_format(o_orderdate, 'dd')"), ("status", "o_orderstatus", "o_orderstatus")]


@query(
    "index_sorted",
    "WITH x AS (" + " UNION ALL ".join(f"SELECT '{n}' AS name, {s} AS key, o_totalprice FROM orders" for n, s, _ in _INDEXES) + r""" ), g AS (SELECT name, key, count(*) AS n, max(o_totalprice) AS most FROM x GROUP BY ALL)
    SELECT name, key, n, most, (CASE WHEN regexp_matches(min(key) OVER (PARTITION BY name), '\p{L}') THEN row_number() OVER (PARTITION BY name ORDER BY key DESC) ELSE row_number() OVER (PARTITION BY name ORDER BY key) END)::INT AS place FROM g""",
)
def index_sorted(spark, sf_dir):
    """Reports by several indexes, each with its rows' places: from behind where the index has letters."""
    o = table(spark, sf_dir, "orders")
    keys = F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.expr(e).alias("key")) for n, _, e in _INDEXES]))
    rows = o.select("o_totalprice", keys).groupBy("name", "key").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("most"))
    return shapes.index_places(rows, "key", ["name"])
