"""Loan reports in full, and the named loan datasets that are composed of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import joins, loanbook
from weftline.operators.loans import HORIZONS, PAST_DUE
from weftline.plans.registry import query
from weftline.sources.tables import kept, table

TODAY = "2001-06-01"

STATUS = {"F": "FINISH", "P": "DUNNING", "O": "LOAN_SUCCESS"}


def _paid():
    """What line items bring, in whole hundredths."""
    return (F.sum(F.floor(F.col("l_extendedprice") * 100 * (1 - F.col("l_discount")))).cast("decimal(18,0)") * F.lit(0.01).cast("decimal(3,2)")).cast("decimal(18,2)")


def _book(spark, sf_dir):
    """Orders as loans with a moved deadline for every seventh, paid by their line items."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_shipdate").cast("date").alias("last_update"), _paid().alias("total_paid"))
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "id")
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    x = o.join(lines, "id").join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    first = F.date_add(F.col("o_orderdate").cast("date"), 30)
    return x.select(
        "id", F.col("o_custkey").alias("phone"), F.col("o_orderpriority").alias("channel"), F.col("c_mktsegment").alias("segment"),
        F.when(F.col("o_orderstatus") == "F", "FINISH").when(F.col("o_orderstatus") == "P", "DUNNING").otherwise("LOAN_SUCCESS").alias("status"),
        first.alias("first_deadline"), F.date_add(first, F.when(F.col("id") % 7 == 0, 14).otherwise(0)).alias("deadline"), "last_update", F.date_add(first, (F.col("id") % 5).cast("int") - 2).alias("extended_on"),
        F.lit(TODAY).cast("date").alias("today"), amount.alias("amount"), "total_paid", (amount * F.lit(0.9).cast("decimal(2,1)")).cast("decimal(18,2)").alias("actual_amount"), (amount * F.lit(0.1).cast("decimal(2,1)")).cast("decimal(18,2)").alias("admin_amount"),
    )


def _performed_sql(order_type: int) -> str:
    due = "deadline" if order_type else "first_deadline"
    state = "status" if order_type else "CASE WHEN moved THEN 'FINISH' ELSE status END"
    overdue = f"CASE WHEN state = 'DUNNING' THEN today - due {'' if order_type else 'WHEN moved THEN extended_on - due '}WHEN state = 'FINISH' THEN last_update - due ELSE 0 END"
    paid = "least(total_paid, amount)" if order_type else "CASE WHEN moved THEN amount ELSE least(total_paid, amount) END"
    cols = []
    for h in HORIZONS:
        n, done = loanbook.horizon_name(h), f"(state = 'FINISH' AND overdue <= {h})"
        cols += [f"(today - due > {h})::INT AS due_{n}", f"(today - due > {h} AND {done})::INT AS finish_{n}", f"CASE WHEN today - due > {h} THEN amount ELSE 0 END AS amount_{n}", f"CASE WHEN today - due > {h} AND ({done} OR (state = 'DUNNING' AND last_update - due <= {h})) THEN paid ELSE 0 END AS paid_{n}"]
    cols += [f"(today - due > {h} AND state = 'FINISH' AND overdue <= 0)::INT AS finish_0_{h}" for h in loanbook.NEVER_LATE]
    return f"""l AS (SELECT l_orderkey AS id, max(l_shipdate)::DATE AS last_update, (sum(floor(l_extendedprice * 100 * (1 - l_discount))::BIGINT)::DECIMAL(18,0) * 0.01)::DECIMAL(18,2) AS total_paid FROM lineitem GROUP BY 1),
    b0 AS (SELECT id, o_custkey AS phone, o_orderpriority AS channel, c_mktsegment AS segment, CASE o_orderstatus WHEN 'F' THEN 'FINISH' WHEN 'P' THEN 'DUNNING' ELSE 'LOAN_SUCCESS' END AS status, o_orderdate::DATE + 30 AS first_deadline, last_update, total_paid, o_totalprice::DECIMAL(18,2) AS amount, DATE '{TODAY}' AS today,
      (o_totalprice::DECIMAL(18,2) * 0.9)::DECIMAL(18,2) AS actual_amount, (o_totalprice::DECIMAL(18,2) * 0.1)::DECIMAL(18,2) AS admin_amount FROM orders JOIN l ON id = o_orderkey JOIN customer ON c_custkey = o_custkey),
    b1 AS (SELECT *, first_deadline + CASE WHEN id % 7 = 0 THEN 14 ELSE 0 END AS deadline, first_deadline + (id % 5)::INT - 2 AS extended_on, id % 7 = 0 AS moved FROM b0),
    b2 AS (SELECT *, {due} AS due, {state} AS state, {paid} AS paid FROM b1 {'WHERE moved' if order_type else ''}), b3 AS (SELECT *, {overdue} AS overdue FROM b2), perf AS (SELECT *, moved::INT AS is_extension, {', '.join(cols)} FROM b3)"""


def _report_sql(by: str) -> str:
    names = [loanbook.horizon_name(h) for h in HORIZONS]
    sums = ["count(DISTINCT id) AS orders", "count(DISTINCT phone) AS users", "sum(amount)::DOUBLE AS amount", "sum(actual_amount)::DOUBLE AS actual_amount", "sum(admin_amount)::DOUBLE AS admin_amount", "sum(is_extension)::BIGINT AS extensions"]
    for n in names:
        sums += [f"sum(due_{n})::BIGINT AS due_{n}", f"sum(finish_{n})::BIGINT AS finish_{n}", f"sum(amount_{n})::DOUBLE AS amount_{n}", f"sum(paid_{n})::DOUBLE AS paid_{n}"]
    sums += [f"sum(finish_0_{h})::BIGINT AS finish_0_{h}" for h in loanbook.NEVER_LATE]
    rates = ["amount / orders AS amount_avg", "admin_amount / nullif(amount, 0) AS admin_rate", "extensions / orders AS extension_rate"]
    for n in names:
        rates += [f"1 - paid_{n} / nullif(amount_{n}, 0) AS bad_amount_{n}", f"1 - finish_{n} / nullif(due_{n}, 0) AS bad_order_{n}"]
    rates += [f"(finish_{h} - finish_0_{h}) / nullif(due_{h} - finish_0_{h}, 0) AS recall_{h}" for h in loanbook.NEVER_LATE]
    return f"SELECT {by}, {', '.join(sums)} FROM perf", ", ".join(rates)


def _plain_report(order_type: int) -> str:
    sums, rates = _report_sql("channel")
    return f"WITH {_performed_sql(order_type)}, r AS ({sums} GROUP BY channel) SELECT *, {rates} FROM r"


@query("post_loan_report", _plain_report(0))
def post_loan_report(spark, sf_dir):
    """All measures of the loans of a channel."""
    return loanbook.post_loan_report(loanbook.performance(kept(_book(spark, sf_dir), "book")), ["channel"])


@query("post_loan_report_extensions", _plain_report(1))
def post_loan_report_extensions(spark, sf_dir):
    """Only loans whose deadline moved, by their last deadline."""
    return loanbook.post_loan_report(loanbook.performance(kept(_book(spark, sf_dir), "book"), 1), ["channel"])


def _total_report() -> str:
    sums, rates = _report_sql("coalesce(channel, 'All') AS channel")
    return f"WITH {_performed_sql(0)}, r AS ({sums} GROUP BY GROUPING SETS ((channel), ())), t AS (SELECT orders AS o, users AS u, amount AS a FROM r WHERE channel = 'All') SELECT r.*, {rates}, orders / o AS order_rate, users / u AS user_rate, amount / a AS share_of_amount FROM r, t"


@query("due_risk_report", _total_report())
def due_risk_report(spark, sf_dir):
    """Risk of due loans by group, with a row for all and shares of it."""
    return loanbook.post_loan_report(loanbook.performance(kept(_book(spark, sf_dir), "book")), ["channel"], "All")


@query("loan_performance_rows", f"WITH {_performed_sql(0)} SELECT id, state, (today - due)::INT AS days_due, overdue::INT AS overdue_days, due_m3, finish_m1, finish_0, amount_7::DOUBLE AS amount_7, paid_m2::DOUBLE AS paid_m2, paid_15::DOUBLE AS paid_15, finish_0_7 FROM perf")
def loan_performance_rows(spark, sf_dir):
    x = loanbook.performance(_book(spark, sf_dir))
    return x.select("id", "state", "days_due", "overdue_days", "due_m3", "finish_m1", "finish_0", *[F.col(c).cast("double").alias(c) for c in ("amount_7", "paid_m2", "paid_15")], "finish_0_7")


# applications

APPLIED_SQL = """ap AS (SELECT o_orderkey AS id, o_custkey AS phone, o_orderpriority AS channel, c_mktsegment AS segment, o_totalprice::DECIMAL(18,2) AS amount, (o_totalprice::DECIMAL(18,2) * 0.9)::DECIMAL(18,2) AS actual_amount,
    CASE o_orderkey % 9 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'ROBOT_DENY' WHEN 2 THEN 'FINAL_DENY' WHEN 3 THEN 'CANCELLED' ELSE CASE o_orderstatus WHEN 'F' THEN 'FINISH' WHEN 'P' THEN 'DUNNING' ELSE 'LOAN_SUCCESS' END END AS status FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _applied(spark, sf_dir):
    k = F.col("o_orderkey") % 9
    status = F.when(k == 0, "PENDING").when(k == 1, "ROBOT_DENY").when(k == 2, "FINAL_DENY").when(k == 3, "CANCELLED").when(F.col("o_orderstatus") == "F", "FINISH").when(F.col("o_orderstatus") == "P", "DUNNING").otherwise("LOAN_SUCCESS")
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    x = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return x.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("phone"), F.col("o_orderpriority").alias("channel"), F.col("c_mktsegment").alias("segment"), amount.alias("amount"), (amount * F.lit(0.9).cast("decimal(2,1)")).cast("decimal(18,2)").alias("actual_amount"), status.alias("status"))


_ALL = ("reject", "pending", "loan", "cancel", "pass")


@query(
    "application_funnel",
    f"""WITH {APPLIED_SQL}, s AS (SELECT *, (status = 'ROBOT_DENY')::INT AS reject, (status = 'PENDING')::INT AS pending, (status IN ('FINISH', 'DUNNING', 'LOAN_SUCCESS'))::INT AS loan, (status NOT IN ('FINISH', 'DUNNING', 'LOAN_SUCCESS', 'PENDING', 'ROBOT_DENY'))::INT AS cancel, (status NOT IN ('PENDING', 'ROBOT_DENY'))::INT AS pass FROM ap),
    o AS (SELECT channel, count(*) AS orders, {', '.join(f'sum({n})::BIGINT AS {n}_num' for n in _ALL)} FROM s GROUP BY 1), d AS (SELECT DISTINCT channel, phone, reject, pending, loan, cancel, pass FROM s),
    u AS (SELECT channel, count(DISTINCT phone) AS users, {', '.join(f'sum({n})::BIGINT AS user_{n}_num' for n in ('reject', 'pass', 'loan'))} FROM d GROUP BY 1)
    SELECT o.*, {', '.join(f'round({n}_num / orders, 4) AS {n}_rate' for n in _ALL)}, u.* EXCLUDE (channel), {', '.join(f'round(user_{n}_num / users, 4) AS user_{n}_rate' for n in ('reject', 'pass', 'loan'))} FROM o LEFT JOIN u USING (channel)""",
)
def application_funnel(spark, sf_dir):
    return loanbook.application_funnel(_applied(spark, sf_dir), ["channel"])


@query(
    "application_pass_rates",
    f"""WITH {APPLIED_SQL}, g AS (SELECT coalesce(channel, 'All') AS channel, count(DISTINCT id) AS orders, count(DISTINCT phone) AS users, count(DISTINCT id) FILTER (status NOT IN ('ROBOT_DENY', 'FINAL_DENY')) AS pass_orders, count(DISTINCT phone) FILTER (status NOT IN ('ROBOT_DENY', 'FINAL_DENY')) AS pass_users,
      count(DISTINCT id) FILTER (status IN ('FINISH', 'DUNNING', 'LOAN_SUCCESS')) AS loan_orders, count(DISTINCT phone) FILTER (status IN ('FINISH', 'DUNNING', 'LOAN_SUCCESS')) AS loan_users, (sum(amount) FILTER (status IN ('FINISH', 'DUNNING', 'LOAN_SUCCESS')))::DOUBLE AS amount, (sum(actual_amount) FILTER (status IN ('FINISH', 'DUNNING', 'LOAN_SUCCESS')))::DOUBLE AS actual_amount
      FROM ap GROUP BY GROUPING SETS ((channel), ())), t AS (SELECT orders AS o, users AS u FROM g WHERE channel = 'All')
    SELECT g.*, round(orders / o, 4) AS order_rate, round(users / u, 4) AS user_rate, round(pass_orders / orders, 4) AS pass_order_rate, round(pass_users / users, 4) AS pass_user_rate, round(amount / loan_orders, 4) AS avg_amount_order FROM g, t""",
)
def application_pass_rates(spark, sf_dir):
    """By group with a grand total."""
    return loanbook.pass_rates(_applied(spark, sf_dir), "channel")


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query(
    "application_pass_pivot",
    f"""WITH {APPLIED_SQL}, g AS (SELECT coalesce(channel, '1ALL') AS channel, segment, count(DISTINCT id) AS orders, count(DISTINCT id) FILTER (status NOT IN ('ROBOT_DENY', 'FINAL_DENY')) AS passed FROM ap GROUP BY GROUPING SETS ((channel, segment), (segment))),
    r AS (SELECT g.*, round(g.orders / t.orders, 4) AS share, round(g.passed / g.orders, 4) AS pass_rate FROM g JOIN (SELECT * FROM g WHERE channel = '1ALL') t USING (segment)),
    w AS (SELECT channel, {', '.join(f"max(CASE WHEN segment = '{s}' THEN {c} END) AS {s}_{c}" for s in SEGMENTS for c in ('orders', 'share', 'pass_rate'))} FROM r GROUP BY 1) SELECT *, (row_number() OVER (ORDER BY channel DESC))::INT AS place FROM w""",
)
def application_pass_pivot(spark, sf_dir):
    """By group and pivot with a subtotal per pivot value, shares of it, flat names."""
    return loanbook.pass_pivot(_applied(spark, sf_dir), "channel", "segment", list(SEGMENTS))


# labels

LABEL_SQL = f"""l AS (SELECT l_orderkey AS id, max(l_shipdate) AS update_time, (sum(floor(l_extendedprice * 100 * (1 - l_discount))::BIGINT)::DECIMAL(18,0) * 0.01)::DECIMAL(18,2) AS repaid FROM lineitem GROUP BY 1),
    i AS (SELECT id, o_custkey AS user_id, o_orderdate AS create_time, o_orderdate - INTERVAL 1 DAY * (id % 5) AS apply_time, o_orderdate + INTERVAL 30 DAY AS repayment_date, update_time, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS status, id % 3 AS extension_count, id % 4 AS settlement_type,
      o_totalprice::DECIMAL(18,2) AS principal, (o_totalprice::DECIMAL(18,2) * 0.1)::DECIMAL(18,2) AS cut_interest, repaid FROM orders JOIN l ON id = o_orderkey),
    a AS (SELECT *, principal - cut_interest AS lent, floor((epoch_us(TIMESTAMP '{TODAY}') - epoch_us(repayment_date)) / 86400e6) AS age, CASE WHEN status = 2 THEN floor((epoch_us(date_trunc('day', update_time)) - epoch_us(repayment_date)) / 86400e6) ELSE 1e9 END AS late FROM i),
    p AS (SELECT *, CASE WHEN extension_count = 0 THEN lent ELSE 0 END AS payout, CASE WHEN age >= {PAST_DUE[7]} THEN repaid - CASE WHEN extension_count = 0 THEN lent ELSE 0 END ELSE 0 END AS profit FROM a),
    v AS (SELECT x.id, sum(y.repaid) AS repaid_ltv, sum(y.payout) AS payout_ltv, sum(y.profit) AS profit_ltv FROM p x JOIN p y ON x.user_id = y.user_id AND y.create_time >= x.create_time AND epoch_us(y.create_time) - epoch_us(x.create_time) < 31 * 86400000000 GROUP BY 1)"""
_LABELS = ", ".join(f"(age >= {d})::INT AS agr_pd{n}, (age >= {d} AND late >= {d})::INT AS def_pd{n}, (CASE WHEN age >= {d} THEN lent ELSE 0 END)::DOUBLE AS agr_pd{n}_amt, (CASE WHEN age >= {d} AND late >= {d} THEN lent ELSE 0 END)::DOUBLE AS def_pd{n}_amt" for n, d in PAST_DUE.items())
_KEYS = ", ".join(f"strftime({c}, '%Y-%m') AS {k}_month, strftime(date_trunc('week', {c}), '%Y-%m-%d') AS {k}_week" for k, c in (("loan", "create_time"), ("apply", "apply_time"), ("repayment", "repayment_date")))
_MONEY = ("agr_cpd_amt", "def_cpd_amt", "repaid", "payout", "profit", "repaid_ltv", "payout_ltv", "profit_ltv")


def _instalments(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_shipdate").alias("update_time"), _paid().alias("repaid"))
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "id").join(lines, "id")
    money = F.col("o_totalprice").cast("decimal(18,2)")
    return o.select(
        "id", F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("create_time"), (F.col("o_orderdate") - F.make_dt_interval(days=(F.col("id") % 5).cast("int"))).alias("apply_time"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAY")).alias("repayment_date"), "update_time",
        F.when(F.col("o_orderstatus") == "F", 2).otherwise(1).alias("status"), (F.col("id") % 3).alias("extension_count"), (F.col("id") % 4).alias("settlement_type"), money.alias("principal"), (money * F.lit(0.1).cast("decimal(2,1)")).cast("decimal(18,2)").alias("cut_interest"), "repaid",
    )


def _labelled(spark, sf_dir):
    return loanbook.labels(_instalments(spark, sf_dir), F.lit(TODAY).cast("timestamp_ntz"))


@query(
    "loan_labels",
    f"""WITH {LABEL_SQL} SELECT id, {_LABELS}, (age >= 1)::INT AS agr_cpd, (age >= 1 AND status <> 2)::INT AS def_cpd, (CASE WHEN age >= 1 THEN lent ELSE 0 END)::DOUBLE AS agr_cpd_amt, (CASE WHEN age >= 1 AND status <> 2 THEN lent ELSE 0 END)::DOUBLE AS def_cpd_amt,
    {_KEYS}, strftime(create_time, '%Y-%m-%d') AS loan_date, strftime(apply_time, '%Y-%m-%d') AS apply_date, (extension_count = 0)::INT AS original, (settlement_type = 2)::INT AS is_extension, repaid::DOUBLE AS repaid, payout::DOUBLE AS payout, profit::DOUBLE AS profit,
    repaid_ltv::DOUBLE AS repaid_ltv, payout_ltv::DOUBLE AS payout_ltv, profit_ltv::DOUBLE AS profit_ltv, (profit_ltv < 0)::INT AS def_ltv FROM p JOIN v USING (id)""",
)
def loan_labels(spark, sf_dir):
    """Every label, key and amount of a loan, with the user's next 30 days."""
    x = _labelled(spark, sf_dir)
    flags = [c for n in PAST_DUE for c in (f"agr_pd{n}", f"def_pd{n}")]
    return x.select(
        "id", *flags, *[F.col(f"{c}_amt").cast("double").alias(f"{c}_amt") for c in flags], "agr_cpd", "def_cpd", *[f"{k}_{s}" for k in ("loan", "apply", "repayment") for s in ("month", "week")],
        "loan_date", "apply_date", "original", "is_extension", *[F.col(c).cast("double").alias(c) for c in _MONEY], "def_ltv",
    )


REGISTERED_SQL = "reg AS (SELECT o_custkey AS user_id, o_orderdate AS reg_time, o_orderpriority AS reg_channel FROM orders WHERE o_orderkey % 4 = 0)"


def _registrations(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderkey % 4 = 0").select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("reg_time"), F.col("o_orderpriority").alias("reg_channel"))


@query(
    "all_loans_with_labels",
    f"""WITH {LABEL_SQL}, {REGISTERED_SQL}, j AS (SELECT p.*, reg_time, reg_channel, row_number() OVER (PARTITION BY p.id ORDER BY reg_time DESC NULLS LAST, reg_channel DESC NULLS LAST) AS rn FROM p LEFT JOIN reg ON reg.user_id = p.user_id AND p.apply_time >= reg_time WHERE create_time >= TIMESTAMP '1997-01-01' AND create_time < TIMESTAMP '2000-01-01' AND status IN (1, 2)),
    t AS (SELECT l_orderkey AS id, count(*) AS term FROM lineitem GROUP BY 1)
    SELECT DISTINCT id, user_id, strftime(reg_time, '%Y-%m-%d') AS reg_day, reg_channel, term, (age >= {PAST_DUE[7]})::INT AS agr_pd7, (age >= {PAST_DUE[7]} AND late >= {PAST_DUE[7]})::INT AS def_pd7, profit_ltv::DOUBLE AS profit_ltv, strftime(create_time, '%Y-%m') AS loan_month FROM j JOIN t USING (id) JOIN v USING (id) WHERE rn = 1""",
)
def all_loans_with_labels(spark, sf_dir):
    """Loans of a span of days and statuses with the latest registration before applying, their contract's term and labels."""
    span = F.col("create_time").between(F.lit("1997-01-01").cast("timestamp_ntz"), F.lit("1999-12-31 23:59:59.999999").cast("timestamp_ntz"))
    loans = _labelled(spark, sf_dir).where(span & F.col("status").isin(1, 2))
    last = _registrations(spark, sf_dir).groupBy("user_id", "reg_time").agg(F.max("reg_channel").alias("reg_channel"))
    got = joins.as_of(loans.select("id", "user_id", "apply_time", "agr_pd7", "def_pd7", "profit_ltv", "loan_month"), last, "user_id", "apply_time", "reg_time", ["reg_channel"])
    term = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("term"))
    return got.join(term, "id").select("id", "user_id", F.date_format("asof_reg_time", "yyyy-MM-dd").alias("reg_day"), "reg_channel", "term", "agr_pd7", "def_pd7", F.col("profit_ltv").cast("double").alias("profit_ltv"), "loan_month").distinct()


# a score over periods

PERIOD_SQL = """o AS (SELECT o_totalprice / 1000 AS score, (o_orderstatus = 'P')::INT AS target, o_totalprice::DECIMAL(18,2) AS amount, (date_diff('day', o_orderdate::DATE, DATE '2000-01-01') - 1) // 180 AS period FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' AND o_orderdate >= TIMESTAMP '2000-01-01' - INTERVAL 720 DAY),
    ed AS (SELECT CASE WHEN count(*) >= 1000 THEN list_sort(list_distinct(quantile_cont(score, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) ELSE list_sort(list_distinct(quantile_cont(score, [0, 0.2, 0.4, 0.6, 0.8, 1.0]))) END AS e FROM o WHERE period = 3)"""


def _score_periods(spark, sf_dir):
    """Orders of the 720 days before a day, in periods of 180 days counted back from it."""
    end = F.lit("2000-01-01").cast("date")
    o = table(spark, sf_dir, "orders").where((F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") >= (F.lit("2000-01-01").cast("timestamp_ntz") - F.expr("INTERVAL 720 DAY"))))
    return o.select((F.col("o_totalprice") / 1000).alias("score"), (F.col("o_orderstatus") == "P").cast("int").alias("target"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), F.floor((F.datediff(end, F.col("o_orderdate").cast("date")) - 1) / 180).alias("period"))


@query("report_cut_points", f"WITH {PERIOD_SQL}, b AS (SELECT period, CASE WHEN score >= e[1] AND score <= e[len(e)] THEN greatest(1, len(list_filter(e, lambda x: x < score))) END AS bin FROM o, ed) SELECT period, bin::INT AS bin, count(*) AS n FROM b GROUP BY ALL")
def report_cut_points(spark, sf_dir):
    """The first period's cut points under all periods; what lies outside has no bin."""
    from weftline.operators import binning

    o = _score_periods(spark, sf_dir)
    x = o.crossJoin(F.broadcast(loanbook.cut_points(o, F.col("period") == 3)))  # one row
    inside = (F.col("score") >= F.element_at("edges", 1)) & (F.col("score") <= F.element_at("edges", -1))
    return x.select("period", F.when(inside, binning.bin_of_quantile(F.col("score"), F.col("edges"))).alias("bin")).groupBy("period", "bin").agg(F.count("*").alias("n"))


_REPORT = ("total", "total_rate", "good", "bad", "amount_sum", "amount_mean", "good_amount_sum", "bad_amount_sum", "brate", "lift", "brate_cum", "bad_amount_rate", "woe", "iv", "ks", "auc_cum")


@query(
    "score_report",
    f"""WITH {PERIOD_SQL}, n AS (SELECT period, count(*) AS n, sum(target) AS ab, sum(1 - target) AS ag FROM o GROUP BY 1 HAVING count(*) > 50), bd AS (SELECT o.*, greatest(1, len(list_filter(e, lambda x: x < score))) AS bin FROM o JOIN n USING (period), ed WHERE score >= e[1] AND score <= e[len(e)]),
    gr AS (SELECT period, ab, ag, unnest(range(1, len(e))) AS bin, len(e) - 1 AS nb FROM n, ed), c AS (SELECT period, bin, sum(target) AS bad, sum(1 - target) AS good, sum(amount)::DOUBLE AS amt, (sum(amount * target))::DOUBLE AS bamt FROM bd GROUP BY ALL),
    x AS (SELECT gr.period, gr.bin, nb, ab, ag, coalesce(bad, 0) AS bad, coalesce(good, 0) AS good, coalesce(amt, 0) / 2 AS amt, coalesce(bamt, 0) / 2 AS bamt FROM gr LEFT JOIN c ON c.period = gr.period AND c.bin = gr.bin),
    pv AS (SELECT period, bin, score, sum(target) AS n1, sum(1 - target) AS n0 FROM bd GROUP BY ALL), rv AS (SELECT *, sum(n0) OVER (PARTITION BY period ORDER BY score) AS c0 FROM pv), wn AS (SELECT period, bin, sum(n1 * (c0 - n0 / 2)) AS wins FROM rv GROUP BY ALL),
    av AS (SELECT x.period, x.bin, sum(coalesce(wins, 0)) OVER u / nullif(sum(good) OVER u * sum(bad) OVER u, 0) AS auc FROM x LEFT JOIN wn ON wn.period = x.period AND wn.bin = x.bin WINDOW u AS (PARTITION BY x.period ORDER BY x.bin ROWS UNBOUNDED PRECEDING)),
    af AS (SELECT period, bin, last_value(greatest(auc, 1 - auc) IGNORE NULLS) OVER (PARTITION BY period ORDER BY bin ROWS UNBOUNDED PRECEDING) AS auc FROM av),
    r AS (SELECT x.period, x.bin, bad + good AS total, (bad + good) / (ab + ag) AS total_rate, good, bad, amt AS amount_sum, coalesce(amt / nullif(bad + good, 0), 0) AS amount_mean, amt - bamt AS good_amount_sum, bamt AS bad_amount_sum, coalesce(bad / nullif(bad + good, 0), 0) AS brate, coalesce((bad / nullif(bad + good, 0)) / (ab / (ab + ag)), 0) AS lift,
      coalesce(sum(bad) OVER d / nullif(sum(bad + good) OVER d, 0), 0) AS brate_cum, coalesce(bamt / nullif(amt, 0), 0) AS bad_amount_rate, ln((good / ag + 0.001) / (bad / ab + 0.001)) AS woe, sum((good / ag - bad / ab) * ln((good / ag + 0.001) / (bad / ab + 0.001))) OVER (PARTITION BY x.period) AS iv, abs(sum(bad) OVER d / ab - sum(good) OVER d / ag) AS ks, coalesce(af.auc, 0) AS auc_cum
      FROM x LEFT JOIN af ON af.period = x.period AND af.bin = nb + 1 - x.bin WINDOW d AS (PARTITION BY x.period ORDER BY x.bin DESC ROWS UNBOUNDED PRECEDING))
    SELECT period, bin::INT AS bin, total::BIGINT AS total, total_rate, good::BIGINT AS good, bad::BIGINT AS bad, amount_sum, amount_mean, good_amount_sum, bad_amount_sum, brate, lift, brate_cum, bad_amount_rate, woe, iv, ks, auc_cum FROM r
    UNION ALL SELECT period, 0, sum(total)::BIGINT, sum(total_rate), sum(good)::BIGINT, sum(bad)::BIGINT, sum(amount_sum), sum(amount_sum) / sum(total), sum(good_amount_sum), sum(bad_amount_sum), sum(bad) / sum(total), 0, sum(bad) / sum(total), sum(bad_amount_sum) / sum(amount_sum), 0, max(iv), max(ks), min_by(auc_cum, bin) FROM r GROUP BY period""",
)
def score_report(spark, sf_dir):
    """A score over periods on the first one's cut points: amounts, rates, lift, WOE, KS, IV, AUC and totals; periods of 50 rows or fewer are left out."""
    o = kept(_score_periods(spark, sf_dir), "score-periods")
    return loanbook.score_report(o, loanbook.cut_points(o, F.col("period") == 3), 2.0).select("period", "bin", *_REPORT)
