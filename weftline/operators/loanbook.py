"""Loans in full: performance at horizons with extensions, post-loan reports, funnels by order and user, labels with lifetime value, period reports of a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.times import micros, week_start, whole_days
from weftline.operators import binning, profiles
from weftline.operators.joins import leading_sum
from weftline.operators.loans import HORIZONS, PAST_DUE
from weftline.operators.woe import LAMBDA
from weftline.sources.tables import checked_broadcast, kept

#: Horizons at which loans are counted that were never overdue (fixed values).
NEVER_LATE = (1, 3, 7, 15)


def horizon_name(h: int) -> str:
    return f"m{-h}" if h < 0 else str(h)


def performance(loans: DataFrame, order_type: int = 0) -> DataFrame:
    """Adds, for each horizon h, due_h, finish_h, amount_h and paid_h, and finish_0_h, to loans at a day of observation.

    loans has status, first_deadline, deadline, last_update, extended_on and
    today (days), amount and total_paid. A loan whose deadline moved counts as
    finished on the day of its first extension (``order_type`` 0); with 1 only
    these loans are looked at, by their last deadline and own status. A part of
    a loan that is overdue counts as paid by h if its last change was by then.
    """
    moved = F.col("deadline") > F.col("first_deadline")
    x = loans.withColumn("is_extension", moved.cast("int"))
    late = lambda day, due: F.datediff(F.col(day), F.col(due))
    if order_type == 0:
        due, status = "first_deadline", F.when(moved, "FINISH").otherwise(F.col("status"))
        overdue = F.when(status == "DUNNING", late("today", due)).when(moved, late("extended_on", due)).when(status == "FINISH", late("last_update", due)).otherwise(0)
        paid = F.when(moved, F.col("amount")).otherwise(F.least("total_paid", "amount"))
    else:
        x = x.where(moved)
        due, status = "deadline", F.col("status")
        overdue = F.when(status == "DUNNING", late("today", due)).when(status == "FINISH", late("last_update", due)).otherwise(0)
        paid = F.least("total_paid", "amount")
    x = x.withColumns({"state": status, "days_due": late("today", due), "overdue_days": overdue, "paid": paid, "change": late("last_update", due)})
    done = lambda h: (F.col("state") == "FINISH") & (F.col("overdue_days") <= h)
    out = {}
    for h in HORIZONS:
        name, is_due = horizon_name(h), F.col("days_due") > h
        out[f"due_{name}"] = is_due.cast("int")
        out[f"finish_{name}"] = (is_due & done(h)).cast("int")
        out[f"amount_{name}"] = F.when(is_due, F.col("amount")).otherwise(0)
        out[f"paid_{name}"] = F.when(is_due & (done(h) | ((F.col("state") == "DUNNING") & (F.col("change") <= h))), F.col("paid")).otherwise(0)
    for h in NEVER_LATE:
        out[f"finish_0_{h}"] = ((F.col("days_due") > h) & done(0)).cast("int")
    return x.withColumns(out)


def post_loan_sums() -> dict[str, Column]:
    """The measures of a post-loan report but for its distinct counts, as aggregates of performance()'s columns."""
    names = [horizon_name(h) for h in HORIZONS]
    sums = {c: F.sum(c).cast("double") for c in ("amount", "actual_amount", "admin_amount")} | {"extensions": F.sum("is_extension")}
    for n in names:
        sums |= {f"due_{n}": F.sum(f"due_{n}"), f"finish_{n}": F.sum(f"finish_{n}"), f"amount_{n}": F.sum(f"amount_{n}").cast("double"), f"paid_{n}": F.sum(f"paid_{n}").cast("double")}
    return sums | {f"finish_0_{h}": F.sum(f"finish_0_{h}") for h in NEVER_LATE}


def post_loan_rates(orders: str = "orders") -> dict[str, Column]:
    """Averages and rates of post_loan_sums(); null where nothing is due."""
    part = lambda a, b: F.try_divide(a, F.nullif(b.cast("double"), F.lit(0.0)))
    c = F.col
    out = {"amount_avg": part(c("amount"), c(orders)), "admin_rate": part(c("admin_amount"), c("amount")), "extension_rate": part(c("extensions"), c(orders))}
    for n in map(horizon_name, HORIZONS):
        out |= {f"bad_amount_{n}": 1 - part(c(f"paid_{n}"), c(f"amount_{n}")), f"bad_order_{n}": 1 - part(c(f"finish_{n}"), c(f"due_{n}"))}
    return out | {f"recall_{h}": part(c(f"finish_{h}") - c(f"finish_0_{h}"), c(f"due_{h}") - c(f"finish_0_{h}")) for h in NEVER_LATE}


def distinct_counts(rows: DataFrame, by: list[str], columns: dict[str, str], total: bool = False) -> DataFrame:
    """(_g, by..., a count of distinct values for each name: column) per group, and with ``total`` over everything, _g 1.

    Each column's values are told apart by themselves, so that no row carries other
    columns or sums along, as it would beside the sums of one aggregate.
    """
    each = None
    for name, c in columns.items():
        told = rows.select(*by, c).where(F.col(c).isNotNull()).distinct()
        n = told.groupBy(*by).agg(F.count("*").alias("n")).withColumn("_g", F.lit(0))
        if total:
            all_ = told.select(c).distinct().agg(F.count("*").alias("n"))
            n = n.unionByName(all_.withColumn("_g", F.lit(1)), allowMissingColumns=True)
        n = n.withColumn("name", F.lit(name))
        each = n if each is None else each.unionByName(n)
    return each.groupBy("_g", *by).agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in columns])


def post_loan_report(performed: DataFrame, by: list[str], total: str | None = None) -> DataFrame:
    """All measures per group; with ``total`` a row of that name over everything too. performed is read three times and should be cheap to read."""
    sums = [v.alias(k) for k, v in post_loan_sums().items()]
    told = distinct_counts(performed, by, {"orders": "id", "users": "phone"}, total is not None)
    if total is None:
        g = performed.groupBy(*by).agg(*sums).withColumn("_g", F.lit(0))
    else:
        g = performed.groupingSets([[F.col(b) for b in by], []], *[F.col(b) for b in by]).agg(F.grouping(by[0]).cast("int").alias("_g"), *sums)
    told = told.select(*[F.col(c).alias(f"_{c}") for c in told.columns])
    same = F.col("_g") == F.col("__g")
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(f"_{b}"))
    g = g.join(told, same, "left").select("_g", *by, *[F.coalesce(f"_{n}", F.lit(0)).alias(n) for n in ("orders", "users")], *post_loan_sums())  # a row per group
    if total is None:
        return g.drop("_g").withColumns(post_loan_rates())
    g = g.withColumns({b: F.when(F.col("_g") == 1, F.lit(total)).otherwise(F.col(b)) for b in by}).drop("_g")
    whole = g.where(F.col(by[0]) == total).select(F.col("orders").alias("_o"), F.col("users").alias("_u"), F.col("amount").alias("_a"))
    shared = g.crossJoin(F.broadcast(whole))  # one row
    return shared.withColumns(post_loan_rates() | {"order_rate": F.col("orders") / F.col("_o"), "user_rate": F.col("users") / F.col("_u"), "share_of_amount": F.col("amount") / F.col("_a")}).drop("_o", "_u", "_a")


#: Which states of an application mean what (fixed values).
LENT, DENIED = ("FINISH", "DUNNING", "LOAN_SUCCESS"), ("ROBOT_DENY", "FINAL_DENY")


def stages(status: Column) -> dict[str, Column]:
    """pending, reject, loan, cancel and pass of an application, 0 or 1."""
    lent, pending, denied = status.isin(*LENT), status == "PENDING", status == "ROBOT_DENY"
    return {"reject": denied.cast("int"), "pending": pending.cast("int"), "loan": lent.cast("int"), "cancel": (~(lent | pending | denied)).cast("int"), "pass": (~(pending | denied)).cast("int")}


def application_funnel(applications: DataFrame, by: list[str]) -> DataFrame:
    """Counts and rates of the five stages by orders, and of three by users whose rows of equal stages count once. Needs id, phone, status."""
    x = applications.withColumns(stages(F.col("status")))
    names = list(stages(F.col("status")))
    rate = lambda a, b: F.round(F.try_divide(F.col(a), F.col(b)), 4)
    orders = x.groupBy(*by).agg(F.count("id").alias("orders"), *[F.sum(n).alias(f"{n}_num") for n in names]).withColumns({f"{n}_rate": rate(f"{n}_num", "orders") for n in names})
    users = x.select(*by, "phone", *names).distinct().groupBy(*by).agg(F.count_distinct("phone").alias("users"), *[F.sum(n).alias(f"user_{n}_num") for n in ("reject", "pass", "loan")])
    return orders.join(users.withColumns({f"user_{n}_rate": rate(f"user_{n}_num", "users") for n in ("reject", "pass", "loan")}), by, "left")


def pass_sums() -> dict[str, Column]:
    """Applied, passed and lent, by orders and users, with amounts of what was lent. Needs id, phone, status, amount, actual_amount."""
    passed, lent = ~F.col("status").isin(*DENIED), F.col("status").isin(*LENT)
    n = lambda c, when=None: F.count_distinct(F.col(c) if when is None else F.when(when, F.col(c)))
    return {
        "orders": n("id"), "users": n("phone"), "pass_orders": n("id", passed), "pass_users": n("phone", passed), "loan_orders": n("id", lent), "loan_users": n("phone", lent),
        "amount": F.sum(F.when(lent, F.col("amount"))).cast("double"), "actual_amount": F.sum(F.when(lent, F.col("actual_amount"))).cast("double"),
    }


def pass_rates(applications: DataFrame, group: str, total: str = "All") -> DataFrame:
    """pass_sums per group with a row for all, and shares of that row."""
    g = applications.groupingSets([[F.col(group)], []], F.col(group)).agg(F.grouping(group).alias("_g"), *[v.alias(k) for k, v in pass_sums().items()])
    g = g.withColumn(group, F.when(F.col("_g") == 1, F.lit(total)).otherwise(F.col(group))).drop("_g")
    all_ = F.broadcast(g.where(F.col(group) == total).select(F.col("orders").alias("_o"), F.col("users").alias("_u")))  # one row
    part = lambda a, b: F.coalesce(F.round(F.try_divide(F.col(a), F.col(b)), 4), F.lit(0.0))
    rates = {"order_rate": part("orders", "_o"), "user_rate": part("users", "_u"), "pass_order_rate": part("pass_orders", "orders"), "pass_user_rate": part("pass_users", "users"), "avg_amount_order": part("amount", "loan_orders")}
    return g.crossJoin(all_).withColumns(rates).drop("_o", "_u")


def pass_pivot(applications: DataFrame, group: str, pivot: str, values: list[str], total: str = "1ALL") -> DataFrame:
    """A row per group and one of subtotals, for each pivot value its orders, share of the subtotal and pass rate; groups with a letter in descending order."""
    passed = ~F.col("status").isin(*DENIED)
    g = applications.groupingSets([[F.col(group), F.col(pivot)], [F.col(pivot)]], F.col(group), F.col(pivot)).agg(F.grouping(group).alias("_g"), F.count_distinct("id").alias("orders"), F.count_distinct(F.when(passed, F.col("id"))).alias("passed"))
    g = g.withColumn(group, F.when(F.col("_g") == 1, F.lit(total)).otherwise(F.col(group)))
    whole = F.max(F.when(F.col("_g") == 1, F.col("orders"))).over(W.partitionBy(pivot))  # a row per group and pivot value
    g = g.withColumns({"share": F.round(F.col("orders") / whole, 4), "pass_rate": F.round(F.col("passed") / F.col("orders"), 4)})
    wide = g.groupBy(group).pivot(pivot, values).agg(F.first("orders").alias("orders"), F.first("share").alias("share"), F.first("pass_rate").alias("pass_rate"))
    return wide.withColumn("place", F.when(F.col(group).rlike("[A-Za-z]"), F.row_number().over(W.orderBy(F.col(group).desc()))).otherwise(F.row_number().over(W.orderBy(group))))  # a row per group


def labels(loans: DataFrame, as_of: Column) -> DataFrame:
    """Flags and amounts of each day past due, of the current state too; keys of month, week and date; repaid, payout, profit and their sums over the user's next 30 days.

    loans has id, user_id, create_time, apply_time, repayment_date, update_time,
    status (2 is settled), extension_count, settlement_type, principal,
    cut_interest and repaid. Days are floored; as_of is midnight of the day.
    """
    settled = F.when(F.col("status") == 2, F.date_trunc("day", F.col("update_time")).cast("timestamp_ntz"))
    lent = F.col("principal") - F.col("cut_interest")
    x = loans.withColumn("finish_date", settled)
    out = {}
    for n, days in PAST_DUE.items():
        due = whole_days(F.col("repayment_date"), as_of) >= days
        late = F.col("finish_date").isNull() | (whole_days(F.col("repayment_date"), F.col("finish_date")) >= days)
        out |= {f"agr_pd{n}": due.cast("int"), f"def_pd{n}": (due & late).cast("int"), f"agr_pd{n}_amt": F.when(due, lent).otherwise(0), f"def_pd{n}_amt": F.when(due & late, lent).otherwise(0)}
    x = x.withColumns(out)
    open_ = (F.col("agr_pd0") == 1) & (F.col("status") != 2)
    x = x.withColumns({"agr_cpd": F.col("agr_pd0"), "def_cpd": open_.cast("int"), "agr_cpd_amt": F.col("agr_pd0_amt"), "def_cpd_amt": F.when(open_, lent).otherwise(0)})
    for k, c in (("loan", "create_time"), ("apply", "apply_time"), ("repayment", "repayment_date")):
        x = x.withColumns({f"{k}_month": F.date_format(c, "yyyy-MM"), f"{k}_week": week_start(F.col(c))})
    x = x.withColumns({"loan_date": F.date_format("create_time", "yyyy-MM-dd"), "apply_date": F.date_format("apply_time", "yyyy-MM-dd"), "original": (F.col("extension_count") == 0).cast("int"), "is_extension": (F.col("settlement_type") == 2).cast("int")})
    x = x.withColumn("payout", F.when(F.col("extension_count") == 0, lent).otherwise(0))
    x = x.withColumn("profit", F.when(F.col("agr_pd7") == 1, F.col("repaid") - F.col("payout")).otherwise(0))
    x = x.withColumn("_us", micros(F.col("create_time")))
    x = x.withColumns({f"{m}_ltv": leading_sum("user_id", F.col("_us"), 31, F.col(m)) for m in ("repaid", "payout", "profit")}).drop("_us")
    return x.withColumn("def_ltv", (F.col("profit_ltv") < 0).cast("int"))


def cut_points(scored: DataFrame, first: Column, score: str = "score", by: str | None = None) -> DataFrame:
    """(edges), one row, or (by, edges): quantile edges of the first period, 10 bins from 1,000 rows on, else 5; all other periods use them."""
    base = scored.where(first).select((F.col(by) if by else F.lit(1)).alias("one"), F.col(score).alias("value"))
    few, many = [i / 5 for i in range(6)], [i / 10 for i in range(11)]
    q = binning.quantiles(base, few + many, ["one"])
    n = base.groupBy("one").agg(F.count("*").alias("n"))
    return q.join(n, "one").select(*([F.col("one").alias(by)] if by else []), F.array_distinct(F.when(F.col("n") >= 1000, F.slice("q", len(few) + 1, len(many))).otherwise(F.slice("q", 1, len(few)))).alias("edges"))


def score_report(scored: DataFrame, edges: DataFrame, rate: float = 1.0, least_rows: int = 50) -> DataFrame:
    """(period, bin, ...) of a score, bins from the highest down, and a row of totals, bin 0, per period with more than ``least_rows`` rows.

    scored has period, score, target, amount; edges is one row, or one per period.
    Amounts are divided by ``rate``.
    auc_cum of the i-th row from the top is that of the raw scores in the i
    lowest bins, as the reports have always had it; flipped above one half,
    carried on where there is one class only.
    """
    attach = lambda df: df.join(checked_broadcast(edges), "period") if "period" in edges.columns else df.crossJoin(F.broadcast(edges))
    value = scored.select("period", F.col("score").alias("value"), "target", "amount")
    a = F.col("amount")
    per = profiles.value_table(value, ["period"], {"amount": a, "bad_amount": F.when(F.col("target") == 1, a).otherwise(0)})
    totals = kept(profiles.class_totals(per, ["period"]).where(F.col("all_good") + F.col("all_bad") > least_rows), "report-totals")
    binned = attach(per.join(F.broadcast(totals.select("period")), "period"))
    inside = (F.col("value") >= F.element_at("edges", 1)) & (F.col("value") <= F.element_at("edges", -1))
    binned = binned.where(inside).withColumn("bin", binning.bin_of_quantile(F.col("value"), F.col("edges"))).drop("edges")
    bins = profiles.bins_of(binned, ["period"], ["amount", "bad_amount"])
    bins = bins.withColumns({c: F.col(c).cast("double") for c in ("amount", "bad_amount")})  # decimals up to here: sums are exact
    grid = attach(totals).withColumn("bin", F.explode(F.sequence(F.lit(1), F.size("edges") - 1))).withColumn("n_bins", F.size("edges") - 1).drop("edges")
    x = grid.join(bins, ["period", "bin"], "left").na.fill(0)  # a row per period and bin from here on
    w = W.partitionBy("period")
    up, down = w.orderBy("bin").rowsBetween(W.unboundedPreceding, 0), w.orderBy(F.col("bin").desc()).rowsBetween(W.unboundedPreceding, 0)
    sums = lambda c, over: F.sum(c).over(over)
    auc = F.try_divide(sums("wins", up), (sums("good", up) * sums("bad", up)).cast("double"))
    x = x.withColumn("auc", F.greatest(auc, 1 - auc))
    x = x.withColumn("auc", F.last("auc", ignorenulls=True).over(up))
    by_code = F.sort_array(F.collect_list(F.struct("bin", "auc")).over(w))
    x = x.withColumn("auc_cum", F.coalesce(F.element_at(by_code, (F.col("n_bins") + 1 - F.col("bin")).cast("int")).auc, F.lit(0.0)))
    g, b = F.col("good") / F.col("all_good"), F.col("bad") / F.col("all_bad")
    all_ = F.col("all_good") + F.col("all_bad")
    woe = F.ln((g + LAMBDA) / (b + LAMBDA))
    part = lambda c, d: F.coalesce(F.try_divide(c, d), F.lit(0.0))
    x = x.withColumns({"total": F.col("good") + F.col("bad"), "good_amount": F.col("amount") - F.col("bad_amount")})
    x = x.withColumns({
        "total_rate": F.col("total") / all_, "amount_sum": F.col("amount") / rate, "amount_mean": part(F.col("amount") / rate, F.col("total")), "good_amount_sum": F.col("good_amount") / rate, "bad_amount_sum": F.col("bad_amount") / rate,
        "brate": part(F.col("bad"), F.col("total")), "lift": part(F.col("bad") / F.col("total"), F.col("all_bad") / all_), "brate_cum": part(sums("bad", down), sums("bad", down) + sums("good", down)), "bad_amount_rate": part(F.col("bad_amount"), F.col("amount")),
        "woe": woe, "iv": sums((g - b) * woe, w), "ks": F.abs(sums("bad", down) / F.col("all_bad") - sums("good", down) / F.col("all_good")),
    })
    columns = ["total", "total_rate", "good", "bad", "amount_sum", "amount_mean", "good_amount_sum", "bad_amount_sum", "brate", "lift", "brate_cum", "bad_amount_rate", "woe", "iv", "ks", "auc_cum"]
    rows = kept(x.select("period", "bin", *columns), "report-rows")
    s = {c: F.sum(c) for c in ("total", "total_rate", "good", "bad", "amount_sum", "good_amount_sum", "bad_amount_sum")} | {c: F.max(c) for c in ("iv", "ks")} | {"auc_cum": F.min_by("auc_cum", "bin")}
    t = rows.groupBy("period").agg(*[v.alias(k) for k, v in s.items()])
    t = t.withColumns({"bin": F.lit(0), "amount_mean": F.col("amount_sum") / F.col("total"), "brate": F.col("bad") / F.col("total"), "brate_cum": F.col("bad") / F.col("total"), "bad_amount_rate": F.col("bad_amount_sum") / F.col("amount_sum"), "lift": F.lit(0.0), "woe": F.lit(0.0)})
    return rows.unionByName(t.select("period", "bin", *columns))
