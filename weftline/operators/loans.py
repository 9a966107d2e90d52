"""Loan labels, performance horizons, point-in-time rebuilds, funnels and due-loan reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.times import whole_days
from weftline.functions.tokens import ratio

#: Days past due -> days after the due date from which a loan counts (fixed values).
PAST_DUE = {0: 1, 1: 2, 3: 4, 4: 5, 7: 8, 14: 15}
HORIZONS = (-3, -2, -1, 0, 1, 3, 7, 15)


def flags(due: Column, settled: Column, as_of: Column) -> dict[str, Column]:
    """agr_pdN: N days past due can be observed at as_of; def_pdN: and the loan wasn't settled by then. as_of is always an argument."""
    out = {}
    for n, days in PAST_DUE.items():
        mature = whole_days(due, as_of) >= days
        unpaid = settled.isNull() | (whole_days(due, settled) >= days)
        out[f"agr_pd{n}"] = mature.cast("int")
        out[f"def_pd{n}"] = F.when(mature, (unpaid).cast("int")).otherwise(0)
    return out


def vintage(loans: DataFrame, by: list[str]) -> DataFrame:
    """Mature loans, defaults and rates per group and label."""
    sums = [F.sum(f"{k}_pd{n}").alias(f"{k}_pd{n}") for n in PAST_DUE for k in ("agr", "def")]
    got = loans.groupBy(*by).agg(F.count("*").alias("n"), *sums)
    return got.withColumns({f"rate_pd{n}": F.try_divide(F.col(f"def_pd{n}"), F.col(f"agr_pd{n}")) for n in PAST_DUE})


def horizons(due: Column, finished: Column, as_of: Column, amount: Column) -> dict[str, Column]:
    """For each horizon h: due by h days before as_of, finished by h days after the due date, and the amounts of both."""
    out = {}
    for h in HORIZONS:
        name = f"m{-h}" if h < 0 else f"p{h}"
        is_due = whole_days(due, as_of) >= h
        done = is_due & finished.isNotNull() & (whole_days(due, finished) <= h)
        out[f"due_{name}"] = is_due.cast("int")
        out[f"finish_{name}"] = F.coalesce(done, F.lit(False)).cast("int")
        out[f"due_amount_{name}"] = F.when(is_due, amount).otherwise(0)
        out[f"finish_amount_{name}"] = F.when(F.coalesce(done, F.lit(False)), amount).otherwise(0)
    return out


def risk_report(loans: DataFrame, by: list[str]) -> DataFrame:
    """One aggregate over all horizons, then bad rates by orders and by amount."""
    names = [f"m{-h}" if h < 0 else f"p{h}" for h in HORIZONS]
    got = loans.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(f"{k}_{x}").alias(f"{k}_{x}") for x in names for k in ("due", "finish", "due_amount", "finish_amount")])
    return got.withColumns({f"bad_{x}": F.try_divide(F.col(f"due_{x}") - F.col(f"finish_{x}"), F.col(f"due_{x}")) for x in names} | {f"bad_amount_{x}": F.try_divide(F.col(f"due_amount_{x}") - F.col(f"finish_amount_{x}"), F.col(f"due_amount_{x}")) for x in names})


def orders_seen_at(orders: DataFrame, key: str, id_: str, status: str, own_status: int = 20) -> DataFrame:
    """For every order the user's orders up to it, its own with the status it had when applying: (own_id, history)."""
    entry = F.struct(F.col(id_).alias("id"), F.col(status).alias("status"))
    upto = F.collect_list(entry).over(W.partitionBy(key).orderBy(id_).rowsBetween(W.unboundedPreceding, 0))
    own = lambda e, mine: F.struct(e.id.alias("id"), F.when(e.id == mine, F.lit(own_status)).otherwise(e.status.cast("int")).alias("status"))
    return orders.select(key, F.col(id_).alias("own_id"), upto.alias("h")).select(key, "own_id", F.transform("h", lambda e: own(e, F.col("own_id"))).alias("history"))


def rewind(instalments: DataFrame, settled: str, applied: str, id_: str, extension: str, fields: list[str]) -> DataFrame:
    """Instalments as they stood when the later loan was applied for.

    What was settled after that is open again: status 1, settlement type 0 and
    the repaid fields 0; of rows that share an id only the one with most
    extensions is reset.
    """
    w = W.partitionBy(id_)
    later = F.col(settled) > F.col(applied)
    last = (F.count("*").over(w) == 1) | (F.col(extension) == F.max(extension).over(w))
    marked = instalments.withColumn("_open", F.coalesce(later & last, F.lit(False)))
    return marked.withColumns({"status": F.when(F.col("_open"), F.lit(1)).otherwise(F.col("status"))} | {f: F.when(F.col("_open"), F.lit(0)).otherwise(F.col(f)) for f in fields}).drop("_open")


def funnel(orders: DataFrame, by: list[str], status: str, user: str, domain: dict[str, list[str]]) -> DataFrame:
    """Counts and shares of each stage per group, by orders and by distinct users."""
    hit = {name: F.col(status).isin(values) for name, values in domain.items()}
    got = orders.groupBy(*by).agg(F.count("*").alias("n_orders"), F.count_distinct(user).alias("n_users"), *[F.count_if(c).alias(f"n_{k}") for k, c in hit.items()], *[F.count_distinct(F.when(c, F.col(user))).alias(f"users_{k}") for k, c in hit.items()])
    return got.withColumns({f"rate_{k}": ratio(F.col(f"n_{k}"), F.col("n_orders")) for k in hit} | {f"user_rate_{k}": ratio(F.col(f"users_{k}"), F.col("n_users")) for k in hit})


def subtotals(df: DataFrame, group: str, pivot: str, sums: dict[str, Column], total: str = "1ALL") -> DataFrame:
    """(group, pivot, sums) with a subtotal per pivot value; one aggregate by grouping sets."""
    got = df.groupingSets([[F.col(group), F.col(pivot)], [F.col(pivot)]], F.col(group), F.col(pivot)).agg(F.grouping(group).alias("_g"), *[c.alias(k) for k, c in sums.items()])
    return got.withColumn(group, F.when(F.col("_g") == 1, F.lit(total)).otherwise(F.col(group))).drop("_g")


def rejections(orders: DataFrame, group: str, bin_: str, rejected: Column, user: str) -> DataFrame:
    """Rejected orders and users per bin against the group's totals."""
    n = orders.groupBy(group, bin_).agg(F.count_if(rejected).alias("n_rejected"), F.count_distinct(F.when(rejected, F.col(user))).alias("users_rejected"))
    totals = orders.groupBy(group).agg(F.count("*").alias("n_orders"), F.count_distinct(user).alias("n_users"))
    return n.join(totals, group).withColumns({"reject_rate": F.col("n_rejected") / F.col("n_orders"), "user_reject_rate": F.col("users_rejected") / F.col("n_users")})
