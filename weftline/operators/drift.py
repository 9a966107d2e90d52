"""Population and characteristic stability between two sets, under named policies.

Shares of (feature, bin) in set p (expected) and q (actual):
guard1   (p - q) * ln(p / q), with 1 and -1 for the empty cells
raw      the same, bins that p lacks left out, null where q is empty
lambda   (p - q) * ln((p + 0.001) / (q + 0.001))
floor    zero shares become 1e-4
density  shares divided by the bins' width, zeros become 1e-6
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators.woe import LAMBDA, guard1


def term(p: Column, q: Column, policy: str, width: Column | None = None) -> Column:
    if policy == "guard1":
        return (p - q) * guard1(p, q)
    if policy == "raw":
        return F.when((p > 0) & (q > 0), (p - q) * F.ln(F.nullif(p, F.lit(0.0)) / F.nullif(q, F.lit(0.0))))
    if policy == "lambda":
        return (p - q) * F.ln((p + LAMBDA) / (q + LAMBDA))
    if policy == "floor":
        a, b = F.when(p == 0, 1e-4).otherwise(p), F.when(q == 0, 1e-4).otherwise(q)
        return (a - b) * F.ln(a / b)
    if policy == "density":
        a, b = F.when(p == 0, 1e-6).otherwise(p / width), F.when(q == 0, 1e-6).otherwise(q / width)
        return (a - b) * F.ln(a / b)
    raise ValueError(f"unknown policy {policy!r}")


def shares(rows: DataFrame, is_first: Column, by: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """(by..., bin, p, q) from one aggregate over both sets; a bin that only one set has gets 0 in the other."""
    by = by or ["feature"]
    w = F.lit(1) if weight is None else weight
    n = rows.groupBy(*by, "bin").agg(F.sum(F.when(is_first, w).otherwise(0)).alias("n_first"), F.sum(F.when(is_first, 0).otherwise(w)).alias("n_second"))
    over = W.partitionBy(*by)
    part = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.sum(c).over(over)), F.lit(0.0))
    return n.withColumns({"p": part("n_first"), "q": part("n_second")})


def psi(table: DataFrame, policy: str = "guard1", by: list[str] | None = None, width: Column | None = None) -> DataFrame:
    """(by..., psi): the sum over bins."""
    return table.withColumn("term", term(F.col("p"), F.col("q"), policy, width)).groupBy(*(by or ["feature"])).agg(F.sum("term").alias("psi"))
