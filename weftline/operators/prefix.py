"""Running sums over a whole table without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Slices that a table's order is cut into, times the shuffle partitions of the session; each is sorted by itself.
SLICES_PER_PARTITION = 2


def n_below(numbers: Column, value: Column, most: int) -> Column:
    """How many of an ascending array's numbers, ``most`` at most, are less than a value: halved step by step, so few are looked at."""
    steps = [1 << k for k in range(max(1, most).bit_length())][::-1]
    far = lambda i, p: F.when(F.get(numbers, i + p - 1) < value, i + p).otherwise(i)
    return F.when(numbers.isNotNull(), F.aggregate(F.array(*[F.lit(p) for p in steps]), F.lit(0), far))


def _cuts(df: DataFrame, order: str, by: list[str], slices: int) -> DataFrame:
    """(by..., _cuts): a row per group, with the numbers that its order is cut at."""
    at = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    return df.groupBy(*by).agg(F.percentile_approx(order, at, F.lit(10 * slices)).alias("_cuts"))


def running(df: DataFrame, order: str, sums: dict[str, str], by: list[str] | None = None, slices: int | None = None) -> DataFrame:
    """Adds, for each new name: column, the sum over rows up to this one in the order of a numeric column.

    df has one row per (by, order). The order is cut at approximate quantiles
    into slices; what comes before a slice is a running sum over the slices'
    totals, a few rows, and only a slice's own rows are sorted together.
    """
    by = by or []
    slices = slices or max(8, SLICES_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = _cuts(df, order, by, slices)
    # a row per group: each holds slices - 1 numbers
    cut = df.join(F.broadcast(cuts), by) if by else df.crossJoin(F.broadcast(cuts))
    sliced = cut.withColumn("_slice", n_below(F.col("_cuts"), F.col(order), slices - 1)).drop("_cuts")
    totals = sliced.groupBy(*by, "_slice").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*by, "_slice", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    inside = W.partitionBy(*by, "_slice").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    with_own = sliced.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()})
    joined = with_own.join(F.broadcast(starts), [*by, "_slice"])  # groups x slices rows
    return joined.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_slice", *[f"_{n}" for n in sums])


def with_totals(df: DataFrame, sums: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """Adds, for each new name: column, the sum over all rows, or over the group's. One row per group is broadcast."""
    by = by or []
    totals = df.groupBy(*by).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    return df.join(F.broadcast(totals), by) if by else df.crossJoin(F.broadcast(totals))


def share(part: Column, whole: Column) -> Column:
    return F.try_divide(part, whole)


def last_known(df: DataFrame, order: str, value: str, name: str, by: list[str] | None = None, slices: int | None = None) -> DataFrame:
    """Adds, as name, the value of the last row up to this one that has one, in the order of a numeric column.

    df has one row per (by, order). As running(), but for what isn't a sum: a slice
    takes over the last known value of the slices before it.
    """
    by = by or []
    slices = slices or max(8, SLICES_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = _cuts(df, order, by, slices)
    # a row per group: each holds slices - 1 numbers
    cut = df.join(F.broadcast(cuts), by) if by else df.crossJoin(F.broadcast(cuts))
    sliced = cut.withColumn("_slice", n_below(F.col("_cuts"), F.col(order), slices - 1)).drop("_cuts")
    ends = sliced.groupBy(*by, "_slice").agg(F.max(F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("_end"))
    before = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(*by, "_slice", F.last("_end.v", ignorenulls=True).over(before).alias("_carried"))
    inside = W.partitionBy(*by, "_slice").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    own = sliced.withColumn(name, F.last(value, ignorenulls=True).over(inside))
    joined = own.join(F.broadcast(carried), [*by, "_slice"])  # groups x slices rows
    return joined.withColumn(name, F.coalesce(name, "_carried")).drop("_slice", "_carried")
