"""As-of, nearest, interval, leave-one-fold-out and either-key joins out of equi-joins and windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Folds that a leave-one-out may have.
MOST_FOLDS = 1_000


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str], exact: bool = True, how: str = "left") -> DataFrame:
    """left with the values of the latest right row of its key before its time (or at it).

    Both sides are one table in time order and the last right row is carried
    forward, so no pair of rows is built that isn't an answer. right's values
    come out under their own names, its time as asof_<right_time>.
    """
    payload = F.struct(F.col(right_time).alias("t"), *[F.col(v) for v in values])
    first, second = (0, 1) if exact else (1, 0)
    both = right.select(F.col(key).alias("k"), F.col(right_time).alias("at"), F.lit(first).alias("side"), payload.alias("found"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("row")).unionByName(
        left.select(F.col(key).alias("k"), F.col(left_time).alias("at"), F.lit(second).alias("side"), F.lit(None).cast(right.select(payload).schema[0].dataType).alias("found"), F.struct("*").alias("row"))
    )
    last = F.last("found", ignorenulls=True).over(W.partitionBy("k").orderBy("at", "side").rowsBetween(W.unboundedPreceding, 0))
    got = both.withColumn("found", last).where("row IS NOT NULL")
    got = got.where("found IS NOT NULL") if how == "inner" else got
    return got.select("row.*", F.col("found.t").alias(f"asof_{right_time}"), *[F.col(f"found.{v}") for v in values])


def nearest(left: DataFrame, right: DataFrame, key: str, left_id: str, left_us: str, right_us: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the right row of its key that is nearest in time, the earlier of equals; rows without one go.

    The last right row at or before a left row and the first one after it are
    carried to it in time order, so no other pair is built.
    """
    found = F.struct(F.col(right_us).alias("t"), *values)
    nothing = F.lit(None)
    firsts = right.groupBy(key, right_us).agg(F.min(F.struct(*values, F.lit(0).alias("_"))).alias("v")).select(key, right_us, *[F.col(f"v.{c}").alias(c) for c in values])
    kind = firsts.select(found).schema[0].dataType
    both = firsts.select(F.col(key).alias("k"), F.col(right_us).alias("at"), F.lit(0).alias("side"), found.alias("found"), nothing.cast(left.schema[left_id].dataType).alias("id")).unionByName(
        left.select(F.col(key).alias("k"), F.col(left_us).alias("at"), F.lit(1).alias("side"), nothing.cast(kind).alias("found"), F.col(left_id).alias("id"))
    )
    w = W.partitionBy("k").orderBy("at", "side")
    both = both.withColumns({"back": F.last("found", True).over(w.rowsBetween(W.unboundedPreceding, 0)), "ahead": F.first("found", True).over(w.rowsBetween(0, W.unboundedFollowing))})
    closer = F.when(F.col("back").isNull() | (F.col("ahead.t") - F.col("at") < F.col("at") - F.col("back.t")), F.col("ahead")).otherwise(F.col("back"))
    got = both.where("side = 1").withColumn("b", closer).where("b IS NOT NULL")
    return got.select(F.col("k").alias(key), F.col("id").alias(left_id), F.col("at").alias(left_us), F.col("b.t").alias(right_us), *[F.col(f"b.{c}").alias(c) for c in values])


def trailing_sum(df: DataFrame, key: str, micros: Column, days: int, value: Column) -> Column:
    """Sum over the rows of the same key from ``days`` before, not included, to now."""
    return F.sum(value).over(W.partitionBy(key).orderBy(micros).rangeBetween(-(days * 86_400_000_000) + 1, 0))


def leading_sum(key: str, micros: Column, days: int, value: Column) -> Column:
    """Sum over the rows of the same key from now to ``days`` later, not included."""
    return F.sum(value).over(W.partitionBy(key).orderBy(micros).rangeBetween(0, days * 86_400_000_000 - 1))


def leave_one_out(counted: DataFrame, keys: list[str], fold: str, sums: list[str], among: DataFrame | None = None) -> DataFrame:
    """(keys, fold, sums) for every fold without itself, and -1 for all folds; entries that nothing is left of go.

    Total minus own, from one shuffle on the keys: a key's own folds, MOST_FOLDS at
    most, lie in one row with its totals, and folds that it isn't in take the totals.
    Folds are those of ``among``, if given, as a fold may have nothing to count.
    """
    known = sorted(r[0] for r in (counted if among is None else among).select(fold).distinct().limit(MOST_FOLDS + 1).collect())
    if len(known) > MOST_FOLDS:
        raise ValueError(f"{fold} has more than {MOST_FOLDS} values; folds are meant to be few")
    kind = counted.schema[fold].dataType
    own = counted.groupBy(*keys, fold).agg(*[F.sum(s).alias(s) for s in sums])
    row = own.groupBy(*keys).agg(*[F.sum(s).alias(f"_all_{s}") for s in sums], F.collect_list(F.struct(F.col(fold).alias("f"), *sums)).alias("_own"))
    each = row.withColumn(fold, F.explode(F.array(*[F.lit(k).cast(kind) for k in [*known, -1]])))
    mine = F.get(F.filter("_own", lambda x: x.f == F.col(fold)), F.lit(0))
    left = each.select(*keys, fold, *[(F.col(f"_all_{s}") - F.coalesce(mine[s], F.lit(0))).alias(s) for s in sums])
    return left.where((F.col(sums[0]) > 0) | (F.col(fold) == -1))


def either_key_hit(left: DataFrame, listed: DataFrame, left_keys: list[str], listed_keys: list[str], when: str) -> DataFrame:
    """Adds first_listed: the least listed date by any of the keys. Two equi-joins, no OR in a join."""
    out = left
    for i, (a, b) in enumerate(zip(left_keys, listed_keys, strict=True)):
        least = listed.groupBy(F.col(b).alias(f"_k{i}")).agg(F.min(when).alias(f"_w{i}"))
        out = out.join(least, F.col(a) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
    return out.withColumn("first_listed", F.least(*[F.col(f"_w{i}") for i in range(len(left_keys))])).drop(*[f"_w{i}" for i in range(len(left_keys))])


def join_all(parts: list[DataFrame], on: list[str], how: str = "inner") -> DataFrame:
    return reduce(lambda a, b: a.join(b, on, how), parts)


def natural(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    return left.join(right, [c for c in left.columns if c in right.columns], how)
