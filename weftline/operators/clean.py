"""Missing values, sentinels, imputation, standardising: one place for each rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What stands for a missing number in models (fixed value).
SENTINEL = -999.0


def finite(c: Column) -> Column:
    """NaN and infinities become null, so that comparisons and quantiles don't see them."""
    c = c.cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def present(c: Column, negative_missing: bool = True) -> Column:
    """The value, or null if it counts as missing: null, NaN, infinite, and negative unless said otherwise."""
    c = finite(c)
    return F.when(c >= 0, c) if negative_missing else c


def with_sentinel(c: Column, negative_missing: bool = True) -> Column:
    return F.coalesce(present(c, negative_missing), F.lit(SENTINEL))


def from_sentinel(c: Column) -> Column:
    return F.when(c != SENTINEL, c)


def numeric(df: DataFrame, but: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in but]


def constant(df: DataFrame, columns: list[str], count_null: bool = True) -> DataFrame:
    """(feature, n_values, is_constant), from one aggregate over all columns."""
    n = lambda c: F.count_distinct(c) + (F.max(F.col(c).isNull().cast("int")) if count_null else F.lit(0))
    wide = df.agg(*[n(c).alias(c) for c in columns])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("n_values"), (F.col(c) <= 1).alias("is_constant")) for c in columns])))


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with each column's most frequent value, the least of equals."""
    return df.agg(*[F.expr(f"mode() WITHIN GROUP (ORDER BY `{c}`)").alias(c) for c in columns])


def standardise(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """Adds z_<column>, by the train rows' mean and population deviation."""
    fitted = df.where(train).agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    joined = df.crossJoin(F.broadcast(fitted))  # one row
    return joined.withColumns({f"z_{c}": F.try_divide(F.col(c) - F.col(f"m_{c}"), F.nullif(F.col(f"s_{c}"), F.lit(0.0))) for c in columns}).drop(*[f"{p}_{c}" for p in "ms" for c in columns])


def long_form(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """A row per row and feature: the number of features no longer matters for the number of jobs."""
    return df.unpivot(keep, features, "feature", "value")
