"""Tables reshaped: constants dropped, JSON flattened, documents rebuilt as of a moment, entities shuffled into folds and sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.sources.tables import kept


#: Columns that JSON may be flattened to.
MOST_KEYS = 5_000


def varying(df: DataFrame, columns: list[str], count_null: bool = True) -> list[str]:
    """Those columns that have two values or more; null is a value if it counts. One aggregate of extremes, no distinct values are held."""
    differs = lambda c: F.coalesce(F.min(c) != F.max(c), F.lit(False))
    mixed = lambda c: (F.count(c) > 0) & (F.count(c) < F.count(F.lit(1))) if count_null else F.lit(False)
    row = df.agg(*[(differs(c) | mixed(c)).alias(c) for c in columns]).first()  # one row
    return [c for c in columns if row[c]]


def drop_constant(df: DataFrame, columns: list[str], count_null: bool = True) -> DataFrame:
    live = set(varying(df, columns, count_null))
    return df.drop(*[c for c in columns if c not in live])


def flatten_json(df: DataFrame, column: str, keep: list[str], prefix: str = "") -> DataFrame:
    """keep and a column for each key of a JSON object of numbers, whatever keys there are; they are found by one aggregate.

    More than MOST_KEYS keys are no columns but data, and an error: explode the map then.
    """
    parsed = df.select(*keep, F.from_json(column, "map<string,double>").alias("_m"))
    keys = sorted(r["k"] for r in parsed.select(F.explode(F.map_keys("_m")).alias("k")).distinct().limit(MOST_KEYS + 1).collect())
    if len(keys) > MOST_KEYS:
        raise ValueError(f"{column} has more than {MOST_KEYS} keys")
    return parsed.select(*keep, *[F.col("_m")[k].alias(f"{prefix}{k}") for k in keys])


def json_paths(column: str, paths: list[str]) -> dict[str, Column]:
    """What stands at dotted paths, null where it is absent."""
    return {p: F.get_json_object(column, f"$.{p}") for p in paths}


def first_of_senders(messages: DataFrame, id_: str, sender: str, time: str) -> DataFrame:
    """(id, apps): a sender's first message as an entry of an app list, in the order of time; a row per sender at most is gathered."""
    first = messages.groupBy(id_, sender).agg(F.min(time).alias("t"))
    app = F.struct("t", F.col(sender).alias("s"))
    ordered = first.groupBy(id_).agg(F.sort_array(F.collect_list(app)).alias("a"))
    shaped = F.transform("a", lambda x: F.struct(x.s.alias("app_name"), x.s.alias("app_package"), x.t.alias("fi_time"), F.lit(0).alias("isSystem"), x.t.alias("lu_time")))
    return ordered.select(id_, shaped.alias("apps"))


def history_rows(orders: DataFrame, own: DataFrame, key: str, id_: str, status: str, own_status: int = 20) -> DataFrame:
    """A row for each of a user's orders up to own's, own's with the status it had when applying. own: (key, own_id), one per user."""
    seen = orders.join(own, key).where(F.col(id_) <= F.col("own_id"))
    return seen.withColumn(status, F.when(F.col(id_) == F.col("own_id"), F.lit(own_status)).otherwise(F.col(status)))


def rewind_instalments(instalments: DataFrame, contracts: DataFrame, own: DataFrame, key: str, order: str, extension: str, zeroed: list[str]) -> DataFrame:
    """Instalments as they stood when a user's own order was applied for.

    Orders after it go. The contract's settlement time replaces the instalment's
    own; where it lies after the application, the repaid amounts are 0, and of
    an order's instalments the one with most extensions is open again: status 1,
    type 0, no extension fee. Overdue days and interest are 0 throughout.
    own: (key, own_id, apply_time), contracts: (order, settlement_time).
    """
    x = instalments.drop("settlement_time").join(contracts, order, "left").join(own, key).where(F.col(order) <= F.col("own_id"))
    later = F.coalesce(F.col("settlement_time") > F.col("apply_time"), F.lit(False))
    w = W.partitionBy(key, order)
    last = (F.count("*").over(w) == 1) | (F.col(extension) == F.max(extension).over(w))
    x = x.withColumns({"_later": later, "_open": later & last})
    reset = {"status": F.when(F.col("_open"), 1).otherwise(F.col("status")), "settlement_type": F.when(F.col("_open"), 0).otherwise(F.col("settlement_type")), "extension_fee": F.when(F.col("_open"), 0.0).otherwise(F.col("extension_fee"))}
    repaid = {c: F.when(F.col("_later"), 0.0).otherwise(F.col(c)) for c in zeroed}
    return x.withColumns(reset | repaid | {"overdue_days": F.lit(0), "overdue_interest": F.lit(0.0)}).drop("_later", "_open")


def shuffled_positions(entities: DataFrame, id_: str, seed: int = 42) -> DataFrame:
    """(id, position): entities in the order of a seeded hash, numbered from 0 without a gap.

    Numbered in 4,096 parts of the hash, whose sizes are summed up first, so that
    no task sorts them all.
    """
    hashed = kept(entities.select(id_).distinct().withColumn("_h", F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_).cast("string")))).withColumn("_part", F.substring("_h", 1, 3)), "shuffled")
    sizes = hashed.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_start"))  # 4,096 rows
    own = F.row_number().over(W.partitionBy("_part").orderBy("_h", id_)) - 1
    return hashed.withColumn("_own", own).join(F.broadcast(starts), "_part").select(id_, (F.col("_start") + F.col("_own")).alias("position"))


def folds(entities: DataFrame, id_: str, n: int, seed: int = 42) -> DataFrame:
    """(id, fold): n folds whose sizes differ by one at most."""
    return shuffled_positions(entities, id_, seed).select(id_, (F.col("position") % n).cast("int").alias("fold"))


def split_sets(rows: DataFrame, user: str, is_oot: Column, n: int = 10, test: int = 3, seed: int = 42) -> DataFrame:
    """Adds sample_type: oot, or train and test by the user's fold; rows of a user that oot has as well are null."""
    late = rows.where(is_oot).select(user).distinct().withColumn("_late", F.lit(True))
    marked = rows.withColumn("_oot", is_oot).join(late, user, "left")
    early = marked.where(~F.col("_oot") & F.col("_late").isNull())
    fold = folds(early, user, n, seed)
    got = marked.join(fold, user, "left")
    kind = F.when(F.col("_oot"), "oot").when(F.col("_late"), None).when(F.col("fold") < test, "test").otherwise("train")
    return got.withColumn("sample_type", kind).drop("_oot", "_late", "fold")


def hashed_share(id_: Column, seed: int = 42) -> Column:
    """A number in [0, 100) that an id and a seed decide."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), id_.cast("string"))), 1, 8), 16, 10).cast("bigint") % 100


def pivot_metrics(df: DataFrame, group: list[str], pivot: str, values: list[str], metrics: dict[str, Column], swap: bool = False) -> DataFrame:
    """Long to wide with a column per pivot value and metric, named value_metric, or metric_value with levels swapped."""
    wide = df.groupBy(*group).pivot(pivot, values).agg(*[c.alias(k) for k, c in metrics.items()])
    names = [(v, m, f"{v}_{m}" if len(metrics) > 1 else v) for v in values for m in metrics]
    return wide.select(*group, *[F.col(f"`{n}`").alias(f"{m}_{v}" if swap else f"{v}_{m}") for v, m, n in names])


def suffixed_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """A join whose sides keep their columns of equal name under suffixes."""
    both = (set(left.columns) & set(right.columns)) - set(on)
    rename = lambda df, s: df.select(*[F.col(c).alias(c + s if c in both else c) for c in df.columns])
    return rename(left, suffixes[0]).join(rename(right, suffixes[1]), on, how)


def index_places(df: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    """Adds place: an index of a report in its order, descending if its least value has a letter, ascending otherwise. df has a row per index value."""
    w = W.partitionBy(*(by or []))
    lettered = F.coalesce(F.min(key).over(w).rlike(r"\p{L}"), F.lit(False))
    return df.withColumn("place", F.when(lettered, F.row_number().over(w.orderBy(F.desc(key)))).otherwise(F.row_number().over(w.orderBy(F.asc(key)))))
