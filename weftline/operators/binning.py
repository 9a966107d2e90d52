"""Bin edges as small tables (feature, edges), and the bin of a value under them.

A value's bin is the number of edges below it, or not above it when intervals
are closed on the left; the outer edges are infinite unless a rule says
otherwise. Quantiles use linear interpolation.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.prefix import n_below, running, with_totals
from weftline.sources.tables import kept

#: Positions of so many parts at most are found by arithmetic; others by looking at each.
PARTS = 1_000


def _may_hold(upto: Column, rows: Column, total: Column, parts: list[int]) -> Column:
    """Whether a value that ends at upto may hold a position i / n of the rows, n of parts. Says yes too often, by two rows at either end, never too seldom."""
    step = F.greatest(total - 1, F.lit(1))
    out = F.lit(False)
    for n in parts:
        out |= F.floor((upto + 2) * n / step) >= F.ceil((upto - rows - 2) * n / step)
    return out


def _parts(fractions: list[float]) -> list[int] | None:
    """Numbers of equal parts that the fractions are ends of."""
    found = {Fraction(f).limit_denominator(PARTS) for f in fractions}
    if any(min(abs(float(g) - f) for g in found) > 1e-12 for f in fractions):
        return None
    ns = {g.denominator for g in found}
    return sorted(n for n in ns if not any(m > n and m % n == 0 for m in ns))


def quantiles(long: DataFrame, fractions: list[float], by: list[str], value: str = "value", rows: str | None = None) -> DataFrame:
    """(by..., q): exact, linearly interpolated quantiles at the fractions.

    Positions are found in the running counts of the distinct values, so neither
    a column nor its distinct values are ever gathered in one task. ``rows``
    names a column with the number of rows that a row stands for.
    """
    n = F.count("*") if rows is None else F.sum(rows)
    counts = long.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(n.alias("_n"))
    run = running(with_totals(counts, {"_total": "_n"}, by), "_v", {"_upto": "_n"}, by)
    parts = _parts(fractions)
    if parts:
        run = run.where(_may_hold(F.col("_upto"), F.col("_n"), F.col("_total"), parts))
    at = F.transform(F.array(*[F.lit(f) for f in fractions]), lambda f, i: F.struct(i.alias("i"), ((F.col("_total") - 1) * f).alias("pos")))
    here = lambda k: (F.col("_upto") - F.col("_n") <= k) & (k < F.col("_upto"))
    hits = run.select(*by, "_v", "_upto", "_n", F.explode(F.filter(at, lambda p: here(F.floor(p.pos)) | here(F.ceil(p.pos)))).alias("p"))
    low, high = F.max(F.when(here(F.floor("p.pos")), F.col("_v"))), F.max(F.when(here(F.ceil("p.pos")), F.col("_v")))
    got = hits.groupBy(*by, F.col("p.i").alias("i"), F.col("p.pos").alias("pos")).agg(low.alias("low"), high.alias("high"))
    edge = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((F.ceil("pos") - F.col("pos")) * F.col("low") + (F.col("pos") - F.floor("pos")) * F.col("high"))
    return got.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", edge.alias("edge")))), lambda x: x.edge).alias("q"))


def quantile_edges(long: DataFrame, n: int, by: list[str] | None = None, value: str = "value", rows: str | None = None) -> DataFrame:
    """(by..., edges): the distinct quantiles at 0, 1/n, ..., 1."""
    by = by or ["feature"]
    return quantiles(long, [i / n for i in range(n + 1)], by, value, rows).select(*by, F.array_distinct("q").alias("edges"))


def quantile_edges_of(long: DataFrame, ns: list[int], by: list[str] | None = None, value: str = "value", rows: str | None = None) -> DataFrame:
    """(by..., n, edges): quantile_edges for several n, from one pass at the union of their fractions."""
    by = by or ["feature"]
    at = sorted({i / n for n in ns for i in range(n + 1)})
    place = {f: k for k, f in enumerate(at)}
    each = [F.struct(F.lit(n).alias("n"), F.array_distinct(F.array(*[F.col("q")[place[i / n]] for i in range(n + 1)])).alias("edges")) for n in ns]
    return quantiles(long, at, by, value, rows).select(*by, F.inline(F.array(*each)))


def counts_by_edges(per: DataFrame, edges: DataFrame, sums: list[str], most: int) -> DataFrame:
    """(feature, n, bin, sums) of counted values under the edges of every n; bin 0 holds missing values.

    A value is placed once among all edges of its feature, ``most`` at most. What lies
    between two neighbours is a cell, and bins are made of cells, so no row is made per
    value and n.
    """
    edges = kept(edges, "edges")
    cuts = kept(edges.groupBy("feature").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("edges")))).alias("cuts")), "cuts")
    placed = per.join(F.broadcast(cuts), "feature")  # a row per feature
    cell = F.when(F.col("value").isNotNull(), n_below(F.col("cuts"), F.col("value"), most))
    cells = placed.groupBy("feature", cell.alias("cell")).agg(*[F.sum(c).alias(c) for c in sums])
    low = F.when(F.col("cell") > 0, F.get("cuts", F.col("cell") - 1))
    cells = cells.join(F.broadcast(cuts), "feature").withColumn("low", low).drop("cuts").join(F.broadcast(edges), "feature")  # a row per feature and n
    below = F.greatest(F.size(F.filter("edges", lambda e: e <= F.col("low"))), F.lit(1))
    bin_ = F.when(F.col("cell").isNull(), F.lit(0)).otherwise(F.when(F.col("cell") > 0, below).otherwise(F.lit(1)))
    return cells.groupBy("feature", "n", bin_.alias("bin")).agg(*[F.sum(c).alias(c) for c in sums])


def opened(edges: Column) -> Column:
    """The outer edges become infinite."""
    return F.when(F.size(edges) >= 2, F.concat(F.array(F.lit(float("-inf"))), F.slice(edges, F.lit(2), F.size(edges) - 2), F.array(F.lit(float("inf"))))).otherwise(edges)


def library_edges(long: DataFrame, n: int, by: list[str] | None = None, value: str = "value") -> DataFrame:
    """(by..., edges, left_closed) by the library's ladder.

    More than two quantile edges: open ends, closed on the right. Exactly two:
    the values strictly between are cut again, in n - 2 parts, between the two
    edges and open ends. One, a constant: the constant between open ends, closed
    on the left.
    """
    by = by or ["feature"]
    first = quantile_edges(long, n, by, value)
    pairs = first.where(F.size("edges") == 2).select(*by, F.col("edges")[0].alias("lo"), F.col("edges")[1].alias("hi"))
    inside = long.join(F.broadcast(pairs), by).where((F.col(value) > F.col("lo")) & (F.col(value) < F.col("hi")))
    again = quantile_edges(inside, max(n - 2, 1), by, value).select(*by, F.col("edges").alias("inner_edges"))
    low, high = F.array(F.lit(float("-inf"))), F.array(F.lit(float("inf")))
    trimmed = F.slice("inner_edges", F.lit(2), F.greatest(F.size("inner_edges") - 2, F.lit(0)))
    middle = F.when(F.col("inner_edges").isNull(), F.col("edges")).otherwise(F.array_distinct(F.concat(F.slice("edges", 1, 1), trimmed, F.slice("edges", 2, 1))))
    return first.join(again, by, "left").select(
        *by,
        F.when(F.size("edges") > 2, opened(F.col("edges"))).when(F.size("edges") == 2, F.concat(low, middle, high)).otherwise(F.concat(low, F.col("edges"), high)).alias("edges"),
        (F.size("edges") < 2).alias("left_closed"),
    )


def floor_edge(edges: Column, least: Column) -> Column:
    """Where negatives are missing: the lowest edge is 0 if the next one isn't 0 and the minimum is positive, else just below 0."""
    return F.concat(F.array(F.when((edges[1] != 0) & (least > 0), F.lit(0.0)).otherwise(F.lit(-0.001))), F.slice(edges, F.lit(2), F.size(edges) - 1))


def bin_of(value: Column, edges: Column, left_closed: Column | bool = False) -> Column:
    """The interval's number from 1; null for a missing value or one outside."""
    if isinstance(left_closed, bool):
        left_closed = F.lit(left_closed)
    below = F.size(F.filter(edges, lambda e: F.when(left_closed, e <= value).otherwise(e < value)))
    return F.when(value.isNotNull() & (below > 0) & (below < F.size(edges)), below)


def bin_of_quantile(value: Column, edges: Column) -> Column:
    """As bin_of, closed on the right, with the least value in the first interval."""
    below = F.size(F.filter(edges, lambda e: e < value))
    return F.when(value.isNotNull(), F.greatest(below, F.lit(1)))


def equal_width(low: Column, high: Column, n: int, kind: str = "finite") -> Column:
    """n equal parts of [low, high]: with finite ends, ``open`` ends, or ``lowered``, the first edge 0.1 % of the range below."""
    edges = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: low + i * (high - low) / n)
    if kind == "open":
        return opened(edges)
    if kind == "lowered":
        return F.concat(F.array(low - (high - low) * 0.001), F.slice(edges, 2, n))
    return edges


def frequency_edges(counts: DataFrame, n: int, by: list[str] | None = None) -> DataFrame:
    """(by..., edges) from (by..., value, n_rows): the values at positions int(i * (rows - 1) / n) of the sorted column, unique.

    Fewer than n + 1 unique values: minus infinity comes before them; else it
    replaces the first. The last becomes infinite. No column is sorted row by
    row: positions are found in the running counts of its distinct values.
    """
    by = by or ["feature"]
    run = running(with_totals(counts, {"total": "n_rows"}, by), "value", {"upto": "n_rows"}, by)
    run = run.where(_may_hold(F.col("upto"), F.col("n_rows"), F.col("total"), [n]))
    at = run.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n)))).where((F.floor(F.col("i") * (F.col("total") - 1) / n) < F.col("upto")) & (F.floor(F.col("i") * (F.col("total") - 1) / n) >= F.col("upto") - F.col("n_rows")))
    unique = at.groupBy(*by).agg(F.array_sort(F.collect_set("value")).alias("u"))
    body = F.when(F.size("u") < n + 1, F.slice("u", F.lit(1), F.greatest(F.size("u") - 1, F.lit(0)))).otherwise(F.slice("u", F.lit(2), F.greatest(F.size("u") - 2, F.lit(0))))
    return unique.select(*by, F.concat(F.array(F.lit(float("-inf"))), body, F.array(F.lit(float("inf")))).alias("edges"))


def upper_edge(value: Column, edges: Column) -> Column:
    """The upper edge of a value's interval, closed on the right; -999 for a missing one, the last edge beyond it."""
    above = F.filter(edges, lambda e: e >= value)
    return F.when(value.isNull(), F.lit(-999.0)).otherwise(F.coalesce(F.get(above, F.lit(0)), F.element_at(edges, -1)))


def code_of(value: Column, codes: dict[str, int]) -> Column:
    """A category's code, 0 for one that is not known."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])[value], F.lit(0)) if codes else F.lit(0)


def _multiples(low: Column, high: Column, cut: Column) -> Column:
    """Multiples of cut above low and up to high."""
    first, last = F.floor(low / cut) + 1, F.floor(high / cut)
    return F.when(first <= last, F.transform(F.sequence(first, last), lambda k: k * cut)).otherwise(F.array().cast("array<double>"))


def score_edge_array(low: Column, high: Column, cut: float) -> Column:
    """Multiples of cut above low and up to high between infinite ends."""
    return F.concat(F.array(F.lit(float("-inf"))), _multiples(low, high, F.lit(cut)), F.array(F.lit(float("inf"))))


def adaptive_edge_array(low: Column, high: Column, cut: float, least: int = 5, most: int = 20) -> Column:
    """cut is halved while there are fewer than ``least`` edges and half of it isn't below 2, then doubled while there are more than ``most``; from 0 to infinity."""
    n = lambda c: F.floor(high / c) - F.floor(low / c)
    steps = 64
    halved = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(float(cut)), lambda c, _: F.when((n(c) < least) & (c / 2 >= 2), c / 2).otherwise(c))
    doubled = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), halved, lambda c, _: F.when(n(c) > most, c * 2).otherwise(c))
    return F.concat(F.array(F.lit(0.0)), F.filter(_multiples(low, high, doubled), lambda e: e > 0), F.array(F.lit(float("inf"))))


def weighted_edges(df: DataFrame, score: str, weight: str, n: int) -> DataFrame:
    """(band, edge): the greatest score of each n-th of the running weight, from sums per distinct score."""
    per = df.groupBy(score).agg(F.sum(weight).alias("w"))
    run = running(with_totals(per, {"total": "w"}), score, {"upto": "w"})
    band = F.least(F.ceil(F.col("upto") * n / F.col("total")), F.lit(n))
    return run.groupBy(band.cast("int").alias("band")).agg(F.max(score).alias("edge"))


def safe_edges(long: DataFrame, n: int, by: list[str] | None = None) -> DataFrame:
    """(by..., rung, edges): distinct values if there are few, else n quantiles, else n - 1, else a split at the median."""
    by = by or ["feature"]
    ks = sorted({n, max(n - 1, 1), 2})
    all_ = quantiles(long, [i / k for k in ks for i in range(k + 1)], by)
    begin = [1 + sum(k + 1 for k in ks[:j]) for j in range(len(ks))]
    got = long.where("value IS NOT NULL").groupBy(*by).agg(F.count_distinct("value").alias("u"))
    got = got.join(all_, by).withColumns({f"q{k}": F.slice("q", b, k + 1) for k, b in zip(ks, begin, strict=True)})
    whole = lambda c: F.size(F.array_distinct(c)) == F.size(c)
    a, b, m = F.col(f"q{n}"), F.col(f"q{max(n - 1, 1)}"), F.col("q2")
    rung = F.when(F.col("u") <= n, F.lit("identity")).when(whole(a), F.lit("n")).when(whole(b), F.lit("n-1")).otherwise(F.lit("median"))
    return got.select(*by, rung.alias("rung"), F.when(rung == "n", a).when(rung == "n-1", b).when(rung == "median", F.array_distinct(m)).alias("edges"))
