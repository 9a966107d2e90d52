"""Mixing sources to target weights by Pareto order sampling.

A document's copies are whole ones, which are certain, and one more that is
drawn. The words that a source still misses after the whole copies are shared
out by size: a document's inclusion probability is proportional to its words, at
most 1, and such that the expected words are those that are missing. Documents
of probability 1 are certain too. The draw ranks the others by random odds over
inclusion odds and takes them in this order until the words are there: the
sample's size is fixed in words. What the last document that fits leaves open
goes to the first later one of each size class, the largest class first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.runtime import checked_broadcast, kept, n_words

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (3, 1, 2)

#: The mix is this share of all words; no source gives more than CAP times its words.
SHARE, CAP = 1.5, 2

#: Slices of the order, for each factor of e in the odds: about one in 4 * SLICES documents of a source at most. They are added up, and only one is sorted.
SLICES = 1024

SEED = 20240607


def targets(sources: DataFrame, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Adds target to (source, source_size, weight): share of all sizes by weight, none above cap times its size.

    The sources that reach their cap are those with the least size for their
    weight. In that order, source k is capped exactly if what is left after the
    ones before it, dealt by weight, gives it more than its cap; the level is
    the first of these quotients that no longer does.
    """
    limit = F.col("source_size") * F.lit(float(cap))
    order = W.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("rank_of_source"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("source_size").over(W.partitionBy())
    level = (total * F.lit(share) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    found = sources.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= limit)
    settled = F.min(F.when(F.col("free"), F.struct(F.col("source_size") / F.col("weight"), F.col("rank_of_source"), F.col("level").alias("level")))).over(W.partitionBy())
    return found.withColumn("target", F.coalesce(F.least(limit, settled.level * F.col("weight")), limit)).drop("level", "free")


def _weights(position: Column, cycle: tuple[int, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (position % len(cycle) + 1).cast("int"))


def _draw_columns(docs: DataFrame, seed: int, key: str, text: str) -> DataFrame:
    """Adds mix_u, the uniform number of a document's random odds."""
    mark = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text), F.lit(""))))
    u = (F.conv(F.substring(mark, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return docs.withColumns({"mix_u": u})


def plan(sized: DataFrame, cycle: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, slices: int = SLICES) -> DataFrame:
    """One row per source: what decides, for any of its documents, how often it is taken.

    sized has doc_id, mix_u, size and source. The result has mix_source,
    source_size, target, certain, missing and scale (a document's probability is
    scale times its size), and where the draw stops: at odds up to cut_odds, and
    at the odds in ``filled``, one document for each size class at most.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("rank_of_source", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    wanted = targets(ranked.withColumn("weight", _weights(F.col("rank_of_source"), cycle)), share, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    wanted = wanted.withColumns({"certain": F.least(F.floor(ratio + 1e-9), F.lit(cap)).cast("long")}).withColumn("rest", F.greatest(ratio - F.col("certain"), F.lit(0.0)))
    wanted = wanted.withColumn("missing", F.when(F.col("rest") > 1e-12, F.col("rest") * F.col("source_size")))
    wanted = kept(wanted.withColumnRenamed("source", "mix_source").select("mix_source", "rank_of_source", "source_size", "target", "certain", "missing"), "mix-targets")
    wanted = kept(wanted.join(checked_broadcast(_scales(sized, wanted)), "rank_of_source", "left"), "mix-scales")
    placed = _place(sized, wanted, slices).where("odds IS NOT NULL")

    sums = placed.groupBy("rank_of_source", "slice").agg(F.sum("size").alias("words"), F.max("missing").alias("missing"))
    upto = W.partitionBy("rank_of_source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    cut = sums.withColumn("below", F.coalesce(F.sum("words").over(upto), F.lit(0))).where((F.col("below") <= F.col("missing")) & (F.col("below") + F.col("words") > F.col("missing")))
    cut = kept(cut.select(F.col("rank_of_source").alias("r"), F.col("slice").alias("cut_slice"), (F.col("missing") - F.col("below")).alias("left")), "mix-cuts")

    # rows that are alike share their odds and are taken together
    at_cut = placed.join(checked_broadcast(cut), (F.col("rank_of_source") == F.col("r")) & (F.col("slice") == F.col("cut_slice")))
    at_cut = at_cut.groupBy("r", "left", "odds").agg(F.sum("size").alias("words"))
    running = F.sum("words").over(W.partitionBy("r").orderBy("odds").rowsBetween(W.unboundedPreceding, 0))
    reached = at_cut.withColumn("running", running).where(F.col("running") <= F.col("left")).groupBy("r").agg(F.max("odds").alias("cut_odds"), F.max("running").alias("got"))
    gaps = kept(cut.join(reached, "r", "left").select("r", "cut_slice", F.coalesce("cut_odds", F.lit(-1.0)).alias("cut_odds"), (F.col("left") - F.coalesce("got", F.lit(0))).alias("gap")), "mix-gaps")

    later = placed.join(checked_broadcast(gaps), F.col("rank_of_source") == F.col("r")).where((F.col("slice") >= F.col("cut_slice")) & (F.col("odds") > F.col("cut_odds")))
    first = kept(later.where(F.col("size") <= F.col("gap")).groupBy("r", "gap", F.length(F.bin("size")).alias("class")).agg(F.min("odds").alias("first_odds")), "mix-first")
    alike = placed.join(checked_broadcast(first), (F.col("rank_of_source") == F.col("r")) & (F.col("odds") == F.col("first_odds"))).groupBy("r", "gap", "class", "odds").agg(F.sum("size").cast("double").alias("words"))
    start = F.struct(F.col("gap"), F.array().cast("array<double>").alias("filled"))
    fits = lambda got, c: F.when(c.words <= got.gap, F.struct((got.gap - c.words).alias("gap"), F.array_append(got.filled, c.odds).alias("filled"))).otherwise(got)
    tried = alike.groupBy("r", "gap").agg(F.sort_array(F.collect_list(F.struct("class", "odds", "words")), asc=False).alias("tried"))  # a row per class
    fills = tried.select("r", F.aggregate("tried", start, fits).filled.alias("filled"))
    stops = gaps.join(fills, "r", "left").select("r", "cut_slice", "cut_odds", F.coalesce("filled", F.array().cast("array<double>")).alias("filled"))
    return kept(wanted.join(stops, F.col("rank_of_source") == F.col("r"), "left").drop("r"), "mix-plan")


def _scales(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rank_of_source, scale): the sum of least(1, scale * size) * size over a source's documents is what it misses.

    Documents above a size have probability 1. From the largest size down, that
    size is the first for which the rest, dealt by size, gives no probability
    above 1. Only the distinct sizes of a source are ordered; sums are exact.
    """
    per = sized.where("size > 0").join(checked_broadcast(wanted.where("missing IS NOT NULL")), F.col("source").eqNullSafe(F.col("mix_source"))).groupBy("rank_of_source", "missing", "size").agg(F.count("*").alias("n"))
    words, squares = F.col("n") * F.col("size"), F.col("n").cast("decimal(38,0)") * F.col("size") * F.col("size")
    by = W.partitionBy("rank_of_source").orderBy("size")
    per = per.withColumns({"above": F.coalesce(F.sum(words).over(by.rowsBetween(1, W.unboundedFollowing)), F.lit(0)), "below": F.sum(squares).over(by.rowsBetween(W.unboundedPreceding, 0)).cast("double")})
    per = per.withColumn("scale", (F.col("missing") - F.col("above")) / F.col("below"))
    fair = per.where(F.col("scale") * F.col("size") <= 1.0)
    return kept(fair.groupBy("rank_of_source").agg(F.max_by("scale", "size").alias("scale")), "mix-scale")


def _place(sized: DataFrame, per_source: DataFrame, slices: int) -> DataFrame:
    """Joins the sources' numbers and adds odds, random odds over inclusion odds, and their slice; null where nothing is drawn."""
    joined = sized.join(checked_broadcast(per_source), F.col("source").eqNullSafe(F.col("mix_source")), "left")
    chance = F.col("scale") * F.col("size")
    odds = F.when(chance >= 1, 0.0).otherwise((F.col("mix_u") / (1 - F.col("mix_u"))) * ((1 - chance) / chance))
    drawn = joined.withColumn("odds", F.when(F.col("missing").isNotNull() & (F.col("size") > 0), odds))
    return drawn.withColumn("slice", F.when(F.col("odds") > 0, F.floor(F.ln("odds") * slices).cast("int")).when(F.col("odds") == 0, F.lit(-(1 << 30))))


def _copies(placed: DataFrame) -> DataFrame:
    drawn = F.col("cut_slice").isNull() | (F.col("odds") <= F.col("cut_odds")) | (F.col("slice") < F.col("cut_slice")) | F.array_contains("filled", F.col("odds"))
    return placed.withColumn("copies", F.col("certain") + F.when(F.col("odds").isNotNull() & drawn, 1).otherwise(0))


def sizes(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size and the numbers of the draw, written once: the text is read here and nowhere else."""
    drawn = _draw_columns(docs.select("doc_id", "text", "source"), seed, "doc_id", "text")
    return kept(drawn.select("doc_id", "source", n_words(F.col("text")).alias("size"), "mix_u"), "mix-sizes")


def mix(docs: DataFrame, cycle: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = SEED, slices: int = SLICES) -> DataFrame:
    """One row per row of docs: doc_id, size, source, source_size, target, copies, taken.

    size counts words, and a null text has none; a null source is a source of
    its own, the last in order. A document is taken whole, floor(target /
    source_size) times for certain and once more if it is drawn, with a
    probability proportional to its words; documents without words are never
    drawn. Very long texts count with all their words, so one may be certain.
    Draws depend on the seed, the key and the text alone, so reruns agree; rows
    that are alike in these are drawn together, also where the draw stops. Other
    columns are ignored. An empty table gives an empty result.
    """
    sized = sizes(docs, seed)
    done = _copies(_place(sized, plan(sized, cycle, share, cap, slices), slices))
    return done.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take(docs: DataFrame, cycle: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = SEED, slices: int = SLICES) -> DataFrame:
    """The mixed documents: each row of docs as often as the mix takes it, with docs' columns. Texts are not shuffled."""
    per_source = plan(sizes(docs, seed), cycle, share, cap, slices)
    work = _draw_columns(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text", "source"), seed, "doc_id", "text").withColumn("size", n_words(F.col("text"))).drop("text")
    done = _copies(_place(work, per_source, slices)).where(F.col("copies") > 0)
    return done.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
