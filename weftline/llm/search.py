"""Ranked lexical search by three rounds over term-partitioned postings (TPUT).

Documents are read once, in slices of bounded size; a slice gives one segment for
each of its terms. Segments become postings in the order of falling impact, spread
by term. A search then takes three rounds:

1. the heads of all lists give partial sums, and the k-th highest sum of an item
   is a lower bound of what its k-th document scores;
2. every list sends the entries that reach the bound divided by the number of the
   item's lists; a document that no list sent can't reach the bound. Sums of a
   heap of slices meet in one task, a few candidates for each item leave it;
3. candidates that can still reach the best lower bound get their exact scores.

No document that could be among the k best is dropped, whatever the lists hold.

Rows are documents and items of their own: ids may repeat or be null (null last
among equal scores). Null and empty texts have no terms and are in no result; an
item without a term that some document has gets no row. Equal scores are ordered by
doc_id. Other columns are ignored, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.runtime import checked_broadcast, kept, small_batches

#: Documents that an item gets.
TOP = 20

#: A slice is closed when it holds so many postings or documents; so much is in a worker's memory at once.
SLICE_POSTINGS, SLICE_DOCUMENTS = 1 << 20, 1 << 15

#: Postings that are scored in one task, or those of one slice.
HEAP_POSTINGS = 1 << 18

#: Up to so many distinct terms of all items, only these are indexed; beyond, all terms are.
VOCABULARY = 1_000_000

#: Terms of items, repeats not counted, that are scored in one pass over the postings; more items take more passes.
ASKS_AT_ONCE = 200_000

#: Slices whose segments of one term stay together, so that a very frequent term is spread.
SLICES_TOGETHER = 64

#: Saturation of term counts and share of the length in it, in hundredths: values that the score is defined with.
SCALE, SHARE = 1_000_000_000, 25

#: Maximal runs of what is no ASCII but letters and digits, in UTF-8 with A-Z lower-cased.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")

SEGMENTS = "slice bigint, term string, docs array<int>, tfs array<int>, lengths array<int>, n_docs bigint, n_terms bigint, ids array<{}>"


def terms(text: bytes) -> list[bytes]:
    """A text's terms in order; only A-Z are lower-cased."""
    return TERM.findall(text.lower())


class _Numbers(dict):
    """Numbers keys as they come."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values))


class _Slice:
    """Documents that wait to be turned into segments."""

    def __init__(self, number: int, numbers: dict) -> None:
        self.number, self.numbers = number, numbers
        self.ids: list[pa.Array] = []
        self.lengths: list[int] = []
        self.found: list[int] = []
        self.counts: list[int] = []
        self.sizes: list[int] = []

    def add(self, text: bytes | None) -> None:
        words = terms(text) if text else []
        counted = Counter(map(self.numbers.__getitem__ if isinstance(self.numbers, _Numbers) else self.numbers.get, words))
        counted.pop(None, None)
        self.lengths.append(len(words))
        self.found.extend(counted.keys())
        self.counts.extend(counted.values())
        self.sizes.append(len(counted))

    def full(self) -> bool:
        return len(self.found) >= SLICE_POSTINGS or len(self.lengths) >= SLICE_DOCUMENTS

    def segments(self, spelled: pa.Array) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in SEGMENTS.split(", ")]
        term, lengths = np.array(self.found, dtype=np.int64), np.array(self.lengths, dtype=np.int64)
        doc = np.repeat(np.arange(len(lengths), dtype=np.int32), self.sizes)
        order = np.argsort(term, kind="stable")
        term, doc, tf = term[order], doc[order], np.array(self.counts, dtype=np.int32)[order]
        first = np.flatnonzero(np.diff(term, prepend=-1)) if len(term) else np.zeros(0, dtype=np.int64)
        starts = np.append(first, len(term))
        ids = pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), pa.concat_arrays(self.ids))
        none = pa.nulls(1, pa.list_(pa.int32()))
        yield pa.record_batch([pa.array([self.number]), pa.nulls(1, pa.string()), none, none, none, pa.array([int((lengths > 0).sum())]), pa.array([int(lengths.sum())]), ids], names=names)
        if not len(term):
            return
        n = len(first)
        of = lengths[doc].astype(np.int32)
        yield pa.record_batch(
            [pa.array(np.full(n, self.number)), spelled.take(pa.array(term[first])), _lists(doc, starts), _lists(tf, starts), _lists(of, starts), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, ids.type)],
            names=names,
        )


def segments(docs: DataFrame, vocabulary: list[str] | None) -> DataFrame:
    """A row for each term of a slice, of the vocabulary or of all terms, and one (term null) for the slice's documents. docs: doc_id, text."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType.fromDDL(SEGMENTS.format(kind.simpleString()))
    known = None if vocabulary is None else {t.encode(): i for i, t in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = None, 0
        fixed = pa.array(vocabulary or [], pa.string())

        def close(s: _Slice) -> Iterator[pa.RecordBatch]:
            yield from s.segments(pa.array([t.decode() for t in s.numbers], pa.string()) if known is None else fixed)

        for batch in batches:
            part, ids, texts = batch.column(0), batch.column(1), batch.column(2).cast(pa.binary())
            begun = 0
            for i, text in enumerate(texts.to_pylist()):
                if held is None:
                    held, begun = _Slice((part[0].as_py() << 32) + n, _Numbers() if known is None else known), i
                    n += 1
                held.add(text)
                if held.full():
                    held.ids.append(ids.slice(begun, i + 1 - begun))
                    yield from close(held)
                    held = None
            if held is not None:
                held.ids.append(ids.slice(begun))
        if held is not None:
            yield from close(held)

    return docs.select(F.spark_partition_id().cast("bigint").alias("part"), "doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _asked(items: DataFrame) -> DataFrame:
    """(item, item_id, term, q): the terms of each item and how often it has them."""
    kind = items.schema["item_id"].dataType
    schema = T.StructType.fromDDL(f"item bigint, item_id {kind.simpleString()}, term string, q bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                if counted := Counter(terms(text or b"")):
                    at = pa.array([i] * len(counted))
                    yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array([t.decode() for t in counted]), pa.array(list(counted.values()), pa.int64())], names=["item", "item_id", "term", "q"])

    return items.select(F.monotonically_increasing_id().alias("item"), "item_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _postings(found: DataFrame, weights: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """(term, slice, docs, impacts): segments of the wanted terms by falling impact; an impact doesn't hold the term's weight."""
    wanted = found.where(F.col("term").isNotNull()).join(checked_broadcast(weights.select("term")), "term", "left_semi")
    spread = wanted.select("slice", "term", "docs", "tfs", "lengths").repartition("term", F.floor(F.col("slice") / SLICES_TOGETHER))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, tf, length = (batch.column(i).flatten().to_numpy().astype(np.int64) for i in (2, 3, 4))
            sizes = batch.column(2).value_lengths().to_numpy()
            starts = np.append(0, np.cumsum(sizes))
            m = 100 - SHARE + (SHARE * length * n_docs) // n_terms
            impact = (SCALE * tf) // (1000 * tf + 12 * m)
            order = np.lexsort((docs, -impact, np.repeat(np.arange(len(sizes)), sizes)))
            yield pa.record_batch([batch.column(1), batch.column(0), _lists(docs[order].astype(np.int32), starts), _lists(impact[order].astype(np.int32), starts)], names=["term", "slice", "docs", "impacts"])

    return spread.mapInArrow(run, "term string, slice bigint, docs array<int>, impacts array<int>")


def _first(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "place") -> DataFrame:
    """The k first rows of each group, numbered; each map task sends k rows of a group at most."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def _kth(df: DataFrame, k: int, name: str) -> DataFrame:
    """(item, name): the k-th highest partial sum of each item that has so many."""
    return _first(df, ["item"], [F.desc("partial")], k).where(F.col("place") == k).select("item", F.col("partial").alias(name))


def _scored(postings: DataFrame, asks: list, k: int, heaps: int) -> DataFrame:
    """(item, slice, doc, partial, seen): round two for one block of items, without documents of a heap that can't be among the k best.

    Slices meet in as many heaps as there are HEAP_POSTINGS postings, so that small
    slices, as small files give them, don't each send k documents on.
    """
    least: dict[str, int] = {}
    for a in asks:
        least[a.term] = min(least.get(a.term, a.need), a.need)
    by_item: dict[int, list] = {}
    for a in asks:
        by_item.setdefault(a.item, []).append((a.term, a.q * a.w, a.need, a.m, a.tau))
    spark = postings.sparkSession
    sizes = spark.createDataFrame(list(least.items()), "term string, least bigint")
    sent = postings.join(F.broadcast(sizes), "term").withColumn("n", F.size(F.filter("impacts", lambda x: x >= F.col("least")))).where("n > 0")
    sent = sent.select(F.pmod(F.xxhash64(F.lit(41), "slice"), F.lit(heaps)).alias("heap"), "slice", "term", F.slice("docs", 1, F.col("n")).alias("docs"), F.slice("impacts", 1, F.col("n")).alias("impacts"))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        slices, of_row = np.unique(table.column("slice").to_numpy(), return_inverse=True)
        lists, names = table.column("docs").chunk(0), table.column("term").dictionary_encode().combine_chunks()
        sizes = lists.value_lengths().to_numpy()
        of_entry = np.repeat(of_row, sizes)
        docs, impacts = lists.flatten().to_numpy().astype(np.int64), table.column("impacts").chunk(0).flatten().to_numpy().astype(np.int64)
        most = np.zeros(len(slices), dtype=np.int64)
        np.maximum.at(most, of_entry, docs + 1)
        starts = np.append(0, np.cumsum(most))  # a slice's documents follow each other
        code = np.repeat(names.indices.to_numpy(), sizes)
        order = np.argsort(code, kind="stable")
        docs, impacts = (docs + starts[of_entry])[order], impacts[order]
        ends = np.searchsorted(code[order], np.arange(len(names.dictionary) + 1))
        at = {t: i for i, t in enumerate(names.dictionary.to_pylist())}
        n = int(starts[-1])
        out = []
        for item, own in by_item.items():
            sums, seen = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
            for term, weight, need, m, tau in own:  # noqa: B007  m and tau are the item's
                if (i := at.get(term)) is None:
                    continue
                mine, here = impacts[ends[i] : ends[i + 1]], docs[ends[i] : ends[i + 1]]
                if len(low := np.flatnonzero(mine < need)):
                    mine, here = np.delete(mine, low), np.delete(here, low)
                sums[here] += weight * mine
                seen[here] += 1
            some = np.flatnonzero(seen)
            if not len(some):
                continue
            partial, hits = sums[some], seen[some]
            bound = max(tau, int(np.partition(partial, -k)[-k])) if len(some) >= k else tau
            left = partial * m + (m - hits) * tau >= bound * m
            out.append((np.full(int(left.sum()), item), some[left], partial[left], hits[left]))
        item, doc, partial, hits = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, dtype=np.int64) for i in range(4))
        where = np.searchsorted(starts, doc, side="right") - 1
        return pa.table({"item": pa.array(item, pa.int64()), "slice": pa.array(slices[where]), "doc": pa.array(doc - starts[where], pa.int32()), "partial": pa.array(partial, pa.int64()), "seen": pa.array(hits, pa.int32())})

    return sent.groupBy("heap").applyInArrow(run, "item bigint, slice bigint, doc int, partial bigint, seen int")


def rank(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item with a score above 0. docs: doc_id, text; items: item_id, text."""
    spark = docs.sparkSession
    small_batches(spark)
    asked = kept(_asked(items), "search-asked")
    vocabulary = [r.term for r in asked.select("term").distinct().limit(VOCABULARY + 1).collect()]
    found = kept(segments(docs, sorted(vocabulary) if len(vocabulary) <= VOCABULARY else None), "search-segments")
    n_docs, n_terms = found.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()

    df = found.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum(F.size("docs").cast("bigint")).alias("df"))
    w = F.floor(1000 * F.ln(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("bigint")
    weights = df.select("term", w.alias("w")).where("w > 0")
    lists = kept(asked.join(weights, "term").withColumn("m", F.count("*").over(W.partitionBy("item"))), "search-lists")
    postings = kept(_postings(found, lists.select("term").distinct(), n_docs, max(n_terms, 1)), "search-postings")

    heads = postings.select("term", "slice", F.inline(F.arrays_zip(F.slice("docs", 1, k).alias("doc"), F.slice("impacts", 1, k).alias("impact"))))
    heads = _first(heads, ["term"], [F.desc("impact"), F.asc("slice"), F.asc("doc")], k)
    sums = heads.join(lists, "term").groupBy("item", "slice", "doc").agg(F.sum(F.col("q") * F.col("w") * F.col("impact")).alias("partial"))
    asks = lists.join(_kth(sums, k, "tau"), "item", "left").withColumn("tau", F.coalesce("tau", F.lit(0)))
    asks = kept(asks.withColumn("need", F.expr("(tau + m * q * w - 1) div (m * q * w)")), "search-asks")

    blocks = max(1, -(-asks.count() // ASKS_AT_ONCE))
    heaps = max(1, -(-(postings.agg(F.sum(F.size("docs").cast("bigint"))).first()[0] or 0) // HEAP_POSTINGS))
    best = None
    for b in range(blocks):
        own = asks.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        rows = own.collect()  # ASKS_AT_ONCE rows or about
        if not rows:
            continue
        near = kept(_scored(postings, rows, k, heaps), "search-near")
        bounds = own.select("item", "m", "tau").distinct().join(_kth(near, k, "low"), "item", "left")
        bounds = bounds.select("item", "m", "tau", F.greatest("tau", F.coalesce("low", F.lit(0))).alias("low"))
        left = near.join(bounds, "item").where(F.col("partial") * F.col("m") + (F.col("m") - F.col("seen")) * F.col("tau") >= F.col("low") * F.col("m"))
        left = kept(left.select("item", "slice", "doc"), "search-left")
        # each candidate's places in its item's lists
        looked = left.join(own.select("item", "term", (F.col("q") * F.col("w")).alias("v")), "item")
        at = F.array_position("docs", F.col("doc")).cast("int")
        exact = postings.join(looked, ["term", "slice"]).withColumn("at", at).where("at > 0")
        exact = exact.groupBy("item", "slice", "doc").agg(F.sum(F.col("v") * F.element_at("impacts", F.col("at"))).alias("score")).where("score > 0")
        best = exact if best is None else best.unionByName(exact)
    if best is None:
        kinds = f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score bigint"
        return spark.createDataFrame([], kinds)
    ids = found.where(F.col("term").isNull()).select("slice", "ids")
    named = kept(best, "search-exact").join(ids, "slice").withColumn("doc_id", F.element_at("ids", F.col("doc") + 1)).drop("ids")
    placed = _first(named, ["item"], [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("slice"), F.asc("doc")], k, "rank")
    return placed.join(checked_broadcast(lists.select("item", "item_id").distinct()), "item").select("item_id", "rank", "doc_id", "score")
