"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

Rotations are learned that make balanced binary codes. A code is cut into
chunks, and two vectors meet wherever two chunks of one rotation's code are the
same; what meets is ranked again with the original vectors, in bounded blocks of
a table's bucket. Equal
vectors are one row with a weight from the start, and a block gives counts and
a spanning forest, never a list of all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import blocks
from weftline.llm.components import components
from weftline.llm.runtime import checked_broadcast, kept, small_batches

#: Vectors that the rotation is learned on at most, in the order of a hash of label and vector; rounds of learning.
SAMPLE_ROWS, ROUNDS = 20_000, 40

#: Bits of a code; bits of its chunks at least and at most.
BITS, LEAST_CHUNK, MOST_CHUNK = 64, 8, 16

#: Chunks that a table takes together. One chunk would give fuller buckets, three would miss more.
JOINT = 2

#: Vectors of a label that a place of a table has on average, or fewer, as long as chunks may grow for it.
CROWD = 16

#: Share of the pairs at LEAST_COSINE that the rotations are to find, by the formula for codes of random turns; codes that were learned find more.
RECALL = 0.96

LEAST_COSINE = 0.93

#: Rows of a block; two meet at a time, as one product of matrices. A member of a bucket goes to one block for each so many members.
BLOCK = 512


def chunk_bits(n: Column) -> Column:
    """Bits of a chunk for a label with n vectors: two chunks make a table of about n / CROWD places."""
    return F.greatest(F.lit(LEAST_CHUNK), F.least(F.lit(MOST_CHUNK), F.ceil(F.log2(n / F.lit(CROWD)) / JOINT))).cast("int")


def rotations_for(bits: int, joint: int = JOINT, cosine: float = LEAST_COSINE, recall: float = RECALL) -> int:
    """Rotations that together find so many of the pairs at a cosine, if a table asks for ``joint`` equal chunks of so many bits."""
    chunks = BITS // bits
    p = (1 - np.arccos(cosine) / np.pi) ** bits
    found = 1 - sum(comb(chunks, k) * p**k * (1 - p) ** (chunks - k) for k in range(joint))
    return max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - found)))) if joint else 1


@cache
def tables_of(bits: int, joint: int, rotations: int) -> list[tuple[int, ...]]:
    """The chunks that each table takes together; chunk c of rotation r has the number r * chunks + c."""
    chunks = BITS // bits
    return [tuple(r * chunks + c for c in t) for r in range(rotations if joint else 1) for t in combinations(range(chunks), joint)]


def learn_rotation(x: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) whose signs are the codes: principal directions turned so that the signs lose least."""
    rng = np.random.default_rng(seed)
    dim = x.shape[1]
    mean = x.mean(axis=0) if len(x) else np.zeros(dim)
    centred = x - mean
    _, vectors = np.linalg.eigh(centred.T @ centred + 1e-12 * np.eye(dim))
    basis = vectors[:, ::-1][:, : min(bits, dim)]
    if basis.shape[1] < bits:  # more bits than directions: turned copies of them
        basis = np.concatenate([basis @ np.linalg.qr(rng.normal(size=(basis.shape[1],) * 2))[0] if k else basis for k in range(-(-bits // dim))], axis=1)[:, :bits]
    v = centred @ basis
    turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    for _ in range(rounds if len(x) else 0):
        signs = np.where(v @ turn >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(signs.T @ v)
        turn = (left @ right).T
    return mean, basis @ turn


def codes(x: np.ndarray, mean: np.ndarray, projection: np.ndarray, bits: int = LEAST_CHUNK) -> np.ndarray:
    """A code per row, as numbers of so many bits. Vectors of another length than the learned one are cut or filled for it."""
    if x.shape[1] != len(mean):
        fitted = np.zeros((len(x), len(mean)))
        fitted[:, : min(x.shape[1], len(mean))] = x[:, : len(mean)]
        x = fitted
    signs = ((x - mean) @ projection >= 0)[:, : BITS // bits * bits].reshape(len(x), -1, bits)
    return (signs @ (1 << np.arange(bits)[::-1])).astype(np.uint8 if bits <= 8 else np.uint16)


def _is_sound() -> Column:
    """May be linked: has a label, and a vector that is finite and not all zero."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.col("label").isNotNull() & v.isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def near_vectors(rows: DataFrame, least_cosine: float = LEAST_COSINE, sample_rows: int = SAMPLE_ROWS, joint: int = JOINT, rotations: int | None = None, chunk: int | None = None) -> DataFrame:
    """One row per row of rows (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Only vectors of equal label and length are compared. Null labels, and
    vectors that are null, empty, zero or not finite, link with nothing. Rows
    that are alike in label and vector link with each other. A vec_id may repeat
    or be null: links are between rows, and the least vec_id names a component,
    null if it has none. Long vectors are compared whole. Other columns are
    ignored. An empty table gives an empty result. A table of the index takes
    ``joint`` chunks of a code together; there are tables for each of
    ``rotations``. Chunks are as wide as the label has vectors (chunk_bits), so that
    a place holds a few of them however many there are, and wider chunks take more
    rotations (rotations_for), unless ``chunk`` and ``rotations`` say otherwise.
    With ``joint`` 0 the one table has all vectors of a label: the result is exact,
    for the work of comparing all of them.
    """
    spark = rows.sparkSession
    small_batches(spark)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    sound = kept(rows.where(_is_sound()).withColumn("same", F.xxhash64("label", "embedding")).withColumn("same2", F.xxhash64(F.lit(1), "embedding", "label")), "vec-sound")
    unique = kept(sound.groupBy("same", "same2").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.any_value("label").alias("label"), F.any_value("embedding").alias("embedding")).withColumn("id", F.monotonically_increasing_id()), "vec-unique")
    some = unique.select("same", "same2", "embedding").orderBy("same", "same2").limit(sample_rows).toPandas()["embedding"]  # bounded by sample_rows
    if not len(some):
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    usual = some.map(len).mode().iloc[0]
    x = np.array([v for v in some if len(v) == usual], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    widths = unique.groupBy("label").agg(F.count("*").alias("of_label")).select("label", (F.lit(chunk).cast("int") if chunk else chunk_bits(F.col("of_label"))).alias("bits"))
    widths = kept(widths, "vec-widths")
    turns = {r.bits: rotations or rotations_for(r.bits, joint) for r in widths.select("bits").distinct().collect()}  # MOST_CHUNK rows at most
    learned = [learn_rotation(x, seed=7 + r) for r in range(max(turns.values()))]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = batch.to_pandas()
            for (dim, bits), part in table.groupby([table["embedding"].map(len), table["bits"]]):
                v = np.array(part["embedding"].tolist(), dtype=float)
                scale = np.abs(v).max(axis=1, keepdims=True)
                v = v / scale
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                code = np.concatenate([codes(v, *how, bits) for how in learned[: turns[bits]]], axis=1)
                tables = tables_of(bits, joint, turns[bits])
                n_tables = len(tables)
                places = np.zeros((len(v), n_tables), dtype=np.int64)
                for c in range(joint):
                    places = places << bits | code[:, [t[c] for t in tables]].astype(np.int64)
                places += np.arange(n_tables) << 32
                yield pa.RecordBatch.from_pandas(
                    pd.DataFrame(
                        {
                            "id": part["id"].to_numpy(),
                            "weight": part["weight"].to_numpy(),
                            "label": part["label"].to_numpy(),
                            "code": [c.tobytes() for c in code.astype("<u2")],
                            "vector": [u.tobytes() for u in v],
                            "places": list(places + (int(dim) << 42) + (int(bits) << 58)),
                        }
                    ),
                    preserve_index=False,
                )

    schema = "id bigint, weight bigint, label string, code binary, vector binary, places array<bigint>"
    sized = unique.select("id", "weight", "label", "embedding").join(checked_broadcast(widths), "label").select("id", "weight", "label", "embedding", "bits")
    units = kept(sized.mapInArrow(index, schema), "vec-units")
    # the tables hold ids only; vectors come to those that meet somebody
    entries = units.select("id", "label", F.explode("places").alias("place")).select("id", "place", F.xxhash64("label", "place").alias("bucket"))
    sizes = kept(entries.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1"), "vec-buckets")
    open_ = entries.join(sizes, "bucket")
    own = blocks.block(F.col("id"), F.col("m"), BLOCK)
    n_blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    pair = F.explode(F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j"))))
    dealt = open_.withColumn("own", own).withColumn("ij", pair).select("bucket", F.col("ij.i").alias("i"), F.col("ij.j").alias("j"), "own", "place", "id")
    dealt = dealt.join(units.drop("places"), "id").select("bucket", "i", "j", "own", "label", "place", "id", "weight", "code", "vector")
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = blocks.together(dealt, ["bucket", "i", "j"], n_parts).mapInArrow(_ranker(least_cosine, joint, turns), "id bigint, links bigint, other bigint")
    found = kept(found, "vec-links")

    links = found.where("links > 0").groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")))
    per = unique.select("same", "same2", "id", "least", "weight").join(links, "id", "left").join(groups, "id", "left")
    per = kept(per.select("same", "same2", "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")), "vec-classes")
    per = per.join(per.groupBy("component").agg(F.min("least").alias("component_id")), "component").drop("least", "component")
    linked = sound.select("vec_id", "same", "same2").join(per, ["same", "same2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~_is_sound())
    alone = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    done = linked.union(alone)
    return done.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _ranker(least_cosine: float, joint: int, turns: dict[int, int]):
    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links between two blocks of a bucket, those left out that an earlier table has already: weights by vector, and a forest."""
        for run in blocks.runs(batches, 3):
            own = run.column("own").to_numpy()
            i, j = run.column("i")[0].as_py(), run.column("j")[0].as_py()
            a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
            if not len(a) or not len(b) or len(own) < 2:
                continue
            label, place = np.array(run.column("label").to_pylist(), dtype=object), run.column("place").to_numpy()
            ids, weight = run.column("id").to_numpy(), run.column("weight").to_numpy()
            if any(len(set(map(len, run.column(c).to_pylist()))) > 1 for c in ("vector", "code")):
                continue  # two lengths under one bucket hash: their places differ, and nothing of them is equal
            vector, code = blocks.matrix(run.column("vector"), "<f8"), blocks.matrix(run.column("code"), "<u2")
            bits = int(place[0] >> 58)
            tables = tables_of(bits, joint, turns[bits])
            near = vector[a] @ vector[b].T >= least_cosine
            near &= (label[a][:, None] == label[b][None, :]) & (place[a][:, None] == place[b][None, :])
            alike = [code[a][:, None, c] == code[b][None, :, c] for c in range(code.shape[1])]
            for t in tables[: int(place[0] >> 32) & 0x3FF]:
                near &= ~np.logical_and.reduce([alike[c] for c in t])
            if i == j:
                near &= ids[a][:, None] < ids[b][None, :]
            x, y = np.nonzero(near)
            if not len(x):
                continue
            x, y = a[x], b[y]
            count = np.bincount(x, weight[y], len(ids)) + np.bincount(y, weight[x], len(ids))
            hit = np.flatnonzero(count)
            v, root = blocks.forest(len(ids), x, y)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[ids[hit], ids[v]]), pa.array(np.r_[count[hit].astype(np.int64), np.zeros(len(v), np.int64)]), pa.array([None] * len(hit) + ids[root].tolist(), pa.int64())], names=["id", "links", "other"]
            )

    return rank
