"""Groups of any size as pairs of bounded blocks, worked through in runs of sorted rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def block(id_: Column, rows: Column, size: int) -> Column:
    """Which of ceil(rows / size) blocks of its group a row belongs to."""
    return F.pmod(F.xxhash64(F.lit(29), id_), F.ceil(rows / F.lit(size))).cast("int")


def all_blocks(rows: Column, size: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(rows / F.lit(size)).cast("int") - 1, F.lit(0))))


def together(df: DataFrame, keys: list[str], n_partitions: int) -> DataFrame:
    """Rows of equal keys become neighbours in one partition."""
    return df.repartition(n_partitions, *keys).sortWithinPartitions(*keys)


def runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Neighbouring rows whose first n_keys columns are equal, across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)]
        change = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        cuts = [*np.flatnonzero(change).tolist(), batch.num_rows]
        start = 0
        for cut in cuts:
            part = batch.slice(start, cut - start)
            head = tuple(k[start] for k in keys)
            if held and head != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
            last = head
            start = cut
    if held:
        yield pa.Table.from_batches(held)


def matrix(column: pa.ChunkedArray, dtype: str) -> np.ndarray:
    """A column of byte strings of one length as rows of numbers."""
    n = len(column)
    flat = np.frombuffer(b"".join(column.to_pylist()), dtype=dtype)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the vertices 0 to n - 1 as the edges (i, j) do, one from each vertex to the first of its component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    v = np.flatnonzero(label != np.arange(n))
    return v, label[v]
