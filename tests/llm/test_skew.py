"""One centre, one label and one key with most of the rows: right results, and no part beyond its bound."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import minhash, queries_models, sharding, vectors


def test_a_famous_centre_is_dealt_into_parts(spark, monkeypatch):
    """A text that many others are one word away from: a star whose centre is in nearly all pairs."""
    monkeypatch.setattr(minhash, "CENTRE_PAIRS", 8)
    rng = random.Random(5)
    base = [f"w{rng.randrange(900)}" for _ in range(60)]
    texts = {0: " ".join(base)}
    for i in range(1, 80):
        words = list(base)
        words[rng.randrange(58)] = f"x{i}"
        texts[i] = " ".join(words)
    for i in range(80, 120):
        texts[i] = " ".join(f"y{rng.randrange(5000)}" for _ in range(40))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} for i, t in texts.items()}
    group = {i: i for i in texts}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                group[b] = a
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert got == {i: root(i) for i in texts}
    star = spark.createDataFrame([(i, 0) for i in range(1, 80)] + [(0, 1)], "id long, centre long")
    assert minhash._pairs_once(star).count() == 79 and {(r.id, r.centre) for r in minhash._pairs_once(star).where("id in (0, 1)").collect()} <= {(1, 0), (0, 1)}


def planted(cosine, pairs, dim=64, seed=1):
    """Pairs of unit vectors at a cosine, each far from all others."""
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(pairs, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(pairs, dim))
    b -= (b * a).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return a, cosine * a + np.sqrt(1 - cosine**2) * b


@pytest.mark.parametrize("bits", [8, 10, 12])
def test_wider_tables_find_as_many_pairs(spark, bits):
    """Recall at the limit, where pairs are hardest to find, for the widths of labels with up to 260 million vectors."""
    a, b = planted(0.9305, 400)
    rows = [(2 * i, [float(x) for x in a[i]], 1) for i in range(400)] + [(2 * i + 1, [float(x) for x in b[i]], 1) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in vectors.near_vectors(df, chunk=bits).collect()}
    found = sum(got[2 * i + 1].component_id == 2 * i for i in range(400))
    assert found >= 0.9 * 400 and sum(r.n_links for r in got.values()) == 2 * found


def test_widths_follow_the_size_of_a_label(spark):
    sizes = [1, 1_000, 1 << 20, 1 << 22, 1 << 24, 1 << 28, 1 << 40]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in sizes], "n long").select(vectors.chunk_bits(F.col("n"))).collect()]
    assert got == [8, 8, 8, 9, 10, 12, 16]
    for n, bits in zip(sizes[:-1], got[:-1], strict=True):
        assert n / 2 ** (2 * bits) <= vectors.CROWD  # rows of a place on average
        assert len(vectors.tables_of(bits, 2, vectors.rotations_for(bits))) <= 200
    assert vectors.rotations_for(8) == 2 and len(vectors.tables_of(8, 2, 2)) == 56 and vectors.tables_of(8, 0, 2) == [()]


def test_labels_of_different_widths_in_one_run(spark, monkeypatch):
    monkeypatch.setattr(vectors, "chunk_bits", lambda n: F.when(n > 100, 10).otherwise(8))
    a, b = planted(0.97, 150)
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(np.r_[a, b])] + [(1000 + i, [float(x) for x in v], 2) for i, v in enumerate(np.r_[a[:20], b[:20]])]
    rows += [(2000, None, 1), (2001, [0.0] * 64, 1), (2002, [1.0, float("nan")], 1), (2003, [float(x) for x in a[0]], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df).collect()}
    assert sum(got[150 + i] == (1, i) for i in range(150)) >= 148 and sum(got[1020 + i] == (1, 1000 + i) for i in range(20)) >= 19
    assert all(got[i] == (0, i) for i in (2000, 2001, 2002, 2003))


def test_links_at_the_limit_equal_the_statement(spark):
    """Vectors with links from 0.93 to 0.99 and rows below it, against the registered DuckDB statement; joint=0 looks at all of a label."""
    import duckdb
    import pandas as pd

    rows = []
    for k, c in enumerate((0.9299, 0.9301, 0.95, 0.97, 0.99)):
        a, b = planted(c, 12, seed=k + 3)
        for i in range(12):
            rows += [(100 * k + 2 * i, a[i].tolist(), k % 2), (100 * k + 2 * i + 1, b[i].tolist(), k % 2)]
    rows += [(900, rows[0][1], 0), (901, rows[0][1], None)]
    con = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["vec_id", "embedding", "label"]).astype({"label": "Int64"})
    con.register("frame", frame)
    con.execute("CREATE TABLE embeddings AS SELECT vec_id::BIGINT AS vec_id, embedding::DOUBLE[] AS embedding, label::INT AS label FROM frame")
    want = {tuple(r) for r in con.execute(queries_models.ORACLES["op4_itq"]).fetchall()}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {tuple(r) for r in vectors.near_vectors(df, joint=0).collect()} == want
    assert sum(r[1] > 0 for r in want) >= 4 * 24
    found = {r.vec_id: r.n_links for r in vectors.near_vectors(df).collect()}
    assert sum(found.values()) >= 0.95 * sum(r[1] for r in want)


def test_parts_of_a_shard_follow_its_rows(spark, monkeypatch):
    rows = [(i, f"t{i % 7}") for i in range(3000)] + [(5, "t5")] * 200 + [(None, "n")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    once = {(r.shard, r.slot): (r.doc_id, r.text_crc32) for r in sharding.assign(df, 4, sub_buckets=2).collect()}
    monkeypatch.setattr(sharding, "PART_ROWS", 30)
    again = {(r.shard, r.slot): (r.doc_id, r.text_crc32) for r in sharding.assign(df, 4, sub_buckets=2).collect()}
    assert once == again and len(once) == 3250
    for shard in range(4):
        slots = sorted(s for k, s in again if k == shard)
        assert slots == list(range(len(slots)))
