"""What SQL can't express, against plain versions: exhaustive search, formulas row by row, the tokenizers library."""

import hashlib
import struct
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import bpe, langid, queries_models
from weftline.llm import toxicity as T
from weftline.llm.textvec import mix64

SF = "/root/testdata/sf0.01"


# languages


def plain_grams(text):
    """n-grams of a text's words, which stand between blanks."""
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    line = " " + " ".join(words) + " " if words else ""
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(line) - n + 1):
            g = line[i : i + n]
            if (n == 1 and g != " ") or (n == 2 and g != "  ") or (n == 3 and g[1] != " "):
                out[g] += 1
    return out


def plain_order(counts, limit):
    tie = lambda g: int(mix64(np.array([langid.number(g)], dtype=np.uint64))[0]) >> 32
    return sorted(counts, key=lambda g: (-counts[g], -tie(g)))[:limit]


def plain_language(text, profiles):
    mine = plain_order(plain_grams(text), langid.COMPARED)
    if not mine or not profiles:
        return "und", 0.0
    away = {}
    for name, profile in sorted(profiles.items()):
        place = {g: i for i, g in enumerate(profile)}
        away[name] = sum(abs(i - place[g]) if g in place else langid.PROFILE for i, g in enumerate(mine))
    order = sorted(away, key=lambda n: (away[n], n))
    first = away[order[0]]
    second = away[order[1]] if len(order) > 1 else langid.PROFILE * len(mine)
    return order[0], second / (first + second) if second else 0.5


def plain_profiles(rows):
    total = {}
    for lang, text in rows:
        total.setdefault(lang, Counter()).update(plain_grams(text))
    return {lang: sorted(c, key=lambda g: (-c[g], langid.number(g)))[: langid.PROFILE] for lang, c in total.items()}


def test_languages_against_the_plain_formula(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").where("doc_id < 60").collect()]
    docs += [(900, None, "en"), (901, "", None), (902, "123 !?", "de"), (903, "a b", None), (904, "ab ba ab ba", None), (904, "ab ba ab ba", None), (905, "wort " * 30_000, None), (906, "ß", None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("told", F.lit("clash")).withColumn("a.b", F.lit(1))
    profiles = langid.learn(d.select("doc_id", "text", "lang"))
    held = {r.doc_id: r.h for r in d.select("doc_id", queries_models.held_out(F.col("doc_id")).alias("h")).collect()}
    want = plain_profiles([(lang, t) for i, t, lang in docs if lang is not None and t is not None and not held[i]])
    assert profiles == {k: [langid.number(g) for g in v] for k, v in want.items()}
    got = d.select("doc_id", "text", langid.predict(F.col("text"), profiles).alias("p")).collect()
    assert len(got) == len(docs)
    for r in got:
        lang, score = plain_language(r.text, want)
        assert r.p.lang == lang and r.p.score == pytest.approx(score), r.doc_id
    assert d.limit(0).select(langid.predict(F.col("text"), profiles)).count() == 0


# toxicity


def test_first_split_against_exhaustive_search():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 9, (120, 4)).astype(float)
    y = ((x[:, 2] > 4) ^ (rng.random(120) < 0.1)).astype(float)
    trees = T.Trees(rounds=1, depth=1).fit(x, y)
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1) + g[~m].sum() ** 2 / (h[~m].sum() + 1) - g.sum() ** 2 / (h.sum() + 1)
    best = max((gain(x[:, f] <= v), -f) for f in range(4) for v in range(8) if h[x[:, f] <= v].sum() >= 1 and h[x[:, f] > v].sum() >= 1)
    (splits, leaves), = trees.trees
    f, k = splits[0]
    left = trees._binned(x)[:, f] <= k
    assert f == -best[1] and gain(left) == pytest.approx(best[0])
    assert leaves[1] == pytest.approx(-0.15 * g[left].sum() / (h[left].sum() + 1))


def test_trees_are_followed_one_row_at_a_time():
    rng = np.random.default_rng(4)
    x = rng.random((150, 5))
    y = (x[:, 0] + x[:, 3] > 1).astype(float)
    model = T.Trees(rounds=9).fit(x, y)

    def one(row):
        out = model.base
        for splits, leaves in model.trees:
            at = 0
            while at in splits:
                f, k = splits[at]
                at = 2 * at + 1 + (sum(e <= row[f] for e in model.edges[f]) > k)
            out += leaves.get(at, 0.0)
        return out

    assert model.raw(x) == pytest.approx([one(r) for r in x])


def test_isotonic_blocks_against_the_minmax_formula():
    rng = np.random.default_rng(5)
    s = np.sort(rng.random(60))
    y = (rng.random(60) < s).astype(float)
    fitted = T.Isotonic().fit(s, y)
    want = [max(min(y[a : b + 1].mean() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    n = Counter(np.round(want, 12))
    smoothed = np.maximum.accumulate([(w * n[np.round(w, 12)] + 0.05) / (n[np.round(w, 12)] + 0.2) for w in want])
    assert np.interp(s, fitted.x, fitted.y) == pytest.approx(smoothed)


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = queries_models.op1_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out AND toxic IS NOT NULL").toPandas()
    bad = got.toxic == 1
    rank = got.score.rank()
    auc = (rank[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum())
    assert bad.sum() > 100 and auc > 0.95
    assert got.predicted[bad].mean() > 0.8 and (got.toxic[got.predicted == 1] == 1).mean() > 0.9


def test_toxicity_with_repeated_labels_and_clashing_columns(spark):
    d = spark.createDataFrame([(i, f"plain words number {i} " + ("grobnik" if i % 3 == 0 else "")) for i in range(200)] + [(3, "other text under an id")], "doc_id long, text string").withColumn("toxic", F.lit("clash")).withColumn("part", F.lit(1)).withColumn("a.b", F.lit(2))
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(200)] + [(0, 1, 0), (3, 0, 1), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    model = T.fit(d.select("doc_id", "text"), labels)
    got = d.select(T.score(F.col("text"), model).alias("t")).select("t.*").collect()
    assert len(got) == 201 and all(0 <= r.score <= 1 for r in got)


# tokens


def digests(known, text):
    ids = known.encode(text, add_special_tokens=False).ids
    packed = b"".join(struct.pack("<I", i) for i in ids)
    return len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(known.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_all_columns_match_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries_models.vocabulary_path()
    known = tokenizers.Tokenizer.from_file(path)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10_000, None), (10_001, ""), (10_002, "wort " * 9_000), (10_003, "x" * 40_000 + "'ll " + " " * 20_000 + "y"), (10_004, "日本語" * 9_000), (10_005, "1" * 20_000 + "<|endoftext|>" + "ab " * 9_000), (10_005, "same id"), (10_006, "\n \n" * 9_000 + "it's")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bpe", F.lit("clash"))
    got = d.select("doc_id", "text", bpe.round_trip(F.col("text"), path).alias("b")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.b.n_tokens, r.b.ids_sha256, r.b.decoded_sha256) == digests(known, r.text or ""), r.doc_id
    assert d.limit(0).select(bpe.round_trip(F.col("text"), path)).count() == 0


@pytest.mark.parametrize("unit", ["words and more words. ", "x", "x1!é "])
def test_memory_does_not_grow_with_the_text(unit):
    vocabulary = bpe.Vocabulary(queries_models.vocabulary_path())
    peaks = []
    for size in (200_000, 800_000):
        text = unit * (size // len(unit))
        encoder = bpe.Encoder(vocabulary)
        tracemalloc.start()
        end = bpe.Digests(vocabulary.token)
        for chunk in encoder.chunks(text):
            end.take(chunk)
        end.end()
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0] + 500_000


def test_segments_of_any_length_give_the_same_ids(monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries_models.vocabulary_path()
    known, encoder = tokenizers.Tokenizer.from_file(path), bpe.Encoder(bpe.Vocabulary(path))
    rng = np.random.default_rng(1)
    parts = ["a", "b", " ", "  ", "\n", "word ", "1", "!", "'", "ll", "re", "é", "日本", "\t", " ", " x", "<|endoftext|>", "don't ", "x" * 20, "!" * 17]
    for segment in (3, 7, 16, 64):
        monkeypatch.setattr(bpe, "SEGMENT", segment)
        for _ in range(150):
            text = "".join(rng.choice(parts, int(rng.integers(0, 60))))
            assert encoder.encode(text) == known.encode(text, add_special_tokens=False).ids, (segment, text)
