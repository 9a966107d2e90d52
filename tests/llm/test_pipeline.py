"""The pipeline's stages, each against a plain version of itself on a small corpus with every awkward row."""

from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tests.llm.test_models import brute_components, word_sets
from tests.llm.test_plain import digests, plain_language, plain_profiles
from weftline.llm import queries_models, queries_native
from weftline.llm import toxicity as T
from weftline.llm.runtime import held_out

STAGES = dict(corpus_pipeline.STAGES)
WORDS = {"en": "the of and to in that is was for on with as by at from this have not are which".split(), "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split()}


def corpus():
    rng = np.random.default_rng(2)
    rows = []
    for i in range(260):
        lang = ("en", "de")[i % 2]
        words = list(rng.choice(WORDS[lang], int(rng.integers(8, 60))))
        if i % 5 == 0:
            words[3] = "grobnik" + str(rng.choice(["en", "ov", "is"]))
        rows.append((i, " ".join(words), lang, f"s{i % 4}" if i % 9 else None))
    for i in (11, 12, 13, 14):
        rows.append((1000 + i, rows[i][1], rows[i][2], "copies"))  # exact copies
        rows.append((1100 + i, rows[i][1] + " tail", rows[i][2], "copies"))  # near ones
    rows += [(11, "another text under an id that is there already", "en", "s1"), (None, rows[17][1], "de", "s1"), (None, "a text of its own without any id at all here", "en", None)]
    rows += [(2000, None, "en", "s0"), (2001, "", "en", "s0"), (2002, "12345 !!", None, "s0"), (2003, " ".join(rng.choice(WORDS["en"], 20_000)), "en", "long"), rows[21], rows[21]]
    return rows


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    d = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string")
    clash = {c: F.lit(c) for c in ("row", "said", "score", "gone_id", "component_id", "size", "odds", "copies", "a", "b")} | {"a.b": F.lit(1), "m": F.create_map(F.lit("k"), F.lit(2))}
    d.withColumns(clash).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i % 5 == 0)) for i in range(260)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def plain(df):
    return Counter((r.doc_id, r.text, r.lang, r.source) for r in df.collect())


def kept_by(spark, docs, name, sf, tmp):
    out = STAGES[name](spark, docs, sf)
    assert out.columns == docs.columns
    path = f"{tmp}/{name}"
    out.write.parquet(path)
    return spark.read.parquet(path)


def test_stages_against_plain_versions(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = {r.doc_id: r.h for r in docs.select("doc_id", held_out(F.col("doc_id")).alias("h")).collect()}
    before = plain(docs)

    after = kept_by(spark, docs, "language_id", sf, tmp_path)
    profiles = plain_profiles([(lang, t) for (i, t, lang, _), n in before.items() for _ in range(n) if lang is not None and t is not None and not held[i]])
    want = Counter({k: n for k, n in before.items() if plain_language(k[1], profiles)[0] != "und"})
    assert plain(after) == want and sum(want.values()) == sum(before.values()) - 3

    docs, before = after, want
    model = T.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet"))
    after = kept_by(spark, docs, "toxicity", sf, tmp_path)
    feature = T.Features(model.lexicon)
    toxic = lambda t: float(model.calibration(model.trees.raw(feature.table([t])))[0]) >= 0.7
    want = Counter({k: n for k, n in before.items() if not toxic(k[1])})
    assert plain(after) == want and len(want) < len(before)
    assert not any("grobnik" in k[1] for k in want)

    docs, before = after, want
    after = kept_by(spark, docs, "minhash_near_dedup", sf, tmp_path)
    keys = sorted(before, key=lambda k: (k[0] is None, k[0] or 0, k[1], str(k[3])))
    groups = brute_components(word_sets([(i, k[1]) for i, k in enumerate(keys)]))
    got = plain(after)
    assert all(n == 1 for n in got.values()) and set(got) <= set(before)
    best = {}
    for i, k in enumerate(keys):
        best.setdefault(groups[i], []).append(k)
    assert len(got) == len(best)
    for members in best.values():
        least = min((m[0] for m in members if m[0] is not None), default=None)
        assert [m[0] for m in members if m in got] == [least]  # one of each group, that of least id

    docs, before = after, got
    after = kept_by(spark, docs, "mixing", sf, tmp_path)
    con = duckdb.connect()
    con.register("frame", docs.select("doc_id", "text", "source").toArrow())
    con.execute("CREATE VIEW documents AS SELECT * FROM frame")
    taken = {(r[0], r[2]): r[5] // r[1] for r in con.execute(queries_native.OP10_SQL).fetchall()}
    want = Counter({k: taken[k[0], k[3]] for k in before if taken[k[0], k[3]]})
    assert plain(after) == want and sum(want.values()) > len(before)

    tokenizers = pytest.importorskip("tokenizers")
    known = tokenizers.Tokenizer.from_file(queries_models.vocabulary_path())
    coded = Counter((r.doc_id, r.source, r.n_tokens, r.ids_sha256, r.decoded_sha256, len(r.ids)) for r in STAGES["bpe"](spark, after, sf).collect())
    expected = Counter()
    for (i, t, _, source), n in want.items():
        d = digests(known, t)
        expected[i, source, *d, d[0]] += n
    assert coded == expected

    assert Counter((r.doc_id, r.source, r.n_tokens, r.ids_sha256, r.decoded_sha256, len(r.ids)) for r in corpus_pipeline.run(spark, sf).collect()) == expected


def test_one_id_with_two_texts_keeps_both(spark, sf):
    t = "some words that make a whole text of their own"
    docs = spark.createDataFrame([(1, t, "en", "x"), (2, t, "en", "x"), (2, "quite other words under the same number here", "en", "x"), (3, "third text with nothing in common to the rest", "en", "x")], "doc_id long, text string, lang string, source string")
    got = {(r.doc_id, r.text[:5]) for r in STAGES["minhash_near_dedup"](spark, docs, sf).collect()}
    assert got == {(1, "some "), (2, "quite"), (3, "third")}


def test_without_any_language_only_texts_without_letters_go(spark, sf):
    docs = spark.createDataFrame([(1, "some text", None, "x"), (2, "123", None, "x"), (3, None, None, "x")], "doc_id long, text string, lang string, source string")
    assert [r.doc_id for r in STAGES["language_id"](spark, docs, sf).collect()] == [1]


def test_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0, name


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and sum(n.startswith("op") and n[2].isdigit() for n in names) == 13
