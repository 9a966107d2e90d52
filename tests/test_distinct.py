"""Distinct values and n-grams told apart without carrying other columns or being dealt out by id."""

from collections import Counter

from pyspark.sql import functions as F

from weftline.operators import loanbook, ml, text


def test_distinct_counts_of_groups_and_of_everything(spark):
    rows = [("a", 1, 1), ("a", 1, 2), ("a", 2, None), ("b", 1, 3), (None, 4, 3), (None, None, 3), ("c", None, None)]
    df = spark.createDataFrame(rows, "g string, id long, phone long")
    got = {(r._g, r.g): (r.orders, r.users) for r in loanbook.distinct_counts(df, ["g"], {"orders": "id", "users": "phone"}, True).collect()}
    assert got == {(0, "a"): (2, 2), (0, "b"): (1, 1), (0, None): (1, 1), (1, None): (3, 3)}


def test_ngrams_of_rows_are_marked_once_per_id(spark):
    rows = [(1, "a b a b a"), (2, "a b"), (2, "b a b"), (None, "a b"), (None, "a b"), (3, None), (4, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (1, 2):
        got = text.marked(docs, "doc_id", "text", n).groupBy("token").agg(F.count("*").alias("n"), F.count_if("first").alias("docs"))
        all_, ids = Counter(), set()
        for i, t in rows:
            w = (t or "").split()
            for k in range(len(w) - n + 1):
                all_[" ".join(w[k : k + n])] += 1
                ids.add((i, " ".join(w[k : k + n])))
        assert {r.token: (r.n, r.docs) for r in got.collect()} == {t: (c, sum(x == t for _, x in ids)) for t, c in all_.items()}
    plan = text.marked(docs.where("doc_id = 1"), "doc_id", "text", 2).groupBy("token").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_models_read_rows_that_are_written_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(ml, "kept", lambda df, tag: written.append(tag) or df.cache())
    df = spark.createDataFrame([(float(i % 7), float(i % 5), float(i % 3), i % 2, int(i % 4 > 0)) for i in range(80)], "a double, b double, c double, target int, train int")
    assert ml.fusion(df, ["a", "b", "c"], "target", "train", 2).count() == 6 and written == ["fusion-rows"]
