"""Near-duplicates where ids are too many for a broadcast: bits let through what is asked for."""

from pyspark.sql import functions as F

from weftline.llm import minhash, runtime


def test_bits_never_lose_a_key(spark, monkeypatch):
    for bits in (1 << 26, 1 << 16):
        monkeypatch.setattr(runtime, "BITS", bits)
        rows = spark.range(3000).select((F.col("id") * 7919 - 10_000).alias("k")).unionByName(spark.sql("SELECT cast(null AS bigint) AS k"))
        told = runtime.may_be_in(rows, F.col("k"), rows.where("k % 3 = 0").select(F.col("k").alias("w")), F.col("w"))
        assert told.count() == 3001 and told.where("k % 3 = 0 AND NOT maybe").count() == 0
        assert told.where("k % 3 <> 0 AND maybe").count() < 60


def test_the_same_groups_with_few_and_many_ids(spark, monkeypatch):
    base = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(40)]
    texts = [t for i, t in enumerate(base) for t in (t, t + " end", t if i % 2 else t.replace("x3", "y3"))]
    docs = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    before = spark.conf.get("spark.sql.sources.fileCompressionFactor")
    few = rows(minhash.near_duplicates(docs)), rows(minhash.one_of_each(docs))
    sent = []
    monkeypatch.setattr(minhash, "IDS_AT_ONCE", 5)
    monkeypatch.setattr(minhash, "may_be_in", lambda *a: sent.append(1) or runtime.may_be_in(*a))
    assert (rows(minhash.near_duplicates(docs)), rows(minhash.one_of_each(docs))) == few and len(sent) >= 3
    assert len(few[1]) < len(texts) and spark.conf.get("spark.sql.sources.fileCompressionFactor") == before
