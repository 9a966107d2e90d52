"""Search, manifest and archives against plain versions."""

import gzip
import hashlib
import math
import os
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import merkle, search, warc

# ---- ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def best(docs, items, k):
    """Every document's score for every item."""
    counted = [(d, Counter(words(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in counted]
    n, length = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counted for t in c)
    out = Counter()
    for item, text in items:
        scored = []
        for (d, c), size in zip(counted, sizes, strict=True):
            score = 0
            for t in words(text):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    m = 75 + (25 * size * n) // length
                    score += w * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0))
        for i, (s, none, d) in enumerate(sorted(scored)[:k]):
            out[(item, i + 1, None if none else d, -s)] += 1
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ünï", "ñandú", "A1", "日本"]
    docs = [(i, " ".join(rng.choices(vocabulary, weights=[40 / (j + 1) for j in range(44)], k=rng.randint(1, 60)))) for i in range(300)]
    docs += [(5, docs[5][1]), (None, docs[6][1]), (None, docs[6][1]), (900, None), (901, ""), (902, " \n.,"), (903, "w1 " * 30000), (904, "W1-w2_W3'w4")] + [(1000 + i, docs[7][1]) for i in range(60)]
    items = [(1, docs[7][1]), (2, "w0 w0 w1 zzz"), (3, None), (4, "?"), (5, "ÜNÏ ñandú a1"), (6, "W39"), (7, docs[100][1] + " " + docs[200][1]), (1, "w2 w3")]
    return docs, items


@pytest.mark.parametrize("k", [20, 3])
def test_search_against_brute_force(spark, k):
    docs, items = corpus(k)
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, term string, slice int").repartition(5)
    b = spark.createDataFrame([(*r, "x", 0) for r in items], "item_id long, text string, term string, score int")
    got = Counter(tuple(r) for r in search.rank(d, b, k).collect())
    assert got == best(docs, items, k)


def test_search_with_all_terms_and_in_blocks(spark, monkeypatch):
    docs, items = corpus(9)
    monkeypatch.setattr(search, "VOCABULARY", 3)
    monkeypatch.setattr(search, "ASKS_AT_ONCE", 20)
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    assert Counter(tuple(r) for r in search.rank(d, b).collect()) == best(docs, items, 20)


def test_search_of_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "b")], "item_id long, text string")
    assert search.rank(d.limit(0), b).count() == 0 and search.rank(d, b.limit(0)).count() == 0
    assert search.rank(d, b).columns == search.rank(d, b.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_slices_are_closed_when_full():
    s = search._Slice(3, {b"a": 0, b"b": 1})
    s.add(b"a A b c")
    s.add(None)
    s.ids.append(pa.array([7, 8]))
    own, found = s.segments(pa.array(["a", "b"]))
    assert own.column("n_terms")[0].as_py() == 4 and own.column("n_docs")[0].as_py() == 1 and own.column("ids")[0].as_py() == [7, 8]
    assert found.select(["term", "docs", "tfs", "lengths"]).to_pylist() == [{"term": "a", "docs": [0], "tfs": [2], "lengths": [4]}, {"term": "b", "docs": [0], "tfs": [1], "lengths": [4]}]
    s.lengths = [0] * search.SLICE_DOCUMENTS
    assert s.full()


# ---- manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, at):
    out = []
    for level in tree[:-1]:
        run = at - at % 16
        out.append((level[run:at], level[at + 1 : run + 16]))
        at //= 16
    return out


def plain_leaf(row, lower=False):
    values = [row[0], row[1], row[2], row[3], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]) if lower and row[4] is not None else row[4]]
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def manifest(rows):
    import zlib

    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, plain_leaf(r), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    out = Counter()
    for i, s in enumerate(order):
        for at, (*_, leaf, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            path = siblings(trees[s], at) + siblings(top, i)
            picked = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            now = plain_leaf(r, True) if picked else leaf
            for before, after in path:
                now = sha(*before, now, *after)
            out[(r[0], leaf, trees[s][-1][0], top[-1][0], sha(*[d for b, a in path for d in (*b, *a)]), now, now == top[-1][0])] += 1
    return out


def test_manifest_against_brute_force(spark):
    rows = [(i, "big", "en", 5, f"Text {i}") for i in range(700)] + [(-i, None, None, None, None) for i in range(17)] + [(i, f"s{i:02}", "de", i, "ä\nB") for i in range(30)]
    rows += [(3, "twice", "en", 1, "A")] * 40 + [(3, "twice", "en", 1, "b"), (None, "twice", "en", 1, "C"), (None, "twice", "en", 1, "C")] + [(0, "", "", 0, ""), (9, "é", "x", -4, "Z" * 100_000), (8, "ﬀ", "x", 1, "y"), (8, "𐍈", "x", 1, "y")]
    random.Random(1).shuffle(rows)
    d = spark.createDataFrame([(*r, "x", 2) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, level int").repartition(7)
    got = merkle.manifest(d, merkle.picked(F.col("doc_id")))
    assert Counter(tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()) == manifest(rows)
    assert merkle.manifest(d.limit(0), merkle.picked(F.col("doc_id"))).count() == 0
    assert merkle.manifest(d.where("doc_id = 9")).count() == 1 + 2  # in big and s09, and é: a tree of one leaf is its leaf


@pytest.mark.parametrize("many", [1, 2, 15, 16, 17, 255, 256, 257, 300, 4100])
def test_mountain_ranges_and_their_edges_give_the_tree(many):
    leaves = [sha(str(i)) for i in range(many)]
    want = levels(leaves)
    rng = random.Random(many)
    cuts = sorted({0, many, *[rng.randrange(many) for _ in range(rng.randint(0, 9))]})
    known, edges = {}, {}
    for a, b in zip(cuts, cuts[1:], strict=False):
        hill = merkle._Range("t", a, many)
        found = [x for i in range(a, b) for x in hill.push(leaves[i])] + list(hill.end())
        for level, at, digest, edge in found:
            (edges if edge else known).setdefault((level, at), digest)
            assert want[level][at] == digest
    for level in range(len(want) - 1):
        for up in {at // 16 for lv, at in edges if lv == level}:
            run = [edges[(level, at)] for at in range(16 * up, min(16 * up + 16, len(want[level])))]
            known[(level + 1, up)] = edges[(level + 1, up)] = sha(*run)
    assert {k: v for k, v in known.items() if k[0]} == {(lv, i): d for lv, row in enumerate(want) for i, d in enumerate(row) if lv}
    assert len(edges) <= 2 * 16 * len(want) * len(cuts)


# ---- archives


def test_round_trip_against_brute_force(spark):
    long, other = "<p>ä" * 60, "<b>" * 34
    rows = [(7, "http://a/", long), (3, "http://b/", long), (9, None, long), (4, "http://c/\r\nWARC-Type: revisit", "short"), (5, "u", "short"), (6, "u", None), (8, "u", ""), (2, "u", other), (1, "u", other), (1, "u", other), (None, "u", other), (11, "u", "x" * 3_000_000), (12, "u", "y" * 99), (13, "u", "y" * 99), (14, "u", "z" * 100), (15, "u", "z" * 100)]
    d = spark.createDataFrame([(*r, "x", 5) for r in rows], "page_id long, url string, html string, digest string, row int").repartition(3)
    got = Counter(tuple(r) for r in warc.round_trip(d).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    want, seen = Counter(), {}
    for p, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (html or "").encode()
        key = hashlib.sha256(raw).hexdigest()
        again = len(raw) >= 100 and key in seen
        want[(p, len(raw), key, "revisit" if again else "response", seen.get(key) if again else None)] += 1
        seen.setdefault(key, p)
    assert got == want
    assert warc.round_trip(d.limit(0)).count() == 0


def test_filters_are_decided_before_blocks_are_read(spark, tmp_path):
    path = str(tmp_path / "in")
    os.makedirs(path)
    good = b"".join(warc.record({"record_type": "response", "record_id": "<urn:a>", "target_uri": "http://a/x", "payload": b"hello"}, True))
    bad = b"".join(warc.record({"record_type": "metadata", "record_id": "<urn:b>", "payload": b"hello" * 50}, True))
    bad = bad.replace(b"\x1f\x8b", b"\x00\x00")  # its payload can't be decoded
    plain = b"".join(warc.record({"record_type": "resource", "record_id": "<urn:c>", "target_uri": "http://b/", "payload": b"WARC/1.1\r\n\r\n"}, False))
    (tmp_path / "in/one.warc").write_bytes(bad + good + bad + plain)
    (tmp_path / "in/two.warc.gz").write_bytes(gzip.compress(good) + gzip.compress(bad) + gzip.compress(plain))
    (tmp_path / "in/other.txt").write_bytes(b"no archive")
    got = warc.read(spark, path).where(F.col("record_type") == "response")
    assert "Filter (" not in got._jdf.queryExecution().executedPlan().toString()
    assert [(r.record_id, bytes(r.payload)) for r in got.collect()] == [("<urn:a>", b"hello")] * 2
    assert sorted(bytes(r.payload) for r in warc.read(spark, path).where(F.col("record_id").isin("<urn:a>", "<urn:c>")).collect()) == [b"WARC/1.1\r\n\r\n"] * 2 + [b"hello"] * 2
    assert warc.read(spark, path).where(F.col("target_uri").startswith("http://b")).count() == 2
    heads = warc.read(spark, path, payload=False)
    assert heads.count() == 7 and heads.where("payload is not null").count() == 0
    both = warc.read(spark, path).where((F.col("record_type") == "resource") & (F.length("payload") > 3))  # the second part stays with Spark
    assert both.count() == 2
    with pytest.raises(Exception, match="incorrect header|unknown|Error"):
        warc.read(spark, path).collect()


def test_files_are_planned_rolled_and_listed(spark, tmp_path):
    path = str(tmp_path / "out")
    pages = spark.range(200).select(F.lit("response").alias("record_type"), F.concat(F.lit("<urn:"), "id", F.lit(">")).alias("record_id"), F.concat(F.lit("http://x/"), "id").alias("target_uri"), F.lit("2024-01-01T00:00:00Z").alias("record_date"), F.lit(None).cast("string").alias("payload_digest"), F.lit(None).cast("bigint").alias("payload_length"), F.lit(None).cast("string").alias("refers_to"), F.lit(None).cast("bigint").alias("content_length"), F.encode(F.repeat(F.lit("ab"), 500), "UTF-8").alias("payload"))
    warc.register(spark)
    write = pages.coalesce(2).write.format("warc").option("fileBytes", 20_000).option("payloadEncoding", "identity")
    write.mode("append").save(path)
    files = [f for f in os.listdir(path) if f.endswith(".warc")]
    assert len(files) > 5
    (tmp_path / "out/part-left-by-a-lost-task.warc").write_bytes(b"WARC/1.1\r\nContent")  # not listed, so not read
    assert warc.read(spark, path).select("record_id").distinct().count() == 200
    reader = warc.WarcReader(path, {"partitionBytes": "60000"})
    parts = reader.partitions()
    assert 1 < len(parts) < len(files) and sorted(p for x in parts for p in x.paths) == sorted(f"{path}/{f}" for f in files)
    write.mode("append").save(path)
    assert warc.read(spark, path).count() == 400
    write.mode("overwrite").save(path)
    assert warc.read(spark, path).count() == 200 and warc.read(spark, f"{path}/{files[0]}").count() > 0
