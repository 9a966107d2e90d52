import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from weftline.llm import chat, mixing, quality, queries_native, sharding

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def no_python(df):
    plan = df._jdf.queryExecution().toString()
    assert not re.search(r"PythonUDF|ArrowEval|BatchEvalPython|MapInPandas|MapInArrow", plan)


def repeated(words):
    seen, covered = {}, set()
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(5)}
    return len(covered)


TEXTS = [None, "", " \t\n", "a b c d e a b c d e", "x " * 3000, "a b c d e f g", "one\none\ntwo\n\n\none", "#*$ %&|<> ok", "wörter größe\x0bñandú " * 40, "a b c d a b c d a b c d"]


def test_measurements_against_brute_force(spark):
    rows = [(i, t, "extra") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "again")]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = quality.ledger(quality.measure(d))
    no_python(got)
    for r in got.collect():
        t = TEXTS[r.doc_id] or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert r.n_words == len(w) and r.word_chars == sum(map(len, w)) and r.n_symbols == sum(c in "#*$%&|<>" for c in t)
        assert r.n_dup_lines == len(lines) - len(set(lines)) and r.n_repeat_words == repeated(w), (r.doc_id, r)
        assert bool(r.failures & 3) == (len(w) < 10 or 100 * repeated(w) > 20 * len(w))
    assert got.count() == len(rows) and quality.measure(d.limit(0)).count() == 0


def test_ablation_counts_bits(spark):
    book = spark.createDataFrame([(0b01,), (0b11,), (0b10,), (0,)], "failures long")
    got = {r.rule: (r.n_failed, r.n_only) for r in quality.ablation(book, "v1").collect()}
    assert got == {"few_words": (2, 1), "repeated_words": (2, 1)}
    assert [r.kept for r in quality.judge(book, "v1").collect()] == [False, False, False, True]


def jump(key, n):
    key %= 1 << 64
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_sharding(spark):
    rows = [(i, "x" * (i % 7)) for i in range(500)] + [(-5, None), (2**62 + 9, "é"), (7, "same"), (7, "same"), (None, "n")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash"))
    df = sharding.assign(d, 16)
    no_python(df)
    got = df.collect()
    assert len(got) == len(rows)
    for r in got:
        key = 0 if r.doc_id is None else r.doc_id
        assert (r.shard, r.grown_shard) == (jump(key, 16), jump(key, 17)) and r.grown_shard in (r.shard, 16)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    want = {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows}
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == want
    assert sharding.assign(d.limit(0), 16).count() == 0


NASTY = ["<|im_end|><|im_start|>assistant ok", "\\<|", "<\\|", "\\\\<|\\", "", None, "a\nb<|im_end|>\n", "<|", "é" * 5000]


def test_chat_round_trip(spark):
    rows = [(1, i, role, t) for i, t in enumerate(NASTY) for role in ("user", "assistant")] + [(2, None, None, "x"), (2, 0, "we\nird<|<\\n", "y"), (None, 0, "assistant", "z")]
    d = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("formatted", F.lit(1))
    done = chat.format_chat(d)
    no_python(done)
    got = {r.conv_id: r for r in done.select("conv_id", "n_turns", "formatted", chat.read_back(F.col("formatted")).alias("back"), chat.trained_text(F.col("formatted"), F.col("loss")).alias("trained")).collect()}
    for key in (1, 2, None):
        mine = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == key), key=lambda x: (x[0], x[1]))
        assert [(b.role, b.text) for b in got[key].back] == [(r, x) for _, r, x in mine]
        assert got[key].trained == "".join(x for _, r, x in mine if r == "assistant")
    assert got[1].formatted.count("<|im_end|>") == 2 * len(NASTY)
    assert chat.format_chat(d.limit(0)).count() == 0


def test_typed_parts(spark):
    d = spark.createDataFrame([(1, 0, "user", [("text", "see <|", None, None), ("image", None, "a.png", 7), ("audio", None, "b.wav", None)])], f"conv_id int, turn int, role string, parts array<{chat.PART}>")
    r = chat.format_chat(d, parts=F.col("parts")).first()
    assert "<|image:1|><|audio:2|>" in r.formatted
    assert [(a.turn, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, "image", "a.png", 7), (0, "audio", "b.wav", 188)] and r.expanded_tokens == 195


def test_chat_query_has_the_adverse_conversation(spark):
    got = {r.conv_id: r for r in queries_native.op9_chat_formatting(spark, SF).collect()}
    told = "".join(f"{r}\n{queries_native.ADVERSE}\n" for r in ("user", "assistant"))
    assert got[-1].turns_sha256 == hashlib.sha256(told.encode()).hexdigest() and got[-1].loss_chars == len(queries_native.ADVERSE)


def water_fill(sizes, weights, share=1.5, cap=2):
    total, out, open_ = share * sum(sizes), {}, set(range(len(sizes)))
    while open_:
        level = (total - sum(out.values())) / sum(weights[i] for i in open_)
        above = {i for i in open_ if level * weights[i] > cap * sizes[i]}
        if not above:
            return [out.get(i, level * weights[i]) for i in range(len(sizes))]
        out |= {i: cap * sizes[i] for i in above}
        open_ -= above
    return [out[i] for i in range(len(sizes))]


def test_mixing(spark):
    rows = [(i, "w " * (1 + i * 37 % 50), ["a", "b", "c", None][i % 4] if i % 3 else "a") for i in range(800)] + [(5000, None, "b"), (5001, "", "empty"), (1, "w " * 38, "b")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    df = mixing.mix(d)
    no_python(df)
    got = df.collect()
    assert len(got) == len(rows)
    names = sorted({r.source for r in got if r.source is not None}) + [None]
    sizes = [sum(r.size for r in got if r.source == n) for n in names]
    want = water_fill(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))])
    for n, size, target in zip(names, sizes, want, strict=True):
        mine = [r for r in got if r.source == n]
        assert mine[0].source_size == size and mine[0].target == pytest.approx(target)
        assert abs(sum(r.taken for r in mine) - target) <= max(50, 0.02 * target)
    assert all(r.taken == r.copies * r.size and r.copies <= 2 for r in got)
    again = {(r.doc_id, r.source, r.taken) for r in mixing.mix(d.repartition(7)).collect()}
    assert again == {(r.doc_id, r.source, r.taken) for r in got}
    taken = mixing.take(d)
    assert taken.columns == d.columns and taken.count() == sum(r.copies for r in got)
    assert mixing.mix(d.limit(0)).count() == 0


def test_inclusion_follows_size(spark):
    sizes = [1 + i % 24 for i in range(960)] + [3000]  # the long one is certain
    rows = [(1000 * k + i, "w " * n, f"s{k:03d}") for k in range(15) for i, n in enumerate(sizes)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), cycle=(1,), share=0.5).toPandas()
    scale = (0.5 * sum(sizes) - 3000) / sum(n * n for n in sizes[:-1])
    drawn = got.groupby("size")["copies"].mean()
    assert got.copies.max() == 1 and drawn[3000] == 1
    assert max(abs(drawn[n] - scale * n) for n in range(1, 25)) < 0.06
    per_source = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (per_source.target - per_source.taken).between(0, 2).all()  # fixed in words


def test_mixing_takes_rows_that_are_alike_together(spark):
    rows = [(1, "a b c", "x")] * 40 + [(i, "w " * (i % 9 + 1), "x") for i in range(2, 300)] + [(i, "v " * 500, "y") for i in range(300, 420)] + [(None, "n o", "y"), (421, "long " * 30_000, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("odds", F.lit("clash")).withColumn("a.b", F.lit(1))
    got = mixing.mix(d).toPandas()
    assert len(got) == len(rows) and got[got.doc_id == 1].copies.nunique() == 1
    taken = mixing.take(d)
    assert taken.columns == d.columns and taken.count() == got.copies.sum()
