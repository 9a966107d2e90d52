"""Out-of-fold sums, lists cut at several ages, values carried along an order, and reports over columns, against plain versions."""

import random
from collections import Counter

import pytest

from weftline.operators import binning, joins, prefix, text, woe
from weftline.sources import tables


def test_leave_one_out_with_folds_that_a_key_lacks(spark, monkeypatch):
    rows = [("x", 0, 3), ("x", 0, 4), ("x", 2, 5), ("y", 1, 1), (None, 1, 2)]
    df = spark.createDataFrame(rows, "k string, f int, n int")
    got = {(r.k, r.f): r.n for r in joins.leave_one_out(df, ["k"], "f", ["n"]).collect()}
    assert got == {("x", 0): 5, ("x", 1): 12, ("x", 2): 7, ("x", -1): 12, ("y", 0): 1, ("y", 2): 1, ("y", -1): 1, (None, 0): 2, (None, 2): 2, (None, -1): 2}
    assert joins.leave_one_out(df.limit(0), ["k"], "f", ["n"]).count() == 0
    monkeypatch.setattr(joins, "MOST_FOLDS", 2)
    with pytest.raises(ValueError, match="more than 2"):
        joins.leave_one_out(df, ["k"], "f", ["n"])


@pytest.mark.parametrize("first_only", [False, True])
def test_lists_at_several_ages(spark, first_only):
    rng = random.Random(8)
    spans, folds = [3, 10, 40], 4
    entries = [(rng.randrange(60), rng.choice("abcdef"), rng.choice([-5.0, 0.0, 3.0, 3.01, 9.0, 25.0, 40.0, 41.0])) for _ in range(900)]
    ids = [(i, int(i % 3 == 0)) for i in range(80)]  # 20 of them have no list
    got = text.items_of_spans(spark.createDataFrame(entries, "id long, item string, age double"), spark.createDataFrame(ids, "id long, target int"), spans, folds, first_only)
    found = {(r.span, r.fold, r.item): (r.orders, r.orders_0, r.orders_1, round(r.weight_0, 9), round(r.weight_1, 9), r.all_0, r.all_1) for r in got.collect()}
    if first_only:
        oldest = {}
        for i, item, age in entries:
            oldest[(i, item)] = max(age, oldest.get((i, item), age))
        entries = [(i, item, age) for (i, item), age in oldest.items()]
    want = {}
    for span in spans:
        lists = {}
        for i, item, age in entries:
            if age <= span:
                lists.setdefault(i, Counter())[item] += 1
        for fold in [*range(folds), -1]:
            others = [(i, t) for i, t in ids if i % folds != fold]
            all_ = [sum(t == k for _, t in others) for k in (0, 1)]
            for item in "abcdef":
                orders, weight = [0, 0], [0.0, 0.0]
                for i, t in others:
                    if lists.get(i, {}).get(item):
                        orders[t] += 1
                        weight[t] += lists[i][item] / sum(lists[i].values())
                if sum(orders):
                    want[(span, fold, item)] = (sum(orders), *orders, round(weight[0], 9), round(weight[1], 9), *all_)
    assert found == want


def test_levels_above_go_on_after_those_below(spark):
    stats = [(3, 0, "a", 10, 9, 1, 50, 50), (3, 0, "b", 10, 5, 5, 50, 50), (3, 0, "c", 10, 2, 8, 50, 50), (3, 0, "d", 10, 1, 9, 50, 50), (7, 0, "c", 10, 2, 8, 50, 50), (7, 0, "rare", 0, 0, 0, 50, 50)]
    df = spark.createDataFrame(stats, "span int, fold int, item string, orders long, orders_0 long, orders_1 long, all_0 long, all_1 long")
    assert {(r.span, r.item): r.level for r in text.select_items(df, ["span", "fold"]).collect()} == {(3, "a"): 0, (3, "c"): 2, (3, "d"): 3, (7, "c"): 0}


def test_the_last_known_value_crosses_slices(spark):
    rng = random.Random(2)
    rows = [(g, i, rng.random() if rng.random() < (0.02 if g == "thin" else 0.5) and i > 3 else None) for g in ("thin", "full") for i in range(400)]
    df = spark.createDataFrame(rows, "g string, o int, v double").repartition(5)
    for slices in (None, 16):
        got = {(r.g, r.o): r.w for r in prefix.last_known(df, "o", "v", "w", ["g"], slices).collect()}
        for g in ("thin", "full"):
            last = None
            for _, o, v in [r for r in rows if r[0] == g]:
                last = v if v is not None else last
                assert got[(g, o)] == last
    one = prefix.last_known(df.where("g = 'full'"), "o", "v", "w")
    assert one.count() == 400 and one.where("w is null").count() == sum(got[("full", o)] is None for o in range(400))


def test_columns_get_a_reason(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(3000):
        rise, turn = rng.random(), rng.random()
        bad = rng.random() < 0.1 + 0.5 * rise if rng.random() < 0.5 else rng.random() < (0.6 if 0.3 < turn < 0.6 else 0.1)
        rows.append((rise, turn, 1.0, None, int(bad)))
    df = spark.createDataFrame(rows, "rise double, turn double, flat double, gone double, target int")
    per = woe.value_classes(df.unpivot(["target"], ["rise", "turn", "flat", "gone"], "feature", "value"))
    got = {r.feature: r for r in woe.monotone_report(per, binning.quantile_edges_of(per.where("value is not null"), [4, 5, 8], rows="rows")).collect()}
    assert got["rise"].reason == "monotone" and not got["rise"].is_bad and got["flat"].reason == "one bin"
    assert got["turn"].is_bad and got["turn"].crossings == 2 and got["turn"].broken > 0
    assert got["gone"].is_bad and got["gone"].reason == "no values" and got["gone"].n is None
    assert woe.monotone_report(per.limit(0), spark.createDataFrame([], "feature string, n int, edges array<double>")).count() == 0


@pytest.mark.parametrize("first_only", [False, True])
def test_lists_are_dealt_out_by_id_once(spark, monkeypatch, first_only):
    written = {}
    monkeypatch.setattr(text, "kept", lambda df, tag: written.setdefault(tag, df))
    rng = random.Random(5)
    entries = spark.createDataFrame([(rng.randrange(50), rng.choice("abcd"), rng.choice([-5.0, 3.0, 9.0, 25.0, 41.0, None])) for _ in range(600)], "id long, item string, age double")
    ids = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(50)], "id long, target int")
    want = {tuple(r[:6]): r[6:] for r in text.items_of_spans(entries, ids, [3, 10, 40], 4, first_only).collect()}
    written.clear()
    got = text.items_of_spans(entries, ids, [3, 10, 40], 4, first_only, tasks=7)
    assert {tuple(r[:6]): tuple(round(x, 9) for x in r[6:]) for r in got.collect()} == {k: tuple(round(x, 9) for x in v) for k, v in want.items()} and want
    plan = written["items-folds"]._jdf.queryExecution().executedPlan().toString()
    assert list(written) == ["items-folds"]
    # of the entries, one shuffle, to as many tasks as are asked for; then items and folds
    shuffles = [x.split("Exchange hashpartitioning(")[1].split("[plan_id")[0] for x in plan.splitlines() if "Exchange hashpartitioning(" in x]
    assert sorted(x.split("#")[0] for x in shuffles) == ["id", "id", "item"] and all(", 7)" in x and "item" not in x for x in shuffles if x.startswith("id"))


def test_tasks_go_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS_PER_TASK", 100)
    few = spark.sparkContext.defaultParallelism
    assert [tables.tasks_for(spark, n) for n in (0, 100 * few, 100 * few + 1, 100_000)] == [None, None, few + 1, 1_000]
    assert tables.dealt(spark.range(50), 9, "id").rdd.getNumPartitions() == 9


def test_folds_without_lists_and_ids_without_a_target(spark):
    entries = spark.createDataFrame([(0, "a", 1.0), (0, None, 1.0), (1, "a", 1.0), (1, "b", 9.0)], "id long, item string, age double")
    ids = spark.createDataFrame([(0, 1), (1, None), (2, 0), (None, 0)], "id long, target int")
    got = {(r.span, r.fold, r.item): (r.orders, r.orders_0, r.orders_1, r.weight_1, r.all_0, r.all_1) for r in text.items_of_spans(entries, ids, [3, 10], 3).collect()}
    of_all = {(3, "a"): (2, 0, 1, 0.5, 1, 1), (10, "a"): (2, 0, 1, 0.5, 1, 1), (3, None): (1, 0, 1, 0.5, 1, 1), (10, None): (1, 0, 1, 0.5, 1, 1), (10, "b"): (1, 0, 0, 0.0, 1, 1)}
    assert {(s, i): v for (s, f, i), v in got.items() if f == -1} == of_all
    assert {(s, i): v[:4] for (s, f, i), v in got.items() if f == 2} == {k: v[:4] for k, v in of_all.items()}
    assert got[(3, 0, "a")] == (1, 0, 0, 0.0, 1, 0) and (3, 0, None) not in got and got[(10, 1, "a")] == (1, 0, 1, 0.5, 1, 1) and (10, 1, "b") not in got
