"""Reports and drift of configured models: rows that nobody asks for, models with too little, days outside."""

import datetime as dt
import math

from pyspark.sql import functions as F

from weftline.operators import monitor

AS_OF = dt.date(2024, 3, 1)


def test_periods_and_models_with_too_few_rows(spark):
    days = spark.createDataFrame([(AS_OF - dt.timedelta(days=k),) for k in (0, 1, 7, 8, 14, 15)], "d date")
    got = [r[0] for r in days.select(monitor.period_of(F.col("d"), F.lit(AS_OF), 7, 2)).collect()]
    assert got == [None, 0, 0, 1, 1, None]
    rows = [("a", AS_OF - dt.timedelta(days=5 + i % 14), float(i % 90), i % 3 == 0, 1) for i in range(400)]  # 4 days until labels show
    rows += [("b", AS_OF - dt.timedelta(days=6), float(i), False, 1) for i in range(50)] + [("c", AS_OF - dt.timedelta(days=6), 1.0, True, 1)] * 60
    rows += [("a", AS_OF - dt.timedelta(days=6), -1.0, True, 1)] * 30
    scored = spark.createDataFrame([(s, d, v, int(t), a) for s, d, v, t, a in rows], "kind string, day date, score double, target int, amount int").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    config = spark.createDataFrame([("A", "a", 4, 2.0), ("A again", "a", 4, 1.0), ("B", "b", 4, 1.0), ("D", "d", 4, 1.0)], "model string, kind string, performance_days int, rate double")
    got = monitor.model_reports(scored, config, ["kind"], F.lit(AS_OF), 7, 2).collect()
    assert {r.model for r in got} == {"A", "A again"} and {r.period for r in got} == {0, 1}
    for model, rate in (("A", 2.0), ("A again", 1.0)):
        for period in (0, 1):
            mine = [r for r in got if r.model == model and r.period == period]
            whole = next(r for r in mine if r.bin == 0)
            assert len(mine) == 6 and whole.total == sum(r.total for r in mine if r.bin) and abs(whole.amount_sum - whole.total / rate) < 1e-9
            assert math.isclose(whole.psi, sum(r.psi for r in mine if r.bin)) and (period == 0 or whole.psi == 0)
    assert sum(r.total for r in got if r.bin == 0 and r.model == "A") == 400


def test_drift_of_configured_models(spark):
    def doc(day, kind, **values):
        return (kind, AS_OF - dt.timedelta(days=day), values)

    rows = [doc(1, "x", a=float(i), s_score=50.0 + i, new=1.0) for i in range(40)] + [doc(2 + i % 3, "x", a=float(i % 40), s_score=float(i % 40), old=1.0) for i in range(120)]
    rows += [doc(5, "x", a=1e6, s_score=1e6)] * 9 + [doc(0, "x", a=1e6, s_score=1e6)] * 9 + [doc(1, "y", a=1.0)] + [doc(2, "z", a=float("nan"), b=1.0)] * 3 + [doc(1, "z", a=2.0, b=1.0)]
    results = spark.createDataFrame(rows, "kind string, day date, doc map<string,double>")
    config = spark.createDataFrame([("X", "x", 3, 0.1), ("X5", "x", 4, 9.9), ("Y", "y", 3, 0.1), ("Z", "z", 3, 0.1), ("W", "w", 3, 0.1)], "model string, kind string, days_before int, threshold double")
    got = {(r.model, r.feature): r for r in monitor.drift_run(results, config, ["kind"], F.lit(AS_OF)).collect()}
    assert set(got) == {("X", "a"), ("X", "s_score"), ("X5", "a"), ("X5", "s_score"), ("Z", "a"), ("Z", "b")}  # not what one side lacks
    assert abs(got[("X", "a")].psi) < 1e-3 and got[("X", "s_score")].psi > 1 and got[("X", "s_score")].alert
    assert not got[("X5", "s_score")].alert and not got[("X", "a")].alert
    assert (got[("X", "a")].n_before, got[("X", "a")].n_day, got[("X5", "a")].n_before) == (120, 40, 129)
    assert got[("Z", "b")].psi == 0 and got[("Z", "a")].psi == 0  # nothing known before: one bin
