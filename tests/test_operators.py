"""Operators on hand-made panels."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from panelforge.functions.core import by_entity, ffill, pct_change
from panelforge.operators import accounting, clean, resample, ts, xs
from panelforge.sources import tables


def panel(spark, values, entity=1):
    return spark.createDataFrame([(entity, dt.date(2020, 1, 1) + dt.timedelta(days=i), v) for i, v in enumerate(values)], "entity int, dt date, x double")


def column(df, name):
    return [r[name] for r in df.orderBy("dt").collect()]


def test_limited_fill_and_padded_growth(spark):
    p = panel(spark, [1.0, None, None, 4.0])
    assert column(p.withColumn("y", ffill("x", by_entity(), 1)), "y") == [1.0, 1.0, None, 4.0]
    assert column(ts.growth(p, "x", 1), "mom_1") == [None, None, None, 3.0]
    assert column(p.withColumn("y", pct_change("x", 3, by_entity())), "y") == [None, None, None, 3.0]


def test_constant_window_has_no_correlation(spark):
    p = panel(spark, [1.0, 1.0, 1.0]).withColumn("y", F.col("x") + 1)
    assert column(p.withColumn("c", ts.correlation("x", "y", 3)), "c") == [None, None, None]


def test_total_loss_stays(spark):
    assert column(panel(spark, [0.5, -1.0, 0.5]).withColumn("n", ts.nav("x", "entity")), "n") == [1.5, 0.0, 0.0]


def test_single_member_industry_has_no_residual(spark):
    rows = [(1, dt.date(2020, 1, 1), 3.0, 10.0, 7), (2, dt.date(2020, 1, 1), 1.0, 5.0, 8), (3, dt.date(2020, 1, 1), 2.0, 50.0, 8)]
    df = spark.createDataFrame(rows, "entity int, dt date, x double, cap double, industry int")
    got = {r["entity"]: r["x"] for r in xs.neutralize(df, "x").collect()}
    assert got[1] == 0.0 and abs(got[2] + got[3]) < 1e-12


def test_signal_moves_to_the_next_date_only(spark):
    rows = [(e, dt.date(2020, 1, d), float(e * d)) for d in (1, 2, 3) for e in (1, 2, 3)]
    df = spark.createDataFrame(rows, "entity int, dt date, x double")
    before = {(r["entity"], r["dt"]): r["signal"] for r in xs.signal(df, "x", 2).collect()}
    changed = df.withColumn("x", F.when(F.col("dt") == dt.date(2020, 1, 3), F.col("x") * -5).otherwise(F.col("x")))
    assert before == {(r["entity"], r["dt"]): r["signal"] for r in xs.signal(changed, "x", 2).collect()}


def brute_medcouple(values):
    z = np.sort(np.array(values) - np.median(values))
    up, low, ties = z[z >= 0], z[z <= 0], int((z == 0).sum())
    h = [(v + u) / (v - u) for v in up for u in low if v > u]
    return float(np.median([*h, *np.sign(np.subtract.outer(np.arange(ties), np.arange(ties))).ravel()]))


def test_medcouple_counts_ties_at_the_median(spark):
    rng = np.random.default_rng(3)
    cases = [rng.lognormal(size=n) for n in (1, 2, 3, 40, 41)] + [rng.integers(-3, 6, n).astype(float) for n in (2, 9, 30, 61)]
    cases += [[0.0] * 9 + [1.0, 2.0, 4.0, 9.0, 30.0, -1.0], [2.0] * 5, [0.0, 0.0, 0.0, 1.0, 50.0]]
    for c in cases:
        assert abs(xs.medcouple(np.array(c)) - brute_medcouple(c)) < 1e-12
    values = [-3.0, *[0.0] * 6, 1.0, 1.0, 1.5, 2.0, 2.5, 13.0]
    q1, q3, mc = *np.quantile(values, [0.25, 0.75]), brute_medcouple(values)
    lo, hi = q1 - 1.5 * np.exp((-3.5 if mc >= 0 else -4) * mc) * (q3 - q1), q3 + 1.5 * np.exp((4 if mc >= 0 else 3.5) * mc) * (q3 - q1)
    inside = [v for v in values if lo <= v <= hi]
    got = xs.adjusted_boxplot(spark.createDataFrame([(dt.date(2020, 1, 1), v) for v in [*values, None]], "dt date, x double"), "x")
    want = sorted(min(max(v, min(inside)), max(inside)) for v in values)
    assert sorted(r["x"] for r in got.where("x is not null").collect()) == want and got.count() == len(values) + 1


def test_quarter_grid_ends_on_quarter_ends(spark):
    df = spark.createDataFrame([(1, dt.date(2020, 6, 30)), (1, dt.date(2020, 12, 31))], "entity int, dt date")
    assert [r["dt"] for r in resample.quarter_grid(df).orderBy("dt").collect()] == [dt.date(2020, 6, 30), dt.date(2020, 9, 30), dt.date(2020, 12, 31)]


def test_weekend_announcement(spark):
    cal = spark.createDataFrame([(dt.date(2020, 1, 3),), (dt.date(2020, 1, 6),)], "dt date")
    df = spark.createDataFrame([(1, dt.date(2020, 1, 4), 5.0), (2, dt.date(2020, 1, 7), 5.0)], "entity int, dt date, x double")
    assert [(r["entity"], r["dt"]) for r in resample.on_or_after(df, cal).collect()] == [(1, dt.date(2020, 1, 6))]


def test_equations():
    assert accounting.signed_sum("a - b + c") == [(1, "a"), (-1, "b"), (1, "c")]


def test_limits(spark):
    up, down = clean.limit_flags("x")
    got = panel(spark, [10.0, 11.0, 9.0]).select("dt", up.alias("u"), down.alias("d")).orderBy("dt").collect()
    assert [(r["u"], r["d"]) for r in got] == [(False, False), (True, False), (False, True)]


def test_keyed_read_of_keys_and_dates(spark):
    df = spark.createDataFrame([(k, dt.date(2020, 1, d), k * 1.0, "n") for k in range(5) for d in range(1, 6)], "entity int, dt date, close double, other string")
    got = tables.keyed_read(df, ["close"], "entity", "dt", [1, 3], dt.date(2020, 1, 2), dt.date(2020, 1, 3))
    assert got.columns == ["entity", "dt", "close"] and sorted((r["entity"], r["dt"].day) for r in got.collect()) == [(1, 2), (1, 3), (3, 2), (3, 3)]
    assert tables.keyed_read(df, ["close"], "entity", "dt", []).count() == 0 and tables.keyed_read(df, ["close"]).columns == ["close"]
