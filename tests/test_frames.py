"""Frames of any length and entities of any length against plain loops."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import combine, frames, ts


def values(seed, size, gaps=0.1, ties=True):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(0, 1, size), 1) if ties else rng.normal(0, 0.05, size)
    x[rng.random(size) < gaps] = np.nan
    return x


@pytest.mark.parametrize(("size", "n"), [(1, 1), (7, 3), (200, 10), (200, 150), (50, 80), (333, 64)])
def test_rank_of_a_frame(size, n):
    for gaps in (0.0, 0.02):
        x = values(size + n, size, gaps)
        got = frames.rank_kernel(x, n)["rank"]
        for i in range(size):
            w = x[max(0, i + 1 - n) : i + 1]
            if len(w) < n or np.isnan(w).any():
                assert np.isnan(got[i])
            else:
                assert got[i] == ((w < x[i]).sum() + ((w == x[i]).sum() + 1) / 2) / n


@pytest.mark.parametrize(("size", "n"), [(1, 1), (9, 4), (120, 12), (120, 100), (40, 63), (300, 37)])
def test_ratings_of_a_frame(size, n):
    for seed in range(3):
        x = values(seed, size, 0.1, ties=False)
        x[size // 2] = -1.4 if seed == 2 else x[size // 2]  # loses more than all
        got = frames.rating_kernel(x, n)
        for i in range(size):
            w = x[max(0, i + 1 - n) : i + 1]
            w = w[~np.isnan(w)]
            assert got["count"][i] == len(w) and abs(got["total"][i] - (np.prod(1 + w) - 1)) < 1e-9 and abs(got["fall"][i] - frames._fall(w)) < 1e-9
            if len(w) > 1:
                assert abs(got["mean"][i] - w.mean()) < 1e-12 and abs(got["deviation"][i] - w.std(ddof=1)) < 1e-9


def test_cost_of_a_frame_does_not_grow_with_it():
    x = values(1, 40_000, 0.0, ties=False)

    def took(kernel, n):
        out = []
        for _ in range(3):
            t = time.perf_counter()
            kernel(x, n)
            out.append(time.perf_counter() - t)
        return min(out)

    assert took(frames.rank_kernel, 2000) < 3 * took(frames.rank_kernel, 20)
    assert took(frames.rating_kernel, 5000) < 8 * took(frames.rating_kernel, 12)


def panel(spark, lengths, seed=3):
    rows = [(k, int(d), None if np.isnan(v) else float(v), float(np.sin(d))) for k, size in lengths.items() for d, v in enumerate(values(seed + len(str(k)), size, 0.03, ties=False))]
    return spark.createDataFrame(rows, "entity string, dt int, x double, m double").repartition(7)


def test_frames_go_on_over_batches(spark):
    df = panel(spark, {"a": 900, "b": 3, None: 40, "c": 500})
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        got = ts.ts_rank(df, "x", 50).orderBy("entity", "dt").collect()
        rated = combine.ratings(df, "x", 60, 0.9, "entity").orderBy("entity", "dt").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    at = {}
    for r in got:
        at.setdefault(r["entity"], []).append(np.nan if r["x"] is None else r["x"])
    want = {k: frames.rank_kernel(np.array(v), 50)["rank"] for k, v in at.items()}
    for r in got:
        assert (r["rank"] is None) == np.isnan(want[r["entity"]][r["dt"]]) and (r["rank"] is None or r["rank"] == want[r["entity"]][r["dt"]])
    for r in rated:
        w = np.array(at[r["entity"]][max(0, r["dt"] - 59) : r["dt"] + 1])
        w = w[~np.isnan(w)]
        if len(w) < 54:
            assert r["total"] is None
        else:
            total = np.prod(1 + w) - 1
            assert abs(r["total"] - total) < 1e-9 and abs(r["calm"] - total / -frames._fall(w)) < 1e-6 and abs(r["sharpe"] - w.mean() / w.std(ddof=1)) < 1e-6


def test_rows_are_numbered_over_ranges(spark):
    df = panel(spark, {"a": 700, "b": 1, None: 60, "c": 333})
    got = frames.numbered(df, "entity").collect()
    assert len(got) == 1094 and all(r["__n"] == r["dt"] for r in got)


@pytest.mark.parametrize("name", ["mean", "rank", "beta", "age", "delta", "corr"])
def test_blocks_of_time_give_the_same_values(spark, name):
    df = panel(spark, {"a": 2500, "b": 5, "c": 300})
    n = 20
    operate = {
        "mean": lambda d: d.withColumn("o", ts.ts_mean("x", n, 5)), "rank": lambda d: ts.ts_rank(d, "x", n, name="o"), "beta": lambda d: ts.rolling_beta(d, "x", "m", n).withColumn("o", F.col("idio") + F.col("beta")),
        "age": lambda d: ts.ts_argmax(d, "x", n).withColumn("o", F.col("argmax").cast("double")), "delta": lambda d: d.withColumn("o", ts.delta("x", n)), "corr": lambda d: d.withColumn("o", ts.correlation("x", "m", n)),
    }[name]
    want = {(r["entity"], r["dt"]): r["o"] for r in operate(df).collect()}
    got = {(r["entity"], r["dt"]): r["o"] for r in frames.over_blocks(df, n, operate, rows=100).collect()}
    assert got.keys() == want.keys() and sum(v is not None for v in want.values()) > 500
    for k, v in want.items():
        assert (got[k] is None) == (v is None) and (v is None or abs(got[k] - v) < 1e-9)


def test_running_values_carry_over_blocks(spark):
    df = panel(spark, {"a": 900, "b": 3}).withColumn("x", F.when(F.col("dt") == 400, -1.2).otherwise(F.col("x") / 10))
    m = df.withColumn("nav", ts.nav("x", "entity"))
    want = {(r["entity"], r["dt"]): (r["nav"], r["drawdown"]) for r in ts.drawdown(m, "nav", "entity").collect()}
    got = {(r["entity"], r["dt"]): (r["nav"], r["drawdown"]) for r in frames.nav_and_drawdown(df, "x", rows=64).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], v, rtol=1e-9, atol=1e-12) for k, v in want.items())
