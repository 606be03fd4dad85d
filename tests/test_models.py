"""Regressions on several factors, models and combinations against numpy, on small panels."""

import datetime as dt

import numpy as np
import pytest

from panelforge.operators import combine, models
from panelforge.plans import factor

DAYS = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(40)]


@pytest.fixture(scope="module")
def returns():
    rng = np.random.default_rng(5)
    market = rng.normal(0, 1, len(DAYS))
    series = {k: 0.5 * market + rng.normal(0.4 if k == "e" else 0.0, 1, len(DAYS)) for k in "abcde"}
    return market, series


def long(spark, market, series):
    rows = [(k, d, float(v[i]), float(market[i])) for k, v in series.items() for i, d in enumerate(DAYS)]
    return spark.createDataFrame(rows, "series string, dt date, x double, mkt double")


def fit(y, *xs):
    design = np.column_stack([np.ones(len(y)), *xs])
    coef = np.linalg.lstsq(design, y, rcond=None)[0]
    res = y - design @ coef
    cov = np.linalg.inv(design.T @ design) * (res @ res) / (len(y) - design.shape[1])
    return coef, coef / np.sqrt(np.diag(cov)), res


def test_several_factors(spark, returns):
    market, series = returns
    rows = [("k", float(series["b"][i]), float(market[i]), float(series["a"][i])) for i in range(len(DAYS))]
    rows += [("gap", 1.0, None, 1.0), ("flat", 1.0, 2.0, 2.0), ("flat", 2.0, 3.0, 3.0), ("flat", 1.5, 1.0, 1.0), ("flat", 0.0, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "k string, y double, m double, a double")
    got = {r["k"]: r for r in models.ols_multi(df, "y", ["m", "a"], "k").collect()}
    coef, t, _ = fit(series["b"], market, series["a"])
    assert set(got) == {"k", "flat"} and got["flat"]["alpha"] is None
    assert np.allclose([got["k"]["alpha"], *got["k"]["betas"]], coef) and np.allclose([got["k"]["alpha_t"], *got["k"]["ts"]], t)


def test_spanning(spark, returns):
    market, series = returns
    df = spark.createDataFrame([(1, float(market[i]), float(series["a"][i]), float(series["e"][i])) for i in range(len(DAYS))], "k int, m double, a double, e double")
    got = models.spanning_test(df, ["a", "e"], ["m"], "k").first()
    n, fits = len(DAYS), [fit(series[k], market) for k in "ae"]
    alpha, res = np.array([f[0][0] for f in fits]), np.column_stack([f[2] for f in fits])
    want = (n - 3) / 2 * alpha @ np.linalg.inv(res.T @ res / n) @ alpha / (1 + market.mean() ** 2 / market.var())
    assert got["n"] == n and abs(got["f"] - want) < 1e-9
    assert models.spanning_test(df.limit(2), ["a", "e"], ["m"], "k").first()["f"] is None


def test_components(spark, returns):
    market, series = returns
    got = models.principal_components(long(spark, market, series), "x", 2).orderBy("component", "series").collect()
    share, vectors = np.linalg.eigh(np.cov(np.stack([series[k] for k in "abcde"])))
    for c in (1, 2):
        v = vectors[:, -c] * np.sign(vectors[np.argmax(np.abs(vectors[:, -c])), -c])
        mine = [r for r in got if r["component"] == c]
        assert np.allclose([r["loading"] for r in mine], v) and np.allclose(mine[0]["share"], share[-c] / share.sum())


def test_matched_counts(spark, returns):
    market, series = returns
    df = long(spark, market, series)
    # a date on which one series is missing belongs to no regression
    df = df.unionByName(df.where("series = 'a'").limit(1).selectExpr("series", "date'2021-01-01' AS dt", "99.0D AS x", "9.0D AS mkt"))
    got = {(r["f1"], r["f2"]): (r["matched"], r["assets"]) for r in models.matched_counts(df, "x", "mkt").collect()}
    want = {}
    for i, a in enumerate("abcde"):
        for b in "abcde"[i + 1 :]:
            rest = [k for k in "abcde" if k not in (a, b)]
            want[a, b] = (sum(abs(fit(series[k], market, series[a], series[b])[1][0]) < 1.96 for k in rest), 3)
    assert got == want and len({m for m, _ in got.values()}) > 1
    priced = {}
    for i, a in enumerate("abcde"):
        for b in "abcde"[i + 1 :]:
            for y in set("abcde") - {a, b}:
                priced[a, b, y] = abs(fit(series[y], market, series[a], series[b])[1][0]) < 1.96
    rare = {y: 1 - np.mean([v for k, v in priced.items() if k[2] == y]) for y in "abcde"}
    weighted = {m: sum(v * rare[k[2]] for k, v in priced.items() if k[:2] == m) / 3 for m in want}
    out = {(r["f1"], r["f2"]): r for r in models.rarity_performance(models.model_alphas(df, "x", "mkt")).collect()}
    assert all(abs(out[m]["share"] - v) < 1e-9 and abs(out[m]["place"] - np.mean([round(w, 9) <= round(v, 9) for w in weighted.values()])) < 1e-9 for m, v in weighted.items())
    places = [r["place"] for r in models.model_performance(models.matched_counts(df, "x", "mkt")).collect()]
    assert len(places) == 10 and max(places) == 1.0


def test_simulated_matches(spark, returns):
    """Shares of matched counts over replicates against a loop over the same draws."""
    import xxhash

    market, series = returns
    df, n, reps = long(spark, market, series), len(DAYS), 4
    got = {(r["planted"], r["matched"]): r for r in models.simulated_matches(df, "x", "mkt", [0, 2], reps).collect()}
    real = {k: fit(series[k], market) for k in "abcde"}
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    shares = {}
    for rep in range(reps):
        v = (rep * 1000003 + np.arange(n) * 7919 + 7) % 2147483647
        for m in (48271, 69621, 16807):
            v = (v * m + 12345) % 2147483647
            v = v * (v % 65521 + 1) % 2147483647
        at = v % n
        lot = lambda k, rep=rep: signed(xxhash.xxh64_intdigest(k.encode(), xxhash.xxh64_intdigest(int(rep).to_bytes(8, "little"), xxhash.xxh64_intdigest((7).to_bytes(4, "little"), 42))))
        order = sorted("abcde", key=lot)
        for planted in (0, 2):
            x = {}
            for i, k in enumerate(order):
                (alpha, _), (t, _), _ = real[k]
                shift = 3 * abs(alpha / t) * (1 if i % 2 == 0 else -1) if i < planted else 0.0
                x[k] = series[k][at] - alpha + shift
            counts = [sum(abs(fit(x[y], market[at], x[a], x[b])[1][0]) < 1.96 for y in set("abcde") - {a, b}) for i, a in enumerate("abcde") for b in "abcde"[i + 1 :]]
            for c in range(4):
                shares.setdefault((planted, c), []).append(counts.count(c) / 10)
    base = [sum(abs(fit(series[y], market, series[a], series[b])[1][0]) < 1.96 for y in set("abcde") - {a, b}) for i, a in enumerate("abcde") for b in "abcde"[i + 1 :]]
    assert {p for p, _ in got} == {0, 2}
    for (planted, c), r in got.items():
        assert np.allclose([r["low"], r["mid"], r["high"]], np.quantile(shares[planted, c], [0.05, 0.5, 0.95])) and r["real"] == base.count(c) / 10


def test_sparse_series_takes_no_dates_from_others(spark, returns):
    """Series f has a value on two dates, d on every third: each regression and covariance keeps its own dates."""
    market, series = returns
    have = {k: np.ones(len(DAYS), bool) for k in "abcde"} | {"f": np.arange(len(DAYS)) < 2}
    have["d"] = np.arange(len(DAYS)) % 3 == 0
    series = series | {"f": series["a"] + 1.0}
    rows = [(k, d, float(v[i]), float(market[i])) for k, v in series.items() for i, d in enumerate(DAYS) if have[k][i]]
    df = spark.createDataFrame(rows, "series string, dt date, x double, mkt double")
    want = {}
    for i, a in enumerate("abcdef"):
        for b in "abcdef"[i + 1 :]:
            matched = 0
            for y in set("abcdef") - {a, b}:
                on = have[a] & have[b] & have[y]
                if on.sum() > 4:
                    matched += abs(fit(series[y][on], market[on], series[a][on], series[b][on])[1][0]) < 1.96
            want[a, b] = (matched, 4)
    got = models.matched_counts(df, "x", "mkt")
    assert {(r["f1"], r["f2"]): (r["matched"], r["assets"]) for r in got.collect()} == want
    assert max(r["share"] for r in models.model_performance(got).collect()) > 0
    cov = np.zeros((6, 6))
    for i, a in enumerate("abcdef"):
        for j, b in enumerate("abcdef"):
            on = have[a] & have[b]
            cov[i, j] = np.cov(series[a][on], series[b][on])[0, 1] if on.sum() > 1 else 0.0
    share, vectors = np.linalg.eigh(cov)
    v = vectors[:, -1] * np.sign(vectors[np.argmax(np.abs(vectors[:, -1])), -1])
    first = models.principal_components(df, "x", 1).orderBy("series").collect()
    assert np.allclose([r["loading"] for r in first], v) and np.allclose(first[0]["share"], share[-1] / share.sum())


def test_bootstraps_of_the_full_count(spark, returns, monkeypatch):
    """p-values and bands of 1000 replicates against a loop over the same draws."""
    market, series = returns
    rows = [(k, d, float(series[c][i]), float(market[i])) for k, c in enumerate("ae") for i, d in enumerate(DAYS)]
    z = spark.createDataFrame(rows, "entity int, dt date, ret_m double, mkt double")
    monkeypatch.setattr(factor, "_mk", lambda s, d: z)
    n, t = len(DAYS), np.empty((1000, 2))
    for rep in range(1000):
        v = (rep * 1000003 + np.arange(n) * 7919 + 7) % 2147483647
        for m in (48271, 69621, 16807):
            v = (v * m + 12345) % 2147483647
            v = v * (v % 65521 + 1) % 2147483647
        k = v % n
        for e, c in enumerate("ae"):
            alpha = fit(series[c], market)[0][0]
            t[rep, e] = fit(series[c][k] - alpha, market[k])[1][0]
    real = np.array([fit(series[c], market)[1][0] for c in "ae"])
    p = {r["entity"]: r["p"] for r in factor.QUERIES["bst8_bootstrap_p_1000"](spark, "").collect()}
    below, upto = (t.round(4) < real.round(4)).sum(axis=0), (t.round(4) <= real.round(4)).sum(axis=0)
    assert np.allclose([p[0], p[1]], (below + upto + (upto > below)) / 2000, atol=0.0011)
    bands = factor.QUERIES["bst7_replicate_bands_1000"](spark, "").orderBy("point").collect()
    q = np.quantile(t, [0.05, 0.5, 0.95], axis=1)
    assert np.allclose([r["low"] for r in bands], np.quantile(q, 0.05, axis=1), atol=1e-4)
    assert np.allclose([r["high"] for r in bands], np.quantile(q, 0.95, axis=1), atol=1e-4)
    assert np.allclose([r["p"] for r in bands], (q >= np.quantile(real, [0.05, 0.5, 0.95])[:, None]).mean(axis=1), atol=0.0011)


def test_ratings_need_coverage_and_see_the_first_fall(spark):
    rows = [("s", d, v) for d, v in zip(DAYS, [-0.5, 1.0, None, 0.1], strict=False)]
    got = combine.ratings(spark.createDataFrame(rows, "s string, dt date, r double"), "r", 2, 0.95, "s").orderBy("dt").collect()
    assert [r["total"] for r in got] == [None, 0.0, None, None] and got[1]["calm"] == 0.0


def test_weights_add_up(spark):
    rows = [("c", "x", 1, 0.5), ("c", "x", 2, 0.7), ("c", "y", 1, 0.3), ("c", "z", 1, -1.0)]
    df = spark.createDataFrame(rows, "cat string, name string, v int, score double")
    got = {r["name"]: (r["v"], round(r["weight"], 6)) for r in combine.choose(df, "score", "name", "cat", 3, "score").collect()}
    assert got == {"x": (2, 0.7), "y": (1, 0.3)}


def test_mixed_signal_holds_after_its_date(spark):
    signals = spark.createDataFrame([("i", 1, DAYS[k], 2.0) for k in range(4)], "indicator string, entity int, dt date, value double")
    weights = spark.createDataFrame([(DAYS[0], "i", 1.0), (DAYS[2], "i", 3.0)], "rebalance date, indicator string, weight double")
    got = combine.mixed_signal(signals, weights).orderBy("dt").collect()
    assert [(r["dt"], r["value"]) for r in got] == [(DAYS[1], 2.0), (DAYS[2], 2.0), (DAYS[3], 6.0)]
