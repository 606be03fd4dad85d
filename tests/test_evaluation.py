"""Universe, evaluation, generators and alignment on hand-made panels."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import access, generate, models, regress, resample, ts, universe
from panelforge.sources import tables

D = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(400)]


def panel(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ---- returns


def test_undefined_monthly_returns_are_null(spark):
    px = panel(spark, [(1, dt.date(2020, 1, 10), 10.0), (1, dt.date(2020, 3, 25), 25.0), (1, dt.date(2020, 4, 2), 20.0), (2, dt.date(2020, 5, 1), 3.0)], "entity int, dt date, close double")
    px = px.withColumns({"high": F.col("close"), "low": F.col("close"), "volume": F.lit(1.0), "amount": F.lit(2.0)})
    got = [(r["entity"], r["month_end"].month, r["ret_m"], r["ret_1m"]) for r in resample.monthly_bars(px).orderBy("entity", "month_end").collect()]
    assert got == [(1, 1, None, None), (1, 2, None, 1.5), (1, 3, 1.5, pytest.approx(-0.2)), (1, 4, pytest.approx(-0.2), None), (2, 5, None, None)]


def test_first_daily_return_is_null(spark):
    r = tables.ret_d(spark, "/root/testdata/sf0.001")
    first = r.groupBy("entity").agg(F.min("dt").alias("dt")).join(r, ["entity", "dt"])
    assert first.where("ret is not null").count() == 0 and r.where("ret is null").count() == first.count()
    s = r.agg(F.min("ret"), F.max("ret"), F.count_distinct("ret"), F.count("ret")).first()
    assert -0.5 < s[0] and s[1] < 1.0 and s[2] > 0.99 * s[3]


def test_statement_values_hold_for_their_days(spark):
    cal = panel(spark, [(d,) for d in D[:10]], "dt date")
    stmt = panel(spark, [(1, D[0], D[2], 5.0), (1, D[1], D[6], 7.0), (1, D[1], D[7], None), (2, D[0], D[9], 1.0)], "entity int, dt date, trd_dt date, x double")
    got = {(r["entity"], r["dt"]): r["x"] for r in resample.as_of_daily(stmt, cal, "x", 2).collect()}
    assert got == {**{(1, D[i]): 5.0 for i in (2, 3, 4)}, **{(1, D[i]): 7.0 for i in (6, 7, 8)}, (2, D[9]): 1.0}


def test_rolling_beta_against_numpy(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(0, 0.02, 120), rng.normal(0, 0.02, 120)
    gone = rng.random(120) < 0.3
    df = panel(spark, [(1, D[i], float(x[i]), None if gone[i] else float(y[i])) for i in range(120)], "entity int, dt date, x double, y double")
    got = ts.rolling_beta(df, "y", "x", 30).orderBy("dt").collect()
    for i in (28, 29, 60, 119):
        a, b, g = x[i - 29 : i + 1], y[i - 29 : i + 1], gone[i - 29 : i + 1]
        if i < 29 or (~g).sum() < 15:
            assert got[i]["beta"] is None
            continue
        b = np.where(g, b[~g].mean(), b)
        beta = np.cov(a, b, ddof=0)[0, 1] / a.var()
        assert got[i]["beta"] == pytest.approx(beta) and got[i]["idio"] == pytest.approx((b - b.mean() - beta * (a - a.mean())).std())


def test_rolling_beta_on_all_dates_of_the_market(spark):
    """An entity's window goes on after its last row, and begins before its first."""
    rng = np.random.default_rng(2)
    x, y = rng.normal(0, 0.02, 100), rng.normal(0, 0.02, 100)
    market = panel(spark, [(D[i], float(x[i])) for i in range(100)], "dt date, x double")
    rows = [(1, D[i], float(y[i])) for i in range(20, 70)] + [(2, D[i], float(y[i])) for i in range(100)]
    df = panel(spark, rows, "entity int, dt date, y double")
    got = {(r["entity"], r["dt"]): (r["beta"], r["idio"]) for r in ts.rolling_beta_on(df, market, "y", "x", 30, least=10).collect()}
    assert set(got) == {(e, d) for e in (1, 2) for d in D[:100]}
    for i in range(100):
        there = np.arange(max(i - 29, 20), min(i, 69) + 1)
        if i < 29 or len(there) < 10:
            assert got[1, D[i]] == (None, None)
            continue
        a, b = x[i - 29 : i + 1], np.full(30, y[there].mean())
        b[there - (i - 29)] = y[there]
        beta = np.cov(a, b, ddof=0)[0, 1] / a.var()
        assert got[1, D[i]] == (pytest.approx(beta), pytest.approx((b - b.mean() - beta * (a - a.mean())).std()))
    assert got[1, D[89]][0] is not None and got[1, D[90]][0] is None
    assert ts.rolling_beta_on(df, market.limit(0), "y", "x", 30).count() == 0


# ---- universe and trading


def test_universe_and_tradability(spark):
    rows = [(1, D[0], 10.0, None, False, 3, False), (1, D[1], 11.0, None, False, 3, False), (1, D[2], 11.1, None, False, 3, True), (2, D[0], 5.0, True, False, 3, False),
            (3, D[0], 5.0, None, True, 3, False), (4, D[0], 5.0, False, None, None, False)]
    df = panel(spark, rows, "entity int, dt date, close double, type_st boolean, young boolean, industry int, suspended boolean")
    assert sorted((r["entity"], r["dt"]) for r in universe.universe(df).collect()) == [(1, D[0]), (1, D[1]), (1, D[2])]
    flags = universe.tradable(df)
    assert {(r["entity"], r["dt"]): r["can_buy"] for r in flags.collect()}[1, D[1]] is False
    trades = panel(spark, [(D[0], 1, 0.5, "buy"), (D[1], 1, -0.5, "sell"), (D[3], 1, 0.1, "buy"), (D[2], 1, 0.0, "keep")], "dt date, entity int, delta double, side string")
    assert {r["dt"]: r["done"] for r in universe.executed(trades, flags).collect()} == {D[0]: 0.5, D[1]: 0.0, D[3]: 0.0, D[2]: 0.0}


def test_appended_signals_are_those_of_the_whole(spark):
    rng = np.random.default_rng(3)
    df = panel(spark, [(e, D[i], float(rng.normal())) for i in range(90) for e in range(6)], "entity int, dt date, x double")
    from panelforge.operators import xs

    whole = {(r["entity"], r["dt"]): r["signal"] for r in xs.signal(df, "x", 5).collect()}
    tail = {(r["entity"], r["dt"]): r["signal"] for r in universe.signal_after(df, "x", 6, D[80]).collect()}
    assert tail == {k: v for k, v in whole.items() if k[1] > D[80]} and len(tail) == 54


def test_weighted_slopes_against_numpy(spark):
    rng = np.random.default_rng(5)
    x, y, w = rng.normal(size=30), rng.normal(size=30), rng.uniform(1, 9, 30)
    df = panel(spark, [(D[0], float(a), float(b), float(c)) for a, b, c in zip(x, y, w, strict=True)] + [(D[0], None, 1.0, 1.0), (D[1], 1.0, 2.0, 1.0)], "dt date, x double, y double, w double")
    got = {r["dt"]: r for r in universe.weighted_slopes(df, "x", "y", "w").collect()}
    design = np.column_stack([np.ones(30), x])
    for root, names in ((True, ("slope_root",)), (False, ("intercept", "slope"))):
        q = np.sqrt(w) if root else w
        coef = np.linalg.solve(design.T * q @ design, design.T * q @ y)
        e = y - design @ coef
        if root:
            assert got[D[0]]["slope_root"] == pytest.approx(coef[1]) and got[D[0]]["t_root"] == pytest.approx(coef[1] * np.sqrt(30) * x.std() / np.sqrt((e**2).sum() / 28))
        else:
            se = np.sqrt(np.diag(np.linalg.inv(design.T * q @ design)) * (q * e**2).sum() / 28)
            assert [got[D[0]][n] for n in names] == pytest.approx(list(coef)) and [got[D[0]]["t_intercept"], got[D[0]]["t"]] == pytest.approx(list(coef / se))
    assert got[D[1]]["slope"] is None and got[D[1]]["t"] is None


def test_layers_and_their_description(spark):
    rows = [(e, D[31 * m], float(e), 0.01 * e if m else -0.5) for m in range(3) for e in range(1, 5)]
    df = panel(spark, rows, "entity int, dt date, x double, ret double")
    bench = panel(spark, [(D[0], 0.0), (D[31], 0.01), (D[62], None)], "dt date, bench double")
    la = universe.layers(df, "x", "ret", 2, bench)
    assert la.count() == 4
    top = {r["bucket"]: r for r in universe.describe_layers(la).collect()}[2]
    assert top["total"] == pytest.approx(0.5 * 1.035 - 1) and top["max_drawdown"] == 0.0 and top["rela_max_drawdown"] == 0.0 and top["n"] == 2


# ---- generators and bootstraps


def test_families_agree_with_single_operators(spark):
    rng = np.random.default_rng(7)
    df = panel(spark, [(e, D[i], float(rng.normal(5, 4)), float(rng.normal(9, 3))) for e in (1, 2) for i in range(24)], "entity int, dt date, a double, b double")
    fam = {(r["indicator"], r["entity"], r["dt"]): r["value"] for r in generate.quarterly_family(df, ["a"], ["b"]).collect()}
    assert len(fam) == 2 * 24 * (6 * 2 + 9)
    for name, f in generate.TWO.items():
        for r in f(df, "a", "b", "v", 8).collect():
            got = fam[f"{name}__a__b", r["entity"], r["dt"]]
            assert got == r["v"] or got == pytest.approx(r["v"])
    sheet = generate.from_rows(df, [{"type": "Q", "name": "n", "numerator": "a - b", "denominator": "b", "function": "ratio"}])
    assert {r["indicator"] for r in sheet.collect()} == {"Q__n"}
    with pytest.raises(ValueError):
        generate.from_rows(df, [{"type": "Q", "name": "n", "numerator": "a", "denominator": "", "function": "__import__"}])


def test_shared_draws_keep_cross_section(spark):
    """Two entities with equal returns keep equal alphas when a draw is shared."""
    rng = np.random.default_rng(2)
    m, y = rng.normal(size=40), rng.normal(size=40)
    df = panel(spark, [(e, D[i], float(y[i]), float(m[i])) for e in (1, 2) for i in range(40)], "entity int, dt date, y double, x double")
    a = {}
    for r in regress.bootstrap_cross_section(df, "y", "x", 5).collect():
        a.setdefault(r["rep"], []).append(r["alpha"])
    assert len(a) == 5 and all(v[0] == pytest.approx(v[1]) for v in a.values())
    free = {}
    for r in regress.bootstrap_residual_and_factor(df, "y", "x", 5, on_drawn=True).collect():
        free.setdefault(r["rep"], []).append(r["alpha"])
    assert any(v[0] != pytest.approx(v[1]) for v in free.values())


def test_survival_of_f():
    """Against the integral of the density, and two points of F tables."""
    from math import lgamma, log

    def density(x, a, b):
        return np.exp(lgamma((a + b) / 2) - lgamma(a / 2) - lgamma(b / 2) + a / 2 * log(a / b) + (a / 2 - 1) * np.log(x) - (a + b) / 2 * np.log1p(a / b * x))

    for f, a, b in ((0.3, 2, 7), (1.0, 4, 30), (2.4205, 5, 45), (1.8307, 10, 120), (6.0, 3, 9)):
        x = np.linspace(1e-9, f, 400_001)
        assert models.f_survival(f, a, b) == pytest.approx(1 - np.trapezoid(density(x, a, b), x), abs=1e-6)
    assert models.f_survival(161.4476, 1, 1) == pytest.approx(0.05, abs=2e-5) and models.f_survival(4.9646, 1, 10) == pytest.approx(0.05, abs=2e-5)
    assert models.f_survival(0.0, 3, 9) == 1.0 and np.isnan(models.f_survival(float("nan"), 1, 2))


def test_scaled_intercepts_of_a_perfect_candidate(spark):
    rng = np.random.default_rng(4)
    f = rng.normal(0.5, 1, 60)
    rows = [("c", a, D[i], float(a * f[i] + 0.001 * rng.normal()), float(f[i])) for a in (1, 2, 3) for i in range(60)]
    got = regress.scaled_intercepts(panel(spark, rows, "candidate string, asset int, dt date, y double, x double"), "y", "x").first()
    assert got["si_mean"] < -0.98 and got["si_median"] < -0.98


# ---- names, types and alignment


def test_types_names_and_sizes(spark):
    df = panel(spark, [("1.5", "20200131.0", "T_size_smooth20_p", "1.5K"), ("x", "no", "odd", "9 TB"), (None, None, None, None)], "n string, d string, strategy string, size string")
    got = access.adjust_types(df, ["n"], ["d"]).select("n", "d", *[c.alias(k) for k, c in access.name_parts().items()], access.bytes_of("size").alias("bytes")).collect()
    assert tuple(got[0]) == (1.5, dt.date(2020, 1, 31), "T", "size", 20, 1, 1536) and got[1]["n"] is None and got[1]["d"] is None and got[1]["bytes"] is None and got[1]["smooth"] is None


def test_unique_keys(spark):
    df = panel(spark, [(1, 2), (1, 1), (2, 5)], "k int, v int")
    assert sorted(map(tuple, access.keep_first(df, ["k"], "v").collect())) == [(1, 1), (2, 5)]
    assert access.check_unique(df.where("v <> 1"), "k").count() == 2
    for bad in (df, panel(spark, [(None, 1)], "k int, v int")):
        with pytest.raises(ValueError):
            access.check_unique(bad, "k")


def test_forward_as_of_and_frames(spark):
    a = panel(spark, [(1, D[0], 1.0), (1, D[5], 2.0), (2, D[9], 3.0)], "entity int, dt date, x double")
    b = panel(spark, [(1, D[3], 7.0), (1, D[5], None), (2, D[1], 9.0)], "entity int, dt date, v double")
    assert sorted((r["x"], r["v"]) for r in access.forward_as_of(a, b, "v").where("v is not null").collect()) == [(1.0, 7.0)]
    x, y = access.union_frame(a, b.withColumnRenamed("v", "x"), "x")
    assert x.count() == y.count() == 5 * 2 and x.where("x is not null").count() == 3


def test_skipped_rows_of_delimited_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("k\tv\nkey\tvalue\nunit\tkg\n7\t1.5\n\t2.5\n8\tx\n")
    rows = tables.delimited(spark, str(tmp_path / "a.txt"), "k int, v double", skip=2).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(7, 1.5), (None, 2.5), (8, None)], key=str)


def test_tables_that_hold_a_key_are_left(spark, tmp_path):
    path = str(tmp_path / "t")
    df = panel(spark, [("a", 1), ("b", 2)], "k string, v int")
    tables.store_missing(df.where("k = 'a'"), path, "k")
    tables.store_missing(df.withColumn("v", F.col("v") + 10), path, "k")
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 12)]
    listing = access.column_listing({"t": df}, panel(spark, [("v", "number")], "field string, category string"))
    assert sorted((r["field"], r["type"], r["category"]) for r in listing.collect()) == [("k", "string", None), ("v", "int", "number")]
    with pytest.raises(FileNotFoundError):
        access.first_found(spark, [path], "none")


def test_many_missing_keys_are_few_files(spark, tmp_path):
    path, parts = tmp_path / "t", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = spark.range(300).selectExpr("id as k", "cast(id as int) as v").unionByName(panel(spark, [(None, -1)], "k long, v int"))
    tables.store_missing(df.where("k % 2 = 0 or k is null"), str(path), "k")
    for _ in range(2):
        tables.store_missing(df.selectExpr("cast(k as int) as k", "-v as v"), str(path), "k")
    assert len(list(path.rglob("*.parquet"))) <= 3 * parts
    got = spark.read.parquet(str(path))
    assert got.dtypes == [("v", "int"), ("k", "bigint")]
    assert sorted((r["k"], r["v"]) for r in got.where("k is not null").collect()) == [(k, -k if k % 2 else k) for k in range(300)]
    assert [r["v"] for r in got.where("k is null").collect()] == [-1]


def test_missing_keys_of_an_empty_table(spark, tmp_path):
    path, df = str(tmp_path / "t"), panel(spark, [(1, 1), (2, 2)], "k int, v int")
    for few in (df.where("false"), df.where("k = 1"), df):
        tables.store_missing(few, path, "k")
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, 1), (2, 2)]


def test_missing_keys_of_a_table_with_folders(spark, tmp_path):
    path, df = str(tmp_path / "t"), panel(spark, [(1, 1), (2, 2)], "k int, v int")
    tables.store(df.where("k = 1"), path, "k")
    tables.store_missing(df.withColumn("v", F.col("v") + 10), path, "k")
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, 1), (2, 12)]


def test_column_store_and_bundle(spark, tmp_path):
    df = panel(spark, [(1, D[0], 1.0, 2), (1, D[1], None, 3)], "entity int, dt date, a double, b int")
    tables.column_store(df, str(tmp_path / "c"), "a", "b")
    assert sorted(map(tuple, tables.columns_of(spark, str(tmp_path / "c"), "b", "a").collect())) == [(1, D[0], 2.0, 1.0), (1, D[1], 3.0, None)]
    assert tables.columns_of(spark, str(tmp_path / "c"), "b").columns == ["entity", "dt", "b"]
    one, two = (panel(spark, [(s, v)], "strategy string, x int") for s, v in (("s", 1), ("t", 2)))
    for frame in (one, two, one.withColumn("x", F.col("x") + 5)):
        tables.store_bundle({"nav": frame, "costs": frame}, str(tmp_path / "b"))
    assert sorted((r["strategy"], r["x"]) for r in spark.read.parquet(str(tmp_path / "b" / "nav")).collect()) == [("s", 6), ("t", 2)]


def test_dated_marks(spark):
    from panelforge.operators import clean

    docs = panel(spark, [(1, "on 2020.01.02\nAcme : 3\nOther : 4\nAcme : 5"), (2, "2020.01.02 Acme : 7"), (3, "no date Acme : 1"), (4, None)], "doc_id int, text string")
    names = panel(spark, [("Acme", "c1")], "name string, code string")
    got = clean.dated_marks(docs, names, r"(\S+)\s:\s(\d+)", r"(\d{4}.\d{2}.\d{2})")
    assert sorted((r["date"], r["code"], r["mark"], r["doc_id"]) for r in got.collect()) == [("", "c1", "1", 3), ("2020.01.02", "c1", "7", 2)]


def test_correlations_of_all_pairs_of_series(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 11)) + 1e6 * np.arange(11)
    x[:, 4], x[:, 5] = 0.1, -2 * x[:, 3]
    rows = [(s, dt.date(2020, 1, 1) + dt.timedelta(d), float(x[d, s])) for d in range(700) for s in range(11) if not (s == 2 and d % 50 == 7)]
    df = spark.createDataFrame([*rows, (1, dt.date(2019, 1, 1), 5.0), (1, dt.date(2019, 1, 2), None)], "s int, day date, x double")
    got = {(r["a"], r["b"]): r for r in universe.pair_correlations(df, "x", "s", "day", width=4).collect()}
    full = x[[d for d in range(700) if d % 50 != 7]]
    assert got.keys() == {(a, b) for a in range(11) for b in range(a + 1, 11)} and {r["n"] for r in got.values()} == {len(full)}
    for (a, b), r in got.items():
        assert r["corr"] is None if 4 in (a, b) else r["corr"] == pytest.approx(np.corrcoef(full[:, a], full[:, b])[0, 1], abs=1e-9)
    assert universe.pair_correlations(df.where("false"), "x", "s", "day").count() == 0
