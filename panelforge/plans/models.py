"""Queries of regressions on several factors, models, combinations, events and further indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.core import by_entity, ratio
from panelforge.operators import clean as cl
from panelforge.operators import combine as cb
from panelforge.operators import models as md
from panelforge.operators import resample as rs
from panelforge.operators import ts
from panelforge.plans.base_sql import FDMT, PXD, PXM, RETD, WE
from panelforge.sources import tables as t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def r(x, digits: int = 6):
    return F.round(x, digits)


# ---- strategies: the industries' mean monthly returns

_ST = FDMT + """, x AS (SELECT *, ret_m AS rm FROM fdmt WHERE ret_m IS NOT NULL), mk AS (SELECT dt, avg(rm) AS mkt FROM x GROUP BY 1),
big AS (SELECT *, percent_rank() OVER (PARTITION BY dt ORDER BY cap) AS pc FROM x), sz AS (SELECT dt, avg(rm) FILTER (WHERE pc < 0.5) - avg(rm) FILTER (WHERE pc >= 0.5) AS smb FROM big GROUP BY 1),
st AS (SELECT sector, industry, x.dt, avg(rm) AS ret FROM x GROUP BY 1, 2, 3)"""


def _x(s, d):
    return t.fdmt_m(s, d).where("ret_m is not null").withColumn("rm", F.col("ret_m"))


def _st(s, d):
    return _x(s, d).groupBy("sector", "industry", "dt").agg(F.avg("rm").alias("ret"))


def _factors(s, d):
    """Market and small-minus-big per month."""
    from pyspark.sql import Window

    big = _x(s, d).withColumn("pc", F.percent_rank().over(Window.partitionBy("dt").orderBy("cap")))
    part = lambda c: F.avg(F.when(c, F.col("rm")))
    return big.groupBy("dt").agg(F.avg("rm").alias("mkt"), (part(F.col("pc") < 0.5) - part(F.col("pc") >= 0.5)).alias("smb"))


@add("reg1_two_factors", f"""WITH {_ST}, z AS (SELECT entity, rm AS y, mkt AS a, smb AS b FROM x JOIN mk ON mk.dt = x.dt JOIN sz ON sz.dt = x.dt WHERE smb IS NOT NULL),
g AS (SELECT entity, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, regr_sxx(y, a) AS saa, regr_sxx(y, b) AS sbb, regr_sxy(b, a) AS sab, regr_sxy(y, a) AS say, regr_sxy(y, b) AS sby, regr_syy(y, a) AS syy FROM z GROUP BY 1),
h AS (SELECT *, (sbb * say - sab * sby) / (saa * sbb - sab * sab) AS b1, (saa * sby - sab * say) / (saa * sbb - sab * sab) AS b2 FROM g WHERE n > 3),
k AS (SELECT *, my - b1 * ma - b2 * mb AS alpha, greatest(syy - b1 * say - b2 * sby, 0) AS rss FROM h)
SELECT entity, n, round(alpha, 6) + 0.0 AS alpha, round(alpha / sqrt(rss / (n - 3) * (1.0 / n + (ma * ma * sbb - 2 * ma * mb * sab + mb * mb * saa) / (saa * sbb - sab * sab))), 4) + 0.0 AS t, round(b1, 5) + 0.0 AS beta_mkt, round(b2, 5) + 0.0 AS beta_smb, round(1 - rss / syy, 5) + 0.0 AS r2 FROM k""")
def reg1b(s, d):
    z = _x(s, d).join(_factors(s, d), "dt").select("entity", "rm", "mkt", "smb")
    o = md.ols_multi(z, "rm", ["mkt", "smb"], "entity").where("n > 3")
    return o.select("entity", "n", r("alpha").alias("alpha"), r("alpha_t", 4).alias("t"), r(F.col("betas")[0], 5).alias("beta_mkt"), r(F.col("betas")[1], 5).alias("beta_smb"), r("r2", 5).alias("r2"))


def _series(s, d):
    x = t.stored(_x(s, d), "panel")
    st, mk = x.groupBy("sector", "industry", "dt").agg(F.avg("rm").alias("ret")), x.groupBy("dt").agg(F.avg("rm").alias("mkt"))
    return st.join(mk, "dt").select(F.col("industry").cast("string").alias("series"), "dt", "ret", "mkt")


def _spanning_sql(assets: int) -> str:
    """The table of moments of factors, assets and 1 is reduced a variable at a time; what is left of the 1 after the
    factors, and after the assets too, gives the F. With an even number of assets its tail is a finite sum."""
    names = ["mkt", "smb", *[f"a{i}" for i in range(assets)], "1.0"]
    wide = ", ".join(f"max(CASE WHEN sector = {i} THEN ret END) AS a{i}" for i in range(assets))
    full = " AND ".join(f"a{i} IS NOT NULL" for i in range(assets))
    long = ", ".join(f"({i}, {c})" for i, c in enumerate(names))
    out = f"""WITH {_ST}, sc AS (SELECT sector, dt, avg(rm) AS ret FROM x GROUP BY 1, 2), wd AS (SELECT w.*, mkt, smb FROM (SELECT dt, {wide} FROM sc GROUP BY dt) w JOIN mk ON mk.dt = w.dt JOIN sz ON sz.dt = w.dt WHERE smb IS NOT NULL AND {full}),
lo AS (SELECT dt, i, v FROM wd, LATERAL (VALUES {long}) AS t(i, v)), m0 AS (SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM lo a JOIN lo b ON b.dt = a.dt GROUP BY 1, 2)"""
    for k in range(len(names) - 1):
        out += f", m{k + 1} AS (SELECT a.i, a.j, a.v - b.v * c.v / p.v AS v FROM m{k} a JOIN m{k} b ON b.i = a.i AND b.j = {k} JOIN m{k} c ON c.i = {k} AND c.j = a.j JOIN m{k} p ON p.i = {k} AND p.j = {k} WHERE a.i > {k} AND a.j > {k})"
    last = len(names) - 1
    return out + f", f AS (SELECT (SELECT count(*) FROM wd) AS n, ((SELECT v FROM m2 WHERE i = {last} AND j = {last}) / (SELECT v FROM m{last}) - 1) AS g)"


def _spanning(s, d, assets):
    sectors = _x(s, d).groupBy("sector", "dt").agg(F.avg("rm").alias("ret"))
    wide = sectors.groupBy("dt").pivot("sector", [0, 1, 2, 3, 4]).agg(F.first("ret")).join(_factors(s, d), "dt")
    wide = wide.select("dt", "mkt", "smb", *[F.col(str(i)).alias(f"a{i}") for i in range(5)])
    return md.spanning_test(wide.withColumn("study", F.lit("sectors")), [f"a{i}" for i in range(assets)], ["mkt", "smb"], "study")


@add("reg9_spanning_test", _spanning_sql(4) + " SELECT 'sectors' AS study, n, round((n - 6) / 4.0 * g, 6) AS f, round(pow(1 / (1 + g), (n - 6) / 2.0) * (1 + (n - 6) / 2.0 * (1 - 1 / (1 + g))), 6) AS p FROM f")
def reg9(s, d):
    return _spanning(s, d, 4).select("study", "n", r("f").alias("f"), r("p").alias("p"))


@add("reg9_spanning_test_all_sectors", _spanning_sql(5) + " SELECT 'sectors' AS study, n, round((n - 7) / 5.0 * g, 5) AS f FROM f")
def reg9b(s, d):
    return _spanning(s, d, 5).select("study", "n", r("f", 5).alias("f"))


# spectral: checked against numpy in tests/test_models.py
@add("reg10_principal_components", None)
def reg10(s, d):
    x = _series(s, d)
    return md.principal_components(x, "ret", 3).select("component", "series", r("loading").alias("loading"), r("share").alias("share"))


# three regressors in closed form, over every model and asset: the inverse of the covariance of market and two series
_TRI = _ST + """, sr AS (SELECT CAST(industry AS VARCHAR) AS s, st.dt, ret, mkt FROM st JOIN mk ON mk.dt = st.dt), tri AS (SELECT a.s AS f1, b.s AS f2, y.s AS asset, a.mkt AS m, a.ret AS u, b.ret AS v, y.ret AS y FROM sr a JOIN sr b ON b.dt = a.dt AND b.s > a.s JOIN sr y ON y.dt = a.dt AND y.s <> a.s AND y.s <> b.s),
cv AS (SELECT f1, f2, asset, count(*) AS n, avg(m) AS m1, avg(u) AS m2, avg(v) AS m3, avg(y) AS my, var_pop(m) AS s11, var_pop(u) AS s22, var_pop(v) AS s33, covar_pop(m, u) AS s12, covar_pop(m, v) AS s13, covar_pop(u, v) AS s23,
  covar_pop(m, y) AS c1, covar_pop(u, y) AS c2, covar_pop(v, y) AS c3, var_pop(y) AS syy FROM tri GROUP BY 1, 2, 3),
dt3 AS (SELECT *, s11 * (s22 * s33 - s23 * s23) - s12 * (s12 * s33 - s13 * s23) + s13 * (s12 * s23 - s13 * s22) AS det FROM cv),
iv AS (SELECT *, (s22 * s33 - s23 * s23) / det AS i11, (s13 * s23 - s12 * s33) / det AS i12, (s12 * s23 - s13 * s22) / det AS i13, (s11 * s33 - s13 * s13) / det AS i22, (s12 * s13 - s11 * s23) / det AS i23, (s11 * s22 - s12 * s12) / det AS i33 FROM dt3 WHERE det <> 0 AND n > 4),
be AS (SELECT *, i11 * c1 + i12 * c2 + i13 * c3 AS b1, i12 * c1 + i22 * c2 + i23 * c3 AS b2, i13 * c1 + i23 * c2 + i33 * c3 AS b3 FROM iv),
tv AS (SELECT f1, f2, asset, (my - b1 * m1 - b2 * m2 - b3 * m3) / nullif(sqrt(greatest(syy - b1 * c1 - b2 * c2 - b3 * c3, 0) * n / (n - 4) * (1 + m1 * (i11 * m1 + i12 * m2 + i13 * m3) + m2 * (i12 * m1 + i22 * m2 + i23 * m3) + m3 * (i13 * m1 + i23 * m2 + i33 * m3)) / n), 0) AS t FROM be),
nm AS (SELECT DISTINCT s FROM sr), pr AS (SELECT a.s AS f1, b.s AS f2, y.s AS asset, CASE WHEN abs(t) < 1.96 THEN 1 ELSE 0 END AS p FROM nm a JOIN nm b ON b.s > a.s JOIN nm y ON y.s <> a.s AND y.s <> b.s LEFT JOIN tv ON tv.f1 = a.s AND tv.f2 = b.s AND tv.asset = y.s),
mt AS (SELECT f1, f2, CAST(sum(p) AS BIGINT) AS matched, count(*) AS assets FROM pr GROUP BY 1, 2)"""


@add("reg10_covariances", f"WITH {_ST}, sr AS (SELECT CAST(industry AS VARCHAR) AS s, st.dt, ret FROM st JOIN mk ON mk.dt = st.dt) SELECT a.s AS a, b.s AS b, count(*) AS n, round(covar_samp(a.ret, b.ret), 9) + 0.0 AS cov FROM sr a JOIN sr b ON b.dt = a.dt GROUP BY 1, 2")
def reg10b(s, d):
    g = md.gram(_series(s, d), "ret")
    return g.select("a", "b", "n", r((F.col("p") - F.col("sa") * F.col("sb") / F.col("n")) / (F.col("n") - 1), 9).alias("cov"))


@add("mod2_matched_counts", f"WITH {_TRI} SELECT * FROM mt")
def mod2(s, d):
    return md.matched_counts(_series(s, d), "ret", "mkt")


@add("mod4_model_performance", f"WITH {_TRI} SELECT f1, f2, round(CAST(matched AS DOUBLE) / assets, 6) AS share, round(cume_dist() OVER (ORDER BY CAST(matched AS DOUBLE) / assets), 6) AS place FROM mt")
def mod4(s, d):
    return md.model_performance(md.matched_counts(_series(s, d), "ret", "mkt")).select("f1", "f2", r("share").alias("share"), r("place").alias("place"))


@add("mod4_rarity_performance", f"WITH {_TRI}, wt AS (SELECT *, 1 - avg(p) OVER (PARTITION BY asset) AS w FROM pr), sh AS (SELECT f1, f2, round(sum(p * w) / count(*), 12) AS share FROM wt GROUP BY 1, 2) SELECT f1, f2, round(share, 6) + 0.0 AS share, round(cume_dist() OVER (ORDER BY share), 6) AS place FROM sh")
def mod4b(s, d):
    return md.rarity_performance(md.model_alphas(_series(s, d), "ret", "mkt")).select("f1", "f2", r("share").alias("share"), r("place").alias("place"))


@add("mod3_simulated_matches", None)
def mod3(s, d):
    out = md.simulated_matches(_series(s, d), "ret", "mkt", [0, 3, 10], 20)
    return out.select("planted", "matched", *[r(c).alias(c) for c in ("low", "mid", "high", "real")])


# ---- combination

@add("cmb1_variants", f"""WITH {PXD}, w AS (SELECT 0 AS "window", entity, dt, volume AS v FROM px_d UNION ALL SELECT n, entity, dt, CASE WHEN c >= n // 2 THEN v END FROM (
SELECT 5 AS n, entity, dt, avg(volume) OVER w AS v, count(volume) OVER w AS c FROM px_d WINDOW w AS (PARTITION BY entity ORDER BY dt ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
UNION ALL SELECT 20, entity, dt, avg(volume) OVER w, count(volume) OVER w FROM px_d WINDOW w AS (PARTITION BY entity ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)))
SELECT CAST("window" AS INTEGER) AS "window", CAST(s AS INTEGER) AS sign, entity, dt, s * v AS value FROM w CROSS JOIN (SELECT unnest([1, -1]) AS s)""")
def cmb1(s, d):
    return cb.variants(t.px_d(s, d), "volume", [0, 5, 20], "entity")


_RT = _ST + """, sk AS (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY dt) AS k FROM st), wn AS (SELECT a.industry, a.dt, b.k, b.ret FROM sk a JOIN sk b ON b.industry = a.industry AND b.k BETWEEN a.k - 11 AND a.k),
wv AS (SELECT *, product(1 + ret) OVER (PARTITION BY industry, dt ORDER BY k) AS v FROM wn), wt AS (SELECT *, greatest(1.0, max(v) OVER (PARTITION BY industry, dt ORDER BY k)) AS top FROM wv),
wg AS (SELECT industry, dt, count(*) AS n, max_by(v, k) - 1 AS total, least(0.0, min(v / top - 1)) AS dd, avg(ret) / nullif(stddev_samp(ret), 0) AS sharpe FROM wt GROUP BY 1, 2),
rt AS (SELECT industry, dt, CASE WHEN n >= 12 THEN total END AS total, CASE WHEN n >= 12 THEN total / nullif(-dd, 0) END AS calm, CASE WHEN n >= 12 THEN sharpe END AS sharpe FROM wg)"""


def _ratings(s, d):
    return cb.ratings(_st(s, d), "ret", 12, 0.95, "industry")


@add("cmb3_ratings", f"WITH {_RT} SELECT industry, dt, round(total, 5) + 0.0 AS total, round(calm, 4) + 0.0 AS calm, round(sharpe, 5) + 0.0 AS sharpe FROM rt")
def cmb3(s, d):
    return _ratings(s, d).select("industry", "dt", r("total", 5).alias("total"), r("calm", 4).alias("calm"), r("sharpe", 5).alias("sharpe"))


_VAR = _ST + f""", va AS (SELECT sector, industry, h, CASE WHEN lag(ret, CAST(h AS INTEGER)) OVER (PARTITION BY industry, h ORDER BY dt) > 0 THEN ret ELSE -ret END AS vr FROM st CROSS JOIN (SELECT unnest([1, 3, 6]) AS h)),
gr AS (SELECT sector, industry, CAST(h AS INTEGER) AS h, round(avg(vr) / nullif(stddev_samp(vr), 0), 9) AS score FROM va GROUP BY ALL),
b1 AS (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY score DESC, sector, h) AS n FROM gr WHERE score > 0), b2 AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY score DESC, industry) AS place FROM b1 WHERE n = 1),
b3 AS (SELECT * FROM b2 WHERE place <= 3)"""


def _graded(s, d):
    w = by_entity(None, "industry")
    st = _st(s, d).withColumns({f"before_{h}": F.lag("ret", h).over(w) for h in (1, 3, 6)})
    lags = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"before_{h}").alias("before")) for h in (1, 3, 6)]))
    v = st.select("sector", "industry", "ret", lags.alias("v")).select("sector", "industry", "v.h", F.when(F.col("v.before") > 0, F.col("ret")).otherwise(-F.col("ret")).alias("vr"))
    return v.groupBy("sector", "industry", "h").agg(r(ratio(F.avg("vr"), F.stddev_samp("vr")), 9).alias("score"))


@add("cmb4_grades", f"WITH {_VAR} SELECT sector, industry, h, round(score, 6) + 0.0 AS score FROM gr")
def cmb4(s, d):
    return _graded(s, d).withColumn("score", r("score"))


for _mode, _raw in (("equal", "1.0"), ("score", "score"), ("place", "max(place) OVER (PARTITION BY sector) + 1 - place")):

    @add(f"cmb5_choice_{_mode}", f"WITH {_VAR}, b4 AS (SELECT *, CAST({_raw} AS DOUBLE) AS w FROM b3) SELECT sector, industry, h, CAST(place AS INTEGER) AS place, round(w / nullif(sum(w) OVER (PARTITION BY sector), 0), 6) AS weight FROM b4")
    def cmb5(s, d, mode=_mode):
        return cb.choose(_graded(s, d), "score", "industry", "sector", 3, mode).select("sector", "industry", "h", "place", r("weight").alias("weight"))


@add("cmb6_mixed_signal", f"""WITH {FDMT}, z AS (SELECT entity, dt, ret_1m, unnest(['cap', 'volume']) AS indicator, unnest([(cap - avg(cap) OVER p) / nullif(stddev_samp(cap) OVER p, 0), (volume - avg(volume) OVER p) / nullif(stddev_samp(volume) OVER p, 0)]) AS value FROM fdmt WINDOW p AS (PARTITION BY dt)),
w AS (SELECT make_date(year(dt), 12, 31) AS rebalance, indicator, avg(ret_1m * value) FILTER (WHERE month(dt) < 12) AS weight FROM z GROUP BY 1, 2)
SELECT entity, dt, round(avg(value * weight), 6) + 0.0 AS value FROM z JOIN w ON w.indicator = z.indicator AND w.rebalance = make_date(year(dt) - 1, 12, 31) GROUP BY 1, 2""")
def cmb6(s, d):
    from panelforge.operators.xs import zscore

    f = t.fdmt_m(s, d).withColumns({"zc": zscore("cap"), "zv": zscore("volume")})
    z = f.select("entity", "dt", "ret_1m", F.explode(F.array(F.struct(F.lit("cap").alias("indicator"), F.col("zc").alias("value")), F.struct(F.lit("volume").alias("indicator"), F.col("zv").alias("value")))).alias("i")).select("entity", "dt", "ret_1m", "i.*")
    # the return of the next month is known at the year's end for all months but December
    seen = F.when(F.month("dt") < 12, F.col("ret_1m") * F.col("value"))
    w = z.groupBy(F.make_date(F.year("dt"), F.lit(12), F.lit(31)).alias("rebalance"), "indicator").agg(F.avg(seen).alias("weight"))
    return cb.mixed_signal(z, w).withColumn("value", r("value"))


@add("cmb9_blend", f"WITH {_ST}, n AS (SELECT sector, industry, dt, ret, product(1 + ret) OVER (PARTITION BY sector, industry ORDER BY dt) AS v FROM st), g AS (SELECT sector, dt, avg(v) AS mean_nav, avg(ret) AS m FROM n GROUP BY 1, 2) SELECT sector, dt, round(mean_nav, 4) + 0.0 AS mean_nav, round(product(1 + m) OVER (PARTITION BY sector ORDER BY dt), 4) + 0.0 AS nav_mean FROM g")
def cmb9(s, d):
    return cb.blend(_st(s, d), "ret", "sector", "industry").select("sector", "dt", r("mean_nav", 4).alias("mean_nav"), r("nav_mean", 4).alias("nav_mean"))


@add("cmb10_summary", f"WITH {_ST} SELECT industry, count(*) AS n, round(product(1 + ret) - 1, 4) + 0.0 AS total, round(avg(ret) / nullif(stddev_samp(ret), 0), 6) + 0.0 AS sharpe, round(covar_samp(ret, mkt) / nullif(stddev_samp(ret) * stddev_samp(mkt), 0), 6) + 0.0 AS market_corr FROM st JOIN mk ON mk.dt = st.dt GROUP BY 1")
def cmb10(s, d):
    x = _st(s, d).join(_factors(s, d).select("dt", "mkt"), "dt")
    corr = ratio(F.covar_samp("ret", "mkt"), F.stddev_samp("ret") * F.stddev_samp("mkt"))
    return x.groupBy("industry").agg(F.count("*").alias("n"), r(F.product(1 + F.col("ret")) - 1, 4).alias("total"), r(ratio(F.avg("ret"), F.stddev_samp("ret"))).alias("sharpe"), r(corr).alias("market_corr"))


@add("cmb11_lag_sensitivity", f"WITH {RETD}, l AS (SELECT CAST(h AS INTEGER) AS h, lag(volume, CAST(h AS INTEGER)) OVER (PARTITION BY entity, h ORDER BY dt) AS sig, ret FROM ret_d CROSS JOIN (SELECT unnest([1, 11, 21]) AS h)) SELECT h, count(sig + ret) AS n, round(regr_slope(ret, sig) * 1000, 5) + 0.0 AS slope FROM l GROUP BY 1")
def cmb11(s, d):
    p = t.ret_d(s, d).withColumns({f"sig_{h}": ts.delay("volume", h) for h in (1, 11, 21)})
    lags = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"sig_{h}").alias("sig")) for h in (1, 11, 21)]))
    x = p.select("ret", lags.alias("l")).select("l.h", "l.sig", "ret")
    return x.groupBy("h").agg(F.count(F.col("sig") + F.col("ret")).alias("n"), r(F.regr_slope("ret", "sig") * 1000, 5).alias("slope"))


@add("cmb12_train_windows", f"WITH {_ST}, e AS (SELECT industry, ret, CAST(y AS INTEGER) AS end_year FROM st CROSS JOIN (SELECT unnest(range(1995, 1999)) AS y) WHERE year(dt) BETWEEN y - 2 AND y) SELECT end_year, industry, count(*) AS n, round(avg(ret) / nullif(stddev_samp(ret), 0), 6) + 0.0 AS score FROM e GROUP BY 1, 2")
def cmb12(s, d):
    e = cb.train_windows(_st(s, d), 3, 1995, 1998)
    return e.groupBy("end_year", "industry").agg(F.count("*").alias("n"), r(ratio(F.avg("ret"), F.stddev_samp("ret"))).alias("score"))


# ---- events: days of large volume

_EV = RETD + """, dk AS (SELECT dt, row_number() OVER (ORDER BY dt) AS k FROM (SELECT DISTINCT dt FROM ret_d)), mkd AS (SELECT dt, avg(ret) AS mkt FROM ret_d GROUP BY 1),
ev AS (SELECT entity, volume AS mark, k FROM ret_d r JOIN dk ON dk.dt = r.dt WHERE volume > 90), o AS (SELECT ev.entity, mark, k + o AS k, CAST(o AS INTEGER) AS o FROM ev CROSS JOIN (SELECT unnest(range(-5, 21)) AS o)),
ew AS (SELECT mark, o, r.dt, ret, mkt FROM o JOIN dk ON dk.k = o.k JOIN ret_d r ON r.entity = o.entity AND r.dt = dk.dt JOIN mkd ON mkd.dt = r.dt)"""


def _ev(s, d):
    p = t.ret_d(s, d)
    # one row per trading day: small by nature
    panel = p.select("entity", "dt", "ret", "volume").join(F.broadcast(p.groupBy("dt").agg(F.avg("ret").alias("mkt"))), "dt")
    return panel.where("volume > 90").select("entity", "dt", F.col("volume").alias("mark")), panel.drop("volume")


@add("evt1_event_profit", f"WITH {_EV} SELECT dt, count(ret) AS held, round(sum(ret * mark) / nullif(sum(mark) FILTER (WHERE ret IS NOT NULL), 0), 6) + 0.0 AS ret FROM ew WHERE o BETWEEN 1 AND 10 GROUP BY 1")
def evt1(s, d):
    return cb.event_profit(*_ev(s, d), "ret", 10, "mark").withColumn("ret", r("ret"))


@add("evt2_holding_periods", f"WITH {_EV}, h AS (SELECT CAST(h AS INTEGER) AS hold, dt, avg(ret) AS ret FROM ew CROSS JOIN (SELECT unnest([1, 5, 10, 20]) AS h) WHERE o BETWEEN 1 AND h GROUP BY 1, 2) SELECT hold, count(ret) AS n, round(avg(ret), 6) + 0.0 AS mean, round(avg(ret - mkt), 6) + 0.0 AS relative FROM h JOIN mkd ON mkd.dt = h.dt GROUP BY 1")
def evt2(s, d):
    events, panel = _ev(s, d)
    g = cb.event_profit_grid(events, panel, "ret", [1, 5, 10, 20])
    g = g.join(F.broadcast(panel.groupBy("dt").agg(F.max("mkt").alias("mkt"))), "dt")
    return g.groupBy("hold").agg(F.count("ret").alias("n"), r(F.avg("ret")).alias("mean"), r(F.avg(F.col("ret") - F.col("mkt"))).alias("relative"))


@add("evt4_benchmark_path", f"WITH {_EV}, g AS (SELECT o AS offset_, avg(mkt) AS m FROM ew WHERE o BETWEEN -5 AND 5 GROUP BY 1) SELECT offset_, round(m, 6) + 0.0 AS mean, round(product(1 + m) OVER (ORDER BY offset_), 6) AS path FROM g")
def evt4(s, d):
    from pyspark.sql import Window

    # eleven rows
    g = cl.event_windows(*_ev(s, d), 5, 5).groupBy(F.col("offset").alias("offset_")).agg(F.avg("mkt").alias("m"))
    return g.select("offset_", r("m").alias("mean"), r(F.product(1 + F.col("m")).over(Window.orderBy("offset_"))).alias("path"))


# ---- further indicators

@add("ind4_monthly_momentum", f"WITH {PXM}, f AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY entity ORDER BY month_end ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM px_m) SELECT entity, month_end, " + ", ".join(f"CASE WHEN close IS NOT NULL THEN round(p / nullif(lag(p, {n}) OVER (PARTITION BY entity ORDER BY month_end), 0) - 1, 5) + 0.0 END AS mom_{n}" for n in (1, 3, 6, 12, 24)) + " FROM f")
def ind4(s, d):
    g = ts.growth(t.px_m(s, d).withColumnRenamed("month_end", "dt"), "close", 1, 3, 6, 12, 24)
    return g.select("entity", F.col("dt").alias("month_end"), *[r(f"mom_{n}", 5).alias(f"mom_{n}") for n in (1, 3, 6, 12, 24)])


@add("ind8_last_return", f"WITH {RETD} SELECT entity, last_day(dt) AS month_end, max_by(ret, dt) FILTER (WHERE ret IS NOT NULL) AS ret FROM ret_d GROUP BY 1, 2")
def ind8(s, d):
    return rs.last_per_month(t.ret_d(s, d).select("entity", "dt", "ret"), "ret")


@add("ind12_turnover_return_correlation", f"WITH {RETD}, a AS (SELECT entity, dt, count(CASE WHEN ret IS NOT NULL THEN 1 END) OVER w AS n, covar_samp(CASE WHEN ret IS NOT NULL THEN volume END, ret) OVER w AS c, stddev_samp(CASE WHEN ret IS NOT NULL THEN volume END) OVER w AS sv, stddev_samp(ret) OVER w AS sr FROM ret_d WINDOW w AS (PARTITION BY entity ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT entity, dt, CASE WHEN n >= 20 THEN round(c / nullif(sv * sr, 0), 5) + 0.0 END AS value FROM a")
def ind12(s, d):
    return t.ret_d(s, d).select("entity", "dt", r(ts.correlation("volume", "ret", 20), 5).alias("value"))


@add("ind15_calendar_window_volatility", f"""WITH {RETD}, mkd AS (SELECT dt, avg(ret) AS mkt FROM ret_d GROUP BY 1), p AS (SELECT r.*, mkt FROM ret_d r JOIN mkd ON mkd.dt = r.dt),
e AS (SELECT p.*, last_day(CAST(date_trunc('month', dt) + to_months(CAST(k AS INTEGER)) AS DATE)) AS month_end FROM p CROSS JOIN (SELECT unnest(range(6)) AS k)),
g AS (SELECT entity, month_end, count(ret) AS n, max(high) / nullif(min(low), 0) AS range_, stddev_samp(ret) AS vol, regr_slope(ret, mkt) AS beta, regr_syy(ret, mkt) AS syy, regr_sxy(ret, mkt) AS sxy FROM e GROUP BY 1, 2)
SELECT entity, month_end, round(range_, 5) + 0.0 AS high_low, round(vol, 6) AS vol, round(beta, 5) + 0.0 AS beta, round(sqrt(greatest(syy - beta * sxy, 0) / n), 6) AS idio FROM g WHERE n >= 15""")
def ind15(s, d):
    p = t.ret_d(s, d)
    p = p.join(F.broadcast(p.groupBy("dt").agg(F.avg("ret").alias("mkt"))), "dt")
    g = cl.trailing_months(p, 6).groupBy("entity", "month_end").agg(
        F.count("ret").alias("n"), ratio(F.max("high"), F.min("low")).alias("hl"), F.stddev_samp("ret").alias("vol"), F.regr_slope("ret", "mkt").alias("beta"), F.regr_syy("ret", "mkt").alias("syy"), F.regr_sxy("ret", "mkt").alias("sxy")
    )
    idio = F.sqrt(F.greatest(F.col("syy") - F.col("beta") * F.col("sxy"), F.lit(0.0)) / F.col("n"))
    return g.where("n >= 15").select("entity", "month_end", r("hl", 5).alias("high_low"), r("vol").alias("vol"), r("beta", 5).alias("beta"), r(idio).alias("idio"))


@add("ind2_momentum_spread", f"WITH {RETD} SELECT entity, dt, " + ", ".join(f"round((close / nullif(lag(close, {a}) OVER {WE}, 0) - 1) - (close / nullif(lag(close, {b}) OVER {WE}, 0) - 1), 5) + 0.0 AS mom_{a}_{b}" for a in (120, 250) for b in (10, 20)) + " FROM ret_d")
def ind2(s, d):
    g = ts.growth(t.ret_d(s, d), "close", 10, 20, 120, 250)
    return g.select("entity", "dt", *[r(F.col(f"mom_{a}") - F.col(f"mom_{b}"), 5).alias(f"mom_{a}_{b}") for a in (120, 250) for b in (10, 20)])


_MF = PXM + ", f AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY entity ORDER BY month_end ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM px_m)"
_ME = "(PARTITION BY entity ORDER BY month_end)"


@add("ind5_ind9_lagged_momentum", f"""WITH {_MF}, g AS (SELECT entity, month_end, CASE WHEN close IS NOT NULL THEN p / nullif(lag(p, 1) OVER {_ME}, 0) - 1 END AS m1, CASE WHEN close IS NOT NULL THEN p / nullif(lag(p, 6) OVER {_ME}, 0) - 1 END AS m6, CASE WHEN close IS NOT NULL THEN p / nullif(lag(p, 11) OVER {_ME}, 0) - 1 END AS m11, CASE WHEN close IS NOT NULL THEN p / nullif(lag(p, 12) OVER {_ME}, 0) - 1 END AS m12 FROM f)
SELECT entity, month_end, round(m12 - m1, 5) + 0.0 AS mom_12_1, round((1 + m12) / nullif(1 + m6, 0) - 1, 5) + 0.0 AS mom_12_6, round(lag(m11, 1) OVER {_ME}, 5) + 0.0 AS mom_11_lagged FROM g""")
def ind5(s, d):
    g = ts.growth(t.px_m(s, d).withColumnRenamed("month_end", "dt"), "close", 1, 6, 11, 12)
    out = g.withColumns({"a": F.col("mom_12") - F.col("mom_1"), "b": ratio(1 + F.col("mom_12"), 1 + F.col("mom_6")) - 1, "c": ts.delay("mom_11", 1)})
    return out.select("entity", F.col("dt").alias("month_end"), r("a", 5).alias("mom_12_1"), r("b", 5).alias("mom_12_6"), r("c", 5).alias("mom_11_lagged"))


@add("reg12_prominence", f"""WITH {_ST}, o AS (SELECT industry, 'market' AS bench, st.ret AS y, mkt AS a FROM st JOIN mk ON mk.dt = st.dt UNION ALL SELECT industry, 'size', st.ret, smb FROM st JOIN sz ON sz.dt = st.dt WHERE smb IS NOT NULL),
g AS (SELECT industry, bench, count(*) AS n, avg(y) AS my, avg(a) AS ma, regr_slope(y, a) AS b, regr_sxx(y, a) AS sxx, regr_syy(y, a) AS syy, regr_sxy(y, a) AS sxy FROM o GROUP BY 1, 2),
h AS (SELECT industry, (my - b * ma) / nullif(sqrt(greatest(syy - b * sxy, 0) / (n - 2) * (1.0 / n + ma * ma / nullif(sxx, 0))), 0) AS t FROM g WHERE n > 2)
SELECT industry, round(min(abs(t)), 4) AS least_t, min(abs(t)) > 1 AS both_, max(abs(t)) > 1 AS any_ FROM h GROUP BY 1""")
def reg12(s, d):
    from panelforge.operators.regress import ols

    f = F.explode(F.array(*[F.struct(F.lit(n).alias("bench"), F.col(c).alias("a")) for n, c in (("market", "mkt"), ("size", "smb"))]))
    x = _st(s, d).join(_factors(s, d), "dt").select("industry", "ret", f.alias("f")).select("industry", "ret", "f.*")
    o = ols(x, "ret", "a", "industry", "bench").where("n > 2").withColumn("t", F.abs("t"))
    return o.groupBy("industry").agg(r(F.min("t"), 4).alias("least_t"), (F.min("t") > 1).alias("both_"), (F.max("t") > 1).alias("any_"))
