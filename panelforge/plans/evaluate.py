"""Queries of the universe, of tradability, of layer tests and of the comparison of factors."""

from __future__ import annotations

import datetime as dt_

from pyspark.sql import functions as F

from panelforge.operators import portfolio as pf
from panelforge.operators import regress as rg
from panelforge.operators import ts, xs
from panelforge.operators import universe as un
from panelforge.plans.base_sql import FDMT, IND, PXD, bucket, mad
from panelforge.plans.ts_xs import _BIG, _NEXT, _Z, _neutral
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


# ---- the universe: listing, special treatment, suspension and industry of each row stand in by rules over the keys

_UNI = PXD + ", " + IND + """, lst AS (SELECT entity, min(dt) + CAST(entity % 40 * 10 AS INTEGER) AS listdate FROM px_d GROUP BY 1),
uni AS (SELECT p.*, listdate, CASE WHEN (p.entity + year(dt)) % 10 = 0 THEN true END AS type_st, CAST(volume AS BIGINT) % 17 = 0 AS suspended, dt <= listdate + 365 AS young,
  CASE WHEN p.entity % 13 <> 0 THEN industry END AS industry, sector FROM px_d p JOIN lst ON lst.entity = p.entity JOIN ind ON ind.entity = p.entity)"""
_IN = "NOT coalesce(type_st, false) AND NOT young AND industry IS NOT NULL"


def _uni(s, d):
    p = t.px_d(s, d)
    listed = p.groupBy("entity").agg(F.date_add(F.min("dt"), (F.col("entity") % 40 * 10).cast("int")).alias("listdate"))
    ind = t.industries(s, d).withColumn("industry", F.when(F.col("entity") % 13 != 0, F.col("industry")))
    u = p.join(listed, "entity").join(ind, "entity")
    return u.withColumns({"type_st": F.when((F.col("entity") + F.year("dt")) % 10 == 0, True), "suspended": F.col("volume").cast("long") % 17 == 0, "young": un.young()})


@add("flt1_universe", f"WITH {_UNI} SELECT entity, dt, close FROM uni WHERE {_IN}")
def flt1(s, d):
    return un.universe(_uni(s, d)).select("entity", "dt", "close")


@add("cln12_young_and_treated", f"WITH {_UNI} SELECT entity, dt, young, coalesce(type_st, false) AS treated FROM uni")
def cln12(s, d):
    return _uni(s, d).select("entity", "dt", "young", un.flag("type_st").alias("treated"))


@add("flt2_suspended", f"WITH {_UNI} SELECT entity, dt, CASE WHEN suspended THEN 0 ELSE 1 END AS open, CASE WHEN NOT suspended THEN close END AS close FROM uni")
def flt2(s, d):
    return _uni(s, d).select("entity", "dt", F.when(F.col("suspended"), 0).otherwise(1).alias("open"), un.while_open("close").alias("close"))


@add("flt5_prefix", f"WITH {PXD} SELECT entity, dt, close FROM px_d WHERE substr(CAST(entity AS VARCHAR), 1, 1) IN ('3', '6', '9') AND month(dt) = 12")
def flt5(s, d):
    return t.px_d(s, d).where(un.by_prefix("entity", "3", "6", "9") & (F.month("dt") == 12)).select("entity", "dt", "close")


_TRD = _UNI + """, lim AS (SELECT *, lag(close) OVER (PARTITION BY entity ORDER BY dt) AS before FROM uni), trd AS (SELECT entity, dt, NOT suspended AND NOT coalesce(close > before * 1.095, false) AND NOT coalesce(close < before * 0.905, false) AS ok FROM lim)"""


@add("pf3_tradability", f"WITH {_TRD} SELECT entity, dt, ok AS can_buy, ok AS can_sell FROM trd")
def pf3(s, d):
    return un.tradable(_uni(s, d))


_TEN = """tn AS (SELECT dt, entity, row_number() OVER (PARTITION BY dt ORDER BY volume DESC, entity) AS place FROM px_d), bk AS (SELECT dt, entity, round(1.0 / count(*) OVER (PARTITION BY dt), 8) AS weight FROM tn WHERE place <= 5),
nd AS (SELECT dt, lead(dt) OVER (ORDER BY dt) AS nx FROM (SELECT DISTINCT dt FROM bk)), hb AS (SELECT nx AS dt, entity, weight AS b FROM bk JOIN nd ON nd.dt = bk.dt WHERE nx IS NOT NULL),
od AS (SELECT dt, entity, round(coalesce(weight, 0) - coalesce(b, 0), 8) AS delta FROM bk FULL JOIN hb USING (dt, entity))"""


@add("pf3_executed_orders", f"WITH {_TRD}, {_TEN} SELECT od.dt, od.entity, CAST(delta AS DOUBLE) + 0.0 AS delta, CASE WHEN delta > 0 THEN 'buy' WHEN delta < 0 THEN 'sell' ELSE 'keep' END AS side, CASE WHEN delta = 0 OR coalesce(ok, false) THEN CAST(delta AS DOUBLE) + 0.0 ELSE 0.0 END AS done FROM od LEFT JOIN trd ON trd.entity = od.entity AND trd.dt = od.dt")
def pf3b(s, d):
    book = pf.weights(pf.top_n(t.px_d(s, d), "volume", 5), "volume", 3).select("dt", "entity", "weight")
    return un.executed(pf.orders(book), un.tradable(_uni(s, d))).withColumns({"delta": F.col("delta") + 0.0, "done": F.col("done") + 0.0})


_UX = f"{_UNI}, fdmt AS (SELECT entity, dt, close AS ret_m, amount AS cap, industry FROM uni WHERE {_IN})"


@add("xs13_signal_universe", f"WITH {_UX}, {_BIG}, {mad('big', 'ret_m')}, {_Z}, {_neutral('ret_m', 'z')}, {_NEXT.format('nr')} SELECT entity, next_dt AS dt, round(ret_m, 5) + 0.0 AS signal FROM nr JOIN nx ON nx.dt = nr.dt WHERE next_dt IS NOT NULL")
def xs13b(s, d):
    u = un.universe(_uni(s, d)).select("entity", "dt", "close", F.col("amount").alias("cap"), "industry")
    return xs.signal(u, "close", 5, neutral=True).select("entity", "dt", r("signal", 5).alias("signal"))


@add("xs14_signal_after", f"WITH {_UX}, bg AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY dt) AS nn FROM fdmt WHERE ret_m IS NOT NULL) WHERE nn >= 6), {mad('bg', 'ret_m')}, {_Z}, {_NEXT.format('z')} SELECT entity, next_dt AS dt, round(ret_m, 6) + 0.0 AS signal FROM z JOIN nx ON nx.dt = z.dt WHERE next_dt > DATE '1997-06-30'")
def xs14(s, d):
    u = un.universe(_uni(s, d)).select("entity", "dt", "close")
    return un.signal_after(u, "close", 6, dt_.date(1997, 6, 30)).select("entity", "dt", r("signal").alias("signal"))


def _std(c: str) -> str:
    return f"""{c}1 AS (SELECT entity, dt, {c} AS v, median({c}) OVER (PARTITION BY dt) AS md FROM fdmt), {c}2 AS (SELECT *, median(abs(v - md)) OVER (PARTITION BY dt) AS mdd FROM {c}1),
{c}3 AS (SELECT entity, dt, CASE WHEN v IS NOT NULL THEN greatest(least(v, md + 4.5 * mdd), md - 4.5 * mdd) END AS v FROM {c}2), {c}4 AS (SELECT entity, dt, (v - avg(v) OVER p) / nullif(stddev_pop(v) OVER p, 0) AS {c} FROM {c}3 WINDOW p AS (PARTITION BY dt))"""


@add("xs15_standardize", f"WITH {FDMT}, {_std('cap')}, {_std('volume')} SELECT a.entity, a.dt, round(cap, 6) + 0.0 AS cap, round(volume, 6) + 0.0 AS volume FROM cap4 a JOIN volume4 b ON b.entity = a.entity AND b.dt = a.dt")
def xs15(s, d):
    return un.standardize(t.fdmt_m(s, d), "cap", "volume").select("entity", "dt", r("cap").alias("cap"), r("volume").alias("volume"))


@add("xs17_alpha008", f"""WITH {PXD}, {IND}, sg AS (SELECT p.entity, dt, industry, CASE WHEN count(close) OVER w >= 39 THEN -1 * close / avg(close) OVER w END AS v FROM px_d p JOIN ind ON ind.entity = p.entity WINDOW w AS (PARTITION BY p.entity ORDER BY dt ROWS BETWEEN 38 PRECEDING AND CURRENT ROW)),
st AS (SELECT dt, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3 FROM sg GROUP BY 1), vv AS (SELECT sg.dt, entity, v, q2 AS m FROM sg JOIN st ON st.dt = sg.dt WHERE v IS NOT NULL),
h AS (SELECT a.dt, median(CASE WHEN a.v > b.v THEN ((a.v - a.m) - (a.m - b.v)) / (a.v - b.v) ELSE sign(a.entity - b.entity) END) AS mc FROM vv a JOIN vv b ON a.dt = b.dt AND a.v >= a.m AND b.v <= b.m GROUP BY 1),
l AS (SELECT st.dt, q1 - 1.5 * exp((CASE WHEN coalesce(mc, 0) >= 0 THEN -3.5 ELSE -4.0 END) * coalesce(mc, 0)) * (q3 - q1) AS lo, q3 + 1.5 * exp((CASE WHEN coalesce(mc, 0) >= 0 THEN 4.0 ELSE 3.5 END) * coalesce(mc, 0)) * (q3 - q1) AS hi FROM st LEFT JOIN h ON h.dt = st.dt),
i AS (SELECT sg.entity, sg.dt, industry, v, CASE WHEN v BETWEEN lo AND hi THEN v END AS i FROM sg JOIN l ON l.dt = sg.dt), c AS (SELECT entity, dt, industry, CASE WHEN v IS NOT NULL THEN least(greatest(v, min(i) OVER (PARTITION BY dt)), max(i) OVER (PARTITION BY dt)) END AS v FROM i)
SELECT entity, dt, round(v - avg(v) OVER (PARTITION BY dt, industry), 6) + 0.0 AS value FROM c""")
def xs17(s, d):
    p = t.px_d(s, d).join(t.industries(s, d), "entity")
    p = p.withColumn("sig", -1 * F.col("close") / ts.ts_mean("close", 39))
    p = xs.adjusted_boxplot(p, "sig").withColumn("sig", xs.demean("sig", "dt", "industry"))
    return ts.decay_linear(p, "sig", 1).select("entity", "dt", (r("decay") + 0.0).alias("value"))


# ---- layers and factors on the monthly cross-section

_X = FDMT + ", x AS (SELECT *, ret_m AS sig FROM fdmt WHERE ret_m IS NOT NULL AND ret_1m IS NOT NULL)"


def _x(s, d):
    return t.fdmt_m(s, d).where("ret_m is not null and ret_1m is not null").withColumn("sig", F.col("ret_m"))


@add("dia2_weighted_slopes", f"""WITH {_X}, y AS (SELECT *, sqrt(cap) AS rc FROM x WHERE cap > 0),
m AS (SELECT dt, count(*) AS n, stddev_pop(sig) AS sd, sum(rc * sig) / sum(rc) AS rx, sum(rc * ret_1m) / sum(rc) AS ry, sum(cap * sig) / sum(cap) AS wx, sum(cap * ret_1m) / sum(cap) AS wy, sum(cap) AS w FROM y GROUP BY 1),
b AS (SELECT y.dt, sum(rc * (sig - rx) * (ret_1m - ry)) / nullif(sum(rc * (sig - rx) * (sig - rx)), 0) AS rb, sum(cap * (sig - wx) * (ret_1m - wy)) / nullif(sum(cap * (sig - wx) * (sig - wx)), 0) AS wb, sum(cap * (sig - wx) * (sig - wx)) AS sxx FROM y JOIN m ON m.dt = y.dt GROUP BY 1),
e AS (SELECT y.dt, sum(pow(ret_1m - ry - rb * (sig - rx), 2)) AS se, sum(cap * pow(ret_1m - wy - wb * (sig - wx), 2)) AS we FROM y JOIN m ON m.dt = y.dt JOIN b ON b.dt = y.dt GROUP BY 1)
SELECT m.dt, n, round(rb, 5) + 0.0 AS slope_root, round(CASE WHEN n > 2 THEN rb * sqrt(n) * sd / nullif(sqrt(se / (n - 2)), 0) END, 4) + 0.0 AS t_root, round(wb, 5) + 0.0 AS slope, round(CASE WHEN n > 2 THEN wb / nullif(sqrt(we / (n - 2) / nullif(sxx, 0)), 0) END, 4) + 0.0 AS t,
round(wy - wb * wx, 5) + 0.0 AS intercept, round(CASE WHEN n > 2 THEN (wy - wb * wx) / nullif(sqrt(we / (n - 2) * (1 / w + wx * wx / nullif(sxx, 0))), 0) END, 4) + 0.0 AS t_intercept FROM m JOIN b ON b.dt = m.dt JOIN e ON e.dt = m.dt WHERE n > 3""")
def dia2(s, d):
    a = un.weighted_slopes(_x(s, d), "sig", "ret_1m", "cap").where("n > 3")
    return a.select("dt", "n", *[r(c, k).alias(c) for c, k in (("slope_root", 5), ("t_root", 4), ("slope", 5), ("t", 4), ("intercept", 5), ("t_intercept", 4))])


@add("dia4_residual_table", f"""WITH {_X}, y AS (SELECT * FROM x WHERE cap > 0), g AS (SELECT dt, regr_slope(ret_1m, sig) AS b, regr_intercept(ret_1m, sig) AS a, avg(cap) + 2 * stddev_samp(cap) AS top, sum(cap * sig) / sum(cap) AS wx, sum(cap * ret_1m) / sum(cap) AS wy FROM y GROUP BY 1),
h AS (SELECT y.dt, sum(cap * (sig - wx) * (ret_1m - wy)) / nullif(sum(cap * (sig - wx) * (sig - wx)), 0) AS wb FROM y JOIN g ON g.dt = y.dt GROUP BY 1)
SELECT entity, y.dt, round(sqrt(CASE WHEN top < cap THEN top ELSE cap END), 4) AS size, round(ret_1m - a - b * sig, 6) + 0.0 AS error_ols, round(ret_1m - wy - wb * (sig - wx), 6) + 0.0 AS error_wls FROM y JOIN g ON g.dt = y.dt JOIN h ON h.dt = y.dt""")
def dia4(s, d):
    return un.residual_table(_x(s, d), "sig", "ret_1m", "cap").select("entity", "dt", r("size", 4).alias("size"), r("error_ols").alias("error_ols"), r("error_wls").alias("error_wls"))


_LAY = f"{_X}, bm AS (SELECT dt, avg(ret_1m) AS bench FROM x GROUP BY 1), g AS (SELECT *, {bucket('sig', 5, 'dt')} AS bucket FROM x), ly AS (SELECT dt, bucket, avg(ret_1m) AS ret, count(*) OVER (PARTITION BY dt) AS k FROM g GROUP BY dt, bucket), la AS (SELECT ly.dt, bucket, ret, bench FROM ly JOIN bm ON bm.dt = ly.dt WHERE k = 5)"


def _layers(s, d):
    x = _x(s, d)
    return un.layers(x, "sig", "ret_1m", 5, x.groupBy("dt").agg(F.avg("ret_1m").alias("bench")))


@add("dia5_layers", f"WITH {_LAY} SELECT dt, bucket, round(ret, 6) + 0.0 AS ret, round(bench, 6) + 0.0 AS bench FROM la")
def dia5(s, d):
    return _layers(s, d).select("dt", "bucket", r("ret").alias("ret"), r("bench").alias("bench"))


@add("dia6_layer_description", f"""WITH {_LAY}, v AS (SELECT *, product(1 + ret) OVER w AS v, product(1 + ret - bench) OVER w AS u, ret - bench AS rel FROM la WINDOW w AS (PARTITION BY bucket ORDER BY dt)), f AS (SELECT *, least(0, v / max(v) OVER w - 1) AS fv, least(0, u / max(u) OVER w - 1) AS fu FROM v WINDOW w AS (PARTITION BY bucket ORDER BY dt)),
a AS (SELECT bucket, count(*) AS n, max_by(v, dt) AS v, max_by(u, dt) AS u, stddev_samp(ret) * sqrt(12) AS sd, stddev_samp(rel) * sqrt(12) AS sr, min(fv) AS fv, min(fu) AS fu FROM f GROUP BY 1), b AS (SELECT *, pow(v, 12.0 / n) - 1 AS an, pow(u, 12.0 / n) - 1 AS ra FROM a)
SELECT bucket, n, round(v - 1, 4) + 0.0 AS total, round(an, 5) + 0.0 AS annual, round(sd, 6) AS sigma, round((an - 0.036) / sd, 5) + 0.0 AS sharpe, round(fv, 6) + 0.0 AS max_drawdown, round(ra, 5) + 0.0 AS rela_annual, round(sr, 6) AS rela_sigma, round(ra / sr, 5) + 0.0 AS information, round(fu, 6) + 0.0 AS rela_max_drawdown FROM b""")
def dia6(s, d):
    digits = {"total": 4, "annual": 5, "sigma": 6, "sharpe": 5, "max_drawdown": 6, "rela_annual": 5, "rela_sigma": 6, "information": 5, "rela_max_drawdown": 6}
    return un.describe_layers(_layers(s, d)).select("bucket", "n", *[r(c, k).alias(c) for c, k in digits.items()])


@add("dia8_top_size_distribution", f"WITH {_X}, g AS (SELECT dt, {bucket('sig', 5, 'dt')} AS g, {bucket('cap', 5, 'dt')} AS size_bucket, count(*) OVER (PARTITION BY dt) AS n FROM x) SELECT dt, size_bucket, round(CAST(count(*) AS DOUBLE) / max(n), 6) AS share FROM g WHERE g = 5 GROUP BY 1, 2")
def dia8(s, d):
    return un.top_size_distribution(_x(s, d), "sig", "cap", 5).withColumn("share", r("share"))


_NAMES = ("ret_m", "volume", "cap")
_ICL = f"""{_X}, l AS (SELECT entity, dt, ret_1m, cap, indicator, v FROM (SELECT entity, dt, ret_1m, cap AS cap, CAST(ret_m AS DOUBLE) AS ret_m_, CAST(volume AS DOUBLE) AS volume_, cap AS cap_ FROM x) UNPIVOT (v FOR indicator IN (ret_m_, volume_, cap_))),
ll AS (SELECT entity, dt, ret_1m, cap, rtrim(indicator, '_') AS indicator, v FROM l),
rk AS (SELECT *, rank() OVER (PARTITION BY indicator, dt ORDER BY v) + (count(*) OVER (PARTITION BY indicator, dt, v) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY indicator, dt ORDER BY ret_1m) + (count(*) OVER (PARTITION BY indicator, dt, ret_1m) - 1) / 2.0 AS ry FROM ll),
ic AS (SELECT indicator, dt, covar_samp(rx, ry) / nullif(stddev_samp(rx) * stddev_samp(ry), 0) AS ic FROM rk GROUP BY 1, 2)"""


def _long(s, d):
    return _x(s, d).unpivot(["entity", "dt", "ret_1m"], [F.col(c).cast("double").alias(c) for c in _NAMES], "indicator", "v").join(_x(s, d).select("entity", "dt", F.col("cap").alias("weight")), ["entity", "dt"])


def _ic(s, d):
    x = _x(s, d)
    long = x.unpivot(["entity", "dt", "ret_1m"], [F.col(c).cast("double").alias(c) for c in _NAMES], "indicator", "v")
    return pf.information_coefficient(long, "v", "ret_1m", "indicator", "dt")


@add("dia9_rank_factors", f"WITH {_ICL}, a AS (SELECT indicator, count(ic) AS n, avg(ic) AS mean, stddev_samp(ic) AS std FROM ic GROUP BY 1) SELECT indicator, n, round(mean, 6) + 0.0 AS mean, round(std, 6) AS std, round(mean / std, 5) + 0.0 AS ir, CAST(row_number() OVER (ORDER BY abs(mean) DESC, indicator) AS INTEGER) AS place FROM a QUALIFY row_number() OVER (ORDER BY abs(mean) DESC, indicator) <= 2")
def dia9(s, d):
    return un.rank_factors(_ic(s, d), "ic", 2).select("indicator", "n", r("mean").alias("mean"), r("std").alias("std"), r("ir", 5).alias("ir"), "place")


@add("agg8_correlations", f"WITH {_ICL}, f AS (SELECT dt FROM ic WHERE ic IS NOT NULL GROUP BY 1 HAVING count(*) = 3), z AS (SELECT ic.* FROM ic JOIN f ON f.dt = ic.dt) SELECT a.indicator AS a, b.indicator AS b, count(*) AS n, round(covar_samp(a.ic, b.ic) / nullif(stddev_samp(a.ic) * stddev_samp(b.ic), 0), 6) + 0.0 AS corr FROM z a JOIN z b ON b.dt = a.dt AND a.indicator < b.indicator GROUP BY 1, 2")
def agg8(s, d):
    return un.pair_correlations(_ic(s, d), "ic").withColumn("corr", r("corr"))


@add("dia10_compare_results", f"WITH {_X}, p AS (SELECT dt, avg(ret_1m) AS old, sum(ret_1m * cap) / sum(cap) AS new FROM x GROUP BY 1) SELECT dt, round(product(1 + old) OVER w, 5) AS old_nav, round(product(1 + new) OVER w, 5) AS new_nav, round(product(1 + new) OVER w - product(1 + old) OVER w, 5) + 0.0 AS gap FROM p WINDOW w AS (ORDER BY dt)")
def dia10(s, d):
    p = _x(s, d).groupBy(F.lit("r").alias("result"), "dt").agg(F.avg("ret_1m").alias("old"), pf.weighted_mean("ret_1m", "cap").alias("new"))
    n = p.withColumns({"o": ts.nav("old", "result"), "n": ts.nav("new", "result")})
    return n.select("dt", r("o", 5).alias("old_nav"), r("n", 5).alias("new_nav"), r(F.col("n") - F.col("o"), 5).alias("gap"))


@add("pf11_forward_returns", f"WITH {FDMT}, g AS (SELECT close, {bucket('cap', 5, 'dt')} AS bucket, lead(close, 1) OVER w AS c1, lead(close, 3) OVER w AS c3, lead(close, 6) OVER w AS c6 FROM fdmt WINDOW w AS (PARTITION BY entity ORDER BY dt)), l AS (SELECT bucket, 1 AS horizon, c1 / close - 1 AS f FROM g UNION ALL SELECT bucket, 3, c3 / close - 1 FROM g UNION ALL SELECT bucket, 6, c6 / close - 1 FROM g) SELECT bucket, horizon, count(f) AS n, round(avg(f), 6) + 0.0 AS mean, round(stddev_samp(f), 6) AS std FROM l GROUP BY 1, 2")
def pf11(s, d):
    return un.forward_returns(t.fdmt_m(s, d), "cap", "close", 5, [1, 3, 6]).select("bucket", "horizon", "n", r("mean").alias("mean"), r("std").alias("std"))


# ---- sorts of several indicators

_PRT = f"{_ICL}, bk AS (SELECT *, {bucket('v', 10, 'indicator', 'dt')} AS bucket FROM ll), pr AS (SELECT indicator, dt, bucket, avg(ret_1m) AS ret_eq FROM bk GROUP BY 1, 2, 3)"


def _ports(s, d):
    return pf.sorted_portfolios(_long(s, d), "v", "ret_1m", "weight", 10, "indicator", "dt")


@add("srt2_test_assets", f"WITH {_PRT} SELECT indicator, dt, bucket, round(ret_eq, 6) + 0.0 AS ret FROM pr")
def srt2(s, d):
    return _ports(s, d).select("indicator", "dt", "bucket", r("ret_eq").alias("ret"))


_SPR = _PRT + ", sp AS (SELECT indicator, dt, max(ret_eq) FILTER (WHERE bucket = 10) - max(ret_eq) FILTER (WHERE bucket = 1) AS spread FROM pr GROUP BY 1, 2)"


def _spreads(s, d):
    return pf.spread(_ports(s, d), 10, "indicator", "dt").select("indicator", "dt", F.col("spread_eq").alias("spread"))


@add("srt3_spread_matrix", f"WITH {_SPR}, ok AS (SELECT * FROM sp WHERE spread IS NOT NULL AND NOT (indicator = 'cap' AND year(dt) < 1997)), ds AS (SELECT DISTINCT dt FROM ok), kp AS (SELECT indicator FROM ok GROUP BY 1 HAVING count(*) >= ceil(0.6 * (SELECT count(*) FROM ds))) SELECT kp.indicator, ds.dt, round(coalesce(spread, 0), 6) + 0.0 AS value FROM kp CROSS JOIN ds LEFT JOIN ok ON ok.indicator = kp.indicator AND ok.dt = ds.dt")
def srt3(s, d):
    sp = _spreads(s, d).where(~((F.col("indicator") == "cap") & (F.year("dt") < 1997)))
    return un.spread_matrix(sp, "spread").select("indicator", "dt", r("value").alias("value"))


_ALN = _SPR + """, mk AS (SELECT dt, avg(ret_1m) AS mkt FROM x GROUP BY 1), cp AS (SELECT indicator, count(*) AS n, avg(spread) - regr_slope(spread, mkt) * avg(mkt) AS alpha, regr_sxx(spread, mkt) AS sxx, regr_syy(spread, mkt) AS syy, regr_sxy(spread, mkt) AS sxy, avg(mkt) AS mx FROM sp JOIN mk ON mk.dt = sp.dt WHERE spread IS NOT NULL GROUP BY 1),
sg AS (SELECT indicator, CASE WHEN alpha > 0 THEN 1.0 ELSE -1.0 END AS s FROM cp),
zs AS (SELECT entity, dt, ret_1m, ll.indicator, s * (v - avg(v) OVER p) / nullif(stddev_samp(v) OVER p, 0) AS z FROM ll JOIN sg ON sg.indicator = ll.indicator WINDOW p AS (PARTITION BY ll.indicator, dt))"""


def _aligned(s, d):
    x = _x(s, d)
    mk = x.groupBy("dt").agg(F.avg("ret_1m").alias("mkt"))
    signs = rg.ols(_spreads(s, d).join(F.broadcast(mk), "dt"), "spread", "mkt", "indicator")
    return un.align(_long(s, d).withColumn("z", xs.zscore("v", "indicator", "dt")), "z", signs)


@add("srt6_aligned_signals", f"WITH {_ALN} SELECT indicator, entity, dt, round(z, 6) + 0.0 AS value FROM zs")
def srt6(s, d):
    return _aligned(s, d).select("indicator", "entity", "dt", (r("z") + 0.0).alias("value"))


@add("srt5_composite", f"""WITH {_ALN}, kz AS (SELECT * FROM zs WHERE NOT (indicator = 'cap' AND entity % 3 = 0) AND NOT (indicator = 'volume' AND entity % 6 = 0)), ci AS (SELECT entity, dt, round(sum(z), 9) AS score FROM kz WHERE z IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2),
cl AS (SELECT entity, dt, lag(score) OVER (PARTITION BY entity ORDER BY dt) AS score FROM ci), cj AS (SELECT cl.dt, score, ret_m FROM cl JOIN x ON x.entity = cl.entity AND x.dt = cl.dt WHERE score IS NOT NULL), cb AS (SELECT dt, ret_m, {bucket('score', 5, 'dt')} AS bucket FROM cj)
SELECT dt, bucket, count(*) AS n, round(avg(ret_m), 6) + 0.0 AS ret FROM cb GROUP BY 1, 2""")
def srt5(s, d):
    z = _aligned(s, d).where("not (indicator = 'cap' and entity % 3 = 0) and not (indicator = 'volume' and entity % 6 = 0)")
    c = un.composite(z, "z", 3).withColumn("score", r("score", 9))
    c = c.withColumn("score", ts.delay("score", 1)).join(_x(s, d).select("entity", "dt", "ret_m", "cap"), ["entity", "dt"])
    return pf.sorted_portfolios(c, "score", "ret_m", "cap", 5).select("dt", "bucket", "n", r("ret_eq").alias("ret"))


@add("srt7_best_condition", f"""WITH {_ICL}, cn AS (SELECT ll.*, 'cap' AS condition, x.cap AS c FROM ll JOIN x ON x.entity = ll.entity AND x.dt = ll.dt UNION ALL SELECT ll.*, 'close', x.close FROM ll JOIN x ON x.entity = ll.entity AND x.dt = ll.dt),
c1 AS (SELECT *, {bucket('c', 3, 'condition', 'indicator', 'dt')} AS g1 FROM cn), c2 AS (SELECT *, {bucket('v', 3, 'condition', 'indicator', 'dt', 'g1')} AS g2 FROM c1), c3 AS (SELECT condition, indicator, dt, g1, avg(ret_1m) FILTER (WHERE g2 = 3) - avg(ret_1m) FILTER (WHERE g2 = 1) AS hl FROM c2 GROUP BY 1, 2, 3, 4),
c4 AS (SELECT condition, indicator, g1, avg(hl) / nullif(stddev_samp(hl) / sqrt(count(hl)), 0) AS t FROM c3 GROUP BY 1, 2, 3), c5 AS (SELECT condition, count(*) FILTER (WHERE abs(t) >= 1) AS large FROM c4 GROUP BY 1 ORDER BY large DESC, condition LIMIT 1)
SELECT c4.condition, indicator, g1, round(t, 5) + 0.0 AS t, large FROM c4 JOIN c5 ON c5.condition = c4.condition""")
def srt7(s, d):
    from panelforge.functions.core import bucket as buckets

    c = _x(s, d).select("entity", "dt", F.explode(F.array(*[F.struct(F.lit(n).alias("condition"), F.col(n).cast("double").alias("c")) for n in ("cap", "close")])).alias("k")).select("entity", "dt", "k.*")
    x = _long(s, d).join(c, ["entity", "dt"]).withColumn("g1", buckets("c", 3, "condition", "indicator", "dt"))
    x = x.withColumn("g2", buckets("v", 3, "condition", "indicator", "dt", "g1"))
    part = lambda g: F.avg(F.when(F.col("g2") == g, F.col("ret_1m")))
    hl = x.groupBy("condition", "indicator", "dt", "g1").agg((part(3) - part(1)).alias("hl"))
    _, tv = pf.mean_t("hl")
    return un.best_condition(hl.groupBy("condition", "indicator", "g1").agg(tv.alias("t")), "t", 1.0).withColumn("t", r("t", 5))
