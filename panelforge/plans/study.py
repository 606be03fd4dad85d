"""Queries of generators, consensus, base characteristics, controls, further bootstraps, scaled intercepts and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.core import by_entity, ratio
from panelforge.operators import accounting as acc
from panelforge.operators import combine as cb
from panelforge.operators import generate as gen
from panelforge.operators import models as md
from panelforge.operators import portfolio as pf
from panelforge.operators import regress as rg
from panelforge.operators import resample as rs
from panelforge.operators import universe as un
from panelforge.plans.base_sql import FDMT, PXD, RETD, STMT, WE, bucket
from panelforge.plans.evaluate import _IN, _UNI, _uni
from panelforge.plans.factor import _BST, _D, _FIT, _MK, _OLS, _PRED, FIELDS, _drawn, _growth, _mk, _ols_out, _pred
from panelforge.plans.models import _ST, _VAR, _factors, _graded, _st
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


# ---- generators

_LW = "(PARTITION BY entity, f ORDER BY dt)"
_L8 = "(PARTITION BY entity, f ORDER BY dt ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)"


def _gr(table: str, x: str, out: str, q: int) -> str:
    """CTEs over long rows (entity, f, dt): growth of positive x over q rows, padded forward, as `out`."""
    return f"""{out}_p AS (SELECT *, CASE WHEN {x} > 0 THEN {x} END AS {out}_v FROM {table}),
{out}_f AS (SELECT *, last_value({out}_v IGNORE NULLS) OVER (PARTITION BY entity, f ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {out}_c FROM {out}_p),
{out}_t AS (SELECT *, CASE WHEN {out}_v IS NOT NULL THEN {out}_c / nullif(lag({out}_c, {q}) OVER {_LW}, 0) - 1 END AS {out} FROM {out}_f)"""


def _down(x: str) -> str:
    return f"CASE WHEN {x} - lag({x}) OVER {_LW} < 0 THEN {x} - lag({x}) OVER {_LW} ELSE 0.0 END"


_FAM = f"""WITH {STMT}, u AS (SELECT entity, dt, f, x FROM (SELECT entity, dt, revenue / 1000 AS revenue, cost / 1000 AS cost, profit / 1000 AS profit, assets / 1000 AS assets FROM stmt) UNPIVOT (x FOR f IN (revenue, cost, profit, assets))),
{_gr('u', 'x', 'g4', 4)}, {_gr('g4_t', 'x', 'g1', 1)}, o AS (SELECT *, {_down('x')} AS dx, {_down('g1')} AS dg FROM g1_t),
one AS (SELECT entity, dt, f, x - lag(x, 4) OVER {_LW} AS x_chg, g4 AS x_pct_chg, CASE WHEN count(g1) OVER {_L8} >= 4 THEN avg(g1) OVER {_L8} END AS x_history_growth_avg, x * x AS x_square,
  CASE WHEN count(dx) OVER {_L8} >= 8 THEN stddev_samp(dx) OVER {_L8} END AS x_history_downside_std, CASE WHEN count(dg) OVER {_L8} >= 8 THEN stddev_samp(dg) OVER {_L8} END AS x_history_growth_downside_std FROM o),
p AS (SELECT a.entity, a.dt, a.f, a.x, b.x AS y, a.x / nullif(CASE WHEN b.x > 0 THEN b.x END, 0) AS q, a.g4 AS gx, b.g4 AS gy FROM g4_t a JOIN g4_t b ON b.entity = a.entity AND b.dt = a.dt AND b.f = 'assets' WHERE a.f <> 'assets'),
{_gr('p', 'q', 'gq', 4)}, w AS (SELECT *, {_down('q')} AS dq FROM gq_t),
two AS (SELECT entity, dt, f, q AS ratio, q - lag(q, 4) OVER {_LW} AS ratio_chg, gq AS ratio_pct_chg, CASE WHEN count(q) OVER {_L8} >= 8 THEN stddev_samp(q) OVER {_L8} END AS ratio_history_std,
  CASE WHEN count(q) OVER {_L8} >= 8 THEN q / nullif(lag(q, 7) OVER {_LW}, 0) - 1 END AS ratio_history_compound_growth, CASE WHEN count(dq) OVER {_L8} >= 8 THEN stddev_samp(dq) OVER {_L8} END AS ratio_history_downside_std,
  gx - gy AS pct_chg_dif, (x - lag(x, 4) OVER {_LW}) / nullif(lag(y, 4) OVER {_LW}, 0) AS ratio_x_chg_over_lag_y, gx / nullif(gy, 0) AS ratio_of_growth_rates FROM w)
SELECT kind || '__' || f AS indicator, entity, dt, round(v, 3) + 0.0 AS value FROM one UNPIVOT INCLUDE NULLS (v FOR kind IN ({', '.join(gen.ONE)}))
UNION ALL SELECT kind || '__' || f || '__assets', entity, dt, round(v, 3) + 0.0 FROM two UNPIVOT INCLUDE NULLS (v FOR kind IN ({', '.join(gen.TWO)}))"""


@add("acc22_quarterly_family", _FAM)
def acc22(s, d):
    x = t.stmt_q(s, d).select("entity", "dt", *[(F.col(c) / 1000).alias(c) for c in ("revenue", "cost", "profit", "assets")])
    return gen.quarterly_family(x, ["revenue", "cost", "profit"], ["assets"]).withColumn("value", r("value", 3))


#: Rows of a sheet of indicators, as it would be read.
SHEET = (
    {"type": "Q", "name": "margin", "numerator": "revenue - cost", "denominator": "revenue", "function": "ratio"},
    {"type": "G", "name": "profitGrowth", "numerator": "profit", "denominator": "", "function": "x_pct_chg"},
    {"type": "G", "name": "salesChange", "numerator": "revenue + tax", "denominator": "", "function": "x_chg"},
    {"type": "Q", "name": "turnoverChange", "numerator": "revenue", "denominator": "assets", "function": "ratio_chg"},
    {"type": "V", "name": "salesOverLaggedAssets", "numerator": "revenue", "denominator": "assets - cost", "function": "ratio_x_chg_over_lag_y"},
)


@add("acc23_sheet_indicators", f"""WITH {STMT}, {_growth('profit', 'g', 4, 'stmt', 'pg')}, m AS (SELECT entity, dt, (revenue - cost) / nullif(CASE WHEN revenue > 0 THEN revenue END, 0) AS "Q__margin", g AS "G__profitGrowth", (revenue + tax) - lag(revenue + tax, 4) OVER {WE} AS "G__salesChange",
revenue / nullif(CASE WHEN assets > 0 THEN assets END, 0) - lag(revenue / nullif(CASE WHEN assets > 0 THEN assets END, 0), 4) OVER {WE} AS "Q__turnoverChange", (revenue - lag(revenue, 4) OVER {WE}) / nullif(lag(assets - cost, 4) OVER {WE}, 0) AS "V__salesOverLaggedAssets" FROM pg)
SELECT indicator, entity, dt, round(v, 4) + 0.0 AS value FROM m UNPIVOT INCLUDE NULLS (v FOR indicator IN ("Q__margin", "G__profitGrowth", "G__salesChange", "Q__turnoverChange", "V__salesOverLaggedAssets"))""")
def acc23(s, d):
    return gen.from_rows(t.stmt_q(s, d), SHEET).withColumn("value", r("value", 4))


_NPX, _OCF = FIELDS["net_profit_excl_min_int_inc"], FIELDS["net_cash_flows_oper_act"]


@add("fg16_net_profit_average_growth", f"WITH {STMT}, n AS (SELECT entity, dt, {_NPX} AS x FROM stmt), {_growth('x', 'g', 1, 'n', 'pg')} SELECT entity, dt, round(CASE WHEN count(g) OVER w >= 6 THEN avg(g) OVER w END, 4) + 0.0 AS value FROM pg WINDOW w AS (PARTITION BY entity ORDER BY dt ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)")
def fg16(s, d):
    return acc.mean_growth(t.stmt_q(s, d).withColumn("x", F.expr(_NPX)), "x", "v", 12).select("entity", "dt", r("v", 4).alias("value"))


@add("fq36_downturn_risk", f"WITH {STMT}, n AS (SELECT entity, dt, {_OCF} AS x FROM stmt), m AS (SELECT *, CASE WHEN x - lag(x) OVER {WE} < 0 THEN x - lag(x) OVER {WE} ELSE 0.0 END AS dx FROM n) SELECT entity, dt, round(CASE WHEN count(dx) OVER w >= 8 THEN stddev_samp(dx) OVER w END, 2) + 0.0 AS value FROM m WINDOW w AS (PARTITION BY entity ORDER BY dt ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)")
def fq36(s, d):
    return acc.downside_std(t.stmt_q(s, d).withColumn("x", F.expr(_OCF)), "x", "v", 8).select("entity", "dt", r("v", 2).alias("value"))


# ---- indicators

_IV = f"""WITH {RETD}, mkd AS (SELECT dt, avg(ret) AS mkt FROM ret_d WHERE ret IS NOT NULL GROUP BY 1), w AS (SELECT unnest([3, 6, 12]) AS months), me AS (SELECT DISTINCT last_day(dt) AS month_end FROM mkd),
sp AS (SELECT month_end, months, last_day(CAST(date_trunc('month', month_end) - to_months(CAST(months - 1 AS INTEGER)) AS DATE)) AS a FROM me CROSS JOIN w), md AS (SELECT sp.month_end, months, dt, mkt FROM sp JOIN mkd ON last_day(mkd.dt) BETWEEN a AND month_end),
wh AS (SELECT month_end, months, count(*) AS n, avg(mkt) AS mx, sum(mkt * mkt) - count(*) * avg(mkt) * avg(mkt) AS sxx FROM md GROUP BY 1, 2),
ow AS (SELECT entity, md.month_end, md.months, count(*) AS nv, avg(ret) AS my, sum((ret) * mkt) AS sxy, sum(mkt) AS sxv, sum(ret * ret) AS syy FROM md JOIN ret_d r ON r.dt = md.dt WHERE ret IS NOT NULL GROUP BY 1, 2, 3)
SELECT entity, ow.month_end, CAST(ow.months AS INTEGER) AS months, round(sqrt(greatest((syy - nv * my * my - coalesce(pow(sxy - my * sxv, 2) / nullif(sxx, 0), 0)) / n, 0)), 6) AS idio FROM ow JOIN wh ON wh.month_end = ow.month_end AND wh.months = ow.months WHERE nv >= floor(0.2 * n)"""


@add("ind16_window_idio_vol", _IV)
def ind16(s, d):
    p = t.ret_d(s, d)
    p = p.join(F.broadcast(p.where("ret is not null").groupBy("dt").agg(F.avg("ret").alias("mkt"))), "dt")
    return gen.window_idio_vol(p.select("entity", "dt", "ret", "mkt"), [3, 6, 12], coverage=0.2).withColumn("idio", r("idio"))


# estimates of a consensus stand in by the rows of one volume in three
_CON = f"{PXD}, con AS (SELECT entity, dt, amount / 100 AS profit, volume + 0.7 AS shares FROM px_d WHERE CAST(volume AS BIGINT) % 3 = 0), cj AS (SELECT p.entity, p.dt, p.close, profit, profit / nullif(shares, 0) AS per_share, profit / nullif(p.close, 0) AS per_close FROM px_d p LEFT JOIN con ON con.entity = p.entity AND con.dt = p.dt)"


def _con(s, d):
    p = t.px_d(s, d)
    con = p.where(F.col("volume").cast("long") % 3 == 0).select("entity", "dt", (F.col("amount") / 100).alias("profit"), (F.col("volume") + 0.7).alias("shares"))
    j = p.select("entity", "dt", "close").join(con, ["entity", "dt"], "left")
    return j.select("entity", "dt", "close", "profit", ratio("profit", "shares").alias("per_share"), ratio("profit", "close").alias("per_close"))


def _chg(x: str, spans: tuple[int, ...], limit: int) -> str:
    cols = ", ".join(f"round(p / nullif(lag(p, {n}) OVER {WE}, 0) - 1, 5) + 0.0 AS g_{n}, round(v - lag(v, {n}) OVER {WE}, 5) + 0.0 AS chg_{n}" for n in spans)
    return f"""fl AS (SELECT *, last_value({x} IGNORE NULLS) OVER (PARTITION BY entity ORDER BY dt ROWS BETWEEN {limit} PRECEDING AND CURRENT ROW) AS v FROM cj), fp AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY entity ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM fl)
SELECT entity, dt, {cols} FROM fp"""


for _name in ("per_share", "per_close"):

    @add(f"ind17_consensus_{_name}", f"WITH {_CON}, {_chg(_name, (20, 60, 180), 20)}")
    def ind17(s, d, name=_name):
        g = gen.estimate_changes(_con(s, d), name, [20, 60, 180])
        return g.select("entity", "dt", *[r(f"{k}_{n}", 5).alias(f"{k}_{n}") for n in (20, 60, 180) for k in ("g", "chg")])


@add("jn4_consensus_join", f"WITH {_CON} SELECT entity, dt, close, profit FROM cj")
def jn4(s, d):
    return _con(s, d).select("entity", "dt", "close", "profit")


@add("ind18_consensus_monthly", f"""WITH {_CON}, nx AS (SELECT *, lead(dt) OVER {WE} AS nd FROM cj), m AS (SELECT entity, last_day(dt) AS month_end, per_share AS s, profit * 2 / nullif(close, 0) AS rel FROM nx WHERE date_trunc('month', nd) <> date_trunc('month', dt)),
f AS (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY entity ORDER BY month_end ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM m)
SELECT entity, month_end, round(rel, 5) AS target_relative, """ + ", ".join(f"CASE WHEN s IS NOT NULL THEN round(p / nullif(lag(p, {n}) OVER (PARTITION BY entity ORDER BY month_end), 0) - 1, 5) + 0.0 END AS g_{n}, round(s - lag(s, {n}) OVER (PARTITION BY entity ORDER BY month_end), 5) + 0.0 AS chg_{n}" for n in (1, 3, 6)) + " FROM f")
def ind18(s, d):
    m = rs.last_rows_of_months(_con(s, d)).withColumn("dt", F.last_day("dt")).withColumn("rel", ratio(F.col("profit") * 2, "close"))
    g = gen.estimate_changes(m, "per_share", [1, 3, 6], limit=None, mask_missing=True)
    return g.select("entity", F.col("dt").alias("month_end"), r("rel", 5).alias("target_relative"), *[r(f"{k}_{n}", 5).alias(f"{k}_{n}") for n in (1, 3, 6) for k in ("g", "chg")])


@add("ind19_base_characteristics", f"""WITH {STMT}, {FDMT.replace('px_raw AS', 'px_raw AS', 1)}, y AS (SELECT entity, make_date(year(dt), 12, 31) AS dt, max_by(assets, dt) AS assets, sum(profit) AS profit, max_by(assets - cost, dt) AS equity FROM stmt GROUP BY 1, 2),
z AS (SELECT entity, dt, assets / nullif(lag(assets) OVER {WE}, 0) - 1 AS inv, profit / nullif(lag(equity) OVER {WE}, 0) AS op, profit / nullif(equity, 0) AS roe, equity FROM y),
e AS (SELECT entity, last_day(CAST(dt + to_months(CAST(6 + k AS INTEGER)) AS DATE)) AS dt, inv, op, roe, equity FROM (SELECT *, unnest(generate_series(0, 11)) AS k FROM z))
SELECT f.entity, f.dt, round(ln(cap), 6) AS log_size, round(inv, 6) + 0.0 AS inv, round(equity / nullif(cap, 0), 4) + 0.0 AS bm, round(op, 6) + 0.0 AS op, round(roe, 6) + 0.0 AS roe FROM fdmt f LEFT JOIN e ON e.entity = f.entity AND e.dt = f.dt""")
def ind19(s, d):
    y = t.stmt_q(s, d).groupBy("entity", F.make_date(F.year("dt"), F.lit(12), F.lit(31)).alias("dt")).agg(
        F.max_by("assets", "dt").alias("assets"), F.sum("profit").alias("profit"), F.max_by(F.col("assets") - F.col("cost"), "dt").alias("equity"))
    w = by_entity()
    z = y.select("entity", "dt", F.struct((ratio("assets", F.lag("assets").over(w)) - 1).alias("inv"), ratio("profit", F.lag("equity").over(w)).alias("op"), ratio("profit", "equity").alias("roe"), "equity").alias("v"))
    m = rs.yearly_to_monthly(z, "v").withColumnRenamed("month_end", "dt")
    f = t.fdmt_m(s, d).select("entity", "dt", "cap").join(m, ["entity", "dt"], "left")
    return f.select("entity", "dt", r(F.ln("cap")).alias("log_size"), r("v.inv").alias("inv"), r(ratio("v.equity", "cap"), 4).alias("bm"), r("v.op").alias("op"), r("v.roe").alias("roe"))


@add("ind20_monthly_returns_and_caps", f"""WITH {_UNI}, k AS (SELECT * FROM uni WHERE NOT suspended AND NOT young), m AS (SELECT entity, last_day(dt) AS month_end, max_by(close * (1 + entity % 5), dt) AS adj, max_by(amount, dt) AS cap FROM k GROUP BY 1, 2),
g AS (SELECT entity, last_day(CAST(unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH)) AS DATE)) AS month_end FROM (SELECT entity, min(month_end) AS a, max(month_end) AS b FROM m GROUP BY 1)),
j AS (SELECT g.entity, g.month_end, adj, cap, lag(adj) OVER (PARTITION BY g.entity ORDER BY g.month_end) AS b FROM g LEFT JOIN m ON m.entity = g.entity AND m.month_end = g.month_end)
SELECT entity, month_end, round(adj / b - 1, 6) + 0.0 AS ret_m, cap FROM j""")
def ind20(s, d):
    k = _uni(s, d).where(~un.flag("suspended") & ~F.col("young")).withColumn("factor", 1 + F.col("entity") % 5)
    k = un.adjusted(k, "factor", "close")
    m = rs.last_per_month(k, "close", "amount")
    m = rs.densify(m, rs.month_grid(m), "entity", "month_end")
    return m.select("entity", "month_end", r(ratio("close", F.lag("close").over(by_entity(None, "entity", order="month_end"))) - 1).alias("ret_m"), F.col("amount").alias("cap"))


@add("ind21_market_returns", f"WITH {FDMT} SELECT sector, dt, round(avg(ret_m), 6) + 0.0 AS ret_eq, round(sum(ret_m * cap) / nullif(sum(cap), 0), 6) + 0.0 AS ret_vw FROM fdmt WHERE ret_m IS NOT NULL GROUP BY 1, 2")
def ind21(s, d):
    return t.fdmt_m(s, d).where("ret_m is not null").groupBy("sector", "dt").agg(r(F.avg("ret_m")).alias("ret_eq"), r(pf.weighted_mean("ret_m", "cap")).alias("ret_vw"))


# ---- regressions

#: Two regressors in closed form over a table z(key, y, a, b): h has b1, b2, alpha, the residual squares and what errors need.
def _two(key: str) -> str:
    return f"""g2 AS (SELECT {key}, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, regr_sxx(y, a) AS saa, regr_sxx(y, b) AS sbb, regr_sxy(b, a) AS sab, regr_sxy(y, a) AS say, regr_sxy(y, b) AS sby, regr_syy(y, a) AS syy FROM z2 GROUP BY ALL),
h2 AS (SELECT *, (sbb * say - sab * sby) / nullif(saa * sbb - sab * sab, 0) AS b1, (saa * sby - sab * say) / nullif(saa * sbb - sab * sab, 0) AS b2 FROM g2 WHERE n > 3),
k2 AS (SELECT *, my - b1 * ma - b2 * mb AS alpha, greatest(syy - b1 * say - b2 * sby, 0) AS rss FROM h2),
f2 AS (SELECT *, alpha / sqrt(rss / (n - 3) * (1.0 / n + (ma * ma * sbb - 2 * ma * mb * sab + mb * mb * saa) / (saa * sbb - sab * sab))) AS ta, b1 / sqrt(rss / (n - 3) * sbb / (saa * sbb - sab * sab)) AS t1, b2 / sqrt(rss / (n - 3) * saa / (saa * sbb - sab * sab)) AS t2, 1 - rss / syy AS r2 FROM k2)"""


_XS = FDMT + ", x AS (SELECT *, ln(cap) AS size, volume / 100 AS vol FROM fdmt WHERE ret_m IS NOT NULL AND ret_1m IS NOT NULL)"


def _xs(s, d):
    x = t.fdmt_m(s, d).where("ret_m is not null and ret_1m is not null")
    return x.withColumns({"size": F.ln("cap"), "vol": F.col("volume") / 100})


@add("reg2_cross_section", f"WITH {_XS}, z2 AS (SELECT dt, ret_1m AS y, ret_m AS a, size AS b FROM x), {_two('dt')} SELECT dt, n, round(alpha, 5) + 0.0 AS alpha, round(b1, 5) + 0.0 AS b_ret, round(t1, 4) + 0.0 AS t_ret, round(b2, 5) + 0.0 AS b_size, round(t2, 4) + 0.0 AS t_size, round(r2, 5) + 0.0 AS r2 FROM f2")
def reg2(s, d):
    o = md.ols_multi(_xs(s, d), "ret_1m", ["ret_m", "size"], "dt").where("n > 3")
    return o.select("dt", "n", r("alpha", 5).alias("alpha"), r(F.col("betas")[0], 5).alias("b_ret"), r(F.col("ts")[0], 4).alias("t_ret"), r(F.col("betas")[1], 5).alias("b_size"), r(F.col("ts")[1], 4).alias("t_size"), r("r2", 5).alias("r2"))


_NW = " + ".join(f"2 * (1 - {k} / 6.0) * coalesce(sum(l{k}), 0)" for k in range(1, 6))
_FMC = f"""WITH {_XS}, l AS (SELECT entity, dt, ret_1m, size, unnest(['ret_m', 'vol']) AS indicator, unnest([ret_m, vol]) AS v FROM x), z2 AS (SELECT indicator, dt, ret_1m AS y, v AS a, size AS b FROM l), {_two('indicator, dt')},
sl AS (SELECT indicator, 'size' AS controls, dt, b1 AS s FROM f2 UNION ALL SELECT indicator, 'none', dt, regr_slope(ret_1m, v) FROM l GROUP BY 1, 3 HAVING count(*) > 2 AND regr_sxx(ret_1m, v) > 0),
u AS (SELECT *, s - avg(s) OVER (PARTITION BY indicator, controls) AS u FROM sl), lg AS (SELECT *, {", ".join(f"u * lag(u, {k}) OVER (PARTITION BY indicator, controls ORDER BY dt) AS l{k}" for k in range(1, 6))} FROM u)
SELECT indicator, controls, count(*) AS periods, round(avg(s), 6) + 0.0 AS mean, round(avg(s) / nullif(sqrt(greatest(sum(u * u) + {_NW}, 0)) / count(*), 0), 3) + 0.0 AS t FROM lg GROUP BY 1, 2"""


@add("reg5_fama_macbeth_controls", _FMC)
def reg5(s, d):
    x = _xs(s, d)
    long = x.select("entity", "dt", "ret_1m", "size", F.explode(F.array(*[F.struct(F.lit(c).alias("indicator"), F.col(c).alias("v")) for c in ("ret_m", "vol")])).alias("i")).select("entity", "dt", "ret_1m", "size", "i.*")
    with_ = rg.controlled_slopes(long, "ret_1m", "v", ["size"], 5, "indicator").withColumn("controls", F.lit("size"))
    none = rg.fama_macbeth(long, "ret_1m", "v", 5, "indicator").withColumn("controls", F.lit("none"))
    return with_.unionByName(none).select("indicator", "controls", "periods", r("mean").alias("mean"), r("t", 3).alias("t"))


_TMB = _PRED + f""", pb AS (SELECT dt, ret_1m, {bucket('predicted', 5, 'dt')} AS g FROM (SELECT * FROM pr WHERE indicator = 'ret_m' AND predicted IS NOT NULL)), tm AS (SELECT dt, avg(ret_1m) FILTER (WHERE g = 5) - avg(ret_1m) FILTER (WHERE g = 1) AS tmb FROM pb GROUP BY 1),
mkn AS (SELECT dt, avg(ret_1m) AS mkt FROM x GROUP BY 1), si AS (SELECT industry, dt, avg(ret_1m) AS ret FROM x GROUP BY 1, 2)"""


@add("reg7_augmented_pricing", f"WITH {_TMB}, z2 AS (SELECT industry, ret AS y, mkt AS a, tmb AS b FROM si JOIN mkn ON mkn.dt = si.dt JOIN tm ON tm.dt = si.dt WHERE tmb IS NOT NULL), {_two('industry')} SELECT industry, n, round(alpha, 5) + 0.0 AS alpha, round(ta, 4) + 0.0 AS t, round(b2, 5) + 0.0 AS beta_tmb FROM f2")
def reg7(s, d):
    ports = pf.sorted_portfolios(_pred(s, d).where("indicator = 'ret_m'").withColumn("w", F.lit(1.0)), "predicted", "ret_1m", "w", 5)
    tmb = pf.spread(ports, 5).select("dt", F.col("spread_eq").alias("tmb"))
    x = t.fdmt_m(s, d).where("ret_m is not null and ret_1m is not null")
    bench = x.groupBy("dt").agg(F.avg("ret_1m").alias("mkt")).join(tmb, "dt")
    assets = x.groupBy("industry", "dt").agg(F.avg("ret_1m").alias("ret")).join(F.broadcast(bench), "dt")
    o = md.ols_multi(assets, "ret", ["mkt", "tmb"], "industry").where("n > 3")
    return o.select("industry", "n", r("alpha", 5).alias("alpha"), r("alpha_t", 4).alias("t"), r(F.col("betas")[1], 5).alias("beta_tmb"))


@add("reg11_spanning_regressions", f"WITH {_ST}, z2 AS (SELECT industry, ret AS y, mkt AS a, smb AS b FROM st JOIN mk ON mk.dt = st.dt JOIN sz ON sz.dt = st.dt WHERE smb IS NOT NULL), {_two('industry')} SELECT industry, round(alpha, 6) + 0.0 AS alpha, round(ta, 4) + 0.0 AS t, round(1 - (1 - r2) * (n - 1) / (n - 3), 5) + 0.0 AS adj_r2 FROM f2")
def reg11(s, d):
    z = _st(s, d).join(F.broadcast(_factors(s, d)), "dt")
    o = md.ols_multi(z, "ret", ["mkt", "smb"], "industry").where("n > 3")
    return o.select("industry", r("alpha").alias("alpha"), r("alpha_t", 4).alias("t"), r(1 - (1 - F.col("r2")) * (F.col("n") - 1) / (F.col("n") - 3), 5).alias("adj_r2"))


@add("reg13_summary", f"""WITH {_ST}, o AS (SELECT sector, industry, 'market' AS bench, st.ret AS y, mkt AS a FROM st JOIN mk ON mk.dt = st.dt UNION ALL SELECT sector, industry, 'size', st.ret, smb FROM st JOIN sz ON sz.dt = st.dt WHERE smb IS NOT NULL),
g AS (SELECT sector, industry, bench, count(*) AS n, avg(y) AS my, avg(a) AS ma, regr_slope(y, a) AS b, regr_sxx(y, a) AS sxx, regr_syy(y, a) AS syy, regr_sxy(y, a) AS sxy FROM o GROUP BY 1, 2, 3),
h AS (SELECT sector, bench, my - b * ma AS alpha, (my - b * ma) / nullif(sqrt(greatest(syy - b * sxy, 0) / (n - 2) * (1.0 / n + ma * ma / nullif(sxx, 0))), 0) AS t FROM g WHERE n > 2)
SELECT sector, bench, count(*) AS n, round(avg(alpha), 6) + 0.0 AS mean_alpha, round(avg(abs(t)), 4) AS mean_t, count(*) FILTER (WHERE abs(t) > 1) AS large, round(max(abs(t)), 4) AS max_t FROM h GROUP BY 1, 2""")
def reg13(s, d):
    f = F.explode(F.array(*[F.struct(F.lit(n).alias("bench"), F.col(c).alias("a")) for n, c in (("market", "mkt"), ("size", "smb"))]))
    x = _st(s, d).join(F.broadcast(_factors(s, d)), "dt").select("sector", "industry", "ret", f.alias("f")).select("sector", "industry", "ret", "f.*")
    o = rg.ols(x, "ret", "a", "sector", "industry", "bench").where("n > 2").withColumn("size_t", F.abs("t"))
    return o.groupBy("sector", "bench").agg(F.count("*").alias("n"), r(F.avg("alpha")).alias("mean_alpha"), r(F.avg("size_t"), 4).alias("mean_t"), F.count_if(F.col("size_t") > 1).alias("large"), r(F.max("size_t"), 4).alias("max_t"))


# ---- bootstraps

def _zz(s, d):
    return _mk(s, d).select("entity", "dt", "ret_m", "mkt")


@add("bst5_pairs", f"WITH {_MK}, {_D}, dk AS (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS k FROM (SELECT DISTINCT dt FROM z)), bs AS (SELECT rep, entity, ret_m, mkt FROM d3 JOIN dk ON dk.k = d3.z % (SELECT count(*) FROM dk) JOIN z ON z.dt = dk.dt) " + _OLS.format(k="rep, entity", t="bs"))
def bst5(s, d):
    return _ols_out(rg.bootstrap_alpha(_zz(s, d), "ret_m", "mkt", 20, remove_alpha=False), "rep", "entity")


_RS = f"{_FIT}, dk AS (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS k FROM (SELECT DISTINCT dt FROM z)), rw AS (SELECT z.entity, k, mkt, n, b, ret_m - a - b * mkt AS e, row_number() OVER (PARTITION BY z.entity ORDER BY z.dt) - 1 AS pos FROM z JOIN ft ON ft.entity = z.entity JOIN dk ON dk.dt = z.dt WHERE b IS NOT NULL)"


@add("bst4_cross_section", f"WITH {_MK}, {_D}, {_RS}, bs AS (SELECT rep, x.entity, x.mkt, x.b * x.mkt + y.e AS ret_m FROM d3 JOIN rw x ON x.k = d3.pos JOIN rw y ON y.entity = x.entity AND y.k = d3.z % (SELECT count(*) FROM dk)) " + _OLS.format(k="rep, entity", t="bs"))
def bst4(s, d):
    return _ols_out(rg.bootstrap_cross_section(_zz(s, d), "ret_m", "mkt", 20), "rep", "entity")


_D13 = _D.replace("+ 7) % 2147483647", "+ 13) % 2147483647")


@add("bst3_residual_and_factor", f"""WITH {_MK}, {_D13}, {_RS}, gd AS (SELECT rw.*, rep FROM rw CROSS JOIN (SELECT unnest(range(10)) AS rep)), {_drawn("gd", "rep, entity, mkt, n, b, k", "rep * 1000003 + pos * 7919 + 7 + entity * 50021", "q")}, mm AS (SELECT k, max(mkt) AS m FROM rw GROUP BY 1),
fd AS (SELECT rep, pos, m FROM d3 JOIN mm ON mm.k = d3.z % (SELECT count(*) FROM dk)), bs AS (SELECT q3.rep, q3.entity, q3.mkt, q3.b * fd.m + rw.e AS ret_m FROM q3 JOIN rw ON rw.entity = q3.entity AND rw.pos = q3.z % q3.n JOIN fd ON fd.rep = q3.rep AND fd.pos = q3.k) """ + _OLS.format(k="rep, entity", t="bs"))
def bst3(s, d):
    return _ols_out(rg.bootstrap_residual_and_factor(_zz(s, d), "ret_m", "mkt", 10), "rep", "entity")


# ---- scaled intercepts: the industries as assets, the sectors' returns as candidates

_SI = _ST + ", cd AS (SELECT sector AS candidate, dt, avg(rm) AS f FROM x GROUP BY 1, 2), sj AS (SELECT candidate, industry, st.dt, ret, f FROM st JOIN cd ON cd.dt = st.dt)"


def _sit(table: str, key: str) -> str:
    return f"""SELECT {key}, (avg(a1) - avg(a0)) / nullif(avg(a0), 0) AS si_mean, (median(a1) - median(a0)) / nullif(median(a0), 0) AS si_median FROM (SELECT {key}, industry, abs(avg(ret)) / nullif(stddev_samp(ret) / sqrt(count(*)), 0) AS a0,
abs(avg(ret) - regr_slope(ret, f) * avg(f)) / nullif(stddev_samp(ret) / sqrt(count(*)), 0) AS a1 FROM {table} GROUP BY ALL) WHERE a0 IS NOT NULL AND a1 IS NOT NULL GROUP BY ALL"""


def _sj(s, d):
    st = _st(s, d).select(F.col("industry").alias("asset"), "dt", "ret")
    cd = t.fdmt_m(s, d).where("ret_m is not null").groupBy(F.col("sector").alias("candidate"), "dt").agg(F.avg("ret_m").alias("f"))
    return st.join(cd, "dt")


@add("mod5_scaled_intercepts", f"WITH {_SI}, s AS ({_sit('sj', 'candidate')}) SELECT candidate, round(si_mean, 6) + 0.0 AS si_mean, round(si_median, 6) + 0.0 AS si_median FROM s")
def mod5(s, d):
    return rg.scaled_intercepts(_sj(s, d), "ret", "f").select("candidate", r("si_mean").alias("si_mean"), r("si_median").alias("si_median"))


_DSI = _D.replace("FROM z)", "FROM sj)")


@add("mod5_scaled_intercept_p", f"""WITH {_SI}, {_DSI}, dk AS (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS k FROM (SELECT DISTINCT dt FROM sj)), cm AS (SELECT candidate, avg(f) AS m FROM (SELECT DISTINCT candidate, dt, f FROM sj) GROUP BY 1),
pj AS (SELECT rep, sj.candidate, industry, ret, f - m AS f FROM d3 JOIN dk ON dk.k = d3.z % (SELECT count(*) FROM dk) JOIN sj ON sj.dt = dk.dt JOIN cm ON cm.candidate = sj.candidate), s AS ({_sit('sj', 'candidate')}), p AS ({_sit('pj', 'rep, candidate')}),
q AS (SELECT rep, min(si_mean) AS least FROM p GROUP BY 1)
SELECT s.candidate, round(s.si_mean, 6) + 0.0 AS si_mean, round(avg(CASE WHEN p.si_mean <= s.si_mean THEN 1.0 ELSE 0.0 END), 6) AS p_single, round(avg(CASE WHEN q.least <= s.si_mean THEN 1.0 ELSE 0.0 END), 6) AS p_multiple FROM s JOIN p ON p.candidate = s.candidate JOIN q ON q.rep = p.rep GROUP BY s.candidate, s.si_mean""")
def mod5b(s, d):
    j = _sj(s, d)
    # as many rows as there are dates, candidates and replicates of a study
    means = j.select("candidate", "dt", "f").distinct().groupBy("candidate").agg(F.avg("f").alias("m"))
    dates = j.select("dt").distinct().withColumn("k", F.row_number().over(by_all("dt")).cast("long") - 1)
    drawn = rg._date_draws(s, dates, 20, 7).select("rep", F.col("draw").alias("k")).join(dates, "k").select("rep", "dt")
    pseudo = j.join(F.broadcast(means), "candidate").withColumn("f", F.col("f") - F.col("m")).join(F.broadcast(drawn), "dt")
    real = rg.scaled_intercepts(j, "ret", "f").select("candidate", F.col("si_mean").alias("real"))
    p = rg.scaled_intercepts(pseudo, "ret", "f", "asset", "candidate", "rep").select("rep", "candidate", "si_mean")
    p = p.join(p.groupBy("rep").agg(F.min("si_mean").alias("least")), "rep").join(F.broadcast(real), "candidate")
    share = lambda c: r(F.avg((F.col(c) <= F.col("real")).cast("double")))
    return p.groupBy("candidate").agg(r(F.max("real")).alias("si_mean"), share("si_mean").alias("p_single"), share("least").alias("p_multiple"))


def by_all(order: str):
    """One window over all rows; only for tables of one row per date."""
    from pyspark.sql import Window

    return Window.orderBy(order)


# ---- sweep of combinations

@add("cmb7_parameter_sweep", f"""WITH {_VAR.replace('WHERE place <= 3', 'WHERE place <= 5')}, gd AS (SELECT b3.*, CAST(tp AS INTEGER) AS top, mode FROM b3 CROSS JOIN (SELECT unnest([1, 3, 5]) AS tp) CROSS JOIN (SELECT unnest(['equal', 'score', 'place']) AS mode) WHERE place <= tp),
gw AS (SELECT *, CASE mode WHEN 'equal' THEN 1.0 WHEN 'score' THEN score ELSE max(place) OVER (PARTITION BY top, mode, sector) + 1 - place END AS w FROM gd)
SELECT top, mode, sector, industry, h, CAST(place AS INTEGER) AS place, round(w / nullif(sum(w) OVER (PARTITION BY top, mode, sector), 0), 6) AS weight FROM gw""")
def cmb7(s, d):
    g = cb.choose_grid(_graded(s, d), "score", "industry", "sector", [1, 3, 5], ["equal", "score", "place"])
    return g.select("top", "mode", "sector", "industry", "h", "place", r("weight").alias("weight"))
