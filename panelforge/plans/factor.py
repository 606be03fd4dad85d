"""Queries of the accounting, sorting, regression, bootstrap and portfolio operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.core import ratio
from panelforge.operators import accounting as acc
from panelforge.operators import portfolio as pf
from panelforge.operators import regress as rg
from panelforge.operators import ts
from panelforge.plans.base_sql import FDMT, RETD, STMT, WE, bucket, guard, we
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


def column(name: str, make, expr: str, digits: int = 6):
    """A single expression over the quarterly panel."""
    add(name, f"WITH {STMT} SELECT entity, dt, round({expr}, {digits}) + 0.0 AS value FROM stmt")(lambda s, d: t.stmt_q(s, d).select("entity", "dt", r(make(), digits).alias("value")))


def frame(name: str, make, ctes: str, expr: str, digits: int = 6):
    """An operator that adds column v to the quarterly panel; ctes end in a table named last."""
    add(name, f"WITH {STMT}, {ctes} SELECT entity, dt, round({expr}, {digits}) + 0.0 AS value FROM last_")(lambda s, d: make(t.stmt_q(s, d)).select("entity", "dt", r("v", digits).alias("value")))


def _lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER {WE}"


def _growth(x: str, out: str, q: int, table: str, name: str) -> str:
    """CTEs: positive x, padded forward, its growth over q rows as `out` in a table `name`."""
    return f"""{name}_p AS (SELECT *, CASE WHEN {x} > 0 THEN {x} END AS {out}_v FROM {table}),
{name}_f AS (SELECT *, last_value({out}_v IGNORE NULLS) OVER (PARTITION BY entity ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {out}_f FROM {name}_p),
{name} AS (SELECT *, CASE WHEN {out}_v IS NOT NULL THEN {out}_f / nullif(lag({out}_f, {q}) OVER {WE}, 0) - 1 END AS {out} FROM {name}_f)"""


column("acc1_ttm_mean", lambda: acc.ttm_mean("revenue"), guard("avg(revenue)", "revenue", 4), 3)
column("acc2_ttm_sum", lambda: acc.ttm_sum("revenue"), guard("sum(revenue)", "revenue", 4), 4)
column("acc4_change", lambda: acc.change("revenue", 4), f"revenue - {_lag('revenue', 4)}", 4)
column("acc7_square", lambda: F.col("units") * F.col("units"), "units * units", 2)
column("acc8_compound_growth", lambda: acc.compound_growth("revenue", 8), f"CASE WHEN count(revenue) OVER {we(8)} >= 8 THEN revenue / nullif({_lag('revenue', 7)}, 0) - 1 END")
column("acc9_history_std", lambda: acc.history_std("revenue", 8), guard("stddev_samp(revenue)", "revenue", 8), 2)
column("acc13_ratio", lambda: acc.quotient("revenue", "profit"), "revenue / nullif(CASE WHEN profit > 0 THEN profit END, 0)")
column("acc13_ratio_smooth", lambda: acc.quotient("revenue", "assets", smooth=True), f"revenue / nullif((assets + {_lag('assets')}) / 2, 0)")
column("acc18_change_over_lag", lambda: acc.change_over_lag("revenue", "assets", 4), f"(revenue - {_lag('revenue', 4)}) / nullif({_lag('assets', 4)}, 0)")
column("acc20_three_ratio", lambda: ratio(F.col("revenue") - F.col("cost"), "assets"), "(revenue - cost) / nullif(assets, 0)")
column("prj3_equation", lambda: acc.equation("revenue - cost + tax"), "revenue - cost + tax", 4)

add("acc3_ttm_cumulative", f"""WITH {STMT}, e AS (SELECT entity, year(dt) + 1 AS y, revenue AS e FROM stmt WHERE month(dt) = 12), a AS (SELECT *, {_lag('revenue', 4)} AS ago FROM stmt)
SELECT a.entity, a.dt, round(revenue - ago + e, 4) + 0.0 AS value FROM a LEFT JOIN e ON e.entity = a.entity AND e.y = year(a.dt)""")(lambda s, d: acc.ttm_cumulative(t.stmt_q(s, d), "revenue", "v").select("entity", "dt", r("v", 4).alias("value")))
frame("acc5_growth", lambda x: acc.growth(x, "profit", "v", 4), _growth("profit", "g", 4, "stmt", "last_"), "g", 5)
frame("acc6_mean_growth", lambda x: acc.mean_growth(x, "revenue", "v", 8), _growth("revenue", "g", 1, "stmt", "last_"), guard("avg(g)", "g", 8, 4), 5)
frame("acc10_downside_std", lambda x: acc.downside_std(x, "revenue", "v", 8), f"last_ AS (SELECT *, CASE WHEN revenue - {_lag('revenue')} < 0 THEN revenue - {_lag('revenue')} ELSE 0.0 END AS d FROM stmt)", guard("stddev_samp(d)", "d", 8), 2)
frame("acc11_growth_std", lambda x: acc.growth(x, "revenue", "g").withColumn("v", acc.history_std("g", 8)), _growth("revenue", "g", 1, "stmt", "last_"), guard("stddev_samp(g)", "g", 8), 5)
frame("acc12_growth_downside_std", lambda x: acc.downside_std(acc.growth(x, "revenue", "g"), "g", "v", 8), _growth("revenue", "g", 1, "stmt", "gg") + f", last_ AS (SELECT *, CASE WHEN g - {_lag('g')} < 0 THEN g - {_lag('g')} ELSE 0.0 END AS d FROM gg)", guard("stddev_samp(d)", "d", 8), 5)
_RT = "rt AS (SELECT *, revenue / nullif(CASE WHEN assets > 0 THEN assets END, 0) AS q FROM stmt)"
_q = lambda x: x.withColumn("q", acc.quotient("revenue", "assets"))
frame("acc14_ratio_change", lambda x: _q(x).withColumn("v", acc.change("q", 4)), f"{_RT}, last_ AS (SELECT * FROM rt)", f"q - {_lag('q', 4)}")
frame("acc15_ratio_growth", lambda x: acc.growth(_q(x), "q", "v", 4), f"{_RT}, " + _growth("q", "g", 4, "rt", "last_"), "g")
frame("acc16_ratio_history_std", lambda x: _q(x).withColumn("v", acc.history_std("q", 8)), f"{_RT}, last_ AS (SELECT * FROM rt)", guard("stddev_samp(q)", "q", 8))
frame("acc16_ratio_compound", lambda x: _q(x).withColumn("v", acc.compound_growth("q", 8)), f"{_RT}, last_ AS (SELECT * FROM rt)", f"CASE WHEN count(q) OVER {we(8)} >= 8 THEN q / nullif({_lag('q', 7)}, 0) - 1 END")
frame("acc16_ratio_downside_std", lambda x: acc.downside_std(_q(x), "q", "v", 8), f"{_RT}, last_ AS (SELECT *, CASE WHEN q - {_lag('q')} < 0 THEN q - {_lag('q')} ELSE 0.0 END AS d FROM rt)", guard("stddev_samp(d)", "d", 8))
_GG = _growth("revenue", "g", 4, "stmt", "ga") + ", " + _growth("cost", "h", 4, "ga", "last_")
frame("acc17_growth_difference", lambda x: acc.growth_difference(x, "revenue", "cost", "v", 4), _GG, "g - h", 5)
frame("acc19_growth_ratio", lambda x: acc.growth_ratio(x, "revenue", "cost", "v", 4), _GG, "g / nullif(h, 0)", 4)

_fields, _bases = ["revenue", "cost", "tax"], ["assets", "units"]
_PAIR = f"""WITH {STMT}, x AS (SELECT entity, dt, other, x FROM stmt UNPIVOT (x FOR other IN (revenue, cost, tax))), y AS (SELECT entity, dt, base, y FROM stmt UNPIVOT (y FOR base IN (assets, units))),
j AS (SELECT x.entity, x.dt, other, base, x, y, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM x JOIN y ON y.entity = x.entity AND y.dt = x.dt WINDOW w AS (PARTITION BY x.entity, other, base ORDER BY x.dt)),
k AS (SELECT entity, dt, other, base, x / nullif(y, 0) AS ratio, x / nullif(y, 0) - x0 / nullif(y0, 0) AS ratio_chg, x / nullif(y, 0) / nullif(x0 / nullif(y0, 0), 0) - 1 AS ratio_growth,
  (x - x0) / nullif(y0, 0) AS chg_over_lag, (x - x0) / nullif(x0, 0) - (y - y0) / nullif(y0, 0) AS growth_dif, (x - x0) / nullif(x0, 0) AS growth FROM j)
SELECT kind || '__' || other || '__' || base AS indicator, entity, dt, round(value, 9) + 0.0 AS value FROM k UNPIVOT INCLUDE NULLS (value FOR kind IN (ratio, ratio_chg, ratio_growth, chg_over_lag, growth_dif, growth))"""


@add("acc21_pair_family", _PAIR)
def acc21(s, d):
    x = t.stmt_q(s, d).select("entity", "dt", *_fields, *_bases)
    return acc.pair_family(x, _fields, _bases).withColumn("value", r("value", 9))


#: Statement fields of the catalogue, made of those that the given tables have.
FIELDS = {
    "oper_rev": "revenue", "tot_oper_rev": "revenue + tax", "oper_cost": "cost * 12", "tot_oper_cost": "cost * 12 + tax", "oper_profit": "profit",
    "net_profit_excl_min_int_inc": "profit - tax", "net_profit_incl_min_int_inc": "profit - tax / 2", "net_profit_after_ded_nr_lp": "profit - tax * 2",
    "net_cash_flows_oper_act": "revenue - cost * 15", "tot_assets": "assets", "tot_liab": "assets / 3 + cost", "cap_stk": "units + 100", "cash_div": "tax / 4 + units / 10", "s_fa_roe": "profit / nullif(assets, 0)",
    "tot_cur_assets": "assets / 4 + revenue", "tot_cur_liab": "assets / 5 + cost", "intang_assets": "assets / 50 + tax", "tot_shrhldr_eqy_excl_min_int": "assets - assets / 3 - cost", "fix_assets": "assets / 2 - cost",
    "inventories": "cost * 4 + units", "tot_non_cur_liab": "assets / 10 + units * 5", "freefloat_cap": "revenue * 6 + units", "cap": "revenue / 1000 + 1", "non_oper_rev": "tax / 10 + units", "non_oper_exp": "tax / 20", "inc_tax": "tax", "fin_exp": "cost / 7 + units / 3",
    "int_exp": "cost / 9 + tax / 5", "selling_dist_exp": "cost / 3 + tax / 7", "gerl_admin_exp": "cost / 2 + units", "notes_rcv": "revenue / 9 - tax / 2", "acct_rcv": "revenue / 6 + cost", "notes_payable": "cost / 2 + tax", "acct_payable": "cost + units",
    "s_fa_arturn": "revenue / nullif(assets - cost, 0)", "monetary_cap": "assets / 8 + tax", "ebitda": "profit + cost / 2",
}


def _listed(name: str, rows: list[tuple], *columns: str) -> str:
    """A CTE of long rows (entity, dt, indicator, columns) from rows of (indicator, expressions)."""
    cells = [", ".join(f"CAST({r_[i + 1]} AS DOUBLE)" for r_ in rows) for i in range(len(columns))]
    return f"{name} AS (SELECT entity, dt, unnest([{', '.join(repr(r_[0]) for r_ in rows)}]) AS indicator, " + ", ".join(f"unnest([{c}]) AS {k}" for c, k in zip(cells, columns, strict=True)) + " FROM f)"


# The definitions of the named factors once more, written out for SQL and not taken from the catalogue.
_NP, _NI, _CF, _EB = "net_profit_excl_min_int_inc", "net_profit_incl_min_int_inc", "net_cash_flows_oper_act", "net_profit_excl_min_int_inc + inc_tax + fin_exp"
_NETA, _TA, _CUT = "tot_assets - tot_liab", "tot_assets", "net_profit_after_ded_nr_lp"
_GROW = [
    ("G_saleEarnings_sq_yoy", "oper_profit", 4), ("G_earnings_sq_yoy", _NP, 4), ("G_sales_sq_yoy", "oper_rev", 4), ("G_ocfGrowth_yoy", _CF, 4), ("G_netCashFlow", _CF, 4), ("G_totalAssets", _TA, 4), ("G_roe", "s_fa_roe", 4),
    ("G_totalOperatingRevenue", "tot_oper_rev", 4), ("G_NetProfit", _NP, 4), ("G_esp1Ygrowth_yoy", f"{_NP} / nullif(CASE WHEN cap_stk > 0 THEN cap_stk END, 0)", 4),
    ("G_netOperateCashFlowPerShare", f"{_CF} / nullif(CASE WHEN cap_stk > 0 THEN cap_stk END, 0)", 4), ("G_netAssetsPerShare", _NETA, 4), ("G_totalOperatingRevenue12Qavg", "tot_oper_rev", 12),
    ("G_netProfit3YRAvg", _NP, 12), ("G_earnings_ltg", _NP, 20), ("G_sales_ltg", "oper_rev", 20),
]
_COMP = [
    ("G_dividend3YR", "cash_div", 12), ("G_netProfitCAGR3", _NP, 12), ("G_operatingRevenueCAGR3", "oper_rev", 12), ("G_epscagr5", "oper_profit", 20), ("G_netProfitCAGR5", _NP, 20), ("G_operatingRevenueCAGR5", "oper_rev", 20),
    ("V_peg_nY", f"{_TA} / nullif(CASE WHEN {_NP} > 0 THEN {_NP} END, 0)", 20),
]
_OVER_POSITIVE = [
    ("Q_cashDividendCover", _CF, "cash_div"), ("Q_cashRateOfSales", _CF, "oper_rev"), ("Q_cashToCurrentLiability", _CF, "tot_cur_liab"), ("Q_cashToLiability", _CF, "tot_liab"), ("Q_currentAssetsToAsset", "tot_cur_assets", _TA),
    ("Q_currentRatio", "tot_cur_assets", "tot_cur_liab"), ("Q_debtAssetsRatio", "tot_liab", _TA), ("Q_intangibleAssetRatio", "intang_assets", _TA), ("Q_dividendCover", _NP, "cash_div"),
    ("Q_equityToAsset", "tot_shrhldr_eqy_excl_min_int", _TA), ("Q_netProfitCashCover", _CF, _NP), ("Q_NPCutToNetRevenue", _CUT, "tot_oper_rev"), ("Q_netProfitRatio", _NI, "tot_oper_rev"), ("Q_netProfitToRevenue", _NP, "tot_oper_rev"),
    ("Q_netProfitToTotProfit", _NP, "oper_profit"), ("Q_NPCutToNetProfit", _CUT, _NP), ("Q_operatingExpenseRate", "selling_dist_exp", "tot_oper_rev"), ("Q_operatingProfitToAsset", "oper_profit", _TA),
    ("Q_operCashInToCurrentDebt", _CF, "oper_rev"), ("Q_roe", _NP, "tot_shrhldr_eqy_excl_min_int"), ("Q_operatingCostToTOR", "tot_oper_rev", "tot_oper_cost"), ("V_bp", "tot_shrhldr_eqy_excl_min_int", _TA), ("V_ep", _NP, _TA),
    ("V_sp", "oper_rev", _TA), ("V_cfp", _CF, _TA), ("V_ebitda_p", "ebitda", "cap"), ("V_dp", "cash_div", _TA),
]
_OVER_ANY = [
    ("Q_grossIncomeRatio", "oper_rev - oper_cost", "oper_rev"), ("Q_mlev", "tot_non_cur_liab", "tot_non_cur_liab + freefloat_cap"), ("Q_netNonOItoTP", "non_oper_rev - non_oper_exp", _NP), ("Q_interestCover", _EB, "int_exp"),
    ("Q_operatingProfitToEquity", "oper_profit", _NETA), ("Q_periodCostsRate", "oper_cost + gerl_admin_exp + fin_exp", "tot_oper_cost"), ("Q_quickRatio", "tot_cur_assets - inventories", "tot_cur_liab"),
    ("Q_receivableToPayable", "notes_rcv + acct_rcv", "notes_payable + acct_payable"), ("Q_roe_ebit", _EB, _TA), ("V_sales_EV", "oper_rev", "tot_assets + tot_non_cur_liab - monetary_cap"), ("G_ebitToTLiability", _EB, "tot_oper_rev"),
]
_OVER_MEAN = [("Q_equityTurnover", "tot_oper_rev", _NETA), ("Q_fixedAssetTurnover", "tot_oper_rev", "fix_assets"), ("Q_inventoryTurnover", "oper_rev", "inventories"), ("Q_operCashInToAsset", _CF, _TA)]
_WI = "(PARTITION BY indicator, entity ORDER BY dt)"
_CATALOG_SQL = f"""WITH {STMT}, f AS (SELECT entity, dt, {", ".join(f"CAST({e} AS DOUBLE) AS {k}" for k, e in FIELDS.items())} FROM stmt),
{_listed("g0", _GROW, "x", "q")}, g1 AS (SELECT *, CASE WHEN x > 0 THEN x END AS v FROM g0), g2 AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY indicator, entity ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM g1),
g3 AS (SELECT a.indicator, a.entity, a.dt, CASE WHEN v IS NOT NULL THEN p / nullif(lag(p, CAST(q AS INTEGER)) OVER {_WI}, 0) - 1 END AS value FROM g2 a),
{_listed("c0", _COMP, "x", "q")}, c1 AS (SELECT *, row_number() OVER {_WI} AS n FROM c0), c2 AS (SELECT a.indicator, a.entity, a.dt, CASE WHEN (SELECT count(b.x) FROM c1 b WHERE b.indicator = a.indicator AND b.entity = a.entity AND b.n BETWEEN a.n - a.q + 1 AND a.n) >= a.q THEN a.x / nullif(lag(a.x, CAST(a.q - 1 AS INTEGER)) OVER (PARTITION BY a.indicator, a.entity ORDER BY a.dt), 0) - 1 END AS value FROM c1 a),
{_listed("p0", _OVER_POSITIVE, "x", "y")}, {_listed("a0", _OVER_ANY, "x", "y")}, {_listed("m0", _OVER_MEAN, "x", "y")}, m1 AS (SELECT *, CASE WHEN y > 0 THEN y END AS v FROM m0),
r0 AS (SELECT entity, dt, {_NI} AS x, tot_assets AS y FROM f),
al AS (SELECT indicator, entity, dt, value FROM g3 UNION ALL SELECT indicator, entity, dt, value FROM c2 UNION ALL SELECT indicator, entity, dt, CASE WHEN y > 0 THEN x / y END FROM p0 UNION ALL SELECT indicator, entity, dt, CASE WHEN y <> 0 THEN x / y END FROM a0
UNION ALL SELECT indicator, entity, dt, x / nullif((v + lag(v) OVER {_WI}) / 2, 0) FROM m1
UNION ALL SELECT 'Q_roa', entity, dt, CASE WHEN count(x) OVER {we(4)} >= 4 AND y > 0 THEN avg(x) OVER {we(4)} / y END FROM r0 UNION ALL SELECT 'Q_earningsStability', entity, dt, {guard('stddev_samp(x)', 'x', 8)} FROM r0
UNION ALL SELECT 'Q_artRate', entity, dt, s_fa_arturn FROM f UNION ALL SELECT 'V_p_square', entity, dt, cap * cap FROM f)
SELECT indicator, entity, dt, round(value, 3) + 0.0 AS value FROM al"""


@add("factor_catalog", _CATALOG_SQL)
def catalog(s, d):
    f = t.stmt_q(s, d).select("entity", "dt", *[F.expr(e).cast("double").alias(k) for k, e in FIELDS.items()])
    return acc.factors(f).withColumn("value", r("value", 3))


# ---- sorts and diagnostics on the monthly cross-section

_X = FDMT + ", x AS (SELECT *, ret_m AS sig FROM fdmt WHERE ret_m IS NOT NULL AND ret_1m IS NOT NULL)"
_PORT = f"""{_X}, b AS (SELECT *, {bucket('sig', 5, 'dt')} AS bucket FROM x),
p AS (SELECT dt, bucket, count(*) AS n, avg(ret_1m) AS ret_eq, sum(ret_1m * cap) / nullif(sum(cap), 0) AS ret_vw FROM b GROUP BY 1, 2)"""


def _x(s, d):
    return t.fdmt_m(s, d).where("ret_m is not null and ret_1m is not null").withColumn("sig", F.col("ret_m"))


@add("srt1_decile_portfolios", f"WITH {_PORT} SELECT dt, bucket, n, round(ret_eq, 6) + 0.0 AS ret_eq, round(ret_vw, 6) + 0.0 AS ret_vw FROM p")
def srt1(s, d):
    return pf.sorted_portfolios(_x(s, d), "sig", "ret_1m", "cap", 5).select("dt", "bucket", "n", r("ret_eq").alias("ret_eq"), r("ret_vw").alias("ret_vw"))


_SPREAD = _PORT + ", sp AS (SELECT dt, max(ret_eq) FILTER (WHERE bucket = 5) - max(ret_eq) FILTER (WHERE bucket = 1) AS spread_eq, max(ret_vw) FILTER (WHERE bucket = 5) - max(ret_vw) FILTER (WHERE bucket = 1) AS spread_vw FROM p GROUP BY 1)"


def _spread(s, d):
    return pf.spread(pf.sorted_portfolios(_x(s, d), "sig", "ret_1m", "cap", 5), 5)


@add("srt1_spread", f"WITH {_SPREAD} SELECT dt, round(spread_eq, 6) + 0.0 AS spread_eq, round(spread_vw, 6) + 0.0 AS spread_vw FROM sp")
def srt1b(s, d):
    return _spread(s, d).select("dt", r("spread_eq").alias("spread_eq"), r("spread_vw").alias("spread_vw"))


@add("srt4_double_sort", f"""WITH {_X}, a AS (SELECT *, {bucket('cap', 3, 'dt')} AS g1 FROM x), b AS (SELECT *, {bucket('sig', 3, 'dt', 'g1')} AS g2 FROM a)
SELECT dt, g1, g2, round(avg(ret_1m), 6) + 0.0 AS ret FROM b GROUP BY 1, 2, 3""")
def srt4(s, d):
    return pf.double_sort(_x(s, d), "cap", "sig", "ret_1m", 3, 3).withColumn("ret", r("ret"))


@add("agg6_mean_t", f"WITH {_SPREAD} SELECT round(avg(spread_eq), 6) + 0.0 AS mean, round(avg(spread_eq) / nullif(stddev_samp(spread_eq) / sqrt(count(spread_eq)), 0), 4) + 0.0 AS t FROM sp")
def agg6(s, d):
    m, tv = pf.mean_t("spread_eq")
    return _spread(s, d).agg(r(m).alias("mean"), r(tv, 4).alias("t"))


_IC = f"""{_X}, rk AS (SELECT *, rank() OVER (PARTITION BY dt ORDER BY sig) + (count(*) OVER (PARTITION BY dt, sig) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY dt ORDER BY ret_1m) + (count(*) OVER (PARTITION BY dt, ret_1m) - 1) / 2.0 AS ry FROM x),
a AS (SELECT dt, count(*) AS n, CASE WHEN regr_sxx(ret_1m, sig) > 0 THEN regr_slope(ret_1m, sig) END AS slope, regr_sxx(ret_1m, sig) AS sxx, regr_syy(ret_1m, sig) AS syy, regr_sxy(ret_1m, sig) AS sxy, covar_samp(rx, ry) / nullif(stddev_samp(rx) * stddev_samp(ry), 0) AS ic FROM rk GROUP BY 1),
ic AS (SELECT dt, n, slope, CASE WHEN n > 2 THEN slope / nullif(sqrt(greatest(syy - slope * sxy, 0) / (n - 2) / nullif(sxx, 0)), 0) END AS t, ic FROM a)"""


def _ic(s, d):
    return pf.information_coefficient(_x(s, d), "sig", "ret_1m")


@add("dia1_information_coefficient", f"WITH {_IC} SELECT dt, n, round(slope, 5) + 0.0 AS slope, round(t, 4) + 0.0 AS t, round(ic, 6) + 0.0 AS ic FROM ic")
def dia1(s, d):
    return _ic(s, d).select("dt", "n", r("slope", 5).alias("slope"), r("t", 4).alias("t"), r("ic").alias("ic"))


@add("dia3_ic_summary", f"""WITH {_IC} SELECT count(*) AS months, round(avg(ic), 6) + 0.0 AS ic_mean, round(stddev_samp(ic), 6) AS ic_std, round(avg(ic) / nullif(stddev_samp(ic), 0), 5) + 0.0 AS ir, count(*) FILTER (WHERE t > 0) AS t_positive,
count(*) FILTER (WHERE abs(t) > 2) AS t_large, count(*) FILTER (WHERE ic > 0.02) AS ic_large FROM ic""")
def dia3(s, d):
    return _ic(s, d).agg(F.count("*").alias("months"), r(F.avg("ic")).alias("ic_mean"), r(F.stddev_samp("ic")).alias("ic_std"), r(ratio(F.avg("ic"), F.stddev_samp("ic")), 5).alias("ir"), F.count_if(F.col("t") > 0).alias("t_positive"), F.count_if(F.abs("t") > 2).alias("t_large"), F.count_if(F.col("ic") > 0.02).alias("ic_large"))


@add("dia7_coverage_by_size", f"WITH {FDMT}, b AS (SELECT *, {bucket('cap', 4, 'dt')} AS bucket FROM fdmt) SELECT dt, bucket, round(CAST(count(ret_m) AS DOUBLE) / count(*), 6) AS coverage FROM b GROUP BY 1, 2")
def dia7(s, d):
    from panelforge.operators.xs import quantile

    return quantile(t.fdmt_m(s, d), "cap", 4).groupBy("dt", "bucket").agg(r(F.count("ret_m").cast("double") / F.count("*")).alias("coverage"))


_MK = f"{_X}, mk AS (SELECT dt, avg(ret_m) AS mkt FROM x GROUP BY 1), z AS (SELECT x.*, mkt FROM x JOIN mk ON mk.dt = x.dt)"
_OLS = """SELECT {k}, n, round(my - beta * mx, 6) + 0.0 AS alpha, round(beta, 5) + 0.0 AS beta, round((my - beta * mx) / nullif(sqrt(greatest(syy - beta * sxy, 0) / (n - 2) * (1.0 / n + mx * mx / nullif(sxx, 0))), 0), 4) + 0.0 AS t FROM
(SELECT {k}, count(*) AS n, regr_slope(ret_m, mkt) AS beta, regr_sxx(ret_m, mkt) AS sxx, regr_syy(ret_m, mkt) AS syy, regr_sxy(ret_m, mkt) AS sxy, avg(mkt) AS mx, avg(ret_m) AS my FROM {t} GROUP BY ALL)"""


def _mk(s, d):
    x = t.stored(_x(s, d), "panel")  # read by the rows and by their market
    return x.join(F.broadcast(x.groupBy("dt").agg(F.avg("ret_m").alias("mkt"))), "dt")


def _ols_out(df, *keys):
    return df.select(*keys, "n", r("alpha").alias("alpha"), r("beta", 5).alias("beta"), r("t", 4).alias("t"))


@add("reg1_pricing", f"WITH {_MK} " + _OLS.format(k="entity", t="z"))
def reg1(s, d):
    return _ols_out(rg.ols(_mk(s, d), "ret_m", "mkt", "entity"), "entity")


_NW = " + ".join(f"2 * (1 - {k} / 6.0) * coalesce(sum(l{k}), 0)" for k in range(1, 6))


@add("reg4_fama_macbeth", f"""WITH {_X}, sl AS (SELECT dt, count(*) AS n, regr_slope(ret_1m, sig) AS u0 FROM x GROUP BY 1 HAVING count(*) > 2 AND regr_sxx(ret_1m, sig) > 0), u AS (SELECT dt, u0, u0 - avg(u0) OVER () AS u FROM sl),
l AS (SELECT *, {", ".join(f"u * lag(u, {k}) OVER (ORDER BY dt) AS l{k}" for k in range(1, 6))} FROM u)
SELECT 'ret_m' AS indicator, count(*) AS periods, round(avg(u0), 6) + 0.0 AS mean, round(avg(u0) / nullif(sqrt(greatest(sum(u * u) + {_NW}, 0)) / count(*), 0), 4) + 0.0 AS t FROM l""")
def reg4(s, d):
    x = _x(s, d).withColumn("indicator", F.lit("ret_m"))
    return rg.fama_macbeth(x, "ret_1m", "sig", 5, "indicator").select("indicator", "periods", r("mean").alias("mean"), r("t", 4).alias("t"))



_D = "d0 AS (SELECT rep, pos, (rep * 1000003 + pos * 7919 + 7) % 2147483647 AS z FROM (SELECT unnest(range(20)) AS rep) CROSS JOIN (SELECT unnest(range((SELECT count(DISTINCT dt) FROM z))) AS pos))"
for _i, _m in enumerate((48271, 69621, 16807)):
    _D += f", e{_i} AS (SELECT rep, pos, (z * {_m} + 12345) % 2147483647 AS z FROM d{_i}), d{_i + 1} AS (SELECT rep, pos, (z * (z % 65521 + 1)) % 2147483647 AS z FROM e{_i})"
_BST = f"""WITH {_MK}, {_D}, al AS (SELECT entity, avg(ret_m) - regr_slope(ret_m, mkt) * avg(mkt) AS alpha FROM z GROUP BY 1),
dk AS (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS k FROM (SELECT DISTINCT dt FROM z)),
rows_ AS (SELECT z.entity, k, ret_m - alpha AS ret_m, mkt FROM z JOIN al ON al.entity = z.entity JOIN dk ON dk.dt = z.dt),
bs AS (SELECT rep, entity, ret_m, mkt FROM d3 JOIN rows_ ON k = d3.z % (SELECT count(*) FROM dk)) """


@add("bst1_bootstrap_alpha", _BST + _OLS.format(k="rep, entity", t="bs"))
def bst1(s, d):
    return _ols_out(rg.bootstrap_alpha(_mk(s, d).select("entity", "dt", "ret_m", "mkt"), "ret_m", "mkt", 20), "rep", "entity")


@add("bst8_bootstrap_p", _BST + f", o AS ({_OLS.format(k='rep, entity', t='bs')}), a AS ({_OLS.format(k='entity', t='z')}) SELECT a.entity, round((count(*) FILTER (WHERE o.t < a.t) + count(*) FILTER (WHERE o.t <= a.t) + CASE WHEN count(*) FILTER (WHERE o.t <= a.t) > count(*) FILTER (WHERE o.t < a.t) THEN 1 ELSE 0 END) / (2.0 * count(o.t)), 6) AS p FROM a JOIN o ON o.entity = a.entity GROUP BY 1")
def bst8(s, d):
    return _bootstrap_p(_mk(s, d).select("entity", "dt", "ret_m", "mkt"), 20)


#: Replicates of the reference. SQL repeats every row so often, so it is given for 20 and these have brute force in tests.
REPLICATES = 1000


def _bootstrap_p(z, reps):
    o = _ols_out(rg.bootstrap_alpha(z, "ret_m", "mkt", reps), "rep", "entity").select("entity", F.col("t").alias("drawn"))
    a = _ols_out(rg.ols(z, "ret_m", "mkt", "entity"), "entity").select("entity", "t")
    return a.join(o, "entity").groupBy("entity").agg(r(rg.percentile_of_score("drawn", "t")).alias("p"))


@add("bst8_bootstrap_p_1000", None)
def bst8_full(s, d):
    return _bootstrap_p(_mk(s, d).select("entity", "dt", "ret_m", "mkt"), REPLICATES)


_FIT = "ft AS (SELECT entity, n, sy - b * sx AS a, b, sqrt(greatest(syy - b * sxy, 0) / nullif(CASE WHEN n > 2 THEN n - 2 END, 0) * (1.0 / n + sx * sx / nullif(sxx, 0))) AS se FROM (SELECT entity, count(*) AS n, regr_slope(ret_m, mkt) AS b, avg(ret_m) AS sy, avg(mkt) AS sx, regr_sxx(ret_m, mkt) AS sxx, regr_syy(ret_m, mkt) AS syy, regr_sxy(ret_m, mkt) AS sxy FROM z GROUP BY 1))"


def _drawn(table: str, keep: str, start: str, name: str) -> str:
    out = f"{name}0 AS (SELECT {keep}, ({start}) % 2147483647 AS z FROM {table})"
    for i, m in enumerate((48271, 69621, 16807)):
        out += f", {name}e{i} AS (SELECT * EXCLUDE (z), (z * {m} + 12345) % 2147483647 AS z FROM {name}{i}), {name}{i + 1} AS (SELECT * EXCLUDE (z), (z * (z % 65521 + 1)) % 2147483647 AS z FROM {name}e{i})"
    return out


@add("bst2_residual_bootstrap", f"""WITH {_MK}, {_FIT}, rw AS (SELECT z.entity, row_number() OVER (PARTITION BY z.entity ORDER BY dt) - 1 AS pos, mkt, n, b, ret_m - a - b * mkt AS e FROM z JOIN ft ON ft.entity = z.entity WHERE b IS NOT NULL),
gd AS (SELECT rw.*, rep FROM rw CROSS JOIN (SELECT unnest(range(10)) AS rep)), {_drawn("gd", "rep, entity, mkt, n, b", "rep * 1000003 + pos * 7919 + 7 + entity * 50021", "q")},
bs AS (SELECT rep, q3.entity, q3.mkt, q3.b * q3.mkt + rw.e AS ret_m FROM q3 JOIN rw ON rw.entity = q3.entity AND rw.pos = q3.z % q3.n) """ + _OLS.format(k="rep, entity", t="bs"))
def bst2(s, d):
    return _ols_out(rg.bootstrap_residuals(_mk(s, d).select("entity", "dt", "ret_m", "mkt"), "ret_m", "mkt", 10), "rep", "entity")


_REP = _BST + f""", {_FIT}, rp AS (SELECT rep, entity, n, my - b * mx AS alpha, b, sqrt(greatest(syy - b * sxy, 0) / (n - 2) * (1.0 / n + mx * mx / nullif(sxx, 0))) AS se FROM
(SELECT rep, entity, count(*) AS n, regr_slope(ret_m, mkt) AS b, regr_sxx(ret_m, mkt) AS sxx, regr_syy(ret_m, mkt) AS syy, regr_sxy(ret_m, mkt) AS sxy, avg(mkt) AS mx, avg(ret_m) AS my FROM bs GROUP BY ALL))"""


@add("bst6_planted", _REP + f""", {_drawn("rp", "rp.*", "rep * 1000003 + entity * 7919 + 11", "q")}, pl AS (SELECT q3.*, row_number() OVER (PARTITION BY rep ORDER BY z % 2147483647, entity) AS k FROM q3),
pa AS (SELECT rep, pl.entity, k <= 3 AS planted, alpha + CASE WHEN k <= 3 THEN 3 * ft.se * CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END ELSE 0 END AS alpha, pl.se FROM pl JOIN ft ON ft.entity = pl.entity)
SELECT rep, entity, planted, round(alpha, 6) + 0.0 AS alpha, round(alpha / nullif(se, 0), 4) + 0.0 AS t FROM pa""")
def bst6(s, d):
    z = _mk(s, d).select("entity", "dt", "ret_m", "mkt")
    planted = rg.plant(rg.bootstrap_alpha(z, "ret_m", "mkt", 20), rg.ols(z, "ret_m", "mkt", "entity"), 3)
    return planted.select("rep", "entity", "planted", r("alpha").alias("alpha"), r("t", 4).alias("t"))


@add("bst7_replicate_bands", _REP + """, qr AS (SELECT rep, unnest([0.05, 0.5, 0.95]) AS point, unnest(quantile_cont(alpha / nullif(se, 0), [0.05, 0.5, 0.95])) AS v FROM rp GROUP BY 1), qf AS (SELECT unnest([0.05, 0.5, 0.95]) AS point, unnest(quantile_cont(a / nullif(se, 0), [0.05, 0.5, 0.95])) AS realized FROM ft)
SELECT CAST(qr.point AS DOUBLE) AS point, round(realized, 4) + 0.0 AS realized, round(quantile_cont(v, 0.05), 4) + 0.0 AS low, round(quantile_cont(v, 0.95), 4) + 0.0 AS high, round(avg(CASE WHEN v >= realized THEN 1.0 ELSE 0.0 END), 6) AS p FROM qr JOIN qf ON qf.point = qr.point GROUP BY qr.point, realized""")
def bst7(s, d):
    return _bands(_mk(s, d).select("entity", "dt", "ret_m", "mkt"), 20)


def _bands(z, reps):
    b = rg.replicate_bands(rg.bootstrap_alpha(z, "ret_m", "mkt", reps), rg.ols(z, "ret_m", "mkt", "entity"), [0.05, 0.5, 0.95])
    return b.select("point", *[r(c, 4).alias(c) for c in ("realized", "low", "high")], r("p").alias("p"))


@add("bst7_replicate_bands_1000", None)
def bst7_full(s, d):
    return _bands(_mk(s, d).select("entity", "dt", "ret_m", "mkt"), REPLICATES)


_PRED = f"""{_X}, il AS (SELECT entity, dt, ret_1m, unnest(['ret_m', 'volume']) AS indicator, unnest([ret_m, volume]) AS v FROM x), fi AS (SELECT indicator, dt, b, my - b * mv AS a FROM (SELECT indicator, dt, CASE WHEN regr_sxx(ret_1m, v) > 0 THEN regr_slope(ret_1m, v) END AS b, avg(ret_1m) AS my, avg(v) AS mv FROM il GROUP BY 1, 2 HAVING count(*) > 2)),
fs AS (SELECT indicator, dt, CASE WHEN count(a) OVER w >= 12 THEN avg(a) OVER w END AS a, CASE WHEN count(b) OVER w >= 12 THEN avg(b) OVER w END AS b FROM fi WINDOW w AS (PARTITION BY indicator ORDER BY dt ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
pr AS (SELECT il.*, a + b * v AS predicted FROM il JOIN fs ON fs.indicator = il.indicator AND fs.dt = il.dt)"""


def _pred(s, d):
    pair = F.explode(F.array(*[F.struct(F.lit(c).alias("indicator"), F.col(c).alias("v")) for c in ("ret_m", "volume")]))
    il = _x(s, d).select("entity", "dt", "ret_1m", pair.alias("i")).select("entity", "dt", "ret_1m", "i.*")
    return rg.predictions(il, "ret_1m", "v", 12, "indicator").where("predicted is not null")


@add("reg6_prediction", f"WITH {_PRED} SELECT indicator, entity, dt, round(predicted, 5) + 0.0 AS predicted FROM pr WHERE predicted IS NOT NULL")
def reg6(s, d):
    return _pred(s, d).select("indicator", "entity", "dt", r("predicted", 5).alias("predicted"))


@add("reg8_forecast_combination", f"""WITH {_PRED}, zz AS (SELECT entity, dt, ret_1m, (predicted - avg(predicted) OVER p) / nullif(stddev_samp(predicted) OVER p, 0) AS z FROM pr WHERE predicted IS NOT NULL WINDOW p AS (PARTITION BY indicator, dt)),
cz AS (SELECT entity, dt, any_value(ret_1m) AS ret_1m, round(sum(z), 9) AS score FROM zz GROUP BY 1, 2), bz AS (SELECT dt, ret_1m, {bucket("score", 5, "dt")} AS g FROM cz)
SELECT dt, count(*) AS n, round(avg(ret_1m) FILTER (WHERE g = 5) - avg(ret_1m) FILTER (WHERE g = 1), 6) + 0.0 AS spread FROM bz GROUP BY 1""")
def reg8(s, d):
    from panelforge.functions.core import bucket as buckets
    from panelforge.operators.xs import zscore

    z = _pred(s, d).withColumn("z", zscore("predicted", "indicator", "dt"))
    c = z.groupBy("entity", "dt").agg(F.first("ret_1m").alias("ret_1m"), r(F.sum("z"), 9).alias("score")).withColumn("g", buckets("score", 5, "dt"))
    return c.groupBy("dt").agg(F.count("*").alias("n"), r(F.avg(F.when(F.col("g") == 5, F.col("ret_1m"))) - F.avg(F.when(F.col("g") == 1, F.col("ret_1m")))).alias("spread"))


# ---- books and performance

_TOP = f"""{_X}, tn AS (SELECT *, row_number() OVER (PARTITION BY dt ORDER BY sig DESC, entity) AS place FROM x), tp AS (SELECT * FROM tn WHERE place <= 10)"""


@add("pf1_top_n", f"WITH {_TOP} SELECT dt, entity, CAST(place AS INTEGER) AS place FROM tp")
def pf1(s, d):
    return pf.top_n(_x(s, d), "sig", 10).select("dt", "entity", "place")


def _w(mode: str) -> str:
    raw = {"1": "least(greatest(sig, avg(sig) OVER p - 3 * stddev_samp(sig) OVER p), avg(sig) OVER p + 3 * stddev_samp(sig) OVER p)", "2": "atan(sig / nullif(sum(abs(sig)) OVER p, 0))", "3": "1.0"}[mode]
    return f"""wa AS (SELECT *, CAST({raw} AS DOUBLE) AS w0 FROM tp WINDOW p AS (PARTITION BY dt)), wb AS (SELECT *, CASE WHEN min(w0) OVER (PARTITION BY dt) < 0 THEN w0 - 2 * min(w0) OVER (PARTITION BY dt) ELSE w0 END AS w1 FROM wa),
book AS (SELECT dt, entity, round(w1 / nullif(sum(w1) OVER (PARTITION BY dt), 0), {{0}}) AS weight FROM wb)"""


@add("pf2_weights_clamped", f"WITH {_TOP}, {_w('1').format(8)} SELECT dt, entity, round(weight, 5) AS weight FROM book WHERE weight <> 0")
def pf2(s, d):
    return pf.weights(pf.top_n(_x(s, d), "sig", 10), "sig", 1).select("dt", "entity", r("weight", 5).alias("weight"))


@add("pf2_weights_arctan", f"WITH {_TOP}, {_w('2').format(8)} SELECT dt, entity, round(weight, 5) AS weight FROM book WHERE weight <> 0")
def pf2b(s, d):
    return pf.weights(pf.top_n(_x(s, d), "sig", 10), "sig", 2).select("dt", "entity", r("weight", 5).alias("weight"))


@add("pf4_band_membership", f"""WITH {_X}, a AS (SELECT dt, entity, row_number() OVER (PARTITION BY dt ORDER BY sig DESC, entity) AS place FROM x)
SELECT dt, entity, coalesce(last_value(CASE WHEN place <= 10 THEN 1 WHEN place > 30 THEN 0 END IGNORE NULLS) OVER (PARTITION BY entity ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS held FROM a""")
def pf4(s, d):
    return pf.band_membership(_x(s, d), "sig", 10, 30).select("dt", "entity", "held")


_BOOK = f"{_TOP}, {_w('3').format(8)}"
_ORD = f"""{_BOOK}, nd AS (SELECT dt, lead(dt) OVER (ORDER BY dt) AS nx FROM (SELECT DISTINCT dt FROM book)), hb AS (SELECT nx AS dt, entity, weight AS b FROM book JOIN nd ON nd.dt = book.dt WHERE nx IS NOT NULL),
od AS (SELECT dt, entity, round(coalesce(weight, 0) - coalesce(b, 0), 8) AS delta FROM book FULL JOIN hb USING (dt, entity))"""


def _book(s, d):
    return pf.weights(pf.top_n(_x(s, d), "sig", 10), "sig", 3).select("dt", "entity", "weight")


@add("pf5_orders", f"WITH {_ORD} SELECT dt, entity, delta + 0.0 AS delta, CASE WHEN delta > 0 THEN 'buy' WHEN delta < 0 THEN 'sell' ELSE 'keep' END AS side FROM od")
def pf5(s, d):
    return pf.orders(_book(s, d)).withColumn("delta", F.col("delta") + 0.0)


_COST = _ORD + """, ct AS (SELECT dt, 0.002 * sum(abs(delta)) + 0.001 * sum(CASE WHEN delta < 0 THEN -delta ELSE 0 END) AS cost, sum(CASE WHEN delta < 0 THEN -delta ELSE 0 END) AS turnover FROM od GROUP BY 1)"""


@add("pf6_costs", f"WITH {_COST} SELECT dt, round(CAST(cost AS DOUBLE), 8) AS cost, round(turnover, 6) AS turnover FROM ct")
def pf6(s, d):
    return pf.trading_costs(pf.orders(_book(s, d))).select("dt", r("cost", 8).alias("cost"), r("turnover").alias("turnover"))


_NET = _COST + """, gr AS (SELECT book.dt, sum(weight * coalesce(ret_1m, 0)) AS gross FROM book JOIN x ON x.dt = book.dt AND x.entity = book.entity GROUP BY 1), nt AS (SELECT gr.dt, gross, gross - coalesce(cost, 0) AS net FROM gr LEFT JOIN ct ON ct.dt = gr.dt)"""


def _net(s, d, x=None):
    # the panel is read by the book and the returns, the book by the orders and the returns
    x = t.stored(_x(s, d).select("dt", "entity", "sig", "ret_1m"), "panel") if x is None else x
    b = t.stored(pf.weights(pf.top_n(x, "sig", 10), "sig", 3).select("dt", "entity", "weight"), "book")
    return pf.book_returns(b, x, "ret_1m", pf.trading_costs(pf.orders(b)))


@add("pf7_book_returns", f"WITH {_NET} SELECT dt, round(gross, 6) + 0.0 AS gross, round(net, 6) + 0.0 AS net FROM nt")
def pf7(s, d):
    return _net(s, d).select("dt", r("gross").alias("gross"), r("net").alias("net"))


_STR = _NET + ", bm AS (SELECT dt, avg(ret_1m) AS bench FROM x GROUP BY 1), st AS (SELECT 'top' AS strategy, nt.dt, net / 5 AS net, bench / 5 AS bench FROM nt JOIN bm ON bm.dt = nt.dt)"


def _strategy(s, d):
    x = t.stored(_x(s, d).select("dt", "entity", "sig", "ret_1m"), "panel")
    bench = x.groupBy("dt").agg(F.avg("ret_1m").alias("bench"))
    return _net(s, d, x).join(bench, "dt").select(F.lit("top").alias("strategy"), "dt", (F.col("net") / 5).alias("net"), (F.col("bench") / 5).alias("bench"))


@add("pf8_hedged", f"""WITH {_STR}, a AS (SELECT *, (row_number() OVER (PARTITION BY strategy ORDER BY dt) - 1) // 12 AS seg FROM st),
b AS (SELECT *, product(1 + net) OVER (PARTITION BY strategy, seg ORDER BY dt) - product(1 + bench) OVER (PARTITION BY strategy, seg ORDER BY dt) + 1 AS v FROM a),
e AS (SELECT strategy, seg, max_by(v, dt) AS e FROM b GROUP BY 1, 2), p AS (SELECT *, product(e) OVER (PARTITION BY strategy ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e)
SELECT b.strategy, b.dt, round(coalesce(before, 1) * v, 6) AS nav FROM b JOIN p ON p.strategy = b.strategy AND p.seg = b.seg""")
def pf8(s, d):
    return pf.hedged(_strategy(s, d), "net", "bench", 12).select("strategy", "dt", r("nav").alias("nav"))


def _perf(key: str) -> str:
    return f"""pn AS (SELECT *, product(1 + net) OVER (PARTITION BY {key} ORDER BY dt) AS nav FROM st), pd AS (SELECT *, nav / nullif(max(nav) OVER (PARTITION BY {key} ORDER BY dt), 0) - 1 AS dd FROM pn),
pa AS (SELECT {key}, count(*) AS n, max_by(nav, dt) AS last, regr_slope(net, bench) AS beta, avg(net) AS m, avg(bench) AS mb, stddev_samp(net) AS sd, avg(net - bench) AS ma, stddev_samp(net - bench) AS sda, min(dd) AS mdd FROM pd GROUP BY 1)
SELECT {key}, n, round(last - 1, 5) + 0.0 AS total, round(pow(greatest(last, 0), 12.0 / n) - 1, 5) + 0.0 AS annual, round(beta, 5) + 0.0 AS beta, round((m - beta * mb) * 12, 5) + 0.0 AS alpha, round(sd * sqrt(12), 5) AS volatility, round(m * sqrt(12) / nullif(sd, 0), 5) + 0.0 AS sharpe,
round(ma * sqrt(12) / nullif(sda, 0), 5) + 0.0 AS information, round(mdd, 5) + 0.0 AS max_drawdown FROM pa"""


def _perf_out(df, key):
    return df.select(key, "n", *[r(c, 5).alias(c) for c in ("total", "annual", "beta", "alpha", "volatility", "sharpe", "information", "max_drawdown")])


@add("pf9_performance", f"WITH {_STR}, {_perf('strategy')}")
def pf9(s, d):
    return _perf_out(pf.performance(_strategy(s, d), "net", "bench", 12), "strategy")


@add("pf10_performance_by_year", f"WITH {_STR.replace(chr(39) + 'top' + chr(39) + ' AS strategy', 'CAST(year(nt.dt) AS INTEGER) AS yr')}, {_perf('yr')}")
def pf10(s, d):
    return _perf_out(pf.performance(_strategy(s, d).withColumn("yr", F.year("dt")), "net", "bench", 12, 0.0, "yr"), "yr")


# ---- technical indicators

_P = f"{RETD}, pd AS (SELECT * FROM ret_d)"


@add("ind1_momentum", f"WITH {RETD} SELECT entity, dt, " + ", ".join(f"round(close / nullif(lag(close, {n}) OVER {WE}, 0) - 1, 5) + 0.0 AS mom_{n}" for n in (1, 10, 20, 50)) + f", round(lag(close, 20) OVER {WE} * 0 + (close / nullif(lag(close, 50) OVER {WE}, 0) - close / nullif(lag(close, 20) OVER {WE}, 0)), 5) + 0.0 AS mom_50_20 FROM ret_d")
def ind1(s, d):
    g = ts.growth(t.ret_d(s, d), "close", 1, 10, 20, 50)
    return g.select("entity", "dt", *[r(f"mom_{n}", 5).alias(f"mom_{n}") for n in (1, 10, 20, 50)], r(F.col("mom_50") - F.col("mom_20"), 5).alias("mom_50_20"))


@add("ind3_max_return", f"WITH {RETD} SELECT entity, dt, {guard('max(ret)', 'ret', 20)} AS value FROM ret_d")
def ind3(s, d):
    return t.ret_d(s, d).select("entity", "dt", ts.ts_max("ret", 20).alias("value"))


@add("ind6_max_return_monthly", f"WITH {RETD} SELECT entity, last_day(dt) AS month_end, max(ret) AS value FROM ret_d GROUP BY 1, 2")
def ind6(s, d):
    return t.ret_d(s, d).groupBy("entity", F.last_day("dt").alias("month_end")).agg(F.max("ret").alias("value"))


@add("ind7_success", f"WITH {FDMT} SELECT entity, dt, round(1 - (rank() OVER (PARTITION BY dt ORDER BY ret_m) + (count(*) OVER (PARTITION BY dt, ret_m) - 1) / 2.0) / count(*) OVER (PARTITION BY dt), 6) + 0.0 AS value FROM fdmt WHERE ret_m IS NOT NULL")
def ind7(s, d):
    from panelforge.operators.xs import rank

    return t.fdmt_m(s, d).where("ret_m is not null").select("entity", "dt", r(1 - rank("ret_m")).alias("value"))


_TO = f"{RETD}, tv AS (SELECT entity, dt, ret, volume / 100 AS tv FROM ret_d)"


@add("ind10_turnover", f"WITH {_TO} SELECT entity, dt, " + ", ".join(f"round({guard('avg(tv)', 'tv', n, n // 2)}, 9) AS avg_{n}, round({guard('stddev_samp(tv)', 'tv', n, n // 2)}, 6) AS std_{n}" for n in (10, 60)) + " FROM tv")
def ind10(s, d):
    x = t.ret_d(s, d).withColumn("tv", F.col("volume") / 100)
    return x.select("entity", "dt", *[c for n in (10, 60) for c in (r(ts.ts_mean("tv", n, n // 2), 9).alias(f"avg_{n}"), r(ts.ts_std("tv", n, n // 2)).alias(f"std_{n}"))])


# whole volumes have exact sums, so the ratio is compared to the last bit, without rounding
@add("ind11_relative_turnover", f"WITH {RETD} SELECT entity, dt, {guard('avg(volume)', 'volume', 60, 30)} / nullif({guard('avg(volume)', 'volume', 30, 15)}, 0) AS value FROM ret_d")
def ind11(s, d):
    return t.ret_d(s, d).select("entity", "dt", ratio(ts.ts_mean("volume", 60, 30), ts.ts_mean("volume", 30, 15)).alias("value"))


@add("ind14_range_and_volatility", f"WITH {RETD} SELECT entity, dt, round({guard('max(high)', 'high', 20)} / nullif({guard('min(low)', 'low', 20)}, 0), 6) AS range_20, round({guard('stddev_samp(ret)', 'ret', 60, 30)}, 6) AS vol_60 FROM ret_d")
def ind14(s, d):
    return t.ret_d(s, d).select("entity", "dt", r(ratio(ts.ts_max("high", 20), ts.ts_min("low", 20))).alias("range_20"), r(ts.ts_std("ret", 60, 30)).alias("vol_60"))
