"""Accounting operators on quarterly rows of an entity, and a catalogue of named factors as declarative specs."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.core import by_entity, col, ffill, guarded, ratio

W = by_entity


def ttm_mean(x: str, q: int = 4) -> Column:
    return guarded(F.avg(x), x, W(q), q)


def ttm_sum(x: str, q: int = 4) -> Column:
    return guarded(F.sum(x), x, W(q), q)


def ttm_cumulative(df: DataFrame, x: str, out: str) -> DataFrame:
    """Trailing year of a figure that accumulates within the year: x, minus that of a year ago, plus last year's end."""
    year_end = df.where((F.month("dt") == 12)).select("entity", (F.year("dt") + 1).alias("__year"), col(x).alias("__end"))
    df = df.withColumn("__ago", F.lag(x, 4).over(W())).withColumn("__year", F.year("dt"))
    return df.join(year_end, ["entity", "__year"], "left").withColumn(out, col(x) - F.col("__ago") + F.col("__end")).drop("__year", "__ago", "__end")


def change(x: str | Column, q: int = 1) -> Column:
    return col(x) - F.lag(col(x), q).over(W())


def positive(x: str | Column) -> Column:
    return F.when(col(x) > 0, col(x))


def growth(df: DataFrame, x: str, out: str, q: int = 1, delete_negative: bool = True) -> DataFrame:
    """Growth over q rows of x (positive values only, if asked), gaps padded forward; null where x is missing."""
    df = df.withColumn("__v", positive(x) if delete_negative else col(x)).withColumn("__p", ffill("__v", W()))
    return df.withColumn(out, F.when(F.col("__v").isNotNull(), ratio("__p", F.lag("__p", q).over(W())) - 1)).drop("__v", "__p")


def mean_growth(df: DataFrame, x: str, out: str, q: int = 12) -> DataFrame:
    df = growth(df, x, "__g")
    return df.withColumn(out, guarded(F.avg("__g"), "__g", W(q), q // 2)).drop("__g")


def compound_growth(x: str | Column, q: int = 20) -> Column:
    """The product of growth inside q rows, which telescopes to the first and last of them."""
    return F.when(F.count(col(x)).over(W(q)) >= q, ratio(col(x), F.lag(col(x), q - 1).over(W())) - 1)


def history_std(x: str | Column, q: int = 8) -> Column:
    return guarded(F.stddev_samp(col(x)), col(x), W(q), q)


def downside_std(df: DataFrame, x: str, out: str, q: int = 8) -> DataFrame:
    """Deviation of the falls; a change that is missing or no fall counts as zero."""
    d = change(x)
    df = df.withColumn("__d", F.when(d < 0, d).otherwise(0.0))
    return df.withColumn(out, F.when(F.count("__d").over(W(q)) >= q, F.stddev_samp("__d").over(W(q)))).drop("__d")


def quotient(x: str | Column, y: str | Column, smooth: bool = False, delete_negative: bool = True) -> Column:
    """x / y; negative y are missing, smooth takes the mean of y and the y before."""
    y = positive(y) if delete_negative else col(y)
    return ratio(x, (y + F.lag(y).over(W())) / 2 if smooth else y)


def growth_difference(df: DataFrame, x: str, y: str, out: str, q: int = 1) -> DataFrame:
    df = growth(growth(df, x, "__gx", q), y, "__gy", q)
    return df.withColumn(out, F.col("__gx") - F.col("__gy")).drop("__gx", "__gy")


def growth_ratio(df: DataFrame, x: str, y: str, out: str, q: int = 4) -> DataFrame:
    df = growth(growth(df, x, "__gx", q), y, "__gy", q)
    return df.withColumn(out, ratio("__gx", "__gy")).drop("__gx", "__gy")


def change_over_lag(x: str, y: str, q: int = 1) -> Column:
    return ratio(change(x, q), F.lag(y, q).over(W()))


def signed_sum(text: str) -> list[tuple[int, str]]:
    """'a - b + c' to [(1, a), (-1, b), (1, c)]; anything else is an error."""
    if not re.fullmatch(r"\s*-?\s*\w+(\s*[+-]\s*\w+)*\s*", text):
        raise ValueError(f"not a signed sum of fields: {text!r}")
    return [(-1 if s == "-" else 1, f) for s, f in re.findall(r"([+-]?)\s*(\w+)", text)]


def equation(text: str) -> Column:
    """A signed sum of fields as a column."""
    return sum((sign * F.col(f) for sign, f in signed_sum(text)[1:]), signed_sum(text)[0][0] * F.col(signed_sum(text)[0][1]))


@dataclass(frozen=True)
class FactorSpec:
    """A named factor: kind of definition, numerator, denominator (signed sums of fields) and span in quarters."""

    name: str
    kind: str
    x: str
    y: str = ""
    q: int = 0

    def padded(self) -> Column | None:
        """What growth is taken of: the positive values of x, or of x / y, before gaps are padded; None for other kinds."""
        x = equation(self.x)
        return {"growth": lambda: positive(x), "ratio_growth": lambda: positive(ratio(x, positive(equation(self.y))))}.get(self.kind, lambda: None)()

    def column(self, filled: str | None = None) -> Column:
        """The factor as a column; growth needs the name of its padded values."""
        x, y = equation(self.x), equation(self.y) if self.y else None
        rows = W(self.q) if self.q else None
        if self.kind == "level":
            return x
        if self.kind == "square":
            return x * x
        if self.kind in ("growth", "ratio_growth"):
            return F.when(self.padded().isNotNull(), ratio(filled, F.lag(filled, self.q).over(W())) - 1)
        if self.kind == "compound":
            return F.when(F.count(x).over(rows) >= self.q, ratio(x, F.lag(x, self.q - 1).over(W())) - 1)
        if self.kind == "ratio_compound":
            z = ratio(x, positive(y))
            return F.when(F.count(z).over(rows) >= self.q, ratio(z, F.lag(z, self.q - 1).over(W())) - 1)
        if self.kind == "ratio":
            return quotient(x, y)
        if self.kind == "plain_ratio":
            return ratio(x, y)
        if self.kind == "smooth_ratio":
            return quotient(x, y, smooth=True)
        if self.kind == "ttm_ratio":
            return ratio(F.when(F.count(x).over(W(4)) >= 4, F.avg(x).over(W(4))), positive(y))
        if self.kind == "std":
            return F.when(F.count(x).over(rows) >= self.q, F.stddev_samp(x).over(rows))
        raise ValueError(self.kind)


_OCF, _NPX, _NPI, _EQ, _REV, _TOR = "net_cash_flows_oper_act", "net_profit_excl_min_int_inc", "net_profit_incl_min_int_inc", "tot_shrhldr_eqy_excl_min_int", "oper_rev", "tot_oper_rev"
_EBIT = f"{_NPX} + inc_tax + fin_exp"
#: The named factors and what they are made of.
CATALOG = tuple(
    FactorSpec(*row)
    for row in (
        ("G_saleEarnings_sq_yoy", "growth", "oper_profit", "", 4), ("G_earnings_sq_yoy", "growth", _NPX, "", 4), ("G_sales_sq_yoy", "growth", _REV, "", 4),
        ("G_ocfGrowth_yoy", "growth", _OCF, "", 4), ("G_netCashFlow", "growth", _OCF, "", 4), ("G_totalAssets", "growth", "tot_assets", "", 4),
        ("G_roe", "growth", "s_fa_roe", "", 4), ("G_totalOperatingRevenue", "growth", _TOR, "", 4), ("G_NetProfit", "growth", _NPX, "", 4),
        ("G_esp1Ygrowth_yoy", "ratio_growth", _NPX, "cap_stk", 4), ("G_netOperateCashFlowPerShare", "ratio_growth", _OCF, "cap_stk", 4),
        ("G_netAssetsPerShare", "growth", "tot_assets - tot_liab", "", 4), ("G_dividend3YR", "compound", "cash_div", "", 12),
        ("G_totalOperatingRevenue12Qavg", "growth", _TOR, "", 12), ("G_netProfit3YRAvg", "growth", _NPX, "", 12), ("G_netProfitCAGR3", "compound", _NPX, "", 12),
        ("G_operatingRevenueCAGR3", "compound", _REV, "", 12), ("G_earnings_ltg", "growth", _NPX, "", 20), ("G_sales_ltg", "growth", _REV, "", 20),
        ("G_epscagr5", "compound", "oper_profit", "", 20), ("G_netProfitCAGR5", "compound", _NPX, "", 20), ("G_operatingRevenueCAGR5", "compound", _REV, "", 20),
        ("Q_cashDividendCover", "ratio", _OCF, "cash_div"), ("Q_cashRateOfSales", "ratio", _OCF, _REV), ("Q_cashToCurrentLiability", "ratio", _OCF, "tot_cur_liab"),
        ("Q_cashToLiability", "ratio", _OCF, "tot_liab"), ("Q_currentAssetsToAsset", "ratio", "tot_cur_assets", "tot_assets"), ("Q_currentRatio", "ratio", "tot_cur_assets", "tot_cur_liab"),
        ("Q_debtAssetsRatio", "ratio", "tot_liab", "tot_assets"), ("Q_intangibleAssetRatio", "ratio", "intang_assets", "tot_assets"), ("Q_dividendCover", "ratio", _NPX, "cash_div"),
        ("Q_equityToAsset", "ratio", _EQ, "tot_assets"), ("Q_equityTurnover", "smooth_ratio", _TOR, "tot_assets - tot_liab"), ("Q_fixedAssetTurnover", "smooth_ratio", _TOR, "fix_assets"),
        ("Q_grossIncomeRatio", "plain_ratio", "oper_rev - oper_cost", _REV), ("Q_inventoryTurnover", "smooth_ratio", _REV, "inventories"),
        ("Q_mlev", "plain_ratio", "tot_non_cur_liab", "tot_non_cur_liab + freefloat_cap"), ("Q_netNonOItoTP", "plain_ratio", "non_oper_rev - non_oper_exp", _NPX),
        ("Q_netProfitCashCover", "ratio", _OCF, _NPX), ("Q_interestCover", "plain_ratio", _EBIT, "int_exp"), ("Q_NPCutToNetRevenue", "ratio", "net_profit_after_ded_nr_lp", _TOR),
        ("Q_netProfitRatio", "ratio", _NPI, _TOR), ("Q_netProfitToRevenue", "ratio", _NPX, _TOR), ("Q_netProfitToTotProfit", "ratio", _NPX, "oper_profit"),
        ("Q_NPCutToNetProfit", "ratio", "net_profit_after_ded_nr_lp", _NPX), ("Q_operatingExpenseRate", "ratio", "selling_dist_exp", _TOR),
        ("Q_operatingProfitToAsset", "ratio", "oper_profit", "tot_assets"), ("Q_operatingProfitToEquity", "plain_ratio", "oper_profit", "tot_assets - tot_liab"),
        ("Q_operCashInToAsset", "smooth_ratio", _OCF, "tot_assets"), ("Q_operCashInToCurrentDebt", "ratio", _OCF, _REV),
        ("Q_periodCostsRate", "plain_ratio", "oper_cost + gerl_admin_exp + fin_exp", "tot_oper_cost"), ("Q_quickRatio", "plain_ratio", "tot_cur_assets - inventories", "tot_cur_liab"),
        ("Q_receivableToPayable", "plain_ratio", "notes_rcv + acct_rcv", "notes_payable + acct_payable"), ("Q_roa", "ttm_ratio", _NPI, "tot_assets"),
        ("Q_roe_ebit", "plain_ratio", _EBIT, "tot_assets"), ("Q_roe", "ratio", _NPX, _EQ), ("Q_operatingCostToTOR", "ratio", _TOR, "tot_oper_cost"), ("Q_artRate", "level", "s_fa_arturn"),
        ("Q_earningsStability", "std", _NPI, "", 8), ("V_bp", "ratio", _EQ, "tot_assets"), ("V_ep", "ratio", _NPX, "tot_assets"), ("V_sp", "ratio", _REV, "tot_assets"),
        ("V_cfp", "ratio", _OCF, "tot_assets"), ("V_sales_EV", "plain_ratio", _REV, "tot_assets + tot_non_cur_liab - monetary_cap"), ("V_ebitda_p", "ratio", "ebitda", "cap"),
        ("V_peg_nY", "ratio_compound", "tot_assets", _NPX, 20), ("V_dp", "ratio", "cash_div", "tot_assets"), ("V_p_square", "square", "cap"), ("G_ebitToTLiability", "plain_ratio", _EBIT, _TOR),
    )
)


def factors(df: DataFrame, specs: tuple[FactorSpec, ...] = CATALOG) -> DataFrame:
    """(indicator, entity, dt, value) of all specs in one job: one sort by entity, then an unpivot."""
    fill = {(s.x, s.y): f"__fill_{i}" for i, s in enumerate(specs) if s.padded() is not None}
    df = df.withColumns({name: ffill(next(s for s in specs if (s.x, s.y) == k and s.padded() is not None).padded(), W()) for k, name in fill.items()})
    wide = df.select("entity", "dt", *[s.column(fill.get((s.x, s.y))).alias(s.name) for s in specs])
    return wide.unpivot(["entity", "dt"], [s.name for s in specs], "indicator", "value")


def pair_family(df: DataFrame, others: list[str], bases: list[str], q: int = 1) -> DataFrame:
    """Six indicators of each (other, base) pair of fields in one job: ratio, its change and growth, change over lagged
    base, difference of growth, and growth of the field; (indicator, entity, dt, value)."""
    x = df.unpivot(["entity", "dt"], others, "other", "x")
    y = df.unpivot(["entity", "dt"], bases, "base", "y")
    j = x.join(y, ["entity", "dt"]).where("other <> base")
    w = Window.partitionBy("entity", "other", "base").orderBy("dt")
    j = j.withColumns({"x0": F.lag("x", q).over(w), "y0": F.lag("y", q).over(w)})
    r1, r0, gx, gy = ratio("x", "y"), ratio("x0", "y0"), ratio(F.col("x") - F.col("x0"), "x0"), ratio(F.col("y") - F.col("y0"), "y0")
    made = {"ratio": r1, "ratio_chg": r1 - r0, "ratio_growth": ratio(r1, r0) - 1, "chg_over_lag": ratio(F.col("x") - F.col("x0"), "y0"), "growth_dif": gx - gy, "growth": gx}
    wide = j.select("entity", "dt", "other", "base", *[c.alias(k) for k, c in made.items()])
    long = wide.unpivot(["entity", "dt", "other", "base"], list(made), "kind", "value")
    return long.select(F.concat_ws("__", "kind", "other", "base").alias("indicator"), "entity", "dt", "value")
