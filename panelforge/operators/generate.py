"""Families of indicators made from statement fields, from rows of a sheet, and from consensus estimates."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.core import by_entity, col, ffill, ratio
from panelforge.functions.registry import operator, register_operator
from panelforge.operators import accounting as acc

#: Indicators of one field: name, and what adds column `out` to a panel.
ONE: dict[str, Callable[[DataFrame, str, str, int], DataFrame]] = {
    "x_chg": lambda d, x, out, q: d.withColumn(out, acc.change(x, 4)),
    "x_pct_chg": lambda d, x, out, q: acc.growth(d, x, out, 4),
    "x_history_growth_avg": lambda d, x, out, q: acc.mean_growth(d, x, out, q),
    "x_square": lambda d, x, out, q: d.withColumn(out, col(x) * col(x)),
    "x_history_downside_std": lambda d, x, out, q: acc.downside_std(d, x, out, q),
    "x_history_growth_downside_std": lambda d, x, out, q: acc.downside_std(acc.growth(d, x, "__g"), "__g", out, q).drop("__g"),
}


def _of_ratio(f: Callable[[DataFrame, str, int], DataFrame]) -> Callable[[DataFrame, str, str, str, int], DataFrame]:
    """An indicator of the ratio of two fields, which is column __q while it is made."""
    return lambda d, x, y, out, q: f(d.withColumn("__q", acc.quotient(x, y)), out, q).drop("__q")


#: Indicators of a field and a base field.
TWO: dict[str, Callable[[DataFrame, str, str, str, int], DataFrame]] = {
    "ratio": lambda d, x, y, out, q: d.withColumn(out, acc.quotient(x, y)),
    "ratio_chg": _of_ratio(lambda d, out, q: d.withColumn(out, acc.change("__q", 4))),
    "ratio_pct_chg": _of_ratio(lambda d, out, q: acc.growth(d, "__q", out, 4)),
    "ratio_history_std": _of_ratio(lambda d, out, q: d.withColumn(out, acc.history_std("__q", q))),
    "ratio_history_compound_growth": _of_ratio(lambda d, out, q: d.withColumn(out, acc.compound_growth("__q", q))),
    "ratio_history_downside_std": _of_ratio(lambda d, out, q: acc.downside_std(d, "__q", out, q)),
    "pct_chg_dif": lambda d, x, y, out, q: acc.growth_difference(d, x, y, out, 4),
    "ratio_x_chg_over_lag_y": lambda d, x, y, out, q: d.withColumn(out, acc.change_over_lag(x, y, 4)),
    "ratio_of_growth_rates": lambda d, x, y, out, q: acc.growth_ratio(d, x, y, out, 4),
}


def quarterly_family(df: DataFrame, fields: Sequence[str], bases: Sequence[str], q: int = 8) -> DataFrame:
    """(indicator, entity, dt, value): all indicators of each field and base, and of each (field, base) pair. The field, or
    the pair, is a part of the key, so the plan has one window for each kind of indicator, however many fields there are."""
    key = lambda *names: F.struct("entity", *names)
    one = df.unpivot(["entity", "dt"], [*fields, *bases], "field", "x").select(key("field").alias("entity"), "dt", "x")
    for name, f in ONE.items():
        one = f(one, "x", name, q)
    x, y = df.unpivot(["entity", "dt"], list(fields), "field", "x"), df.unpivot(["entity", "dt"], list(bases), "base", "y")
    two = x.join(y, ["entity", "dt"]).select(key("field", "base").alias("entity"), "dt", "x", "y")
    for name, g in TWO.items():
        two = g(two, "x", "y", name, q)
    one, two = one.unpivot(["entity", "dt"], list(ONE), "kind", "value"), two.unpivot(["entity", "dt"], list(TWO), "kind", "value")
    named = lambda d, *names: d.select(F.concat_ws("__", "kind", *names).alias("indicator"), "entity.entity", "dt", "value")
    return named(one, "entity.field").unionByName(named(two, "entity.field", "entity.base"))


def _of_one(f: Callable) -> Callable:
    return lambda df, x, out, q=8: f(df, x, out, q)


def _of_two(f: Callable) -> Callable:
    return lambda df, x, y, out, q=8: f(df, x, y, out, q)


for _name, _f in ONE.items():
    register_operator(_name, _of_one(_f))
for _name, _f in TWO.items():
    register_operator(_name, _of_two(_f))


def from_rows(df: DataFrame, rows: Iterable[dict]) -> DataFrame:
    """(indicator, entity, dt, value) of indicators that a sheet names: each row has type, name, numerator, denominator,
    function and its span q. Functions are those of functions.registry, the user's among them: looked up, checked, never
    evaluated; an unknown one is an error. The name of an indicator is its type, two underscores and its name; numerator
    and denominator are signed sums of fields."""
    made = []
    for row in rows:
        out, op = f"{row['type']}__{row['name']}", operator(row["function"])
        df = df.withColumn("__a", acc.equation(row["numerator"]))
        if op.inputs == 2:
            df = df.withColumn("__b", acc.equation(row["denominator"]))
        df = op.add(df, out, *("__a", "__b")[: op.inputs], q=row.get("q")).drop("__a", "__b")
        made.append(out)
    return df.unpivot(["entity", "dt"], made, "indicator", "value")


def estimate_changes(df: DataFrame, value: Column | str, spans: Sequence[int], limit: int | None = 20, mask_missing: bool = False) -> DataFrame:
    """Adds g_n and chg_n for each span of rows: growth and change of a value that is filled forward at most `limit` rows
    first. Growth pads further gaps on both sides, so that it is null only before the first value, or where the value
    itself is missing if `mask_missing`; change does not pad."""
    w = by_entity()
    df = df.withColumn("__d", col(value) if limit is None else ffill(value, w, limit)).withColumn("__p", ffill("__d", w))
    out = {}
    for n in spans:
        g = ratio("__p", F.lag("__p", n).over(w)) - 1
        out |= {f"g_{n}": F.when(F.col("__d").isNotNull(), g) if mask_missing else g, f"chg_{n}": F.col("__d") - F.lag("__d", n).over(w)}
    return df.withColumns(out).drop("__d", "__p")


def window_idio_vol(daily: DataFrame, months: Sequence[int], ret: str = "ret", mkt: str = "mkt", coverage: float = 0.6) -> DataFrame:
    """(entity, month_end, months, idio): deviation of the residuals of daily returns on the market's, over the trailing
    calendar months of each month end. The market has every trading day; an entity's missing days count as the mean of
    those it has, which must be `coverage` of all. Everything is a sum per (entity, month end), and the market's days are
    one row each."""
    spans = F.explode(F.filter(F.array(*[F.struct(F.lit(n).alias("months"), F.lit(n).alias("reach")) for n in months]), lambda s: s["reach"] > F.col("__k")))
    longest = max(months)
    reach = lambda d: d.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(longest - 1)))).withColumn("month_end", F.last_day(F.add_months("dt", F.col("__k")))).withColumn("__s", spans)
    market = daily.where(col(mkt).isNotNull()).groupBy("dt").agg(F.max(mkt).alias("m"))
    whole = reach(market).groupBy("month_end", "__s.months").agg(F.count("*").alias("n"), F.sum("m").alias("sx"), F.sum(F.col("m") * F.col("m")).alias("sxx"))
    own = daily.where(col(ret).isNotNull() & col(mkt).isNotNull()).select("entity", "dt", col(ret).alias("r"), col(mkt).alias("m"))
    # monthly sums first, so that the repeats are of months and not of days
    monthly = own.groupBy("entity", F.last_day("dt").alias("dt")).agg(
        F.count("*").alias("nv"), F.sum("r").alias("sy"), F.sum("m").alias("sxv"), F.sum(F.col("r") * F.col("m")).alias("sxy"), F.sum(F.col("r") * F.col("r")).alias("syy"))
    sums = reach(monthly).groupBy("entity", "month_end", "__s.months").agg(*[F.sum(c).alias(c) for c in ("nv", "sy", "sxv", "sxy", "syy")])
    last = market.agg(F.last_day(F.max("dt")).alias("__last"))
    j = sums.join(F.broadcast(whole), ["month_end", "months"]).crossJoin(F.broadcast(last)).where("month_end <= __last")
    mean = F.col("sy") / F.col("nv")
    num, den = F.col("sxy") - mean * F.col("sxv"), F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    var = (F.col("syy") - F.col("nv") * mean * mean - F.coalesce(ratio(num * num, den), F.lit(0.0))) / F.col("n")
    ok = F.col("nv") >= F.floor(coverage * F.col("n"))
    return j.where(ok).select("entity", "month_end", "months", F.sqrt(F.greatest(var, F.lit(0.0))).alias("idio"))
