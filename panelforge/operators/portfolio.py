"""Sorts, books, costs, returns and performance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.core import average_rank, bucket, col, ratio


def weighted_mean(value: str, weight: str) -> Column:
    """Mean by weight of the values that are there."""
    ok = col(value).isNotNull() & col(weight).isNotNull()
    return ratio(F.sum(F.when(ok, col(value) * col(weight))), F.sum(F.when(ok, col(weight))))


def sorted_portfolios(df: DataFrame, signal: str, ret: str, weight: str, groups: int, *keys: str) -> DataFrame:
    """Per (keys, bucket): rows, equal- and value-weighted mean of ret; keys may hold an indicator, so any number of
    indicators is one job."""
    keys = keys or ("dt",)
    return df.withColumn("bucket", bucket(signal, groups, *keys)).where(F.col("bucket").isNotNull()).groupBy(*keys, "bucket").agg(
        F.count("*").alias("n"), F.avg(ret).alias("ret_eq"), weighted_mean(ret, weight).alias("ret_vw")
    )


def spread(ports: DataFrame, groups: int, *keys: str) -> DataFrame:
    """Top minus bottom bucket."""
    keys = keys or ("dt",)
    pick = lambda c, b: F.max(F.when(F.col("bucket") == b, F.col(c)))
    return ports.groupBy(*keys).agg((pick("ret_eq", groups) - pick("ret_eq", 1)).alias("spread_eq"), (pick("ret_vw", groups) - pick("ret_vw", 1)).alias("spread_vw"))


def double_sort(df: DataFrame, by: str, signal: str, ret: str, outer: int, inner: int) -> DataFrame:
    """Dependent sort: buckets of signal inside buckets of `by`, mean of ret in each."""
    df = df.where(col(by).isNotNull() & col(signal).isNotNull()).withColumn("g1", bucket(by, outer, "dt"))
    df = df.withColumn("g2", bucket(signal, inner, "dt", "g1"))
    return df.groupBy("dt", "g1", "g2").agg(F.avg(ret).alias("ret"))


def mean_t(x: str) -> tuple[Column, Column]:
    """(mean, mean over its standard error)."""
    return F.avg(x), ratio(F.avg(x), F.stddev_samp(x) / F.sqrt(F.count(x).cast("double")))


def information_coefficient(df: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """Per date: slope of y on x, its t value, and the rank correlation."""
    keys = keys or ("dt",)
    df = df.where(col(x).isNotNull() & col(y).isNotNull()).withColumns({"__rx": average_rank(x, *keys), "__ry": average_rank(y, *keys)})
    a = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"),
        F.covar_samp("__rx", "__ry").alias("c"), F.stddev_samp("__rx").alias("sx"), F.stddev_samp("__ry").alias("sy"),
    )
    sse = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    t = ratio("slope", F.sqrt(ratio(sse, F.col("n") - 2) / F.nullif("sxx", F.lit(0.0))))
    return a.select(*keys, "n", "slope", F.when(F.col("n") > 2, t).alias("t"), ratio("c", F.col("sx") * F.col("sy")).alias("ic"))


def top_n(df: DataFrame, signal: str, n: int, excluded: DataFrame | None = None) -> DataFrame:
    """The n greatest signals of each day, ties by entity, without what is excluded that day."""
    df = df.where(col(signal).isNotNull())
    if excluded is not None:
        df = df.join(excluded, ["dt", "entity"], "left_anti")
    w = Window.partitionBy("dt").orderBy(F.desc(signal), "entity")
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def weights(df: DataFrame, signal: str, mode: int = 3) -> DataFrame:
    """Adds weight per day: 0 the signal, 1 clamped at three deviations, 2 the arctangent of the signal over its
    absolute sum, 3 equal; shifted to be positive, normalised, rounded to 8 digits, zeros dropped."""
    w = Window.partitionBy("dt")
    raw = {
        0: col(signal),
        1: F.least(F.greatest(col(signal), F.avg(signal).over(w) - 3 * F.stddev_samp(signal).over(w)), F.avg(signal).over(w) + 3 * F.stddev_samp(signal).over(w)),
        2: F.atan(ratio(signal, F.sum(F.abs(signal)).over(w))),
        3: F.lit(1.0),
    }[mode]
    df = df.withColumn("__w", raw).withColumn("__lo", F.min("__w").over(w))
    df = df.withColumn("__w", F.when(F.col("__lo") < 0, F.col("__w") - 2 * F.col("__lo")).otherwise(F.col("__w")))
    df = df.withColumn("weight", F.round(ratio("__w", F.sum("__w").over(w)), 8)).drop("__w", "__lo")
    return df.where(F.col("weight") != 0)


def band_membership(df: DataFrame, signal: str, enter: int, leave: int) -> DataFrame:
    """Adds held: an entity enters at a rank up to `enter` and leaves at one beyond `leave`; in between it stays as it
    was. Each entity is on its own: there is no cap on their number, so it differs from a book filled to a count."""
    rank = F.row_number().over(Window.partitionBy("dt").orderBy(F.desc(signal), "entity"))
    df = df.withColumn("place", rank)
    event = F.when(F.col("place") <= enter, 1).when(F.col("place") > leave, 0)
    w = Window.partitionBy("entity").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("held", F.coalesce(F.last(event, ignorenulls=True).over(w), F.lit(0)))


def orders(book: DataFrame) -> DataFrame:
    """(dt, entity, delta, side) between each date's book (dt, entity, weight) and that of the date before."""
    dates = book.select("dt").distinct()
    # one row per date: small by nature
    following = F.broadcast(dates.withColumn("next", F.lead("dt").over(Window.orderBy("dt"))))
    held = book.join(following, "dt").where("next is not null").select(F.col("next").alias("dt"), "entity", F.col("weight").alias("before"))
    both = book.join(held, ["dt", "entity"], "full")
    delta = F.round(F.coalesce("weight", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)), 8)
    return both.select("dt", "entity", delta.alias("delta")).withColumn("side", F.when(F.col("delta") > 0, "buy").when(F.col("delta") < 0, "sell").otherwise("keep"))


def trading_costs(trades: DataFrame, commission: float = 2e-3, stamp: float = 1e-3) -> DataFrame:
    """Cost and turnover of each date: commission on both sides, stamp tax on sales."""
    bought = F.sum(F.when(F.col("delta") > 0, F.col("delta")).otherwise(0.0))
    sold = F.sum(F.when(F.col("delta") < 0, -F.col("delta")).otherwise(0.0))
    return trades.groupBy("dt").agg((commission * (bought + sold) + stamp * sold).alias("cost"), sold.alias("turnover"))


def book_returns(book: DataFrame, returns: DataFrame, ret: str, costs: DataFrame | None = None) -> DataFrame:
    """Sum of weight times return of each date, net of costs."""
    out = book.join(returns.select("dt", "entity", ret), ["dt", "entity"], "left").groupBy("dt").agg(F.sum(F.col("weight") * F.coalesce(col(ret), F.lit(0.0))).alias("gross"))
    if costs is None:
        return out.withColumn("net", F.col("gross"))
    return out.join(costs, "dt", "left").select("dt", "gross", (F.col("gross") - F.coalesce("cost", F.lit(0.0))).alias("net"))


def hedged(df: DataFrame, ret: str, bench: str, every: int = 60, key: str = "strategy") -> DataFrame:
    """Adds nav of a long book against a benchmark, the hedge reset every so many rows: inside a segment the value is
    product(1 + p) - product(1 + b) + 1, and segments are chained."""
    w = Window.partitionBy(key).orderBy("dt")
    df = df.withColumn("segment", F.floor((F.row_number().over(w) - 1) / every))
    inside = Window.partitionBy(key, "segment").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__v", F.product(1 + col(ret)).over(inside) - F.product(1 + col(bench)).over(inside) + 1)
    last = F.when(F.row_number().over(Window.partitionBy(key, "segment").orderBy(F.desc("dt"))) == 1, F.col("__v"))
    df = df.withColumn("__end", last)
    before = F.product(F.coalesce("__end", F.lit(1.0))).over(Window.partitionBy(key).orderBy("segment").rangeBetween(Window.unboundedPreceding, -1))
    return df.withColumn("nav", F.coalesce(before, F.lit(1.0)) * F.col("__v")).drop("__v", "__end")


def performance(df: DataFrame, ret: str, bench: str, periods: int = 252, rf: float = 0.0, *keys: str) -> DataFrame:
    """One row per key: total and annual return, beta, alpha, volatility, Sharpe and information ratio, drawdown."""
    keys = keys or ("strategy",)
    w = Window.partitionBy(*keys).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__nav", F.product(1 + col(ret)).over(w)).withColumn("__dd", ratio("__nav", F.max("__nav").over(w)) - 1)
    # the running maximum needs the running product first
    a = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.max_by("__nav", "dt").alias("last"), F.regr_slope(ret, bench).alias("beta"), F.avg(ret).alias("m"), F.avg(bench).alias("mb"),
        F.stddev_samp(ret).alias("sd"), F.avg(col(ret) - col(bench)).alias("ma"), F.stddev_samp(col(ret) - col(bench)).alias("sda"), F.min("__dd").alias("max_drawdown"),
    )
    annual = F.pow(F.greatest("last", F.lit(0.0)), F.lit(float(periods)) / F.col("n")) - 1
    return a.select(
        *keys, "n", (F.col("last") - 1).alias("total"), annual.alias("annual"), "beta", ((F.col("m") - rf / periods - F.col("beta") * (F.col("mb") - rf / periods)) * periods).alias("alpha"),
        (F.col("sd") * periods**0.5).alias("volatility"), ratio((F.col("m") - rf / periods) * periods**0.5, "sd").alias("sharpe"), ratio(F.col("ma") * periods**0.5, "sda").alias("information"), "max_drawdown",
    )
