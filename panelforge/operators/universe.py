"""Universe filters, tradability, layer tests and the comparison of factors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.core import bucket, by_entity, col, ratio
from panelforge.operators import blocks
from panelforge.operators.clean import limit_flags
from panelforge.operators.xs import clip_mad, signal, zscore
from panelforge.sources.tables import stored


def young(listdate: str = "listdate", days: int = 365, date: str = "dt") -> Column:
    """Whether a date lies within so many days of the listing."""
    return col(date) <= F.date_add(listdate, days)


def flag(x: str) -> Column:
    """A flag whose null means false."""
    return F.coalesce(col(x), F.lit(False))


def universe(df: DataFrame, st: str = "type_st", young_: str = "young", industry: str = "industry") -> DataFrame:
    """Rows that are not under special treatment, not young and in an industry."""
    return df.where(~flag(st) & ~flag(young_) & col(industry).isNotNull())


def while_open(x: str, suspended: str = "suspended") -> Column:
    """x on the days that an entity trades, null on others."""
    return F.when(~flag(suspended), col(x))


def by_prefix(x: str, *prefixes: str) -> Column:
    """Whether a code begins with one of some characters."""
    return F.substring(col(x).cast("string"), 1, 1).isin(*prefixes)


def adjusted(df: DataFrame, factor: str, *prices: str) -> DataFrame:
    """Prices times their adjustment factor, in place."""
    return df.withColumns({p: col(p) * col(factor) for p in prices})


def tradable(df: DataFrame, price: str = "close", suspended: str = "suspended") -> DataFrame:
    """(entity, dt, can_buy, can_sell): open, and neither at the upper nor at the lower limit of the day."""
    up, down = limit_flags(price)
    free = ~flag(suspended) & ~up & ~down
    return df.select("entity", "dt", free.alias("can_buy"), free.alias("can_sell"))


def executed(trades: DataFrame, flags: DataFrame) -> DataFrame:
    """Orders (dt, entity, delta, side) with done: what of delta can be traded; a day without flags can't be traded."""
    both = trades.join(flags, ["dt", "entity"], "left")
    ok = F.when(F.col("delta") > 0, flag("can_buy")).when(F.col("delta") < 0, flag("can_sell")).otherwise(F.lit(True))
    return both.select("dt", "entity", "delta", "side", F.when(ok, F.col("delta")).otherwise(F.lit(0.0)).alias("done"))


def signal_after(df: DataFrame, x: str, least_rows: int, after, lookback: int = 62) -> DataFrame:
    """The signals of dates later than `after`, from the rows of at most `lookback` days before it: what is appended to a
    table that holds the dates up to `after`. Dates need at least `least_rows` values."""
    recent = df.where((col("dt") > F.date_sub(F.lit(after), lookback)))
    return signal(recent, x, least_rows - 1).where(col("dt") > F.lit(after))


def standardize(df: DataFrame, *columns: str) -> DataFrame:
    """Every column clipped at the median deviation and scored within its date."""
    for c in columns:
        df = clip_mad(df, c)
        df = df.withColumn(c, zscore(c, ddof=0))
    return df


def weighted_slopes(df: DataFrame, x: str, y: str, weight: str, *keys: str) -> DataFrame:
    """Per key the weighted regression of y on x, by two formulas: the slope under weights sqrt(weight) with a t from the
    unweighted spread of x and residuals, and slope and intercept under `weight` with their own t."""
    keys = keys or ("dt",)
    ok = df.where(col(x).isNotNull() & col(y).isNotNull() & (col(weight) > 0))
    sums, w = {}, {"r": F.sqrt(col(weight)), "w": col(weight)}
    for k, c in w.items():
        sums |= {f"{k}": F.sum(c), f"{k}x": F.sum(c * col(x)), f"{k}y": F.sum(c * col(y)), f"{k}xx": F.sum(c * col(x) * col(x)), f"{k}xy": F.sum(c * col(x) * col(y)), f"{k}yy": F.sum(c * col(y) * col(y))}
    a = ok.groupBy(*keys).agg(
        F.count("*").alias("n"), F.stddev_pop(x).alias("sd"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(col(x) * col(x)).alias("xx"), F.sum(col(x) * col(y)).alias("xy"),
        F.sum(col(y) * col(y)).alias("yy"), *[v.alias(k) for k, v in sums.items()],
    )
    c = F.col
    for k in w:
        sxx, sxy = c(f"{k}xx") - c(f"{k}x") * c(f"{k}x") / c(k), c(f"{k}xy") - c(f"{k}x") * c(f"{k}y") / c(k)
        a = a.withColumns({f"{k}_sxx": sxx, f"{k}_b": ratio(sxy, sxx)})
        a = a.withColumn(f"{k}_a", (c(f"{k}y") - c(f"{k}_b") * c(f"{k}x")) / c(k))
    # residual squares from the sums of squares
    plain = c("yy") + c("n") * c("r_a") * c("r_a") + c("r_b") * c("r_b") * c("xx") - 2 * c("r_a") * c("y") - 2 * c("r_b") * c("xy") + 2 * c("r_a") * c("r_b") * c("x")
    own = c("wyy") + c("w") * c("w_a") * c("w_a") + c("w_b") * c("w_b") * c("wxx") - 2 * c("w_a") * c("wy") - 2 * c("w_b") * c("wxy") + 2 * c("w_a") * c("w_b") * c("wx")
    free = F.when(c("n") > 2, c("n") - 2)
    s2 = F.greatest(own, F.lit(0.0)) / free
    mean = c("wx") / c("w")
    return a.select(
        *keys, "n", c("r_b").alias("slope_root"), ratio(c("r_b") * F.sqrt(c("n").cast("double")) * c("sd"), F.sqrt(F.greatest(plain, F.lit(0.0)) / free)).alias("t_root"),
        c("w_b").alias("slope"), ratio(c("w_b"), F.sqrt(s2 / F.nullif(c("w_sxx"), F.lit(0.0)))).alias("t"),
        c("w_a").alias("intercept"), ratio(c("w_a"), F.sqrt(s2 * (1 / c("w") + mean * mean / F.nullif(c("w_sxx"), F.lit(0.0))))).alias("t_intercept"),
    )


def residual_table(df: DataFrame, x: str, y: str, weight: str) -> DataFrame:
    """(entity, dt, size, error_ols, error_wls): residuals of y on x within a date, without and with weights, against the
    root of the weight capped at its mean plus two deviations."""
    ok = df.where(col(x).isNotNull() & col(y).isNotNull() & (col(weight) > 0))
    w = Window.partitionBy("dt")
    ok = ok.withColumns({"__b": F.regr_slope(y, x).over(w), "__mx": F.avg(x).over(w), "__my": F.avg(y).over(w), "__cap": F.avg(weight).over(w) + 2 * F.stddev_samp(weight).over(w)})
    s = {"w": col(weight), "wx": col(weight) * col(x), "wy": col(weight) * col(y), "wxx": col(weight) * col(x) * col(x), "wxy": col(weight) * col(x) * col(y)}
    ok = ok.withColumns({f"__{k}": F.sum(v).over(w) for k, v in s.items()})
    slope = ratio(F.col("__wxy") - F.col("__wx") * F.col("__wy") / F.col("__w"), F.col("__wxx") - F.col("__wx") * F.col("__wx") / F.col("__w"))
    ok = ok.withColumn("__wb", slope)
    ols = col(y) - F.col("__my") - F.col("__b") * (col(x) - F.col("__mx"))
    wls = col(y) - F.col("__wy") / F.col("__w") - F.col("__wb") * (col(x) - F.col("__wx") / F.col("__w"))
    capped = F.when(F.col("__cap") < col(weight), F.col("__cap")).otherwise(col(weight))
    return ok.select("entity", "dt", F.sqrt(capped).alias("size"), ols.alias("error_ols"), wls.alias("error_wls"))


def layers(df: DataFrame, x: str, ret: str, groups: int, bench: DataFrame) -> DataFrame:
    """(dt, bucket, ret, bench): mean return of each bucket of x per date, next to a benchmark (dt, bench); dates that lack
    a bucket or the benchmark are left out."""
    b = df.where(col(x).isNotNull() & col(ret).isNotNull()).withColumn("bucket", bucket(x, groups, "dt"))
    m = b.groupBy("dt", "bucket").agg(F.avg(ret).alias("ret")).withColumn("__n", F.count("*").over(Window.partitionBy("dt")))
    return m.where(F.col("__n") == groups).drop("__n").join(bench.where(F.col("bench").isNotNull()), "dt").select("dt", "bucket", "ret", "bench")


def describe_layers(df: DataFrame, periods: int = 12, rf: float = 0.036, key: str = "bucket") -> DataFrame:
    """Per layer (rows key, dt, ret, bench): whole and annual return, deviation, Sharpe ratio, deepest fall, and the same
    of the return relative to the benchmark."""
    w = Window.partitionBy(key).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__rel", F.col("ret") - F.col("bench"))
    df = df.withColumns({"__v": F.product(1 + F.col("ret")).over(w), "__u": F.product(1 + F.col("__rel")).over(w)})
    fall = lambda c: F.least(F.lit(0.0), ratio(c, F.max(c).over(w)) - 1)
    df = df.withColumns({"__fv": fall("__v"), "__fu": fall("__u")})
    a = df.groupBy(key).agg(
        F.count("*").alias("n"), F.max_by("__v", "dt").alias("v"), F.max_by("__u", "dt").alias("u"), (F.stddev_samp("ret") * periods**0.5).alias("sigma"),
        (F.stddev_samp("__rel") * periods**0.5).alias("rela_sigma"), F.min("__fv").alias("max_drawdown"), F.min("__fu").alias("rela_max_drawdown"),
    )
    annual = lambda c: F.pow(F.greatest(F.col(c), F.lit(0.0)), F.lit(float(periods)) / F.col("n")) - 1
    return a.select(
        key, "n", (F.col("v") - 1).alias("total"), annual("v").alias("annual"), "sigma", ratio(annual("v") - rf, "sigma").alias("sharpe"), "max_drawdown",
        annual("u").alias("rela_annual"), "rela_sigma", ratio(annual("u"), "rela_sigma").alias("information"), "rela_max_drawdown",
    )


def top_size_distribution(df: DataFrame, x: str, size: str, groups: int) -> DataFrame:
    """(dt, size_bucket, share): where the top bucket of x lies among the buckets of size, over all rows with a size."""
    d = df.where(col(size).isNotNull()).withColumns({"__g": bucket(x, groups, "dt"), "size_bucket": bucket(size, groups, "dt"), "__n": F.count("*").over(Window.partitionBy("dt"))})
    return d.where(F.col("__g") == groups).groupBy("dt", "size_bucket").agg((F.count("*") / F.max("__n")).alias("share"))


def rank_factors(ic: DataFrame, value: str, top: int, key: str = "indicator") -> DataFrame:
    """The `top` factors by the size of the mean of a series of each: key, n, mean, std, ratio, place."""
    a = ic.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    # one row per factor
    place = F.row_number().over(Window.orderBy(F.desc(F.abs("mean")), key))
    return a.withColumn("place", place).where(F.col("place") <= top).select(key, "n", "mean", "std", ratio("mean", "std").alias("ir"), "place")


def pair_correlations(df: DataFrame, value: str, key: str = "indicator", date: str = "dt", width: int = blocks.PAIR_BLOCK) -> DataFrame:
    """(a, b, n, corr) of the series of each pair of keys over the dates that all keys have; null where one is constant."""
    ok = df.where(col(value).isNotNull())
    full = ok.groupBy(date).agg(F.count_distinct(key).alias("k")).join(ok.agg(F.count_distinct(key).alias("all_")), F.col("k") == F.col("all_")).select(date)
    x = stored(ok.join(full, date).select(F.col(date).alias("dt"), F.col(key).alias("series"), col(value).cast("double").alias("x")), "series")
    # one row per series; standardised, a correlation is a sum of products, which blocks of series add up a chunk of dates at a time
    own = stored(x.groupBy("series").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.count("*").alias("n")), "moments")
    z = x.join(own, "series").select("series", "dt", F.coalesce(ratio(F.col("x") - F.col("mean"), "sd"), F.lit(0.0)).alias("z"))
    sums = blocks.pair_sums(blocks.blocked(z, "z", width=width)).select(F.col("a").alias("sa_"), F.col("b").alias("sb_"), "p")
    side = lambda c: own.select(F.col("series").alias(c), F.col("series").cast("string").alias(f"s{c}_"), F.col("sd").alias(f"sd_{c}"), F.col("n"))
    j = sums.join(side("a"), "sa_").join(side("b").drop("n"), "sb_").where("a < b")
    return j.select("a", "b", "n", F.when((F.col("sd_a") > 0) & (F.col("sd_b") > 0), ratio("p", F.col("n") - 1)).alias("corr"))


def forward_returns(df: DataFrame, x: str, price: str, groups: int, horizons: Sequence[int]) -> DataFrame:
    """(bucket, horizon, n, mean, std): what the buckets of x earn over the next rows of their entities."""
    w = by_entity()
    ahead = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"__{h}").alias("fwd")) for h in horizons]))
    d = df.withColumns({f"__{h}": ratio(F.lead(price, h).over(w), price) - 1 for h in horizons}).withColumn("bucket", bucket(x, groups, "dt"))
    d = d.where(F.col("bucket").isNotNull()).select("bucket", ahead.alias("h")).select("bucket", "h.*").where(F.col("fwd").isNotNull())
    return d.groupBy("bucket", "horizon").agg(F.count("*").alias("n"), F.avg("fwd").alias("mean"), F.stddev_samp("fwd").alias("std"))


def spread_matrix(spreads: DataFrame, value: str, coverage: float = 0.6, key: str = "indicator") -> DataFrame:
    """(key, dt, value) of the keys that have a value on at least `coverage` of all dates, 0 where one is missing."""
    ok = spreads.where(col(value).isNotNull())
    dates = ok.select("dt").distinct()
    keep = ok.groupBy(key).agg(F.count("*").alias("n")).join(dates.agg(F.count("*").alias("all_")), F.col("n") >= F.ceil(coverage * F.col("all_"))).select(key)
    # indicators of a study times its dates
    return keep.crossJoin(dates).join(ok.select(key, "dt", col(value).alias("value")), [key, "dt"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def composite(df: DataFrame, value: str, names: int, share: float = 0.5, key: str = "indicator") -> DataFrame:
    """(entity, dt, score): sum of the values of all keys where at least `share` of the `names` are there, missing as 0."""
    a = df.where(col(value).isNotNull()).groupBy("entity", "dt").agg(F.sum(value).alias("score"), F.count_distinct(key).alias("__n"))
    return a.where(F.col("__n") >= F.ceil(F.lit(share * names))).drop("__n")


def align(df: DataFrame, value: str, signs: DataFrame, key: str = "indicator") -> DataFrame:
    """Values times the sign (key, sign) of their indicator: 1 where its statistic is above zero, -1 otherwise."""
    return df.join(signs.select(key, F.when(F.col("t") > 0, 1.0).otherwise(-1.0).alias("__s")), key).withColumn(value, col(value) * F.col("__s")).drop("__s")


def best_condition(df: DataFrame, t: str = "t", hurdle: float = 2.0, condition: str = "condition") -> DataFrame:
    """The rows of the condition under which most |t| reach the hurdle (ties by its name), with that count."""
    n = df.groupBy(condition).agg(F.count_if(F.abs(t) >= hurdle).alias("large"))
    # one row per condition
    first = n.orderBy(F.desc("large"), condition).limit(1)
    return df.join(F.broadcast(first), condition)
