"""Time-series operators: each maps a column of a panel to a column, within an entity in time order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelforge.functions.core import by_entity, col, corr, ffill, guarded, ratio
from panelforge.operators.frames import framed, rank_kernel
from panelforge.sources.tables import stored

W = by_entity


def delay(x: str, n: int) -> Column:
    return F.lag(x, n).over(W())


def delta(x: str, n: int) -> Column:
    return col(x) - delay(x, n)


def correlation(x: str, y: str, n: int) -> Column:
    """Of the complete pairs in n rows, where all n are complete."""
    return F.when(F.count(F.when(col(x).isNotNull() & col(y).isNotNull(), 1)).over(W(n)) >= n, corr(x, y, W(n)))


def covariance(x: str, y: str, n: int) -> Column:
    both = F.when(col(x).isNotNull() & col(y).isNotNull(), 1)
    return F.when(F.count(both).over(W(n)) >= n, F.covar_samp(x, y).over(W(n)))


def decay_linear(df: DataFrame, x: str, n: int, fill: int = 3) -> DataFrame:
    """Adds decay: weights n, n-1 .. 1 from the newest row back, over values filled forward at most `fill` rows."""
    df = df.withColumn("__f", ffill(x, W(), fill))
    total = sum((F.lit(n - k) * F.lag("__f", k).over(W()) for k in range(1, n)), F.lit(n) * F.col("__f"))
    return df.withColumn("decay", F.when(col(x).isNotNull(), total / (n * (n + 1) / 2))).drop("__f")


def ts_min(x: str, n: int) -> Column:
    return guarded(F.min(x), x, W(n), n)


def ts_max(x: str, n: int) -> Column:
    return guarded(F.max(x), x, W(n), n)


def _age(df: DataFrame, x: str, n: int, sign: int, name: str) -> DataFrame:
    df = df.withColumn("__n", F.row_number().over(W()))
    best = F.max(F.when(col(x).isNotNull(), F.struct((col(x) * sign).alias("v"), (-F.col("__n")).alias("k")))).over(W(n))
    return df.withColumn(name, F.when(F.count(x).over(W(n)) >= n, F.col("__n") + best["k"] + 1)).drop("__n")


def ts_argmax(df: DataFrame, x: str, n: int) -> DataFrame:
    """Adds argmax: rows since the greatest of n values, the newest being 1; ties take the earliest."""
    return _age(df, x, n, 1, "argmax")


def ts_argmin(df: DataFrame, x: str, n: int) -> DataFrame:
    return _age(df, x, n, -1, "argmin")


def ts_rank(df: DataFrame, x: str, n: int, *keys: str, name: str = "rank") -> DataFrame:
    """Adds the average rank of the newest of n values as a share of n, where all n are there. The cost doesn't depend on n
    (frames.counted_below)."""
    keys = keys or ("entity",)
    return framed(df, x, n, lambda v, m: {name: rank_kernel(v, m)["rank"]}, {name: "double"}, *keys)


def ts_sum(x: str, n: int) -> Column:
    return guarded(F.sum(x), x, W(n), n)


def ts_mean(x: str, n: int, least: int | None = None) -> Column:
    return guarded(F.avg(x), x, W(n), n if least is None else least)


def ts_std(x: str, n: int, least: int | None = None) -> Column:
    return guarded(F.stddev_samp(x), x, W(n), n if least is None else least)


def product(x: str, n: int) -> Column:
    return guarded(F.product(col(x)), x, W(n), n)


def smooth(x: str, n: int, sign: int = 1) -> Column:
    """Mean of n rows with at least half of them present; n = 0 leaves the value."""
    return sign * (col(x) if n == 0 else ts_mean(x, n, n // 2))


def nav(ret: str, *keys: str, order: str = "dt") -> Column:
    """Running product of 1 + ret; a return of -1 or less is no problem."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.product(1 + F.coalesce(col(ret), F.lit(0.0))).over(w)


def drawdown(df: DataFrame, value: str, *keys: str, order: str = "dt") -> DataFrame:
    """Adds drawdown: value over its running maximum, minus one."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("drawdown", ratio(value, F.max(value).over(w)) - 1)


def until_peak(df: DataFrame, x: str, *keys: str) -> DataFrame:
    """Rows up to the (first) maximum of x within the keys."""
    w = Window.partitionBy(*keys)
    top = F.max(x).over(w)
    return df.withColumn("__top", top).withColumn("__at", F.min(F.when(col(x) == F.col("__top"), F.col("dt"))).over(w)).where("dt <= __at").drop("__top", "__at")


def growth(df: DataFrame, x: str, *spans: int, prefix: str = "mom") -> DataFrame:
    """Adds prefix_n, the growth over n rows, for all n in one sort; gaps are padded forward and stay null themselves."""
    df = df.withColumn("__p", ffill(x, W()))
    out = {f"{prefix}_{n}": F.when(col(x).isNotNull(), ratio("__p", F.lag("__p", n).over(W())) - 1) for n in spans}
    return df.withColumns(out).drop("__p")


def rolling_beta(df: DataFrame, y: str, x: str, n: int, least: int | None = None) -> DataFrame:
    """Adds beta and idio: regression of y on x over n rows of a dense calendar, where missing y count as the mean of
    those present (at least half, or `least`). idio is the deviation of the residuals with divisor n. All are differences
    of running sums, so errors are relative to the largest sum of an entity's history, not of the window."""
    return _beta(_differences(df, {**_own_sums(y, x), **_market_sums(x)}, n, W()), n, least)


def rolling_beta_on(df: DataFrame, market: DataFrame, y: str, x: str, n: int, least: int | None = None) -> DataFrame:
    """(entity, dt, beta, idio) of each entity on each date of market(dt, x): as rolling_beta over all dates of the market,
    whose own sums are taken once and not once per entity. An entity's window goes on after its last row."""
    spark = df.sparkSession
    sums = _differences(market.withColumn("entity", F.lit(0)), _market_sums(x), n, W())
    held = stored(sums.withColumn("__day", F.row_number().over(W())).drop("entity"), "market")
    # days are written out by number, in as many tasks as there are partitions: few entities make many rows
    entities = df.select("entity").distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "entity")
    days = F.explode(F.sequence(F.lit(1), F.lit(held.count()).cast("int"))).alias("__day")
    grid = entities.select("entity", days).join(held, "__day").drop("__day")
    grid = grid.join(df.select("entity", "dt", y), ["entity", "dt"], "left")
    return _beta(_differences(grid, _own_sums(y, x), n, W()), n, least).select("entity", "dt", "beta", "idio")


def _own_sums(y: str, x: str) -> dict[str, Column]:
    v = F.when(col(y).isNotNull(), col(x))
    return {"nv": F.count(y), "sy": F.sum(y), "sxy": F.sum(v * col(y)), "sxv": F.sum(v), "syy": F.sum(col(y) * col(y))}


def _market_sums(x: str) -> dict[str, Column]:
    return {"sx": F.sum(x), "sxx": F.sum(col(x) * col(x)), "na": F.count(x)}


def _differences(df: DataFrame, sums: dict[str, Column], n: int, w: WindowSpec) -> DataFrame:
    """Adds __k, the sum k over n rows. Running sums cost one addition a row; a sliding frame would add up n for each."""
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"__{k}": F.coalesce(a.over(upto), F.lit(0)) for k, a in sums.items()})
    return df.withColumns({f"__{k}": F.col(f"__{k}") - F.coalesce(F.lag(f"__{k}", n).over(w), F.lit(0)) for k in sums})


def _beta(df: DataFrame, n: int, least: int | None) -> DataFrame:
    mean = ratio("__sy", "__nv")
    num, den = F.col("__sxy") - mean * F.col("__sxv"), F.col("__sxx") - F.col("__sx") * F.col("__sx") / n
    full = (F.col("__na") >= n) & (F.col("__nv") >= (n // 2 if least is None else least))
    beta = F.when(full, ratio(num, den))
    idio = F.sqrt(F.greatest(F.lit(0.0), (F.col("__syy") - F.col("__nv") * mean * mean - beta * num) / n))
    return df.withColumns({"beta": beta, "idio": F.when(beta.isNotNull(), idio)}).drop(*[c for c in df.columns if c in {f"__{k}" for k in ("nv", "sy", "sxy", "sxv", "syy", "sx", "sxx", "na")}])
