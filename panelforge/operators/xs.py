"""Cross-sectional operators: each works within a date (or the given keys)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from panelforge.functions.core import average_rank, bucket, by_date, col, ratio


def rank(x: str, *keys: str) -> Column:
    keys = keys or ("dt",)
    return average_rank(x, *keys) / F.count(x).over(by_date(*keys))


def scale(x: str, k: float = 1.0, *keys: str) -> Column:
    return k * ratio(x, F.sum(F.abs(x)).over(by_date(*keys)))


def demean(x: str, *keys: str) -> Column:
    """Minus the mean within the keys, say ("dt", "industry")."""
    return col(x) - F.avg(x).over(by_date(*keys))


def zscore(x: str, *keys: str, ddof: int = 1) -> Column:
    w = by_date(*keys)
    return ratio(col(x) - F.avg(x).over(w), (F.stddev_samp if ddof else F.stddev_pop)(x).over(w))


def winsorize(df: DataFrame, x: str, *keys: str, k: float = 3.0) -> DataFrame:
    """Values beyond k deviations become the least or greatest of those inside."""
    w = by_date(*keys)
    df = df.withColumns({"__m": F.avg(x).over(w), "__s": F.stddev_samp(x).over(w)})
    inside = F.when(F.abs(col(x) - F.col("__m")) <= k * F.col("__s"), col(x))
    df = df.withColumn("__in", inside).withColumns({"__lo": F.min("__in").over(w), "__hi": F.max("__in").over(w)})
    return df.withColumn(x, F.when(col(x).isNull() | F.col("__lo").isNull(), col(x)).otherwise(F.least(F.greatest(col(x), F.col("__lo")), F.col("__hi")))).drop("__m", "__s", "__in", "__lo", "__hi")


def to_unit(x: str, *keys: str) -> Column:
    w = by_date(*keys)
    return ratio(col(x) - F.min(x).over(w), F.max(x).over(w) - F.min(x).over(w))


def clip_mad(df: DataFrame, x: str, *keys: str, k: float = 4.5) -> DataFrame:
    """Clip at the median plus or minus k times the median absolute deviation."""
    w = by_date(*keys)
    df = df.withColumn("__m", F.percentile(x, 0.5).over(w))
    df = df.withColumn("__d", F.percentile(F.abs(col(x) - F.col("__m")), 0.5).over(w))
    clipped = F.greatest(F.least(col(x), F.col("__m") + k * F.col("__d")), F.col("__m") - k * F.col("__d"))
    return df.withColumn(x, F.when(col(x).isNotNull(), clipped)).drop("__m", "__d")


def medcouple(values: np.ndarray) -> float:
    """Median of the kernel ((v - m) - (m - z)) / (v - z) over all pairs of the upper (v >= m) with the lower half (z <= m).

    Of the pairs of k values tied at the median m, k have the kernel 0, and half of the others -1 and 1 each. The kernel
    grows with v and z, so a bisection counts the pairs up to a bound on the sorted lower half and makes no pairs.
    """
    if not len(values):
        return 0.0
    z = np.sort(values) - np.median(values)
    up, low, ties = z[z > 0], z[z < 0], int((z == 0).sum())
    total = (len(up) + ties) * (len(low) + ties)
    least, greatest = ties * len(low) + ties * (ties - 1) // 2, ties * len(up) + ties * (ties - 1) // 2

    def at(r: int) -> float:
        """The kernel of rank r."""
        if r <= least or r > total - greatest:
            return -1.0 if r <= least else 1.0
        lo, hi = -1.0, 1.0
        while lo < (mid := (lo + hi) / 2) < hi and hi - lo > 1e-16:
            n = least + (ties if mid >= 0 else 0) + int(np.searchsorted(low, -up * ((1 - mid) / (1 + mid)), "right").sum())
            lo, hi = (lo, mid) if n >= r else (mid, hi)
        return hi

    return (at((total + 1) // 2) + at(total // 2 + 1)) / 2


@F.pandas_udf(DoubleType())
def _medcouples(values: pd.Series) -> pd.Series:
    return values.map(medcouple).astype(float)


def fences(q: Column, mc: Column) -> tuple[Column, Column]:
    """Ends of the skewness-adjusted boxplot, by the quartiles and the medcouple."""
    iqr = q[2] - q[0]
    return q[0] - 1.5 * F.exp(F.when(mc >= 0, -3.5).otherwise(-4.0) * mc) * iqr, q[2] + 1.5 * F.exp(F.when(mc >= 0, 4.0).otherwise(3.5) * mc) * iqr


def adjusted_boxplot(df: DataFrame, x: str, *keys: str) -> DataFrame:
    """Clamp to the greatest and least values inside a skewness-adjusted boxplot (medcouple)."""
    keys = keys or ("dt",)
    w = by_date(*keys)
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    stats = df.groupBy(*keys).agg(q.alias("q"), F.collect_list(col(x).cast("double")).alias("v"))
    lim = stats.select(*keys, "q", _medcouples("v").alias("mc"))
    lo, hi = fences(F.col("q"), F.col("mc"))
    df = df.join(lim.select(*keys, lo.alias("__lo"), hi.alias("__hi")), list(keys))
    inside = F.when(col(x).between(F.col("__lo"), F.col("__hi")), col(x))
    df = df.withColumn("__in", inside).withColumns({"__a": F.min("__in").over(w), "__b": F.max("__in").over(w)})
    return df.withColumn(x, F.when(col(x).isNotNull(), F.least(F.greatest(col(x), F.col("__a")), F.col("__b")))).drop("__lo", "__hi", "__in", "__a", "__b")


def neutralize(df: DataFrame, y: str, size: str = "cap", industry: str = "industry", date: str = "dt") -> DataFrame:
    """Residual of y on industry dummies and log size, exactly: demeaning within (date, industry) removes the dummies,
    one slope per date is left."""
    wi, wd = Window.partitionBy(date, industry), Window.partitionBy(date)
    ok = col(y).isNotNull() & (col(size) > 0) & col(industry).isNotNull()
    df = df.withColumns({"__y": F.when(ok, col(y)), "__x": F.when(ok, F.ln(F.when(col(size) > 0, col(size))))})
    df = df.withColumns({"__y": F.col("__y") - F.avg("__y").over(wi), "__x": F.col("__x") - F.avg("__x").over(wi)})
    b = ratio(F.sum(F.col("__x") * F.col("__y")).over(wd), F.sum(F.col("__x") * F.col("__x")).over(wd))
    return df.withColumn("__b", b).withColumn(y, F.col("__y") - F.coalesce("__b", F.lit(0.0)) * F.col("__x")).drop("__y", "__x", "__b")


def clean(df: DataFrame, x: str, size: str = "cap", industry: str = "industry") -> DataFrame:
    """Clip, z-score, neutralise."""
    df = clip_mad(df, x)
    return neutralize(df.withColumn(x, zscore(x, ddof=0)), x, size, industry)


def signal(df: DataFrame, x: str, least_rows: int, neutral: bool = False) -> DataFrame:
    """Dates of more than `least_rows` values, clipped and z-scored (neutralised if asked), known one date later: a
    value moves to the next date of the list of dates, not to the entity's next row."""
    df = df.where(col(x).isNotNull()).withColumn("__n", F.count("*").over(by_date())).where(F.col("__n") > least_rows).drop("__n")
    df = clean(df, x) if neutral else clip_mad(df, x).withColumn(x, zscore(x, ddof=0))
    dates = df.select("dt").distinct()
    # one row per date: small by nature
    following = dates.withColumn("next_dt", F.lead("dt").over(Window.orderBy("dt")))
    out = df.join(F.broadcast(following), "dt").where(F.col("next_dt").isNotNull())
    return out.select("entity", F.col("next_dt").alias("dt"), F.col(x).alias("signal"))


def quantile(df: DataFrame, x: str, groups: int, *keys: str, fallback: bool = False) -> DataFrame:
    """Adds bucket 1..groups; with fallback, of the rank by value and then entity, so ties can't empty a bucket."""
    keys = keys or ("dt",)
    if not fallback:
        return df.withColumn("bucket", bucket(x, groups, *keys))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(col(x).asc_nulls_last(), "entity"))
    return df.withColumn("__r", F.when(col(x).isNotNull(), first)).withColumn("bucket", bucket("__r", groups, *keys)).drop("__r")
