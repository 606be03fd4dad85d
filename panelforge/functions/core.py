"""Null-safe arithmetic and the window idioms of a keyed panel (entity, dt, value)."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(x: Column | str, y: Column | str) -> Column:
    """x / y, null where y is zero or null (ANSI division would raise)."""
    return col(x) / F.nullif(col(y), F.lit(0.0))


def no_nan(x: Column | str) -> Column:
    """NaN poisons max, avg and count: sources pass through here once."""
    return F.nanvl(col(x).cast("double"), F.lit(None).cast("double"))


def by_entity(rows: int | None = None, *keys: str, order: str = "dt") -> WindowSpec:
    """Rows of an entity in time order; with `rows` the trailing frame of so many rows."""
    w = Window.partitionBy(*(keys or ("entity",))).orderBy(order)
    return w if rows is None else w.rowsBetween(1 - rows, 0)


def by_date(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or ("dt",)))


def guarded(agg: Column, x: Column | str, w: WindowSpec, least: int) -> Column:
    """agg over w where the frame holds at least `least` values of x."""
    return F.when(F.count(col(x)).over(w) >= least, agg.over(w))


def ffill(x: Column | str, w: WindowSpec, limit: int | None = None) -> Column:
    """The last value not null, at most `limit` rows back."""
    first = Window.unboundedPreceding if limit is None else -limit
    return F.last(col(x), ignorenulls=True).over(w.rowsBetween(first, 0))


def pct_change(x: Column | str, q: int, w: WindowSpec, pad: bool = True, mask_missing: bool = True) -> Column:
    """Growth over q rows; gaps are padded forward, and stay null where x itself is missing. The padded column must
    be a plain one where pad is set, so x is given by name."""
    now = col(x)
    out = ratio(now, F.lag(now, q).over(w)) - 1
    return F.when(now.isNotNull(), out) if mask_missing else out


def corr(x: Column | str, y: Column | str, w: WindowSpec) -> Column:
    """Correlation of complete pairs; null where a side is constant (the built-in raises)."""
    both = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(both, col(x)), F.when(both, col(y))
    return ratio(F.covar_samp(a, b).over(w), F.stddev_samp(a).over(w) * F.stddev_samp(b).over(w))


def average_rank(x: Column | str, *keys: str) -> Column:
    """Rank with ties averaged, null for null."""
    x = col(x)
    w = Window.partitionBy(*keys)
    rank = F.rank().over(w.orderBy(x.asc_nulls_last()))
    return F.when(x.isNotNull(), rank + (F.count("*").over(Window.partitionBy(*keys, x)) - 1) / 2)


def bucket(x: Column | str, groups: int, *keys: str) -> Column:
    """Quantile bucket 1..groups with linearly interpolated, right-closed edges inside the keys."""
    x = col(x)
    edges = F.percentile(x, F.array(*[F.lit(i / groups) for i in range(1, groups)])).over(Window.partitionBy(*keys))
    return F.when(x.isNotNull(), F.lit(1) + sum(F.when(edges[i] < x, 1).otherwise(0) for i in range(groups - 1))).cast("int")
