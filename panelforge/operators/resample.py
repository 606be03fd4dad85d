"""Calendars, grids and changes of frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.core import by_entity, ffill, ratio


def month_grid(df: DataFrame, month: str = "month_end", key: str = "entity") -> DataFrame:
    """Every month end of each key between its first and last."""
    span = df.groupBy(key).agg(F.trunc(F.min(month), "month").alias("a"), F.trunc(F.max(month), "month").alias("b"))
    return span.select(key, F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("m")).select(key, F.last_day("m").alias(month))


def quarter_grid(df: DataFrame, period: str = "dt", key: str = "entity") -> DataFrame:
    """Every quarter end of each key between its first and last; steps run over quarter starts, as a step of three
    months from 30 June would end on 30 December."""
    span = df.groupBy(key).agg(F.trunc(F.min(period), "quarter").alias("a"), F.trunc(F.max(period), "quarter").alias("b"))
    return span.select(key, F.explode(F.sequence("a", "b", F.expr("interval 3 month"))).alias("q")).select(key, F.last_day(F.add_months("q", 2)).alias(period))


def densify(df: DataFrame, grid: DataFrame, *on: str) -> DataFrame:
    return grid.join(df, list(on), "left")


def monthly_bars(px: DataFrame) -> DataFrame:
    """Bars of the months between an entity's first and last, with the return of the month and of the next one. A month
    without a price and the first month have no return; a return after a gap is on the last price before it."""
    bars = px.groupBy("entity", F.last_day("dt").alias("month_end")).agg(
        F.sum("volume").alias("volume"), F.min_by("close", "dt").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "dt").alias("close"), (F.sum(F.round(F.col("amount") * 100).cast("long")).cast("double") / 100.0).alias("amount"), F.max("dt").alias("trd_dt"),
    )
    # each bar is followed by the empty months up to the next one: the bars are made once, and one window sees them
    w = by_entity(None, "entity", order="month_end")
    start = F.trunc("month_end", "month")
    until = F.coalesce(F.add_months(F.trunc(F.lead("month_end").over(w), "month"), -1), start)
    out = bars.withColumn("__until", until).withColumn("__month", F.explode(F.sequence(start, "__until", F.expr("interval 1 month"))))
    here = F.col("__month") == start
    out = out.select("entity", F.last_day("__month").alias("month_end"), *[F.when(here, F.col(c)).alias(c) for c in bars.columns if c not in ("entity", "month_end")])
    out = out.withColumn("__last", ffill("close", w))
    out = out.withColumn("ret_m", F.when(F.col("close").isNotNull(), ratio("close", F.lag("__last").over(w)) - 1)).drop("__last")
    return out.withColumn("ret_1m", F.lead("ret_m").over(w))


def last_per_month(df: DataFrame, *values: str) -> DataFrame:
    """The last value not null of each column in each month."""
    return df.groupBy("entity", F.last_day("dt").alias("month_end")).agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col("dt"))).alias(v) for v in values])


def last_rows_of_months(df: DataFrame) -> DataFrame:
    """Rows after which the month changes; an entity's final month is dropped, as it may be unfinished."""
    following = F.lead("dt").over(by_entity())
    return df.withColumn("__next", following).where(F.trunc("__next", "month") != F.trunc("dt", "month")).drop("__next")


def convert_frequency(df: DataFrame, value: str, limit: int) -> DataFrame:
    """Last per month on the dense month grid, filled forward for at most `limit` months."""
    m = last_per_month(df, value)
    m = densify(m, month_grid(m), "entity", "month_end")
    return m.withColumn(value, ffill(value, by_entity(None, "entity", order="month_end"), limit))


def as_of_daily(stmt: DataFrame, calendar: DataFrame, value: str, limit: int) -> DataFrame:
    """Statement values on the trading days from the day they are known, at most `limit` days long. Each value is laid
    out over its own days, so nothing is joined by a range and the rows made are those of the result."""
    known = stmt.groupBy("entity", F.col("trd_dt").alias("dt")).agg(F.max_by(value, "dt").alias(value))
    known = on_or_after(known, calendar).where(F.col(value).isNotNull())
    # one row per trading day: small by nature
    days = F.broadcast(calendar.select("dt", F.row_number().over(Window.orderBy("dt")).alias("k")))
    at = known.join(days, "dt").drop("dt")
    # least skips the null of an entity's last value, which then holds for all of its days
    end = F.least(F.col("k") + limit, F.lead("k").over(by_entity(None, "entity", order="k")) - 1)
    at = at.withColumn("__end", end).select("entity", value, F.explode(F.sequence("k", "__end")).alias("k"))
    return at.join(days, "k").select("entity", "dt", value)


def next_trading_day(calendar: DataFrame, back: int = 366) -> DataFrame:
    """(day, trading): for each calendar day up to the last trading day, from `back` days before the first one on, the first
    trading day on or after it.

    The calendar is one row per day, so its window is small by nature."""
    c = calendar.select(F.col("dt").alias("trading")).withColumn("before", F.lag("trading").over(Window.orderBy("trading")))
    first = F.coalesce(F.date_add("before", 1), F.date_sub("trading", back))
    return c.select(F.explode(F.sequence(first, F.col("trading"))).alias("day"), "trading")


def on_or_after(df: DataFrame, calendar: DataFrame, date: str = "dt") -> DataFrame:
    """Move a date to the first trading day on or after it; rows after the last trading day are dropped."""
    days = F.broadcast(next_trading_day(calendar))
    out = df.join(days, F.col(date) == F.col("day")).drop(date, "day").withColumnRenamed("trading", date)
    keys = ["entity", date]
    return out.groupBy(*keys).agg(*[F.max_by(c, c).alias(c) for c in out.columns if c not in keys])


def yearly_to_monthly(df: DataFrame, value: str, lag: int = 6, fill: int = 11) -> DataFrame:
    """Annual values (dt is a year end) from `lag` months later on, for `fill` further months."""
    out = df.select("entity", "dt", value, F.explode(F.sequence(F.lit(0), F.lit(fill))).alias("k"))
    out = out.select("entity", F.last_day(F.add_months("dt", F.lit(lag) + F.col("k"))).alias("month_end"), value, "k")
    return out.groupBy("entity", "month_end").agg(F.min_by(value, "k").alias(value))


def trading_month_ends(df: DataFrame) -> DataFrame:
    return df.groupBy(F.last_day("dt").alias("month_end")).agg(F.max("dt").alias("trd_dt"))
