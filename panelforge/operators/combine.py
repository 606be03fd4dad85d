"""Ratings of strategies, choice and weights of variants, mixed signals, blends and event profit and loss."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.core import by_entity, col, guarded, ratio
from panelforge.operators.clean import event_windows
from panelforge.operators.frames import framed, rating_kernel
from panelforge.operators.ts import nav


def variants(df: DataFrame, x: str, windows: Sequence[int], *keys: str) -> DataFrame:
    """(window, sign, keys, dt, value): each series smoothed over each window (0: as it is), in both directions."""
    wide = df.select(*keys, "dt", *[(col(x) if n == 0 else guarded(F.avg(x), x, by_entity(n, *keys), n // 2)).alias(f"__{n}") for n in windows])
    smooth = wide.select(*keys, "dt", F.explode(F.array(*[F.struct(F.lit(n).alias("window"), F.col(f"__{n}").alias("v")) for n in windows])).alias("s"))
    signed = smooth.withColumn("sign", F.explode(F.array(F.lit(1), F.lit(-1))))
    return signed.select("s.window", "sign", *keys, "dt", (F.col("sign") * F.col("s.v")).alias("value"))


def ratings(df: DataFrame, ret: str, rows: int, coverage: float = 0.95, *keys: str) -> DataFrame:
    """Over the trailing rows of each strategy: total (compound return), calm (total over the deepest fall) and sharpe
    (mean over deviation); null where less than `coverage` of the rows have a return. The cost of a row doesn't grow with
    the frame (frames.rating_kernel)."""
    names = ("count", "total", "fall", "mean", "deviation")
    out = framed(df.select(*keys, "dt", ret), ret, rows, rating_kernel, dict.fromkeys(names, "double"), *keys)
    ok = F.col("count") >= math.ceil(rows * coverage)
    calm, sharpe = ratio("total", -F.col("fall")), ratio("mean", "deviation")
    return out.select(*keys, "dt", *[F.when(ok, c).alias(n) for n, c in (("total", F.col("total")), ("calm", calm), ("sharpe", sharpe))])


def choose(graded: DataFrame, score: str, name: str, category: str, top: int, weigh: str = "equal") -> DataFrame:
    """The best variant per name with a positive score, then the `top` names per category, with weights that add up to
    1 in the category: equal, by score, or by place from the last."""
    first = Window.partitionBy(name).orderBy(F.desc(score), *[c for c in graded.columns if c not in (score, name)])
    best = graded.where(col(score) > 0).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    place = Window.partitionBy(category).orderBy(F.desc(score), name)
    best = best.withColumn("place", F.row_number().over(place)).where(F.col("place") <= top)
    w = Window.partitionBy(category)
    raw = {"equal": F.lit(1.0), "score": col(score), "place": (F.max("place").over(w) + 1 - F.col("place")).cast("double")}[weigh]
    best = best.withColumn("__w", raw)
    return best.withColumn("weight", ratio("__w", F.sum("__w").over(w))).drop("__w")


def choose_grid(graded: DataFrame, score: str, name: str, category: str, tops: Sequence[int], modes: Sequence[str]) -> DataFrame:
    """choose for all numbers and ways of weighing at once: (top, mode, columns of graded, place, weight). The best
    variants are found once; a choice of fewer is a part of that of more."""
    best = choose(graded, score, name, category, max(tops)).drop("weight")
    best = best.withColumn("top", F.explode(F.array(*map(F.lit, tops)))).where("place <= top").withColumn("mode", F.explode(F.array(*map(F.lit, modes))))
    w = Window.partitionBy("top", "mode", category)
    raw = F.when(F.col("mode") == "equal", F.lit(1.0)).when(F.col("mode") == "score", col(score)).otherwise((F.max("place").over(w) + 1 - F.col("place")).cast("double"))
    best = best.withColumn("__w", raw)
    return best.withColumn("weight", ratio("__w", F.sum("__w").over(w))).drop("__w")


def mixed_signal(signals: DataFrame, weights: DataFrame, name: str = "indicator") -> DataFrame:
    """(entity, dt, value): the mean of weighted signals that aren't null; weights(rebalance, name, weight) hold after
    their date up to and with the next. Dates are mapped to their rebalance first, so that the join has equal keys."""
    # one row per rebalance and per date: small by nature
    turns = weights.select("rebalance").distinct().withColumn("until", F.lead("rebalance").over(Window.orderBy("rebalance")))
    dates = signals.select("dt").distinct().join(turns, (F.col("dt") > F.col("rebalance")) & ((F.col("dt") <= F.col("until")) | F.col("until").isNull())).select("dt", "rebalance")
    x = signals.join(F.broadcast(dates), "dt").join(weights, ["rebalance", name])
    return x.groupBy("entity", "dt").agg(F.avg(F.col("value") * F.col("weight")).alias("value"))


def blend(df: DataFrame, ret: str, key: str, strategy: str) -> DataFrame:
    """Per key and date: mean of the values that the strategies build up, and the value that their mean return builds."""
    each = df.withColumn("__v", nav(ret, key, strategy)).groupBy(key, "dt").agg(F.avg("__v").alias("mean_nav"), F.avg(ret).alias("__r"))
    return each.select(key, "dt", "mean_nav", nav("__r", key).alias("nav_mean"))


def train_windows(df: DataFrame, years: int, first: int, last: int) -> DataFrame:
    """Each row once per end year whose training window of so many years holds it."""
    y = F.year("dt")
    ends = F.filter(F.sequence(y, y + years - 1), lambda e: e.between(first, last))
    return df.withColumn("end_year", F.explode(ends))


def event_profit(events: DataFrame, panel: DataFrame, ret: str, hold: int, mark: str | None = None) -> DataFrame:
    """Per date the mean return of what was bought after events of the `hold` days before, weighted by mark."""
    held = event_windows(events, panel, 0, hold).where("offset > 0")
    value = F.avg(ret) if mark is None else ratio(F.sum(F.when(col(ret).isNotNull(), col(ret) * col(mark))), F.sum(F.when(col(ret).isNotNull(), col(mark))))
    return held.groupBy("dt").agg(F.count(ret).alias("held"), value.alias("ret"))


def event_profit_grid(events: DataFrame, panel: DataFrame, ret: str, holds: Sequence[int]) -> DataFrame:
    """event_profit for several holding periods at once: an event's day at an offset counts for all that reach it."""
    held = event_windows(events, panel, 0, max(holds)).where("offset > 0")
    held = held.withColumn("hold", F.explode(F.array(*map(F.lit, holds)))).where("offset <= hold")
    return held.groupBy("hold", "dt").agg(F.avg(ret).alias("ret"))
