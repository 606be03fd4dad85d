"""Regressions by grouped sums, Fama-MacBeth with Newey-West errors, bootstraps keyed by replicate."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.core import col, ratio


def ols(df: DataFrame, y: str, x: str, *keys: str) -> DataFrame:
    """y = alpha + beta x per key: coefficients, standard error and t of alpha, from centred sums in one pass."""
    ok = df.where(col(y).isNotNull() & col(x).isNotNull())
    a = ok.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("beta"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.avg(x).alias("mx"), F.avg(y).alias("my"))
    alpha = F.col("my") - F.col("beta") * F.col("mx")
    s2 = ratio(F.greatest(F.col("syy") - F.col("beta") * F.col("sxy"), F.lit(0.0)), F.when(F.col("n") > 2, F.col("n") - 2))
    se = F.sqrt(s2 * (1 / F.col("n") + ratio(F.col("mx") * F.col("mx"), "sxx")))
    return a.select(*keys, "n", alpha.alias("alpha"), "beta", se.alias("se"), ratio(alpha, se).alias("t"))


def newey_west(df: DataFrame, x: str, lags: int, *keys: str, order: str = "dt") -> DataFrame:
    """Mean of a series per key with its Bartlett-weighted standard error (no small-sample correction) and t."""
    w, u = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(order)
    df = df.where(col(x).isNotNull()).withColumn("__u", col(x) - F.avg(x).over(w))
    products = {f"__l{k}": F.col("__u") * F.lag("__u", k).over(u) for k in range(1, lags + 1)}
    df = df.withColumns(products)
    s = F.sum(F.col("__u") * F.col("__u"))
    for k in range(1, lags + 1):
        s = s + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(f"__l{k}"), F.lit(0.0))
    a = df.groupBy(*keys).agg(F.count("*").alias("periods"), F.avg(x).alias("mean"), s.alias("s"))
    se = F.sqrt(F.greatest(F.col("s"), F.lit(0.0))) / F.col("periods")
    return a.select(*keys, "periods", "mean", se.alias("se"), ratio("mean", se).alias("t"))


def fama_macbeth(df: DataFrame, y: str, x: str, lags: int = 5, *keys: str) -> DataFrame:
    """Cross-sectional slopes per date, then their mean with Newey-West errors, per key (say indicator)."""
    slopes = df.where(col(y).isNotNull() & col(x).isNotNull()).groupBy(*keys, "dt").agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope")).where("n > 2")
    return newey_west(slopes, "slope", lags, *keys)


def draws(positions: DataFrame, length: int | str, seed: int, by: str | None = None) -> DataFrame:
    """Adds draw in 0..length-1 to rows (rep, pos), by whole-number arithmetic that any engine repeats; draws differ by
    the whole-number key `by` where one is given, and are shared otherwise."""
    p = 2147483647
    z: Column = F.col("rep") * 1000003 + F.col("pos") * 7919 + seed
    out = positions.withColumn("__z", (z if by is None else z + F.col(by) * 50021) % p)
    for m in (48271, 69621, 16807):
        out = out.withColumn("__z", (F.col("__z") * m + 12345) % p).withColumn("__z", (F.col("__z") * (F.col("__z") % 65521 + 1)) % p)
    return out.withColumn("draw", F.col("__z") % (F.col(length) if isinstance(length, str) else length)).drop("__z")


def _lots(reps: int, pos: np.ndarray, seed: int, first: int = 0) -> np.ndarray:
    """The numbers that draws() takes modulo a length, for reps (from `first` on) x pos."""
    p = 2147483647
    z = (np.arange(first, first + reps, dtype=np.int64)[:, None] * 1000003 + pos[None, :] * 7919 + seed) % p
    for m in (48271, 69621, 16807):
        z = (z * m + 12345) % p
        z = z * (z % 65521 + 1) % p
    return z


@lru_cache(maxsize=2)
def _drawn_counts(reps: int, length: int, seed: int) -> np.ndarray:
    """How often each replicate draws each of so many dates: reps x dates."""
    at = _lots(reps, np.arange(length, dtype=np.int64), seed) % length
    out = np.zeros((reps, length))
    np.add.at(out, (np.repeat(np.arange(reps), length), at.ravel()), 1.0)
    return out


def _fits(key, n: np.ndarray, sums: dict[str, np.ndarray], mx: float, my: float, alone: np.ndarray) -> pd.DataFrame:
    """ols() of every replicate, from counts and sums of values less mx and my; alone: a single date was drawn."""
    with np.errstate(divide="ignore", invalid="ignore"):
        ax, ay = sums["x"] / n, sums["y"] / n
        sxx, sxy, syy = sums["xx"] - n * ax * ax, sums["xy"] - n * ax * ay, np.maximum(sums["yy"] - n * ay * ay, 0)
        flat = alone | (sxx <= 1e-14 * sums["xx"])
        beta = np.where(flat, np.nan, sxy / sxx)
        alpha = ay + my - beta * (ax + mx)
        s2 = np.where(n > 2, np.maximum(syy - beta * sxy, 0) / (n - 2), np.nan)
        se = np.sqrt(s2 * (1 / n + (ax + mx) ** 2 / sxx))
        t = np.where(se > 0, alpha / se, np.nan)
    out = pd.DataFrame({"rep": np.arange(len(n)), "entity": key, "n": n.astype("int64"), "alpha": alpha, "beta": beta, "se": se, "t": t})
    return out[n > 0]


def _per_entity(rows: DataFrame, fit) -> DataFrame:
    """fit for the rows of each entity, which are at most as many as there are dates; NaN becomes null."""
    kind = rows.schema["entity"].dataType.simpleString()
    out = rows.groupBy("entity").applyInPandas(fit, f"rep long, entity {kind}, n long, alpha double, beta double, se double, t double")
    return out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("alpha", "beta", "se", "t")})


def _line(g: pd.DataFrame) -> tuple[float, float]:
    """(alpha, beta) of y on x; beta is NaN where x is constant."""
    a = g["x"].to_numpy() - g["x"].mean()
    beta = (a @ g["y"].to_numpy()) / (a @ a) if len(g) > 1 and g["x"].min() < g["x"].max() else np.nan
    return g["y"].mean() - beta * g["x"].mean(), beta


def bootstrap_alpha(df: DataFrame, y: str, x: str, reps: int, seed: int = 7, remove_alpha: bool = True) -> DataFrame:
    """Time-index bootstrap shared across entities: for each (rep, entity) the regression of y on x over resampled
    dates, after each entity's own alpha was removed. Rows are dealt by entity once and never repeated: the sums of all
    replicates of an entity are the products of its rows with the number of times that each date was drawn."""
    # one row per date: small by nature
    place = {r["dt"]: i for i, r in enumerate(df.select("dt").distinct().orderBy("dt").collect())}
    rows = df.where(col(y).isNotNull() & col(x).isNotNull()).select("entity", "dt", col(y).cast("double").alias("y"), col(x).cast("double").alias("x"))

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        c = _drawn_counts(reps, len(place), seed)[:, [place[d] for d in g["dt"]]]
        alpha = _line(g)[0] if remove_alpha else 0.0
        mx, my = g["x"].mean(), g["y"].mean() - alpha
        a, b = g["x"].to_numpy() - mx, g["y"].to_numpy() - alpha - my
        sums = {"x": c @ a, "y": c @ b, "xx": c @ (a * a), "xy": c @ (a * b), "yy": c @ (b * b)}
        return _fits(g["entity"].iloc[0], c.sum(axis=1), sums, mx, my, (c > 0).sum(axis=1) < 2)

    return _per_entity(rows, fit)


def percentile_of_score(sample: str, score: str) -> Column:
    """Mean of the strict and weak share of a sample below a score (kind 'rank'), as an aggregate."""
    left, right = F.sum(F.when(col(sample) < col(score), 1).otherwise(0)), F.sum(F.when(col(sample) <= col(score), 1).otherwise(0))
    return (left + right + F.when(right > left, 1).otherwise(0)) / (2 * F.count(sample))


def bootstrap_residuals(df: DataFrame, y: str, x: str, reps: int, seed: int = 7) -> DataFrame:
    """For each (rep, entity) the regression on the factor as it was of beta x plus a residual drawn among the entity's
    own, independently of other entities (whose ids are whole numbers): the distribution of t where there is no alpha."""
    rows = df.where(col(y).isNotNull() & col(x).isNotNull()).select("entity", "dt", col(y).cast("double").alias("y"), col(x).cast("double").alias("x"))

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("dt")
        n, key, mx = len(g), g["entity"].iloc[0], g["x"].mean()
        alpha, beta = _line(g)
        a, e = g["x"].to_numpy() - mx, g["y"].to_numpy() - alpha - beta * g["x"].to_numpy()
        drawn = beta * a + e[_lots(reps, np.arange(n, dtype=np.int64), seed + int(key) * 50021) % n]
        full = np.full(reps, 0.0 if np.isnan(beta) else float(n))  # without a slope there are no residuals to draw
        sums = {"x": full * a.mean(), "y": drawn.sum(axis=1), "xx": np.full(reps, (a * a).sum()), "xy": drawn @ a, "yy": (drawn * drawn).sum(axis=1)}
        return _fits(key, full, sums, mx, beta * mx, np.full(reps, n < 2))

    return _per_entity(rows, fit)


#: Numbers that a task holds of the replicates of one entity at a time.
_HELD = 1 << 21


def _by_dates(df: DataFrame, y: str, x: str) -> tuple[DataFrame, dict, np.ndarray]:
    """(complete rows; the rank of each date; the factor of each date, NaN where it has none)."""
    # one row per date: small by nature
    seen = df.groupBy("dt").agg(F.max(col(x).cast("double")).alias("fx")).orderBy("dt").collect()
    rows = df.where(col(y).isNotNull() & col(x).isNotNull()).select("entity", "dt", col(y).cast("double").alias("y"), col(x).cast("double").alias("x"))
    return rows, {r["dt"]: i for i, r in enumerate(seen)}, np.array([np.nan if r["fx"] is None else r["fx"] for r in seen])


def _replicated(g: pd.DataFrame, place: dict, reps: int, pseudo) -> pd.DataFrame:
    """Fits of all replicates of an entity: pseudo(rank of each date, beta, residuals, first replicate, how many) gives the
    returns and the factor, replicates x dates, NaN where one has none. So many replicates at a time as memory is
    meant for; no row is repeated outside the task."""
    g = g.sort_values("dt")
    (alpha, beta), key, mx = _line(g), g["entity"].iloc[0], g["x"].mean()
    if np.isnan(beta):
        return _fits(key, np.zeros(0), {c: np.zeros(0) for c in ("x", "y", "xx", "xy", "yy")}, 0.0, 0.0, np.zeros(0, bool))
    k, e = np.array([place[d] for d in g["dt"]], dtype=np.int64), g["y"].to_numpy() - alpha - beta * g["x"].to_numpy()
    out, step = [], max(1, _HELD // len(g))
    for first in range(0, reps, step):
        y, f = pseudo(g["x"].to_numpy(), k, beta, e, first, min(step, reps - first))
        ok = ~(np.isnan(y) | np.isnan(f))
        a, b = np.where(ok, f - mx, 0.0), np.where(ok, y - beta * mx, 0.0)
        n = ok.sum(axis=1)
        sums = {"x": a.sum(axis=1), "y": b.sum(axis=1), "xx": (a * a).sum(axis=1), "xy": (a * b).sum(axis=1), "yy": (b * b).sum(axis=1)}
        fits = _fits(key, n.astype(float), sums, mx, beta * mx, n < 2)
        out.append(fits.assign(rep=fits["rep"] + first))
    return pd.concat(out)


def bootstrap_cross_section(df: DataFrame, y: str, x: str, reps: int, seed: int = 7) -> DataFrame:
    """For each (rep, entity) the regression on the factor of beta x plus the residual of a drawn date, the same draw for
    all entities, which keeps how residuals go together; dates without a residual of the entity are left out."""
    rows, place, _ = _by_dates(df, y, x)

    def pseudo(own, k, beta, e, first, count):
        residual = np.full(len(place), np.nan)
        residual[k] = e
        return beta * own + residual[_lots(count, k, seed, first) % len(place)], np.broadcast_to(own, (count, len(own)))

    return _per_entity(rows, lambda g: _replicated(g, place, reps, pseudo))


def bootstrap_residual_and_factor(df: DataFrame, y: str, x: str, reps: int, seed: int = 7, on_drawn: bool = False) -> DataFrame:
    """As bootstrap_residuals, with the factor drawn too: one draw of dates for all entities and another stream of
    residuals for each. The pseudo returns are regressed on the factor as it was, or as it was drawn."""
    rows, place, factor = _by_dates(df, y, x)

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        stream = seed + int(g["entity"].iloc[0]) * 50021

        def pseudo(own, k, beta, e, first, count):
            drawn = factor[_lots(count, k, seed + 6, first) % len(place)]
            residual = e[_lots(count, np.arange(len(e), dtype=np.int64), stream, first) % len(e)]
            return beta * drawn + residual, drawn if on_drawn else np.broadcast_to(own, drawn.shape)

        return _replicated(g, place, reps, pseudo)

    return _per_entity(rows, fit)


def _date_draws(spark, dates: DataFrame, reps: int, seed: int) -> DataFrame:
    """(rep, pos, draw) of one draw of as many dates as there are, per replicate."""
    length = max(1, dates.count())
    return draws(spark.range(reps).select(F.col("id").alias("rep")).crossJoin(spark.range(length).select(F.col("id").alias("pos"))), length, seed)


def scaled_intercepts(df: DataFrame, y: str, x: str, asset: str = "asset", candidate: str = "candidate", *keys: str) -> DataFrame:
    """How far each candidate factor shrinks the intercepts of assets, against no factor at all: si_mean and si_median, the
    relative change of the mean and median of |intercept| over the standard error of the asset's mean.

    df: one row per (keys, asset, candidate, date), with the asset's return y and the candidate's x."""
    ok = df.where(col(y).isNotNull() & col(x).isNotNull())
    a = ok.groupBy(*keys, candidate, asset).agg(F.count("*").alias("n"), F.avg(y).alias("base"), F.stddev_samp(y).alias("sd"), F.avg(x).alias("mx"), F.regr_slope(y, x).alias("b"))
    se = F.col("sd") / F.sqrt(F.col("n").cast("double"))
    a = a.select(*keys, candidate, ratio(F.abs("base"), se).alias("before"), ratio(F.abs(F.col("base") - F.col("b") * F.col("mx")), se).alias("after")).dropna()
    m = a.groupBy(*keys, candidate).agg(F.avg("before").alias("m0"), F.avg("after").alias("m1"), F.percentile("before", 0.5).alias("d0"), F.percentile("after", 0.5).alias("d1"))
    return m.select(*keys, candidate, ratio(F.col("m1") - F.col("m0"), "m0").alias("si_mean"), ratio(F.col("d1") - F.col("d0"), "d0").alias("si_median"))


def controlled_slopes(df: DataFrame, y: str, x: str, controls: Sequence[str], lags: int, *keys: str) -> DataFrame:
    """Fama-MacBeth of y on x with controls: slopes of x per (keys, date), then their mean, Newey-West error and t."""
    from panelforge.operators.models import ols_multi

    s = ols_multi(df, y, [x, *controls], *keys, "dt").where(F.col("n") > len(controls) + 2)
    return newey_west(s.select(*keys, "dt", F.col("betas")[0].alias("slope")).where("slope is not null"), "slope", lags, *keys)


def plant(replicates: DataFrame, fits: DataFrame, count: int, size: float = 3.0, seed: int = 11) -> DataFrame:
    """In each replicate, `count` entities get an alpha of `size` standard errors of their own fit, up and down in turn.
    An alpha that is added to the returns moves the estimate by as much and leaves its error."""
    lots = draws(replicates.withColumn("pos", F.col("entity")), 2147483647, seed)
    place = F.row_number().over(Window.partitionBy("rep").orderBy("draw", "entity"))
    out = lots.withColumn("__k", place).join(fits.select("entity", F.col("se").alias("__se")), "entity")
    shift = F.when(F.col("__k") <= count, size * F.col("__se") * F.when(F.col("__k") % 2 == 1, 1).otherwise(-1)).otherwise(0.0)
    alpha = F.col("alpha") + F.coalesce(shift, F.lit(0.0))
    return out.select("rep", "entity", "n", "beta", "se", (F.col("__k") <= count).alias("planted"), alpha.alias("alpha"), ratio(alpha, "se").alias("t"))


def replicate_bands(replicates: DataFrame, fits: DataFrame, points: list[float]) -> DataFrame:
    """For each percentile of the cross-section of t: its value in the data, the 5 % and 95 % points over replicates, and
    the share of replicates that reach the value."""
    at = F.array(*map(F.lit, points))
    real = fits.groupBy().agg(F.percentile("t", at).alias("q")).select(F.posexplode("q").alias("k", "realized"))
    reps = replicates.groupBy("rep").agg(F.percentile("t", at).alias("q")).select("rep", F.posexplode("q").alias("k", "v"))
    both = reps.join(F.broadcast(real), "k")
    band = both.groupBy("k").agg(F.first("realized").alias("realized"), F.percentile("v", 0.05).alias("low"), F.percentile("v", 0.95).alias("high"), F.avg((F.col("v") >= F.col("realized")).cast("double")).alias("p"))
    return band.withColumn("point", F.element_at(at, F.col("k") + 1)).drop("k")


def predictions(df: DataFrame, y: str, x: str, months: int, *keys: str) -> DataFrame:
    """y predicted from x by the cross-sectional coefficients of earlier dates: their mean over the trailing `months`
    dates before. Every smoothing starts from the coefficients themselves."""
    ok = df.where(col(y).isNotNull() & col(x).isNotNull())
    fit = ok.groupBy(*keys, "dt").agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("b"), (F.avg(y) - F.regr_slope(y, x) * F.avg(x)).alias("a")).where("n > 2")
    w = Window.partitionBy(*keys).orderBy("dt").rowsBetween(-months, -1)
    mean = lambda c: F.when(F.count(c).over(w) >= months, F.avg(c).over(w))
    return df.join(fit.select(*keys, "dt", mean("a").alias("__a"), mean("b").alias("__b")), [*keys, "dt"]).withColumn("predicted", F.col("__a") + F.col("__b") * col(x)).drop("__a", "__b")
