"""Regressions on several factors from grouped sums, spanning tests, principal components and matched counts of models.

Sums of products are aggregated by Spark; only the small systems that they form are solved in tasks, a batch at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.core import col
from panelforge.operators import blocks
from panelforge.sources.tables import stored


def _solve(n: np.ndarray, xx: np.ndarray, xy: np.ndarray, yy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, t values and R2 of a stack of normal equations; null (NaN) where singular or without freedom."""
    k = xx.shape[1]
    sound = (np.linalg.matrix_rank(xx) == k) & (n > k)
    safe = np.where(sound[:, None, None], xx, np.eye(k))
    inverse = np.linalg.inv(safe)
    beta = np.einsum("nij,nj->ni", inverse, xy)
    rss = np.maximum(yy - np.einsum("ni,ni->n", beta, xy), 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        se = np.sqrt(np.einsum("nii->ni", inverse) * (rss / np.where(sound, n - k, np.nan))[:, None])
        t = np.where(se > 0, beta / se, np.nan)
        tss = yy - xy[:, 0] ** 2 / n
        r2 = np.where(tss > 0, 1 - rss / tss, np.nan)
    beta[~sound] = np.nan
    return beta, t, np.where(sound, r2, np.nan)


def ols_multi(df: DataFrame, y: str, xs: Sequence[str], *keys: str) -> DataFrame:
    """y on a constant and xs per key: n, alpha, alpha_t, r2 and arrays betas, ts in the order of xs; null where the
    factors are collinear or too few rows are complete."""
    names = ["__1", *xs]
    ok = df.dropna(subset=[y, *xs]).withColumn("__1", F.lit(1.0))
    pair = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"__x{i}_{j}") for i, j in pair]
    sums += [F.sum(F.col(c) * F.col(y)).alias(f"__y{i}") for i, c in enumerate(names)]
    a = ok.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col(y) * F.col(y)).alias("__yy"), *sums)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            xx = np.empty((len(b), len(names), len(names)))
            for i, j in pair:
                xx[:, i, j] = xx[:, j, i] = b[f"__x{i}_{j}"]
            xy = np.stack([b[f"__y{i}"].to_numpy() for i in range(len(names))], axis=1)
            beta, t, r2 = _solve(b["n"].to_numpy(float), xx, xy, b["__yy"].to_numpy())
            out = b[[*keys, "n"]].assign(alpha=beta[:, 0], alpha_t=t[:, 0], r2=r2)
            yield out.assign(betas=list(beta[:, 1:]), ts=list(t[:, 1:]))

    out = a.mapInPandas(solve, f"{kinds}, n long, alpha double, alpha_t double, r2 double, betas array<double>, ts array<double>")
    return out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("alpha", "alpha_t", "r2")})


def gram(df: DataFrame, value: str, series: str = "series", width: int = blocks.PAIR_BLOCK) -> DataFrame:
    """(a, b, n, sa, sb, p) per pair of series over the dates that both have: their number, the sum of each series and
    of the products. As many rows as squared series, which are the portfolios of a study and not its entities."""
    return blocks.pair_sums(blocks.blocked(df, value, series, width=width))


def model_alphas(df: DataFrame, value: str, market: str, series: str = "series", keys: Sequence[str] = (), width: int = blocks.BLOCK) -> DataFrame:
    """(keys, f1, f2, asset, t): for each model of the market and two series the t of the alpha of each other series; with
    keys, such as a replicate, for each of their values.

    Each regression has the dates on which its own three series and the market have a value, so a series with gaps
    takes no dates from the regressions without it. One that can't be fitted has no t. The sums of products are blocked
    products of matrices (operators/blocks.py): a task has three blocks of `width` series, a chunk of dates at a time."""
    held = blocks.blocked(df, value, series, keys, market, width)
    return blocks.named(held, blocks.triple_alphas(held), "f1", "f2", "asset").select(*keys, "f1", "f2", "asset", "t")


def matched_counts(df: DataFrame, value: str, market: str, hurdle: float = 1.96, series: str = "series", keys: Sequence[str] = (), width: int = blocks.BLOCK) -> DataFrame:
    """(keys, f1, f2, matched, assets): how many of the other series each model prices (|t| of alpha < hurdle); one that
    can't be fitted prices nothing. As model_alphas, with the counts taken where the regressions are."""
    held = blocks.blocked(df, value, series, keys, market, width)
    counts = blocks.triple_alphas(held, hurdle).groupBy(*keys, "f1", "f2").agg(F.sum("matched").alias("matched"), F.sum("assets").alias("assets"))
    return blocks.named(held, counts, "f1", "f2").select(*keys, "f1", "f2", "matched", "assets")


def rarity_performance(alphas: DataFrame, hurdle: float = 1.96) -> DataFrame:
    """(f1, f2, share, place): the share of other series that a model prices, each weighted by the share of models that
    don't price it, and the share of models that do no better; from model_alphas."""
    priced = F.coalesce((F.abs("t") < hurdle).cast("double"), F.lit(0.0))
    x = alphas.withColumn("__p", priced)
    x = x.withColumn("__w", 1 - F.avg("__p").over(Window.partitionBy("asset")))
    out = x.groupBy("f1", "f2").agg(F.round(F.sum(F.col("__p") * F.col("__w")) / F.count("*"), 12).alias("share"))
    # one row per model of a study
    return out.withColumn("place", F.cume_dist().over(Window.orderBy("share")))


def simulated_matches(df: DataFrame, value: str, market: str, planted: Sequence[int], reps: int, series: str = "series", seed: int = 7, size: float = 3.0) -> DataFrame:
    """(planted, matched, low, mid, high, real): the distribution of matched counts if so many series had an alpha.

    In each replicate the dates are drawn anew for all series, alphas are taken out, and `planted` series get one of
    `size` standard errors, up and down in turn. Per number of planted series and matched count: the 5, 50 and 95 %
    points over replicates of the share of models with that count, and the share in the data."""
    from panelforge.operators.regress import _date_draws, ols

    real = matched_counts(df, value, market, series=series)
    ok = df.where(col(value).isNotNull() & col(market).isNotNull())
    fit = ols(ok, value, market, series).select(series, "alpha", F.col("se").alias("__se"))
    dates = ok.select("dt").distinct().withColumn("k", F.row_number().over(Window.orderBy("dt")).cast("long") - 1)
    # replicates, planted numbers and series of a study, not entities: small
    lots = ok.sparkSession.range(reps).select(F.col("id").alias("rep")).crossJoin(fit.select(series, "__se", "alpha"))
    place = F.row_number().over(Window.partitionBy("rep").orderBy(F.xxhash64(F.lit(seed), "rep", F.col(series).cast("string")), series))
    lots = lots.withColumn("__k", place).withColumn("planted", F.explode(F.array(*map(F.lit, planted))))
    shift = F.when(F.col("__k") <= F.col("planted"), size * F.col("__se") * F.when(F.col("__k") % 2 == 1, 1).otherwise(-1)).otherwise(0.0)
    lots = lots.select("rep", "planted", series, (F.coalesce(shift, F.lit(0.0)) - F.col("alpha")).alias("__shift"))
    drawn = _date_draws(ok.sparkSession, dates, reps, seed).select("rep", "pos", F.col("draw").alias("k")).join(dates, "k").select("rep", "pos", "dt")
    pseudo = ok.join(drawn, "dt").join(lots, ["rep", series])
    pseudo = pseudo.select("rep", "planted", F.col("pos").alias("dt"), series, (col(value) + F.col("__shift")).alias(value), market)
    counts = matched_counts(pseudo, value, market, series=series, keys=["rep", "planted"])
    share = lambda d, *k: d.groupBy(*k, "matched").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*k)))
    got = share(counts, "rep", "planted")
    # counts that a replicate never has are shares of zero
    seen = got.select("planted", "matched").distinct().unionByName(real.select("matched").distinct().crossJoin(lots.select("planted").distinct()).select("planted", "matched")).distinct()
    every = seen.crossJoin(got.select("rep").distinct()).join(got.select("rep", "planted", "matched", "share"), ["rep", "planted", "matched"], "left")
    q = F.percentile(F.coalesce("share", F.lit(0.0)), F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    out = every.groupBy("planted", "matched").agg(q.alias("q")).join(share(real).select("matched", F.col("share").alias("real")), "matched", "left")
    return out.select("planted", "matched", F.col("q")[0].alias("low"), F.col("q")[1].alias("mid"), F.col("q")[2].alias("high"), F.coalesce("real", F.lit(0.0)).alias("real"))


def f_survival(f: float, d1: float, d2: float) -> float:
    """P(F > f) of an F distribution, by the continued fraction of the incomplete beta function."""
    if not f > 0:
        return 1.0 if f == f else float("nan")
    x, a, b = d2 / (d2 + d1 * f), d2 / 2, d1 / 2
    if x > (a + 1) / (a + b + 2):
        return 1 - f_survival(1 / f, d2, d1)
    head = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 / max(1 - (a + b) * x / (a + 1), tiny)
    out = d
    for m in range(1, 500):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + t * d or tiny), 1 + t / c or tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return head * out


def spanning_test(df: DataFrame, assets: Sequence[str], factors: Sequence[str], *keys: str) -> DataFrame:
    """Joint test that all assets have no alpha on the factors, per key: n (rows), f and its p.

    df is wide in assets and factors, at most a few tens of each. Spark adds up the products of the columns, combined
    before they are shuffled; a task solves the small systems of the keys."""
    size, k = len(assets), len(factors)
    names = ["__1", *factors, *assets]
    pair = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    ok = df.dropna(subset=[*assets, *factors]).withColumn("__1", F.lit(1.0))
    sums = ok.groupBy(*keys).agg(F.array(*[F.sum(F.col(names[i]).cast("double") * F.col(names[j])) for i, j in pair]).alias("sums"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for flat in batch["sums"]:
                m = np.empty((len(names), len(names)))
                for v, (i, j) in zip(flat, pair, strict=True):
                    m[i, j] = m[j, i] = v
                n, f = m[0, 0], np.nan
                xx, xy, yy = m[: k + 1, : k + 1], m[: k + 1, k + 1 :], m[k + 1 :, k + 1 :]
                if n > size + k and np.linalg.matrix_rank(xx) == k + 1:
                    coef = np.linalg.solve(xx, xy)
                    sigma, mean = (yy - coef.T @ xy) / n, xx[0, 1:] / n
                    omega = xx[1:, 1:] / n - np.outer(mean, mean)
                    if np.linalg.matrix_rank(sigma) == size:
                        f = (n - size - k) / size * (coef[0] @ np.linalg.solve(sigma, coef[0])) / (1 + mean @ np.linalg.solve(omega, mean))
                out.append((int(n), f, f_survival(f, size, n - size - k)))
            yield batch[list(keys)].assign(**{c: [r[i] for r in out] for i, c in enumerate(("n", "f", "p"))})

    out = sums.mapInPandas(test, f"{kinds}, n long, f double, p double")
    return out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("f", "p")})


def principal_components(df: DataFrame, value: str, k: int, series: str = "series", width: int = blocks.PAIR_BLOCK) -> DataFrame:
    """(component, series, loading, share of variance) of centred series; the loading of greatest size is positive.

    Each covariance is taken over the dates that its two series share (0 where those are fewer than two), so with gaps
    the least shares may be below zero. The covariances stay a table of blocks; the leading vectors come from a subspace
    that grows by distributed products of the blocks with thin matrices (blocks.leading)."""
    held = blocks.blocked(df, value, series, width=width)
    cov = stored(blocks.covariance_blocks(held), "covariances")
    total = cov.agg(F.sum("trace")).first()[0]
    schema = "component int, sid int, loading double, share double"
    if not held.count:
        return blocks.named(held, df.sparkSession.createDataFrame([], schema), "sid").select("component", F.col("sid").alias("series"), "loading", "share")
    share, vectors = blocks.leading(cov, held.count, width, min(k, held.count))
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    rows = pd.DataFrame([(c + 1, i, v, share[c] / total) for c in range(vectors.shape[1]) for i, v in enumerate(vectors[:, c])], columns=["component", "sid", "loading", "share"])
    return blocks.named(held, df.sparkSession.createDataFrame(rows, schema), "sid").select("component", F.col("sid").alias("series"), "loading", "share")


def model_performance(matched: DataFrame) -> DataFrame:
    """Share of other series that a model prices, and the share of models that do no better, from matched_counts."""
    matched = matched.withColumn("share", F.col("matched") / F.col("assets"))
    # one row per different share: at most as many as series
    upto = matched.groupBy("share").agg(F.count("*").alias("n"))
    upto = upto.select("share", (F.sum("n").over(Window.orderBy("share")) / F.sum("n").over(Window.partitionBy())).alias("place"))
    return matched.join(upto, "share").select("f1", "f2", "share", "place")
