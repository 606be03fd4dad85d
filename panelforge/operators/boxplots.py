"""The skewness-adjusted boxplot for groups of any size.

The medcouple is the median of a kernel over all pairs of an upper with a lower value. No pair is made: the distances
from the median lie in sorted blocks, whose bounds alone tell for most pairs of blocks on which side of a threshold all
their pairs are; the others are counted at many thresholds at once, until the median lies between two neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.core import col
from panelforge.operators import xs
from panelforge.operators.quantiles import FEW, _on, exact_quantiles
from panelforge.sources.tables import stored

#: Different values of a block, thresholds of a round, and the width at which a kernel is found.
BLOCK, STEPS, WIDTH = 1 << 12, 64, 2.0**-50
QUARTILES = [0.25, 0.5, 0.75]


def _cut(size: int):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows in order of (gid, up, v) as blocks of `size` values; only a block and a batch are held."""
        held, key = [], None

        def block(part: pd.DataFrame) -> dict:
            return {"gid": key[0], "up": key[1], "first": part["v"].iloc[0], "last": part["v"].iloc[-1], "n": part["c"].sum(), "v": part["v"].to_numpy(), "c": part["c"].to_numpy()}

        def flush(least: int) -> Iterator[pd.DataFrame]:
            nonlocal held
            rows = pd.concat(held) if held else pd.DataFrame({"v": []})
            stop = len(rows) if least == 1 else len(rows) // size * size
            if stop:
                yield pd.DataFrame([block(rows.iloc[i : min(i + size, stop)]) for i in range(0, stop, size)])
            held = [rows.iloc[stop:]] if stop < len(rows) else []

        for b in batches:
            new = ((b["gid"] != b["gid"].shift()) | (b["up"] != b["up"].shift())).to_numpy()
            at = [*np.flatnonzero(new), len(b)]
            for i, j in zip(at, at[1:], strict=False):
                here = (int(b["gid"].iloc[i]), bool(b["up"].iloc[i]))
                if key is not None and here != key:
                    yield from flush(1)
                key = here
                held.append(b.iloc[i:j])
                if sum(map(len, held)) >= size:
                    yield from flush(size)
        yield from flush(1)

    return cut


def _slope(t: float | np.ndarray) -> np.ndarray:
    """A pair's kernel is at most t where its lower distance is at least this times the upper one."""
    with np.errstate(divide="ignore"):
        return np.divide(1 - np.float64(t), 1 + np.float64(t)) if np.isscalar(t) else (1 - t) / (1 + t)


def _tail(n: np.ndarray) -> np.ndarray:
    """How many lie at or behind each place."""
    return np.append(np.cumsum(n[::-1].astype(np.int64))[::-1], 0)


def _sides(bounds: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """First and last value and number of each upper block, then of each lower one."""
    b = bounds.sort_values("first")
    return tuple(b.loc[b["up"] == s, c].to_numpy() for s in (True, False) for c in ("first", "last", "n"))


def _bracket(aims: pd.DataFrame, bounds: pd.DataFrame) -> pd.DataFrame:
    """Thresholds around the kernel of each rank, by the bounds of blocks alone."""
    ua, uz, un, la, lz, ln = _sides(bounds)
    tail = _tail(ln)

    def narrow(enough) -> tuple[float, float]:
        lo, hi = -1.0, 1.0
        while hi - lo > WIDTH:
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if enough(mid) else (mid, hi)
        return lo, hi

    lo, hi = [], []
    for r, least, ties in zip(aims["rank"], aims["least"], aims["ties"], strict=True):
        at = lambda t: least + (ties if t >= 0 else 0)  # noqa: B023, E731
        lo.append(narrow(lambda t: at(t) + int((un * tail[np.searchsorted(lz, ua * _slope(t))]).sum()) >= r)[0])  # noqa: B023
        hi.append(narrow(lambda t: at(t) + int((un * tail[np.searchsorted(la, uz * _slope(t))]).sum()) >= r)[1])  # noqa: B023
    return aims.assign(lo=lo, hi=hi)


def _undecided(brackets: pd.DataFrame, bounds: pd.DataFrame) -> pd.DataFrame:
    """Of each bracket, the pairs that its lower end already counts, in a row of its own, and the pairs of blocks (by
    their first values) that its thresholds may part."""
    ua, uz, un, la, lz, ln = _sides(bounds)
    tail, out = _tail(ln), []
    for gid, lo, hi in zip(brackets["gid"], brackets["lo"], brackets["hi"], strict=True):
        sure = np.searchsorted(la, uz * _slope(lo))
        first = np.minimum(np.searchsorted(lz, ua * _slope(hi)), sure)
        many = sure - first
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
        u, low = np.append(np.repeat(ua, many), np.nan), np.append(la[place], np.nan)
        out.append(pd.DataFrame({"gid": gid, "lo": lo, "hi": hi, "base": np.append(np.zeros(len(place), np.int64), (un * tail[sure]).sum()), "u": u, "l": low}))
    return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("gid", "lo", "hi", "base", "u", "l")})


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many pairs of two blocks have a kernel of at most t, for thresholds t inside the bracket."""
    for b in batches:
        for r in b.itertuples():
            t = np.unique(np.linspace(r.lo, r.hi, STEPS + 1))
            t = t[(t > r.lo) & (t < r.hi)]
            n = np.full(len(t), r.base, np.int64)
            if r.uv is not None and r.lv is not None:
                n += (_tail(np.asarray(r.lc))[np.searchsorted(r.lv, np.outer(_slope(t), r.uv))] * np.asarray(r.uc)).sum(1)
            yield pd.DataFrame({"gid": r.gid, "lo": r.lo, "hi": r.hi, "t": t, "n": n})


def _large_medcouples(z: DataFrame, block: int) -> DataFrame:
    """(gid, mc) of rows (gid, z), z the distance from the group's median."""
    tally = z.groupBy("gid").agg(F.count_if(F.col("z") > 0).alias("above"), F.count_if(F.col("z") < 0).alias("below"), F.count_if(F.col("z") == 0).alias("ties"))
    same = F.expr("ties * (ties - 1) div 2")
    tally = tally.withColumns({"total": (F.col("above") + F.col("ties")) * (F.col("below") + F.col("ties")), "least": F.col("ties") * F.col("below") + same, "most": F.col("ties") * F.col("above") + same})
    ranks = F.explode(F.array_distinct(F.array(F.expr("(total + 1) div 2"), F.expr("total div 2 + 1"))))
    aims = tally.withColumn("rank", ranks).select("gid", "rank", "least", "ties", "total", "most")
    end = F.when(F.col("rank") <= F.col("least"), -1.0).when(F.col("rank") > F.col("total") - F.col("most"), 1.0)
    aims = stored(aims.withColumn("end", end.cast("double")), "kernels")

    half = z.where("z <> 0").groupBy("gid", (F.col("z") > 0).alias("up"), F.abs("z").alias("v")).agg(F.count("*").alias("c"))
    # ranges of the sorted values, so that a group lies over many tasks
    half = half.repartitionByRange("gid", "up", "v").sortWithinPartitions("gid", "up", "v")
    blocks = stored(half.mapInPandas(_cut(block), "gid long, up boolean, first double, last double, n long, v array<double>, c array<long>"), "halves")
    bounds = blocks.select("gid", "up", "first", "last", "n")  # a row per block
    side = lambda up, a, v, c: blocks.where(F.col("up") == up).select("gid", F.col("first").alias(a), F.col("v").alias(v), F.col("c").alias(c))

    known = [aims.where("end is not null").select("gid", F.col("end").alias("value"))]
    state = "gid long, rank long, least long, ties long, lo double, hi double"
    aims = aims.where("end is null").select("gid", "rank", "least", "ties").groupBy("gid").cogroup(bounds.groupBy("gid"))
    aims = stored(aims.applyInPandas(lambda a, b: _bracket(a, b)[["gid", "rank", "least", "ties", "lo", "hi"]] if len(a) else a.assign(lo=[], hi=[]), state), "brackets")
    while True:
        known.append(aims.where(F.col("hi") - F.col("lo") <= WIDTH).select("gid", F.col("hi").alias("value")))
        aims = aims.where(F.col("hi") - F.col("lo") > WIDTH)
        if not aims.limit(1).count():
            break
        brackets = aims.select("gid", "lo", "hi").distinct()
        pairs = brackets.groupBy("gid").cogroup(bounds.groupBy("gid")).applyInPandas(_undecided, "gid long, lo double, hi double, base long, u double, l double")
        pairs = pairs.withColumns({c: F.nanvl(c, F.lit(None)) for c in ("u", "l")}).repartition("gid", "u", "l")
        pairs = pairs.join(side(True, "u", "uv", "uc"), ["gid", "u"], "left").join(side(False, "l", "lv", "lc"), ["gid", "l"], "left")
        counts = pairs.select("gid", "lo", "hi", "base", "uv", "uc", "lv", "lc").mapInPandas(_counted, "gid long, lo double, hi double, t double, n long")
        counts = counts.groupBy("gid", "lo", "hi", "t").agg(F.sum("n").alias("n"))
        n = F.col("n") + F.col("least") + F.when(F.col("t") >= 0, F.col("ties")).otherwise(0)
        below, above = F.max(F.when(n < F.col("rank"), F.col("t"))), F.min(F.when(n >= F.col("rank"), F.col("t")))
        moved = aims.join(counts, ["gid", "lo", "hi"]).groupBy("gid", "rank", "least", "ties", "lo", "hi").agg(below.alias("below"), above.alias("above"))
        aims = stored(moved.select("gid", "rank", "least", "ties", F.coalesce("below", "lo").alias("lo"), F.coalesce("above", "hi").alias("hi")), "brackets")
    out = known[0]
    for k in known[1:]:
        out = out.unionByName(k)
    return out.groupBy("gid").agg(F.avg("value").alias("mc"))


def medcouples(df: DataFrame, x: str, *keys: str, few: int = FEW, block: int = BLOCK) -> DataFrame:
    """(keys, n, q, mc): each group's number of values, quartiles and medcouple; groups without a value have none.

    Groups of at most `few` values are solved where they are. Of the others a task holds some blocks, and one task the
    bounds of a group's blocks (n / block rows). Pairs are counted in 64 bits: up to 6 * 10^9 values a group. Keys may
    be null; values are finite.
    """
    stats = stored(exact_quantiles(df, x, QUARTILES, *keys, few=few).withColumn("__gid", F.monotonically_increasing_id()), "quartiles")
    s, on = _on(df, stats.select(*keys, "__gid", F.col("n").alias("__n"), F.col("q")[1].alias("__m")), keys)
    rows = df.where(col(x).isNotNull()).join(s, on).select(F.col("__gid").alias("gid"), (col(x).cast("double") - F.col("__m")).alias("z"), F.col("__n").alias("n"))
    rows = stored(rows, "distances")
    small = rows.where(F.col("n") <= few).groupBy("gid").agg(F.collect_list("z").alias("v")).select("gid", xs._medcouples("v").alias("mc"))
    mc = small.unionByName(_large_medcouples(rows.where(F.col("n") > few).select("gid", "z"), block))
    return stats.join(mc.withColumnRenamed("gid", "__gid"), "__gid").select(*keys, "n", "q", "mc")


def adjusted_boxplot_large(df: DataFrame, x: str, *keys: str, few: int = FEW, block: int = BLOCK) -> DataFrame:
    """xs.adjusted_boxplot for groups of any size; rows with a null key are a group too."""
    keys = keys or ("dt",)
    df = stored(df, "boxplot")
    lo, hi = xs.fences(F.col("q"), F.col("mc"))
    s, on = _on(df, medcouples(df, x, *keys, few=few, block=block).select(*keys, lo.alias("__lo"), hi.alias("__hi")), keys)
    fenced = stored(df.join(s, on, "left").drop(*[f"__k{i}" for i in range(len(keys))]), "fenced")
    inside: Column = F.when(col(x).between(F.col("__lo"), F.col("__hi")), col(x))
    ends, on = _on(fenced, fenced.groupBy(*keys).agg(F.min(inside).alias("__a"), F.max(inside).alias("__b")), keys)
    clamped = F.when(col(x).isNotNull(), F.least(F.greatest(col(x), F.col("__a")), F.col("__b")))
    return fenced.join(ends, on, "left").withColumn(x, clamped).select(*df.columns)
