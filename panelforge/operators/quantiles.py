"""Exact quantiles of groups of any size, without a group in one task.

A mergeable sketch brackets each rank; exact counts say how many values lie below the bracket and in it; the values in
it are bracketed again while they are many, and ranked when they are few. Each round keeps some thousandths of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.core import col, ratio
from panelforge.sources.tables import stored

#: Values of a bracket that are ranked in one task, and the accuracy of the sketch.
FEW, ACCURACY = 1 << 16, 2000
#: Size of a mergeable sketch whose ranks are off by some 0.0004, and the part of the values taken on each side of a median.
SKETCH, ASIDE = 1 << 14, 0.00075


def exact_quantiles(df: DataFrame, x: str, points: Sequence[float], *keys: str, few: int = FEW) -> DataFrame:
    """(keys, n, q): the number of values of each group and its quantiles, interpolated between neighbours as the
    built-in percentile does; groups without a value have none. Keys may be null."""
    rows = stored(df.where(col(x).isNotNull()).select(F.struct(*keys).alias("g"), col(x).cast("double").alias("x")), "values")
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("point"), F.lit(float(p)).alias("p")) for i, p in enumerate(points)]))
    want = rows.groupBy("g").agg(F.count("*").alias("n")).select("g", "n", at.alias("t")).select("g", "n", "t.*").withColumn("place", F.col("p") * (F.col("n") - 1))
    # each quantile lies between the values of two ranks (from 0); `skip` values are below those that are still in the race
    aims = want.select("g", "n", F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place")))).alias("rank")).distinct()
    values = _values(rows, stored(aims.select(F.struct("g", "rank").alias("id"), "g", "n", "rank", F.lit(0).cast("long").alias("skip")), "aims"), few)
    return _between(want, values).groupBy("g", "n").agg(F.sort_array(F.collect_list(F.struct("point", "v"))).alias("q")).select("g.*", "n", F.transform("q", lambda s: s["v"]).alias("q"))


def _values(rows: DataFrame, aims: DataFrame, few: int) -> DataFrame:
    """(id, value) at the rank of each aim (id, g, n, rank, skip): rows (g, x) hold n values of g, above `skip` others."""
    found = []
    while True:
        near = rows.join(aims.where(F.col("n") <= few).drop("n"), "g")
        nth = F.row_number().over(Window.partitionBy("id").orderBy("x")) - 1
        found.append(near.withColumn("k", nth + F.col("skip")).where("k = rank").select("id", F.col("x").alias("value")))
        large = aims.where(F.col("n") > few)
        if not large.limit(1).count():
            break
        rows = rows.join(large.select("g").distinct(), "g", "left_semi")
        # a ladder of values; cell 2i + 1 is the rung i itself, cell 2i what lies under it
        rungs = rows.groupBy("g").agg(F.array_distinct(F.percentile_approx("x", [i / 256 for i in range(257)], ACCURACY)).alias("r"))
        cell = 2 * F.size(F.filter("r", lambda v: v < F.col("x"))) + F.array_contains("r", F.col("x")).cast("int")
        cells = rows.join(rungs, "g").groupBy("g", cell.alias("cell")).agg(F.count("*").alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        before = F.sum("c").over(Window.partitionBy("g").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
        place = F.col("rank") - F.col("skip")
        aims = large.drop("n").join(cells.withColumn("before", before), "g").where((place >= F.col("before")) & (place < F.col("before") + F.col("c")))
        aims = stored(aims.select("id", "g", F.col("c").alias("n"), "rank", (F.col("skip") + F.col("before")).alias("skip"), "lo", "hi"), "aims")
        found.append(aims.where("lo = hi").select("id", F.col("lo").alias("value")))
        # from here on an aim has rows of its own: those of its cell
        aims = aims.where("lo < hi")
        rows = stored(rows.join(aims.select("id", "g", "lo", "hi"), "g").where("x between lo and hi").select(F.col("id").alias("g"), "x"), "inside")
        aims = aims.select("id", F.col("id").alias("g"), "n", "rank", "skip")
    values = found[0]
    for f in found[1:]:
        values = values.unionByName(f)
    return stored(values, "quantiles")


def _between(want: DataFrame, values: DataFrame) -> DataFrame:
    """want with v, the value at its place, between those at the ranks on both sides."""
    side = lambda to, c: values.select(F.col("id.g").alias("g"), F.col("id.rank").alias(to), F.col("value").alias(c))
    out = want.withColumns({"a": F.floor("place"), "b": F.ceil("place")}).join(side("a", "low"), ["g", "a"]).join(side("b", "high"), ["g", "b"])
    part = F.col("place") - F.col("a")
    return out.withColumn("v", F.when(part == 0, F.col("low")).otherwise(F.col("low") * (1 - part) + F.col("high") * part))


def distribution_with_total(df: DataFrame, x: str, key: str, apart: float, few: int = FEW) -> DataFrame:
    """(key, total, n, mean, median, std, lo, hi, large) of each of the few values of key and, with a null key and total
    true, of all rows; `large` counts the values further than `apart` from 0. No group is in one task.

    Mergeable sketches of the keys bracket the medians, that of all rows too; values below and inside are counted, and
    the median is sought in the bracket if the counts say that it lies there, else in the whole group."""
    rows = stored(df.select(F.col(key).alias("k"), col(x).cast("double").alias("x")), "distribution")
    figures = [
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("lo"), F.max("x").alias("hi"),
        F.count_if(F.abs("x") > apart).alias("large"),
    ]
    none, of = F.lit(None).cast(df.schema[key].dataType), lambda k, total: F.struct(k.alias("k"), F.lit(total).alias("total")).alias("g")
    each = stored(rows.groupBy("k").agg(*figures, F.kll_sketch_agg_double("x", F.lit(SKETCH)).alias("s")), "keys")
    everything = rows.agg(*figures).crossJoin(each.agg(F.kll_merge_agg_double("s", F.lit(SKETCH)).alias("s")))
    groups = each.select(of(F.col("k"), False), *each.columns[1:]).unionByName(everything.select(of(none, True), "*"))
    edge = lambda p: F.when(F.col("n") > few, F.kll_sketch_get_quantile_double("s", F.lit(p)))
    groups = stored(groups.withColumns({"a": edge(0.5 - ASIDE), "b": edge(0.5 + ASIDE)}).drop("s"), "groups")

    def beside(bounds: DataFrame) -> DataFrame:
        """The rows with the brackets of their key and of all rows."""
        own = bounds.where("not g.total").select(F.col("g.k").alias("own"), F.col("a").alias("own_a"), F.col("b").alias("own_b"))
        out = rows.where("x is not null").join(F.broadcast(own), F.col("k").eqNullSafe(F.col("own")))
        return out.crossJoin(F.broadcast(bounds.where("g.total").select("a", "b")))

    side = lambda c, a, b: [F.count_if(F.col("x") < F.col(a)).alias(f"{c}_below"), F.count_if(F.col("x").between(F.col(a), F.col(b))).alias(f"{c}_in")]
    counts = stored(beside(groups).groupBy("k").agg(*side("own", "own_a", "own_b"), *side("all", "a", "b")), "counts")
    held = counts.select(of(F.col("k"), False), F.col("own_below").alias("below"), F.col("own_in").alias("inside"))
    held = held.unionByName(counts.agg(F.sum("all_below").alias("below"), F.sum("all_in").alias("inside")).select(of(none, True), "*"))
    want = groups.where("n > 0").join(held, "g").withColumn("place", 0.5 * (F.col("n") - 1))
    there = (F.floor("place") >= F.col("below")) & (F.ceil("place") < F.col("below") + F.col("inside"))
    either = lambda c, other: F.when(there, F.col(c)).otherwise(other)
    want = stored(want.select("g", "place", either("a", None).alias("a"), either("b", None).alias("b"), either("inside", F.col("n")).alias("n"), either("below", 0).alias("skip")), "want")

    inside = lambda a, b: F.coalesce(F.col("x").between(F.col(a), F.col(b)), F.lit(True))
    near = beside(want).where(inside("own_a", "own_b") | inside("a", "b"))
    near = near.select("x", F.explode(F.array(F.when(inside("own_a", "own_b"), of(F.col("k"), False)), F.when(inside("a", "b"), of(none, True)))).alias("g"))
    aims = want.select("g", "n", "skip", F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place")))).alias("rank"))
    values = _values(stored(near.where("g is not null"), "near"), stored(aims.select(F.struct("g", "rank").alias("id"), "g", "n", "rank", "skip"), "aims"), few)
    out = groups.join(_between(want.select("g", "place"), values).select("g", F.col("v").alias("median")), "g", "left")
    return out.select(F.col("g.k").alias(key), "g.total", "n", "mean", "median", "std", "lo", "hi", "large")


def _on(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, Column]:
    """b with its keys under other names, and the condition that equals them, nulls included."""
    b = b.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(keys)})
    on = F.lit(True)
    for i, k in enumerate(keys):
        on &= a[k].eqNullSafe(b[f"__k{i}"])
    return b, on


def clip_mad_large(df: DataFrame, x: str, *keys: str, k: float = 4.5, few: int = FEW) -> DataFrame:
    """xs.clip_mad for groups of any size."""
    keys = keys or ("dt",)
    df = stored(df, "clip")
    m, on = _on(df, exact_quantiles(df, x, [0.5], *keys, few=few).select(*keys, F.col("q")[0].alias("__m")), keys)
    apart = stored(df.join(m, on, "left").drop(*[f"__k{i}" for i in range(len(keys))]).withColumn("__a", F.abs(col(x) - F.col("__m"))), "clip")
    d, on = _on(apart, exact_quantiles(apart, "__a", [0.5], *keys, few=few).select(*keys, F.col("q")[0].alias("__d")), keys)
    out = apart.join(d, on, "left")
    clipped = F.greatest(F.least(col(x), F.col("__m") + k * F.col("__d")), F.col("__m") - k * F.col("__d"))
    return out.withColumn(x, F.when(col(x).isNotNull(), clipped)).select(*df.columns)


def zscore_clipped_large(df: DataFrame, x: str, *keys: str, k: float = 4.5, few: int = FEW) -> DataFrame:
    """A signal's standardisation (clipped, then less its mean over its deviation with divisor n) for groups of any size."""
    keys = keys or ("dt",)
    out = stored(clip_mad_large(df, x, *keys, k=k, few=few), "clipped")
    s, on = _on(out, out.groupBy(*keys).agg(F.avg(x).alias("__mean"), F.stddev_pop(x).alias("__sd")), keys)
    return out.join(s, on, "left").withColumn(x, ratio(col(x) - F.col("__mean"), "__sd")).select(*df.columns)


def buckets_large(df: DataFrame, x: str, groups: int, *keys: str, few: int = FEW) -> DataFrame:
    """core.bucket for groups of any size: adds bucket 1..groups with interpolated, right-closed edges."""
    keys = keys or ("dt",)
    df = stored(df, "buckets")
    e, on = _on(df, exact_quantiles(df, x, [i / groups for i in range(1, groups)], *keys, few=few).select(*keys, F.col("q").alias("__q")), keys)
    above = F.size(F.filter("__q", lambda v: v < col(x)))
    return df.join(e, on, "left").withColumn("bucket", F.when(col(x).isNotNull(), 1 + above).cast("int")).select(*[c for c in df.columns if c != "bucket"], "bucket")
