"""Quantiles of large groups against the built-in ones of small groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.functions.core import bucket
from panelforge.operators import boxplots, quantiles, xs
from panelforge.plans.misc import QUERIES


def panel(spark, seed=1):
    r = random.Random(seed)
    rows = [(i, 1, r.gauss(0, 1)) for i in range(3000)] + [(i, 2, float(r.randrange(3))) for i in range(2500)] + [(i, None, 2.0**-i) for i in range(900)] + [(i, 3, None) for i in range(4)]
    rows += [(i, 4, float(i)) for i in range(3)] + [(5, 1, None), (6, 5, 7.0)]
    return spark.createDataFrame(rows, "entity int, dt int, x double").repartition(5)


@pytest.mark.parametrize("few", [1, 40, 1 << 16])
def test_exact_quantiles(spark, few):
    df, points = panel(spark), [0.0, 0.05, 0.333, 0.5, 0.95, 1.0]
    got = {r["dt"]: (r["n"], r["q"]) for r in quantiles.exact_quantiles(df, "x", points, "dt", few=few).collect()}
    want = df.groupBy("dt").agg(F.count("x").alias("n"), F.percentile("x", F.array(*map(F.lit, points))).alias("q")).where("n > 0").collect()
    assert got.keys() == {r["dt"] for r in want}
    for r in want:
        assert got[r["dt"]][0] == r["n"] and got[r["dt"]][1] == pytest.approx(r["q"], rel=1e-12, abs=1e-300)


@pytest.mark.parametrize("few, sketch, aside", [(1, 8, 0.0), (40, 8, 0.05), (40, 1 << 14, 0.01), (1 << 16, 1 << 14, 0.001)])
def test_distribution_with_total(spark, monkeypatch, few, sketch, aside):
    """Also where brackets miss the median: a rough sketch, a bracket of one value."""
    monkeypatch.setattr(quantiles, "SKETCH", sketch)
    monkeypatch.setattr(quantiles, "ASIDE", aside)
    df = panel(spark)
    out = quantiles.distribution_with_total(df, "x", "dt", 0.5, few=few)
    figures = [F.count("x"), F.avg("x"), F.percentile("x", 0.5), F.stddev_samp("x"), F.min("x"), F.max("x"), F.count_if(F.abs("x") > 0.5)]
    want = {(r[0], False): tuple(r[1:]) for r in df.groupBy("dt").agg(*figures).collect()} | {(None, True): tuple(df.agg(*figures).first())}
    got = {(r["dt"], r["total"]): tuple(r[2:]) for r in out.collect()}
    assert out.columns == ["dt", "total", "n", "mean", "median", "std", "lo", "hi", "large"] and got.keys() == want.keys()
    for k, v in want.items():
        assert [a is None for a in got[k]] == [a is None for a in v]
        assert [a for a in got[k] if a is not None] == pytest.approx([a for a in v if a is not None], rel=1e-9, abs=1e-300)


def test_registered_distribution_holds_no_group_in_a_task(spark, tmp_path):
    """Before: the built-in percentile, which gathers the values of a group in one task; no total of no rows."""
    full, empty = "/root/testdata/sf0.001", str(tmp_path)
    agg7 = QUERIES["agg7_distribution_with_total"]
    assert "percentile(" not in agg7(spark, full)._jdf.queryExecution().toString()
    for name in ("supplier", "nation", "lineitem"):
        t = spark.read.parquet(f"{full}/{name}.parquet")
        t.where("false" if name == "lineitem" else "true").write.parquet(f"{empty}/{name}.parquet")
    assert [tuple(r) for r in agg7(spark, empty).collect()] == [("all", 0, None, None, None, None, None, 0)]


def test_operators_of_large_dates(spark):
    df = panel(spark).where("dt is not null").withColumn("__k0", F.lit("clash")).drop("__k0")
    key = lambda v: [(a, b, c is None, c or 0) for a, b, c in v]
    assert sorted(key(rows2(quantiles.clip_mad_large(df, "x", k=1.5, few=50), "x"))) == sorted(key(rows2(xs.clip_mad(df, "x", k=1.5), "x")))
    z = xs.clip_mad(df, "x").withColumn("x", xs.zscore("x", ddof=0))
    assert sorted(key(rows2(quantiles.zscore_clipped_large(df, "x", few=50), "x"))) == sorted(key(rows2(z, "x")))
    b = df.withColumn("bucket", bucket("x", 5, "dt"))
    assert sorted(key(rows2(quantiles.buckets_large(df, "x", 5, few=50), "bucket"))) == sorted(key(rows2(b, "bucket")))


@pytest.mark.parametrize("few, block", [(50, 7), (1 << 16, 64)])
def test_boxplot_of_large_dates(spark, few, block):
    r = random.Random(4)
    skewed = [(i, 6, r.lognormvariate(0, 1)) for i in range(1500)] + [(i, 7, 5.0) for i in range(200)] + [(i, 8, float(max(r.randrange(-9, 30), 0))) for i in range(801)]
    df = panel(spark).unionByName(spark.createDataFrame(skewed, "entity int, dt int, x double")).repartition(6)
    held = {}
    for row in df.where("x is not null").collect():
        held.setdefault(row["dt"], []).append(row["x"])
    got = {m["dt"]: m for m in boxplots.medcouples(df, "x", "dt", few=few, block=block).collect()}
    assert got.keys() == held.keys()
    for k, v in held.items():
        assert got[k]["n"] == len(v) and got[k]["mc"] == pytest.approx(xs.medcouple(np.array(v)), abs=1e-12)
    df = df.where("dt is not null").withColumn("q", F.lit("clash"))
    key = lambda v: sorted((a, b, c is None, c or 0) for a, b, c in v)
    large = boxplots.adjusted_boxplot_large(df, "x", few=few, block=block)
    assert large.columns == df.columns and key(rows2(large, "x")) == key(rows2(xs.adjusted_boxplot(df, "x"), "x"))


def test_boxplot_without_values(spark):
    empty = panel(spark).where("false")
    assert boxplots.adjusted_boxplot_large(empty, "x", few=5).count() == 0
    none = boxplots.adjusted_boxplot_large(panel(spark).where("dt = 3"), "x", few=5).collect()
    assert len(none) == 4 and all(r["x"] is None for r in none)


def rows2(d, c):
    return [(r["dt"], r["entity"], None if r[c] is None else round(r[c], 9)) for r in d.collect()]
