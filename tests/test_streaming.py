"""A panel from a stream equals the panel of the table for all days that are complete."""

import os

from pyspark.sql import functions as F

from panelforge.streaming.append import append, daily_panel

ROOT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stream_equals_table(spark, tmp_path):
    events = spark.read.parquet(f"{ROOT}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 100).cast("long").alias("value"))
    parts = [tmp_path / "in" / f"part{i}" for i in (0, 1)]
    middle = events.agg(F.percentile_approx(F.col("ts").cast("double"), 0.5)).first()[0]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for path, rows in zip(parts, (events.where(F.col("ts").cast("double") < middle), events.where(F.col("ts").cast("double") >= middle)), strict=True):
        rows.coalesce(1).write.parquet(str(path))
        stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in" / "*"))
        append(daily_panel(stream, "user_id", "ts", "value"), out, state).awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(out).collect()}
    rows = spark.read.parquet(out).count()
    last = events.agg(F.max("ts")).first()[0]
    want = {tuple(r) for r in daily_panel(events, "user_id", "ts", "value").collect()}
    assert rows == len(got) and got <= want
    # open are only the days that the watermark hasn't passed
    assert all((last.date() - r[1]).days <= 1 for r in want - got)


def test_streamed_signals_are_those_of_the_whole(spark, tmp_path):
    import datetime as dt

    import numpy as np

    from panelforge.operators.xs import signal
    from panelforge.streaming.append import append_signals

    rng = np.random.default_rng(8)
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(30)]
    whole = spark.createDataFrame([(e, d, float(rng.normal())) for d in days for e in range(5 if d.day % 7 else 2)], "entity int, dt date, x double")
    at = {k: str(tmp_path / k) for k in ("in", "panel", "signals", "state")}
    for i, (a, b) in enumerate(((0, 1), (1, 12), (12, 13), (13, 30))):
        whole.where(F.col("dt").between(days[a], days[b - 1])).coalesce(1).write.parquet(f"{at['in']}/part{i}")
        stream = spark.readStream.schema(whole.schema).parquet(f"{at['in']}/*")
        append_signals(stream, at["panel"], at["signals"], at["state"], "x", 4).awaitTermination(120)
    got = sorted(tuple(r)[:3] for r in spark.read.parquet(at["signals"]).select("entity", "dt", "signal").collect())
    assert got == sorted(tuple(r) for r in signal(whole, "x", 3).select("entity", "dt", "signal").collect()) and len(got) > 100


def test_late_rows_change_the_dates_that_they_touch(spark, tmp_path):
    """Batches in any order, late rows of old dates, a date that reaches the least number of rows late, one batch twice."""
    import datetime as dt
    import random

    from panelforge.operators.xs import signal
    from panelforge.streaming.append import grow_signals

    r = random.Random(4)
    days = [dt.date(2021, 1, 1) + dt.timedelta(days=2 * i) for i in range(12)]
    rows = [(e, d, None if r.random() < 0.1 else r.gauss(0, 1)) for d in days for e in range(7)]
    late = [(9, days[3], 0.3), (8, days[3], 5.0), (8, days[7], -1.0)]
    thin = [x for x in rows if x[1] == days[5]]
    batches = [[x for x in rows if x[1] < days[5]], [x for x in rows if x[1] > days[8]], thin[:2], [x for x in rows if days[5] < x[1] <= days[8]], late, thin[2:], [], [(1, None, 1.0)]]
    panel, signals = str(tmp_path / "panel"), str(tmp_path / "signals")
    frame = lambda b: spark.createDataFrame(b, "entity int, dt date, x double")
    seen = []
    for i, b in enumerate(batches):
        seen += b
        for _ in range(2 if i in (3, 4) else 1):
            wrote = grow_signals(frame(b), i, panel, signals, "x", 4)
        got = sorted((x["entity"], x["dt"], round(x["signal"], 9)) for x in spark.read.parquet(signals).collect())
        want = sorted((x["entity"], x["dt"], round(x["signal"], 9)) for x in signal(frame([x for x in seen if x[1]]), "x", 3).collect())
        assert got == want
        assert len(wrote) <= 2 * len({x[1] for x in b})
    assert len(got) > 60
