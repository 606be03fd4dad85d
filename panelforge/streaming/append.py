"""A daily panel that grows from a stream of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from panelforge.operators.universe import standardize


def daily_panel(rows: DataFrame, entity: str, ts: str, value: str, late: str = "1 day") -> DataFrame:
    """(entity, dt, n, total, low, high) per day, from a stream or a table; on a stream a day is emitted once, when no row
    of it can be due any more, and rows that come later than `late` are left out."""
    x = rows.where(F.col(ts).isNotNull()).withWatermark(ts, late)
    a = x.groupBy(F.window(ts, "1 day").alias("w"), F.col(entity).alias("entity")).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"))
    return a.select("entity", F.to_date("w.start").alias("dt"), "n", "total", "low", "high")


def append(panel: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what the stream has so far to a table, each day once even if the job is started again."""
    return panel.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def _paths(spark, root: str, dates: list) -> list[str]:
    """The folders of some dates that are there; no other folder of the table is listed."""
    out = []
    for d in dates:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/dt={d.isoformat()}")
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            out.append(f"{root}/dt={d.isoformat()}")
    return out


def _of_dates(spark, root: str, schema: str, dates: list) -> DataFrame:
    paths = _paths(spark, root, dates)
    return spark.read.schema(schema).option("basePath", root).parquet(*paths) if paths else spark.createDataFrame([], schema)


def grow_signals(batch: DataFrame, number: int, panel: str, signals: str, x: str, least_rows: int) -> list:
    """Add a batch of rows (entity, dt, x) to a panel and bring a table of signals up to date with it, by the dates that
    the batch touches: late rows of old dates as well as new ones. Returns the dates whose signals were written.

    Both tables have a folder per date. A date's signal comes from the last date before it that has at least
    `least_rows` values, so what changes are the signals of the touched dates and of those that follow them; only they
    and the dates that they come from are read, and they are swapped in as whole folders. How many values each date has
    is a small table of its own (one row per date), a version per batch. A batch that runs again writes the same folders.
    """
    spark = batch.sparkSession
    rows = batch.select("entity", F.col("dt").cast("date").alias("dt"), F.col(x).cast("double").alias(x)).where("dt is not null")
    into = lambda df, path, *by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    into(rows.withColumn("batch", F.lit(number)), panel, "dt", "batch")
    kind = rows.schema["entity"].dataType.simpleString()
    panel_schema = f"entity {kind}, `{x}` double, dt date, batch int"
    # dates of a batch and of the table: small by nature
    touched = sorted(r["dt"] for r in rows.select("dt").distinct().collect())
    counts = f"{panel}-counts"
    before = [i for i in range(number - 1, -1, -1) if _exists(spark, f"{counts}/batch={i}")][:1]
    known = {r["dt"]: r["n"] for i in before for r in spark.read.parquet(f"{counts}/batch={i}").collect()}
    held = _of_dates(spark, panel, panel_schema, touched).where(F.col("batch") <= number)
    known |= {r["dt"]: r["n"] for r in held.groupBy("dt").agg(F.count(x).alias("n")).collect()}
    spark.createDataFrame(sorted(known.items()), "dt date, n long").coalesce(1).write.mode("overwrite").parquet(f"{counts}/batch={number}")
    # dates that give a signal, in order; the signal of one is dated by the next
    able = [d for d in sorted(known) if known[d] >= least_rows]
    place = {d: i for i, d in enumerate(able)}
    changed = {place[d] for d in touched if d in place}
    sources = sorted(changed | {i - 1 for i in changed if i})
    goes = [(able[i], able[i + 1]) for i in sources if i + 1 < len(able)]
    if goes:
        seen = _of_dates(spark, panel, panel_schema, [a for a, _ in goes]).where(F.col("batch") <= number).select("entity", "dt", x)
        scored = standardize(seen.where(F.col(x).isNotNull()), x)
        out = scored.join(spark.createDataFrame(goes, "dt date, next_dt date"), "dt").select("entity", F.col(x).alias("signal"), F.col("next_dt").alias("dt"))
        into(out, signals, "dt")
    return [b for _, b in goes]


def _exists(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def append_signals(rows: DataFrame, panel: str, signals: str, checkpoint: str, x: str, least_rows: int) -> StreamingQuery:
    """Grow a table of signals from a stream of rows (entity, dt, x) by grow_signals, a batch at a time: in any order of
    dates the table is that of all rows at once."""
    grow = lambda batch, number: grow_signals(batch.persist(), number, panel, signals, x, least_rows) and None
    return rows.writeStream.foreachBatch(grow).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
