"""Point-in-time cleaning, flags, joins, events and text extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.core import by_entity, col
from panelforge.operators.resample import next_trading_day
from panelforge.sources.tables import stored


def parse_yyyymmdd(x: Column | str, numeric: bool = True) -> Column:
    """20180131, 20180131.0 or their text to a date; a double cast straight to text would print an exponent."""
    text = col(x).cast("bigint").cast("string") if numeric else F.substring_index(col(x), ".", 1)
    return F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date")


def keep_one(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row per keys in a full order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def latest(df: DataFrame, keys: list[str], known: str, *ties: str) -> DataFrame:
    """The latest restatement of each key."""
    return keep_one(df, keys, F.desc(known), *[F.desc(t) for t in ties])


def earliest(df: DataFrame, keys: list[str], known: str, *ties: str) -> DataFrame:
    """What was known first: no look-ahead."""
    return keep_one(df, keys, F.asc(known), *[F.asc(t) for t in ties])


def two_level(df: DataFrame, keys: list[str], kind: str, known: str) -> DataFrame:
    """The earliest row of each kind, then the highest kind of each key."""
    return keep_one(earliest(df, [*keys, kind], known), keys, F.desc(kind))


def single_quarters(df: DataFrame, x: str, out: str) -> DataFrame:
    """Quarter values from values that accumulate within a year, for years of four rows."""
    w = Window.partitionBy("entity", F.year("dt"))
    df = df.withColumn("__n", F.count("*").over(w))
    return df.withColumn(out, F.when(F.col("__n") == 4, col(x) - F.coalesce(F.lag(x).over(w.orderBy("dt")), F.lit(0.0)))).drop("__n")


def laid_out(spans: DataFrame, calendar: DataFrame) -> DataFrame:
    """The columns of spans(first, last, ...) on each trading day dt from first to last; a null last is the calendar's end.

    Both ends are moved to ranks of trading days by equal dates, and the ranks between them are written out: nothing is
    joined by a range, and the rows made are those of the result. The calendar is one row per day."""
    days = calendar.select("dt", F.row_number().over(Window.orderBy("dt")).alias("k"))
    days = stored(days.withColumn("size", F.max("k").over(Window.partitionBy())), "calendar")  # read four times
    # ranks of all days of the calendar's years; a day before them has the first rank, one after them is past the end
    at = next_trading_day(days, back=40_000).join(days, F.col("trading") == F.col("dt"))
    start = spans.join(at.select(F.col("day").alias("first"), "k", "size"), "first")
    ends = at.select(F.col("day").alias("last"), F.when(F.col("day") == F.col("trading"), F.col("k")).otherwise(F.col("k") - 1).alias("__end"))
    out = start.join(ends, "last", "left").withColumn("__end", F.coalesce("__end", "size")).where("k <= __end")
    out = out.withColumn("k", F.explode(F.sequence("k", "__end"))).drop("size", "__end")
    return out.join(days.select("k", "dt"), "k").drop("k")


def listing_grid(calendar: DataFrame, listed: DataFrame) -> DataFrame:
    """Every trading day of every entity from its listing on; `listed` is one row per entity and may be long, the
    calendar is one row per day."""
    spans = listed.select("entity", F.col("listdate").alias("first"), F.lit(None).cast("date").alias("last"))
    return laid_out(spans, calendar).select("entity", "dt", (F.col("dt") <= F.date_add("first", 365)).alias("young"))


def edge_flags(df: DataFrame, n: int) -> DataFrame:
    """Adds first_days and last_days: within the first or last n rows of the entity."""
    up, down = by_entity(), Window.partitionBy("entity").orderBy(F.desc("dt"))
    return df.withColumns({"first_days": F.row_number().over(up) <= n, "last_days": F.row_number().over(down) <= n})


def limit_flags(price: str, up: float = 1.095, down: float = 0.905) -> tuple[Column, Column]:
    before = F.lag(price).over(by_entity())
    return F.coalesce(col(price) > before * up, F.lit(False)), F.coalesce(col(price) < before * down, F.lit(False))


def partial_sum(*fields: str) -> Column:
    """Sum of the fields that are there; null if none is."""
    return F.when(F.coalesce(*fields).isNotNull(), sum((F.coalesce(col(f), F.lit(0.0)) for f in fields[1:]), F.coalesce(col(fields[0]), F.lit(0.0))))


def mix(a: DataFrame, b: DataFrame, keys: list[str], known: str = "trd_dt") -> DataFrame:
    """Inner join of two panels, known when the later of them is."""
    j = a.withColumnRenamed(known, "__a").join(b.withColumnRenamed(known, "__b"), keys)
    return j.withColumn(known, F.greatest("__a", "__b")).drop("__a", "__b")


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full join with provenance: left, right, same or differs."""
    j = a.select(*keys, col(value).alias("left_value"), F.lit(1).alias("__l")).join(b.select(*keys, col(value).alias("right_value"), F.lit(1).alias("__r")), keys, "full")
    state = F.when(F.col("__r").isNull(), "left").when(F.col("__l").isNull(), "right").when(F.col("left_value").eqNullSafe(F.col("right_value")), "same").otherwise("differs")
    return j.withColumn("provenance", state).drop("__l", "__r")


def as_of(df: DataFrame, other: DataFrame, value: str, days: int | None = None) -> DataFrame:
    """Each row's last known value of `other` (entity, dt, value) at or before its date, at most `days` old: one union
    and one ordered pass per entity, no range join."""
    both = df.withColumn("__o", F.lit(1)).unionByName(other.select("entity", "dt", value).withColumn("__o", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy("entity").orderBy("dt", "__o").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("__o") == 0, F.struct(F.col("dt").alias("d"), F.col(value).alias("v"))), ignorenulls=True).over(w)
    both = both.withColumn("__s", seen).where("__o = 1")
    fresh = F.col("__s.v") if days is None else F.when(F.datediff("dt", "__s.d") <= days, F.col("__s.v"))
    return both.withColumn(value, fresh).drop("__o", "__s")


def trailing_months(df: DataFrame, months: int) -> DataFrame:
    """Rows repeated for each month end in whose trailing `months` calendar months they fall (an equi-join key, where
    a range join would compare all)."""
    return df.withColumn("month_end", F.explode(F.transform(F.sequence(F.lit(0), F.lit(months - 1)), lambda k: F.last_day(F.add_months("dt", k)))))


def event_windows(events: DataFrame, prices: DataFrame, before: int, after: int) -> DataFrame:
    """(event columns, offset, price columns) for trading days -before..after around each event (entity, dt)."""
    # one row per trading day: small by nature
    days = prices.select("dt").distinct().withColumn("k", F.row_number().over(Window.orderBy("dt")))
    e = events.join(F.broadcast(days), "dt").withColumn("offset", F.explode(F.sequence(F.lit(-before), F.lit(after)))).withColumn("k", F.col("k") + F.col("offset")).withColumnRenamed("dt", "event_dt")
    return e.join(prices.join(F.broadcast(days), "dt"), ["entity", "k"]).drop("k")


def links(html: str = "html") -> Column:
    """Distinct link targets of a page as an array."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), 1))


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose value differs between two snapshots."""
    return reconcile(old, new, keys, value).where("provenance <> 'same'")


def dated_marks(df: DataFrame, names: DataFrame, pair: str, date: str, text: str = "text", order: str = "doc_id") -> DataFrame:
    """(date, code, name, mark, order column): the name and mark pairs of texts with the first date in each, names mapped
    to codes by names(name, code), the last row of each (date, code) in an order that tells texts apart. pair is an
    expression with two groups, date one with one; names without a code are left out."""
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pair), 1).alias("name"), F.regexp_extract_all(text, F.lit(pair), 2).alias("mark"))
    x = df.select(order, F.regexp_extract(text, date, 1).alias("date"), F.posexplode(both).alias("__k", "p")).select(order, "date", "__k", "p.*")
    x = x.join(names, "name")
    return keep_one(x, ["date", "code"], F.desc(order), F.desc("__k")).select("date", "code", "name", "mark", order)
