"""Aligning and describing tables: names, types, duplicates, derived fields, matrices and reporting states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.functions.core import by_entity, col, ratio


def first_found(spark: SparkSession, roots: Sequence[str], name: str, *fields: str) -> DataFrame:
    """The table of a name under the first of several roots that has it, with some of its fields."""
    for root in roots:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}.parquet")
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            out = spark.read.parquet(f"{root}/{name}.parquet")
            return out.select(*fields) if fields else out
    raise FileNotFoundError(f"{name} is under none of {list(roots)}")


def column_listing(frames: dict[str, DataFrame], categories: DataFrame | None = None) -> DataFrame:
    """(table, field, type, place) of all columns of named frames, with the columns of categories(field, ...) if given."""
    spark = next(iter(frames.values())).sparkSession
    rows = [(n, f.name, f.dataType.simpleString(), i) for n, df in frames.items() for i, f in enumerate(df.schema)]
    out = spark.createDataFrame(rows, "table string, field string, type string, place int")
    return out if categories is None else out.join(F.broadcast(categories), "field", "left")


def adjust_types(df: DataFrame, numeric: Sequence[str], dates: Sequence[str] = ()) -> DataFrame:
    """Texts to numbers and dates; what doesn't fit is null."""
    out = {c: col(c).try_cast("double") for c in numeric}
    return df.withColumns(out | {c: F.to_date(F.try_to_timestamp(F.regexp_replace(col(c).cast("string"), r"\.0$", ""), F.lit("yyyyMMdd"))) for c in dates})


def keep_first(df: DataFrame, keys: Sequence[str], *order: str, last: bool = False) -> DataFrame:
    """One row per keys, the first or last in an order that tells all rows apart."""
    by = [F.desc(c) if last else F.asc(c) for c in order]
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("__n = 1").drop("__n")


def check_unique(df: DataFrame, *keys: str) -> DataFrame:
    """The frame itself; an error if a key repeats or is null."""
    bad = df.groupBy(*keys).count().where(" or ".join(["count > 1", *(f"`{k}` is null" for k in keys)])).limit(1).collect()
    if bad:
        raise ValueError(f"repeated or missing key: {bad[0].asDict()}")
    return df


def derived_fields(df: DataFrame) -> DataFrame:
    """Adds net_asset, net_non_oper, period_cost, receivable, payable and gross_income; sums need one of their terms."""
    from panelforge.operators.clean import partial_sum

    return df.withColumns({
        "net_asset": F.col("tot_assets") - F.col("tot_liab"), "net_non_oper": F.col("non_oper_rev") - F.col("non_oper_exp"),
        "period_cost": partial_sum("oper_cost", "gerl_admin_exp", "fin_exp"), "receivable": partial_sum("notes_rcv", "acct_rcv"),
        "payable": partial_sum("notes_payable", "acct_payable"), "gross_income": F.col("oper_rev") - F.col("oper_cost"),
    })


def name_parts(name: str = "strategy") -> dict[str, Column]:
    """Parts of a strategy's name KIND_short_smoothN_sign: category, short_name, smooth and sign (p: 1, n: -1)."""
    smooth = F.regexp_extract(name, r"_smooth(\d+)_", 1)
    return {
        "category": F.substring_index(name, "_", 1), "short_name": F.regexp_extract(name, r"^[^_]*_(.*)_smooth\d+_", 1),
        "smooth": F.when(smooth != "", smooth).cast("int"), "sign": F.when(col(name).endswith("_p"), 1).when(col(name).endswith("_n"), -1),
    }


def bytes_of(size: str) -> Column:
    """'12K', '3M', '1.5G' or plain digits as bytes; null for anything else."""
    unit = F.upper(F.regexp_extract(size, r"^\s*[0-9.]+\s*([KMGkmg]?)\s*$", 1))
    n = F.regexp_extract(size, r"^\s*([0-9.]+)\s*[KMGkmg]?\s*$", 1).try_cast("double")
    return (n * F.when(unit == "K", 1024).when(unit == "M", 1024**2).when(unit == "G", 1024**3).otherwise(1)).cast("long")


def inner_align(first: DataFrame, *others: DataFrame, keys: Sequence[str] = ("entity", "dt")) -> DataFrame:
    """Panels side by side on the keys that all have."""
    for o in others:
        first = first.join(o, list(keys))
    return first


def outer_align(first: DataFrame, *others: DataFrame, keys: Sequence[str] = ("entity", "dt"), required: Sequence[str] = ()) -> DataFrame:
    """Panels side by side on the keys that any has, without rows that lack a required column."""
    for o in others:
        first = first.join(o, list(keys), "full")
    return first.dropna(subset=list(required)) if required else first


def shared_index(a: DataFrame, b: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """The rows of each whose keys the other has too."""
    keys = keys or ("entity", "dt")
    return a.join(b.select(*keys).distinct(), list(keys), "left_semi"), b.join(a.select(*keys).distinct(), list(keys), "left_semi")


def union_frame(a: DataFrame, b: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """Both on the dates and entities that either has: missing cells are null. Dates are one row per day; the grid is as
    large as the matrices that are asked for."""
    grid = a.select("dt").union(b.select("dt")).distinct().crossJoin(a.select("entity").union(b.select("entity")).distinct())
    return tuple(grid.join(x.select("entity", "dt", value), ["entity", "dt"], "left") for x in (a, b))


def forward_as_of(df: DataFrame, other: DataFrame, value: str) -> DataFrame:
    """Each row's next value of `other` (entity, dt, value) at or after its date: one union and one ordered pass."""
    both = df.withColumn("__o", F.lit(0)).unionByName(other.select("entity", "dt", value).withColumn("__o", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("entity").orderBy("dt", "__o").rowsBetween(0, Window.unboundedFollowing)
    seen = F.first(F.when(F.col("__o") == 1, F.struct(F.col(value).alias("v"))), ignorenulls=True).over(w)
    return both.withColumn("__s", seen).where("__o = 0").withColumn(value, F.col("__s.v")).drop("__o", "__s")


def coverage(df: DataFrame, columns: Sequence[str], *keys: str) -> DataFrame:
    """(keys, column, filled, rows): how many values each column has, in one pass."""
    a = df.groupBy(*keys).agg(F.count("*").alias("rows"), *[F.count(c).alias(c) for c in columns])
    return a.unpivot([*keys, "rows"], list(columns), "column", "filled")


def rolling_two(df: DataFrame, y: str, x1: str, x2: str, n: int) -> DataFrame:
    """Adds alpha, b1, b2: the regression of y on two columns over n rows of an entity, where all n are complete."""
    ok = F.when(col(y).isNotNull() & col(x1).isNotNull() & col(x2).isNotNull(), 1)
    v = {"y": F.when(ok.isNotNull(), col(y)), "a": F.when(ok.isNotNull(), col(x1)), "b": F.when(ok.isNotNull(), col(x2))}
    w = by_entity(n)
    s = {"m" + k: F.avg(c).over(w) for k, c in v.items()}
    s |= {i + j: F.covar_samp(v[i], v[j]).over(w) for i, j in ("aa", "bb", "ab", "ay", "by")}
    df = df.withColumns({f"__{k}": c for k, c in s.items()}).withColumn("__n", F.count(ok).over(w))
    c = lambda k: F.col(f"__{k}")
    det = c("aa") * c("bb") - c("ab") * c("ab")
    full = lambda e: F.when(c("n") >= n, e)
    b1, b2 = ratio(c("bb") * c("ay") - c("ab") * c("by"), det), ratio(c("aa") * c("by") - c("ab") * c("ay"), det)
    return df.withColumns({"b1": full(b1), "b2": full(b2), "alpha": full(c("my") - b1 * c("ma") - b2 * c("mb"))}).drop(*[f"__{k}" for k in (*s, "n")])


def reported_share(reports: DataFrame, listed: DataFrame) -> DataFrame:
    """(period, dt, share): for each report period, how many of the companies listed on a day have reported by then, up to
    the first day of its peak. reports(period, dt) has a row per report, those before the period's end are errors and are
    dropped; listed(dt, listed) has a row per trading day."""
    n = reports.where(F.col("dt") > F.col("period")).groupBy("period", "dt").agg(F.count("*").alias("n"))
    # periods times trading days: small by nature
    grid = n.select("period").distinct().crossJoin(listed).join(n, ["period", "dt"], "left")
    w = Window.partitionBy("period").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    g = grid.withColumn("share", F.sum(F.coalesce("n", F.lit(0))).over(w) / F.nullif("listed", F.lit(0)))
    top = g.withColumn("__top", F.max("share").over(Window.partitionBy("period")))
    at = F.min(F.when(F.col("share") == F.col("__top"), F.col("dt"))).over(Window.partitionBy("period"))
    return top.withColumn("__at", at).where("dt <= __at").select("period", "dt", "share")


def timing_grid(shares: DataFrame, market: DataFrame, starts: Sequence[float], ends: Sequence[float]) -> DataFrame:
    """(start, end, dt, signal, nav, relative): out of the market (-1) while the share of any period lies between start
    and end, in it (1) otherwise; log values of the strategy, and relative to the market. market(dt, ret) is one row per
    day."""
    spark = shares.sparkSession
    grid = spark.createDataFrame([(a, b) for a in starts for b in ends], "start double, end double")
    inside = shares.crossJoin(F.broadcast(grid)).where("share >= start and share <= end").select("start", "end", "dt").distinct().withColumn("__in", F.lit(1))
    m = market.crossJoin(F.broadcast(grid)).join(inside, ["start", "end", "dt"], "left").withColumn("signal", F.when(F.col("__in").isNull(), 1).otherwise(-1))
    w = Window.partitionBy("start", "end").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    nav = F.sum(F.log1p(F.col("signal") * F.col("ret"))).over(w)
    return m.select("start", "end", "dt", "signal", nav.alias("nav"), (nav - F.sum(F.log1p("ret")).over(w)).alias("relative"))
