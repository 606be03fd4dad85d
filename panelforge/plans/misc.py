"""Queries of sources, cleaning, joins, aggregations, events and text."""

from __future__ import annotations

import datetime as dt_

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge.functions.core import ratio
from panelforge.operators import clean as cl
from panelforge.operators.portfolio import weighted_mean
from panelforge.operators.quantiles import distribution_with_total
from panelforge.plans.base_sql import FDMT, IND, PXD, RETD, STMT, WE
from panelforge.sources import tables as t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def r(x, digits: int = 6):
    return F.round(x, digits)


@add("src2_keyed_read", "SELECT l_suppkey, l_shipdate, l_quantity, l_extendedprice FROM lineitem WHERE l_suppkey IN (1, 3, 5) AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate <= TIMESTAMP '1998-12-31'")
def src2(s, d):
    return t.keyed_read(t.table(s, d, "lineitem"), ["l_quantity", "l_extendedprice"], "l_suppkey", "l_shipdate", [1, 3, 5], dt_.datetime(1996, 1, 1), dt_.datetime(1998, 12, 31))


@add("cat2_field_space", "SELECT s_suppkey AS k, s_name, s_acctbal, c_name FROM supplier JOIN customer ON c_custkey = s_suppkey")
def cat2(s, d):
    return t.Catalog({"a": t.table(s, d, "supplier").withColumnRenamed("s_suppkey", "k"), "b": t.table(s, d, "customer").withColumnRenamed("c_custkey", "k")}, ["k"]).fields("s_name", "s_acctbal", "c_name")


@add("cln1_parse_dates", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) AS b FROM orders")
def cln1(s, d):
    o = t.table(s, d, "orders").withColumn("n", F.date_format("o_orderdate", "yyyyMMdd").cast("double")).withColumn("c", F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".0")))
    return o.select("o_orderkey", cl.parse_yyyymmdd("n").alias("a"), cl.parse_yyyymmdd("c", numeric=False).alias("b"))


_VER = STMT + ", ver AS (SELECT entity, dt, trd_dt, revenue, 408001000 AS kind FROM stmt UNION ALL SELECT entity, dt, trd_dt + 30, revenue * 1.5, 408004000 FROM stmt WHERE entity % 3 = 0 UNION ALL SELECT entity, dt, trd_dt - 10, revenue * 2, 408005000 FROM stmt WHERE entity % 5 = 0)"


def _versions(s, d):
    q = t.stmt_q(s, d).select("entity", "dt", "trd_dt", "revenue")
    a = q.withColumn("kind", F.lit(408001000))
    b = q.where("entity % 3 = 0").select("entity", "dt", F.date_add("trd_dt", 30).alias("trd_dt"), (F.col("revenue") * 1.5).alias("revenue"), F.lit(408004000).alias("kind"))
    c = q.where("entity % 5 = 0").select("entity", "dt", F.date_sub("trd_dt", 10).alias("trd_dt"), (F.col("revenue") * 2).alias("revenue"), F.lit(408005000).alias("kind"))
    return a.unionByName(b).unionByName(c)


def _one(order: str, part: str = "entity, dt", table: str = "ver") -> str:
    return f"SELECT entity, dt, trd_dt, revenue, kind FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {order}) AS n FROM {table}) WHERE n = 1"


add("cln3_latest", f"WITH {_VER} {_one('trd_dt DESC')}")(lambda s, d: cl.latest(_versions(s, d), ["entity", "dt"], "trd_dt"))
add("cln4_earliest", f"WITH {_VER}, z AS (SELECT * FROM ver WHERE kind IN (408001000, 408004000)) {_one('trd_dt', table='z')}")(lambda s, d: cl.earliest(_versions(s, d).where(F.col("kind").isin(408001000, 408004000)), ["entity", "dt"], "trd_dt"))
add("cln5_two_level", f"WITH {_VER}, z AS ({_one('trd_dt', 'entity, dt, kind')}) {_one('kind DESC', table='z')}")(lambda s, d: cl.two_level(_versions(s, d), ["entity", "dt"], "kind", "trd_dt"))
add("cln6_latest_period", f"WITH {_VER}, z AS (SELECT entity, dt, make_date(year(trd_dt), 6, 30) AS trd_dt, revenue, kind FROM ver WHERE kind = 408001000) {_one('dt DESC', 'entity, trd_dt', 'z')}")(
    lambda s, d: cl.latest(_versions(s, d).where("kind = 408001000").withColumn("trd_dt", F.make_date(F.year("trd_dt"), F.lit(6), F.lit(30))), ["entity", "trd_dt"], "dt")
)


@add("cln10_single_quarters", f"WITH {STMT}, n AS (SELECT *, count(*) OVER (PARTITION BY entity, year(dt)) AS n FROM stmt) SELECT entity, dt, round(CASE WHEN n = 4 THEN assets - coalesce(lag(assets) OVER (PARTITION BY entity, year(dt) ORDER BY dt), 0) END, 4) + 0.0 AS v FROM n")
def cln10(s, d):
    return cl.single_quarters(t.stmt_q(s, d), "assets", "v").select("entity", "dt", r("v", 4).alias("v"))


@add("cln11_listing_grid", f"WITH {PXD}, li AS (SELECT entity, min(dt) + 30 AS listdate FROM px_d GROUP BY 1), cal AS (SELECT DISTINCT dt FROM px_d) SELECT entity, dt, dt <= listdate + 365 AS young FROM li JOIN cal ON dt >= listdate")
def cln11(s, d):
    p = t.px_d(s, d)
    return cl.listing_grid(p.select("dt").distinct(), p.groupBy("entity").agg(F.date_add(F.min("dt"), 30).alias("listdate")))


@add("cln13_edge_flags", f"WITH {PXD} SELECT entity, dt, row_number() OVER {WE} <= 10 AS first_days, row_number() OVER (PARTITION BY entity ORDER BY dt DESC) <= 10 AS last_days FROM px_d")
def cln13(s, d):
    return cl.edge_flags(t.px_d(s, d), 10).select("entity", "dt", "first_days", "last_days")


@add("flt3_minimum_cross_section", f"WITH {PXD} SELECT entity, dt, close FROM (SELECT *, count(*) OVER (PARTITION BY dt) AS n FROM px_d) WHERE n > 20")
def flt3(s, d):
    return t.px_d(s, d).withColumn("n", F.count("*").over(Window.partitionBy("dt"))).where("n > 20").select("entity", "dt", "close")


@add("flt4_minimum_history", f"WITH {PXD} SELECT entity, dt, close FROM px_d WHERE entity IN (SELECT entity FROM px_d GROUP BY 1 HAVING count(close) > 530)")
def flt4(s, d):
    p = t.px_d(s, d)
    return p.join(p.groupBy("entity").agg(F.count("close").alias("n")).where("n > 530"), "entity", "left_semi").select("entity", "dt", "close")


@add("flt7_limit_flags", f"WITH {PXD} SELECT entity, dt, coalesce(close > lag(close) OVER {WE} * 1.095, false) AS up, coalesce(close < lag(close) OVER {WE} * 0.905, false) AS down FROM px_d")
def flt7(s, d):
    up, down = cl.limit_flags("close")
    return t.px_d(s, d).select("entity", "dt", up.alias("up"), down.alias("down"))


@add("prj1_partial_sum", f"WITH {STMT}, n AS (SELECT entity, dt, CASE WHEN entity % 2 = 0 THEN cost END AS a, CASE WHEN entity % 3 = 0 THEN tax END AS b FROM stmt) SELECT entity, dt, round(CASE WHEN coalesce(a, b) IS NOT NULL THEN coalesce(a, 0) + coalesce(b, 0) END, 4) AS v FROM n")
def prj1(s, d):
    q = t.stmt_q(s, d).select("entity", "dt", F.when(F.col("entity") % 2 == 0, F.col("cost")).alias("a"), F.when(F.col("entity") % 3 == 0, F.col("tax")).alias("b"))
    return q.select("entity", "dt", r(cl.partial_sum("a", "b"), 4).alias("v"))


@add("jn3_mix", f"WITH {STMT} SELECT a.entity, a.dt, a.revenue, b.cost, greatest(a.trd_dt, b.trd_dt + 20) AS trd_dt FROM stmt a JOIN stmt b ON b.entity = a.entity AND b.dt = a.dt")
def jn3(s, d):
    q = t.stmt_q(s, d)
    return cl.mix(q.select("entity", "dt", "revenue", "trd_dt"), q.select("entity", "dt", "cost", F.date_add("trd_dt", 20).alias("trd_dt")), ["entity", "dt"])


_REC = f"WITH {STMT}, a AS (SELECT entity, dt, units AS v FROM stmt WHERE entity % 2 = 0 OR units > 200), b AS (SELECT entity, dt, CASE WHEN entity % 3 = 0 THEN units + 1 ELSE units END AS v FROM stmt WHERE entity % 5 <> 0), j AS (SELECT coalesce(a.entity, b.entity) AS entity, coalesce(a.dt, b.dt) AS dt, a.v AS left_value, b.v AS right_value, CASE WHEN b.entity IS NULL THEN 'left' WHEN a.entity IS NULL THEN 'right' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'same' ELSE 'differs' END AS provenance FROM a FULL JOIN b ON a.entity = b.entity AND a.dt = b.dt) "


def _two(s, d):
    q = t.stmt_q(s, d)
    return q.where("entity % 2 = 0 or units > 200").select("entity", "dt", F.col("units").alias("v")), q.where("entity % 5 <> 0").select("entity", "dt", F.when(F.col("entity") % 3 == 0, F.col("units") + 1).otherwise(F.col("units")).alias("v"))


add("jn5_reconcile", _REC + "SELECT * FROM j")(lambda s, d: cl.reconcile(*_two(s, d), ["entity", "dt"], "v"))
add("inc1_snapshot_diff", _REC + "SELECT * FROM j WHERE provenance <> 'same'")(lambda s, d: cl.snapshot_diff(*_two(s, d), ["entity", "dt"], "v"))


@add("jn6_as_of", f"WITH {PXD}, {STMT}, k AS (SELECT entity, trd_dt AS dt, max_by(revenue, dt) AS revenue FROM stmt GROUP BY 1, 2) SELECT p.entity, p.dt, close, CASE WHEN p.dt - k.dt <= 60 THEN revenue END AS revenue FROM px_d p ASOF LEFT JOIN k ON k.entity = p.entity AND k.dt <= p.dt")
def jn6(s, d):
    known = t.stmt_q(s, d).groupBy("entity", F.col("trd_dt").alias("dt")).agg(F.max_by("revenue", "dt").alias("revenue"))
    return cl.as_of(t.px_d(s, d).select("entity", "dt", "close"), known, "revenue", 60)


@add("jn10_anti_exclusion", f"WITH {PXD} SELECT entity, dt, close FROM px_d WHERE (entity, dt) NOT IN (SELECT entity, dt FROM px_d WHERE volume < 20)")
def jn10(s, d):
    p = t.px_d(s, d)
    return p.join(p.where("volume < 20").select("entity", "dt"), ["entity", "dt"], "left_anti").select("entity", "dt", "close")


@add("jn12_trailing_months", f"WITH {RETD}, e AS (SELECT entity, ret, last_day(CAST(date_trunc('month', dt) + to_months(CAST(k AS INTEGER)) AS DATE)) AS month_end FROM ret_d CROSS JOIN (SELECT unnest(range(3)) AS k)) SELECT entity, month_end, count(ret) AS n, round(stddev_samp(ret), 6) AS vol FROM e GROUP BY 1, 2")
def jn12(s, d):
    return cl.trailing_months(t.ret_d(s, d), 3).groupBy("entity", "month_end").agg(F.count("ret").alias("n"), r(F.stddev_samp("ret")).alias("vol"))


@add("agg1_weighted_mean", f"WITH {FDMT} SELECT dt, industry, round(sum(ret_m * cap) FILTER (WHERE ret_m IS NOT NULL) / nullif(sum(cap) FILTER (WHERE ret_m IS NOT NULL), 0), 6) + 0.0 AS value FROM fdmt GROUP BY 1, 2")
def agg1(s, d):
    return t.fdmt_m(s, d).groupBy("dt", "industry").agg(r(weighted_mean("ret_m", "cap")).alias("value"))


@add("agg3_pivot", "SELECT user_id, max(value) FILTER (WHERE event_type = 'click') AS click, max(value) FILTER (WHERE event_type = 'purchase') AS purchase, max(value) FILTER (WHERE event_type = 'view') AS view_ FROM events GROUP BY 1")
def agg3(s, d):
    return t.table(s, d, "events").groupBy("user_id").pivot("event_type", ["click", "purchase", "view"]).agg(F.max("value")).withColumnRenamed("view", "view_")


@add("agg4_quantile_vector", f"WITH {FDMT}, q AS (SELECT dt, quantile_cont(ret_m, [0.05, 0.25, 0.5, 0.75, 0.95]) AS q FROM fdmt GROUP BY 1) SELECT dt, " + ", ".join(f"round(q[{i + 1}], 6) + 0.0 AS q{i}" for i in range(5)) + " FROM q")
def agg4(s, d):
    q = t.fdmt_m(s, d).groupBy("dt").agg(F.percentile("ret_m", F.array(*map(F.lit, (0.05, 0.25, 0.5, 0.75, 0.95)))).alias("q"))
    return q.select("dt", *[r(F.col("q")[i]).alias(f"q{i}") for i in range(5)])


@add("agg7_distribution_with_total", f"WITH {RETD}, {IND} SELECT coalesce(CAST(sector AS VARCHAR), 'all') AS sector, count(ret) AS n, round(avg(ret), 6) + 0.0 AS mean, round(median(ret), 6) + 0.0 AS median, round(stddev_samp(ret), 6) AS std, round(min(ret), 6) + 0.0 AS lo, round(max(ret), 6) + 0.0 AS hi, count(*) FILTER (WHERE abs(ret) > 0.5) AS large FROM ret_d JOIN ind ON ind.entity = ret_d.entity GROUP BY ROLLUP (sector)")
def agg7(s, d):
    a = distribution_with_total(t.ret_d(s, d).join(t.industries(s, d), "entity"), "ret", "sector", 0.5)
    return a.select(F.coalesce(F.col("sector").cast("string"), F.lit("all")).alias("sector"), "n", *[r(c).alias(c) for c in ("mean", "median", "std", "lo", "hi")], "large")


@add("agg10_top_per_group", f"WITH {FDMT} SELECT dt, industry, entity, cap FROM (SELECT *, row_number() OVER (PARTITION BY dt, industry ORDER BY cap DESC, entity) AS n FROM fdmt) WHERE n <= 2")
def agg10(s, d):
    w = Window.partitionBy("dt", "industry").orderBy(F.desc("cap"), "entity")
    return t.fdmt_m(s, d).withColumn("n", F.row_number().over(w)).where("n <= 2").select("dt", "industry", "entity", "cap")


@add("evt3_event_time_average", f"""WITH {RETD}, mk AS (SELECT dt, avg(ret) AS mkt FROM ret_d GROUP BY 1), dk AS (SELECT dt, row_number() OVER (ORDER BY dt) AS k FROM (SELECT DISTINCT dt FROM ret_d)),
ev AS (SELECT entity, r.dt, k FROM ret_d r JOIN dk ON dk.dt = r.dt WHERE volume > 90), o AS (SELECT ev.entity, k + o AS k, o AS offset_ FROM ev CROSS JOIN (SELECT unnest(range(-5, 6)) AS o)),
j AS (SELECT offset_, ret - mkt AS ar FROM o JOIN dk ON dk.k = o.k JOIN ret_d r ON r.entity = o.entity AND r.dt = dk.dt JOIN mk ON mk.dt = r.dt)
SELECT CAST(offset_ AS INTEGER) AS offset_, count(ar) AS n, round(avg(ar), 6) + 0.0 AS abnormal FROM j GROUP BY 1""")
def evt3(s, d):
    p = t.ret_d(s, d)
    p = p.join(F.broadcast(p.groupBy("dt").agg(F.avg("ret").alias("mkt"))), "dt").select("entity", "dt", "ret", "mkt", "volume")
    w = cl.event_windows(p.where("volume > 90").select("entity", "dt"), p.drop("volume"), 5, 5)
    return w.groupBy(F.col("offset").alias("offset_")).agg(F.count(F.col("ret") - F.col("mkt")).alias("n"), r(F.avg(F.col("ret") - F.col("mkt"))).alias("abnormal"))


@add("txt1_marks", r"SELECT doc_id, unnest(regexp_extract_all(text, '(\w+) = \"', 1)) AS mark FROM documents")
def txt1(s, d):
    return t.table(s, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r'([A-Za-z0-9_]+) = "'), 1)).alias("mark"))


@add("txt2_links", r"""SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages""")
def txt2(s, d):
    return t.table(s, d, "pages").select("page_id", F.explode(cl.links()).alias("link"))


@add("mkt1_market_state", f"WITH {RETD}, a AS (SELECT dt, count(*) AS listed, count(*) FILTER (WHERE ret > 0.095) AS up, count(*) FILTER (WHERE ret < -0.095) AS down, CAST(sum(CAST(round(amount * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS amount FROM ret_d GROUP BY 1) SELECT dt, listed, up, down, round(amount / nullif(lag(amount) OVER (ORDER BY dt), 0), 6) AS amount_scaled FROM a")
def mkt1(s, d):
    a = t.ret_d(s, d).groupBy("dt").agg(F.count("*").alias("listed"), F.count_if(F.col("ret") > 0.095).alias("up"), F.count_if(F.col("ret") < -0.095).alias("down"), (F.sum(F.round(F.col("amount") * 100).cast("long")).cast("double") / 100.0).alias("amount"))
    # one row per date: small by nature
    return a.select("dt", "listed", "up", "down", r(ratio("amount", F.lag("amount").over(Window.orderBy("dt")))).alias("amount_scaled"))


@add("mod1_combinations", "SELECT a.n_name AS a, b.n_name AS b, c.n_name AS c FROM nation a JOIN nation b ON a.n_name < b.n_name JOIN nation c ON b.n_name < c.n_name")
def mod1(s, d):
    n = t.table(s, d, "nation").select("n_name")
    a, b, c = (n.withColumnRenamed("n_name", k) for k in "abc")
    return a.join(b, F.col("a") < F.col("b")).join(c, F.col("b") < F.col("c"))


@add("cmb2_direction", f"WITH {FDMT} SELECT entity, CAST(sign(round(sum(ret_m), 6)) AS INTEGER) AS direction FROM fdmt GROUP BY 1")
def cmb2(s, d):
    return t.fdmt_m(s, d).groupBy("entity").agg(F.signum(r(F.sum("ret_m"))).cast("int").alias("direction"))


@add("cmb8_best_variant", f"WITH {FDMT}, g AS (SELECT sector, industry, avg(ret_m) / nullif(stddev_samp(ret_m), 0) AS s FROM fdmt GROUP BY 1, 2) SELECT sector, industry, round(s, 6) + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY s DESC, industry) AS n FROM g) WHERE n = 1")
def cmb8(s, d):
    g = t.fdmt_m(s, d).groupBy("sector", "industry").agg(ratio(F.avg("ret_m"), F.stddev_samp("ret_m")).alias("s"))
    return cl.keep_one(g, ["sector"], F.desc("s"), F.asc("industry")).select("sector", "industry", r("s").alias("score"))
