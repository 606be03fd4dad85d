"""Queries of the time-series, cross-sectional and resampling operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.core import by_entity, ffill
from panelforge.operators import boxplots, resample, ts, xs
from panelforge.plans.base_sql import FDMT, PXD, PXM, RETD, STMT, WE, bucket, guard, mad, we
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


def simple(name: str, make, expr: str, digits: int = 6, base: str = RETD, table: str = "ret_d"):
    """entity, dt, value of one column expression over the daily panel."""
    sql, out = (f"round({expr}, {digits}) + 0.0", lambda: r(make(), digits)) if digits else (expr, make)
    add(name, f"WITH {base} SELECT entity, dt, {sql} AS value FROM {table}")(lambda s, d: t.ret_d(s, d).select("entity", "dt", out().alias("value")))


simple("ts1_delay", lambda: ts.delay("close", 5), f"lag(close, 5) OVER {WE}", 0)
simple("ts2_delta", lambda: ts.delta("close", 5), f"close - lag(close, 5) OVER {WE}", 0)
_both = "count(CASE WHEN ret IS NOT NULL AND volume IS NOT NULL THEN 1 END)"
_ok = "ret IS NOT NULL AND volume IS NOT NULL"
simple(
    "ts3_correlation", lambda: ts.correlation("ret", "volume", 10),
    f"CASE WHEN {_both} OVER {we(10)} >= 10 THEN covar_samp(ret, volume) OVER {we(10)} / nullif(stddev_samp(ret) OVER {we(10)} * stddev_samp(volume) OVER {we(10)}, 0) END",
)
simple("ts4_covariance", lambda: ts.covariance("ret", "volume", 10), f"CASE WHEN {_both} OVER {we(10)} >= 10 THEN covar_samp(ret, volume) OVER {we(10)} END")
simple("ts6_min", lambda: ts.ts_min("close", 20), guard("min(close)", "close", 20), 0)
simple("ts6_max", lambda: ts.ts_max("close", 20), guard("max(close)", "close", 20), 0)
simple("ts9_sum", lambda: ts.ts_sum("volume", 20), guard("sum(volume)", "volume", 20), 0)
simple("ts9_mean", lambda: ts.ts_mean("ret", 20), guard("avg(ret)", "ret", 20))
simple("ts9_std", lambda: ts.ts_std("ret", 20), guard("stddev_samp(ret)", "ret", 20))


@add("ts10_product", f"WITH {RETD}, g AS (SELECT entity, dt, 1 + ret AS g FROM ret_d) SELECT entity, dt, round({guard('product(g)', 'g', 5)}, 5) + 0.0 AS value FROM g")
def ts10(s, d):
    return t.ret_d(s, d).withColumn("g", 1 + F.col("ret")).select("entity", "dt", r(ts.product("g", 5), 5).alias("value"))


_terms = " + ".join([f"{10 - k} * lag(f, {k}) OVER {WE}" for k in range(1, 10)])


@add("ts5_decay_linear", f"WITH {RETD}, f AS (SELECT *, last_value(ret IGNORE NULLS) OVER {we(4)} AS f FROM ret_d) SELECT entity, dt, round(CASE WHEN ret IS NOT NULL THEN (10 * f + {_terms}) / 55.0 END, 6) + 0.0 AS value FROM f")
def ts5(s, d):
    return ts.decay_linear(t.ret_d(s, d), "ret", 10).select("entity", "dt", r("decay").alias("value"))


def _arg(kind: str) -> str:
    op = ">" if kind == "max" else "<"
    return f"""WITH {PXD}, n AS (SELECT *, row_number() OVER {WE} AS n FROM px_d),
p AS (SELECT a.entity, a.dt, a.n, b.n AS bn, b.close AS c FROM n a JOIN n b ON b.entity = a.entity AND b.n BETWEEN a.n - 9 AND a.n),
q AS (SELECT entity, dt, n, {kind}(c) AS best, count(*) AS k FROM p GROUP BY ALL)
SELECT q.entity, q.dt, CAST(CASE WHEN k >= 10 THEN q.n - min(p.bn) + 1 END AS INTEGER) AS value FROM q JOIN p ON p.entity = q.entity AND p.dt = q.dt AND p.c = q.best GROUP BY q.entity, q.dt, q.n, k
"""


@add("ts7_argmax", _arg("max"))
def ts7a(s, d):
    return ts.ts_argmax(t.px_d(s, d), "close", 10).select("entity", "dt", F.col("argmax").cast("int").alias("value"))


@add("ts7_argmin", _arg("min"))
def ts7b(s, d):
    return ts.ts_argmin(t.px_d(s, d), "close", 10).select("entity", "dt", F.col("argmin").cast("int").alias("value"))


@add("ts8_rank", f"""WITH {PXD}, n AS (SELECT *, row_number() OVER {WE} AS n FROM px_d)
SELECT a.entity, a.dt, round(CASE WHEN count(*) >= 10 THEN (count(*) FILTER (WHERE b.close < a.close) + (count(*) FILTER (WHERE b.close = a.close) + 1) / 2.0) / 10.0 END, 6) + 0.0 AS value
FROM n a JOIN n b ON b.entity = a.entity AND b.n BETWEEN a.n - 9 AND a.n GROUP BY a.entity, a.dt, a.close""")
def ts8(s, d):
    return ts.ts_rank(t.px_d(s, d).select("entity", "dt", "close"), "close", 10).select("entity", "dt", r("rank").alias("value"))


_sm = [10, 20, 40, 80]


@add("ts11_smooth", f"WITH {RETD} SELECT entity, dt, round(ret, 6) + 0.0 AS smooth_0, " + ", ".join(f"round({guard('avg(ret)', 'ret', n, n // 2)}, 6) + 0.0 AS smooth_{n}" for n in _sm) + " FROM ret_d")
def ts11(s, d):
    return t.ret_d(s, d).select("entity", "dt", *[r(ts.smooth("ret", n)).alias(f"smooth_{n}") for n in [0, *_sm]])


@add("ts12_nav_drawdown", f"""WITH {PXM}, n AS (SELECT entity, month_end AS dt, product(1 + coalesce(ret_m / 10, 0)) OVER (PARTITION BY entity ORDER BY month_end) AS nav FROM px_m)
SELECT entity, dt, round(nav, 5) + 0.0 AS nav, round(nav / nullif(max(nav) OVER {WE}, 0) - 1, 6) + 0.0 AS drawdown FROM n""")
def ts12(s, d):
    m = t.px_m(s, d).select("entity", F.col("month_end").alias("dt"), (F.col("ret_m") / 10).alias("ret"))
    return ts.drawdown(m.withColumn("nav", ts.nav("ret", "entity")), "nav", "entity").select("entity", "dt", r("nav", 5).alias("nav"), r("drawdown").alias("drawdown"))


@add("ts13_until_peak", f"WITH {PXD}, m AS (SELECT entity, max(close) AS top FROM px_d GROUP BY 1), p AS (SELECT p.entity, min(dt) AS pk FROM px_d p JOIN m ON m.entity = p.entity AND close = top GROUP BY 1) SELECT x.entity, dt, close FROM px_d x JOIN p ON p.entity = x.entity WHERE dt <= pk")
def ts13(s, d):
    return ts.until_peak(t.px_d(s, d), "close", "entity").select("entity", "dt", "close")


@add("reg3_ind13_rolling_beta", f"""WITH {RETD}, mk AS (SELECT dt, round(avg(ret), 8) + 0.0 AS mkt FROM ret_d WHERE ret IS NOT NULL GROUP BY 1),
g AS (SELECT e.entity, mk.dt, mkt, ret FROM (SELECT DISTINCT entity FROM ret_d) e CROSS JOIN mk LEFT JOIN ret_d r ON r.entity = e.entity AND r.dt = mk.dt),
s AS (SELECT entity, dt, count(ret) OVER {we(60)} AS nv, sum(ret) OVER {we(60)} AS sy, sum(CASE WHEN ret IS NOT NULL THEN mkt * ret END) OVER {we(60)} AS sxy,
  sum(CASE WHEN ret IS NOT NULL THEN mkt END) OVER {we(60)} AS sxv, sum(mkt) OVER {we(60)} AS sx, sum(mkt * mkt) OVER {we(60)} AS sxx,
  sum(ret * ret) OVER {we(60)} AS syy, count(mkt) OVER {we(60)} AS na FROM g),
b AS (SELECT *, CASE WHEN na >= 60 AND nv >= 10 THEN (sxy - sy / nullif(nv, 0) * sxv) / nullif(sxx - sx * sx / 60, 0) END AS beta FROM s)
SELECT entity, dt, round(beta, 5) + 0.0 AS beta, round(CASE WHEN beta IS NOT NULL THEN sqrt(greatest(0, (syy - nv * (sy / nullif(nv, 0)) * (sy / nullif(nv, 0)) - beta * (sxy - sy / nullif(nv, 0) * sxv)) / 60)) END, 5) + 0.0 AS idio FROM b""")
def reg3(s, d):
    px = t.stored(t.ret_d(s, d).select("entity", "dt", "ret"), "panel")
    mk = px.where(F.col("ret").isNotNull()).groupBy("dt").agg(F.round(F.avg("ret"), 8).alias("mkt"))
    out = ts.rolling_beta_on(px, mk, "ret", "mkt", 60, least=10)
    return out.select("entity", "dt", r("beta", 5).alias("beta"), r("idio", 5).alias("idio"))


# ---- cross-section, monthly


def cross(name: str, make, expr: str, digits: int = 6):
    add(name, f"WITH {FDMT} SELECT entity, dt, round({expr}, {digits}) + 0.0 AS value FROM fdmt")(lambda s, d: t.fdmt_m(s, d).select("entity", "dt", r(make(), digits).alias("value")))


cross("xs1_rank", lambda: xs.rank("ret_m"), "CASE WHEN ret_m IS NOT NULL THEN (rank() OVER (PARTITION BY dt ORDER BY ret_m NULLS LAST) + (count(*) OVER (PARTITION BY dt, ret_m) - 1) / 2.0) / count(ret_m) OVER (PARTITION BY dt) END")
cross("xs2_scale", lambda: xs.scale("ret_m", 1.0), "ret_m / nullif(sum(abs(ret_m)) OVER (PARTITION BY dt), 0)")
cross("xs3_industry_neutralize", lambda: xs.demean("ret_m", "industry"), "ret_m - avg(ret_m) OVER (PARTITION BY industry)")
cross("xs4_industry_neutralize_by_date", lambda: xs.demean("ret_m", "dt", "industry"), "ret_m - avg(ret_m) OVER (PARTITION BY dt, industry)")
cross("xs5_zscore", lambda: xs.zscore("ret_m"), "(ret_m - avg(ret_m) OVER (PARTITION BY dt)) / nullif(stddev_samp(ret_m) OVER (PARTITION BY dt), 0)")
cross("xs5_zscore_pop", lambda: xs.zscore("ret_m", ddof=0), "(ret_m - avg(ret_m) OVER (PARTITION BY dt)) / nullif(stddev_pop(ret_m) OVER (PARTITION BY dt), 0)")
cross("xs7_unit", lambda: xs.to_unit("ret_m"), "(ret_m - min(ret_m) OVER (PARTITION BY dt)) / nullif(max(ret_m) OVER (PARTITION BY dt) - min(ret_m) OVER (PARTITION BY dt), 0)")


@add("xs6_winsorize", f"""WITH {FDMT}, a AS (SELECT entity, dt, ret_m, avg(ret_m) OVER (PARTITION BY dt) AS m, stddev_samp(ret_m) OVER (PARTITION BY dt) AS s FROM fdmt),
b AS (SELECT *, CASE WHEN abs(ret_m - m) <= 1.5 * s THEN ret_m END AS i FROM a), c AS (SELECT *, min(i) OVER (PARTITION BY dt) AS lo, max(i) OVER (PARTITION BY dt) AS hi FROM b)
SELECT entity, dt, round(CASE WHEN ret_m IS NULL OR lo IS NULL THEN ret_m ELSE least(greatest(ret_m, lo), hi) END, 6) + 0.0 AS value FROM c""")
def xs6(s, d):
    return xs.winsorize(t.fdmt_m(s, d), "ret_m", k=1.5).select("entity", "dt", r("ret_m").alias("value"))


@add("xs8_clip_mad", f"WITH {FDMT}, {mad('fdmt', 'ret_m', k=1.5)} SELECT entity, dt, round(ret_m, 6) + 0.0 AS value FROM clipped")
def xs8(s, d):
    return xs.clip_mad(t.fdmt_m(s, d), "ret_m", k=1.5).select("entity", "dt", r("ret_m").alias("value"))


@add("xs9_adjusted_boxplot", f"""WITH {FDMT}, st AS (SELECT dt, quantile_cont(ret_m, 0.25) AS q1, quantile_cont(ret_m, 0.5) AS q2, quantile_cont(ret_m, 0.75) AS q3 FROM fdmt GROUP BY 1),
v AS (SELECT f.dt, entity, ret_m AS v, q2 AS m FROM fdmt f JOIN st ON st.dt = f.dt WHERE ret_m IS NOT NULL),
h AS (SELECT a.dt, median(CASE WHEN a.v > b.v THEN ((a.v - a.m) - (a.m - b.v)) / (a.v - b.v) ELSE sign(a.entity - b.entity) END) AS mc FROM v a JOIN v b ON a.dt = b.dt AND a.v >= a.m AND b.v <= b.m GROUP BY 1),
l AS (SELECT st.dt, q1 - 1.5 * exp((CASE WHEN coalesce(mc, 0) >= 0 THEN -3.5 ELSE -4.0 END) * coalesce(mc, 0)) * (q3 - q1) AS lo, q3 + 1.5 * exp((CASE WHEN coalesce(mc, 0) >= 0 THEN 4.0 ELSE 3.5 END) * coalesce(mc, 0)) * (q3 - q1) AS hi FROM st LEFT JOIN h ON h.dt = st.dt),
i AS (SELECT f.entity, f.dt, ret_m, CASE WHEN ret_m BETWEEN lo AND hi THEN ret_m END AS i FROM fdmt f JOIN l ON l.dt = f.dt)
SELECT entity, dt, round(CASE WHEN ret_m IS NOT NULL THEN least(greatest(ret_m, min(i) OVER (PARTITION BY dt)), max(i) OVER (PARTITION BY dt)) END, 6) + 0.0 AS value FROM i""")
def xs9(s, d):
    return xs.adjusted_boxplot(t.fdmt_m(s, d), "ret_m").select("entity", "dt", r("ret_m").alias("value"))


@add("xs9_adjusted_boxplot_large", f"""WITH {FDMT}, y AS (SELECT entity, dt, ret_m, year(dt) AS yr, row_number() OVER (ORDER BY entity, dt) AS k FROM fdmt), st AS (SELECT yr, quantile_cont(ret_m, 0.25) AS q1, quantile_cont(ret_m, 0.5) AS q2, quantile_cont(ret_m, 0.75) AS q3 FROM y GROUP BY 1),
v AS (SELECT y.yr, k, ret_m AS v, q2 AS m FROM y JOIN st ON st.yr = y.yr WHERE ret_m IS NOT NULL),
h AS (SELECT a.yr, median(CASE WHEN a.v > b.v THEN ((a.v - a.m) - (a.m - b.v)) / (a.v - b.v) ELSE sign(a.k - b.k) END) AS mc FROM v a JOIN v b ON a.yr = b.yr AND a.v >= a.m AND b.v <= b.m GROUP BY 1),
l AS (SELECT st.yr, q1 - 1.5 * exp((CASE WHEN mc >= 0 THEN -3.5 ELSE -4.0 END) * mc) * (q3 - q1) AS lo, q3 + 1.5 * exp((CASE WHEN mc >= 0 THEN 4.0 ELSE 3.5 END) * mc) * (q3 - q1) AS hi FROM st LEFT JOIN h ON h.yr = st.yr),
i AS (SELECT entity, dt, y.yr, ret_m, CASE WHEN ret_m BETWEEN lo AND hi THEN ret_m END AS i FROM y JOIN l ON l.yr = y.yr)
SELECT entity, dt, round(CASE WHEN ret_m IS NOT NULL THEN least(greatest(ret_m, min(i) OVER (PARTITION BY yr)), max(i) OVER (PARTITION BY yr)) END, 6) + 0.0 AS value FROM i""")
def xs9_large(s, d):
    years = t.fdmt_m(s, d).withColumn("yr", F.year("dt"))
    return boxplots.adjusted_boxplot_large(years, "ret_m", "yr", few=512, block=128).select("entity", "dt", r("ret_m").alias("value"))


def _neutral(x: str, table: str) -> str:
    return f"""ng AS (SELECT *, CASE WHEN {x} IS NOT NULL AND cap > 0 THEN {x} END AS ny, CASE WHEN {x} IS NOT NULL AND cap > 0 THEN ln(cap) END AS nx FROM {table}),
nd AS (SELECT * EXCLUDE (ny, nx), ny - avg(ny) OVER (PARTITION BY dt, industry) AS ny, nx - avg(nx) OVER (PARTITION BY dt, industry) AS nx FROM ng),
nr AS (SELECT * EXCLUDE ({x}), ny - coalesce(sum(nx * ny) OVER (PARTITION BY dt) / nullif(sum(nx * nx) OVER (PARTITION BY dt), 0), 0) * nx AS {x} FROM nd)"""


@add("xs10_neutralize", f"WITH {FDMT}, {_neutral('ret_m', 'fdmt')} SELECT entity, dt, round(ret_m, 5) + 0.0 AS value FROM nr")
def xs10(s, d):
    return xs.neutralize(t.fdmt_m(s, d), "ret_m").select("entity", "dt", r("ret_m", 5).alias("value"))


_Z = "z AS (SELECT * EXCLUDE (ret_m), (ret_m - avg(ret_m) OVER (PARTITION BY dt)) / nullif(stddev_pop(ret_m) OVER (PARTITION BY dt), 0) AS ret_m FROM clipped)"


@add("xs11_clean", f"WITH {FDMT}, {mad('fdmt', 'ret_m')}, {_Z}, {_neutral('ret_m', 'z')} SELECT entity, dt, round(ret_m, 5) + 0.0 AS value FROM nr")
def xs11(s, d):
    return xs.clean(t.fdmt_m(s, d), "ret_m").select("entity", "dt", r("ret_m", 5).alias("value"))


_BIG = "big AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY dt) AS nn FROM fdmt WHERE ret_m IS NOT NULL) WHERE nn > 5)"
_NEXT = "nx AS (SELECT dt, lead(dt) OVER (ORDER BY dt) AS next_dt FROM (SELECT DISTINCT dt FROM {0}))"


@add("xs12_signal_monthly", f"WITH {FDMT}, {_BIG}, {mad('big', 'ret_m')}, {_Z}, {_NEXT.format('z')} SELECT entity, next_dt AS dt, round(ret_m, 6) + 0.0 AS signal FROM z JOIN nx ON nx.dt = z.dt WHERE next_dt IS NOT NULL")
def xs12(s, d):
    return xs.signal(t.stored(t.fdmt_m(s, d).select("entity", "dt", "ret_m"), "panel"), "ret_m", 5).select("entity", "dt", r("signal").alias("signal"))


@add("xs13_signal_neutral", f"WITH {FDMT}, {_BIG}, {mad('big', 'ret_m')}, {_Z}, {_neutral('ret_m', 'z')}, {_NEXT.format('nr')} SELECT entity, next_dt AS dt, round(ret_m, 5) + 0.0 AS signal FROM nr JOIN nx ON nx.dt = nr.dt WHERE next_dt IS NOT NULL")
def xs13(s, d):
    return xs.signal(t.fdmt_m(s, d), "ret_m", 5, neutral=True).select("entity", "dt", r("signal", 5).alias("signal"))


@add("xs16_quantile", f"WITH {FDMT} SELECT entity, dt, {bucket('ret_m', 5, 'dt')} AS bucket FROM fdmt")
def xs16(s, d):
    return xs.quantile(t.fdmt_m(s, d), "ret_m", 5).select("entity", "dt", "bucket")


@add("xs16_quantile_rank_first", f"WITH {FDMT}, q AS (SELECT entity, dt, CASE WHEN volume IS NOT NULL THEN row_number() OVER (PARTITION BY dt ORDER BY volume NULLS LAST, entity) END AS rk FROM fdmt) SELECT entity, dt, {bucket('rk', 5, 'dt')} AS bucket FROM q")
def xs16b(s, d):
    return xs.quantile(t.fdmt_m(s, d), "volume", 5, fallback=True).select("entity", "dt", "bucket")


# ---- resampling


@add("rsp1_monthly_bars", f"WITH {PXM} SELECT * FROM px_m")
def rsp1(s, d):
    return t.px_m(s, d)


@add("rsp2_last_per_month", f"WITH {RETD}, x AS (SELECT entity, dt, CASE WHEN volume > 30 THEN close END AS c, ret FROM ret_d) SELECT entity, last_day(dt) AS month_end, max_by(c, dt) FILTER (WHERE c IS NOT NULL) AS c, max_by(ret, dt) FILTER (WHERE ret IS NOT NULL) AS ret FROM x GROUP BY 1, 2")
def rsp2(s, d):
    return resample.last_per_month(t.ret_d(s, d).withColumn("c", F.when(F.col("volume") > 30, F.col("close"))), "c", "ret")


@add("rsp3_index_monthly", f"WITH {RETD}, i AS (SELECT dt, CAST(sum(CAST(round(amount * 100) AS BIGINT)) AS DOUBLE) / sum(volume) AS lvl FROM ret_d GROUP BY 1), m AS (SELECT last_day(dt) AS month_end, max_by(lvl, dt) AS lvl FROM i GROUP BY 1), n AS (SELECT *, lvl / lag(lvl) OVER (ORDER BY month_end) - 1 AS ret_m FROM m) SELECT month_end, lvl, round(ret_m, 6) + 0.0 AS ret_m, round(lead(ret_m) OVER (ORDER BY month_end), 6) + 0.0 AS ret_1m FROM n")
def rsp3(s, d):
    i = t.px_d(s, d).groupBy(F.lit(1).alias("entity"), "dt").agg((F.sum(F.round(F.col("amount") * 100).cast("long")).cast("double") / F.sum("volume")).alias("lvl"))
    m = resample.last_per_month(i, "lvl")
    w = by_entity(None, "entity", order="month_end")
    m = m.withColumn("ret_m", F.col("lvl") / F.lag("lvl").over(w) - 1).withColumn("ret_1m", F.lead("ret_m").over(w))
    return m.select("month_end", "lvl", r("ret_m").alias("ret_m"), r("ret_1m").alias("ret_1m"))


@add("rsp4_last_rows_of_months", f"WITH {PXD}, n AS (SELECT entity, dt, close, lead(dt) OVER {WE} AS nd FROM px_d) SELECT entity, dt, close FROM n WHERE date_trunc('month', nd) <> date_trunc('month', dt)")
def rsp4(s, d):
    return resample.last_rows_of_months(t.px_d(s, d)).select("entity", "dt", "close")


_IRR = """irr AS (SELECT o_custkey AS entity, CAST(o_orderdate AS DATE) AS dt, round(sum(o_totalprice), 2) AS spend FROM orders GROUP BY 1, 2)"""


@add("rsp5_convert_frequency", f"""WITH {_IRR}, m AS (SELECT entity, last_day(dt) AS month_end, max_by(spend, dt) AS spend FROM irr GROUP BY 1, 2),
g AS (SELECT entity, last_day(CAST(unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH)) AS DATE)) AS month_end FROM (SELECT entity, min(month_end) AS a, max(month_end) AS b FROM m GROUP BY 1))
SELECT g.entity, g.month_end, last_value(spend IGNORE NULLS) OVER (PARTITION BY g.entity ORDER BY g.month_end ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS spend FROM g LEFT JOIN m ON m.entity = g.entity AND m.month_end = g.month_end""")
def rsp5(s, d):
    o = t.table(s, d, "orders").groupBy(F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("dt")).agg(F.round(F.sum("o_totalprice"), 2).alias("spend"))
    return resample.convert_frequency(o, "spend", 3)


@add("rsp6_cln8_statement_to_daily", f"""WITH {STMT}, cal AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS dt FROM lineitem),
k0 AS (SELECT entity, trd_dt, max_by(revenue, dt) AS revenue FROM stmt GROUP BY 1, 2),
k1 AS (SELECT k0.entity, k0.trd_dt, min(cal.dt) AS dt, any_value(revenue) AS revenue FROM k0 JOIN cal ON cal.dt >= k0.trd_dt GROUP BY 1, 2),
k AS (SELECT entity, dt, max(revenue) AS revenue FROM k1 GROUP BY 1, 2), f AS (SELECT entity, min(dt) AS a FROM k GROUP BY 1),
g AS (SELECT f.entity, cal.dt, revenue FROM f JOIN cal ON cal.dt >= a LEFT JOIN k ON k.entity = f.entity AND k.dt = cal.dt)
SELECT entity, dt, revenue FROM (SELECT entity, dt, last_value(revenue IGNORE NULLS) OVER {we(401)} AS revenue FROM g) WHERE revenue IS NOT NULL""")
def rsp6(s, d):
    cal = t.table(s, d, "lineitem").select(F.to_date("l_shipdate").alias("dt")).distinct()
    return resample.as_of_daily(t.stmt_q(s, d), cal, "revenue", 400)


@add("rsp7_yearly_to_monthly", f"""WITH {STMT}, y AS (SELECT entity, make_date(year(dt), 12, 31) AS dt, max(revenue) AS revenue FROM stmt GROUP BY 1, 2),
e AS (SELECT entity, revenue, k, last_day(CAST(dt + to_months(6 + k) AS DATE)) AS month_end FROM (SELECT *, unnest(generate_series(0, 11)) AS k FROM y))
SELECT entity, month_end, min_by(revenue, k) AS revenue FROM e GROUP BY 1, 2""".replace("to_months(6 + k)", "to_months(CAST(6 + k AS INTEGER))"))
def rsp7(s, d):
    y = t.stmt_q(s, d).groupBy("entity", F.make_date(F.year("dt"), F.lit(12), F.lit(31)).alias("dt")).agg(F.max("revenue").alias("revenue"))
    return resample.yearly_to_monthly(y, "revenue")


@add("rsp8_trading_month_ends", f"WITH {PXD} SELECT last_day(dt) AS month_end, max(dt) AS trd_dt FROM px_d GROUP BY 1")
def rsp8(s, d):
    return resample.trading_month_ends(t.px_d(s, d))


@add("cln9_quarter_grid", f"""WITH {STMT}, z AS (SELECT entity, dt, revenue FROM stmt WHERE units > 100),
g AS (SELECT entity, last_day(CAST(unnest(generate_series(date_trunc('quarter', a), date_trunc('quarter', b), INTERVAL 3 MONTH)) + INTERVAL 2 MONTH AS DATE)) AS dt FROM (SELECT entity, min(dt) AS a, max(dt) AS b FROM z GROUP BY 1))
SELECT g.entity, g.dt, revenue FROM g LEFT JOIN z ON z.entity = g.entity AND z.dt = g.dt""")
def cln9(s, d):
    z = t.stmt_q(s, d).where("units > 100").select("entity", "dt", "revenue")
    return resample.densify(z, resample.quarter_grid(z), "entity", "dt")


@add("s7_limited_fill", f"WITH {RETD}, x AS (SELECT entity, dt, CASE WHEN volume > 40 THEN close END AS c FROM ret_d) SELECT entity, dt, last_value(c IGNORE NULLS) OVER {we(4)} AS value FROM x")
def s7(s, d):
    x = t.ret_d(s, d).withColumn("c", F.when(F.col("volume") > 40, F.col("close")))
    return x.select("entity", "dt", ffill("c", by_entity(), 3).alias("value"))
