"""Queries of reads, types, names, alignment, coverage and reporting states."""

from __future__ import annotations

import datetime as dt_

from pyspark.sql import functions as F

from panelforge.operators import access as ac
from panelforge.operators import clean as cl
from panelforge.operators import regress as rg
from panelforge.operators import resample as rs
from panelforge.operators import universe as un
from panelforge.operators.accounting import positive
from panelforge.plans.base_sql import FDMT, IND, PXD, RETD, STMT, we
from panelforge.plans.evaluate import _UNI, _uni
from panelforge.plans.factor import FIELDS
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


# ---- reads

@add("src1_table", "SELECT * FROM supplier")
def src1(s, d):
    return t.table(s, d, "supplier")


@add("src3_stock_read", "SELECT entity, dt, close, volume FROM (WITH " + PXD + " SELECT * FROM px_d) WHERE dt BETWEEN DATE '1995-01-01' AND DATE '1997-12-31' ORDER BY dt, entity")
def src3(s, d):
    return t.keyed_read(t.px_d(s, d), ["close", "volume"], "entity", "dt", None, dt_.date(1995, 1, 1), dt_.date(1997, 12, 31)).orderBy("dt", "entity")


@add("src4_futures_read", "SELECT l_partkey AS product, CAST(l_shipdate AS DATE) AS dt, l_linenumber AS code, l_quantity, l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-06-01'")
def src4(s, d):
    rows = t.table(s, d, "lineitem").select(F.col("l_partkey").alias("product"), F.to_date("l_shipdate").alias("dt"), F.col("l_linenumber").alias("code"), "l_quantity", "l_extendedprice")
    return t.keyed_read(rows, ["code", "l_quantity", "l_extendedprice"], "product", "dt", None, dt_.date(1996, 6, 1))


_LVL = PXD + ", " + IND + ", lv AS (SELECT dt, " + ", ".join(f"CAST(sum(CAST(round(amount * 100) AS BIGINT)) FILTER (WHERE sector = {i}) AS DOUBLE) / sum(volume) FILTER (WHERE sector = {i}) AS index_{i}" for i in range(5)) + " FROM px_d p JOIN ind ON ind.entity = p.entity GROUP BY 1)"


def _levels(s, d):
    p = t.px_d(s, d).join(t.industries(s, d), "entity")
    own = lambda i, c: F.sum(F.when(F.col("sector") == i, c))
    cents = F.round(F.col("amount") * 100).cast("long")
    return p.groupBy("dt").agg(*[(own(i, cents).cast("double") / own(i, F.col("volume"))).alias(f"index_{i}") for i in range(5)])


@add("src5_index_read", f"WITH {_LVL} SELECT dt, index_0, index_1, index_2, index_3, index_4 FROM lv WHERE dt >= DATE '1996-01-01' AND dt <= DATE '1998-06-30'")
def src5(s, d):
    return t.keyed_read(_levels(s, d), [f"index_{i}" for i in range(5)], None, "dt", None, dt_.date(1996, 1, 1), dt_.date(1998, 6, 30))


@add("src6_first_root", "SELECT c_custkey, c_acctbal FROM customer")
def src6(s, d):
    return ac.first_found(s, [f"{d}/none", d], "customer", "c_custkey", "c_acctbal")


@add("src9_evaluation_inputs", f"WITH {_UNI}, lv AS (SELECT dt, avg(close) AS bench FROM uni GROUP BY 1) SELECT u.entity, u.dt, round(bench, 6) AS bench, coalesce(type_st, false) AS st, CAST(industry - 1 AS INTEGER) AS industry_code, CASE WHEN suspended THEN 0 ELSE 1 END AS open_flag, CASE WHEN NOT suspended THEN close END AS close, CASE WHEN NOT suspended THEN round(amount / nullif(volume, 0), 9) END AS vwap FROM uni u JOIN lv ON lv.dt = u.dt")
def src9(s, d):
    u = _uni(s, d)
    # one row per trading day
    u = u.join(F.broadcast(u.groupBy("dt").agg(r(F.avg("close")).alias("bench"))), "dt")
    vwap = r(F.col("amount") / F.nullif(F.col("volume"), F.lit(0.0)), 9)
    return u.withColumn("vwap", vwap).select(
        "entity", "dt", "bench", un.flag("type_st").alias("st"), (F.col("industry") - 1).cast("int").alias("industry_code"), F.when(F.col("suspended"), 0).otherwise(1).alias("open_flag"),
        un.while_open("close").alias("close"), un.while_open("vwap").alias("vwap"),
    )


# ---- stores: written to the shared folder and read back

@add("src7_delimited", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def src7(s, d):
    path = t.scratch(s, "src7")
    t.table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal").write.option("sep", "\t").option("header", True).csv(path)
    return t.delimited(s, path, "c_custkey long, c_name string, c_acctbal double")


# files with two descriptor rows under the header, in a one-byte encoding whose letters UTF-8 spells otherwise
@add("src7_described_files", "SELECT c_custkey, 'é' || c_name AS c_name, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal FROM customer")
def src7b(s, d):
    path = t.scratch(s, "src7b")
    c = t.table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("c_custkey"), F.concat(F.lit("é"), "c_name").alias("c_name"), F.when(F.col("c_custkey") % 7 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("c_acctbal"))
    # one file a nation, so that every file has its own header and descriptors
    rows = c.withColumn("part", F.pmod(F.col("c_custkey").cast("long"), F.lit(5))).withColumn("place", F.lit(2))
    described = s.createDataFrame([(a, b, e, p, i) for p in range(5) for i, (a, b, e) in enumerate((("customer", "name", "balance"), ("number", "text é", "money")))], "c_custkey string, c_name string, c_acctbal string, part long, place int")
    lines = rows.unionByName(described).repartition(5, "part").sortWithinPartitions("part", "place")
    lines.select("c_custkey", "c_name", "c_acctbal", "part").write.partitionBy("part").option("sep", "|").option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return t.delimited(s, f"{path}/part=*", "c_custkey long, c_name string, c_acctbal double", "|", "ISO-8859-1", skip=2)


# the dictionary of fields: where each is found, and what each table holds
@add("cat1_field_owners", "SELECT column_name AS field, table_name AS owner FROM information_schema.columns WHERE table_name IN ('supplier', 'customer', 'part') AND column_name NOT IN ('s_suppkey', 'c_custkey', 'p_partkey')")
def cat1(s, d):
    return _catalog(s, d).owners()


def _catalog(s, d):
    key = {"supplier": "s_suppkey", "customer": "c_custkey", "part": "p_partkey"}
    return t.Catalog({n: t.table(s, d, n).withColumnRenamed(k, "k") for n, k in key.items()}, ["k"])


_TYPES = "CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE lower(data_type) END"


@add("cat3_column_listing", f"""SELECT table_name AS "table", column_name AS field, {_TYPES} AS type, CAST(ordinal_position - 1 AS INTEGER) AS place, CASE WHEN column_name LIKE '%key' THEN 'key' END AS category
FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part')""")
def cat3(s, d):
    frames = {n: t.table(s, d, n) for n in ("region", "nation", "customer", "supplier", "part")}
    keys = sorted({c for df in frames.values() for c in df.columns if c.endswith("key")})
    return ac.column_listing(frames, s.createDataFrame([(k, "key") for k in keys], "field string, category string")).select("table", "field", "type", "place", "category")


@add("src8_column_store", f"WITH {PXD} SELECT entity, dt, close, volume FROM px_d")
def src8(s, d):
    path = t.scratch(s, "src8")
    t.column_store(t.px_d(s, d), path, "close", "high", "volume")
    return t.columns_of(s, path, "close", "volume")


@add("snk1_replaced_panel", f"WITH {PXD} SELECT entity, dt, close, CAST(year(dt) AS INTEGER) AS yr FROM px_d WHERE volume > 20")
def snk1(s, d):
    path, p = t.scratch(s, "snk1"), t.px_d(s, d).select("entity", "dt", "close", "volume", F.year("dt").alias("yr"))
    t.store(p.drop("volume").limit(10), path, "yr")
    t.store(p.where("volume > 20").drop("volume"), path, "yr")
    return s.read.parquet(path)


@add("snk2_missing_keys", f"WITH {STMT} SELECT dt, units, CASE WHEN entity % 2 = 0 THEN revenue ELSE -revenue END AS revenue, CAST(entity AS INTEGER) AS entity FROM stmt")
def snk2(s, d):
    # both stores read the statements
    path, q = t.scratch(s, "snk2"), t.stored(t.stmt_q(s, d).select("entity", "dt", "units", "revenue"), "statements")
    t.store_missing(q.where("entity % 2 = 0"), path, "entity")
    t.store_missing(q.withColumn("revenue", -F.col("revenue")), path, "entity")
    return s.read.parquet(path).withColumn("entity", F.col("entity").cast("int"))


@add("snk3_result_bundle", f"WITH {FDMT} SELECT 'navs' AS frame, industry AS strategy, dt, round(avg(ret_m), 6) + 0.0 AS value FROM fdmt WHERE ret_m IS NOT NULL GROUP BY 2, 3 UNION ALL SELECT 'sizes', industry, dt, round(sum(cap), 2) FROM fdmt GROUP BY 2, 3")
def snk3(s, d):
    path, f = t.scratch(s, "snk3"), t.fdmt_m(s, d)
    navs = f.where("ret_m is not null").groupBy(F.col("industry").alias("strategy"), "dt").agg(r(F.avg("ret_m")).alias("value"))
    sizes = f.groupBy(F.col("industry").alias("strategy"), "dt").agg(r(F.sum("cap"), 2).alias("value"))
    t.store_bundle({"navs": navs, "sizes": sizes}, path)
    frames = [s.read.parquet(f"{path}/{n}").select(F.lit(n).alias("frame"), "strategy", "dt", "value") for n in ("navs", "sizes")]
    return frames[0].unionByName(frames[1])


# ---- types, duplicates, fields and names

@add("cln2_adjust_types", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders")
def cln2(s, d):
    o = t.table(s, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.when(F.col("o_orderkey") % 5 == 0, "--").otherwise(F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".0"))).alias("day"))
    return ac.adjust_types(o, ["price"], ["day"])


for _last in (False, True):

    @add(f"cln7_keep_{'last' if _last else 'first'}", f"SELECT o_custkey, CAST(o_orderdate AS DATE) AS dt, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_totalprice {'DESC' if _last else 'ASC'}, o_orderkey {'DESC' if _last else 'ASC'}) = 1")
    def cln7(s, d, last=_last):
        o = t.table(s, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("dt"), "o_orderkey", "o_totalprice")
        return ac.keep_first(o, ["o_custkey", "dt"], "o_totalprice", "o_orderkey", last=last)


_FLD = f"{STMT}, f AS (SELECT entity, dt, " + ", ".join(f"CAST({e} AS DOUBLE) AS {k}" for k, e in FIELDS.items()) + " FROM stmt)"


@add("prj2_derived_fields", f"WITH {_FLD}, g AS (SELECT * REPLACE (CASE WHEN entity % 2 = 0 THEN notes_rcv END AS notes_rcv, CASE WHEN entity % 3 = 0 THEN acct_rcv END AS acct_rcv) FROM f) SELECT entity, dt, round(tot_assets - tot_liab, 6) AS net_asset, round(non_oper_rev - non_oper_exp, 7) AS net_non_oper, round(oper_cost + gerl_admin_exp + fin_exp, 6) AS period_cost, round(CASE WHEN notes_rcv IS NOT NULL OR acct_rcv IS NOT NULL THEN coalesce(notes_rcv, 0) + coalesce(acct_rcv, 0) END, 6) AS receivable, round(notes_payable + acct_payable, 6) AS payable, round(oper_rev - oper_cost, 6) + 0.0 AS gross_income FROM g")
def prj2(s, d):
    f = t.stmt_q(s, d).select("entity", "dt", *[F.expr(e).cast("double").alias(k) for k, e in FIELDS.items()])
    f = f.withColumns({"notes_rcv": F.when(F.col("entity") % 2 == 0, F.col("notes_rcv")), "acct_rcv": F.when(F.col("entity") % 3 == 0, F.col("acct_rcv"))})
    digits = {"net_asset": 6, "net_non_oper": 7, "period_cost": 6, "receivable": 6, "payable": 6, "gross_income": 6}
    return ac.derived_fields(f).select("entity", "dt", *[r(c, k).alias(c) for c, k in digits.items()])


@add("prj4_adjusted_prices", f"WITH {PXD} SELECT entity, dt, close * (1 + entity % 5) AS close, high * (1 + entity % 5) AS high, low * (1 + entity % 5) AS low FROM px_d")
def prj4(s, d):
    return un.adjusted(t.px_d(s, d).withColumn("factor", 1 + F.col("entity") % 5), "factor", "close", "high", "low").select("entity", "dt", "close", "high", "low")


@add("prj5_name_parts", "SELECT p_partkey, substr(p_brand, 1, 1) AS category, lower(replace(p_type, ' ', '_')) AS short_name, CAST(p_size AS INTEGER) AS smooth, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END AS sign FROM part")
def prj5(s, d):
    p = t.table(s, d, "part")
    name = F.concat(F.substring("p_brand", 1, 1), F.lit("_"), F.lower(F.replace(F.col("p_type"), F.lit(" "), F.lit("_"))), F.lit("_smooth"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "_p").otherwise("_n"))
    return p.withColumn("strategy", name).select("p_partkey", *[c.alias(k) for k, c in ac.name_parts().items()])


@add("prj6_sizes", "SELECT p_partkey, CAST(p_size AS BIGINT) * CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 ELSE 1073741824 END AS bytes FROM part")
def prj6(s, d):
    unit = F.element_at(F.array(F.lit(""), F.lit("K"), F.lit("m"), F.lit("G")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t.table(s, d, "part").withColumn("size", F.concat(F.col("p_size").cast("string"), unit)).select("p_partkey", ac.bytes_of("size").alias("bytes"))


@add("flt6_positive", f"WITH {STMT} SELECT entity, dt, CASE WHEN profit > 0 THEN profit END AS profit FROM stmt")
def flt6(s, d):
    return t.stmt_q(s, d).select("entity", "dt", positive("profit").alias("profit"))


# ---- alignment

@add("jn1_inner_align", f"WITH {PXD}, {STMT} SELECT p.entity, p.dt, close, revenue, tax FROM px_d p JOIN stmt s ON s.entity = p.entity AND s.dt = p.dt")
def jn1(s, d):
    q = t.stmt_q(s, d)
    return ac.inner_align(t.px_d(s, d).select("entity", "dt", "close"), q.select("entity", "dt", "revenue"), q.select("entity", "dt", "tax"))


_AB = f"WITH {PXD}, a AS (SELECT entity, dt, close FROM px_d WHERE close > 150), b AS (SELECT entity, dt, volume FROM px_d WHERE volume > 20)"


def _ab(s, d):
    p = t.px_d(s, d)
    return p.where("close > 150").select("entity", "dt", "close"), p.where("volume > 20").select("entity", "dt", "volume")


@add("jn2_outer_align", f"{_AB} SELECT entity, dt, close, volume FROM a FULL JOIN b USING (entity, dt) WHERE volume IS NOT NULL")
def jn2(s, d):
    return ac.outer_align(*_ab(s, d), required=["volume"])


@add("jn7_forward_as_of", f"WITH {PXD}, {STMT}, k AS (SELECT entity, trd_dt AS dt, max_by(revenue, dt) AS revenue FROM stmt GROUP BY 1, 2) SELECT p.entity, p.dt, close, revenue FROM px_d p ASOF LEFT JOIN k ON k.entity = p.entity AND k.dt >= p.dt")
def jn7(s, d):
    known = t.stmt_q(s, d).groupBy("entity", F.col("trd_dt").alias("dt")).agg(F.max_by("revenue", "dt").alias("revenue"))
    return ac.forward_as_of(t.px_d(s, d).select("entity", "dt", "close"), known, "revenue")


@add("jn8_market_dimension", f"WITH {RETD}, mk AS (SELECT dt, avg(ret) AS mkt FROM ret_d GROUP BY 1) SELECT entity, r.dt, round(ret - mkt, 6) + 0.0 AS excess FROM ret_d r JOIN mk ON mk.dt = r.dt")
def jn8(s, d):
    p = t.ret_d(s, d)
    return p.join(F.broadcast(p.groupBy("dt").agg(F.avg("ret").alias("mkt"))), "dt").select("entity", "dt", r(F.col("ret") - F.col("mkt")).alias("excess"))


@add("jn9_shared_index", f"{_AB} SELECT 'a' AS side, entity, dt, close AS value FROM a WHERE (entity, dt) IN (SELECT entity, dt FROM b) UNION ALL SELECT 'b', entity, dt, volume FROM b WHERE (entity, dt) IN (SELECT entity, dt FROM a)")
def jn9(s, d):
    a, b = ac.shared_index(*_ab(s, d))
    return a.select(F.lit("a").alias("side"), "entity", "dt", F.col("close").alias("value")).unionByName(b.select(F.lit("b").alias("side"), "entity", "dt", F.col("volume").alias("value")))


@add("jn9_union_frame", f"{_AB}, g AS (SELECT * FROM (SELECT dt FROM a UNION SELECT dt FROM b) CROSS JOIN (SELECT entity FROM a UNION SELECT entity FROM b)) SELECT g.entity, g.dt, close, volume FROM g LEFT JOIN a ON a.entity = g.entity AND a.dt = g.dt LEFT JOIN b ON b.entity = g.entity AND b.dt = g.dt")
def jn9b(s, d):
    a, b = _ab(s, d)
    x, y = ac.union_frame(a.withColumnRenamed("close", "v"), b.withColumnRenamed("volume", "v"), "v")
    return x.withColumnRenamed("v", "close").join(y.withColumnRenamed("v", "volume"), ["entity", "dt"])


@add("jn11_replicate", f"WITH {STMT} SELECT CAST(rep AS BIGINT) AS rep, entity, dt, units FROM stmt CROSS JOIN (SELECT unnest(range(3)) AS rep)")
def jn11(s, d):
    return s.range(3).select(F.col("id").alias("rep")).crossJoin(t.stmt_q(s, d).select("entity", "dt", "units"))


@add("jn13_event_windows", f"WITH {RETD}, dk AS (SELECT dt, row_number() OVER (ORDER BY dt) AS k FROM (SELECT DISTINCT dt FROM ret_d)), ev AS (SELECT r.entity, r.dt, k FROM ret_d r JOIN dk ON dk.dt = r.dt WHERE volume > 95) SELECT ev.entity, ev.dt AS event_dt, CAST(o AS INTEGER) AS offset_, r.dt, ret FROM ev CROSS JOIN (SELECT unnest(range(-3, 4)) AS o) JOIN dk ON dk.k = ev.k + o JOIN ret_d r ON r.entity = ev.entity AND r.dt = dk.dt")
def jn13(s, d):
    p = t.ret_d(s, d)
    return cl.event_windows(p.where("volume > 95").select("entity", "dt"), p.select("entity", "dt", "ret"), 3, 3).select("entity", "event_dt", F.col("offset").alias("offset_"), "dt", "ret")


# ---- aggregates

@add("agg2_group_statistics", "SELECT user_id, event_type, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS days, min_by(value, event_id) AS first_value, max_by(value, event_id) AS last_value FROM events GROUP BY 1, 2")
def agg2(s, d):
    return t.table(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.count_distinct(F.to_date("ts")).alias("days"), F.min_by("value", "event_id").alias("first_value"), F.max_by("value", "event_id").alias("last_value"))


@add("agg5_percentile_of_score", f"WITH {FDMT}, a AS (SELECT industry, avg(volume) AS score FROM fdmt GROUP BY 1) SELECT f.industry, round((count(*) FILTER (WHERE volume < score) + count(*) FILTER (WHERE volume <= score) + CASE WHEN count(*) FILTER (WHERE volume <= score) > count(*) FILTER (WHERE volume < score) THEN 1 ELSE 0 END) / (2.0 * count(volume)), 6) AS p FROM fdmt f JOIN a ON a.industry = f.industry GROUP BY 1")
def agg5(s, d):
    f = t.fdmt_m(s, d).select("industry", "volume")
    return f.join(f.groupBy("industry").agg(F.avg("volume").alias("score")), "industry").groupBy("industry").agg(r(rg.percentile_of_score("volume", "score")).alias("p"))


@add("agg9_coverage", f"WITH {RETD}, x AS (SELECT year(dt) AS yr, ret, CASE WHEN volume > 20 THEN close END AS close, CASE WHEN entity % 2 = 0 THEN high END AS high FROM ret_d), a AS (SELECT yr, count(*) AS rows, count(ret) AS ret, count(close) AS close, count(high) AS high FROM x GROUP BY 1) SELECT CAST(yr AS INTEGER) AS yr, rows, \"column\", filled FROM a UNPIVOT (filled FOR \"column\" IN (ret, close, high))")
def agg9(s, d):
    x = t.ret_d(s, d).select(F.year("dt").alias("yr"), "ret", F.when(F.col("volume") > 20, F.col("close")).alias("close"), F.when(F.col("entity") % 2 == 0, F.col("high")).alias("high"))
    return ac.coverage(x, ["ret", "close", "high"], "yr")


_W = we(30)


@add("ts14_rolling_two", f"""WITH {RETD}, x AS (SELECT entity, dt, ret AS y, volume / 100 AS a, close / 100 AS b FROM ret_d), m AS (SELECT *, CASE WHEN y IS NOT NULL THEN a END AS a_, CASE WHEN y IS NOT NULL THEN b END AS b_ FROM x),
g AS (SELECT entity, dt, count(y) OVER {_W} AS n, avg(y) OVER {_W} AS my, avg(a_) OVER {_W} AS ma, avg(b_) OVER {_W} AS mb, covar_pop(a_, a_) OVER {_W} AS saa, covar_pop(b_, b_) OVER {_W} AS sbb, covar_pop(a_, b_) OVER {_W} AS sab, covar_pop(a_, y) OVER {_W} AS say, covar_pop(b_, y) OVER {_W} AS sby FROM m),
h AS (SELECT *, (sbb * say - sab * sby) / nullif(saa * sbb - sab * sab, 0) AS b1, (saa * sby - sab * say) / nullif(saa * sbb - sab * sab, 0) AS b2 FROM g)
SELECT entity, dt, CASE WHEN n >= 30 THEN round(my - b1 * ma - b2 * mb, 5) + 0.0 END AS alpha, CASE WHEN n >= 30 THEN round(b1, 5) + 0.0 END AS b1, CASE WHEN n >= 30 THEN round(b2, 5) + 0.0 END AS b2 FROM h""")
def ts14(s, d):
    x = t.ret_d(s, d).select("entity", "dt", F.col("ret").alias("y"), (F.col("volume") / 100).alias("a"), (F.col("close") / 100).alias("b"))
    return ac.rolling_two(x, "y", "a", "b", 30).select("entity", "dt", *[r(c, 5).alias(c) for c in ("alpha", "b1", "b2")])


# ---- reporting states

_RP = f"""{STMT}, {PXD.replace('px_raw AS', 'px_raw AS', 1)}, rp AS (SELECT dt AS period, trd_dt + CAST(entity % 30 AS INTEGER) - CASE WHEN entity % 17 = 0 THEN 80 ELSE 0 END AS dt FROM stmt), li AS (SELECT c.dt, count(*) AS listed FROM (SELECT DISTINCT dt FROM px_d) c JOIN (SELECT entity, min(dt) AS a FROM px_d GROUP BY 1) l ON l.a <= c.dt GROUP BY 1),
rn AS (SELECT period, dt, count(*) AS n FROM rp WHERE dt > period GROUP BY 1, 2), gr AS (SELECT p.period, li.dt, coalesce(n, 0) AS n, listed FROM (SELECT DISTINCT period FROM rn) p CROSS JOIN li LEFT JOIN rn ON rn.period = p.period AND rn.dt = li.dt),
sh AS (SELECT period, dt, CAST(sum(n) OVER (PARTITION BY period ORDER BY dt) AS DOUBLE) / nullif(listed, 0) AS share FROM gr), pk AS (SELECT period, max(share) AS top FROM sh GROUP BY 1), at_ AS (SELECT sh.period, min(dt) AS stop FROM sh JOIN pk ON pk.period = sh.period AND share = top GROUP BY 1),
rs AS (SELECT sh.* FROM sh JOIN at_ ON at_.period = sh.period WHERE dt <= stop)"""


def _shares(s, d):
    early = F.when(F.col("entity") % 17 == 0, 80).otherwise(0)
    rp = t.stmt_q(s, d).select(F.col("dt").alias("period"), F.date_add("trd_dt", (F.col("entity") % 30 - early).cast("int")).alias("dt"))
    p = t.px_d(s, d).select("entity", "dt")
    # listings per day, added up over the days: one row per day
    first = p.groupBy("entity").agg(F.min("dt").alias("dt")).groupBy("dt").agg(F.count("*").alias("new"))
    from pyspark.sql import Window

    days = p.select("dt").distinct().join(first, "dt", "left")
    listed = days.select("dt", F.sum(F.coalesce("new", F.lit(0))).over(Window.orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)).alias("listed"))
    return ac.reported_share(rp, listed)


@add("mkt2_reported_share", f"WITH {_RP} SELECT period, dt, round(share, 6) AS share FROM rs")
def mkt2(s, d):
    return _shares(s, d).withColumn("share", r("share"))


@add("mkt3_timing_grid", f"""WITH {_RP}, md AS (SELECT dt, avg(close) AS lvl FROM px_d GROUP BY 1), mr AS (SELECT dt, coalesce(lvl / lag(lvl) OVER (ORDER BY dt) - 1, 0) AS ret FROM md), gd AS (SELECT * FROM (SELECT unnest([0.1, 0.3]) AS start) CROSS JOIN (SELECT unnest([0.5, 0.7]) AS end_)),
inn AS (SELECT DISTINCT start, end_, dt FROM rs CROSS JOIN gd WHERE share >= start AND share <= end_), sg AS (SELECT gd.start, gd.end_, mr.dt, ret, CASE WHEN inn.dt IS NULL THEN 1 ELSE -1 END AS signal FROM gd CROSS JOIN mr LEFT JOIN inn ON inn.start = gd.start AND inn.end_ = gd.end_ AND inn.dt = mr.dt)
SELECT CAST(start AS DOUBLE) AS start, CAST(end_ AS DOUBLE) AS end_, dt, CAST(signal AS INTEGER) AS signal, round(sum(ln(1 + signal * ret)) OVER w, 5) + 0.0 AS nav, round(sum(ln(1 + signal * ret)) OVER w - sum(ln(1 + ret)) OVER w, 5) + 0.0 AS relative FROM sg WINDOW w AS (PARTITION BY start, end_ ORDER BY dt)""")
def mkt3(s, d):
    from pyspark.sql import Window

    # one row per trading day
    m = t.px_d(s, d).groupBy("dt").agg(F.avg("close").alias("lvl"))
    m = m.select("dt", F.coalesce(F.col("lvl") / F.lag("lvl").over(Window.orderBy("dt")) - 1, F.lit(0.0)).alias("ret"))
    g = ac.timing_grid(_shares(s, d), m, [0.1, 0.3], [0.5, 0.7])
    return g.select("start", F.col("end").alias("end_"), "dt", "signal", r("nav", 5).alias("nav"), r("relative", 5).alias("relative"))


@add("txt1_dated_marks", r"""WITH l AS (SELECT doc_id, regexp_extract(text, '([0-9]{4})', 1) AS date, unnest(regexp_extract_all(text, '([A-Za-z0-9_]+) = "([^"\n]*)"', 1)) AS name, unnest(regexp_extract_all(text, '([A-Za-z0-9_]+) = "([^"\n]*)"', 2)) AS mark, unnest(range(1, 1 + len(regexp_extract_all(text, '([A-Za-z0-9_]+) = "([^"\n]*)"', 1)))) AS k FROM documents)
SELECT date, CAST(length(name) AS INTEGER) AS code, name, mark, doc_id FROM l WHERE length(name) > 3 QUALIFY row_number() OVER (PARTITION BY date, length(name) ORDER BY doc_id DESC, k DESC) = 1""")
def txt1b(s, d):
    x = t.table(s, d, "documents")
    pair, date = r'([A-Za-z0-9_]+) = "([^"\n]*)"', r"([0-9]{4})"
    names = x.select(F.explode(F.regexp_extract_all("text", F.lit(pair), 1)).alias("name")).distinct().where(F.length("name") > 3)
    return cl.dated_marks(x, names.withColumn("code", F.length("name")), pair, date)
