"""The panels of panelforge.sources.tables as common table expressions of the SQL that queries are held against."""

# Sums run over whole cents and quantities are whole, so both engines reach the same bits before any division.
PXD = """px_raw AS (SELECT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS dt, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 / nullif(sum(l_quantity), 0) AS c,
  max(l_extendedprice / nullif(l_quantity, 0)) AS h, min(l_extendedprice / nullif(l_quantity, 0)) AS l,
  sum(l_quantity) AS volume, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS amount FROM lineitem GROUP BY 1, 2),
px_d AS (SELECT entity, dt, 100.0 + 100.0 * c / (c + 2000.0) AS close, 100.0 + 100.0 * h / (h + 2000.0) AS high, 100.0 + 100.0 * l / (l + 2000.0) AS low, volume, amount FROM px_raw)"""
# returns by a join of each row with the one before it, in place of a window function
RETD = PXD + """, num_d AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY dt) AS rn FROM px_d),
ret_d AS (SELECT a.* EXCLUDE (rn), a.close / b.close - 1 AS ret FROM num_d a LEFT JOIN num_d b ON b.entity = a.entity AND b.rn = a.rn - 1)"""
PXM = PXD + """, bars AS (SELECT entity, last_day(dt) AS month_end, sum(volume) AS volume, min_by(close, dt) AS open, max(high) AS high, min(low) AS low,
  max_by(close, dt) AS close, CAST(sum(CAST(round(amount * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS amount, max(dt) AS trd_dt FROM px_d GROUP BY 1, 2),
grid_m AS (SELECT entity, last_day(CAST(unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH)) AS DATE)) AS month_end
  FROM (SELECT entity, min(month_end) AS a, max(month_end) AS b FROM bars GROUP BY 1)),
ago AS (SELECT a.entity, a.month_end, max(b.month_end) AS before FROM bars a JOIN bars b ON b.entity = a.entity AND b.month_end < a.month_end GROUP BY 1, 2),
px_m0 AS (SELECT g.entity, g.month_end, b.volume, b.open, b.high, b.low, b.close, b.amount, b.trd_dt, b.close / p.close - 1 AS ret_m
  FROM grid_m g LEFT JOIN bars b ON b.entity = g.entity AND b.month_end = g.month_end
  LEFT JOIN ago ON ago.entity = g.entity AND ago.month_end = g.month_end LEFT JOIN bars p ON p.entity = g.entity AND p.month_end = ago.before),
px_m AS (SELECT a.*, b.ret_m AS ret_1m FROM px_m0 a LEFT JOIN px_m0 b ON b.entity = a.entity AND b.month_end = last_day(CAST(a.month_end + INTERVAL 1 DAY AS DATE)))"""
IND = """ind AS (SELECT s_suppkey AS entity, s_nationkey AS industry, n_regionkey AS sector FROM supplier JOIN nation ON n_nationkey = s_nationkey)"""
FDMT = PXM + ", " + IND + """, fdmt AS (SELECT m.entity, month_end AS dt, close, volume, amount AS cap, ret_m, ret_1m, industry, sector
  FROM px_m m JOIN ind ON ind.entity = m.entity WHERE close IS NOT NULL)"""
STMT = """stmt0 AS (SELECT l_suppkey AS entity, last_day(CAST(date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH AS DATE)) AS dt,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT))) AS BIGINT) AS rev,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS cst,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS tx, sum(l_quantity) AS units FROM lineitem GROUP BY 1, 2),
stmt AS (SELECT entity, dt, rev / 10000.0 AS revenue, cst / 10000.0 AS cost, tx / 10000.0 AS tax, units,
  CAST(sum(rev) OVER (PARTITION BY entity ORDER BY dt) AS BIGINT) / 10000.0 AS assets, (rev - 19 * cst) / 10000.0 AS profit, dt + 45 AS trd_dt FROM stmt0)"""
WE = "(PARTITION BY entity ORDER BY dt)"


def we(n: int) -> str:
    return f"(PARTITION BY entity ORDER BY dt ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def guard(agg: str, x: str, n: int, least: int | None = None) -> str:
    return f"CASE WHEN count({x}) OVER {we(n)} >= {n if least is None else least} THEN {agg} OVER {we(n)} END"


def bucket(x: str, groups: int, *keys: str) -> str:
    part = ", ".join(keys)
    edges = " + ".join(f"CASE WHEN quantile_cont({x}, {i / groups!r}) OVER (PARTITION BY {part}) < {x} THEN 1 ELSE 0 END" for i in range(1, groups))
    return f"CASE WHEN {x} IS NOT NULL THEN CAST(1 + {edges} AS INTEGER) END"


def mad(table: str, x: str, key: str = "dt", k: float = 4.5) -> str:
    """A chain of CTEs m1, m2, clipped over `table`: x clipped at k median absolute deviations."""
    return f"""m1 AS (SELECT *, median({x}) OVER (PARTITION BY {key}) AS md FROM {table}),
m2 AS (SELECT *, median(abs({x} - md)) OVER (PARTITION BY {key}) AS mdd FROM m1),
clipped AS (SELECT * EXCLUDE ({x}), CASE WHEN {x} IS NOT NULL THEN greatest(least({x}, md + {k} * mdd), md - {k} * mdd) END AS {x} FROM m2)"""
