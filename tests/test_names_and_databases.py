"""Functions by name, results as views, and database tables on the embedded database that Spark brings along."""

import uuid

import pytest
from pyspark.sql import functions as F

from panelforge.functions import registry
from panelforge.operators import generate
from panelforge.sources import database


def statements(spark):
    rows = [(e, f"20{10 + i // 4}-{3 * (i % 4) + 3:02d}-28", 100.0 + 7 * i + e, 60.0 + 3 * i) for e in (1, 2) for i in range(12)]
    return spark.createDataFrame(rows, "entity int, dt string, revenue double, cost double").withColumn("dt", F.to_date("dt"))


@pytest.fixture
def names():
    held = registry.registered()
    yield
    for n in set(registry.registered()) - set(held):
        registry.remove_operator(n)


def test_a_function_of_the_user_in_a_sheet(spark, names):
    registry.register_operator("x_share_of_y", lambda x, y: x / (x + y))
    registry.register_operator("x_lagged", lambda df, x, out, q: df.withColumn(out, F.expr(f"lag({x}, {q}) over (partition by entity order by dt)")))
    sheet = [{"type": "U", "name": "share", "numerator": "revenue", "denominator": "cost", "function": "x_share_of_y"}, {"type": "U", "name": "ago", "numerator": "revenue - cost", "denominator": "", "function": "x_lagged", "q": 2},
             {"type": "Q", "name": "margin", "numerator": "revenue - cost", "denominator": "revenue", "function": "ratio"}]
    df = statements(spark)
    got = {(r["indicator"], r["entity"], r["dt"]): r["value"] for r in generate.from_rows(df, sheet).collect()}
    rows = sorted((r["entity"], r["dt"], r["revenue"], r["cost"]) for r in df.collect())
    assert len(got) == 3 * len(rows)
    for i, (e, d, x, y) in enumerate(rows):
        assert got["U__share", e, d] == x / (x + y) and got["Q__margin", e, d] == (x - y) / x
        assert got["U__ago", e, d] == (rows[i - 2][2] - rows[i - 2][3] if i >= 2 and rows[i - 2][0] == e else None)


def test_names_are_checked(spark, names):
    df = statements(spark)
    row = {"type": "U", "name": "n", "numerator": "revenue", "denominator": "cost"}
    for bad in ("nothing", "__import__('os')", "ratio; drop"):
        with pytest.raises(ValueError, match="no such function"):
            generate.from_rows(df, [row | {"function": bad}])
    with pytest.raises(ValueError, match="takes no q"):
        registry.register_operator("plain", lambda x: x).add(df, "o", "cost", q=3)
    with pytest.raises(ValueError, match="1 column"):
        registry.operator("plain").add(df, "o", "cost", "revenue")
    for q in (0, -1, 2.0, "4", True):
        with pytest.raises(ValueError, match="whole number"):
            generate.from_rows(df, [row | {"function": "x_history_growth_avg", "q": q}])
    with pytest.raises(ValueError, match="registered already"):
        registry.register_operator("plain", lambda x: x)
    registry.register_operator("plain", lambda x: x + 1, replace=True)
    for fn in (lambda: 1, lambda a, b, c: a, lambda df, x: df, lambda y: y):
        with pytest.raises(TypeError):
            registry.register_operator("odd", fn)
    with pytest.raises(ValueError, match="not a name"):
        registry.register_operator("a b", lambda x: x)
    with pytest.raises(TypeError, match="must return a Column"):
        registry.register_operator("number", lambda x: 3).add(df, "o", "cost")


def test_results_as_views(spark):
    df = statements(spark)
    assert registry.publish(spark, {"stmt": df, "late": df.where("dt > '2011-01-01'")}, "res_") == ["res_stmt", "res_late"]
    assert spark.sql("select count(*) from res_stmt s join res_late l using (entity, dt)").first()[0] == df.where("dt > '2011-01-01'").count()
    with pytest.raises(ValueError):
        registry.publish(spark, {"a b": df})


@pytest.fixture
def url():
    return f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"


def test_ranges_of_a_database_table(spark, url):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 3 % 101).cast("double").alias("v")).unionByName(spark.createDataFrame([(None, 5.0)], "k long, v double"))
    df.write.jdbc(url, "numbers")
    got = database.read_table(spark, url, "numbers", "k", 4)
    assert got.rdd.getNumPartitions() == 4
    sizes = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 300
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    # a filter goes to the database with the range of each partition
    plan = got.where("k > 900 and v < 50")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThan" in plan.replace("*", "") or "k > 900" in plan
    df.limit(0).write.jdbc(url, "nothing")
    assert database.read_table(spark, url, "nothing", "k", 4).count() == 0


def test_rows_are_replaced_by_key(spark, url):
    schema = "entity int, dt string, v double"
    first = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0), (None, "a", 4.0)], schema)
    assert not database.table_exists(spark, url, "panel")
    database.replace_rows(first, url, "panel", ["entity", "dt"])
    assert database.table_exists(spark, url, "panel")
    more = spark.createDataFrame([(1, "b", 20.0), (3, "a", 30.0), (None, "a", 40.0)], schema)
    for _ in range(2):  # the same rows again change nothing
        database.replace_rows(more, url, "panel", ["entity", "dt"])
        got = sorted(map(tuple, database.read_table(spark, url, "panel", "v", 3).collect()), key=str)
        assert got == sorted([(1, "a", 1.0), (2, "a", 3.0), (1, "b", 20.0), (3, "a", 30.0), (None, "a", 40.0)], key=str)
    assert not database.table_exists(spark, url, "panel_staging")
    with pytest.raises(ValueError, match="unique"):
        database.replace_rows(more.unionByName(more), url, "panel", ["entity", "dt"])
    # a write that fails leaves the table as it was
    with pytest.raises(Exception):
        database.replace_rows(more.withColumn("other", F.lit(1)), url, "panel", ["entity", "dt"])
    assert sorted(map(tuple, database.read_table(spark, url, "panel", "v", 3).collect()), key=str) == got
