"""Database tables: parallel reads by ranges of a column, and writes that replace rows by key."""

from __future__ import annotations

import math
from collections.abc import Sequence
from contextlib import contextmanager
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession


def _quote(spark: SparkSession, url: str, name: str) -> str:
    return spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(name)


@contextmanager
def _connection(spark: SparkSession, url: str, options: dict[str, str]):
    """One connection of the driver, committed as a whole or not at all."""
    properties = spark._jvm.java.util.Properties()
    for k, v in options.items():
        properties.setProperty(k, v)
    c = spark._jvm.java.sql.DriverManager.getConnection(url, properties)
    try:
        c.setAutoCommit(False)
        yield c
        c.commit()
    except BaseException:
        c.rollback()
        raise
    finally:
        c.close()


def table_exists(spark: SparkSession, url: str, name: str, **options: str) -> bool:
    with _connection(spark, url, options) as c:
        for spelled in {name, name.upper(), name.lower()}:
            if c.getMetaData().getTables(None, None, spelled, None).next():
                return True
        return False


def read_table(spark: SparkSession, url: str, name: str, column: str, parts: int, lower=None, upper=None, **options: str) -> DataFrame:
    """A table as so many reads of ranges of a number, date or timestamp column; the bounds are asked from the database
    where none are given. Rows outside the bounds, or without a value, are read with the first or last range."""
    if lower is None or upper is None:
        q = _quote(spark, url, column)
        ends = spark.read.jdbc(url, f"(SELECT MIN({q}) AS a, MAX({q}) AS b FROM {name}) ends", properties=options).first()
        lower, upper = (ends[0] if lower is None else lower), (ends[1] if upper is None else upper)
    if lower is None:  # no values at all
        return spark.read.jdbc(url, name, properties=options)
    if isinstance(lower, (float, Decimal)) or isinstance(upper, (float, Decimal)):
        lower, upper = math.floor(lower), math.ceil(upper)
    return spark.read.jdbc(url, name, column=column, lowerBound=str(lower), upperBound=str(upper), numPartitions=parts, properties=options)


def replace_rows(df: DataFrame, url: str, name: str, keys: Sequence[str], key_length: int = 255, **options: str) -> None:
    """Rows of a table with the keys of df are replaced by those of df, others stay; a table that isn't there is made.

    Executors write a staging table; then one transaction of the database deletes and inserts, so a reader sees the rows
    before or after and a job that fails leaves the table as it was. Keys may be null; a key twice in df is an error. Keys that are texts are made as
    varchar(key_length), as databases don't compare unbounded texts."""
    spark = df.sparkSession
    if df.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError(f"keys {list(keys)} aren't unique")
    texts = [k for k in keys if df.schema[k].dataType.typeName() == "string"]
    writer = df.write.option("createTableColumnTypes", ", ".join(f"`{k}` VARCHAR({key_length})" for k in texts)) if texts else df.write
    if not table_exists(spark, url, name, **options):
        writer.jdbc(url, name, mode="append", properties=options)
        return
    staging, q = f"{name}_staging", lambda c: _quote(spark, url, c)
    writer.jdbc(url, staging, mode="overwrite", properties=options)
    same = " AND ".join(f"(s.{q(k)} = {name}.{q(k)} OR (s.{q(k)} IS NULL AND {name}.{q(k)} IS NULL))" for k in keys)
    columns = ", ".join(q(c) for c in df.columns)
    with _connection(spark, url, options) as c:
        s = c.createStatement()
        s.executeUpdate(f"DELETE FROM {name} WHERE EXISTS (SELECT 1 FROM {staging} s WHERE {same})")
        s.executeUpdate(f"INSERT INTO {name} ({columns}) SELECT {columns} FROM {staging}")
        s.executeUpdate(f"DROP TABLE {staging}")

