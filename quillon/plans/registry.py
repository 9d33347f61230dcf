"""Queries by name and their SQL, filled by the modules that catalogue imports."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lambdas are written with arrows here; DuckDB asks for "lambda x:".
LAMBDA = re.compile(r"(?:\((\w+, \w+)\)|\b(\w+)) -> ")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query, and SQL for the same rows where there is some."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = LAMBDA.sub(lambda m: f"lambda {m[1] or m[2]}: ", sql)
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Line items made unique: one per order and line number.
LINES = "lines as (select l_orderkey, l_linenumber, min(l_partkey) as l_partkey, min(l_suppkey) as l_suppkey, min(l_quantity) as l_quantity, min(l_discount) as l_discount from lineitem group by all)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_discount")])
