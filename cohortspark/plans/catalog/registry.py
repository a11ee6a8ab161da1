"""Query registry and the shared stand-in cohorts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def r6(col: Column | str, name: str | None = None) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    out = F.round(col, 6) + F.lit(0.0)  # no negative zero
    return out.alias(name) if name else out


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    """Every column but ``keep`` rounded to six places."""
    return df.select(*keep, *[r6(F.col(f"`{c}`"), c) for c in df.columns if c not in keep])


def bigint(col: Column | str, name: str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("bigint").alias(name)


def study_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the region of their customer as the study."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region")
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus", "r_name")
    )


STUDY_SQL = """
study AS (
  SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice, o_orderstatus, r_name
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""


def key_sql(column: str, seed: int = 42) -> str:
    """The seeded order key of a column, as hex text."""
    return f"substr(md5(concat('{seed}:', cast({column} as varchar))), 1, 15)"
