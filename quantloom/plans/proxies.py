"""The driver's star tables read as scored observations, in Spark and in SQL.

A line item is an observation (peak group) of a part (entity) in a run (line status); returned items are
decoys, accepted ones carry signal; discount and tax are error probabilities.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.runtime import table

#: Columns that make an observation unique, for ties.
TIES = ("l_orderkey", "l_linenumber", "l_suppkey")

OBSERVATIONS_SQL = """SELECT l_partkey AS entity, l_linestatus AS run, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS decoy,
 l_extendedprice + CASE WHEN l_returnflag = 'A' THEN 10000.0 ELSE 0.0 END AS score, round(l_discount * 10, 4) AS pep, round(l_tax * 10, 4) AS pep1,
 concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS obs, l_orderkey, l_linenumber, l_suppkey, l_quantity AS quantity, l_extendedprice AS intensity FROM lineitem"""


def observations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("entity"),
        F.col("l_linestatus").alias("run"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("decoy"),
        (F.col("l_extendedprice") + F.when(F.col("l_returnflag") == "A", 10000.0).otherwise(0.0)).alias("score"),
        F.round(F.col("l_discount") * 10, 4).alias("pep"),
        F.round(F.col("l_tax") * 10, 4).alias("pep1"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("obs"),
        *TIES,
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("intensity"),
    )


def rounded(df: DataFrame, digits: int = 9, keep: Sequence[str] = ()) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def rounded_sql(columns: Sequence[str], digits: int = 9) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)
