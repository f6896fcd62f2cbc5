"""Reading the input tables, and written tables that cut a plan's lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.session import materialized as written

__all__ = ["beside", "nested", "partitions", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of an input table, others are left unread; without names, all."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def nested(docs: DataFrame, *more) -> DataFrame:
    """The rows of ``docs`` as one column ``row``, beside others: no name of theirs can clash with ours."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *more)


def beside(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    """A schema whose column ``t`` has made way for another."""
    return T.StructType([f for f in schema if f.name != "t"] + [T.StructField(name, kind)])
