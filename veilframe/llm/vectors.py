"""Vectors that take part in a search, packed in blocks of bounded size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK, QUERY_BLOCK = 4096, 512


def usable(rows: DataFrame, zero: bool) -> DataFrame:
    """(vec_id, v, dim) of the rows with an id and a vector without null or non-finite components; repeated rows once.

    Vectors of zero length count as null. ``zero``: whether zero vectors take part. Floats stay floats, all other numbers become doubles.
    """
    kind = "float" if isinstance(rows.schema["embedding"].dataType.elementType, T.FloatType) else "double"
    v = F.col("embedding").cast(f"array<{kind}>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")).cast(kind)))
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~bad)
    if not zero:
        kept = kept.where(F.exists("v", lambda x: x != 0))
    return kept.withColumn("dim", F.size("v")).dropDuplicates(["vec_id", "v"])


def element(vectors: DataFrame) -> type:
    """The type of the components of the column ``v``."""
    return np.float32 if isinstance(vectors.schema["v"].dataType.elementType, T.FloatType) else np.float64


def query_blocks(queries: DataFrame, size: int = QUERY_BLOCK) -> DataFrame:
    """(dim, block, q) with q the block's (vec_id, v); about ``size`` queries a block."""
    n = max(1, -(-queries.count() // size))
    return queries.groupBy("dim", F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias("block")).agg(F.collect_list(F.struct("vec_id", "v")).alias("q"))


def against(blocks: DataFrame, index: DataFrame) -> DataFrame:
    """Every query block beside every row of ``index`` of its dimension; ``index`` has dim and part, numbered from 0 for each dim."""
    parts = index.groupBy("dim").agg(F.max("part").alias("last"))
    sent = blocks.join(F.broadcast(parts), "dim").select("dim", "block", "q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("part"))
    return sent.join(index, ["dim", "part"])


def matrix(column, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and vectors of an Arrow list of (vec_id, v)."""
    flat = column.values if hasattr(column, "values") else column
    return flat.field("vec_id").to_numpy(zero_copy_only=False), flat.field("v").flatten().to_numpy().reshape(-1, dim)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, from (query_id, vec_id, score): highest score first, ties to the smaller id."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
