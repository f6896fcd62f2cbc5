"""Exact top-k inner products by pivot-table elimination.

Vectors are lifted to ``(x, sqrt(M^2 - |x|^2))`` with M the largest norm, queries to ``(q, 0)``; then the largest inner
product is the least distance, ``d^2 = |q|^2 + M^2 - 2 q.x``. The index keeps each vector's distances to ``PIVOTS`` vectors
(those with the smallest hashes, a bounded sample). By the triangle inequality ``max_p |d(q,p) - d(x,p)|`` is at most
d(q,x), which bounds q.x from above. Candidates are evaluated in the order of that bound, in integers, until the bound
falls below the k-th score found (with room for the rounding of the bound): the result is exact, ties included.

Vectors go in blocks of about ``BLOCK`` and queries in blocks of about 512; a pair of blocks is one unit of work with
bounded memory. Broadcast are the pivots alone. Defined results: rows without id, null or empty vectors and those with
null or non-finite components take no part, zero vectors do; repeated rows count once; vectors of another length are no
candidates; components become ``floor(1024 * x)``, and scores must fit 64 bits; fewer than k candidates are all returned;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.tables import table, written
from veilframe.llm.vectors import BLOCK, against, best, matrix, query_blocks, usable

K, EVERY, PIVOTS, STEP, SCALE = 10, 100, 32, 256, 1024.0


def whole(v: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * v.astype(np.float64)).astype(np.int64)


def to_pivots(x: np.ndarray, pivots: np.ndarray, most: float) -> np.ndarray:
    """Distances between lifted vectors and lifted pivots."""
    lift = lambda a: np.sqrt(np.maximum(0.0, most - (a * a).sum(1)))
    x, p = x.astype(np.float64), pivots.astype(np.float64)
    return np.sqrt(np.maximum(0.0, 2 * most - 2 * (x @ p.T + np.outer(lift(x), lift(p)))))


def top_k(q: np.ndarray, q_id: int, bound: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """ids and scores of the k best in a block, and how many candidates were evaluated."""
    order = np.argsort(-bound, kind="stable")
    got_ids, got = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = 0
    while at < len(order):
        if len(got) >= k and bound[order[at]] < got[k - 1]:
            break
        step = order[at : at + STEP]
        at += len(step)
        step = step[ids[step] != q_id]
        got_ids, got = np.concatenate([got_ids, ids[step]]), np.concatenate([got, x[step] @ q])
        keep = np.lexsort((got_ids, -got))[:k]
        got_ids, got = got_ids[keep], got[keep]
    return got_ids, got, at


def indexed(vectors: DataFrame, pivots: int) -> DataFrame:
    """(dim, part, ids, v, table, pivots, most): one row a block, written to the shared folder."""
    vectors = written(vectors, "pivot-vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.floor(x.cast("double") * SCALE).cast("double") * F.floor(x.cast("double") * SCALE))
    sizes = vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("m"), F.max(square).alias("most"))
    chosen = {r.dim: whole(np.array([x.v for x in vectors.where(F.col("dim") == r.dim).select("v", F.xxhash64("v").alias("h")).distinct().orderBy("h").limit(pivots).collect()], np.float64)) for r in sizes.select("dim").collect()}
    shared = vectors.sparkSession.sparkContext.broadcast(chosen)
    dealt = vectors.join(F.broadcast(sizes), "dim").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("m") / BLOCK)))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        dim, most = int(pdf["dim"].iloc[0]), float(pdf["most"].iloc[0])
        x = whole(np.stack(pdf["v"].to_numpy()))
        return pd.DataFrame({"dim": [dim], "part": [int(pdf["part"].iloc[0])], "most": [most], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "x": [x.tobytes()], "table": [to_pivots(x, shared.value[dim], most).tobytes()], "pivots": [shared.value[dim].tobytes()]})

    return written(dealt.groupBy("dim", "part").applyInPandas(block, "dim int, part long, most double, ids binary, x binary, table binary, pivots binary"), "pivot-index")


def search(vectors: DataFrame, queries: DataFrame, k: int = K, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score of the exact ``k`` best of each query, itself excluded. Both have (vec_id, v, dim)."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                dim, most = b.column("dim")[i].as_py(), b.column("most")[i].as_py()
                q_ids, q = matrix(b.column("q")[i], dim)
                q = whole(q)
                ids = np.frombuffer(b.column("ids")[i].as_py(), np.int64)
                x = np.frombuffer(b.column("x")[i].as_py(), np.int64).reshape(-1, dim)
                p = np.frombuffer(b.column("pivots")[i].as_py(), np.int64).reshape(-1, dim)
                far = np.frombuffer(b.column("table")[i].as_py()).reshape(len(x), -1)
                norm = (q.astype(np.float64) ** 2).sum(1)
                q_far = np.sqrt(np.maximum(0.0, norm[:, None] + most - 2 * (q.astype(np.float64) @ p.astype(np.float64).T)))
                out: list[list] = [[], [], []]
                for row, qid in enumerate(q_ids.tolist()):
                    least = np.abs(far - q_far[row]).max(1)
                    bound = (norm[row] + most - least * least) / 2 + 1e-6 * (norm[row] + most) + 1
                    got_ids, got, _ = top_k(q[row], qid, bound, x, ids, k)
                    out[0] += [qid] * len(got)
                    out[1] += got_ids.tolist()
                    out[2] += got.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["query_id", "vec_id", "score"])

    return best(against(query_blocks(queries), indexed(vectors, pivots)).mapInArrow(look, "query_id long, vec_id long, score long"), k)


def op7_topk_pivot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), zero=True)
    return search(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


OP7_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, embedding, list_transform(embedding, lambda x: floor(1024.0 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""
