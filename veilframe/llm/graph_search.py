"""Approximate nearest neighbours by largest inner product, over robust-pruned directed graphs.

The vectors are dealt by hash into shards of about ``BLOCK`` distinct vectors of like norm (within a factor of 2). In each shard a graph is built in batches of
doubling size: a greedy search from the entry proposes neighbours, relaxed pruning keeps a neighbour only if no kept one is
nearer to it by the factor ``ALPHA``, and backward edges are pruned alike. A query searches every shard with a beam and the
shards' results are merged. Largest inner product becomes nearest distance between unit vectors by one more component,
``sqrt(1 - |x|^2 / max|x|^2)``, with the largest norm of the shard, so that a few huge vectors do not make all others look
alike. Of the backward edges that a batch gives one node, pruning sees the first ``3 * DEGREE``.

Every vector is indexed. Equal vectors are one node with their smallest ``k + 1`` ids, which is all that a result of k can
hold of them; they are cut down before the shuffle, so a vector that fills the table costs no more than a rare one.
Queries go in blocks, one (block, shard) at a time. Index rows and blocks have bounded size; nothing is broadcast but one
number a dimension. Scores are inner products of the original vectors in double precision.

Defined results: rows without id, null, empty or zero vectors and those with null or non-finite components take no part;
repeated rows count once; vectors of another length than the query's are not its candidates; fewer than k candidates are
all returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.functions.match import bound
from veilframe.llm.tables import table, written
from veilframe.llm.vectors import BLOCK, against, best, element, matrix, query_blocks, usable

K, EVERY, DEGREE, BEAM, ALPHA, WIDE = 20, 20, 24, 64, 1.2, 4


def beam_search(points: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ``beam`` nearest nodes met, nearest first, and their squared distances (unit vectors); -1 where fewer.

    Each step expands the ``WIDE`` nearest unexpanded nodes of every beam, until no beam has one.
    """
    n_q, n = len(queries), len(points)
    beam = min(beam, n)
    ids = np.full((n_q, beam), -1)
    dist = np.full((n_q, beam), np.inf, np.float32)
    done = np.ones((n_q, beam), bool)
    ids[:, 0], done[:, 0] = entry, False
    dist[:, 0] = 2 - 2 * (queries @ points[entry])
    met = np.zeros((n_q, n + 1), bool)
    met[:, entry] = met[:, n] = True
    live = np.arange(n_q)
    while len(live):
        open_ = np.where(done[live], np.inf, dist[live])
        pick = np.argsort(open_, 1)[:, :WIDE]
        chosen = np.take_along_axis(ids[live], pick, 1)
        valid = np.isfinite(np.take_along_axis(open_, pick, 1))
        flags = done[live]
        np.put_along_axis(flags, pick, True, 1)
        done[live] = flags
        near = np.where(valid[:, :, None], links[np.maximum(chosen, 0)], -1).reshape(len(live), -1)
        near = np.where(near < 0, n, near)
        near.sort(1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        fresh = ~met[live[:, None], near]
        near = np.where(fresh, near, n)
        met[live[:, None], near] = True
        d = np.full(near.shape, np.inf, np.float32)
        r, c = np.nonzero(fresh)
        d[r, c] = 2 - 2 * np.einsum("ij,ij->i", queries[live[r]], points[near[r, c]])
        all_d = np.concatenate([dist[live], d], 1)
        keep = np.argsort(all_d, 1, kind="stable")[:, :beam]
        dist[live] = np.take_along_axis(all_d, keep, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(fresh, near, -1)], 1), keep, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], ~fresh], 1), keep, 1)
        live = live[(~done[live]).any(1)]
    return ids, dist


def robust_prune(points: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` diverse neighbours for each node from its candidates (-1: none), padded by -1."""
    out = np.full((len(nodes), degree), -1)
    for at in range(0, len(nodes), 512):
        node, cand = nodes[at : at + 512], candidates[at : at + 512].copy()
        cand[cand == node[:, None]] = -1
        cand.sort(1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        x = points[np.maximum(cand, 0)]
        own = 2 - 2 * np.einsum("bcd,bd->bc", x, points[node])
        between = 2 - 2 * (x @ x.transpose(0, 2, 1))
        alive = np.where(cand < 0, np.inf, own)
        rows = np.arange(len(node))
        for r in range(degree):
            p = alive.argmin(1)
            some = np.isfinite(alive[rows, p])
            if not some.any():
                break
            out[at + rows[some], r] = cand[rows[some], p[some]]
            gone = alpha * alpha * between[rows, p] <= own
            alive[gone & some[:, None]] = np.inf
            alive[rows, p] = np.inf
    return out


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """Adjacency (n, degree), padded by -1, and the entry: the node nearest to the mean."""
    n = len(points)
    links = np.full((n, degree), -1)
    entry = int((points @ points.mean(0)).argmax())
    order = np.random.default_rng(7).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    at = 1
    while at < n:
        batch = order[at : at + min(at, 1024)]
        found, _ = beam_search(points, links, points[batch], entry, beam)
        if len(batch) > 1:
            found = np.concatenate([found, np.tile(np.resize(batch, 8), (len(batch), 1))], 1)
        links[batch] = robust_prune(points, batch, found, degree, alpha)
        source = np.repeat(batch, degree)
        target = links[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        hit, start, size = np.unique(target, return_index=True, return_counts=True)
        room = 3 * degree
        back = np.full((len(hit), room), -1)
        slot = np.arange(len(target)) - np.repeat(start, size)
        row = np.repeat(np.arange(len(hit)), size)
        use = slot < room
        back[row[use], slot[use]] = source[use]
        links[hit] = robust_prune(points, hit, np.concatenate([links[hit], back], 1), degree, alpha)
        at += len(batch)
    return links, entry


def unit(v: np.ndarray, largest: float) -> np.ndarray:
    """Vectors scaled by the largest norm, with the component that makes them unit vectors."""
    x = v.astype(np.float64) / largest
    return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))], 1).astype(np.float32)


def indexed(vectors: DataFrame, k: int) -> DataFrame:
    """(dim, part, n, ids, v, links, entry): one row a shard, written to the shared folder."""
    copies = Window.partitionBy("v").orderBy("vec_id")
    few = vectors.withColumn("r", F.row_number().over(copies)).where(F.col("r") <= k + 1)
    distinct = written(few.groupBy("v").agg(F.first("dim").alias("dim"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "ann-distinct")
    top = F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x).cast("double")))
    norm = bound(top, lambda t: t * F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / t) * (x / t))))  # neither overflows nor vanishes
    normed = distinct.select("*", bound(norm, lambda n: F.struct(n.alias("norm"), F.floor(F.log2(n) + 0.5).alias("band"))).alias("n")).select("dim", "ids", "v", "n.norm", "n.band")
    normed = written(normed, "ann-normed")
    sizes = normed.groupBy("dim", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("m"), F.max("norm").alias("largest"))  # a row for each power of 2
    before = Window.partitionBy("dim").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0)))
    dealt = normed.join(F.broadcast(sizes), ["dim", "band"]).withColumn("part", F.col("before") + F.pmod(F.xxhash64("v"), F.col("m"))).drop("norm", "band", "before")
    kind = element(vectors)

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ids", key=lambda s: s.map(lambda x: x[0])).reset_index(drop=True)
        v = np.stack(pdf["v"].to_numpy()).astype(kind)
        links, entry = build(unit(v, float(pdf["largest"].iloc[0])))
        return pd.DataFrame({"dim": [int(pdf["dim"].iloc[0])], "part": [int(pdf["part"].iloc[0])], "largest": [float(pdf["largest"].iloc[0])], "ids": [[list(map(int, x)) for x in pdf["ids"]]], "v": [v.tobytes()], "links": [links.astype(np.int32).tobytes()], "entry": [entry]})

    out = dealt.groupBy("dim", "part").applyInPandas(shard, "dim int, part long, largest double, ids array<array<long>>, v binary, links binary, entry int")
    return written(out, "ann-index")


def search(vectors: DataFrame, queries: DataFrame, k: int = K, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` found nearest to each query, itself excluded. Both have (vec_id, v, dim)."""
    index, kind = indexed(vectors, k), element(vectors)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                dim = b.column("dim")[i].as_py()
                q_ids, q = matrix(b.column("q")[i], dim)
                v = np.frombuffer(b.column("v")[i].as_py(), kind).reshape(-1, dim)
                links = np.frombuffer(b.column("links")[i].as_py(), np.int32).reshape(len(v), -1)
                points = unit(v, b.column("largest")[i].as_py())
                scaled = q.astype(np.float64)
                scaled /= np.abs(scaled).max(1, keepdims=True)
                scaled = np.concatenate([scaled / np.linalg.norm(scaled, axis=1, keepdims=True), np.zeros((len(q), 1))], 1).astype(np.float32)
                found, _ = beam_search(points, links, scaled, b.column("entry")[i].as_py(), beam)
                ids = b.column("ids")[i].as_py()
                out: list[list] = [[], [], []]
                for row, (qid, x) in enumerate(zip(q_ids.tolist(), q.astype(np.float64))):
                    near = found[row][found[row] >= 0]
                    scores = v[near].astype(np.float64) @ x
                    near = [(s, c) for s, node in sorted(zip(-scores, near))[: k + 1] for c in ids[node] if c != qid]
                    near = sorted(near)[:k]
                    out[0] += [qid] * len(near)
                    out[1] += [c for _, c in near]
                    out[2] += [-s for s, _ in near]
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    return best(against(query_blocks(queries), index).mapInArrow(look, "query_id long, vec_id long, score double"), k)


def op3_ann_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), zero=False)
    return search(vectors, vectors.where(F.col("vec_id") % EVERY == 0))
