import duckdb
import numpy as np
import pytest

from veilframe.llm import graph_search, pivot_search
from veilframe.llm.vectors import usable


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(300)]
    rows += [(300 + i, rows[5][1]) for i in range(60)]  # one vector many times
    rows += [rows[7], (500, None), (501, []), (502, [0.0] * 8), (503, [float("nan")] + [1.0] * 7), (504, [None] + [1.0] * 7), (None, rows[3][1]), (505, [1.0, 2.0])]
    return spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, rank string")


def brute(rows, k, scale):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], float)
    x = np.floor(1024 * x) if scale else x
    s = x @ x.T
    return {int(ids[i]): [(int(ids[j]), s[i, j]) for j in np.lexsort((ids, -np.round(s[i], 9))) if j != i][:k] for i in range(len(ids))}


def test_pivot_search_is_exact(vectors):
    v = usable(vectors, zero=True)
    rows = sorted((r.vec_id, r.v) for r in v.where("dim = 8").collect())
    want = brute(rows, 10, True)
    got = {}
    for r in pivot_search.search(v, v.where("vec_id % 10 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {q: [(i, int(s)) for i, s in want[q]] for q in want if q % 10 == 0}


def test_pivots_skip_candidates():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-1000, 1000, (2000, 4)), rng.integers(9000, 10000, (60, 4))])
    q = x[-1]
    norm = float((x.astype(float) ** 2).sum(1).max())
    far = pivot_search.to_pivots(x, x[:32], norm)
    q_far = np.sqrt(np.maximum(0, float(q @ q) + norm - 2 * (x[:32] @ q)))
    least = np.abs(far - q_far).max(1)
    bound = (float(q @ q) + norm - least**2) / 2 + 1
    assert (bound >= x @ q).all()
    ids, scores, seen = pivot_search.top_k(q, -1, bound, x, np.arange(len(x)), 10)
    assert seen < len(x) and scores.tolist() == sorted(x @ q, reverse=True)[:10]


def test_graph_search_recall_and_ties(vectors):
    v = usable(vectors, zero=False)
    rows = sorted((r.vec_id, r.v) for r in v.where("dim = 8").collect())
    want = brute(rows, 20, False)
    got = {}
    for r in graph_search.search(v, v.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == {q for q in want if q % 20 == 0} and all(len(x) == 20 for x in got.values())
    hits = sum(len(set(got[q]) & {i for i, _ in want[q]}) for q in got)
    assert hits >= 0.9 * 20 * len(got)
    assert got[320] == [i for i, _ in want[320]]  # its 20 nearest are copies: smallest ids first


def test_recall_on_the_table(spark, sf):
    x = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    e = np.stack(x.embedding).astype(float)
    s = e @ e.T
    got = graph_search.op3_ann_pruned_graph(spark, sf).toPandas().groupby("query_id").vec_id.apply(set)
    hits = 0
    for q, found in got.items():
        i = int(np.flatnonzero(x.vec_id == q)[0])
        hits += len(found & {int(x.vec_id[j]) for j in np.argsort(-s[i]) if j != i} & {int(x.vec_id[j]) for j in [j for j in np.argsort(-s[i]) if j != i][:20]})
    assert hits >= 0.9 * 20 * len(got)


def test_pivot_equals_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = sorted(map(tuple, c.execute(pivot_search.OP7_SQL).fetchall()))
    assert sorted(tuple(r) for r in pivot_search.op7_topk_pivot_table(spark, sf).collect()) == want


def test_empty_tables(vectors):
    v = usable(vectors.limit(0), zero=True)
    assert pivot_search.search(v, v).count() == 0 and graph_search.search(v, v).count() == 0
