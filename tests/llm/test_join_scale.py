"""What keeps op5's work in proportion to its input: texts are hashed once, and heads cost little with many fragments."""

import numpy as np
import pyarrow as pa

from veilframe.llm import ngram_join
from test_text_ops import brute, near_copies


def test_survey_reads_a_sample_only(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = near_copies(rng, 40, 4, 2) + near_copies(rng, 2, 60, 2) + ["", None, "a b", "A b"]
    monkeypatch.setattr(ngram_join, "SAMPLE", 50, raising=False)
    read, plain = [], ngram_join.survey
    monkeypatch.setattr(ngram_join, "survey", lambda docs: read.append(docs.count()) or plain(docs))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)
    assert sum(read) < len(texts) / 2


def test_heads_cost_little_with_many_fragments(spark):
    rng = np.random.default_rng(6)
    words = 400
    texts = [" ".join(map(str, rng.integers(0, 10**6, words + 4))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string").selectExpr("doc_id as row", "doc_id", "cast(t as binary) as t").coalesce(1)
    hot = spark.sparkContext.broadcast(np.zeros(0, np.uint64))
    blobs = [bytes(r.blob) for r in ngram_join.fragmented(docs, hot, list(range(600))).where("blob is not null").collect()]
    assert len(blobs) == 600
    assert sum(len(pa.compress(b, "lz4_raw")) for b in blobs) < 14 * words * len(texts)


def test_packed_blobs_give_back_what_went_in():
    rng = np.random.default_rng(7)
    for m in (0, 1, 3000):
        doc = rng.integers(0, 70_000, m)
        code = np.sort(rng.integers(0, 2**47, m).astype(np.uint64))
        last = rng.random(m) < 0.3
        node, n = rng.integers(-(2**62), 2**62, 70_000), rng.integers(1, 9, 70_000)
        target = np.mod(node, 67_000)[doc]
        to, blobs = ngram_join.packed(target, doc, code, node, n, last=last)
        assert to.tolist() == np.unique(target).tolist()
        got = []
        for t, blob in zip(to, blobs):
            head, _, codes = ngram_join.unpacked([blob], 8)
            ends = np.cumsum(head["k"])
            for i, end in enumerate(ends):
                k, h = int(head["k"][i]), int(head["h"][i])
                got += [(t, head["node"][i], head["n"][i], j >= k - h, c) for j, c in enumerate(codes[end - k : end].tolist())]
        assert sorted(got) == sorted(zip(target, node[doc], n[doc], last, code.tolist()))


def test_distinct_and_numbered_equal_numpy():
    from veilframe.llm.text import distinct

    rng = np.random.default_rng(8)
    for x in (rng.integers(0, 50, 400).astype(np.uint64), np.zeros(0, np.uint64), np.full(3, 2**63, np.uint64)):
        assert distinct(x).tolist() == np.unique(x).tolist()
        values, first, number = ngram_join.numbered(x)
        assert values.tolist() == np.unique(x).tolist() and (values[number] == x).all() and (x[first] == values).all()


def test_overlaps_between_lists_by_both_ways(monkeypatch):
    rng = np.random.default_rng(9)
    for values, slab in ((300, 4096), (300, 64), (10**6, 4096)):
        monkeypatch.setattr(ngram_join, "SLAB", slab)
        lists = [[rng.choice(values, rng.integers(1, 200), replace=False).tolist() for _ in range(m)] for m in (30, 41, 2)]
        left, right = (pa.array(x, pa.list_(pa.int64())) for x in (lists[2] + lists[0], lists[1]))
        got = [g.tolist() for g in ngram_join.overlaps_between(left[2:], right)]
        assert got == [[len(set(a) & set(b)) for b in lists[1]] for a in lists[0]]
