"""Whole results against plain versions of the same method."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from veilframe.llm import graph_search, hmm, labelled, packing, pivot_search, quality, toxicity
from veilframe.llm.text import words
from veilframe.llm.vectors import usable


def test_hmm_query_score(spark, monkeypatch):
    """The score of the query is the model's probability of the symbols times the class shares of the words."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.5, rng.integers(1, 400)) % 300) for _ in range(60)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = {}
    plain, encode = hmm.baum_welch, hmm.encode
    monkeypatch.setattr(hmm, "baum_welch", lambda *a: kept.setdefault("m", plain(*a)))
    monkeypatch.setattr(hmm, "encode", lambda docs, v, *a: encode(docs, kept.setdefault("v", v), *a))
    got = {r.doc_id: r for r in hmm.score(df, states=3, rounds=2, head=20, near=40).collect()}
    m, v = kept["m"], kept["v"].value
    counts = Counter(w for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2 for w in words((t or "").encode()))
    order = sorted(counts, key=lambda w: (-counts[w], w))
    head = set(order[: v.head])
    sizes, kinds = Counter(), Counter()
    for w in order:
        if w not in head:
            sizes[hmm.word_class(w, v.classes)] += counts[w]
            kinds[hmm.word_class(w, v.classes)] += 1
    for i, t in enumerate(texts):
        log, alpha = 0.0, None
        for w in [*words((t or "").encode()), None]:
            if w is None:
                s = 0
            elif w in head:
                s = 1 + order.index(w)
            else:
                c = hmm.word_class(w, v.classes)
                s = 1 + v.head + c
                log += math.log10((counts[w] + 1) / (sizes[c] + kinds[c] + 1))
            alpha = (m.start if alpha is None else alpha @ m.move) * m.emit[s]
            log += math.log10(alpha.sum())
            alpha = alpha / alpha.sum()
        assert abs(got[i].score - log) < 1e-6 * max(1, abs(log))


def test_hmm_counts_every_move():
    rng = np.random.default_rng(2)
    k, s, n = 3, 7, 1000
    m = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(s), k).T)
    ids = rng.integers(0, s, n).astype(np.uint16)
    rows = [ids[max(i - 1, 0) : i + hmm.SEGMENT] for i in range(0, n, hmm.SEGMENT)]
    total = (np.zeros(k), np.zeros(k), np.zeros((k, k)), np.zeros((s, k)))
    hmm.expected_counts(rows, np.arange(len(rows)) == 0, m, total)
    assert abs(total[2].sum() - (n - 1)) < 1e-6 and np.allclose(total[3].sum(1), np.bincount(ids, minlength=s))


def test_quality_equals_plain_ridge_and_isotonic(spark):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(rng.choice(["ab", "Cd.", "ef,", "$$|", "12"], rng.integers(1, 60), p=[0.5, 0.2, 0.1, 0.1, 0.1])), int(rng.integers(0, 2))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int").repartition(3)
    labels = docs.select("doc_id", F.col("y").alias("quality"))
    got = {r.doc_id: r.score for r in quality.score_quality(docs.drop("y"), labels).collect()}
    sample = labelled.training_texts(docs, labels, "quality", quality.MOD, quality.HELD).collect()
    assert {r.doc_id for r in sample} == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 != 0}
    x, y, fold = np.array([quality.statistics(r.t) for r in sample]), np.array([r.label for r in sample], float), np.array([r.fold for r in sample])
    mean, scale = x.mean(0), x.std(0) + 1e-6
    r = np.random.default_rng(quality.SEED)
    w = r.normal(0, np.sqrt(1 / x.shape[1]), (x.shape[1], quality.FEATURES))
    b = r.uniform(0, 2 * np.pi, quality.FEATURES)

    def phi(a):
        z = np.clip((a - mean) / scale, -6, 6)
        return np.hstack([np.cos(z @ w + b) * np.sqrt(2 / quality.FEATURES), np.ones((len(a), 1))])

    p = phi(x[fold == 0])
    coefficients = np.linalg.lstsq(np.vstack([p, np.sqrt(quality.RIDGE) * np.eye(p.shape[1])]), np.concatenate([y[fold == 0], np.zeros(p.shape[1])]), rcond=None)[0]
    raw, target = phi(x[fold == 1]) @ coefficients, y[fold == 1]
    order = np.argsort(raw)
    raw, target = raw[order], target[order]
    n = len(raw)
    fitted = np.array([max(min(target[i : j + 1].mean() for j in range(k, n)) for i in range(k + 1)) for k in range(n)])  # the min-max formula
    blocks = [list(g) for _, g in itertools.groupby(range(n), key=lambda k: round(fitted[k], 9))]
    knots = np.array([raw[g].mean() for g in blocks]), np.array([fitted[g[0]] for g in blocks])
    for i, t, _ in rows:
        s = float((phi(quality.statistics(t.encode())[None]) @ coefficients)[0])
        assert abs(got[i] - (0.999 * np.interp(s, *knots) + 0.001 / (1 + np.exp(-s)))) < 1e-5


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(7)
    model = toxicity.letter_model(rng.integers(0, 50, (toxicity.SYMBOLS,) * 3).astype(float))
    for token in ("1d10t", "a$$", "s.t-0p", "l|0*e", "aab", "3", "x+!"):
        best = -math.inf
        for path in itertools.product(*toxicity.lattice(token)):
            letters, score, a, b = "".join(c for c, _ in path), sum(cost for _, cost in path), 0, 0
            for c in letters:
                score += model[a, b, toxicity.symbol(c)] - math.log(1 / 12)
                a, b = b, toxicity.symbol(c)
            score += model[a, b, 0] - math.log(1 / 12)
            if score > best + 1e-12:
                best, want = score, letters
        assert toxicity.decode(token, model) == want, token


def test_toxic_weights_equal_a_plain_count(spark):
    rng = np.random.default_rng(9)
    vocabulary = [f"{a}{b}rt" for a in "bcdfg" for b in "aeiou"]
    rows = []
    for i in range(240):
        w = list(rng.choice(vocabulary, 30))
        if i % 3 == 0:
            for _ in range(3):
                w[rng.integers(1, 30)] = "idiot"
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    scorer = toxicity.fit(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    sample = [r for r in labelled.training_texts(docs, docs.select("doc_id", "toxic"), "toxic", toxicity.MOD, toxicity.HELD).collect() if r.fold == 0]
    n0, n1 = sum(r.label == 0 for r in sample), sum(r.label == 1 for r in sample)
    before, toxic, clean = {}, Counter(), Counter()
    for r in sample:
        w = r.t.decode().split()
        (toxic if r.label else clean).update({*w})
        if r.label:
            for x, y in zip(["", *w], w):
                before.setdefault(y, set()).add(x)
    for w in {"idiot", *vocabulary}:
        contexts = min(len(before.get(w, ())), toxic[w])
        weight = math.log((max(0, contexts - toxicity.CAUTION * math.sqrt(contexts)) + 0.1) / (n1 + 1)) - math.log((clean[w] + 0.5) / (n0 + 1))
        assert abs(scorer.weights.get(w, 0.0) - (weight if contexts >= 3 and weight > 1 else 0.0)) < 1e-9
    assert scorer.weights["idiot"] > 1


def test_packing_takes_the_cheapest_sequence():
    lengths = np.random.default_rng(3).integers(1, 300, 200)
    got = packing.balanced(lengths, 1024)
    n_seq = -(-int(lengths.sum()) // 1024)
    room, cost, at = [1024] * n_seq, [0.0] * n_seq, iter(got)
    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [s for s in range(n_seq) if room[s] >= lengths[piece]]
        parts = [(min(fits, key=lambda s: cost[s]), int(lengths[piece]))] if fits else None
        left = int(lengths[piece])
        while left:
            p, _, length, s, offset = next(at)
            assert p == piece and offset == 1024 - room[s] and (s, length) in (parts or [(max(range(n_seq), key=lambda s: room[s]), min(left, max(room)))])
            room[s] -= length
            cost[s] += packing.LINEAR * length + packing.QUADRATIC * length * length
            left -= length


def test_packing_does_not_follow_the_input_split(spark):
    rows = [(None if i % 2 else i % 9, "word " * (i % 50)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (sorted(map(str, packing.pack(docs.repartition(n), capacity=128).collect())) for n in (2, 7))
    assert a == b


def test_one_huge_vector_spoils_nothing(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 8)) * np.exp(rng.normal(size=(600, 1)))
    x[0] = 1e6
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    v = usable(df, zero=False)
    got = {}
    for r in graph_search.search(v, v.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    s = x @ x.T
    hits = 0
    for q in range(0, 600, 20):
        near = [j for j in np.argsort(-s[q], kind="stable") if j != q][:20]
        hits += len(set(near) & set(got[q]))
        assert len(got[q]) == 20 and all(abs(got[q][j] - s[q, j]) <= 1e-9 * abs(s[q, j]) for j in got[q])
    assert hits >= 0.9 * 20 * 30


def test_doubles_keep_their_precision(spark):
    rng = np.random.default_rng(11)
    x = rng.integers(-4000, 4000, (200, 4)) / 1024 + rng.choice([-1e-12, 0], (200, 4))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(900, [1e39, 0.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    v = usable(df, zero=True)
    assert v.count() == 201
    small = v.where("vec_id < 900")
    whole = np.floor(1024 * x).astype(np.int64)
    s = whole @ whole.T
    for r in pivot_search.search(small, small.where("vec_id = 100")).collect():
        assert r.score == s[100, r.vec_id]
