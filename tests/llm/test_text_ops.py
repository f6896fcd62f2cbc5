import collections
import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import chat, hmm, labelled, mixing, ngram_join, packing, quality, tokens, toxicity
from veilframe.llm.components import connected_components
from veilframe.llm.text import RunHasher, words

LONG = "lorem ipsum dolor sit amet " * 30_000
ODD = [
    (1, "The quick brown fox jumps over the lazy dog today", "a"), (1, "The quick brown fox jumps over the lazy dog today", "a"), (2, "THE QUICK brown fox jumps over\tthe lazy dog today", "a"),
    (3, None, None), (4, "", "b"), (5, " \t\n", "b"), (None, "one two three", "b"), (6, "one two three", None), (7, LONG, "c"), (8, "é x y", "é"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, "x", 2.0) for r in ODD], "doc_id long, text string, source string, row int, node string, size double").repartition(3)


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.limit(0)


def test_words_and_shingles():
    assert words("A\x0bb\xa0C É".encode()) == [b"a", "b\xa0c".encode(), "É".encode()]
    h = RunHasher()
    a, b = "a b c d e f g".split(), "x a b c d e f g".split()
    enc = lambda w: [x.encode() for x in w]
    assert set(h.shingles(enc(a))) < set(h.shingles(enc(b))) and len(h.shingles(enc(a))) == 3
    assert len(h.shingles(enc(a[:2]))) == 1 and len(h.shingles([])) == 0
    w = [str(i % 977).encode() for i in range(400_000)]
    assert len(h.shingles(w)) == len({tuple(w[i : i + 5]) for i in range(len(w) - 4)})


# ---- op1 -------------------------------------------------------------------------------------------------------------

def test_hmm_forward_is_exact():
    rng = np.random.default_rng(1)
    k, s = 3, 5
    m = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(s), k).T)
    rows = [rng.integers(0, s, n).astype(np.uint16) for n in (1, 4, 7)]
    for r, got in zip(rows, hmm.log10_forward(rows, m)):
        total = 0.0
        for path in np.ndindex(*[k] * len(r)):
            p = m.start[path[0]] * m.emit[r[0], path[0]]
            for a, b, o in zip(path, path[1:], r[1:]):
                p *= m.move[a, b] * m.emit[o, b]
            total += p
        assert abs(10**got - total) < 1e-12
    total = (np.zeros(k), np.zeros(k), np.zeros((k, k)), np.zeros((s, k)))
    hmm.expected_counts(rows, np.array([True, True, True]), m, total)
    assert abs(total[3].sum() - 12) < 1e-9 and abs(total[2].sum() - 9) < 1e-9 and abs(total[0].sum() - 3) < 1e-9


def test_hmm_scores(odd, nothing):
    got = {(r.doc_id, r.n_tokens): r for r in hmm.score(odd, rounds=2).collect()}
    counts, docs = collections.Counter(), 0
    for d, t, _ in ODD:
        if zlib.crc32(b"" if d is None else str(d).encode()) % 7 != 2:
            counts.update(words((t or "").encode()))
            docs += 1
    n, v = sum(counts.values()) + docs, len(counts) + 1
    for d, t, _ in ODD:
        w = words((t or "").encode())
        r = got[d, len(w) + 1]
        want = sum(np.log10((counts[x] + 1) / (n + v + 1)) for x in w) + np.log10((docs + 1) / (n + v + 1))
        assert r.train_tokens == n and abs(r.base_score - want) < 1e-6 * abs(want) and r.n_known == sum(counts[x] > 0 for x in w) + 1 and r.score < 0
    assert hmm.score(odd, rounds=1).count() == len(ODD) and hmm.score(nothing, rounds=1).count() == 0


def test_hmm_small_tables_agree(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a = hmm.score(docs, rounds=1, head=50, near=100).agg(F.sum("base_score"), F.sum("n_known")).first()
    b = hmm.score(docs, rounds=1).agg(F.sum("base_score"), F.sum("n_known")).first()
    assert abs(a[0] - b[0]) < 1e-6 * abs(b[0]) and a[1] == b[1]


# ---- op2 -------------------------------------------------------------------------------------------------------------

def test_chat_round_trip(spark):
    turns = [
        (1, 0, "system", "be <|im_end|> \\ good"), (1, 1, "user", None), (1, 2, "assistant", "<|im_start|>assistant\nx\\|<|"), (1, 3, "user", "more"), (2, 0, "user", "alone"), (None, 0, "assistant", "é😀"),
        (3, None, "as\nsistant", "role"), (3, None, "as\nsistant", "role"), (3, 1, None, "t"), (3, 2, "assistant", ""),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("head", F.lit(1))
    got = {r.conv_id: r for r in chat.digests(chat.prefix_target_examples(df)).collect()}
    for c in {t[0] for t in turns}:
        own = sorted(((t[1] is not None, t[1] or 0), t[2] or "", t[3] or "") for t in turns if t[0] == c)
        said = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.prefix_target_examples(df.limit(0))).count() == 0
    e = chat.prefix_target_examples(df).where("conv_id = 1 and loss_end > loss_start").first()
    assert e.text[: e.loss_start].endswith("<|im_start|>assistant\n") and e.text[e.loss_end :] == "<|im_end|>\n"


def test_chat_equals_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    want = {r[0]: r[1:] for r in c.execute(chat.OP2_SQL).fetchall()}
    got = {r[0]: tuple(r[1:]) for r in chat.op2_chat_prefix_targets(spark, sf).collect()}
    assert got == want and -1 in got


# ---- op4, op8 --------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


TRICKY = ["", "a", "x\n\n\ny", "\n", " \n \n", "héllo wörld\r\n<|endoftext|>!", "don't  stop\n\t\tnow  ", "日本語\n😀😀", "a" * 3000, LONG[:20_000]]


def test_ids_equal_tokenizers(tokenizer):
    enc = tokens.encoder(tokens.default_path())
    for t in TRICKY:
        e = tokenizer.encode(t, add_special_tokens=False)
        assert enc(t).tolist() == e.ids and enc.width[enc(t)].sum() == len(t.encode())


def test_sections_by_offsets(tokenizer):
    enc = tokens.encoder(tokens.default_path())
    for t in TRICKY:
        start, end, n, crossing = tokens.sections(t, enc)
        lines = t.splitlines(keepends=True) if "\r" not in t else [x + "\n" for x in t.split("\n")[:-1]] + [t.split("\n")[-1]]
        lines = [x for x in lines if x] or [""]
        assert [t[a:b] for a, b in zip(start, end)] == lines and n.sum() == len(enc(t)) and (crossing <= n).all()
        ends = np.cumsum([len(x.encode()) for x in lines])
        want, at = [0] * len(lines), 0
        for w in enc.width[enc(t)]:
            share = [max(0, min(at + w, e) - max(at, e - len(x.encode()))) for e, x in zip(ends, lines)]
            want[int(np.argmax(share))] += 1
            at += w
        assert n.tolist() == want


def test_section_counts_keep_every_row(odd, nothing):
    assert tokens.section_counts(odd).select("doc_id").distinct().count() == 9 and tokens.section_counts(nothing).count() == 0


def check_packing(rows, texts, capacity, tokenizer):
    by_doc = collections.defaultdict(list)
    by_seq = collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for s in by_seq.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [0, *np.cumsum([r.length for r in s])[:-1]] and sum(r.length for r in s) <= capacity
    for d, own in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[d], add_special_tokens=False).ids, 0], "<u4")
        copies = sum(r.start == 0 for r in own)
        assert sum(r.length for r in own) == copies * len(ids)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids)
    return by_seq


def test_packing(odd, nothing, tokenizer):
    rows = packing.pack(odd, capacity=64, window=5).collect()
    check_packing(rows, {d: t or "" for d, t, _ in ODD}, 64, tokenizer)
    assert packing.pack(nothing).count() == 0


def test_balanced_fills_all_but_one():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 1024, 500)
    got = packing.balanced(lengths, 1024)
    used = collections.Counter()
    for piece, start, length, s, offset in got:
        assert offset == used[s]
        used[s] += length
    assert sum(used.values()) == lengths.sum() and max(used.values()) <= 1024 and len(used) == -(-lengths.sum() // 1024)


# ---- op5 -------------------------------------------------------------------------------------------------------------

def brute(texts):
    sets, n = [], len(texts)
    for t in texts:
        w = words((t or "").encode())
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_copies(rng, n_groups, size, changes):
    vocabulary = [f"w{i}" for i in range(5000)]
    texts = []
    for _ in range(n_groups):
        base = list(rng.choice(vocabulary, 60))
        for _ in range(size):
            w = list(base)
            for _ in range(rng.integers(0, changes + 1)):
                w[rng.integers(0, len(w))] = str(rng.choice(vocabulary))
            texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize(("hot", "block"), [(24, 2048), (4, 2048), (4, 16)])
def test_jaccard_components_equal_brute_force(spark, monkeypatch, hot, block):
    rng = np.random.default_rng(hot + block)
    texts = near_copies(rng, 6, 4, 2) + near_copies(rng, 2, 60, 2) + near_copies(rng, 1, 40, 4)
    texts += ["a b", "A b", "", None, "a b c d e f", texts[0], texts[0].upper()]
    texts += [texts[30] + " " + " ".join(f"z{i}_{j}" for j in range(40)) for i in range(30)]
    monkeypatch.setattr(ngram_join, "HOT", hot)
    if block != 2048:
        plain = ngram_join.hot_links
        monkeypatch.setattr(ngram_join, "hot_links", lambda d: plain(d, block))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_jaccard_odd_rows(odd, nothing):
    rows = ngram_join.jaccard_components(odd).collect()
    by = {(r.doc_id, r.n_shingles): r.component_id for r in rows}
    assert len(rows) == len(ODD) and by[2, 6] == 1 and by[3, 0] == 3 and by[4, 0] == 4 and by[None, 1] == 6 and by[6, 1] == 6
    assert ngram_join.jaccard_components(nothing).count() == 0


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (1, 0)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}


# ---- op6 -------------------------------------------------------------------------------------------------------------

def water(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((k for k in sizes if k is not None), key=lambda k: k) + ([None] if None in sizes else [])
    w = {k: weights[i % 3] for i, k in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [k for k in names if k not in fixed]
        level = (total - sum(fixed.values())) / max(sum(w[k] for k in free), 1e-12)
        over = [k for k in free if level * w[k] > most * sizes[k] + 1e-9]
        if not over:
            return fixed | {k: level * w[k] for k in free}
        fixed |= {k: most * sizes[k] for k in over}


def test_mix_reaches_targets(spark, odd, nothing):
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(rng.integers(0, 50)), [None, "a", "b", "é", "z"][int(rng.choice(5, p=[0.1, 0.5, 0.2, 0.1, 0.1]))]) for i in range(400)]
    for data in (spark.createDataFrame(rows, "doc_id long, text string, source string"), odd):
        got = mixing.mix_to_weights(data).collect()
        sizes, taken, goal = collections.Counter(), collections.Counter(), {}
        for r in got:
            sizes[r.source] += r.size
            taken[r.source] += r.taken
            goal[r.source] = r.target
            assert 0 <= r.taken <= 2 * r.size
        want = water(sizes)
        for k in sizes:
            assert abs(goal[k] - want[k]) < 1e-6 and goal[k] - 1 < taken[k] <= goal[k] + 1e-6
        key = lambda rs: sorted((str(r.doc_id), r.size, r.taken) for r in rs)
        assert key(got) == key(mixing.mix_to_weights(data.repartition(7)).collect())
    assert mixing.mix_to_weights(nothing).count() == 0


def test_mixed_documents_keeps_columns(odd):
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns and out.count() > 0


# ---- op9, op10 -------------------------------------------------------------------------------------------------------

def test_isotonic_pools_violators():
    x = np.array([1, 2, 2, 3, 4, 5.0])
    y = np.array([0, 1, 0, 0, 1, 1])
    knots, value = labelled.isotonic(x, y)
    assert np.allclose(value, [0, 1 / 3, 1]) and np.allclose(knots, [1, 7 / 3, 4.5])


@pytest.mark.parametrize(("score", "column", "least"), [(quality.score_quality, "quality", 0.95), (toxicity.score_toxicity, "toxic", 0.8)])
def test_classifiers_hold_out(spark, score, column, least):
    sf = "/root/testdata/sf0.01"
    mod, rest = (5, 0) if column == "quality" else (4, 2)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = score(docs, labels).join(labels, "doc_id").where(labelled.in_fold("doc_id", mod, rest)).select("score", column).toPandas()
    rank = rows["score"].rank()
    pos = rows[column] == 1
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc >= least and rows["score"].between(0, 1).all()


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_classifiers_odd_rows(spark, odd, nothing, score):
    column = "quality" if score is quality.score_quality else "toxic"
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (7, None), (8, 0)], f"doc_id long, {column} int")
    got = score(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id in (3, 4)}) == 1
    assert all(r.score == 0.5 for r in score(odd, labels.limit(0)).collect()) and score(nothing, labels).count() == 0
    assert score(odd, labels, keep=True).select("row.*").columns == odd.columns


def test_deobfuscation(spark):
    docs = spark.createDataFrame([("stupid idiot loser trash moron " * 20 + "the house and the garden are nice " * 50,)], "text string")
    r = toxicity.Restorer(toxicity.letter_model(toxicity.trigram_counts(docs)))
    for noisy, plain in (("1d10t", "idiot"), ("stuuupid", "stupid"), ("l0ser", "loser"), ("tr@sh", "trash"), ("s.t.u.p.i.d", "stupid"), ("m0r0n!", "moron"), ("garden", "garden"), ("nice,", "nice")):
        assert r.word(noisy.encode()) == plain, noisy
    assert r.spaced(b"you i d i o t there") == ["idiot"]


def test_obfuscated_words_at_edges(spark):
    docs = spark.createDataFrame([("stupid idiot loser trash moron ass " * 20 + "the house and the garden are nice " * 50,)], "text string")
    model = toxicity.letter_model(toxicity.trigram_counts(docs))
    r = toxicity.Restorer(model)
    for text in ("s t u p i d, ok", "s t u p i d. ok", '"s t u p i d"', "(s t u p i d)", "\u201cs t u p i d\u201d", "s\tt\tu\tp\ti\td", "s\nt\nu\np\ni\nd", "s - t . u_p * i , d", "S T * P I D!"):
        assert r.spaced(text.encode()) == ["stupid"], text
    assert r.spaced(b"1 d 1 0 +") == ["idiot"] and r.spaced(b"a word of two x y") == []
    for noisy, plain in (("idio+", "idiot"), ("1d10+!", "idiot"), ("a$$", "ass"), ("a$$!", "ass"), ("stuupid", "stupid"), ("(idiot)", "idiot"), ("garden!", "garden")):
        assert plain in r.readings(noisy.encode()), noisy
    scorer = toxicity.Scorer(model, {"stup~": 3.0, "ass": 2.0}, None)
    assert scorer.run("stupid") == [3.0] and scorer.run("youstupid") == [3.0] and scorer.run("ass") == [2.0] and scorer.run("passed") == []
    assert scorer.evidence(b"you s t u p i d.")[1] == 3.0 and scorer.evidence(b"* * * " * 200_000 + b"a " * 200_000)[1] == 0.0
