import time

import numpy as np
import pytest
from test_text_ops import brute

import corpus_pipeline as cp
from veilframe.llm import toxicity

CLASHING = ("_row", "_t", "_score", "_copy", "_id", "row", "t", "score", "id", "key", "size", "node", "kept", "component")
SENTENCE = "The quick brown fox jumps over the lazy dog while the old grey cat sleeps near the warm stove in the kitchen today"


def rows():
    texts = [SENTENCE, SENTENCE, SENTENCE.upper(), None, "", " \n", "a b", "- " * 400_000, "x" + "-" * 1_000_000 + "x", "é x y", "one two three four five six", "seven eight nine ten eleven twelve"]
    ids = [1, 1, 2, 3, 4, 5, 6, 7, 8, None, None, None]
    return [(i, t, "en", ["a", "b", None][k % 3], len(t or "")) for k, (i, t) in enumerate(zip(ids, texts))]


@pytest.fixture(scope="module")
def docs(spark):
    data = [(*r, *(100 * k + j for j in range(len(CLASHING)))) for k, r in enumerate(rows())]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in CLASHING)).repartition(3).cache()


def all_rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("name", ["quality", "toxicity", "near_duplicates", "mix"])
def test_stages_keep_rows_whole(spark, sf, docs, name):
    stage = dict(cp.STAGES)[name]
    out = stage(spark, docs, sf)
    assert out.columns == docs.columns and set(all_rows(out)) <= set(all_rows(docs))
    empty = stage(spark, docs.limit(0), sf)
    assert empty.columns == docs.columns and empty.count() == 0


def test_near_duplicates_keep_one_of_each(spark, sf, docs):
    got = {(r.doc_id, r.text) for r in cp.near_duplicates(spark, docs, sf).collect()}
    assert cp.near_duplicates(spark, docs, sf).count() == len(rows()) - 2  # the sentence, three times
    assert got == {(i, t) for i, t, *_ in rows()} - {(2, SENTENCE.upper())}


def test_near_duplicates_with_repeated_ids_equal_brute_force(spark, sf):
    rng = np.random.default_rng(8)
    texts = []
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 3000, 50)]
        for _ in range(4):
            w = list(base)
            for _ in range(rng.integers(0, 4)):
                w[rng.integers(0, 50)] = f"n{rng.integers(0, 3000)}"
            texts.append(" ".join(w))
    ids = [None if k % 5 == 0 else k % 7 for k in range(len(texts))]  # ids say nothing of the groups
    df = spark.createDataFrame([(i, t, None, "a", 1) for i, t in zip(ids, texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in cp.near_duplicates(spark, df.repartition(4), sf).collect()]
    groups = {}
    for k, (_, g) in enumerate(brute(texts)):
        groups.setdefault(g, []).append(k)
    assert len(kept) == len(groups)
    for own in groups.values():
        least = min((ids[k] is None, ids[k] or 0) for k in own)
        assert sum((i is None, i or 0) == least and t in {texts[k] for k in own} for i, t in kept) >= 1


def test_packing_stage(spark, sf, docs):
    out = cp.packing(spark, docs, sf).collect()
    assert sum(r.start == 0 for r in out) == len(rows()) and cp.packing(spark, docs.limit(0), sf).count() == 0


def test_run_writes_and_reads_each_stage(spark, sf):
    got = cp.run(spark, sf)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() > 0


def test_long_punctuation_is_linear():
    model = toxicity.letter_model(np.ones((toxicity.SYMBOLS,) * 3))
    began = time.time()
    for text in (b"a" + b"-" * 300_000 + b"a", b"-" * 300_000 + b"a" + b"!" * 300_000, b"#" * 1_000_000, b"_" * 1_000_000, b"a" + b"#" * 1_000_000 + b"a"):
        toxicity.Scorer(model, {"idiot": 3.0}, None).evidence(text)
    assert time.time() - began < 60
