import collections

from veilframe.llm import mixing


def test_mixed_documents_by_row(spark):
    rows = [(None if i % 3 == 0 else i % 40, "w " * (1 + i % 7) + f"t{i}", "ab"[i % 5 == 0]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.mix_to_weights(docs).collect()
    goal = {r.source: r.target for r in plan}
    words = collections.Counter()
    seen = mixing.mixed_documents(docs).collect()
    for r in seen:
        words[r.source] += len(r.text.split())
    for source, target in goal.items():
        assert target - 1 < words[source] < target + 9, (source, target, words[source])
    assert seen and {(r.doc_id, r.text, r.source) for r in seen} <= set(rows)
