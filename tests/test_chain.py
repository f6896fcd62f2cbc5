from veilframe.functions.registry import BY_NAME
from veilframe.operators import governance as gov
from veilframe.operators.lookup import passage_search
from veilframe.operators.score import window_tokens
from veilframe.plans.chain import redact_full
from veilframe.plans.queries import CORE


def test_redact_full_replaces_what_the_steps_leave(spark):
    docs = spark.createDataFrame([
        (1, "PATIENT: SMITH, JOHN  MRN: 12345678  seen by Dr. Jane Miller at the hospital, diagnosed with diabetes. Mail x@y.org"),
        (2, None), (3, ""), (4, "nothing here"), (5, "MEDICAL RECORD, PLAN\nA plain line"),
    ], "doc_id long, text string")
    got = {r.doc_id: r for r in redact_full(docs, (*CORE, BY_NAME["credit_card"])).collect()}
    assert len(got) == 5 and got[2].redacted is None and got[3].redacted == "" and got[4].redacted == "nothing here"
    for gone in ("12345678", "Jane Miller", "x@y.org", "SMITH, JOHN"):
        assert gone not in got[1].redacted
    assert got[1].redacted.count("[") == got[1].n_redactions and "diagnosed with diabetes" in got[1].redacted
    assert got[5].redacted == "MEDICAL RECORD, PLAN\nA plain line"


def test_windows_reach_as_far_as_the_words_do(spark):
    long = "w" * 500
    text = f"one two {long} four five six X7X {long} , {long} c d e f"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    at = text.index("X7X")
    spans = spark.createDataFrame([(1, at, at + 3, "X7X", "NAME", 0.5, 1, "p")], "doc_id long, start long, end long, text string, type string, confidence double, priority int, pattern string")
    assert window_tokens(spans, docs).first().window == ["two", long, "four", "five", "six", long, long, "c", "d", "e"]


def test_every_tag_rule(spark):
    rows = [("f", t, "v") for t in gov.TAG_RULES] + [("f", "x0020000d", "v"), ("f", "(0028,0010)", "512"), ("f", "00080060", "CT"), ("f", None, "kept")]
    got = {r.tag: r.value for r in gov.tag_rules(spark.createDataFrame(rows, "file string, tag string, value string")).collect()}
    assert set(got) == {t for t, a in gov.TAG_RULES.items() if a == "HASH"} | {"x0020000d", "(0028,0010)", "00080060", None}
    assert got["(0028,0010)"] == "512" and got["x0020000d"] == got["0020000D"] and len(got["00100010"]) == 64
    put = {r.tag: r.value for r in gov.tag_rules(spark.createDataFrame(rows, "file string, tag string, value string"), replacements={"00100010": "ANONYMOUS", "00100030": "1900"}).collect()}
    assert put["00100010"] == "ANONYMOUS" and put["00100030"] == "1900"


def test_passages_are_compared_whole(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g, a b c d e f x"), (2, "A B C D E F G A b c d e f g"), (3, None), (4, "p q")], "doc_id long, text string")
    passages = spark.createDataFrame([("a b c d e f g",), ("p q",), ("",), (None,), ("p q r",)], "text string")
    got = sorted((r.doc_id, r.word, r.passage) for r in passage_search(docs, passages).collect())
    assert got == [(1, 0, "a b c d e f g"), (2, 0, "a b c d e f g"), (2, 7, "a b c d e f g"), (4, 0, "p q")]
