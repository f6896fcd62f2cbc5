import random
import re
import time

from pyspark.sql import functions as F

from veilframe.operators import postfilter, score


def _said(text: str) -> float:
    """The weight by the patterns as they are listed, over the whole text."""
    return round(sum(w * sum(1 for p in ps for _ in re.finditer(p, text, re.ASCII)) for _, ps, w in score.CLINICAL), 6)


def test_pieces_have_the_indicators_of_the_whole_text(spark):
    random.seed(6)
    bits = [
        "patient name:", "Full\nname ", "MRN #", "DOB:", "date of\n\nbirth ", "er", "onset on ", "started  x", "for the\npast", "follow-up", "day\n12", "POD #3", "5 y.o. old", "5-year-old", "son", "next of kin", "lives\nin",
        "Patient Information:\n", "\nContact\n", "\nFamily History: \n", ",", ".\n", "!\n", "\n", " ", "x", "the", "symptoms", "complains", "presented to", "transferred from", "home address", "subject's", "_er", "er1", "clinic.\nadmitted", "ended,seen",
    ]
    texts = ["".join(x + random.choice(["", " ", "\n"]) for x in random.choices(bits, k=random.randint(1, 14))) for _ in range(1500)]
    texts = [t for t in texts if not t.endswith("\n")]  # where an end before a last break is one, engines differ
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = df.select("i", score.clinical_context(F.col("text"))["weight"].alias("w")).collect()
    assert [(texts[r.i], r.w) for r in got if abs(r.w - _said(texts[r.i])) > 1e-6] == [] and len({r.w for r in got}) > 50


def test_types_and_strength_of_a_long_text_cost_little(spark):
    head = "DISCHARGE SUMMARY\nThe patient was admitted to the clinic with chest pain. Heart\nsurgery, tumour"
    df = spark.createDataFrame([(head + ".\nThe onder ined ther shion of anand, ertion the inor. Ander ith than" * 60_000,)], "text string").cache()
    run = lambda d: d.select(score.clinical_context(F.col("text")).alias("c"), postfilter.document_type(F.col("text")).alias("t"), postfilter.specialty(F.col("text")).alias("s")).first()
    short = run(spark.createDataFrame([(head,)], "text string"))
    df.count()
    began = time.time()
    assert run(df) == short and short.t == "discharge_summary" and short.s == "cardiology" and short.c.strength == "STRONG"
    assert time.time() - began < 6


def test_labels_are_those_of_the_whole_text(spark):
    random.seed(7)
    bits = ["Patient:", "pt\n:", "patient name :", "DOB:", "medical\nrecord # :", "file #:", "e-mail:", "Smith", "x", ",", ".\n", "\n", "lab#:", "order  number:", "age:", "3", "sx:", "REQ:", "a.b", ":"]
    texts = ["".join(x + random.choice(["", " ", "\n"]) for x in random.choices(bits, k=random.randint(1, 14))) + " end" for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.label_start, r["rank"]) for r in score.field_contexts(df).collect()}
    want = {(i, m.start(), k) for i, t in enumerate(texts) for k, (names, _, _) in enumerate(score.FIELD_LABELS) for m in re.finditer(score.label_pattern(names), t, re.ASCII)}
    assert got <= want and {x[2] for x in got} >= {0, 1, 2, 6, 9}
    empty = {x for x in want - got}  # labels without a value have no row
    assert all(re.match(r"[ \t\x0b\f\r]*\n?\s*($|[A-Z]|\n)", texts[i][re.compile(score.label_pattern(score.FIELD_LABELS[k][0]), re.ASCII).match(texts[i], s).end() :]) for i, s, k in empty)


def test_labels_in_a_long_text_cost_little(spark):
    head = "Patient: SMITH, JOHN\nDOB: 1/1/1950"
    df = spark.createDataFrame([(1, head + ".\nThe onder ined ther shion of anand, patient and name of an order. Ander ith than date" * 60_000)], "doc_id long, text string").cache()
    df.count()
    score.field_contexts(df.where("doc_id = 2")).collect()
    began = time.time()
    assert len(score.field_contexts(df).collect()) == 2 and time.time() - began < 12
