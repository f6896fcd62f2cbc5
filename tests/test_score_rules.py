import math

import numpy as np
from pyspark.sql import functions as F

from veilframe.operators import measure, postfilter, score

SPANS = "doc_id long, start long, end long, text string, type string, confidence double, priority int, pattern string"


def spans_of(spark, text, *found):
    rows = [(1, text.index(t), text.index(t) + len(t), t, kind, c, 1, "p") for t, kind, c in found]
    return spark.createDataFrame(rows, SPANS), spark.createDataFrame([(1, text)], "doc_id long, text string")


def cross(spark, text, *found):
    return {r.text: r.confidence for r in score.cross_type(*spans_of(spark, text, *found)).collect()}


def test_pairs_of_types(spark):
    got = cross(spark, "111-22-3333 and 555-201-9999", ("111-22-3333", "SSN", 0.5), ("555-201-9999", "PHONE", 0.9))
    assert got == {"111-22-3333": round(0.5 - 0.5 * 0.95, 6), "555-201-9999": 0.9}
    tie = cross(spark, "12345 or 67890", ("12345", "MRN", 0.8), ("67890", "ZIPCODE", 0.8))
    assert tie == {"12345": 0.6, "67890": 0.6}  # at a tie either side is hit once
    assert cross(spark, "a Jo b 1/2/50", ("Jo", "NAME", 0.5), ("1/2/50", "DATE", 0.5)) == {"Jo": 0.5, "1/2/50": 0.5}
    assert cross(spark, "Jo, born 1/2/50", ("Jo", "NAME", 0.5), ("1/2/50", "DATE", 0.5)) == {"Jo": 0.56, "1/2/50": 0.56}
    far = "Jo " + "x" * 300 + " j@b.org"
    assert cross(spark, far, ("Jo", "NAME", 0.5), ("j@b.org", "EMAIL", 0.5)) == {"Jo": 0.5, "j@b.org": 0.5}


def test_equal_texts_need_two_of_one_type(spark):
    rows = [(1, 0, 4, "Ann  Lee", "NAME", 0.5, 1, "p"), (1, 300, 304, "ann lee", "ADDRESS", 0.5, 1, "p"), (2, 0, 3, "x y", "NAME", 0.5, 1, "p"), (2, 600, 603, "X Y", "NAME", 0.5, 1, "p"), (2, 900, 903, "X  Y", "ADDRESS", 0.5, 1, "p")]
    docs = spark.createDataFrame([(1, "a" * 1000), (2, "a" * 1000)], "doc_id long, text string")
    got = sorted((r.doc_id, r.start, r.confidence) for r in score.cross_type(spark.createDataFrame(rows, SPANS), docs).collect())
    assert got == [(1, 0, 0.5), (1, 300, 0.5), (2, 0, 0.6), (2, 600, 0.6), (2, 900, 0.375)]


def test_fields_end_at_the_next_label(spark):
    text = "Next of Kin: Ann Lee DOB: 1/2/50 \nFile #:\n  777\nMember ID: H5\nCity:\n\nnote\nName: " + "A" * 100_000
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    got = [(text[r.value_start : r.value_end][:20], r.expected) for r in score.field_contexts(docs).orderBy("label_start").collect()]
    assert got == [("Ann Lee", "NAME"), ("1/2/50", "DATE"), ("777", "MRN"), ("H5", "MRN"), ("A" * 20, "NAME")]
    spans, _ = spans_of(spark, text, ("Ann Lee", "NAME", 0.5), ("H5", "HEALTH_PLAN", 0.5), ("note", "NAME", 0.5))
    boosted = {r.text: (round(r.confidence, 6), r.priority) for r in score.field_boost(spans, score.field_contexts(docs)).collect()}
    assert boosted == {"Ann Lee": (0.575, 90), "H5": (0.4, 1), "note": (0.5, 1)}


def test_clinical_strength(spark):
    rows = [("nothing", 0.0, "NONE"), ("a boy", 0.6, "WEAK"), ("the hospital", 0.9, "MODERATE"), ("a boy in the ICU", 1.5, "STRONG"), ("Family History:\nb", 0.5, "WEAK"), ("MRN# 5", 1.0, "MODERATE"), ("", 0.0, "NONE")]
    w, s = score.clinical_strength(F.col("t"))
    got = spark.createDataFrame(rows, "t string, w double, s string").select("t", w.alias("w"), s.alias("s")).collect()
    assert [tuple(r) for r in got] == rows


def test_titles_and_short_names(spark):
    text = "seen by Mr. Lee, then " + "x " * 40 + "Poe" + " y" * 40
    got = {r.text: round(r.confidence, 6) for r in score.context_modifiers(score.window_tokens(*spans_of(spark, text, ("Lee", "NAME", 0.5), ("Poe", "NAME", 0.5)))).collect()}
    assert got == {"Lee": 0.7, "Poe": 0.5}
    assert score.context_modifiers(score.window_tokens(*spans_of(spark, "Poe", ("Poe", "NAME", 0.5)))).first().confidence == 0.35


def test_calibrators(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.uniform(0, 1, 400), 2)
    y = (rng.uniform(0, 1, 400) < x**2).astype(int)
    df = spark.createDataFrame([*zip(x.tolist(), y.tolist()), (None, 1), (0.5, None)], "confidence double, label int")
    a = b = 0.0
    for _ in range(100):
        e = [1 / (1 + math.exp(-(a * p + b))) - t for p, t in zip(x, y)]
        a, b = a - 0.01 * sum(i * p for i, p in zip(e, x)) / 400, b - 0.01 * sum(e) / 400
    r = measure.platt(df).first()
    assert (r.n, r.a, r.b) == (400, round(a, 6), round(b, 6))
    got = df.limit(1).select(measure.calibrated(F.lit(0.5), "platt", a=a, b=b).alias("p"), measure.calibrated(F.lit(0.8), "temperature", temperature=1.0).alias("t"), measure.calibrated(F.lit(0.5), "beta", a=1.0, b=2.0, c=0.1).alias("b")).first()
    assert all(abs(p - q) < 1e-9 for p, q in zip(got, (1 / (1 + math.exp(-(a / 2 + b))), 0.8, 0.35)))
    few = df.limit(19)
    assert measure.platt(few).count() == measure.beta(few).count() == measure.temperature(few).count() == 0
    assert measure.temperature(df).count() == 1 and measure.beta(df).first().b > 1


def test_what_else_a_span_may_be(spark):
    text = "90 mg daily of Xanor, a drug. " + "z " * 60 + "signed by Lee"
    got = {(r.text, r.alternative): (r.winner, r.sure) for r in score.disambiguated(*spans_of(spark, text, ("Xanor", "NAME", 0.5), ("Lee", "NAME", 0.5), ("90", "DATE", 0.5))).collect()}
    assert got[("Xanor", "MEDICATION")] == ("MEDICATION", 0.95) and got[("Xanor", "DIAGNOSIS")] == ("NAME", 0.5)
    assert got[("Lee", "MEDICATION")] == got[("Lee", "DIAGNOSIS")] == ("NAME", 0.8)
    assert got[("90", "MEASUREMENT")] == ("MEASUREMENT", 0.9) and got[("90", "AGE")] == ("DATE", 0.5)


def test_post_filter_rules(spark):
    names = {"Ann Lee\nDOB": "line_break", "Ann Lee\r\nRoom: 5": "line_break", "Ann Lee\nMiller": None, "Jones Clinic": "medical_suffix", "Jones clinic": None, "MEDICAL RECORD": "heading", "Ann Lee\nsome more words than that: b": None}
    df = spark.createDataFrame([(k, "NAME", 0.9) for k in names], "text string, type string, confidence double")
    assert {r.text: r.why for r in df.select("text", postfilter.removed_by(F.lit(0.5)).alias("why")).collect()} == names


def test_whitelist_knows_persons(spark):
    found = {"Dr. Hospital": True, "Dr. Recording": False, "Hospital": False, "Ann Lee": True, "surgery 5": False}
    rows = [(1, 0, 1, t, "NAME", 0.5, 1, "p") for t in found] + [(1, 0, 1, "surgery 6", "DEVICE", 0.5, 1, "p"), (1, 0, 1, "hospital day 5", "DATE", 0.5, 1, "p")]
    assert {r.text for r in score.whitelist_filter(spark.createDataFrame(rows, SPANS)).collect()} == {t for t, kept in found.items() if kept} | {"surgery 6"}


def test_post_filter_tables(spark):
    names = {"FINDINGS": "heading", "CHIEF  COMPLAINT": "suffix", "CHIEF  COMPLAINANT": None, "LAB RESULTS": "heading", "Ann Bank": "structure", "Ann Banks": None, "Ann-Bank Lee": None, "Vital Signs": "structure", "heart rate": "structure", "domestic partner": "medical",
             "Ann Texas": "geographic", "Texas-Lee Ann": None, "nurse manager": "label", "spouse name": "suffix", "": "short", "Ann Lee": None}
    df = spark.createDataFrame([(k, "NAME", 0.7) for k in names], "text string, type string, confidence double")
    assert {r.text: r.why for r in df.select("text", postfilter.removed_by(F.lit(0.5)).alias("why")).collect()} == names
    assert not df.select("text", F.lit("DATE").alias("type"), "confidence").where(postfilter.removed_by(F.lit(0.5)).isNotNull()).count()


def test_whitelist_tables(spark):
    names = {"Oscar Lee": False, "Mount Sinai Ann": False, "Lee Appendectomy": False, "Renal, Ann": False, "Lee Renal": False, "Ann or Lee": True, "Or": False, "Wilson": True, "Wilson disease": False, "Wilsons disease": True,
             "Parkinson'": True, "Boston Ann": False, "Ann, Dallas": False, "Senior Nurse": False, "Senior Lee": False, "Ann Wells": True, "Mr. Wells score": True, "Dr. Discharge Plan": False, "St. Mary": False, "St Xmary": True, "": True}
    rows = [(1, 0, 1, t, "NAME", 0.5, 1, "p") for t in names] + [(1, 0, 1, "Boston 5", "CUSTOM", 0.5, 1, "p"), (1, 0, 1, None, "NAME", 0.5, 1, "p"), (1, 0, 1, "Oscar", "MRN", 0.5, 1, "p"), (1, 0, 1, "Xanor 5", "CUSTOM", 0.5, 1, "p")]
    spans = spark.createDataFrame(rows, SPANS)
    assert {r.text for r in score.whitelist_filter(spans).collect()} == {t for t, kept in names.items() if kept} | {"Boston 5", None, "Oscar", "Xanor 5"}
    more = score.whitelist_filter(spans, conditions=("wells",), medications=("xanor", "wilson disease"))
    assert {r.text for r in more.collect()} == {t for t, kept in names.items() if kept} - {"Ann Wells"} | {"Boston 5", None, "Oscar"}
