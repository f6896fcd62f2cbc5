import random
import time

from pyspark.sql import functions as F

from veilframe.functions.match import EDGE, VALUE, matches
from veilframe.functions.registry import DETECTORS
from veilframe.operators.detect import detect, exploded, opens, views


def test_gates_only_save_the_search(spark):
    """Whatever a pattern matches, its gate lets through: single edits of the fixture's header and lines made for the patterns."""
    from veilframe.sources import HEADER

    random.seed(4)
    head = [r[0] for r in spark.range(40).selectExpr(HEADER.format(id="id")).collect()]
    lines = [
        "Q3 2023 FY'24 winter of 2020 since 1998 late 1990s the 5th of March 5 May 12-Mar-2021 051430Z MAR 23 20230105 2023-01-05T10:30", "020 7946 0958 01632 960123 01 23 45 67 89 030/1234567 0412 345 678 +49 30 12345 67",
        "Visa ending in 1234 3714 496353 98431 4111.1111.1111.1111 ABA 123456789 order no 12345A", "José Álvarez, née Brown aka Al O'Neil McCoy Jan van Dyk, John Q-Smith Mary Brown-White's J. Doe Jr Al Bo III",
        "SW1A 1AA K1A 0B1 RR 2 Box 10 12 OAK HILL RD lives in Boston Kent County mile marker 7 apt. B12 corner of Oak and Elm", "DEA AB1234567 NPI: 1234567890 05D1234567 CA DL A1234567 7ABC123 (01)00643169007222(17)220101 lot # AB12 tattoo on the left arm",
        "spoke with Ann Lee, patient Brown denies. scrub: Ann Lee Tom (8) fe80::1:2 00:1b:44:11:3a:b7 1EG4-TE5-MK73 rx bin 004336", "yesterday morning second trimester third TRIMESTER 12 weeks ago MR #AB123 hospital no 123 456 7890",
        "pat_2024_00123 (#1234567) MED 6936859 M0E: 736B399 PT 2023-805069 rec: 2020- 638238 id 834|971 ID:2 656000 Record # 327 2869 MRN: 2024-!q66 file 12345 chart 12345A 8D 9064636", "Medicare 1EG4TE5MK73 GRP-12345-A pol: AB-12345 ID#: BC123456789",
        "Acct 123456-7 ACC: 8819217 Savings account: **-1234 policy no: ABC-12345 card ending in 1234 Document ID: AB-12345-6789 REF-123456 INV-2024-123456 AB-CDE-12345 group no ABC-1234X", "cc 4111 1111-1111 1111 3714 4963 5398 431 4111  1111  1111 1111 371449635398431 3714  496353  98431",
    ]
    texts = head + lines + [random.choice((str.lower, str.upper, str.swapcase))(t) for t in lines]
    for t in [*head[:6], *lines]:
        for _ in range(12):
            i = random.randrange(len(t))
            texts.append(t[:i] + random.choice(["", " ", "\t", "0", "A", "a", "-", "\u017f", "\u0130"]) + t[i + random.randint(0, 1) :])
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("v", F.expr(views("text"))).cache()
    missed = []
    for d in DETECTORS:
        row = df.select(*[F.sum((~F.expr(f"({opens(d.gate)}) AND ({opens(p.gate)})") & (F.size(matches("text", p.regex, p.group)) > 0)).cast("int")) for p in d.patterns]).first()
        missed += [(d.name, p.name) for p, n in zip(d.patterns, row) if n]
    assert not missed


def test_every_detector_finds_something_in_the_fixture(spark, sf):
    from veilframe.sources import clinical

    found = {r[0] for r in exploded(detect(clinical(spark, sf).limit(30), DETECTORS), "doc_id").select(F.split("pattern", ":")[0]).distinct().collect()}
    assert {d.name for d in DETECTORS} - found <= {"name_shape", "credit_card"}


def test_many_matches_are_linear(spark):
    text = "12345 abc, " * 16_000
    df = spark.createDataFrame([(text,)], "text string")
    df.select(matches("text", r"\b\d{5}\b")).collect()
    began = time.time()
    got = df.select(matches("text", r"\b(\d)\d{4}\b", 1).alias("m")).first().m
    assert time.time() - began < 5 and len(got) == 16_000 and all(text[m.start : m.end] == "1" == m.text for m in got) and got[-1].start == 11 * 15_999


def test_marks_in_a_text(spark):
    text = f"a{EDGE}b 12345 {VALUE}{EDGE} 54321 {EDGE}"
    df = spark.createDataFrame([(text,)], "text string")
    for group, pattern in ((0, r"\d{5}"), (1, r"(\d{4})\d"), (0, r"[^ ]+")):
        got = df.select(matches("text", pattern, group).alias("m")).first().m
        assert got and all(text[m.start : m.end] == m.text for m in got)


def test_numbers_of_records_members_accounts_and_cards(spark):
    want = {
        "mrn": ["pat_2024_00123", "1234567", "MED 6936859", "M0E: 736B399", "PT 2023-805069", "rec: 2020- 638238", "834|971", "ID:2 656000", "327 2869", "MRN: 2024-!q66", "12345", "12345A", "8D 9064636"],
        "health_plan": ["1EG4TE5MK73", "GRP-12345-A", "AB-12345", "BC123456789"],
        "account": ["123456-7", "ACC: 8819217", "**-1234", "ABC-12345", "1234", "AB-12345-6789", "REF-123456", "INV-2024-123456", "AB-CDE-12345", "ABC-1234X"],
        "credit_card": ["4111 1111-1111 1111", "3714 4963 5398 431", "4111  1111  1111 1111", "371449635398431", "3714  496353  98431", "4532 0000 0000 0000"],
    }
    text = (
        "pat_2024_00123 (#1234567) MED 6936859 M0E: 736B399 PT 2023-805069 rec: 2020- 638238 id 834|971, ID:2 656000. Record # 327 2869, MRN: 2024-!q66 file 12345, chart 12345A 8D 9064636; Medicare 1EG4TE5MK73 GRP-12345-A pol: AB-12345 ID#: BC123456789; "
        "Acct 123456-7 ACC: 8819217 Savings account: **-1234, policy no: ABC-12345, card ending in 1234, Document ID: AB-12345-6789, REF-123456, INV-2024-123456, AB-CDE-12345, group no ABC-1234X; "
        "cc 4111 1111-1111 1111, 3714 4963 5398 431, 4111  1111  1111 1111, 371449635398431, 3714  496353  98431, 4532 0000 0000 0000, 4111 1111 1111 1112, patient presented, chart reviewed, #12345"
    )
    found: dict[str, set] = {}
    for r in exploded(detect(spark.createDataFrame([(1, text)], "doc_id long, text string"), DETECTORS), "doc_id").collect():
        assert text[r.start : r.end] == r.text
        found.setdefault(r.pattern.split(":")[0], set()).add(r.text)
    assert {d: [x for x in xs if x not in found[d]] for d, xs in want.items()} == {d: [] for d in want}
    assert not {x for x in found["credit_card"] if x.endswith("1112")} and not found["mrn"] & {"presented", "reviewed"}
