import random
import time

from pyspark.sql import functions as F

from veilframe.functions.match import matches, within_line
from veilframe.functions.registry import BY_NAME, DETECTORS
from veilframe.operators.detect import detect
from veilframe.sources import HEADER, spread


def test_what_can_take_a_line_break_is_not_searched_by_line():
    assert all(map(within_line, (r"(?i)\bmrn[ \t]*:(\d{4})\b", r"[A-Z][a-z]+, (?:a|b)", r"(?i:\bpt[ \t]+)([a-z])")))
    assert not any(map(within_line, (r"a\s+b", r"^a", r"a$", r"a.b", r"[^a]", r"\D", "a\nb", r"[\t-\r]", r"(?:a|\W)")))
    assert {(d.name, p.name) for d in DETECTORS for p in d.patterns if not within_line(p.regex) and not p.by_line} == {("multiline_patient", "patient line"), ("multiline_file", "file line")}


def test_lines_have_the_matches_of_the_whole_text(spark):
    """Searched by line, a text has the spans that each pattern finds in the whole of it."""
    random.seed(5)
    head = spark.range(6).selectExpr(HEADER.format(id="id")).collect()
    lines = [x for r in head for x in r[0].split("\n")] + ["#1234567 and", "José Alvarez", "Ana Ñandú,", "José", "Alvarez", "José Alvarez, x", "file 12345", "", "\r", "x\r", "pt 12", "4111 1111", "1111 1111", "file #:", "patient:"]
    texts = ["\n".join(random.choices(lines, k=random.randint(1, 12))) + random.choice(["", "\n", "\n\n", " "]) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").cache()
    patterns = [(d, p) for d in DETECTORS for p in d.patterns if f"{d.name}:{p.name}" in ("mrn:hash", "name_shape:accented", "zip:five", "mrn:file", "multiline_file:file line", "name_last_first:caps", "provider_name:title", "email:address")]
    got = {(r.doc_id, s.pattern, s.start, s.end, s.text) for r in detect(df, DETECTORS).select("doc_id", "spans").collect() for s in r.spans}
    rows = df.select("doc_id", *[matches("text", p.regex, p.group).alias(f"m{i}") for i, (_, p) in enumerate(patterns)]).collect()
    want = {(r[0], f"{d.name}:{p.name}", s.start, s.end, s.text) for r in rows for (d, p), found in zip(patterns, r[1:]) for s in found}
    names = {f"{d.name}:{p.name}" for d, p in patterns}
    assert {x for x in got if x[1] in names} == want and {x[1] for x in want} == names


def test_a_long_text_costs_little_beside_its_lines_with_identifiers(spark):
    head = spark.range(1).selectExpr(HEADER.format(id="id")).first()[0]
    long = head + "\nThe onder ined ther stion of anand, ertion the inor. Ander with a patient than in march" * 20_000
    df = spark.createDataFrame([(1, head), (2, long)], "doc_id long, text string").cache()
    run = lambda k: detect(df.where(F.col("doc_id") == k), DETECTORS).select(F.size("spans")).first()[0]
    few, began = run(1), time.time()
    run(1)
    short, began = time.time() - began, time.time()
    assert run(2) == few and time.time() - began < 10 + short


def test_tasks_grow_with_a_table_not_their_size(spark, tmp_path, monkeypatch):
    import veilframe.sources as sources

    path = str(tmp_path / "t")
    spark.range(4_000).selectExpr("id", "sha2(CAST(id AS STRING), 512) AS text").coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    monkeypatch.setattr(sources, "SPREAD_BYTES", 2_000)
    many = spread(df)
    sizes = many.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 50 and max(r[1] for r in sizes) < 200 and many.count() == 4_000


def test_the_end_of_a_text_is_its_very_end(spark):
    df = spark.createDataFrame([(1, "José Alvarez\n"), (2, "José Alvarez"), (3, "José Alvarez\nx")], "doc_id long, text string")
    found = detect(df, [BY_NAME["name_shape"]]).select("doc_id", F.size("spans")).collect()
    assert {tuple(r) for r in found} == {(1, 0), (2, 1), (3, 0)}
