import random
import re

from pyspark.sql import functions as F

from veilframe.functions.match import BOUNDARY, java
from veilframe.functions.registry import DETECTORS
from veilframe.operators import lookup, measure
from veilframe.sources import spread


def test_value_tests(spark):
    rows = spark.createDataFrame([("123-45-6789",), ("900-45-6789",), ("10.0.0.1",), ("10.0.0.256",), ("1HGCM82633A004352",), ("45.5, -120.25",), ("95.0, 10.0",), (None,)], "v string")
    got = {r.v: r for r in lookup.value_tests(rows).collect()}
    assert got["123-45-6789"].is_ssn and not got["900-45-6789"].is_ssn
    assert got["10.0.0.1"].is_ipv4 and not got["10.0.0.256"].is_ipv4
    assert got["1HGCM82633A004352"].is_vin
    assert got["45.5, -120.25"].is_gps and not got["95.0, 10.0"].is_gps
    assert got[None].is_ssn is None


def test_ocr_variants(spark):
    rows = spark.createDataFrame([("b0x",), ("",), (None,), ("0" * 40,)], "w string")
    got = {r.w: r.v for r in rows.select("w", lookup.ocr_variants(F.col("w")).alias("v")).collect()}
    assert got["b0x"] == ["b0x", "box", "80x", "8ox"] and got[""] == [""] and got[None] is None
    assert len(got["0" * 40]) == 100 and got["0" * 40][0] == "0" * 40


def test_words_that_sound_alike_share_a_code(spark):
    pairs = [("philip", "filip"), ("knight", "night"), ("wright", "right"), ("catherine", "katherine"), ("thompson", "thompsen")]
    rows = spark.createDataFrame(pairs, "a string, b string").select(lookup.metaphone(F.col("a")).alias("a"), lookup.metaphone(F.col("b")).alias("b")).collect()
    assert all(r.a == r.b and r.a for r in rows)
    terms = spark.createDataFrame([("filip",), ("anna",), ("maria",), (None,)], "term string")
    tokens = spark.createDataFrame([("philip",), ("anna",), ("mariq",), ("zzzz",), (None,)], "token string")
    got = {r.token: (r.term, r.match, r.score) for r in lookup.phonetic_lookup(tokens, terms).collect()}
    assert got == {"philip": ("filip", "PHONETIC", 0.9), "anna": ("anna", "EXACT", 1.0), "mariq": ("maria", "EDITS", 0.75)}


def test_phrases(spark):
    docs = spark.createDataFrame([(1, "The chest pain, and CHEST PAIN again; fever"), (2, None), (3, ""), (4, "chest")], "doc_id long, text string")
    phrases = spark.createDataFrame([("chest pain",), ("Fever",), ("not there",)], "phrase string")
    got = sorted((r.doc_id, r.word, r.phrase) for r in lookup.phrase_search(docs, phrases, (1, 2)).collect())
    assert got == [(1, 1, "chest pain"), (1, 4, "chest pain"), (1, 7, "fever")]


def test_grid_and_composition(spark):
    e = spark.createDataFrame([(0.9, 0.1, True), (0.2, 0.8, False), (None, 0.5, True)], "pattern double, context double, truth boolean")
    got = {(r.w, r.threshold): (r.tp, r.fp, r.fn) for r in measure.weight_grid(e, [0.0, 1.0], [0.5]).collect()}
    assert got == {(0.0, 0.5): (0, 1, 2), (1.0, 0.5): (1, 0, 1)}
    assert measure.advanced_composition(0.1, 100, 1e-5) < 100 * 0.1


def test_small_tables_are_spread(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    assert spread(d).count() == d.count() and spread(d).rdd.getNumPartitions() > 1


def test_short_boundaries_match_the_same():
    random.seed(1)
    texts = ["".join(random.choice("0123456789- .:/éAbcX_@") for _ in range(300)) for _ in range(40)] + ["PATIENT: SMITH, JOHN MRN: A12345 é12345 555-201-1234x5 123-45-6789_"]
    for d in DETECTORS:
        for p in d.patterns:
            full, short = (re.compile(r, re.ASCII) for r in (p.regex.replace(r"\b", BOUNDARY), java(p.regex)))
            assert all([m.span() for m in full.finditer(t)] == [m.span() for m in short.finditer(t)] for t in texts), p.name


def test_sql_of_codes_and_readings_equals_spark(spark, tmp_path):
    """The queries' SQL on words that the small table does not hold."""
    import duckdb

    import __spark_entry__

    words = ["Tymczak", "Pfister", "Honeyman", "Ashcraft", "Robert", "Rupert", "Jackson", "van Dyk", "Bwlh", "O'Hara", "Lloyd", "HWB", "Lee", "a", "Boggiloosz", "s5s5s5s5s5", "17", "Abbab"]
    from pyspark.sql import functions as F

    from veilframe.operators.normalize import soundex

    known = {"Tymczak": "T520", "Robert": "R163", "Rupert": "R163", "O'Hara": "O600", "van Dyk": "V532", "s5s5s5s5s5": "S000", "17": "0000", "Abbab": "A100", "": "0000", None: None}
    assert {r.w: r.c for r in spark.createDataFrame([(w,) for w in known], "w string").select("w", soundex(F.col("w")).alias("c")).collect()} == known
    spark.createDataFrame([(w,) for w in words], "n_name string").coalesce(1).write.parquet(f"{tmp_path}/nation.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW nation AS SELECT * FROM '{tmp_path}/nation.parquet/*.parquet'")
    for name in ("soundex_match", "ocr_variants"):
        df = __spark_entry__.queries()[name](spark, str(tmp_path))
        got, want = sorted(map(tuple, df.collect())), sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall())
        assert got == want and len(got) > 8
    con.execute("CREATE OR REPLACE VIEW documents AS SELECT unnest(['a', 'b', 'c', NULL, 'a']) AS text")
    import hashlib

    level = sorted(hashlib.sha256(x.encode()).hexdigest() for x in "abca")
    while len(level) > 1:
        level = [hashlib.sha256(bytes.fromhex(level[i]) + bytes.fromhex(level[min(i + 1, len(level) - 1)])).hexdigest() for i in range(0, len(level), 2)]
    assert con.execute(__spark_entry__.oracle_sql()["merkle_root"]).fetchall() == [(level[0],)]


def test_passages_that_follow_themselves_are_found_as_the_sql_finds_them(spark):
    import duckdb

    from veilframe.operators import lookup
    from veilframe.plans.queries import ORACLE

    docs = [(1, "a b a b a b"), (2, "a b c a b"), (3, "x x x x x x"), (4, "A, b! a b"), (5, "b a")]
    passages = [("a b",), ("x x",), ("b a",)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?)", passages)
    want = sorted(con.sql(ORACLE["phrase_search"]).fetchall())
    found = lookup.passage_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(passages, "text string"), parted=True)
    assert sorted((r.doc_id, r.passage, r.word) for r in found.collect()) == want and len(want) == 10
