import random

from pyspark.sql import functions as F

from veilframe.operators import lookup, normalize


def distance(a, b):
    before, now = [], [*range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(now[j] + 1, new[-1] + 1, now[j - 1] + (x != y))
            new.append(min(d, before[j - 2] + 1) if i > 1 and j > 1 and (a[i - 2], x) == (y, b[j - 2]) else d)
        before, now = now, new
    return now[-1]


def test_fuzzy_lookup_equals_brute_force(spark):
    random.seed(2)
    word = lambda: "".join(random.choice("abcdé") for _ in range(random.randint(0, 7)))
    a, b = sorted({"lee", "iran", "x" * 5000, *(word() for _ in range(150))}), sorted({"leeds", "irok", *(word() for _ in range(60))})
    tokens, terms = spark.createDataFrame([(w,) for w in [*a, None]], "token string"), spark.createDataFrame([(w,) for w in [*b, None]], "term string")
    for most in (1, 2):
        want = {t: min((distance(t, w), w) for w in b) for t in a}
        got = {r.token: (r.distance, r.term) for r in normalize.fuzzy_lookup(tokens, terms, most).collect()}
        assert got == {t: x for t, x in want.items() if x[0] <= most}


def test_phonetic_lookup_takes_two_edits(spark):
    tokens = spark.createDataFrame([("lee",), ("iran",)], "token string")
    terms = spark.createDataFrame([("leeds",), ("irok",)], "term string")
    got = {r.token: (r.term, r.match) for r in lookup.phonetic_lookup(tokens, terms).select(F.col("token"), "term", "match").collect()}
    assert got == {"lee": ("leeds", "EDITS"), "iran": ("irok", "EDITS")}
