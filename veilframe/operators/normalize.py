"""Text normalisation, noise scores and string distances."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that recognition takes for digits; invisible characters; look-alike letters.
OCR_FROM = "OolI|BbSsZzGgq"
OCR_TO = "00111865522699"
INVISIBLE = "​‌‍⁠﻿­"
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "Α": "A", "Β": "B", "Ε": "E", "Ο": "O"}
CHAOS_WEIGHTS = {"digits": 0.30, "case": 0.25, "spacing": 0.20, "corruption": 0.15, "entropy": 0.10}


def ocr_digits(text: Column) -> Column:
    """Characters mistaken for digits become those; the length stays."""
    return F.translate(text, OCR_FROM, OCR_TO)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


# The letters that a sound code names, and their digits; other letters part nothing.
SOUND_FROM = "BFPVCGJKQSXZDTLMNRAEIOUHWY"
SOUND_TO = "111122222222334556"


def soundex(text: Column) -> Column:
    """First letter and three digits. Only A-Z count; letters without a digit, vowels too, do not part equal digits, unlike in Spark's own
    function. 0000 without letters, null for null."""
    letters = F.regexp_replace(F.upper(text), "[^A-Z]", "")
    runs = F.regexp_replace(F.translate(letters, SOUND_FROM, SOUND_TO), r"(.)\1+", "$1")
    rest = F.when(F.regexp_like(letters, F.lit("^[AEIOUHWY]")), runs).otherwise(F.substr(runs, F.lit(2)))
    return F.concat(F.rpad(F.substr(letters, F.lit(1), F.lit(1)), 1, "0"), F.rpad(F.substr(rest, F.lit(1), F.lit(3)), 3, "0"))


def visible(text: Column) -> Column:
    """Invisible characters removed, look-alikes replaced."""
    return F.translate(F.translate(text, INVISIBLE, ""), "".join(HOMOGLYPHS), "".join(HOMOGLYPHS.values()))


def adversarial_score(text: Column) -> Column:
    """.3 min(invisible / 5, 1) + .4 min(look-alikes / 3, 1) + .5 if both Latin and Cyrillic or Greek letters occur, 1 at most."""
    gone = F.length(text) - F.length(F.translate(text, INVISIBLE, ""))
    alike = F.length(text) - F.length(F.translate(text, "".join(HOMOGLYPHS), ""))
    mixed = F.regexp_like(text, F.lit("[A-Za-z]")) & F.regexp_like(text, F.lit("[Ͱ-ӿ]"))
    return F.round(F.least(F.lit(1.0), F.least(gone / F.lit(5.0), F.lit(1.0)) * 0.3 + F.least(alike / F.lit(3.0), F.lit(1.0)) * 0.4 + F.when(mixed, 0.5).otherwise(0.0)), 6)


def chaos_score(text: Column) -> Column:
    """How noisy a text looks: digits inside words, mixed case, broken spacing, odd symbols; each part at most 1."""
    n = F.greatest(F.lit(100.0), F.length(text) / F.lit(10.0))
    part = lambda p: F.least(F.lit(1.0), 2 * F.regexp_count(text, F.lit(p)) / n)
    total = part("[a-z][0-9][a-z]") * CHAOS_WEIGHTS["digits"] + part("[a-z][A-Z]") * CHAOS_WEIGHTS["case"] + part("[a-z]  +[a-z]") * CHAOS_WEIGHTS["spacing"] + part("[#$%&*@]{2,}") * CHAOS_WEIGHTS["corruption"]
    return F.round(F.least(F.lit(1.0), total), 6)


def case_pattern(text: Column) -> Column:
    return F.when(F.regexp_like(text, F.lit("^[A-Z][a-z]+( [A-Z][a-z]+)*$")), "PROPER").when((F.upper(text) == text) & (F.lower(text) != text), "ALL_CAPS").when((F.lower(text) == text) & (F.upper(text) != text), "ALL_LOWER").otherwise("CHAOS")


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def jaro_of(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, hits = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    other = [c for c, u in zip(b, used) if u]
    swaps = sum(x != y for x, y in zip(hits, other)) // 2
    m = len(hits)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler_of(a: str, b: str) -> float:
    j = jaro_of(a, b)
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return j + same * 0.1 * (1 - j) if j > 0.7 else j


def osa_of(a: str, b: str) -> int:
    """Edit distance with swaps of neighbours, no part edited twice."""
    before, now = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(now[j] + 1, new[j - 1] + 1, now[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, now = now, new
    return now[-1]


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler_of(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.LongType())
def osa(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else osa_of(x, y) for x, y in zip(a, b)], dtype="Int64")


def deletes(word: Column) -> Column:
    """A word and all that deleting one character makes of it."""
    return F.array_distinct(F.concat(F.array(word), F.transform(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))))


def forms(word: Column, most: int) -> Column:
    """A word and all that deleting up to ``most`` characters makes of it."""
    out = F.array(word)
    for _ in range(most):
        out = F.array_distinct(F.flatten(F.transform(out, deletes)))
    return out


def fuzzy_lookup(tokens: DataFrame, terms: DataFrame, most: int = 2) -> DataFrame:
    """(token, term, distance): the nearest term within ``most`` edits of each distinct token (a swap of neighbours is one), ties to the smaller term.

    Each edit is at most one deletion on either side, so words within distance ``most`` share a form after up to ``most``
    deletions each. Joins are on those forms, never all against all. Tokens too long for any term are left out first.
    """
    d = terms.select("term").where("term is not null").distinct()
    longest = d.agg(F.max(F.length("term")).alias("_longest"))
    t = tokens.select("token").distinct().join(F.broadcast(longest), F.length("token") <= F.col("_longest") + most).select("token")
    keyed = d.select("term", F.explode(forms(F.col("term"), most)).alias("k"))
    met = t.select("token", F.explode(forms(F.col("token"), most)).alias("k")).join(keyed, "k").select("token", "term").distinct()
    near = met.where(F.levenshtein("token", "term", 2 * most) >= 0).withColumn("distance", osa("token", "term")).where(F.col("distance") <= most)
    return near.groupBy("token").agg(F.min_by("term", F.struct("distance", "term")).alias("term"), F.min("distance").cast("long").alias("distance"))
