"""Regular-expression matches with offsets, as column expressions.

One replacement puts a mark before and after every match and another behind it, with the group that is the value; splitting
at the first mark then gives gaps and matches in turn, and prefix sums of their lengths the offsets. So a text is searched
once for each pattern. The marks are two noncharacters; where a text holds one itself, it is searched with others in their
place. Offsets are code points, from 0, end-exclusive. Patterns never match the empty string.
"""

from __future__ import annotations

import re
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ``\\b`` as ASCII has it: Java's own boundary knows Unicode letters while its ``\\w`` does not.
BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"

SPAN = "struct<start: bigint, end: bigint, text: string, type: string, confidence: double, priority: int, pattern: string>"
PLACE = "struct<start: bigint, end: bigint, text: string>"
EDGE, VALUE, FOREIGN = "\ufdd0", "\ufdd1", "\ufffd"
#: Lengths are summed in chunks of so many, so that long lists of matches cost little more than in proportion.
CHUNK = 64

#: An atom that takes one ASCII word character: a digit, a letter, or a class of nothing else.
_WORD = r"(?:\\d|(?<!\\)[A-Za-z0-9]|\[(?:[A-Za-z0-9]-[A-Za-z0-9]|[A-Za-z0-9_]|\\d)+\])"
_FIRST = re.compile(rf"^((?:\(\?i\))?)\\b(?={_WORD}(?![?*]|\{{0)|\((?:\?:)?[A-Za-z0-9][^()|\[\\?*]*(?:\|[A-Za-z0-9][^()|\[\\?*]*)*\)(?![?*]|\{{0))")
_LAST = re.compile(rf"(?<=.)({_WORD}(?:\+|\{{[1-9]\d*(?:,\d*)?\}})?)\\b$")
#: An escape or a class, which may hold a ``$`` that means itself, or a ``$`` that is an anchor.
_END = re.compile(r"(\\.|\[(?:\\.|[^\]\\])*\])|\$")


def within_line(pattern: str) -> bool:
    """Whether no match holds a line break or depends on where text begins or ends, so that the lines of a text, each searched
    by itself, have all its matches. Only what surely is so passes."""

    def safe(op: object, arg: object) -> bool:
        name = str(op)
        if name == "LITERAL":
            return arg != 10
        if name == "NOT_LITERAL":
            return arg == 10
        if name == "IN":
            return all(str(o) != "NEGATE" and (str(o) != "CATEGORY" or str(a) in ("CATEGORY_DIGIT", "CATEGORY_WORD")) and (str(o) != "RANGE" or not a[0] <= 10 <= a[1]) and (str(o) != "LITERAL" or a != 10) for o, a in arg)
        if name == "AT":
            return str(arg) == "AT_BOUNDARY"
        if name == "BRANCH":
            return all(safe(*x) for branch in arg[1] for x in branch)
        if name in ("MAX_REPEAT", "MIN_REPEAT", "SUBPATTERN"):
            return all(safe(*x) for x in arg[-1])
        return False

    return all(safe(*x) for x in _parser.parse(pattern))


def java(pattern: str) -> str:
    """The pattern with ASCII boundaries. Where a word character must follow the first one, or stand before the last, half
    the test decides, which is much faster to search for. ``$`` is the text's very end, unless lines count (``m``)."""
    if not re.match(r"\(\?[a-z]*m", pattern):
        pattern = _END.sub(lambda m: m[1] or r"(?![\s\S])", pattern)
    if "|" not in re.sub(r"\([^()]*\)", "", re.sub(r"\([^()]*\)", "", pattern)):  # no alternatives outside groups
        pattern = _LAST.sub(r"\1(?!\\w)", _FIRST.sub(r"\1(?<!\\w)", pattern))
    return pattern.replace(r"\b", BOUNDARY)


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def quoted(s: str) -> str:
    """A string literal of Spark's SQL."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def searchable_sql(text: str) -> str:
    """SQL for the text without marks; its length stays."""
    return f"CASE WHEN contains({text}, '{EDGE}') OR contains({text}, '{VALUE}') THEN translate({text}, '{EDGE}{VALUE}', '{FOREIGN}{FOREIGN}') ELSE {text} END"


def lines_sql(text: str) -> str:
    """SQL for the lines of a text, without their breaks."""
    return f"split({text}, '\\n', -1)"


def pieces_sql(text: str, pattern: str, group: int = 0) -> str:
    """SQL for gap, match, gap, ... of a searchable text; a match is followed by a mark and the value if a group is that."""
    to = f"{EDGE}$0{f'{VALUE}${group}' if group else ''}{EDGE}"
    return f"split(regexp_replace({text}, {quoted(java(pattern))}, {quoted(to)}), '{EDGE}', -1)"


def _summed(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, n: a + n)


def starts(lengths: Column) -> Column:
    """The sum of all lengths before each."""

    def before(own: Column, base: Column) -> Column:
        return F.transform(own, lambda _, i: base + _summed(F.slice(own, F.lit(1), i)))

    def chunked(all_: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / CHUNK).cast("int")), lambda k: F.slice(all_, k * CHUNK + 1, CHUNK))
        summed = bound(parts, lambda p: F.struct(p.alias("p"), F.transform(p, _summed).alias("s")))
        return bound(summed, lambda x: F.flatten(F.transform(x["p"], lambda own, k: bound(_summed(F.slice(x["s"], F.lit(1), k)), lambda base: before(own, base)))))

    return F.when(F.size(lengths) <= CHUNK, before(lengths, F.lit(0).cast("bigint"))).otherwise(chunked(lengths))


def placed(parts: Column, group: Column) -> Column:
    """start, end and text of the matches of ``pieces``; ``group``: whether the value is a group."""

    def located(x: Column) -> Column:
        def one(k: Column) -> Column:
            whole, at = F.get(x["p"], k), F.get(x["s"], k)
            value = F.when(group, F.substring_index(whole, VALUE, -1)).otherwise(whole)
            start = at + F.when(group, F.instr(F.substring_index(whole, VALUE, 1), value) - 1).otherwise(0)
            return bound(F.struct(start.alias("start"), value.alias("v")), lambda y: F.struct(y["start"].alias("start"), (y["start"] + F.length(y["v"])).alias("end"), y["v"].alias("text")))

        return F.transform(F.sequence(F.lit(1), F.size(x["p"]) - 2, F.lit(2)), one)

    lengths = F.transform(parts, lambda p: F.length(F.substring_index(p, VALUE, 1)).cast("bigint"))
    known = bound(lengths, lambda n: starts(n))
    return F.when(F.size(parts) > 2, bound(F.struct(parts.alias("p"), known.alias("s")), located)).otherwise(F.array().cast(f"array<{PLACE}>"))


def original(text: Column, places: Column) -> Column:
    """Places whose text is that of ``text`` itself, marks and all."""
    marked = F.contains(text, F.lit(EDGE)) | F.contains(text, F.lit(VALUE))
    return bound(places, lambda own: F.when(marked, F.transform(own, lambda s: s.withField("text", F.substr(text, s["start"] + 1, s["end"] - s["start"])))).otherwise(own))


def matches(text: str, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, text>> of a pattern's matches in a column, or of one of its groups where that took part."""
    found = bound(F.expr(pieces_sql(searchable_sql(f"`{text}`"), pattern, group)), lambda p: placed(p, F.lit(bool(group))))
    return F.filter(original(F.col(text), found), lambda s: F.length(s["text"]) > 0)
