"""Detectors as column expressions: a text column to an array of spans, without a shuffle."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.match import SPAN, bound, lines_sql, original, pieces_sql, placed, quoted, searchable_sql, starts, within_line
from veilframe.functions.registry import DEFAULTS, Detector, Pattern


#: What gates look into: the text itself, its lower-cased form (``~``), and its shape (``#``), in which every digit is 0 and every capital A.
DIGITS, CAPITALS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ROW = "array<struct<p: array<string>, g: boolean, type: string, confidence: double, priority: int, pattern: string, line: int>>"


def opens(gate: str, view: str = "v") -> str:
    """SQL for whether every part of a gate (parts by `` & ``, its literals by ``|``) stands in the text; literals are searched for as they are."""
    parts = []
    for part in sorted(filter(None, gate.split(" & ")), key=lambda x: x.count("|")):  # what is quickly tried first
        where = {"~": "low", "#": "shape"}.get(part[0], "text")
        parts.append("(" + " OR ".join(f"contains({view}.{where}, {quoted(x.replace('¦', '|'))})" for x in part[where != "text" :].split("|")) + ")")
    return " AND ".join(parts) or "true"


def views(text: str) -> str:
    """SQL for the struct that gates look into."""
    return f"named_struct('text', {searchable_sql(text)}, 'low', lower({text}), 'shape', translate({text}, '{DIGITS + CAPITALS}', '{'0' * 10 + 'A' * 26}'))"


def _test(valid: str) -> str:
    """A test of the registry in Spark's SQL, over the text of a span ``s``."""
    return re.sub(r"\bv\b", "s.text", valid.replace("luhn(v)", "luhn_check(regexp_replace(v, '[^0-9]', ''))").replace(", 'g')", ")"))


def needs_digit(d: Detector) -> bool:
    """Whether the detector's gate lets no text without a digit through."""
    return any(part[0] == "#" and all("0" in x for x in part[1:].split("|")) for part in filter(None, d.gate.split(" & ")))


def _rows(detectors: Iterable[tuple[Detector, list[Pattern]]], line: str) -> str:
    """SQL for the pieces of the patterns whose gates open for ``v``; what several gates of a detector ask for is looked for once."""
    groups = []
    for d, patterns in detectors:
        own: dict[str, list[str]] = {}
        for p in patterns:
            source = "v.text" if within_line(p.regex) or not p.by_line else "concat(v.text, CASE WHEN i < size(ls) - 1 THEN '\\n' ELSE '' END)"
            row = f"named_struct('p', {pieces_sql(source, p.regex, p.group)}, 'g', {str(bool(p.group)).lower()}, 'type', '{d.type}', 'confidence', {p.confidence}D, 'priority', {d.priority(p)}, 'pattern', {quoted(f'{d.name}:{p.name}')}, 'line', {line})"
            asked = p.gate.split(" & ")
            most = max(asked, key=lambda x: x.count("|"))
            shared = most if sum(most in q.gate.split(" & ") for q in patterns) > 1 else ""
            rest = " & ".join(x for x in asked if x != shared)
            own.setdefault(shared, []).append(f"CASE WHEN {opens(rest)} THEN {row} END" if rest else row)
        if own:
            inner = [f"CASE WHEN {opens(part)} THEN array({', '.join(rows)}) END" if part else f"array({', '.join(rows)})" for part, rows in own.items()]
            groups.append(f"CASE WHEN {opens(d.gate)} THEN {inner[0] if len(inner) == 1 else f'flatten(filter(array({", ".join(inner)}), x -> x IS NOT NULL))'} END")
    every = f"flatten(filter(array({', '.join(groups)}), x -> x IS NOT NULL))"
    return f"filter({every}, x -> x IS NOT NULL AND size(x.p) > 1)" if groups else f"CAST(array() AS {ROW})"


@lru_cache(maxsize=64)
def _tried(detectors: tuple[Detector, ...], text: str) -> tuple[str, str]:
    """SQL for the pieces of all patterns whose gates open, and for the test of a span. As text, since building so large an
    expression call by call takes longer than many a query.

    Gates are tried for each line, and a pattern searches the lines its gates open for; only patterns that take line breaks are
    tried for the text as a whole. Detectors that need a digit pass lines without one together."""
    lined = lambda p: p.by_line or within_line(p.regex)
    of = lambda own, by_line: [(d, [p for p in d.patterns if lined(p) == by_line]) for d in own]
    digits, others = [d for d in detectors if needs_digit(d)], [d for d in detectors if not needs_digit(d)]
    parts = []
    if digits or others:
        numeric = f"CASE WHEN v.text RLIKE '[0-9]' THEN {_rows(of(digits, True), 'i')} ELSE CAST(array() AS {ROW}) END"
        found = [x for x, own in ((numeric, digits), (_rows(of(others, True), "i"), others)) if own]
        in_line = found[0] if len(found) == 1 else f"concat({', '.join(found)})"
        parts.append(f"get(transform(array({lines_sql(searchable_sql(text))}), ls -> flatten(transform(ls, (l, i) -> get(transform(array({views('l')}), v -> {in_line}), 0)))), 0)")
    if any(own for _, own in of(detectors, False)):
        parts.append(f"get(transform(array({views(searchable_sql(text))}), v -> {_rows(of(detectors, False), '-1')}), 0)")
    tests = [f"WHEN {quoted(f'{d.name}:{p.name}')} THEN {_test(p.valid)}" for d in detectors for p in d.patterns if p.valid != "true"]
    tried = "concat(" + ", ".join(parts) + ")" if parts else f"CAST(array() AS {ROW})"
    valid = f"length(s.text) > 0 AND (CASE s.pattern {' '.join(tests)} ELSE true END)" if tests else "length(s.text) > 0"
    return f"CASE WHEN length({text}) >= 3 THEN {tried} ELSE CAST(array() AS {ROW}) END", valid


def detect(docs: DataFrame, detectors: Iterable[Detector] = DEFAULTS, text: str = "text") -> DataFrame:
    """``docs`` with a column ``spans``, ordered by place, then by type and pattern; texts shorter than 3 and null texts have none.

    A pattern is tried only where its detector's gate and its own open, and each line is searched once for it. All matches go
    through one lambda, which keeps the plan small.
    """
    tried, valid = _tried(tuple(detectors), f"`{text}`")

    def named(x: Column, at: Column) -> Column:
        base = F.coalesce(F.get(at, x["line"]), F.lit(0).cast("bigint"))
        return bound(base, lambda b: F.transform(placed(x["p"], x["g"]), lambda s: F.struct((s["start"] + b).alias("start"), (s["end"] + b).alias("end"), s["text"].alias("text"), x["type"].alias("type"), x["confidence"].alias("confidence"), x["priority"].alias("priority"), x["pattern"].alias("pattern"))))

    lengths = F.expr(f"transform({lines_sql(f'`{text}`')}, l -> CAST(length(l) + 1 AS BIGINT))")
    placed_ = bound(F.expr(tried), lambda rows: F.when(F.size(rows) == 0, F.array().cast(f"array<{SPAN}>")).otherwise(bound(bound(lengths, starts), lambda at: F.flatten(F.transform(rows, lambda x: named(x, at))))))
    rows = docs.withColumn("spans", original(F.col(text), placed_))
    return rows.withColumn("spans", F.array_sort(F.expr(f"filter(spans, s -> {valid})")))


def exploded(docs: DataFrame, *keep: str) -> DataFrame:
    """One row a span: the columns ``keep``, then those of the span.

    The outer form, because for the inner one the optimiser puts a filter on the array's size below the projection that makes
    the array, and so makes it twice or, inside a lambda, once for each element.
    """
    return docs.select(*keep, F.explode_outer("spans").alias("_s")).where("_s is not null").select(*keep, "_s.*")
