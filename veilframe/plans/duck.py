"""DuckDB SQL for the detectors, from the same registry, over RE2 and list functions."""

from __future__ import annotations

from veilframe.functions.registry import SPECIFICITY, UNKNOWN_SPECIFICITY, Detector, Pattern

_D = "regexp_replace(v, '[^0-9]', '', 'g')"
_AT = f"CAST(substr({_D}, length({_D}) - k + 1, 1) AS INTEGER)"
LUHN = f"(list_sum(list_transform(range(1, length({_D}) + 1), lambda k: CASE WHEN k % 2 = 1 THEN {_AT} ELSE (2 * {_AT}) % 10 + (2 * {_AT}) // 10 END)) % 10 = 0)"


def text_of(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def pattern_sql(d: Detector, p: Pattern, source: str, key: str = "doc_id") -> str:
    r = text_of(p.regex)
    test = p.valid.replace("luhn(v)", LUHN)
    return f"""SELECT {key}, start, start + length(v) AS "end", v AS text, '{d.type}' AS type, {p.confidence}::DOUBLE AS confidence, {d.priority(p)} AS priority, '{d.name}:{p.name}' AS pattern FROM (
  SELECT {key}, v[i] AS v, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) + instr(m[i], v[i]) - 1)::BIGINT AS start FROM (
    SELECT {key}, m, v, g, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT {key}, regexp_extract_all(text, {r}, 0) AS m, regexp_extract_all(text, {r}, {p.group}) AS v, string_split_regex(text, {r}) AS g FROM {source} WHERE length(text) >= 3 AND regexp_matches(text, {r})))
) WHERE length(v) > 0 AND {test}"""


def detector_sql(d: Detector, source: str, key: str = "doc_id") -> str:
    return "\nUNION ALL\n".join(pattern_sql(d, p, source, key) for p in d.patterns)


def spans_sql(detectors, source: str, key: str = "doc_id") -> str:
    return "\nUNION ALL\n".join(detector_sql(d, source, key) for d in detectors)


def specificity_sql(column: str = "type") -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SPECIFICITY.items()) + f" ELSE {UNKNOWN_SPECIFICITY} END"
