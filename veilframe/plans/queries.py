"""Named queries over the tables, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.registry import BY_NAME, DEFAULTS, DETECTORS
from veilframe.operators import governance as gov
from veilframe.operators import lookup, measure, normalize, postfilter, score, words
from veilframe.operators.apply import TOKEN, redact, restore, tokenize
from veilframe.operators.detect import detect, exploded
from veilframe.operators.resolve import FIELD_WORDS, resolve
from veilframe.plans import chain
from veilframe.plans.duck import detector_sql, spans_sql, specificity_sql, text_of
from veilframe.session import materialized
from veilframe.sources import CLINICAL, clinical, spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
#: Detectors that the composite queries use.
CORE = tuple(BY_NAME[n] for n in ("ssn", "phone", "fax", "email", "zip", "ipv4", "mrn", "date", "name_last_first", "name_labelled", "name_family", "provider_name", "age_90_plus", "address", "health_plan"))
NATURAL = ("email", "phone", "ipv4", "credit_card", "url")
CLIN = f"clin AS MATERIALIZED ({CLINICAL})"
SPANS = f"WITH {CLIN}, spans AS MATERIALIZED ({spans_sql(CORE, 'clin')})"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def core(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The clinical fixture and its long spans."""
    docs = clinical(spark, sf_dir)
    return docs, materialized(exploded(detect(docs, CORE), "doc_id"), "spans")


# ---- detectors -------------------------------------------------------------------------------------------------------

def _detector_query(name: str) -> None:
    d = BY_NAME[name]
    natural = name in NATURAL and name != "url"
    cols = ["doc_id", "start", "end", "text", "type", "confidence", "pattern"]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = spread(table(spark, sf_dir, "documents", "doc_id", "text")) if natural else clinical(spark, sf_dir)
        return exploded(detect(docs, [d]), "doc_id").select(*cols)

    QUERIES[f"detect_{name}"] = run
    source = "documents" if natural else "clin"
    ORACLE[f"detect_{name}"] = ("" if natural else f"WITH {CLIN} ") + f'SELECT doc_id, start, "end", text, type, confidence, pattern FROM ({detector_sql(d, source)})'


for _d in DETECTORS:
    _detector_query(_d.name)


@query('WITH s AS (' + spans_sql([BY_NAME[n] for n in NATURAL], "documents") + ') SELECT type, count(*) AS n, count(DISTINCT doc_id) AS docs FROM s GROUP BY type')
def span_counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = exploded(detect(spread(table(spark, sf_dir, "documents", "doc_id", "text")), [BY_NAME[n] for n in NATURAL]), "doc_id")
    return s.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(SPANS + " SELECT doc_id, count(*) AS n, count(DISTINCT type) AS types FROM spans GROUP BY doc_id")
def spans_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core(spark, sf_dir)[1].groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("type").alias("types"))


_PAIRS = """pairs AS (SELECT a.doc_id, a.start AS a_start, a."end" AS a_end, a.text AS a_text, a.type AS a_type, a.confidence AS a_confidence, a.pattern AS a_pattern,
 b.start AS b_start, b."end" AS b_end, b.text AS b_text, b.type AS b_type, b.confidence AS b_confidence, b.pattern AS b_pattern, greatest(b.start - a."end", a.start - b."end", 0) AS gap
 FROM spans a JOIN spans b ON a.doc_id = b.doc_id AND (a.start, a."end", a.type, a.pattern) < (b.start, b."end", b.type, b.pattern) WHERE greatest(b.start - a."end", a.start - b."end", 0) <= 200)"""


@query(SPANS + f", {_PAIRS} SELECT least(a_type, b_type) AS first_type, greatest(a_type, b_type) AS second_type, count(*) AS n FROM pairs GROUP BY ALL")
def type_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = score.nearby_pairs(core(spark, sf_dir)[1])
    return p.groupBy(F.least("a_type", "b_type").alias("first_type"), F.greatest("a_type", "b_type").alias("second_type")).agg(F.count(F.lit(1)).alias("n"))


@query(SPANS + """ SELECT a.doc_id, a.start AS a_start, a."end" AS a_end, a.type AS a_type, b.start AS b_start, b."end" AS b_end, b.type AS b_type FROM spans a JOIN spans b ON a.doc_id = b.doc_id
 AND (a.start, a."end", a.type, a.pattern) < (b.start, b."end", b.type, b.pattern) AND a.start < b."end" AND b.start < a."end" """)
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = score.nearby_pairs(core(spark, sf_dir)[1]).where("a_start < b_end and b_start < a_end")
    return p.select("doc_id", "a_start", "a_end", "a_type", "b_start", "b_end", "b_type")


@query(SPANS + """ SELECT doc_id, lower(trim(text)) AS norm, count(*) AS n, count(DISTINCT type) AS types, min(type) AS first_type FROM spans GROUP BY ALL HAVING count(*) >= 2""")
def same_text_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core(spark, sf_dir)[1].groupBy("doc_id", F.lower(F.trim("text")).alias("norm")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("type").alias("types"), F.min("type").alias("first_type")).where("n >= 2")


# ---- scoring ---------------------------------------------------------------------------------------------------------

_BODY = 'SELECT s.*, c.text AS body FROM spans s JOIN clin c USING (doc_id)'
_WINDOW = f"""win AS (SELECT doc_id, start, "end", text, type, confidence, pattern,
 list_transform(list_concat(list_reverse(list_reverse(regexp_extract_all(substr(body, 1, start), '\\w+'))[1:5]), regexp_extract_all(substr(body, "end" + 1), '\\w+')[1:5]), lambda x: lower(x)) AS w,
 regexp_matches(substr(body, greatest(0, start - 50) + 1, start - greatest(0, start - 50)), {text_of(score.TITLE)}) AS titled, regexp_matches(substr(body, greatest(0, start - 50) + 1, "end" + 50 - greatest(0, start - 50)), {text_of(score.ALONE)}) AS alone FROM ({_BODY}))"""


@query(SPANS + f""", {_WINDOW} SELECT doc_id, start, "end", type, pattern, array_to_string(w, ' ') AS "window" FROM win""")
def span_window_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, s = core(spark, sf_dir)
    return score.window_tokens(s, docs).select("doc_id", "start", "end", "type", "pattern", F.concat_ws(" ", "window").alias("window"))


def _modifier_sql() -> str:
    t = f"(CASE WHEN type = 'NAME' AND titled AND confidence < 0.98 THEN least(1.0, confidence * {score.TITLE_FACTOR}::DOUBLE) ELSE confidence END)"
    whens = " ".join(f"WHEN type = '{k}' AND list_has_any(w, [{', '.join(text_of(x) for x in f)}]) AND {t} < 0.98 THEN least(1.0, {t} * {m}::DOUBLE)" for k, f, m in score.CONTEXT_RULES)
    c = f"(CASE {whens} ELSE {t} END)"
    return f"round(CASE WHEN type = 'NAME' AND alone AND {c} > 0.02 THEN {c} * {score.ALONE_FACTOR}::DOUBLE ELSE {c} END, 6)"


@query(SPANS + f', {_WINDOW} SELECT doc_id, start, "end", type, pattern, {_modifier_sql()} AS confidence FROM win')
def context_modifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, s = core(spark, sf_dir)
    return score.context_modifiers(score.window_tokens(s, docs)).select("doc_id", "start", "end", "type", "pattern", F.round("confidence", 6).alias("confidence"))


def _fields_sql() -> str:
    parts = []
    for rank, (names, expected, sure) in enumerate(score.FIELD_LABELS):
        r = text_of(score.label_pattern(names))
        parts.append(f"""SELECT doc_id, text, '{expected}' AS expected, {sure}::DOUBLE AS sure, {rank} AS rank, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::BIGINT AS label_start, length(m[i]) AS n
 FROM (SELECT doc_id, text, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, text, regexp_extract_all(text, {r}) AS m, string_split_regex(text, {r}) AS g FROM clin WHERE regexp_matches(text, {r})))""")
    blank = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"
    return f"""fields AS (SELECT doc_id, label_start, label_start + n + lead AS value_start, label_start + n + lead + length(value) AS value_end, expected, sure, rank FROM (
 SELECT *, rtrim(regexp_extract(substr(tail, lead + 1), '^([^\\n]*?)(?:\\n|[A-Z][A-Z \\t\\n\\x0B\\f\\r]*:|$)', 1), {blank}) AS value FROM (SELECT *, length(regexp_extract(tail, '^([ \\t\\x0B\\f\\r]*\\n?[ \\t]*)', 1)) AS lead FROM (SELECT *, substr(text, label_start + n + 1) AS tail FROM ({' UNION ALL '.join(parts)})))) WHERE length(value) > 0)"""


@query(f"WITH {CLIN}, {_fields_sql()} SELECT doc_id, label_start, value_start, value_end, expected, sure FROM fields")
def field_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.field_contexts(clinical(spark, sf_dir)).drop("rank")


@query(SPANS + f""", {_fields_sql()}, met AS (SELECT s.doc_id, s.start, s."end", s.type, s.pattern, min_by(f.expected, f.rank) AS expected FROM spans s JOIN fields f ON s.doc_id = f.doc_id AND s.start < f.value_end AND f.value_start < s."end" GROUP BY ALL)
SELECT s.doc_id, s.start, s."end", s.type, s.pattern, round(CASE WHEN m.expected IS NULL THEN confidence WHEN m.expected = s.type THEN least(1.0, confidence * 1.15::DOUBLE) ELSE confidence * 0.8::DOUBLE END, 6) AS confidence, (CASE WHEN m.expected = s.type THEN greatest(priority, 90) ELSE priority END)::INTEGER AS priority
FROM spans s LEFT JOIN met m ON s.doc_id = m.doc_id AND s.start = m.start AND s."end" = m."end" AND s.type = m.type AND s.pattern = m.pattern""")
def field_context_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, s = core(spark, sf_dir)
    return score.field_boost(s, score.field_contexts(docs)).select("doc_id", "start", "end", "type", "pattern", F.round("confidence", 6).alias("confidence"), "priority")


def _strength_sql(text: str) -> tuple[str, str]:
    counts = [("(" + " + ".join(f"len(regexp_extract_all({text}, {text_of(p)}))" for p in patterns) + ")", w) for _, patterns, w in score.CLINICAL]
    total = "(" + " + ".join(f"{n} * {w}::DOUBLE" for n, w in counts) + ")"
    kinds = "(" + " + ".join(f"({n} > 0)::INT" for n, _ in counts) + ")"
    return total, f"CASE WHEN {total} >= 1.5 OR ({total} >= 0.8 AND {kinds} >= 2) THEN 'STRONG' WHEN {total} >= 0.7 OR {kinds} >= 2 THEN 'MODERATE' WHEN {total} > 0 THEN 'WEAK' ELSE 'NONE' END"


@query(f"SELECT doc_id, round({_strength_sql('text')[0]}, 6) AS weight, {_strength_sql('text')[1]} AS strength FROM ({CLINICAL})")
def clinical_context_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clinical(spark, sf_dir).select("doc_id", score.clinical_context(F.col("text")).alias("c")).select("doc_id", "c.weight", "c.strength")


_NEAR = 'substr(body, greatest(0, start - {n}) + 1, "end" + {n} - greatest(0, start - {n}))'


@query(SPANS + f""" SELECT doc_id, start, "end", type, pattern, round(greatest(confidence, least(0.99, confidence + CASE WHEN type IN {score.INDEPENDENT} THEN CASE k WHEN 'STRONG' THEN 0.075 WHEN 'MODERATE' THEN 0.05 ELSE 0.0 END ELSE CASE k WHEN 'STRONG' THEN 0.15 WHEN 'MODERATE' THEN 0.10 WHEN 'WEAK' THEN 0.05 ELSE 0.0 END END)), 6)::DOUBLE AS confidence
FROM (SELECT *, {_strength_sql('near')[1]} AS k FROM (SELECT *, {_NEAR.format(n=150)} AS near FROM ({_BODY})))""")
def clinical_context_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, s = core(spark, sf_dir)
    return score.clinical_boost(s, docs).select("doc_id", "start", "end", "type", "pattern", F.round("confidence", 6).alias("confidence"))


def _any(words: str, xs: tuple) -> str:
    return f"list_has_any({words}, [{', '.join(text_of(x) for x in xs)}])"


_W = "string_split_regex(lower(text), '[^a-z]+')"


@query(SPANS + f""" SELECT doc_id, start, "end", type, pattern, round(CASE WHEN confidence >= 0.92 OR (type IN {score.HIGH_PRECISION} AND confidence >= 0.88) OR confidence <= 0.15 THEN confidence ELSE greatest(0.0, least(1.0, base + CASE WHEN type = 'NAME' THEN gain - penalty ELSE 0.0 END)) END, 6)::DOUBLE AS confidence FROM (
SELECT *, CASE WHEN type IN {score.HIGH_PRECISION} THEN 0.95 WHEN type = 'NAME' THEN CASE WHEN contains(lower(pattern), 'last_first') THEN 0.95 WHEN contains(lower(pattern), 'title') THEN 0.92 WHEN contains(lower(pattern), 'label') THEN 0.90 WHEN contains(lower(pattern), 'family') THEN 0.90 ELSE 0.70 END ELSE confidence END AS base,
 CASE WHEN regexp_matches(near, '(?:dr|mr|mrs|ms)\\. ') THEN 0.25 ELSE 0.0 END + CASE WHEN regexp_matches(near, 'wife|husband|mother|father|son|daughter') THEN 0.30 ELSE 0.0 END + CASE WHEN regexp_matches(near, 'name:|patient:') THEN 0.20 ELSE 0.0 END AS gain,
 CASE WHEN {_any(_W, score.STRUCTURE)} THEN 0.85 WHEN {_any(_W, score.MEDICAL)} THEN 0.80 WHEN {_any(_W, score.GEOGRAPHIC)} THEN 0.60 ELSE 0.0 END AS penalty FROM (SELECT *, lower({_NEAR.format(n=100)}) AS near FROM ({_BODY})))""")
def weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, s = core(spark, sf_dir)
    return score.weighted(s, docs).select("doc_id", "start", "end", "type", "pattern", F.round("confidence", 6).alias("confidence"))


_RULES = "rules(a_type, b_type, kind, strength, hint) AS (VALUES " + ", ".join(f"('{min(a, b)}', '{max(a, b)}', '{k}', {x}::DOUBLE, {score.hints().index(h) + 1 if h else 'NULL::INT'})" for a, b, k, x, h in score.PAIR_RULES) + ")"
_HINTED = f"""hinted AS (SELECT *, [{", ".join(f"regexp_matches(near, {text_of(h)})" for h in score.hints())}] AS hints
 FROM (SELECT *, concat(substr(body, greatest(0, start - 100) + 1, start - greatest(0, start - 100)), ' ', substr(body, "end" + 1, 100)) AS near FROM ({_BODY})))"""
_HINTED_PAIRS = _PAIRS.replace("FROM spans a JOIN spans b", "FROM hinted a JOIN hinted b").replace("SELECT a.doc_id", "SELECT a.hints AS a_hints, b.hints AS b_hints, a.doc_id")
_DOWN = "CASE WHEN kind = 'SUPPORTIVE' THEN 0.2 * strength WHEN {0} < {1} THEN -0.5 * strength WHEN {0} = {1} THEN -0.25 * strength ELSE 0 END"


@query(SPANS + f""", {_HINTED}, {_HINTED_PAIRS}, {_RULES}, met AS (SELECT p.*, r.kind, r.strength FROM pairs p JOIN rules r ON least(p.a_type, p.b_type) = r.a_type AND greatest(p.a_type, p.b_type) = r.b_type WHERE r.hint IS NULL OR p.a_hints[r.hint] OR p.b_hints[r.hint]),
moved AS (SELECT doc_id, a_start AS start, a_end AS "end", a_type AS type, a_pattern AS pattern, {_DOWN.format('a_confidence', 'b_confidence')} AS delta FROM met UNION ALL SELECT doc_id, b_start, b_end, b_type, b_pattern, {_DOWN.format('b_confidence', 'a_confidence')} FROM met),
normed AS (SELECT *, regexp_replace(lower(trim(text)), '\\s+', ' ', 'g') AS norm FROM spans),
counts AS (SELECT doc_id, norm, type, count(*) AS n, min(start) AS first FROM normed GROUP BY ALL), most AS (SELECT doc_id, norm, max_by(type, (n, -first, type)) AS most FROM counts GROUP BY ALL HAVING max(n) >= 2),
allof AS (SELECT * FROM moved UNION ALL SELECT s.doc_id, s.start, s."end", s.type, s.pattern, CASE WHEN s.type = m.most THEN 0.10 ELSE -0.125 END FROM normed s JOIN most m USING (doc_id, norm)),
total AS (SELECT doc_id, start, "end", type, pattern, sum(delta) AS delta FROM allof GROUP BY ALL)
SELECT s.doc_id, s.start, s."end", s.type, s.pattern, round(greatest(0.0, least(1.0, s.confidence + coalesce(t.delta, 0))), 6)::DOUBLE AS confidence FROM spans s LEFT JOIN total t ON s.doc_id = t.doc_id AND s.start = t.start AND s."end" = t."end" AND s.type = t.type AND s.pattern = t.pattern""")
def cross_type_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, s = core(spark, sf_dir)
    return score.cross_type(s, docs).select("doc_id", "start", "end", "type", "pattern", "confidence")


@query(SPANS + """, g AS (SELECT doc_id, start, "end", max_by(type, (confidence, priority, type, pattern)) AS best, max(confidence) AS confidence, list_sort(list_distinct(list(type))) AS types FROM spans GROUP BY doc_id, start, "end")
SELECT doc_id, start, "end", best AS type, confidence, array_to_string(list_filter(types, lambda t: t <> best), ',') AS ambiguous_with FROM g""")
def same_place_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.same_place(core(spark, sf_dir)[1]).select("doc_id", "start", "end", "type", "confidence", F.concat_ws(",", "ambiguous_with").alias("ambiguous_with"))


def _votes_sql() -> str:
    found = {t: "(" + " + ".join(f"regexp_matches(near, {text_of(p)})::INT" for p in ps) + ")" for t, ps in score.INDICATORS.items()}
    rows = (f"SELECT *, '{own}' AS own, '{other}' AS alternative, {found[own]} * {score.OWN_WEIGHT}::DOUBLE AS a, {found[other]} * {weight}::DOUBLE AS b FROM about WHERE type = '{own}'" for own, other, weight in score.ALTERNATIVES)
    return " UNION ALL ".join(rows)


@query(SPANS + f""", about AS (SELECT *, {_NEAR.format(n=100)} AS near FROM ({_BODY})), votes AS ({_votes_sql()})
SELECT doc_id, start, "end", type, pattern, alternative, CASE WHEN b > a THEN alternative ELSE own END AS winner, round(CASE WHEN a = b THEN 0.5 ELSE least(0.95::DOUBLE, 0.5 + greatest(a, b)) END, 6)::DOUBLE AS sure FROM votes""")
def type_disambiguation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, s = core(spark, sf_dir)
    return score.disambiguated(s, docs).select("doc_id", "start", "end", "type", "pattern", "alternative", "winner", "sure")


_PERSON = f"(regexp_matches(trim(text), {text_of(score.PERSON_TITLE)}) OR regexp_matches(trim(text), {text_of(score.PERSON_SUFFIX)}))"
_LOW = "lower(trim(text))"
_STRUCTURE = "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in score.STRUCTURE) + f" OR regexp_matches({_LOW}, {text_of(score.one_of(words.STRUCTURE_PARTS))}))"
_SPACED, _SINGLE = f"string_split_regex({_LOW}, {text_of(score.WHITE)})", f"list_filter(string_split_regex({_LOW}, {text_of(score.WHITE_COMMA)}), lambda w: length(w) > 2)"
_LISTED = f"""({_any(f"list_filter({_W}, lambda w: length(w) > 2)", score.STRUCTURE + score.MEDICAL)} OR regexp_matches({_LOW}, {text_of(score.one_of(score.PARTS))}) OR {_LOW} IN {score.WHOLE} OR {_any(_SINGLE, score.WHOLE)} OR {_any(_SPACED, words.PROCEDURES)}
 OR ({_any(_SPACED, words.EPONYMS)} AND regexp_matches({_LOW}, {text_of(score.BESIDE)}))
 OR (type = 'NAME' AND ({_any(_SPACED, words.PLACE_WORDS)} OR {_any(_SINGLE, words.PLACE_WORDS + words.NEVER_NAMES)} OR list_has_all([{', '.join(map(text_of, words.NEVER_NAMES))}], {_SPACED}))))"""


@query(SPANS + f""" SELECT doc_id, start, "end", type, pattern, text FROM spans WHERE type IN {score.CLOSED} OR (contains(pattern, 'Labeled name field') AND confidence >= 0.95)
 OR NOT CASE WHEN {_PERSON} THEN {_STRUCTURE} ELSE {_LISTED} END""")
def whitelist_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.whitelist_filter(core(spark, sf_dir)[1]).select("doc_id", "start", "end", "type", "pattern", "text")


_LINE = """concat(list_last(string_split(substr(body, 1, start), chr(10))), string_split(substr(body, start + 1), chr(10))[1])"""


@query(SPANS + f""" SELECT doc_id, start, "end", type, pattern, text FROM (SELECT *, {_LINE} AS line FROM ({_BODY})) WHERE NOT (type = 'NAME' AND upper(line) = line AND ({' OR '.join(f"contains(line, '{h}')" for h in score.HEADINGS)}) AND NOT contains(line, ':'))""")
def all_caps_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, s = core(spark, sf_dir)
    return score.all_caps_filter(s, docs).select("doc_id", "start", "end", "type", "pattern", "text")


@query(SPANS + """ SELECT doc_id, start, "end", type, pattern, base, length_factor, total, CASE WHEN total >= 0.6 THEN 'REDACT' ELSE 'KEEP' END AS decision FROM (SELECT *, round(greatest(0.0, least(1.0, confidence + 0.10 + CASE WHEN priority >= 90 THEN 0.05 ELSE 0.0 END + length_factor)), 6)::DOUBLE AS total FROM (SELECT *, confidence AS base, (CASE WHEN length(text) >= 8 THEN 0.05 WHEN length(text) < 3 THEN -0.05 ELSE 0.0 END)::DOUBLE AS length_factor FROM spans))""")
def explain_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.explain(core(spark, sf_dir)[1])


@query("""WITH v AS (SELECT doc_id AS id, s, CASE s WHEN 'pattern' THEN 0.30 WHEN 'dictionary' THEN 0.25 ELSE 0.20 END AS w, ((doc_id * (CASE s WHEN 'pattern' THEN 7 WHEN 'dictionary' THEN 13 ELSE 29 END)) % 100 / 100.0)::DOUBLE AS c FROM documents, (VALUES ('pattern'), ('dictionary'), ('context')) t(s)),
g AS (SELECT id, exp(sum(w::DOUBLE * ln(greatest(c, 0.01))) / sum(w::DOUBLE)) AS mean, avg((c >= 0.5)::INT::DOUBLE) AS p, sum((c >= 0.5)::INT) AS yes FROM v GROUP BY id),
h AS (SELECT *, least(1.2, 1.15 - 0.3 * (CASE WHEN p <= 0 OR p >= 1 THEN 0.0 ELSE -(p * log2(p) + (1 - p) * log2(1 - p)) END) + CASE WHEN yes >= 2 THEN 0.05 ELSE 0.0 END) AS f FROM g),
r AS (SELECT id, round(greatest(0.0, least(1.0, mean * f)), 6)::DOUBLE AS score FROM h)
SELECT id, score, CASE WHEN score >= 0.65 THEN 'REDACT' WHEN score <= 0.35 THEN 'SKIP' ELSE 'UNCERTAIN' END AS decision FROM r""")
def ensemble_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id")
    signals = F.explode(F.array(*[F.struct(F.lit(w).alias("w"), ((F.col("doc_id") * k % 100) / 100.0).alias("c"), F.lit(n).alias("signal")) for n, w, k in (("pattern", 0.30, 7), ("dictionary", 0.25, 13), ("context", 0.20, 29))]))
    return score.ensemble_vote(d.select(F.col("doc_id").alias("id"), signals.alias("s")).select("id", "s.*"))


# ---- thresholds and post-filter --------------------------------------------------------------------------------------

_DOCTYPE = "CASE " + " ".join(f"WHEN regexp_matches(text, {text_of(p)}) THEN '{n}'" for n, p, _ in postfilter.DOCUMENT_TYPES) + " ELSE 'general' END"
_SPEC = ", ".join(f"len(regexp_extract_all(text, {text_of(p)})) * {w} AS s{i}" for i, (_, p, w) in enumerate(postfilter.SPECIALTIES))
_BEST = f"greatest({', '.join(f's{i}' for i in range(len(postfilter.SPECIALTIES)))})"
_SPECIALTY = f"CASE WHEN {_BEST} >= 2 THEN CASE " + " ".join(f"WHEN s{i} = {_BEST} THEN '{n}'" for i, (n, _, _) in enumerate(postfilter.SPECIALTIES)) + " ELSE 'general' END ELSE 'general' END"


@query(f"SELECT doc_id, {_DOCTYPE} AS document_type, {_SPECIALTY} AS specialty FROM (SELECT *, {_SPEC} FROM ({CLINICAL}))")
def document_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clinical(spark, sf_dir).select("doc_id", postfilter.document_type(F.col("text")).alias("document_type"), postfilter.specialty(F.col("text")).alias("specialty"))


def _case(column: str, t: dict) -> str:
    return f"(CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in t.items()) + " ELSE 1.0::DOUBLE END)"


_MIN = f"round(greatest(0.3, least(0.99, 0.60::DOUBLE * {_case('dt', {n: f for n, _, f in postfilter.DOCUMENT_TYPES})} * {_case('st', postfilter.STRENGTH_FACTOR)} * {_case('type', postfilter.TYPE_FACTOR)})), 6)::DOUBLE"
_DOCS = f"d AS (SELECT doc_id, {_DOCTYPE} AS dt, {_strength_sql('text')[1]} AS st FROM clin)"


@query(SPANS + f", {_DOCS} SELECT doc_id, start, \"end\", type, pattern, {_MIN} AS minimum, confidence >= {_MIN} AS kept FROM spans JOIN d USING (doc_id)")
def adaptive_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, s = core(spark, sf_dir)
    d = docs.select("doc_id", postfilter.document_type(F.col("text")).alias("dt"), score.clinical_strength(F.col("text"))[1].alias("st"))
    m = postfilter.minimum(F.col("dt"), F.col("st"), F.col("type"))
    return s.join(d, "doc_id").select("doc_id", "start", "end", "type", "pattern", m.alias("minimum"), (F.col("confidence") >= m).alias("kept"))


def _ends(xs: tuple) -> str:
    return "(" + " OR ".join(f"ends_with(lower(text), {text_of(x)})" for x in xs) + ")"


_AFTER = "trim(regexp_replace(regexp_extract(text, '(?s)\\A.*?\\r?\\n(.*)\\z', 1), '\\r?\\n', ' ', 'g'), ' ' || chr(9) || chr(12))"
def _holds(xs: tuple) -> str:
    return _any(f"string_split_regex(lower(text), {text_of(postfilter.WHITE)})", tuple(x.lower() for x in xs))


_REMOVED = f"""CASE WHEN confidence < {_MIN} THEN 'threshold' WHEN type IN ('DEVICE', 'PHONE') AND regexp_matches(lower(text), 'call button|room:|bed:') THEN 'device_phone'
 WHEN type = 'NAME' THEN CASE WHEN regexp_matches(text, '^[A-Z\\s]+\\z') AND trim(text, ' ' || chr(9) || chr(10) || chr(12) || chr(13)) IN {postfilter.HEADINGS} THEN 'heading' WHEN {_holds(words.STRUCTURE_WORDS)} THEN 'structure' WHEN length(text) < 5 AND NOT contains(text, ',') AND confidence < 0.9 THEN 'short'
 WHEN {' OR '.join(f"starts_with(text, '{x}')" for x in postfilter.INVALID_PREFIXES)} THEN 'prefix' WHEN {_ends(postfilter.INVALID_SUFFIXES)} THEN 'suffix' WHEN regexp_matches({_AFTER}, {text_of(postfilter.BREAK_LABEL)}) OR (length({_AFTER}) <= 24 AND contains({_AFTER}, ':')) THEN 'line_break' WHEN lower(text) IN {words.MEDICAL_PHRASES} THEN 'medical'
 WHEN {' OR '.join(f"ends_with(text, '{x}')" for x in postfilter.MEDICAL_SUFFIXES)} THEN 'medical_suffix' WHEN {_holds(words.PLACES)} THEN 'geographic' WHEN lower(text) IN {words.FIELD_LABELS} THEN 'label' END END"""


@query(SPANS + f', {_DOCS} SELECT doc_id, start, "end", type, pattern, {_REMOVED} AS removed_by FROM spans JOIN d USING (doc_id)')
def postfilter_removed_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, s = core(spark, sf_dir)
    d = docs.select("doc_id", postfilter.document_type(F.col("text")).alias("dt"), score.clinical_strength(F.col("text"))[1].alias("st"))
    m = postfilter.minimum(F.col("dt"), F.col("st"), F.col("type"))
    return s.join(d, "doc_id").select("doc_id", "start", "end", "type", "pattern", postfilter.removed_by(m).alias("removed_by"))


@query("""SELECT key, n, factor FROM (SELECT key, count(*) AS n, round(greatest(0.8, least(1.2, 1 + 0.4 * (avg(fp::INT) - avg(fn::INT)))), 6)::DOUBLE AS factor FROM (SELECT event_type AS key, value < 2 AS fp, value > 50 AS fn FROM events) GROUP BY key) WHERE n >= 10""")
def learned_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_type", "value")
    return postfilter.learned_factors(e.select(F.col("event_type").alias("key"), (F.col("value") < 2).alias("false_positive"), (F.col("value") > 50).alias("false_negative")))


# ---- resolution, replacement -----------------------------------------------------------------------------------------

_SCORE = f"""round((CASE WHEN type = 'NAME' AND {_any("string_split_regex(upper(text), '[^A-Z]+')", FIELD_WORDS)} THEN 0.0 ELSE least(("end" - start) / 50.0::DOUBLE, 1.0) * 40 END) + confidence * 30 + {specificity_sql()} / 100.0::DOUBLE * 20 + least(priority / 100.0::DOUBLE, 1.0) * 10, 6)::DOUBLE"""


@query(SPANS + f' SELECT doc_id, start, "end", type, pattern, {_SCORE} AS score FROM spans')
def span_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilframe.operators.resolve import score as span_score_

    s = core(spark, sf_dir)[1]
    return s.select("doc_id", "start", "end", "type", "pattern", F.round(span_score_(F.struct("start", "end", "text", "type", "confidence", "priority", "pattern")), 6).alias("score"))


@query(SPANS + """ SELECT doc_id, start, "end", type, max(confidence) AS confidence FROM spans GROUP BY doc_id, start, "end", type""")
def dedupe_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilframe.operators.resolve import deduplicated

    d = detect(clinical(spark, sf_dir), CORE).withColumn("spans", deduplicated(F.col("spans")))
    return exploded(d, "doc_id").select("doc_id", "start", "end", "type", "confidence")


@query()
def resolve_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(resolve(detect(clinical(spark, sf_dir), CORE)), "doc_id")


@query()
def redact_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(resolve(detect(spread(table(spark, sf_dir, "documents", "doc_id", "text")), DEFAULTS))).select("doc_id", "n_redactions", "redacted")


@query("SELECT doc_id, text AS restored FROM documents WHERE text IS NOT NULL")
def restore_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text")).where("text is not null")
    return restore(tokenize(resolve(detect(docs, [BY_NAME[n] for n in NATURAL])), "doc_id")).select("doc_id", "restored")


_MAIL = BY_NAME["email"].patterns[0].regex


@query(f"SELECT doc_id, regexp_replace(text, {text_of(_MAIL)}, '[EMAIL]', 'g') AS redacted, len(regexp_extract_all(text, {text_of(_MAIL)})) AS n_redactions FROM documents WHERE text IS NOT NULL")
def redact_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text")).where("text is not null")
    return redact(resolve(detect(docs, [BY_NAME["email"]]))).select("doc_id", "redacted", "n_redactions")


@query()
def redact_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokenize(resolve(detect(clinical(spark, sf_dir), CORE)), "doc_id")
    return t.select("doc_id", F.size("token_map").alias("n_tokens"), F.size(F.regexp_extract_all("redacted", F.lit(TOKEN), F.lit(0))).alias("n_in_text"), F.sha2("redacted", 256).alias("sha256"))


@query(f"""SELECT conv_id, turn, regexp_replace(t, {text_of(_MAIL)}, '[EMAIL]', 'g') AS redacted, len(regexp_extract_all(t, {text_of(_MAIL)})) AS n FROM (SELECT conv_id, turn, text || ' mail ' || role || conv_id || '@example.org' AS t FROM conversations) WHERE t IS NOT NULL""")
def conversation_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").select("conv_id", "turn", F.concat("text", F.lit(" mail "), "role", F.col("conv_id").cast("string"), F.lit("@example.org")).alias("text")).where("text is not null")
    return redact(resolve(detect(c, [BY_NAME["email"]]))).select("conv_id", "turn", "redacted", F.col("n_redactions").alias("n"))


_STRIP = r"<[^>]*>"


@query(f"""WITH p AS (SELECT page_id, regexp_replace(html, '{_STRIP}', ' ', 'g') AS text FROM pages WHERE html IS NOT NULL) SELECT page_id, regexp_replace(text, {text_of(_MAIL)}, '[EMAIL]', 'g') AS redacted, len(regexp_extract_all(text, {text_of(_MAIL)})) AS n FROM p""")
def page_text_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(table(spark, sf_dir, "pages", "page_id", "html")).where("html is not null").select("page_id", F.regexp_replace("html", _STRIP, " ").alias("text"))
    return redact(resolve(detect(p, [BY_NAME["email"]]))).select("page_id", "redacted", F.col("n_redactions").alias("n"))


@query(f"""WITH p AS (SELECT page_id, regexp_replace(html, '{_STRIP}', ' ', 'g') AS text FROM pages), s AS ({spans_sql([BY_NAME[n] for n in ("email", "phone", "ipv4")], "p", "page_id")}) SELECT page_id, type, start, "end", text FROM s""")
def page_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(table(spark, sf_dir, "pages", "page_id", "html")).select("page_id", F.regexp_replace("html", _STRIP, " ").alias("text"))
    return exploded(detect(p, [BY_NAME[n] for n in ("email", "phone", "ipv4")]), "page_id").select("page_id", "type", "start", "end", "text")


@query()
def redact_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain.redact_full(clinical(spark, sf_dir)).select("doc_id", "n_redactions", "redacted")


# ---- consistency, policy, audit --------------------------------------------------------------------------------------

_NORM = r"""CASE WHEN type IN ('SSN', 'PHONE', 'FAX', 'CREDIT_CARD') THEN regexp_replace(text, '[^0-9]', '', 'g') WHEN type = 'EMAIL' THEN lower(text) WHEN type = 'MRN' THEN upper(regexp_replace(text, '[ ]', '', 'g'))
 WHEN type IN ('NAME', 'PROVIDER_NAME') THEN trim(regexp_replace(regexp_replace(lower(text), '(?:dr|mr|mrs|ms|prof)\. ?', '', 'g'), '[^a-z ]', '', 'g')) ELSE lower(text) END"""


@query(SPANS + f""", e AS (SELECT type, {_NORM} AS norm, min((doc_id, start)) AS f, count(*) AS occurrences FROM spans GROUP BY ALL)
SELECT type, norm, row_number() OVER (PARTITION BY type ORDER BY f[1], f[2], norm) AS n, occurrences, f[1] AS first_doc FROM e""")
def consistent_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gov.consistent_tokens(core(spark, sf_dir)[1]).select("type", "norm", "n", "occurrences", "first_doc")


@query(SPANS + " SELECT type, pattern, count(*) AS n, count(DISTINCT doc_id) AS docs, grouping(type, pattern)::BIGINT AS level FROM spans GROUP BY ROLLUP (type, pattern)")
def entity_stats_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gov.entity_rollup(core(spark, sf_dir)[1])


_STRICT = "('NAME', 'SSN', 'PHONE', 'EMAIL', 'DATE', 'MRN', 'ADDRESS', 'ZIPCODE')"


@query(SPANS + f""" SELECT doc_id, start, "end", type, pattern, CASE WHEN confidence < 0.7 THEN 'keep' WHEN type = 'DATE' THEN 'keep' WHEN type = 'ZIPCODE' THEN CASE WHEN confidence < 0.9 THEN 'keep' ELSE 'redact' END WHEN type IN {_STRICT} THEN 'redact' ELSE 'keep' END AS action FROM spans""")
def policy_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = gov.parse_policy(gov.TEMPLATES["RESEARCH"])
    return core(spark, sf_dir)[1].select("doc_id", "start", "end", "type", "pattern", gov.policy_action(p).alias("action"))


@query("SELECT doc_id, sha256(text) AS original_sha256, sha256(text || '|') AS redacted_sha256 FROM documents WHERE text IS NOT NULL")
def audit_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents", "doc_id", "text")).where("text is not null").withColumn("r", F.concat("text", F.lit("|")))
    return gov.manifest(d, "text", "r").select("doc_id", "original_sha256", "redacted_sha256")


@query("""WITH RECURSIVE m(l) AS (SELECT list_sort(list(sha256(text))) FROM documents WHERE text IS NOT NULL
 UNION ALL SELECT list_transform(range(1, len(l) + 1, 2), lambda i: sha256(unhex(l[i]) || unhex(coalesce(l[i + 1], l[i])))) FROM m WHERE len(l) > 1) SELECT l[1] AS root FROM m WHERE len(l) = 1""")
def merkle_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gov.merkle_root(table(spark, sf_dir, "documents", "text").where("text is not null").select(F.sha2("text", 256).alias("h")), "h")


@query("SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1")
def exact_duplicate_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents", "doc_id", "text")).where("text is not null").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


@query(r"SELECT sha256(regexp_replace(regexp_replace(html, '>[^<]*<', '><', 'g'), '=\"[^\"]*\"', '', 'g')) AS skeleton, count(*) AS n FROM pages GROUP BY 1".replace('\\"', '"'))
def template_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.regexp_replace(F.regexp_replace("html", ">[^<]*<", "><"), '="[^"]*"', "")
    return table(spark, sf_dir, "pages", "html").groupBy(F.sha2(s, 256).alias("skeleton")).agg(F.count(F.lit(1)).alias("n"))


@query(SPANS + """ SELECT doc_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(type))), ',') AS types FROM spans GROUP BY doc_id""")
def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = gov.audit_events(core(spark, sf_dir)[1])
    j = F.from_json("json", "entity struct<redactions: bigint, types: array<string>>")
    return e.select("doc_id", j["entity"]["redactions"].alias("n"), F.concat_ws(",", j["entity"]["types"]).alias("types"))


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, min(value) AS low, max(value) AS high, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type""")
def audit_percentiles_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_type", "value")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("median"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"))


# ---- retention, alerts -----------------------------------------------------------------------------------------------

@query("""SELECT o_orderkey AS id, o_orderpriority AS data_type, date_diff('day', o_orderdate::DATE, DATE '1998-09-01') AS age_days, CASE WHEN date_diff('day', o_orderdate::DATE, DATE '1998-09-01') > 2190 THEN 'destroy' WHEN date_diff('day', o_orderdate::DATE, DATE '1998-09-01') > 365 THEN 'archive' ELSE 'none' END AS due FROM orders""")
def retention_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("data_type"), F.col("o_orderdate").alias("created"))
    return gov.retention(r, F.lit("1998-09-01").cast("date")).select("id", "data_type", "age_days", "due")


@query("""SELECT o_orderkey AS id FROM orders WHERE NOT ((o_orderpriority = '1-URGENT' AND o_orderdate::DATE >= DATE '1996-01-01') OR (o_orderdate::DATE BETWEEN DATE '1994-01-01' AND DATE '1994-06-30'))""")
def legal_hold_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("data_type"), F.col("o_orderdate").alias("created"))
    holds = spark.createDataFrame([("1-URGENT", "1996-01-01", None), (None, "1994-01-01", "1994-06-30")], "data_type string, f string, t string").select("data_type", F.col("f").cast("date").alias("from_day"), F.col("t").cast("date").alias("to_day"))
    return gov.without_holds(r, holds).select("id")


@query("""SELECT event_id, user_id, recent FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS recent FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events)) WHERE recent > 2""")
def alert_ops_per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gov.busy_minutes(table(spark, sf_dir, "events", "event_id", "user_id", "ts"), 2, 3600).select("event_id", "user_id", "recent")


@query("SELECT event_id, user_id FROM events WHERE hour(ts) < 8 OR hour(ts) >= 18")
def alert_off_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gov.off_hours(table(spark, sf_dir, "events", "event_id", "user_id", "ts")).select("event_id", "user_id")


@query("SELECT * FROM (SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS n, sum((event_type = 'error')::INT)::BIGINT AS failed, round(sum((event_type = 'error')::INT) / count(*), 6) AS rate FROM events GROUP BY 1) WHERE rate > 0.1")
def alert_failure_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gov.failure_rate(table(spark, sf_dir, "events", "ts", "event_type"))


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT event_type AS rule, ts::TIMESTAMP AS ts FROM events WHERE ts IS NOT NULL), later AS MATERIALIZED (SELECT a.rule, a.ts, min(b.ts) AS next FROM e a JOIN e b ON a.rule = b.rule AND b.ts >= a.ts + INTERVAL 600 SECOND GROUP BY ALL),
passed AS (SELECT rule, min(ts) AS ts FROM e GROUP BY rule UNION ALL SELECT p.rule, l.next FROM passed p JOIN later l ON p.rule = l.rule AND p.ts = l.ts) SELECT rule, ts FROM passed""")
def alert_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gov.cooled_down(table(spark, sf_dir, "events", "ts", "event_type").select(F.col("event_type").alias("rule"), "ts"), 600)


# ---- text ------------------------------------------------------------------------------------------------------------

@query(f"SELECT doc_id, translate(text, '{normalize.OCR_FROM}', '{normalize.OCR_TO}') AS digits, length(regexp_replace(translate(text, '{normalize.OCR_FROM}', '{normalize.OCR_TO}'), '[^0-9]', '', 'g')) AS n FROM documents")
def ocr_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", normalize.ocr_digits(F.col("text")).alias("digits"))
    return d.select("doc_id", "digits", F.length(normalize.digits(F.col("digits"))).cast("long").alias("n"))


_CH = lambda p: f"least(1.0, 2 * len(regexp_extract_all(text, {text_of(p)})) / greatest(100.0::DOUBLE, length(text) / 10.0::DOUBLE))"


@query(f"""SELECT doc_id, round(least(1.0, {_CH('[a-z][0-9][a-z]')} * 0.30::DOUBLE + {_CH('[a-z][A-Z]')} * 0.25::DOUBLE + {_CH('[a-z]  +[a-z]')} * 0.20::DOUBLE + {_CH('[#$%&*@]{2,}')} * 0.15::DOUBLE), 6)::DOUBLE AS chaos FROM documents WHERE text IS NOT NULL""")
def chaos_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents", "doc_id", "text")).where("text is not null").select("doc_id", normalize.chaos_score(F.col("text")).alias("chaos"))


_TRICK = "CASE doc_id % 4 WHEN 0 THEN concat(text, ' p', chr(1072), 'ypal') WHEN 1 THEN concat(text, ' pay', chr(8203), 'pal') ELSE text END"
_HOMO = "".join(normalize.HOMOGLYPHS)


@query(f"""SELECT doc_id, round(least(1.0, least((length(t) - length(translate(t, '{normalize.INVISIBLE}', ''))) / 5.0::DOUBLE, 1.0) * 0.3::DOUBLE + least((length(t) - length(translate(t, '{_HOMO}', ''))) / 3.0::DOUBLE, 1.0) * 0.4::DOUBLE + CASE WHEN regexp_matches(t, '[A-Za-z]') AND regexp_matches(t, '[\\x{{370}}-\\x{{4ff}}]') THEN 0.5 ELSE 0.0 END), 6)::DOUBLE AS score FROM (SELECT doc_id, {_TRICK} AS t FROM documents)""")
def homoglyph_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit(" p\u0430ypal"))).when(F.col("doc_id") % 4 == 1, F.concat("text", F.lit(" pay\u200bpal"))).otherwise(F.col("text"))
    return spread(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", normalize.adversarial_score(t).alias("score"))


@query("""WITH n(term) AS (SELECT DISTINCT lower(n_name) FROM nation), t AS (SELECT DISTINCT lower(concat(substr(n_name, 1, 1), substr(n_name, 3), 'x')) AS token FROM nation UNION SELECT DISTINCT lower(concat(substr(n_name, 2, 1), substr(n_name, 1, 1), substr(n_name, 3))) FROM nation)
SELECT token, min_by(term, (d, term)) AS term, min(d) AS distance FROM (SELECT token, term, damerau_levenshtein(token, term) AS d FROM t, n) WHERE d <= 2 GROUP BY token""")
def fuzzy_two_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation", "n_name")
    t = n.select(F.lower(F.concat(F.substr("n_name", F.lit(1), F.lit(1)), F.substr("n_name", F.lit(3)), F.lit("x"))).alias("token")).unionByName(n.select(F.lower(F.concat(F.substr("n_name", F.lit(2), F.lit(1)), F.substr("n_name", F.lit(1), F.lit(1)), F.substr("n_name", F.lit(3)))).alias("token")))
    return normalize.fuzzy_lookup(t, n.select(F.lower("n_name").alias("term")).distinct(), 2)


@query("""WITH n(term) AS (SELECT DISTINCT lower(n_name) FROM nation), t AS (SELECT DISTINCT lower(concat(substr(n_name, 1, 2), substr(n_name, 4))) AS token FROM nation UNION SELECT DISTINCT lower(concat(n_name, 'x')) FROM nation)
SELECT token, min_by(term, (d, term)) AS term, min(d) AS distance FROM (SELECT token, term, levenshtein(token, term) AS d FROM t, n) WHERE d <= 1 GROUP BY token""")
def fuzzy_name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation", "n_name")
    t = n.select(F.lower(F.concat(F.substr("n_name", F.lit(1), F.lit(2)), F.substr("n_name", F.lit(4)))).alias("token")).unionByName(n.select(F.lower(F.concat("n_name", F.lit("x"))).alias("token")))
    return normalize.fuzzy_lookup(t, n.select(F.lower("n_name").alias("term")).distinct(), 1)


@query("SELECT c_custkey, round(jaro_winkler_similarity(c_name, 'Customer#000000042'), 6) AS jw FROM customer")
def jaro_winkler_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer", "c_custkey", "c_name").select("c_custkey", F.round(normalize.jaro_winkler("c_name", F.lit("Customer#000000042")), 6).alias("jw"))


_CODED = "regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '0123012-02245501262301-202'), '[0-]', '', 'g')"


@query(f"""WITH w AS (SELECT n_name, regexp_replace(upper(n_name), '[^A-Z]', '', 'g') AS w FROM nation), c AS (SELECT n_name, w, {_CODED.format('w')} AS c, length({_CODED.format('w[1:1]')}) AS own FROM w),
k AS (SELECT n_name, concat(rpad(w[1:1], 1, '0'), rpad(array_to_string(list_transform(list_filter(range(1 + own, length(c) + 1), lambda i: i = 1 OR c[i:i] <> c[i - 1:i - 1]), lambda i: c[i:i]), '')[1:3], 3, '0')) AS code FROM c)
SELECT code, string_agg(n_name, ',' ORDER BY n_name) AS names FROM k GROUP BY code""")
def soundex_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation", "n_name")
    return n.groupBy(normalize.soundex(F.col("n_name")).alias("code")).agg(F.concat_ws(",", F.array_sort(F.collect_list("n_name"))).alias("names"))


# ---- evaluation, calibration -----------------------------------------------------------------------------------------

#: Truth of the fixture's MRN and ZIP, from arithmetic alone: the header's first line has a fixed shape.
TRUTH = "SELECT doc_id, CAST(27 AS BIGINT) AS start, CAST(27 + length(CAST(100000 + doc_id AS STRING)) AS BIGINT) AS \"end\", CAST(100000 + doc_id AS STRING) AS text, 'MRN' AS type FROM documents WHERE text IS NOT NULL"


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents", "doc_id", "text")).where("text is not null")
    v = (F.col("doc_id") + 100000).cast("string")
    return d.select("doc_id", F.lit(27).cast("long").alias("start"), (F.length(v) + 27).cast("long").alias("end"), v.alias("text"), F.lit("MRN").alias("type"))


@query(SPANS + f""", t AS ({TRUTH}), p AS (SELECT DISTINCT doc_id, start, "end", type FROM spans), j AS (SELECT coalesce(p.type, t.type) AS type, p.doc_id IS NOT NULL AS has_p, t.doc_id IS NOT NULL AS has_t FROM p FULL JOIN t ON p.doc_id = t.doc_id AND p.start = t.start AND p."end" = t."end" AND p.type = t.type)
SELECT type, count(*) FILTER (has_p AND has_t) AS tp, count(*) FILTER (has_p AND NOT has_t) AS fp, count(*) FILTER (has_t AND NOT has_p) AS fn FROM j GROUP BY type""")
def eval_strict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.strict_counts(core(spark, sf_dir)[1], truth(spark, sf_dir))


@query()
def eval_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = core(spark, sf_dir)[1].where("type = 'MRN'")
    return measure.rates(measure.mode_counts(measure.align(p, truth(spark, sf_dir))))


@query(f"""WITH {CLIN}, m AS ({detector_sql(BY_NAME["mrn"], "clin")}), t AS ({TRUTH}), n AS (SELECT t.doc_id, count(DISTINCT m.start) AS hidden FROM t LEFT JOIN m ON t.doc_id = m.doc_id AND t.text = m.text GROUP BY t.doc_id)
SELECT t.doc_id, t.type, t.text FROM t JOIN clin USING (doc_id) JOIN n USING (doc_id) WHERE (length(clin.text) - length(replace(clin.text, t.text, ''))) // length(t.text) > n.hidden""")
def leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    # written first: a filter on the redacted text would be pushed below what makes it, and so make it many times
    done = materialized(redact(resolve(detect(clinical(spark, sf_dir), [BY_NAME["mrn"]]))).select("doc_id", "redacted"), "redacted")
    return measure.leaks(done, truth(spark, sf_dir)).select("doc_id", "type", "text")


_POINTS = "SELECT (doc_id % 100 / 100.0)::DOUBLE AS confidence, quality AS label FROM labels WHERE quality IS NOT NULL"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels", "doc_id", "quality").where("quality is not null").select(((F.col("doc_id") % 100) / 100.0).alias("confidence"), F.col("quality").alias("label"))


@query(f"SELECT least(9, floor(confidence * 10))::BIGINT AS bin, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, round(avg(label), 6) AS accuracy FROM ({_POINTS}) GROUP BY 1")
def calibration_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.reliability(points(spark, sf_dir))


@query(f"WITH g AS (SELECT least(9, floor(confidence * 10)) AS b, count(*) AS n, avg(confidence) AS c, avg(label) AS a, sum((confidence - label) ** 2) AS sq FROM ({_POINTS}) GROUP BY 1) SELECT round(sum(n * abs(c - a)) / sum(n), 6) AS ece, round(max(abs(c - a)), 6) AS mce, round(sum(sq) / sum(n), 6) AS brier FROM g")
def calibration_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.calibration_errors(points(spark, sf_dir))


@query(f"""WITH p AS ({_POINTS}), t AS (SELECT (k / 20.0)::DOUBLE AS threshold FROM range(2, 20) r(k)), g AS (SELECT threshold, count(*) FILTER (confidence >= threshold AND label = 1) AS tp, count(*) FILTER (confidence >= threshold AND label = 0) AS fp, count(*) FILTER (confidence < threshold AND label = 1) AS fn, count(*) FILTER (confidence < threshold AND label = 0) AS tn FROM t, p GROUP BY threshold)
SELECT threshold, tp, fp, fn, tn, coalesce(round(tp / nullif(tp + fn, 0), 6), 0.0) AS sensitivity, coalesce(round(tn / nullif(tn + fp, 0), 6), 0.0) AS specificity, coalesce(round(tp / nullif(tp + fp, 0), 6), 0.0) AS precision, coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0), 6), 0.0) AS f1 FROM g""")
def roc_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.roc_sweep(points(spark, sf_dir))


@query(f"""WITH p AS ({_POINTS}) SELECT round(sum(CASE WHEN a.confidence > b.confidence THEN 1.0 WHEN a.confidence = b.confidence THEN 0.5 ELSE 0.0 END)::DOUBLE / count(*), 6) AS auc FROM p a, p b WHERE a.label = 1 AND b.label = 0""")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.roc_auc(points(spark, sf_dir))


_COUNTED = f"g AS (SELECT round(confidence, 6)::DOUBLE AS x, count(*) FILTER (label = 1) AS pos, count(*)::DOUBLE AS n FROM ({_POINTS}) GROUP BY 1), whole AS (SELECT sum(n) AS whole FROM g)"


@query(f"""WITH RECURSIVE {_COUNTED}, fit(i, a, b) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL
 SELECT i + 1, a - 0.01 * sum((n / (1 + exp(-(a * x + b))) - pos) * x) / any_value(whole), b - 0.01 * sum(n / (1 + exp(-(a * x + b))) - pos) / any_value(whole) FROM fit, g, whole WHERE i < 100 GROUP BY i, a, b)
SELECT whole::BIGINT AS n, round(a, 6) AS a, round(b, 6) AS b FROM fit, whole WHERE i = 100 AND whole >= 20""")
def calibration_platt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.platt(points(spark, sf_dir))


@query(f"""WITH RECURSIVE {_COUNTED}, h AS (SELECT greatest(0.001, least(0.999, x)) AS x, pos, n FROM g), fit(i, a, b, c) AS (SELECT 0, 1.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE UNION ALL
 SELECT i + 1, greatest(0.1, least(10.0, a - 0.01 * sum(e * x ** b) / any_value(whole))), greatest(0.1, least(10.0, b - 0.01 * sum(e * a * x ** b * ln(x)) / any_value(whole))), greatest(-0.5, least(0.5, c - 0.01 * sum(e) / any_value(whole)))
 FROM (SELECT *, n * greatest(0.001, least(0.999, a * x ** b + c)) - pos AS e FROM fit, h, whole WHERE i < 100) GROUP BY i, a, b, c)
SELECT whole::BIGINT AS n, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c FROM fit, whole WHERE i = 100 AND whole >= 20""")
def calibration_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.beta(points(spark, sf_dir))


@query(f"""WITH {_COUNTED}, l AS (SELECT ln(greatest(0.001, least(0.999, x)) / (1 - greatest(0.001, least(0.999, x)))) AS l, pos, n FROM g), t AS (SELECT (k / 10.0)::DOUBLE AS t FROM range(1, 51) r(k)),
p AS (SELECT t, greatest(0.001, least(0.999, 1 / (1 + exp(-l / t)))) AS p, pos, n FROM l, t), loss AS (SELECT t, round(sum(-pos * ln(p) - (n - pos) * ln(1 - p)), 9) AS loss FROM p GROUP BY t)
SELECT whole::BIGINT AS n, t AS temperature FROM loss, whole WHERE whole >= 20 ORDER BY loss, t LIMIT 1""")
def calibration_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.temperature(points(spark, sf_dir))


@query(f"""WITH {_COUNTED}, r AS (SELECT x, row_number() OVER (ORDER BY x) AS k, sum(pos) OVER (ORDER BY x) AS p, sum(n) OVER (ORDER BY x) AS s, pos, n FROM g),
m AS (SELECT i.k AS i, j.k AS j, (j.p - i.p + i.pos) / (j.s - i.s + i.n) AS mean FROM r i JOIN r j ON i.k <= j.k), least_of AS (SELECT k.k, m.i, min(m.mean) AS low FROM r k JOIN m ON m.i <= k.k AND k.k <= m.j GROUP BY ALL)
SELECT r.x AS confidence, round(max(low), 6) AS calibrated FROM least_of JOIN r USING (k) GROUP BY r.x""")
def calibration_isotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.isotonic(points(spark, sf_dir).select(F.round("confidence", 6).alias("confidence"), "label"))


@query("""WITH g AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS b, count(*) FILTER (quality = 0 AND toxic = 1) AS c FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL) SELECT b, c, CASE WHEN b + c > 0 THEN round((abs(b - c) - 1) ** 2 / (b + c), 6) ELSE 0.0 END AS chi2 FROM g""")
def eval_mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.mcnemar(table(spark, sf_dir, "labels", "quality", "toxic").where("quality is not null and toxic is not null").select((F.col("quality") == 1).alias("a_right"), (F.col("toxic") == 1).alias("b_right")))


# ---- drift, privacy --------------------------------------------------------------------------------------------------

@query("""WITH c AS (SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL), b AS (SELECT event_type, sum(n) AS b FROM c WHERE start < TIMESTAMP '2024-01-04' GROUP BY 1), q AS (SELECT event_type, b / (SELECT sum(b) FROM b) AS q FROM b),
l AS (SELECT * FROM c WHERE start >= TIMESTAMP '2024-01-04'), t AS (SELECT start, sum(n) AS al FROM l GROUP BY 1), grid AS (SELECT t.start, q.event_type, q.q, t.al FROM t, q),
j AS (SELECT coalesce(g.start, l.start) AS start, coalesce(g.q, 0) AS q, coalesce(l.n, 0) AS n FROM grid g FULL JOIN l ON g.start = l.start AND g.event_type = l.event_type),
d AS (SELECT start, (sqrt(n / sum(n) OVER (PARTITION BY start)) - sqrt(q)) ** 2 AS sq FROM j), r AS (SELECT start, round(sqrt(sum(sq) / 2), 6) AS distance FROM d GROUP BY start)
SELECT start, distance, CASE WHEN distance > 0.3 THEN 'CRITICAL' WHEN distance > 0.2 THEN 'HIGH' WHEN distance > 0.1 THEN 'MEDIUM' ELSE 'NONE' END AS alert FROM r""")
def drift_hellinger(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = measure.windows(table(spark, sf_dir, "events", "ts", "event_type"), "1 day")
    return measure.hellinger(c, F.col("start") < F.lit("2024-01-04").cast("timestamp"))


@query("""WITH g AS (SELECT date_trunc('day', ts)::TIMESTAMP AS start, count(*) AS n FROM events GROUP BY 1), l AS (SELECT *, lag(n) OVER (ORDER BY start) AS p FROM g) SELECT start, n, round((n - p) / p, 6) AS change, coalesce(abs(round((n - p) / p, 6)) > 0.3, false) AS alert FROM l""")
def drift_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.volume_change(table(spark, sf_dir, "events", "ts"), "1 day")


@query("""SELECT event_id, round(value - 2.0::DOUBLE * sign(u) * ln(1 - 2 * abs(u)), 6) AS noisy FROM (SELECT event_id, value, ((event_id * 37 % 199) - 99) / 200.0::DOUBLE AS u FROM events)""")
def dp_laplace_from_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "value").withColumn("u", ((F.col("event_id") * 37 % 199) - 99) / 200.0)
    return e.select("event_id", F.round(measure.laplace(F.col("value"), F.col("u"), 1.0, 0.5), 6).alias("noisy"))


@query("""SELECT event_id AS id, user_id, spent, spent <= 5 AS allowed FROM (SELECT event_id, user_id, round(sum((event_id % 5 + 1) / 10.0::DOUBLE) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS spent FROM events)""")
def dp_budget_running_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "user_id", "ts").select(F.col("event_id").alias("id"), "user_id", "ts", ((F.col("event_id") % 5 + 1) / 10.0).alias("epsilon"))
    return measure.budget(e, 5.0).select("id", "user_id", "spent", "allowed")


@query("""WITH c AS (SELECT event_type AS item, count(*) AS observed FROM events GROUP BY 1) SELECT item, observed, round((observed - (SELECT sum(observed) FROM c) / (exp(1.0) + 4)) / ((exp(1.0) - 1) / (exp(1.0) + 4)), 4) AS estimate FROM c""")
def randomized_response_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.randomized_response(table(spark, sf_dir, "events", "event_type").groupBy(F.col("event_type").alias("item")).agg(F.count(F.lit(1)).alias("observed")), 5, 1.0)


#: Tags as they are written in files, with two that stay.
_TAGS = "00080012 00080013 00080018 00080020 00080021 00080022 00080023 00080030 00080031 00080032 00080033 00080050 00080060 00080080 00080081 00080090 00081030 0008103E 00081050 00081070 00100010 00100020 00100021 00100030 00100032 00100040 00101000 00101001 00101010 00101040 00101060 00102154 00102160 00104000 00181000 00181030 0020000D 0020000E 00200010 00280010".split()
_NAMES_HASHED = "tag IN ('00100010', '00100020', '00080080', '00080090', '00081050', '00081070', '00080050', '00200010', '00080018', '0020000D', '0020000E', '00181000')"


@query(f"""WITH t AS (SELECT doc_id AS file, unnest({_TAGS}) AS tag FROM documents) SELECT file, tag, CASE WHEN {_NAMES_HASHED} THEN 'hashed' ELSE 'v' || file END AS value FROM t WHERE {_NAMES_HASHED} OR tag IN ('00080060', '00280010')""")
def dicom_tag_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "documents", "doc_id").select(F.col("doc_id").alias("file"), F.explode(F.array(*map(F.lit, _TAGS))).alias("tag"), F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("value"))
    return gov.tag_rules(tags).withColumn("value", F.when(F.regexp_like("value", F.lit("^[0-9a-f]{64}$")), "hashed").otherwise(F.col("value")))


@query("""SELECT doc_id, d::VARCHAR AS d, (d + INTERVAL 11 DAY)::DATE::VARCHAR AS shifted, '[DATE_' || dense_rank() OVER (PARTITION BY doc_id ORDER BY d) || ']' AS token FROM (SELECT o_custkey AS doc_id, o_orderdate::DATE AS d FROM orders)""")
def date_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gov.shifted_dates(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.to_date("o_orderdate").alias("d")), 11).select("doc_id", F.col("d").cast("string").alias("d"), F.col("shifted").cast("string").alias("shifted"), "token")


# ---- looking up ------------------------------------------------------------------------------------------------------

_VALUES = """SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 0 THEN concat(CAST(c_custkey % 1000 + 100 AS STRING), '-', CAST(10 + c_custkey % 90 AS STRING), '-', CAST(1000 + c_custkey % 9000 AS STRING))
 WHEN 1 THEN concat('+1 (555) 201-', CAST(1000 + c_custkey % 9000 AS STRING)) WHEN 2 THEN concat('10.0.', CAST(c_custkey % 400 AS STRING), '.7') WHEN 3 THEN '2001:db8:0:0:0:0:0:1' WHEN 4 THEN concat('1HGCM82633A', CAST(100000 + c_custkey % 900000 AS STRING))
 WHEN 5 THEN concat('ABC-', CAST(c_custkey % 1000 AS STRING)) WHEN 6 THEN concat(CAST(c_custkey % 120 AS STRING), '.5, -', CAST(c_custkey % 200 AS STRING), '.25') ELSE c_name END AS v FROM {0}"""


@query(f"SELECT id, {', '.join(f'({sql}) AS is_{name}' for name, sql in lookup.VALUE_TESTS.items())} FROM ({_VALUES.format('customer')})".replace("regexp_like(", "regexp_matches("))
def value_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer", "c_custkey", "c_name")
    return lookup.value_tests(spark.sql(_VALUES.format("{rows}"), rows=rows)).drop("v")


@query("""WITH p AS (SELECT DISTINCT r_name AS s FROM region UNION SELECT n_name FROM nation), term AS (SELECT s AS term, lower(s) AS l FROM p), tok AS (SELECT concat(substr(s, 1, 3), substr(s, 5)) AS token FROM p UNION SELECT s FROM p),
a AS (SELECT token, len(g) AS n, unnest(g) AS k FROM (SELECT token, list_distinct(list_transform(range(1, length(token) + 2), lambda i: substr(concat('  ', lower(token), ' '), i, 3))) AS g FROM tok)),
b AS (SELECT term, len(g) AS m, unnest(g) AS k FROM (SELECT term, list_distinct(list_transform(range(1, length(term) + 2), lambda i: substr(concat('  ', l, ' '), i, 3))) AS g FROM term)),
c AS (SELECT token, term, round(count(*) / (n + m - count(*)), 6) AS similarity FROM a JOIN b USING (k) GROUP BY token, n, term, m)
SELECT token, term, similarity FROM c WHERE similarity >= 0.3 QUALIFY row_number() OVER (PARTITION BY token ORDER BY similarity DESC, term) = 1""")
def trigram_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "region", F.col("r_name").alias("term")).unionByName(table(spark, sf_dir, "nation", F.col("n_name").alias("term"))).distinct()
    t = p.select(F.concat(F.substr("term", F.lit(1), F.lit(3)), F.substr("term", F.lit(5))).alias("token")).unionByName(p.select(F.col("term").alias("token")))
    return lookup.trigram_lookup(t, p)


_W = "regexp_extract_all(lower(text), '[A-Za-z0-9_]+')"


@query(f"""WITH d AS (SELECT doc_id, ' ' || array_to_string({_W}, ' ') || ' ' AS t FROM documents WHERE text IS NOT NULL), p AS (SELECT DISTINCT array_to_string({_W}, ' ') AS passage FROM benchmark WHERE text IS NOT NULL AND len({_W}) > 0),
m AS (SELECT doc_id, passage, string_split(t, ' ' || passage || ' ') AS g FROM d JOIN p ON contains(t, ' ' || passage || ' ')),
c AS (SELECT doc_id, passage, unnest(range(1, len(g))) AS i, g FROM m)
SELECT doc_id, passage, (list_sum(list_transform(g[1:i], lambda x: len(list_filter(string_split(x, ' '), lambda y: y <> '')))) + (i - 1) * len(string_split(passage, ' ')))::BIGINT AS word FROM c""")
def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.passage_search(spread(table(spark, sf_dir, "documents", "doc_id", "text")), table(spark, sf_dir, "benchmark", "text"), parted=True)


@query()
def phonetic_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation", F.lower("n_name").alias("term"))
    t = n.select(F.regexp_replace("term", "c", "k").alias("token")).unionByName(n.select(F.concat("term", F.lit("x")).alias("token")))
    return lookup.phonetic_lookup(t, n)


_READ_AS = "CASE c " + " ".join(f"WHEN '{k}' THEN [{', '.join(map(text_of, v))}]" for k, v in lookup.READINGS.items()) + " ELSE [c] END"


@query(f"""WITH RECURSIVE g(n_name, k, held) AS (SELECT n_name, 0, [''] FROM nation WHERE n_name IS NOT NULL
 UNION ALL SELECT n_name, k + 1, flatten(list_transform(held, lambda h: list_transform(options, lambda o: h || o)))[1:100] FROM (SELECT *, {_READ_AS} AS options FROM (SELECT *, lower(n_name)[k + 1:k + 1] AS c FROM g WHERE k < length(n_name))))
SELECT n_name, unnest(held) AS variant FROM g WHERE k = length(n_name)""")
def ocr_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation", "n_name").select("n_name", F.explode(lookup.ocr_variants(F.col("n_name"))).alias("variant"))


@query("SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, {text_of(p)})) AS {name}" for name, p in lookup.LAYOUT.items()) + f" FROM ({CLINICAL})")
def document_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clinical(spark, sf_dir).select("doc_id", *lookup.structure(F.col("text")))


@query("""WITH e AS (SELECT (doc_id % 100) / 100.0::DOUBLE AS pattern, (doc_id * 7 % 100) / 100.0::DOUBLE AS context, quality = 1 AS truth FROM labels), w AS (SELECT i / 10.0::DOUBLE AS w FROM range(0, 11) t(i)), t AS (SELECT i / 10.0::DOUBLE AS threshold FROM range(3, 8) t(i)),
c AS (SELECT w, threshold, count(*) FILTER (s AND truth) AS tp, count(*) FILTER (s AND NOT truth) AS fp, count(*) FILTER (NOT s AND truth) AS fn FROM (SELECT w, threshold, truth, round(w * pattern + (1 - w) * context, 9) >= threshold AS s FROM e, w, t) GROUP BY w, threshold)
SELECT w, threshold, tp, fp, fn, round(CASE WHEN tp = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM c""")
def weight_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "labels", "doc_id", "quality").select((F.col("doc_id") % 100 / F.lit(100.0)).alias("pattern"), (F.col("doc_id") * 7 % 100 / F.lit(100.0)).alias("context"), (F.col("quality") == 1).alias("truth"))
    return measure.weight_grid(e, [i / 10 for i in range(11)], [i / 10 for i in range(3, 8)])
