"""The scoring chain over long spans: each step edits ``confidence`` and never the place of a span.

Every function takes and returns rows (doc_id, start, end, text, type, confidence, priority, pattern), plus the documents
where it needs the text around a span. Joins are on doc_id with a range condition behind it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.operators import words

# Default context rules (type, words, factor).
CONTEXT_RULES = (
    ("SSN", ("ssn", "social", "security"), 1.2),
    ("PHONE", ("phone", "tel", "telephone", "mobile", "cell"), 1.15),
    ("EMAIL", ("email", "e-mail", "contact"), 1.1),
    ("MRN", ("mrn", "medical", "record", "patient"), 1.25),
    ("DATE", ("dob", "birthday", "birth", "born"), 1.3),
    ("ADDRESS", ("address", "street", "ave", "road", "blvd"), 1.2),
    ("NAME", ("patient", "doctor", "dr", "nurse", "physician"), 1.15),
    ("CREDIT_CARD", ("card", "credit", "visa", "mastercard", "amex"), 1.25),
)
# A title before a name, and a text that is nothing but a short name.
TITLE, TITLE_FACTOR = r"(?i)\b(Dr|Mr|Mrs|Ms|Miss|Prof|Professor)\.\s*\z", 1.4
ALONE, ALONE_FACTOR = r"^[A-Z][a-z]{1,3}\z", 0.7
# Labels before a colon, what they announce, and how surely; a space stands for white space, ``#`` may follow it.
FIELD_LABELS = (
    (("patient", "pt", "patient name", "name", "full name", "physician", "doctor", "dr", "attending physician", "ordering physician",
      "primary care", "referring", "referring physician", "radiologist", "read by", "interpreted by", "dictated by", "transcribed by",
      "signed by", "electronically signed", "spouse", "wife", "husband", "next of kin", "guardian", "power of attorney",
      "emergency contact", "contact name", "mother", "father", "parent", "subscriber", "insured", "policyholder", "policy holder",
      "beneficiary", "nurse", "rn", "lpn", "caregiver", "witness", "notarized by"), "NAME", 0.95),
    (("file#", "file number", "mrn", "medical record", "medical record number", "medical record#", "chart#", "chart number", "account#",
      "account number", "patient id", "patient number", "accession#?", "accession number", "case#", "case number", "encounter#?",
      "encounter number", "visit#", "visit number", "admission#", "unit number", "study id", "specimen#?", "lab#", "req#", "requisition",
      "order#", "order number", "claim#", "claim number", "invoice#", "authorization#?", "reference#", "control#"), "MRN", 0.95),
    (("dob", "date of birth", "birth date", "birthdate", "date", "service date", "exam date", "study date", "procedure date",
      "admission date", "discharge date", "visit date", "order date", "report date", "signed date", "effective date",
      "expiration date", "onset date", "date of service", "dos", "date of death", "surgery date", "specimen date", "collection date",
      "received date", "reported date", "appointment date", "scheduled date"), "DATE", 0.90),
    (("address", "home address", "mailing address", "street address", "residential address", "billing address", "shipping address",
      "work address", "employer address", "facility address", "location", "city", "state", "zip", "zip code", "postal code", "county",
      "country"), "ADDRESS", 0.90),
    (("phone", "phone number", "telephone", "tel", "cell", "mobile", "cell phone", "mobile phone", "home phone", "work phone",
      "office phone", "pager", "fax", "fax number", "contact number", "callback number", "emergency phone"), "PHONE", 0.90),
    (("ssn", "ssn number", "ssn#", "social security", "social security number", "social security#", "ss#", "ss number"), "SSN", 0.98),
    (("email", "e-mail", "email address", "electronic mail"), "EMAIL", 0.90),
    (("insurance id", "member id", "member number", "group number", "group#", "policy number", "policy#", "subscriber id", "plan id",
      "plan number", "certificate number", "rx bin", "rx pcn", "rx group", "bin", "pcn"), "MRN", 0.90),
    (("insurance company", "insurance carrier", "health plan", "payer", "carrier", "employer"), "ORGANIZATION", 0.85),
    (("age", "sex", "gender", "race", "ethnicity", "marital status", "occupation"), "DEMOGRAPHIC", 0.80),
)
# Clinical indicators (kind, patterns, weight of a match).
CLINICAL = (
    ("label", (
        r"(?i)\b(?:patient|pt|subject|individual|client|resident|member)\s*(?:name)?[:\s]", r"(?i)\b(?:name|full\s+name)\s*[:\s]", r"(?i)\bMRN\s*[:#]",
        r"(?i)\b(?:DOB|date\s+of\s+birth)\s*[:\s]", r"(?i)\b(?:admitted|discharged|seen|evaluated|examined|treated)\b"), 1.0),
    ("setting", (
        r"(?i)\b(?:hospital|clinic|emergency\s+room|ER|ICU|ward|unit|floor)\b", r"(?i)\b(?:admission|discharge|transfer|consult)\b",
        r"(?i)\b(?:inpatient|outpatient|ambulatory)\b", r"(?i)\b(?:surgery|procedure|operation|exam|examination)\b",
        r"(?i)\b(?:diagnosis|prognosis|treatment|therapy)\b"), 0.9),
    ("action", (
        r"(?i)\b(?:presented|presents|presenting)\s+(?:with|to)\b", r"(?i)\b(?:complains|complained|reports|reported|states|stated)\b",
        r"(?i)\b(?:denies|denied|endorses|endorsed)\b", r"(?i)\b(?:prescribed|ordered|administered|given)\b",
        r"(?i)\b(?:vital\s+signs|blood\s+pressure|temperature|pulse|respirations)\b", r"(?i)\b(?:symptoms?|signs?|findings?)\b"), 0.8),
    ("time", (
        r"(?i)\b(?:onset|started|began|developed|occurred)\s+(?:on|at|around)?\b", r"(?i)\b(?:since|for\s+the\s+past|over\s+the\s+past|within\s+the\s+last)\b",
        r"(?i)\b(?:follow[- ]?up|return\s+visit|next\s+appointment)\b", r"(?i)\b(?:pre[- ]?op|post[- ]?op|day\s+\d+|POD\s*#?\d+)\b"), 0.75),
    ("relation", (
        r"(?i)\b(?:spouse|wife|husband|partner)\b", r"(?i)\b(?:mother|father|parent|guardian)\b",
        r"(?i)\b(?:son|daughter|child|children|sibling|brother|sister)\b", r"(?i)\b(?:caregiver|emergency\s+contact|next\s+of\s+kin|NOK)\b"), 0.85),
    ("person", (
        r"(?i)\b\d+[- ]?(?:year|yr|y\.?o\.?)[- ]?old\b", r"(?i)\b(?:male|female|man|woman|boy|girl)\b",
        r"(?i)\b(?:caucasian|african[- ]?american|hispanic|asian|latino|latina)\b"), 0.6),
    ("place", (
        r"(?i)\b(?:resides?|lives?|living)\s+(?:in|at|near)\b", r"(?i)\b(?:transferred\s+from|referred\s+from|came\s+from)\b",
        r"(?i)\b(?:home\s+address|mailing\s+address)\b"), 0.65),
    ("heading", (
        r"(?im)^(?:Patient|Subject|Client)\s*(?:Information|Demographics)?[:\s]*$", r"(?im)^(?:Emergency\s+)?Contact[:\s]*$",
        r"(?im)^(?:Family|Social)\s+History[:\s]*$"), 0.5),
)
#: What begins a line in each of the headings' patterns; where no line begins so, they find nothing.
HEADING_LINE = r"(?imd)^(?:patient|subject|client|emergency\s|contact|family\s|social\s)"
# What speaks for a type in the text around, each pattern once; and the types that another may be, with the weight of a pattern.
INDICATORS = {
    "DATE": (r"(?i)\b(born|dob|date of birth|admission|discharge|visit|appointment)\b", r"(?i)\b(on|dated|as of|effective|expires?)\b",
             r"(?i)\b(january|february|march|april|may|june|july|august|september|october|november|december)\b"),
    "AGE": (r"(?i)\b(year[- ]?old|yo|y\.?o\.?|aged?)\b", r"(?i)\b(patient is|she is|he is|who is)\s+\d"),
    "MEASUREMENT": (r"(?i)\b(mg|ml|mcg|units?|mmol|mmhg|bpm)\b", r"(?i)\b(level|value|result|reading|score)\b", r"(?i)\d+\s*[\/x×]\s*\d+"),
    "NAME": (r"(?i)\b(patient|mr\.?|mrs\.?|ms\.?|dr\.?|name|signed|by)\b", r"(?i)\b(contact|guardian|spouse|mother|father|son|daughter)\b"),
    "MEDICATION": (r"(?i)\b(mg|mcg|tablet|capsule|prescribed|taking|dose|daily|prn)\b", r"(?i)\b(medication|drug|rx|prescription)\b"),
    "DIAGNOSIS": (r"(?i)\b(diagnosis|diagnosed|condition|disease|syndrome|disorder)\b", r"(?i)\b(icd|code|assessment)\b"),
}
OWN_WEIGHT = 0.3
ALTERNATIVES = (("DATE", "AGE", 0.4), ("DATE", "MEASUREMENT", 0.4), ("NAME", "MEDICATION", 0.35), ("NAME", "DIAGNOSIS", 0.35))
INDEPENDENT = ("SSN", "MRN", "EMAIL", "PHONE", "FAX", "CREDIT_CARD", "ACCOUNT", "IP", "URL", "PASSPORT")
# Cross-type rules (first type, second type, kind, strength, what must stand near one of the two or None).
PAIR_RULES = (
    ("SSN", "PHONE", "EXCLUSIVE", 0.95, None), ("DATE", "AGE", "EXCLUSIVE", 0.90, None), ("MRN", "ZIPCODE", "EXCLUSIVE", 0.80, None),
    ("PHONE", "FAX", "EXCLUSIVE", 0.70, None), ("DATE", "MRN", "EXCLUSIVE", 0.75, None),
    ("NAME", "ADDRESS", "EXCLUSIVE", 0.70, r"(?i)\b(street|st|ave|avenue|road|rd|drive|dr|lane|ln|blvd|way)\b"),
    ("ACCOUNT", "CREDIT_CARD", "EXCLUSIVE", 0.85, None), ("IP", "PHONE", "EXCLUSIVE", 0.90, None),
    ("NAME", "CUSTOM", "EXCLUSIVE", 0.85, r"(?i)\b(mg|mcg|tablet|daily|prn|prescribed)\b"), ("SSN", "MRN", "EXCLUSIVE", 0.85, None),
    ("NAME", "DATE", "SUPPORTIVE", 0.30, r"(?i)\b(dob|date of birth|born|birthday)\b"),
    ("NAME", "MRN", "SUPPORTIVE", 0.35, r"(?i)\b(patient|mrn|medical record|chart)\b"), ("ADDRESS", "ZIPCODE", "SUPPORTIVE", 0.40, None),
    ("PHONE", "NAME", "SUPPORTIVE", 0.25, r"(?i)\b(contact|call|phone|reach)\b"), ("EMAIL", "NAME", "SUPPORTIVE", 0.30, None),
    ("SSN", "NAME", "SUPPORTIVE", 0.40, None),
)
NEAR, PAIR_TIMES = 200, 2
HIGH_PRECISION = ("SSN", "EMAIL", "PHONE", "MRN", "CREDIT_CARD", "IP", "URL")
HEADINGS = ("MEDICAL RECORD", "PATIENT INFORMATION", "DISCHARGE SUMMARY", "PROGRESS NOTE", "HISTORY", "ASSESSMENT", "PLAN")
# Types that need no whitelist, and what makes a text a person's.
CLOSED = ("SSN", "PHONE", "EMAIL", "IP", "URL", "FAX", "MRN", "ACCOUNT", "LICENSE", "CREDIT_CARD", "HEALTH_PLAN", "DEVICE", "BIOMETRIC")
PERSON_TITLE = r"(?i)^(?:Dr\.?|Mr\.?|Mrs\.?|Ms\.?|Miss|Prof\.?|Rev\.?)\s+"
PERSON_SUFFIX = r"(?i)\s+(?:Jr\.?|Sr\.?|II|III|IV|V|MD|DO|PhD|RN|NP)\z"
STRUCTURE = ("record", "section", "summary", "report", "history", "assessment", "plan", "note")
MEDICAL = ("hypertension", "diabetes", "medication", "surgery", "hospital", "cancer")
GEOGRAPHIC = ("street", "avenue", "county", "city", "springfield")


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def with_text(spans: DataFrame, docs: DataFrame) -> DataFrame:
    return spans.join(docs.select("doc_id", F.col("text").alias("body")), "doc_id")


def around(reach: int) -> Column:
    """The text from ``reach`` before a span to ``reach`` after it."""
    at = F.greatest(F.lit(0), F.col("start") - reach)
    return F.substr(F.col("body"), at + 1, F.col("end") + reach - at)


def window_tokens(spans: DataFrame, docs: DataFrame, n: int = 5) -> DataFrame:
    """Adds ``window``: the ``n`` words before a span and the ``n`` after it, lower case, however long or far they are; a word
    that a span cuts counts with its rest. Each side is searched from the span outwards, up to the ``n``-th word. Also adds ``after_title``,
    and ``alone``: all within 50 characters of the span, itself included, is one short capitalised word."""
    from veilframe.functions.match import java

    first = rf"^\W*((?:\w+\W+){{0,{n - 1}}}\w+)"
    before = F.reverse(F.regexp_extract(F.reverse(F.substr(F.col("body"), F.lit(1), F.col("start").cast("int"))), first, 1))
    after = F.regexp_extract(F.substr(F.col("body"), F.col("end") + 1), first, 1)
    tokens = lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"\w+"), F.lit(0)), F.lower)
    at = F.greatest(F.lit(0), F.col("start") - 50)
    titled = F.regexp_like(F.substr(F.col("body"), at + 1, F.col("start") - at), F.lit(java(TITLE)))
    return with_text(spans, docs).withColumns({"window": F.concat(tokens(before), tokens(after)), "after_title": titled, "alone": F.regexp_like(around(50), F.lit(ALONE))}).drop("body")


def context_modifiers(windowed: DataFrame, rules=CONTEXT_RULES) -> DataFrame:
    """Multiplies the confidence of a name by 1.4 after a title, then of any type where a rule's word stands in the window, then of a name
    that stands alone by 0.7; boosts stop at 0.98, penalties at 0.02."""

    def times(applies: Column, factor: Column) -> Column:
        c = F.col("confidence")
        skip = ~F.coalesce(applies, F.lit(False)) | (factor > 1) & (c >= 0.98) | (factor < 1) & (c <= 0.02)
        return F.when(skip, c).otherwise(clamp(c * factor))

    name = F.col("type") == "NAME"
    rule = F.lit(1.0)
    for type_, found, factor in rules:  # one rule a type, so the first that applies is the only one
        rule = F.when((F.col("type") == type_) & F.arrays_overlap("window", F.array(*map(F.lit, found))), F.lit(factor)).otherwise(rule)
    for applies, factor in ((name & F.col("after_title"), F.lit(TITLE_FACTOR)), (F.lit(True), rule), (name & F.col("alone"), F.lit(ALONE_FACTOR))):
        windowed = windowed.withColumn("confidence", times(applies, factor))
    return windowed.drop("after_title", "alone")


def label_pattern(labels: tuple[str, ...]) -> str:
    return r"(?i)\b(?:" + "|".join(x.replace("#?", r"(?:\s*[#])?") if "#?" in x else x.replace("#", r"\s*#") for x in labels).replace(" ", r"\s+") + r")\s*:"


def field_contexts(docs: DataFrame, labels=FIELD_LABELS) -> DataFrame:
    """(doc_id, label_start, value_start, value_end, expected, sure, rank): what follows each label, up to the end of its line or to capitals
    before a colon; the next line where nothing follows; no row for an empty value. ``rank`` is the label's group in the list."""
    from veilframe.functions.match import bound, matches, starts

    def labelled(rank: int, names: tuple[str, ...], expected: str, sure: float) -> Column:
        return F.transform(matches("text", by_first_letter((label_pattern(names),))), lambda m: F.struct(m["start"].alias("label_start"), m["end"].alias("label_end"), F.lit(expected).alias("expected"), F.lit(sure).alias("sure"), F.lit(rank).alias("rank")))

    # no label takes a comma, or a full stop before a line break, so none goes over such a cut; only pieces with a colon are searched
    cut = F.split(F.replace(F.col("text"), F.lit(".\n"), F.lit(",,")), ",", -1)
    at = bound(F.transform(cut, lambda x: (F.length(x) + 1).cast("bigint")), starts)
    pieces = F.filter(F.arrays_zip(cut.alias("text"), at.alias("at")), lambda x: x["text"].contains(":"))
    parts = docs.select("doc_id", F.col("text").alias("whole"), F.explode(pieces).alias("piece")).select("doc_id", "whole", "piece.*")
    found = F.concat(*[labelled(i, *x) for i, x in enumerate(labels)])
    rows = parts.select("doc_id", "whole", "at", F.explode(found).alias("f")).select("doc_id", F.col("whole").alias("text"), "at", "f.*")
    rows = rows.withColumns({"label_start": F.col("at") + F.col("label_start"), "label_end": F.col("at") + F.col("label_end")})
    tail = F.substr(F.col("text"), F.col("label_end") + 1)
    lead = F.length(F.regexp_extract(tail, r"^([ \t\x0B\f\r]*\n?[ \t]*)", 1))
    rest = F.substr(tail, lead + 1)
    # runs of capitals are taken whole, so that each character is looked at once
    value = F.substring_index(F.regexp_extract(rest, r"^((?:[^A-Z\n]++|[A-Z][A-Z \t\n\x0B\f\r]*+(?!:))*+)", 1), "\n", 1)
    value = F.rtrim(value, F.lit(" \t\x0b\f\r"))
    start = F.col("label_end") + lead
    return rows.select("doc_id", "label_start", start.alias("value_start"), (start + F.length(value)).alias("value_end"), "expected", "sure", "rank").where("value_end > value_start")


def field_boost(spans: DataFrame, contexts: DataFrame) -> DataFrame:
    """Of the contexts over a span the first in the list of labels decides: its type raises the confidence by 1.15 and the priority to 90,
    another lowers it by 0.8."""
    c = contexts.select(F.col("doc_id").alias("_d"), "value_start", "value_end", "expected", "rank")
    key = ["doc_id", "start", "end", "type", "pattern"]
    met = spans.join(c, (F.col("doc_id") == F.col("_d")) & (F.col("start") < F.col("value_end")) & (F.col("value_start") < F.col("end"))).groupBy(*key).agg(F.min_by("expected", "rank").alias("expected"))
    joined = spans.join(met, key, "left")
    same = F.col("expected") == F.col("type")
    return joined.withColumn("confidence", F.when(F.col("expected").isNull(), F.col("confidence")).when(same, clamp(F.col("confidence") * 1.15)).otherwise(F.col("confidence") * 0.8)).withColumn("priority", F.when(same, F.greatest("priority", F.lit(90))).otherwise(F.col("priority"))).drop("expected")


def by_first_letter(patterns: tuple[str, ...]) -> str:
    """One Java pattern for all that begin, in any case, at a boundary with a letter or digit. Alternatives of one letter stand together, in
    their order, so it matches as they do, and most words meet few of them."""
    from veilframe.functions.match import BOUNDARY

    grouped: dict[str, list[str]] = {}
    for p in patterns:
        body = p.removeprefix(r"(?i)\b")
        depth, alternatives, tail = 0, [""], body
        if body.startswith("(?:"):
            for i, c in enumerate(body):
                depth += (c == "(") - (c == ")")
                if depth == 0:
                    tail = body[i + 1 :]
                    break
                if c == "|" and depth == 1:
                    alternatives.append("")
                elif i > 2:
                    alternatives[-1] += c
        for x in ([a + tail for a in alternatives] if body.startswith("(?:") else [body]):
            plain = x[0].isalpha() and x[1] not in "?*+{"
            grouped.setdefault(x[0].lower() if plain else "", []).append(x[1:] if plain else x)
    return (r"(?i)(?<!\w)(?:" + "|".join(f"{k}(?:{'|'.join(xs)})" for k, xs in grouped.items()) + ")").replace(r"\b", BOUNDARY)


def clinical_parts(text: Column, patterns: tuple[str, ...]) -> Column:
    """What of a text holds matches of the indicators: its pieces in which any of them is found. It is cut at commas and at a full stop
    before a line break, which none of them takes."""
    any_of = by_first_letter(patterns)
    return F.array_join(F.filter(F.split(F.replace(text, F.lit(".\n"), F.lit(",")), ",", -1), lambda x: F.regexp_like(x, F.lit(any_of))), ",")


def clinical_context(text: Column) -> Column:
    """Sum of weights, and STRONG / MODERATE / WEAK / NONE. All indicators are looked for at once, then counted in the pieces of the text
    that hold one; headings, which take whole lines, are counted where one of their words stands."""
    from veilframe.functions.match import bound, java

    def count(own: Column, p: str) -> Column:
        return F.regexp_count(own, F.lit(java(p).replace("(?im)", "(?imd)") if p.startswith("(?im)") else by_first_letter((p,))))

    def judged(kinds: Column) -> Column:
        total, n = F.aggregate(kinds, F.lit(0.0), lambda a, x: a + x), F.size(F.filter(kinds, lambda x: x > 0))
        name = F.when((total >= 1.5) | ((total >= 0.8) & (n >= 2)), "STRONG").when((total >= 0.7) | (n >= 2), "MODERATE").when(total > 0, "WEAK").otherwise("NONE")
        return F.struct(F.round(total, 6).alias("weight"), name.alias("strength"))

    def counted(own: Column) -> Column:
        kinds = []
        for kind, patterns, w in CLINICAL:
            n = reduce(lambda a, b: a + b, (count(text if kind == "heading" else own, p) for p in patterns))
            kinds.append((F.when(F.regexp_like(text, F.lit(HEADING_LINE)), n).otherwise(0) if kind == "heading" else n) * F.lit(w))
        return bound(F.array(*kinds), judged)

    return bound(clinical_parts(text, tuple(p for kind, patterns, _ in CLINICAL if kind != "heading" for p in patterns)), counted)


def clinical_strength(text: Column) -> tuple[Column, Column]:
    """Both fields of the context; for one of them, as each use computes it anew."""
    out = clinical_context(text)
    return out["weight"], out["strength"]


def clinical_boost(spans: DataFrame, docs: DataFrame, reach: int = 150) -> DataFrame:
    """Adds .15 / .10 / .05 by the strength within ``reach``, half of it (and nothing for WEAK) for types that need no context; at most .99."""
    joined = with_text(spans, docs)
    _, strength = clinical_strength(around(reach))
    gain = F.when(F.col("_k") == "STRONG", 0.15).when(F.col("_k") == "MODERATE", 0.10).when(F.col("_k") == "WEAK", 0.05).otherwise(0.0)
    half = F.when(F.col("_k").isin("STRONG", "MODERATE"), gain / 2).otherwise(0.0)
    out = joined.withColumn("_k", strength).drop("body")
    gained = F.when(F.col("type").isin(*INDEPENDENT), half).otherwise(gain)
    return out.withColumn("confidence", F.greatest(F.col("confidence"), F.least(F.lit(0.99), F.col("confidence") + gained))).drop("_k")


def weighted(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Base by type or pattern, plus what stands within 100 characters, less what makes a name unlikely. Sure spans stay (0.92, or 0.88 for
    types of high precision), as do hopeless ones (0.15)."""
    joined = with_text(spans, docs)
    ctx = F.lower(around(100))
    p = F.lower("pattern")
    base = F.when(F.col("type").isin(*HIGH_PRECISION), 0.95).when(F.col("type") == "NAME", F.when(p.contains("last_first"), 0.95).when(p.contains("title"), 0.92).when(p.contains("label"), 0.90).when(p.contains("family"), 0.90).otherwise(0.70)).otherwise(F.col("confidence"))
    gain = F.when(F.regexp_like(ctx, F.lit(r"(?:dr|mr|mrs|ms)\. ")), 0.25).otherwise(0.0) + F.when(F.regexp_like(ctx, F.lit("wife|husband|mother|father|son|daughter")), 0.30).otherwise(0.0) + F.when(F.regexp_like(ctx, F.lit("name:|patient:")), 0.20).otherwise(0.0)
    words = F.split(F.lower("text"), "[^a-z]+")
    penalty = F.when(F.arrays_overlap(words, F.array(*map(F.lit, STRUCTURE))), 0.85).when(F.arrays_overlap(words, F.array(*map(F.lit, MEDICAL))), 0.80).when(F.arrays_overlap(words, F.array(*map(F.lit, GEOGRAPHIC))), 0.60).otherwise(0.0)
    name = F.col("type") == "NAME"
    new = clamp(base + F.when(name, gain - penalty).otherwise(0.0))
    c = F.col("confidence")
    keep = (c >= 0.92) | (F.col("type").isin(*HIGH_PRECISION) & (c >= 0.88)) | (c <= 0.15)
    return joined.withColumn("confidence", F.when(keep, c).otherwise(new)).drop("body")


def pair_rules(spark, rules=PAIR_RULES) -> DataFrame:
    """The rules, with ``hint`` for the place of their pattern among those of ``hints``."""
    patterns = hints(rules)
    return spark.createDataFrame([(a, b, k, x, patterns.index(h) if h else None) for a, b, k, x, h in rules], "a_type string, b_type string, kind string, strength double, hint int")


def hints(rules=PAIR_RULES) -> list[str]:
    return [r[4] for r in rules if r[4]]


def nearby_pairs(spans: DataFrame, near: int = NEAR, more: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of spans of one document with at most ``near`` characters between them, the first being the smaller by (start, end, type, pattern).

    Documents are cut into cells of ``near`` and a reach is rounded up to whole cells, so a long document's spans meet only those around them.
    """
    key = ["start", "end", "text", "type", "confidence", "pattern", *more]
    a = spans.select("doc_id", *[F.col(k).alias(f"a_{k}") for k in key])
    b = spans.select(F.col("doc_id").alias("_doc"), *[F.col(k).alias(f"b_{k}") for k in key])
    a = a.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("a_start") / near) - 1, F.floor((F.col("a_end") + near) / near))))
    b = b.withColumn("_cell_b", F.floor(F.col("b_start") / near))
    order = lambda x: F.struct(*[F.col(f"{x}_{k}") for k in ("start", "end", "type", "pattern")])
    gap = F.greatest(F.col("b_start") - F.col("a_end"), F.col("a_start") - F.col("b_end"), F.lit(0))
    return a.join(b, (F.col("doc_id") == F.col("_doc")) & (F.col("_cell") == F.col("_cell_b"))).where((order("a") < order("b")) & (gap <= near)).drop("_doc", "_cell", "_cell_b").withColumn("gap", gap)


def cross_type(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Exclusive neighbours lower the less sure of two spans by strength * .25, supportive ones raise both by strength * .10; each pair speaks
    ``PAIR_TIMES``, at a tie of exclusive ones once for either side. A rule with a pattern needs it within 100 characters of one of the two.
    Equal texts of a document, if a type has two of them: the most frequent type (the first of equals) gains .10, others lose .125. Summed,
    then clamped."""
    from veilframe.functions.match import java

    joined = with_text(spans, docs)
    at = F.greatest(F.lit(0), F.col("start") - 100)
    near = F.concat(F.substr(F.col("body"), at + 1, F.col("start") - at), F.lit(" "), F.substr(F.col("body"), F.col("end") + 1, F.lit(100)))
    hinted = joined.withColumn("hints", F.array(*(F.regexp_like(near, F.lit(java(h))) for h in hints()))).drop("body")
    kinds = pair_rules(spans.sparkSession).select(F.least("a_type", "b_type").alias("_low"), F.greatest("a_type", "b_type").alias("_high"), "kind", "strength", "hint")
    met = nearby_pairs(hinted, more=("hints",)).join(F.broadcast(kinds), (F.least("a_type", "b_type") == F.col("_low")) & (F.greatest("a_type", "b_type") == F.col("_high")))
    met = met.where(F.col("hint").isNull() | F.get("a_hints", F.col("hint")) | F.get("b_hints", F.col("hint")))
    down = F.lit(-0.25 * PAIR_TIMES) * F.col("strength")
    up = F.lit(0.10 * PAIR_TIMES) * F.col("strength")

    def moves(own: str, other: str) -> Column:
        lower = F.when(F.col(own) < F.col(other), down).when(F.col(own) == F.col(other), down / PAIR_TIMES).otherwise(0.0)
        return F.when(F.col("kind") == "EXCLUSIVE", lower).otherwise(up)

    side = lambda x, d: met.select("doc_id", F.col(f"{x}_start").alias("start"), F.col(f"{x}_end").alias("end"), F.col(f"{x}_type").alias("type"), F.col(f"{x}_pattern").alias("pattern"), d.alias("delta"))
    moved = side("a", moves("a_confidence", "b_confidence")).unionByName(side("b", moves("b_confidence", "a_confidence")))
    same = spans.withColumn("norm", F.regexp_replace(F.lower(F.trim("text")), r"\s+", " "))
    counts = same.groupBy("doc_id", "norm", "type").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first"))
    most = counts.groupBy("doc_id", "norm").agg(F.max_by("type", F.struct(F.col("n"), -F.col("first"), F.col("type"))).alias("most"), F.max("n").alias("n"))
    consistent = same.join(most.where("n >= 2"), ["doc_id", "norm"]).select("doc_id", "start", "end", "type", "pattern", F.when(F.col("type") == F.col("most"), 0.10).otherwise(-0.125).alias("delta"))
    key = ["doc_id", "start", "end", "type", "pattern"]
    delta = moved.unionByName(consistent).groupBy(*key).agg(F.sum("delta").alias("delta"))
    return spans.join(delta, key, "left").withColumn("confidence", F.round(clamp(F.col("confidence") + F.coalesce("delta", F.lit(0.0))), 6)).drop("delta")


def same_place(spans: DataFrame) -> DataFrame:
    """Of spans of one place the surest, with the other types in ``ambiguous_with``; ties to the first by type, then pattern."""
    pick = F.max_by(F.struct("text", "type", "confidence", "priority", "pattern"), F.struct(F.col("confidence"), F.col("priority"), F.col("type"), F.col("pattern")))
    g = spans.groupBy("doc_id", "start", "end").agg(pick.alias("s"), F.array_sort(F.collect_set("type")).alias("types"))
    return g.select("doc_id", "start", "end", "s.*", F.filter("types", lambda t: t != F.col("s.type")).alias("ambiguous_with"))


def disambiguated(spans: DataFrame, docs: DataFrame, reach: int = 100) -> DataFrame:
    """For each span and each other type it may be (``ALTERNATIVES``): the winner by the indicators within ``reach``, and how surely: .5 and the
    winner's weights, .95 at most; at a tie the span's own type with .5. Spans of types without alternatives have no row."""
    from veilframe.functions.match import java

    found = {t: reduce(lambda a, b: a + b, (F.regexp_like(F.col("_near"), F.lit(java(p))).cast("int") for p in INDICATORS[t])) for t in INDICATORS}
    near = with_text(spans, docs).withColumn("_near", around(reach)).drop("body").where(F.col("type").isin(*{a for a, *_ in ALTERNATIVES}))
    near = near.select("*", *(n.alias(f"_{t}") for t, n in found.items())).drop("_near")

    def judged(own: str, other: str, weight: float) -> Column:
        a, b = F.col(f"_{own}") * F.lit(OWN_WEIGHT), F.col(f"_{other}") * F.lit(weight)
        sure = F.round(F.when(a == b, 0.5).otherwise(F.least(F.lit(0.95), 0.5 + F.greatest(a, b))), 6)
        return F.when(F.col("type") == own, F.struct(F.lit(other).alias("alternative"), F.when(b > a, other).otherwise(own).alias("winner"), sure.alias("sure")))

    votes = F.filter(F.array(*(judged(*x) for x in ALTERNATIVES)), lambda v: v.isNotNull())
    return near.withColumn("_vote", F.explode(votes)).select(*spans.columns, "_vote.*")


#: What parts the words of a text, alike for every engine: at white space, and at commas too.
WHITE, WHITE_COMMA = r"[ \t\n\f\r]+", r"[, \t\n\f\r]+"
#: Of these no text may hold one, of these not be one, and of these not have one as a word.
PARTS = (*words.LABEL_PARTS, *words.INSURERS, *words.HOSPITALS, *words.STRUCTURE_PARTS)
WHOLE = (*words.PROCEDURES, *words.ANATOMY, *words.ACRONYMS)
BESIDE = r"\b(?:" + "|".join(words.EPONYM_BESIDE) + r")\b|'s?[ \t\n\f\r]*\z"


def one_of(parts: tuple[str, ...]) -> str:
    """A pattern for any of the literals (letters, digits, dots and signs without a meaning in patterns)."""
    return "|".join(p.replace(".", r"\.") for p in parts)


def whitelist_filter(spans: DataFrame, conditions: tuple[str, ...] = (), medications: tuple[str, ...] = ()) -> DataFrame:
    """Drops spans of open types that are, or hold, what the whitelist knows: labels, insurers, hospitals and structure also within a word,
    procedures, anatomy and acronyms as a whole or a word of more than two letters, eponyms beside what they name, and for names places and
    words no name is made of. ``conditions`` and ``medications`` are tables of the caller's, in small letters. Closed types and labelled names
    of .95 stay; with a person's title or suffix only structure, also within another word, drops a span. Null texts stay."""
    from veilframe.functions.match import java

    t = F.trim("text")
    low, name = F.lower(t), F.col("type") == "NAME"
    spaced = F.split(low, WHITE)
    single = F.filter(F.split(low, WHITE_COMMA), lambda w: F.length(w) > 2)
    has = lambda ws, xs: F.exists(ws, lambda w: w.isin(*xs))
    own = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) > 2)
    known = F.arrays_overlap(own, F.array(*map(F.lit, STRUCTURE + MEDICAL)))
    whole = (*WHOLE, *conditions, *medications)
    listed = (
        F.regexp_like(low, F.lit(one_of(PARTS))) | low.isin(*whole) | has(single, whole) | has(spaced, (*words.PROCEDURES, *conditions))
        | has(spaced, words.EPONYMS) & F.regexp_like(low, F.lit(java(BESIDE)))
        | name & (has(spaced, words.PLACE_WORDS) | has(single, (*words.PLACE_WORDS, *words.NEVER_NAMES)) | F.forall(spaced, lambda w: w.isin(*words.NEVER_NAMES)))
    )
    person = F.regexp_like(t, F.lit(java(PERSON_TITLE))) | F.regexp_like(t, F.lit(java(PERSON_SUFFIX)))
    structure = reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in STRUCTURE)) | F.regexp_like(low, F.lit(one_of(words.STRUCTURE_PARTS)))
    dropped = F.coalesce(F.when(person, structure).otherwise(known | listed), F.lit(False))
    return spans.where(F.col("type").isin(*CLOSED) | (F.col("pattern").contains("Labeled name field") & (F.col("confidence") >= 0.95)) | ~dropped)


def all_caps_filter(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Drops NAME spans in a line of capitals that holds a heading and no colon."""
    joined = with_text(spans, docs)
    before = F.element_at(F.split(F.substr(F.col("body"), F.lit(1), F.col("start")), "\n"), -1)
    after = F.element_at(F.split(F.substr(F.col("body"), F.col("start") + 1), "\n"), 1)
    line = F.concat(before, after)
    heading = reduce(lambda a, b: a | b, (F.contains(line, F.lit(h)) for h in HEADINGS))
    return joined.where(~((F.col("type") == "NAME") & (F.upper(line) == line) & heading & ~F.contains(line, F.lit(":")))).drop("body")


def ensemble_vote(votes: DataFrame) -> DataFrame:
    """(id, signal, w, c) to (id, score, decision): weighted geometric mean times an agreement factor of 1.15 - 0.3 * entropy, + .05 (1.2 at most) if two agree."""
    g = votes.groupBy("id").agg(F.exp(F.sum(F.col("w") * F.ln(F.greatest("c", F.lit(0.01)))) / F.sum("w")).alias("mean"), F.avg((F.col("c") >= 0.5).cast("double")).alias("p"), F.sum((F.col("c") >= 0.5).cast("int")).alias("yes"))
    h = F.when((F.col("p") <= 0) | (F.col("p") >= 1), 0.0).otherwise(-(F.col("p") * F.log2("p") + (1 - F.col("p")) * F.log2(1 - F.col("p"))))
    factor = F.least(F.lit(1.2), F.lit(1.15) - 0.3 * h + F.when(F.col("yes") >= 2, 0.05).otherwise(0.0))
    s = F.round(clamp(F.col("mean") * factor), 6)
    return g.select("id", s.alias("score"), F.when(s >= 0.65, "REDACT").when(s <= 0.35, "SKIP").otherwise("UNCERTAIN").alias("decision"))


def explain(spans: DataFrame) -> DataFrame:
    """Factors of a decision: base, +.10 pattern, +.05 by priority of 90, length; REDACT from .6."""
    length = F.when(F.length("text") >= 8, 0.05).when(F.length("text") < 3, -0.05).otherwise(0.0)
    total = F.round(clamp(F.col("confidence") + 0.10 + F.when(F.col("priority") >= 90, 0.05).otherwise(0.0) + length), 6)
    return spans.select("doc_id", "start", "end", "type", "pattern", F.col("confidence").alias("base"), length.alias("length_factor"), total.alias("total"), F.when(total >= 0.6, "REDACT").otherwise("KEEP").alias("decision"))
