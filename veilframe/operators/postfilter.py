"""Adaptive thresholds and the suppression of false positives."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.match import bound, java
from veilframe.operators.words import FIELD_LABELS, MEDICAL_PHRASES, PLACES, SECTION_HEADINGS, SINGLE_WORD_HEADINGS, STRUCTURE_WORDS

# Factors of the minimum confidence, all clamped to [.3, .99] after multiplication.
BASE_THRESHOLD = 0.60
DOCUMENT_TYPES = (("discharge_summary", r"(?i)discharge summary", 0.95), ("radiology_report", r"(?i)radiology|x-ray|ct scan|mri", 0.97), ("operative_report", r"(?i)operative report|procedure performed", 0.96), ("lab_report", r"(?i)laboratory|lab results", 1.05), ("progress_note", r"(?i)progress note|medical record", 1.0), ("consultation", r"(?i)consultation", 0.98))
STRENGTH_FACTOR = {"STRONG": 0.85, "MODERATE": 0.95, "WEAK": 1.0, "NONE": 1.15}
TYPE_FACTOR = {"SSN": 0.85, "MRN": 0.90, "EMAIL": 0.90, "PHONE": 0.92, "NAME": 1.05, "DATE": 1.0, "ZIPCODE": 1.10, "IP": 1.0, "VEHICLE": 1.05, "AGE": 1.0}
SPECIALTIES = (("cardiology", r"(?i)cardiac|heart|pacemaker|hypertension", 2), ("oncology", r"(?i)cancer|tumou?r|chemotherapy", 2), ("surgery", r"(?i)surgery|incision|operative", 1), ("neurology", r"(?i)brain|seizure|stroke", 2))
# How a false name begins (case counts) and ends (it does not).
INVALID_PREFIXES = (
    "The ", "A ", "An ", "To ", "From ", "In ", "On ", "At ", "Is ", "Was ", "Are ", "By ", "For ", "With ", "As ", "All ", "No ", "Not ", "And ", "Or ", "But ", "Home ", "Work ", "Cell ", "Fax ", "Email ", "Blood ", "Heart ", "Vital ",
    "Oxygen ", "Cardiac ", "Distinct ", "Athletic ", "Local ", "Regional ", "National ", "Nursing ", "Diagnostic ", "Unstable ", "Acute ", "Chronic ", "Chief ", "Present ", "Privacy ", "Advance ", "Consent ", "Financial ", "Current ",
    "Complete ", "Comprehensive ", "Continue ", "Add ", "Increase ", "Past ", "Family ", "Social ", "Review ", "Treatment ", "Provider ", "Contact ", "Relationship ", "Digital ", "Online ", "Vehicle ", "Transportation ", "Device ",
    "Implant ", "Professional ", "Biometric ", "Identifying ", "Visual ", "Reports ", "Symptom ", "Died ", "History ", "Diagnosed ", "NPO ", "Education ", "Paternal ", "Maternal ", "Consulting ", "Admitting ", "Sister ", "Brother ",
    "Allergic ", "Seasonal ", "General ", "Zip ", "Lives ", "Next ", "Medtronic ", "Zimmer ",
)
INVALID_SUFFIXES = (
    " the", " at", " in", " on", " to", " from", " reviewed", " case", " was", " is", " are", " patient", " doctor", " nurse", " staff", " phone", " address", " email", " number", " contact", " portal", " history", " status", " results",
    " plan", " notes", " unit", " rate", " pressure", " signs", " level", " build", " network", " angina", " support", " education", " planning", " studies", " management", " drip", " vehicle", " model", " location", " situation",
    " use", " boulder", " boston", " denver", " colorado", " name", " illness", " complaint", " appearance", " notice", " rights", " responsibilities", " treatment", " directive", " rhinitis", " medications", " count", " panel",
    " mellitus", " lisinopril", " aspirin", " atorvastatin", " metoprolol", " metformin", " information", " identifiers", " characteristics", "-up", " hipaa",
)
# How what is no name ends, as written.
MEDICAL_SUFFIXES = (
    "Disorder", "Mellitus", "Disease", "Syndrome", "Infection", "Condition", "Health", "Hospital", "Clinic", "Center", "Partners", "Group", "Medical", "Medicine", "System", "Systems", "Pressure", "Rate", "Signs", "Phone", "Address",
    "Email", "Portal", "History", "Examination", "Studies", "Management", "Planning",
)
# Labels that a name over a line break may have caught.
BREAK_LABEL = r"(?i)^(?:dx|dob|mrn|age|phone|fax|email|address|street|zip|zipcode|npi|dea|ssn|patient|provider)\b"
#: The last is this engine's own: a word of structure stands in it, so it goes either way.
HEADINGS = (*SECTION_HEADINGS, *SINGLE_WORD_HEADINGS, "MEDICAL RECORD")


#: What parts the words of a name, alike for every engine.
WHITE = r"[ \t\n\f\r]+"


def mapped(c: Column, table: dict, default: float) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def literals(pattern: str) -> list[str]:
    """For each alternative of a pattern of plain words the letters that it surely begins with."""
    return [re.match(r"[^?*+(\[.\\]*", re.sub(r".[?*].*", "", x))[0] for x in pattern.removeprefix("(?i)").split("|")]


def document_type(text: Column) -> Column:
    """The first type whose title pattern the text has, else general. Only lines with their words are searched."""

    def first(own: Column) -> Column:
        out = F.lit("general")
        for name, p, _ in reversed(DOCUMENT_TYPES):
            out = F.when(F.regexp_like(own, F.lit(p)), name).otherwise(out)
        return out

    return bound(held(text, [p for _, p, _ in DOCUMENT_TYPES]), first)


def held(text: Column, patterns: list[str]) -> Column:
    """The lines of a text in which words of the patterns stand; none of them takes a line break."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda line: bound(F.lower(line), lambda low: reduce(lambda a, b: a | b, (F.contains(low, F.lit(x)) for p in patterns for x in literals(p))))), "\n")


def specialty(text: Column) -> Column:
    """The specialty with the highest weighted count of its words, at least 2; ties to the earlier."""

    def judged(scores: Column) -> Column:
        best = F.array_max(scores)
        return F.when(best >= 2, F.get(F.array(*[F.lit(name) for name, _, _ in SPECIALTIES]), F.array_position(scores, best).cast("int") - 1)).otherwise("general")

    counts = lambda own: bound(F.array(*[F.regexp_count(own, F.lit(p)) * w for _, p, w in SPECIALTIES]), judged)
    return F.coalesce(bound(held(text, [p for _, p, _ in SPECIALTIES]), counts), F.lit("general"))


def minimum(doc_type: Column, strength: Column, type_: Column) -> Column:
    product = F.lit(BASE_THRESHOLD) * mapped(doc_type, {n: f for n, _, f in DOCUMENT_TYPES}, 1.0) * mapped(strength, STRENGTH_FACTOR, 1.0) * mapped(type_, TYPE_FACTOR, 1.0)
    return F.round(F.greatest(F.lit(0.3), F.least(F.lit(0.99), product)), 6)


def learned_factors(feedback: DataFrame, at_least: int = 10) -> DataFrame:
    """(key, false_positive, false_negative) rows to a factor in [.8, 1.2] for each key with enough feedback."""
    g = feedback.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("false_positive").cast("double")).alias("fp"), F.avg(F.col("false_negative").cast("double")).alias("fn"))
    return g.where(F.col("n") >= at_least).select("key", "n", F.round(F.greatest(F.lit(0.8), F.least(F.lit(1.2), 1 + 0.4 * (F.col("fp") - F.col("fn")))), 6).alias("factor"))


def removed_by(threshold: Column, text: Column | None = None) -> Column:
    """The first strategy that drops a span, null if none: columns text, type, confidence, body, end."""
    t = text if text is not None else F.col("text")
    low, name = F.lower(t), F.col("type") == "NAME"
    words = F.split(low, WHITE)
    among = lambda xs: F.exists(words, lambda w: w.isin(*(x.lower() for x in xs)))
    starts = lambda xs: F.greatest(*[t.startswith(x) for x in xs])
    ends = lambda c, xs: F.greatest(*[c.endswith(x) for x in xs])
    after = F.trim(F.regexp_replace(F.regexp_extract(t, r"(?s)\A.*?\r?\n(.*)\z", 1), r"\r?\n", " "), F.lit(" \t\f"))
    label = F.regexp_like(after, F.lit(java(BREAK_LABEL))) | (F.length(after) <= 24) & F.contains(after, F.lit(":"))
    return (
        F.when(F.col("confidence") < threshold, "threshold")
        .when(F.col("type").isin("DEVICE", "PHONE") & F.regexp_like(low, F.lit("call button|room:|bed:")), "device_phone")
        .when(name & F.regexp_like(t, F.lit(r"^[A-Z\s]+\z")) & F.trim(t, F.lit(" \t\n\f\r")).isin(*HEADINGS), "heading")
        .when(name & among(STRUCTURE_WORDS), "structure")
        .when(name & (F.length(t) < 5) & ~F.contains(t, F.lit(",")) & (F.col("confidence") < 0.9), "short")
        .when(name & starts(INVALID_PREFIXES), "prefix")
        .when(name & ends(low, INVALID_SUFFIXES), "suffix")
        .when(name & label, "line_break")
        .when(name & low.isin(*MEDICAL_PHRASES), "medical")
        .when(name & ends(t, MEDICAL_SUFFIXES), "medical_suffix")
        .when(name & among(PLACES), "geographic")
        .when(name & low.isin(*FIELD_LABELS), "label")
    )
