"""The whole chain from texts to redacted texts: what each step of the scoring does to a span decides whether it is replaced."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions.match import SPAN
from veilframe.functions.registry import DEFAULTS, Detector
from veilframe.operators import postfilter, score
from veilframe.operators.apply import redact
from veilframe.operators.detect import detect, exploded
from veilframe.operators.resolve import resolve
from veilframe.session import materialized

KEYS = ("start", "end", "text", "type", "confidence", "priority", "pattern")


def scored(docs: DataFrame, detectors: Iterable[Detector] = DEFAULTS) -> DataFrame:
    """The long spans of (doc_id, text) after all steps that change their confidence: fields, whitelists, words around, weights, other
    types nearby, clinical context. doc_id must be unique; every step joins on it, so rows stay where the first join put them."""
    s = materialized(exploded(detect(docs, detectors), "doc_id"), "chain-spans")
    s = score.field_boost(s, score.field_contexts(docs))
    s = score.all_caps_filter(score.whitelist_filter(s), docs)
    s = score.context_modifiers(score.window_tokens(s, docs)).drop("window")
    s = materialized(score.weighted(s, docs), "chain-weighted")
    return materialized(score.clinical_boost(score.cross_type(s, docs), docs), "chain-scored")


def _gathered(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*KEYS).cast(SPAN))).alias("spans"))


def redact_full(docs: DataFrame, detectors: Iterable[Detector] = DEFAULTS, kind: str = "brackets") -> DataFrame:
    """(doc_id, text, spans, redacted, n_redactions): detected, scored, resolved, filtered against the document's own minimum,
    replaced. A null text stays null; a text without spans comes back as it was."""
    chosen = exploded(resolve(_gathered(scored(docs, detectors))), "doc_id")
    about = docs.select("doc_id", postfilter.document_type(F.col("text")).alias("dt"), score.clinical_strength(F.col("text"))[1].alias("st"))
    least = postfilter.minimum(F.col("dt"), F.col("st"), F.col("type"))
    kept = chosen.join(about, "doc_id").where(postfilter.removed_by(least).isNull()).select("doc_id", *KEYS)
    own = _gathered(kept).withColumnRenamed("doc_id", "_doc")
    joined = docs.select("doc_id", "text").join(own, F.col("doc_id") == F.col("_doc"), "left").drop("_doc")
    return redact(joined.withColumn("spans", F.coalesce("spans", F.array().cast(f"array<{SPAN}>"))), kind)
