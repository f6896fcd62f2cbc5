"""Replacing spans by tokens or styles, and putting the originals back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def splice(text: Column, spans: Column, replacement, between=lambda x: x) -> Column:
    """``text`` with each of the disjoint, ordered spans replaced by ``replacement(span, index)``, and what stands between by
    ``between`` of it; one pass, left to right."""
    pieces = F.transform(spans, lambda s, i: F.concat(between(F.substr(text, F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)) + 1, s["start"] - F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)))), replacement(s, i)))
    last = F.coalesce(F.get(spans, F.size(spans) - 1)["end"], F.lit(0))
    return F.concat(F.concat_ws("", pieces), between(F.substr(text, last + 1)))


def style(s: Column, kind: str = "brackets") -> Column:
    if kind == "brackets":
        return F.concat(F.lit("["), s["type"], F.lit("]"))
    if kind == "asterisks":
        return F.repeat(F.lit("*"), F.length(s["text"]))
    if kind == "empty":
        return F.lit("")
    return F.lit(kind)


def redact(df: DataFrame, kind: str = "brackets", text: str = "text") -> DataFrame:
    """Adds ``redacted`` and ``n_redactions``; spans must be resolved. A text whose spans are null is not let through: it becomes null."""
    return df.withColumn("redacted", splice(F.col(text), F.col("spans"), lambda s, i: style(s, kind))).withColumn("n_redactions", F.size("spans").cast("long"))


def numbered(df: DataFrame) -> DataFrame:
    """Adds ``tokens``: one for each distinct (type, value) of a text, numbered per type by first place, left to right."""
    distinct = F.transform(F.array_distinct(F.transform("spans", lambda s: F.struct(s["type"].alias("type"), s["text"].alias("text")))), lambda d, i: F.struct(d["type"].alias("type"), d["text"].alias("text"), i.alias("i")))
    out = df.withColumn("_d", distinct)
    return out.withColumn("tokens", F.transform("_d", lambda d: F.struct(d["type"].alias("type"), d["text"].alias("original"), F.size(F.filter("_d", lambda e: (e["type"] == d["type"]) & (e["i"] <= d["i"]))).alias("n")))).drop("_d")


def tokenize(df: DataFrame, scope: str, text: str = "text") -> DataFrame:
    """Adds ``redacted`` with tokens {{TYPE_scope_N}}, and ``token_map`` (token, original, type). A ``{{`` that the text itself
    has outside of spans is written ``{U+FDD0{``, so that it is never taken for a token."""
    named = numbered(df).withColumn("token_map", F.transform("tokens", lambda t: F.struct(F.concat(F.lit("{{"), t["type"], F.lit("_"), F.regexp_replace(F.col(scope).cast("string"), "[{}\ufdd0]", "_"), F.lit("_"), t["n"].cast("string"), F.lit("}}")).alias("token"), t["original"].alias("original"), t["type"].alias("type")))).drop("tokens")

    def token(s: Column, i: Column) -> Column:
        return F.get(F.filter("token_map", lambda t: (t["type"] == s["type"]) & (t["original"] == s["text"])), F.lit(0))["token"]

    return named.withColumn("redacted", splice(F.col(text), F.col("spans"), token, lambda gap: F.regexp_replace(gap, r"\{(?=[\ufdd0{])", "{\ufdd0")))


TOKEN = r"\{\{[A-Z_]+_[^{}\ufdd0]*_[0-9]+\}\}"


def restore(df: DataFrame, redacted: str = "redacted", token_map: str = "token_map") -> DataFrame:
    """Adds ``restored``: every known token replaced by its original in a single pass, unknown ones left."""
    found = F.regexp_extract_all(F.col(redacted), F.lit(TOKEN), F.lit(0))
    out = df.withColumn("_m", found).withColumn("_g", F.split(redacted, TOKEN, -1))
    value = lambda m: F.coalesce(F.get(F.filter(token_map, lambda t: t["token"] == m), F.lit(0))["original"], m)
    plain = lambda g: F.regexp_replace(g, "\\{\ufdd0", "{")
    joined = F.concat_ws("", F.transform("_g", lambda g, i: F.concat(plain(g), F.coalesce(value(F.get("_m", i)), F.lit("")))))
    return out.withColumn("restored", joined).drop("_m", "_g")
