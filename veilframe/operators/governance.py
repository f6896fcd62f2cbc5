"""Policies, consistent tokens, retention, alerts, audit trails, tag rules and box decisions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.session import materialized

# ---- policy language -------------------------------------------------------------------------------------------------

TEMPLATES = {
    "STRICT": "policy STRICT { redact names redact ssns redact phones redact emails redact dates redact mrns redact addresses redact zipcodes threshold 0.5 }",
    "RESEARCH": "policy RESEARCH extends STRICT { keep dates keep zipcodes where confidence < 0.9 threshold 0.7 }",
    "TRAINING": "policy TRAINING { redact names redact ssns keep dates }",
}
KINDS = {"name": "NAME", "ssn": "SSN", "phone": "PHONE", "email": "EMAIL", "date": "DATE", "mrn": "MRN", "address": "ADDRESS", "zipcode": "ZIPCODE", "fax": "FAX", "ip": "IP", "url": "URL", "age": "AGE", "provider": "PROVIDER_NAME", "plan": "HEALTH_PLAN"}
_RULE = re.compile(r'(description)\s+"([^"]*)"|(redact|keep)\s+(\w+)(?:\s+where\s+(\w+)\s*(<=|>=|==|!=|<|>)\s*([\w.]+))?|(threshold)\s+([\d.]+)')
_HEAD = re.compile(r"\s*policy\s+(\w+)(?:\s+extends\s+(\w+))?\s*\{(.*)\}\s*", re.S)
_FIELDS = {"confidence": float, "priority": int, "length": int}


class PolicyError(ValueError):
    pass


@dataclass
class Policy:
    name: str
    description: str = ""
    threshold: float = 0.0
    rules: dict[str, tuple[str, tuple[str, str, str] | None]] = field(default_factory=dict)


def parse_policy(source: str, known: dict[str, str] = TEMPLATES) -> Policy:
    """A policy from its text; what it extends is taken first, later rules win, unknown identifiers and leftovers are errors."""
    head = _HEAD.fullmatch(re.sub(r"//[^\n]*", "", source))
    if not head:
        raise PolicyError("expected: policy NAME [extends BASE] { ... }")
    name, base, body = head.groups()
    if base and base not in known:
        raise PolicyError(f"unknown base {base}")
    out = parse_policy(known[base], known) if base else Policy(name)
    out.name = name
    at = 0
    for m in _RULE.finditer(body):
        if body[at : m.start()].strip(" \t\n;"):
            raise PolicyError(f"not understood: {body[at : m.start()].strip()}")
        at = m.end()
        if m[1]:
            out.description = m[2]
        elif m[8]:
            out.threshold = float(m[9])
        else:
            kind = m[4].lower()
            kind = KINDS.get(kind) or KINDS.get(kind.removesuffix("es")) or KINDS.get(kind.removesuffix("s"))
            if not kind:
                raise PolicyError(f"unknown identifier {m[4]}")
            if m[5] and m[5] not in _FIELDS:
                raise PolicyError(f"unknown field {m[5]}")
            out.rules[kind] = (m[3], (m[5], m[6], m[7]) if m[5] else None)
    if body[at:].strip(" \t\n;"):
        raise PolicyError(f"not understood: {body[at:].strip()}")
    return out


def _condition(c: tuple[str, str, str] | None) -> Column:
    if c is None:
        return F.lit(True)
    name, op, value = c
    left = F.length("text") if name == "length" else F.col(name)
    right = F.lit(_FIELDS[name](value))
    return {"<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right, "==": left == right, "!=": left != right}[op]


def policy_action(policy: Policy) -> Column:
    """redact or keep for a span: by its type's rule where the condition holds; a keep whose condition fails redacts, a redact whose fails keeps."""
    out = F.lit("keep")
    for kind, (action, condition) in policy.rules.items():
        other = "keep" if action == "redact" else "redact"
        out = F.when(F.col("type") == kind, F.when(_condition(condition), action).otherwise(other)).otherwise(out)
    return F.when(F.col("confidence") < policy.threshold, "keep").otherwise(out)


# ---- consistent tokens -----------------------------------------------------------------------------------------------

def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC in hexadecimal, composed of two hashes over the padded key."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.concat(F.lit(bytes(b ^ 0x36 for b in block)), F.encode(message, "UTF-8"))
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in block)), F.unhex(F.sha2(inner, 256))), 256)


def normalized_value() -> Column:
    t = F.col("text")
    return (
        F.when(F.col("type").isin("SSN", "PHONE", "FAX", "CREDIT_CARD"), F.regexp_replace(t, "[^0-9]", ""))
        .when(F.col("type") == "EMAIL", F.lower(t))
        .when(F.col("type") == "MRN", F.upper(F.regexp_replace(t, "[ ]", "")))
        .when(F.col("type").isin("NAME", "PROVIDER_NAME"), F.trim(F.regexp_replace(F.regexp_replace(F.lower(t), r"(?:dr|mr|mrs|ms|prof)\. ?", ""), "[^a-z ]", "")))
        .otherwise(F.lower(t))
    )


def consistent_tokens(spans: DataFrame, key: bytes = b"demo-salt") -> DataFrame:
    """One token for each (type, normalised value) of the whole collection: [TYPE-n-hash8], n by first document and place within the type.

    A type may hold most values, so no window holds a type: values are sorted in ranges of (type, first, value), counted in each
    range, and numbered after the ranges before; what is summed over all is a row for each range and type.
    """
    spark = spans.sparkSession
    entities = spans.withColumn("norm", normalized_value()).groupBy("type", "norm").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("occurrences"))
    order = ["type", "first.doc_id", "first.start", "norm"]
    ranged = entities.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("range", F.spark_partition_id())
    rows = materialized(ranged, "entities")
    sums = rows.groupBy("range", "type").agg(F.count(F.lit(1)).alias("here"))
    before = Window.partitionBy("type").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("range", "type", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("earlier"))
    n = F.row_number().over(Window.partitionBy("range", "type").orderBy("first.doc_id", "first.start", "norm")) + F.col("earlier")
    mac = hmac_sha256(key, F.concat(F.col("type"), F.lit(":"), F.col("norm")))
    numbered = rows.join(offsets, ["range", "type"])
    return numbered.select("type", "norm", n.cast("long").alias("n"), "occurrences", F.col("first.doc_id").alias("first_doc"), mac.alias("mac")).withColumn("token", F.concat(F.lit("["), "type", F.lit("-"), F.col("n").cast("string"), F.lit("-"), F.substr("mac", F.lit(1), F.lit(8)), F.lit("]")))


def entity_rollup(spans: DataFrame) -> DataFrame:
    return spans.rollup("type", "pattern").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"), F.grouping_id().cast("long").alias("level"))


def sealed(rows: DataFrame, column: str, key: Column) -> DataFrame:
    """``column`` encrypted (GCM) as ``sealed``; ``key`` has 16, 24 or 32 bytes."""
    return rows.withColumn("sealed", F.aes_encrypt(F.col(column), key, F.lit("GCM"))).drop(column)


def opened(rows: DataFrame, column: str, key: Column) -> DataFrame:
    return rows.withColumn(column, F.aes_decrypt("sealed", key, F.lit("GCM")).cast("string")).drop("sealed")


def shifted_dates(dates: DataFrame, days: int) -> DataFrame:
    """(doc_id, d) with ``shifted`` and a token for each distinct date of a document, in the order of dates."""
    n = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("d"))
    return dates.select("doc_id", "d", F.date_add("d", days).alias("shifted"), F.concat(F.lit("[DATE_"), n.cast("string"), F.lit("]")).alias("token"))


# ---- retention -------------------------------------------------------------------------------------------------------

def retention(records: DataFrame, today: Column, archive_days: int = 365, keep_days: int = 2190) -> DataFrame:
    """(id, data_type, created) with ``due``: destroy after ``keep_days``, archive after ``archive_days``, else none."""
    age = F.date_diff(today, F.to_date("created"))
    return records.withColumn("age_days", age.cast("long")).withColumn("due", F.when(age > keep_days, "destroy").when(age > archive_days, "archive").otherwise("none"))


def without_holds(records: DataFrame, holds: DataFrame) -> DataFrame:
    """Records that no hold covers. A hold has data_type (null: all) and an interval of created days (null: open)."""
    h = F.broadcast(holds.select(F.col("data_type").alias("h_type"), "from_day", "to_day"))
    day = F.to_date("created")
    return records.join(h, (F.col("h_type").isNull() | (F.col("h_type") == F.col("data_type"))) & (F.col("from_day").isNull() | (day >= F.col("from_day"))) & (F.col("to_day").isNull() | (day <= F.col("to_day"))), "left_anti")


# ---- alerts ----------------------------------------------------------------------------------------------------------

def busy_minutes(events: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """Events whose user made more than ``limit`` of them in the ``seconds`` up to it. The window is per user, so it scales with users."""
    w = Window.partitionBy("user_id").orderBy(F.col("ts").cast("timestamp").cast("long")).rangeBetween(-seconds, 0)
    return events.withColumn("recent", F.count(F.lit(1)).over(w)).where(F.col("recent") > limit)


def off_hours(events: DataFrame, first: int = 8, last: int = 18) -> DataFrame:
    return events.where((F.hour("ts") < first) | (F.hour("ts") >= last))


def failure_rate(events: DataFrame, bad: str = "error", limit: float = 0.1) -> DataFrame:
    g = events.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("event_type") == bad).cast("long")).alias("failed"))
    return g.withColumn("rate", F.round(F.col("failed") / F.col("n"), 6)).where(F.col("rate") > limit)


def cooled_down(alerts: DataFrame, seconds: int) -> DataFrame:
    """(rule, ts): alerts at least ``seconds`` after the last one that passed, of each rule; one without a time never passes.

    The fold of a rule is sequential; it runs over sorted rows as a stream, so memory is bounded by the batch.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule, last = None, None
        for b in batches:
            keep = []
            for r, t in zip(b.column("rule").to_pylist(), b.column("at").to_pylist()):
                last = last if r == rule else None
                keep.append(last is None or t - last >= seconds * 1_000_000)
                rule, last = r, t if keep[-1] else last
            yield b.filter(pa.array(keep, pa.bool_()))

    rows = alerts.select("rule", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).where("at is not null")
    return rows.repartition("rule").sortWithinPartitions("rule", "at").mapInArrow(run, rows.schema).select("rule", F.timestamp_micros("at").alias("ts"))


# ---- audit -----------------------------------------------------------------------------------------------------------

def manifest(rows: DataFrame, original: str, redacted: str) -> DataFrame:
    return rows.select("doc_id", F.sha2(original, 256).alias("original_sha256"), F.sha2(redacted, 256).alias("redacted_sha256")).withColumn("manifest_sha256", F.sha2(F.to_json(F.struct("doc_id", "original_sha256", "redacted_sha256")), 256))


def merkle_root(leaves: DataFrame, column: str) -> DataFrame:
    """The root over the sorted hexadecimal leaves; an odd node is paired with itself, pairs are hashed as bytes.

    Leaves are numbered by prefix and place within it; each level pairs neighbours by number, so no task holds a level.
    """
    spark = leaves.sparkSession
    n = leaves.count()
    parts = leaves.select(F.col(column).alias("h")).withColumn("_p", F.conv(F.substr("h", F.lit(1), F.lit(4)), 16, 10).cast("int"))
    before = parts.groupBy("_p").count().select("_p", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    level = parts.join(F.broadcast(before), "_p").select("h", (F.row_number().over(Window.partitionBy("_p").orderBy("h")) - 1 + F.col("_o")).cast("long").alias("i"))
    while n > 1:
        pairs = level.groupBy(F.floor(F.col("i") / 2).alias("i")).agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("c"))
        level = pairs.select(F.sha2(F.concat(F.unhex(F.col("c")[0]["h"]), F.unhex(F.element_at("c", -1)["h"])), 256).alias("h"), "i")
        n = (n + 1) // 2
    return level.select(F.col("h").alias("root")) if n else spark.createDataFrame([], "root string")


def audit_events(spans: DataFrame) -> DataFrame:
    """One audit resource in JSON for each document, fields in alphabetical order; ``write.text`` makes NDJSON of it."""
    g = spans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("type")).alias("types"))
    return g.select("doc_id", F.to_json(F.struct(F.lit("E").alias("action"), F.struct(F.lit("deidentification").alias("code")).alias("code"), F.struct(F.col("doc_id").cast("string").alias("reference"), F.col("n").alias("redactions"), F.col("types").alias("types")).alias("entity"), F.lit("AuditEvent").alias("resourceType"))).alias("json"))


# ---- media -----------------------------------------------------------------------------------------------------------

# Tags that identify a person, and what happens to them.
TAG_RULES = {
    "00100010": "HASH", "00100020": "HASH", "00100030": "REMOVE", "00100032": "REMOVE", "00100040": "REMOVE", "00101040": "REMOVE", "00102154": "REMOVE", "00101060": "REMOVE", "00101000": "REMOVE", "00101001": "REMOVE", "00101010": "REMOVE",
    "00080080": "HASH", "00080081": "REMOVE", "00080090": "HASH", "00081050": "HASH", "00081070": "HASH", "00080050": "HASH", "00080020": "REMOVE", "00080030": "REMOVE", "00080021": "REMOVE", "00080031": "REMOVE", "00080022": "REMOVE", "00080032": "REMOVE",
    "00080023": "REMOVE", "00080033": "REMOVE", "00080012": "REMOVE", "00080013": "REMOVE", "00200010": "HASH", "00080018": "HASH", "0020000D": "HASH", "0020000E": "HASH", "00100021": "REMOVE", "00104000": "REMOVE", "00102160": "REMOVE",
    "00081030": "REMOVE", "0008103E": "REMOVE", "00181000": "HASH", "00181030": "REMOVE",
}


def tag_rules(tags: DataFrame, key: bytes = b"demo-salt", rules: dict[str, str] = TAG_RULES, replacements: dict[str, str] | None = None) -> DataFrame:
    """(file, tag, value) after the rules: removed tags are gone, hashed ones are HMACs, those of ``replacements`` constants, all
    others as they were. Tags are eight hexadecimal digits of either case, with or without ``x``, a comma or brackets."""
    put = replacements or {}
    actions = F.broadcast(tags.sparkSession.createDataFrame([(t, "REPLACE" if t in put else a, put.get(t)) for t, a in (rules | dict.fromkeys(put, "REPLACE")).items()], "_tag string, action string, replacement string"))
    plain = F.regexp_replace(F.upper("tag"), "[^0-9A-F]", "")
    out = tags.withColumn("_plain", plain).join(actions, F.col("_plain") == F.col("_tag"), "left").where(F.coalesce("action", F.lit("KEEP")) != "REMOVE")
    return out.select("file", "tag", F.when(F.col("action") == "HASH", hmac_sha256(key, F.col("value"))).when(F.col("action") == "REPLACE", F.col("replacement")).otherwise(F.col("value")).alias("value"))


def box_decisions(boxes: DataFrame, known: DataFrame, pad: int = 4) -> DataFrame:
    """(image, text, x, y, w, h) to padded boxes: a known identifier 1.0, a detector hit .9, digits .6; .8 and above is redacted, other hits go to review."""
    from veilframe.functions.registry import DEFAULTS
    from veilframe.operators.detect import detect

    k = F.broadcast(known.select(F.lower("text").alias("_k")).distinct())
    joined = detect(boxes, DEFAULTS).join(k, F.lower("text") == F.col("_k"), "left")
    c = F.when(F.col("_k").isNotNull(), 1.0).when(F.size("spans") > 0, 0.9).when(F.regexp_like("text", F.lit("[0-9]{4,}")), 0.6).otherwise(0.0)
    return joined.select("image", "text", F.greatest(F.lit(0), F.col("x") - pad).alias("x"), F.greatest(F.lit(0), F.col("y") - pad).alias("y"), (F.col("w") + 2 * pad).alias("w"), (F.col("h") + 2 * pad).alias("h"), c.alias("confidence"), F.when(c >= 0.8, "redact").when(c > 0, "review").otherwise("keep").alias("decision"))
