"""Overlap resolution: one disjoint set of spans for each text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.match import bound
from veilframe.functions.registry import SPECIFICITY, UNKNOWN_SPECIFICITY

#: NAME spans with one of these words score nothing for their length.
FIELD_WORDS = ("DATE", "BIRTH", "RECORD", "NUMBER", "PHONE", "ADDRESS", "EMAIL", "MEMBER", "ACCOUNT", "STATUS", "DOB", "MRN", "SSN", "ID")


def specificity(type_: Column) -> Column:
    table = F.expr(f"map({', '.join(f"'{k}', {v}" for k, v in SPECIFICITY.items())})")
    return F.coalesce(F.try_element_at(table, type_), F.lit(UNKNOWN_SPECIFICITY))


def score(s: Column) -> Column:
    """min(length / 50, 1) * 40 + confidence * 30 + specificity / 100 * 20 + min(priority / 100, 1) * 10."""
    length = F.least((s["end"] - s["start"]) / F.lit(50.0), F.lit(1.0)) * 40
    field = (s["type"] == "NAME") & F.arrays_overlap(F.split(F.upper(s["text"]), "[^A-Z]+"), F.array(*map(F.lit, FIELD_WORDS)))
    return F.when(field, 0.0).otherwise(length) + s["confidence"] * 30 + specificity(s["type"]) / F.lit(100.0) * 20 + F.least(s["priority"] / F.lit(100.0), F.lit(1.0)) * 10


def deduplicated(spans: Column) -> Column:
    """Of spans equal in place and type the one of highest confidence, at a tie the first in order; by place. Sorted, equals are neighbours."""
    keyed = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"), (-s["confidence"]).alias("c"), i.alias("i"), s.alias("s")))

    def firsts(all_: Column) -> Column:
        differs = lambda x, y: y.isNull() | (x["start"] != y["start"]) | (x["end"] != y["end"]) | (x["type"] != y["type"])
        return F.transform(F.filter(all_, lambda x, i: differs(x, F.get(all_, i - 1))), lambda x: x["s"])

    return F.when(F.size(spans) < 2, spans).otherwise(bound(F.array_sort(keyed), firsts))


def clusters(spans: Column) -> Column:
    """Spans by place, cut wherever one begins at or behind the end of all before it: no two clusters overlap."""
    none = F.filter(spans, lambda _: F.lit(False))
    begin = F.struct(F.filter(F.array(none), lambda _: F.lit(False)).alias("done"), none.alias("now"), F.lit(-1).cast("bigint").alias("upto"))

    def step(acc: Column, s: Column) -> Column:
        apart = (s["start"] >= acc["upto"]) & (F.size(acc["now"]) > 0)
        return F.struct(F.when(apart, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"), F.when(apart, F.array(s)).otherwise(F.concat(acc["now"], F.array(s))).alias("now"), F.greatest(acc["upto"], s["end"]).alias("upto"))

    return F.aggregate(spans, begin, step, lambda acc: F.concat(acc["done"], F.array(acc["now"])))


def ranked(spans: Column) -> Column:
    """Spans by score descending, start, length descending, then the rest of the span, with ``spec``."""
    keyed = F.transform(spans, lambda s: F.struct((-F.round(score(s), 6)).alias("k"), s["start"].alias("start"), (s["start"] - s["end"]).alias("neg"), s["type"].alias("type"), s["pattern"].alias("pattern"), s.alias("s"), specificity(s["type"]).alias("spec")))
    return F.array_sort(keyed)


def resolve(df: DataFrame, column: str = "spans") -> DataFrame:
    """The greedy choice over ``ranked`` spans. A candidate that overlaps kept spans must win against each of them: by
    containing it and being more specific, or by being inside it, more specific, and of confidence 0.9 at least. The losers
    go, so the result is disjoint; it is ordered by place. Touching spans do not overlap. Spans that meet through others are chosen
    among themselves, so the work follows the largest such cluster, not the square of all spans."""
    a = lambda x: x["s"]

    def overlaps(x: Column, y: Column) -> Column:
        return (a(x)["start"] < a(y)["end"]) & (a(y)["start"] < a(x)["end"])

    def contains(x: Column, y: Column) -> Column:
        return (a(x)["start"] <= a(y)["start"]) & (a(x)["end"] >= a(y)["end"])

    def wins(x: Column, y: Column) -> Column:
        return (x["spec"] > y["spec"]) & (contains(x, y) | (contains(y, x) & (a(x)["confidence"] >= 0.9)))

    def step(kept: Column, x: Column) -> Column:
        return F.when(F.exists(kept, lambda y: overlaps(x, y) & ~wins(x, y)), kept).otherwise(F.concat(F.filter(kept, lambda y: ~overlaps(x, y)), F.array(x)))

    def chosen(cluster: Column) -> Column:
        folded = bound(ranked(cluster), lambda r: F.aggregate(r, F.filter(r, lambda x: F.lit(False)), step))
        return F.when(F.size(cluster) < 2, cluster).otherwise(F.transform(folded, lambda x: x["s"]))

    spans = F.col(column)
    return df.withColumn(column, F.when(F.size(spans) < 2, spans).otherwise(F.array_sort(F.flatten(F.transform(bound(deduplicated(spans), clusters), chosen)))))


def twin(spans: list[dict]) -> list[dict]:
    """The same choice in plain Python, for tests; spans carry score and spec."""
    kept: list[dict] = []
    for x in sorted(spans, key=lambda s: (-round(s["score"], 6), s["start"], s["start"] - s["end"], s["type"], s["pattern"])):
        over = [y for y in kept if x["start"] < y["end"] and y["start"] < x["end"]]

        def wins(y: dict, x: dict = x) -> bool:
            x_has = x["start"] <= y["start"] and x["end"] >= y["end"]
            y_has = y["start"] <= x["start"] and y["end"] >= x["end"]
            return x["spec"] > y["spec"] and (x_has or (y_has and x["confidence"] >= 0.9))

        if all(wins(y) for y in over):
            kept = [y for y in kept if y not in over] + [x]
    return sorted(kept, key=lambda s: s["start"])
