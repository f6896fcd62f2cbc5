"""Mixing sources to target weights.

Every document gets a hash-random key; a range sort by (source, key) lines up each source; prefix sums of the sizes are
made per partition and offset by the sums of the partitions before; each source is cut at its exact budget, after as many
whole epochs as fit. No source is ever gathered in one task: a hot source spans as many ranges as it needs, and only one
row per (range, source) is summed globally.

Defined results: a null text has size 0; a null source is a source of its own, last; a null doc_id is mixed like any
other; repeated rows are mixed one by one, in the order of (key, doc_id, size), which makes equal rows interchangeable.
An empty table gives an empty mix; a source without words takes none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.tables import partitions, table, written
from veilframe.llm.text import words

WEIGHTS, SHARE, MOST, SEED = (3, 1, 2), 1.5, 2.0, 17


def sizes(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, source, size (words of the text) and a hash-random key of every row; with ``carry`` also the row itself as ``_row`` and a hash of its text as ``_tie``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array([len(words(t)) for t in b.column("t").to_pylist()], pa.int64())
            names = ["doc_id", "source", *carried]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), n], [*names, "size"])

    carried = ["_row", "_tie"] if carry else []
    row = [F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.xxhash64(docs["text"]).alias("_tie")] if carry else []
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), *row, F.col("text").cast("binary").alias("t"))
    schema = T.StructType([f for f in raw.schema if f.name != "t"] + [T.StructField("size", T.LongType())])
    return raw.mapInArrow(count, schema).withColumn("key", F.xxhash64(F.lit(SEED), "doc_id", "size"))


def targets(per_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target. Sources by code point, null last, weigh ``weights``, repeating.

    Water-filling in closed form: sources reach their cap in the order of cap/weight, so with prefix sums over that order
    the level is the first at which no further source is above its cap. One row a source, never one a document.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = per_source.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(most))
    up = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(share)
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    leveled = ranked.select("source", "source_size", "w", "cap", (left / weight).alias("level"), F.row_number().over(up).alias("k"))
    fits = leveled.withColumn("fits", F.col("level") * F.col("w") <= F.col("cap"))
    level = F.min_by(F.when(F.col("fits"), F.col("level")), F.when(F.col("fits"), F.col("k"))).over(everything)
    return fits.select("source", "source_size", F.when(level.isNull(), F.col("cap")).otherwise(F.least("cap", level * F.col("w"))).alias("target"))


def lined_up(sized: DataFrame, n: int) -> DataFrame:
    """The rows in (source, key) order with ``upto``, the words of their source up to and with them."""

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, held, source = TaskContext.get().partitionId(), 0, object()
        for b in batches:
            names, size = b.column("source").to_pylist(), b.column("size").to_numpy()
            upto = np.empty(b.num_rows, np.int64)
            i = 0
            while i < b.num_rows:
                j = i + 1
                while j < b.num_rows and names[j] == names[i]:
                    j += 1
                held = held if names[i] == source else 0
                upto[i:j] = held + np.cumsum(size[i:j])
                held, source, i = int(upto[j - 1]), names[i], j
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, pid, np.int32)), pa.array(upto)], [*b.schema.names, "pid", "within"])

    carried = [c for c in ("_row", "_tie") if c in sized.columns]
    cols = ["doc_id", "source", "size", "key", *carried]
    order = ["source", "key", "doc_id", "size", *carried[1:]]
    ranged = sized.select(*cols).repartitionByRange(n, *order).sortWithinPartitions(*order)
    schema = T.StructType([*ranged.schema, T.StructField("pid", T.IntegerType()), T.StructField("within", T.LongType())])
    rows = written(ranged.mapInArrow(running, schema), "mix")
    sums = rows.groupBy("pid", "source").agg(F.max("within").alias("here"))
    earlier = Window.partitionBy("source").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("pid").alias("_pid"), F.col("source").alias("_source"), F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("_offset"))
    joined = rows.join(offsets, (F.col("pid") == F.col("_pid")) & F.col("source").eqNullSafe(F.col("_source")))
    return joined.select(*cols, (F.col("within") + F.col("_offset")).alias("upto"))


def mix_to_weights(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, carry: bool = False) -> DataFrame:
    """doc_id, source, size, key, source_size, target, epochs (whole passes over the source), upto, taken (words, repeats counted); with ``carry`` also ``_row``."""
    n = partitions(docs.sparkSession)
    rows = lined_up(sizes(docs, carry), n)
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    budget = F.floor("target")
    goal = goal.select(F.col("source").alias("_source"), "source_size", "target", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long").alias("epochs")).withColumn("rest", F.when(F.col("source_size") > 0, budget - F.col("epochs") * F.col("source_size")).otherwise(0).cast("long"))
    joined = rows.join(goal, F.col("source").eqNullSafe(F.col("_source")))
    cut = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - (F.col("upto") - F.col("size"))))
    return joined.select("doc_id", "source", "size", "key", "source_size", "target", "epochs", "rest", "upto", (F.col("epochs") * F.col("size") + cut).alias("taken"), *(["_row"] if carry else []))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_to_weights(table(spark, sf_dir, "documents", "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "source", "epochs")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them: whole, in each whole epoch, and once more while the rest of
    the budget lasts. A document that the budget cuts is taken whole, so a source exceeds its target by less than one
    document. A document without words stays once for each whole epoch, at least once. Each row goes by its own place in
    the mix, so rows that share an id, or have none, are told apart.
    """
    again = (F.col("upto") - F.col("size") < F.col("rest")) & (F.col("size") > 0)
    times = F.greatest((F.col("size") == 0).cast("long"), F.col("epochs") + again.cast("long"))
    plan = mix_to_weights(docs, carry=True).select("_row", times.alias("_times")).where("_times > 0")
    return plan.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))).alias("_copy")).select("_row.*")
