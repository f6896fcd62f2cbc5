"""A bounded sample of labelled training rows, and monotone calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000


def in_fold(doc_id: str, mod: int, rest: int):
    """Whether crc32(doc_id as text) mod ``mod`` is ``rest``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod == rest


def training_labels(labels: DataFrame, column: str, mod: int, held: int, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, label) of at most ``sample`` labelled rows outside the held-out fold: those with the smallest hash of the id.

    Null ids and labels are left out; of several labels of one id the largest holds. The sample is the documented bound on
    what a classifier is fitted on, which makes it safe to broadcast.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    kept = rows.where(~in_fold("doc_id", mod, held)).groupBy("doc_id").agg(F.max("label").alias("label"))
    return kept.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def training_texts(docs: DataFrame, labels: DataFrame, column: str, mod: int, held: int, sample: int = SAMPLE) -> DataFrame:
    """doc_id, t (UTF-8 text), label, fold (0 to fit, 1 to calibrate) of the sampled rows."""
    picked = training_labels(labels, column, mod, held, sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("t"))
    return rows.join(F.broadcast(picked), "doc_id").withColumn("fold", (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3)) == 0).cast("int"))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y on x by pooling adjacent violators; equal x are pooled first."""
    if not len(x):
        return np.array([0.0]), np.array([0.5])
    order = np.argsort(x, kind="stable")
    xs, start = np.unique(x[order], return_index=True)
    weight = np.diff(np.append(start, len(x))).astype(float)
    mean = np.add.reduceat(y[order].astype(float), start) / weight
    blocks: list[list[float]] = []
    for a, m, w in zip(xs, mean, weight):
        blocks.append([m, w, a * w])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, w2, a2 = blocks.pop()
            m1, w1, a1 = blocks.pop()
            blocks.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, a1 + a2])
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] for b in blocks])


def calibrated(raw: np.ndarray, knots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Linear between the knots, with a trace of the raw score so that order survives where the fit is flat."""
    return 0.999 * np.interp(raw, *knots) + 0.001 / (1 + np.exp(-np.clip(raw, -30, 30)))
