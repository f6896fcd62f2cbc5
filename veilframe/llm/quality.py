"""Quality classifier: random Fourier features over document statistics, ridge regression, isotonic calibration.

The statistics are of the whole text. The features ``cos(W z + b)`` approximate a Gaussian kernel over the standardised
statistics; each partition sums its part of the normal equations, the driver adds the parts up and solves them; a third
of the training rows, unseen by the ridge fit, sets the isotonic calibration.

Fitted on at most ``SAMPLE`` labelled rows (see ``labelled``); every row is scored. Defined results: null and empty texts
have the statistics of an empty text and get a score; without any training row all scores are 0.5; repeated rows are
scored one by one, equal texts equally.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.labelled import SAMPLE, calibrated, in_fold, isotonic, training_texts
from veilframe.llm.tables import beside, nested, table

MOD, HELD, CUT = 5, 0, 0.3
FEATURES, RIDGE, SEED, PARTS = 384, 1.0, 11, 8
_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
_MARKS = [ord(c) for c in ".,;:!?|$%&*#@=<>{}[]()/\\_-\"'"]


def statistics(text: bytes | None) -> np.ndarray:
    text = text or b""
    n = max(len(text), 1)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    found = text.split()
    m = max(len(found), 1)
    seen = Counter(found)
    lines = [x for x in text.split(b"\n") if x.strip()]
    share = count[count > 0] / n
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = Counter(w[-1] for w in found)
    letters = max(count[_UPPER].sum() + count[_LOWER].sum() + count[128:].sum(), 1)
    return np.array([
        np.log1p(len(text)), np.log1p(len(found)), np.log1p(len(lines)),
        lengths.mean() if len(found) else 0.0, lengths.std() if len(found) else 0.0, np.log1p(lengths.max() if len(found) else 0),
        count[_UPPER].sum() / letters, count[_DIGIT].sum() / n, count[128:].sum() / n, count[10] / n, count[32] / n,
        *(count[_MARKS] / m),
        len(seen) / m, max(seen.values(), default=0) / m, sum(c for c in seen.values() if c > 2) / m,
        sum(a == b for a, b in zip(found, found[1:])) / m,
        len(set(lines)) / max(len(lines), 1), m / max(len(lines), 1) / 50,
        sum(ends[c] for c in b".,;:!?") / m, sum(ends[c] for c in b"|$%&*#@") / m,
        len(zlib.compress(text, 1)) / n, float(-(share * np.log2(share)).sum()),
        sum(w[:1].isupper() for w in seen) / max(len(seen), 1), sum(w.isupper() for w in seen) / max(len(seen), 1),
    ])


class Model:
    """Statistics to a calibrated score; plain arrays of bounded size."""

    def __init__(self, mean, scale, W, b, weights, knots):
        self.mean, self.scale, self.W, self.b, self.weights, self.knots = mean, scale, W, b, weights, knots

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.column_stack([np.cos(z @ self.W + self.b) * np.sqrt(2 / self.W.shape[1]), np.ones(len(x))])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return calibrated(self.features(x) @ self.weights, self.knots)


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", mod: int = MOD, held: int = HELD, sample: int = SAMPLE) -> Model:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = [statistics(t) for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("fold"), pa.array([s.tobytes() for s in stats], pa.binary())], ["label", "fold", "x"])

    rows = training_texts(docs, labels, column, mod, held, sample).select("t", "label", "fold").mapInArrow(measure, "label int, fold int, x binary").repartition(PARTS).persist()
    try:
        width = len(statistics(b""))

        def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((3, width))
            for b in batches:
                x = np.array([np.frombuffer(v) for v in b.column("x").to_pylist()]).reshape(-1, width)
                total += [np.full(width, len(x)), x.sum(0), (x * x).sum(0)]
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

        total = sum((np.frombuffer(r.v).reshape(3, width) for r in rows.mapInArrow(moments, "v binary").collect()), np.zeros((3, width)))
        n = total[0, 0]
        if not n:
            return Model(np.zeros(width), np.ones(width), None, None, None, None)
        mean = total[1] / n
        scale = np.sqrt(np.maximum(total[2] / n - mean**2, 0)) + 1e-6
        rng = np.random.default_rng(SEED)
        model = Model(mean, scale, rng.normal(0, np.sqrt(1.0 / width), (width, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES), None, None)
        d = FEATURES + 1

        def normal_equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = np.zeros((d, d + 1))
            for b in batches:
                use = b.column("fold").to_numpy() == 0
                x = np.array([np.frombuffer(v) for v in b.column("x").to_pylist()]).reshape(-1, width)[use]
                phi = model.features(x)
                part += phi.T @ np.column_stack([phi, b.column("label").to_numpy()[use]])
            yield pa.RecordBatch.from_arrays([pa.array([part.tobytes()], pa.binary())], ["v"])

        part = sum(np.frombuffer(r.v).reshape(d, d + 1) for r in rows.mapInArrow(normal_equations, "v binary").collect())
        model.weights = np.linalg.solve(part[:, :d] + RIDGE * np.eye(d), part[:, d])

        def held_aside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                use = np.flatnonzero(b.column("fold").to_numpy() == 1)
                x = np.array([np.frombuffer(v) for v in b.column("x").to_pylist()]).reshape(-1, width)[use]
                yield pa.RecordBatch.from_arrays([pa.array(model.features(x) @ model.weights), b.column("label").take(pa.array(use))], ["raw", "label"])

        pairs = rows.mapInArrow(held_aside, "raw double, label int").toPandas()
        model.knots = isotonic(pairs.raw.to_numpy(), pairs.label.to_numpy()) if len(pairs) else (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        return model
    finally:
        rows.unpersist()


def score_quality(docs: DataFrame, labels: DataFrame, keep: bool = False, column: str = "quality", mod: int = MOD, held: int = HELD) -> DataFrame:
    """doc_id and score of every row; with ``keep``, the whole row as ``row``, so that no column of it can clash, and score."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, column, mod, held))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in b.column("t").to_pylist()]).reshape(b.num_rows, -1)
            s = pa.array(model.value(x) if b.num_rows else [], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), s], [b.schema.names[0], "score"])

    text = F.col("text").cast("binary").alias("t")
    rows = nested(docs, text) if keep else docs.select("doc_id", text)
    return rows.mapInArrow(score, beside(rows.schema, "score", T.DoubleType()))


def op9_quality_rff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))
    return scored.select("doc_id", in_fold("doc_id", MOD, HELD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
