"""Hidden Markov language model: Baum-Welch counts summed over partitions, exact likelihood by the scaled forward recursion.

A text is its words and one end token. The states emit symbols: the end, each of the ``HEAD`` most frequent training
words, and ``CLASSES`` classes (by the last three bytes) for all other words. A word of a class then has the add-one
probability (c + 1) / (N_class + V_class + 1) within it, the last type being all unseen words; this factor does not depend
on the state, so the forward recursion over symbols and a sum over the class words give the exact probability.

Size: the word counts are a distributed table that grows with the corpus. Broadcast are the model (``HEAD + CLASSES + 1``
by ``STATES``) and the counts of at most ``NEAR`` frequent words; rarer words meet their counts in a shuffle join, where
no key is hot because the frequent ones are gone. Baum-Welch reads every training document, cut into segments of
``SEGMENT`` tokens; an inner segment begins with the last token before it, whose state is drawn from a start distribution of
inner segments and whose emission counts in its own segment alone, so the moves over borders count too. A partition's
expected counts leave it as one row a symbol and are summed by Spark. Scoring never cuts a text.

Defined results: a null or blank text has its end token alone; a null doc_id is hashed as the empty string; repeated rows
are scored one by one; with no training document every token is unseen and both scores use N = V = 0; an empty table gives
no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.labelled import in_fold
from veilframe.llm.tables import table, written
from veilframe.llm.text import words

MOD, HELD = 7, 2
HEAD, CLASSES, NEAR, STATES, SEGMENT, ROUNDS, PRIOR = 16_384, 128, 262_144, 8, 128, 4, 20.0
FREQUENT, AWAY = 512, 0.05


def word_counts(texts: DataFrame) -> DataFrame:
    """(w, c) over the column ``t``; each task sums before it sends, in a table of bounded size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["w", "c"])
            seen.clear()
            return rows

        for b in batches:
            for t in b.column("t").to_pylist():
                seen.update(words(t))
                if len(seen) > 300_000:
                    yield out()
        if seen:
            yield out()

    return texts.select("t").mapInArrow(count, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))


def word_class(w: bytes, classes: int) -> int:
    return zlib.crc32(w[-3:]) % classes


class Vocabulary:
    """Training counts of the frequent words, and the totals of everything."""

    def __init__(self, counts: DataFrame, n_docs: int, head: int = HEAD, near: int = NEAR, classes: int = CLASSES):
        by_count = sorted(((r.c, r.n) for r in counts.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
        self.tokens = sum(c * n for c, n in by_count) + n_docs
        self.types = sum(n for _, n in by_count) + (n_docs > 0)
        held, least = 0, by_count[0][0] + 1 if by_count else 1
        for c, n in by_count:
            if held + n > near:
                break
            held, least = held + n, c
        rows = sorted(((r.c, bytes(r.w)) for r in counts.where(F.col("c") >= least).collect()), key=lambda r: (-r[0], r[1]))
        self.least, self.classes, self.head = least, classes, min(head, len(rows))
        self.index = {w: i for i, (_, w) in enumerate(rows)}
        self.count = np.array([c for c, _ in rows], np.int64)
        cls = F.crc32(F.substring("w", -3, 3)) % classes
        total = np.zeros(classes, np.int64)
        kinds = np.zeros(classes, np.int64)
        for r in counts.groupBy(cls.alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
            total[r.k], kinds[r.k] = r.c, r.n
        own = np.array([word_class(w, classes) for _, w in rows], np.int64)
        np.subtract.at(total, own[: self.head], self.count[: self.head])
        np.subtract.at(kinds, own[: self.head], 1)
        self.class_size = total + kinds + 1
        self.symbol = np.where(np.arange(len(rows)) < self.head, 1 + np.arange(len(rows)), 1 + self.head + own).astype(np.uint16) if len(rows) else np.zeros(0, np.uint16)
        self.base = np.log10((self.count + 1) / self.size)
        self.within = np.where(np.arange(len(rows)) < self.head, 0.0, np.log10((self.count + 1) / self.class_size[own])) if len(rows) else np.zeros(0)
        self.end_base = float(np.log10((n_docs + 1) / self.size))
        self.unigram = np.concatenate([[n_docs], self.count[: self.head], total]).astype(float) + 0.5
        self.unigram /= self.unigram.sum()

    @property
    def size(self) -> int:
        return self.tokens + self.types + 1


def encode(docs: DataFrame, vocabulary, mod: int, held: int) -> DataFrame:
    """One row a document: its symbols as 16-bit ids, its sums over near words, and its other words with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocabulary.value
        get = v.index.get
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for t in b.column("t").to_pylist():
                found = words(t)
                at = np.fromiter((get(w, -1) for w in found), np.int64, len(found))
                near = at[at >= 0]
                symbols = np.zeros(len(found) + 1, np.uint16)
                far: Counter = Counter()
                if len(near) == len(found):
                    symbols[:-1] = v.symbol[at]
                else:
                    symbols[:-1][at >= 0] = v.symbol[near]
                    for i in np.flatnonzero(at < 0):
                        w = found[i]
                        far[w] += 1
                        symbols[i] = 1 + v.head + word_class(w, v.classes)
                for column, value in zip(out, (len(found) + 1, len(near) + 1 if v.tokens else 0, float(v.base[near].sum()) + v.end_base, float(v.within[near].sum()), symbols.tobytes(), list(far.items()))):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.struct([("w", pa.binary()), ("n", pa.int64())]))]
            far_rows = [[{"w": w, "n": n} for w, n in row] for row in out[5]]
            arrays = [pa.array(x, k) for x, k in zip([*out[:5], far_rows], kinds)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), *arrays], ["doc_id", "held_out", "n_tokens", "n_known", "base", "within", "ids", "far"])

    rows = docs.select("doc_id", in_fold("doc_id", mod, held).alias("held_out"), F.col("text").cast("binary").alias("t"))
    out = rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, within double, ids binary, far array<struct<w: binary, n: long>>")
    return written(out.withColumn("row", F.monotonically_increasing_id()), "hmm")


class Model:
    """Start distributions of documents and of inner segments, transitions, emissions (symbols by states)."""

    def __init__(self, start: np.ndarray, inner: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.inner, self.move, self.emit = start, inner, move, emit

    @classmethod
    def initial(cls, unigram: np.ndarray, groups: np.ndarray, states: int) -> Model:
        """Sticky states; state k prefers the symbols of group k. Symbols of no group (-1) are even."""
        lift = np.where(groups[:, None] == np.arange(states), 1.0, np.where(groups[:, None] < 0, 1.0, AWAY))
        emit = unigram[:, None] * lift
        move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
        even = np.full(states, 1.0 / states)
        return cls(even, even, move, emit / emit.sum(0))


def symbol_groups(train: DataFrame, n_symbols: int, states: int) -> np.ndarray:
    """A group for each of the ``FREQUENT`` first symbols, from how often two of them share a segment of any training document.

    Random emissions take Baum-Welch many passes to tell apart. So one pass counts co-occurrence, a table of fixed size;
    the leading eigenvectors of its pointwise mutual information, clustered, give the states something to start from.
    """
    m = min(FREQUENT, n_symbols)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m, m))
        for b in batches:
            held: list[np.ndarray] = []
            raws = b.column("ids").to_pylist()
            for i, raw in enumerate(raws):
                ids = np.frombuffer(raw, np.uint16)
                held += [ids[j : j + SEGMENT] for j in range(0, len(ids), SEGMENT)]
                if len(held) > 4096 or i == len(raws) - 1:
                    x = np.zeros((len(held), m), np.float32)
                    row = np.repeat(np.arange(len(held)), [len(h) for h in held])
                    flat = np.concatenate(held)
                    use = flat < m
                    x[row[use], flat[use]] = 1
                    total += x.T @ x
                    held = []
        kept = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(list(total[kept]), pa.list_(pa.float64()))], ["key", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for key, v in zip(b.column("key").to_pylist(), b.column("v")):
                held[key] = held.get(key, 0) + v.values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.list_(pa.float64()))], ["key", "v"])

    total = np.zeros((m, m))
    for r in train.mapInArrow(pairs, "key long, v array<double>").repartition(16, "key").mapInArrow(add, "key long, v array<double>").collect():
        total[r.key] = r.v
    out = np.full(n_symbols, -1)
    if not total.any():
        return out
    alone = np.maximum(np.diag(total), 1e-9)
    pmi = np.log(np.maximum(total * alone.max() / np.outer(alone, alone), 1e-2))
    pmi -= pmi.mean()
    np.fill_diagonal(pmi, 0)
    value, vector = np.linalg.eigh(pmi)
    top = np.argsort(-np.abs(value))[: min(states, m)]
    points = vector[:, top] * np.sqrt(np.abs(value[top]))
    points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)
    centers = points[:1]
    while len(centers) < min(states, m):
        centers = np.vstack([centers, points[((points[:, None] - centers) ** 2).sum(2).min(1).argmax()]])
    for _ in range(25):
        near = ((points[:, None] - centers) ** 2).sum(2).argmin(1)
        centers = np.vstack([points[near == k].mean(0) if (near == k).any() else centers[k] for k in range(len(centers))])
    out[1:m] = near[1:]
    return out


def laid_out(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows by descending length as a (time, row) array, the rows still running at each time, and the order taken."""
    lengths = np.array([len(r) for r in rows])
    order = np.argsort(-lengths, kind="stable")
    t = int(lengths.max())
    obs = np.zeros((t, len(rows)), np.uint16)
    for j, i in enumerate(order):
        obs[: lengths[i], j] = rows[i]
    running = np.searchsorted(-lengths[order], -np.arange(t), "left")
    return obs, running, order


def log10_forward(rows: list[np.ndarray], m: Model) -> np.ndarray:
    """Exact log10 probability of each whole row by the scaled forward recursion; rows in blocks of like length."""
    out = np.zeros(len(rows))
    by_length = sorted(range(len(rows)), key=lambda i: len(rows[i]))
    for at in range(0, len(by_length), 1024):
        block = by_length[at : at + 1024]
        for lo in range(0, len(block), 1024 if len(rows[block[-1]]) < 4096 else 64):
            part = block[lo : lo + (1024 if len(rows[block[-1]]) < 4096 else 64)]
            obs, running, order = laid_out([rows[i] for i in part])
            log, alpha = np.zeros(len(part)), np.tile(m.start, (len(part), 1))
            for t, n in enumerate(running):
                alpha = (alpha if t == 0 else alpha[:n] @ m.move) * m.emit[obs[t, :n]]
                scale = alpha.sum(1)
                alpha /= scale[:, None]
                log[:n] += np.log10(scale)
            out[np.array(part)[order]] = log
    return out


def expected_counts(rows: list[np.ndarray], first: np.ndarray, m: Model, total: tuple[np.ndarray, ...]) -> None:
    """Adds the expected starts, inner starts, moves and emissions of the segments to ``total``; ``first`` marks document heads.
    The first token of another segment is the last of the one before, and its emission counts there."""
    starts, inners, moves, emits = total
    obs, running, order = laid_out(rows)
    head = first[order]
    t_end, n_all, k = len(running), len(rows), len(m.start)
    alpha, scale = np.zeros((t_end, n_all, k)), np.ones((t_end, n_all))
    for t, n in enumerate(running):
        a = np.where(head[:, None], m.start, m.inner) if t == 0 else alpha[t - 1, :n] @ m.move
        a = a * m.emit[obs[t, :n]]
        scale[t, :n] = a.sum(1)
        alpha[t, :n] = a / scale[t, :n, None]
    beta = np.ones((n_all, k))
    for t in range(t_end - 1, -1, -1):
        n = running[t]
        gamma = alpha[t, :n] * beta[:n]
        if t:
            ahead = m.emit[obs[t, :n]] * beta[:n] / scale[t, :n, None]
            moves += m.move * (alpha[t - 1, :n].T @ ahead)
            beta[:n] = ahead @ m.move.T
        else:
            starts += gamma[head].sum(0)
            inners += gamma[~head].sum(0)
            gamma = np.where(head[:, None], gamma, 0.0)
        alpha[t, :n] = gamma
    moves_seen = obs.ravel()
    for s in range(k):
        emits[:, s] += np.bincount(moves_seen, alpha[:, :, s].ravel(), len(emits))


def baum_welch(encoded: DataFrame, unigram: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Model:
    spark = encoded.sparkSession
    train = encoded.where(~F.col("held_out")).select("ids")
    n_symbols = len(unigram)
    model = Model.initial(unigram, symbol_groups(train, n_symbols, states), states)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def gather(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m: Model = shared.value
            k = len(m.start)
            total = (np.zeros(k), np.zeros(k), np.zeros((k, k)), np.zeros((n_symbols, k)))
            rows: list[np.ndarray] = []
            first: list[bool] = []

            def flush() -> None:
                if rows:
                    expected_counts(rows, np.array(first), m, total)
                    rows.clear()
                    first.clear()

            for b in batches:
                for raw in b.column("ids").to_pylist():
                    ids = np.frombuffer(raw, np.uint16)
                    for i in range(0, len(ids), SEGMENT):
                        rows.append(ids[max(i - 1, 0) : i + SEGMENT])
                        first.append(i == 0)
                        if len(rows) >= 2048:
                            flush()
            flush()
            kept = np.flatnonzero(total[3].any(1))
            keys = np.concatenate([kept, n_symbols + np.arange(k + 2)])
            values = np.concatenate([total[3][kept], total[2], total[0][None], total[1][None]])
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), *(pa.array(np.ascontiguousarray(values[:, s])) for s in range(k))], ["key", *(f"v{s}" for s in range(k))])

        parts = train.mapInArrow(gather, "key long, " + ", ".join(f"v{s} double" for s in range(states)))
        summed = parts.groupBy("key").agg(*(F.sum(f"v{s}").alias(f"v{s}") for s in range(states))).toPandas()
        values = np.zeros((n_symbols + states + 2, states))
        values[summed.key.to_numpy(np.int64)] = summed[[f"v{s}" for s in range(states)]].to_numpy()
        emit = values[:n_symbols] + PRIOR * unigram[:, None]
        move = values[n_symbols : n_symbols + states] + 0.1
        start, inner = values[-2] + 0.1, values[-1] + 0.1
        model = Model(start / start.sum(), inner / inner.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
        shared.unpersist()
    return model


def score(docs: DataFrame, mod: int = MOD, held: int = HELD, states: int = STATES, rounds: int = ROUNDS, head: int = HEAD, near: int = NEAR) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row, learned from the rows outside the held-out fold."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    training = docs.where(~in_fold("doc_id", mod, held))
    counts = written(word_counts(training.select(F.col("text").cast("binary").alias("t"))), "hmm-words")
    v = Vocabulary(counts, training.count(), head, near)
    encoded = encode(docs, spark.sparkContext.broadcast(v), mod, held)
    model = baum_welch(encoded, v.unigram, states, rounds)
    shared = spark.sparkContext.broadcast(model)

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.frombuffer(x, np.uint16) for x in b.column("ids").to_pylist()]
            kept = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(log10_forward(rows, shared.value) if rows else [], pa.float64())], [*b.schema.names[:-1], "hidden"])

    scored = encoded.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "within", "ids").mapInArrow(forward, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, within double, hidden double")
    far = encoded.select("row", F.explode("far").alias("f")).select("row", F.col("f.w").alias("w"), F.col("f.n").alias("n"))
    rare = counts.where(F.col("c") < v.least)
    c = F.coalesce("c", F.lit(0))
    size = F.element_at(F.array(*[F.lit(int(x)) for x in v.class_size]), (F.crc32(F.substring("w", -3, 3)) % v.classes + 1).cast("int"))
    met = far.join(rare, "w", "left").select("row", F.when(c > 0, F.col("n")).otherwise(0).alias("n_known"), (F.col("n") * F.log10((c + 1) / F.lit(float(v.size)))).alias("base"), (F.col("n") * F.log10((c + 1) / size)).alias("within"))
    nothing = lambda kind: F.lit(None).cast(kind)
    both = scored.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", (F.col("within") + F.col("hidden")).alias("within")).unionByName(met.select("row", nothing("long").alias("doc_id"), nothing("boolean").alias("held_out"), nothing("long").alias("n_tokens"), F.col("n_known").cast("long").alias("n_known"), "base", "within"))
    return both.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"), F.sum("base").alias("base_score"), F.sum("within").alias("score")).drop("row")


def op1_hmm_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents", "doc_id", "text"))
