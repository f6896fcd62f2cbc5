"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

A word that shows leetspeak, inner separators or repeated letters, and a run of single characters set apart, becomes a
lattice: each character may stand for itself, for the letters it imitates, or for nothing (a separator, a repetition).
Viterbi decoding over a character trigram model picks the likeliest letters. Any other word has a lattice of one path,
itself, so decoding it would change nothing and is left out. Where symbols at a word's end may be letters or punctuation,
or doubled letters may be meant, the word has several readings, and the strongest counts.

The trigram model is counted over all documents, per partition and summed. Weights of words and of their beginnings come
from at most ``SAMPLE`` labelled rows (see ``labelled``): the log odds of toxic to other documents, where toxic
documents count no more often than there are different words before the word (for a
beginning: different words that begin so), so that copies do not count again, less ``CAUTION`` standard errors. A document's evidence
is its three strongest words and their density; a logistic fit on rows unseen by the weights makes it a probability.

Defined results: null and empty texts have no evidence and get the score of that; without training rows every score is
0.5 and without a toxic one near 0; repeated rows are scored one by one, equal texts equally. Whole texts are read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.labelled import SAMPLE, in_fold, training_texts
from veilframe.llm.tables import beside, nested, table
from veilframe.llm.text import words

MOD, HELD, CUT = 4, 2, 0.3
#: Letters that a character may imitate.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou"}
SEPARATORS = frozenset(".-_*~'`^,")
SYMBOLS, CAUTION = 28, 1.5
SWAP, SKIP, LITERAL, REPEAT = -1.0, -0.5, -6.0, -0.3
#: Symbols at a word's end that may be letters.
ENDING = 16
_SUSPECT = re.compile(r"[^\W\d_][0-9@$!|+(€£*._~`^-]+[^\W\d_]|[0-9@$!|+(€£*][^\W\d_]|[^\W\d_][0-9@$!|+€£]|([^\W\d_])\1\1")
#: Single characters with white space or separators between; a star stands between letters or for one. Letters and separators
#: share no character, so a scan is linear.
_SPACED = re.compile(r"(?<![^\W_])(?:\*\s++)?(?:[^\W_]|[@$!|+(€£])(?:[\s.\-_*~'`^,]++(?:[^\W_]|[@$!|+(€£])(?![^\W_])){2,}(?:\s\*(?!\w))*")
_GAP = re.compile(r"[\s.\-_~'`^,]+")
_INNER = re.compile(r"[\w@$!|+(€£*]")
_PLAIN = re.compile(r"[^\W_]")
_LEET_TAIL = re.compile(r"[@$!|+(€£*.\-_~'`^,]*[@$!|+(€£*]")
_AGAIN = re.compile(r"(.)\1{2,}")
_DOUBLE = re.compile(r"([^\W\d_])\1")
_ALPHA = re.compile(r"[\W\d_]+")


def trimmed(text: str, inner: re.Pattern, head: bool = True) -> str:
    """``text`` from the first to the last character that ``inner`` matches, or from its own start; linear in its length."""
    found = inner.search(text)
    if not found:
        return ""
    end = len(text)
    while not inner.match(text[end - 1]):
        end -= 1
    return text[found.start() if head else 0 : end]


def symbol(c: str) -> int:
    """0: a word's edge; 1 to 26: a to z; 27: any other letter."""
    return ord(c) - 96 if "a" <= c <= "z" else 27


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of letter trigrams over the words of all documents, summed over partitions: a table of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3)
        lookup = np.full(256, 27, np.int64)
        lookup[97:123] = np.arange(1, 27)
        lookup[0] = 0
        seen: Counter = Counter()

        def flush() -> None:
            nonlocal total
            plain = [(w, c) for w, c in ((w.strip(b".,;:!?\"'()"), c) for w, c in seen.items()) if w and (w.isalpha() or not w.isascii())]
            seen.clear()
            if plain:
                raw = lookup[np.frombuffer(b"\0\0" + b"\0\0".join(w for w, _ in plain) + b"\0", np.uint8)]
                word = np.cumsum(np.concatenate([[0], (raw[1:] == 0) & (raw[:-1] != 0)]))[2:]
                code = (raw[:-2] * SYMBOLS + raw[1:-1]) * SYMBOLS + raw[2:]
                weight = np.append([c for _, c in plain], 0.0)[np.minimum(word, len(plain))]
                weight[(raw[2:] == 0) & (raw[1:-1] != 0)] = np.array([c for _, c in plain], float)[: int(((raw[2:] == 0) & (raw[1:-1] != 0)).sum())]
                weight[(raw[2:] == 0) & (raw[1:-1] == 0)] = 0
                total += np.bincount(code, weight, SYMBOLS**3)

        for b in batches:
            for t in b.column("t").to_pylist():
                seen.update(words(t))
                if len(seen) > 200_000:
                    flush()
        flush()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["code", "n"])

    parts = docs.select(F.col("text").cast("binary").alias("t")).mapInArrow(count, "code int, n double")
    out = np.zeros(SYMBOLS**3)
    for r in parts.groupBy("code").agg(F.sum("n").alias("n")).collect():
        out[r.code] = r.n
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def letter_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), smoothed by the bigram model, that by the unigram model."""
    one = counts.sum((0, 1)) + 1.0
    two = counts.sum(0)
    p1 = one / one.sum()
    p2 = (two + 20 * p1) / (two.sum(1, keepdims=True) + 20)
    return np.log((counts + 5 * p2[None]) / (counts.sum(2, keepdims=True) + 5))


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each character what it may stand for, at what cost; the empty string for nothing."""
    out: list[list[tuple[str, float]]] = []
    for i, c in enumerate(token):
        if c.isalpha():
            options = [(c, 0.0)]
            if i and token[i - 1] == c:
                options.append(("", REPEAT))
        else:
            options = [(x, SWAP) for x in LEET.get(c, "")]
            options.append(("", SKIP if c in SEPARATORS or c.isspace() else LITERAL))
        out.append(options)
    return out


def decodings(token: str, model: np.ndarray, least: int) -> list[str]:
    """The likeliest letters behind each beginning of a token of ``least`` characters or more. A path's letters are weighed by their mean surprise over the uniform one, so that dropping letters gains nothing."""
    free = math.log(1 / 12)
    states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}

    def best() -> str:
        _, path = max(((s + model[a, b, 0] - free, p) for (a, b), (s, p) in states.items()), key=lambda x: x[0])
        letters = []
        while path:
            path, c = path
            letters.append(c)
        return "".join(reversed(letters))

    out = [] if least else [""]
    for n, options in enumerate(lattice(token), 1):
        after: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (score, path) in states.items():
            for c, cost in options:
                if c:
                    k = symbol(c)
                    key, s, p = (b, k), score + cost + model[a, b, k] - free, (path, c)
                else:
                    key, s, p = (a, b), score + cost, path
                if key not in after or after[key][0] < s:
                    after[key] = (s, p)
        states = after
        if n >= least:
            out.append(best())
    return out


def decode(token: str, model: np.ndarray) -> str:
    """The likeliest letters behind a token."""
    return decodings(token, model, len(token))[-1]


class Restorer:
    """Words as they were meant; a memo of bounded size spares decoding a token twice."""

    def __init__(self, model: np.ndarray):
        self.model, self.memo = model, {}

    def word(self, token: bytes) -> str:
        return self.readings(token)[0]

    def readings(self, token: bytes) -> tuple[str, ...]:
        """What a token may read, without repeats: its letters or what they stand for; with doubled letters decoded; with each number of the symbols at its end, up to ``ENDING``, read as letters; without symbols around it."""
        if (got := self.memo.get(token)) is not None:
            return got
        text = token.decode("utf-8", "replace").lower()
        core = trimmed(text, _INNER)
        plain = trimmed(core, _PLAIN, head=False)
        if _SUSPECT.search(plain) or (plain != core and _SUSPECT.search(core) and not plain.isalpha()):
            out = [decode(plain, self.model)]
        else:
            out = [_ALPHA.sub("", plain)]
            if _DOUBLE.search(plain):
                out.append(decode(plain, self.model))
        if plain != core and (tail := _LEET_TAIL.match(_AGAIN.sub(r"\1\1", core[len(plain) :])[:ENDING])):
            out += decodings(plain + tail.group(), self.model, len(plain) + 1)
        bare = trimmed(plain, _PLAIN)
        if bare.isalpha():
            out.append(bare)
        found = tuple(dict.fromkeys(out))
        if len(self.memo) > 300_000:
            self.memo.clear()
        self.memo[token] = found
        return found

    def spaced(self, text: bytes) -> list[str]:
        """Letters behind runs of single characters set apart."""
        return [decode(_GAP.sub("", m.group()), self.model) for m in _SPACED.finditer(text.decode("utf-8", "replace").lower())]


def keys(word: str) -> list[str]:
    return [word, *(f"{word[:k]}~" for k in (4, 5, 6) if len(word) > k)]


class Scorer:
    """Evidence and probability of a text; the weights are at most a few per labelled training row."""

    def __init__(self, model: np.ndarray, weights: dict[str, float], logistic: np.ndarray | None):
        self.restorer, self.weights, self.logistic, self.memo = Restorer(model), weights, logistic, {}
        self.longest = max(map(len, weights), default=0)

    def weight(self, token: bytes) -> float:
        out = max((self.weights.get(k, 0.0) for w in self.restorer.readings(token) if len(w) > 2 for k in keys(w)), default=0.0)
        if len(self.memo) > 500_000:
            self.memo.clear()
        self.memo[token] = out
        return out

    def run(self, letters: str) -> list[float]:
        """Weights of the words, and of their beginnings, that start at each letter of a run; one of three letters is all of the run but for a one-letter word before it."""
        out = []
        for i in range(len(letters) - 2):
            least = 3 if len(letters) == i + 3 and letters[:i] in ("", "a", "i") else 4
            found = [letters[i:j] for j in range(i + least, min(len(letters), i + self.longest) + 1)]
            if found:
                x = max(self.weights.get(k, 0.0) for k in (*found, *keys(letters[i : i + 7])))
                if x > 0.0:
                    out.append(x)
        return out

    def evidence(self, text: bytes | None) -> np.ndarray:
        found = words(text)
        memo, weight = self.memo, self.weight
        ws = [x if (x := memo.get(t)) is not None else weight(t) for t in found]
        ws = [x for x in ws if x > 0.0]
        for letters in self.restorer.spaced(text or b""):
            ws += self.run(letters)
        top = [*sorted(ws, reverse=True)[:3], 0.0, 0.0, 0.0]
        return np.array([1.0, top[0], top[1], top[2], math.log1p(1000 * sum(x > 2 for x in ws) / (len(found) + 20))])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), 0.5) if self.logistic is None else 1 / (1 + np.exp(-np.clip(x @ self.logistic, -30, 30)))


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Newton steps of a ridge logistic regression. Evidence can only speak for the label: columns whose weight comes out
    negative are left out, and the rest is fitted again."""
    use = np.arange(x.shape[1])
    while True:
        part, w = x[:, use], np.zeros(len(use))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            h = (part * (p * (1 - p))[:, None]).T @ part + ridge * np.eye(len(w))
            step = np.linalg.solve(h, part.T @ (p - y) + ridge * w)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        if (w[1:] >= 0).all():
            out = np.zeros(x.shape[1])
            out[use] = w
            return out
        use = use[np.concatenate([[True], w[1:] >= 0])]


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", mod: int = MOD, held: int = HELD, sample: int = SAMPLE) -> Scorer:
    model = letter_model(trigram_counts(docs))
    texts = training_texts(docs, labels, column, mod, held, sample).persist()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        for b in batches:
            clean: Counter = Counter()
            docs_with: Counter = Counter()
            toxic: defaultdict = defaultdict(set)
            n = [0, 0]
            for t, y in zip(b.column("t").to_pylist(), b.column("label").to_pylist()):
                n[y > 0] += 1
                restored = [restorer.readings(w) for w in words(t)]
                distinct = {k for r in set(restored) for w in r if len(w) > 2 for k in keys(w)}
                if y > 0:
                    docs_with.update(distinct)
                    for (before, *_), r in zip([("",), *restored], restored):
                        for w in r:
                            if len(w) > 2:
                                for k in keys(w):
                                    toxic[k].add(zlib.crc32((before if k == w else w).encode()))
                else:
                    clean.update(distinct)
            rows = [(k, None, c, 0) for k, c in clean.items()] + [(k, None, 0, c) for k, c in docs_with.items()] + [(k, code, 0, 0) for k, s in toxic.items() for code in s] + [("", None, *n)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["k", "code", "clean", "toxic"])

    try:
        seen = texts.where("fold = 0").select("t", "label").mapInArrow(observe, "k string, code long, clean long, toxic long").persist()
        total = seen.where("k = ''").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).first()
        n0, n1 = total.clean or 0, total.toxic or 0
        if not n0 + n1:
            return Scorer(model, {}, None)
        table_ = seen.where("k <> ''").groupBy("k").agg(F.least(F.countDistinct("code"), F.sum("toxic")).alias("contexts"), F.sum("clean").alias("clean"))
        sure = F.greatest(F.lit(0.0), F.col("contexts") - CAUTION * F.sqrt("contexts"))
        odds = F.log((sure + 0.1) / F.lit(n1 + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(n0 + 1.0))
        strong = table_.where("contexts >= 3").select("k", odds.alias("w")).where("w > 1")
        scorer = Scorer(model, {r.k: r.w for r in strong.collect()}, None)
        held_scorer = docs.sparkSession.sparkContext.broadcast(scorer)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                e = np.array([held_scorer.value.evidence(t) for t in b.column("t").to_pylist()]).reshape(-1, 5)
                yield pa.RecordBatch.from_arrays([*(pa.array(e[:, i]) for i in range(5)), b.column("label")], [*"abcde", "y"])

        rows = texts.where("fold = 1").select("t", "label").mapInArrow(measure, "a double, b double, c double, d double, e double, y int").toPandas()
        scorer.logistic = logistic_fit(rows[[*"abcde"]].to_numpy(), (rows.y > 0).to_numpy().astype(float)) if len(rows) else np.array([-3.0, 1.0, 0, 0, 0])
        return scorer
    finally:
        texts.unpersist()


def score_toxicity(docs: DataFrame, labels: DataFrame, keep: bool = False, column: str = "toxic", mod: int = MOD, held: int = HELD) -> DataFrame:
    """doc_id and score of every row; with ``keep``, the whole row as ``row``, so that no column of it can clash, and score."""
    scorer = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, column, mod, held))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([scorer.value.evidence(t) for t in b.column("t").to_pylist()]).reshape(b.num_rows, 5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scorer.value(x))], [b.schema.names[0], "score"])

    text = F.col("text").cast("binary").alias("t")
    rows = nested(docs, text) if keep else docs.select("doc_id", text)
    return rows.mapInArrow(score, beside(rows.schema, "score", T.DoubleType()))


def op10_toxicity_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return scored.select("doc_id", in_fold("doc_id", MOD, HELD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
