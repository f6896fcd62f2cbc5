"""Byte-level BPE token ids of whole texts, and token counts by section.

The vocabulary is a ``tokenizers`` JSON file whose ids rise with merge rank, so the same ids come out of a rank-based
encoder built from that file, at about six times the speed; tests hold both against each other. A special token's string
in a text is that token, as ``Tokenizer.encode`` has it by default. Runs of white space of any length are encoded: the
pattern's look-ahead overflows the encoder's stack on long ones, so these are cut out where the pattern would cut them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.tables import table


#: Runs of white space (as Rust's patterns have it) from this length on are cut out; the encoder's stack holds 600,000.
RUN = 100_000
_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % RUN)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable bytes stand for themselves, the others for the code points from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids and byte lengths of a byte-level BPE vocabulary file."""

    def __init__(self, path: str, pattern: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.special = special
        self.inner = tiktoken.Encoding("bpe", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.width = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
        for token, i in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
            self.width[i] = len(token)

    def __call__(self, text: str) -> np.ndarray:
        if len(text) > RUN and _RUN.search(text):
            return self._long_runs(text)
        if any(s in text for s in self.special):
            return np.asarray(self.inner.encode(text, allowed_special="all"), np.uint32)
        return np.asarray(self.inner.encode_ordinary(text), np.uint32)


    def _long_runs(self, text: str) -> np.ndarray:
        """Ids of a text with a long run of white space. A special token ends a text for the pattern; a run is one piece, but its last character goes with what follows it."""
        special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        out: list[int] = []
        for part in special.split(text) if special else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            at = 0
            for m in _RUN.finditer(part):
                end = m.end() if m.end() == len(part) else m.end() - 1
                out += self.inner.encode_ordinary(part[at : m.start()])
                out += self.inner._encode_single_piece(part[m.start() : end])
                at = end
            out += self.inner.encode_ordinary(part[at:])
        return np.asarray(out, np.uint32)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def section_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Tokens of each section (line) of each text, by encoding whole texts once and joining token spans to section spans.

    A section is a line with the line feed that ends it; an empty text has one empty section. Tokens are spans of bytes;
    one that crosses section boundaries is allocated whole to the section that holds most of its bytes, the earlier one at
    a tie. So the sections' tokens add up to the text's. Returns doc_id, section (from 0), start, end (code points),
    n_tokens, n_crossing (tokens here that another section also holds bytes of). Null texts count as empty; every row
    of ``docs`` gives its own sections, repeated rows included.
    """
    path = path or default_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        names = ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"]
        for b in batches:
            held: list[tuple[np.ndarray, ...]] = []
            rows = 0
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                held.append((doc, *sections(text or "", encode)))
                rows += len(held[-1][1])
                if rows > 50_000:
                    yield _batch(held, names)
                    held, rows = [], 0
            if held:
                yield _batch(held, names)

    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return raw.mapInArrow(count, "doc_id long, section long, start long, end long, n_tokens long, n_crossing long")


def _batch(held: list, names: list[str]) -> pa.RecordBatch:
    n = [len(h[1]) for h in held]
    ids = pa.array([h[0] for h in held], pa.int64()).take(pa.array(np.repeat(np.arange(len(held)), n)))
    rest = [pa.array(np.concatenate([h[i] for h in held])) for i in range(1, 5)]
    return pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate([np.arange(k, dtype=np.int64) for k in n])), *rest], names)


def sections(text: str, encode: Encoder) -> tuple[np.ndarray, ...]:
    """start, end (code points), tokens and crossing tokens of each line."""
    raw = np.frombuffer(text.encode(), np.uint8)
    cuts = np.flatnonzero(raw == 10) + 1
    bounds = np.concatenate([[0], cuts if len(cuts) and cuts[-1] < len(raw) else cuts[:-1] if len(cuts) else cuts, [len(raw)]]).astype(np.int64)
    ends = np.cumsum(encode.width[encode(text)])
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]]) if len(ends) else ends
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends, "left") - 1
    owner = first.copy()
    crossing = np.flatnonzero(last > first)
    for k in crossing:  # few: tokens that hold a line feed and what follows it
        part = np.minimum(bounds[first[k] + 1 : last[k] + 2], ends[k]) - np.maximum(bounds[first[k] : last[k] + 1], starts[k])
        owner[k] = first[k] + int(np.argmax(part))
    m = len(bounds) - 1
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)]).astype(np.int64)[bounds]
    return points[:-1], points[1:], np.bincount(owner, minlength=m).astype(np.int64), np.bincount(owner[crossing], minlength=m).astype(np.int64)


def op4_section_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_counts(table(spark, sf_dir, "documents", "doc_id", "text"))
