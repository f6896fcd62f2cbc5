"""Redaction and drift over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veilframe.functions.registry import DEFAULTS
from veilframe.operators.apply import redact
from veilframe.operators.detect import detect
from veilframe.operators.resolve import resolve

LIMIT, OVERLAP = 200, 32


def cut(buffer: str, limit: int = LIMIT, overlap: int = OVERLAP, force: bool = False) -> tuple[str, str]:
    """What may be emitted of a buffer and what stays: up to the last sentence end before the held-back tail, or, from twice
    ``limit`` on, the last space before it; all of it if forced."""
    if force:
        return buffer, ""
    safe = len(buffer) - overlap
    best = max((buffer.rfind(m, 0, max(safe, 0)) + 2 for m in (". ", "! ", "? ", ".\n", "!\n", "?\n") if buffer.rfind(m, 0, max(safe, 0)) >= 0), default=0)
    if not best and len(buffer) >= 2 * limit:
        best = buffer.rfind(" ", 0, safe) + 1 or safe
    return buffer[:best], buffer[best:]


def segments(chunks: DataFrame, timeout_ms: int = 60_000) -> DataFrame:
    """(stream_id, seq, text, final) to whole segments (stream_id, position, text), with the rest of each stream as state.

    A chunk with ``final`` flushes its stream; so do ``timeout_ms`` without a chunk, whose text is emitted, not lost. With 0 there
    is no timeout: a query with one runs empty batches for ever and so never ends by itself.
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        buffer, position = state.get if state.exists else ("", 0)
        rows = []
        done = state.hasTimedOut
        if not done:
            pdf = pd.concat(list(batches)).sort_values("seq")
            buffer += "".join(pdf["text"].fillna(""))
            done = bool(pdf["final"].any())
        while True:
            out, buffer = cut(buffer, force=done)
            if not out:
                break
            rows.append((key[0], position, out))
            position += len(out)
        if done:
            state.remove()
        else:
            state.update((buffer, position))
            if timeout_ms:
                state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(rows, columns=["stream_id", "position", "text"])

    return chunks.groupBy("stream_id").applyInPandasWithState(run, "stream_id long, position long, text string", "buffer string, position long", "append", GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout)


def redact_stream(chunks: DataFrame, detectors=DEFAULTS, timeout_ms: int = 60_000) -> DataFrame:
    """Redacted segments of a stream of chunks: the batch expressions over ``segments``."""
    found = detect(segments(chunks, timeout_ms), detectors)
    return redact(resolve(found)).select("stream_id", "position", "redacted", "n_redactions")


def drift_stream(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by window and type, emitted when the watermark has passed."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
