"""Media columns: text bytes as 8-bit WAV, read back with the wave module, and spectral landmarks.

The landmarks are pairs of peaks of a short-time Fourier transform: (time, f1, f2, dt) packed to a long
and stored as an array in order of time, so that two columns can be aligned by equal hashes.
"""

from __future__ import annotations

import io
import wave

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm.common import table, with_python

UNIT = 576  # bytes: a payload is a positive multiple, and a transform frame is as long
RATE = 8000


def payload(data: bytes) -> bytes:
    """data with bytes 255 up to a positive multiple of UNIT."""
    return data + b"\xff" * (-len(data) % UNIT or (0 if data else UNIT))


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as r:
        return r.readframes(r.getnframes())


def landmarks(samples: bytes, frame: int = UNIT, fan: int = 3) -> np.ndarray:
    """Pairs of spectral peaks as longs, time << 32 | f1 << 20 | f2 << 8 | dt, in order of time.

    A frame's peak is the strongest bin above the first under a Hann window; frames step by half their length,
    and each peak is paired with the next `fan` ones. Ties go to the lower bin. All frames count.
    """
    x = np.frombuffer(samples, dtype=np.uint8).astype(np.float32) - 128.0
    step, window = frame // 2, np.hanning(frame).astype(np.float32)
    views = np.lib.stride_tricks.sliding_window_view(x, frame)[::step]
    peaks = np.concatenate([np.abs(np.fft.rfft(views[i : i + 256] * window, axis=1)[:, 1:]).argmax(axis=1) + 1 for i in range(0, len(views), 256)]).astype(np.int64)
    t = np.arange(len(peaks), dtype=np.int64)
    pairs = [(t[:-d] << 32) | (peaks[:-d] << 20) | (peaks[d:] << 8) | d for d in range(1, fan + 1) if len(t) > d]
    return np.sort(np.concatenate(pairs)) if pairs else (peaks << 20)


def media_columns(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (the WAV file), payload (as read back), landmarks (array of long).

    A null text counts as empty; its payload is UNIT bytes 255. Every row is worked on by itself: repeated rows, ties and null ids
    give a row each, an empty table none. Arrow batches are cut by a row count that keeps very long texts within memory.
    """

    def run(texts: list[str]) -> dict:
        data = [t.encode() for t in texts]
        stored = [to_wav(payload(d)) for d in data]
        back = [from_wav(w) for w in stored]
        return {"n_bytes": [len(d) for d in data], "media": stored, "payload": back, "landmarks": [landmarks(b) for b in back]}

    ready = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("t"))
    return with_python(ready, "t", run, "n_bytes long, media binary, payload binary, landmarks array<long>")


def op10_media(spark, sf_dir):
    out = media_columns(table(spark, sf_dir, "documents"))
    tail = F.crc32(F.expr("substring(payload, octet_length(payload) - 31, 32)"))
    return out.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), tail.alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.md5(F.array_join(F.col("landmarks").cast("array<string>"), ",")).alias("feature"), "landmarks",
    )
