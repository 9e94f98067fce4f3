"""Speech segments from frame energies: one state step, used by the stream and by its batch twin."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from clausewright import settings as S


def frame_rms(samples: Column) -> Column:
    return F.sqrt(F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / F.size(samples))


def tenths(x: float) -> float:
    return math.floor(x * 10 + 0.5) / 10


@dataclass(frozen=True)
class VadConfig:
    hangover_ms: float = S.HANGOVER_MS
    most_ms: float = S.MOST_SPEECH_MS
    floor: float = 0.004
    least_rms: float = 0.001
    silence_ms: float | None = None  # a segment ends this long after a stream's last frame, where no later one comes sooner


@dataclass
class VadState:
    """Adapts the noise floor on quiet frames; a segment ends on a quiet frame after the hangover or beyond the longest length."""

    config: VadConfig = field(default_factory=VadConfig)
    floor: float = -1.0
    start: float | None = None
    last: float = 0.0
    energy: float = 0.0
    frames: int = 0
    seen: float | None = None  # the last frame

    def _end(self, at: float, rms: float) -> tuple[str, float, float, float]:
        floor = self.config.floor if self.floor < 0 else self.floor
        mean = self.energy / self.frames if self.frames else rms
        out = "speechEnd", at, tenths(at - self.start), tenths(max(0.0, 20 * math.log10(mean / max(1e-5, floor))))
        self.start, self.energy, self.frames = None, 0.0, 0
        return out

    def deadline(self) -> float | None:
        """When the open segment ends if no frame comes before."""
        return None if self.config.silence_ms is None or self.start is None or self.seen is None else self.seen + self.config.silence_ms

    def until(self, at: float) -> tuple[str, float, float, float] | None:
        """The end of a segment whose stream is silent for too long by this time."""
        end = self.deadline()
        return self._end(end, 0.0) if end is not None and at >= end else None

    def events(self, rms: float, at: float) -> list[tuple[str, float, float, float]]:
        """What a frame brings, and the silence before it."""
        out = [e for e in (self.until(at), self.step(rms, at)) if e]
        self.seen = at
        return out

    def step(self, rms: float, at: float) -> tuple[str, float, float, float] | None:
        """(type, at, duration, snr_db) of a start or an end that this frame brings."""
        c = self.config
        floor = c.floor if self.floor < 0 else self.floor
        if (rms / max(1e-5, floor) - 1.5) / 6.0 >= 0.5:
            self.last, self.energy, self.frames = at, self.energy + rms, self.frames + 1
            if self.start is None:
                self.start = at
                return "speechStart", at, 0.0, 0.0
            return None
        self.floor = floor = 0.98 * floor + 0.02 * max(c.least_rms, rms)
        if self.start is None or (at - self.last < c.hangover_ms and at - self.start < c.most_ms):
            return None
        return self._end(at, rms)


def segments(frames: DataFrame, config: VadConfig = VadConfig()) -> DataFrame:
    """(stream_id, type, at, duration_ms, snr_db) from (stream_id, at, rms), at in ms.

    Streams are sorted inside their partition and read as a flow, so a long one needs no more memory than a short one.
    """
    kind = dict(frames.dtypes)["stream_id"]
    flow = frames.select("stream_id", F.col("at").cast("double").alias("at"), F.col("rms").cast("double").alias("rms")).repartition("stream_id").sortWithinPartitions("stream_id", "at", "rms")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, VadState(config)
        for batch in batches:
            rows = []
            for stream, at, rms in batch.itertuples(index=False):
                if stream != now:
                    rows += [(now, *e) for e in [state.until(math.inf)] if e]
                    now, state = stream, VadState(config)
                rows += [(stream, *got) for got in state.events(rms, at)]
            yield pd.DataFrame(rows, columns=["stream_id", "type", "at", "duration_ms", "snr_db"])
        if last := state.until(math.inf):
            yield pd.DataFrame([(now, *last)], columns=["stream_id", "type", "at", "duration_ms", "snr_db"])

    return flow.mapInPandas(run, f"stream_id {kind}, type string, at double, duration_ms double, snr_db double")


def in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's rows of one micro-batch, which may come in several pieces, by time."""
    return pd.concat(list(rows), ignore_index=True).sort_values(["at", "rms"], kind="stable")


class VadProcessor(StatefulProcessor):
    """The same step over a stream, for groupBy("stream_id").transformWithStateInPandas. ttl_ms: a stream silent for so long is forgotten."""

    def __init__(self, config: VadConfig = VadConfig(), ttl_ms: int | None = None) -> None:
        self.config, self.ttl_ms = config, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("vad", "floor double, start double, last double, energy double, frames long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        vad = VadState(self.config)
        if self.state.exists():
            floor, start, last, energy, frames = self.state.get()
            vad.floor, vad.start, vad.last, vad.energy, vad.frames = floor, None if start < 0 else start, last, energy, frames
        out = [(key[0], *got) for at, rms in in_order(rows)[["at", "rms"]].itertuples(index=False) if (got := vad.step(rms, at))]
        self.state.update((vad.floor, -1.0 if vad.start is None else vad.start, vad.last, vad.energy, vad.frames))
        yield pd.DataFrame(out, columns=["stream_id", "type", "at", "duration_ms", "snr_db"])

    def close(self) -> None:
        pass


def stream_segments(frames: DataFrame, config: VadConfig = VadConfig(), ttl_ms: int | None = None) -> DataFrame:
    """Streaming form of segments. The frames of a stream must come in order from one micro-batch to the next; within one they are sorted."""
    kind = dict(frames.dtypes)["stream_id"]
    return frames.groupBy("stream_id").transformWithStateInPandas(VadProcessor(config, ttl_ms), f"stream_id {kind}, type string, at double, duration_ms double, snr_db double", "Append", "ProcessingTime" if ttl_ms else "None")
