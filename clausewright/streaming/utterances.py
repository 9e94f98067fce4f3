"""Utterances from audio frames: accumulation, partial decodes, provisional and final transcripts. One step serves the stream and its batch twin.

While someone speaks, what was said so far is decoded from time to time, one decode at a time. When the segment ends, the last partial result that was done by then
is given out at once as provisional, and the decode of the whole utterance as final. A partial decode that is still running at the
end is stale and its result is dropped. How long a decode takes comes from the recogniser, so results follow from the frames' times alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from clausewright import settings as S
from clausewright.functions.speech import Recogniser, no_model
from clausewright.streaming.vad import VadConfig, VadState, in_order, tenths

COLUMNS = ["start", "stop", "snr_db", "text", "decode_ms", "audio_ms", "rms", "is_provisional"]
TYPES = "start double, stop double, snr_db double, text string, decode_ms double, audio_ms double, rms double, is_provisional boolean"


@dataclass(frozen=True)
class SessionConfig:
    vad: VadConfig = VadConfig()
    rate: float = S.SAMPLE_RATE
    partial_ms: float = S.PARTIAL_MS
    least_ms: float = S.LEAST_SPEECH_MS
    prompt: str = ""


@dataclass
class Utterance:
    """State of one stream: the voice detector's, the frames since speech began, and the partial decodes."""

    config: SessionConfig
    model: Recogniser
    vad: VadState = field(init=False)
    start: float | None = None
    frames: list[np.ndarray] = field(default_factory=list)
    samples: int = 0
    asked: float = 0.0  # when the last partial decode began
    busy_until: float = -1.0
    pending: tuple[str, float, float] | None = None  # of the decode that began last: text, decode_ms, audio_ms
    partial: tuple[str, float, float] | None = None  # the last one done in time

    def __post_init__(self) -> None:
        self.vad = VadState(self.config.vad)

    def _audio_ms(self) -> float:
        return self.samples / self.config.rate * 1000

    def _settle(self, at: float) -> None:
        """Takes the result of a partial decode that is done by now."""
        if self.pending is not None and self.busy_until <= at:
            self.partial, self.pending = self.pending, None

    def _decode(self) -> tuple[str, float, np.ndarray]:
        whole = np.concatenate(self.frames)
        text, ms = self.model.transcribe(whole, self.config.prompt)
        return text.strip(), ms, whole

    def until(self, at: float) -> list[tuple]:
        """The rows of an utterance whose stream is silent for too long by this time."""
        event = self.vad.until(at)
        if not event or self.start is None:
            return []
        self._settle(event[1])
        return self._finish(event[1], event[3])

    def frame(self, samples: np.ndarray, rms: float, at: float) -> list[tuple]:
        """What a frame brings, and the silence before it."""
        out = self.until(at) + self.step(samples, rms, at)
        self.vad.seen = at
        return out

    def step(self, samples: np.ndarray, rms: float, at: float) -> list[tuple]:
        """The rows (as COLUMNS) that a frame brings."""
        out: list[tuple] = []
        self._settle(at)
        event = self.vad.step(rms, at)
        if event and event[0] == "speechStart":
            self.start, self.frames, self.samples, self.asked, self.pending, self.partial = at, [], 0, 0.0, None, None
        elif event and self.start is not None:
            out = self._finish(at, event[3])
        if self.start is not None:
            self.frames.append(samples)
            self.samples += len(samples)
            if at >= self.busy_until and at - self.asked >= self.config.partial_ms and self._audio_ms() >= self.config.least_ms:
                text, ms, _ = self._decode()
                self.asked, self.busy_until, self.pending = at, at + ms, (text, ms, self._audio_ms())
                self._settle(at)
        return out

    def _finish(self, at: float, snr: float) -> list[tuple]:
        start, out = self.start, []
        if self.samples:
            text, ms, whole = self._decode()
            rms = float(np.sqrt(np.mean(whole.astype(np.float64) ** 2)))
            if self.partial and self.partial[0]:
                out.append((start, at, snr, self.partial[0], tenths(self.partial[1]), tenths(self.partial[2]), rms, True))
            out.append((start, at, snr, text, tenths(ms), tenths(self._audio_ms()), rms, False))
        self.start, self.frames, self.samples, self.pending, self.partial = None, [], 0, None, None
        return out


def utterances(frames: DataFrame, make: Callable[[], Recogniser] = no_model, config: SessionConfig = SessionConfig()) -> DataFrame:
    """(stream_id, start, stop, snr_db, text, decode_ms, audio_ms, rms, is_provisional) from (stream_id, at, rms, samples), at in ms.

    Streams are sorted inside their partition and read as a flow; a task holds the frames of one open utterance.
    """
    kind = dict(frames.dtypes)["stream_id"]
    flow = frames.select("stream_id", F.col("at").cast("double").alias("at"), F.col("rms").cast("double").alias("rms"), F.col("samples").cast("array<float>").alias("samples"))
    flow = flow.repartition("stream_id").sortWithinPartitions("stream_id", "at", "rms")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, model = None, None, make()
        for batch in batches:
            rows = []
            for stream, at, rms, samples in batch.itertuples(index=False):
                if state is None or stream != now:
                    rows += [(now, *got) for got in (state.until(math.inf) if state else [])]
                    now, state = stream, Utterance(config, model)
                rows += [(stream, *got) for got in state.frame(np.asarray(samples, np.float32), rms, at)]
            yield pd.DataFrame(rows, columns=["stream_id", *COLUMNS])
        if state and (rows := state.until(math.inf)):
            yield pd.DataFrame([(now, *got) for got in rows], columns=["stream_id", *COLUMNS])

    return flow.mapInPandas(run, f"stream_id {kind}, {TYPES}")


class UtteranceStore:
    """An utterance as state of a key. ttl_ms: a stream silent for so long is forgotten."""

    def __init__(self, handle: StatefulProcessorHandle, ttl_ms: int | None = None) -> None:
        result = lambda n: f"{n}_text string, {n}_ms double, {n}_audio double"
        self.state = handle.getValueState("utterance", f"floor double, vad_start double, last double, energy double, voiced long, start double, samples long, asked double, busy double, {result('pending')}, {result('partial')}", ttl_ms)
        self.frames = handle.getListState("frames", "samples array<float>", ttl_ms)

    def load(self, u: Utterance) -> Utterance:
        if self.state.exists():
            s = self.state.get()
            u.vad.floor, u.vad.start, u.vad.last, u.vad.energy, u.vad.frames = s[0], s[1], *s[2:5]
            u.start, u.samples, u.asked, u.busy_until = s[5:9]
            u.pending, u.partial = (None if s[i] is None else tuple(s[i : i + 3]) for i in (9, 12))
            u.frames = [np.asarray(x[0], np.float32) for x in self.frames.get()] if u.start is not None else []
        return u

    def save(self, u: Utterance) -> None:
        none = (None, None, None)
        self.state.update((u.vad.floor, u.vad.start, u.vad.last, u.vad.energy, u.vad.frames, u.start, u.samples, u.asked, u.busy_until, *(u.pending or none), *(u.partial or none)))
        self.frames.clear()
        if u.start is not None and u.frames:
            self.frames.put([(x.tolist(),) for x in u.frames])


class UtteranceProcessor(StatefulProcessor):
    """The same step over a stream. ttl_ms: a stream silent for so long is forgotten."""

    def __init__(self, make: Callable[[], Recogniser] = no_model, config: SessionConfig = SessionConfig(), ttl_ms: int | None = None) -> None:
        self.make, self.config, self.ttl_ms = make, config, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.model = self.make()
        self.store = UtteranceStore(handle, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        u = self.store.load(Utterance(self.config, self.model))
        out = [(key[0], *got) for at, rms, samples in in_order(rows)[["at", "rms", "samples"]].itertuples(index=False) for got in u.step(np.asarray(samples, np.float32), rms, at)]
        self.store.save(u)
        yield pd.DataFrame(out, columns=["stream_id", *COLUMNS])

    def close(self) -> None:
        pass


def stream_utterances(frames: DataFrame, make: Callable[[], Recogniser] = no_model, config: SessionConfig = SessionConfig(), ttl_ms: int | None = None) -> DataFrame:
    """Streaming form of utterances. The frames of a stream must come in order from one micro-batch to the next; within one they are sorted."""
    kind = dict(frames.dtypes)["stream_id"]
    return frames.groupBy("stream_id").transformWithStateInPandas(UtteranceProcessor(make, config, ttl_ms), f"stream_id {kind}, {TYPES}", "Append", "ProcessingTime" if ttl_ms else "None")
