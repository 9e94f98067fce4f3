"""Segments and utterances in event time: frames that come late or out of order are put in order, and silent streams end what is open.

Frames wait in a list state until the watermark has passed them, and are then taken in the order of their times by the same step as in the batch form. An event-time timer wakes a
stream that has no new frames: for frames that waited, and for the end of a segment whose stream has been silent for VadConfig.silence_ms. So results depend on the frames alone and not on
how they are cut into micro-batches, as long as none comes later than the watermark allows; such a one is dropped. A task holds what a key's frames between the watermark and the newest take.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ListState, StatefulProcessor, StatefulProcessorHandle, ValueState

from clausewright.functions.speech import Recogniser, no_model
from clausewright.streaming import utterances as U
from clausewright.streaming.vad import VadConfig, VadState

EVENTS = ["type", "at", "duration_ms", "snr_db"]


class InOrder(StatefulProcessor):
    """Buffer, clock and timers; what is done with a frame is the subclass's. Frames have at (ms) and what else `frame` names."""

    frame = "at double, rms double"
    columns: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = [f.split()[0] for f in self.frame.split(", ")]
        self.waiting: ListState = handle.getListState("waiting", self.frame)
        self.clock: ValueState = handle.getValueState("clock", "done double, timer long")

    def load(self) -> Any:
        raise NotImplementedError

    def save(self, state: Any) -> None:
        raise NotImplementedError

    def take(self, state: Any, row: tuple) -> list[tuple]:
        raise NotImplementedError

    def deadline(self, state: Any) -> float | None:
        raise NotImplementedError

    def until(self, state: Any, at: float) -> list[tuple]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        done = self.clock.get()[0] if self.clock.exists() else -math.inf
        for part in rows:
            new = part[part["at"] > done]  # what is older has been passed by
            if len(new):
                self.waiting.appendList([tuple(x.tolist() if isinstance(x, np.ndarray) else x for x in r) for r in new[self.names].itertuples(index=False, name=None)])
        yield self._advance(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._advance(key, timerValues.getCurrentWatermarkInMs())

    def _advance(self, key: tuple, now: int) -> pd.DataFrame:
        done, timer = self.clock.get() if self.clock.exists() else (-math.inf, -1)
        held = [(float(r[0]), float(r[1]), *r[2:]) for r in self.waiting.get()]  # plain numbers, as the state stores no others
        ready = sorted((r for r in held if r[0] <= now), key=lambda r: (r[0], r[1]))
        rest = [r for r in held if r[0] > now]
        out: list[tuple] = []
        state = self.load()
        for r in ready:
            out += self.take(state, r)
        out += self.until(state, now)
        if ready:
            self.waiting.clear()
            if rest:
                self.waiting.put([(*r[:2], *(list(map(float, x)) for x in r[2:])) for r in rest])
        self.save(state)
        ends = [x for x in (min((r[0] for r in rest), default=None), self.deadline(state)) if x is not None]
        wake = math.ceil(min(ends)) if ends else -1
        if wake >= 0 and not now < timer <= wake:  # an earlier timer that is still to come sets the next one itself
            self.handle.registerTimer(max(wake, now + 1))
            timer = max(wake, now + 1)
        self.clock.update((max([done, *(r[0] for r in ready)]), timer))
        return pd.DataFrame([(key[0], *x) for x in out], columns=["stream_id", *self.columns])

    def close(self) -> None:
        pass


class OrderedVad(InOrder):
    columns = EVENTS

    def __init__(self, config: VadConfig) -> None:
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("vad", "floor double, start double, last double, energy double, frames long, seen double")

    def load(self) -> VadState:
        vad = VadState(self.config)
        if self.state.exists():
            vad.floor, vad.start, vad.last, vad.energy, vad.frames, vad.seen = self.state.get()
        return vad

    def save(self, vad: VadState) -> None:
        self.state.update((vad.floor, vad.start, vad.last, vad.energy, vad.frames, vad.seen))

    def take(self, vad: VadState, row: tuple) -> list[tuple]:
        return vad.events(row[1], row[0])

    def deadline(self, vad: VadState) -> float | None:
        return vad.deadline()

    def until(self, vad: VadState, at: float) -> list[tuple]:
        return [e for e in [vad.until(at)] if e]


class OrderedUtterances(InOrder):
    columns = U.COLUMNS
    frame = "at double, rms double, samples array<float>"

    def __init__(self, make: Callable[[], Recogniser], config: U.SessionConfig) -> None:
        self.make, self.config = make, config

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.store = U.UtteranceStore(handle)
        self.seen = handle.getValueState("seen", "seen double")
        self.model = self.make()

    def load(self) -> U.Utterance:
        u = self.store.load(U.Utterance(self.config, self.model))
        if self.seen.exists():
            u.vad.seen = self.seen.get()[0]
        return u

    def save(self, u: U.Utterance) -> None:
        self.store.save(u)
        if u.vad.seen is not None:
            self.seen.update((u.vad.seen,))

    def take(self, u: U.Utterance, row: tuple) -> list[tuple]:
        return u.frame(np.asarray(row[2], np.float32), row[1], row[0])

    def deadline(self, u: U.Utterance) -> float | None:
        return u.vad.deadline()

    def until(self, u: U.Utterance, at: float) -> list[tuple]:
        return u.until(at)


def _timed(frames: DataFrame, late: str) -> DataFrame:
    return frames.withColumn("at", F.unix_micros("ts") / 1000).withWatermark("ts", late)


def ordered_segments(frames: DataFrame, late: str, config: VadConfig = VadConfig()) -> DataFrame:
    """vad.segments() over a stream of frames (stream_id, ts timestamp, rms) in any order; `late` is how long the watermark waits, such as "2 seconds". Times are ms since 1970."""
    kind = dict(frames.dtypes)["stream_id"]
    rows = _timed(frames, late).select("stream_id", "ts", "at", F.col("rms").cast("double").alias("rms"))
    return rows.groupBy("stream_id").transformWithStateInPandas(OrderedVad(config), f"stream_id {kind}, type string, at double, duration_ms double, snr_db double", "Append", "EventTime")


def ordered_utterances(frames: DataFrame, late: str, make: Callable[[], Recogniser] = no_model, config: U.SessionConfig = U.SessionConfig()) -> DataFrame:
    """utterances.utterances() over a stream of frames (stream_id, ts timestamp, rms, samples) in any order, as ordered_segments()."""
    kind = dict(frames.dtypes)["stream_id"]
    rows = _timed(frames, late).select("stream_id", "ts", "at", F.col("rms").cast("double").alias("rms"), F.col("samples").cast("array<float>").alias("samples"))
    return rows.groupBy("stream_id").transformWithStateInPandas(OrderedUtterances(make, config), f"stream_id {kind}, {U.TYPES}", "Append", "EventTime")
