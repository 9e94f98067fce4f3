"""A ring buffer of samples a stream: writes, reads of the latest samples, and clears. One step serves the stream and its batch twin."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


class Ring:
    """The latest `capacity` samples, in chunks; whole chunks that nothing reads any more go."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.chunks, self.held = capacity, [], 0

    def write(self, samples: np.ndarray) -> None:
        x = np.asarray(samples, np.float32)[-self.capacity :]
        if not len(x):
            return
        self.chunks.append(x)
        self.held += len(x)
        while self.held - len(self.chunks[0]) >= self.capacity:
            self.held -= len(self.chunks.pop(0))
        if self.held > self.capacity:
            self.chunks[0] = self.chunks[0][self.held - self.capacity :]
            self.held = self.capacity

    def latest(self, n: int) -> np.ndarray:
        """The newest n samples, or all that there are, oldest first."""
        n = max(0, min(n, self.held))
        some, left = [], n
        for x in reversed(self.chunks):
            if left <= 0:
                break
            some.append(x[-left:])
            left -= len(some[-1])
        return np.concatenate(some[::-1]) if some else np.zeros(0, np.float32)

    def clear(self) -> None:
        self.chunks, self.held = [], 0

    def step(self, op: str, samples: np.ndarray | None, n: int | None) -> np.ndarray | None:
        """What an operation gives: samples for `read`, nothing for `write` and `clear`; others are an error."""
        if op == "write":
            self.write(np.zeros(0) if samples is None else samples)
        elif op == "clear":
            self.clear()
        elif op == "read":
            return self.latest(int(n or 0))
        else:
            raise ValueError(f"no operation {op!r}")
        return None


#: Of operations: their order within a stream is (at, seq).
OPS = ["stream_id", "at", "seq", "op", "samples", "n"]


def _ops(rows: DataFrame) -> DataFrame:
    return rows.select("stream_id", F.col("at").cast("double").alias("at"), F.col("seq").cast("long").alias("seq"), "op", F.col("samples").cast("array<float>").alias("samples"), F.col("n").cast("int").alias("n"))


def _fields(rows: DataFrame) -> str:
    return f"stream_id {dict(rows.dtypes)['stream_id']}, at double, seq long, samples array<float>"


def _reads(ring: Ring, rows: pd.DataFrame) -> Iterator[tuple]:
    for stream, at, seq, op, samples, n in rows[OPS].itertuples(index=False):
        if (got := ring.step(op, samples, None if pd.isna(n) else n)) is not None:
            yield stream, at, seq, got.tolist()


def ring_reads(ops: DataFrame, capacity: int) -> DataFrame:
    """(stream_id, at, seq, samples) of the reads among operations (stream_id, at, seq, op, samples, n): `write` samples, `read` the latest n, `clear`.

    Streams flow through their partition in order; a task holds one ring.
    """
    flow = _ops(ops).repartition("stream_id").sortWithinPartitions("stream_id", "at", "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, ring = None, None
        for batch in batches:
            out: list[tuple] = []
            for stream, part in batch.groupby("stream_id", sort=False, dropna=False):
                if ring is None or stream != now:
                    now, ring = stream, Ring(capacity)
                out += _reads(ring, part)
            yield pd.DataFrame(out, columns=["stream_id", "at", "seq", "samples"])

    return flow.mapInPandas(run, _fields(ops))


class RingProcessor(StatefulProcessor):
    """The ring as list state: chunks that never come to more than the capacity."""

    def __init__(self, capacity: int, ttl_ms: int | None = None) -> None:
        self.capacity, self.ttl_ms = capacity, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.chunks = handle.getListState("chunks", "samples array<float>", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ring = Ring(self.capacity)
        for x in self.chunks.get():
            ring.write(np.asarray(x[0], np.float32))
        ordered = pd.concat(list(rows), ignore_index=True).sort_values(["at", "seq"], kind="stable")
        out = list(_reads(ring, ordered))
        self.chunks.clear()
        if ring.chunks:
            self.chunks.put([(x.tolist(),) for x in ring.chunks])
        yield pd.DataFrame(out, columns=["stream_id", "at", "seq", "samples"])

    def close(self) -> None:
        pass


def stream_ring_reads(ops: DataFrame, capacity: int, ttl_ms: int | None = None) -> DataFrame:
    """Streaming form of ring_reads. Operations of a stream must come in order from one micro-batch to the next; within one they are sorted."""
    return _ops(ops).groupBy("stream_id").transformWithStateInPandas(RingProcessor(capacity, ttl_ms), _fields(ops), "Append", "ProcessingTime" if ttl_ms else "None")
