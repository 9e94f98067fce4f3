"""Readers and writers: documents, labelled queries, WAV files; index folders are in sources/index.py."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from clausewright import settings as S
from clausewright.functions import text as T
from clausewright.sources.index import CorruptIndex, DimensionMismatch, InvalidIndex, ModelMismatch, UnsupportedVersion, read_index, write_index  # noqa: F401
from clausewright.sources.tables import BATCH_BYTES, small_batches

ASSERTIONS = "id string, assertion string, goldChunkIds array<string>, acceptableChunkIds array<string>, expectedStance string, adversarial boolean, note string"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, title, text): one row a text or Markdown file."""
    name = F.input_file_name()
    return spark.read.text(path, wholetext=True).select(T.slug(F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"\.[^.]*$", "")).alias("doc_id"), T.title(name).alias("title"), F.col("value").alias("text"))


def read_assertions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ASSERTIONS).json(path)


TYPES = {(1, 8): ("u1", 128.0, 128.0), (1, 16): ("<i2", 0.0, 32768.0), (1, 32): ("<i4", 0.0, 2147483648.0), (3, 32): ("<f4", 0.0, 1.0)}


def wav_parts(data: bytes) -> tuple[int, int, tuple[str, float, float], memoryview]:
    """(sample rate, channels, how numbers are stored, the whole blocks of samples) of a WAV file; nothing is copied."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, body = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", data, at + 8)
        elif name == b"data":
            body = memoryview(data)[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if form is None or body is None:
        raise ValueError("a WAV file needs format and data")
    kind, channels, rate, _, _, bits = form
    if (kind, bits) not in TYPES:
        raise ValueError(f"unsupported WAV format {kind} of {bits} bits")
    block = channels * bits // 8
    return rate, channels, TYPES[kind, bits], body[: len(body) // block * block]


def _mono(body: memoryview, channels: int, how: tuple[str, float, float]) -> np.ndarray:
    dtype, zero, scale = how
    x = (np.frombuffer(body, dtype).astype(np.float64) - zero) / scale
    return (x if channels == 1 else x.reshape(-1, channels).mean(axis=1)).astype(np.float32)


def decode_wav(data: bytes) -> tuple[int, np.ndarray]:
    """(sample rate, mono samples in -1 to 1) of PCM of 8, 16 or 32 bits or 32-bit float."""
    rate, channels, how, body = wav_parts(data)
    return rate, _mono(body, channels, how)


def wav_frames(data: bytes, rate: int = S.SAMPLE_RATE, size: int = 512, window: int = 65_536) -> Iterator[np.ndarray]:
    """The mono samples at the rate asked for in frames of `size`, the last one shorter: what resample(decode_wav()) gives, with `window` samples of the source decoded at a time.

    The resampler carries its last sample and place from one window to the next.
    """
    source, channels, how, body = wav_parts(data)
    block = channels * np.dtype(how[0]).itemsize
    total, step = len(body) // block, source / rate
    whole = total if source == rate else int(total / step)
    held, base, done = np.zeros(0, np.float32), 0, 0  # samples not used up, the place of the first, and how many were made
    out = np.zeros(0, np.float32)
    for at in range(0, total, window):
        new = _mono(body[at * block : (at + window) * block], channels, how)
        if source == rate:
            made = new
        else:
            held = np.concatenate([held, new])
            end = at + len(new)
            n = whole if end == total else min(whole, int((end - 1) / step) + 1)
            where = np.arange(done, n) * step
            where = where[where <= end - 1] if end < total else where
            made = np.interp(where, np.arange(base, base + len(held)), held).astype(np.float32)
            done += len(made)
            keep = max(base, min(end - 1, int(done * step)))  # the sample before the next place is needed again
            held, base = held[keep - base :], keep
        out = np.concatenate([out, made])
        for i in range(0, len(out) // size * size, size):
            yield out[i : i + size]
        out = out[len(out) // size * size :]
    if len(out):
        yield out


@F.udtf(returnType="frame int, at double, rms double, samples array<float>")
class WavFrames:
    """A table function: the frames of a WAV file (content, rate, size), with their start in ms and their energy. Null content has none. A task holds the file's bytes and one window of it."""

    def eval(self, content, rate, size):
        if content is None:
            return
        for i, x in enumerate(wav_frames(bytes(content), rate, size)):
            yield i, i * size / rate * 1000, float(np.sqrt(np.mean(x.astype(np.float64) ** 2))), x.tolist()


def frames_of(files: DataFrame, key: str = "path", content: str = "content", rate: int = S.SAMPLE_RATE, size: int = 512) -> DataFrame:
    """(stream_id, frame, at, rms, samples) of each WAV file, a row a frame, as the segment and utterance operators take them."""
    named = files.select(F.col(key).alias("stream_id"), F.col(content).alias("content"))
    return named.lateralJoin(WavFrames(F.col("content").outer(), F.lit(rate), F.lit(size))).drop("content")


def resample(x: np.ndarray, source: int, target: int) -> np.ndarray:
    """Linear interpolation."""
    if source == target or not len(x):
        return x
    step = source / target
    n = int(len(x) / step)  # whole samples only
    return np.interp(np.arange(n) * step, np.arange(len(x)), x).astype(np.float32)


def decode_wavs(files: DataFrame, rate: int = 16_000) -> DataFrame:
    """(path, sample_rate, samples array<float>) of each WAV file (path, content), mono at the rate asked for. Files are handed over and back in batches of some 16 MB, or one larger file."""
    out = StructType([files.schema["path"], *StructType.fromDDL("sample_rate int, samples array<float>").fields])

    def made(paths: list, samples: list[np.ndarray]) -> pa.RecordBatch:
        ends = pa.array(np.cumsum([0, *map(len, samples)]), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(paths, to_arrow_type(out["path"].dataType)), pa.array([rate] * len(paths), pa.int32()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(samples), pa.float32()))], names=out.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, samples, held = [], [], 0
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                source, x = decode_wav(memoryview(data.as_buffer()))
                x = resample(x, source, rate)
                if paths and held + x.nbytes > BATCH_BYTES:
                    yield made(paths, samples)
                    paths, samples, held = [], [], 0
                paths.append(path)
                samples.append(x)
                held += x.nbytes
            if paths:
                yield made(paths, samples)

    return small_batches(files.select("path", "content")).mapInArrow(run, out)


def read_wav(spark: SparkSession, path: str, rate: int = 16_000) -> DataFrame:
    """(path, sample_rate, samples array<float>) of each file."""
    return decode_wavs(spark.read.format("binaryFile").load(path), rate)
