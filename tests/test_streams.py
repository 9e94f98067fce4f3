"""Event-time streams and ring buffers as state: shuffled micro-batches give what the batch form gives."""

import collections
import datetime as dt
import random
import struct
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewright.functions import vectors as V
from clausewright.operators import clauses as C
from clausewright.operators import documents as D
from clausewright.plans import retrieval as R
from clausewright.sources import files
from clausewright.sources.tables import cut
from clausewright.streaming import answers as A
from clausewright.streaming import event_time, ring, vad
from clausewright.streaming import utterances as U

BASE = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def counter():
    class Counter:  # within a function, so that it is sent to workers by value
        def transcribe(self, samples, prompt):
            return f"{len(samples)} samples", 90.0

    return Counter


def talk(silent_at_the_end=True):
    """(stream_id, ts, rms, samples): loud and quiet stretches; one stream falls silent while someone speaks, one has a gap in speech."""
    rng, rows = np.random.default_rng(7), []
    for stream in (1, 2, 3):
        loud = np.repeat(rng.random(10) < 0.6, 20)
        for i, on in enumerate(loud.tolist()):
            if stream == 2 and 60 <= i < 95:
                continue
            rms = round(float(rng.uniform(0.1, 0.4)), 3) if on or i > 190 else 0.001
            rows.append((stream, BASE + dt.timedelta(milliseconds=32 * i + stream), rms, [rms] * 8))
    return rows


SCHEMA = "stream_id long, ts timestamp, rms double, samples array<float>"
CONFIG = vad.VadConfig(silence_ms=700.0)


def stream(spark, parts, schema, make, path, name):
    """All rows of a streaming query whose micro-batches are the parts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    (path / "in").mkdir()
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path / "in"))
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(path / "in"))
        query = make(source).writeStream.format("parquet").outputMode("append").option("path", str(path / "out")).option("checkpointLocation", str(path / "check")).queryName(f"{name}{k}").trigger(availableNow=True).start()
        query.awaitTermination(200)
        assert query.exception() is None
    return sorted((tuple(r) for r in spark.read.parquet(str(path / "out")).collect()), key=repr)


def shuffled(rows):
    """Micro-batches in which no frame comes over two seconds late, and two that move the watermark on."""
    rng = random.Random(3)
    late = sorted(rows, key=lambda r: r[1] + dt.timedelta(milliseconds=rng.uniform(0, 1900)))
    parts = [late[i : i + 130] for i in range(0, len(late), 130)]
    for part in parts:
        rng.shuffle(part)
    end = BASE + dt.timedelta(hours=1)
    return [*parts, [(99, end, 0.001, [0.0])], [(99, end + dt.timedelta(hours=1), 0.001, [0.0])], [(99, end + dt.timedelta(hours=2), 0.001, [0.0])]]


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("at", F.unix_micros("ts") / 1000)


def test_segments_of_shuffled_frames(spark, tmp_path):
    rows = talk()
    want = sorted((tuple(r) for r in vad.segments(batch(spark, rows), CONFIG).collect()), key=repr)
    silent = [r for r in want if r[1] == "speechEnd" and r[2] not in {x["at"] for x in batch(spark, rows).select("at").distinct().collect()}]
    assert len(silent) >= 2 and len(want) > 6  # ends that no frame brings
    got = stream(spark, shuffled(rows), SCHEMA, lambda s: event_time.ordered_segments(s, "2 seconds", CONFIG), tmp_path, "ordered_segments")
    assert got == want


def test_utterances_of_shuffled_frames(spark, tmp_path):
    rows, config = talk(), U.SessionConfig(vad=CONFIG, rate=250.0, partial_ms=200, least_ms=100)
    want = sorted((tuple(r) for r in U.utterances(batch(spark, rows), counter(), config).collect()), key=repr)
    assert len([r for r in want if not r[-1]]) >= 4 and any(r[-1] for r in want)
    got = stream(spark, shuffled(rows), SCHEMA, lambda s: event_time.ordered_utterances(s, "2 seconds", counter(), config), tmp_path, "ordered_utterances")
    assert got == want


def test_frames_beyond_the_watermark_are_dropped(spark, tmp_path):
    rows = [r for r in talk() if r[0] == 1]
    hour = BASE + dt.timedelta(hours=1)
    parts = [rows, [(1, hour, 0.001, [0.0])], [(1, BASE + dt.timedelta(milliseconds=5), 0.4, [0.4])], [(1, hour + dt.timedelta(hours=1), 0.001, [0.0])], [(1, hour + dt.timedelta(hours=2), 0.001, [0.0])]]
    got = stream(spark, parts, SCHEMA, lambda s: event_time.ordered_segments(s, "2 seconds", CONFIG), tmp_path, "late_segments")
    assert got == sorted((tuple(r) for r in vad.segments(batch(spark, rows + parts[1]), CONFIG).collect()), key=repr)


OPS = "stream_id long, at double, seq long, op string, samples array<float>, n int"


def operations(capacity, seed):
    rng, rows, want, rings = random.Random(seed), [], [], {}
    for i in range(400):
        s = rng.randint(1, 3)
        held = rings.setdefault(s, collections.deque(maxlen=capacity))
        op = rng.choice(["write"] * 5 + ["read"] * 4 + ["clear"])
        samples = [float(rng.randint(-9, 9)) for _ in range(rng.choice([0, 1, 3, 5, capacity, 3 * capacity]))] if op == "write" else None
        n = rng.choice([None, 0, 1, 2, capacity - 1, capacity, 5 * capacity]) if op == "read" else None
        rows.append((s, float(i // 3), i, op, samples, n))
        if op == "write":
            held.extend(samples)
        elif op == "clear":
            held.clear()
        else:
            want.append((s, float(i // 3), i, list(held)[max(0, len(held) - (n or 0)) :]))
    return rows, sorted(want, key=repr)


@pytest.mark.parametrize("capacity", [1, 4, 17])
def test_ring_equals_a_deque(spark, capacity):
    rows, want = operations(capacity, capacity)
    got = ring.ring_reads(spark.createDataFrame(rows, OPS).repartition(4), capacity).collect()
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_ring_as_state(spark, tmp_path):
    rows, want = operations(6, 2)
    parts = [rows[i : i + 100][::-1] for i in range(0, len(rows), 100)]
    assert stream(spark, parts, OPS, lambda s: ring.stream_ring_reads(s, 6), tmp_path, "ring") == want


def test_ring_keeps_its_capacity():
    r = ring.Ring(16_000)
    for _ in range(3):
        r.write(np.full(8_000, 0.5, np.float32))
    assert r.latest(4_000).tolist() == [0.5] * 4_000 and len(r.latest(10**6)) == r.held == 16_000
    r.clear()
    assert not len(r.latest(5))
    with pytest.raises(ValueError, match="no operation"):
        r.step("open", None, None)


def clause_table(spark):
    text = "\n".join(f'{i}.{j} The carrier shall deliver parcel kind {i}{j} within {j} days, and unless "Storage {i}" applies it must give notice of samples.' for i in range(1, 5) for j in range(1, 6))
    return cut(C.chunks(C.units(D.parse(spark.createDataFrame([("order", text)], "doc_id string, text string")))), "chunks")


def embedder():
    return V.embed_with(lambda: V.HashedWords(32))


def utterance_rows():
    words = ["the carrier violates delivery of parcel kind 12", "notice of storage 2 is required", "a", "samples exceed the days of parcel kind 43", "deliver within two days"]
    return [(s, 1000.0 * i, 1000.0 * i + 900 + s, 20.0, words[(i + s) % 5], 5.0, 900.0, 0.1, i % 4 == 3) for s in (1, 2) for i in range(8)]


UTTERED = "stream_id long, " + U.TYPES


def contents(spark, sink):
    return sorted(map(str, sink.cards(spark).drop("batch").collect())), [tuple(r) for r in sink.history(spark).collect()]


def test_answers_of_a_stream_equal_those_of_a_batch_and_replays_change_nothing(spark, tmp_path):
    table = clause_table(spark)
    rows = utterance_rows()
    sink = A.AnswerSink(f"file://{tmp_path}/out", table, embedder(), most=7)
    (tmp_path / "in").mkdir()
    for k in range(3):
        spark.createDataFrame(rows[k::3], UTTERED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(spark.createDataFrame([], UTTERED).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = A.answer_stream(source, sink, str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination(200)
        assert q.exception() is None
    assert sink.batches(spark, "history") == [1, 2] and sink.batches(spark, "cards") == [0, 1, 2] and sink.batches(spark, "ranked") == []
    all_ = A.queries_of(spark.createDataFrame(rows, UTTERED))
    ranked = R.answer(all_.drop("at"), table, embedder()).cache()
    want = sorted(map(str, R.cards(ranked).select(*A.CARD).collect()))
    told = all_.select("query_id", "at", "transcript").join(R.verdicts(all_.drop("at"), ranked), "query_id").join(ranked.filter("final_rank = 1").select("query_id", F.col("id").alias("top_id")), "query_id", "left")
    newest = sorted((tuple(r) for r in told.collect()), key=lambda r: (r[1], r[0]), reverse=True)[:7]
    assert contents(spark, sink) == (want, newest) and len(want) > 10
    sink(A.queries_of(spark.createDataFrame(rows[2::3], UTTERED)), 2)  # the last batch again
    assert contents(spark, sink) == (want, newest)
    sink(A.queries_of(spark.createDataFrame([], UTTERED)), 3)  # an empty one
    assert contents(spark, sink) == (want, newest)
    ranked.unpersist()


def test_history_merge(spark):
    of = lambda rows: spark.createDataFrame(rows, "query_id string, at double, state string")
    before = of([("a", 1.0, "x"), ("b", 2.0, "x"), ("c", 3.0, "x")])
    got = [tuple(r) for r in A.merged(before, of([("b", 0.5, "y"), ("d", 3.0, "y"), ("d", 2.0, "z")]), 3).collect()]
    assert got == [("d", 3.0, "y"), ("c", 3.0, "x"), ("a", 1.0, "x")]
    assert A.merged(None, of([]), 3).count() == 0


def wav(x, rate, kind=1, bits=16, channels=1):
    data = x.tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, kind, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits) + b"data" + struct.pack("<I", len(data)) + data


def test_frames_equal_the_whole_file():
    rng = np.random.default_rng(1)
    for rate in (8_000, 11_025, 16_000, 22_050, 44_100, 48_000):
        for n in (0, 1, 2, 700, 5_003):
            for kind, bits, dtype, channels in ((1, 16, np.int16, 1), (1, 8, np.uint8, 2), (3, 32, np.float32, 1)):
                x = (rng.random(n * channels) * 100).astype(dtype)
                data = wav(x, rate, kind, bits, channels)
                want = files.resample(files.decode_wav(data)[1], rate, 16_000)
                for window in (1, 7, 64, 1000, 65_536):
                    if window < 64 and n > 1000:
                        continue
                    frames = list(files.wav_frames(data, 16_000, 32, window))
                    got = np.concatenate(frames) if frames else np.zeros(0, np.float32)
                    assert np.array_equal(got, want) and all(len(f) == 32 for f in frames[:-1]), (rate, n, window)


def test_frames_of_a_long_file_need_little_memory():
    x = np.zeros(60_000_000, np.int16)  # over twenty minutes at 44.1 kHz
    data = wav(x, 44_100)
    tracemalloc.start()
    n = sum(len(f) for f in files.wav_frames(data))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == int(60_000_000 / (44_100 / 16_000)) and most < 2**23


def test_files_to_segments(spark):
    tone = np.concatenate([np.zeros(16_000), 9_000 * np.sin(np.arange(16_000)), np.zeros(24_000)]).astype(np.int16)
    rows = spark.createDataFrame([("a", wav(tone, 16_000)), ("b", None), ("c", wav(tone[:100], 16_000))], "path string, content binary")
    frames = files.frames_of(rows)
    got = [tuple(r) for r in vad.segments(frames).orderBy("stream_id", "at").select("stream_id", "type").collect()]
    assert got == [("a", "speechStart"), ("a", "speechEnd")] and {r["stream_id"]: r["n"] for r in frames.groupBy("stream_id").agg(F.count("*").alias("n")).collect()} == {"a": 110, "c": 1}
    spark.udtf.register("wav_frames", files.WavFrames)
    rows.createOrReplaceTempView("recordings")
    assert spark.sql("SELECT path, frame, at FROM recordings, LATERAL wav_frames(content, 16000, 512)").count() == 111
