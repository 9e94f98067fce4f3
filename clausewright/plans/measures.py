"""Registered queries over events, conversations and plain texts: percentiles, words, signals, sessions, speech; each with the SQL that says the same."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from clausewright import settings as S
from clausewright.functions import speech
from clausewright.functions import text as T
from clausewright.functions import vectors as V
from clausewright.operators import clauses as C
from clausewright.operators import evaluate as E
from clausewright.plans.registry import query, rounded, sql_list, table
from clausewright.plans.search import MARKS, marks
from clausewright.sources import files, tables
from clausewright.streaming import ring, sessions, vad
from clausewright.streaming import utterances as U


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, floor(avg(value) * 100 + 0.5) / 100 AS mean FROM events GROUP BY event_type")
def percentile_nearest_rank(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    mean = e.groupBy("event_type").agg(T.rounded(F.avg("value"), 2).alias("mean"))
    return E.values_at(e, "event_type", "value", {"p50": E.nearest_rank(0.5), "p95": E.nearest_rank(0.95)}).join(mean, "event_type")


@query("SELECT event_type, min(value) FILTER (rn = floor(n * 0.5) + 1) AS p50, min(value) FILTER (rn = floor(n * 0.95) + 1) AS p95 FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type")
def percentile_floor_index(spark, sf_dir):
    """The value after floor(n * p) smaller ones."""
    return E.values_at(table(spark, sf_dir, "events"), "event_type", "value", {"p50": E.floor_index(0.5), "p95": E.floor_index(0.95)})


@query(f"""SELECT event_id, round(greatest(0.1, t1 - t0), 3) AS build_ms, round(greatest(0.1, t2 - t1), 3) AS embed_ms, round(greatest(0.1, t3 - t2), 3) AS search_ms, round(greatest(0.1, t4 - t3), 3) AS rank_ms, round(greatest(0.1, t4 - t0), 3) AS total_ms FROM ({MARKS})""")
def stage_durations(spark, sf_dir):
    """Times between the marks of a query's stages, as an overlay shows them; events stand for queries."""
    return E.stage_times(marks(spark, sf_dir), 0.1).select("event_id", *[F.round(c, 3).alias(c) for c in ("build_ms", "embed_ms", "search_ms", "rank_ms", "total_ms")])


@query("SELECT seconds, count(*) AS n, floor(avg(decode_ms) * 100 + 0.5) / 100 AS mean_ms, min(decode_ms) AS min_ms, max(decode_ms) AS max_ms, floor(mean_ms / (seconds * 1000) * 1000 + 0.5) / 1000 AS real_time_factor FROM (SELECT turn % 3 + 2 AS seconds, length(text) * 0.5::DOUBLE AS decode_ms FROM conversations) GROUP BY seconds")
def decode_times(spark, sf_dir):
    """Decode times by length of audio; turns of conversations stand for decodes."""
    return E.decode_times(table(spark, sf_dir, "conversations").select((F.col("turn") % 3 + 2).alias("seconds"), (F.length("text") * F.lit(0.5)).alias("decode_ms")))


@query("SELECT label, 'The following is a discussion of a term sheet: ' || string_agg(t, ', ' ORDER BY vec_id) || '.' AS prompt FROM (SELECT label, vec_id, 'Term ' || vec_id AS t FROM embeddings) GROUP BY label UNION ALL SELECT -1, ''")
def domain_prompts(spark, sf_dir):
    """What a recogniser is told about each group's terms; nothing where there are none."""
    e = table(spark, sf_dir, "embeddings")
    terms = e.groupBy("label").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("terms", F.transform("ids", lambda i: F.concat(F.lit("Term "), i.cast("string"))))
    none = e.agg(F.lit(-1).alias("label"), F.array().cast("array<string>").alias("terms"))
    return terms.select("label", "terms").unionByName(none).select("label", speech.domain_prompt(F.col("terms")).alias("prompt"))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> ''))::INTEGER AS words, right(trim(text), 1) IN ('.', ';', ':', '\"', '''', ')') AS ends_whole, sha256(text) AS content FROM documents".replace('\\"', '"'))
def text_measures(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.word_count(t).alias("words"), C.ends_whole(t).alias("ends_whole"), F.sha2(t, 256).alias("content"))


WORDS = ["the ", "worthless", "with", "password", "copyright", "license"]


HAS = "len(list_filter({}, lambda m: contains(lower(text), m))) > 0"


@query(f"SELECT doc_id, array_to_string(list_filter({sql_list(WORDS + S.EXCEPTION_MARKERS)}, lambda m: contains(lower(text), m)), ',') AS matched, matched <> '' AS has_exception, {HAS.format(sql_list(['must', *S.OBLIGATION_MARKERS]))} AS has_obligation, {HAS.format(sql_list([' is ', *S.DEFINITION_MARKERS]))} AS has_definition, {HAS.format(sql_list(['ere', *S.REMEDY_MARKERS]))} AS has_remedy FROM documents")
def signals(spark, sf_dir):
    found = T.signals(F.col("text"), exception=WORDS + S.EXCEPTION_MARKERS, obligation=["must", *S.OBLIGATION_MARKERS], definition=[" is ", *S.DEFINITION_MARKERS], remedy=["ere", *S.REMEDY_MARKERS])
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("s")).select("doc_id", F.array_join("s.matched_markers", ",").alias("matched"), "s.has_exception", "s.has_obligation", "s.has_definition", "s.has_remedy")


@query(r"""WITH t AS (SELECT DISTINCT source, unnest(regexp_extract_all(text, '[A-Z][a-z]{9,}')) AS term FROM documents), d AS (SELECT doc_id, source, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{10,}'))) AS w FROM documents)
SELECT source, lower(term) AS term, count(DISTINCT doc_id) AS docs FROM d JOIN t USING (source) WHERE w = lower(term) GROUP BY ALL""")
def defined_term_join(spark, sf_dir):
    """Capitalised long words of a source as its terms, joined by key with the words of its documents."""
    d = table(spark, sf_dir, "documents")
    terms = d.select("source", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{9,}"), 0)).alias("term")).select("source", F.lower("term").alias("term")).distinct()
    words = d.select("source", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{10,}"), 0))).alias("term"))
    return words.groupBy("source", "term").agg(F.count("*").alias("docs")).join(terms, ["source", "term"])


@query("SELECT page_id, pos::INTEGER AS pos, ref FROM (SELECT page_id, unnest(range(len(r))) AS pos, unnest(r) AS ref FROM (SELECT page_id, regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1) AS r FROM pages))")
def href_edges(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), 1)).alias("pos", "ref"))


HOUR = 3_600_000
VAD = vad.VadConfig(hangover_ms=6 * HOUR, most_ms=48 * HOUR, floor=2.0, least_rms=0.001)


def _frames(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), F.expr("unix_micros(cast(ts AS timestamp))").cast("double").alias("at_us"), F.col("value").alias("rms")).select("stream_id", (F.col("at_us") / 1000).alias("at"), "rms")


@query(f"""WITH RECURSIVE f AS (SELECT user_id AS stream_id, epoch_us(ts)::DOUBLE / 1000 AS at_, value AS rms, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) AS rn FROM events),
s AS (SELECT stream_id, 0::BIGINT AS rn, 2.0::DOUBLE AS fl, NULL::DOUBLE AS st, 0.0::DOUBLE AS la, 0.0::DOUBLE AS energy, 0::BIGINT AS frames, NULL::VARCHAR AS type, NULL::DOUBLE AS at_, 0.0::DOUBLE AS duration_ms, 0.0::DOUBLE AS snr FROM f WHERE rn = 1
UNION ALL SELECT n.stream_id, n.rn, CASE WHEN sp THEN fl ELSE nf END, CASE WHEN sp THEN coalesce(st, n.at_) WHEN en THEN NULL ELSE st END, CASE WHEN sp THEN n.at_ ELSE la END, CASE WHEN en THEN 0 WHEN sp THEN energy + rms ELSE energy END, CASE WHEN en THEN 0 WHEN sp THEN frames + 1 ELSE frames END,
  CASE WHEN sp AND st IS NULL THEN 'speechStart' WHEN en THEN 'speechEnd' END, n.at_, CASE WHEN en THEN n.at_ - st ELSE 0.0 END, CASE WHEN en THEN greatest(0.0, 20 * log10((energy / frames) / greatest(1e-5, nf))) ELSE 0.0 END
  FROM (SELECT f.*, s.fl, s.st, s.la, s.energy, s.frames, (f.rms / greatest(1e-5, s.fl) - 1.5::DOUBLE) / 6 >= 0.5 AS sp, 0.98::DOUBLE * s.fl + 0.02::DOUBLE * greatest(0.001, f.rms) AS nf,
    NOT ((f.rms / greatest(1e-5, s.fl) - 1.5::DOUBLE) / 6 >= 0.5) AND s.st IS NOT NULL AND (f.at_ - s.la >= {6 * HOUR} OR f.at_ - s.st >= {48 * HOUR}) AS en FROM s JOIN f ON f.stream_id = s.stream_id AND f.rn = s.rn + 1) n)
SELECT stream_id, type, at_ AS at, floor(duration_ms * 10 + 0.5) / 10 AS duration_ms, floor(snr * 10 + 0.5) / 10 AS snr_db FROM s WHERE type IS NOT NULL""")
def vad_sessions(spark, sf_dir):
    return vad.segments(_frames(spark, sf_dir), VAD)


class CountingRecogniser:
    """Says how many samples it got and takes a time by their number: a stand-in, not a model."""

    def transcribe(self, samples: np.ndarray, prompt: str) -> speech.Transcript:
        return speech.Transcript(f"{len(samples)} samples", len(samples) * HOUR / 8)


# Two samples a frame, each half an hour of audio.
SESSION = U.SessionConfig(vad=VAD, rate=2000 / HOUR, partial_ms=3 * HOUR, least_ms=2 * HOUR)


@query(f"""WITH RECURSIVE f AS (SELECT user_id AS stream_id, epoch_us(ts)::DOUBLE / 1000 AS at_, value AS rms, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) AS rn FROM events),
s AS (SELECT stream_id, 0::BIGINT AS rn, 2.0::DOUBLE AS fl, NULL::DOUBLE AS st, 0.0::DOUBLE AS la, 0.0::DOUBLE AS en, 0::BIGINT AS fr, 0::BIGINT AS n, 0.0::DOUBLE AS sq, 0.0::DOUBLE AS asked, -1.0::DOUBLE AS busy, 0::BIGINT AS pend, 0::BIGINT AS part,
  NULL::DOUBLE AS o_start, NULL::DOUBLE AS o_stop, NULL::DOUBLE AS o_snr, 0::BIGINT AS o_n, 0::BIGINT AS o_part, 0.0::DOUBLE AS o_rms FROM f WHERE rn = 1
UNION ALL SELECT stream_id, rn, CASE WHEN sp THEN fl ELSE nf END, CASE WHEN sp THEN coalesce(st, at_) WHEN fin THEN NULL ELSE st END, CASE WHEN sp THEN at_ ELSE la END, CASE WHEN fin THEN 0 WHEN sp THEN en + rms ELSE en END, CASE WHEN fin THEN 0 WHEN sp THEN fr + 1 ELSE fr END,
  CASE WHEN fin THEN 0 WHEN born THEN 2 WHEN st IS NOT NULL THEN n + 2 ELSE 0 END, CASE WHEN fin THEN 0 WHEN born THEN 2 * s32 * s32 WHEN st IS NOT NULL THEN sq + 2 * s32 * s32 ELSE 0 END,
  CASE WHEN dec THEN at_ WHEN born THEN 0 ELSE asked END, CASE WHEN dec THEN at_ + n2 * {HOUR} / 8.0::DOUBLE ELSE busy END, CASE WHEN dec THEN n2 WHEN born OR fin OR done THEN 0 ELSE pend END, CASE WHEN born OR fin THEN 0 WHEN done THEN pend ELSE part END,
  CASE WHEN fin THEN st END, at_, floor(greatest(0.0, 20 * log10((en / fr) / greatest(1e-5, nf))) * 10 + 0.5) / 10, n, CASE WHEN done THEN pend ELSE part END, sqrt(sq / n)
  FROM (SELECT *, n2 > 0 AND at_ >= busy AND at_ - CASE WHEN born THEN 0 ELSE asked END >= {3 * HOUR} AND n2 * {HOUR / 2} >= {2 * HOUR} AS dec FROM (SELECT *, sp AND st IS NULL AS born, CASE WHEN fin THEN 0 WHEN sp AND st IS NULL THEN 2 WHEN st IS NOT NULL THEN n + 2 ELSE 0 END AS n2, pend > 0 AND busy <= at_ AS done, rms::FLOAT::DOUBLE AS s32
    FROM (SELECT f.stream_id, f.rn, f.at_, f.rms, s.fl, s.st, s.la, s.en, s.fr, s.n, s.sq, s.asked, s.busy, s.pend, s.part, (f.rms / greatest(1e-5, s.fl) - 1.5::DOUBLE) / 6 >= 0.5 AS sp, 0.98::DOUBLE * s.fl + 0.02::DOUBLE * greatest(0.001, f.rms) AS nf,
      NOT ((f.rms / greatest(1e-5, s.fl) - 1.5::DOUBLE) / 6 >= 0.5) AND s.st IS NOT NULL AND (f.at_ - s.la >= {6 * HOUR} OR f.at_ - s.st >= {48 * HOUR}) AS fin FROM s JOIN f ON f.stream_id = s.stream_id AND f.rn = s.rn + 1)))),
o AS (SELECT * FROM s WHERE o_start IS NOT NULL)
SELECT stream_id, o_start AS start, o_stop AS stop, round(o_snr, 3) AS snr_db, o_n || ' samples' AS text, o_n * {HOUR / 8} AS decode_ms, o_n * {HOUR / 2} AS audio_ms, round(o_rms, 6) AS rms, false AS is_provisional FROM o
UNION ALL SELECT stream_id, o_start, o_stop, round(o_snr, 3), o_part || ' samples', o_part * {HOUR / 8}, o_part * {HOUR / 2}, round(o_rms, 6), true FROM o WHERE o_part > 0""")
def utterances(spark, sf_dir):
    """Provisional and final transcripts; each event is a frame of two samples."""
    frames = _frames(spark, sf_dir).withColumn("samples", F.array_repeat("rms", 2))
    return U.utterances(frames, CountingRecogniser, SESSION).withColumns({"snr_db": F.round("snr_db", 3), "rms": F.round("rms", 6)})


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS last_us, count(*) AS n FROM s GROUP BY user_id, k""")
def session_gap(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return sessions.gap_sessions(e, "user_id", "ts", "1 hour").select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("last").alias("last_us"), "n")


@query("SELECT user_id, event_id, age::INTEGER AS age FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age FROM events) WHERE age <= 5")
def ring_latest_n(spark, sf_dir):
    return sessions.latest(table(spark, sf_dir, "events"), "user_id", "ts", 5, "event_id").select("user_id", "event_id", "age")


# Events as operations on a ring of 50 samples: one of eleven clears it, one of three reads, others write two samples each.
RING = """o AS (SELECT user_id, event_id, row_number() OVER w AS rn, CASE WHEN event_id % 11 = 0 THEN 'clear' WHEN event_id % 3 = 0 THEN 'read' ELSE 'write' END AS op, value, (event_id % 70)::INTEGER AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
ep AS (SELECT *, count(*) FILTER (op = 'clear') OVER (PARTITION BY user_id ORDER BY rn) AS epoch, 2 * count(*) FILTER (op = 'write') OVER (PARTITION BY user_id ORDER BY rn) AS upto FROM o),
base AS (SELECT user_id, epoch, min(upto) FILTER (op = 'clear') AS first_ FROM ep GROUP BY user_id, epoch),
sm AS (SELECT user_id, epoch, upto - 1 AS pos, value::FLOAT::DOUBLE AS x FROM ep WHERE op = 'write' UNION ALL SELECT user_id, epoch, upto, (value / 2)::FLOAT::DOUBLE FROM ep WHERE op = 'write'),
rd AS (SELECT user_id, event_id, epoch, upto, least(n, 50, upto - coalesce(first_, 0)) AS c FROM ep JOIN base USING (user_id, epoch) WHERE op = 'read')"""


@query(f"WITH {RING} SELECT event_id, any_value(rd.user_id) AS user_id, any_value(c)::INTEGER AS n, round(coalesce(sum(x), 0), 3) AS total FROM rd LEFT JOIN sm ON sm.user_id = rd.user_id AND sm.epoch = rd.epoch AND sm.pos > rd.upto - c AND sm.pos <= rd.upto GROUP BY event_id")
def ring_buffer_reads(spark, sf_dir):
    """Writes to a ring of bounded capacity, reads of its latest samples, and clears."""
    i, v = F.col("event_id"), F.col("value")
    op = F.when(i % 11 == 0, "clear").when(i % 3 == 0, "read").otherwise("write")
    ops = table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("at"), i.alias("seq"), op.alias("op"), F.array(v, v / 2).alias("samples"), (i % 70).cast("int").alias("n"))
    got = ring.ring_reads(ops, 50)
    return got.select(F.col("seq").alias("event_id"), F.col("stream_id").alias("user_id"), F.size("samples").alias("n"), F.round(F.aggregate("samples", F.lit(0.0), lambda s, x: s + x.cast("double")), 3).alias("total"))


@query(f"""WITH RECURSIVE f AS (SELECT user_id, event_id, epoch_us(ts)::DOUBLE / 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
s AS (SELECT user_id, 0::BIGINT AS event_id, 0::BIGINT AS rn, -1e18::DOUBLE AS la, false AS hit FROM f WHERE rn = 1
UNION ALL SELECT f.user_id, f.event_id, f.rn, CASE WHEN f.t - s.la BETWEEN 60000 AND {24 * HOUR} THEN -1e18::DOUBLE ELSE f.t END, f.t - s.la BETWEEN 60000 AND {24 * HOUR} FROM s JOIN f ON f.user_id = s.user_id AND f.rn = s.rn + 1)
SELECT user_id, event_id FROM s WHERE hit""")
def double_tap(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.expr("unix_micros(cast(ts AS timestamp))") / 1000).alias("t"))
    return sessions.double_taps(e, "user_id", "t", "event_id", 60_000, 24 * HOUR).select("user_id", "event_id")


@query(r"""WITH c AS (SELECT conv_id, turn, text, list_filter(regexp_split_to_array(lower(trim(text)), '\s+'), lambda w: w <> '') AS ws, (turn % 7) / 100.0::DOUBLE AS rms, 1000.0::DOUBLE * (1 + turn % 5) AS ms FROM conversations),
e AS (SELECT *, CASE WHEN rms < 0.005 THEN [-2.5, 0.95] WHEN trim(text) = '' THEN [-2.2, 0.9] WHEN length(trim(text)) / (ms / 1000) < 3 THEN [-1.4, 0.45] WHEN len(ws) > 6 AND len(list_distinct(ws)) / len(ws) < 0.35 THEN [-1.5, 0.5]
  ELSE [-0.6 + 0.4 * least(1.0::DOUBLE, rms / 0.05), greatest(0.02::DOUBLE, 0.2 - 0.18 * least(1.0::DOUBLE, rms / 0.05))]::DOUBLE[] END::DOUBLE[] AS p FROM c)
SELECT conv_id, turn, round(p[1], 6) AS mean_logprob, round(p[2], 6) AS no_speech, round(1 / (1 + exp(-3 * (p[1] + 0.8))), 6) AS confidence FROM e""")
def asr_confidence(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    got = c.select("conv_id", "turn", T.recognised(F.col("text"), (F.col("turn") % 7) / F.lit(100.0), F.lit(1000.0) * (1 + F.col("turn") % 5)).alias("r")).select("conv_id", "turn", "r.*")
    return rounded(got.withColumn("confidence", T.asr_confidence(F.col("mean_logprob"))), "mean_logprob", "no_speech", "confidence")


@query(r"SELECT doc_id, (('0x' || substr(md5(w), 1, 4))::INTEGER % 16) AS bucket, count(*) AS n FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(trim(text)), '\s+'), lambda w: w <> '')) AS w FROM documents) GROUP BY ALL")
def hashed_features(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(V.hashed_words(F.col("text"))).alias("bucket", "n"))
    return counts.filter("n > 0").select("doc_id", "bucket", F.col("n").cast("long").alias("n"))


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def event_history(spark, sf_dir):
    return sessions.history(table(spark, sf_dir, "events"), "ts", "event_id").select("event_id", "user_id")


@query("SELECT 'q' || vec_id AS id, CASE WHEN label % 3 = 0 THEN 'c' || (vec_id + 1) ELSE array_to_string(list_sort(['c' || (vec_id + 1), 'c' || (vec_id + 2)]), ',') END AS ids FROM embeddings")
def assertion_file(spark, sf_dir):
    """Labelled queries written as a file of JSON lines, read by its schema, and what counts as found for each."""
    v, path = F.col("vec_id"), tables.folder(spark, "assertions")
    of = lambda *ids: F.array(*[F.concat(F.lit("c"), i.cast("string")) for i in ids])
    rows = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("q"), v.cast("string")).alias("id"), F.lit("a claim").alias("assertion"), of(v + 1).alias("goldChunkIds"), of(v + 2, v + 1).alias("acceptableChunkIds"), (F.col("label") % 3 == 0).alias("adversarial"))
    rows.write.json(path)
    back = files.read_assertions(spark, path)
    return back.select("id", F.array_join(F.array_sort(E.gold_ids(F.col("goldChunkIds"), F.col("acceptableChunkIds"), F.col("adversarial"))), ",").alias("ids"))


@query("SELECT label, count(*) AS n, round(sum(list_sum(embedding)::DOUBLE), 3) AS total FROM embeddings GROUP BY label")
def index_file(spark, sf_dir):
    """An index written with its manifest and read back against it."""
    path = tables.folder(spark, "index")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.concat(F.lit("text "), F.col("vec_id").cast("string")).alias("text"), "embedding", "label")
    wide = rows.select(F.size("embedding")).first()[0]
    files.write_index(rows, path, f"vectors-{wide}", wide)
    back = files.read_index(spark, path, f"vectors-{wide}")
    return back.groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x)), 3).alias("total"))


def _wav(rate: int):
    """The bytes of the column text as a WAV file of one channel and 8 bits."""
    little = lambda n, k: F.unhex(F.concat(*[F.lpad(F.hex(F.floor(n / 256**i).cast("long") % 256), 2, "0") for i in range(k)]))
    body = F.encode("text", "utf-8")
    size = F.octet_length("text").cast("long")
    head = [F.encode(F.lit("RIFF"), "utf-8"), little(size + 36, 4), F.encode(F.lit("WAVEfmt "), "utf-8"), little(F.lit(16), 4), little(F.lit(1), 2), little(F.lit(1), 2), little(F.lit(rate), 4), little(F.lit(rate), 4), little(F.lit(1), 2), little(F.lit(8), 2)]
    return F.concat(*head, F.encode(F.lit("data"), "utf-8"), little(size, 4), body)


@query("""WITH b AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE text <> ''), x AS (SELECT doc_id, unnest(range(len(h) // 2)) AS i, unnest(list_transform(range(len(h) // 2), lambda i: (('0x' || substr(h, 2 * i + 1, 2))::INTEGER - 128) / 128.0::DOUBLE)) AS v FROM b)
SELECT doc_id, frame::INTEGER AS frame, frame * 32.0::DOUBLE AS "at", round(sqrt(avg(v * v)), 6) AS rms, count(*)::INTEGER AS samples FROM (SELECT *, i // 512 AS frame FROM x) GROUP BY doc_id, frame""")
def audio_frames(spark, sf_dir):
    """The bytes of each text as a WAV file, cut into frames by a table function."""
    got = files.frames_of(table(spark, sf_dir, "documents").filter("text <> ''").select("doc_id", _wav(16_000).alias("content")), "doc_id")
    return got.select(F.col("stream_id").alias("doc_id"), "frame", "at", F.round("rms", 6).alias("rms"), F.size("samples").alias("samples"))


@query("""WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents WHERE text <> ''), s AS (SELECT doc_id, list_transform(range(len(h) // 2), lambda i: (('0x' || substr(h, 2 * i + 1, 2))::INTEGER - 128) / 128.0::DOUBLE) AS x FROM b)
SELECT doc_id, (2 * len(x))::INTEGER AS samples, round(2 * list_sum(x) - x[1] / 2 + x[-1] / 2, 2) AS total, (len(x) * 8000 // 11025)::INTEGER AS samples_of_another FROM s""")
def wav_decode(spark, sf_dir):
    """The bytes of each text as a WAV file of 8-bit samples at 8 and at 11.025 kHz, decoded to mono at 16 and at 8 kHz."""
    docs = table(spark, sf_dir, "documents").filter("text <> ''")
    one = files.decode_wavs(docs.select(F.col("doc_id").alias("path"), _wav(8000).alias("content")))
    two = files.decode_wavs(docs.select(F.col("doc_id").alias("path"), _wav(11_025).alias("content")), 8000)
    total = F.aggregate("samples", F.lit(0.0), lambda s, x: s + x)
    return one.select(F.col("path").alias("doc_id"), F.size("samples").alias("samples"), F.round(total, 2).alias("total")).join(two.select(F.col("path").alias("doc_id"), F.size("samples").alias("samples_of_another")), "doc_id")
