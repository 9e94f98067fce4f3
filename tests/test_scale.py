"""What larger tables ask of the engine: each text is worked on once, small batches, and work that follows what is asked."""

import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from clausewright.functions import vectors as V
from clausewright.operators import clauses as C
from clausewright.operators import documents as D
from clausewright.operators.dictionary import contained_terms
from clausewright.plans import contracts
from clausewright.plans import retrieval as R
from clausewright.plans.registry import ORACLES
from clausewright.sources import files, tables
from clausewright.sources.tables import cut
from clausewright.streaming import answers as A


@pytest.fixture(scope="module")
def chunk_rows(spark):
    text = '1.1 The fee for item{i} shall not exceed 5 unless "Net Cap" applies. See Section 1.2.\n\n1.2 Notwithstanding section 1.1, item{i} is exempt and the Seller shall pay all that is owed to others in due time.'
    docs = spark.createDataFrame([(i, text.replace("{i}", str(i)), f"t{i}") for i in range(60)], "doc_id long, text string, title string")
    return cut(C.chunks(C.units(D.parse(docs))), "chunks")


def asked(spark, ids):
    return spark.createDataFrame([(f"q{i}", float(i), f"the item{i} fee exceeds 5 in Q3", -0.1, 0.02, 20.0) for i in ids], "query_id string, at double, transcript string, asr_mean_logprob double, asr_no_speech_prob double, snr_db double")


def counting(seen):
    """An embedding that counts the texts that begin as clauses do, and refuses more than 1,000 texts at once."""

    class Counting(V.HashedWords):
        def embed(self, texts):
            assert len(texts) <= 1000
            seen.add(sum(t.startswith("ARTICLE") for t in texts))
            return super().embed(texts)

    return V.embed_with(lambda: Counting(32))


def test_texts_are_embedded_once_in_small_batches(spark, chunk_rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    n = chunk_rows.count()
    many = chunk_rows.crossJoin(spark.range(30).withColumnRenamed("id", "copy")).withColumn("id", F.concat_ws("/", "id", F.col("copy").cast("string"))).drop("copy").coalesce(1)
    seen = spark.sparkContext.accumulator(0)
    R.verdicts(asked(spark, [1, 2]).drop("at"), R.answer_plain(asked(spark, [1, 2]).drop("at"), many, counting(seen)), plain=True).collect()
    assert seen.value == 30 * n


def test_a_sink_embeds_the_clauses_for_its_first_batch_only(spark, chunk_rows, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    sink = A.AnswerSink(f"file://{tmp_path}/out", chunk_rows, counting(seen))
    left = set(tables._left)
    for batch, ids in ((0, [1, 2]), (1, [3]), (1, [3])):
        sink(asked(spark, ids), batch)
    assert sorted(x.partition("-")[0] for x in set(tables._left) - left) == ["terms", "vectors"]  # batches leave nothing behind
    assert seen.value == chunk_rows.count()
    assert [r["query_id"] for r in sink.history(spark).collect()] == ["q3", "q2", "q1"]


def test_a_history_answers_what_all_conversations_say(spark, monkeypatch, tmp_path):
    said = [(c, t, ("user", "assistant")[t % 2], f"line {c} of turn {t} says that the fee is due in {c % 7} days") for c in (*range(1, 61), 100, 200) for t in range(4)]
    lines = "\n\n".join(f"line {i} says that the fee is due in {i} days and all is well" for i in range(40))
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(d, lines) for d in range(1, 4)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen = []

    class Sink(A.AnswerSink):
        def __call__(self, queries, batch):
            seen.extend((r["query_id"], batch) for r in queries.select("query_id").collect())
            super().__call__(queries, batch)

    monkeypatch.setattr(contracts, "AnswerSink", Sink)
    got = contracts.answered_history(spark, str(tmp_path)).collect()
    users = [(c, t) for c, t, role, _ in said if role == "user"]
    assert {q for q, _ in seen} == {f"{c}:{t}" for c, t in users} and len(set(seen)) == len(users) > 100  # all are answered, not just those that are shown
    assert [r["query_id"] for r in got] == [f"{c}:{t}" for c, t in sorted(users, reverse=True)[:100]]
    db = duckdb.connect()
    for name in ("conversations", "documents"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert [tuple(r) for r in got] == db.sql(ORACLES["answered_history"]).fetchall()
    assert {r["query_id"] for r in contracts.said(spark, str(tmp_path)).collect()} == {"100:0", "100:2", "200:0", "200:2"}  # searches ask what they asked


def wav(samples, rate=8000):
    return b"RIFF" + struct.pack("<I", 36 + len(samples)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples


def test_files_are_decoded_in_batches(spark):
    rng = np.random.default_rng(2)
    data = {i: wav(rng.integers(0, 256, int(n)).astype("u1").tobytes()) for i, n in enumerate([0, 1, 2, 513, *rng.integers(0, 3000, 1500)])}
    got = files.decode_wavs(spark.createDataFrame(list(data.items()), "path long, content binary").coalesce(1))
    assert "MapInArrow" in got._jdf.queryExecution().toString()  # a batch for many files, not a frame of its own for each
    found = {r["path"]: (r["sample_rate"], r["samples"]) for r in got.collect()}
    assert found == {i: (16_000, files.resample(files.decode_wav(x)[1], 8000, 16_000).tolist()) for i, x in data.items()}


def test_terms_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(i):
        seen.add(1)
        return i

    terms = spark.createDataFrame([(f"term {i}",) for i in range(40)], "term string").withColumn("place", F.udf(told, LongType())(F.substring("term", 6, 9).cast("long")))
    texts = spark.createDataFrame([("a", "Term 7 and term 3")], "query_id string, transcript string")
    for size in (2**22, 50):
        before = seen.value
        assert [r["known"] for r in contained_terms(texts, terms, slice_bytes=size).collect()] == [["term 3", "term 7"]]
        assert seen.value - before == 40


def test_only_clauses_within_reach_are_grouped(spark, chunk_rows):
    clauses = C.as_clauses(chunk_rows)
    twice = clauses.unionByName(clauses.filter("id LIKE '7::%'").withColumns({"seq": F.struct((F.col("seq.doc_id") + 100).alias("doc_id"), "seq.vector_offset"), "doc": F.col("doc") + 1_000_000, "text": F.lit("the last of its id")}))
    some = clauses.filter("id LIKE '7::1.1%' OR id LIKE '9::1.2%' OR id LIKE '30::1.1%'").select("id")
    fused = some.withColumns({"query_id": F.lit("q"), "rank": F.when(F.col("id").startswith("30"), 3).otherwise(1)})
    whole, got = R.last_of_id(twice), R.within_reach(twice, fused)
    want = whole.filter("id LIKE '7::%' OR id LIKE '9::%'").unionByName(whole.join(some.filter("id LIKE '30::%'"), "id", "left_semi"))
    rows = lambda df: sorted(map(str, df.select(*whole.columns).collect()))
    assert rows(got) == rows(want) and got.filter("text = 'the last of its id'").count() > 0


def test_units_are_folded_alike_whatever_the_batches(spark):
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rng = np.random.default_rng(4)
    rows = [(d, f"d{d}", i, [str(i)], f"l{i}", ["t"], i, i + 1, f'u{i} "Cap {i % 3}" ' + "w " * int(n), bool(n == 5)) for d in range(9) for i, n in enumerate(rng.integers(1, 20, 30))]
    units = spark.createDataFrame(rows, "row long, doc_id string, seq long, path array<string>, label string, trail array<string>, page_start int, page_end int, text string, is_definition boolean")
    found = []
    for size in (10_000, 1, 7):
        spark.conf.set(conf, size)
        found.append(sorted(map(str, C.clause_flow(units).collect())))
        assert spark.conf.get(conf) == str(min(size, 1000))  # Spark's own limit is too many long rows
    spark.conf.set(conf, 1000)
    assert found[0] == found[1] == found[2]
