"""Operators on small examples: clauses, fusion, references, gate, segments, sources."""

import contextlib
import math
import os
import struct
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from clausewright import settings as S
from clausewright.functions import speech
from clausewright.functions import text as T
from clausewright.functions import vectors as V
from clausewright.operators import clauses as C
from clausewright.operators import documents as D
from clausewright.operators import evaluate as E
from clausewright.operators import faults as FX
from clausewright.operators import fusion as X
from clausewright.operators import scoring as G
from clausewright.operators.dictionary import contained_terms
from clausewright.operators import knn
from clausewright.operators.knn import BackendUnavailable, FlatIndex, create_index
from clausewright.sources import files, index, tables
from clausewright.streaming import utterances as U
from clausewright.streaming import vad

ORDER = """SERVICE ORDER 7

ARTICLE I — MEANINGS

"Parcel" means any sealed item handed to the Carrier for delivery.

ARTICLE II — DELIVERY

SECTION 2.1 Delivery Times

2.1 The Carrier shall deliver each Parcel within two days, and late deliv-
ery must be reported under Section 3.1.

2.1.1(a) Notwithstanding §2.1, rural Parcel routes are exempt provided that notice is given.

(b) Reserved.

2.2 Storage fees apply after five days unless the Carrier agrees otherwise in writing.

Storage is free on public holidays.

SECTION 3.1 Claims

3.1 In the event of loss, the sole remedy is a refund under §2.1.1(a).
"""


def test_clauses_of_a_document(spark):
    docs = spark.createDataFrame([("service_order", ORDER)], "doc_id string, text string")
    rows = C.chunks(C.units(D.parse(docs))).orderBy("vector_offset").collect()
    assert [".".join(r["clause_path"]) for r in rows] == ["def.parcel", "2.1", "2.1.1.a", "2.2", "3.1"]
    assert [r["clause_label"] for r in rows] == ['§1.1 ("Parcel")', "§2.1", "§2.1.1(a)", "§2.2", "§3.1"]
    assert [r["token_count"] for r in rows] == [11, 19, 13, 22, 14]
    assert [r["cross_refs"] for r in rows] == [[], ["3.1"], ["2.1"], [], ["2.1.1(a)"]]
    assert [r["signals"]["matched_markers"] for r in rows] == [[], [], ["notwithstanding", "provided that", "exempt"], ["unless"], []]
    assert [(r["signals"]["has_obligation"], r["signals"]["has_definition"], r["signals"]["has_remedy"]) for r in rows] == [(False, True, False), (True, False, False), (False, False, False), (False, False, False), (False, False, True)]
    assert "late delivery" in rows[1]["text"] and rows[3]["text"].startswith("(b) Reserved. 2.2 Storage") and rows[3]["text"].endswith("public holidays.")
    assert rows[0]["heading_trail"] == ["ARTICLE I — MEANINGS", "Definitions"] and rows[4]["heading_trail"] == ["ARTICLE II — DELIVERY", "SECTION 3.1 Claims"]
    assert [r["defined_terms"] for r in rows] == [["Parcel"]] * 3 + [[], []]


def test_fusion_and_references(spark):
    ranks = {"A": (1, 2, None, None), "B": (2, 1, 3, None), "C": (None, None, 1, None), "D": (3, None, 2, 1)}
    hits = [(1, k, i, 1.0 / r, r) for i, rs in ranks.items() for k, r in zip(S.KINDS, rs, strict=True) if r]
    rows = X.fuse(spark.createDataFrame(hits, "query_id long, kind string, id string, score double, rank int")).orderBy("rank").collect()
    assert [(r["id"], round(r["fused"], 9), r["best_kind"]) for r in rows] == [("B", 0.050138920, "exception"), ("D", 0.041890996, "obligation"), ("A", 0.037361185, "exception"), ("C", 0.013114754, "definition")]
    fused = spark.createDataFrame([(1, "p", 1.0, 0.9, "obligation", 0.9, None, 1), (1, "other", 0.5, 0.4, "remedy", None, 0.4, 2)], "query_id long, id string, fused double, best_cosine double, best_kind string, obligation double, remedy double, rank int")
    clauses = [("p", "§2.1", ["3.1"], False, 0), ("cited", "§3.1", [], False, 1), ("sub", "§2.1(A)", ["2.1"], True, 2), ("deep", "§9", ["2.1(b)"], True, 3), ("plain", "§2.1.1", ["2.1"], False, 4), ("far", "§2.10", [], True, 5), ("other", "§8", [], True, 6), ("twin", "§2.1", ["3.1"], True, 7), ("last", "§3.1", [], False, 8)]
    # a second document with the same labels, all of them exceptions that cite §2.1, changes nothing
    both = [(*c, 1) for c in clauses] + [("x" + c[0], c[1], ["2.1"], True, 100 + c[4], 2) for c in clauses]
    got = X.expand_refs(fused, spark.createDataFrame(both, "id string, label string, refs array<string>, has_exception boolean, seq int, doc int")).orderBy("rank").collect()
    # of two clauses with one label the last is cited; a clause with the parent's label is no carve-out of it unless it cites it
    assert [(r["id"], round(r["fused"], 6), r["xref_from"], r["obligation"], r["best_kind"]) for r in got] == [("sub", 1.03, "§2.1", 0.9, "exception"), ("deep", 1.03, "§2.1", 0.9, "exception"), ("p", 1.0, None, 0.9, "obligation"), ("last", 0.7, "§2.1", 0.9, "obligation"), ("other", 0.5, None, None, "remedy")]


def test_references_stay_in_their_document(spark):
    clauses = [(f"{d}::{i}", d, f"§1.{i}", ["1.2"] if i == 1 else [], i == 3, i) for d in ("a", "b", None) for i in (1, 2, 3)]
    rows = spark.createDataFrame([(f"{r[0]}", {"a": 1, "b": 2, None: 3}[r[1]], *r[2:]) for r in clauses], "id string, doc int, label string, refs array<string>, has_exception boolean, seq int")
    fused = spark.createDataFrame([(q, f"{d}::1", 1.0, 0.9, "obligation", 0.9, 1) for q, d in ((1, "a"), (2, "b"), (3, None))] + [(4, "b::2", 1.0, 0.9, "obligation", 0.9, 1)], "query_id long, id string, fused double, best_cosine double, best_kind string, obligation double, rank int")
    got = X.expand_refs(fused, rows).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"]) for r in got] == [(1, "a::1"), (1, "a::2"), (2, "b::1"), (2, "b::2"), (3, "None::1"), (3, "None::2"), (4, "b::2")]


GATES = [
    ("strong", {}, [0.7], "green", 0.74, "confident_match"), ("weak", {}, [0.2, 0.1], "amber", 0.0, "weak_similarity_match"), ("none", {"lp": -0.9, "snr": 9.0}, [], "amber", 0.2, "no_candidates_retrieved"),
    ("mute", {"ns": 0.61}, [], "red", 0.0, "no_speech_detected"), ("middle", {}, [0.5, 0.45], "green", 0.73, "confident_match"), ("low", {}, [0.35], "amber", 0.45, "weak_similarity_match"), ("near", {"snr": 6.0, "lp": -0.8}, [0.5, 0.5], "amber", 0.37, "narrow_rank_margin"),
    ("asr", {"lp": -1.17}, [0.6], "red", 0.0, "asr_confidence_below_floor"), ("empty", {"t": " b "}, [], "red", 0.0, "empty_transcript"),
]


def test_gate(spark):
    asked = [(n, c.get("t", "some words"), c.get("lp", -0.2), c.get("ns", 0.1), c.get("snr", 22.0)) for n, c, *_ in GATES]
    found = [(n, i + 1, x) for n, _, xs, *_ in GATES for i, x in enumerate(xs)]
    got = G.gate(spark.createDataFrame(asked, "query_id string, transcript string, asr_mean_logprob double, asr_no_speech_prob double, snr_db double"), spark.createDataFrame(found, "query_id string, final_rank int, best_cosine double")).collect()
    assert {r["query_id"]: (r["state"], r["composite"], r["reason"]) for r in got} == {n: (s, c, r) for n, _, _, s, c, r in GATES}


def test_search_seam(spark):
    rows = spark.createDataFrame([(i, [float(i == j) for j in range(3)]) for i in range(3)], "id long, embedding array<float>")
    got = create_index(rows).search(spark.createDataFrame([(7, "obligation", [0.0, 1.0, 0.0])], "query_id long, kind string, embedding array<float>"), 2).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in got] == [(1, 1.0), (0, 0.0)]
    with pytest.raises(BackendUnavailable):
        create_index(rows, "other")


def test_search_ways_agree_and_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = rng.integers(-3, 4, (300, 6)).astype(float)  # many ties
    queries = rng.integers(-3, 4, (40, 6)).astype(float)
    schema = "id long, embedding array<float>"
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, None), (901, [])], schema).repartition(5)
    asked = spark.createDataFrame([(i, "k", v.tolist()) for i, v in enumerate(queries)] + [(99, "k", None)], "query_id long, kind string, embedding array<float>")
    for k in (1, 7, 1000):
        want = [(q, "k", int(i), float(s[i]), n + 1) for q, s in enumerate(queries @ vectors.T) for n, i in enumerate(np.lexsort((np.arange(300), -s))[:k])]
        for sent, product in ((2**20, 2**22), (2**20, 100), (1, 2**22), (1, 100)):
            monkeypatch.setattr(FlatIndex, "SENT", sent)
            monkeypatch.setattr(knn, "SCORES", product)
            got = sorted(map(tuple, FlatIndex(rows).search(asked, k).select("query_id", "kind", "id", "score", "rank").collect()))
            assert got == sorted(want), (k, sent, product)
    everything = create_index(rows, "lists", lists=5, probes=5)
    assert sorted(map(tuple, everything.search(asked, 1000).select("query_id", "kind", "id", "score", "rank").collect())) == sorted(want)
    everything.close()
    for bad in ([1.0] * 5, [1.0, None, 1.0, 1.0, 1.0, 1.0], [float("nan")] * 6, [float("inf")] * 6):
        with pytest.raises(Exception, match="vector of id 77 isn't 6 finite numbers"):
            FlatIndex(rows.unionByName(spark.createDataFrame([(77, bad)], schema))).search(asked, 3).collect()
    with pytest.raises(Exception, match="vector of query_id 5 "):
        FlatIndex(rows).search(spark.createDataFrame([(5, "k", [1.0])], asked.schema), 3).collect()
    assert FlatIndex(rows.filter("id >= 900")).search(asked).count() == 0 and FlatIndex(rows).search(asked.limit(0)).count() == 0 and create_index(rows.limit(0), "lists").search(asked).count() == 0


def test_lists_recall_in_clusters(spark):
    """In clustered vectors few lists are enough, and each query meets a share of the rows only."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    v = centres[rng.integers(0, 30, 4000)] + 0.2 * rng.normal(size=(4000, 16))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
    asked = rows.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.lit("k").alias("kind"), "embedding")
    lists = create_index(rows, "lists", lists=30, probes=6)
    got = {(r["query_id"], r["id"]) for r in lists.search(asked, 10).collect()}
    want = {(r["query_id"], r["id"]) for r in FlatIndex(rows).search(asked, 10).collect()}
    lists.close()
    assert len(got & want) / len(want) >= 0.95


def test_segments_in_batch_and_stream(spark, tmp_path):
    frames = [(1, 100.0, 0.35), (1, 400.0, 0.35), (1, 1200.0, 0.001), (2, 0.0, 0.5), (2, 599.0, 0.001), (2, 700.0, 0.001)]
    df = spark.createDataFrame(frames, "stream_id long, at double, rms double")
    got = sorted(map(tuple, vad.segments(df).collect()))
    assert [g for g in got if g[0] == 1] == [(1, "speechEnd", 1200.0, 1100.0, 39.0), (1, "speechStart", 100.0, 0.0, 0.0)]
    assert [(g[1], g[2]) for g in got if g[0] == 2] == [("speechEnd", 700.0), ("speechStart", 0.0)]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = vad.stream_segments(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("segments").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("segments").collect())) == got


def test_text_functions(spark):
    row = spark.range(1).select(
        T.title(F.lit("/a/term-sheet_v4 (x).md")).alias("title"), T.slug(F.lit("Term Sheet v4")).alias("slug"), T.dehyphenate(F.lit("deliv-\nery  now")).alias("joined"),
        F.regexp_extract_all(F.lit("4.0% of $50,000,000 in Q3, 12%x annual"), F.lit(S.QUALIFIERS), 1).alias("q"), T.highlight(F.lit("a Cap (x) here"), ["cap", "(x)", "he"]).alias("b"),
    ).first()
    assert row["title"] == "Term-Sheet V4 (X)" and row["slug"] == "term_sheet_v4" and row["joined"] == "delivery now" and row["q"] == ["Q3", "12%", "annual"] and row["b"] == "a <b>Cap</b> <b>(x)</b> here"


def test_files(spark, tmp_path):
    data = struct.pack("<4h", 0, 16384, -16384, 32767)
    wav = b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 8000, 32000, 4, 16) + b"data" + struct.pack("<I", len(data)) + data
    (tmp_path / "a.wav").write_bytes(wav)
    rate, x = files.decode_wav(wav)
    assert len(files.resample(np.zeros(101, np.float32), 44_100, 16_000)) == 36 and len(files.resample(np.zeros(300, np.float32), 8000, 16_000)) == 600
    assert rate == 8000 and np.allclose(x, [0.25, 0.249985], atol=1e-5)
    assert len(files.read_wav(spark, str(tmp_path / "a.wav")).first()["samples"]) == 4
    chunks = spark.createDataFrame([("a", "t", [1.0, 0.0])], "id string, text string, embedding array<float>")
    files.write_index(chunks, str(tmp_path / "i"), "sha256:1", 2)
    assert files.read_index(spark, str(tmp_path / "i"), "sha256:1").count() == 1
    with pytest.raises(files.ModelMismatch):
        files.read_index(spark, str(tmp_path / "i"), "sha256:2")
    chunks.write.mode("append").parquet(str(tmp_path / "i" / "chunks"))
    with pytest.raises(files.InvalidIndex):
        files.read_index(spark, str(tmp_path / "i"))
    (tmp_path / "my_doc.md").write_text("x\ny")
    assert files.read_documents(spark, str(tmp_path / "my_doc.md")).first()[:] == ("my_doc", "My Doc", "x\ny")


def test_search_takes_query_sets_of_any_size(spark):
    rng = np.random.default_rng(3)
    own, asked = rng.normal(size=(300, 8)), rng.normal(size=(20_500, 8))
    own[7] = own[3]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(own.tolist())], "id long, embedding array<double>")
    queries = spark.createDataFrame([(i, "obligation", v) for i, v in enumerate(asked.tolist())], "query_id long, kind string, embedding array<double>")
    got = create_index(rows).search(queries, 3).orderBy("query_id", "rank").toPandas()
    scores = asked @ own.T
    want = np.lexsort((np.broadcast_to(np.arange(300), scores.shape), -scores.round(9)), axis=1)[:, :3]
    assert got["id"].to_numpy().reshape(-1, 3).tolist() == want.tolist()


def parsed(spark, *texts):
    return D.parse(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).orderBy("doc_id").collect()


def test_pages_and_blocks(spark):
    mark = "--- PAGE BREAK ---"
    a, b, c, d = parsed(spark, f"alpha {mark} beta {mark}{mark} gamma", "\n".join(f"line {i}" for i in range(81)), None, "(A) one\n(a) two\nArticle 5 three\nArticles of faith\n\nbold\n# Section 2.1 x")
    assert a["page_count"] == 4 and [(x["page"], x["text"]) for x in a["blocks"]] == [(1, "alpha"), (2, "beta"), (4, "gamma")] and a["rejected"] and a["poor_pages"] == 4
    assert b["page_count"] == 3 and [x["page"] for x in b["blocks"]] == [1, 2, 3] and b["blocks"][2]["text"] == "line 80"
    assert c["page_count"] == 1 and c["blocks"] == [] and c["rejected"]
    # an upper-case letter in brackets is no heading; sizes are of headings only
    assert [(x["text"], x["font_size"], x["bold"]) for x in d["blocks"]] == [("(A) one", 11.0, False), ("(a) two", 11.0, False), ("Article 5 three Articles of faith", 14.0, True), ("bold", 11.0, False), ("Section 2.1 x", 12.5, True)]


def test_repeated_headers_count_all_pages(spark):
    mark = "--- PAGE BREAK ---"
    two, three = parsed(spark, mark.join(["Draft\n\nx", "draft\n\ny", "", "", ""]), mark.join(["Draft\n\nx", "draft\n\ny", "DRAFT", "", ""]))
    assert [x["text"] for x in two["blocks"]] == ["Draft", "x", "draft", "y"] and [x["text"] for x in three["blocks"]] == ["x", "y"]


def test_documents_and_clauses_that_are_refused(spark):
    whole = D.parse(spark.createDataFrame([(1, "x" * 120), (2, "little"), (None, "y" * 200)], "doc_id long, text string"))
    assert sorted(r["doc_id"] or 0 for r in D.accepted(whole).collect()) == [0, 1] and [r["doc_id"] for r in D.quarantined(whole).collect()] == [2]
    with pytest.raises(Exception, match="scanned document: 2, pages with little text 1/1"):
        D.accepted(whole, strict=True).collect()
    rows = spark.createDataFrame([("§1", "A clause."), ("§2", "A clause that"), ("§3", 'He said "so"')], "clause_label string, text string")
    assert [r[0] for r in C.whole(rows).collect()] == ["§1", "§3"]
    with pytest.raises(Exception, match="cut within a sentence: §2"):
        C.whole(rows, strict=True).collect()


def test_documents_without_ids_stay_apart(spark):
    docs = spark.createDataFrame([(None, "1.1 " + "a " * 14 + "end."), (None, "1.1 " + "b " * 14 + 'of "Big Cap".\nmore\n1.2 ' + "c " * 14), (7, "2.1 x\n2.2 " + "y " * 20), (7, "2.1 z")], "doc_id long, text string")
    rows = C.chunks(C.units(D.parse(docs))).collect()
    got = sorted((r["doc_id"] or 0, r["clause_label"], r["token_count"], r["vector_offset"]) for r in rows)
    assert got == [(0, "§1.1", 16, 0), (0, "§1.1", 19, 0), (0, "§1.2", 15, 1), (7, "§2.1", 2, 0), (7, "§2.2", 23, 0)]


def test_short_units_merge_as_one_by_one(spark):
    rng = np.random.default_rng(5)
    for _ in range(5):
        units = [(int(n), bool(d)) for n, d in zip(rng.integers(1, 20, 40), rng.random(40) < 0.1, strict=True)]
        units[7:9] = [(3, False), (318, False)]
        text = lambda i, n: " ".join([f"u{i}"] * n)
        rows = [(1, 9, i, [str(i)], f"l{i}", ["t"], i, i + 1, text(i, n), d) for i, (n, d) in enumerate(units)]
        df = spark.createDataFrame(rows, "row long, doc_id long, seq long, path array<string>, label string, trail array<string>, page_start int, page_end int, text string, is_definition boolean")
        want, held = [], None
        for i, (n, d) in enumerate(units):
            cur = (text(i, n), n, i) if held is None else (f"{held[0]} {text(i, n)}", held[1] + n, held[2])
            follows = i + 1 < len(units) and not units[i + 1][1] and cur[1] + units[i + 1][0] <= 320
            if not d and cur[1] < 12 and follows:
                held = cur
            else:
                want.append((cur[0], cur[1], cur[2], f"l{i}", i + 1))
                held = None
        got = [(r["text"], r["words"], r["page_start"], r["label"], r["page_end"]) for r in C.merge_short(df).orderBy("seq").collect()]
        assert got == want


def test_terms_of_the_corpus_in_queries(spark):
    terms = spark.createDataFrame([("big cap", 2), ("cap", 1), ("x y", 3), ("absent", 0)], "term string, place int")
    queries = spark.createDataFrame([("a", "The Big Cap exceeds"), ("b", "nothing known here exceeds"), ("c", "  "), ("d", "recapture")], "query_id string, transcript string")
    got = {r["query_id"]: (r["subject"], r["obligation"]) for r in G.parse_assertions(queries, terms).collect()}
    assert got == {"a": (["cap", "big cap"], ["exceeds", "exceed", "cap"]), "b": (["nothing", "known", "here"], ["exceeds", "exceed"]), "c": ([], []), "d": (["cap"], ["cap"])}


def test_dictionary_in_slices_equals_substrings(spark):
    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("abİé x"), n))
    terms = sorted({word(int(n)).strip().lower() for n in rng.integers(1, 60, 300)})
    texts = [(i, " ".join(word(int(n)) for n in rng.integers(1, 40, 12))) for i in range(60)] + [(70, None), (71, ""), (72, "   "), (73, "".join(terms).upper())]
    t = spark.createDataFrame([(x, i) for i, x in enumerate(terms)], "term string, place int")
    q = spark.createDataFrame(texts, "query_id long, transcript string")
    want = {i: [x for x in terms if x and x in s.strip(" ").lower()] for i, s in texts if s}
    want = {i: x for i, x in want.items() if x}
    for size in (2**22, 500):
        got = {r["query_id"]: r["known"] for r in contained_terms(q, t, slice_bytes=size).collect()}
        assert got == want, size
    assert contained_terms(q, t.limit(0)).count() == 0 and contained_terms(q.limit(0), t).count() == 0


def test_index_errors_name_what_is_wrong(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = spark.range(3000).select(F.concat(F.lit("c"), "id").alias("id"), F.lit("text").alias("text"), F.array(F.col("id").cast("float"), F.lit(0.5).cast("float")).alias("embedding")).coalesce(2)
    files.write_index(rows, path, "model-a", 2, file_rows=5)
    told = spark.read.parquet(f"{path}/manifest/files")
    assert told.count() == 600 and {r["level"]: r["n"] for r in index.tree(told).groupBy("level").agg(F.count("*").alias("n")).collect()} == {0: 600, 1: 3, 2: 1}
    assert files.read_index(spark, path, "model-a", 2).count() == 3000
    with pytest.raises(files.ModelMismatch):
        files.read_index(spark, path, "model-b", 3)
    with pytest.raises(files.DimensionMismatch):
        files.read_index(spark, path, "model-a", 3)
    # one changed vector, in a file of the same name: the file is named, before the model is looked at
    name = sorted(f for f in os.listdir(f"{path}/chunks") if f.endswith(".parquet"))[7]
    one = f"{path}/chunks/{name}"
    whole = pq.read_table(one)
    vectors = whole.column("embedding").to_pylist()
    vectors[1][1] = 0.25
    was = open(one, "rb").read()
    pq.write_table(whole.set_column(2, "embedding", pa.array(vectors, pa.list_(pa.float32()))), one)
    with contextlib.suppress(FileNotFoundError):
        os.remove(f"{path}/chunks/.{name}.crc")
    with pytest.raises(files.CorruptIndex, match=f"{name} changed") as e:
        files.read_index(spark, path, "model-b")
    assert e.value.files == [name]
    open(one, "wb").write(was)
    assert files.read_index(spark, path).count() == 3000
    os.rename(one, f"{path}/chunks/part-x.parquet")
    with pytest.raises(files.CorruptIndex, match=f"{name} missing, part-x.parquet added"):
        files.read_index(spark, path)
    os.rename(f"{path}/chunks/part-x.parquet", one)
    head = next(f for f in os.listdir(f"{path}/manifest/head") if f.endswith(".json"))
    text = open(f"{path}/manifest/head/{head}").read()

    def with_head(old, new):
        open(f"{path}/manifest/head/{head}", "w").write(text.replace(old, new))
        with contextlib.suppress(FileNotFoundError):
            os.remove(f"{path}/manifest/head/.{head}.crc")
        return files.read_index(spark, path)

    with pytest.raises(files.UnsupportedVersion):
        with_head('"version":1', '"version":2')
    with pytest.raises(files.CorruptIndex, match="root"):
        with_head('"root":"', '"root":"0')
    with pytest.raises(files.CorruptIndex, match="of another size"):
        with_head('"dimensions":2', '"dimensions":3')
    with pytest.raises(files.InvalidIndex, match="can't be read"):
        with_head("{", "[")
    with pytest.raises(files.InvalidIndex, match="no manifest"):
        files.read_index(spark, str(tmp_path / "nothing"))


def test_faults_are_counted_while_rows_are_written(spark, tmp_path):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 7 == 0, "no end").otherwise("It ends.").alias("text"), F.when(F.col("id") % 5 == 0, 400).otherwise(10).alias("token_count"))
    good, bad, seen = FX.write_apart(FX.clause_fault(rows), str(tmp_path / "out"), [FX.MID_SENTENCE, FX.OVERSIZED])
    second = {r["fault"]: r["n"] for r in bad.groupBy("fault").agg(F.count("*").alias("n")).collect()}
    assert seen == {"rows": 1000, "kept": good.count(), **second} and second == {FX.MID_SENTENCE: 143, FX.OVERSIZED: 171}
    assert good.columns == ["id", "text", "token_count"] and good.filter("id % 7 = 0 or id % 5 = 0").count() == 0
    docs = D.parse(spark.createDataFrame([(1, "x " * 200), (2, "short"), (3, None)], "doc_id long, text string"))
    good, bad, seen = FX.write_apart(FX.document_fault(docs).drop("blocks"), str(tmp_path / "docs"), [FX.SCANNED, FX.EMPTY])
    assert [r["doc_id"] for r in good.collect()] == [1] and seen == {"rows": 3, "kept": 1, FX.SCANNED: 2, FX.EMPTY: 0}


def test_one_long_document_stays_many_rows(spark):
    """A document of many blocks: units are merged and terms found as in short ones, from rows and not from one array."""
    n = 60_000
    i = F.col("id")
    body = F.concat(F.lit("1."), i.cast("string"), F.when(i % 5 == 0, F.concat(F.lit(' "Term '), F.char(65 + i % 26), F.lit('" means a thing that is said here in more than twelve words, it is.'))).otherwise(" The term z is used."))
    block = F.struct(F.lit(1).alias("page"), i.cast("int").alias("line_no"), body.alias("text"), F.lit(11.0).alias("font_size"), F.lit(False).alias("bold"))
    b = spark.range(n).select(F.lit(0).cast("long").alias("row"), F.lit("d").alias("doc_id"), (i + 1).cast("int").alias("seq"), F.split(F.concat(F.lit("1."), i.cast("string")), r"\.").alias("path"), F.concat(F.lit("§1."), i.cast("string")).alias("label"), F.array(F.lit("a"), F.lit("b")).alias("trail"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), block["text"].alias("text"), F.lit(False).alias("is_definition"))
    rows = C.chunks(b).orderBy("vector_offset").collect()
    assert len(rows) == 3 * (n // 5) and [r["vector_offset"] for r in rows] == list(range(len(rows)))
    assert rows[0]["defined_terms"] == ["Term A"] and sum(len(r["defined_terms"]) for r in rows) >= n // 5 and {t for r in rows for t in r["defined_terms"]} <= {f"Term {chr(65 + i)}" for i in range(26)}


def test_values_at_ranks(spark):
    rng = np.random.default_rng(1)
    values = [*rng.normal(size=300).round(2).tolist(), *rng.lognormal(3, 4, 300).tolist(), 0.0, -0.0, 5e-324, 1e300, *[7.5] * 400]
    rows = [("a", v) for v in values] + [("b", 3.0), (None, 1.0), (None, 2.0), ("c", None)]
    names = {"low": lambda n: F.lit(1), "p50": E.nearest_rank(0.5), "p95": E.floor_index(0.95), "top": lambda n: n}
    got = {r["g"]: (r["low"], r["p50"], r["p95"], r["top"]) for r in E.values_at(spark.createDataFrame(rows, "g string, v double"), "g", "v", names).collect()}
    x = sorted(values)
    assert got == {"a": (x[0], x[math.ceil(len(x) * 0.5) - 1], x[math.floor(len(x) * 0.95)], x[-1]), "b": (3.0,) * 4, None: (1.0, 1.0, 2.0, 2.0)}


def test_assertions_and_gold(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "q1", "assertion": "x", "goldChunkIds": ["a"], "acceptableChunkIds": ["b", "a"], "expectedStance": "supports", "adversarial": false, "note": ""}\n{"id": "q2", "assertion": "y", "goldChunkIds": ["a"], "acceptableChunkIds": ["b"], "adversarial": true}\n')
    rows = files.read_assertions(spark, str(tmp_path / "a.jsonl"))
    got = {r[0]: r[1] for r in rows.select("id", E.gold_ids(F.col("goldChunkIds"), F.col("acceptableChunkIds"), F.col("adversarial"))).collect()}
    assert got == {"q1": ["a", "b"], "q2": ["a"]}


def test_speech_seam(spark):
    class Loud:
        def transcribe(self, samples, prompt):
            return f"{prompt}{samples.max():.1f}", 2.0

    df = spark.createDataFrame([([0.5, 0.25],), ([1.0],)], "samples array<float>")
    assert sorted(r[0]["text"] for r in df.select(speech.transcribe_with(Loud, "max ")("samples")).collect()) == ["max 0.5", "max 1.0"]
    with pytest.raises(Exception, match="no speech model"):
        df.select(speech.transcribe_with()("samples")).collect()
    vectors = df.select(V.embed_with(lambda: V.HashedWords(8))(F.lit("a b a")).alias("v")).first()["v"]
    assert len(vectors) == 8 and abs(sum(x * x for x in vectors) - 1) < 1e-3


def frame_counter():
    """Makes a recogniser that counts the frames it gets and takes 300 ms; tasks get its code, as they can't import tests."""

    class Frames:
        def transcribe(self, samples, prompt):
            return f"{len(samples) // 512} frames", 300.0

    return Frames


def streamed(spark, df, make, path, name):
    """All rows of a query over df as a stream of three micro-batches, in Arrow batches of few rows."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rows = df.orderBy("at").collect()
    try:
        for k in range(3):
            part = rows[k * len(rows) // 3 : (k + 1) * len(rows) // 3]
            spark.createDataFrame(part[::-1], df.schema).coalesce(1).write.parquet(str(path / "in" / f"p{k}"))
            time.sleep(1.1)  # files are taken in order of their times
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(path / "in"))
        make(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(path / "c")).trigger(availableNow=True).start().awaitTermination(100)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    return sorted(map(tuple, spark.table(name).collect()), key=repr)


def talk(spark):
    rng, rows = np.random.default_rng(2), []
    for stream in (1, 2):
        loud = np.repeat(rng.random(12) < 0.5, 40)
        for i, on in enumerate(loud.tolist()):
            rms = float(rng.uniform(0.1, 0.4)) if on else 0.001
            rows.append((stream, 32.0 * i + stream, rms, [rms] * 512))
    return spark.createDataFrame(rows, "stream_id long, at double, rms double, samples array<float>")


def test_utterances_in_batch_and_stream(spark, tmp_path):
    frames = talk(spark)
    got = sorted(map(tuple, U.utterances(frames, frame_counter()).collect()), key=repr)
    final = [g for g in got if not g[-1]]
    ends = [r for r in vad.segments(frames.drop("samples")).collect() if r["type"] == "speechEnd"]
    assert len(final) == len(ends) > 2 and {(g[0], g[2]) for g in final} == {(r["stream_id"], r["at"]) for r in ends}
    for g in got:
        if g[-1]:  # a partial decode begins every 750 ms at most, and is done 300 ms later
            whole = next(f for f in final if f[:3] == g[:3])
            assert 0 < int(g[4].split()[0]) < int(whole[4].split()[0]) and whole[6] - g[6] >= 300 - 32
    assert streamed(spark, frames, lambda s: U.stream_utterances(s, frame_counter()), tmp_path, "utterances_out") == got


def test_short_utterances_have_no_partial_result(spark):
    rows = [(1, 32.0 * i, 0.3 if i < 8 else 0.001, [0.3] * 512) for i in range(60)]
    got = U.utterances(spark.createDataFrame(rows, "stream_id long, at double, rms double, samples array<float>"), frame_counter(), U.SessionConfig(partial_ms=10_000)).collect()
    assert [(r["is_provisional"], r["start"], r["text"]) for r in got] == [(False, 0.0, "26 frames")]


def test_segments_over_several_batches(spark, tmp_path):
    frames = talk(spark).drop("samples")
    got = sorted(map(tuple, vad.segments(frames).collect()), key=repr)
    assert streamed(spark, frames, vad.stream_segments, tmp_path, "segments_out") == got


def test_streams_that_forget(spark, tmp_path):
    frames = talk(spark).drop("samples")
    frames.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = vad.stream_segments(spark.readStream.schema(frames.schema).parquet(str(tmp_path / "in")), ttl_ms=3_600_000).writeStream.format("memory").queryName("forgetful").option("checkpointLocation", str(tmp_path / "c")).start()
    want = vad.segments(frames).count()
    for _ in range(60):
        time.sleep(0.5)
        if spark.table("forgetful").count() == want:
            break
    q.stop()
    assert spark.table("forgetful").count() == want


def test_written_tables_need_a_shared_folder(spark):
    class Far:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        tables.shared_dir(Far)
    df = tables.cut(spark.range(5), "five")
    assert df.count() == 5
    folder = df.inputFiles()[0].rpartition("/")[0].removeprefix("file://")
    tables.discard(df)
    assert not os.path.exists(folder)


def test_tables_left_over_are_swept(spark):
    kept, gone = (tables.cut(spark.range(5), "sweep-test") for _ in range(2))
    folders = [df.inputFiles()[0].rpartition("/")[0].removeprefix("file://") for df in (kept, gone)]
    tables.discard(gone)
    assert kept.count() == 5 and [os.path.isdir(f) for f in folders] == [True, False]
    rest = {k: v for k, v in tables._left.items() if "sweep-test" not in k}
    for k in rest:
        del tables._left[k]
    tables.sweep()
    tables._left.update(rest)
    assert not os.path.isdir(folders[0]) and not any("sweep-test" in k for k in tables._left)
