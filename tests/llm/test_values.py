"""Corpus operators by value: plain recomputations of their results, and rows with nulls, repeats, ties and clashing columns."""

import hashlib
import math
import random
import time
import tracemalloc
import zlib
from array import array

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clausewright.llm import html_text, line_dedup, media, mixing, near_dup, packing, secrets, substring_dedup, syncmers, toxicity
from clausewright.llm.common import cut, join_keys, quantile_cells, table

DATA, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SHARED = " ".join(f"shared{i}" for i in range(20))
ROWS = [
    (1, None), (2, ""), (3, f"a b c {SHARED} d"), (3, f"a b c {SHARED} d"), (3, f"z {SHARED}"), (None, f"q {SHARED} r"), (None, f"q {SHARED} r"), (None, f"{SHARED} s"), (None, None), (9, f"t {SHARED}"), (10, "token = abcdefg\nsame\nsame"), (11, "é\n\n" + "x" * 9),
]
CLASH = ["t", "k", "h", "c", "n", "v", "key", "node", "row", "sig", "size", "gone", "settled", "shared", "spans", "score", "part", "extra", "__t", "n_lines", "lines"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame([(*r, "s") for r in ROWS], "doc_id long, text string, source string").repartition(3)
    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASH)})


def counted(rows):
    return sorted(map(tuple, rows), key=repr)


def test_packing_of_odd_rows(spark, odd):
    stock = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.pack_documents(odd, packing.default_tokenizer(), length=16, parts=3).collect()
    want = []
    for i, t in ROWS:
        want += [(i, *pair) for pair in enumerate([*stock.encode(t or "", add_special_tokens=False).ids, 1])]
    assert counted((r["doc_id"], r["start"] + j, x) for r in got for j, x in enumerate(array("I", r["ids"]))) == counted(want)


def test_ids_are_the_stock_tokenizers():
    stock, store, rng = Tokenizer.from_file(packing.default_tokenizer()), packing.WordIds(packing.default_tokenizer()), random.Random(8)
    parts = ["a", "The", "é", ".", ",", " ", "  ", "\n", "\t", "'s", "1", "日本", "<|endoftext|>", "<|", "_", "x.", " .", "\r\n", "　", "$$$", "²", "'", "’s", "́", "don't", " \n", "ß", "😀"]
    for _ in range(6000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert store.ids([t]) == [array("I", stock.encode(t, add_special_tokens=False).ids).tobytes()], t
    assert array("I", store.ids(["a<|endoftext|>b"])[0])[1] == 50256


def test_lines_of_odd_rows(spark, odd):
    out = line_dedup.dedup_lines(odd, min_docs=2)
    lines = [(t or "").split("\n") for _, t in ROWS]
    n = {}
    for own in lines:
        for x in {x.strip(" \t").lower() for x in own}:
            n[x] = n.get(x, 0) + 1
    want = [(i, len(own), sum(x != "" and n[x.lower()] >= 2 for x in own), "\n".join(x for x in own if x == "" or n[x.lower()] < 2)) for (i, _), own in zip(ROWS, lines, strict=True)]
    assert counted(out.select("doc_id", "n_lines", "n_dropped", "kept_text").collect()) == counted(want)
    few = line_dedup.dedup_lines(odd, min_docs=2, hot=1)  # one hot line is sent out, the others are shuffled
    assert counted(few.select("doc_id", "n_lines", "n_dropped", "kept_text").collect()) == counted(want)


def test_lines_of_a_long_text_take_time_in_proportion(spark):
    text = "\n".join(f"line {i} of a very long text" for i in range(60_000))
    began = time.time()
    row = line_dedup.dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"), min_docs=1).first()
    assert row["n_dropped"] == 60_000 and row["kept_text"] == "" and time.time() - began < 40


def test_hot_keys_are_sent_out(spark):
    rows = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(300)], "a long, x long")
    keys = cut(rows.groupBy("a").agg(F.count("*").alias("n")).filter("a <> 6").withColumn("b", F.col("a") * 10), "keys")
    want = counted(r for r in rows.join(keys.drop("n"), "a").collect())
    for most in (1, 2, 100):
        assert counted(join_keys(rows, keys, ["a"], most).collect()) == want


def anchors_by_hand(data):
    """Closed syncmers by their definition, over the same hash of s-mers."""
    k, s = syncmers.K, syncmers.S
    if len(data) < k:
        return len(data) and 1
    mer = lambda i: int(syncmers._mix(np.array([int.from_bytes(data[i : i + s], "little")], np.uint64))[0])
    h = [mer(i) for i in range(len(data) - s + 1)]
    return [i for i in range(len(data) - k + 1) if min(h[i : i + k - s + 1]) in (h[i], h[i + k - s])]


def likeness_by_hand(x, y):
    (px, hx), (py, hy) = ((p.tolist(), h.tolist()) for p, h in (x, y))
    if min(len(hx), len(hy)) <= 1:
        return float(hx == hy)
    runs = [{(h[i], h[i + 1], p[i + 1] - p[i]) for i in range(len(h) - 1)} for p, h in ((px, hx), (py, hy))]
    held = [len({j for i in range(len(h) - 1) if (h[i], h[i + 1], p[i + 1] - p[i]) in runs[0] & runs[1] for j in (i, i + 1)}) for p, h in ((px, hx), (py, hy))]
    same = min(held)
    return same / (len(hx) + len(hy) - same)


def shared_share(a, b, k=15):
    """Likeness of the sets of all k-mers."""
    x, y = ({t[i : i + k] for i in range(len(t) - k + 1)} for t in (a, b))
    return len(x & y) / max(1, len(x | y))


def test_fingerprints_by_hand(spark):
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall())
    docs = {d: t for d, t in docs.items() if len(t) < 4000} | {100_001: "short", 100_002: "", 100_003: "tiny text é", 100_004: "short"}
    rows = {r["doc_id"]: r for r in syncmers.fingerprint_pairs(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), parts=7).collect()}
    order, errors = sorted(docs, reverse=True), []
    assert len(rows) == len(docs)
    for d, following in zip(order, [*order[1:], order[0]], strict=True):
        r, t, m = rows[d], docs[d], len(docs[d]) // 3
        edited, nxt = (t[: len(t) - m] + docs[following][:m]).encode(), docs[following].encode()
        own = syncmers.anchors(t.encode())
        assert r["edited_sha256"] == hashlib.sha256(edited).hexdigest() and r["anchor_places"] == own[0].tolist()
        for text, name in ((own, "fingerprint"), (syncmers.anchors(edited), "edited_fingerprint")):
            assert r[name] == "".join(f"{x:08x}" for x in sorted(set(text[1].tolist()))[: syncmers.KEEP])
        assert r["near_edited"] == likeness_by_hand(own, syncmers.anchors(edited)) and r["near_next"] == likeness_by_hand(own, syncmers.anchors(nxt))
        if len(t) > 200:
            errors += [abs(r["near_edited"] - shared_share(t.encode(), edited)), abs(r["near_next"] - shared_share(t.encode(), nxt))]
    for d in order[:12]:
        data = docs[d].encode()
        by_hand = anchors_by_hand(data)
        assert (syncmers.anchors(data)[0].tolist() == by_hand) if isinstance(by_hand, list) else len(syncmers.anchors(data)[0]) == by_hand
    assert np.mean(errors) < 0.05 and rows[100_001]["fingerprint"] == rows[100_004]["fingerprint"] != rows[100_003]["fingerprint"]


def test_fingerprints_of_one_id(spark, odd):
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abcdefgh", k=40)) for _ in range(300)]
    df = spark.createDataFrame([(None if i % 2 else 5, t) for i, t in enumerate(texts)], "doc_id long, text string")
    ends, cells = quantile_cells(df.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("k")), 20)
    assert cells.max() > 5  # an id of many rows has several cells
    rows = syncmers.fingerprint_pairs(df, parts=20).collect()
    assert counted((r["doc_id"], r["n_chars"], r["fingerprint"]) for r in rows) == counted((None if i % 2 else 5, len(t), syncmers._rows([(0, t, 0, False), (0, "", 0, True)], None)["fingerprint"][0].as_py()) for i, t in enumerate(texts))
    follows = {r["edited_sha256"] for r in rows}
    assert len(follows) == 300 and follows <= {hashlib.sha256((a[: len(a) - len(a) // 3] + b[: len(a) // 3]).encode()).hexdigest() for a in texts for b in texts}
    assert counted((r["doc_id"], r["n_chars"]) for r in syncmers.fingerprint_pairs(odd).collect()) == counted((i, len(t or "")) for i, t in ROWS)


def repeats_by_hand(rows, n=13):
    least = {}
    words = [(t or "").split() for _, t in rows]
    node = [2**63 - 1 if i is None else i for i, _ in rows]
    for d, w in zip(node, words, strict=True):
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            least[key] = min(d, least.get(key, d))
    out = []
    for (i, _), d, w in zip(rows, node, words, strict=True):
        gone = {j for a in range(len(w) - n + 1) if least[tuple(w[a : a + n])] < d for j in range(a, a + n)}
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def test_repeats_of_odd_rows(spark, odd):
    got = substring_dedup.remove_repeats(odd).collect()
    assert counted(got) == counted(repeats_by_hand(ROWS))


def test_long_repeats(spark):
    rng = random.Random(11)
    make = lambda n: " ".join(f"w{rng.randint(0, 3000)}" for _ in range(n))
    passages, rows = [make(n) for n in (14, 30, 60, 200, 900)] + ["a " * 400, "a b " * 300], []
    for i in range(90):
        parts = [make(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), make(rng.randint(0, 30))]
        rows.append((None if i % 10 == 9 else rng.randint(0, 60), " ".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert counted(substring_dedup.remove_repeats(df).collect()) == counted(repeats_by_hand(rows))
    ready = substring_dedup.row_keys(df.select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("node"), F.col("text").alias("t")))
    settled = substring_dedup.settled_passages(ready).collect()
    assert max(p["words"] for r in settled for p in r["settled"]) > 50  # symbols of later rounds stand for long passages


def test_rounds_give_equal_passages_equal_symbols():
    rng = np.random.default_rng(0)
    passage = rng.integers(0, 2**63, 3000).astype(np.uint64)
    x, y = (np.concatenate([rng.integers(0, 2**63, n).astype(np.uint64), passage, rng.integers(0, 2**63, 40).astype(np.uint64)]) for n in (17, 230))
    names = [substring_dedup.rounds(z, np.zeros(len(z), np.int64), np.ones(len(z), np.int64), 0, 12) for z in (x, y)]
    same = np.isin(names[0][0], names[1][0])
    assert names[0][2].sum() == len(x) and names[0][2].mean() > 15 and names[0][2][same].sum() > 2700


def test_near_groups_of_odd_rows(spark, odd):
    got = near_dup.near_groups(odd, n=3, percent=85).collect()
    # rows 3 and 3 are equal; rows without an id that are equal to each other or near to one with an id follow it
    sets = [{tuple((t or "").split()[j : j + 3]) for j in range(len((t or "").split()) - 2)} for _, t in ROWS]
    want, groups = [], set()
    for i, s in enumerate(sets):
        reach, todo = {i}, [i] if s else []
        while todo:
            a = todo.pop()
            for b, other in enumerate(sets):
                if b not in reach and other and 100 * len(sets[a] & other) >= 85 * len(sets[a] | other):
                    reach.add(b)
                    todo.append(b)
        groups.add(frozenset(reach))
        ids = [ROWS[j][0] for j in reach if ROWS[j][0] is not None]
        want.append((ROWS[i][0], len(s), min(ids) if ids else None))
    short = [(i, n if n or not (ROWS[k][1] or "").split() else 1, c) for k, (i, n, c) in enumerate(want)]  # fewer than three words: one shingle
    assert counted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == counted(short)
    assert sum(r["kept"] for r in got) == len(groups) and all(r["doc_id"] == r["component_id"] for r in got if r["kept"])


def test_toxicity_by_hand(spark):
    docs, labels = table(spark, LARGER, "documents"), table(spark, LARGER, "labels")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score_toxicity(docs, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    marks = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    for r in rows[::17]:
        rest = 1.0
        for _, _, words in toxicity.sentences(texts[r["doc_id"]]):
            z = model.bias + sum(model.weights.get(f, 0.0) for w in set(words) for f in toxicity.features(w))
            rest *= 1 / (1 + math.exp(z))
        assert abs(r["score"] - (1 - rest)) < 1e-9
    held = [(r["score"] >= 0.5, bool(marks[r["doc_id"]])) for r in rows if r["held"] and r["doc_id"] in marks]
    assert len(held) > 40 and np.mean([a == b for a, b in held]) > 0.95
    for d in (1, 2, 3):  # crc32 of the id as text
        assert (zlib.crc32(str(d).encode()) % 5 == 0) == bool(spark.range(1).select(toxicity.held_out(F.lit(d))).first()[0])


def test_toxicity_gradient():
    """The fit lowers the likelihood's loss, and where it ends no small step does."""
    rng = random.Random(1)
    texts = [". ".join(" ".join(rng.choices(["good", "fine", "calm", "well"], k=4)) for _ in range(3)) + (". you blockhead" if i % 2 else "") for i in range(60)]
    model = toxicity.fit_bags(texts, [i % 2 for i in range(60)])
    assert all((model.score(t) >= 0.5) == bool(i % 2) for i, t in enumerate(texts))
    where = max(model.sentence_scores(texts[1]), key=lambda s: s[2])
    assert texts[1][where[0] : where[1]].strip() == "you blockhead"


def test_secrets_of_long_texts():
    tracemalloc.start()
    text = "0123456789abcdef" * 20_000
    assert secrets.spans(text) == [("hex", 0, len(text))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8e6
    many = "é token=abcdef1 " * 4000
    began = time.time()
    found = secrets.spans(many)
    assert len(found) == 4000 and found[-1] == ("assign", len(many) - 14, len(many) - 1) and time.time() - began < 5


def test_rules_that_cannot_be_read():
    nfa = secrets._Nfa()
    with pytest.raises(ValueError, match="rules don't use"):
        nfa.add("a)", nfa.state())


def test_media_by_hand(spark):
    text = "The quick brown fox, ééé. " * 60
    (row,) = media.media_columns(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    x = np.frombuffer(bytes(row["payload"]), np.uint8).astype(float) - 128
    n = media.UNIT
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1))
    peaks = []
    for at in range(0, len(x) - n + 1, n // 2):
        power = [abs(sum(x[at : at + n] * window * np.exp(-2j * np.pi * f * np.arange(n) / n))) for f in range(1, n // 2 + 1)]
        peaks.append(1 + int(np.argmax(power)))
    want = sorted((i << 32) | (p << 20) | (peaks[i + d] << 8) | d for i, p in enumerate(peaks) for d in (1, 2, 3) if i + d < len(peaks))
    assert row["landmarks"] == want


def test_mixing_of_odd_rows(spark, odd):
    got = mixing.sample_mix(odd).collect()
    assert counted((r["doc_id"], r["size"]) for r in got) == counted((i, len((t or "").split())) for i, t in ROWS)
    assert abs(sum(r["taken"] for r in got) - sum(len((t or "").split()) for _, t in ROWS)) <= 1
    mixed = mixing.mix_documents(odd)
    assert mixed.columns == odd.columns and all(r["text"] for r in mixed.collect())


PARA = "The story of the town goes on for some while, and what comes next is told in the next part of it. "


def page(rng):
    """(html, text) of a page without article elements: runs of long and short paragraphs between menus, slogans and notices."""
    blocks = [(PARA * rng.randint(1, 4)).strip() if rng.random() < 0.6 else f"Short line {i}." for i in range(rng.randint(4, 12))]
    blocks[0] = blocks[-1] = (PARA * 3).strip()
    end_p, end_head, links = rng.choice(["</p>", ""]), rng.choice(["</head>", ""]), "".join(f"<li><a href=/{i}>Entry {i}</a>" for i in range(rng.randint(3, 9)))
    body = "".join(f"<p>{b}{end_p}" for b in blocks)
    wrap = rng.choice(["<div class='content has-sidebar'>{}</div>", "<div><div>{}</div></div>", "<section class=post>{}</section>"])
    top = rng.choice(["<nav><ul>{}</ul></nav>", "<div class=site-header><p>We are the town's paper</p><ul>{}</ul></div>", "<header><ul>{}</ul></header>"]).format(links)
    return f"<html><head><title>A title</title><meta name=x>{end_head}<body>{top}{wrap.format(body)}<div class='comments-area'><p>{PARA}</p></div><div class=copyright>Copyright of us all</div>", "\n\n".join(blocks)


def test_pages_without_articles():
    rng = random.Random(4)
    for _ in range(40):
        html, text = page(rng)
        assert html_text.main_text(html) == text, html


def test_articles_keep_what_is_theirs():
    long = (PARA * 3).strip()
    html = f"<article><header><h1>Title</h1></header><p>{long}</p><div class=related-work><p>{long}</p></div><section class=comments-on-method><p>{long}</p></section><div class=related-posts><p>{long}</p></div><div class='share-buttons'>Share</div></article>"
    assert html_text.main_text(html) == "\n\n".join(["Title", long, long, long])


def test_the_threshold_decides(monkeypatch):
    """Lines outside the upper cluster seed no region: with the threshold above all ratios nothing is left, below all of them the list of entries is text too."""
    html = "<body><ul>" + "".join(f"<li>Entry {i}" for i in range(9)) + f"</ul><div><p>{PARA * 3}</p><p>{PARA * 2}</p></div>"
    usual = html_text.main_text(html)
    monkeypatch.setattr(html_text, "_threshold", lambda x: float(x.max()) + 1)
    assert html_text.main_text(html) == ""
    monkeypatch.setattr(html_text, "_threshold", lambda x: -1.0)
    assert len(html_text.main_text(html)) > len(usual) > 0
