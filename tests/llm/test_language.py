"""Language labels against plain dynamic programming, on mixed texts, other scripts, odd rows, and by held-out accuracy."""

import itertools
import random
import unicodedata
import zlib

import numpy as np
import pandas as pd

from clausewright.llm import language as L

SCHEMA = "doc_id long, text string, lang string, score double, t string"
WORDS = {"aa": ["thing", "the", "with", "which", "another"], "bb": ["schön", "über", "nicht", "zwischen", "und"], "cc": ["привет", "мир", "это", "слово"]}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 0.5, "t") for i, t, lang in rows], SCHEMA)


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def fitted(spark, extra=()):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang, 60), lang) for i, lang in enumerate(itertools.islice(itertools.cycle(WORDS), 120))]
    return L.fit(frame(spark, [*rows, *extra]))


def plain_labels(scores):
    """The best sequence by trying, for each word and language, every language before it; ties go to staying, then to the first."""
    n, k = scores.shape
    best, back = [list(scores[0])], []
    for t in range(1, n):
        now, way = [], []
        for j in range(k):
            ways = [(best[-1][i] - (L.PENALTY if i != j else 0), i == j, -i, i) for i in range(k)]
            way.append(max(ways)[3])
            now.append(max(ways)[0] + scores[t, j])
        best.append(now)
        back.append(way)
    at = int(np.argmax(best[-1]))
    out = [at]
    for way in reversed(back):
        out.append(at := way[at])
    return out[::-1], max(best[-1])


def total(scores, label):
    return sum(scores[t, j] for t, j in enumerate(label)) - L.PENALTY * sum(a != b for a, b in itertools.pairwise(label))


def test_labels_equal_plain_programming():
    rng = np.random.default_rng(2)
    for k in (2, 3, 5):
        model = L.Model([str(i) for i in range(k)], np.ones((k, L.BUCKETS)), np.ones((k, len(L.NAMES))), np.ones(k))
        size = [1, 7, 30, 2, 1, 200, 30]
        text = np.repeat(np.arange(len(size)), size)
        drift = np.repeat(rng.integers(0, k, len(text) // 10 + 1), 10)[: len(text)]
        scores = -rng.random((len(text), k)) * 6
        scores[np.arange(len(text)), drift] += 3
        got = model.labels(scores, text)
        for t in range(len(size)):
            own = scores[text == t]
            want, best = plain_labels(own)
            mine = got[text == t].tolist()
            assert abs(total(own, mine) - best) < 1e-9 and (mine == want or len(set(mine)) > 1)
        assert any(len(set(got[text == t])) > 1 for t in range(len(size)))


def plain_words(text):
    out, at = [], 0
    while at < len(text):
        end = at
        while end < len(text) and unicodedata.category(text[end])[0] in "LM":
            end += 1
        if end > at and any(unicodedata.category(c)[0] == "L" for c in text[at:end]):
            out.append((at, end))
        at = max(end, at + 1)
    return out


def test_words_and_pieces(monkeypatch):
    texts = ["", "Ab1cd-Éa ́x\n\nमें हूँ 日本語かな", "123 ...", "one", "́́ \U00020000x ", "İstanbul ǅ"]
    want = [(i, *span) for i, t in enumerate(texts) for span in plain_words(t)]
    for piece in (1, 4, 10, 2**20):
        monkeypatch.setattr(L, "PIECE", piece)
        got = [row for w in L.words_of(texts) for row in zip(*(x.tolist() for x in w.places()), strict=True)]
        assert got == want, piece
    w = next(iter(L.words_of(["abc мир 日本 ü"])))
    assert [L.NAMES[i] for i in w.script] == ["latin", "cyrillic", "han", "latin"]


def test_scores_of_words_equal_counts(spark):
    """A word's score is the sum of its runs' log probabilities, whatever else is in the batch; scripts leave candidates out."""
    model = fitted(spark)
    assert model.langs == ["aa", "bb", "cc"]
    one = {w: model.word_scores(next(L.words_of([w])))[0] for w in ("the", "über", "слово", "xyz")}
    many = model.word_scores(next(L.words_of(["the über", "слово xyz"])))
    assert np.allclose(many, [one["the"], one["über"], one["слово"], one["xyz"]])
    assert one["слово"][:2].max() == L.NEVER and one["слово"][2] == 0 and one["the"][2] == L.NEVER and one["the"][0] == 0 > one["the"][1]


def test_mixed_texts_get_spans(spark):
    rng, model = random.Random(9), fitted(spark)
    a, b, c = prose(rng, "aa", 30), prose(rng, "bb", 12), prose(rng, "cc", 8)
    lang, score, spans = model.judge([f"{a}. {b} -- {c}!"])[0]
    assert lang == "aa" and 0.3 < score < 0.9 and [s[2] for s in spans] == ["aa", "bb", "cc"]
    assert abs(spans[0][1] - len(a)) < 12 and spans[2] == (len(a) + len(b) + 6, len(a) + len(b) + len(c) + 6, "cc")
    assert [s[2] for s in model.judge([f"{a} und {a}"])[0][2]] == ["aa"]  # one odd word doesn't break a span


def test_odd_rows(spark):
    model = fitted(spark, [(200, None, "aa"), (201, "", "bb"), (202, "12 34", "cc"), (203, "no language", None), (None, "thing with", "aa"), (None, "thing with", "aa")])
    long = prose(random.Random(3), "bb", 400_000)
    rows = [(1, None, None), (2, "", "aa"), (3, "12 , .\n", "aa"), (4, long, None), (5, "the", "bb"), (5, "the", "bb"), (None, "über", None), (6, "ελληνικά λόγια", None)]
    got = [tuple(r) for r in L.identify(frame(spark, rows), model).select("doc_id", "lang_pred", "score", "spans").collect()]
    by = sorted(got, key=str)
    assert len(by) == 8 and [r[1] for r in got if r[0] in (1, 2, 3)] == ["und"] * 3 and all(r[2] == 0 and r[3] == [] for r in got if r[1] == "und")
    of = lambda i: [r for r in got if r[0] == i]
    assert of(4)[0][1] == "bb" and [tuple(s) for s in of(4)[0][3]] == [(0, len(long), "bb")] and of(5)[0] == of(5)[1] and of(5)[0][1] == "aa" and of(None)[0][1] == "bb"
    assert of(6)[0][1] == model.langs[model.main] and 0 < of(6)[0][2] <= 0.5
    none = L.fit(frame(spark, [(1, "text", None)]))
    assert L.identify(frame(spark, rows), none).filter("lang_pred <> 'und' OR score <> 0").count() == 0
    assert L.identify(frame(spark, rows).limit(0), model).count() == 0


def test_query_is_right_on_held_out_rows(spark):
    got = L.op13_language(spark, "/root/testdata/sf0.01").toPandas()
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    both = got.merge(docs, on="doc_id")
    assert len(both) == len(docs) and (both["held_out"] == both["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    assert both["score"].between(0, 1).all() and set(both["lang_pred"]) <= {"en", "de", "fr", "es"}
    out = both[both["held_out"]]
    assert (out["lang"] == out["lang_pred"]).mean() > 0.99


def test_sample_of_a_fit_is_bounded(spark):
    rows = frame(spark, [(i, f"thing {i}", "aa") for i in range(3000)] + [(i, f"nicht {i}", "bb") for i in range(50)])
    model = L.fit(rows, rows=100)
    assert model.langs == ["aa", "bb"] and model.main == 0
