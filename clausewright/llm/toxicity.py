"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, trained from document labels.

A document is a bag of sentences. A sentence's score is a logistic function of its words; a document is toxic
with probability 1 - prod(1 - score). Only documents carry labels, and the gradient of their likelihood tells which
sentences they owe it to, so the trained model also locates the offending sentences.

The fit uses at most FIT_ROWS labelled rows of each class, of texts up to FIT_CHARS, taken in order of a hash of their id; the rest of
the work, scoring, runs over every row in parallel with the model's word weights as a broadcast of bounded size.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm.common import free, table, with_python

#: Labelled rows of each class, and features, that a fit uses at most; rows with longer texts take no part in it, so what the driver gets is bounded.
FIT_ROWS, FIT_WORDS, FIT_CHARS = 1500, 2000, 50_000
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
TOKEN = re.compile(r"[^\W\d_]+")


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of each run up to a full stop, mark or line end that has words."""
    return [(m.start(), m.end(), w) for m in SENTENCE.finditer(text) if (w := TOKEN.findall(m[0].lower()))]


def features(word: str) -> list[str]:
    """The word, and its beginnings of three to six letters, marked: word forms that share a stem share those."""
    return [word, *(word[:n] + "^" for n in range(3, min(6, len(word)) + 1))]


class _Weights(dict):
    """Weight of a word as the sum of its features', kept for words seen."""

    def __init__(self, known: dict[str, float]) -> None:
        self.known = known

    def __missing__(self, word: str) -> float:
        if len(self) >= 50_000:
            self.clear()
        self[word] = x = sum(self.known.get(f, 0.0) for f in features(word))
        return x


class Model:
    """Feature weights and a bias; a word's repeats in a sentence count once."""

    def __init__(self, weights: dict[str, float], bias: float) -> None:
        self.weights, self.bias = weights, bias

    def __getstate__(self) -> tuple:
        return self.weights, self.bias

    def __setstate__(self, state: tuple) -> None:
        self.weights, self.bias = state
        self.words = _Weights(self.weights)

    @property
    def of_word(self):
        if not hasattr(self, "words"):
            self.words = _Weights(self.weights)
        return self.words.__getitem__

    def sentence_scores(self, text: str) -> list[tuple[int, int, float]]:
        return [(a, b, 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + sum(map(self.of_word, set(words)))))))) for a, b, words in sentences(text)]

    def score(self, text: str) -> float:
        """Noisy-or over the sentences; 0 for a text without any."""
        get, log = self.of_word, 0.0
        for part in SENTENCE.findall(text.lower()):
            words = TOKEN.findall(part)
            if words:
                log -= math.log1p(math.exp(min(30.0, self.bias + sum(map(get, set(words))))))
        return min(1.0, max(0.0, 1.0 - math.exp(log)))


def fit_bags(texts: list[str], labels: list[int], words: int = FIT_WORDS, steps: int = 200, rate: float = 0.15, decay: float = 1e-4) -> Model:
    """Maximum likelihood of document labels under noisy-or, by Adam on full batches.

    Features are those in at least three documents, the most telling first by the absolute log ratio of their shares
    in the two classes. Both classes weigh alike. Without both labels there is nothing to tell apart, and every score is near 0.
    """
    if len(set(labels)) < 2:
        return Model({}, -12.0)
    bags = [[sorted(set(w)) for _, _, w in sentences(t)] for t in texts]
    y = np.array([float(v) for v, b in zip(labels, bags, strict=True) if b])
    bags = [b for b in bags if b]
    seen: dict[str, list[int]] = {}
    for bag, label in zip(bags, y, strict=True):
        for w in {f for s in bag for w in s for f in features(w)}:
            seen.setdefault(w, [0, 0])[int(label)] += 1
    n1, n0 = max(1.0, y.sum()), max(1.0, (1 - y).sum())
    telling = lambda w: abs(math.log((seen[w][1] + 0.5) / (n1 + 1)) - math.log((seen[w][0] + 0.5) / (n0 + 1))) * math.sqrt(sum(seen[w]))
    chosen = {w: i for i, w in enumerate(sorted((w for w in seen if sum(seen[w]) >= 3), key=lambda w: (-telling(w), w))[:words])}

    word, sentence, document, k = [], [], [], 0
    for d, bag in enumerate(bags):
        for s in bag:
            known = [chosen[f] for w in s for f in features(w) if f in chosen]
            word += known
            sentence += [k] * len(known)
            document.append(d)
            k += 1
    word_, sentence_, document_ = (np.array(x, dtype=np.int64) for x in (word, sentence, document))
    weight = np.where(y > 0, 0.5 / n1, 0.5 / n0)
    theta = np.zeros(len(chosen) + 1)
    theta[-1] = -5.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        z = np.clip(theta[-1] + np.bincount(sentence_, weights=theta[word_], minlength=k), -30, 30)
        soft, prob = np.logaddexp(0, z), 1 / (1 + np.exp(-z))
        q = np.bincount(document_, weights=soft, minlength=len(y))  # -log of the chance that no sentence is toxic
        slope = weight * np.where(y > 0, -np.exp(-q) / np.maximum(-np.expm1(-q), 1e-9), 1.0)
        gz = slope[document_] * prob
        grad = np.append(np.bincount(word_, weights=gz[sentence_], minlength=len(chosen)), gz.sum())
        grad[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model({w: float(theta[i]) for w, i in chosen.items() if abs(theta[i]) > 0.05}, float(theta[-1]))


def held_out(doc_id):
    """Rows that never take part in a fit: crc32 of the id as text, mod 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """A model from at most `rows` labelled rows of each class that aren't held out.

    Which rows follows from a hash of their ids, so every run learns the same. Several labels of one id: the largest counts; null
    labels, null texts and texts of over FIT_CHARS characters take no part.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    ids = known.filter(~held_out(F.col("doc_id"))).withColumn("h", F.xxhash64("doc_id"))
    few = ids.filter("toxic = 1").orderBy("h", "doc_id").limit(rows).unionByName(ids.filter("toxic = 0").orderBy("h", "doc_id").limit(rows))
    sample = docs.select("doc_id", "text").filter(F.length("text") <= FIT_CHARS).join(F.broadcast(few), "doc_id")  # at most 2 * rows ids
    # A row or two an id are expected; repeated rows of one id beyond that don't enter the bounded fit.
    got = sample.orderBy("h", "doc_id", F.xxhash64("text")).limit(4 * rows).select("text", "toxic").collect()
    return fit_bags([r["text"] for r in got], [r["toxic"] for r in got])


def score_toxicity(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and worst, the (start, stop, score) of the sentence that counts most, for every row.

    Texts that are null, empty or without words score 0 and have no worst sentence. Rows are scored alone, whole; repeated rows and
    null ids give a row each, an empty table none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FIT_WORDS weights

    def run(texts: list[str]) -> dict:
        m = shared.value
        scores = [m.score(t) for t in texts]
        worst = [max(m.sentence_scores(t), key=lambda s: (s[2], -s[0]), default=None) if p >= 0.5 else None for t, p in zip(texts, scores, strict=True)]
        return {"score": scores, "worst": [w and {"start": w[0], "stop": w[1], "score": w[2]} for w in worst]}

    ready = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("t"))
    return with_python(ready, "t", run, "score double, worst struct<start:long,stop:long,score:double>")


def drop_toxic(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """docs without the rows that score at least limit; the columns stay, whatever their names.

    Rows are judged alone by their text: null and empty texts score 0 and stay, rows of one id or without one don't touch each other, and repeated rows go
    or stay together. An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    t, score = free(docs, "__t"), free(docs, "__score")
    scored = with_python(docs.withColumn(t, F.coalesce("text", F.lit(""))), t, lambda texts: {score: [shared.value.score(x) for x in texts]}, f"{score} double")
    return scored.filter(F.col(score) < limit).drop(score)


def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst")
