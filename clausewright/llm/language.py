"""Language identification: script ranges narrow the candidates, then Viterbi over per-word scores with a penalty for switching labels spans.

A word is a run of letters, and its script that of its first letter. Only languages that write this script to a telling share are candidates for it. A word's score in a language is the log
probability of its runs of one to three letters, edges of the word included, by their counts in texts of that language (naive Bayes over buckets of hashed runs). The best sequence of labels is
that of the highest sum of scores less a penalty for each change of language, so single odd words don't break a span while longer passages in another language do. A text's
language is the one whose spans have the most letters.

Counts are learned from a sample of at most some FIT_ROWS labelled texts a language, whole, by one aggregation; the model is languages x BUCKETS numbers. Texts are scored alone, in arrays:
all words of a slice of texts at once, and the labels of like long texts step by step side by side.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.llm.common import small_batches, table, with_python

FIT_ROWS = 2000  # labelled texts of a language that a fit expects to use; which ones follows from a hash of id and text
BUCKETS = 2**14
MOST_LANGS = 2000  # a model of more would not be small enough to send out
SMOOTH = 0.5  # added to each bucket's count
SHARE = 0.01  # least share of a language's letters that makes a script one of its own
PENALTY = 12.0  # nats for a change of language between two words
EVIDENCE = 0.5  # weight of a run's log probability, as runs of a word overlap
WORD = 20.0  # most that one word tells between languages of its script: less than two changes cost, so it alone breaks no span
NEVER = -1e9
PIECE = 2**20  # characters that are worked on at once

#: Scripts by ranges of code points (first, last); letters elsewhere are of one script, "other".
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "sinhala": [(0xD80, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "lao": [(0xE80, 0xEFF)],
    "tibetan": [(0xF00, 0xFFF)],
    "myanmar": [(0x1000, 0x109F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "ethiopic": [(0x1200, 0x137F)],
    "khmer": [(0x1780, 0x17FF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
NAMES = [*SCRIPTS, "other"]


@cache
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: 2 for letters, 1 for marks that go with them, else 0; the lower-case form where it is one character; the script."""
    kind, low, script = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32), np.full(0x110000, len(SCRIPTS), np.uint8)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        category = unicodedata.category(ch := chr(c))[0]
        if category in "LM":
            kind[c] = 2 if category == "L" else 1
            if len(lower := ch.lower()) == 1:
                low[c] = ord(lower)
    for i, ranges in enumerate(SCRIPTS.values()):
        for a, b in ranges:
            script[a : b + 1] = i
    return kind, low, script


class Words:
    """The words of some pieces of texts: starts and ends in their joined characters, the piece each belongs to, and their hashed runs of letters."""

    def __init__(self, texts: list[str], of: list[int], base: list[int]) -> None:
        """of and base: the text that each piece is from, and where in it. Pieces are told apart by a character between them that is no letter."""
        self.of, self.base = np.array(of, np.int64), np.array(base, np.int64)
        kinds, low, scripts = _characters()
        code = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "replace"), np.uint32)
        kind = kinds[code]
        inside = np.concatenate([[False], kind > 0, [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[::2], edge[1::2]
        has = np.add.reduceat((kind == 2).astype(np.int64), start) > 0 if len(start) else np.zeros(0, bool)  # up to the next word there is no letter
        start, end = start[has], end[has]
        begins = np.append(0, np.cumsum([len(t) + 1 for t in texts]))
        self.piece = np.searchsorted(begins, start, side="right") - 1
        self.start, self.end, self.begins = start, end, begins
        size = end - start
        place = np.arange(size.sum()) - np.repeat(np.append(0, np.cumsum(size))[:-1] - start, size)  # of each letter
        letter = low[code[place]].astype(np.uint64)
        first = np.zeros(len(letter), bool)
        last = first.copy()
        ends = np.cumsum(size)
        first[ends - size], last[ends - 1] = True, True
        before = np.append(np.uint64(0), letter[:-1]) if len(letter) else letter
        after = np.append(letter[1:], np.uint64(0)) if len(letter) else letter
        before[first], after[last] = 0, 0  # the edge of a word counts as a letter of its own
        mix = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(BUCKETS)
        shift = np.uint64(21)
        self.runs = np.stack([mix(letter), mix((before << shift | letter) + np.uint64(1 << 62)), mix((before << np.uint64(42)) | (letter << shift) | after | np.uint64(1 << 63))], axis=1).astype(np.int64)
        # A word's script is that of its first letter (marks may stand before it).
        head = start if not len(start) else start + np.where(kind[start] == 2, 0, 1)
        self.script = scripts[code[np.minimum(head, len(code) - 1)]] if len(start) else np.zeros(0, np.uint8)

    def letters(self) -> np.ndarray:
        return self.end - self.start

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, end) of each word, within its text."""
        move = (self.base - self.begins[:-1])[self.piece]
        return self.of[self.piece], self.start + move, self.end + move


def words_of(texts: list[str]) -> Iterator[Words]:
    """The words of the texts in order, some PIECE characters at a time; long texts are cut between words."""
    kinds = _characters()[0]
    held: list[tuple[str, int, int]] = []
    size = 0
    for i, t in enumerate(texts):
        at = 0
        while at < len(t):
            end = min(len(t), at + PIECE)
            while end < len(t) and kinds[ord(t[end])]:
                end += 1
            held.append((t[at:end], i, at))
            size += end - at
            at = end
            if size >= PIECE:
                yield Words(*map(list, zip(*held, strict=True)))
                held, size = [], 0
    if held:
        yield Words(*map(list, zip(*held, strict=True)))


class Model:
    """Languages in order of their names, log probabilities of runs (BUCKETS x languages), which scripts each writes, and each one's share of the fitted texts."""

    def __init__(self, langs: list[str], runs: np.ndarray, scripts: np.ndarray, texts: np.ndarray) -> None:
        """runs, scripts: counts of each language (languages x BUCKETS, x scripts); texts: how many of each."""
        self.langs = langs
        n = runs + SMOOTH
        self.log = (np.log(n / n.sum(axis=1, keepdims=True)).T * EVIDENCE).astype(np.float64)
        self.writes = scripts >= SHARE * scripts.sum(axis=1, keepdims=True)
        self.writes &= scripts > 0
        self.main = int(np.argmax(texts)) if langs else -1

    def word_scores(self, w: Words) -> np.ndarray:
        """(words x languages) log probabilities, relative to each word's best, -WORD at least; NEVER for languages that don't write its script, where any does."""
        out = np.zeros((len(w.start), len(self.langs)))
        if not len(out):
            return out
        sizes = w.letters()
        begin = np.append(0, np.cumsum(sizes))[:-1]
        each = self.log[w.runs[:, 0]]
        for i in (1, 2):
            each += self.log[w.runs[:, i]]
        out[:] = np.add.reduceat(each, begin, axis=0)
        allowed = self.writes.T[w.script]
        out[~allowed & allowed.any(axis=1, keepdims=True)] = -np.inf
        out[~allowed.any(axis=1)] = 0.0  # a script that no language writes tells nothing
        out -= out.max(axis=1, keepdims=True)
        return np.where(np.isinf(out), NEVER, np.maximum(out, -WORD))

    def labels(self, scores: np.ndarray, text: np.ndarray) -> np.ndarray:
        """The best label of each word, texts apart: sum of scores less PENALTY for each change; of equally good ones the first language."""
        n, k = scores.shape
        out = np.zeros(n, np.int64)
        if not n or k == 1:
            return out
        begin = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        size = np.diff(np.append(begin, n))
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        alive = np.searchsorted(-size, -np.arange(size[0]), side="left")  # so many texts have a word at this step
        keeps, best = np.zeros((n, k), bool), np.zeros(n, np.int64)
        now = np.zeros((len(begin), k))
        for step in range(size[0]):
            m = alive[step]
            at = begin[:m] + step
            held = now[:m]
            if step:
                keeps[at] = stays = held >= -PENALTY
                held = np.where(stays, held, -PENALTY)
            held = held + scores[at]
            best[at] = top = held.argmax(axis=1)
            now[:m] = held - held[np.arange(m), top][:, None]
        label = np.zeros(len(begin), np.int64)
        for step in range(size[0] - 1, -1, -1):
            m = alive[step]
            at = begin[:m] + step
            ends = size[:m] - 1 == step
            if step + 1 < size[0]:
                m2 = alive[step + 1]
                nxt = begin[:m2] + step + 1
                stays = keeps[nxt, label[:m2]]
                label[:m2] = np.where(stays, label[:m2], best[at[:m2]])
            label[:m][ends] = best[at[ends]]
            out[at] = label[:m]
        return out

    def judge(self, texts: list[str]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """(language, score, spans of (start, end, language)) of each text; `und`, 0 and no spans without a letter or without a learned language.

        The score is the share of letters in the language's spans, times its probability by their words against the other languages. A text whose words tell nothing goes to the most common language.
        """
        n, k = len(texts), len(self.langs)
        out: list[tuple[str, float, list[tuple[int, int, str]]]] = [("und", 0.0, [])] * n
        parts = [(*w.places(), self.word_scores(w)) for w in words_of(texts)] if k else []
        if not parts:
            return out
        text, start, end, scores = (np.concatenate(x) for x in zip(*parts, strict=True))
        label, letters = self.labels(scores, text), end - start
        blank = np.bincount(text, (scores < 0).any(axis=1), n) == 0
        label[blank[text]] = self.main
        mine = np.bincount(text * k + label, letters, n * k).reshape(-1, k)
        chosen = mine.argmax(axis=1)
        own = label == chosen[text]
        sums = np.stack([np.bincount(text[own], np.maximum(scores[own, i], -700), n) for i in range(k)], axis=1)
        sums -= np.take_along_axis(sums, chosen[:, None], axis=1)
        probable = 1 / np.exp(np.minimum(sums, 700)).sum(axis=1)
        turn = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (label[1:] != label[:-1])))
        stop = np.append(turn[1:], len(label)) - 1
        for t in np.unique(text).tolist():
            c = int(chosen[t])
            out[t] = (self.langs[c], min(1.0, float(mine[t, c] / mine[t].sum() * probable[t])), [])
        for a, b in zip(turn.tolist(), stop.tolist(), strict=True):
            out[int(text[a])][2].append((int(start[a]), int(end[b]), self.langs[int(label[a])]))
        return out


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text, mod 3, is 1."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, rows: int = FIT_ROWS) -> Model:
    """A model from some `rows` texts of each language that aren't held out, whole, whatever their lengths.

    More than MOST_LANGS languages are an error. Which rows follows from a hash of id and text at a share that gives `rows` of them, so every run learns the same; equal rows count once. Rows without text, language or letters teach nothing.
    """
    known = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    kinds = counts.count()
    if kinds > MOST_LANGS:
        raise ValueError(f"{kinds} values of lang; a model holds {MOST_LANGS}")
    share = (F.xxhash64("doc_id", "text").bitwiseAND(2**31 - 1)) * F.col("n") < F.lit(rows) * 2**31
    some = known.join(F.broadcast(counts), "lang").filter(share).select("lang", "doc_id", "text").distinct().select("lang", "text")
    # One row a task, language and bucket at most.
    fields = "lang string, kind int, i int, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                mine = held.setdefault(lang, [np.zeros(BUCKETS, np.int64), np.zeros(len(NAMES), np.int64), np.zeros(1, np.int64)])
                for w in words_of([text]):
                    mine[0] += np.bincount(w.runs.reshape(-1), minlength=BUCKETS)
                    mine[1] += np.bincount(w.script, w.letters(), len(NAMES)).astype(np.int64)
                mine[2] += 1
        for lang, parts in held.items():
            for kind, part in enumerate(parts):
                here = np.flatnonzero(part)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(here), pa.string()), pa.array([kind] * len(here), pa.int32()), pa.array(here.astype(np.int32)), pa.array(part[here])], names=["lang", "kind", "i", "n"])

    got = small_batches(some).mapInArrow(run, fields).groupBy("lang", "kind", "i").agg(F.sum("n").alias("n")).toPandas()  # languages x BUCKETS rows at most
    langs = sorted(got["lang"].unique())
    runs, scripts, texts = np.zeros((len(langs), BUCKETS)), np.zeros((len(langs), len(NAMES))), np.zeros(len(langs))
    at = {lang: i for i, lang in enumerate(langs)}
    row = got["lang"].map(at).to_numpy(dtype=np.int64)
    for kind, into in enumerate((runs, scripts)):
        m = (got["kind"] == kind).to_numpy()
        into[row[m], got["i"].to_numpy()[m]] = got["n"].to_numpy()[m]
    m = (got["kind"] == 2).to_numpy()
    texts[row[m]] = got["n"].to_numpy()[m]
    return Model(langs, runs, scripts, texts)


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and spans (start, stop, lang), in code points, for every row.

    Texts that are null, empty or without a letter are `und`, score 0 and have no spans, as all are if nothing was learned. A text of scripts that no learned language writes
    goes to the most common one at a low score. Rows are judged alone and whole, so null ids and repeated rows give a row each; other columns go, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS numbers

    def run(texts: list[str]) -> dict:
        found = shared.value.judge(texts)
        return {"lang_pred": [x[0] for x in found], "score": [x[1] for x in found], "spans": [[{"start": a, "stop": b, "lang": lang} for a, b, lang in x[2]] for x in found]}

    ready = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("t"))
    return with_python(ready, "t", run, "lang_pred string, score double, spans array<struct<start:long,stop:long,lang:string>>", rows=1000, most=2**22)  # labels of many texts take few more steps than of one


def op13_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "spans")
