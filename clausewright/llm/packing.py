"""Packing documents along a space-filling curve into sequences of fixed length.

Each document becomes a hashed vector of its byte trigrams, projected to three dimensions by a
fixed random matrix; its place on a Hilbert curve through them is its key. A range sort by that key puts alike documents side
by side, and each partition is packed as one stream: pieces follow each other without gaps, a document is cut where a
sequence is full. What is left at a partition's end goes to sequences whose lengths are powers of two, which need no padding.

Ranges end at quantiles of the keys of a sample of bounded size. A key that many documents share is dealt into several by a hash of
their ids, so a group of equal documents that is a third of the table still spreads evenly over partitions.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.llm.common import quantile_cells, small_batches, table, with_python

LENGTH, BITS, DIMS, BUCKETS = 2048, 12, 3, 256
END = (1).to_bytes(4, "little")
#: Words kept per worker with their ids, in each of the store's two halves; a full one becomes the elder and a new one begins.
STORE = 100_000
SAMPLE = 200  # documents a partition, on average, whose keys set the ranges
_PIECE = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_PARTS = re.compile(r"([ \n]*)([^\W\d_]+)([^\w\s']*)\Z")
_OTHER_SPACE = tuple(c for c in map(chr, range(0x3001)) if (c.isspace() and c not in " \n") or c in "\u180e\u200b")


def document_vectors(texts: list[str]) -> np.ndarray:
    """Places in the unit cube: hashed byte trigrams of the whole text, centred, projected, each coordinate by a normal law's form."""
    rng = np.random.default_rng(20240501)
    matrix = rng.standard_normal((BUCKETS, DIMS)).astype(np.float32)
    out = np.zeros((len(texts), BUCKETS), dtype=np.float32)
    for i, t in enumerate(texts):
        b = np.frombuffer(t.encode(), np.uint8).astype(np.uint32)
        if len(b) > 2:
            h = (b[:-2] * np.uint32(0x10001) + b[1:-1] * np.uint32(0x101) * np.uint32(31) + b[2:]) * np.uint32(2654435761)
            out[i] = np.sqrt(np.bincount(h >> np.uint32(24), minlength=BUCKETS))
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    x = (out / np.where(norm > 0, norm, 1) - 1 / np.sqrt(BUCKETS)) @ matrix
    return 1 / (1 + np.exp(-3.0 * x))


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each point of the unit cube on the Hilbert curve with 2^bits steps a dimension (Skilling's transposition)."""
    n = points.shape[1]
    x = np.clip((points * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1).T.copy()
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _byte_letters() -> dict[int, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary: its own where it has one, else the next from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(other)}


_BYTES = _byte_letters()


class WordIds(dict):
    """Token ids (unsigned, little-endian, four bytes each) of a word with the white space before it, made when first asked for.

    No token of the vocabulary spans the border from a word to the blank or line end after it, so a text's ids are those of its
    pieces, marks of special tokens in them included. A piece that is a word with white space before or signs after it is made of the ids of these, as
    the tokenizer splits them too; what is a word alone goes to its merges at once. Texts with other white space, whose borders differ, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.elder: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.elder.get(piece)
        if ids is None:
            ids = self._made(piece)
        if len(self) >= STORE:
            self.elder = dict(self)
            self.clear()
        if len(piece) <= 40:
            self[piece] = ids
        return ids

    def _made(self, piece: str) -> bytes:
        parts = _PARTS.match(piece)
        if parts is None or not parts[2].isalpha():
            return self.whole(piece)
        space, word, signs = parts.groups()
        if space[-1:] == " ":  # the last blank goes to the word
            space, word = space[:-1], " " + word
        if not space and not signs:
            return array("I", [t.id for t in self.merges.tokenize(word.encode().decode("latin-1").translate(_BYTES))]).tobytes()
        if space[1:] and word[0] != " ":  # and the last line end stands alone
            space, word = space[:-1], "\n" + word
        return (self[space] if space else b"") + self[word] + (self[signs] if signs else b"")

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        return [self.whole(t) if any(c in t for c in _OTHER_SPACE) else b"".join(map(self.__getitem__, _PIECE.findall(t))) for t in texts]


def _stores() -> dict[str, WordIds]:
    return globals().setdefault("_STORES", {})


def word_ids(path: str) -> WordIds:
    """The worker's store for a tokenizer file; it outlives a task."""
    return _stores().setdefault(path, None) or _stores().update({path: WordIds(path)}) or _stores()[path]


def pack_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, parts: int | None = None) -> DataFrame:
    """A row per piece: doc_id, start, length, ids (binary, four bytes each), doc_tokens, sequence_id, offset, sequence_length.

    A null or empty text is its end mark alone. Repeated rows and rows with a null id are packed like others, each by itself.
    Pieces cover each document once, offsets have no gaps, and a sequence is full, or its length a power of two. An empty table gives an empty
    result. parts: partitions, by default spark.sql.shuffle.partitions.
    """
    ready = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("t"), F.coalesce(text, F.lit("")).alias("v"))
    n = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = docs.count()
    some = ready.select("v") if many <= SAMPLE * n else ready.select("v").sample(SAMPLE * n / many, 1)
    ends, cells = quantile_cells(with_python(some, "v", lambda texts: {"k": hilbert_keys(document_vectors(texts))}, "k long"), n)
    before, total = np.cumsum(cells) - cells, int(cells.sum())

    def place(texts: list[str]) -> dict:
        keys = hilbert_keys(document_vectors(texts))
        at = np.searchsorted(ends, keys, side="left")
        return {"key": keys, "before": before[at], "cells": cells[at]}

    keyed = with_python(ready, "v", place, "key long, before long, cells long")
    cell = F.col("before") + F.pmod(F.xxhash64("doc_id", "t"), F.col("cells"))
    ranged = keyed.withColumn("part", F.floor(cell * n / total).cast("int")).drop("before", "cells")
    ranged = ranged.repartitionById(n, "part").sortWithinPartitions("key", "doc_id", F.xxhash64("t"))
    kind = ranged.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = word_ids(tokenizer)
        number = TaskContext.get().partitionId() << 40
        waiting: list[list] = []  # pieces of the sequence that isn't full: [doc_id, start, ids, doc_tokens]
        held = 0
        out: list[tuple] = []
        id_type = None

        def close(pieces: list[list], size: int) -> None:
            nonlocal number
            at = 0
            for doc, start, ids, total in pieces:
                out.append((doc, start, len(ids) // 4, ids, total, number, at, size))
                at += len(ids) // 4
            number += 1

        def flush() -> pa.RecordBatch:
            types = (id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_length")
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
            out.clear()
            return batch

        for batch in batches:
            id_type = id_type or batch.column("doc_id").type
            for row in range(0, batch.num_rows, 128):
                piece = batch.slice(row, 128)
                for doc, ids in zip(piece.column("doc_id").to_pylist(), store.ids(piece.column("t").to_pylist()), strict=True):
                    ids += END
                    total, start = len(ids) // 4, 0
                    while start < total:
                        n_ids = min(length - held, total - start)
                        waiting.append([doc, start, ids[4 * start : 4 * (start + n_ids)], total])
                        start, held = start + n_ids, held + n_ids
                        if held == length:
                            close(waiting, length)
                            waiting, held = [], 0
                    if len(out) >= 2000:
                        yield flush()
        while waiting:  # the rest, in powers of two from the largest
            size, taken, got = 1 << (held.bit_length() - 1), [], 0
            while got < size:
                doc, start, ids, total = waiting.pop(0)
                fits = min(len(ids) // 4, size - got)
                taken.append([doc, start, ids[: 4 * fits], total])
                got += fits
                if 4 * fits < len(ids):
                    waiting.insert(0, [doc, start + fits, ids[4 * fits :], total])
            close(taken, size)
            held -= size
        if out:
            yield flush()

    return small_batches(ranged).mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def digest(packed: DataFrame) -> DataFrame:
    return packed.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")


def op1_packing(spark, sf_dir):
    return digest(pack_documents(table(spark, sf_dir, "documents"), default_tokenizer()))
