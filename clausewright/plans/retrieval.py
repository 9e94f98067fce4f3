"""Queries in batches through gate, parsing, expansion, embedding, search, fusion, references, stance and cards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright import settings as S
from clausewright.operators.clauses import as_clauses, corpus_terms
from clausewright.operators.fusion import expand_refs, fuse
from clausewright.operators.knn import KnnBackend, create_index
from clausewright.operators.scoring import early_gate, expansions, gate, nudge, parse_assertions, stance
from clausewright.sources.tables import cut, small_batches


def last_of_id(clauses: DataFrame) -> DataFrame:
    """One clause an id, the last in the corpus, as lookups by id find it."""
    rest = [c for c in clauses.columns if c != "id"]
    return clauses.groupBy("id").agg(F.max_by(F.struct(*rest), "seq").alias("c")).select("id", "c.*")


def of_ids(clauses: DataFrame, ids: DataFrame) -> DataFrame:
    """The clauses that lookups by these ids find. Others are left out before the texts are grouped, so what is shuffled follows the ids."""
    return last_of_id(clauses.join(ids.select("id").distinct(), "id", "left_semi"))


def within_reach(clauses: DataFrame, fused: DataFrame, top: int = 2) -> DataFrame:
    """The clauses that expand_refs() can lead to: those of the candidates, and all of the documents of the first rows."""
    docs = of_ids(clauses.select("id", "doc", "seq"), fused.filter(F.col("rank") <= top)).select("doc").distinct()
    ids = clauses.join(docs, "doc", "left_semi").select("id").unionByName(fused.select("id")).distinct()
    return of_ids(clauses, cut(ids, "ids"))  # written, so that its size is known: a small one is sent to where the texts are


def ranked_answers(parsed: DataFrame, vectors: DataFrame, clauses: DataFrame, index: KnnBackend) -> DataFrame:
    """All candidates of each query with stance, scores and final_rank.

    parsed: queries after early_gate and parse_assertions; vectors: query_id, kind, embedding of their expansions; clauses: as as_clauses() gives them.
    Refused queries are left out before the search. The candidates, and the clauses within their reach, are written, as they are read several times.
    """
    open_ = parsed.filter("early IS NULL")
    asked = vectors.join(open_.select("query_id"), "query_id", "left_semi")
    fused = cut(fuse(index.search(asked, S.TOP_K)), "candidates")
    found = cut(within_reach(clauses, fused), "reached")
    rows = expand_refs(fused, found).join(found, "id").join(open_.select("query_id", "subject", "qualifiers", (F.size("obligation") > 0).alias("accusatory")), "query_id")
    return nudge(stance(rows))


def cards(ranked: DataFrame) -> DataFrame:
    return ranked.filter(F.col("final_rank") <= S.CARDS)


def vectors_of(chunk_rows: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """The clauses' vectors, written: the model sees a text once, however often a search names its vector, and doesn't share a task with the search."""
    return cut(small_batches(chunk_rows).select("id", embed(F.col("embedding_text")).alias("embedding")), "vectors")


def prepared(chunk_rows: DataFrame, embed: Callable[[Column], Column], backend: str = "flat") -> tuple[DataFrame, KnnBackend]:
    """What answer() needs of a table of clauses whatever is asked: its terms and the index of its vectors, both written, so that many calls work them out once."""
    return cut(corpus_terms(chunk_rows), "terms"), create_index(vectors_of(chunk_rows, embed), backend)


def answer(queries: DataFrame, chunk_rows: DataFrame, embed: Callable[[Column], Column], backend: str = "flat", known: tuple[DataFrame, KnnBackend] | None = None) -> DataFrame:
    """The ranked candidates of queries (query_id, transcript and the measures of the gate) in a table of clauses from chunks().

    cards() and gate() take them further. chunk_rows is read several times, so it should be a written table; known: what prepared() gives for it.
    """
    terms, index = known or (corpus_terms(chunk_rows), create_index(vectors_of(chunk_rows, embed), backend))
    parsed = parse_assertions(early_gate(queries), terms)
    vectors = expansions(parsed.filter("early IS NULL")).select("query_id", "kind", embed(F.col("text")).alias("embedding"))
    return ranked_answers(parsed, vectors, as_clauses(chunk_rows), index)


def answer_plain(queries: DataFrame, chunk_rows: DataFrame, embed: Callable[[Column], Column], backend: str = "flat") -> DataFrame:
    """The plain arm: the transcript itself is searched, its hits are the cards, with stance as for obligations; no query is refused early."""
    parsed = parse_assertions(queries, corpus_terms(chunk_rows))
    vectors = parsed.select("query_id", F.lit("obligation").alias("kind"), embed(F.col("transcript")).alias("embedding"))
    hits = cut(create_index(vectors_of(chunk_rows, embed), backend).search(vectors, S.CARDS), "hits")
    kinds = {k: F.lit(None).cast("double") for k in S.KINDS} | {"obligation": F.col("score")}
    rows = hits.withColumns({"fused": F.col("score"), "best_cosine": F.col("score"), "best_kind": F.lit("obligation"), "xref_from": F.lit(None).cast("string"), "final_rank": F.col("rank"), **kinds})
    rows = rows.drop("kind", "score").join(of_ids(as_clauses(chunk_rows), hits), "id").join(parsed.select("query_id", "subject", "qualifiers"), "query_id")
    return stance(rows)


def verdicts(queries: DataFrame, ranked: DataFrame, plain: bool = False) -> DataFrame:
    """(query_id, state, composite, reason) of every query."""
    return gate(queries, ranked, early=not plain)
