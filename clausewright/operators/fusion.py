"""Reciprocal rank fusion, margins, and expansion along the reference graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright import settings as S
from clausewright.functions import text as T


def with_weights(hits: DataFrame, kinds: dict[str, float] = S.KINDS) -> DataFrame:
    """hits of the known kinds with weight and kind_ord."""
    named = F.create_map(*[x for i, (k, w) in enumerate(kinds.items()) for x in (F.lit(k), F.struct(F.lit(float(w)).alias("weight"), F.lit(i).alias("kind_ord")))])
    return hits.filter(F.col("kind").isin(*kinds)).withColumn("w", named[F.col("kind")]).select(*hits.columns, "w.weight", "w.kind_ord")


def fuse(hits: DataFrame, kinds: dict[str, float] = S.KINDS, k: int = S.RRF_K) -> DataFrame:
    """(query_id, id, fused, best_cosine, best_kind, <kind>..., rank): one row a candidate, ties by kind and rank of its first hit."""
    inc = F.col("weight") / (k + F.col("rank"))
    agg = with_weights(hits, kinds).groupBy("query_id", "id").agg(
        F.sum(inc).alias("fused"), F.max("score").alias("best_cosine"), F.max(F.struct(inc, -F.col("kind_ord"), "kind")).alias("top"),
        F.min(F.struct("kind_ord", "rank")).alias("seen"), *[F.max(F.when(F.col("kind") == n, F.col("score"))).alias(n) for n in kinds],
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("fused"), "seen")
    return agg.withColumn("rank", F.row_number().over(order)).select("query_id", "id", "fused", "best_cosine", F.col("top.kind").alias("best_kind"), *kinds, "rank")


def rank1_margin(fused: DataFrame) -> DataFrame:
    """(query_id, margin): cosine of the first less that of the second, 0 at least; of the first alone its own."""
    w = Window.partitionBy("query_id").orderBy("rank")
    second = F.lead("best_cosine").over(w)
    return fused.withColumn("margin", F.when(second.isNull(), F.col("best_cosine")).otherwise(F.greatest(F.lit(0.0), F.col("best_cosine") - second))).filter("rank = 1").select("query_id", "margin")


def bare(label: Column) -> Column:
    """A clause's label without its sign, in lower case."""
    return F.lower(F.regexp_replace(label, r"^§\s*", ""))


def reached(clauses: DataFrame) -> DataFrame:
    """(way, doc, key, to_id, to_seq): what a reference reaches in its own document. Way 0: the clause of that label, the document's last one where several have it.

    Way 1: exception clauses that cite the label or one of its sub-clauses, or are sub-clauses of it. A label is a path, and each such clause is listed under
    every beginning of the paths that lead to it, so "is a sub-clause of" is an equality of (doc, key) and no document meets another's labels.
    """
    starts = lambda x, at: T.let(F.split(x, at), lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, F.lit(1), i), "")))
    named = clauses.groupBy("doc", bare(F.col("label")).alias("key")).agg(F.max_by("id", "seq").alias("to_id"), F.max("seq").alias("to_seq"))
    cites = F.flatten(F.transform("refs", lambda r: starts(bare(r), r"(?=\()")))
    ups = F.filter(starts(bare(F.col("label")), r"(?=[.(])"), lambda x: x != bare(F.col("label")))
    carve = clauses.filter("has_exception").select("doc", F.explode(F.array_distinct(F.concat(cites, ups))).alias("key"), F.col("id").alias("to_id"), F.col("seq").alias("to_seq"))
    return named.withColumn("way", F.lit(0)).unionByName(carve.withColumn("way", F.lit(1)))


def expand_refs(fused: DataFrame, clauses: DataFrame, top: int = 2) -> DataFrame:
    """fused with clauses of the same document that the first rows cite, and carve-outs there that cite them, where missing; adds xref_from, the citing row's label as written.

    clauses: id, doc (what its document is told apart by, not null), label, refs (array), has_exception, seq (of any type that has an order). Forward: cited by a top row, both scores at a discount. Reverse: see
    reached(); scores above the row's. Scores by kind are the top row's. A clause found in several ways takes the first: as a candidate itself, then
    by parent's rank, forward before reverse, then by place. Each candidate is read once: it stands for itself and, as a top row, for the keys it reaches by.
    The join by (way, doc, key) is a plain outer one from the rows, whose large partitions adaptive execution splits, so a clause that many queries find is no single task.
    """
    own = clauses.select(F.col("id").alias("__own"), F.col("doc").alias("__doc"), F.col("label").alias("__label"), "refs")
    rows = fused.withColumn("__own", F.when(F.col("rank") <= top, F.col("id"))).join(own, "__own", "left")
    stub = lambda way, key, at: F.struct(F.lit(way).alias("way"), key.alias("key"), at.cast("int").alias("at"))
    ahead = F.transform("refs", lambda r, i: stub(0, bare(r), i))
    stubs = F.concat(F.array(stub(-1, F.lit(None).cast("string"), F.lit(0))), F.when(F.col("__label").isNotNull(), F.concat(ahead, F.array(stub(1, bare(F.col("__label")), F.lit(0))))).otherwise(F.array().cast("array<struct<way:int,key:string,at:int>>")))
    rows = rows.withColumn("__s", F.explode(stubs)).select(*fused.columns, "__label", F.col("__doc").alias("doc"), "__s.*")
    found = rows.join(reached(clauses), ["way", "doc", "key"], "left").filter("way < 0 OR to_id IS NOT NULL")
    way = F.col("way")
    found = found.withColumns({
        "id": F.coalesce("to_id", "id"), "fused": F.col("fused") * F.when(way == 0, S.XREF_DISCOUNT).when(way == 1, S.REVERSE_BOOST).otherwise(1.0), "best_cosine": F.col("best_cosine") * F.when(way == 0, S.XREF_DISCOUNT).otherwise(1.0),
        "best_kind": F.when(way == 1, "exception").otherwise(F.col("best_kind")), "xref_from": F.when(way >= 0, F.col("__label")), "__p": F.when(way < 0, 0).otherwise(F.col("rank")),
        "__at": F.struct(F.when(way < 0, F.col("rank")).otherwise(F.col("at")).alias("n"), F.when(way == 1, F.col("to_seq")).alias("seq")),
    })
    first = Window.partitionBy("query_id", "id").orderBy("__p", "way", "__at")
    order = Window.partitionBy("query_id").orderBy(F.desc("fused"), "__p", "way", "__at")
    kept = found.withColumn("__n", F.row_number().over(first)).filter("__n = 1")
    return kept.withColumn("rank", F.row_number().over(order)).select(*fused.columns, "xref_from")
