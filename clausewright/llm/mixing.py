"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in built-in functions.

Each document draws the key -ln(u) / quality, with u from a hash of its id and text, so reruns agree.
Within a source, documents in order of that key are taken until the source's word budget
is met; whole epochs come first, and the last document is cut at the budget.

No source is sorted as a whole. Keys fall into some 65,000 leaves in key order, 1,024 for each doubling of the key; sums by leaf and by
group of 256 leaves give, for each source, the one leaf in which the budget ends. Documents of
earlier leaves are taken, of later ones not, and only that leaf is sorted. Whatever its documents' weights, no leaf holds more than one in 3,900 of
a source's draws of one weight, so a source with a third of 10^10 documents sorts under a million rows, and one of number tables no more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.llm.common import WORD, cut, free, table

#: Characters that count against a text's quality weight.
JUNK = "0123456789|#{}<>[]_=*~^@\\/$%&+"
FAN = 256
#: Sources whose goals (six numbers each) go to every task at most.
FEW_SOURCES = 50_000


def quality_weight(text: Column) -> Column:
    """1 less the share of digits and symbols, 0.05 at least; 1 for an empty text."""
    n = F.length(text)
    clean = F.length(F.translate(text, JUNK, ""))
    return F.when(n > 0, F.greatest(F.lit(0.05), clean.cast("double") / n)).otherwise(F.lit(1.0))


def source_targets(sized: DataFrame, max_epochs: int = 3) -> DataFrame:
    """(source, source_size, target): weights 1, 2, 3, repeating by source in code-point order (null last) share all words.

    A target stops at max_epochs times its source's size; the excess goes to the others by weight. With the
    sources in order of size / weight, those that stop come first, so the common rate
    follows from running sums. One row a source is all that this works on.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("s"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("rn", F.row_number().over(by_name)).withColumn("w", (F.col("rn") - 1) % 3 + 1)
    order = Window.orderBy((F.col("s") / F.col("w")), "rn")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = (
        per.withColumn("at", F.row_number().over(order))
        .withColumn("capped", F.coalesce(F.sum(F.col("s") * max_epochs).over(before), F.lit(0)))
        .withColumn("rest_w", F.sum("w").over(after))
        .withColumn("total", F.sum("s").over(whole))
        .withColumn("rate", (F.col("total") - F.col("capped")) / F.col("rest_w"))
        .withColumn("free", F.when(F.col("rate") * F.col("w") <= F.col("s") * max_epochs, F.col("at")))
    )
    per = per.withColumn("first", F.min("free").over(whole))
    per = per.withColumn("common", F.max(F.when(F.col("at") == F.col("first"), F.col("rate"))).over(whole))
    target = F.when(F.col("at") < F.col("first"), (F.col("s") * max_epochs).cast("double")).otherwise(F.col("common") * F.col("w"))
    return per.select("source", F.col("s").alias("source_size"), target.alias("target"))


def sample_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (words, repeats counted).

    A null text has size 0 and is never taken; null sources are one source, the last. Rows without an id draw by their text alone. Repeated rows are
    documents of their own with the same key. The document in which a source's budget ends gives its first words
    only, so a source's taken words are its target rounded to a whole number. An empty table gives an empty result.
    """
    return _drawn(docs, doc_id, text, source, max_epochs, seed).drop("th")


def _drawn(docs: DataFrame, doc_id: str, text: str, source: str, max_epochs: int, seed: str) -> DataFrame:
    """sample_mix with th, the hash of each row's text."""
    t = F.coalesce(text, F.lit(""))
    size = F.regexp_count(t, F.lit(WORD)).cast("long")
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), quality_weight(t).alias("q"), F.md5(t).alias("th"))
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("th"))), 1, 13), 16, 10).cast("double")
    key = -F.log((bits + 0.5) / F.lit(float(2**52))) / F.col("q")
    sized = sized.withColumn("key", key).withColumn("leaf", F.floor((F.log2("key") + 54) * 1024).cast("int"))  # keys lie between 2^-54 and 2^10
    sized = cut(sized.select("doc_id", "source", "size", "th", "key", "leaf"), "mix-sized")

    budget = F.floor(F.col("target") + 0.5)
    goal = (
        source_targets(sized, max_epochs)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("cast(floor(target + 0.5) as bigint) div source_size")).otherwise(F.lit(0)))
        .withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    )
    leaves = sized.groupBy("source", "leaf").agg(F.sum("size").alias("n")).withColumn("group", F.expr(f"leaf div {FAN}").cast("int"))

    def ends(sums: DataFrame, at: str, over: list[str]) -> DataFrame:
        """The row of each source in which the running sum reaches what is left to take."""
        before = Window.partitionBy(*over).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        return sums.withColumn("prior", F.coalesce(F.sum("n").over(before), F.lit(0)) + F.col("offset")).filter((F.col("prior") < F.col("rest")) & (F.col("rest") <= F.col("prior") + F.col("n")))

    def to_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        right = right.withColumnRenamed("source", "__source")
        return left.join(right, F.col("source").eqNullSafe(F.col("__source")), how).drop("__source")

    groups = leaves.groupBy("source", "group").agg(F.sum("n").alias("n"))
    group_end = ends(to_source(groups, goal.select("source", "rest")).withColumn("offset", F.lit(0)), "group", ["source"])
    group_end = group_end.select("source", F.col("group").alias("end_group"), F.col("prior").alias("offset"), "rest")
    leaf_end = ends(to_source(leaves, group_end).filter(F.col("group") == F.col("end_group")), "leaf", ["source"])
    goal = to_source(goal, leaf_end.select("source", F.col("leaf").alias("end_leaf"), "prior"), "left").fillna({"end_leaf": -1, "prior": 0})

    goal = cut(goal, "mix-goal")
    if goal.count() <= FEW_SOURCES:  # a row a source; beyond that the join is a shuffle, which adaptive execution splits where a source is hot
        goal = F.broadcast(goal)
    rows = to_source(sized, goal)
    inside = Window.partitionBy("source").orderBy("key", "doc_id", "th").rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.filter(F.col("leaf") == F.col("end_leaf")).withColumn("part", F.least("size", F.greatest(F.lit(0), F.col("rest") - F.col("prior") - F.coalesce(F.sum("size").over(inside), F.lit(0)))))
    sure = rows.filter(F.col("leaf") != F.col("end_leaf")).withColumn("part", F.when(F.col("leaf") < F.col("end_leaf"), F.col("size")).otherwise(F.lit(0)))
    both = sure.unionByName(edge)
    return both.select("doc_id", "th", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """The mixed corpus: each row of docs as often as its taken words fill it, the last time if at least half is taken.

    Columns stay those of docs, whatever their names. Rows without words, null texts too, have no part in a mix and go. Rows are told apart by id and text, so different
    texts of one id or without an id are drawn for themselves; equal ones are repeated alike. An empty table stays empty.
    """
    n = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    copies = _drawn(docs, "doc_id", "text", "source", max_epochs, seed).filter(F.col("size") > 0).withColumn("n", n)
    copies = copies.groupBy("doc_id", "th").agg(F.max("n").alias("n")).filter("n > 0")
    a, b, c, d = (free(docs, x) for x in ("__id", "__th", "__n", "__copy"))
    copies = copies.select(F.col("doc_id").alias(a), F.col("th").alias(b), F.col("n").alias(c))
    rows = docs.join(copies, F.col("doc_id").eqNullSafe(F.col(a)) & (F.md5(F.coalesce("text", F.lit(""))) == F.col(b)))
    return rows.withColumn(d, F.explode(F.sequence(F.lit(1), F.col(c)))).drop(a, b, c, d)


def op9_mixing(spark, sf_dir):
    return sample_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  CASE WHEN length(coalesce(text, '')) > 0 THEN greatest(0.05::DOUBLE, length(translate(text, '0123456789|#{}<>[]_=*~^@\/$%&+', ''))::DOUBLE / length(text)) ELSE 1.0::DOUBLE END AS q, md5(coalesce(text, '')) AS th FROM documents),
k AS (SELECT *, -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || th), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496::DOUBLE) / q AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM d GROUP BY source),
w AS (SELECT *, (rn - 1) % 3 + 1 AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY s::DOUBLE / w, rn) AS pos,
  coalesce(sum(3 * s) OVER (ORDER BY s::DOUBLE / w, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped,
  sum(w) OVER (ORDER BY s::DOUBLE / w, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS rest_w, sum(s) OVER ()::BIGINT AS total FROM w),
r AS (SELECT *, (total - capped)::DOUBLE / rest_w::DOUBLE AS rate FROM o),
c AS (SELECT arg_min(rate, pos) AS common, min(pos) AS first_pos FROM r WHERE rate * w <= 3 * s),
t AS (SELECT source, s, CASE WHEN pos < first_pos THEN (3 * s)::DOUBLE ELSE common * w END AS target FROM r, c),
g AS (SELECT *, CASE WHEN s > 0 THEN floor(target + 0.5)::BIGINT // s ELSE 0 END AS epochs FROM t),
p AS (SELECT k.doc_id, k.size, g.s, g.target, g.epochs, floor(g.target + 0.5)::BIGINT - g.epochs * g.s AS rest,
  coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.th ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prior
  FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, s AS source_size, target, (epochs * size + least(size, greatest(0, rest - prior)))::BIGINT AS taken FROM p
"""
