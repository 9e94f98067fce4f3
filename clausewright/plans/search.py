"""Registered queries of search, fusion, stance, gate and evaluation over the embeddings, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright import settings as S
from clausewright.functions import text as T
from clausewright.functions import vectors as V
from clausewright.operators import evaluate as E
from clausewright.operators import fusion as X
from clausewright.operators import scoring as G
from clausewright.operators.knn import create_index
from clausewright.plans.registry import query, rounded, sql_list, table
from clausewright.sources.tables import cut
from clausewright.streaming import vad

DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"
KINDS = """kinds AS (SELECT * FROM (VALUES ('obligation', 0, 1.0::DOUBLE), ('exception', 1, 1.3::DOUBLE), ('definition', 2, 0.8::DOUBLE), ('remedy', 3, 0.8::DOUBLE)) k(kind, kind_ord, weight))"""
# Queries are the rows whose id is divisible by 100; the four kinds take the vectors of that row and the next three.
ASKED = f"""{KINDS}, vecs AS (SELECT vec_id AS id, embedding FROM embeddings),
qs AS (SELECT e.vec_id - kind_ord AS query_id, kind, kind_ord, weight, embedding FROM embeddings e JOIN kinds ON (e.vec_id - kind_ord) % 100 = 0)"""
SEARCH = f"""hits AS (SELECT query_id, kind, kind_ord, weight, id, score, rank FROM (SELECT query_id, kind, kind_ord, weight, id, score, row_number() OVER (PARTITION BY query_id, kind ORDER BY score DESC, id) AS rank
  FROM (SELECT query_id, kind, kind_ord, weight, v.id, {DOT.format('v.embedding', 'qs.embedding')} AS score FROM vecs v, qs)) WHERE rank <= 10)"""
HITS = f"{ASKED}, {SEARCH}"
FUSION = """agg AS (SELECT query_id, id, sum(weight / (60 + rank)) AS fused, max(score) AS best_cosine, arg_max(kind, weight / (60 + rank) - kind_ord * 1e-12) AS best_kind, min(kind_ord * 100 + rank) AS seen,
  max(score) FILTER (kind = 'obligation') AS obligation, max(score) FILTER (kind = 'exception') AS exception, max(score) FILTER (kind = 'definition') AS definition, max(score) FILTER (kind = 'remedy') AS remedy FROM hits GROUP BY query_id, id),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, seen, id) AS rank FROM agg)"""
FUSED = f"{HITS}, {FUSION}"


def index_of(spark, sf_dir):
    return create_index(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"))


def asked(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    kinds = list(S.KINDS)
    return e.withColumn("k", F.col("vec_id") % 100).filter(F.col("k") < len(kinds)).select((F.col("vec_id") - F.col("k")).alias("query_id"), F.get(F.array(*map(F.lit, kinds)), F.col("k").cast("int")).alias("kind"), "embedding")


def found(spark, sf_dir):
    return index_of(spark, sf_dir).search(asked(spark, sf_dir), S.TOP_K)


def graph(spark, sf_dir) -> DataFrame:
    """Clauses made of the embeddings' ids: documents of a hundred, labels §a or §a.b in each, two references each, exceptions by label."""
    e, v = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    text = lambda c: c.cast("string")
    a = F.floor(v / 10) % 10
    label = F.concat(F.lit("§"), F.when(v % 10 == 0, text(a)).otherwise(F.concat_ws(".", text(a), text(v % 10))))
    refs = F.array(F.concat_ws(".", text(v * 7 % 10), text(v * 3 % 9 + 1)), text(v * 11 % 10))
    return e.select(v.alias("id"), F.floor(v / 100).alias("doc"), label.alias("label"), refs.alias("refs"), (F.col("label") % 3 == 0).alias("has_exception"), (F.col("label") % 2 == 0).alias("has_obligation"), (F.col("label") == 1).alias("has_definition"), v.alias("seq"))


@query(f"WITH {HITS} SELECT query_id, kind, id, round(score, 6) AS score, rank::INTEGER AS rank FROM hits")
def knn_flat_top10(spark, sf_dir):
    return rounded(found(spark, sf_dir), "score")


@query(f"WITH {HITS} SELECT query_id, kind, round(min(score), 6) AS least, count(*)::INTEGER AS n, true AS recalled FROM hits GROUP BY query_id, kind")
def knn_lists_recall(spark, sf_dir):
    """The exact answer's least score and size for each query, and whether inverted lists recall at least 0.95 of all exact hits."""
    exact = found(spark, sf_dir)
    lists = create_index(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "lists", lists=16, probes=14)
    met = lists.search(asked(spark, sf_dir), S.TOP_K).select("query_id", "kind", "id", F.lit(1).alias("met"))
    per = exact.join(met, ["query_id", "kind", "id"], "left").groupBy("query_id", "kind").agg(F.round(F.min("score"), 6).alias("least"), F.count("*").cast("int").alias("n"), F.count("met").alias("met"))
    out = cut(per, "recall")
    lists.close()
    recall = out.agg((F.sum("met") / F.sum("n")).alias("r"))
    return out.join(recall, how="cross").select("query_id", "kind", "least", "n", (F.col("r") >= 0.95).alias("recalled"))  # recall is one row


@query(f"SELECT vec_id, round(sqrt({DOT.format('embedding', 'embedding')}), 6) AS before, 1.0::DOUBLE AS after, round(sqrt({DOT.format('embedding', 'embedding')} / len(embedding)), 6) AS rms FROM embeddings")
def l2_normalize_norms(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm(e), 6).alias("before"), F.round(V.norm(V.l2_normalize(e)), 6).alias("after"), F.round(vad.frame_rms(e), 6).alias("rms"))


@query(f"WITH {FUSED} SELECT query_id, id, round(fused, 6) AS fused, round(best_cosine, 6) AS best_cosine, best_kind, round(obligation, 6) AS obligation, round(exception, 6) AS exception, round(definition, 6) AS definition, round(remedy, 6) AS remedy, rank::INTEGER AS rank FROM fused")
def rrf_fuse(spark, sf_dir):
    return rounded(X.fuse(found(spark, sf_dir)), "fused", "best_cosine", *S.KINDS)


@query(f"WITH {FUSED} SELECT query_id, round(coalesce(greatest(0, best_cosine - nxt), best_cosine), 6) AS margin FROM (SELECT *, lead(best_cosine) OVER (PARTITION BY query_id ORDER BY rank) AS nxt FROM fused) WHERE rank = 1")
def rank1_margin(spark, sf_dir):
    return rounded(X.rank1_margin(X.fuse(found(spark, sf_dir))), "margin")


GRAPH = """clauses AS (SELECT *, substr(written, 2) AS low FROM (SELECT vec_id AS id, vec_id // 100 AS doc, vec_id AS seq, CASE WHEN vec_id % 10 = 0 THEN '§' || (vec_id // 10 % 10) ELSE '§' || (vec_id // 10 % 10) || '.' || (vec_id % 10) END AS written,
  [(vec_id * 7 % 10) || '.' || (vec_id * 3 % 9 + 1), (vec_id * 11 % 10)::VARCHAR] AS refs, label % 3 = 0 AS has_exception, label % 2 = 0 AS has_obligation, label = 1 AS has_definition, ''::VARCHAR AS text, []::VARCHAR[] AS matched_markers FROM embeddings))"""
EXPANSION = """parents AS (SELECT query_id, f.id AS p_id, rank AS p_rank, doc, low AS p_low, written AS p_label, refs, fused AS p_fused, best_cosine AS p_cosine, best_kind AS p_kind, obligation, exception, definition, remedy FROM fused f JOIN clauses USING (id) WHERE rank <= 2),
named AS (SELECT doc, low, arg_max(id, seq) AS id FROM clauses GROUP BY doc, low),
fwd AS (SELECT query_id, n.id, p_fused * 0.7 AS fused, p_cosine * 0.7 AS best_cosine, p_kind AS best_kind, obligation, exception, definition, remedy, p_label, p_rank, 0 AS way, p.pos - 1 AS at_ FROM (SELECT *, unnest(refs) AS r, generate_subscripts(refs, 1) AS pos FROM parents) p JOIN named n ON n.doc = p.doc AND n.low = lower(p.r)),
rev AS (SELECT query_id, o.id, p_fused * 1.03 AS fused, p_cosine AS best_cosine, 'exception' AS best_kind, obligation, exception, definition, remedy, p_label, p_rank, 1 AS way, o.seq AS at_ FROM parents p JOIN (SELECT *, list_transform(refs, lambda r: lower(r)) AS lrefs FROM clauses WHERE has_exception) o
  ON o.doc = p.doc AND (len(list_filter(o.lrefs, lambda r: r = p.p_low OR starts_with(r, p.p_low || '('))) > 0 OR starts_with(o.low, p.p_low || '.') OR starts_with(o.low, p.p_low || '('))),
found AS (SELECT * FROM (SELECT * FROM fwd UNION ALL SELECT * FROM rev) f WHERE NOT EXISTS (SELECT 1 FROM fused u WHERE u.query_id = f.query_id AND u.id = f.id) QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY p_rank, way, at_) = 1),
alls AS (SELECT query_id, id, fused, best_cosine, best_kind, obligation, exception, definition, remedy, NULL AS xref_from, 0 AS p_rank, -1 AS way, rank AS at_ FROM fused UNION ALL SELECT query_id, id, fused, best_cosine, best_kind, obligation, exception, definition, remedy, p_label, p_rank, way, at_ FROM found),
expanded AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, p_rank, way, at_) AS rank FROM alls)"""
EXPANDED = f"{FUSED}, {GRAPH}, {EXPANSION}"


def expanded(spark, sf_dir):
    return X.expand_refs(X.fuse(found(spark, sf_dir)), graph(spark, sf_dir))


@query(f"WITH {EXPANDED} SELECT query_id, id, round(fused, 6) AS fused, round(best_cosine, 6) AS best_cosine, best_kind, round(obligation, 6) AS obligation, round(exception, 6) AS exception, round(definition, 6) AS definition, round(remedy, 6) AS remedy, xref_from, rank::INTEGER AS rank FROM expanded")
def xref_expand(spark, sf_dir):
    return rounded(expanded(spark, sf_dir), "fused", "best_cosine", *S.KINDS).select("query_id", "id", "fused", "best_cosine", "best_kind", *S.KINDS, "xref_from", "rank")


# Needs expanded, clauses and subjects (query_id, subject, qualifiers, accusatory).
JUDGED = f"""pts AS (SELECT e.*, c.* EXCLUDE (id), s.subject, s.qualifiers, s.accusatory, c.has_definition AND NOT c.has_exception AS short, lower(c.text) AS ltext FROM expanded e JOIN clauses c USING (id) JOIN subjects s USING (query_id)),
nr AS (SELECT *, len(list_filter({sql_list(S.EXEMPTING)}, lambda m: contains(ltext, m))) > 0 AND len(list_filter(subject, lambda m: contains(ltext, lower(m)))) > 0 AS near FROM pts),
pro AS (SELECT *, 2.0 * has_exception::INT + 1.5 * (best_kind = 'exception')::INT + 1.0 * (has_exception AND (xref_from IS NOT NULL OR len(refs) > 0))::INT + 1.2 * near::INT AS pro, 1.5 * has_obligation::INT + 1.0 * (best_kind = 'obligation')::INT AS con FROM nr),
conf AS (SELECT *, abs(pro - con)::DOUBLE / (pro + con + 1e-6)::DOUBLE AS conf, list_filter([CASE WHEN has_exception THEN 'exception marker: ''' || coalesce(matched_markers[1], 'exception language') || '''' END, CASE WHEN has_obligation THEN 'contains obligation language (''shall / must / not exceed'')' END,
  CASE WHEN best_kind = 'exception' THEN 'matched hypothetical exception/carve-out expansion' WHEN best_kind = 'obligation' THEN 'matched hypothetical obligation expansion' END,
  CASE WHEN has_exception AND xref_from IS NOT NULL THEN 'modifies/carves out ' || xref_from WHEN has_exception AND len(refs) > 0 THEN 'xref → §' || refs[1] END, CASE WHEN near THEN 'subject appears within exempting/carve-out scope' END], lambda r: r IS NOT NULL) AS said,
  list_filter(subject || qualifiers || {sql_list(S.TOPICAL)}, lambda t: length(t) > 1 AND contains(ltext, lower(t))) AS mt FROM pro),
st AS (SELECT *, CASE WHEN short OR conf < 0.25 THEN 'context' WHEN pro >= con THEN 'supports' ELSE 'against' END AS stance, CASE WHEN short THEN 0.88::DOUBLE ELSE floor(least(greatest(conf, 0.5), 0.99) * 100 + 0.5) / 100 END AS stance_confidence,
  CASE WHEN short THEN 'definitional clause' WHEN len(said) = 0 THEN 'topical relevance' ELSE array_to_string(said, '; ') END AS reasons, array_to_string(list_filter(mt, lambda t, i: list_position(mt, t) = i), ',') AS matched_terms FROM conf)"""
NUDGED = """nd AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused + CASE WHEN accusatory AND stance = 'supports' AND has_exception AND fused >= 0.72::DOUBLE * top THEN 0.025::DOUBLE ELSE 0 END DESC, rank) AS final_rank FROM (SELECT *, max(fused) OVER (PARTITION BY query_id) AS top FROM st))"""
STANCE = f"{EXPANDED}, subjects AS (SELECT DISTINCT query_id, []::VARCHAR[] AS subject, []::VARCHAR[] AS qualifiers, true AS accusatory FROM qs), {JUDGED}, {NUDGED}"


def ranked(spark, sf_dir):
    rows = expanded(spark, sf_dir).join(graph(spark, sf_dir), "id")
    none = F.array().cast("array<string>")
    return G.nudge(G.stance(rows.withColumns({"text": F.lit(""), "subject": none, "qualifiers": none, "matched_markers": none, "accusatory": F.lit(True)})))


@query(f"WITH {STANCE} SELECT query_id, id, stance, stance_confidence, reasons, round(fused, 6) AS fused, final_rank::INTEGER AS final_rank FROM nd")
def stance_rerank(spark, sf_dir):
    return rounded(ranked(spark, sf_dir), "fused").select("query_id", "id", "stance", "stance_confidence", F.array_join("reasons", "; ").alias("reasons"), "fused", "final_rank")


@query(f"WITH {STANCE} SELECT query_id, id, final_rank::INTEGER AS final_rank FROM nd WHERE final_rank <= 3")
def topk_cards(spark, sf_dir):
    return ranked(spark, sf_dir).filter(F.col("final_rank") <= S.CARDS).select("query_id", "id", "final_rank")


ASKED_GATE = """qy AS (SELECT vec_id AS query_id, CASE WHEN vec_id % 700 = 0 THEN 'a' ELSE 'query ' || vec_id END AS transcript, -0.22::DOUBLE - (vec_id % 300) / 250.0::DOUBLE AS lp, CASE WHEN vec_id % 400 = 300 THEN 0.7::DOUBLE ELSE 0.03::DOUBLE END AS ns, 7.5::DOUBLE + vec_id % 13 AS snr FROM embeddings WHERE vec_id % 100 = 0)"""
# Needs qy (query_id, transcript, lp, ns, snr) and nd (query_id, final_rank, best_cosine).
VERDICT = """tops AS (SELECT query_id, max(best_cosine) FILTER (final_rank = 1) AS c1, max(best_cosine) FILTER (final_rank = 2) AS c2 FROM nd WHERE final_rank <= 2 GROUP BY query_id),
sc AS (SELECT *, 1 / (1 + exp(-3 * (lp + 0.8::DOUBLE))) AS asr, least(greatest((c1 - 0.3::DOUBLE) / (0.62::DOUBLE - 0.3::DOUBLE), 0), 1) AS sim, coalesce(least(greatest(c1 - c2, 0) / 0.08::DOUBLE, 1), 0) AS gap FROM qy LEFT JOIN tops USING (query_id)),
tot AS (SELECT *, least(0.99::DOUBLE, floor((0.3::DOUBLE * asr + 0.15::DOUBLE * least(greatest((snr - 6) / 18, 0), 1) + 0.35::DOUBLE * sim + 0.2::DOUBLE * gap) * 100 + 0.5) / 100) AS total,
  CASE WHEN length(trim(transcript)) < 3 THEN 'empty_transcript' WHEN ns > 0.6 THEN 'no_speech_detected' WHEN asr < 0.25 THEN 'asr_confidence_below_floor' END AS early FROM sc),
verdict AS (SELECT query_id, CASE WHEN early IS NOT NULL THEN 'red' WHEN c1 IS NULL OR c1 < 0.3 OR total < 0.55 THEN 'amber' ELSE 'green' END AS state,
  CASE WHEN early IS NOT NULL THEN 0.0::DOUBLE WHEN c1 IS NULL THEN 0.2::DOUBLE WHEN c1 < 0.3 THEN 0.0::DOUBLE ELSE total END AS composite,
  coalesce(early, CASE WHEN c1 IS NULL THEN 'no_candidates_retrieved' WHEN c1 < 0.3 OR (total < 0.55 AND sim < 0.35) THEN 'weak_similarity_match' WHEN total < 0.55 THEN 'narrow_rank_margin' ELSE 'confident_match' END) AS reason FROM tot)"""


def asked_gate(spark, sf_dir):
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").filter(v % 100 == 0).select(
        v.alias("query_id"), F.when(v % 700 == 0, "a").otherwise(F.concat(F.lit("query "), v.cast("string"))).alias("transcript"), (F.lit(-0.22) - (v % 300) / F.lit(250.0)).alias("asr_mean_logprob"),
        F.when(v % 400 == 300, 0.7).otherwise(0.03).alias("asr_no_speech_prob"), (F.lit(7.5) + v % 13).alias("snr_db"),
    )


@query(f"WITH {STANCE}, {ASKED_GATE}, {VERDICT} SELECT * FROM verdict")
def gate_state(spark, sf_dir):
    return G.gate(asked_gate(spark, sf_dir), ranked(spark, sf_dir))


RANKS = """ranks AS (SELECT q.vec_id AS query_id, q.label, coalesce(min(h.rank) FILTER (e.label = q.label AND e.vec_id <> q.vec_id), 0) AS first_ FROM embeddings q JOIN res h ON h.query_id = q.vec_id JOIN embeddings e ON e.vec_id = h.id WHERE q.vec_id % 100 = 0 GROUP BY q.vec_id, q.label)"""
RECALL = f"""{RANKS} SELECT label, count(*) AS n, round(avg(CASE WHEN first_ BETWEEN 1 AND 1 THEN 1.0 ELSE 0 END) * 100, 6) AS recall_1, round(avg(CASE WHEN first_ BETWEEN 1 AND 3 THEN 1.0 ELSE 0 END) * 100, 6) AS recall_3,
  round(avg(CASE WHEN first_ BETWEEN 1 AND 5 THEN 1.0 ELSE 0 END) * 100, 6) AS recall_5, round(avg(CASE WHEN first_ > 0 THEN 1.0::DOUBLE / first_ ELSE 0 END), 6) AS mrr FROM ranks GROUP BY ROLLUP (label)"""


def ranks(spark, sf_dir, results):
    e = table(spark, sf_dir, "embeddings")
    of = e.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "label")
    named = results.join(e.select(F.col("vec_id").alias("id"), F.col("label").alias("got")), "id").join(of.withColumnRenamed("label", "wanted"), "query_id")
    return E.first_ranks(of, named, (F.col("got") == F.col("wanted")) & (F.col("id") != F.col("query_id")))


def _quality(spark, sf_dir, results):
    return rounded(E.quality(ranks(spark, sf_dir, results), "label"), "recall_1", "recall_3", "recall_5", "mrr")


@query(f"WITH {FUSED}, res AS (SELECT query_id, id, rank FROM fused), {RECALL}")
def recall_mrr(spark, sf_dir):
    return _quality(spark, sf_dir, X.fuse(found(spark, sf_dir)).select("query_id", "id", "rank"))


@query(f"WITH {HITS}, res AS (SELECT query_id, id, rank FROM hits WHERE kind = 'obligation'), {RECALL}")
def recall_mrr_baseline(spark, sf_dir):
    return _quality(spark, sf_dir, found(spark, sf_dir).filter("kind = 'obligation'").select("query_id", "id", "rank"))


LIFTS = f"""WITH {FUSED}, res AS (SELECT query_id, id, rank FROM fused), {RANKS}, res2 AS (SELECT query_id, id, rank FROM hits WHERE kind = 'obligation'),
both_ AS (SELECT 'system' AS arm, label, first_ FROM ranks UNION ALL SELECT 'plain', label, first_ FROM ({RANKS.removeprefix('ranks AS (').removesuffix(')').replace('res h', 'res2 h')})),
a AS (SELECT label, arm, count(*) AS n, count(*) FILTER (first_ = 1) AS h1, count(*) FILTER (first_ BETWEEN 1 AND 3) AS h3, count(*) FILTER (first_ BETWEEN 1 AND 5) AS h5, sum(CASE WHEN first_ > 0 THEN 1.0::DOUBLE / first_ ELSE 0 END) AS rr FROM both_ GROUP BY GROUPING SETS ((arm, label), (arm))),
r AS (SELECT label, arm, n, floor(h1::DOUBLE / n * 100 * 10 + 0.5) / 10 AS r1, floor(h3::DOUBLE / n * 100 * 10 + 0.5) / 10 AS r3, floor(h5::DOUBLE / n * 100 * 10 + 0.5) / 10 AS r5, floor(rr / n * 1 * 1000 + 0.5) / 1000 AS mrr FROM a)
SELECT s.label, s.n, s.r1 AS system_recall_1, s.r3 AS system_recall_3, s.r5 AS system_recall_5, s.mrr AS system_mrr, p.r1 AS plain_recall_1, p.r3 AS plain_recall_3, p.r5 AS plain_recall_5, p.mrr AS plain_mrr,
  floor((s.r1 - p.r1) * 10 + 0.5) / 10 AS lift_recall_1, floor((s.r3 - p.r3) * 10 + 0.5) / 10 AS lift_recall_3, floor((s.r5 - p.r5) * 10 + 0.5) / 10 AS lift_recall_5, floor((s.mrr - p.mrr) * 1000 + 0.5) / 1000 AS lift_mrr FROM r s JOIN r p ON s.label IS NOT DISTINCT FROM p.label AND s.arm = 'system' AND p.arm = 'plain'"""


def arm_ranks(spark, sf_dir) -> DataFrame:
    """First ranks in both arms: the fused results, and the first kind's search alone."""
    hits = found(spark, sf_dir)
    arms = {"system": X.fuse(hits), "plain": hits.filter("kind = 'obligation'")}
    each = [ranks(spark, sf_dir, r.select("query_id", "id", "rank")).withColumn("arm", F.lit(a)) for a, r in arms.items()]
    return each[0].unionByName(each[1])


@query(LIFTS)
def arm_lift(spark, sf_dir):
    return E.lift(arm_ranks(spark, sf_dir), "label")


ITEMS = f"WITH {STANCE}, {ASKED_GATE}, {VERDICT}, res AS (SELECT query_id, id, final_rank AS rank FROM nd WHERE final_rank <= 3), {RANKS}, items AS (SELECT query_id, state, composite, label, coalesce(first_, 0) AS first_ FROM verdict LEFT JOIN ranks USING (query_id))"
COUNTS = "counts AS (SELECT count(*) AS n, count(*) FILTER (state = 'green') AS green, count(*) FILTER (state <> 'green') AS other, count(*) FILTER (state = 'green' AND first_ = 0) AS false_confident FROM items)"
RATE = "coalesce(floor(false_confident::DOUBLE / nullif(green, 0) * 100 * 100 + 0.5) / 100, 0.0::DOUBLE)"


def items(spark, sf_dir) -> DataFrame:
    """(query_id, label, first, state, composite): each query's verdict, and where among its cards the first relevant one stands."""
    rows = ranked(spark, sf_dir)
    cards = rows.filter(F.col("final_rank") <= S.CARDS).select("query_id", "id", F.col("final_rank").alias("rank"))
    return ranks(spark, sf_dir, cards).join(G.gate(asked_gate(spark, sf_dir), rows).select("query_id", "state", "composite"), "query_id")


@query(f"{ITEMS}, {COUNTS} SELECT *, {RATE} AS false_confident_pct FROM counts")
def verdict_counts(spark, sf_dir):
    return E.verdict_counts(items(spark, sf_dir))


LIMITS = [0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8]
SWEPT = """floor(coalesce(shown::DOUBLE / n, 0) * 100 * 10 + 0.5) / 10 AS coverage_pct, floor(coalesce(wrong::DOUBLE / nullif(shown, 0), 0) * 100 * 10 + 0.5) / 10 AS wrong_pct, floor(coalesce((n - shown)::DOUBLE / n, 0) * 100 * 10 + 0.5) / 10 AS amber_pct"""
SWEEP = f"""sw AS (SELECT l AS "limit", count(*) AS n, count(*) FILTER (s >= l) AS shown, count(*) FILTER (s >= l AND NOT good) AS wrong FROM (SELECT value / (1 + value) AS s, event_type = 'click' AS good FROM events) e, (SELECT unnest({LIMITS})::DOUBLE AS l) GROUP BY l),
swept AS (SELECT "limit", shown, wrong, {SWEPT}, n FROM sw)"""


def _swept(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("value") / (1 + F.col("value"))).alias("s"), (F.col("event_type") == "click").alias("good"))
    return E.sweep(e, "s", F.col("good"), LIMITS)


@query(f'WITH {SWEEP} SELECT "limit", shown, wrong, coverage_pct, wrong_pct, amber_pct FROM swept')
def threshold_sweep(spark, sf_dir):
    return _swept(spark, sf_dir)


NUMBER = r"regexp_replace(printf('%.2f', {}), '\.?0+$', '')"


@query(f"""WITH {SWEEP} SELECT (row_number() OVER (ORDER BY "limit") + 2)::INTEGER AS place, '| ' || CASE WHEN "limit" = 0.55 THEN '**' || {NUMBER.format('"limit"')} || '** ←' ELSE {NUMBER.format('"limit"')} END || ' | ' || shown || '/' || n || ' | ' || {NUMBER.format('coverage_pct')} || '% | ' || wrong || ' (' || {NUMBER.format('wrong_pct')} || '%) | ' || {NUMBER.format('amber_pct')} || '% |' AS line FROM swept
UNION ALL SELECT 1, '| Threshold | Shown | Coverage | False-confident | Amber rate |' UNION ALL SELECT 2, '|---|---|---|---|---|'""")
def sweep_report(spark, sf_dir):
    n = table(spark, sf_dir, "events").agg(F.count("*").alias("n"))
    return E.sweep_report(_swept(spark, sf_dir).join(n, how="cross"), F.col("n"))  # n is one row


# Stage times of the evaluation: events stand for queries.
MARKS = """SELECT event_id, epoch_us(ts)::DOUBLE / 1000 AS t0, t0 + value AS t1, t1 + (event_id % 7) / 8.0::DOUBLE AS t2, t2 + (event_id % 5) / 4.0::DOUBLE AS t3, t3 + 0.03125::DOUBLE AS t4 FROM events"""
STAGE_SQL = f"""stg AS (SELECT unnest(['build_ms', 'embed_ms', 'search_ms', 'rank_ms', 'total_ms']) AS stage, unnest([t1 - t0, t2 - t1, t3 - t2, t4 - t3, t4 - t0]) AS ms FROM ({MARKS})),
stages AS (SELECT stage, floor(quantile_disc(ms, 0.5) * 100 + 0.5) / 100 AS p50, floor(quantile_disc(ms, 0.95) * 100 + 0.5) / 100 AS p95, floor(avg(ms) * 100 + 0.5) / 100 AS mean FROM stg GROUP BY stage)"""


def marks(spark, sf_dir) -> DataFrame:
    """The times at which a query's stages end; events stand for queries."""
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(i, (F.expr("unix_micros(cast(ts AS timestamp))").cast("double") / 1000).alias("t_speech_end"), "value")
    rows = rows.withColumn("t_query_built", F.col("t_speech_end") + F.col("value")).withColumn("t_embed_done", F.col("t_query_built") + (i % 7) / F.lit(8.0))
    return rows.withColumn("t_search_done", F.col("t_embed_done") + (i % 5) / F.lit(4.0)).withColumn("t_ranked", F.col("t_search_done") + F.lit(0.03125))


def evaluated(spark, sf_dir) -> dict[str, DataFrame]:
    """The parts of an evaluation: items are the cards' first ranks with verdicts, the plain arm is the first kind's search cut to as many results; each third label is adversarial."""
    hard = F.col("label") % 3 == 0
    of = cut(items(spark, sf_dir).withColumn("adversarial", hard), "items")
    hits = found(spark, sf_dir).filter(f"kind = 'obligation' AND rank <= {S.CARDS}").select("query_id", "id", "rank")
    plain = cut(ranks(spark, sf_dir, hits).withColumn("adversarial", hard), "plain")
    arms = of.select(*plain.columns).withColumn("arm", F.lit("system")).unionByName(plain.withColumn("arm", F.lit("plain")))
    return {
        "items": of, "plain": plain, "scores": E.lift(arms, "label"), "hard": E.lift(arms.filter("adversarial"), "label"), "stages": E.stage_summary(E.stage_times(marks(spark, sf_dir))),
        "verdict": E.verdict_counts(of), "swept": E.sweep(of, "composite", F.col("first") > 0, LIMITS),
    }


ARMS = f"""res2 AS (SELECT query_id, id, rank FROM hits WHERE kind = 'obligation' AND rank <= 3), ranks2 AS (SELECT query_id, label, first_ FROM ({RANKS.removeprefix('ranks AS (').removesuffix(')').replace('res h', 'res2 h')})),
pi AS (SELECT i.query_id, i.label, i.state, i.composite, i.first_ AS f1, p.first_ AS f2, i.label % 3 = 0 AS adversarial FROM items i JOIN ranks2 p USING (query_id)),
arm AS (SELECT label, count(*) AS n, {", ".join(f"floor(count(*) FILTER (f{a} BETWEEN 1 AND {k})::DOUBLE / count(*) * 100 * 10 + 0.5) / 10 AS {n}_{k}" for a, n in ((1, "s"), (2, "p")) for k in (1, 3, 5))},
  {", ".join(f"floor(sum(CASE WHEN f{a} > 0 THEN 1.0::DOUBLE / f{a} ELSE 0 END) / count(*) * 1000 + 0.5) / 1000 AS {n}_mrr" for a, n in ((1, "s"), (2, "p")))} FROM pi GROUP BY GROUPING SETS ((label), ())),
hard AS (SELECT count(*) AS n, {", ".join(f"floor(count(*) FILTER (f{a} BETWEEN 1 AND {k})::DOUBLE / count(*) * 100 * 10 + 0.5) / 10 AS {n}_{k}" for a, n in ((1, "s"), (2, "p")) for k in (1, 3, 5))} FROM pi WHERE adversarial HAVING count(*) > 0),
sw AS (SELECT l AS "limit", count(*) AS n, count(*) FILTER (composite >= l) AS shown, count(*) FILTER (composite >= l AND first_ = 0) AS wrong FROM items, (SELECT unnest({LIMITS})::DOUBLE AS l) GROUP BY l), swept AS (SELECT "limit", shown, wrong, {SWEPT}, n FROM sw)"""


@query(f"""{ITEMS}, {COUNTS}, {ARMS}, {STAGE_SQL}
SELECT part, "limit", a::DOUBLE AS a, b::DOUBLE AS b, pct FROM (SELECT 'verdicts' AS part, NULL::DOUBLE AS "limit", green AS a, false_confident AS b, {RATE} AS pct FROM counts UNION ALL SELECT 'sweep', "limit", shown, wrong, wrong_pct FROM swept
UNION ALL SELECT 'system', label::DOUBLE, n, n, s_1 FROM arm UNION ALL SELECT 'plain', label::DOUBLE, n, n, p_1 FROM arm UNION ALL SELECT 'hard', NULL, n, n, s_3 FROM hard UNION ALL SELECT 'hard plain', NULL, n, n, p_3 FROM hard UNION ALL SELECT stage, NULL, NULL, NULL, p95 FROM stages)""")
def calibration_result(spark, sf_dir):
    """The nested result of the evaluation of both arms as JSON, read back: its verdicts, sweep, recall, adversarial part and times as rows."""
    e = evaluated(spark, sf_dir)
    text = E.calibration(e["scores"], e["verdict"], e["swept"], e["hard"], e["stages"])
    score = "system_recall_1:double,plain_recall_1:double,system_recall_3:double,plain_recall_3:double"
    form = f"recall array<struct<label:double,n:long,{score}>>, adversarial struct<n:long,{score}>, latency_ms array<struct<stage:string,p95:double>>, gate struct<green:long,false_confident:long,false_confident_pct:double,sweep:array<struct<limit:double,shown:long,wrong:long,wrong_pct:double>>>"
    back = text.select(F.from_json("json", form).alias("j"))
    none = F.lit(None)
    row = lambda part, limit, a, b, pct: F.struct((part if isinstance(part, Column) else F.lit(part)).alias("part"), limit.cast("double").alias("limit"), a.cast("double").alias("a"), b.cast("double").alias("b"), pct.alias("pct"))
    g, h = F.col("j.gate"), F.col("j.adversarial")
    parts = [F.array(row("verdicts", none, g["green"], g["false_confident"], g["false_confident_pct"])), F.transform(g["sweep"], lambda s: row("sweep", s["limit"], s["shown"], s["wrong"], s["wrong_pct"]))]
    recalled = lambda a: F.transform("j.recall", lambda r: row(a, r["label"], r["n"], r["n"], r[f"{a}_recall_1"]))
    parts += [recalled("system"), recalled("plain")]
    parts += [F.filter(F.array(row(n, none, h["n"], h["n"], h[f"{a}_recall_3"])), lambda r: r["a"].isNotNull()) for n, a in (("hard", "system"), ("hard plain", "plain"))]
    parts.append(F.transform("j.latency_ms", lambda s: row(s["stage"], none, none, none, s["p95"])))
    return back.select(F.explode(F.concat(*parts)).alias("r")).select("r.*")


@query(f"{ITEMS}, {ARMS} SELECT query_id, nullif(f1, 0)::DOUBLE AS rank, nullif(f2, 0)::DOUBLE AS plain_rank, adversarial, state, composite, f1 > 0 AS hit FROM pi")
def calibration_items(spark, sf_dir):
    e = evaluated(spark, sf_dir)
    return E.per_item(e["items"], e["plain"]).withColumns({c: F.col(c).cast("double") for c in ("rank", "plain_rank")})


THREE = r"regexp_replace(printf('%.3f', ({})::DOUBLE), '\.?0+$', '')"


@query(f"""{ITEMS}, {COUNTS}, {ARMS}, {STAGE_SQL}, al AS (SELECT * FROM arm WHERE label IS NULL), rate AS (SELECT *, {RATE} AS pct FROM counts),
lines AS (SELECT 0 AS part, i - 7 AS pos, x AS line FROM (SELECT unnest(range(1, 7)) AS i, unnest(['# Evaluation', '', '## Retrieval', '', '| Measure | System | Plain | Lift |', '|---|---|---|---|']) AS x)
UNION ALL {" UNION ALL ".join(f"SELECT 0, {i}, '| {name} | ' || {THREE.format('s_' + m)} || ' | ' || {THREE.format('p_' + m)} || ' | ' || {THREE.format(f'floor((s_{m} - p_{m}) * {k} + 0.5) / {k}')} || ' |' FROM al" for i, (m, name, k) in enumerate((("1", "Recall@1 (%)", 10), ("3", "Recall@3 (%)", 10), ("5", "Recall@5 (%)", 10), ("mrr", "MRR", 1000)), 1))}
UNION ALL SELECT 1, i - 6, x FROM (SELECT unnest(range(1, 6)) AS i, unnest(['', '### Adversarial queries', '', '| Measure | System | Plain | Lift |', '|---|---|---|---|']) AS x)
UNION ALL {" UNION ALL ".join(f"SELECT 1, {i}, '| Recall@{m} (%) | ' || {THREE.format('s_' + m)} || ' | ' || {THREE.format('p_' + m)} || ' | ' || {THREE.format(f'floor((s_{m} - p_{m}) * 10 + 0.5) / 10')} || ' |' FROM hard" for i, m in enumerate(("1", "3"), 1))}
UNION ALL SELECT 2, i - 6, x FROM (SELECT unnest(range(1, 6)) AS i, unnest(['', '## Times (ms)', '', '| Stage | p50 | p95 | Mean | Budget |', '|---|---|---|---|---|']) AS x)
UNION ALL SELECT 2, list_position(['build_ms', 'embed_ms', 'search_ms', 'rank_ms', 'total_ms'], stage), '| ' || stage || ' | ' || {THREE.format('p50')} || ' | ' || {THREE.format('p95')} || ' | ' || {THREE.format('mean')} || ' | ' || CASE WHEN stage <> 'search_ms' THEN '' WHEN p95 < 10 THEN 'within 10' ELSE 'over 10' END || ' |' FROM stages
UNION ALL SELECT 3, i - 6, x FROM (SELECT unnest(range(1, 6)) AS i, unnest(['', '## Gate', '', '| Verdict | Value |', '|---|---|']) AS x)
UNION ALL SELECT 3, 1, '| Queries | ' || n || ' |' FROM rate UNION ALL SELECT 3, 2, '| Green | ' || green || ' |' FROM rate UNION ALL SELECT 3, 3, '| Amber or red | ' || other || ' |' FROM rate UNION ALL SELECT 3, 4, '| Green without a relevant card | ' || false_confident || ' |' FROM rate
UNION ALL SELECT 3, 5, '| Share of the green (%) | ' || {THREE.format('pct')} || CASE WHEN pct <= 5 THEN ', within 5' ELSE ', over 5' END || ' |' FROM rate
UNION ALL SELECT 4, i - 6, x FROM (SELECT unnest(range(1, 6)) AS i, unnest(['', '### Limits', '', '| Threshold | Shown | Coverage | False-confident | Amber rate |', '|---|---|---|---|---|']) AS x)
UNION ALL SELECT 4, row_number() OVER (ORDER BY "limit"), '| ' || CASE WHEN "limit" = 0.55 THEN '**' || {NUMBER.format('"limit"')} || '** ←' ELSE {NUMBER.format('"limit"')} END || ' | ' || shown || '/' || n || ' | ' || {NUMBER.format('coverage_pct')} || '% | ' || wrong || ' (' || {NUMBER.format('wrong_pct')} || '%) | ' || {NUMBER.format('amber_pct')} || '% |' FROM swept)
SELECT row_number() OVER (ORDER BY part, pos)::INTEGER AS place, line FROM lines""")
def evaluation_report(spark, sf_dir):
    """The whole report of an evaluation as Markdown."""
    e = evaluated(spark, sf_dir)
    return E.report(e["scores"], e["hard"], e["stages"], e["verdict"], e["swept"])


GOLD = "SELECT vec_id, [vec_id + 1, vec_id + 2] AS gold, [vec_id + 2, vec_id + label] AS acceptable, label % 3 = 0 AS adversarial FROM embeddings"


@query(f"WITH g AS ({GOLD}), l AS (SELECT vec_id, CASE WHEN adversarial THEN list_sort(list_distinct(gold)) ELSE list_sort(list_distinct(gold || acceptable)) END AS ids FROM g) SELECT vec_id, array_to_string(ids, ',') AS ids FROM l")
def gold_sets(spark, sf_dir):
    v, label = F.col("vec_id"), F.col("label")
    ids = E.gold_ids(F.array(v + 1, v + 2), F.array(v + 2, v + label), label % 3 == 0)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.array_sort(ids).cast("array<string>"), ",").alias("ids"))
