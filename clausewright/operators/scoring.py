"""Parsing and expanding assertions, stance scores, the confidence gate and the cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright import settings as S
from clausewright.functions import text as T
from clausewright.operators.dictionary import contained_terms


def parse_assertions(queries: DataFrame, terms: DataFrame | None = None, text: str = "transcript") -> DataFrame:
    """Adds raw, subject, obligation, instrument and qualifiers; without a known term, the first four telling words are the subject.

    terms: (term, place), the corpus' defined terms in lower case.
    """
    raw = F.trim(text)
    low = F.lower(raw)
    words = F.filter(F.split(F.regexp_replace(low, r"[^a-z0-9\s-]", " "), r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(*S.STOP_WORDS, *S.OBLIGATION_WORDS))
    if terms is None:
        known = F.array().cast("array<string>")
    else:
        queries = queries.join(contained_terms(queries, terms, text=text), "query_id", "left")
        known = F.coalesce("known", F.array().cast("array<string>"))
    subject = F.when(F.size(known) > 0, known).otherwise(F.slice(words, 1, 4))
    return queries.withColumns({"raw": raw, "subject": F.array_distinct(subject), "obligation": T.found_in(raw, S.OBLIGATION_WORDS), "instrument": T.found_in(raw, S.INSTRUMENTS), "qualifiers": F.array_distinct(F.regexp_extract_all(raw, F.lit(S.QUALIFIERS), 1))}).drop("known")


def expansions(parsed: DataFrame) -> DataFrame:
    """(query_id, kind, kind_ord, weight, text): four clause forms that an assertion supposes."""
    raw = F.col("raw")
    subject = F.when(F.size("subject") > 0, F.array_join("subject", " ")).otherwise(raw)
    extra = F.when(F.size("qualifiers") > 0, F.concat(F.lit(" "), F.array_join("qualifiers", " "))).otherwise(F.lit(""))
    under = F.coalesce(F.get("instrument", F.lit(0)), F.lit("this Agreement"))
    # The wording of the forms (the SQL that tests them repeats it).
    forms = {
        "obligation": (" Under ", under, ", ", subject, extra, " shall not exceed the applicable minimum thresholds, and the Company shall comply with such covenants at all times."),
        "exception": (" Notwithstanding the foregoing, ", subject, extra, " shall be exempt from such thresholds, and this provision shall not apply, provided that the applicable conditions are satisfied."),
        "definition": (" For purposes of ", under, ', "', subject, '" means the amount so calculated and shall have the meaning set forth in this Section.'),
        "remedy": (" In the event of any breach with respect to ", subject, extra, ", the sole and exclusive remedy shall be as set forth herein, subject to the applicable cure period."),
    }
    text = lambda parts: F.concat(raw, *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(i).alias("kind_ord"), F.lit(S.KINDS[k]).alias("weight"), text(p).alias("text")) for i, (k, p) in enumerate(forms.items())])
    return parsed.select("query_id", F.explode(rows).alias("e")).select("query_id", "e.*")


def stance(candidates: DataFrame) -> DataFrame:
    """Adds stance, stance_confidence, reasons and matched_terms.

    candidates: has_exception, has_obligation, has_definition, matched_markers, refs, text, subject, qualifiers, best_kind, xref_from.
    """
    low = F.lower("text")
    exception, obligation = F.col("has_exception"), F.col("has_obligation")
    by_exception, by_obligation = F.coalesce(F.col("best_kind") == "exception", F.lit(False)), F.coalesce(F.col("best_kind") == "obligation", F.lit(False))
    from_ref, own_ref = F.col("xref_from").isNotNull() & exception, F.col("xref_from").isNull() & (F.size("refs") > 0) & exception
    near = T.any_in(F.col("text"), S.EXEMPTING) & F.exists("subject", lambda s: F.contains(low, F.lower(s)))
    points = lambda *of: sum((F.when(c, F.lit(p)).otherwise(F.lit(0.0)) for c, p in of), F.lit(0.0))
    pro = points((exception, 2.0), (by_exception, 1.5), (from_ref | own_ref, 1.0), (near, 1.2))
    con = points((obligation, 1.5), (~by_exception & by_obligation, 1.0))
    conf = F.abs(pro - con) / (pro + con + 1e-6)
    short = F.col("has_definition") & ~exception
    said = F.filter(F.array(
        F.when(exception, F.concat(F.lit("exception marker: '"), F.coalesce(F.get("matched_markers", F.lit(0)), F.lit("exception language")), F.lit("'"))),
        F.when(obligation, F.lit("contains obligation language ('shall / must / not exceed')")), F.when(by_exception, F.lit("matched hypothetical exception/carve-out expansion")),
        F.when(~by_exception & by_obligation, F.lit("matched hypothetical obligation expansion")), F.when(from_ref, F.concat(F.lit("modifies/carves out "), F.col("xref_from"))),
        F.when(own_ref, F.concat(F.lit("xref → §"), F.get("refs", F.lit(0)))), F.when(near, F.lit("subject appears within exempting/carve-out scope")),
    ), lambda r: r.isNotNull())
    terms = F.array_distinct(F.filter(F.concat("subject", "qualifiers", F.array(*map(F.lit, S.TOPICAL))), lambda t: (F.length(t) > 1) & F.contains(low, F.lower(t))))
    return candidates.withColumns({
        "stance": F.when(short | (conf < S.STANCE_MIN), "context").when(pro >= con, "supports").otherwise("against"),
        "stance_confidence": F.when(short, F.lit(0.88)).otherwise(T.rounded(T.clamp(conf, 0.5, 0.99), 2)),
        "reasons": F.when(short, F.array(F.lit("definitional clause"))).when(F.size(said) == 0, F.array(F.lit("topical relevance"))).otherwise(said), "matched_terms": terms,
    })


def nudge(ranked: DataFrame) -> DataFrame:
    """Re-ranks: for an accusation, supporting carve-outs that score near the top move up. Adds final_rank."""
    top = F.max("fused").over(Window.partitionBy("query_id"))
    good = F.col("accusatory") & (F.col("stance") == "supports") & F.col("has_exception") & (F.col("fused") >= S.NUDGE_SHARE * top)
    key = F.col("fused") + F.when(good, F.lit(S.NUDGE)).otherwise(F.lit(0.0))
    return ranked.withColumn("sort_key", key).withColumn("final_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sort_key"), "rank")))


def early_gate(queries: DataFrame) -> DataFrame:
    """Adds early: why a query is refused before any search, or null."""
    why = (
        F.when(F.length(F.trim("transcript")) < 3, "empty_transcript")
        .when(F.col("asr_no_speech_prob") > S.NO_SPEECH, "no_speech_detected")
        .when(T.asr_confidence(F.col("asr_mean_logprob")) < S.ASR_FLOOR, "asr_confidence_below_floor")
    )
    return queries.withColumn("early", why)


def gate(queries: DataFrame, ranked: DataFrame, early: bool = True) -> DataFrame:
    """(query_id, state, composite, reason) for every query from the cosines of its first two results (query_id, final_rank, best_cosine).

    early: whether queries that are refused before a search are red; the plain arm has no such step.
    """
    tops = ranked.filter("final_rank <= 2").groupBy("query_id").agg(F.max(F.when(F.col("final_rank") == 1, F.col("best_cosine"))).alias("c1"), F.max(F.when(F.col("final_rank") == 2, F.col("best_cosine"))).alias("c2"))
    q = (early_gate(queries) if early else queries.withColumn("early", F.lit(None).cast("string"))).join(tops, "query_id", "left")
    sim = T.clamp((F.col("c1") - S.SIM_FLOOR) / (S.SIM_CEIL - S.SIM_FLOOR), 0.0, 1.0)
    gap = F.coalesce(T.clamp(F.greatest(F.lit(0.0), F.col("c1") - F.col("c2")) / S.MARGIN_CEIL, 0.0, 1.0), F.lit(0.0))
    asr = T.asr_confidence(F.col("asr_mean_logprob"))
    total = T.rounded(S.W_ASR * asr + S.W_SNR * T.clamp((F.col("snr_db") - 6) / 18, 0.0, 1.0) + S.W_SIM * sim + S.W_MARGIN * gap, 2)
    total = F.least(total, F.lit(0.99))
    low = F.col("c1") < S.SIM_FLOOR
    return q.select(
        "query_id", F.when(F.col("early").isNotNull(), "red").when(F.col("c1").isNull() | low | (total < S.AMBER), "amber").otherwise("green").alias("state"),
        F.when(F.col("early").isNotNull() | low, F.lit(0.0)).when(F.col("c1").isNull(), F.lit(0.2)).otherwise(total).alias("composite"),
        F.coalesce("early", F.when(F.col("c1").isNull(), "no_candidates_retrieved").when(low | ((total < S.AMBER) & (sim < 0.35)), "weak_similarity_match").when(total < S.AMBER, "narrow_rank_margin").otherwise("confident_match")).alias("reason"),
    )
