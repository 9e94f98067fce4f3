"""Scalar text functions over columns; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright import settings as S


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value worked out once a row, however often and in whatever lambdas `then` uses it."""
    return F.transform(F.array(value), then)[0]


def free(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def collapse(text: Column) -> Column:
    """White space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def dehyphenate(text: Column) -> Column:
    return F.regexp_replace(F.when(F.contains(text, F.lit("-")), F.regexp_replace(text, r"([a-z])-\s+([a-z])", "$1$2")).otherwise(text), r"\s+", " ")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_")


def title(name: Column) -> Column:
    """Of a file: no folder, no ending, blanks for underscores, words capitalised (after any sign that isn't a letter, digit or line) with the rest as it is."""
    base = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"^.*[\\/]", ""), r"\.[^.]+$", ""), "_", " ")
    parts = F.split(base, r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])")  # each but perhaps the first begins a word
    return F.array_join(F.transform(parts, lambda w: F.concat(F.translate(F.substring(w, 1, 1), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.substring(w, 2, 1 << 30))), "")


def _found(low: Column, terms: list[str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t.lower())), F.lit(t)) for t in terms])) if terms else F.array().cast("array<string>")


def _any(low: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(t.lower())) for t in terms], F.lit(False))


def found_in(text: Column, terms: list[str]) -> Column:
    """Those of the terms that the text contains in any case, in order."""
    return let(F.lower(text), lambda low: _found(low, terms))


def any_in(text: Column, terms: list[str]) -> Column:
    return let(F.lower(text), lambda low: _any(low, terms))


def cross_refs(text: Column, own: Column) -> Column:
    """Numbers of the clauses that the text cites, without its own, each once in order."""
    refs = F.regexp_extract_all(text, F.lit(r"(?i)(?:§+|Section\s+)(\d+(?:\.\d+)*(?:\([a-z0-9]+\))*)"), 1)
    return F.array_distinct(F.filter(refs, lambda r: F.lower(F.concat(F.lit("§"), r)) != F.lower(own)))


def quoted_terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r'"([A-Z][A-Za-z0-9\s-]{1,35})"'), 1))


def signals(text: Column, exception=S.EXCEPTION_MARKERS, obligation=S.OBLIGATION_MARKERS, definition=S.DEFINITION_MARKERS, remedy=S.REMEDY_MARKERS) -> Column:
    """Struct of four booleans and the exception markers that matched; the text is lower-cased once for all of them."""
    return let(F.lower(text), lambda low: F.struct(
        _any(low, exception).alias("has_exception"), _any(low, obligation).alias("has_obligation"), _any(low, definition).alias("has_definition"),
        _any(low, remedy).alias("has_remedy"), _found(low, exception).alias("matched_markers"),
    ))


def highlight(text: Column, terms: list[str]) -> Column:
    """The text with each term of more than two characters in <b>."""
    long = [F.regexp_replace(F.lit(t), r"([\\.^$|?*+()\[\]{}])", r"\\$1") for t in terms if len(t) > 2]
    return F.regexp_replace(text, F.concat(F.lit("(?i)("), F.array_join(F.array(*long), "|"), F.lit(")")), F.lit("<b>$1</b>")) if long else text


def rounded(x: Column, places: int) -> Column:
    """Half up on the binary value, alike in every engine."""
    return F.floor(x * 10**places + 0.5) / 10**places


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def asr_confidence(logprob: Column) -> Column:
    return 1 / (1 + F.exp(-3 * (logprob + 0.8)))


def recognised(text: Column, rms: Column, audio_ms: Column) -> Column:
    """Struct (mean_logprob, no_speech) estimated from a transcript, its energy and its length."""
    words = F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda w: w != "")
    q = F.least(F.lit(1.0), rms / 0.05)
    pair = lambda a, b: F.struct(F.lit(a).cast("double").alias("mean_logprob") if not isinstance(a, Column) else a.alias("mean_logprob"), (F.lit(b).cast("double") if not isinstance(b, Column) else b).alias("no_speech"))
    return (
        F.when(rms < 0.005, pair(-2.5, 0.95))
        .when(F.trim(text) == "", pair(-2.2, 0.9))
        .when(F.length(F.trim(text)) / (audio_ms / 1000) < 3, pair(-1.4, 0.45))
        .when((F.size(words) > 6) & (F.size(F.array_distinct(words)) / F.size(words) < 0.35), pair(-1.5, 0.5))
        .otherwise(pair(-0.6 + 0.4 * q, F.greatest(F.lit(0.02), 0.2 - 0.18 * q)))
    )
