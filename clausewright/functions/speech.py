"""The seam for speech models: what one must offer, and its use on columns. No model is part of this library."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf


class Transcript(NamedTuple):
    text: str
    decode_ms: float


class Recogniser(Protocol):
    def transcribe(self, samples: np.ndarray, prompt: str) -> Transcript: ...


class ModelUnavailable(RuntimeError):
    """There is no speech model; nothing else is used in its place."""


def no_model() -> Recogniser:
    raise ModelUnavailable("no speech model is installed: pass a function that makes one")


def domain_prompt(terms: Column) -> Column:
    """What a recogniser is told about a corpus, from its defined terms (array); empty without any."""
    # Fixed value: the wording.
    return F.when(F.size(terms) > 0, F.concat(F.lit("The following is a discussion of a term sheet: "), F.array_join(terms, ", "), F.lit("."))).otherwise("")


def transcribe_with(make: Callable[[], Recogniser] = no_model, prompt: str = ""):
    """An Arrow-batched function from samples (array of float) to (text, decode_ms); make() runs once a worker task."""

    @pandas_udf("text string, decode_ms double")
    def transcribe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            yield pd.DataFrame([model.transcribe(np.asarray(x, np.float32), prompt) for x in batch], columns=["text", "decode_ms"])

    return transcribe
