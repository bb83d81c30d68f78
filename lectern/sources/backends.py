"""Model seams with deterministic offline defaults: OCR, recognizer, embedder, language model.

A seam is a function from rows to rows, run by mapInPandas: a model is loaded once in a worker and fed in batches.
Offline, language-model answers are replayed from a table and embeddings are hashed bags of words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.buckets import KEY
from lectern.plans.stage import small_batches

DIM = 64


@lru_cache(1 << 16)
def _place(word: str) -> tuple[int, float]:
    """A word's dimension and sign; frequent words are hashed once in a worker."""
    h = hashlib.sha256(word.encode()).digest()
    return h[0] % DIM, 1.0 if h[1] & 1 else -1.0


def hashed_bag(texts: list[str]) -> list[list[float]]:
    """An embedding that needs no model: word hashes with signs."""
    out = []
    for text in texts:
        v = [0.0] * DIM
        for w in text.lower().split():
            d, sign = _place(w)
            v[d] += sign
        out.append(v)
    return out


def embed(strings: DataFrame, column: str, encode: Callable[[list[str]], list[list[float]]] = hashed_bag) -> DataFrame:
    """(column, v) of the distinct strings: each is embedded once, whatever the number of rows that use it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({column: frame[column], "v": encode(frame[column].tolist()) if len(frame) else []})

    return strings.select(column).where(F.col(column).isNotNull()).distinct().mapInPandas(run, f"`{column}` string, v array<double>")


def embed_texts(rows: DataFrame, keys: tuple[str, ...], column: str, encode: Callable[[list[str]], list[list[float]]] = hashed_bag) -> DataFrame:
    """keys, v of rows with long strings: each distinct one is embedded once, and is shuffled once, by its digest."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"digest": frame["digest"], "v": encode(frame[column].tolist()) if len(frame) else []})

    small_batches(rows.sparkSession)
    named = rows.where(F.col(column).isNotNull()).select(*keys, column, F.sha2(F.col(column).cast("binary"), 256).alias("digest"))
    vectors = named.groupBy("digest").agg(F.first(column).alias(column)).mapInPandas(run, "digest string, v array<double>")
    return named.select(*keys, "digest").join(vectors, "digest").drop("digest")


def replay(prompts: DataFrame, answers: DataFrame) -> DataFrame:
    """KEY, response: answers (KEY, response) for the prompted slides; slides without an answer fail, as a model may."""
    return prompts.select(*KEY).join(answers, list(KEY), "left").select(*KEY, "response")


class RateLimited(Exception):
    pass


def invoke(prompts: DataFrame, primary: Callable[[str], str], secondary: Callable[[str], str], tries: int = 3, pause: Callable[[], None] = lambda: None, clients: int = 2) -> DataFrame:
    """KEY, response of a hosted model: the secondary where the primary is limited, a pause where both are, null for
    other errors. `clients` partitions cap the rate."""

    def one(prompt: str) -> str | None:
        for _ in range(tries):
            for model in (primary, secondary):
                try:
                    return model(prompt)
                except Exception as e:  # noqa: BLE001
                    if not (isinstance(e, RateLimited) or "429" in str(e) or "rate" in str(e).lower()):
                        return None
            pause()
        return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = frame[list(KEY)].copy()
            out["response"] = [one(p) for p in frame["prompt"]]
            yield out

    kinds = {f.name: f.dataType.simpleString() for f in prompts.schema.fields}
    return prompts.select(*KEY, "prompt").repartition(clients).mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in KEY) + ", response string")
