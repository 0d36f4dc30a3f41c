"""Embedding of texts: only distinct texts missing from the cache are encoded."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import hashed_bag_of_words

Encoder = Callable[[list[str]], np.ndarray]


def text_key(model: Column, normalization: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", model, normalization, text), 256)


def encode_batches(texts: DataFrame, encoder_factory: Callable[[], Encoder]) -> DataFrame:
    """(text_key, text) to (text_key, vector) with one encoder per Python worker.

    The factory runs inside the worker, so a model is loaded once per worker and never shipped.
    Rows of wrong shape or with non-finite values fail the job.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = None
        for pdf in batches:
            if pdf.empty:
                continue
            encode = encode or encoder_factory()
            rows = np.asarray(encode(pdf["text"].tolist()), dtype="float32")
            if rows.ndim != 2 or len(rows) != len(pdf) or rows.shape[1] == 0:
                raise ValueError("encoder returned an unexpected shape")
            if not np.isfinite(rows).all():
                raise ValueError("encoder returned a non-finite vector")
            yield pd.DataFrame({"text_key": pdf["text_key"], "vector": list(rows)})

    return texts.select("text_key", "text").mapInPandas(run, "text_key string, vector array<float>")


def missing_texts(
    texts: DataFrame, cache: DataFrame, model: str, normalization: str
) -> DataFrame:
    """Distinct (text_key, text) absent from ``cache`` (keyed by model, normalisation and text)."""
    keyed = texts.select(
        text_key(F.lit(model), F.lit(normalization), F.col("text")).alias("text_key"), "text"
    )
    # a frequent text collapses to one row per map task before any shuffle
    return keyed.dropDuplicates(["text_key"]).join(cache.select("text_key"), "text_key", "left_anti")


def incremental_embed(
    texts: DataFrame,
    cache: DataFrame,
    model: str,
    normalization: str,
    encoder_factory: Callable[[], Encoder] | None = None,
    dimension: int = 64,
) -> DataFrame:
    """New cache rows (text_key, model_version, normalization_version, vector)."""
    todo = missing_texts(texts, cache, model, normalization)
    if encoder_factory is None:
        encoded = todo.select(
            "text_key", hashed_bag_of_words(F.col("text"), dimension).alias("vector")
        )
    else:
        encoded = encode_batches(todo, encoder_factory)
    return encoded.select(
        "text_key",
        F.lit(model).alias("model_version"),
        F.lit(normalization).alias("normalization_version"),
        "vector",
    )


def vectors_from_cache(
    complaints: DataFrame, cache: DataFrame, model: str, normalization: str
) -> DataFrame:
    """(id, vector) for complaints by their normalised text.

    Text is the key: a text shared by a large share of all reports is split over several tasks.
    """
    from ..operators.skew import lookup

    keyed = complaints.select(
        "id",
        text_key(F.lit(model), F.lit(normalization), F.col("normalized_text")).alias("text_key"),
    )
    return lookup(
        keyed, cache.select("text_key", "vector"), ["text_key"], spread_by="id"
    ).select("id", "vector")
