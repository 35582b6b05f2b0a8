"""Plug points for models: embedders, rerankers, translators and answer writers, each with an offline stand-in.

The stand-ins are deterministic and lexical; their scores are not those of a model.
"""

from __future__ import annotations

import hashlib
import logging
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostra.functions import text as T


log = logging.getLogger(__name__)


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


def hashing_embedder(size: int = 64) -> Embedder:
    """Signed counts of hashed tokens, of unit length."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), size))
        for row, text in zip(out, texts, strict=True):
            for token in re.findall("[a-z0-9]+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest())
                row[h % size] += 1 if h >> 32 & 1 else -1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()

    return embed


def embed(df: DataFrame, make: Callable[[], Embedder], text: str = "text", column: str = "embedding", batch: int = 32) -> DataFrame:
    """df with the vector of each text; each worker makes one embedder and calls it with ``batch`` texts."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = make()
        for values in batches:
            texts = [t or "" for t in values.to_pylist()]
            yield pa.array([v for at in range(0, len(texts), batch) for v in own(texts[at : at + batch])], pa.list_(pa.float32()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn(column, F.arrow_udf(run, "array<float>")(F.col(text)))


def with_translations(queries: DataFrame, translate: Callable[[str], str | None], qkey: str = "query_id") -> DataFrame:
    """(qkey, version, text): each query and, unless it is Malay already, its translation; a failed, empty or equal one is left out. For a table of questions."""
    rows = []
    for r in queries.select(qkey, "text", T.question_language(F.col("text")).alias("lang")).toLocalIterator():
        rows.append((r[0], 0, r.text))
        if r.lang != "ms":
            try:
                answer = translate(r.text) or ""
            except Exception as error:  # a plug point: whatever fails there leaves the question as it is
                log.warning("no translation of %r: %s", r.text, error)
                answer = ""
            made = re.sub(r"(?s)<think>.*?(</think>|$)", "", answer).strip().strip('"“”').splitlines()
            if made and made[0].strip() and made[0].strip().lower() != r.text.lower():
                rows.append((r[0], 1, made[0].strip()))
    return queries.sparkSession.createDataFrame(rows, f"{qkey} {queries.schema[qkey].dataType.simpleString()}, version int, text string")


class ProviderError(Exception):
    """An answer writer failed."""


class Failover:
    """Answer writers in order: the next one is tried only while nothing was given out yet."""

    def __init__(self, writers: dict[str, Callable[[str], Iterator[str]]]):
        self.writers, self.used = writers, None

    def stream(self, prompt: str) -> Iterator[str]:
        failed = []
        for name, writer in self.writers.items():
            begun = False
            try:
                for piece in writer(prompt):
                    begun, self.used = True, name
                    yield piece
                return
            except ProviderError as error:
                if begun:
                    raise
                failed.append(f"{name}: {error}")
        raise ProviderError("; ".join(failed) or "no writer")


def extractive(prompt: str) -> Iterator[str]:
    """The offline writer: the first sentence of the first source, cited."""
    first = prompt.partition("\n\n")[2].partition("\n")[2].partition("\n\n")[0]
    yield f'"{first[:120].strip()}" [1]'
