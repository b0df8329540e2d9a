"""Models behind an interface, called in batches inside Arrow UDFs; a deterministic stand-in for tests and queries."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class TextEmbedder(ABC):
    """Vectors of a batch of texts. Pickled to the executors: hold settings, and open connections lazily."""

    dim: int
    batch = 256

    @abstractmethod
    def embed(self, texts: list[str]) -> np.ndarray: ...


class Recogniser(ABC):
    """Words (text, start, end, confidence) of a batch of audio chunks."""

    @abstractmethod
    def recognise(self, chunks: list[bytes]) -> list[list[tuple[str, float, float, float]]]: ...


class Describer(ABC):
    """A text or JSON description of a batch of prompts with frames."""

    @abstractmethod
    def describe(self, prompts: list[str], frames: list[list[bytes]]) -> list[str]: ...


class Ocr(ABC):
    """Lines (text, x, y, w, h in fractions, confidence) of a batch of frames."""

    @abstractmethod
    def read(self, frames: list[bytes]) -> list[list[tuple[str, float, float, float, float, float]]]: ...


class ImageEmbedder(ABC):
    """Vectors of a batch of frames, in one space with those of query texts."""

    dim: int
    batch = 64

    @abstractmethod
    def embed_frames(self, frames: list[bytes]) -> np.ndarray: ...

    @abstractmethod
    def embed_queries(self, texts: list[str]) -> np.ndarray: ...


class Reranker(ABC):
    """How well each of some texts answers a query."""

    @abstractmethod
    def score(self, query: str, texts: list[str]) -> list[float]: ...


class Llm(ABC):
    """Replies to a batch of prompts."""

    @abstractmethod
    def generate(self, prompts: list[str]) -> list[str]: ...


class SpeechScorer(ABC):
    """The probability of speech in each hop of a batch of audio chunks."""

    @abstractmethod
    def probabilities(self, chunks: list[bytes]) -> list[list[float]]: ...


class OverlapReranker(Reranker):
    """The share of the query's words that a text has."""

    def score(self, query, texts):
        want = set(query.lower().split())
        return [len(want & set(t.lower().split())) / max(1, len(want)) for t in texts]


def reranked(hits: DataFrame, query: str, model: Reranker, k: int, text: str = "text") -> DataFrame:
    """The ``k`` best of ``hits`` (id, text, ...) by the model, asked in batches; ties go to the smaller id."""

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(query, x.fillna("").tolist()), dtype=float)

    return hits.withColumn("relevance", run(F.col(text))).orderBy(F.desc("relevance"), "id").limit(k)


def scored_speech(chunks: DataFrame, model: SpeechScorer, audio: str = "audio") -> DataFrame:
    """``chunks`` with ``probabilities`` of each hop; null audio has none."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(model.probabilities([b or b"" for b in x]), dtype=object)

    return chunks.withColumn("probabilities", run(F.col(audio))).drop(audio)


class HashingEmbedder(TextEmbedder):
    """Counts of hashed words, scaled to length one."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts):
        import zlib

        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % self.dim] += 1 if h >> 31 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def embedded(rows: DataFrame, model: TextEmbedder, text: str = "text") -> DataFrame:
    """``rows`` with ``vector``; the model sees batches of its own size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = [model.embed(b[text].iloc[i : i + model.batch].tolist()) for i in range(0, len(b), model.batch)]
            yield b.assign(vector=list(np.concatenate(parts)) if parts else [])

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))]))
