"""Models as plug-ins: embeddings in Arrow batches, rerankers over pairs, loaded once in a process."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondera.config import ConfigError, Model
from sondera.functions import vectors as vx

_loaded: dict[tuple, object] = {}


class EmbeddingError(RuntimeError):
    """A model gave no vectors, or too few."""


class EmbeddingProvider(Protocol):
    """What an embedding model has to offer; it must be picklable without its weights."""

    dimensions: int | None

    def embed_texts(self, texts: list[str]) -> np.ndarray: ...

    def embed_query(self, text: str) -> np.ndarray: ...


class HashEmbedding:
    """Deterministic unit vectors from digests, in SQL: for tests, and where no model is."""

    def __init__(self, dimensions: int = 64):
        if dimensions < 1:
            raise ConfigError("dimensions must be at least 1")
        self.dimensions = dimensions

    def embed_texts(self, texts: list[str]) -> np.ndarray:
        import hashlib

        rows = [np.resize(np.frombuffer(hashlib.sha256(t.encode()).digest(), np.uint8), self.dimensions) / 255.0 * 2 - 1 for t in texts]
        m = np.array(rows).reshape(len(rows), self.dimensions)
        norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return m / np.where(norms > 0, norms, 1)

    def embed_query(self, text: str) -> np.ndarray:
        return self.embed_texts([text])[0]


class SentenceTransformers:
    """A local model of the sentence-transformers library, if it is installed."""

    def __init__(self, model: str, query_instruction: str = "", max_seq_length: int = 1024, batch_size: int = 8):
        self.model, self.query_instruction, self.max_seq_length, self.batch_size, self.dimensions = model, query_instruction, max_seq_length, batch_size, None

    def _load(self):
        key = ("st", self.model)
        if key not in _loaded:
            from sentence_transformers import SentenceTransformer

            _loaded[key] = SentenceTransformer(self.model)
            _loaded[key].max_seq_length = self.max_seq_length
        return _loaded[key]

    def embed_texts(self, texts: list[str]) -> np.ndarray:
        return np.asarray(self._load().encode(texts, batch_size=self.batch_size, normalize_embeddings=True))

    def embed_query(self, text: str) -> np.ndarray:
        return self.embed_texts([f"{self.query_instruction}{text}"])[0]


class FastEmbed:
    """A local model of the fastembed library, if it is installed."""

    def __init__(self, model: str):
        self.model, self.dimensions = model, None

    def _load(self):
        key = ("fe", self.model)
        if key not in _loaded:
            from fastembed import TextEmbedding

            _loaded[key] = TextEmbedding(self.model)
        return _loaded[key]

    def embed_texts(self, texts: list[str]) -> np.ndarray:
        return np.array(list(self._load().embed(texts)))

    def embed_query(self, text: str) -> np.ndarray:
        return np.array(next(iter(self._load().query_embed([text]))))


class _Again(Exception):
    """Worth another attempt."""


def attempted(call, attempts: int, first_wait: float = 0.5):
    """What ``call`` gives, tried again with doubled waits as long as it asks for it; the last trouble is raised as it came."""
    for wait in [first_wait * 2**i for i in range(attempts - 1)] + [None]:
        try:
            return call()
        except _Again as e:
            if wait is None:
                raise e.__cause__ from None
            time.sleep(wait)


class HttpEmbedding:
    """An embedding service with the usual JSON protocol; overloads, server errors and broken answers are tried again."""

    #: Answers, besides server errors, after which another attempt may succeed.
    RETRIED = frozenset((408, 409, 425, 429))

    def __init__(self, base_url: str, model: str, api_key_env: str = "", batch_size: int = 8, attempts: int = 4, timeout: float = 60.0, query_instruction: str = "", dimensions: int | None = None):
        self.base_url, self.model, self.api_key_env, self.batch_size, self.attempts, self.timeout = base_url.rstrip("/"), model, api_key_env, batch_size, attempts, timeout
        self.query_instruction, self.dimensions = query_instruction, dimensions

    def _ask(self, texts: list[str]) -> bytes:
        key = os.environ.get(self.api_key_env, "") if self.api_key_env else ""
        request = urllib.request.Request(f"{self.base_url}/embeddings", json.dumps({"model": self.model, "input": texts}).encode(), {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {}))
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return answer.read()
        except urllib.error.HTTPError as e:
            trouble = EmbeddingError(f"the embedding service answered {e.code}")
            raise (_Again() if e.code >= 500 or e.code in self.RETRIED else trouble) from trouble
        except OSError as e:
            raise _Again() from EmbeddingError(f"the embedding service can't be reached ({type(e).__name__})")

    def _vectors(self, texts: list[str]) -> np.ndarray:
        """Vectors in the order of the texts, as many as there are texts and all of one size."""
        raw = self._ask(texts)
        try:
            rows = sorted(json.loads(raw)["data"], key=lambda row: row.get("index", 0))
            made = np.array([row["embedding"] for row in rows], np.float64)
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            raise _Again() from EmbeddingError(f"the embedding service's answer can't be read ({type(e).__name__})")
        if made.ndim != 2 or len(made) != len(texts):
            raise EmbeddingError(f"{len(made)} vectors for {len(texts)} texts")
        if self.dimensions and made.shape[1] != self.dimensions:
            raise EmbeddingError(f"vectors of {made.shape[1]} numbers where {self.dimensions} are set")
        return made

    def embed_texts(self, texts: list[str]) -> np.ndarray:
        parts = [texts[i : i + self.batch_size] for i in range(0, len(texts), self.batch_size)]
        made = [attempted(lambda part=part: self._vectors(part), self.attempts) for part in parts]
        return np.concatenate(made) if made else np.empty((0, self.dimensions or 0))

    def embed_query(self, text: str) -> np.ndarray:
        return self.embed_texts([f"{self.query_instruction}{text}"])[0]


def embedding_provider(model: Model) -> EmbeddingProvider:
    """The provider that the settings name."""
    name = model.provider.strip().lower().replace("-", "_")
    if name in ("hash", "fake", "deterministic"):
        return HashEmbedding(model.dimensions)
    if name in ("sentence_transformers", "sentence_transformer", "local"):
        return SentenceTransformers(model.model, model.query_instruction, model.max_seq_length, model.batch_size)
    if name in ("fastembed", "fast_embed"):
        return FastEmbed(model.model)
    if name in ("openai", "openai_compatible", "http"):
        if not model.base_url:
            raise ConfigError("an embedding service needs a base_url")
        return HttpEmbedding(model.base_url, model.model, model.api_key_env, model.batch_size, query_instruction=model.query_instruction)
    raise ConfigError(f"unknown embedding provider {model.provider}")


def embed(rows: DataFrame, provider: EmbeddingProvider, text: str = "text", vector: str = "vector", queries: bool = False) -> DataFrame:
    """Rows with a vector for their text. Hash vectors are made in SQL; models run on Arrow batches.

    ``queries``: the texts are queries, which some models embed in another way
    (with an instruction) than the texts that they look for.
    """
    if isinstance(provider, HashEmbedding):
        return rows.withColumn(vector, vx.hash_embedding(F.col(text), provider.dimensions))

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = [t or "" for t in batch]
            made = [provider.embed_query(t) for t in texts] if queries else provider.embed_texts(texts)
            if len(made) != len(batch):
                raise EmbeddingError(f"{len(made)} vectors for {len(batch)} texts")
            yield pd.Series([np.asarray(v, dtype=np.float64) for v in made], index=batch.index)

    return rows.withColumn(vector, run(F.col(text)))


class Reranker(Protocol):
    """Scores (query, text) pairs."""

    def scores(self, queries: list[str], texts: list[str]) -> list[float]: ...


class CrossEncoder:
    """A reranking model of the sentence-transformers library, if it is installed."""

    def __init__(self, model: str):
        self.model = model

    def scores(self, queries: list[str], texts: list[str]) -> list[float]:
        key = ("ce", self.model)
        if key not in _loaded:
            from sentence_transformers import CrossEncoder as Model_

            _loaded[key] = Model_(self.model)
        return [float(s) for s in _loaded[key].predict(list(zip(queries, texts)))]


def reranker(model: Model) -> Reranker | None:
    """The reranker that the settings name; None for the one by shared words."""
    name = model.provider.strip().lower().replace("-", "_")
    if name in ("hash", "deterministic", "fake", "words", ""):
        return None
    if name in ("sentence_transformers", "cross_encoder", "local"):
        return CrossEncoder(model.model)
    raise ConfigError(f"unknown reranker {model.provider}")


def rerank_with(results: DataFrame, model: Reranker, limit: int | None = None) -> DataFrame:
    """Results (query_id, query, rank, score, text) ordered by a model's scores; the old score stays as pre_rerank_score."""
    from pyspark.sql import Window

    @F.pandas_udf("double")
    def run(queries: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(queries.fillna("").tolist(), texts.fillna("").tolist()))

    scored = results.withColumn("pre_rerank_score", F.col("score")).withColumn("score", run("query", "text"))
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")))
    return out.where(F.col("rank") <= limit) if limit else out
