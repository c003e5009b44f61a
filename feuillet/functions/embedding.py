"""Embedding models by name. A model is a function from a list of texts to a matrix; real ones are registered where they
are installed, a hashing model is always there."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feuillet.functions.text import STOPWORDS, TOKEN

Model = Callable[[list[str]], np.ndarray]
MAKERS: dict[str, Callable[[], Model]] = {}
_loaded: dict[str, Model] = {}  # one of each name a process, also on the workers


class HashingModel:
    """Token counts in `dim` buckets, a token's bucket being the first 32 bits of its MD5 modulo `dim`."""

    def __init__(self, dim: int = 64) -> None:
        self.dim, self.bucket, self.token, self.stop = dim, {}, re.compile(TOKEN), frozenset(STOPWORDS)

    def __call__(self, texts: list[str]) -> np.ndarray:
        rows = np.zeros((len(texts), self.dim))
        for row, text in zip(rows, texts):
            for t in self.token.findall(text.lower()):
                if t in self.stop:
                    continue
                at = self.bucket.get(t)
                if at is None:
                    if len(self.bucket) > 200_000:
                        self.bucket.clear()
                    at = self.bucket[t] = int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % self.dim
                row[at] += 1
        return rows


def register_model(name: str, make: Callable[[], Model]) -> None:
    """Make a model known under a name; `make` runs once in each process that needs it and has to be picklable."""
    MAKERS[name] = make


register_model("hash-64", HashingModel)
register_model("hash-384", lambda: HashingModel(384))


def load_model(name: str, make: Callable[[], Model] | None = None) -> Model:
    """The model of this process. An unknown name, or one that can't be loaded, raises ValueError."""
    if name not in _loaded:
        make = make or MAKERS.get(name)
        if make is None:
            raise ValueError(f"unknown embedding model: {name}")
        try:
            _loaded[name] = make()
        except Exception as e:
            raise ValueError(f"embedding model {name} can't be loaded: {e}") from e
    return _loaded[name]


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = np.asarray(rows, np.float64)
    return rows / np.maximum(1e-300, np.linalg.norm(rows, axis=1, keepdims=True))


def embed_texts(texts: list[str], name: str = "hash-64") -> np.ndarray:
    """Vectors of length one (zero for a text without tokens). An empty list raises ValueError."""
    if not texts:
        raise ValueError("no texts to embed")
    return _unit(load_model(name)(texts))


def embed_query(query: str, name: str = "hash-64") -> list[float]:
    """The vector of one query, the same as that of a text; a blank one raises ValueError."""
    if not query or not query.strip():
        raise ValueError("an empty query has no vector")
    return embed_texts([query], name)[0].tolist()


def with_embedding(df: DataFrame, text_col: str, name: str = "hash-64", to: str = "vector") -> DataFrame:
    """`df` with the vector of a text column; null texts give null. Arrow batches, one model a worker process."""
    make = MAKERS.get(name)
    if make is None:
        raise ValueError(f"unknown embedding model: {name}")

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load_model(name, make)
        for batch in batches:
            texts = batch.to_pylist()
            rows = _unit(model([t or "" for t in texts])) if texts else np.zeros((0, 1))
            yield pa.array([None if t is None else r for t, r in zip(texts, rows)], pa.list_(pa.float64()))

    return df.withColumn(to, F.arrow_udf(run, "array<double>")(F.col(text_col)))
