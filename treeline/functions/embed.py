"""Embedders as plug-ins: anything that turns a list of texts into vectors of one length."""

from __future__ import annotations

import json
import math
import urllib.request
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
import xxhash
from pyspark.sql import DataFrame


class Embedder(Protocol):
    dims: int

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Deterministic vectors of character trigrams; for tests and offline work."""

    def __init__(self, dims: int = 64) -> None:
        self.dims = dims

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dims
            low = t.lower()
            for i in range(max(1, len(low) - 2)):
                h = xxhash.xxh64_intdigest(low[i : i + 3])
                v[h % self.dims] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v))
            out.append([x / n for x in v] if n else v)
        return out


class HttpEmbedder:
    """Embeddings endpoint that takes {"model", "input"} and answers {"data": [{"embedding"}]} or {"embeddings"}."""

    def __init__(self, url: str, model: str, dims: int, timeout: float = 60.0) -> None:
        self.url, self.model, self.dims, self.timeout = url, model, dims, timeout

    def __call__(self, texts: list[str]) -> list[list[float]]:
        body = json.dumps({"model": self.model, "input": texts}).encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            got = json.load(answer)
        return got["embeddings"] if "embeddings" in got else [d["embedding"] for d in got["data"]]


def embedded(df: DataFrame, key: str, text: str, embedder: Embedder, batch: int = 64) -> DataFrame:
    """(key, embedding): blank and null texts get the zero vector and never reach the embedder; wrong lengths and values that
    are not finite are errors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [[0.0] * embedder.dims for _ in range(len(pdf))]
            todo = [i for i, t in enumerate(pdf[text]) if t and t.strip()]
            for a in range(0, len(todo), batch):
                part = todo[a : a + batch]
                for i, v in zip(part, embedder([pdf[text].iat[i] for i in part]), strict=True):
                    if len(v) != embedder.dims or not all(map(math.isfinite, v)):
                        raise ValueError("the embedder gave a vector of another length or with values that are not finite")
                    out[i] = v
            yield pd.DataFrame({key: pdf[key], "embedding": out})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<float>")
