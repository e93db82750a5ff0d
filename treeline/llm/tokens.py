"""Sizes of texts in tokens of a public tokenizer; the tokenizer's file is a parameter."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

from treeline.plans.session import spread

TOKENIZER = os.environ.get("TREELINE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")


@lru_cache(maxsize=2)
def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def token_counts(docs: DataFrame, *keep: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, *keep, n_tokens) of whole texts; null and empty texts have 0 tokens. The file must be readable on workers."""
    docs = spread(docs.select("doc_id", "text", *keep), "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = _load(tokenizer)
        for pdf in batches:
            texts = [x or "" for x in pdf["text"]]
            n: list[int] = []
            for a in range(0, len(texts), 64):
                n += [len(e.ids) for e in t.encode_batch_fast(texts[a : a + 64], add_special_tokens=False)]
            yield pdf[["doc_id", *keep]].assign(n_tokens=n)

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name in ("doc_id", *keep))
    return docs.mapInPandas(run, kept + ", n_tokens long").select("doc_id", *keep, "n_tokens")
