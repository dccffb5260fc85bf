"""Sizes of texts in tokens of a public tokenizer; its file is a parameter and is never copied."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = os.environ.get("LAKELOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The split pattern that belongs to the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str = TOKENIZER) -> int:
    return len(encoder(path).encode_ordinary(text))


def with_tokens(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``documents`` with ``tokens``: null and empty texts have 0."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: len(encoder(path).encode_ordinary(t)) if t else 0).astype("int64")

    return documents.withColumn("tokens", F.pandas_udf(count, "long")("text"))
