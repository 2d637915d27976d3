"""Token counts by a public byte-level BPE; the vocabulary file is a parameter and never trained."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published split pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOADED: dict = {}


def encoding(path: str = VOCABULARY):
    """The tokenizer, loaded once per worker."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _LOADED[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def count_udf(path: str = VOCABULARY):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(path)
        for s in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in s], dtype="int64")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.LongType())


def n_tokens(text: Column | str, path: str = VOCABULARY) -> Column:
    """Tokens of a text; a null or empty one has none."""
    return count_udf(path)(text)


def counted(documents: DataFrame, columns: list[str], path: str = VOCABULARY) -> DataFrame:
    """The given columns and ``n_tokens``; the text itself is dropped as soon as it is counted."""
    return documents.select(*columns, n_tokens("text", path).alias("n_tokens"))
