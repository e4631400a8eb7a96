"""Token counts under a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Where the ranks file lies on every executor.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's texts were cut before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoder(path: str = RANKS):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def n_tokens(text: Column | str, path: str = RANKS) -> Column:
    """Tokens of a whole text; 0 for null and ''."""

    @F.pandas_udf(LongType())
    def count(texts: pd.Series) -> pd.Series:
        encode = encoder(path).encode_ordinary
        return texts.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    return count(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def sized(documents: DataFrame, *keep: str, path: str = RANKS) -> DataFrame:
    """The columns of ``keep`` with n_tokens of ``text``."""
    return documents.select(*keep, n_tokens("text", path).alias("n_tokens"))
