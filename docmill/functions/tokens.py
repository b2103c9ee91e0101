"""Tokenizers by name, as native columns where words suffice, as Arrow functions for byte pairs."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_FOLDER = os.environ.get("DOCMILL_TOKENIZERS", "/opt/tokenizers")

#: The word tokenizer splits on blanks, tabs and line ends.
WORD_BREAK = r"[ \t\r\n]+"


def word_tokens(text: Column | str) -> Column:
    """The words of a text; none of null and empty."""
    column = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(column, F.lit("")), WORD_BREAK), lambda w: w != "")


def token_count(text: Column | str, encoding: str = "word") -> Column:
    """Number of tokens; 0 of null and empty."""
    return F.size(word_tokens(text)) if encoding == "word" else _byte_pair_count(encoding)(F.col(text) if isinstance(text, str) else text)


def message_tokens(messages: Column, encoding: str = "word", named: bool = False) -> Column:
    """Tokens of a chat: 3 a message, those of every value, 1 more for a name, and 3 for the reply.

    ``messages`` is an array of structs with role and content, and with ``named`` also name.
    """

    def each(so_far: Column, m: Column) -> Column:
        own = so_far + 3 + token_count(m["role"], encoding) + token_count(m["content"], encoding)
        return own + F.when(m["name"].isNotNull(), 1 + token_count(m["name"], encoding)).otherwise(0) if named else own

    return F.aggregate(F.coalesce(messages, F.array()), F.lit(3), each)


@lru_cache(maxsize=8)
def byte_pair(encoding: str, folder: str = DEFAULT_FOLDER):
    """A byte-pair encoding from a rank file; an unknown name falls back to byte_bpe_50k."""
    import tiktoken

    path = os.path.join(folder, f"{encoding}.tiktoken")
    if not os.path.exists(path):
        path = os.path.join(folder, "byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _byte_pair_count(encoding: str, folder: str = DEFAULT_FOLDER):
    @F.pandas_udf(T.IntegerType())
    def count(texts: pd.Series) -> pd.Series:
        bpe = byte_pair(encoding, folder)
        return texts.map(lambda t: len(bpe.encode_ordinary(t)) if t else 0)

    return count


def byte_pair_windows(text: Column, size: int, overlap: int, encoding: str, folder: str = DEFAULT_FOLDER) -> Column:
    """Windows of ``size`` byte-pair tokens, each starting ``size - overlap`` after the one before, as texts."""
    if size - overlap <= 0:
        raise ValueError("the overlap must be smaller than the window")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def windows(texts: pd.Series) -> pd.Series:
        bpe = byte_pair(encoding, folder)

        def cut(t: str | None) -> list[str]:
            ids = bpe.encode_ordinary(t) if t else []
            return [bpe.decode(ids[i : i + size]) for i in range(0, len(ids), size - overlap)]

        return texts.map(cut)

    return windows(text)
