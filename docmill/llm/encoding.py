"""Problem 6: encoding of a whole corpus with a public byte-level BPE tokenizer.

The ids are those of the ``tokenizers`` library. Byte-level BPE merges only inside the pieces its
pre-tokenizer cuts, so each distinct piece needs the library once per worker; a text is the
concatenation of its pieces' ids. Characters whose class differs between Unicode versions could
be cut differently, so a text outside ``_STABLE`` goes through the library as a whole.

Edge cases: null and empty text encode to an empty list; a string that looks like a special token
is plain text; texts of any length are encoded whole; extra columns pass through untouched.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_TOKENIZERS = os.environ.get("DOCMILL_TOKENIZERS", "/opt/tokenizers")

#: Distinct pieces remembered by one worker (about 100 MB); beyond it the memory starts anew.
PIECES_KEPT = 400_000

#: The byte-level pre-tokenizer's published pattern (fixed value); L and N are its letter and number classes.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?[L]+| ?[N]+| ?[^SLN]+|[S]+(?![^S])|[S]+"

#: White space of the Unicode standard.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Blocks whose character classes no longer change between Unicode versions.
_STABLE = [(0, 0x557), (0x600, 0x6FF), (0x1E00, 0x206F), (0x20A0, 0x20BF), (0x2100, 0x27FF), (0x3000, 0x9FFF), (0xAC00, 0xD7A3), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFF00, 0xFFEF)]


def _ranges(kind: str) -> str:
    """The members of a Unicode major class within the stable blocks, as a character class."""
    inside = [c for a, b in _STABLE for c in range(a, b + 1) if unicodedata.category(chr(c))[0] == kind]
    breaks = [i for i in range(1, len(inside)) if inside[i] != inside[i - 1] + 1]
    runs = zip([0, *breaks], [*breaks, len(inside)])
    return "".join(f"\\u{inside[a]:04x}-\\u{inside[b - 1]:04x}" for a, b in runs)


def _piece_pattern() -> re.Pattern:
    parts = {"L": _ranges("L"), "N": _ranges("N"), "S": _SPACE}
    return re.compile(re.sub(r"(?<=[\[^SLN])[LNS](?=[LN\]])", lambda m: parts[m[0]], _PIECES))


def _stable_pattern() -> re.Pattern:
    """A character outside the stable blocks; emoji count as stable, being symbols in every version."""
    blocks = "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in _STABLE)
    return re.compile(f"[^{blocks}\\U0001f300-\\U0001faff]")


def vocabulary_path(name: str, folder: str = DEFAULT_TOKENIZERS) -> str:
    """Where a tokenizer's file lies; the folder is a parameter, nothing is copied."""
    return os.path.join(folder, f"{name}.json")


def byte_table() -> dict[str, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class CorpusEncoder:
    """One worker's tokenizer: ids, offsets, and the way back."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.pieces = _piece_pattern()
        self.unstable = _stable_pattern()
        self.model = self.tokenizer.model
        self.letters = {b: c for c, b in byte_table().items()}
        self.ascii = {b: self.letters[b] for b in range(128)}
        self.known: dict[str, list[int]] = {}
        self._bytes: dict[int, bytes] = {}
        self._path = path

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> list[int]:
        """Ids of one pre-tokenizer piece: its bytes in the byte alphabet, merged by the library's model."""
        if piece.isascii():
            mapped = piece.translate(self.ascii)
        else:
            mapped = "".join(map(self.letters.__getitem__, piece.encode()))
        return [t.id for t in self.model.tokenize(mapped)]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; null and empty give an empty list."""
        known, cut = self.known, self.pieces.findall
        if len(known) > PIECES_KEPT:
            known.clear()
        whole = {t for t in texts if t and not t.isascii() and self.unstable.search(t)}
        cuts = [cut(t) if t and t not in whole else [] for t in texts]
        for piece in {p for pieces in cuts for p in pieces if p not in known}:
            known[piece] = self._piece(piece)
        apart = dict(zip(whole, self._library(list(whole)))) if whole else {}
        flat = chain.from_iterable
        return [apart[t] if t in whole else list(flat(map(known.__getitem__, p))) for t, p in zip(texts, cuts)]

    def token_bytes(self) -> dict[int, bytes]:
        """The bytes of every id, from the byte-level alphabet reversed."""
        if not self._bytes:
            table = byte_table()
            with open(self._path, encoding="utf-8") as f:
                vocabulary = json.load(f)["model"]["vocab"]
            for token, i in vocabulary.items():
                known = all(c in table for c in token)
                self._bytes[i] = bytes(table[c] for c in token) if known else token.encode()
        return self._bytes

    def decode(self, ids: list[int] | None) -> str | None:
        """The text of ``ids``; a character split over several ids is joined before decoding."""
        if ids is None:
            return None
        table = self.token_bytes()
        return b"".join(table[i] for i in ids).decode("utf-8", errors="replace")

    def offsets(self, text: str | None, ids: list[int]) -> list[tuple[int, int]]:
        """Character span of each id; an id inside a split character gets that character's span."""
        if not text:
            return []
        owner: list[int] = []  # character index of each byte
        for i, c in enumerate(text):
            owner.extend([i] * len(c.encode("utf-8", "surrogatepass")))
        table, spans, at = self.token_bytes(), [], 0
        for i in ids:
            end = at + len(table[i])
            spans.append((owner[at], owner[end - 1] + 1))
            at = end
        return spans


@lru_cache(maxsize=4)
def encoder(path: str) -> CorpusEncoder:
    """The worker's encoder of a vocabulary file, kept between batches."""
    return CorpusEncoder(path)


def encode_corpus(df: DataFrame, key: str, text: str, tokenizer: str, folder: str = DEFAULT_TOKENIZERS) -> DataFrame:
    """``key`` and ``ids ARRAY<INT>`` of every row of ``df``."""
    path = vocabulary_path(tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = encoder(path).encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    schema = T.StructType([df.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(key, text).mapInArrow(run, schema)


def encode_with_offsets(df: DataFrame, key: str, text: str, tokenizer: str, folder: str = DEFAULT_TOKENIZERS) -> DataFrame:
    """As :func:`encode_corpus`, with ``starts`` and ``ends``, the character span of each id."""
    path = vocabulary_path(tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = encoder(path).encode(texts)
            spans = [encoder(path).offsets(t, i) for t, i in zip(texts, ids)]
            lists = [ids, [[a for a, _ in s] for s in spans], [[b for _, b in s] for s in spans]]
            arrays = [pa.array(x, pa.list_(pa.int32())) for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [key, "ids", "starts", "ends"])

    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([df.schema[key], *(T.StructField(n, ints) for n in ("ids", "starts", "ends"))])
    return df.select(key, text).mapInArrow(run, schema)


def decode_ids(ids: Column, tokenizer: str, folder: str = DEFAULT_TOKENIZERS) -> Column:
    """The text of an ``ARRAY<INT>`` column."""
    path = vocabulary_path(tokenizer, folder)

    @F.pandas_udf(T.StringType())
    def decoded(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else encoder(path).decode(list(x)))

    return decoded(ids)
