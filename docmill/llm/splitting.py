"""Problem 3: splitting oversized items at natural boundaries.

Content-defined chunking: a rolling hash over the last ``WINDOW`` characters marks, between the
smallest and the largest size a piece may have, the place where it is greatest; the cut snaps to
the natural boundary nearest to that landmark. The place depends on the characters around it
alone, so an edit moves the cuts next to it and the later ones come to rest where they were.

Boundaries are tried by rank: paragraph, then sentence or list line, then word; text that has none
between the two sizes is cut at a character, but never inside a combined one (combining marks,
joiners, variation selectors, a carriage return and its line feed).

Edge cases: a null or empty item and one within the limit gives no piece (it isn't oversized); a
redelivered item gives its pieces once; items of any length are split whole; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Limits in characters.
DOCUMENT_LIMIT, CHUNK_LIMIT = 4000, 1200

#: Characters that a piece repeats of the one before, least and most.
OVERLAP = (100, 200)

#: Characters under the rolling hash; a power of two.
WINDOW = 32

_LINE = r"(?:\r\n|[\n\r\u0085\u2028\u2029])"
_PARAGRAPH = re.compile(rf"{_LINE}[^\S\n\r]*{_LINE}\s*")
_SENTENCE = re.compile(rf"[.!?…]+[\"'”’»)\]]*\s+|[。！？]+[」』）”]*\s*|{_LINE}(?=\s*(?:[-*•|#>]|\d+[.)]\s))")
_WORD = re.compile(r"\s+|(?<=[、，；：])")
_INSIDE = re.compile(r"[\u0300-\u036f\u0483-҉\u0591-\u05bd\u064b-\u065f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\u3099\u309a\ufe00-\ufe0f\ufe20-\ufe2f\U0001f3fb-\U0001f3ff\U000e0020-\U000e007f]|\u200d.?|(?<=\r)\n", re.S)

_U64 = np.uint64


@lru_cache(maxsize=1)
def _gears() -> np.ndarray:
    """A fixed pseudo-random number for each low 12 bits of a character."""
    x = np.arange(1, 4097, dtype=_U64) * _U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def rolling_hash(text: str) -> np.ndarray:
    """The hash of the last ``WINDOW`` characters at every position, by doubling."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    h = _gears()[codes & 4095].copy()
    width = 1
    while width < WINDOW:
        further = h.copy()
        further[width:] += h[:-width] << _U64(width)
        h, width = further, width * 2
    return h


def _nearest(places: np.ndarray, low: int, high: int, to: int) -> int:
    """The place in [low, high] nearest to ``to``, or -1."""
    a, b = np.searchsorted(places, [low, high + 1])
    if a == b:
        return -1
    within = places[a:b]
    return int(within[np.argmin(np.abs(within - to))])


def _ends(pattern: re.Pattern, text: str) -> np.ndarray:
    return np.array([m.end() for m in pattern.finditer(text)], np.int64)


def spans(text: str | None, limit: int, overlap: tuple[int, int] = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, own start, end) of each piece; the text from start to own start is repeated.

    No piece for a text within the limit. The parts from own start to end give the text back.
    """
    if text is None or len(text) <= limit:
        return []
    least, most = overlap
    largest = limit - most
    smallest = max(limit // 4, most + 1)
    if smallest * 2 > largest:
        raise ValueError(f"limit {limit} leaves no room for an overlap of {most}")
    hashes = rolling_hash(text)
    ranks = [_ends(p, text) for p in (_PARAGRAPH, _SENTENCE, _WORD)]
    inside = {m.start() + k for m in _INSIDE.finditer(text) for k in range(m.end() - m.start())}
    size, out, begin, start = len(text), [], 0, 0
    while size - begin > largest:
        low = begin + smallest
        high = min(begin + largest, size - smallest)
        landmark = low + int(np.argmax(hashes[low - 1 : high]))
        end = next((x for r in ranks if (x := _nearest(r, low, high, landmark)) >= 0), -1)
        if end < 0:
            end = landmark
            while end in inside and end > low:
                end -= 1
        out.append((start, begin, end))
        start = next((x for r in ranks if (x := _nearest(r, end - most, end - least, end - least)) >= 0), end - least)
        while start in inside and start > end - most:
            start -= 1
        begin = end
    out.append((start, begin, size))
    return out


def split(items: DataFrame, with_text: bool = True) -> DataFrame:
    """Pieces of the oversized items.

    ``items`` has field, item_id, text and limit. The result has field, item_id, piece (from 0),
    start, own_start and end (characters), and with ``with_text`` the piece itself.
    """
    fields = [T.StructField("field", T.StringType()), T.StructField("item_id", T.StringType())]
    fields += [T.StructField(n, T.IntegerType()) for n in ("piece", "start", "own_start", "end")]
    fields += [T.StructField("text", T.StringType())] * with_text
    schema = T.StructType(fields)
    types = [pa.string(), pa.string(), *[pa.int32()] * 4, *[pa.string()] * with_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in types]
            for field, item, text, limit in zip(*(c.to_pylist() for c in batch.columns)):
                for k, (start, own, end) in enumerate(spans(text, limit)):
                    row = (field, item, k, start, own, end, text[start:end] if with_text else None)
                    for column, value in zip(out, row):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], schema.names)

    pieces = items.select("field", "item_id", "text", "limit").where(F.length("text") > F.col("limit")).mapInArrow(run, schema)
    return pieces.dropDuplicates(["field", "item_id", "piece"])


def chunked_items(chunked: DataFrame, document_limit: int = DOCUMENT_LIMIT, chunk_limit: int = CHUNK_LIMIT) -> DataFrame:
    """The texts of ``chunked`` with their limits; only oversized chunks are exploded."""
    documents = chunked.select(
        F.lit("document_text").alias("field"), F.col("document_id").alias("item_id"), F.col("document_text").alias("text"), F.lit(document_limit).alias("limit")
    )
    large = F.filter("chunks", lambda c: F.length(c["chunk_text"]) > chunk_limit)
    chunks = chunked.select(F.explode(large).alias("c")).select(
        F.lit("chunk_text").alias("field"), F.col("c.chunk_id").alias("item_id"), F.col("c.chunk_text").alias("text"), F.lit(chunk_limit).alias("limit")
    )
    return documents.unionByName(chunks)


def restored(pieces: DataFrame) -> DataFrame:
    """(field, item_id, text_hash, longest, least_overlap, most_overlap): each item put together again from its pieces' own parts."""
    own = F.struct("piece", F.substring("text", F.col("own_start") - F.col("start") + 1, F.length("text")).alias("t"))
    shared = F.when(F.col("piece") > 0, F.col("own_start") - F.col("start"))
    grouped = pieces.groupBy("field", "item_id").agg(
        F.array_sort(F.collect_list(own)).alias("p"), F.max(F.length("text")).alias("longest"), F.min(shared).alias("least_overlap"), F.max(shared).alias("most_overlap")
    )
    text = F.array_join(F.transform("p", lambda x: x["t"]), "")
    return grouped.select("field", "item_id", F.md5(text).alias("text_hash"), "longest", "least_overlap", "most_overlap")
