"""Problem 7: evaluation texts leaking into training text.

Every task builds word-level suffix arrays over its shard of the corpus and binary-searches every
suffix of the evaluation texts in them; a hit is grown to the longest verbatim match. The test
side is searched in blocks of bounded size, one after another, while the corpus is read and cut
into words once. Hits are grown ``PAIRS_TOGETHER`` at a time, so phrases that recur on both sides
cost time but no memory.

Suffixes that cannot reach the wanted length, because a word of theirs occurs in no evaluation
text or their document ends first, are left out of the arrays: they could match nothing.

Edge cases: null or empty texts have no words and match nothing; repeated rows give the same
match, returned once; an evaluation text shorter than the wanted length can't leak; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.llm.words import words

#: Consecutive words that make a leak.
MIN_WORDS = 18

#: Characters of evaluation text searched in one pass over the corpus.
BLOCK_CHARS = 8_000_000

#: Words of corpus text in one suffix array.
SHARD_WORDS = 1_000_000

#: Pairs of positions that are grown together.
PAIRS_TOGETHER = 1 << 20

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("field", T.StringType()),
        T.StructField("match_words", T.IntegerType()),
        T.StructField("doc_word", T.IntegerType()),
        T.StructField("item_word", T.IntegerType()),
    ]
)


@dataclass
class TestTexts:
    """A block of evaluation texts as one array of word numbers, texts parted by zeros."""

    vocabulary: dict[str, int]
    stream: np.ndarray
    owner: np.ndarray  # text number of each stream position
    offset: np.ndarray  # word position within its text
    item: np.ndarray  # item id by text number
    field: list[str]

    @classmethod
    def of(cls, rows: list[tuple[int, str, str]]) -> TestTexts:
        vocabulary: dict[str, int] = {}
        stream, owner, offset = [0], [0], [0]
        for number, (_, _, text) in enumerate(rows):
            for k, w in enumerate(words(text)):
                stream.append(vocabulary.setdefault(w, len(vocabulary) + 1))
                owner.append(number)
                offset.append(k)
            stream.append(0)
            owner.append(number)
            offset.append(-1)
        as_int = lambda x: np.array(x, np.int64)
        return cls(vocabulary, as_int(stream), as_int(owner), as_int(offset), as_int([r[0] for r in rows]), [r[1] for r in rows])


def whole_windows(stream: np.ndarray, length: int) -> np.ndarray:
    """Positions from which ``length`` words follow without a zero."""
    if len(stream) < length:
        return np.empty(0, np.int64)
    zeros = np.concatenate([[0], np.cumsum(stream == 0)])
    return np.flatnonzero(zeros[length:] == zeros[:-length])


def keys(stream: np.ndarray, at: np.ndarray, length: int, bits: int) -> np.ndarray:
    """The first ``length`` words of the suffixes at ``at``, packed into columns of 63 bits that compare alike."""
    per = max(1, 63 // bits)
    columns = []
    for start in range(0, length, per):
        packed = np.zeros(len(at), np.int64)
        for k in range(start, min(start + per, length)):
            packed = (packed << bits) | stream[at + k]
        columns.append(packed)
    return np.stack(columns) if columns else np.zeros((1, len(at)), np.int64)


def suffix_array(stream: np.ndarray, length: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``length`` words, and their packed keys."""
    at = whole_windows(stream, length)
    key = keys(stream, at, length, bits)
    order = np.lexsort(key[::-1])
    return at[order], key[:, order]


def search(array_keys: np.ndarray, wanted: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of all ``wanted`` keys at once: the first place not below (or, right, above) each."""
    low = np.zeros(wanted.shape[1], np.int64)
    high = np.full(wanted.shape[1], array_keys.shape[1], np.int64)
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        probe = array_keys[:, np.minimum(middle, max(array_keys.shape[1] - 1, 0))]
        below = np.zeros(len(middle), bool)
        tied = np.ones(len(middle), bool)
        for column in range(len(wanted)):
            below |= tied & (probe[column] < wanted[column])
            tied &= probe[column] == wanted[column]
        go_right = open_ & (below | tied if right else below)
        low = np.where(go_right, middle + 1, low)
        high = np.where(open_ & ~go_right, middle, high)
    return low


def grown(corpus: np.ndarray, test: np.ndarray, c: np.ndarray, t: np.ndarray, length: int) -> np.ndarray:
    """Length of the verbatim match from each pair of positions, known to reach ``length``."""
    size = np.full(len(c), length, np.int64)
    alive = np.arange(len(c))
    while len(alive):
        a, b = corpus[c[alive] + size[alive]], test[t[alive] + size[alive]]
        alive = alive[(a == b) & (a != 0)]
        size[alive] += 1
    return size


class ShardSearch:
    """Searches one shard after another for a block of evaluation texts."""

    def __init__(self, test: TestTexts, length: int):
        self.test, self.length = test, length
        self.bits = max(1, int(len(test.vocabulary)).bit_length())
        self.at = whole_windows(test.stream, length)
        self.wanted = keys(test.stream, self.at, length, self.bits)

    def matches(self, doc_ids: list[int], streams: list[np.ndarray]) -> list[list]:
        """Columns of SCHEMA: the longest match of each document and evaluation text."""
        sizes = np.array([len(s) for s in streams], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        stream = np.concatenate([*streams, np.zeros(1, np.int64)])
        array, array_keys = suffix_array(stream, self.length, self.bits)
        if not len(array) or not len(self.at):
            return [[] for _ in SCHEMA]
        low, high = search(array_keys, self.wanted, False), search(array_keys, self.wanted, True)
        hit = np.flatnonzero(high > low)
        counts = (high - low)[hit]
        before = np.cumsum(counts) - counts
        cuts = np.unique(np.searchsorted(before, np.arange(0, counts.sum(), PAIRS_TOGETHER)))
        best = np.empty((5, 0), np.int64)
        for part in np.split(np.arange(len(hit)), cuts[1:]):
            own, n = hit[part], counts[part]
            t = np.repeat(self.at[own], n)
            c = array[np.repeat(low[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            size = grown(stream, self.test.stream, c, t, self.length)
            found = np.stack([np.searchsorted(starts, c, "right") - 1, self.test.owner[t], c, t, size])
            best = longest(np.concatenate([best, found], axis=1))
        doc, text, c, t, size = best
        return [
            [doc_ids[d] for d in doc],
            self.test.item[text].tolist(),
            [self.test.field[x] for x in text],
            size.tolist(),
            (c - starts[doc]).tolist(),
            self.test.offset[t].tolist(),
        ]


def longest(found: np.ndarray) -> np.ndarray:
    """Of columns (document, text, corpus position, test position, words) the longest of each document and text, the first of equals."""
    doc, text, c, _, size = found
    found = found[:, np.lexsort([c, -size, text, doc])]
    first = np.ones(found.shape[1], bool)
    first[1:] = (found[:2, 1:] != found[:2, :-1]).any(axis=0)
    return found[:, first]


def _pass(docs: DataFrame, blocks: list[Broadcast], length: int) -> DataFrame:
    """SCHEMA of the matches of every document with the texts of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[ShardSearch] = []  # of a lone block, which every shard meets

        def searches() -> Iterator[ShardSearch]:
            if kept:
                yield kept[0]
                return
            for block in blocks:
                search_ = ShardSearch(TestTexts.of(block.value), length)
                if len(blocks) == 1:
                    kept.append(search_)
                yield search_

        ids: list[int] = []
        texts: list[list[str]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for shard in searches():
                number = shard.test.vocabulary.get
                columns = shard.matches(ids, [np.array([*map(number, found, repeat(0)), 0], np.int64) for found in texts])
                types = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], SCHEMA.names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words(text)
                if len(found) < length:
                    continue
                ids.append(doc_id)
                texts.append(found)
                held += len(found)
                if held >= SHARD_WORDS:
                    yield from flush()
                    ids, texts, held = [], [], 0
        if ids:
            yield from flush()

    return docs.mapInArrow(run, SCHEMA)


def leaks(docs: DataFrame, items: DataFrame, length: int = MIN_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The longest verbatim match of at least ``length`` words of each document and evaluation text.

    ``docs`` has ``doc_id`` and ``text``; ``items`` has ``item_id`` and the fields ``passage`` and
    ``question``. A document that occurs twice under one id gives each match once.
    """
    texts = items.select(
        "item_id", F.expr("stack(2, 'passage', passage, 'question', question) AS (field, text)")
    ).where(F.length("text") > 0)
    chars = texts.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = -(-chars // block_chars) or 1
    context = docs.sparkSession.sparkContext
    sent = []
    for b in range(blocks):  # the driver holds one block at a time
        block = texts if blocks == 1 else texts.where(F.pmod(F.xxhash64("item_id", "field"), F.lit(blocks)) == b)
        sent.append(context.broadcast([(r.item_id, r.field, r.text) for r in block.toLocalIterator()]))
    return _pass(docs.select("doc_id", "text"), sent, length).dropDuplicates(["doc_id", "item_id", "field"])


def leaked_documents(matches: DataFrame) -> DataFrame:
    """Each document with each evaluation item it contains."""
    return matches.select("doc_id", "item_id").distinct()


def leaked_items(matches: DataFrame) -> DataFrame:
    """Each leaked item with its number of documents and its longest match."""
    return matches.groupBy("item_id").agg(
        F.countDistinct("doc_id").alias("documents"), F.max("match_words").alias("longest_match")
    )


def without_leaks(docs: DataFrame, matches: DataFrame) -> DataFrame:
    """The corpus without the affected documents."""
    return docs.join(matches.select("doc_id").distinct(), "doc_id", "left_anti")
