"""Problem 5: near-duplicate records with small edits.

Two records belong together when their common words are at least 0.7 of all their words. Records
with the same words form a class first, so copies are compared once. Classes meet in the blocks
of their rarest words (a pair above the threshold must share one of the first n - ceil(0.7 n) + 1
words in any common order; the order puts words of rare hash buckets first). Inside a block the
comparison is tiled and exact: word sets are 128-bit parity signatures, numpy exclusive-or and bit
counts give a lower bound of the words two records don't share, and tile pairs whose population
counts or sizes differ beyond the radius are skipped. A comparison of the word sets confirms
every pair. A block above ``TILE_ROWS`` rows is cut into tiles along its sizes and population
counts; only pairs of tiles within the radius are written out, each of them a piece of work of
bounded size, so no block is ever held whole and the bound is the same at every size.

Edge cases: records whose question is null or blank are left out; a null answer counts as empty;
a redelivered row is the same record; records without a single word match nothing; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docmill.llm.words import words
from docmill.session import cut_lineage, discard, partitioned_by

#: The threshold as a fraction.
COMMON, ALL = 7, 10

#: Buckets of the word-frequency sketch (4 MB when sent to the workers).
BUCKETS = 1 << 20

#: Rows of one tile of a block, or of a class of copies, that is cut.
TILE_ROWS = 4096

#: Rows of a table that is sent to the workers at most; a larger one is joined by shuffling.
SENT_ROWS = 100_000

#: Seed of Spark's xxhash64, so that both sides number the buckets alike (fixed value).
_SEED = 42

SETS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("same", T.BinaryType()),
        T.StructField("n", T.IntegerType()),
        T.StructField("high", T.LongType()),
        T.StructField("low", T.LongType()),
        T.StructField("words", T.ArrayType(T.LongType())),
        T.StructField("alone", T.IntegerType()),
        T.StructField("common", T.IntegerType()),
    ]
)


def record_text(question: str | None, answer: str | None) -> str | None:
    """Question, a blank, and answer; none where the question is null or blank."""
    if question is None or not question.strip():
        return None
    return f"{question} {answer or ''}"


def word_sketch(records: DataFrame) -> np.ndarray:
    """Number of records per word bucket, over all records; of fixed size."""
    text = F.lower(F.concat_ws(" ", F.coalesce("question", F.lit("")), F.coalesce("self_answer", F.lit(""))))
    word = F.explode(F.array_distinct(F.split(text, r"[^\p{L}\p{N}]+")))
    bucket = F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int").alias("bucket")
    counts = records.select(word.alias("word")).groupBy(bucket).count().toArrow()  # 12 MB at most
    sketch = np.zeros(BUCKETS, np.uint32)
    sketch[counts.column("bucket").to_numpy()] = np.minimum(counts.column("count").to_numpy(), 2**32 - 1)
    return sketch


def word_sets(records: DataFrame, sketch: np.ndarray) -> DataFrame:
    """SETS of each record: its words as hashes, rarest first, their parity signature, how many of the first no other record can have, and how many of the last a hot block can have."""
    sent = records.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency, digest, known = sent.value, xxhash.xxh64_intdigest, {}
        for batch in batches:
            if len(known) > 500_000:
                known.clear()
            out: list[list] = [[] for _ in SETS]
            for rid, question, answer in zip(*(c.to_pylist() for c in batch.columns)):
                text = record_text(question, answer)
                found = set(words(text)) if text else None
                if not found or rid is None:
                    continue
                hashes = []
                for w in found:
                    h = known.get(w)
                    if h is None:
                        h = known[w] = digest(w.encode("utf-8", "surrogatepass"), _SEED)
                    hashes.append(h)
                hashes.sort()
                array = np.array(hashes, np.uint64)
                often = frequency[(array % np.uint64(BUCKETS)).astype(np.int64)]
                rare = np.lexsort([array, often])
                signature = 0
                for h in hashes:
                    signature ^= 1 << (h >> 57)
                row = (
                    rid,
                    xxhash.xxh128_digest(array.tobytes()),
                    len(hashes),
                    _signed(signature >> 64),
                    _signed(signature & (2**64 - 1)),
                    array.view(np.int64)[rare],
                    int((often <= 1).sum()),
                    int((often > TILE_ROWS).sum()),
                )
                for column, value in zip(out, row):
                    column.append(value)
            types = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], SETS.names)

    return records.select("question_id", "question", "self_answer").mapInArrow(run, SETS)


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _close(n_a: np.ndarray, n_b: np.ndarray, hamming: np.ndarray) -> np.ndarray:
    """Whether a pair can reach the threshold, by sizes and by the bits in which it differs."""
    smaller, larger = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    radius = (ALL - COMMON) * (n_a + n_b)
    return (ALL * smaller >= COMMON * larger) & ((ALL + COMMON) * hamming <= radius)


def _tiles(n: np.ndarray, high: np.ndarray, low: np.ndarray, side: np.ndarray, tile: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of one block, compared tile by tile in the order of size and population count.

    ``side`` tells the two tiles of a cut block apart: -1 compares with every row, 0 only with 1.
    """
    bits = np.bitwise_count(high).astype(np.int64) + np.bitwise_count(low)
    order = np.lexsort([bits, n])
    n, high, low, bits, side = n[order], high[order], low[order], bits[order], side[order]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    starts = range(0, len(n), tile)
    spans = [(n[s : s + tile].min(), n[s : s + tile].max(), bits[s : s + tile].min(), bits[s : s + tile].max()) for s in starts]
    for i, a in enumerate(starts):
        for j in range(i, len(spans)):
            b = starts[j]
            if ALL * spans[i][1] < COMMON * spans[j][0]:
                break
            gap = max(spans[i][2] - spans[j][3], spans[j][2] - spans[i][3], 0)
            if (ALL + COMMON) * gap > (ALL - COMMON) * (spans[i][1] + spans[j][1]):
                continue
            x, y = slice(a, a + tile), slice(b, b + tile)
            hamming = np.bitwise_count(high[x, None] ^ high[None, y]).astype(np.int64)
            hamming += np.bitwise_count(low[x, None] ^ low[None, y])
            close = _close(n[x, None], n[None, y], hamming)
            close &= (side[x, None] < 0) | (side[x, None] != side[None, y])
            if i == j:
                close &= np.tri(*close.shape, k=-1, dtype=bool).T
            p, q = np.nonzero(close)
            found.append((order[a + p], order[b + q]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([p for p, _ in found]), np.concatenate([q for _, q in found])


def _small(block: np.ndarray, n: np.ndarray, high: np.ndarray, low: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of many small blocks at once: each row against the next, the one after, and so on."""
    left, right = [], []
    step = 1
    while step < len(block):
        p = np.flatnonzero(block[step:] == block[:-step])
        if not len(p):
            break
        q = p + step
        hamming = np.bitwise_count(high[p] ^ high[q]).astype(np.int64) + np.bitwise_count(low[p] ^ low[q])
        keep = _close(n[p], n[q], hamming) & ((side[p] < 0) | (side[p] != side[q]))
        left.append(p[keep])
        right.append(q[keep])
        step += 1
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


#: From this size on a block is compared by tiles.
_LARGE = 48

PAIRS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of a partition sorted by block; a block may run over batches."""
    rest: list[np.ndarray] | None = None

    def pairs(columns: list[np.ndarray]) -> pa.RecordBatch:
        token, first, second, rid, n, high, low, side = columns
        change = np.flatnonzero((token[1:] != token[:-1]) | (first[1:] != first[:-1]) | (second[1:] != second[:-1])) + 1
        starts = np.concatenate([[0], change])
        sizes = np.diff(np.concatenate([starts, [len(token)]]))
        block = np.repeat(np.arange(len(starts)), sizes)
        lefts, rights = [], []
        small = np.flatnonzero(np.repeat((sizes > 1) & (sizes < _LARGE), sizes))
        p, q = _small(block[small], n[small], high[small], low[small], side[small])
        lefts.append(rid[small[p]])
        rights.append(rid[small[q]])
        for s in np.flatnonzero(sizes >= _LARGE):
            x = slice(starts[s], starts[s] + sizes[s])
            p, q = _tiles(n[x], high[x], low[x], side[x])
            lefts.append(rid[x][p])
            rights.append(rid[x][q])
        a, b = np.concatenate(lefts), np.concatenate(rights)
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], PAIRS.names)

    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        columns[5:7] = [c.view(np.uint64) for c in columns[5:7]]  # signed numbers would count the bits of their absolute value
        if rest is not None:
            columns = [np.concatenate([r, c]) for r, c in zip(rest, columns)]
        if not len(columns[0]):
            continue
        token, first, second = columns[:3]
        last = (token == token[-1]) & (first == first[-1]) & (second == second[-1])
        cut = int(np.argmax(last))
        if cut:
            yield pairs([c[:cut] for c in columns])
        rest = [c[cut:] for c in columns]
    if rest is not None:
        yield pairs(rest)


def postings(classes: DataFrame) -> DataFrame:
    """(token, id, n, bits, high, low, common): a row per word of each class's prefix, and whether its block may be hot; words that no other record has are left out."""
    least = F.floor((COMMON * F.col("n") + ALL - 1) / ALL)  # of its words a partner shares at least so many
    prefix = F.col("n") - least + 1 - F.col("alone")
    words = F.slice("words", F.col("alone") + 1, F.greatest(prefix, F.lit(0)).cast("int"))
    bits = (F.bit_count("high") + F.bit_count("low")).cast("int").alias("bits")
    each = classes.select(F.posexplode(words).alias("at", "token"), "id", "n", bits, "high", "low", "alone", "common")
    return each.select("token", "id", "n", "bits", "high", "low", (F.col("at") + F.col("alone") >= F.col("n") - F.col("common")).alias("common"))


def sent(df: DataFrame, rows: int) -> DataFrame:
    """``df``, for a broadcast where its number of ``rows`` allows it."""
    return F.broadcast(df) if rows <= SENT_ROWS else df


def tiles(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tiles of the hot blocks: (token, n, bits, start, count) of their cells, and (token, first, second) of the pairs of tiles within the radius.

    A block's rows are ordered by size and population count; a cell is a run of rows equal in both.
    """
    rows = rows.where("common")
    hot = cut_lineage(rows.groupBy("token").count().where(F.col("count") > TILE_ROWS).select("token"))
    cells = rows.join(sent(hot, hot.count()), "token", "left_semi").groupBy("token", "n", "bits").count()
    before = Window.partitionBy("token").orderBy("n", "bits").rowsBetween(Window.unboundedPreceding, -1)  # over one row per cell
    cells = cut_lineage(cells.withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))))
    number = lambda row: F.floor(row / TILE_ROWS).cast("int")
    spans = cells.select("token", "n", "bits", F.explode(F.sequence(number(F.col("start")), number(F.col("start") + F.col("count") - 1))).alias("tile"))
    ends = [f(c).alias(f"{name}_{c}") for c in ("n", "bits") for name, f in (("least", F.min), ("most", F.max))]
    spans = cut_lineage(spans.groupBy("token", "tile").agg(*ends))
    a, b = (spans.select("token", *[F.col(c).alias(f"{x}_{c}") for c in spans.columns[1:]]) for x in ("a", "b"))
    gap = F.greatest(F.col("a_least_bits") - F.col("b_most_bits"), F.col("b_least_bits") - F.col("a_most_bits"), F.lit(0))
    near = (ALL * F.col("a_most_n") >= COMMON * F.col("b_least_n")) & ((ALL + COMMON) * gap <= (ALL - COMMON) * (F.col("a_most_n") + F.col("b_most_n")))
    pairs = a.join(b, "token").where((F.col("a_tile") <= F.col("b_tile")) & near).select("token", F.col("a_tile").alias("first"), F.col("b_tile").alias("second"))
    return cells, pairs


BLOCK = ("token", "first", "second", "id", "n", "high", "low", "side")


def blocks(classes: DataFrame) -> DataFrame:
    """BLOCK: the rows of every block; of a hot one, each row once for each pair of tiles that its tile is in."""
    rows = postings(classes)
    cells, pairs = tiles(rows)
    pairs = cut_lineage(pairs)
    many, hot = cells.count(), cells.select("token").distinct()
    whole = F.lit(0)
    cold = rows if not many else rows.join(sent(hot, many), "token", "left_anti")
    cold = cold.select("token", whole.alias("first"), whole.alias("second"), "id", "n", "high", "low", F.lit(-1).alias("side"))
    if not many:
        return cold
    place = F.col("start") + F.pmod(F.xxhash64("id"), F.col("count"))
    own = rows.join(sent(cells, many), ["token", "n", "bits"]).withColumn("tile", F.floor(place / TILE_ROWS).cast("int"))
    ends = pairs.select("token", F.col("first").alias("tile"), "first", "second").unionByName(pairs.where("first <> second").select("token", F.col("second").alias("tile"), "first", "second"))
    side = F.when(F.col("first") == F.col("second"), -1).otherwise((F.col("tile") == F.col("second")).cast("int"))
    return cold.unionByName(own.join(sent(ends, 2 * pairs.count()), ["token", "tile"]).withColumn("side", side).select(*BLOCK))


def candidates(classes: DataFrame) -> DataFrame:
    """Pairs of classes that can reach the threshold, by tiled comparison of signatures."""
    rows = blocks(classes).repartition("token", "first", "second").sortWithinPartitions("token", "first", "second")
    return rows.mapInArrow(_compare, PAIRS).distinct()


def confirmed(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose common words reach the threshold, by their word sets."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("words").alias(f"words_{x}"))
    common = F.size(F.array_intersect("words_a", "words_b"))
    all_words = F.size("words_a") + F.size("words_b") - common
    return pairs.join(side("a"), "a").join(side("b"), "b").where(ALL * common >= COMMON * all_words).select("a", "b")


class NearDuplicates:
    """Classes of records with the same words, and the links between them."""

    def __init__(self, records: DataFrame):
        records = records.select("question_id", "question", "self_answer")
        # the one shuffle of the word sets, which pairs are confirmed from without another
        sets = partitioned_by(word_sets(records, word_sketch(records)), "id")
        first = sets.groupBy("same").agg(F.min("id").alias("rep"))
        #: (id, rep): each record's class, named by its smallest id.
        self.members = cut_lineage(sets.select("id", "same").join(first, "same").select("id", "rep"))
        self.classes = sets.join(self.members.where("id <> rep").select("id"), "id", "left_anti")
        #: (a, b): linked classes.
        self.links = confirmed(candidates(self.classes), self.classes)

    def pairs(self) -> DataFrame:
        """Every pair of records, a < b; the members of a large class are dealt out over tiles, so no pair of classes meets in one task."""
        copies = self.members.groupBy("rep").count().where("count > 1")
        large = cut_lineage(copies.where(F.col("count") > TILE_ROWS).select("rep", F.ceil(F.col("count") / TILE_ROWS).cast("int").alias("tiles")))
        many = large.count()

        def tiled(df: DataFrame, key: str, name: str) -> DataFrame:
            """``df`` with the number of tiles of its class ``key``."""
            if not many:
                return df.withColumn(name, F.lit(1))
            known = large.select(F.col("rep").alias(key), F.col("tiles").alias(name))
            return df.join(sent(known, many), key, "left").withColumn(name, F.coalesce(name, F.lit(1)))

        every = lambda start, n: F.explode(F.sequence(start, F.col(n) - 1))
        own = tiled(self.members, "rep", "tiles").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
        side = lambda rep, tile, record: own.select(F.col("rep").alias(rep), F.col("tile").alias(tile), F.col("id").alias(record))
        linked = tiled(tiled(self.links, "a", "tiles_a"), "b", "tiles_b").withColumn("tile_a", every(F.lit(0), "tiles_a")).withColumn("tile_b", every(F.lit(0), "tiles_b"))
        between = linked.join(side("a", "tile_a", "x"), ["a", "tile_a"]).join(side("b", "tile_b", "y"), ["b", "tile_b"]).select("x", "y")
        within = own.join(copies.select("rep"), "rep", "left_semi")
        left = within.select("rep", F.col("id").alias("x"), F.col("tile").alias("first"), every(F.col("tile"), "tiles").alias("second"))
        right = within.select("rep", F.col("id").alias("y"), F.col("tile").alias("second"), F.explode(F.sequence(F.lit(0), F.col("tile"))).alias("first"))
        met = left.join(right, ["rep", "first", "second"]).where((F.col("first") < F.col("second")) | (F.col("x") < F.col("y"))).select("x", "y")
        return between.unionByName(met).select(F.least("x", "y").alias("question_id_a"), F.greatest("x", "y").alias("question_id_b"))

    def groups(self) -> DataFrame:
        """Each record that has a partner: its class, its group and the number of its links."""
        links = cut_lineage(self.links)
        group = components(links)
        size = self.members.groupBy("rep").agg(F.count("*").alias("size"))
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        outside = both.join(size.withColumnRenamed("rep", "b"), "b").groupBy("a").agg(F.sum("size").alias("outside"))
        per_class = (
            size.join(outside.withColumnRenamed("a", "rep"), "rep", "left")
            .join(group.withColumnRenamed("id", "rep"), "rep", "left")
            .select("rep", (F.col("size") - 1 + F.coalesce("outside", F.lit(0))).alias("links"), F.coalesce("root", "rep").alias("group_id"))
            .where("links > 0")
        )
        return self.members.join(per_class, "rep").select(F.col("id").alias("question_id"), F.col("rep").alias("class_id"), "group_id", "links")


def components(links: DataFrame) -> DataFrame:
    """(id, root): connected components named by their smallest id, by star contraction.

    Each round links every id to the smallest of its neighbourhood (large star), then every id and
    its smaller neighbours to the smallest of them (small star); the links are stars in the end.
    Rounds grow with the logarithm of the longest path, not with the component.
    """
    edges = cut_lineage(links.select("a", "b").where("a <> b").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("low").alias("a"), "b")
        down = large.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).where("a <> b").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("low"))
        small = down.join(low, "a").select(F.col("low").alias("x"), F.col("b").alias("y")).unionByName(low.select(F.col("low").alias("x"), F.col("a").alias("y")))
        new = cut_lineage(small.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        moved = new.join(edges, ["a", "b"], "left_anti").limit(1).count() + edges.join(new, ["a", "b"], "left_anti").limit(1).count()
        discard(edges)
        edges = new
        if not moved:
            break
    root = edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("root"))
    return root.unionByName(edges.select(F.col("a").alias("id"), F.col("a").alias("root")).distinct()).groupBy("id").agg(F.min("root").alias("root"))
