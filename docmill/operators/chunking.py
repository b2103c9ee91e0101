"""Chunks of documents and combinations of chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import has_content, let
from docmill.functions.tokens import byte_pair_windows, word_tokens


def token_windows(text: Column | str, size: int, overlap: int = 0, encoding: str = "word") -> Column:
    """Windows of ``size`` tokens, each starting ``size - overlap`` after the one before; none of an empty text."""
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("a window needs at least one token and an overlap below its size")
    column = F.col(text) if isinstance(text, str) else text
    if encoding != "word":
        return byte_pair_windows(column, size, overlap, encoding)

    def windows(words: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(words) - 1, F.lit(size - overlap))
        cut = F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, F.lit(size)), " "))
        return F.when(F.size(words) > 0, cut).otherwise(F.array().cast("array<string>"))

    return let(word_tokens(column), windows)


def chunks(document_id: Column | str, text: Column | str, size: int, overlap: int = 0, encoding: str = "word", preprocess: Callable[[Column], Column] | None = None) -> Column:
    """ARRAY<STRUCT<chunk_id, chunk_text>> with ids ``<document>_<number>``; empty for a text without content.

    ``preprocess`` changes the text before it is cut, as a column, so native functions stay native.
    """
    key = F.col(document_id) if isinstance(document_id, str) else document_id
    if preprocess is not None:
        text = preprocess(F.col(text) if isinstance(text, str) else text)
    named = F.transform(
        token_windows(text, size, overlap, encoding),
        lambda t, i: F.struct(F.concat_ws("_", key.cast("string"), i.cast("string")).alias("chunk_id"), t.alias("chunk_text")),
    )
    return F.when(has_content(text), named).otherwise(F.array().cast("array<struct<chunk_id:string,chunk_text:string>>"))


def combinations(document_id: Column | str, n: Column, least: int = 2, most: int = 5, factor: int = 1) -> Column:
    """Groups of chunk positions of a document, as ARRAY<ARRAY<INT>>.

    One group per ``factor`` chunks is wanted, spread evenly over the sizes; a size of which there
    aren't that many chunks is drawn at most five times. A draw's positions come from hashes of
    document, size, draw and attempt, taken modulo the number of chunks; a position that the draw
    has already is rejected, and after ``2 * size + 6`` attempts the first positions fill up. So a
    draw costs the same in any document, is the same in every run, and independent of the
    partitioning. Equal draws count once; smaller groups come first; one chunk forms a group of its
    own, and fewer chunks than the smallest group give none.
    """
    if not 1 <= least <= most or factor < 1:
        raise ValueError("sizes must satisfy 1 <= least <= most, and the factor be at least 1")
    key = F.col(document_id) if isinstance(document_id, str) else document_id
    count = F.coalesce(n.cast("int"), F.lit(0))
    wanted = F.greatest(F.lit(1), F.floor(count / factor).cast("int"))
    last = F.least(F.lit(most), count)
    each = F.greatest(F.lit(1), F.floor(wanted / (last - least + 1)).cast("int"))

    def draw(size: Column, number: Column) -> Column:
        """A draw as text, which an array tells apart by hashing."""
        named = lambda t: F.md5(F.concat_ws(":", key.cast("string"), size.cast("string"), number.cast("string"), t.cast("string")))
        tried = F.transform(F.sequence(F.lit(0), 2 * size + 5), lambda t: (F.conv(F.substring(named(t), 1, 8), 16, 10).cast("long") % count).cast("int"))
        some = F.slice(F.array_distinct(F.concat(tried, F.sequence(F.lit(0), F.least(2 * size, count) - 1))), F.lit(1), size)
        return F.array_join(F.array_sort(some).cast("array<string>"), ",")

    def of_size(size: Column) -> Column:
        draws = F.when(each < count, each).otherwise(F.least(F.lit(5), F.floor(count / size).cast("int")))
        return F.when(draws > 0, F.transform(F.sequence(F.lit(0), draws - 1), lambda d: draw(size, d))).otherwise(F.array().cast("array<string>"))

    texts = F.slice(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(least), last), of_size))), F.lit(1), wanted)
    many = F.transform(texts, lambda t: F.split(t, ",").cast("array<int>"))
    return F.when(count == 1, F.array(F.array(F.lit(0)))).when(count < F.lit(least), F.array().cast("array<array<int>>")).when(count < 1, F.array().cast("array<array<int>>")).otherwise(many)


def groups(chunk_array: Column, positions: Column) -> Column:
    """ARRAY<STRUCT<chunk_ids, chunks_text>> of groups of positions."""
    take = lambda group, field: F.transform(group, lambda i: chunk_array[i][field])
    return F.transform(positions, lambda g: F.struct(take(g, "chunk_id").alias("chunk_ids"), take(g, "chunk_text").alias("chunks_text")))


def chunk_documents(documents: DataFrame, size: int = 8192, overlap: int = 0, least: int = 2, most: int = 5, factor: int = 1, encoding: str = "word", preprocess: Callable[[Column], Column] | None = None) -> DataFrame:
    """``documents`` with chunks and multihop_chunks; a document without content keeps its row, with empty arrays."""
    cut = documents.withColumn("chunks", chunks("document_id", "document_text", size, overlap, encoding, preprocess))
    return cut.withColumn("multihop_chunks", groups(F.col("chunks"), combinations("document_id", F.size("chunks"), least, most, factor)))


def chunk_statistics(chunked: DataFrame) -> DataFrame:
    """Per document: number of chunks, their total, average, smallest and largest length."""
    lengths = chunked.select("document_id", F.explode("chunks").alias("c")).select("document_id", F.length("c.chunk_text").alias("n"))
    return lengths.groupBy("document_id").agg(
        F.count("n").alias("chunks"), F.sum("n").alias("total_length"), F.avg("n").alias("avg_length"), F.min("n").alias("min_length"), F.max("n").alias("max_length")
    )


def chunk_totals(chunked: DataFrame) -> DataFrame:
    """One row: chunks and groups of all documents."""
    return chunked.agg(F.sum(F.size("chunks")).alias("chunks"), F.sum(F.size("multihop_chunks")).alias("groups"))
