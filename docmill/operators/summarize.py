"""Summaries in two steps: of the parts of a document, and of the parts' summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import bullets, has_content, render, strip, tag_content
from docmill.functions.tokens import token_count
from docmill.operators.chunking import token_windows

NO_SUMMARY = "No summary available."


def parts(documents: DataFrame, most: int = 32768, overlap: int = 512, encoding: str = "word") -> DataFrame:
    """(document_id, part, text): the whole text as part -1 if it has at most ``most`` tokens, else its windows from 0."""
    whole = F.array(F.struct(F.lit(-1).alias("part"), F.coalesce("document_text", F.lit("")).alias("text")))
    windows = F.transform(token_windows("document_text", most, overlap, encoding), lambda t, i: F.struct(i.alias("part"), t.alias("text")))
    chosen = F.when(token_count("document_text", encoding) <= most, whole).otherwise(windows)
    return documents.select("document_id", F.inline(chosen))


def part_calls(documents: DataFrame, template: str, most: int = 32768, overlap: int = 512, encoding: str = "word") -> DataFrame:
    """:func:`parts` with the prompt of each."""
    return parts(documents, most, overlap, encoding).withColumn("prompt", render(template, document=F.col("text")))


def extracted(response: Column | str) -> Column:
    """Summary in a response: the chunk tag's, else the final tag's, else ""."""
    return F.coalesce(F.nullif(tag_content(response, "chunk_summary"), F.lit("")), tag_content(response, "final_summary"))


def by_document(responses: DataFrame) -> DataFrame:
    """(document_id, summaries) in the order of the parts; a missing response is ""."""
    each = F.struct("part", extracted(F.coalesce("response", F.lit(""))).alias("summary"))
    grouped = responses.groupBy("document_id").agg(F.array_sort(F.collect_list(each)).alias("s"))
    return grouped.select("document_id", F.transform("s", lambda x: x["summary"]).alias("summaries"))


def combine_calls(summaries: DataFrame, template: str) -> DataFrame:
    """A call for each document with more than one summary that has content."""
    useful = F.filter("summaries", lambda s: has_content(s))
    return summaries.withColumn("useful", useful).where(F.size("useful") > 1).select("document_id", render(template, chunk_summaries=bullets(F.col("useful"))).alias("prompt"))


def merged(summaries: DataFrame, combined: DataFrame) -> DataFrame:
    """(document_id, document_summary): the combined summary, or the first that has content, or "".

    A combined response without a summary gives a fixed text that says so. ``combined`` has
    document_id and response.
    """
    final = tag_content(F.coalesce("response", F.lit("")), "final_summary")
    answers = combined.select("document_id", F.when(final == "", NO_SUMMARY).otherwise(final).alias("final"))
    first = F.try_element_at(F.filter("summaries", lambda s: has_content(s)), F.lit(1))
    joined = summaries.join(answers, "document_id", "left")
    return joined.select("document_id", F.coalesce("final", strip(first), F.lit("")).alias("document_summary"))
