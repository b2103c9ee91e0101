"""Prompts: one row per call, with its messages, its tags and the key of what it asks about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import has_content, render, strip
from docmill.operators.sampling import Sampling, sample_array


def messages(system: str | None, user: Column) -> Column:
    """ARRAY<STRUCT<role, content>>."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(*([turn("system", F.lit(system))] if system else []), turn("user", user))


def title(filename: Column | str, document_id: Column | str) -> Column:
    """File name of a document, or ``doc_<id>`` where it has none."""
    return F.coalesce(filename if isinstance(filename, Column) else F.col(filename), F.concat(F.lit("doc_"), F.col(document_id) if isinstance(document_id, str) else document_id))


def size_class(n: Column) -> Column:
    """few_chunks up to 2, medium_chunks up to 5, else many_chunks."""
    return F.when(n <= 2, "few_chunks").when(n <= 5, "medium_chunks").otherwise("many_chunks")


def single_shot_calls(chunked: DataFrame, template: str, system: str | None = None, instructions: str = "", sampling: Sampling = Sampling()) -> DataFrame:
    """A call per chunk with content: document_id, chunk_id, prompt, messages, tags."""
    taken = sample_array(F.col("document_id"), F.col("chunks"), sampling)
    each = chunked.select("document_id", "document_filename", "document_summary", F.posexplode(taken).alias("n", "c")).where(has_content(F.col("c.chunk_text")))
    prompt = render(
        template,
        title=title("document_filename", "document_id"),
        document_summary=F.col("document_summary"),
        text_chunk=F.col("c.chunk_text"),
        additional_instructions=F.lit(instructions),
    )
    tags = F.array(
        F.lit("single_shot_qa"),
        F.concat(F.lit("doc_"), "document_id"),
        F.concat(F.lit("chunk_"), F.col("n").cast("string")),
        F.concat(F.lit("chunk_len_"), F.length("c.chunk_text").cast("string")),
    )
    out = each.select("document_id", F.col("c.chunk_id").alias("chunk_id"), prompt.alias("prompt"), tags.alias("tags"))
    return out.withColumn("messages", messages(system, F.col("prompt")))


def tagged_chunks(texts: Column) -> Column:
    """The texts of a group, each between numbered tags, one per line."""
    number = lambda i: i.cast("string")
    each = F.transform(texts, lambda t, i: F.concat(F.lit("<text_chunk_"), number(i), F.lit(">"), t, F.lit("</text_chunk_"), number(i), F.lit(">\n")))
    return F.array_join(each, "")


def multi_hop_calls(chunked: DataFrame, template: str, system: str | None = None, instructions: str = "", sampling: Sampling = Sampling()) -> DataFrame:
    """A call per group of chunks that has texts: document_id, source_chunk_ids, prompt, messages, tags."""
    taken = sample_array(F.col("document_id"), F.col("multihop_chunks"), sampling, least=2)
    each = chunked.select("document_id", "document_filename", "document_summary", F.posexplode(taken).alias("n", "g")).where(F.size("g.chunks_text") > 0)
    text = tagged_chunks(F.col("g.chunks_text"))
    prompt = render(
        template,
        title=title("document_filename", "document_id"),
        document_summary=F.col("document_summary"),
        chunks=text,
        additional_instructions=F.lit(instructions),
    )
    size = F.size("g.chunks_text")
    tags = F.array(
        F.lit("multi_hop_qa"),
        F.concat(F.lit("doc_"), "document_id"),
        F.concat(F.lit("group_"), F.col("n").cast("string")),
        F.concat(F.lit("chunks_"), size.cast("string")),
        F.concat(F.lit("total_len_"), F.length(text).cast("string")),
        size_class(size),
    )
    out = each.select("document_id", F.col("g.chunk_ids").alias("source_chunk_ids"), prompt.alias("prompt"), tags.alias("tags"))
    return out.withColumn("messages", messages(system, F.col("prompt")))


def rewriting_calls(questions: DataFrame, template: str, system: str | None = None, instructions: str = "") -> DataFrame:
    """A call per question with content; ``chunks`` is an array of texts, joined by blank lines."""
    prompt = render(
        template,
        original_question=F.col("question"),
        answer=F.col("self_answer"),
        chunk_text=F.array_join("chunks", "\n\n"),
        document_summary=F.col("document_summary"),
        additional_instructions=F.lit(instructions),
    )
    return questions.where(strip("question") != "").withColumn("prompt", prompt).withColumn("messages", messages(system, F.col("prompt")))


def builder_totals(chunked: DataFrame, calls: DataFrame) -> DataFrame:
    """One row: documents, chunks, calls, chunks skipped as blank, average prompt length over the chunks."""
    seen = chunked.select(
        F.lit(1).alias("documents"),
        F.size("chunks").alias("chunks"),
        F.size(F.filter("chunks", lambda c: ~has_content(c["chunk_text"]))).alias("skipped"),
        F.lit(0).alias("calls"),
        F.lit(0).alias("length"),
    )
    made = calls.select(F.lit(0).alias("documents"), F.lit(0).alias("chunks"), F.lit(0).alias("skipped"), F.lit(1).alias("calls"), F.length("prompt").alias("length"))
    total = seen.unionByName(made).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("documents", "chunks", "skipped", "calls", "length")])
    return total.select("documents", "chunks", "skipped", "calls", (F.col("length") / F.nullif(F.col("chunks"), F.lit(0))).alias("avg_prompt_length"))


def tag_histogram(calls: DataFrame) -> DataFrame:
    """Number of calls per tag."""
    return calls.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("calls"))


def skipped_chunks(chunked: DataFrame) -> DataFrame:
    """(document_id, chunk_id) of the chunks without content, for which there is no call."""
    return chunked.select("document_id", F.explode("chunks").alias("c")).where(~has_content(F.col("c.chunk_text"))).select("document_id", "c.chunk_id")


def call_summary(calls: DataFrame, seconds: float = 0.0) -> DataFrame:
    """One row: calls, the average, least and largest length of their messages together, and calls per second (0 of no time)."""
    length = F.aggregate(F.transform("messages", lambda m: F.length(F.coalesce(m["content"], F.lit("")))), F.lit(0), lambda a, n: a + n)
    sizes = calls.select(length.alias("n"))
    none = lambda c: F.coalesce(c, F.lit(0))
    rate = F.count("*") / F.lit(float(seconds)) if seconds > 0 else F.lit(0.0)
    return sizes.agg(
        F.count("*").alias("total_calls"),
        none(F.avg("n")).alias("avg_message_length"),
        none(F.min("n")).cast("long").alias("min_message_length"),
        none(F.max("n")).cast("long").alias("max_message_length"),
        rate.alias("calls_per_second"),
    )
