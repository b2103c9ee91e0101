"""The evaluation table: three kinds of questions, each with its source passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import let
from docmill.schemas import PREPARED

#: Columns of the slim table in the order of its contract (fixed values).
SLIM = (
    "question",
    "ground_truth_answer",
    "question_category",
    "kind",
    "estimated_difficulty",
    "citations",
    "document_id",
    "chunk_ids",
    "question_generating_model",
    "choices",
    "gold_index",
    "gold_text",
)


def documents_once(chunked: DataFrame, order: Column | None = None) -> DataFrame:
    """One row per document: of rows with one id, the last in ``order`` (by default the one with most chunks, then the longest text)."""
    rank = order if order is not None else F.struct(F.size("chunks"), F.length("document_text"), F.xxhash64("document_text"))
    return chunked.groupBy("document_id").agg(F.max_by(F.struct("document_text", "chunks"), rank).alias("d")).select("document_id", "d.*")


def with_summaries(documents: DataFrame, summarized: DataFrame) -> DataFrame:
    """Documents with the summary of the ``summarized`` table, "" where it has none."""
    once = summarized.groupBy("document_id").agg(F.max("document_summary").alias("document_summary"))
    return documents.join(once, "document_id", "left").withColumn("document_summary", F.coalesce("document_summary", F.lit("")))


def chunk_texts(ids: Column, chunks: Column, keep_missing: bool) -> Column:
    """Texts of chunk ids, in their order; a missing one is "" or left out. Empty ids are skipped."""
    known = F.filter(F.coalesce(chunks, F.array().cast("array<struct<chunk_id:string,chunk_text:string>>")), lambda c: c["chunk_id"].isNotNull())
    wanted = F.filter(F.coalesce(ids, F.array().cast("array<string>")), lambda k: k.isNotNull() & (k != ""))

    def texts(own: Column) -> Column:
        last = lambda k: F.try_element_at(F.filter(own, lambda c: c["chunk_id"] == k), F.lit(-1))["chunk_text"]
        return F.transform(wanted, lambda k: F.coalesce(last(k), F.lit("")))

    found = let(known, texts)
    return found if keep_missing else F.filter(found, lambda t: t != "")


def gold(mode: Column, answer: Column) -> tuple[Column, Column]:
    """Gold as choice positions and as texts: the one a multi-choice question has, the other any other.

    An empty multi-choice answer stands for the first choice; one that is no single letter gives
    no position.
    """
    multi = F.coalesce(mode == "multi-choice", F.lit(False))
    text = F.coalesce(answer, F.lit(""))
    index = F.when(text == "", 0).when(text.rlike("^[A-Z]$"), F.ascii(text) - 65)
    none = F.array().cast("array<int>")
    return F.when(multi & index.isNotNull(), F.array(index)).otherwise(none), F.when(multi, F.array().cast("array<string>")).otherwise(F.array(text))


def custom_fields(questions: DataFrame) -> Column:
    """The fields of a custom output schema, none where the table has no such column."""
    name = "custom_fields"
    return F.col(name) if name in questions.columns else F.lit(None).cast("map<string,string>").alias(name)


def records(questions: DataFrame, kind: str, documents: DataFrame, mode: Column) -> DataFrame:
    """Questions of one kind in the schema of the evaluation table.

    A question whose document isn't known keeps its row, with "" for the text and no chunks.
    """
    single = kind == "single_shot"
    ids = F.array("chunk_id") if single else F.col("source_chunk_ids")
    asked = questions.withColumn("_ids", F.filter(F.coalesce(ids, F.array().cast("array<string>")), lambda k: k.isNotNull() & (k != "")))
    joined = asked.join(documents.select("document_id", F.col("document_text").alias("_text"), F.col("chunks").alias("_chunks"), F.col("document_summary").alias("_summary")), "document_id", "left")
    index, text = gold(mode, F.col("self_answer"))
    empty = F.array().cast("array<string>")
    return joined.select(
        F.coalesce("question", F.lit("")).alias("question"),
        F.coalesce("additional_instructions", F.lit("")).alias("additional_instructions"),
        F.coalesce("self_answer", F.lit("")).alias("ground_truth_answer"),
        index.alias("gold_index"),
        text.alias("gold_text"),
        F.coalesce("choices", empty).alias("choices"),
        F.coalesce("self_assessed_question_type", F.lit("unknown")).alias("question_category"),
        F.lit(kind).alias("kind"),
        F.coalesce("estimated_difficulty", F.lit(5)).alias("estimated_difficulty"),
        F.coalesce("citations", empty).alias("citations"),
        "document_id",
        F.col("_ids").alias("chunk_ids"),
        F.coalesce("generating_model", F.lit("")).alias("question_generating_model"),
        chunk_texts(F.col("_ids"), F.col("_chunks"), keep_missing=not single).alias("chunks"),
        F.coalesce("_text", F.lit("")).alias("document"),
        F.coalesce("_summary", F.lit("")).alias("document_summary"),
        custom_fields(questions),
    )


def evaluation_table(documents: DataFrame, single: DataFrame | None, multi: DataFrame | None, cross: DataFrame | None) -> DataFrame:
    """All kinds of questions in one table; a kind that is missing adds no rows."""
    parts = [
        records(table, kind, documents, F.lower("question_mode"))
        for kind, table in (("single_shot", single), ("multi_hop", multi), ("cross_document", cross))
        if table is not None
    ]
    if not parts:
        return documents.sparkSession.createDataFrame([], PREPARED)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def slim(prepared: DataFrame) -> DataFrame:
    """Questions and answers without their texts."""
    return prepared.select(*SLIM)


def across_documents(questions: DataFrame, chunked: DataFrame) -> DataFrame:
    """Cross-document questions in the schema of the evaluation table.

    Their document is none of the table, so chunk texts are looked up by chunk id wherever the
    chunk lies, in the order of the ids, "" for a missing one; the document's text is "".
    """
    ids = F.filter(F.coalesce("source_chunk_ids", F.array().cast("array<string>")), lambda k: k.isNotNull() & (k != ""))
    asked = questions.withColumn("_ids", ids)
    lists = asked.select("_ids").distinct()  # what a row gets depends on its ids alone
    wanted = lists.select("_ids", F.posexplode("_ids").alias("n", "chunk_id"))
    texts = chunked.select(F.inline("chunks")).where("chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.max("chunk_text").alias("text"))
    found = wanted.join(texts, "chunk_id", "left").groupBy("_ids").agg(F.array_sort(F.collect_list(F.struct("n", F.coalesce("text", F.lit("")).alias("t")))).alias("c"))
    joined = asked.join(found.select("_ids", F.transform("c", lambda x: x["t"]).alias("_texts")), "_ids", "left")
    index, text = gold(F.lower("question_mode"), F.col("self_answer"))
    empty = F.array().cast("array<string>")
    return joined.select(
        F.coalesce("question", F.lit("")).alias("question"),
        F.coalesce("additional_instructions", F.lit("")).alias("additional_instructions"),
        F.coalesce("self_answer", F.lit("")).alias("ground_truth_answer"),
        index.alias("gold_index"),
        text.alias("gold_text"),
        F.coalesce("choices", empty).alias("choices"),
        F.coalesce("self_assessed_question_type", F.lit("unknown")).alias("question_category"),
        F.lit("cross_document").alias("kind"),
        F.coalesce("estimated_difficulty", F.lit(5)).alias("estimated_difficulty"),
        F.coalesce("citations", empty).alias("citations"),
        "document_id",
        F.col("_ids").alias("chunk_ids"),
        F.coalesce("generating_model", F.lit("")).alias("question_generating_model"),
        F.coalesce("_texts", empty).alias("chunks"),
        F.lit("").alias("document"),
        F.lit("").alias("document_summary"),
        custom_fields(questions),
    )
