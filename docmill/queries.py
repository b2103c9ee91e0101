"""Registered queries of the core operators: each takes (spark, sf_dir) and covers its whole tables."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import tokens
from docmill.functions.text import has_content, question_key, safe_id, strip, tag_content
from docmill.operators import assemble, chunking, crossdoc, dedup, inference, metrics, parsing, prompts, rewriting, sampling, scoring, summarize
from docmill.session import checkpoint_dir, cut_lineage, spread, table
from docmill.sources import convert, files, store

Query = Callable[[SparkSession, str], DataFrame]
QUESTION_TABLES = {"single_shot": "single_shot_questions", "multi_hop": "multi_hop_questions", "cross_document": "cross_document_questions"}
SINGLE_TEMPLATE = "Title: {title}\nSummary: {document_summary}\nText: {text_chunk}\n{additional_instructions}"
MULTI_TEMPLATE = "Title: {title}\nSummary: {document_summary}\n{chunks}{additional_instructions}"
REWRITE_TEMPLATE = "Question: {original_question}\nAnswer: {answer}\nText: {chunk_text}\nSummary: {document_summary}\n{additional_instructions}"
TITLED = ("document_filename", "document_summary")
REGISTERED: dict[str, Query] = {}


def query(f: Query) -> Query:
    """Register a query under its function's name."""
    REGISTERED[f.__name__] = f
    return f


def _long(*names: str) -> dict[str, Column]:
    return {n: F.col(n).cast("long") for n in names}


def chunked_once(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The wanted columns of ``chunked`` with one row per document; redelivered rows are equal.

    Only the wanted columns are read and shuffled.
    """
    rows = table(spark, sf_dir, "chunked").select("document_id", *columns)
    return rows.groupBy("document_id").agg(*[F.any_value(c).alias(c) for c in columns])


def questions_once(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """A question table with one row per question; redelivered rows are equal."""
    return table(spark, sf_dir, QUESTION_TABLES[kind]).dropDuplicates(["question_id"])


def _every_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question of the three tables once, with both keys, of which each table has one."""
    chunk, group = F.lit(None).cast("string").alias("chunk_id"), F.lit(None).cast("array<string>").alias("source_chunk_ids")
    keys = lambda kind: ("chunk_id", group) if kind == "single_shot" else (chunk, "source_chunk_ids")
    shared = ("question_id", "document_id", "question", "self_answer", "self_assessed_question_type", "question_mode", "choices", "citations", "generating_model", "additional_instructions", "raw_response")
    parts = [table(spark, sf_dir, name).select(*shared, *keys(kind)) for kind, name in QUESTION_TABLES.items()]
    return functools.reduce(DataFrame.unionByName, parts).dropDuplicates(["question_id"])


def _all_questions(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The wanted columns of the three question tables, redelivered rows included."""
    return functools.reduce(DataFrame.unionByName, [spread(table(spark, sf_dir, name).select(*columns)) for name in QUESTION_TABLES.values()])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` under the names of the ingested subset."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.col("text").alias("document_text"), "document_filename")
    return spread(rows)


@query
def ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stripped texts of documents with content, with their size in bytes."""
    rows = documents(spark, sf_dir).where(has_content("document_text")).withColumn("document_text", strip("document_text"))
    return rows.select("document_id", "document_filename", F.md5("document_text").alias("text_hash"), F.octet_length("document_text").cast("long").alias("file_size"))


@query
def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe ids made of file names."""
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", safe_id("document_filename", F.col("doc_id")).alias("safe_id"))


@query
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", tokens.token_count("text").cast("long").alias("tokens"))


def _windows(spark: SparkSession, sf_dir: str, size: int, overlap: int) -> DataFrame:
    made = chunking.chunks("document_id", "document_text", size, overlap)
    return documents(spark, sf_dir).select("document_id", F.inline(made)).select("document_id", "chunk_id", "chunk_text")


@query
def chunk_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 64 words."""
    return _windows(spark, sf_dir, 64, 0)


@query
def chunk_words_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 64 words that share 16 with the one before."""
    return _windows(spark, sf_dir, 64, 16)


@query
def chunk_bytepairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 128 byte-pair tokens."""
    made = chunking.chunks("document_id", "document_text", 128, 0, "byte_bpe_50k")
    return documents(spark, sf_dir).select("document_id", F.inline(made))


@query
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and lengths of each document's chunks."""
    return chunking.chunk_statistics(chunked_once(spark, sf_dir, "chunks")).withColumns(_long("min_length", "max_length"))


@query
def chunk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and groups of all documents."""
    return chunking.chunk_totals(chunked_once(spark, sf_dir, "chunks", "multihop_chunks"))


@query
def chunk_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of two to five chunk positions of each document."""
    rows = chunked_once(spark, sf_dir, "chunks").select("document_id", chunking.combinations("document_id", F.size("chunks")).alias("g"))
    each = rows.select("document_id", F.posexplode("g").alias("n", "p"))
    return each.select("document_id", F.col("n").cast("long").alias("n"), F.array_join(F.col("p").cast("array<string>"), ",").alias("positions"))


def _sampled(spark: SparkSession, sf_dir: str, how: sampling.Sampling) -> DataFrame:
    taken = sampling.sample_array(F.col("document_id"), F.col("chunks"), how)
    return chunked_once(spark, sf_dir, "chunks").select("document_id", F.posexplode(taken).alias("n", "c")).select("document_id", F.col("n").cast("long").alias("n"), "c.chunk_id")


@query
def sample_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three chunks of each document at most."""
    return _sampled(spark, sf_dir, sampling.Sampling("count", 3))


@query
def sample_percentage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of each document's chunks, rounded down."""
    return _sampled(spark, sf_dir, sampling.Sampling("percentage", 0.5))


@query
def colex_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of positions by their rank, in closed form."""
    first, second = crossdoc.pair_positions(F.col("item_id"))
    return table(spark, sf_dir, "eval_items").select("item_id", first.alias("first"), second.alias("second"))


@query
def colex_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of positions by their rank."""
    rows = table(spark, sf_dir, "eval_items").select("item_id", crossdoc.unranked(F.lit(60), F.lit(3), F.col("item_id")).alias("p"))
    return rows.select("item_id", *[F.col("p")[i].cast("long").alias(f"p{i}") for i in range(3)])


@query
def crossdoc_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of groups of each size among the documents that qualify."""
    n = crossdoc.usable_groups(table(spark, sf_dir, "chunked")).select("document_id").distinct().count()
    return spark.createDataFrame(crossdoc.quotas(n), "size long, number long")


@query
def crossdoc_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that qualify, numbered by their ids."""
    return crossdoc.numbered(crossdoc.usable_groups(table(spark, sf_dir, "chunked")))


@query
def crossdoc_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combined rows of two to five documents."""
    return crossdoc.cross_documents(table(spark, sf_dir, "chunked"))


@query
def prompt_single_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt for each chunk with content."""
    calls = prompts.single_shot_calls(chunked_once(spark, sf_dir, *TITLED, "chunks"), SINGLE_TEMPLATE, instructions="Be brief.")
    return calls.select("document_id", "chunk_id", F.md5("prompt").alias("prompt_hash"), F.array_join("tags", " ").alias("tags"))


@query
def prompt_multi_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt for each group of chunks."""
    calls = prompts.multi_hop_calls(chunked_once(spark, sf_dir, *TITLED, "multihop_chunks"), MULTI_TEMPLATE, instructions="Be brief.")
    return calls.select("document_id", F.array_join("source_chunk_ids", ",").alias("chunk_ids"), F.md5("prompt").alias("prompt_hash"), F.array_join("tags", " ").alias("tags"))


@query
def prompt_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rewriting prompt for each question with content."""
    known = chunked_once(spark, sf_dir, "document_summary", "chunks").select("document_id", "document_summary", F.col("chunks").alias("_chunks"))
    asked = questions_once(spark, sf_dir, "single_shot").join(known, "document_id", "left")
    passages = asked.withColumn("chunks", assemble.chunk_texts(F.array("chunk_id"), F.col("_chunks"), keep_missing=False))
    return prompts.rewriting_calls(passages, REWRITE_TEMPLATE).select("question_id", F.md5("prompt").alias("prompt_hash"))


@query
def builder_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the builder of single-shot prompts saw and made."""
    chunked = chunked_once(spark, sf_dir, *TITLED, "chunks")
    return prompts.builder_totals(chunked, prompts.single_shot_calls(chunked, SINGLE_TEMPLATE))


@query
def call_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many single-shot calls there are, how long their messages are, and how many a second were made in 8."""
    calls = prompts.single_shot_calls(chunked_once(spark, sf_dir, *TITLED, "chunks"), SINGLE_TEMPLATE, system="Ask.")
    return prompts.call_summary(calls, 8.0)


@query
def chunks_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks without content, for which no call is made."""
    return prompts.skipped_chunks(chunked_once(spark, sf_dir, "chunks"))


@query
def chunk_preprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 64 words of texts in lower case."""
    made = chunking.chunks("document_id", "document_text", 64, preprocess=F.lower)
    return documents(spark, sf_dir).select("document_id", F.inline(made)).select("document_id", "chunk_id", F.md5("chunk_text").alias("text_hash"))


@query
def tag_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls per tag of the multi-hop prompts."""
    return prompts.tag_histogram(prompts.multi_hop_calls(chunked_once(spark, sf_dir, *TITLED, "multihop_chunks"), MULTI_TEMPLATE))


@query
def model_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and calls by model, each call once."""
    return metrics.totals_by_model(metrics.calls_once(table(spark, sf_dir, "cost_log")))


@query
def cost_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and calls in all."""
    return metrics.overall_summary(metrics.calls_once(table(spark, sf_dir, "cost_log")))


@query
def call_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every evaluation item asked of the models of a stage."""
    models = [inference.Model(n) for n in ("quill", "loom", "plume")]
    chosen = inference.chosen_models(models, ["plume", "quill"])
    return inference.call_matrix(table(spark, sf_dir, "eval_items").select("item_id"), chosen).withColumns(_long("model_order"))


@query
def answered_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses with content by model."""
    rows = _all_questions(spark, sf_dir, "generating_model", "raw_response").select(F.lower("generating_model").alias("model_name"), F.col("raw_response").alias("response"))
    told = rows.withColumns({"success": F.lit(True), "seconds": F.lit(0.0), "attempts": F.lit(1)})
    return inference.call_success(told).select("model_name", "calls", "answered")


@query
def error_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as errors, by category."""
    message = F.element_at(F.array(*map(F.lit, ("Request timeout", "rate_limit hit", "Authentication failed", "connection reset", "odd"))), (F.col("event_id") % 5 + 1).cast("int"))
    kind = F.when(F.col("event_id") % 7 == 0, "RateLimitError").otherwise("Error")
    rows = table(spark, sf_dir, "events").select(inference.error_category(message, kind).alias("category"))
    return rows.groupBy("category").agg(F.count("*").alias("events"))


@query
def parse_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects in the responses' JSON lists, with their fields normalised."""
    responses = _all_questions(spark, sf_dir, "raw_response").select(F.md5("raw_response").alias("response_id"), F.col("raw_response").alias("response")).where("response_id IS NOT NULL")
    once = responses.groupBy("response_id").agg(F.max("response").alias("response"))
    found = parsing.pairs(once, "response", ("response_id",))
    counted = {"citations": F.size("citations").cast("long"), "choices": F.size("choices").cast("long")}
    return found.withColumns({**counted, **_long("pair_position", "estimated_difficulty")}).withColumn("custom_fields", F.array_join(F.array_sort(F.map_keys("custom_fields")), ","))


@query
def choices_permuted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choices in hashed order, with the answer moved along."""
    rows = _every_question(spark, sf_dir).where("question IS NOT NULL AND size(choices) = 4 AND self_answer rlike '^[A-D]$'")
    out = parsing.permuted_choices(rows.select("question_id", "question", "self_answer", "choices"))
    return out.select("question_id", "self_answer", F.array_join("choices", "|").alias("choices"))


@query
def document_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without copies up to case, punctuation, digits and spacing."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup.keep_first(rows, question_key("text"), ["doc_id"]).select("doc_id")


@query
def last_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last call of each stage and model."""
    rows = metrics.calls_once(table(spark, sf_dir, "cost_log")).select(F.concat_ws("/", "stage", "model_name").alias("slot"), "call_id", "input_tokens")
    return dedup.keep_last(rows, "slot", "call_id").select("slot", "input_tokens")


@query
def without_empties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question records with empty values as null."""
    rows = _every_question(spark, sf_dir).select("question_id", "document_id", "question", "generating_model", "additional_instructions", "citations")
    return parsing.without_empties(rows).select("question_id", "additional_instructions", F.array_join("citations", "|").alias("citations"))




@query
def question_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of all three tables without repetitions; the smallest id stays."""
    return dedup.distinct_questions(_every_question(spark, sf_dir).select("question_id", "question"), ["question_id"])


@query
def question_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each question of all three tables may stay: in its mode, and with one key."""
    rows = _every_question(spark, sf_dir).withColumn("choices", F.coalesce("choices", F.array().cast("array<string>")))
    valid = parsing.mode_valid(F.coalesce(F.lower("question_mode"), F.lit(""))) & parsing.record_valid(F.col("chunk_id"), F.col("source_chunk_ids"))
    return rows.select("question_id", valid.alias("valid"))


@query
def gold_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold answers of all three tables as positions or texts."""
    index, text = assemble.gold(F.lower("question_mode"), F.col("self_answer"))
    return _every_question(spark, sf_dir).select("question_id", F.array_join(index.cast("array<string>"), ",").alias("gold_index"), F.array_join(text, ",").alias("gold_text"))


@query
def message_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the chat of each question and answer of all three tables."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), F.coalesce(text, F.lit("")).alias("content"))
    chat = F.array(turn("user", F.col("question")), turn("assistant", F.col("self_answer")))
    return _every_question(spark, sf_dir).select("question_id", tokens.message_tokens(chat).cast("long").alias("tokens"))


@query
def analysis_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands in, or after, the analysis tag of each response of all three tables."""
    return _every_question(spark, sf_dir).select("question_id", F.md5(tag_content("raw_response", "document_analysis")).alias("analysis"))


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunked = chunked_once(spark, sf_dir, "document_text", "document_summary", "chunks")
    known = assemble.with_summaries(assemble.documents_once(chunked), chunked)
    single, multi, cross = (questions_once(spark, sf_dir, k) for k in QUESTION_TABLES)
    return assemble.evaluation_table(known, single, multi, None).unionByName(assemble.across_documents(cross, chunked))


@query
def evaluation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All questions with their passages."""
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), "|")
    return _prepared(spark, sf_dir).select(
        "kind", "document_id", "question", "ground_truth_answer", "question_category", "question_generating_model", "additional_instructions",
        F.col("estimated_difficulty").cast("long").alias("estimated_difficulty"),
        *[joined(c).alias(c) for c in ("gold_index", "gold_text", "choices", "citations", "chunk_ids")],
        F.md5(joined("chunks")).alias("chunks_hash"), F.size("chunks").cast("long").alias("chunks"),
        F.length("document").cast("long").alias("document_length"), F.md5("document_summary").alias("summary_hash"),
    )


@query
def evaluation_slim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions and answers by kind, category and model."""
    return assemble.slim(_prepared(spark, sf_dir)).groupBy("kind", "question_category", "question_generating_model").agg(
        F.count("*").alias("questions"), F.sum(F.size("citations")).alias("citations"), F.sum("estimated_difficulty").alias("difficulty")
    )


@query
def crossdoc_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the combined rows: how many of each size, and whether their members differ, are in order, exist, and give their chunks and names."""
    chunked = table(spark, sf_dir, "chunked")
    rows = crossdoc.cross_documents(chunked)
    m, one = F.col("cross_document_metadata"), F.col("multihop_chunks")[0]
    members = F.array_sort(F.array_distinct(m["source_documents"]))
    fit = (F.size(members) == m["num_source_docs"]) & (members == m["source_documents"]) & (F.array_sort("cross_document_metadata.source_indices") == m["source_indices"])
    fit &= (F.size(one["chunk_ids"]) == F.size(one["chunks_text"])) & (F.size(one["chunk_ids"]) >= m["num_source_docs"]) & F.col("document_id").startswith(F.concat(F.lit("cross_"), m["num_source_docs"].cast("string"), F.lit("docs_")))
    each = rows.select("document_id", m["num_source_docs"].alias("size"), fit.alias("fit"), F.explode(m["source_documents"]).alias("member"))
    known = crossdoc.usable_groups(chunked).select(F.col("document_id").alias("member")).distinct().withColumn("known", F.lit(True))
    joined = each.join(known, "member", "left").groupBy("document_id", "size").agg(F.bool_and(F.col("fit") & F.coalesce("known", F.lit(False))).alias("fit"))
    return joined.groupBy(F.col("size").cast("long").alias("size")).agg(F.count("*").alias("number"), F.bool_and("fit").alias("fit"))


@query
def sample_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two groups of chunks of each document at most; a lone one stays."""
    taken = sampling.sample_array(F.col("document_id"), F.col("multihop_chunks"), sampling.Sampling("count", 2), least=2)
    rows = chunked_once(spark, sf_dir, "multihop_chunks").select("document_id", F.posexplode(taken).alias("n", "g"))
    return rows.select("document_id", F.col("n").cast("long").alias("n"), F.array_join("g.chunk_ids", ",").alias("chunk_ids"))


@query
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of chunks of every document, those without content included."""
    rows = documents(spark, sf_dir).select("document_id", "document_text")
    return chunking.chunk_documents(rows, 64).select("document_id", F.size("chunks").cast("long").alias("chunks"))


@query
def bytepair_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an unknown encoding counts as the byte pairs of 50k do, and a text has no more of those than bytes."""
    rows = documents(spark, sf_dir)
    odd, own = tokens.token_count("document_text", "no_such_encoding"), tokens.token_count("document_text", "byte_bpe_50k")
    return rows.select("document_id", (odd == own).alias("same"), (own <= F.octet_length(F.coalesce("document_text", F.lit("")))).alias("bounded"))


@query
def summary_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of each part of a document."""
    calls = summarize.part_calls(documents(spark, sf_dir), "Sum up:\n{document}", 100, 10)
    return calls.select("document_id", F.col("part").cast("long").alias("part"), F.md5("prompt").alias("prompt_hash"))


@query
def pages_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks read as transcribed pages, put together."""
    pages = chunked_once(spark, sf_dir, "chunks").select(F.col("document_id").alias("path"), F.lit(0).alias("model_order"), F.posexplode("chunks").alias("page", "c"))
    joined = files.joined_pages(pages.select("path", "model_order", "page", F.col("c.chunk_text").alias("text")))
    return joined.select(F.col("path").alias("document_id"), F.md5("text").alias("text_hash"))


def _answering(model, prompt: str) -> str:
    """A provider that can't answer prompts of every third length."""
    if len(prompt) % 3 == 0:
        raise TimeoutError("too slow")
    return f"{model.name}: {prompt}"


@query
def calls_answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation questions asked of two models, one attempt each, with what came of it."""
    models = [inference.Model("quill", concurrency=4), inference.Model("plume", concurrency=1)]
    calls = table(spark, sf_dir, "eval_items").select("item_id", F.col("question").alias("prompt"))
    found = inference.answers(calls, models, _answering, attempts=1, tasks=spark.sparkContext.defaultParallelism)
    error = F.when(~F.col("success"), inference.error_category("error_message", "error_type"))
    return found.select("item_id", "model_name", _long("model_order")["model_order"].alias("model_order"), "response", "success", F.col("attempts").cast("long").alias("attempts"), error.alias("error"))


@query
def model_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, answers and successes by model."""
    rows = _all_questions(spark, sf_dir, "generating_model", "raw_response").select(F.lower("generating_model").alias("model_name"), F.col("raw_response").alias("response"))
    told = rows.withColumns({"success": F.col("response").isNotNull(), "seconds": F.lit(1.0), "attempts": F.lit(1)})
    return inference.call_success(told).select("model_name", "calls", "answered", F.round("success_rate", 6).alias("success_rate"), "avg_seconds", "avg_attempts")


def _folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one for what a query writes and reads again."""
    checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}_{uuid.uuid4().hex}"


@query
def files_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as text files of four kinds and read again: files by extension and bytes, those in folders for output and of other kinds left out."""
    root = _folder(spark, "files")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for kind, place in enumerate(("a", "b/c", "output", "d")):
        rows.where(F.col("doc_id") % 4 == kind).select("text").write.text(f"{root}/{place}", compression="gzip" if place == "d" else None)
    found = files.files(spark, root, (".txt",))
    return found.groupBy("extension").agg(F.sum("length").alias("bytes"), F.sum(F.octet_length(convert.utf8("content"))).cast("long").alias("text_bytes"))


@query
def files_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as text files and ingested: the bytes of their stripped texts, each file once."""
    root = _folder(spark, "ingest")
    table(spark, sf_dir, "eval_items").select("passage").coalesce(1).write.text(root)
    rows = files.ingested(files.texts(files.files(spark, root, (".txt",))))
    return rows.select(F.md5("document_text").alias("text_hash"), F.col("document_metadata.file_size").alias("file_size"), (F.length("document_id") == 32).alias("named"))


@query
def subset_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls saved to a store, with more of them added, then replaced by a table made of itself, and loaded again."""
    kept = store.SubsetStore(spark, _folder(spark, "store"))
    rows = table(spark, sf_dir, "cost_log").select("call_id", "model_name", "input_tokens")
    kept.save(rows.where("call_id % 2 = 0"), "calls")
    kept.save(rows.where("call_id % 2 <> 0"), "calls", append=True)
    kept.save(store.replace_columns(kept.load("calls"), {"model_name": F.lower("model_name"), "known": F.col("input_tokens").isNotNull()}), "calls")
    return kept.load("calls")


@query
def subset_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question tables exported as JSON lines and read again."""
    folder = _folder(spark, "export")
    parts = []
    for name in QUESTION_TABLES.values():
        store.write_jsonl(table(spark, sf_dir, name).select("question_id", "question"), f"{folder}/{name}")
        parts.append(spark.read.schema("question_id long, question string").json(f"{folder}/{name}").withColumn("subset", F.lit(name)))
    return functools.reduce(DataFrame.unionByName, parts)


@query
def call_log_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls written to the log and totalled from it, in the models' order."""
    folder = _folder(spark, "log")
    calls = metrics.calls_once(table(spark, sf_dir, "cost_log"))
    metrics.write_call_log(calls, f"{folder}/log")
    metrics.write_totals(spark.read.schema(metrics.LOG).option("header", True).csv(f"{folder}/log"), f"{folder}/totals")
    return spark.read.schema("model_name string, total_input_tokens long, total_output_tokens long, total_calls long").option("header", True).csv(f"{folder}/totals")


@query
def custom_fields_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a custom schema, from responses to the evaluation table."""
    words = tokens.word_tokens("question")
    item = F.to_json(F.array(F.struct(F.col("question"), F.lit("open").alias("answer"), F.lit("q").alias("question_type"), F.element_at(words, 1).alias("hint"), F.size(words).alias("steps"))))
    asked = table(spark, sf_dir, "eval_items").where(has_content("question"))
    answered = asked.select(F.col("item_id").cast("string").alias("document_id"), F.lit("c").alias("chunk_id"), F.lit("quill").alias("generating_model"), F.concat(F.lit("<output_json>"), item, F.lit("</output_json>")).alias("response"))
    found = parsing.questions(answered, "chunk_id", "open-ended")
    none = spark.createDataFrame([], "document_id string, document_text string, chunks array<struct<chunk_id: string, chunk_text: string>>, document_summary string")
    rows = assemble.records(found, "single_shot", none, F.col("question_mode"))
    return rows.select("document_id", "question", F.col("custom_fields")["hint"].alias("hint"), F.col("custom_fields")["steps"].cast("long").alias("steps"), F.size("custom_fields").cast("long").alias("fields"))


def _contained(rows: DataFrame) -> DataFrame:
    found = scoring.containment(F.col("citations"), F.col("chunks"), F.col("ground_truth_answer"))
    return rows.select("kind", "document_id", "question", "ground_truth_answer", *[F.round(v, 6).alias(k) for k, v in found.items()])


@query
def citation_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation scores where only containment counts, of questions of every kind."""
    return _contained(_prepared(spark, sf_dir))


@query
def citation_scores_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of the best window similarities: full where every citation is contained, 0 without any, and in bounds."""
    rows = citation_scores(spark, sf_dir)
    full = lambda c: (F.col(c) == 100).alias(c)
    bounds = functools.reduce(lambda a, b: a & b, [F.col(c).between(0, 100) for c in scoring.SCORES.names])
    weighted = F.abs(F.col("citation_score") - 0.7 * F.col("chunk_citation_score") - 0.3 * F.col("answer_citation_score")) < 1e-9
    return rows.select("kind", "document_id", "question", full("answer_citation_score"), full("chunk_citation_score"), (bounds & weighted).alias("sound"))


@query
def citation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation scores by best window similarity, over the written table as in the pipeline."""
    written = cut_lineage(_prepared(spark, sf_dir).select("kind", "document_id", "question", "citations", "chunks", "ground_truth_answer"))
    return scoring.scored(spread(written)).select("kind", "document_id", "question", *scoring.SCORES.names)


@query
def rewrite_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions reworded by responses made of their own words; every third response is unusable."""
    rows = _every_question(spark, sf_dir).where("question IS NOT NULL")
    new = F.concat(F.lit("<rewritten_question> In short: "), "question", F.lit(" </rewritten_question><question_rewriting_rationale>shorter</question_rewriting_rationale>"))
    responses = rows.select("question_id", F.lit("quill").alias("rewriting_model"), F.when(F.col("question_id") % 3 == 0, "no tags").otherwise(new).alias("response"))
    out = rewriting.rewritten(rows, responses)
    return out.select("question_id", "question", "original_question", "question_mode", "question_rewriting_rationale")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarize.parts(documents(spark, sf_dir), 100, 10)


@query
def summary_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the documents that are summarised one by one."""
    return _parts(spark, sf_dir).select("document_id", F.col("part").cast("long").alias("part"), F.md5("text").alias("text_hash"))


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.array_join(F.slice(tokens.word_tokens("text"), 1, 6), " ")
    response = F.when(F.size(tokens.word_tokens("text")) > 20, F.concat(F.lit("<chunk_summary>"), head, F.lit("</chunk_summary>"))).otherwise(F.concat(F.lit("<final_summary>"), head))
    return summarize.by_document(_parts(spark, sf_dir).withColumn("response", response))


@query
def summary_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts that combine the summaries of a document's parts."""
    return summarize.combine_calls(_summaries(spark, sf_dir), "Combine:\n{chunk_summaries}\nEnd").select("document_id", F.md5("prompt").alias("prompt_hash"))


@query
def summary_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final summaries, where every other combining response lacks one."""
    summaries = _summaries(spark, sf_dir)
    calls = summarize.combine_calls(summaries, "{chunk_summaries}")
    response = F.when(F.col("document_id").cast("long") % 2 == 0, F.concat(F.lit("<final_summary>All of "), "document_id", F.lit("</final_summary>"))).otherwise("nothing")
    return summarize.merged(summaries, calls.select("document_id", response.alias("response")))


@query
def subset_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three question tables as one, by table."""
    parts = [table(spark, sf_dir, n).select(F.lit(n).alias("subset")) for n in QUESTION_TABLES.values()]
    return store.jsonl_index(parts)


@query
def markup_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read as pages, as Markdown."""
    return table(spark, sf_dir, "documents").select("doc_id", convert.html_markdown("text").alias("markdown"))


@query
def markup_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read as pages, by column functions."""
    return table(spark, sf_dir, "documents").select("doc_id", convert.strip_tags("text").alias("text"))


@query
def questions_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From documents to scored questions: chunks, stub responses, parsing, validation, deduplication, grounding."""
    parts = _windows(spark, sf_dir, 64, 0)
    answered = parts.select("document_id", "chunk_id", "chunk_text", F.lit("quill").alias("generating_model"), inference.stub_response(F.col("chunk_text"), F.lit("quill")).alias("response"))
    found = parsing.questions(answered, "chunk_id", "open-ended").drop("custom_fields")
    once = dedup.distinct_questions(found, ["document_id", "chunk_id", "pair_position"])
    score = scoring.containment(F.col("citations"), F.array("chunk_text"), F.col("self_answer"))["citation_score"]
    return once.select("document_id", "chunk_id", "question", "self_answer", F.col("estimated_difficulty").cast("long").alias("estimated_difficulty"), score.alias("citation_score"))
