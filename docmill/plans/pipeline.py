"""The stages from files to scored questions, each from subsets of the store to one."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill import schemas
from docmill.operators import assemble, chunking, crossdoc, dedup, inference, metrics, parsing, prompts, rewriting, scoring, summarize
from docmill.plans import card, schema_prompt
from docmill.plans.config import Config
from docmill.plans.prompts import DEFAULTS, load_prompt
from docmill.session import cut_lineage
from docmill.sources import files
from docmill.sources.hub import Hub
from docmill.sources.store import SubsetStore, conform, write_index

log = logging.getLogger("docmill")

#: Warnings of a kind that are logged.
WARNINGS = 5


class Pipeline:
    """Runs the enabled stages in their order; the first that fails ends the run."""

    def __init__(self, spark: SparkSession, config: Config, provider: inference.Provider, hub: Hub | None = None):
        self.spark, self.config, self.provider, self.logged = spark, config, provider, False
        self.hub = hub
        self.store = SubsetStore(spark, config.storage.local_dataset_dir)
        self.steps: dict[str, Callable] = {
            "ingestion": self.ingest,
            "summarization": self.summarize,
            "chunking": self.chunk,
            "single_shot_question_generation": lambda s: self.ask("single_shot_questions", "chunk_id", s),
            "multi_hop_question_generation": lambda s: self.ask("multi_hop_questions", "source_chunk_ids", s),
            "cross_document_question_generation": self.ask_across,
            "question_rewriting": self.rewrite,
            "prepare_lighteval": self.prepare,
            "citation_score_filtering": self.score,
        }

    def run(self) -> dict[str, float]:
        """Seconds of each stage."""
        took = {}
        for name in self.config.enabled():
            began = time.monotonic()
            self.spark.sparkContext.setJobGroup(name, name)
            log.info("%s begins", name)
            try:
                self.steps[name](self.config.stages[name])
            except Exception:
                log.exception("%s failed", name)
                raise
            took[name] = time.monotonic() - began
            log.info("%s took %.1f s", name, took[name])
        if self.config.storage.export_jsonl:
            target = self.config.storage.jsonl_export_dir
            write_index(self.spark, self.store.export_jsonl(target), target)
        self.write_totals()
        self.write_card()
        return took

    def call_log(self) -> str:
        """Where a row per call is kept, beside the subsets."""
        return f"{self.store.root}/_calls/log"

    def write_totals(self) -> None:
        """Write the totals of all calls by model, if any were made."""
        if self.logged:
            calls = self.spark.read.schema(metrics.LOG).option("header", True).csv(self.call_log())
            metrics.write_totals(calls, f"{self.store.root}/_calls/totals")

    def write_card(self) -> None:
        """Write the card beside the subsets; a failure there is logged only."""
        storage = self.config.storage
        try:
            text = card.render_card(self.config, self.store.read_text("README.md"))
            self.store.write_text("README.md", text)
            if self.hub is not None and storage.push_to_hub and storage.upload_card:
                self.hub.push_card(text, storage.identifier())
        except Exception:  # noqa: BLE001 - a run isn't lost for its card
            log.warning("the card could not be written", exc_info=True)

    def save(self, df: DataFrame, subset: str) -> None:
        if subset in schemas.SUBSETS:
            df = conform(df, schemas.SUBSETS[subset])
        storage = self.config.storage
        self.store.save(df, subset, append=storage.concat_if_exist)
        if self.hub is not None and storage.push_to_hub:
            self.hub.push(self.store.load(subset), storage.identifier(), subset, storage.private)

    def load(self, subset: str, optional: bool = False) -> DataFrame:
        """A subset of the store; one that isn't there is fetched from the hub, if there is one and it has it."""
        if self.hub is not None and subset not in self.store.subsets():
            found = self.hub.pull(self.config.storage.identifier(), subset)
            if found is not None:
                self.store.save(found, subset)
        return self.store.load(subset, optional)

    def answers(self, stage: str, calls: DataFrame) -> DataFrame:
        """Calls with their answers, written once, as asking again may answer otherwise, and logged."""
        models = inference.chosen_models(self.config.models, self.config.roles.get(stage))
        found = cut_lineage(inference.answers(calls, models, self.provider, tasks=self.spark.sparkContext.defaultParallelism))
        metrics.write_call_log(inference.counted(found, models, stage), self.call_log())
        self.logged = True
        for r in inference.call_success(found).collect():  # a row per model
            log.info("%s: %s answered %d of %d calls, %.2f s each", stage, r["model_name"], r["answered"], r["calls"], r["avg_seconds"])
        return found

    def ingest(self, s) -> None:
        found = files.files(self.spark, s.source_documents_dir, tuple(s.supported_file_extensions), s.output_dir)
        read = files.texts(found)
        for extension, render in files.renderers().items() if s.llm_ingestion else ():
            images = files.pages(found.where(F.col("extension") == extension), lambda data, render=render: render(data, s.pdf_dpi))
            told = self.answers("ingestion", files.page_calls(images, load_prompt(s.pdf_llm_prompt, "page")))
            joined = files.joined_pages(told.select("path", "model_order", "page", F.col("response").alias("text")))
            read = read.where(~F.endswith(F.lower("path"), F.lit(extension))).unionByName(joined.join(found.select("path", "length"), "path").select("path", "length", "text"))
        if s.output_dir and self.config.storage.local_saving:
            files.write_markdown(read, s.source_documents_dir, s.output_dir)
        self.save(files.ingested(read), "ingested")

    def summarize(self, s) -> None:
        documents = self.load("ingested")
        first = self.answers("summarization", summarize.part_calls(documents, load_prompt(s.summarization_user_prompt, "summary"), s.max_tokens, s.token_overlap, s.encoding_name))
        used = first.where("model_order = 0")
        parts = cut_lineage(summarize.by_document(used.select("document_id", "part", "response")))
        second = self.answers("summarization", summarize.combine_calls(parts, load_prompt(s.combine_summaries_user_prompt, "combine"))).where("model_order = 0")
        merged = summarize.merged(parts, second.select("document_id", "response"))
        model = inference.chosen_models(self.config.models, self.config.roles.get("summarization"))
        named = documents.join(merged, "document_id", "left").withColumn("summarization_model", F.lit(model[0].name if model else "unknown"))
        self.save(named, "summarized")

    def chunk(self, s) -> None:
        cut = chunking.chunk_documents(self.load("summarized"), s.l_max_tokens, s.token_overlap, s.h_min, s.h_max, s.num_multihops_factor, s.encoding_name)
        self.save(cut, "chunked")

    def ask(self, subset: str, key: str, s, chunked: DataFrame | None = None) -> None:
        chunked = chunked if chunked is not None else self.load("chunked")
        system = load_prompt(s.system(), "choice_system" if s.question_mode == "multi-choice" else "question_system")
        if s.question_schema and "{schema_definition}" not in system:
            system += "\n\n{schema_definition}"
        system = schema_prompt.system_prompt(system, schema_prompt.load_schema(s.question_schema, s.question_mode))
        for r in prompts.skipped_chunks(chunked).limit(WARNINGS).collect():
            log.warning("chunk %s of document %s has no content and is left out", r["chunk_id"], r["document_id"])
        if key == "chunk_id":
            calls = prompts.single_shot_calls(chunked, load_prompt(s.user_prompt, "single_shot"), system, s.additional_instructions, s.sampling())
        else:
            calls = prompts.multi_hop_calls(chunked, load_prompt(s.user_prompt, "multi_hop"), system, s.additional_instructions, s.sampling())
        stage = next(n for n, v in self.config.stages.items() if v is s)
        answered = self.answers(stage, calls).select("document_id", key, "model_order", F.col("model_name").alias("generating_model"), "response")
        found = parsing.questions(answered, key, s.question_mode, s.additional_instructions)
        order = ["model_order", "document_id", key, "pair_position"]
        self.save(dedup.distinct_questions(found, order), subset)

    def ask_across(self, s) -> None:
        least, most = s.num_docs_per_combination
        rows = crossdoc.cross_documents(self.load("chunked"), least, most, s.max_combinations, s.chunks_per_document, s.random_seed)
        self.ask("cross_document_questions", "source_chunk_ids", s, rows.withColumn("document_filename", F.lit(None).cast("string")))

    def rewrite(self, s) -> None:
        documents = self.load("chunked")
        known = assemble.with_summaries(assemble.documents_once(documents), documents)
        for subset, key in (("single_shot_questions", "chunk_id"), ("multi_hop_questions", "source_chunk_ids")):
            if subset not in self.store.subsets():
                continue
            asked = self.load(subset)
            content = F.to_json(F.struct(*asked.columns), {"ignoreNullFields": "false"})
            asked = asked.withColumn("question_id", F.sha2(content, 256)).dropDuplicates(["question_id"])  # rows alike in all are one
            joined = asked.join(known.select("document_id", "document_summary", F.col("chunks").alias("_chunks")), "document_id", "left")
            ids = F.array("chunk_id") if key == "chunk_id" else F.col(key)
            passages = joined.withColumn("chunks", assemble.chunk_texts(ids, F.col("_chunks"), keep_missing=False))
            calls = prompts.rewriting_calls(passages, load_prompt(s.user_prompt, "rewrite"), DEFAULTS["rewrite_system"] if not s.system_prompt else load_prompt(s.system_prompt, ""), s.additional_instructions)
            answered = self.answers("question_rewriting", calls.select("question_id", "prompt", "messages"))
            responses = answered.select("question_id", F.col("model_name").alias("rewriting_model"), "response")
            self.save(rewriting.rewritten(asked, responses), f"{subset}_rewritten")

    def prepare(self, s) -> None:
        chunked = self.load(s.chunked_subset)
        documents = assemble.with_summaries(assemble.documents_once(chunked), self.load(s.summarized_subset, optional=True))
        tables = {k: self.load(n) if n in self.store.subsets() else None for k, n in (("single", s.single_shot_subset), ("multi", s.multi_hop_subset), ("cross", s.cross_doc_subset))}
        cross = tables["cross"]
        out = assemble.evaluation_table(documents, tables["single"], tables["multi"], None)
        if cross is not None:
            out = out.unionByName(assemble.across_documents(cross, chunked))
        self.save(out, s.output_subset)

    def score(self, s) -> None:
        self.store.save(scoring.scored(self.load(s.subset), s.alpha, s.beta), s.subset)
