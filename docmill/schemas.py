"""Fixed schemas of the subsets; a missing value is null, never a missing column."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


_TEXTS = T.ArrayType(T.StringType())
METADATA = T.StructType([T.StructField("file_size", T.LongType())])
CHUNKS = T.ArrayType(T.StructType(_fields("chunk_id", "chunk_text")))
GROUPS = T.ArrayType(T.StructType([T.StructField("chunk_ids", _TEXTS), T.StructField("chunks_text", _TEXTS)]))

INGESTED = T.StructType([*_fields("document_id", "document_text", "document_filename"), T.StructField("document_metadata", METADATA)])
SUMMARIZED = T.StructType([*INGESTED.fields, *_fields("document_summary", "summarization_model")])
CHUNKED = T.StructType([*SUMMARIZED.fields, T.StructField("chunks", CHUNKS), T.StructField("multihop_chunks", GROUPS)])

_QUESTION = [
    *_fields("document_id", "additional_instructions", "question", "self_answer"),
    T.StructField("estimated_difficulty", T.IntegerType()),
    *_fields("self_assessed_question_type", "question_mode", "generating_model", "thought_process", "raw_response"),
    T.StructField("citations", _TEXTS),
    T.StructField("choices", _TEXTS),
]
_REWRITING = _fields("original_question", "question_rewriting_model", "question_rewriting_rationale", "raw_question_rewriting_response")
#: Fields of a custom output schema that have no column of their own, as texts.
CUSTOM = T.StructField("custom_fields", T.MapType(T.StringType(), T.StringType()))
SINGLE_HOP = T.StructType([*_QUESTION, *_fields("chunk_id"), *_REWRITING, CUSTOM])
MULTI_HOP = T.StructType([*_QUESTION, T.StructField("source_chunk_ids", _TEXTS), *_REWRITING, CUSTOM])

PREPARED = T.StructType(
    [
        *_fields("question", "additional_instructions", "ground_truth_answer"),
        T.StructField("gold_index", T.ArrayType(T.IntegerType())),
        T.StructField("gold_text", _TEXTS),
        T.StructField("choices", _TEXTS),
        *_fields("question_category", "kind"),
        T.StructField("estimated_difficulty", T.IntegerType()),
        T.StructField("citations", _TEXTS),
        *_fields("document_id"),
        T.StructField("chunk_ids", _TEXTS),
        *_fields("question_generating_model"),
        T.StructField("chunks", _TEXTS),
        *_fields("document", "document_summary"),
        CUSTOM,
    ]
)

SUBSETS = {
    "ingested": INGESTED,
    "summarized": SUMMARIZED,
    "chunked": CHUNKED,
    "single_shot_questions": SINGLE_HOP,
    "multi_hop_questions": MULTI_HOP,
    "cross_document_questions": MULTI_HOP,
    "single_shot_questions_rewritten": SINGLE_HOP,
    "multi_hop_questions_rewritten": MULTI_HOP,
    "prepared_lighteval": PREPARED,
}
