"""Questions out of model responses: exploding, normalising, validating, permuting choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions import variant as V
from docmill.functions.text import let, strip

#: Question types that are checked; of others only the record rules hold (fixed values).
MULTI_CHOICE_TYPES = ("analytical", "application-based", "clarification", "counterfactual", "conceptual", "true-false", "factual", "false-premise", "edge-case")
OPEN_ENDED_TYPES = (*MULTI_CHOICE_TYPES, "open-ended")

LETTERS = ("A", "B", "C", "D")


def pairs(responses: DataFrame, response: str = "response", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per object in each response's list: the kept columns, its position, its fields.

    Items that aren't objects are skipped; a response without a list gives no row.
    """
    items = responses.select(*keep, F.posexplode(V.response_items(response)).alias("pair_position", "item")).where(V.is_object(F.col("item")))
    keyed = items.withColumn("keys", V.keys_of(F.col("item")))
    item, keys = F.col("item"), F.col("keys")
    answer = F.coalesce(V.text_field(item, "answer"), V.text_field(item, "self_answer"))
    kind = F.coalesce(V.text_field(item, "question_type"), V.text_field(item, "self_assessed_question_type"))
    return keyed.select(
        *keep,
        "pair_position",
        strip(V.text_field(item, "question")).alias("question"),
        strip(answer).alias("self_answer"),
        V.difficulty(item, keys).alias("estimated_difficulty"),
        strip(kind).alias("self_assessed_question_type"),
        F.coalesce(V.aliased(item, keys, "thought_process"), F.lit("")).alias("thought_process"),
        V.text_list(item, "citations").alias("citations"),
        V.text_list(item, "choices").alias("choices"),
        V.custom_fields(item).alias("custom_fields"),
    )


def unlabelled(choices: Column) -> Column:
    """The choices without their three-character labels."""
    return F.transform(choices, lambda c: strip(F.substring(c, 4, 1 << 30)))


def labelled(texts: Column) -> Column:
    """Texts labelled (A), (B) and so on."""
    return F.transform(texts, lambda t, i: F.concat(F.lit("("), F.char(F.lit(65) + i), F.lit(") "), t))


def permuted_choices(questions: DataFrame) -> DataFrame:
    """Choices in the order of a hash of question and text, with the answer's letter moved along.

    The order depends on nothing but the question, so it is the same in every run. Rows without
    choices or answer stay as they are; ``permutable`` tells whether the answer named a choice, as
    an answer with choices must.
    """
    letter = F.upper(strip("self_answer"))
    index = F.when(letter.rlike("^[A-Z]$"), F.ascii(letter) - 65)
    applies = (F.size("choices") > 0) & (F.coalesce(letter, F.lit("")) != "")

    def ordered(texts: Column) -> Column:
        ranked = F.array_sort(F.transform(texts, lambda t, i: F.struct(F.sha2(F.concat_ws("|", "question", t), 256).alias("h"), t.alias("t"), i.alias("i"))))
        return let(F.transform(ranked, lambda x: x["t"]), lambda r: F.struct(r.alias("texts"), F.array_position(r, F.try_element_at(texts, index + 1)).alias("place")))

    moved = questions.withColumn("_moved", F.when(applies, let(unlabelled(F.col("choices")), ordered))).withColumn("_applies", applies)
    place = F.col("_moved.place")
    out = moved.withColumns(
        {
            "choices": F.when(place > 0, labelled(F.col("_moved.texts"))).otherwise(F.col("choices")),
            "self_answer": F.when(place > 0, F.char(F.lit(64) + place)).otherwise(F.col("self_answer")),
            "permutable": ~F.col("_applies") | F.coalesce(place > 0, F.lit(False)),
        }
    )
    return out.drop("_moved", "_applies")


def mode_valid(mode: Column) -> Column:
    """Whether a pair may stay in its mode.

    Open-ended pairs of a known type mustn't be answered by a lone choice letter; multi-choice
    pairs need four choices.
    """
    kind = F.lower(F.coalesce(strip("self_assessed_question_type"), F.lit("")))
    lone_letter = F.upper(F.coalesce(strip("self_answer"), F.lit(""))).isin(*LETTERS)
    open_ended = ~(kind.isin(*OPEN_ENDED_TYPES) & lone_letter)
    return F.when(mode == "multi-choice", F.size("choices") == 4).when(mode == "open-ended", open_ended).otherwise(True)


def record_valid(chunk_id: Column, source_chunk_ids: Column) -> Column:
    """Whether exactly one of the two keys of a record is given."""
    single = F.coalesce(chunk_id, F.lit("")) != ""
    multi = F.coalesce(F.size(source_chunk_ids), F.lit(0)) > 0
    return single != multi


def questions(responses: DataFrame, key: str, mode: str, instructions: str = "") -> DataFrame:
    """Validated question records of responses.

    ``responses`` has document_id, the key (chunk_id or source_chunk_ids), generating_model and
    response, and whatever else orders them (``call_order``). Rejected pairs are in
    :func:`rejected`.
    """
    return _judged(responses, key, mode, instructions).where("valid").drop("valid", "permutable")


def rejected(responses: DataFrame, key: str, mode: str, instructions: str = "") -> DataFrame:
    """The pairs that :func:`questions` leaves out."""
    return _judged(responses, key, mode, instructions).where("NOT valid").drop("valid")


def _judged(responses: DataFrame, key: str, mode: str, instructions: str) -> DataFrame:
    kept = tuple(c for c in responses.columns)
    found = permuted_choices(pairs(responses, "response", kept))
    single = F.col(key) if key == "chunk_id" else F.lit(None).cast("string")
    multi = F.col(key) if key == "source_chunk_ids" else F.lit(None).cast("array<string>")
    valid = mode_valid(F.lit(mode)) & record_valid(single, multi) & F.col("permutable")
    shaped = found.withColumns(
        {
            "question_mode": F.lit(mode),
            "additional_instructions": F.lit(instructions),
            "valid": F.coalesce(valid, F.lit(False)),
            "choices": F.when(F.lit(mode) == "multi-choice", F.col("choices")).otherwise(F.array().cast("array<string>")),
        }
    )
    return shaped.withColumnRenamed("response", "raw_response")


def without_empties(records: DataFrame, keep: tuple[str, ...] = ("document_id", "question", "generating_model")) -> DataFrame:
    """Records with empty texts and arrays as null, but for the columns that must stay."""
    out = {}
    for field in records.schema.fields:
        if field.name in keep:
            continue
        kind = field.dataType.typeName()
        if kind == "string":
            out[field.name] = F.nullif(F.col(field.name), F.lit(""))
        elif kind in ("array", "map"):
            out[field.name] = F.when(F.size(field.name) > 0, F.col(field.name))
    return records.withColumns(out)
