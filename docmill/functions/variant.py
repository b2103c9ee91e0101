"""Semi-structured model output: finding the JSON list of a response and reading its fields.

Everything stays in VARIANT columns, so one odd element never spoils its list.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmill.functions.text import closed_tag, strip, without_fence

#: Other names of a field, the first that is present counting (fixed values).
ALIASES = {
    "thought_process": ("reasoning", "explanation", "rationale", "thinking"),
    "estimated_difficulty": ("difficulty", "complexity"),
}

#: Difficulty in words (fixed values).
DIFFICULTY_WORDS = {"beginner": 2, "easy": 2, "intermediate": 5, "medium": 5, "advanced": 7, "hard": 7, "expert": 9, "very hard": 9}

#: Fields with a column of their own; all others are custom fields (fixed values).
STANDARD_FIELDS = (
    "question",
    "answer",
    "self_answer",
    "thought_process",
    "reasoning",
    "explanation",
    "rationale",
    "thinking",
    "question_type",
    "self_assessed_question_type",
    "estimated_difficulty",
    "difficulty",
    "complexity",
    "citations",
    "choices",
    "question_mode",
    "document_id",
    "chunk_id",
    "source_chunk_ids",
    "generating_model",
    "raw_response",
    "additional_instructions",
    "original_question",
    "question_rewriting_model",
    "question_rewriting_rationale",
    "raw_question_rewriting_response",
)

DEFAULT_DIFFICULTY, LEAST_DIFFICULTY, MOST_DIFFICULTY = 5, 1, 10


def as_list(text: Column) -> Column:
    """ARRAY<VARIANT> of a JSON list; null of anything else."""
    return F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")


def response_items(response: Column | str) -> Column:
    """The items of a response's JSON list: in the output tag, in the first JSON fence, or in a bracketed list.

    Each place is tried only if the one before holds no list. Null without any.
    """
    column = F.col(response) if isinstance(response, str) else response
    tagged = without_fence(closed_tag(column, "output_json"))
    fence = r"```json\s*([\s\S]*?)\s*```"
    fenced = F.when(column.rlike(fence), strip(F.regexp_extract(column, fence, 1)))
    bracketed = F.transform(F.regexp_extract_all(column, F.lit(r"(\[[\s\S]*?\])"), 1), as_list)
    first_bracketed = F.try_element_at(F.filter(bracketed, lambda x: x.isNotNull()), F.lit(1))
    return F.coalesce(as_list(tagged), as_list(fenced), first_bracketed)


def is_object(item: Column) -> Column:
    """Whether a VARIANT is a JSON object."""
    return F.coalesce(F.schema_of_variant(item).startswith("OBJECT"), F.lit(False))


def keys_of(item: Column) -> Column:
    """Keys of an object; null of anything else."""
    return F.map_keys(F.try_variant_get(item, "$", "map<string,variant>"))


def text_field(item: Column, name: str) -> Column:
    """A field as text; null where missing or JSON null."""
    return F.try_variant_get(item, f"$.{name}", "string")


def aliased(item: Column, keys: Column, name: str) -> Column:
    """Text of a field or of the first of its other names that is present; the name itself comes first even when null."""
    picked = F.when(F.array_contains(keys, name), text_field(item, name))
    for other in ALIASES[name]:
        picked = picked.when(F.array_contains(keys, other), text_field(item, other))
    return picked


def difficulty(item: Column, keys: Column) -> Column:
    """Difficulty of an item: words are mapped (5 if unknown), numbers cut to whole ones, within 1 and 10; null where not given."""
    names = ("estimated_difficulty", *ALIASES["estimated_difficulty"])
    raw, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name in reversed(names):
        present = F.array_contains(keys, name)
        value = F.try_variant_get(item, f"$.{name}", "variant")
        raw = F.when(present, text_field(item, name)).otherwise(raw)
        kind = F.when(present, F.schema_of_variant(value)).otherwise(kind)
    words = F.create_map(*[F.lit(x) for pair in DIFFICULTY_WORDS.items() for x in pair])
    number = F.when(kind == "STRING", F.coalesce(F.try_element_at(words, F.lower(raw)), F.lit(DEFAULT_DIFFICULTY)))
    number = number.otherwise(F.coalesce(raw.try_cast("double").cast("int"), F.lit(DEFAULT_DIFFICULTY)))
    given = F.array_contains(keys, names[0]) | F.array_contains(keys, names[1]) | F.array_contains(keys, names[2])
    return F.when(given, whole_in_range(number))


def whole_in_range(number: Column, least: int = LEAST_DIFFICULTY, most: int = MOST_DIFFICULTY) -> Column:
    """A whole number within the range; the middle where it is null."""
    return F.least(F.lit(most), F.greatest(F.lit(least), F.coalesce(number, F.lit((least + most) // 2))))


def text_list(item: Column, name: str) -> Column:
    """A field as a list of texts; empty for anything that is no list."""
    return F.coalesce(F.try_variant_get(item, f"$.{name}", "array<string>"), F.array().cast("array<string>"))


def custom_fields(item: Column) -> Column:
    """Fields without a column of their own, as MAP<STRING, STRING>."""
    as_map = F.try_variant_get(item, "$", "map<string,string>")
    return F.map_filter(as_map, lambda k, v: ~k.isin(*STANDARD_FIELDS))
