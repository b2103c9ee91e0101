"""What a model is told about the wanted output: a JSON Schema made from a Spark schema, and back.

A field that isn't nullable is required. A field's metadata may have ``comment``, ``min``, ``max``,
``min_items``, ``max_items`` and ``choices``; they become the keywords of JSON Schema.
"""

from __future__ import annotations

import importlib.util
import json
import os
from typing import Any

from pyspark.sql import types as T

#: Keywords of JSON Schema for what a field's metadata says (fixed values).
KEYWORDS = {"comment": "description", "min": "minimum", "max": "maximum", "min_items": "minItems", "max_items": "maxItems", "choices": "enum"}

#: Spark's types for those of JSON Schema (fixed values).
SPARK_TYPES = {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}


class SchemaError(ValueError):
    """A schema that can't be used."""


def default_schema(mode: str) -> T.StructType:
    """The schema of a question mode."""
    letters = T.StructField("answer", T.StringType(), False, {"comment": "Letter of the right choice.", "choices": ["A", "B", "C", "D"]})
    text = T.StructField("answer", T.StringType(), False, {"comment": "The full answer, as an expert would give it."})
    choices = T.StructField("choices", T.ArrayType(T.StringType()), False, {"comment": "Texts that begin with (A), (B), (C) and (D).", "min_items": 4, "max_items": 4})
    answers = {"open-ended": [text], "multi-choice": [letters, choices]}
    if mode not in answers:
        raise SchemaError(f"no such question mode: {mode}")
    return T.StructType(
        [
            T.StructField("thought_process", T.StringType(), False, {"comment": "Which part of the text the question rests on, and why it is worth asking."}),
            T.StructField("question_type", T.StringType(), False, {"comment": "What kind of question it is."}),
            T.StructField("question", T.StringType(), False, {"comment": "The wording, clear to somebody who hasn't the text at hand."}),
            *answers[mode],
            T.StructField("estimated_difficulty", T.IntegerType(), False, {"comment": "How hard it is.", "min": 1, "max": 10}),
            T.StructField("citations", T.ArrayType(T.StringType()), False, {"comment": "Passages of the text, word for word, that prove the answer."}),
        ]
    )


def json_schema(kind: T.DataType, metadata: dict | None = None) -> dict[str, Any]:
    """A Spark type as JSON Schema."""
    if isinstance(kind, T.StructType):
        out: dict[str, Any] = {"type": "object", "properties": {f.name: json_schema(f.dataType, f.metadata) for f in kind}}
        if required := [f.name for f in kind if not f.nullable]:
            out["required"] = required
    elif isinstance(kind, T.ArrayType):
        out = {"type": "array", "items": json_schema(kind.elementType)}
    elif isinstance(kind, T.MapType):
        out = {"type": "object", "additionalProperties": json_schema(kind.valueType)}
    elif isinstance(kind, T.VariantType):
        out = {}
    elif isinstance(kind, T.IntegralType):
        out = {"type": "integer"}
    elif isinstance(kind, T.NumericType):
        out = {"type": "number"}
    else:
        out = {"type": "boolean" if isinstance(kind, T.BooleanType) else "string"}
    return out | {word: metadata[key] for key, word in KEYWORDS.items() if key in (metadata or {})}


def spark_schema(schema: dict[str, Any]) -> T.StructType:
    """The object that a JSON Schema describes as a Spark schema; references to its definitions are followed."""
    definitions = schema.get("$defs") or schema.get("definitions") or {}

    def resolved(node: dict[str, Any]) -> dict[str, Any]:
        if "$ref" in node:
            return resolved(definitions[node["$ref"].rsplit("/", 1)[-1]] | {k: v for k, v in node.items() if k != "$ref"})
        for several in ("anyOf", "oneOf", "allOf"):
            if own := [x for x in node.get(several, ()) if x.get("type") != "null"]:
                return resolved(own[0] | {k: v for k, v in node.items() if k != several})
        return node

    def kind(node: dict[str, Any]) -> T.DataType:
        name = node.get("type")
        if name == "array":
            return T.ArrayType(kind(resolved(node.get("items") or {})))
        if name == "object" and node.get("properties"):
            return struct(node)
        if name == "object":
            return T.MapType(T.StringType(), kind(resolved(node["additionalProperties"])) if isinstance(node.get("additionalProperties"), dict) else T.StringType())
        return SPARK_TYPES.get(name, T.StringType())

    def struct(node: dict[str, Any]) -> T.StructType:
        fields = []
        for name, raw in node["properties"].items():
            own = resolved(raw)
            metadata = {key: own[word] for key, word in KEYWORDS.items() if word in own}
            fields.append(T.StructField(name, kind(own), name not in node.get("required", ()), metadata))
        return T.StructType(fields)

    top = resolved(schema)
    if top.get("type") == "array":
        top = resolved(top.get("items") or {})
    if not top.get("properties"):
        raise SchemaError("a question's schema is an object with properties")
    return struct(top)


#: Name that a Python schema file gives its schema (fixed value).
EXPORTED = "DataFormat"


def load_schema(path: str | None, mode: str) -> T.StructType:
    """The schema of a file, or the mode's default without one.

    A ``.json`` file holds JSON Schema or a Spark schema. A ``.py`` file exports ``DataFormat``: a
    Spark schema, its DDL text, or a class that gives its JSON Schema by ``model_json_schema``.
    """
    if not path:
        return default_schema(mode)
    if not os.path.exists(path):
        raise SchemaError(f"no schema file at {path}")
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        return T.StructType.fromJson(found) if "fields" in found else spark_schema(found)
    if not path.endswith(".py"):
        raise SchemaError(f"a schema file is a .py or .json file: {path}")
    spec = importlib.util.spec_from_file_location("docmill_question_schema", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    found = getattr(module, EXPORTED, None)
    if isinstance(found, T.StructType):
        return found
    if isinstance(found, str):
        return T.StructType.fromDDL(found)
    if isinstance(found, type) and hasattr(found, "model_json_schema"):
        return spark_schema(found.model_json_schema())
    raise SchemaError(f"{path} exports no {EXPORTED} that is a schema")


def instance(schema: dict[str, Any]) -> Any:
    """A smallest value that a JSON Schema allows."""
    if schema.get("enum"):
        return schema["enum"][0]
    kind = schema.get("type", "string")
    if kind == "object":
        return {name: instance(own) for name, own in schema.get("properties", {}).items()}
    if kind == "array":
        return [instance(schema.get("items", {}))] * max(1, schema.get("minItems", 1))
    if kind in ("integer", "number"):
        return schema.get("minimum", 0)
    return True if kind == "boolean" else f"<{schema.get('description', 'text')}>"


def _dumped(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2)


def system_prompt(template: str, schema: T.StructType) -> str:
    """A template with its placeholders for the definition, an example and what matters filled; other text stays as it is."""
    item = json_schema(schema)
    wanted = {"type": "array", "items": item}
    matters = ["Questions that a reader of the whole text can answer, and nobody else.", "Some easy, some hard.", "Valid JSON and nothing else between the tags."]
    if "citations" in schema.names:
        matters.append("Citations are copied from the text letter for letter.")
    if item.get("required"):
        matters.append("No item lacks any of: " + ", ".join(item["required"]) + ".")
    filled = {
        "{schema_definition}": f"Between <output_json> and </output_json> put JSON that this JSON Schema accepts:\n\n```json\n{_dumped(wanted)}\n```",
        "{example_output}": f"<output_json>\n{_dumped([instance(item)])}\n</output_json>",
        "{critical_reminders}": "\n".join(f"* {x}" for x in matters),
    }
    for placeholder, text in filled.items():
        template = template.replace(placeholder, text)
    return template
