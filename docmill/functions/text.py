"""Text functions as native columns: trimming, keys, tags, templates."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip sees it, for Java's regular expressions.
BLANK = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column | str) -> Column:
    """Without white space of any kind at both ends; null stays null."""
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def has_content(text: Column | str) -> Column:
    """Whether there is anything but white space; null has none."""
    return F.coalesce(strip(text) != "", F.lit(False))


def question_key(question: Column | str) -> Column:
    """Key under which questions are the same: case, ASCII punctuation, digits and spacing don't count."""
    bare = F.regexp_replace(F.lower(question), r"[!-/:-@\[-`{-~]", "")
    bare = F.regexp_replace(bare, r"\p{Nd}+", "")
    return strip(F.regexp_replace(bare, f"{BLANK}+", " "))


def tag_content(text: Column | str, tag: str) -> Column:
    """Content of the first closed tag, else all that follows an opening one; stripped; "" without tag."""
    either = rf"(?s)<{tag}>(?:(.*?)</{tag}>|(.*))"
    column = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return strip(F.concat(F.regexp_extract(column, either, 1), F.regexp_extract(column, either, 2)))


def closed_tag(text: Column | str, tag: str) -> Column:
    """Content of the first closed tag, whose opening may hold white space; null without one."""
    column = F.col(text) if isinstance(text, str) else text
    return strip(F.try_element_at(F.regexp_extract_all(column, F.lit(rf"<{tag}\s*>([\s\S]*?)</{tag}>"), 1), F.lit(1)))


def without_fence(text: Column) -> Column:
    """Content of a code fence that spans the whole text; else the text."""
    pattern = r"^\s*```(?:json)?\s*([\s\S]*?)\s*```\s*$"
    return let(text, lambda t: F.when(t.startswith("```") & t.endswith("```"), strip(F.regexp_extract(t, pattern, 1))).otherwise(t))


def safe_id(document_id: Column | str, position: Column) -> Column:
    """An id of letters, digits, underscores and hyphens; ``doc_<position>`` if nothing is left."""
    kept = F.regexp_replace(document_id, r"[^\p{L}\p{N}_-]", "")
    return F.when(F.coalesce(kept, F.lit("")) == "", F.concat(F.lit("doc_"), position.cast("string"))).otherwise(kept)


def render(template: str, **values: Column) -> Column:
    """A template with its ``{name}`` placeholders filled in one pass.

    Braces in the values are plain text. ``{{`` and ``}}`` stand for braces; a placeholder without
    a value, or a lone brace, is an error here rather than in the middle of a job.
    """
    parts: list[Column] = []
    for literal, name in re.findall(r"((?:[^{}]|\{\{|\}\})+)|\{(\w+)\}", template):
        if name and name not in values:
            raise KeyError(f"the template wants {{{name}}}, which isn't given")
        parts.append(F.coalesce(values[name].cast("string"), F.lit("")) if name else F.lit(literal.replace("{{", "{").replace("}}", "}")))
    if len("".join(a or f"{{{b}}}" for a, b in re.findall(r"((?:[^{}]|\{\{|\}\})+)|\{(\w+)\}", template))) != len(template):
        raise ValueError("the template has a brace that opens or closes nothing")
    return F.concat(*parts) if parts else F.lit("")


def bullets(items: Column) -> Column:
    """A list with one ``- item`` per line."""
    return F.array_join(F.transform(items, lambda s: F.concat(F.lit("- "), s)), "\n")
