"""Prompt templates: packaged defaults, and where a configured prompt comes from."""

from __future__ import annotations

import os

SUMMARY = "Summarise the document below for a reader who will write exam questions about it.\n\n<document>\n{document}\n</document>\n\nPut the summary in <final_summary> tags."
COMBINE = "These are summaries of consecutive parts of one document:\n\n{chunk_summaries}\n\nWrite one summary of the whole in <final_summary> tags."
QUESTION_SYSTEM = (
    "You write questions that test whether somebody has understood a text. Study it inside <document_analysis> tags first.\n\n"
    "{schema_definition}\n\nFor example:\n\n{example_output}\n\nMind that:\n\n{critical_reminders}"
)
CHOICE_SYSTEM = QUESTION_SYSTEM + "\n* Exactly one of the four choices is right, and the answer is its letter."
SINGLE_SHOT = (
    "<title>{title}</title>\n<document_summary>{document_summary}</document_summary>\n<text_chunk>{text_chunk}</text_chunk>\n"
    "<additional_instructions>{additional_instructions}</additional_instructions>"
)
MULTI_HOP = (
    "<title>{title}</title>\n<document_summary>{document_summary}</document_summary>\n<text_chunks>\n{chunks}</text_chunks>\n"
    "<additional_instructions>{additional_instructions}</additional_instructions>"
)
REWRITE_SYSTEM = "You reword questions without changing what they ask. Put the new wording in <rewritten_question> tags and why it is better in <question_rewriting_rationale> tags."
REWRITE = (
    "<original_question>{original_question}</original_question>\n<answer>{answer}</answer>\n<chunk_text>{chunk_text}</chunk_text>\n"
    "<document_summary>{document_summary}</document_summary>\n<additional_instructions>{additional_instructions}</additional_instructions>"
)

PAGE = "Transcribe this page as Markdown: headings, lists and tables as such, every word as it stands, nothing added."

DEFAULTS = {
    "page": PAGE,
    "summary": SUMMARY,
    "combine": COMBINE,
    "question_system": QUESTION_SYSTEM,
    "choice_system": CHOICE_SYSTEM,
    "single_shot": SINGLE_SHOT,
    "multi_hop": MULTI_HOP,
    "rewrite_system": REWRITE_SYSTEM,
    "rewrite": REWRITE,
}

#: A prompt longer than this, or of several lines, is taken as it stands.
INLINE_LENGTH = 300


def load_prompt(value: str | None, default: str) -> str:
    """A configured prompt: the default where empty, the text itself, a file's, a packaged one's, or else the text."""
    if not value:
        return DEFAULTS.get(default, default)
    if "\n" in value or len(value) > INLINE_LENGTH:
        return value
    if value.endswith((".md", ".txt", ".prompt")) and os.path.exists(value):
        with open(value, encoding="utf-8") as f:
            return f.read()
    return DEFAULTS.get(value, value)
