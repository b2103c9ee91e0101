"""A card that says how a dataset was made."""

from __future__ import annotations

import json
import os
import re

from docmill.plans.config import Config, as_mapping

#: What looks like a secret (fixed patterns).
SECRETS = (re.compile(r"\bsk-[A-Za-z0-9_-]{8,}"), re.compile(r"\bhf_[A-Za-z0-9]{8,}"))
PRIVATE = {"api_key", "key_variable", "organization", "hf_organization", "token", "hf_token", "base_url"}

PURPOSES = {
    "ingestion": "documents read from files",
    "summarization": "documents with summaries",
    "chunking": "documents with chunks and groups of chunks",
    "single_shot_question_generation": "questions on single chunks",
    "multi_hop_question_generation": "questions on groups of chunks",
    "cross_document_question_generation": "questions across documents",
    "question_rewriting": "reworded questions",
    "prepare_lighteval": "questions with their passages",
    "citation_score_filtering": "citation scores",
}


def sanitized(value, key: str = ""):
    """A setting without secrets: private keys and secret-looking texts masked, paths made relative."""
    if isinstance(value, dict):
        return {k: sanitized(v, k) for k, v in value.items()}
    if isinstance(value, list):
        return [sanitized(v, key) for v in value]
    if key in PRIVATE and value:
        return "$" + key.upper()
    if isinstance(value, str):
        for pattern in SECRETS:
            value = pattern.sub("***", value)
        if key.endswith("prompt") and len(value) > 120:
            return f"custom_{key}.md"
        return os.path.relpath(value) if os.path.isabs(value) and key.endswith("dir") else value
    return value


def front_matter(card: str) -> str:
    """The YAML head of an existing card, "" without one."""
    found = re.match(r"---\n(.*?)\n---\n", card, re.S)
    return found[1] if found else ""


def dataset_info(head: str) -> str:
    """The dataset_info section of a YAML head, "" without one."""
    found = re.search(r"(?m)^dataset_info:\n(?:[ \t-].*\n?)*", head)
    return found[0].rstrip() if found else ""


def render_card(config: Config, former: str = "") -> str:
    """Markdown with the enabled stages and the settings; the dataset section of a former card is carried over."""
    head = dataset_info(front_matter(former))
    stages = "\n".join(f"- **{s}**: {PURPOSES[s]}" for s in config.enabled()) or "- none"
    settings = json.dumps(sanitized(as_mapping(config)), indent=2, ensure_ascii=False, default=str)
    start = f"---\n{head}\n---\n\n" if head else ""
    return f"{start}# {config.storage.dataset_name or 'dataset'}\n\nStages:\n\n{stages}\n\nSettings:\n\n```json\n{settings}\n```\n"
