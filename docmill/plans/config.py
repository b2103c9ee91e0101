"""Configuration: a YAML file into checked dataclasses."""

from __future__ import annotations

import logging
import os
import re
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any

from docmill.operators.inference import Model
from docmill.operators.sampling import Sampling

#: Names of former versions (fixed values).
FORMER_NAMES = {"models": "model_list", "pipeline_config": "pipeline"}

#: Names in a file for settings that are called otherwise here (fixed values).
STORAGE_NAMES = {"dataset_name": "hf_dataset_name", "organization": "hf_organization"}
MODEL_NAMES = {
    "model_name": "name",
    "max_concurrent_requests": "concurrency",
    "encoding_name": "encoding",
    "extra_parameters": "extra",
    "api_key_variable": "key_variable",
}
PROMPT_NAMES = ("system_prompt", "system_prompt_multi", "user_prompt")
PROMPT_PREFIXES = ("single_shot_", "multi_hop_", "cross_document_", "question_rewriting_")

#: Variables from which a model is taken when the file has none (fixed values).
OPENAI_KEY, OPENAI_MODEL, OPENAI_URL = "OPENAI_API_KEY", "OPENAI_MODEL", "OPENAI_BASE_URL"

MODES = ("open-ended", "multi-choice")

log = logging.getLogger("docmill")


class ConfigError(ValueError):
    """A configuration that can't be used."""


def _need(condition: bool, message: str) -> None:
    if not condition:
        raise ConfigError(message)


@dataclass
class Ingestion:
    source_documents_dir: str = "data/raw"
    output_dir: str = "data/processed"
    upload_to_hub: bool = True
    llm_ingestion: bool = False
    pdf_dpi: int = 300
    pdf_llm_prompt: str = ""
    supported_file_extensions: tuple[str, ...] = (".md", ".txt", ".pdf")
    run: bool = False


@dataclass
class Summarization:
    max_tokens: int = 32768
    token_overlap: int = 512
    encoding_name: str = "cl100k_base"
    summarization_user_prompt: str = ""
    combine_summaries_user_prompt: str = ""
    run: bool = False

    def __post_init__(self) -> None:
        _need(self.max_tokens > 0 and 0 <= self.token_overlap < self.max_tokens, "summarization: needs max_tokens > token_overlap >= 0")


@dataclass
class Chunking:
    l_max_tokens: int = 8192
    token_overlap: int | None = None
    encoding_name: str = "cl100k_base"
    h_min: int = 2
    h_max: int = 5
    num_multihops_factor: int = 1
    run: bool = False

    def __post_init__(self) -> None:
        if self.token_overlap is None:  # as usual, or an eighth of chunks too short for that
            self.token_overlap = min(512, max(0, self.l_max_tokens) // 8)
        _need(self.l_max_tokens > 0 and 0 <= self.token_overlap < self.l_max_tokens, "chunking: needs l_max_tokens > token_overlap >= 0")
        _need(1 <= self.h_min <= self.h_max, "chunking: needs 1 <= h_min <= h_max")
        _need(self.num_multihops_factor >= 1, "chunking: num_multihops_factor must be at least 1")


@dataclass
class Questions:
    question_mode: str = "open-ended"
    additional_instructions: str = ""
    system_prompt: str = ""
    system_prompt_multi: str = ""
    user_prompt: str = ""
    chunk_sampling: dict = field(default_factory=dict)
    question_schema: str | None = None
    run: bool = False

    def __post_init__(self) -> None:
        self.question_mode = (self.question_mode or MODES[0]).strip().lower()
        _need(self.question_mode in MODES, f"question_mode must be one of {MODES}")
        self.sampling()

    def system(self) -> str:
        """The configured system prompt of the mode."""
        return self.system_prompt_multi if self.question_mode == "multi-choice" else self.system_prompt

    def sampling(self) -> Sampling:
        """How chunks are sampled: ``enable`` with ``num_samples``, or ``mode`` and ``value``."""
        s = self.chunk_sampling or {}
        seed = int(s.get("random_seed", 42))
        if "mode" in s:
            return Sampling(s["mode"], float(s.get("value", 1)), seed)
        number = int(s.get("num_samples", 100))
        _need(number >= 1, f"num_samples must be at least 1, not {number}")
        return Sampling("count", number, seed) if s.get("enable") else Sampling(seed=seed)


@dataclass
class CrossDocument(Questions):
    max_combinations: int = 100
    chunks_per_document: int = 1
    num_docs_per_combination: tuple[int, int] = (2, 5)
    random_seed: int = 42

    def __post_init__(self) -> None:
        super().__post_init__()
        pair = tuple(self.num_docs_per_combination)
        _need(len(pair) == 2 and 2 <= pair[0] <= pair[1], "num_docs_per_combination must be two numbers, 2 <= least <= most")
        _need(self.max_combinations >= 1 and self.chunks_per_document >= 1, "max_combinations and chunks_per_document must be at least 1")
        self.num_docs_per_combination = pair


@dataclass
class Rewriting:
    additional_instructions: str = ""
    system_prompt: str = ""
    user_prompt: str = ""
    run: bool = False


@dataclass
class Assembly:
    single_shot_subset: str = "single_shot_questions"
    multi_hop_subset: str = "multi_hop_questions"
    cross_doc_subset: str = "cross_document_questions"
    chunked_subset: str = "chunked"
    summarized_subset: str = "summarized"
    output_subset: str = "prepared_lighteval"
    run: bool = False


@dataclass
class CitationScores:
    subset: str = "prepared_lighteval"
    alpha: float = 0.7
    beta: float = 0.3
    run: bool = False

    def __post_init__(self) -> None:
        _need(0 <= self.alpha <= 1 and 0 <= self.beta <= 1, "alpha and beta must lie between 0 and 1")


#: Stages in the order in which they run; a stage that the file names is enabled unless it says run: false.
STAGES: dict[str, type] = {
    "ingestion": Ingestion,
    "summarization": Summarization,
    "chunking": Chunking,
    "single_shot_question_generation": Questions,
    "multi_hop_question_generation": Questions,
    "cross_document_question_generation": CrossDocument,
    "question_rewriting": Rewriting,
    "prepare_lighteval": Assembly,
    "citation_score_filtering": CitationScores,
}


@dataclass
class Storage:
    hf_dataset_name: str = ""
    hf_organization: str = ""
    hf_token: str = field(default="", repr=False)
    private: bool = False
    concat_if_exist: bool = False
    local_dataset_dir: str = "data/saved_dataset"
    local_saving: bool = True
    upload_card: bool = True
    export_jsonl: bool = False
    jsonl_export_dir: str = "data/jsonl_export"
    push_to_hub: bool = True

    @property
    def dataset_name(self) -> str:
        return self.hf_dataset_name

    @property
    def organization(self) -> str:
        return self.hf_organization

    def identifier(self) -> str:
        """``organization/name``, or the name where there is no organisation or it is in the name."""
        _need(bool(self.dataset_name), "a dataset needs a name")
        name = self.dataset_name
        return name if "/" in name or not self.organization else f"{self.organization}/{name}"


@dataclass
class Config:
    storage: Storage = field(default_factory=Storage)
    models: list[Model] = field(default_factory=list)
    roles: dict[str, list[str]] = field(default_factory=dict)
    stages: dict[str, Any] = field(default_factory=dict)
    debug: bool = False

    def enabled(self) -> list[str]:
        """Enabled stages in the order in which they run."""
        return [s for s in STAGES if s in self.stages and self.stages[s].run]


def expand(value: Any) -> Any:
    """Values with texts of the form ``$NAME`` replaced from the environment ("" if unset)."""
    if isinstance(value, str):
        return os.environ.get(value[1:], "") if re.fullmatch(r"\$[A-Za-z_]\w*", value) else value
    if isinstance(value, dict):
        return {k: expand(v) for k, v in value.items()}
    return [expand(v) for v in value] if isinstance(value, list) else value


def _build(kind: type, values: dict, where: str, names: dict[str, str] | None = None) -> Any:
    """A checked object; a key that isn't known is left out with a warning, as is one of the wrong stage."""
    known = {f.name for f in fields(kind)}
    given = {(names or {}).get(k, k): v for k, v in values.items()}
    if unknown := sorted(set(given) - known):
        log.warning("%s: unknown keys %s are ignored", where, ", ".join(unknown))
    try:
        return kind(**{k: v for k, v in given.items() if k in known})
    except TypeError as e:
        raise ConfigError(f"{where}: {e}") from e


def parse(data: dict) -> Config:
    """A configuration from the mapping that a file holds; keys of models stay names of variables."""
    data = {FORMER_NAMES.get(k, k): v for k, v in (data or {}).items()}
    models = [_model(m) for m in data.get("model_list") or []]
    if not models and os.environ.get(OPENAI_KEY):
        models = [Model(os.environ.get(OPENAI_MODEL, "gpt-4"), os.environ.get(OPENAI_URL), OPENAI_KEY, 8)]
    data = expand({k: v for k, v in data.items() if k != "model_list"})
    prompts = {prefix + name: name for prefix in PROMPT_PREFIXES for name in PROMPT_NAMES}
    stages = {}
    for name, values in (data.get("pipeline") or {}).items():
        if name not in STAGES:
            raise ConfigError(f"no such stage: {name}")
        stages[name] = _build(STAGES[name], {"run": True, **(values or {})}, name, prompts)
    roles = {k: [v] if isinstance(v, str) else list(v) for k, v in (data.get("model_roles") or {}).items()}
    if models:
        roles = {s: roles.get(s) or [models[0].name] for s in STAGES} | roles
    storage = _build(Storage, data.get("hf_configuration") or {}, "hf_configuration", STORAGE_NAMES)
    return Config(storage, models, roles, stages, bool(data.get("debug")))


def _model(m: dict) -> Model:
    _need(bool(m.get("model_name")), "a model needs a model_name")
    key = m.get("api_key")
    named = isinstance(key, str) and re.fullmatch(r"\$[A-Za-z_]\w*", key)
    own = expand({k: v for k, v in m.items() if k != "api_key"}) | ({"key_variable": key[1:]} if named else {"api_key": key})
    return _build(Model, {"encoding_name": "cl100k_base"} | own, f"model {m.get('model_name')}", MODEL_NAMES)


def load(path: str) -> Config:
    """A configuration file."""
    import yaml

    if not os.path.exists(path):
        raise FileNotFoundError(f"no configuration at {path}")
    with open(path, encoding="utf-8") as f:
        return parse(yaml.safe_load(f) or {})


def as_mapping(value: Any) -> Any:
    """Dataclasses as plain mappings, defaults and disabled stages left out."""
    if is_dataclass(value):
        default = type(value)() if not isinstance(value, Model) else Model("")
        return {f.name: as_mapping(v) for f in fields(value) if f.repr and (v := getattr(value, f.name)) != getattr(default, f.name)}
    if isinstance(value, dict):
        return {k: as_mapping(v) for k, v in value.items() if not (hasattr(v, "run") and not v.run)}
    return [as_mapping(v) for v in value] if isinstance(value, (list, tuple)) else value
