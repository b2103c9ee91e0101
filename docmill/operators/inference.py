"""Calls to models: which model is asked what, and one row per answer.

Keys ride along with every call, so no answer is ever matched by position. A provider answers one
Arrow batch of calls at a time; the result must be written before it is used twice, as asking
again may answer otherwise.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.tokens import message_tokens, token_count

TIMEOUT_SECONDS = 300.0
ATTEMPTS = 12


@dataclass(frozen=True)
class Model:
    """A model's address; its key is read from the environment where the call is made (or given outright), never kept in a table."""

    name: str
    base_url: str | None = None
    key_variable: str | None = None
    concurrency: int = 32
    encoding: str = "word"
    extra: dict = field(default_factory=dict)
    provider: str | None = None
    bill_to: str | None = None
    api_key: str | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        if self.concurrency < 1:
            raise ValueError("a model needs a concurrency of at least 1")


class Provider(Protocol):
    """Answers one call or raises.

    A provider that also has ``chat(model, messages, image)`` is given the whole chat, and the image
    of a call that has one, instead of the prompt.
    """

    def __call__(self, model: Model, prompt: str) -> str: ...


def chosen_models(models: list[Model], roles: list[str] | None) -> list[Model]:
    """The models of a stage: those its roles name, in the models' order; the first one without roles."""
    if not roles:
        return models[:1]
    return [m for m in models if m.name in set(roles)]


def call_matrix(calls: DataFrame, models: list[Model]) -> DataFrame:
    """Every call with every model: the configured models, a handful, as an array that is exploded beside each call."""
    named = F.array(*[F.struct(F.lit(i).alias("model_order"), F.lit(m.name).alias("model_name")) for i, m in enumerate(models)])
    if not models:
        named = F.array().cast("array<struct<model_order:int,model_name:string>>")
    return calls.select("*", F.inline(named))


def error_category(message: Column | str, kind: Column | str) -> Column:
    """timeout, rate_limit, auth_error, connection_error or other_error, by an error's message or type."""
    text = F.lower(F.coalesce(message if isinstance(message, Column) else F.col(message), F.lit("")))
    name = F.coalesce(kind if isinstance(kind, Column) else F.col(kind), F.lit(""))
    rules = [("timeout", "TimeoutError", "timeout"), ("rate_limit", "RateLimitError", "rate_limit"), ("authentication", "AuthenticationError", "auth_error"), ("connection", "ConnectionError", "connection_error")]
    out = F.lit("other_error")
    for word, error, category in reversed(rules):
        out = F.when(text.contains(word) | name.contains(error), category).otherwise(out)
    return out


RESULT = T.StructType(
    [
        T.StructField("response", T.StringType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("attempts", T.IntegerType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("error_type", T.StringType()),
        T.StructField("error_message", T.StringType()),
    ]
)


def ask(provider: Provider, model: Model, call: dict | str, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> tuple:
    """One call (its prompt, and where there are any its messages and image) with exponential pauses between attempts; the last error stays with the row."""
    call = {"prompt": call} if isinstance(call, str) else call
    began, kind, message = time.monotonic(), None, None
    chat = getattr(provider, "chat", None)
    for attempt in range(attempts):
        try:
            if chat is not None:
                turns = [m.asDict() if hasattr(m, "asDict") else dict(m) for m in call.get("messages", ())] or [{"role": "user", "content": call["prompt"]}]
                answer = chat(model, turns, call.get("image"))
            else:
                answer = provider(model, call["prompt"])
            return answer, True, attempt + 1, time.monotonic() - began, None, None
        except Exception as e:  # noqa: BLE001 - whatever a provider raises is recorded
            kind, message = type(e).__name__, str(e)
            if attempt + 1 < attempts:
                sleep(2.0 ** (attempt + 2))
    return "", False, attempts, time.monotonic() - began, kind, message


def shares(concurrency: int, tasks: int) -> tuple[int, int]:
    """Tasks that call a model, and threads of each, so that no more than ``concurrency`` calls are under way anywhere."""
    used = max(1, min(concurrency, tasks))
    return used, max(1, concurrency // used)


def answers(calls: DataFrame, models: list[Model], provider: Provider, attempts: int = ATTEMPTS, tasks: int = 1) -> DataFrame:
    """``calls`` (with a prompt, and maybe messages and an image) times ``models``, each with its answer and how it went.

    ``tasks`` is the number of tasks that run at once. The calls of a model are dealt out over no
    more tasks than it may have calls under way, so its concurrency holds for the whole cluster.
    """
    parts = []
    for order, model in enumerate(models):
        matrix = calls.select("*", F.lit(order).alias("model_order"), F.lit(model.name).alias("model_name"))
        used, threads = shares(model.concurrency, tasks)

        def run(frames: Iterator[pd.DataFrame], model: Model = model, threads: int = threads) -> Iterator[pd.DataFrame]:
            with ThreadPoolExecutor(threads) as pool:
                for frame in frames:
                    sent = [{k: row[k] for k in ("prompt", "messages", "image") if k in row and row[k] is not None} for row in frame.to_dict("records")]
                    outcome = list(pool.map(lambda call: ask(provider, model, call, attempts), sent))
                    yield pd.concat([frame, pd.DataFrame(outcome, columns=RESULT.names, index=frame.index)], axis=1)

        schema = T.StructType([*matrix.schema.fields, *RESULT.fields])
        parts.append(matrix.repartition(used).mapInPandas(run, schema))
    if not parts:
        return call_matrix(calls, []).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in RESULT])
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def counted(results: DataFrame, models: list[Model], stage: str) -> DataFrame:
    """A row per call for the log: logged_at, model_name, stage, input_tokens, output_tokens, encoding_used.

    Tokens are counted by each model's own encoding, those of a failed call's answer being 0.
    """
    turn = F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))
    chat = F.col("messages") if "messages" in results.columns else F.array(turn)
    spent, made, used = F.lit(0), F.lit(0), F.lit(None).cast("string")
    for model in models:
        own = F.col("model_name") == model.name
        spent = F.when(own, message_tokens(chat, model.encoding)).otherwise(spent)
        made = F.when(own, token_count("response", model.encoding)).otherwise(made)
        used = F.when(own, model.encoding).otherwise(used)
    return results.select(
        F.current_timestamp().alias("logged_at"), "model_name", F.lit(stage).alias("stage"), spent.cast("long").alias("input_tokens"), made.cast("long").alias("output_tokens"), used.alias("encoding_used")
    )


def stub_response(subject: Column, model_name: Column) -> Column:
    """A deterministic response built from a text by column functions: one question on its first words.

    It stands in for a provider in tests and in queries that SQL checks.
    """
    words = F.filter(F.split(subject, r"[ \t\r\n]+"), lambda w: w != "")
    head = F.array_join(F.slice(words, 1, 8), " ")
    quote = F.array_join(F.slice(words, 1, 12), " ")
    item = F.struct(
        F.concat(F.lit("What follows after "), head, F.lit("?")).alias("question"),
        quote.alias("answer"),
        F.lit("factual").alias("question_type"),
        F.lit("medium").alias("difficulty"),
        F.concat(F.lit("asked by "), model_name).alias("reasoning"),
        F.array(quote).alias("citations"),
    )
    return F.concat(F.lit("<output_json>\n"), F.to_json(F.array(item)), F.lit("\n</output_json>"))


def call_success(results: DataFrame) -> DataFrame:
    """Per model: calls, answers with content, share of successes, mean seconds and attempts."""
    return results.groupBy("model_name").agg(
        F.count("*").alias("calls"),
        F.count_if(F.coalesce("response", F.lit("")) != "").alias("answered"),
        F.avg(F.col("success").cast("double")).alias("success_rate"),
        F.avg("seconds").alias("avg_seconds"),
        F.avg("attempts").alias("avg_attempts"),
    )
