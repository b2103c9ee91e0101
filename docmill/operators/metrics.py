"""What calls cost: one row per call, totals by model, performance summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Schema of the log of calls.
LOG = "logged_at timestamp, model_name string, stage string, input_tokens long, output_tokens long, encoding_used string"
CALL_COLUMNS = ("logged_at", "model_name", "stage", "input_tokens", "output_tokens", "encoding_used")


def calls_once(log: DataFrame) -> DataFrame:
    """One row per call: of repeated ones the first logged, token counts null or below zero as 0, model names in lower case."""
    first = F.min_by(F.struct("model_name", "stage", "input_tokens", "output_tokens", "encoding_used"), F.struct("logged_at", "stage", "input_tokens"))
    once = log.groupBy("call_id").agg(F.min("logged_at").alias("logged_at"), first.alias("c")).select("call_id", "logged_at", "c.*")
    counted = {c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)) for c in ("input_tokens", "output_tokens")}
    return once.withColumns({**counted, "model_name": F.lower("model_name")})


def totals_by_model(calls: DataFrame) -> DataFrame:
    """Token and call totals by model; each call counts once."""
    return calls.groupBy("model_name").agg(
        F.sum("input_tokens").alias("total_input_tokens"), F.sum("output_tokens").alias("total_output_tokens"), F.count("*").alias("total_calls")
    )


def overall_summary(calls: DataFrame) -> DataFrame:
    """One row: calls, tokens, and their averages per call (of no calls, 0)."""
    n = F.greatest(F.count("*"), F.lit(1))
    tokens = {c: F.coalesce(F.sum(c), F.lit(0)) for c in ("input_tokens", "output_tokens")}
    return calls.agg(
        F.count("*").alias("calls"),
        *[t.alias(f"total_{c}") for c, t in tokens.items()],
        *[(t / n).alias(f"avg_{c}") for c, t in tokens.items()],
    )


def write_call_log(calls: DataFrame, path: str) -> None:
    """Append the calls to a CSV log."""
    calls.select(*CALL_COLUMNS).write.mode("append").option("header", True).csv(path)


def write_totals(calls: DataFrame, path: str) -> None:
    """Write the totals by model, in the models' order, as one CSV file."""
    totals_by_model(calls).orderBy("model_name").coalesce(1).write.mode("overwrite").option("header", True).csv(path)
