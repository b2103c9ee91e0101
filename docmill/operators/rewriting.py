"""Rewritten questions: what a rewriting response changes in its question's record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.functions.text import tag_content


def rewritten(questions: DataFrame, responses: DataFrame, key: str = "question_id") -> DataFrame:
    """Questions with their rewriting; one without a usable response is left out.

    ``responses`` has the key, rewriting_model and response. The mode and the choices of a record
    stay, and so does every other field.
    """
    usable = responses.where(F.coalesce("response", F.lit("")) != "").select(
        key,
        F.col("rewriting_model").alias("question_rewriting_model"),
        F.col("response").alias("raw_question_rewriting_response"),
        tag_content("response", "rewritten_question").alias("_new"),
        tag_content("response", "question_rewriting_rationale").alias("question_rewriting_rationale"),
    )
    fields = ("original_question", "question_rewriting_model", "question_rewriting_rationale", "raw_question_rewriting_response")
    base = questions.drop(*fields)
    joined = base.join(usable.where(F.col("_new") != ""), key)
    return joined.withColumn("original_question", F.col("question")).withColumn("question", F.col("_new")).drop("_new")
