"""Exact duplicates by key, with a defined survivor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.functions.text import question_key


def keep_first(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key in the given order; rows whose key is null are all kept.

    Each partition gives away no more than one row of a key before the shuffle (a ranking that is
    asked for its first only), so a key that holds a third of all rows costs no more than any other,
    and only the columns that are used later are moved. Ties in the order go to the smaller row. A
    row without a key is a group of its own, by a number that no other row of any task has.
    """
    plain = [F.col(c) for c in order] + [F.xxhash64(*[c for c in rows.columns if not _unhashable(rows, c)])]
    own = F.when(F.col("_key").isNull(), F.monotonically_increasing_id())
    first = Window.partitionBy("_key", "_own").orderBy(*plain)
    keyed = rows.withColumn("_key", key).withColumn("_own", own)
    return keyed.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").select(*rows.columns)


def _unhashable(rows: DataFrame, column: str) -> bool:
    kind = rows.schema[column].dataType.simpleString()
    return "variant" in kind or "map<" in kind


def distinct_questions(questions: DataFrame, order: list[str]) -> DataFrame:
    """Questions without repetitions up to case, punctuation, digits and spacing; null questions stay."""
    return keep_first(questions, question_key("question"), order)


def keep_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, as of a lookup that later rows overwrite."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.col(order)).alias("_r")).select(key, "_r.*")
