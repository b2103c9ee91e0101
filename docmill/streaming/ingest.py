"""Incremental versions of the batch operators, on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from docmill.functions.text import question_key

CALLS = T.StructType(
    [
        T.StructField("call_id", T.LongType()),
        T.StructField("logged_at", T.TimestampType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("stage", T.StringType()),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
        T.StructField("encoding_used", T.StringType()),
    ]
)


def table_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files below a path as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def new_files(spark: SparkSession, source_dir: str, pattern: str = "*") -> DataFrame:
    """New files of a directory tree as a stream of (path, length, content)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(source_dir)


def first_calls(calls: DataFrame, delay: str = "4 days") -> DataFrame:
    """Calls without repetitions that arrive within the delay."""
    return calls.withWatermark("logged_at", delay).dropDuplicatesWithinWatermark(["call_id"])


def cost_windows(calls: DataFrame, width: str = "1 day", delay: str = "4 days") -> DataFrame:
    """Tokens and calls by model and window of time; rows later than the delay are left out."""
    counted = first_calls(calls, delay)
    tokens = lambda c: F.sum(F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)))
    return counted.groupBy(F.window("logged_at", width), F.lower("model_name").alias("model_name")).agg(
        tokens("input_tokens").alias("input_tokens"), tokens("output_tokens").alias("output_tokens"), F.count("*").alias("calls")
    )


def first_questions(questions: DataFrame, time: str, delay: str) -> DataFrame:
    """Questions without repetitions, up to case, punctuation, digits and spacing, that arrive within the delay."""
    keyed = questions.withColumn("_key", question_key("question"))
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there now into Parquet, and end; the next run goes on from there."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
