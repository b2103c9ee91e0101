"""Session construction and table access shared by queries, tests and the command line."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

#: Settings every docmill session wants; a session handed in by a cluster keeps its own.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("docmill")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out where one split holds a whole small table; a table of several splits stays as it is read."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if df.rdd.getNumPartitions() < 2 else df


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediates.

    A cluster names it in ``spark.checkpoint.dir``, and must. Only a session within one process, as in
    tests, gets a local folder, which is set on the context.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    current = spark.sparkContext.getCheckpointDir()
    if named:
        if current is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if current:
        return current
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"{master} needs spark.checkpoint.dir, a folder that every executor reaches")
    import tempfile

    fallback = os.path.join(tempfile.gettempdir(), "docmill-checkpoints")
    spark.sparkContext.setCheckpointDir(f"file://{fallback}")
    return fallback


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from the written copy."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitioned_by(df: DataFrame, key: str) -> DataFrame:
    """``df`` with one row of each ``key``, written once in its partitions, which later joins on it go on from without another shuffle.

    An adaptive plan doesn't tell how its result is partitioned, so this one isn't.
    """
    conf = df.sparkSession.conf
    former = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut_lineage(df.repartition(int(conf.get("spark.sql.shuffle.partitions")), key).dropDuplicates([key]))
    finally:
        conf.set("spark.sql.adaptive.enabled", former)


def discard(df: DataFrame) -> None:
    """Delete the written copy behind a table of :func:`cut_lineage` that nothing reads any more."""
    plan = df._jdf.queryExecution().logical()
    file = plan.rdd().getCheckpointFile() if plan.getClass().getSimpleName() == "LogicalRDD" else None
    if file is not None and file.isDefined():
        jvm, path = df.sparkSession._jvm, file.get()
        written = jvm.org.apache.hadoop.fs.Path(path)
        written.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(written, True)
