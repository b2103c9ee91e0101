"""A store of named subsets: one Parquet directory each, with JSON lines as an export."""

from __future__ import annotations

import json
import logging
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.operators.assemble import slim
from docmill.schemas import SUBSETS

log = logging.getLogger("docmill")


class SubsetStore:
    """Subsets below one root, local or on any file system Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, subset: str) -> str:
        return f"{self.root}/{subset}"

    def _fs(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _former(self, subset: str) -> str:
        return f"{self.root}/_former_{subset}"

    def subsets(self) -> list[str]:
        """Names of the subsets there are."""
        fs, path = self._fs()
        if not fs.exists(path(self.root)):
            return []
        names = {s.getPath().getName() for s in fs.listStatus(path(self.root)) if s.isDirectory()}
        for name in sorted(n.removeprefix("_former_") for n in names if n.startswith("_former_")):
            if name not in names:  # a replacement was broken off between its two moves
                fs.rename(path(self._former(name)), path(self.path(name)))
                names.add(name)
        return sorted(n for n in names if not n.startswith(("_", ".")))

    def load(self, subset: str, optional: bool = False) -> DataFrame:
        """A subset; a missing one is an error that names those there are, or with ``optional`` an empty table."""
        if subset in self.subsets():
            return self.spark.read.parquet(self.path(subset))
        if optional and subset in SUBSETS:
            return self.spark.createDataFrame([], SUBSETS[subset])
        raise FileNotFoundError(f"no subset {subset!r} in {self.root}; there are: {', '.join(self.subsets()) or 'none'}")

    def save(self, df: DataFrame, subset: str, append: bool = False) -> None:
        """Replace a subset, or add rows to it where the columns agree; where they don't it is replaced, with a warning.

        A replacement is written beside, then the old table is moved aside, the new one into its
        place, and the old one deleted; whatever breaks off, one of the two stays and is found. So a
        table may be computed from its own former self. Appending writes the new rows only. An empty
        table is saved too.
        """
        fs, path = self._fs()
        if append and subset in self.subsets():
            there = self.load(subset)
            if [(f.name, f.dataType) for f in there.schema] == [(f.name, f.dataType) for f in df.schema]:
                df.write.mode("append").parquet(self.path(subset))
                return
            log.warning("the columns of %s differ from those it had; it is replaced", subset)
        beside = f"{self.root}/_new_{subset}_{uuid.uuid4().hex}"
        df.write.parquet(beside)
        own, former = path(self.path(subset)), path(self._former(subset))
        if fs.exists(own):
            fs.delete(former, True)
            if not fs.rename(own, former):
                raise OSError(f"{self.path(subset)} can't be moved")
        if not fs.rename(path(beside), own):
            raise OSError(f"{beside} can't be moved to {self.path(subset)}")
        fs.delete(former, True)

    def read_text(self, name: str) -> str:
        """A small file beside the subsets, "" if there is none."""
        fs, path = self._fs()
        file = path(f"{self.root}/{name}")
        return "\n".join(r[0] for r in self.spark.read.text(f"{self.root}/{name}", wholetext=True).collect()) if fs.exists(file) else ""

    def write_text(self, name: str, text: str) -> None:
        """Write a small file beside the subsets."""
        write_file(self.spark, f"{self.root}/{name}", text)

    def export_jsonl(self, export_dir: str, subsets: list[str] | None = None) -> dict:
        """Write subsets as JSON lines (nulls kept, UTF-8) with an index of their row counts; returns the index."""
        counts = []
        for name in subsets or self.subsets():
            table = self.load(name)
            write_jsonl(table, f"{export_dir}/{name}")
            if name == "prepared_lighteval":
                write_jsonl(slim(table), f"{export_dir}/questions_and_answers")
            counts.append(table.select(F.lit(name).alias("subset")))
        index = jsonl_index(counts) if counts else None
        rows = {r["subset"]: r["rows"] for r in index.collect()} if index else {}
        return {"subsets": {n: rows.get(n, 0) for n in subsets or self.subsets()}, "total_rows": sum(rows.values())}


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with every field, nulls included."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def jsonl_index(tables: list[DataFrame]) -> DataFrame:
    """(subset, rows) of tables that have a subset column."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("subset").agg(F.count("*").alias("rows"))


def write_file(spark: SparkSession, file: str, text: str) -> None:
    """Write a small text file on whatever file system its path names."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(file)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def write_index(spark: SparkSession, index: dict, directory: str) -> None:
    """Write the index of an export beside it."""
    write_file(spark, f"{directory.rstrip('/')}/index.json", json.dumps(index, ensure_ascii=False, indent=2))


def replace_columns(df: DataFrame, columns: dict) -> DataFrame:
    """``df`` with columns replaced where they exist and added where not."""
    return df.withColumns(columns)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` in a fixed schema: missing columns null, others cast, extra ones dropped."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
