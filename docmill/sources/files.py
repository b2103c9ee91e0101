"""Documents out of a directory tree."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions.text import has_content, strip
from docmill.sources.convert import converted, html_markdown, registered, utf8

log = logging.getLogger("docmill")

DEFAULT_EXTENSIONS = (".md", ".txt", ".pdf")
PLAIN, HTML = (".md", ".txt", ".text"), (".html", ".htm")


def extension(path: Column | str) -> Column:
    """Lower-case extension of a path, with its dot."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def files(spark: SparkSession, source_dir: str, extensions: tuple[str, ...] = DEFAULT_EXTENSIONS, output_dir: str | None = None) -> DataFrame:
    """Files below a directory with an allowed extension (path, length, content, extension).

    Paths that contain "output" below the directory, or lie in the output directory, are left out.
    Only the columns a query uses are read; a query without content lists files only.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source_dir)
    root = F.lit(source_dir.rstrip("/"))
    below = F.substring(F.col("path"), F.instr(F.col("path"), root) + F.length(root), F.lit(1 << 30))
    kept = found.where(~below.contains("output")).withColumn("extension", extension("path"))
    if output_dir:
        kept = kept.where(~F.contains(F.col("path"), F.lit(output_dir.rstrip("/") + "/")))
    return kept.where(F.col("extension").isin(*extensions)).select("path", "length", "content", "extension")


def texts(found: DataFrame) -> DataFrame:
    """(path, length, text) of the files that could be read.

    Plain files must be UTF-8; pages become Markdown, or stay as they are where that leaves
    nothing; other formats go to the registered converters.
    """
    plain, kind, content = utf8("content"), F.col("extension"), F.col("content")
    text = F.when(kind.isin(*PLAIN), plain).when(kind.isin(*HTML), F.coalesce(html_markdown(plain), plain))
    if others := registered():
        text = text.otherwise(converted(kind, content, others))
    return found.select("path", "length", text.alias("text")).where("text IS NOT NULL")


def ingested(read: DataFrame) -> DataFrame:
    """The ``ingested`` subset: texts stripped, empty ones left out, ids from path and content.

    ``file_size`` is the size of the text in bytes.
    """
    text = strip("text")
    return read.where(has_content("text")).select(
        F.substring(F.sha2(F.concat_ws("\n", "path", text), 256), 1, 32).alias("document_id"),
        text.alias("document_text"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("document_filename"),
        F.struct(F.octet_length(text).cast("long").alias("file_size")).alias("document_metadata"),
    )


def write_markdown(read: DataFrame, source_dir: str, output_dir: str) -> None:
    """Write the texts as a table with their paths relative to the source, so that a.txt and a.html don't collide."""
    relative = F.regexp_replace("path", f"^.*?{source_dir.strip('/')}/", "")
    read.select(relative.alias("relative_path"), "text").write.mode("overwrite").parquet(output_dir)


#: Renderers by file extension, from bytes and a resolution to PNG images; a user who has a library for it registers one.
_RENDERERS: dict[str, Callable[[bytes, int], list[bytes]]] = {}


def register_renderer(extension: str, render: Callable[[bytes, int], list[bytes]]) -> None:
    """Use ``render`` to turn files with this extension, such as ``.pdf``, into page images."""
    _RENDERERS[extension.lower()] = render


def renderers() -> dict[str, Callable[[bytes, int], list[bytes]]]:
    """The renderers registered so far."""
    return dict(_RENDERERS)


def pages(found: DataFrame, render: Callable[[bytes], list[bytes]]) -> DataFrame:
    """(path, page, image) of documents that ``render`` turns into page images, images as base64 text; one that fails has no pages."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, data in frame.itertuples(index=False):
                try:
                    rows += [(path, i, image) for i, image in enumerate(render(bytes(data)))]
                except Exception:  # noqa: BLE001 - a broken file is skipped, as an unreadable one is
                    log.warning("%s can't be rendered", path, exc_info=True)
            yield pd.DataFrame(rows, columns=["path", "page", "image"])

    made = found.select("path", "content").mapInPandas(run, "path string, page int, image binary")
    return made.withColumn("image", F.base64("image"))


def page_calls(images: DataFrame, prompt: str) -> DataFrame:
    """A call per page: path, page, prompt, image, tags."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    tags = F.array(F.lit("pdf_ingestion"), F.concat(F.lit("page_"), (F.col("page") + 1).cast("string")), name)
    return images.select("path", "page", F.lit(prompt).alias("prompt"), "image", tags.alias("tags"))


def joined_pages(transcribed: DataFrame) -> DataFrame:
    """(path, text): the pages that have content, by model and page, parted by rules."""
    ordered = F.array_sort(F.collect_list(F.struct("model_order", "page", "text")))
    used = transcribed.where(has_content("text")).groupBy("path").agg(ordered.alias("p"))
    return used.select("path", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n---\n\n").alias("text"))
