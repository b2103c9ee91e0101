"""Datasets on a hub: the interface that a client library implements, and one on a shared folder."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession


class Hub(Protocol):
    """Keeps the subsets of datasets under ``organization/name``. A client library's user implements it; its token stays with it."""

    def pull(self, identifier: str, subset: str) -> DataFrame | None:
        """A subset, or none if the hub hasn't it."""

    def push(self, df: DataFrame, identifier: str, subset: str, private: bool) -> None:
        """Replace a subset."""

    def push_card(self, text: str, identifier: str) -> None:
        """Replace a dataset's card."""


class FolderHub:
    """A hub that is a folder which all users share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _store(self, identifier: str):
        from docmill.sources.store import SubsetStore

        return SubsetStore(self.spark, f"{self.root}/{identifier}")

    def pull(self, identifier: str, subset: str) -> DataFrame | None:
        store = self._store(identifier)
        return store.load(subset) if subset in store.subsets() else None

    def push(self, df: DataFrame, identifier: str, subset: str, private: bool) -> None:
        self._store(identifier).save(df, subset)

    def push_card(self, text: str, identifier: str) -> None:
        self._store(identifier).write_text("README.md", text)
