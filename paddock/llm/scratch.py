"""Intermediate tables that are deleted once nothing reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from paddock.session import discard, scratch_path, store


class Scratch:
    """Tables in the shared work folder, of which ``drop`` deletes those not kept."""

    def __init__(self):
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def table(self, frame: DataFrame, label: str) -> DataFrame:
        path = scratch_path(frame.sparkSession, label)
        stored = store(frame, label, path)
        self.paths[id(stored)] = (stored, path)
        return stored

    def drop(self, *tables: DataFrame) -> None:
        for stored in tables:
            _, path = self.paths.pop(id(stored))
            discard(stored.sparkSession, path)
