"""Versions of something stored: one small JSON file each, committed by a rename that fails if the version is taken."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from ..work import names, read_text, write_new


class Versions:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, f"{path.rstrip('/')}/versions"

    def latest(self) -> int:
        """The latest version; 0 if there is none."""
        return max((int(n[1:9]) for n in names(self.spark, self.folder) if n.startswith("v") and len(n) == 14), default=0)

    def read(self, version: int | None = None) -> dict:
        version = self.latest() if version is None else version
        return json.loads(read_text(self.spark, f"{self.folder}/v{version:08d}.json")) if version else {}

    def commit(self, version: int, state: dict) -> bool:
        """Make `state` the given version; False if another writer has made that version."""
        return write_new(self.spark, f"{self.folder}/v{version:08d}.json", json.dumps(state))
