"""Settings from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import SparkSession

from .operators.embed import embedder
from .operators.store import ChunkStore


@dataclass(frozen=True)
class Config:
    corpus_root: str
    db_path: str
    collection: str = "knowledge"
    embedder_name: str = "hash"

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Config:
        """CORPUSLOOM_CORPUS_ROOT and CORPUSLOOM_DB_PATH are needed; CORPUSLOOM_COLLECTION and CORPUSLOOM_EMBEDDER have defaults."""
        env = os.environ if env is None else env
        root, db = env.get("CORPUSLOOM_CORPUS_ROOT"), env.get("CORPUSLOOM_DB_PATH")
        for name, value in (("CORPUSLOOM_CORPUS_ROOT", root), ("CORPUSLOOM_DB_PATH", db)):
            if not value:
                raise ValueError(f"{name} is not set")
        out = cls(os.path.realpath(root), os.path.realpath(db), env.get("CORPUSLOOM_COLLECTION", "knowledge"), env.get("CORPUSLOOM_EMBEDDER", "hash"))
        embedder(out.embedder_name)  # an unknown name fails here
        return out

    def open_store(self, spark: SparkSession) -> ChunkStore:
        return ChunkStore(spark, self.db_path, self.collection, embedder(self.embedder_name))
