"""Read-only Parquet tables under their native types (an extension)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class External:
    """``key`` orders results; without one their order is unspecified."""

    name: str
    path: str
    schema: T.StructType
    key: str | None = None

    @classmethod
    def open(cls, spark: SparkSession, name: str, path: str, key: str | None = None) -> External:
        return cls(name, path, spark.read.parquet(path).schema, key)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.path)
