"""Logical tables, loaded when first asked for."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession


class TableSet(Mapping[str, DataFrame]):
    """Name -> DataFrame. A missing table raises on access only, so one check fails and not the whole suite."""

    def __init__(self, load: Callable[[str], DataFrame], names: tuple[str, ...] = ()):
        self._load = load
        self._names = names
        self._seen: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._seen:
            self._seen[name] = self._load(name)
        return self._seen[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._names or tuple(self._seen))

    def __len__(self) -> int:
        return len(self._names or self._seen)

    @classmethod
    def from_catalog(cls, spark: SparkSession) -> TableSet:
        return cls(spark.table)

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str) -> TableSet:
        return cls(lambda name: spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet"))

    @classmethod
    def from_frames(cls, frames: Mapping[str, DataFrame]) -> TableSet:
        return cls(lambda name: frames[name], tuple(frames))

    @classmethod
    def from_builders(cls, builders: Mapping[str, Callable[[], DataFrame]]) -> TableSet:
        return cls(lambda name: builders[name](), tuple(builders))


def sql_source(spark: SparkSession, text: str, **values) -> DataFrame:
    """A query text as a source; ``:name`` markers are bound by Spark, never pasted into the text."""
    return spark.sql(text, args=values) if values else spark.sql(text)
