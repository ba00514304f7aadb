"""Where queries and their SQL statements are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder as attributes, NaN read as null at the scan."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        from ..sources.scans import read_table

        return read_table(self.spark, f"{self.folder}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    """Register fn(tables) under a name, with the SQL that gives the same rows."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register
