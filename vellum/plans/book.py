"""A book of named queries: a callable per name and, where SQL can say it, the equivalent statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellum.runtime import table


class Tables:
    """The tables of one data folder, read on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


class Book:
    def __init__(self) -> None:
        self.calls: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable:
        """Register a function of ``Tables`` under a name, with its SQL."""

        def add(build: Callable[[Tables], DataFrame]) -> Callable:
            self.calls[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
            if sql is not None:
                self.sql[name] = sql
            return build

        return add
