"""What the registered queries share: tables, the registry of queries with their SQL, and values chosen by a key."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = "TIMESTAMP '2024-01-20 00:00:00'"


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def events(t: Tables) -> DataFrame:
    return t.events.withColumn("ts", F.col("ts").cast("timestamp"))


def pick(key: str, values: Sequence[str | None]) -> Column:
    """One of the values, by the remainder of a whole key."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def sql_pick(key: str, values: Sequence[str | None]) -> str:
    quoted = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"[{quoted}][CAST({key} % {len(values)} + 1 AS INT)]"


def sql_any(text: str, patterns: Sequence[str]) -> str:
    """Whether some pattern is found in a text."""
    return "(" + " OR ".join(f"regexp_matches({text}, '{p}')" for p in patterns) + ")"
