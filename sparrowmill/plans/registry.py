"""Where queries register themselves with the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables)`` under ``name``; ``tables[x]`` reads a table of the given folder."""

    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle
        return fn

    return wrap


class Tables:
    """Lazy access to the parquet tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_query(name: str, text: str, oracle: str | None = None) -> None:
    """Register a query given as SQL over ``{table}`` names; the same text is its oracle unless another is given."""
    used = [t for t in TABLES if f"{{{t}}}" in text]

    def run(t: Tables) -> DataFrame:
        return t.spark.sql(text, **{x: t[x] for x in used})

    plain = text
    for x in used:
        plain = plain.replace(f"{{{x}}}", x)
    query(name, oracle or plain)(run)
