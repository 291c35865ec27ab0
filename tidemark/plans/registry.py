"""Registering queries with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Registry:
    def __init__(self):
        self.queries, self.oracle = {}, {}

    def __call__(self, name: str, oracle: str | None = None):
        def add(f):
            if name in self.queries:
                raise ValueError(f"{name} is registered twice")
            self.queries[name] = f
            if oracle:
                self.oracle[name] = oracle
            return f

        return add

    def sql(self, name: str, spark_sql: str, oracle: str | None = None):
        """A query that is SQL over the tables it names; by default the oracle is the same text."""

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            views(spark, sf_dir, spark_sql)
            return spark.sql(spark_sql)

        self(name, oracle or spark_sql)(run)


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """Temporary views of the tables that sql names."""
    import re

    for t in TABLES:
        if re.search(rf"\b{t}\b", sql):
            table(spark, sf_dir, t).createOrReplaceTempView(t)
