"""The library's registered queries: name to (spark, sf_dir) -> DataFrame, and SQL over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its scan has fewer parts, as a file of one row group has; what follows is costly by the row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def all_queries() -> tuple[dict[str, Query], dict[str, str]]:
    from . import arrays, attribution, facts, graphs, symbols, text, tools

    queries: dict[str, Query] = {}
    oracle: dict[str, str] = {}
    for m in (arrays, graphs, text, facts, symbols, attribution, tools):
        queries |= m.QUERIES
        oracle |= m.ORACLE
    return queries, oracle
