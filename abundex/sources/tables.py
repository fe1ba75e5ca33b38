"""Parquet tables as sources of sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table. One with fewer splits than cores is dealt out among the cores, as its row groups may even be
    fewer; one of a split or more a core is read in place, without a shuffle."""
    table = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table
