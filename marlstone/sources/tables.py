"""Parquet table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the folder ``sf_dir``, scanned lazily."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt to all cores where its files give work to fewer, as a single row group does. A table
    of many files is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    busy = df.select(F.spark_partition_id().alias("p")).distinct().count()
    return df if busy >= cores else df.repartition(cores)
