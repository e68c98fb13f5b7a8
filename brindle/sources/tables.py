"""Reading the tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.workspace import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def table_of_texts(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table for a step that takes long for each row: read by all cores, even if its files are few.

    Only a table with less than one split for every second core is shuffled, so none of any size.
    """
    df = table(spark, folder, name).select(*columns)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() < cores else df
