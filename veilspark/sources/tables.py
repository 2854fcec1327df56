"""Tables of a folder of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores. Only an input of a few splits is shuffled; a large one has more of its own."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def dealt(df: DataFrame, rows: int, each: int) -> DataFrame:
    """df over so many partitions that each has about `each` of its rows and no core is without one: for rows whose work outweighs their bytes, of which a split or a coalesced shuffle has as many as the input is large."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))
