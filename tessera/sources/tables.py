"""Readers of the test tables: one Parquet file or folder for each table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: A table up to so many bytes for each core is dealt out anew if it has fewer files than there are cores.
SMALL = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` on all cores, where it is small and in few files.

    A Parquet file with one row group is read by one task whatever its size, which would
    leave the other cores idle. Tables of many files are left as they are: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) < cores and int(str(df._jdf.queryExecution().analyzed().stats().sizeInBytes())) < SMALL * cores:
        return df.repartition(cores)
    return df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``, through Spark's reader only, so any store works."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
