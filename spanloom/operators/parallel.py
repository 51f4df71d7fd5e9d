"""Parallelism of scans that do much work a row."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """A small input in fewer files than cores, dealt out to all of them; any other as it is.

    Such an input (less than two scan partitions a core) may lie in a single row group, which one
    task would have to work off. Larger ones have partitions enough, and never pay for a shuffle.
    The decision rests on the plan's size estimate and the list of files; nothing is run.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    estimate = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    if estimate < 2 * cores * split and 0 < len(df.inputFiles()) < cores:
        return df.repartition(cores)
    return df
