"""Small tables on all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame

SMALL = 32 << 20


def spread(df: DataFrame, small: int = SMALL) -> DataFrame:
    """df dealt over all cores if it is small in store and has fewer files than there are cores; else df.

    A small file is often one row group, which one task reads, whatever is done with its rows. What is shuffled
    for that is less than `small` bytes; larger tables come in many row groups and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < small and len(df.inputFiles()) < cores else df
