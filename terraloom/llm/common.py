"""Shared plumbing of the text operators: the shared folder, cut lineage, joins of checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom import storage

#: Bytes up to which a side is broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 32 << 20


#: Rows that travel to Python at once. Documents are long, so Spark's default of 10,000 takes hundreds of megabytes.
BATCH_ROWS = 1000


def text_batches(spark: SparkSession) -> None:
    """Sets the batch size for long texts unless the session has one of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)


def table(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends here and survives lost executors."""
    text_batches(df.sparkSession)
    return storage.table(df, name)


drop = storage.drop


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores in front as no column of df has, however its columns are called."""
    taken = [c.lower() for c in df.columns]
    pre = "__"
    while any((pre + n).lower() in taken for n in names):
        pre += "_"
    return [pre + n for n in names]


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its rows, at row_bytes each, fit BROADCAST_BYTES; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shards(spark: SparkSession) -> int:
    """Number of shuffle shards for work that is grouped by hash: it follows the session's setting, hence the cluster."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
