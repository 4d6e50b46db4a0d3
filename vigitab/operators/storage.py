"""Stages that are read more than once: written to the folder that all machines share, and read back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. A local session without one gets a scratch folder; a cluster has to name it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def keep(df: DataFrame, name: str = "stage", by: str | None = None) -> DataFrame:
    """Write `df` once as Parquet; later plans read the rows and need no lineage or executor storage.

    With `by` the rows stand in buckets of that column: what is joined by it, or grouped by it alone or with more columns, is not shuffled again.
    """
    spark = df.sparkSession
    typed = df.withColumns({f.name: df[f.name].cast("string") for f in df.schema.fields if isinstance(f.dataType, T.NullType)})
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    if by is None:
        typed.write.parquet(path)
        return spark.read.schema(typed.schema).parquet(path)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    typed.repartition(buckets, by).write.format("parquet").option("path", path).bucketBy(buckets, by).saveAsTable(table)
    return spark.table(table)


@contextmanager
def joins_in_buckets(spark: SparkSession) -> Iterator[None]:
    """What is written inside joins buckets where they stand, also by their column and further ones; the session's own setting comes back after."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)
