"""Scans and sinks. Files are read and written by executors; nothing passes through the driver."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str, cols: Sequence[str], where: Column | None = None) -> DataFrame:
    """Columnar scan; projection and filter reach the file reader."""
    df = spark.read.parquet(path)
    return (df if where is None else df.where(where)).select(*cols)


def scan_text_csv(spark: SparkSession, path: str, casts: dict[str, str]) -> DataFrame:
    """Every column as text, then explicit casts that turn bad values into nulls."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return df.select(*[F.col(c).try_cast(casts[c]).alias(c) if c in casts else F.col(c) for c in df.columns])


def scan_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def scan_dictionary(spark: SparkSession, path: str, schema: str, sep: str = "$") -> DataFrame:
    """Headerless separated dictionary without quoting."""
    return spark.read.option("sep", sep).option("quote", "").option("header", False).schema(schema).csv(path)


def register_tables(spark: SparkSession, source: dict[str, str], jdbc: dict | None = None) -> list[str]:
    """Read-only tables of one registry as temporary views, from files or from a database."""
    for name, where in source.items():
        df = spark.read.format("jdbc").options(**jdbc, dbtable=where).load() if jdbc else spark.read.parquet(where)
        df.createOrReplaceTempView(name)
    return list(source)


def matrix_to_table(df: DataFrame, values: str = "values", keep: Sequence[str] = ()) -> DataFrame:
    """JSON value matrices (row 0 is the header) to (row, column name, value), without a join."""
    v = F.col(values)
    rows = df.select(*keep, F.element_at(v, 1).alias("_h"), F.posexplode(F.slice(v, F.lit(2), F.size(v) - 1)).alias("row", "_c"))
    cells = rows.select(*keep, "row", F.explode(F.arrays_zip("_h", "_c")).alias("_z"))
    return cells.select(*keep, "row", F.col("_z._h").alias("column_name"), F.col("_z._c").alias("value"))


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str, fields: Sequence[str]) -> None:
    """CSV with the chosen fields in the chosen order; other columns are left out."""
    df.select(*fields).write.mode("overwrite").option("header", True).csv(path)


def write_dictionary(df: DataFrame, path: str, fields: Sequence[str], sep: str = "$") -> None:
    df.select(*fields).write.mode("overwrite").option("sep", sep).option("quote", "").option("header", False).csv(path)


def write_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free content fingerprint: rows, sum and xor of row hashes."""
    h = F.xxhash64(*sorted(df.columns))
    return df.select(h.alias("_h")).agg(
        F.count(F.lit(1)).alias("rows"), F.bit_xor("_h").alias("hash_xor"),
        F.sum(F.col("_h").cast("decimal(38,0)")).cast("string").alias("hash_sum"),
    )


def verify_fingerprint(df: DataFrame, expected: DataFrame) -> DataFrame:
    """One row per expected fingerprint telling whether the table still matches it."""
    both = fingerprint(df).withColumn("_now", F.lit(True)).unionByName(expected.select("rows", "hash_xor", "hash_sum").withColumn("_now", F.lit(False)))
    same = F.countDistinct(F.struct("rows", "hash_xor", "hash_sum")) == 1
    return both.agg(F.max(F.when(F.col("_now"), F.col("rows"))).alias("rows"), same.alias("unchanged"))


def stack_tables(tables: dict[str, DataFrame], tag: str = "source_table") -> DataFrame:
    """Several result tables under one another, columns united, with their source name."""
    parts = [df.withColumn(tag, F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
