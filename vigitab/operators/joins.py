"""Join operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import title_key


def assemble_by_key(frames: Sequence[DataFrame], key: str | Sequence[str]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, key)
    return out


def left_zero(df: DataFrame, other: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    out = df.join(other, list(keys), "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0)))
    return out


def orphans(child: DataFrame, parent: DataFrame, key: str | Sequence[str]) -> DataFrame:
    return child.join(parent.select(*([key] if isinstance(key, str) else key)).distinct(), key, "left_anti")


def restrict_to(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys, list(on), "left_semi")


def exclude(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys, list(on), "left_anti")


def with_levels(df: DataFrame, name: str, levels: Sequence) -> DataFrame:
    """Every row once per literal level, without a join."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(x) for x in levels])))


def unique_text_match(
    left: DataFrame, right: DataFrame, block: str, left_id: str, right_id: str, title: str, attrs: Sequence[str] = ()
) -> DataFrame:
    """Left rows with the number of right rows of the same block and title key.

    Both sides are cut to distinct (block, key, id) rows before they meet, and
    the right side is summed per (block, key), so a group of copies adds one
    joined row, never all pairs.
    """
    lk = left.select(block, left_id, title_key(title).alias("title_norm")).distinct()
    rk = right.select(block, title_key(title).alias("title_norm"), right_id, *attrs)
    per_title = rk.groupBy(block, "title_norm").agg(
        F.countDistinct(right_id).alias("_n"), F.min(right_id).alias("_first"), *[F.min(a).alias(a) for a in attrs]
    )
    return (
        lk.join(per_title, [block, "title_norm"], "left")
        .groupBy(block, left_id, "title_norm")
        .agg(
            F.coalesce(F.max("_n"), F.lit(0)).alias("matches"),
            F.min("_first").alias(right_id),
            *[F.min(a).alias(a) for a in attrs],
        )
    )


def cooccurrence(exposures: DataFrame, events: DataFrame, case: Sequence[str], pair: Sequence[str]) -> DataFrame:
    """Distinct cases per (entity, event); both inputs hold unique edges, so a plain count is exact."""
    return exposures.join(events, list(case)).groupBy(*pair).agg(F.count(F.lit(1)).alias("a"))


def join_checked(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", one_to_one: bool = True) -> DataFrame:
    """Join that fails at run time when the right key (and for 1:1 also the left key) repeats."""
    on = list(on)
    null = reduce(or_, (F.col(c).isNull() for c in on))

    def guarded(df: DataFrame, side: str) -> DataFrame:
        """Rows with their key checked; a null key repeats nothing. The window deals rows as the join does, so it adds no shuffle."""
        rows = F.count(F.lit(1)).over(Window.partitionBy(*on))
        bad = F.raise_error(F.concat(F.lit(f"{side} key repeats: "), F.to_json(F.struct(*on)))).cast("boolean")
        return df.withColumn("_n", rows).where(F.when((F.col("_n") > 1) & ~null, bad).otherwise(True)).drop("_n")

    return (guarded(left, "left") if one_to_one else left).join(guarded(right, "right"), on, how)


def repeated_keys(df: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def unpivot_names(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per (ids, field, name) over several alias columns."""
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("name")) for c in columns])
    return df.select(*ids, F.explode(fields).alias("_f")).select(*ids, "_f.field", "_f.name")


def alias_join(df: DataFrame, ids: Sequence[str], columns: Sequence[str], mapping: DataFrame, name: str) -> DataFrame:
    """Match any of several name columns against a raw-name map."""
    long = unpivot_names(df, ids, columns).where(F.col("name").isNotNull() & (F.trim("name") != "")).distinct()
    return long.withColumnRenamed("name", name).join(mapping, name)


def classify_presence(df: DataFrame, reference: DataFrame, on: Sequence[str], name: str, yes: str, no: str) -> DataFrame:
    marks = reference.select(*on).distinct().withColumn("_hit", F.lit(True))
    out = df.join(marks, list(on), "left")
    return out.withColumn(name, F.when(F.col("_hit"), yes).otherwise(no)).drop("_hit")


def key_diff(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys present on one side only."""
    lk, rk = left.select(*keys).distinct(), right.select(*keys).distinct()
    return (
        lk.join(rk, list(keys), "left_anti").withColumn("side", F.lit("left_only"))
        .unionByName(rk.join(lk, list(keys), "left_anti").withColumn("side", F.lit("right_only")))
    )


def frames_equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row with the number of rows found on one side only (multiset comparison)."""
    cols = left.columns
    tagged = left.withColumn("_s", F.lit(1)).unionByName(right.select(*cols).withColumn("_s", F.lit(-1)))
    diff = tagged.groupBy(*cols).agg(F.sum("_s").alias("_d")).where("_d <> 0")
    return diff.agg(
        F.coalesce(F.sum(F.when(F.col("_d") > 0, F.col("_d"))), F.lit(0)).alias("left_only"),
        F.coalesce(F.sum(F.when(F.col("_d") < 0, -F.col("_d"))), F.lit(0)).alias("right_only"),
    ).withColumn("equal", (F.col("left_only") == 0) & (F.col("right_only") == 0))


def composite(*cols: str) -> Column:
    return F.struct(*cols)
