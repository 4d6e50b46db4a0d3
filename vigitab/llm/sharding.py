"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly over a fixed number of shards.

Rows of equal text form a group. Groups are gathered into units, a bounded number whatever the input's size: light groups share units by
hash, a heavy group is a unit of its own, and a group too heavy for one shard is dealt into pieces. Only the units' three sums reach the
packer, which puts them, largest first, where the dot product with the residual capacity is highest.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, documents, join_groups, stored, whole_text

#: Units of light groups for each shard, and the share of a shard above which a group is dealt into pieces.
LIGHT_UNITS, PIECE = 256, 8


def pack(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unit; `sizes` has a row per unit and a column per resource.

    Resources are measured in shares of one shard's capacity. Units go in order of their largest share; each goes to the shard whose
    residual capacity has the highest dot product with it. As that product also rewards room in resources the unit hardly uses, a shard
    without room for the unit is taken only if no other has room, and then the one that it overfills least.
    """
    total = sizes.sum(axis=0)
    need = sizes * shards / np.where(total > 0, total, 1)
    residual, out = np.ones((shards, sizes.shape[1])), np.zeros(len(sizes), dtype=np.int64)
    for u in np.lexsort((np.arange(len(need)), -need.max(axis=1))):
        after = residual - need[u]
        over = np.clip(-after, 0, None).max(axis=1)
        fits = over <= 1e-12
        at = np.argmax(np.where(fits, residual @ need[u], -np.inf)) if fits.any() else np.argmin(over)
        out[u], residual[at] = at, after[at]
    return out


def shard_rows(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Return doc_id, size, tokens, text_crc32, shard, slot for every row.

    size is the text's UTF-8 bytes plus 8 (a null text: 8), tokens its words. slot counts from 0 without gaps within a shard. Equal texts
    share a shard unless they weigh more than an eighth of one in some resource; a null is the empty text here. Rows that repeat an id
    are rows like others and get slots of their own. An empty table gives an empty result. Other columns are not read.
    """
    body = whole_text(text)
    rows = stored(docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(body).cast("long") + 8).alias("size"), F.regexp_count(body, F.lit(WORD)).cast("long").alias("tokens"),
        F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body, F.octet_length(body)).alias("group"),
    ), "shard_rows")
    spark, units = docs.sparkSession, shards * LIGHT_UNITS
    total = rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("size", "tokens")), F.count(F.lit(1)).alias("n")).first()

    def weight(n, size, tokens):
        return F.greatest(n / max(total["n"], 1), size / max(total["size"], 1), tokens / max(total["tokens"], 1))

    groups = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.sum("tokens").alias("tokens"))
    # at most 3 * units groups weigh over 1 / units in one of three resources: a bound that does not grow with the input
    heavy = stored(groups.withColumn("w", weight(F.col("n"), F.col("size"), F.col("tokens"))).where(F.col("w") * units > 1).select(
        "group", F.ceil(F.col("w") * shards * PIECE).alias("pieces")), "heavy_groups")
    light = F.concat(F.lit("l"), F.pmod(F.col("group"), F.lit(units)))
    piece = F.concat_ws("_", F.lit("h"), "group", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("pieces")))
    placed = rows.join(F.broadcast(heavy), "group", "left").withColumn("unit", F.when(F.col("pieces").isNull(), light).otherwise(piece)).drop("pieces")
    sums = placed.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.sum("tokens").alias("tokens"))
    known = sums.orderBy("unit").collect()  # units, not rows
    at = pack(np.array([[u["size"], u["tokens"], u["n"]] for u in known], dtype=float).reshape(-1, 3), shards)
    used, plan = [0] * shards, []
    for u, s in zip(known, at.tolist()):
        plan.append((u["unit"], s, used[s]))
        used[s] += u["n"]
    plan_df = spark.createDataFrame(plan, "unit string, shard int, first_slot long")
    rank = F.row_number().over(Window.partitionBy("unit").orderBy("doc_id", "text_crc32", "size")).cast("long") - 1
    return placed.withColumn("rank", rank).join(F.broadcast(plan_df), "unit").select(
        "doc_id", "size", "tokens", "text_crc32", "shard", (F.col("first_slot") + F.col("rank")).alias("slot"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(documents(spark, sf_dir), 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")
