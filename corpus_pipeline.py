"""A corpus pipeline: language filter, exact dedup, near-dedup, mixing, BPE round trip.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept, written as Parquet and read again. All but the last
return the columns of `docs`; extra columns go along (the last replaces columns named like its own, n_tokens, ids and round_trip). The
first four drop rows. Exact dedup decides by id and text, and of rows that repeat both one stays. The others decide by id, null being an
id like others: rows with one id stay if the stage keeps any of them. A null text counts as empty; the language filter rejects it. An
empty table passes as an empty table; texts may be of any length.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigitab.llm import bpe, exact_dedup, langid, mixing, near_copies
from vigitab.llm.common import documents, shared_dir, stored


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents that it rejects go, unless a row with the same id is not rejected."""
    judged = langid.identify(docs).groupBy(F.col("doc_id").alias("__rejected_id")).agg(F.min("rejected").alias("__rejected"))
    rejected = stored(judged.where("__rejected").select("__rejected_id"), "rejected")
    return docs.join(rejected, F.col("doc_id").eqNullSafe(F.col("__rejected_id")), "left_anti")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the smallest doc_id stays, and one row of it if the row itself is repeated."""
    found = exact_dedup.exact_dedup(docs, exact_dedup.new_index(spark), batches=exact_dedup.BATCHES)
    key = lambda digest: F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.hex(digest))
    kept = found.where("kept").select(key(F.col("digest")).alias("__key")).distinct()
    same = docs.withColumn("__key", key(exact_dedup.text_digest())).join(kept, "__key", "left_semi")
    told = [F.col(f"`{c}`") for c in ("lang", "source", "n_chars") if c in docs.columns]
    nth = F.row_number().over(Window.partitionBy("__key").orderBy("__key", *told))  # the join's partitions serve the window
    return same.withColumn("__nth_copy", nth).where("__nth_copy = 1").select(*(F.col(f"`{c}`") for c in docs.columns))


#: Bits of the map of dropped ids: 2^16 words of 64 bits at most are broadcast, whatever the number of ids.
MAP_BITS = 1 << 22


def without_ids(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of `docs` whose doc_id (null too) is not in `dropped` (distinct __dropped_id), few texts being moved.

    A bit map of the hashed ids clears most rows where they are. Only rows that hit a set bit are held against the ids themselves.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(MAP_BITS))
    word, one = lambda c: F.shiftright(bit(c), 6), lambda c: F.expr(f"shiftleft(1L, cast(pmod(xxhash64({c}), 64) as int))")
    words = stored(dropped.groupBy(word("__dropped_id").alias("__word")).agg(F.bit_or(one("__dropped_id")).alias("__bits")), "dropped_map")
    met = docs.withColumn("__word", word("doc_id")).join(F.broadcast(words), "__word", "left")
    hit = F.coalesce(F.col("__bits").bitwiseAND(one("doc_id")) != 0, F.lit(False))
    asked = met.where(hit).join(dropped, F.col("doc_id").eqNullSafe(F.col("__dropped_id")), "left_anti")
    return met.where(~hit).unionByName(asked).select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup on five-word shingles: of documents linked by a Jaccard of 0.8 or more the one with the smallest doc_id stays."""
    first = F.col("component_id").eqNullSafe(F.col("doc_id"))
    judged = near_copies.near_copies(docs).groupBy(F.col("doc_id").alias("__dropped_id")).agg(F.max(first).alias("__kept"))
    return without_ids(docs, stored(judged.where("not __kept").select("__dropped_id"), "dropped"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: the rows that a single epoch takes.

    A leaf takes a prefix of its rows by order key, so a row is known by the last key that its leaf takes and texts stay where they are.
    Ids of which some rows are taken and others not, in leaves of their own, are looked up.
    """
    tree = mixing.source_tree()
    taken = stored(mixing.mix(docs, tree, mixing.TREE_WEIGHTS, mixing.PERCENT, 1, mixing.SEED), "mixed").withColumn("__taken", F.col("copies") > 0)
    leaf = lambda cols: F.to_json(F.array(*(F.coalesce(c.cast("string"), F.lit(mixing.NONE)) for c in cols)))
    key = mixing.order_key(mixing.SEED, F.lit(0), "doc_id")
    last = stored(taken.where("__taken").groupBy(leaf([F.col(n) for n in tree]).alias("__leaf")).agg(F.max(key).alias("__last")), "mix_last")
    ids = taken.groupBy(F.col("doc_id").alias("__kept_id")).agg(F.max("__taken").alias("__any"), F.min("__taken").alias("__all"))
    partly = stored(ids.where("__any and not __all").select("__kept_id", F.lit(True).alias("__partly")), "partly_taken")
    told = docs.withColumn("__leaf", leaf(tree.values())).join(last, "__leaf", "left").join(partly, F.col("doc_id").eqNullSafe(F.col("__kept_id")), "left")
    kept = F.coalesce(key <= F.col("__last"), F.lit(False)) | F.col("__partly").isNotNull()
    return told.where(kept).select(*(F.col(f"`{c}`") for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding: the rows with their token ids, and whether decoding gives the text back."""
    return bpe.round_trip(docs, bpe.default_vocabulary())


STAGES = [("language_id", keep_languages), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("bpe", encode)]

#: The language models and near copies cannot be said in SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
