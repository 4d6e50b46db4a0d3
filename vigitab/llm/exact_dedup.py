"""Exact dedup against a persistent digest index, bucketed and sorted by hash.

New rows come in batches in the order of their ids. A batch is reduced to one row per digest and written, digests that the index holds are
dropped by a sort-merge anti-join, and the rest is appended to the index's buckets. The index side of that join is never shuffled: its
buckets are the join's partitions; the batch side has a digest once, so no text, however frequent, makes a large task.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, documents, join_groups, shared_dir, stored, whole_text


def text_digest(text: str = "text") -> Column:
    """SHA-256 of the text with every run of white space replaced by one blank; a null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(whole_text(text), f"{SPACE}+", " ").cast("binary"), 256))


class DigestIndex:
    """Digests seen so far, one row each: digest, keep_id (the document that stays).

    `path` must lie in a folder that all machines share; an index that exists there is opened again, with the same number of buckets.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 200):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = "digest_index_" + hashlib.md5(path.encode()).hexdigest()
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def fresh(self, batch: DataFrame) -> DataFrame:
        """The rows of `batch` (digest, keep_id) whose digest the index does not hold."""
        return batch.select("digest", "keep_id").join(self.rows().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, rows: DataFrame) -> None:
        """Reduce `rows` (digest, doc_id) to a row per digest and add the digests that are not in the index yet."""
        batch = stored(rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id")), "digest_batch")
        (
            self.fresh(batch).repartition(self.buckets, "digest").write.mode("append").format("parquet")
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)
        )


def in_batches(rows: DataFrame, batches: int) -> list[DataFrame]:
    """`rows` cut by doc_id into at most `batches` parts of like size, smaller ids first; null ids stand in the last part."""
    bounds = sorted(set(rows.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01))) if batches > 1 else []
    edge = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("inf")))
    return [rows.where((edge > low) & (edge <= high)) for low, high in zip([float("-inf"), *bounds], [*bounds, float("inf")])]


BATCHES = 4


def exact_dedup(docs: DataFrame, index: DigestIndex, doc_id: str = "doc_id", text: str = "text", batches: int = 1) -> DataFrame:
    """Add `docs` to the index, in `batches` by ascending id; one row per input row: doc_id, digest, keep_id, group_size, kept.

    keep_id is the document that stays of all equal texts: the smallest id of the batch in which the text first came (so the smallest of
    all `docs`, if the index was empty). group_size counts the rows of `docs` with that text. Rows that are given again find their own
    digests and get the same answer. Null and empty texts are one group; a null id stays only if its text has no other; rows that repeat
    an id and its text are equal rows and get equal answers; a text may be of any length; an empty table gives an empty result and
    leaves the index as it is. Other columns are not read.
    """
    rows = stored(docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_digest(text).alias("digest")), "digests")
    for part in in_batches(rows, batches):
        index.append(part)
    sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    groups = stored(sizes.join(index.rows(), "digest"), "digest_groups")
    found = join_groups(rows, groups, "digest", rows.count(), "group_size")
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def new_index(spark: SparkSession) -> DigestIndex:
    """An empty index in the shared folder, with as many buckets as the session has shuffle partitions."""
    return DigestIndex(spark, f"{shared_dir(spark)}/digest-index-{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions")))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(documents(spark, sf_dir), new_index(spark), batches=BATCHES)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP8_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256 FROM t JOIN g USING (text_sha256)
"""
