"""Importance resampling towards a target distribution, over distinct lines.

Texts are cut at newlines, which no word holds. Equal lines of the whole corpus are one row with the number of their occurrences; their
features are hashed into buckets once, and bucket totals are sums of bucket counts times occurrences. Runs of words that cross a line
break belong to no line and are added document by document (there are none where features are single words). A document's weight is put
together from its lines' sums. What is shuffled are distinct lines once and (row, digest) pairs; frequent lines are joined by broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, join_groups, map_batches, stored, term_lists

GRAMS, BUCKETS, PERCENT, LEAST_WORDS, SEED = 1, 10_000, 10, 20, 2024
#: Any byte of a word: lines without one have no features and are left out.
WORD_CHARACTER = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
PLACE_BITS = 33  # of monotonically_increasing_id: the row within its partition


def line_words(text: bytes) -> list[bytes]:
    return [w for part in term_lists(text) for w in part]


def line_buckets(words: list[bytes], grams: int, buckets: int) -> np.ndarray:
    """Bucket of every run of 1 to `grams` of the words, repeats included."""
    runs = [np.fromiter(map(crc32, words if k == 1 else map(b" ".join, zip(*(words[i:] for i in range(k))))), np.int64) for k in range(1, grams + 1)]
    return np.concatenate(runs) % buckets


def crossing_buckets(text: bytes, grams: int, buckets: int) -> np.ndarray:
    """Bucket of every run of 2 to `grams` words that stands on more than one line of the text.

    Of a line only its first and last `grams` - 1 words can be in such a run; between them stands a gap.
    """
    words: list[bytes | None] = []
    line: list[int] = []
    for k, part in enumerate(text.split(b"\n")):
        own: list[bytes | None] = line_words(part)
        if len(own) > 2 * (grams - 1):
            own = [*own[: grams - 1], None, *own[1 - grams :]]
        words += own
        line += [k] * len(own)
    found = []
    for n in range(2, grams + 1):
        for at in range(len(words) - n + 1):
            run = words[at : at + n]
            if line[at] != line[at + n - 1] and None not in run:
                found.append(crc32(b" ".join(run)) % buckets)
    return np.array(found, dtype=np.int64)


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *values]).astype(np.int32)))


def _line_features(grams: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [line_words(t.as_py()) for t in batch.column("line")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), batch.column("times"), pa.array(map(len, words), pa.int64()), _lists([line_buckets(w, grams, buckets) for w in words])],
                ["digest", "times", "words", "buckets"])

    return run


def _crossing(grams: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crossing = _lists([crossing_buckets(t.as_py(), grams, buckets) for t in batch.column("text")])
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("digests"), crossing], ["row", "doc_id", "digests", "crossing"])

    return run


def _bucket_sums(buckets: int):
    """Bucket counts of a task, `buckets` multiplied by `times`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            lists = batch.column("buckets")
            times = np.repeat(batch.column("times").to_numpy(), lists.value_lengths().to_numpy(zero_copy_only=False))
            np.add.at(total, lists.flatten().to_numpy(), times)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    return run


def _gain_sums(gains, kept: list[str]):
    """Replace `buckets` by their number, n, and the sum of their gains."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("buckets")
            upto = np.r_[0, np.cumsum(gains.value[lists.flatten().to_numpy()])]
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(size)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(size), pa.array(upto[ends] - upto[ends - size])], [*kept, "n", "gain"])

    return run


def lines_of(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD_CHARACTER))


def digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


def line_features(texts: DataFrame, grams: int, buckets: int) -> DataFrame:
    """digest, times, words, buckets of every distinct line of `text` that holds a word."""
    lines = texts.select(F.explode(lines_of(F.col("text"))).alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("times"))
    named = lines.select(digest(F.col("line")).alias("digest"), "times", F.col("line").cast("binary").alias("line"))
    return stored(map_batches(named, _line_features(grams, buckets), "digest binary, times long, words long, buckets array<int>"), "line_features")


def _rows(texts: DataFrame, grams: int, buckets: int) -> DataFrame:
    """A row number, doc_id, the digests of the lines and the buckets of the crossing runs of every row."""
    rows = texts.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.transform(lines_of(F.col("text")), digest).alias("digests"), F.col("text").cast("binary").alias("text"))
    if grams == 1:
        return stored(rows.select("row", "doc_id", "digests", F.expr("cast(array() AS array<int>)").alias("crossing")), "rows")
    kind = texts.schema["doc_id"].dataType.simpleString()
    return stored(map_batches(rows, _crossing(grams, buckets), f"row long, doc_id {kind}, digests array<binary>, crossing array<int>"), "rows")


def _totals(lines: DataFrame, rows: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket, over distinct lines times their occurrences and crossing runs."""
    both = lines.select("buckets", "times").unionByName(rows.where(F.size("crossing") > 0).select(F.col("crossing").alias("buckets"), F.lit(1).cast("long").alias("times")))
    found = map_batches(both, _bucket_sums(buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in found.collect():  # `buckets` rows at most
        out[bucket] = n
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed target share over the smoothed corpus share) of every bucket."""
    size = len(corpus)
    s, t = corpus.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size)))).astype(np.int64)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, grams: int = GRAMS, buckets: int = BUCKETS, seed: int = SEED,
    doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
) -> DataFrame:
    """Return doc_id, n_features, weight, score, rank for every row; rank is null for rows that are not drawn.

    Drawn are `percent` hundredths of the rows with at least `least_words` words, by score, which is the weight and Gumbel noise from the
    id; equal scores stand by id, a null id first and with noise of an empty id. Null, empty and blank texts have no features and weight
    0. A text or a line may be of any length. Rows that repeat an id and a text are rows like others: they score alike and have ranks
    one after the other. An empty table gives an empty result; an empty target leaves the smoothing alone. Other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    aims = target.select(F.lit(0).alias("doc_id"), F.coalesce(F.col(f"`{target_text}`"), F.lit("")).alias("text"))
    lines, rows = line_features(texts, grams, buckets), _rows(texts, grams, buckets)
    gains = spark.sparkContext.broadcast(gains_of(_totals(lines, rows, buckets), _totals(line_features(aims, grams, buckets), _rows(aims, grams, buckets), buckets)))
    known = stored(map_batches(lines, _gain_sums(gains, ["digest", "times", "words"]), "digest binary, times long, words long, n long, gain long"), "line_gains")
    found = join_groups(rows.select("row", F.explode("digests").alias("digest")), known, "digest", known.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0], "times")
    parts = found.select("row", "words", "n", "gain")
    if grams > 1:
        crossing = rows.where(F.size("crossing") > 0).select("row", F.lit(0).cast("long").alias("words"), F.col("crossing").alias("buckets"))
        parts = parts.unionByName(map_batches(crossing, _gain_sums(gains, ["row", "words"]), "row long, words long, n long, gain long"))
    sums = parts.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("words", "n", "gain")))
    none = F.lit(0).cast("long")
    whole = rows.select("row", "doc_id").join(sums, "row", "left").fillna(0, ["words", "n", "gain"])
    weight = F.when(F.col("n") > 0, F.expr("(gain - pmod(gain, n)) div n")).otherwise(none)
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    scored = stored(whole.select(
        "row", "doc_id", F.col("n").alias("n_features"), (F.col("words") >= least_words).alias("open"), weight.alias("weight"),
        (weight + F.floor(-1000 * F.log(-F.log(share)))).alias("score")), "scored")
    gains.unpersist()
    return _drawn(scored, percent).select("doc_id", "n_features", "weight", "score", "rank")


def _drawn(scored: DataFrame, percent: int) -> DataFrame:
    """Number the rows in the order of the draw, `open` ones first: sorted ranges, and a running total of the ranges' sizes."""
    spark = scored.sparkSession
    order = [F.desc("open"), F.desc("score"), F.asc("doc_id"), F.asc("row")]
    dealt = scored.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    placed = stored(dealt.withColumn("place", F.monotonically_increasing_id()), "drawn")
    part = F.shiftright("place", PLACE_BITS).alias("part")
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias("size"), F.count(F.when(F.col("open"), 1)).alias("opened"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition, not for each document
    starts = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    draws = (sizes.agg(F.coalesce(F.sum("opened"), F.lit(0))).first()[0] or 0) * percent // 100
    at = F.col("start") + F.col("place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) + 1
    ranked = placed.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("at", at)
    return ranked.withColumn("rank", F.when(F.col("open") & (F.col("at") <= draws), F.col("at")))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
