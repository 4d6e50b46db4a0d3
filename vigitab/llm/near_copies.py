"""Near copies by similarity: SimHash tries below shared samples of five-word shingles, links confirmed by Jaccard, the rest by prefixes.

At a Jaccard of 0.8 two 64-bit fingerprints differ in about ten bits, and no block of the fingerprint is both equal in such pairs and
rare in others. So the block that partners share comes from the text: each of SAMPLES samples takes the shingles whose hash falls into
one of 2^k classes, k such that three to six shingles remain whatever the text's length. Two similar texts agree in some sample as a
whole; below each shared sample the binary trie of simhash.py is joined with itself within BUDGET bits. Its pairs, nearest first, are
reduced to a spanning forest, and a link of the forest counts only if the two shingle sets have a Jaccard of SIMILARITY or more.

A sample gives a row of four numbers, so rows grow with the documents alone. A sample that more than BLOCK sets share (a passage that
many documents hold, a large group of near copies) is taken apart twice: by the text's next sample, and by a hash that differs from
sample to sample, so that the parts of one group overlap and a group of near copies stays connected. No task makes pairs of more than
BLOCK rows.

Samples, budget and blocks find most links cheaply and may miss some. An exact pass follows: two sets with a Jaccard of t share one of the
first n - ceil(t * n) + 1 shingles of their n, in any common order, the smaller set even one of its first n - ceil(2t / (1 + t) * n) + 1.
With the frequent shingles last, such prefixes seldom meet. Sets of different components that stand in one such bucket are compared in the
task that holds it, by size, by the place of the shingle and by a parity map, whose differing bits are never more than the shingles that
the sets do not share. Rows are made only for pairs that pass, and these are confirmed as well. So no link between two components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import HOT_SHARE, join_groups, map_batches, stored, whole_text
from .simhash import NODE_ROWS, SEED, components, spanning, trie_pairs

SHINGLE, SIMILARITY = 5, 0.8
#: Samples of a text, and the differing bits at which the trie below a sample is pruned: twice the mean at a Jaccard of 0.8.
SAMPLES, BUDGET = 16, 20
#: Sets that share a block and are joined in one task.
BLOCK = 64
#: Rows that a task joins at once.
JOIN_ROWS = 1 << 14
MULTIPLIERS = np.random.default_rng(SEED).integers(1 << 62, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
CHUNK = 1 << 14
#: Shingles counted to find the frequent ones, and frequent ones kept. Both only order the prefixes: any order gives the same links.
ORDER_SAMPLE, ORDER_ROOM = 1 << 24, 1 << 18
#: Bits of a parity map: a bit tells whether an odd number of the set's shingles fall on it.
PARITY_BITS = 512
#: Slack of comparisons of whole numbers with products of `similarity`.
SLACK = 1e-6


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 of the word shingles; fewer words: the whole sequence; no words: none."""
    words = text.lower().split()  # of bytes: A-Z only, and blanks U+0009 to U+000D only
    if not words:
        return np.zeros(0, np.uint64)
    runs = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) > shingle else [b" ".join(words)]
    return _distinct(np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64, count=max(len(words) - shingle + 1, 1)))


def _distinct(values: np.ndarray) -> np.ndarray:
    values.sort()
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def set_fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set of hashes, signed: a bit is 1 if set in over half of them."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[at : at + CHUNK].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def level(n: int) -> int:
    """k, so that a sample of one class in 2^k holds three to six of n shingles on average (two to six of fewer than 12)."""
    return max(1, (n // 3).bit_length() - 1)


def samples(hashes: np.ndarray, similarity: float = SIMILARITY) -> list[int]:
    """Digests of the samples that are not empty, at the level of this set and at that of the largest set it can be similar to."""
    n = len(hashes)
    if (n + 1) * similarity > n:  # a set that lacks or has one more shingle is not similar, so only equal sets are
        return []
    found: list[int] = []
    for k in sorted({level(n), level(int(n / similarity))}):
        sums, sizes = np.zeros(SAMPLES, np.uint64), np.zeros(SAMPLES, np.int64)
        for at in range(0, n, CHUNK):
            part = hashes[at : at + CHUNK]
            mixed = part ^ (part >> np.uint64(29))
            taken = (mixed[None, :] * MULTIPLIERS[:, None]) >> np.uint64(64 - k) == 0
            sums += np.where(taken, part[None, :], np.uint64(0)).sum(axis=1, dtype=np.uint64)
            sizes += taken.sum(axis=1)
        found += sums[sizes > 0].view(np.int64).tolist()
    return list(dict.fromkeys(found))


def parity_map(shingles: np.ndarray) -> bytes:
    """Parity of the shingles on each of PARITY_BITS places. Two maps differ in no more bits than there are shingles in one set only."""
    return np.packbits(np.bincount(shingles.view(np.uint32) % PARITY_BITS, minlength=PARITY_BITS) & 1).tobytes()


def _sketches(batches: Iterator[pa.RecordBatch], shingle: int, similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, prints, keys, sets = [], [], [], []
        for text in batch.column("text").cast(pa.binary()):
            hashes = shingle_hashes(text.as_py(), shingle)
            digests.append(xxhash.xxh64_intdigest(hashes.tobytes(), seed=SEED))
            prints.append(set_fingerprint(hashes))
            keys.append(samples(hashes, similarity))
            sets.append(_distinct(hashes.astype(np.uint32)).view(np.int32))
        ends = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
        told = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int32)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.array(digests, np.uint64).view(np.int64)), pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64())), told,
             pa.array(list(map(parity_map, sets)), pa.binary())],
            ["doc_id", "digest", "value", "keys", "shingles", "parity"])


def block_links(groups: np.ndarray, values: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions) of a spanning forest of all pairs within the budget, nearest first. Rows stand by group and unsigned value."""
    first = np.r_[True, (groups[1:] != groups[:-1]) | (values[1:] != values[:-1])]
    equal, own = np.flatnonzero(~first), np.flatnonzero(first)  # equal fingerprints are linked in a chain
    none = np.zeros(len(own), np.int64)
    left, right = trie_pairs(groups[own], none, values[own], none, budget)
    left, right = own[left], own[right]
    near = np.argsort(np.bitwise_count(values[left] ^ values[right]), kind="stable")
    left, right = np.r_[equal - 1, left[near]], np.r_[equal, right[near]]
    kept = spanning(left, right)
    return left[kept], right[kept]


def _whole_groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], ends: int) -> Iterator[pa.Table]:
    """The rows of a partition in tables of about JOIN_ROWS, cut only where one of the first `ends` columns changes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch.select(columns))
        if sum(h.num_rows for h in held) >= JOIN_ROWS:
            rows = pa.Table.from_batches(held)
            last = np.flatnonzero(_changes(rows, columns[:ends]))
            if len(last):
                yield rows.slice(0, int(last[-1]) + 1)
                rows = rows.slice(int(last[-1]) + 1)
            held = rows.combine_chunks().to_batches()
    if sum(h.num_rows for h in held):
        yield pa.Table.from_batches(held)


def _changes(rows: pa.Table, columns: tuple[str, ...]) -> np.ndarray:
    return np.logical_or.reduce([np.diff(rows[c].to_numpy()) != 0 for c in columns])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate links of a partition whose blocks stand together."""
    for rows in _whole_groups(batches, ("key", "part", "value", "digest"), 2):
        group = np.cumsum(np.r_[False, _changes(rows, ("key", "part"))])
        values, digest = rows["value"].to_numpy().view(np.uint64), rows["digest"].to_numpy()
        order = np.lexsort((values, group))
        left, right = block_links(group[order], values[order])
        a, b = digest[order[left]], digest[order[right]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["u", "v"])


def _shared(rows: DataFrame, name: str) -> DataFrame:
    """Rows whose key others have too, with the number of rows of the key."""
    rows = stored(rows, name)
    sizes = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "sample_sizes")
    cut = rows.count() // HOT_SHARE
    hot = [r["key"] for r in sizes.where(F.col("members") > cut).select("key").collect()] if cut else []  # fewer than HOT_SHARE
    if not hot:
        return stored(rows.join(sizes, "key"), "shared_samples")
    large, small = F.col("key").isin(hot), F.col("members") <= cut
    met = rows.where(large).join(F.broadcast(sizes.where(~small)), "key").unionByName(rows.where(~large).join(sizes.where(small), "key"))
    return stored(met, "shared_samples")


def candidates(sets: DataFrame) -> DataFrame:
    """Distinct pairs (u < v) of digests that stand in one block within the budget, as far as forests need them."""
    following = F.expr("concat(slice(keys, 2, size(keys)), slice(keys, 1, 1))")
    rows = sets.where("size(keys) > 0").select(F.explode(F.arrays_zip("keys", following.alias("next"))).alias("s"), "value", "digest")
    met = _shared(rows.select(F.col("s.keys").alias("key"), F.col("s.next").alias("next"), "value", "digest"), "samples")
    large = met.where(F.col("members") > BLOCK)
    finer = _shared(large.select(F.xxhash64("key", "next").alias("key"), "next", "value", "digest"), "sample_pairs")
    dealt = F.pmod(F.xxhash64("digest", "key"), F.ceil(F.col("members") / BLOCK))
    blocks = met.unionByName(finer).select("key", F.when(F.col("members") > BLOCK, dealt).otherwise(F.lit(0)).alias("part"), "value", "digest")
    return blocks.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_pairs, "u long, v long").distinct()


def confirmed(pairs: DataFrame, sketches: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs whose shingle sets have a Jaccard of `similarity` or more.

    Sets are compared by 32 bits of their hashes: at 100,000 shingles about one falls together with another.
    """
    uses = stored(pairs.select(F.explode(F.array("u", "v")).alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("uses")), "asked_sets")
    asked = sketches.join(uses, "digest").groupBy("digest").agg(F.first("shingles").alias("shingles"), F.first("uses").alias("uses"))
    asked, total = stored(asked, "sets_asked"), pairs.count()
    side = lambda c: asked.select(F.col("digest").alias(c), F.col("shingles").alias(f"{c}_set"), F.col("uses").alias(f"{c}_uses"))
    met = join_groups(join_groups(pairs, side("u"), "u", total, "u_uses"), side("v"), "v", total, "v_uses")
    both = F.size(F.array_intersect("u_set", "v_set"))
    return met.withColumn("both", both).where(F.col("both") + 1e-9 >= similarity * (F.size("u_set") + F.size("v_set") - F.col("both"))).select("u", "v")


def frequent_shingles(sketches: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that recur in a bounded sample of the sets, ascending, and their ranks from 1, the most frequent highest."""
    total = sketches.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0))).first()[0]
    part = sketches.where(F.pmod(F.xxhash64("digest"), F.lit(max(1, total // ORDER_SAMPLE))) == 0).dropDuplicates(["digest"])
    counts = part.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    top = counts.orderBy(F.desc("n"), "shingle").limit(ORDER_ROOM).toArrow().combine_chunks()
    shingles, n = top["shingle"].to_numpy().astype(np.int32).view(np.uint32), top["n"].to_numpy().astype(np.int64)
    ranks = np.empty(len(n), np.int64)
    ranks[np.lexsort((shingles, n))] = np.arange(1, len(n) + 1)
    order = np.argsort(shingles)
    return shingles[order], ranks[order]


def prefixes(sets: list[np.ndarray], known: np.ndarray, ranks: np.ndarray, similarity: float) -> tuple[np.ndarray, ...]:
    """Of ascending sets: the place of the set, the shingle, the set's size and its shingles from this one on, for each shingle of a prefix."""
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint32)
    row = np.repeat(np.arange(len(sets)), size)
    rank = np.zeros(len(flat), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
        rank = np.where(known[at] == flat, ranks[at], 0)
    order = np.lexsort((rank, row))  # stable, so shingles of one rank ascend
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    length = size - np.ceil(similarity * size - SLACK).astype(np.int64) + 1
    length[(size + 1) * similarity > size + SLACK] = 0  # only equal sets are similar
    kept = place < length[row]
    row, place = row[kept], place[kept]
    return row, flat[order][kept], size[row], size[row] - place


def prefix_rows(sketches: DataFrame, similarity: float) -> DataFrame:
    """shingle, digest, size, left for every shingle of every set's prefix."""
    shared = sketches.sparkSession.sparkContext.broadcast(frequent_shingles(sketches))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ranks = shared.value
        for batch in batches:
            sets = [s.values.to_numpy().view(np.uint32) for s in batch.column("shingles")]
            row, shingle, size, left = prefixes(sets, known, ranks, similarity)
            digest = batch.column("digest").to_numpy()[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shingle.view(np.int32)), pa.array(digest), pa.array(size.astype(np.int32)), pa.array(left.astype(np.int32))], ["shingle", "digest", "size", "left"])

    return map_batches(sketches.select("digest", "shingles"), run, "shingle int, digest long, size int, left int")


def _met(rows: DataFrame, node: str, similarity: float) -> DataFrame:
    """Rows whose shingle stands in the prefixes of more than one `node`, and for the smaller of two of them in its first ones.

    A pair shares as many shingles as 2t / (1 + t) of the smaller set at least, so that many follow in it from the first shared one on.
    """
    bucket = Window.partitionBy("shingle")
    early = F.col("left") + F.lit(SLACK) >= F.lit(2 * similarity / (1 + similarity)) * F.col("size")
    smaller = F.when(early, F.col(node))
    told = rows.withColumns({"low": F.min(node).over(bucket), "high": F.max(node).over(bucket), "low_early": F.min(smaller).over(bucket), "high_early": F.max(smaller).over(bucket)})
    other = (F.col("low_early") < F.col("high_early")) | (F.col("low_early") != F.col(node))
    return told.where((F.col("low") < F.col("high")) & (early | other)).select(*rows.columns)


def bucket_pairs(ends: np.ndarray, side: np.ndarray, label: np.ndarray, size: np.ndarray, left: np.ndarray, parity: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of different labels that can be similar. Rows stand by bucket and size; `ends` is the end of a row's bucket.

    Rows of a bucket with both sides (0 and 1) meet those of the other side only, -1 meets all. A row leaves the walk over the larger ones
    as soon as too few shingles follow in it for their size.
    """
    share, at, found = similarity / (1 + similarity), np.arange(len(ends)), []
    for step in range(1, len(ends)):
        at = at[at + step < ends[at]]
        at = at[left[at] + SLACK >= share * (size[at] + size[at + step])]
        if not len(at):
            break
        least = share * (size[at] + size[at + step])
        open_ = (label[at] != label[at + step]) & (left[at + step] + SLACK >= least) & ((side[at] != side[at + step]) | (side[at] < 0))
        a, b, least = at[open_], at[open_] + step, least[open_]
        apart = np.bitwise_count(parity[a] ^ parity[b]).sum(axis=1, dtype=np.int64)
        near = apart <= size[a] + size[b] - 2 * np.ceil(least - SLACK)
        found.append((a[near], b[near]))
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.zeros(0, np.int64),) * 2


def _apart_pairs(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Candidate pairs (u < v) of a partition whose buckets stand together, by size."""
    for rows in _whole_groups(batches, ("shingle", "node_a", "node_b", "part", "label", "size", "left", "digest", "parity"), 3):
        last = np.flatnonzero(np.r_[_changes(rows, ("shingle", "node_a", "node_b")), True]) + 1
        ends = np.repeat(last, np.diff(np.r_[0, last]))
        a, b, part, label, size, left, digest = (rows[c].to_numpy() for c in ("node_a", "node_b", "part", "label", "size", "left", "digest"))
        parity = np.frombuffer(b"".join(rows["parity"].to_pylist()), np.uint64).reshape(len(rows), -1)
        side = np.where(a == b, -1, part == b)
        x, y = bucket_pairs(ends, side, label, size, left, parity, similarity)
        found = np.stack([np.minimum(digest[x], digest[y]), np.maximum(digest[x], digest[y])])
        u, v = np.unique(found, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def missing(sketches: DataFrame, sets: DataFrame, labels: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """All pairs (u < v) of digests in different components (id, label) that can have a Jaccard of `similarity`.

    A bucket holds the rows of a shingle. One of more than NODE_ROWS is dealt into parts, and each two parts meet in a task of their own.
    """
    met = stored(_met(prefix_rows(sketches, similarity), "digest", similarity), "met_prefixes")
    known = met.join(labels.withColumnRenamed("id", "digest"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    apart = _met(known.distinct(), "label", similarity).withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("shingle")))
    parts = F.ceil(F.col("members") / NODE_ROWS).cast("int")
    dealt = stored(apart.withColumn("parts", parts).drop("members"), "apart_prefixes").join(sets.select("digest", "parity"), "digest")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("digest", "shingle"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    node = {"node_a": F.least("part", "other"), "node_b": F.greatest("part", "other")}
    buckets = dealt.withColumns(node).drop("parts", "other").repartition("shingle", "node_a", "node_b").sortWithinPartitions("shingle", "node_a", "node_b", "size")
    return map_batches(buckets, partial(_apart_pairs, similarity=similarity), "u long, v long").distinct()


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Return doc_id and component_id, the smallest doc_id reachable over links, for every row.

    Equal sets of shingles are one node; null, empty and blank texts share the empty set. Links are between sets, so a row with a null id
    links others; component_id is null only if all ids of the component are. Repeated rows get equal rows. A text may be of any length.
    An empty table gives an empty result. Other columns are not read.
    """
    told = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, digest long, value long, keys array<long>, shingles array<int>, parity binary"
    run = partial(_sketches, shingle=shingle, similarity=similarity)
    sketches = stored(map_batches(docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text")), run, told), "sketches")
    sets = sketches.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.first("value").alias("value"), F.first("keys").alias("keys"), F.first("parity").alias("parity"), F.count(F.lit(1)).alias("copies"))
    sets = stored(sets, "shingle_sets")
    edges = stored(confirmed(stored(candidates(sets), "candidates"), sketches, similarity), "confirmed")
    labels = components(edges)
    more = stored(confirmed(stored(missing(sketches, sets, labels, similarity), "missing"), sketches, similarity), "confirmed_missing")
    side = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"))
    between = more.join(side("u"), "u", "left").join(side("v"), "v", "left").select(F.coalesce("u_label", "u").alias("u"), F.coalesce("v_label", "v").alias("v"))
    tops = components(between).toDF("label", "top")  # of components: their members need not be walked again
    named = sets.select("digest", "first_id", "copies").join(labels.withColumnRenamed("id", "digest"), "digest", "left")
    named = stored(named.withColumn("label", F.coalesce("label", "digest")), "labelled_sets")
    heads = named.groupBy("label").agg(F.min("first_id").alias("first_id"), F.count(F.lit(1)).alias("members")).join(tops, "label", "left")
    heads = stored(heads.withColumn("top", F.coalesce("top", "label")), "set_members")
    first = stored(heads.groupBy("top").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("heads")), "component_ids")
    told = stored(join_groups(heads, first, "top", heads.count(), "heads").select("label", "members", "component_id"), "told_members")
    whole = join_groups(named, told, "label", named.count(), "members").select("digest", "copies", "component_id")
    rows = sketches.select("doc_id", "digest")
    return join_groups(rows, stored(whole, "set_components"), "digest", rows.count(), "copies").select("doc_id", "component_id")
