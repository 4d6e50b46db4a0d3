"""Near-dedup by SimHash: fingerprints are linked by a binary-trie self-join within a Hamming budget, links are closed to components.

Copies collapse first: the join works on distinct fingerprints. With a budget of two bits one of three blocks of the fingerprint is equal
in both partners, so every fingerprint stands in three tries, one for each block rotated to the top, and two trie nodes meet only below
an equal block. A node pair with too many members is taken apart by the next bits, again only into child pairs within the budget, until
its members fit one task; there the node pairs are traversed together, bit by bit, and dropped when the budget is exceeded.
A fingerprint has at most 2,080 partners, so no step makes pairs that grow with the square of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, join_groups, map_batches, stored, whole_text

BUDGET = 2
#: (rotation that brings the block to the top, bits of the block): BUDGET + 1 blocks.
BLOCKS = [(0, 22), (22, 21), (43, 21)]
#: Members of a node pair that one task traverses, and bits by which a larger one is taken apart.
NODE_ROWS, SPLIT_BITS = 4096, 4
SHINGLE, SEED, CHUNK = 3, 42, 1 << 16


def fingerprint(text: bytes) -> int:
    """SimHash of the text's word shingles, unsigned: a bit is 1 if set in over half of the shingles' hashes; no words: 0."""
    words = text.lower().split()  # of bytes: A-Z only, and blanks U+0009 to U+000D only
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), seed=SEED) if words else 0
    ones, n = np.zeros(64, dtype=np.int64), len(words) - SHINGLE + 1
    for at in range(0, n, CHUNK):
        part = words[at : at + CHUNK + SHINGLE - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(SHINGLE))))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, count=len(part) - SHINGLE + 1)
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)  # a byte for each bit
        sums = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0)  # 255 ones fit a byte, so no sum runs into its neighbour
        ones += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [fingerprint(t.as_py()) for t in batch.column("text").cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(values, dtype=np.uint64).view(np.int64))], ["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fingerprint (its 64 bits as a long) of every row; a null text has no words."""
    return map_batches(
        docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text")), _fingerprints, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, fingerprint long")


def trie_pairs(
    groups: np.ndarray, sides: np.ndarray, values: np.ndarray, depths: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs within `budget` bits, for many node pairs at once.

    Rows stand by group, side and unsigned value; a group with one side is a node against itself. A node is a range of rows that agree in
    all bits above the one it is split by, so its half with that bit set is the end of the range.
    """
    if not len(groups):
        return (np.zeros(0, np.int64),) * 2
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    ends = np.r_[starts[1:], len(groups)].astype(np.int64)
    second = np.r_[0, np.cumsum(sides)]
    mid = ends - (second[ends] - second[starts])
    alone = mid == ends
    a0, a1, b0, b1 = starts, mid, np.where(alone, starts, mid), ends
    bit = 63 - depths[starts]
    set_before = np.zeros((64, len(values) + 1), dtype=np.int32)
    for k in range(64):
        np.cumsum((values >> np.uint64(k)) & np.uint64(1), out=set_before[k, 1:])
    errors, found = np.bitwise_count((values[a0] ^ values[b0]) & _above(bit)).astype(np.int64), []
    while len(a0):
        same = a0 == b0
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        leaf = single & ~same
        x, y = a0[leaf], b0[leaf]
        near = np.bitwise_count(values[x] ^ values[y]) <= budget
        found.append((x[near], y[near]))
        go = ~single
        a0, a1, b0, b1, bit, errors, same = (v[go] for v in (a0, a1, b0, b1, bit, errors, same))
        if not len(a0):
            break
        am = a1 - (set_before[bit, a1] - set_before[bit, a0])
        bm = b1 - (set_before[bit, b1] - set_before[bit, b0])
        kids = [(a0, am, b0, bm, 0, True), (am, a1, bm, b1, 0, True), (a0, am, bm, b1, 1, True), (am, a1, b0, bm, 1, ~same)]
        parts = []
        for l0, l1, r0, r1, more, open_ in kids:
            keep = open_ & (l1 > l0) & (r1 > r0) & (errors + more <= budget) & ~((l0 == r0) & (l1 - l0 == 1))
            parts.append([v[keep] for v in (l0, l1, r0, r1, bit - 1, errors + more)])
        a0, a1, b0, b1, bit, errors = (np.concatenate(v) for v in zip(*parts))
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.zeros(0, np.int64),) * 2


def _above(bit: np.ndarray) -> np.ndarray:
    """Mask of the bits above `bit`."""
    return ~((np.uint64(2) << bit.astype(np.uint64)) - np.uint64(1))


def spanning(left: np.ndarray, right: np.ndarray) -> list[int]:
    """Indices of links that join what earlier ones have not joined: the same components with fewer links."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    kept = []
    for k, (x, y) in enumerate(zip(left.tolist(), right.tolist())):
        if (rx := root(x)) != (ry := root(y)):
            parent[rx] = ry
            kept.append(k)
    return kept


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the node pairs of a partition; a node pair's rows stand together and are at most NODE_ROWS."""
    held: list[np.ndarray] = []
    columns = ("turn", "node_a", "node_b", "side", "depth", "value")

    def solve(rows: np.ndarray) -> pa.RecordBatch:
        turn, group = rows[0], np.cumsum(np.r_[False, (np.diff(rows[:3], axis=1) != 0).any(axis=0)])
        values = rows[5].view(np.uint64)
        left, right = trie_pairs(group, rows[3], values, rows[4])
        kept = spanning(left, right)
        left, right = left[kept], right[kept]
        back = lambda at: np.bitwise_or(values[at] >> turn[at].astype(np.uint64), values[at] << ((64 - turn[at]) % 64).astype(np.uint64)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(back(left)), pa.array(back(right))], ["a", "b"])

    for batch in batches:
        held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]))
        if sum(h.shape[1] for h in held) >= 4 * NODE_ROWS:
            rows = np.concatenate(held, axis=1)
            last = np.flatnonzero((np.diff(rows[:3], axis=1) != 0).any(axis=0))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield solve(rows[:, :cut].copy())
            held = [rows[:, cut:].copy()]
    if held:
        yield solve(np.concatenate(held, axis=1))


def _rotated(value: Column, by: int) -> Column:
    return F.shiftleft(value, by).bitwiseOR(F.shiftrightunsigned(value, 64 - by)) if by else value


def _split(rows: DataFrame) -> DataFrame:
    """Take node pairs apart by the next bits: a member goes to each child pair within the budget that it belongs to."""
    depth = F.least(F.col("depth") + SPLIT_BITS, F.lit(64))
    own = F.expr("shiftrightunsigned(value, 64 - depth)")
    other = F.when(F.col("side") == 0, F.col("node.node_b")).otherwise(F.col("node.node_a"))
    grown = rows.withColumns({"other": other, "alone": F.col("node.node_a") == F.col("node.node_b"), "step": depth - F.col("depth"), "depth": depth})
    grown = grown.withColumn("own", own)
    partners = F.expr(
        "filter(transform(sequence(0L, shiftleft(1L, step) - 1), m -> shiftleft(other, step) | m), p -> bit_count(p ^ own) <= " f"{BUDGET})")
    spread = grown.withColumn("partner", F.explode(partners))
    left = F.when(F.col("alone"), F.col("own") <= F.col("partner")).otherwise(F.col("side") == 0)
    pair = F.struct(
        F.col("node.turn").alias("turn"), F.when(left, F.col("own")).otherwise(F.col("partner")).alias("node_a"),
        F.when(left, F.col("partner")).otherwise(F.col("own")).alias("node_b"))
    return spread.select(pair.alias("node"), F.when(left, 0).otherwise(1).alias("side"), "depth", "value")


def links(distinct: DataFrame, fingerprint: str = "fingerprint") -> DataFrame:
    """Links (a, b) between distinct fingerprints that have the same components as all links within the budget."""
    turns = F.explode(F.array(*(F.struct(
        F.lit(by).alias("turn"), F.lit(bits).alias("depth"), _rotated(F.col(fingerprint), by).alias("value")) for by, bits in BLOCKS)))
    top = F.expr("shiftrightunsigned(value, 64 - depth)")
    rows = distinct.select(turns.alias("t")).select("t.*").select(
        F.struct("turn", top.alias("node_a"), top.alias("node_b")).alias("node"), F.lit(0).alias("side"), "depth", "value")
    out = None
    while True:
        rows = stored(rows, "trie_rows")
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("members"), F.sum("side").alias("right"))
        both = F.when(F.col("node.node_a") == F.col("node.node_b"), F.col("members") > 1).otherwise((F.col("right") > 0) & (F.col("right") < F.col("members")))
        sizes = stored(sizes.where(both).drop("right"), "trie_nodes")
        met = join_groups(rows, sizes, "node", rows.count(), "members")
        ready = met.where(F.col("members") <= NODE_ROWS).select("node.*", "side", "depth", "value")
        ready = ready.repartition("turn", "node_a", "node_b").sortWithinPartitions("turn", "node_a", "node_b", "side", "value")
        found = ready.mapInArrow(_links, "a long, b long")
        out = found if out is None else out.unionByName(found)
        if sizes.where(F.col("members") > NODE_ROWS).isEmpty():
            return out
        rows = _split(met.where(F.col("members") > NODE_ROWS))


def components(edges: DataFrame) -> DataFrame:
    """id and label (the smallest id it reaches) of every id in `edges` (u, v).

    Labels go along the edges and along id -> label, so that paths halve; each round is written, and rounds end when no label falls.
    """
    both = stored(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), "edges")
    state = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).withColumnRenamed("u", "id")
    last = None
    while True:
        state = stored(state, "labels")
        weight = state.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if weight == last:
            return state
        last = weight
        steps = both.unionByName(state.select(F.col("id").alias("u"), F.col("label").alias("v")))
        state = steps.join(state.withColumnRenamed("id", "v"), "v").groupBy("u").agg(F.min("label").alias("label")).withColumnRenamed("u", "id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Return doc_id, fingerprint (long) and component_id, the smallest doc_id reachable over links, for every row.

    Null, empty and blank texts have fingerprint 0 and are linked like others. Links are between fingerprints, so a row with a null id
    links others; component_id is null only if all ids of the component are. Rows that repeat an id and a text get equal rows; an id with
    several texts has a row for each. A text may be of any length. An empty table gives an empty result. Other columns are not read.
    """
    rows = stored(fingerprints(docs, doc_id, text), "fingerprints")
    groups = stored(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")), "distinct_fingerprints")
    near = stored(links(groups), "links")
    labels = components(near.toDF("u", "v")).withColumnRenamed("id", "fingerprint")
    named = stored(groups.join(labels, "fingerprint", "left").withColumn("label", F.coalesce("label", "fingerprint")), "labelled")
    members = named.groupBy("label").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("fingerprints"))
    whole = join_groups(named, stored(members, "members"), "label", groups.count(), "fingerprints").select("fingerprint", "copies", "component_id")
    return join_groups(rows, stored(whole, "components"), "fingerprint", rows.count(), "copies").select("doc_id", "fingerprint", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
