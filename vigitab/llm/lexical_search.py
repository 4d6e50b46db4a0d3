"""Ranked lexical search for many items at once: what items share is added up once for a document.

The items of a block are mined for shared term sets in one task a block. Terms that the same items hold the same number of times are one
sum; of the sums, the pair that most items hold is made a sum of its own, again and again, until no two items share a pair. That gives a
graph: leaves are terms, inner nodes are shared partial sums, and every item is the sum of a few nodes. Documents stay where they are. A
task fills one accumulator per node and document, each node from nodes below it, so a shared part is computed once however many items
need it; scores are exact integers, so the order of additions does not matter. Only the best documents of a task leave it.

Documents are read twice for a block of items: once for the counts of the block's terms, once, over the counts alone, for the scores. A
block holds about BLOCK_TERMS (item, term) entries, so what is broadcast does not grow with the documents or with the number of items.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, map_batches, stored, term_lists

TOP = 20
#: Weights of the score: scale of a term's weight, scale of its saturation, and how much of a document's length counts, in hundredths.
WEIGHT_SCALE, FULL, TF_SCALE, LENGTH_SCALE, LENGTH_SHARE = 1000, 1_000_000_000, 1000, 12, 25
#: (item, term) entries of a block, cells of a task's accumulators, and the most shared sums of an item among which pairs are mined.
BLOCK_TERMS, CELLS, MINED = 1 << 16, 1 << 21, 64
#: Parts into which an item's best documents are dealt before the last choice.
SALTS = 64


def sharing_plan(entries: list[tuple[int, int, int]]) -> tuple[list[list[tuple[int, int]]], list[tuple[int, int]], dict[int, list[int]]]:
    """Sums, pairs and items of a block from its (item, term, times) entries, each (item, term) once.

    A sum is a list of (term, coefficient). Nodes are numbered with the sums first and then the pairs, each of two earlier nodes. An item
    is a list of nodes whose sum is its score. Pairs are looked for among an item's MINED most shared nodes; what is missed is only added
    up more than once.
    """
    held = defaultdict(lambda: defaultdict(list))
    for item, term, times in entries:
        held[term][times].append(item)
    classes: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
    for term in sorted(held):
        levels, owners = sorted(held[term]), sorted(i for items in held[term].values() for i in items)
        below = 0
        for times in levels:  # items that hold the term more often share its lower counts with the others
            classes[tuple(owners)].append((term, times - below))
            gone = set(held[term][times])
            owners, below = [i for i in owners if i not in gone], times
    order = sorted(classes, key=lambda items: (-len(items), items))
    sums = [classes[items] for items in order]
    holders = {k: set(items) for k, items in enumerate(order)}
    nodes: dict[int, set[int]] = defaultdict(set)
    for k, items in enumerate(order):
        for i in items:
            nodes[i].add(k)

    pairs: list[tuple[int, int]] = []
    counts: Counter = Counter()
    for own in nodes.values():
        shared = [k for k in sorted(own) if len(holders[k]) > 1][:MINED]
        counts.update((a, b) for n, b in enumerate(shared) for a in shared[:n])
    heap = [(-n, a, b) for (a, b), n in counts.items() if n > 1]
    heapq.heapify(heap)
    while heap:
        n, a, b = heapq.heappop(heap)
        both = holders[a] & holders[b]
        if len(both) < -n:  # an earlier pair took some of them
            if len(both) > 1:
                heapq.heappush(heap, (-len(both), a, b))
            continue
        new = len(sums) + len(pairs)
        pairs.append((a, b))
        holders[new] = both
        holders[a], holders[b] = holders[a] - both, holders[b] - both
        beside: Counter = Counter()
        for i in both:
            nodes[i] -= {a, b}
            beside.update(sorted((k for k in nodes[i] if len(holders[k]) > 1), key=lambda k: -len(holders[k]))[:MINED])
            nodes[i].add(new)
        for k, m in beside.items():
            if m > 1:
                heapq.heappush(heap, (-m, *sorted((k, new))))
    return sums, pairs, {i: sorted(own) for i, own in nodes.items()}


PLAN = "kind string, at int, term binary, item_id {}, parts array<int>, times array<int>"


def _mine(block: pa.Table) -> pa.Table:
    """The plan of a block as rows: term (its number), sum and pair (their nodes), item (its number, id and nodes)."""
    rows = block.to_pylist()
    terms = {t: k for k, t in enumerate(sorted({r["term"] for r in rows}))}
    items = {i: k for k, i in enumerate(sorted({r["item_id"] for r in rows}, key=lambda i: (i is not None, i)))}
    sums, pairs, own = sharing_plan([(items[r["item_id"]], terms[r["term"]], r["times"]) for r in rows])
    out = [("term", k, t, None, None, None) for t, k in terms.items()]
    out += [("sum", k, None, None, [t for t, _ in s], [c for _, c in s]) for k, s in enumerate(sums)]
    out += [("pair", len(sums) + k, None, None, list(p), None) for k, p in enumerate(pairs)]
    out += [("item", k, None, i, own[k], None) for i, k in items.items()]
    columns = list(zip(*out))
    types = (pa.string(), pa.int32(), pa.binary(), block.schema.field("item_id").type, pa.list_(pa.int32()), pa.list_(pa.int32()))
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["kind", "at", "term", "item_id", "parts", "times"])


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, text in enumerate(batch.column("text")):
            counts: Counter = Counter()
            for part in term_lists(text.as_py()):
                counts.update(part)
            if counts:
                own = batch.column("item_id").slice(row, 1).take(pa.array(np.zeros(len(counts), dtype=np.int64)))
                yield pa.RecordBatch.from_arrays([own, pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["item_id", "term", "times"])


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term and how often the item's distinct texts hold it, with the item's block; items without a term have no row."""
    kind = items.schema["item_id"].dataType.simpleString()
    texts = items.select("item_id", F.col("text").cast("binary").alias("text")).where("text is not null").distinct()
    terms = map_batches(texts, _item_terms, f"item_id {kind}, term binary, times long")
    counted = stored(terms.groupBy("item_id", "term").agg(F.sum("times").alias("times")), "item_terms")
    blocks = max(1, -(-counted.count() // BLOCK_TERMS))
    return counted.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))


def _count_terms(words: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, terms, times = [], [], []
            for text in batch.column("text"):
                n, counts = 0, Counter()
                for part in term_lists(text.as_py()):
                    n += len(part)
                    counts.update(map(words.value.get, part))
                counts.pop(None, None)
                totals.append(n)
                terms.append(list(counts.keys()))
                times.append(list(counts.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(totals, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))],
                ["doc_id", "n", "terms", "times"])

    return run


class Scorer:
    """Scores of a block's items for batches of documents, and the best documents so far."""

    def __init__(self, plan: dict, df: np.ndarray, documents: int, length: int, top: int):
        self.documents, self.length, self.top = documents, length, top
        self.weight = np.floor(WEIGHT_SCALE * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)
        self.parts, self.times, self.starts = plan["parts"], plan["times"], plan["starts"]
        self.pairs, self.item_parts, self.item_starts = plan["pairs"], plan["item_parts"], plan["item_starts"]
        self.width = len(df) + len(self.parts) + len(self.pairs) + len(self.item_parts)
        items = len(self.item_starts)
        self.floor = np.ones(items, dtype=np.int64)
        self.best = np.zeros((4, 0), dtype=np.int64)  # item, score, whether the id is known, id
        self.waiting: list[np.ndarray] = []

    def scores(self, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """A row per item and a column per document; `doc`, `term` and `tf` are the documents' counts."""
        m = 100 - LENGTH_SHARE + LENGTH_SHARE * n * self.documents // self.length
        leaf = np.zeros((len(self.weight), len(n)), dtype=np.int64)
        leaf[term, doc] = self.weight[term] * (FULL * tf // (TF_SCALE * tf + LENGTH_SCALE * m[doc]))
        node = np.empty((len(self.starts) + len(self.pairs), len(n)), dtype=np.int64)
        node[: len(self.starts)] = np.add.reduceat(leaf[self.parts] * self.times[:, None], self.starts, axis=0)
        for k, (a, b) in enumerate(self.pairs, len(self.starts)):
            np.add(node[a], node[b], out=node[k])
        return np.add.reduceat(node[self.item_parts], self.item_starts, axis=0)

    def add(self, ids: np.ndarray, known: np.ndarray, scores: np.ndarray) -> None:
        item, at = np.nonzero(scores >= self.floor[:, None])
        self.waiting.append(np.stack([item, scores[item, at], known[at], ids[at]]))
        if sum(w.shape[1] for w in self.waiting) > 4 * self.top * len(self.floor):
            self.choose()

    def choose(self) -> np.ndarray:
        """The best `top` documents of each item: highest score, then a missing id, then the smallest id."""
        rows = np.concatenate([self.best, *self.waiting], axis=1)
        rows = rows[:, np.lexsort((rows[3], rows[2], -rows[1], rows[0]))]
        first = np.searchsorted(rows[0], np.arange(len(self.floor)))
        place = np.arange(rows.shape[1]) - first[rows[0]]
        self.best, self.waiting = rows[:, place < self.top], []
        last = place == self.top - 1
        self.floor[rows[0, last]] = np.maximum(rows[1, last], 1)
        return self.best


def _best(task):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*task.value)
        step = max(1, CELLS // scorer.width)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                ends = batch.column("terms")
                n, ids = batch.column("n").to_numpy(), batch.column("doc_id")
                sizes = ends.value_lengths().to_numpy(zero_copy_only=False)
                scorer.add(
                    ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64),
                    scorer.scores(n, np.repeat(np.arange(len(n)), sizes), ends.flatten().to_numpy(), batch.column("times").flatten().to_numpy()))
        item, score, known, ids = scorer.choose()
        yield pa.RecordBatch.from_arrays(
            [pa.array(item.astype(np.int32)), pa.array(ids, mask=known == 0), pa.array(score)], ["at", "doc_id", "score"])

    return run


def _compiled(rows: list) -> dict:
    """Arrays of a block's plan, sums and items laid out one after the other."""
    by_kind: dict[str, list] = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["at"]):
        by_kind[r["kind"]].append(r)

    def flat(kind: str, column: str) -> np.ndarray:
        return np.array([v for r in by_kind[kind] for v in r[column]], dtype=np.int64)

    def starts(kind: str) -> np.ndarray:
        return np.cumsum([0, *(len(r["parts"]) for r in by_kind[kind])])[:-1].astype(np.int64)

    return {
        "parts": flat("sum", "parts"), "times": flat("sum", "times"), "starts": starts("sum"), "pairs": [tuple(r["parts"]) for r in by_kind["pair"]],
        "item_parts": flat("item", "parts"), "item_starts": starts("item"), "words": {bytes(r["term"]): r["at"] for r in by_kind["term"]},
    }


def _ranked(rows: DataFrame, by: list[str], top: int) -> DataFrame:
    best = Window.partitionBy(*by).orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Return item_id, rank, doc_id, score: the `top` best documents of every item with a score above 0.

    Ids of documents are integers. Documents with null, empty or blank texts have no terms and count nowhere; a text may be of any
    length and is read in pieces. Equal scores stand by id, a null id first. A row that repeats an id is a document of its own. Rows of
    one item id are one item, which holds the terms of its distinct texts; a null id is an item like others; an item without terms, or
    whose terms no document holds, has no rows. An empty table on either side gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    kind = items.schema[item_id].dataType.simpleString()
    wanted = item_terms(items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").alias("text")))
    mined = wanted.groupBy("block").applyInArrow(lambda key, block: _mined(key, block), "block int, " + PLAN.format(kind))
    plans = stored(mined, "search_plans")
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text")).where("text is not null")
    out = None
    for (block,) in sorted(plans.select("block").distinct().collect()):
        own = plans.where(F.col("block") == block)
        plan = _compiled(own.drop("item_id").collect())  # a block: its size is bounded by BLOCK_TERMS
        words = spark.sparkContext.broadcast(plan.pop("words"))
        counts = stored(map_batches(source, _count_terms(words), "doc_id long, n long, terms array<int>, times array<long>").where("n > 0"), "term_counts")
        documents_, length = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(words.value), dtype=np.int64)
        for term, n in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # terms of the block
            df[term] = n
        task = spark.sparkContext.broadcast((plan, df, documents_, length, top))
        best = stored(map_batches(counts.where(F.size("terms") > 0), _best(task), "at int, doc_id long, score long"), "search_best")
        words.unpersist()
        task.unpersist()
        best = _ranked(best.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))), ["at", "salt"], top)
        named = _ranked(best, ["at"], top).join(own.where("kind = 'item'").select("at", "item_id"), "at").select("item_id", "rank", "doc_id", "score")
        out = named if out is None else out.unionByName(named)
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long") if out is None else out


def _mined(key: tuple, block: pa.Table) -> pa.Table:
    found = _mine(block)
    return found.add_column(0, "block", pa.array([key[0].as_py()] * found.num_rows, pa.int32()))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH term(doc_id, row_no, t) AS (
  SELECT doc_id, row_no, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))
  FROM (SELECT doc_id, text, row_number() OVER () AS row_no FROM documents)
), tf AS (SELECT doc_id, row_no, t, count(*) AS tf FROM term GROUP BY ALL),
n AS (SELECT row_no, sum(tf)::BIGINT AS n FROM tf GROUP BY row_no),
size AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM n),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, size GROUP BY t, docs),
q AS (
  SELECT item_id, t, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
    FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL
), scored AS (
  SELECT item_id, doc_id, row_no, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // length))))::BIGINT AS score
  FROM q JOIN w USING (t) JOIN tf USING (t) JOIN n USING (row_no), size GROUP BY item_id, doc_id, row_no
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
