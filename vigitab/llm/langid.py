"""Language identification by interpolated Kneser-Ney character language models.

Trigrams of folded text (lower-case letters, one blank for every run of other characters) are counted per language over all training
rows. Lower orders follow from the distinct trigrams. Discounts and totals are taken over whole tables; the most frequent n-grams are stored,
with the models of all languages side by side in sorted arrays of hashed n-grams, so one search serves every language. A text gets the language of the lowest cross-entropy per character; how far
that is trusted, and when it is rejected, is calibrated on the training rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_batches, stored, whole_text

UNKNOWN = "und"
BLANK, LETTER_BITS = 32, 21
LOW, ONE, SHIFT = np.uint64((1 << 2 * LETTER_BITS) - 1), np.uint64((1 << LETTER_BITS) - 1), np.uint64(LETTER_BITS)
#: Stored letters, pairs and trigrams of all languages together, so no corpus makes the broadcast model larger.
ROOM = (1 << 18, 1 << 20, 1 << 22)
CHUNK = 1 << 20
#: Standard deviations above the language's mean cross-entropy from which on a text is rejected, and the least trusted confidence.
REJECT_AT, LEAST_SCORE = 8.0, 0.3
MARGIN_BINS = 24


@cache
def folding() -> np.ndarray:
    """Folded code point of every code point: a letter's lower case, or BLANK."""
    table = np.full(0x110000, BLANK, dtype=np.uint32)
    for code in range(0x110000):
        letter = chr(code)
        if letter.isalpha():
            small = letter.lower()
            table[code] = ord(small) if len(small) == 1 else code
    return table


def folded(text: str) -> np.ndarray:
    """Folded code points between two leading blanks and a final one."""
    codes = folding()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    codes = np.concatenate(([BLANK, BLANK], codes, [BLANK])).astype(np.uint64)
    again = (codes[1:] == BLANK) & (codes[:-1] == BLANK)
    again[0] = False
    return codes[np.r_[True, ~again]]


def hashed(codes: np.ndarray) -> np.ndarray:
    """Hash of packed n-grams; an odd factor, so that different n-grams have different hashes."""
    return codes * np.uint64(0x9E3779B97F4A7C15)


def trigrams(codes: np.ndarray) -> np.ndarray:
    return codes[:-2] << np.uint64(2 * LETTER_BITS) | codes[1:-1] << np.uint64(LETTER_BITS) | codes[2:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts by language, given out whenever about 2 * CHUNK trigrams are held."""
    held: dict[str, list[np.ndarray]] = {}
    n = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            grams, counts = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(counts)], ["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            found = trigrams(folded(text.as_py()))
            held.setdefault(lang, []).append(found)
            n += len(found)
            if n >= 2 * CHUNK:
                yield from flush()
                n = 0
    yield from flush()


def trigram_counts(rows: DataFrame) -> DataFrame:
    """lang, gram, n over all rows of (lang, text)."""
    return map_batches(rows, _count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Table:
    """Sorted n-gram hashes, each with a value in some of the languages: the values of key i are those from starts[i] to starts[i + 1]."""

    keys: np.ndarray
    starts: np.ndarray
    langs: np.ndarray
    values: np.ndarray

    @staticmethod
    def of(grams: np.ndarray, langs: np.ndarray, values: np.ndarray) -> Table:
        keys = hashed(grams)
        order = np.lexsort((langs, keys))
        keys, starts = np.unique(keys[order], return_index=True)
        return Table(keys, np.r_[starts, len(order)].astype(np.int64), langs[order].astype(np.int32), values[order].astype(np.float32))

    def add(self, grams: np.ndarray, times: np.ndarray, total: np.ndarray) -> None:
        """Add to the total of each language its values for the grams, times their number."""
        if not len(self.keys):
            return
        keys = hashed(grams)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        at, times = at[known], times[known]
        first, n = self.starts[at], self.starts[at + 1] - self.starts[at]
        cells = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        total += np.bincount(self.langs[cells], weights=self.values[cells] * np.repeat(times, n), minlength=len(total))


def discount(ones: int, twos: int) -> float:
    """Kneser-Ney discount from the numbers of n-grams counted once and twice."""
    return ones / (ones + 2 * twos) if ones and twos else 0.5


@dataclass
class Order:
    """Stored n-grams of one order: language (its place by name), n-gram, count, and the count of all n-grams of its context, stored or not."""

    lang: np.ndarray
    gram: np.ndarray
    n: np.ndarray
    total: np.ndarray
    discounts: np.ndarray  # by language, from all n-grams

    def of(self, lang: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        own = slice(*np.searchsorted(self.lang, [lang, lang + 1]))
        return self.gram[own], self.n[own], self.total[own], float(self.discounts[lang])


def whole_orders(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> tuple[list[Order], int]:
    """The orders one to three of trigram counts by language, nothing left out, and the number of different letters."""
    parts: list[list[tuple]] = [[], [], []]
    discounts = np.zeros((3, len(counts)))
    for k, name in enumerate(sorted(counts)):
        gram, n = counts[name]
        for order, mask in ((2, None), (1, LOW), (0, ONE)):
            if mask is not None:
                gram, n = np.unique(gram & mask, return_counts=True)
            _, place = np.unique(gram >> SHIFT, return_inverse=True)
            parts[order].append((np.full(len(gram), k), gram, n, np.bincount(place, weights=n)[place] if len(n) else n))
            discounts[order, k] = discount(int((n == 1).sum()), int((n == 2).sum()))
    empty = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    orders = [Order(*(np.concatenate(c) for c in zip(*(p or [empty]))), d) for p, d in zip(parts, discounts)]
    return orders, len(np.unique(orders[0].gram))


class Models:
    """Interpolated Kneser-Ney trigram models of several languages over common arrays.

    An n-gram that is not stored has the probability of its shorter one times its context's weight, and that weight is all the mass that
    the context's stored n-grams leave: the probabilities after any context sum to 1, whatever is left out. Tables hold the logarithms
    that a stored n-gram or weight adds to that of an unknown letter, so what a language lacks takes no room.
    """

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self._fill(sorted(counts), *whole_orders(counts))

    @classmethod
    def of(cls, langs: list[str], orders: list[Order], letters: int) -> Models:
        models = cls.__new__(cls)
        models._fill(langs, orders, letters)
        return models

    def _fill(self, langs: list[str], orders: list[Order], letters: int) -> None:
        self.langs, unseen = langs, 1.0 / (letters + 1)
        self.unknown, self.uniform = np.zeros(len(langs)), float(np.log2(letters + 1))
        cells: list[list[tuple]] = [[], [], [], [], []]

        def find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: np.ndarray | float) -> np.ndarray:
            if not len(keys):
                return np.full(len(wanted), default)
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            return np.where(keys[at] == wanted, values[at], default)

        def stored_part(gram: np.ndarray, n: np.ndarray, total: np.ndarray, less: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Contexts of the n-grams, the weights that they leave, and the n-grams' own probabilities."""
            contexts, first, place = np.unique(gram >> SHIFT, return_index=True, return_inverse=True)
            left = total[first] - np.bincount(place, weights=n, minlength=len(contexts)) + less * np.bincount(place, minlength=len(contexts))
            return contexts, left / total[first], (n - less) / total

        for k in range(len(langs)):
            g1, n1, total1, d1 = orders[0].of(k)
            _, rest, own = stored_part(g1, n1, total1, d1)
            unknown = (rest[0] if len(rest) else 1.0) * unseen
            self.unknown[k] = np.log2(unknown)
            p1 = own + unknown
            g2, n2, total2, d2 = orders[1].of(k)
            c2, w2, own = stored_part(g2, n2, total2, d2)
            back2 = find(c2, w2, g2 >> SHIFT, 1.0) * find(g1, p1, g2 & ONE, unknown)
            p2 = own + back2
            g3, n3, total3, d3 = orders[2].of(k)
            c3, w3, own = stored_part(g3, n3, total3, d3)
            pair = g3 & LOW
            back3 = find(c3, w3, g3 >> SHIFT, 1.0) * find(g2, p2, pair, find(c2, w2, pair >> SHIFT, 1.0) * find(g1, p1, pair & ONE, unknown))
            for table, grams, values in zip(cells, (g1, c2, g2, c3, g3), (p1 / unknown, w2, p2 / back2, w3, (own + back3) / back3)):
                table.append((grams, np.full(len(grams), k), np.log2(values)))
        empty = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0))
        self.one, self.weight2, self.two, self.weight3, self.three = (Table.of(*(np.concatenate(c) for c in zip(*(t or [empty])))) for t in cells)

    def _total(self, grams: np.ndarray) -> np.ndarray:
        """Sum of the log-probabilities of trigrams in each language."""
        grams, times = np.unique(grams, return_counts=True)
        total = times.sum() * self.unknown
        pairs = grams & LOW
        for table, keys in ((self.three, grams), (self.weight3, grams >> SHIFT), (self.two, pairs), (self.weight2, pairs >> SHIFT), (self.one, pairs & ONE)):
            table.add(keys, times, total)
        return total

    def entropies(self, text: str) -> tuple[int, np.ndarray | None]:
        """Scored characters and cross-entropy in bits a character for each language; None without a letter or a language."""
        codes = folded(text)
        if not self.langs or not (codes != BLANK).any():
            return 0, None
        n = len(codes) - 2
        total = sum(self._total(trigrams(codes[at : at + CHUNK + 2])) for at in range(0, n, CHUNK))
        return n, -total / n


def shares_of_room(sizes: dict[str, int], room: int) -> int:
    """The n-grams that a language may store: the most at which all languages together store `room`; small ones leave the rest to others."""
    left = room
    for k, size in enumerate(sorted(sizes.values())):
        if size * (len(sizes) - k) > left:
            return left // (len(sizes) - k)
        left -= size
    return room


def stored_order(counts: DataFrame, langs: list[str], room: int) -> Order:
    """Statistics of all rows of counts (lang, gram, n); only the most frequent `room` of them, by shares_of_room, come to the driver."""
    n = F.col("n")
    ones = {r["lang"]: r for r in counts.groupBy("lang").agg(
        F.count(F.lit(1)).alias("size"), F.sum((n == 1).cast("long")).alias("ones"), F.sum((n == 2).cast("long")).alias("twos")).collect()}  # a row for each language
    most = shares_of_room({k: r["size"] for k, r in ones.items()}, room)
    large = [k for k, r in ones.items() if r["size"] > most]
    bars = {k: 1 for k in langs}
    if large:  # at most room / most languages; counts are rounded down to eight binary digits, so there are a few thousand steps
        steps = counts.where(F.col("lang").isin(large)).withColumn("cut", F.greatest(F.length(F.bin("n")) - 8, F.lit(0))).withColumn("step", F.expr("shiftleft(shiftright(n, cut), cut)"))
        above = dict.fromkeys(large, 0)
        bars |= dict.fromkeys(large, 1 << 62)
        for r in steps.groupBy("lang", "step").count().orderBy(F.desc("step")).collect():
            above[r["lang"]] += r["count"]
            if above[r["lang"]] <= most:
                bars[r["lang"]] = r["step"]
    bounds = counts.sparkSession.createDataFrame([(name, k, bars[name]) for k, name in enumerate(langs)], "lang string, k int, bar long")
    context = F.shiftright("gram", LETTER_BITS).alias("context")
    kept = counts.join(F.broadcast(bounds), "lang").where("n >= bar").select("lang", "k", context, "gram", "n")
    totals = counts.groupBy("lang", context).agg(F.sum("n").alias("total"))
    found = kept.join(totals, ["lang", "context"]).select("k", "gram", "n", "total").toArrow().combine_chunks()
    k, gram = found["k"].to_numpy().astype(np.int64), found["gram"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.lexsort((gram, k))
    discounts = np.array([discount(ones[name]["ones"], ones[name]["twos"]) for name in langs])
    return Order(k[order], gram[order], found["n"].to_numpy().astype(np.int64)[order], found["total"].to_numpy().astype(np.int64)[order], discounts)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", room: tuple[int, int, int] = ROOM) -> Models:
    """Models of all non-null values of `lang`, from the trigrams of all rows. Null texts are empty.

    Discounts, continuation counts and context totals are those of all n-grams; `room` bounds what is stored of each order.
    """
    one, two, three, langs = ngrams(docs, text, lang)
    if not langs:
        return Models({})
    return Models.of(langs, [stored_order(c, langs, n) for c, n in zip((one, two, three), room)], one.select("gram").distinct().count())


def ngrams(docs: DataFrame, text: str, lang: str) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """Written counts (lang, gram, n) of letters, pairs and trigrams, and the languages."""
    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), whole_text(text).alias("text"))
    three = stored(trigram_counts(rows), "trigrams")
    shorter = lambda df, mask: df.groupBy("lang", F.col("gram").bitwiseAND(F.lit(int(mask))).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    two = stored(shorter(three, LOW), "pairs")
    one = stored(shorter(two, ONE), "letters")
    return one, two, three, sorted(r[0] for r in one.select("lang").distinct().collect())


def whole_cells(orders: list[DataFrame], langs: list[str], letters: int) -> tuple[DataFrame, np.ndarray]:
    """The values that Models keeps in its five tables, of all n-grams, as rows (place, gram, k, value, n); log2 of an unknown letter by language."""
    stats = [{r["lang"]: r for r in c.groupBy("lang").agg(
        F.count(F.lit(1)).alias("size"), F.sum("n").alias("total"), F.sum((F.col("n") == 1).cast("long")).alias("ones"),
        F.sum((F.col("n") == 2).cast("long")).alias("twos")).collect()} for c in orders]  # a row for each language
    less = [[discount(s[name]["ones"], s[name]["twos"]) for name in langs] for s in stats]
    unknown = [less[0][k] * stats[0][name]["size"] / stats[0][name]["total"] / (letters + 1) for k, name in enumerate(langs)]
    told = orders[0].sparkSession.createDataFrame(
        [(name, k, float(unknown[k]), *(float(d[k]) for d in less)) for k, name in enumerate(langs)], "lang string, k int, unknown double, d1 double, d2 double, d3 double")
    cell = lambda df, place, gram, value, n: df.select(F.lit(place).alias("place"), F.col(gram).alias("gram"), "k", F.log2(value).alias("value"), F.col(n).alias("n"))
    below = orders[0].join(F.broadcast(told), "lang").join(orders[0].groupBy("lang").agg(F.sum("n").alias("total")), "lang")
    below = below.withColumn("p", (F.col("n") - F.col("d1")) / F.col("total") + F.col("unknown"))
    cells = [cell(below, 0, "gram", F.col("p") / F.col("unknown"), "n")]
    for order, mask, d in ((1, ONE, "d2"), (2, LOW, "d3")):
        grams = orders[order].withColumns({"context": F.shiftright("gram", LETTER_BITS), "short": F.col("gram").bitwiseAND(F.lit(int(mask)))})
        contexts = grams.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        contexts = contexts.join(F.broadcast(told), "lang").withColumn("weight", F.col(d) * F.col("kinds") / F.col("total"))
        grams = grams.join(contexts, ["lang", "context"]).join(below.select("lang", F.col("gram").alias("short"), F.col("p").alias("shorter")), ["lang", "short"])
        grams = grams.withColumn("back", F.col("weight") * F.col("shorter")).withColumn("p", (F.col("n") - F.col(d)) / F.col("total") + F.col("back"))
        below = stored(grams.select("lang", "k", "gram", "n", "p", "back"), "probabilities")
        cells += [cell(contexts, 2 * order - 1, "context", F.col("weight"), "total"), cell(below, 2 * order, "gram", F.col("p") / F.col("back"), "n")]
    out = cells[0]
    for more in cells[1:]:
        out = out.unionByName(more)
    return stored(out, "language_cells"), np.log2(np.array(unknown))


def whole_scores(docs: DataFrame, orders: list[DataFrame], langs: list[str], room: int, text: str = "text") -> tuple[DataFrame, float]:
    """`scores` by models of all n-grams, however many; and the bits of a letter drawn evenly.

    The most frequent n-grams, with all their languages, are broadcast, `room` values at most. Those of a text that are not among them are
    joined with the table of the others.
    """
    letters = orders[0].select("gram").distinct().count()
    cells, unknown = whole_cells(orders, langs, letters)
    tops = cells.groupBy("place", "gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "place", "gram").limit(max(1, room // len(langs))).select("place", "gram")
    tops = stored(tops, "frequent_cells")
    found = cells.join(tops, ["place", "gram"]).select("place", "gram", "k", "value").toArrow().combine_chunks()
    place, gram, k, value = (found[c].to_numpy() for c in ("place", "gram", "k", "value"))
    tables = [Table.of(gram[place == t].astype(np.int64).view(np.uint64), k[place == t], value[place == t]) for t in range(5)]
    shared = docs.sparkSession.sparkContext.broadcast((tables, unknown))
    kept = [f for f in docs.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, unknown = shared.value
        for batch in batches:
            sizes, totals, asked = [], [], []
            for value in batch.column(text):
                codes = folded(value.as_py() or "")
                total, others = np.zeros(len(unknown)), []
                n = len(codes) - 2 if (codes != BLANK).any() else 0
                if n:
                    parts = [np.unique(trigrams(codes[at : at + CHUNK + 2]), return_counts=True) for at in range(0, n, CHUNK)]
                    grams, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                    times = np.bincount(at, weights=np.concatenate([p[1] for p in parts]))
                    total += n * unknown
                    pairs = grams & LOW
                    for t, keys in ((4, grams), (3, grams >> SHIFT), (2, pairs), (1, pairs >> SHIFT), (0, pairs & ONE)):
                        tables[t].add(keys, times, total)
                        missed = ~np.isin(hashed(keys), tables[t].keys)
                        rest, at = np.unique(keys[missed], return_inverse=True)
                        for g, c in zip(rest.tolist(), np.bincount(at, weights=times[missed], minlength=len(rest)).tolist()):
                            others.append({"place": t, "gram": g, "times": c})
                sizes.append(n)
                totals.append(total.tolist())
                asked.append(others)
            kind = pa.list_(pa.struct([("place", pa.int32()), ("gram", pa.int64()), ("times", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), pa.array(sizes, pa.int64()), pa.array(totals, pa.list_(pa.float64())), pa.array(asked, kind)],
                [*(f.name for f in kept), "letters", "totals", "asked"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "letters long, totals array<double>, asked array<struct<place:int,gram:bigint,times:double>>"])
    rows = stored(map_batches(docs, run, schema).withColumn("__row", F.monotonically_increasing_id()), "partial_scores")
    rest = cells.join(tops, ["place", "gram"], "left_anti")
    added = rows.select("__row", F.explode("asked").alias("a")).select("__row", "a.*").join(rest, ["place", "gram"])
    added = added.groupBy("__row", "k").agg(F.sum(F.col("value") * F.col("times")).alias("more")).groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("k", "more"))).alias("more"))
    bits = F.expr("transform(totals, (x, i) -> -(x + coalesce(try_element_at(more, i), 0D)) / letters)")
    met = rows.join(added, "__row", "left").where("letters > 0").withColumn("bits", bits).withColumn("entropy", F.array_min("bits"))
    best = F.get(F.array(*(F.lit(name) for name in langs)), (F.array_position("bits", F.col("entropy")) - 1).cast("int"))
    margin = F.expr("sort_array(bits)[1] - entropy") if len(langs) > 1 else F.lit(1.0)
    names = [F.col(f"`{f.name}`") for f in kept]
    none = rows.where("letters = 0").select(*names, F.lit(UNKNOWN).alias("lang_pred"), *(F.lit(None).cast("double").alias(c) for c in ("entropy", "margin")), "letters")
    return met.select(*names, best.alias("lang_pred"), "entropy", margin.alias("margin"), "letters").unionByName(none), float(np.log2(letters + 1))


def scores(docs: DataFrame, models: Models, text: str = "text") -> DataFrame:
    """Replace `text` by lang_pred, entropy, margin (bits a character to the next language) and letters (characters scored)."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    kept = [f for f in docs.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            out = []
            for value in batch.column(text):
                n, bits = models.entropies(value.as_py() or "")
                if bits is None:
                    out.append((UNKNOWN, None, None, 0))
                else:
                    best, *others = np.argsort(bits, kind="stable").tolist()
                    out.append((models.langs[best], float(bits[best]), float(bits[others[0]] - bits[best]) if others else 1.0, n))
            columns = [pa.array(v, t) for v, t in zip(zip(*out) if out else [()] * 4, (pa.string(), pa.float64(), pa.float64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *columns], [*(f.name for f in kept), "lang_pred", "entropy", "margin", "letters"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "lang_pred string, entropy double, margin double, letters long"])
    return map_batches(docs, run, schema)


def margin_bin() -> Column:
    """Bin of the whole text's margin in bits, on a scale of half powers of two."""
    bits = F.greatest(F.col("margin") * F.col("letters"), F.lit(1.0))
    return F.least(F.floor(2 * F.log2(bits)), F.lit(MARGIN_BINS - 1)).cast("int")


def rising(right: list[float], all_: list[float]) -> list[float]:
    """Shares of right answers by bin, made to rise by pooling neighbours that fall."""
    blocks: list[list[float]] = []
    for r, n in zip(right, all_):
        blocks.append([r, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            r2, n2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + r2, blocks[-1][1] + n2, blocks[-1][2] + k2]
    return [r / n for r, n, k in blocks for _ in range(int(k))]


def calibrated(scored: DataFrame, known: Column, uniform: float, lang: str = "lang") -> DataFrame:
    """Append score (0 to 1) and rejected, calibrated on the rows where `known` holds and `lang` is right.

    score is the share of right answers among rows of a like margin. A text is rejected if it is UNKNOWN, if its score is under
    LEAST_SCORE, or if its cross-entropy is more than REJECT_AT standard deviations above its language's mean (the variance has a part
    that falls with the length) and also nearer to `uniform`, that of letters drawn evenly, than to the mean. Without training rows the score is 0 and nothing but UNKNOWN is rejected.
    """
    rows = scored.where(known & F.col(lang).isNotNull() & (F.col("lang_pred") != UNKNOWN)).withColumn("bin", margin_bin())
    hits = {r["bin"]: (r["hit"], r["n"]) for r in rows.groupBy("bin").agg(F.sum((F.col("lang_pred") == F.col(lang)).cast("long")).alias("hit"), F.count(F.lit(1)).alias("n")).collect()}
    trained = bool(hits)
    shares = rising([hits.get(b, (0, 0))[0] + 0.5 for b in range(MARGIN_BINS)], [hits.get(b, (0, 0))[1] + 1.0 for b in range(MARGIN_BINS)])
    right = rows.where(F.col("lang_pred") == F.col(lang))
    x, short = F.col("entropy"), 1 / F.col("letters")
    moments = right.groupBy("lang_pred").agg(
        F.avg(x).alias("m"), F.avg(x * x).alias("xx"), F.avg(short).alias("s"), F.avg(short * short).alias("ss"), F.avg(x * short).alias("xs"), F.avg(x * x * short).alias("xxs"))
    limits = []
    for r in moments.collect():  # a row for each language
        a, b = max(r["xx"] - r["m"] ** 2, 0), max(r["xxs"] - 2 * r["m"] * r["xs"] + r["m"] ** 2 * r["s"], 0)
        spread = r["ss"] - r["s"] ** 2
        per_letter = max((b - a * r["s"]) / spread, 0) if spread > 1e-12 else 0.0
        limits.append((r["lang_pred"], r["m"], max(a - per_letter * r["s"], 0) + 1e-4, per_letter + 1.0))
    score = F.when(F.col("lang_pred") == UNKNOWN, 0.0).otherwise(F.get(F.array(*(F.lit(s) for s in shares)), margin_bin())) if trained else F.lit(0.0)
    bounds = scored.sparkSession.createDataFrame(limits, "lang_pred string, __mean double, __always double, __per_letter double")
    far = x > F.greatest(F.col("__mean") + REJECT_AT * F.sqrt(F.col("__always") + F.col("__per_letter") / F.col("letters")), (F.col("__mean") + F.lit(uniform)) / 2)
    return scored.join(F.broadcast(bounds), "lang_pred", "left").withColumn("score", score).withColumn(
        "rejected", (F.col("lang_pred") == UNKNOWN) | F.coalesce(far, F.lit(False)) | ((F.col("score") < LEAST_SCORE) if trained else F.lit(False))).drop("__mean", "__always", "__per_letter")


def is_held_out(doc_id: str = "doc_id") -> Column:
    """A quarter of the documents, never learned from; false for a null id, which is not learned from either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", room: tuple[int, int, int] = ROOM) -> DataFrame:
    """Return doc_id, held_out, lang_pred, score, rejected, entropy, letters for every row.

    Models and calibration come from rows that are not held out and have a non-null `lang`. A text without a letter, an empty and a null
    one are UNKNOWN, score 0, rejected; so is every text if no language was learned. Of languages with equal cross-entropy the first by
    name is taken. `room` bounds what is broadcast: further n-grams are joined, with the same result. Rows that repeat an id are judged one by one. An empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), is_held_out(doc_id).alias("held_out"))
    learn = ~F.col("held_out") & F.col("doc_id").isNotNull()
    *orders, langs = ngrams(rows.where(learn), "text", "lang")
    if any(c.count() > most for c, most in zip(orders, room)):
        found, uniform = whole_scores(rows, orders, langs, sum(room))
    else:  # every n-gram has room
        letters = orders[0].select("gram").distinct().count()
        models = Models.of(langs, [stored_order(c, langs, n) for c, n in zip(orders, room)], letters) if langs else Models({})
        found, uniform = scores(rows, models), models.uniform
    scored = stored(found, "language_scores")
    return calibrated(scored, learn, uniform).select("doc_id", "held_out", "lang_pred", "score", "rejected", "entropy", "letters")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
