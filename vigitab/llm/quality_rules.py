"""Quality rules: counts of one document, and the divergence of its histograms from its language's.

Two histograms are compared by Jensen-Shannon distance: character classes, and common words of the language with one bin for all others.
The references are counted over all documents. A histogram of a short text is noisy, so a test starts at a minimum length and its bound
is widened by the distance that sampling alone gives.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import HOT_SHARE, SPACE, documents, join_groups, let, stored, whole_text

#: Patterns of the character classes, taken away one after the other; what is left is the class "other".
CLASSES = {"lower": r"\p{Ll}+", "letter": r"\p{L}+", "space": f"{SPACE}+", "digit": r"\p{N}+", "stop": r"[.,;:!?'\x22()\x2D]+", "symbol": r"[#*$%&|<>]+"}
WINDOW = 8
COMMON_WORDS = 24
#: (least length, bound of the distance): class histogram by characters, word histogram by words.
CLASS_TEST, WORD_TEST = (200, 0.25), (60, 0.30)
#: A language with less text than this many times a test's least length has no histogram for it.
LEAST_REFERENCE = 50


def repeated_words(hashes: Column) -> Column:
    """Words that lie in windows of WINDOW words found twice or more, from the words' hashes."""
    n = F.size(hashes)
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))).otherwise(
        F.array().cast("array<bigint>"))

    def cover(found: Column) -> Column:
        placed = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            return F.filter(s, lambda x, j: F.coalesce(x["h"] == F.get(s, j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False)))

        starts = F.array_sort(F.transform(let(placed, twice), lambda x: x["i"].cast("long")))
        begin = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).cast("long").alias("last"))
        return F.aggregate(starts, begin, lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")))["n"]

    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(cover(w)))


def counted(docs: DataFrame, text: str) -> DataFrame:
    """Append the class counts n_<class>, n_other, the words and n_words."""
    out = docs.withColumns({"__left": whole_text(text), "words": F.array_remove(F.split(whole_text(text), f"{SPACE}+"), "")})
    for name, pattern in CLASSES.items():
        out = out.withColumn("__rest", F.regexp_replace("__left", pattern, ""))
        out = out.withColumn(f"n_{name}", (F.char_length("__left") - F.char_length("__rest")).cast("long")).drop("__left").withColumnRenamed("__rest", "__left")
    return out.withColumns({"n_other": F.char_length("__left").cast("long"), "n_words": F.size("words").cast("long")}).drop("__left")


def shares(counts: Column) -> Column:
    """Counts as shares of their sum."""
    return let(counts, lambda c: let(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), lambda s: F.transform(c, lambda x: x / F.greatest(s, F.lit(1.0)))))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence in bits of two arrays of shares."""
    half = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b)) / 2).otherwise(F.lit(0.0))
    return F.sqrt(F.greatest(F.aggregate(F.zip_with(p, q, lambda a, b: half(a, b) + half(b, a)), F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def bound(test: tuple[int, float], bins: int, n: Column) -> Column:
    """The test's bound with four times the divergence that n draws from the reference itself give on average."""
    return F.sqrt(F.lit(test[1] ** 2) + bins / (2 * log(2)) / n)


CLASS_COUNTS = [f"n_{c}" for c in (*CLASSES, "other")]


def references(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """One row per non-null language: n_docs, class_shares, common (words, most frequent first), word_shares (with one bin for the rest).

    Common words are words with a thousandth of the language's words or more, COMMON_WORDS at most. The shares are null where the language
    has less than LEAST_REFERENCE times the text of the shortest document tested.
    """
    base = counted(docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text")), "text")
    classes = stored(base.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), *(F.sum(c).cast("double").alias(c) for c in CLASS_COUNTS), F.sum("n_words").cast("double").alias("n_words")), "class_sums")
    words = stored(base.select("lang", F.explode("words").alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "word_counts")
    sizes = stored(words.groupBy("lang").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("distinct")), "word_sums")
    frequent = join_groups(words, sizes, "lang", words.count(), "distinct").where(F.col("n") * HOT_SHARE >= F.col("all"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))  # of at most HOT_SHARE words
    top = frequent.withColumn("rank", rank).where(F.col("rank") <= COMMON_WORDS).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("rank", "word", "n"))).alias("top"))
    out = classes.join(top, "lang", "left").withColumn("top", F.coalesce("top", F.array().cast(top.schema["top"].dataType)))
    hits = F.aggregate("top", F.lit(0.0), lambda a, x: a + x["n"])
    n_chars = sum(F.col(c) for c in CLASS_COUNTS)
    return out.select(
        "lang", "n_docs", F.when(n_chars >= LEAST_REFERENCE * CLASS_TEST[0], shares(F.array(*CLASS_COUNTS))).alias("class_shares"), F.transform("top", lambda x: x["word"]).alias("common"),
        F.when(F.col("n_words") >= LEAST_REFERENCE * WORD_TEST[0], shares(F.concat(F.transform("top", lambda x: x["n"].cast("double")), F.array(F.col("n_words") - hits)))).alias("word_shares"))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Return doc_id, lang, the counts, base_failed, class_distance, word_distance (null below the tests' least lengths) and kept.

    A null text counts as empty: no words, base_failed. A document is compared with its own language only: where that is null or has too
    little text for a histogram, the distances are null and the counts decide alone. Rows that repeat an id are judged one by one. An
    empty table gives an empty result. Other columns are not read.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    refs = stored(references(source, "text", "lang"), "references")
    total = refs.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    judged = join_groups(source, refs, "lang", total, "n_docs").unionByName(source.where(F.col("lang").isNull()), allowMissingColumns=True)
    lines = F.filter(F.split(whole_text("text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    rows = counted(judged, "text").select(
        "doc_id", "lang", "words", *CLASS_COUNTS, "n_words", let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(hashes, repeated_words).alias("n_repeat_words"), "class_shares", F.coalesce("common", F.array().cast("array<string>")).alias("common"), "word_shares")
    places = F.filter(F.transform("words", lambda w: F.array_position(F.col("common"), w)), lambda k: k > 0)
    numbers = F.when(F.size("common") > 0, F.sequence(F.lit(1), F.greatest(F.size("common"), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    seen = let(places, lambda p: F.concat(
        F.transform(numbers, lambda k: F.size(F.filter(p, lambda x: x == k)).cast("double")), F.array((F.col("n_words") - F.size(p)).cast("double"))))
    n_chars = sum(F.col(c) for c in CLASS_COUNTS)
    rows = rows.withColumns({
        "class_distance": F.when((n_chars >= CLASS_TEST[0]) & F.col("class_shares").isNotNull(), js_distance(shares(F.array(*(F.col(c).cast("double") for c in CLASS_COUNTS))), F.col("class_shares"))),
        "word_distance": F.when((F.col("n_words") >= WORD_TEST[0]) & F.col("word_shares").isNotNull(), js_distance(shares(seen), F.col("word_shares"))),
        "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        "word_chars": n_chars - F.col("n_space"), "n_symbols": F.col("n_symbol"),
    })
    far = F.coalesce(F.col("class_distance") > bound(CLASS_TEST, len(CLASS_COUNTS), n_chars), F.lit(False)) | F.coalesce(
        F.col("word_distance") > bound(WORD_TEST, COMMON_WORDS + 1, F.col("n_words")), F.lit(False))
    return rows.select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"),
        "class_distance", "word_distance")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).drop("lang")
