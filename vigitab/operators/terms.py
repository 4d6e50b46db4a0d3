"""Terminology: lookup index, cascade, hierarchy, quarantine, yield audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as X

# (kind, key form) in the order in which a term is looked up
LEVELS = [(k, f) for k in ("PREFERRED", "LOWER", "HISTORY") for f in ("EXACT", "FOLDED", "ALNUM")]


def redirect_history(history: DataFrame, preferred: DataFrame, children: DataFrame) -> DataFrame:
    """Retired term to the current code, or to the parent of a current child; others drop out."""
    cur = preferred.select(F.col("code").alias("target"), F.col("code").alias("_c"))
    kid = children.select(F.col("code").alias("target"), F.col("parent").alias("_p"))
    return (
        history.join(cur, "target", "left").join(kid, "target", "left")
        .withColumn("code", F.coalesce("_c", "_p")).where("code IS NOT NULL").select("term", "old_code", "code")
    )


def with_term_keys(terms: DataFrame, term: str = "term") -> DataFrame:
    """Distinct terms with their three keys; the Unicode helper only sees each spelling once."""
    return terms.select(term).distinct().select(
        term, F.col(term).alias("k1"), X.norm_l1(F.col(term)).alias("k2"), X.norm_l2(F.col(term)).alias("k3")
    )


def _key_rows(keyed: DataFrame, first: int, carry: Sequence[str]) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(first + i).alias("level"), F.col(f"k{i + 1}").alias("key")) for i in range(3)])
    return keyed.select(*carry, F.explode(arr).alias("_k")).select(*carry, "_k.level", "_k.key").where("key <> ''")


def build_term_index(preferred: DataFrame, lower: DataFrame, history: DataFrame) -> DataFrame:
    """(level, key) → sorted candidate codes for nine levels."""
    parts = []
    for i, src in enumerate((preferred.select("term", "code"), lower.select("term", F.col("parent").alias("code")), history.select("term", "code"))):
        keyed = src.join(with_term_keys(src), "term")
        parts.append(_key_rows(keyed, 3 * i + 1, ["code"]))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("level", "key").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def map_terms_cascade(terms: DataFrame, index: DataFrame, hierarchy: DataFrame | None = None) -> DataFrame:
    """First level with any candidate decides: one code maps, several stop as ambiguous.

    With a hierarchy (see ``primary_hierarchy``) a code without a unique branch gives no mapping either.
    """
    keyed = with_term_keys(terms)
    probes = _key_rows(keyed, 1, ["term"])
    probes = probes.withColumn("level", F.explode(F.array(*[F.col("level") + 3 * i for i in range(3)])))
    hits = probes.join(index, ["level", "key"]).groupBy("term").agg(
        F.min("level").alias("level"), F.min_by("codes", "level").alias("codes")
    )
    out = terms.join(hits, "term", "left")
    n = F.size("codes")
    status = F.when(F.col("level").isNull(), "UNRESOLVED").when(n == 1, "MAPPED").otherwise("AMBIGUOUS")
    out = out.withColumn("status", status).withColumn("code", F.when(n == 1, F.element_at("codes", 1)))
    if hierarchy is None:
        return out
    sound = hierarchy.where("hierarchy_status = 'RESOLVED'").select("code", F.lit(True).alias("_sound"))
    lost = (F.col("status") == "MAPPED") & F.col("_sound").isNull()
    out = out.join(sound, "code", "left").withColumn("status", F.when(lost, "UNRESOLVED_HIERARCHY").otherwise(F.col("status")))
    return out.withColumn("code", F.when(F.col("status") == "MAPPED", F.col("code"))).drop("_sound")


def primary_hierarchy(h: DataFrame, attrs: Sequence[str] = ("middle", "top")) -> DataFrame:
    """Unique branch per code among the flagged branches (all branches when none is flagged)."""
    branch = F.struct(*attrs)
    prim = F.col("primary_flag") == "Y"
    g = h.groupBy("code").agg(
        F.collect_set(F.when(prim, branch)).alias("_p"), F.collect_set(branch).alias("_a")
    )
    use = F.when(F.size("_p") > 0, F.col("_p")).otherwise(F.col("_a"))
    one = F.size(use) == 1
    return g.select(
        "code", F.when(one, "RESOLVED").otherwise("UNRESOLVED_HIERARCHY").alias("hierarchy_status"),
        F.size(use).cast("long").alias("branches"),
        *[F.when(one, F.element_at(use, 1)[a]).alias(a) for a in attrs],
    )


def quarantine_conflicts(mapped: DataFrame) -> DataFrame:
    """Blank every row whose normalised term leads to several codes."""
    norms = mapped.select("term").distinct().select("term", X.norm_l2(F.col("term")).alias("norm"))
    rows = mapped.join(norms, "term")
    clash = rows.groupBy("norm").agg(F.countDistinct("code").alias("_n")).where("_n > 1").select("norm", F.lit(True).alias("_bad"))
    bad = F.coalesce("_bad", F.lit(False))
    return (
        rows.join(clash, "norm", "left").withColumn("status", F.when(bad, "QUARANTINED").otherwise(F.col("status")))
        .withColumn("code", F.when(~bad, F.col("code"))).drop("_bad")
    )


def classify_legacy(legacy: DataFrame, mapped: DataFrame, preferred: DataFrame) -> DataFrame:
    """Defect class of an old (term, name, code) triple against the new mapping."""
    new = mapped.select("term", F.col("code").alias("new_code"), F.col("status").alias("new_status"))
    names = preferred.select(F.col("code").alias("old_code"), F.col("term").alias("code_name"))
    cls = (
        F.when(F.col("old_code").isNull(), "NO_OLD_CODE").when(F.col("new_code").isNull(), "NEW_UNRESOLVED")
        .when(F.col("code_name").isNull(), "OLD_CODE_UNKNOWN").when(F.col("code_name") != F.col("old_name"), "OLD_NAME_MISMATCH")
        .when(F.col("old_code") != F.col("new_code"), "CODE_CHANGED").otherwise("CONSISTENT")
    )
    return legacy.join(new, "term", "left").join(names, "old_code", "left").withColumn("defect", cls)


def mapping_yield(mapped: DataFrame) -> DataFrame:
    """Terms and weighted rows per status and level, with percentages of all."""
    g = mapped.groupBy("status", "level").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("rows"))
    terms, rows = mapped.agg(F.count(F.lit(1)).alias("t")).scalar(), mapped.agg(F.sum("n").alias("r")).scalar()
    return g.select("status", "level", "terms", "rows", N.pct("terms", terms).alias("terms_pct"), N.pct("rows", rows).alias("rows_pct"))


def mapping_failures(mapped: DataFrame) -> DataFrame:
    """Integrity failures that must be zero."""
    ok = F.col("status") == "MAPPED"
    return mapped.agg(
        F.count(F.when(ok & F.col("code").isNull(), 1)).alias("mapped_without_code"),
        F.count(F.when(~ok & F.col("code").isNotNull(), 1)).alias("code_without_mapping"),
        (F.count(F.lit(1)) - F.countDistinct("term")).alias("repeated_terms"),
    )


def vocabulary_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Shared codes of two vocabularies and the share of each that is covered."""
    a = left.select("code").distinct().withColumn("_l", F.lit(1))
    b = right.select("code").distinct().withColumn("_r", F.lit(1))
    return a.join(b, "code", "full").agg(
        F.count("_l").alias("left_codes"), F.count("_r").alias("right_codes"),
        F.count(F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), 1)).alias("shared"),
    ).withColumn("left_covered_pct", N.pct("shared", "left_codes")).withColumn("right_covered_pct", N.pct("shared", "right_codes"))


def bijection_audit(df: DataFrame, code: str, name: str) -> DataFrame:
    """Codes with several names and names with several codes."""
    def many(key, other):
        return df.groupBy(key).agg(F.countDistinct(other).alias("_n")).agg(
            F.count(F.lit(1)).alias("values"), F.count(F.when(F.col("_n") > 1, 1)).alias("with_several"))
    return many(code, name).select(F.lit("code").alias("side"), "values", "with_several").unionAll(
        many(name, code).select(F.lit("name").alias("side"), "values", "with_several"))
