"""Data-quality audits: every audit is one or two aggregations and returns a table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import numeric as N
from ..functions import text as X
from .describe import stack


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def grain_audit(tables: dict[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Rows, distinct keys, repeats and null key parts per table."""
    parts = []
    for name, (df, key) in tables.items():
        null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
        per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.max(null).alias("_null"))
        parts.append(per_key.agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("keys"),
            F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("repeats"),
            F.coalesce(F.sum(F.when(F.col("_null"), F.col("_n"))), F.lit(0)).alias("null_keys"),
        ).withColumn("table_name", F.lit(name)))
    return _union(parts)


def fk_audit(children: dict[str, tuple[DataFrame, str]], parent: DataFrame, key: str) -> DataFrame:
    """Rows and distinct ids of every child table without a parent."""
    ids = parent.select(F.col(key).alias("_k")).distinct()
    parts = []
    for name, (df, c) in children.items():
        lost = df.select(F.col(c).alias("_k")).join(ids, "_k", "left_anti")
        parts.append(lost.agg(F.count(F.lit(1)).alias("orphan_rows"), F.countDistinct("_k").alias("orphan_ids")).withColumn("child", F.lit(name)))
    return _union(parts)


def period_coverage(df: DataFrame, day: str) -> DataFrame:
    return df.agg(
        F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.countDistinct(F.trunc(day, "month")).alias("months"),
        F.count(F.when(F.col(day).isNull(), 1)).alias("null_days"), F.count(F.lit(1)).alias("rows"),
    )


def revision_audit(df: DataFrame, key: str, revision: str) -> DataFrame:
    """How many ids have how many rows and known revisions."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows_per_id"), F.countDistinct(revision).alias("revisions"))
    return g.groupBy("rows_per_id", "revisions").agg(F.count(F.lit(1)).alias("ids"))


def category_audit(df: DataFrame, c: str, case: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(c).cast("string"), F.lit("MISSING")).alias("category")).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(case).alias("cases")
    )


def field_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Filled, blank and null counts of text fields."""
    long = stack(df, [], columns, "string")
    blank = F.col("value").isNotNull() & (F.trim("value") == "")
    return long.groupBy("variable").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(X.non_blank("value"), 1)).alias("filled"),
        F.count(F.when(blank, 1)).alias("blank"), F.count(F.when(F.col("value").isNull(), 1)).alias("missing"),
    ).withColumn("filled_pct", N.pct("filled", "rows"))


def mapped_by_year(df: DataFrame, year: Column, mapped: Column) -> DataFrame:
    return df.groupBy(year.alias("year")).agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(mapped, 1)).alias("mapped")
    ).withColumn("mapped_pct", N.pct("mapped", "rows"))


def unmapped_by_field(df: DataFrame, columns: Sequence[str], known: DataFrame, name: str) -> DataFrame:
    """Non-blank values without a mapping, per field."""
    long = stack(df, [], columns, "string").where(X.non_blank("value")).groupBy("variable", "value").agg(F.count(F.lit(1)).alias("_n"))
    lost = long.join(known.select(F.col(name).alias("value")).distinct(), "value", "left_anti")
    return lost.groupBy("variable").agg(F.sum("_n").alias("unmapped_rows"), F.count(F.lit(1)).alias("unmapped_values"))


def multi_value_loss(df: DataFrame, c: str, sep: str, kept: str) -> DataFrame:
    """Rows with several values in one field and how many values a single-value column would lose."""
    n = F.size(F.split(F.col(c), sep))
    return df.where(X.non_blank(c)).agg(
        F.count(F.lit(1)).alias("filled"), F.count(F.when(n > 1, 1)).alias("multi_valued"), F.sum(n - 1).alias("values_beyond_first"),
        F.count(F.when((n > 1) & F.col(kept).isNotNull(), 1)).alias("multi_valued_kept_one"),
    )


def outcome_totals(df: DataFrame, case: str, flag: Column, known: Column) -> DataFrame:
    """Completeness at row and at case level."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(known, 1)).alias("known_rows"), F.count(F.when(flag, 1)).alias("flag_rows"),
        F.countDistinct(case).alias("cases"), F.countDistinct(F.when(known, F.col(case))).alias("known_cases"),
        F.countDistinct(F.when(flag, F.col(case))).alias("flag_cases"),
    )


def date_precision(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Text dates by precision: day, month, year, other or missing, for every field."""
    long = stack(df, [], fields, "string")
    v = F.col("value")
    level = (
        F.when(~F.coalesce(X.non_blank("value"), F.lit(False)), "MISSING").when(X.safe_date(v).isNotNull() & (F.length(v) == 8), "DAY")
        .when(F.regexp_like(v, F.lit("^[0-9]{6}$")), "MONTH").when(F.regexp_like(v, F.lit("^[0-9]{4}$")), "YEAR").otherwise("OTHER")
    )
    return long.groupBy("variable", level.alias("precision")).agg(F.count(F.lit(1)).alias("rows"))


def pairing_structure(exposures: DataFrame, events: DataFrame, case: str) -> DataFrame:
    """Cases by number of exposures and events, and the pairs they would make."""
    a = exposures.groupBy(case).agg(F.count(F.lit(1)).alias("exposures"))
    b = events.groupBy(case).agg(F.count(F.lit(1)).alias("events"))
    j = a.join(b, case)
    return j.groupBy("exposures", "events").agg(F.count(F.lit(1)).alias("cases")).withColumn(
        "pairs", F.col("cases") * F.col("exposures") * F.col("events")
    )


def hierarchy_coverage(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("codes"), *[F.count(c).alias(f"with_{c}") for c in levels])


def shared_ids(df: DataFrame, ident: str, case: str) -> DataFrame:
    """Report ids used by several cases: why single-key joins are unsafe."""
    return df.groupBy(ident).agg(F.countDistinct(case).alias("cases"), F.count(F.lit(1)).alias("rows")).where("cases > 1")


def reconcile(actual: DataFrame, expected: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Named counts against an expected table; a metric missing on one side fails."""
    a = actual.select("metric", F.col("value").cast("double").alias("actual"))
    e = expected.select("metric", F.col("value").cast("double").alias("expected"))
    ok = F.coalesce(F.abs(F.col("actual") - F.col("expected")) <= tolerance, F.lit(False))
    return a.join(e, "metric", "full").withColumn("passed", ok)


def boundary_scan(docs: DataFrame, ident: str, text: str, limit: int) -> DataFrame:
    """Documents that contain secrets, keys, local paths or exceed a size; whole texts are searched."""
    t = F.col(text)
    checks = [F.when(F.regexp_like(t, F.lit(p)), F.lit(label)) for label, p in fixed.BOUNDARY_PATTERNS.items()]
    checks.append(F.when(F.octet_length(t) > limit, F.lit("oversized")))
    return docs.select(ident, F.explode(F.array_compact(F.array(*checks))).alias("violation"))


def forbidden_columns(df: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """Columns whose name holds a forbidden token, with the number of rows they carry."""
    bad = [c for c in df.columns if any(tok in c.lower() for tok in tokens)]
    pairs = F.array(*[F.lit(c) for c in bad]) if bad else F.array().cast("array<string>")
    return df.agg(F.count(F.lit(1)).alias("rows")).select(F.explode(pairs).alias("column_name"), "rows")


def table_checks(df: DataFrame, key: Sequence[str], count: str, total: str, percent: str) -> DataFrame:
    """Published-table rules: unique labels, counts within totals, percent equal to the ratio."""
    per = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.when(F.col(count) > F.col(total), 1).otherwise(0)).alias("_over"),
                               F.sum(F.when(F.abs(F.col(percent) - N.pct(count, total)) > 1e-9, 1).otherwise(0)).alias("_off"))
    return per.agg(F.sum("_n").alias("rows"), F.sum(F.col("_n") - 1).alias("repeated_labels"), F.sum("_over").alias("count_above_total"), F.sum("_off").alias("percent_off"))
