"""Cohort description: balance, characteristics, missingness, profiles, display tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as X
from .aggregates import top_level
from .prefix import quantile_columns


def stack(df: DataFrame, ids: Sequence[str], variables: Sequence[str], kind: str = "double") -> DataFrame:
    """(ids, variable, value) over many columns in one pass; no columns give no rows."""
    if not variables:
        return df.select(*ids, F.lit("").alias("variable"), F.lit(None).cast(kind).alias("value")).where("false")
    arr = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast(kind).alias("value")) for v in variables])
    return df.select(*ids, F.explode(arr).alias("_s")).select(*ids, "_s.variable", "_s.value")


def smd_continuous(df: DataFrame, group: str, variables: Sequence[str]) -> DataFrame:
    """Two-group means and standardised mean difference per variable. ``group`` is Boolean."""
    long = stack(df, [group], variables).where("value IS NOT NULL")
    g = F.col(group)
    def side(flag, name):
        v = F.when(g if flag else ~g, F.col("value"))
        return [F.count(v).alias(f"n_{name}"), F.avg(v).alias(f"value_{name}"), F.var_samp(v).alias(f"_v_{name}")]
    out = long.groupBy("variable").agg(*side(True, "yes"), *side(False, "no"))
    smd = F.when((F.col("n_yes") >= 2) & (F.col("n_no") >= 2), N.smd_means("value_yes", "_v_yes", "value_no", "_v_no"))
    return out.withColumn("smd", smd).withColumn("kind", F.lit("continuous")).drop("_v_yes", "_v_no")


def smd_binary(df: DataFrame, group: str, variables: Sequence[str]) -> DataFrame:
    long = stack(df, [group], variables, "int").where("value IS NOT NULL")
    g = F.col(group)
    def side(flag, name):
        v = F.when(g if flag else ~g, F.col("value").cast("double"))
        return [F.count(v).alias(f"n_{name}"), F.avg(v).alias(f"value_{name}")]
    out = long.groupBy("variable").agg(*side(True, "yes"), *side(False, "no"))
    return out.withColumn("smd", N.smd_shares("value_yes", "value_no")).withColumn("kind", F.lit("binary"))


def smd_levels(df: DataFrame, group: str, variables: Sequence[str]) -> DataFrame:
    """Share of every level in both groups; the denominator keeps missing values."""
    long = stack(df, [group], variables, "string")
    g = F.col(group)
    sizes = long.groupBy("variable").agg(F.count(F.when(g, 1)).alias("n_yes"), F.count(F.when(~g, 1)).alias("n_no"))
    counts = long.where("value IS NOT NULL").groupBy("variable", "value").agg(
        F.count(F.when(g, 1)).alias("_a"), F.count(F.when(~g, 1)).alias("_b")
    )
    out = counts.join(sizes, "variable").select(
        F.concat_ws(":", "variable", "value").alias("variable"), "n_yes", N.ratio("_a", "n_yes").alias("value_yes"),
        "n_no", N.ratio("_b", "n_no").alias("value_no"),
    )
    return out.withColumn("smd", N.smd_shares("value_yes", "value_no")).withColumn("kind", F.lit("level"))


def balance_table(df: DataFrame, group: str, continuous, binary, categorical) -> DataFrame:
    return (
        smd_continuous(df, group, continuous).unionByName(smd_binary(df, group, binary))
        .unionByName(smd_levels(df, group, categorical))
    )


def table_one(df: DataFrame, group: str, continuous: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Characteristics of two groups as display texts with SMD and imbalance flag."""
    long = stack(df, [group], continuous)
    q = quantile_columns(long, ["variable", group], "value", {"q1": 0.25, "med": 0.5, "q3": 0.75})
    text = q.withColumn("_t", X.fmt_quartiles("med", "q1", "q3")).groupBy("variable").agg(
        F.max(F.when(F.col(group), F.col("_t"))).alias("text_yes"), F.max(F.when(~F.col(group), F.col("_t"))).alias("text_no")
    )
    cont = smd_continuous(df, group, continuous).join(text, "variable").select("variable", "kind", "text_yes", "text_no", "smd")
    lv = smd_levels(df, group, categorical)
    cat = lv.select(
        "variable", "kind", X.fmt_count_pct(F.round(F.col("value_yes") * F.col("n_yes")).cast("long"), "n_yes").alias("text_yes"),
        X.fmt_count_pct(F.round(F.col("value_no") * F.col("n_no")).cast("long"), "n_no").alias("text_no"), "smd",
    )
    return cont.unionByName(cat).withColumn("imbalanced", F.abs("smd") >= 0.20)


def missingness(df: DataFrame, variables: Sequence[str], part: str) -> DataFrame:
    """Known, missing, zero and distinct counts per variable for every partition and overall."""
    long = stack(df.withColumn("_p", F.explode(F.array(F.lit("ALL"), F.col(part).cast("string")))), ["_p"], variables, "string")
    known = F.count("value")
    return long.groupBy(F.col("_p").alias("part"), "variable").agg(
        F.count(F.lit(1)).alias("rows"), known.alias("known"), (F.count(F.lit(1)) - known).alias("missing"),
        F.count(F.when(F.col("value").try_cast("double") == 0, 1)).alias("zeros"), F.countDistinct("value").alias("distinct_values"),
    ).withColumn("missing_pct", N.pct("missing", "rows")).withColumn(
        "rule", F.when(F.col("missing") == 0, "COMPLETE").when(F.col("known") == 0, "ALL_MISSING").otherwise("PARTIAL")
    )


def profile(df: DataFrame, variables: Sequence[str], qs=(0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """Percentiles, extremes, moments and bias-corrected skewness per numeric variable."""
    long = stack(df, [], variables).where("value IS NOT NULL")
    q = quantile_columns(long, ["variable"], "value", {f"p{int(round(100 * x)):02d}": x for x in qs})
    m = long.groupBy("variable").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"), N.unbiased_skew("value").alias("skew"),
    )
    return m.join(q, "variable")


def outlier_cut(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """``max(P99, Q3 + 3 IQR)`` per variable and the number of values above it."""
    long = stack(df, [], variables).where("value IS NOT NULL")
    q = quantile_columns(long, ["variable"], "value", {"q1": 0.25, "q3": 0.75, "p99": 0.99})
    cut = q.select("variable", F.greatest("p99", F.col("q3") + 3 * (F.col("q3") - F.col("q1"))).alias("cut"))
    n = long.join(cut, "variable").groupBy("variable").agg(F.max("cut").alias("cut"), F.count(F.when(F.col("value") > F.col("cut"), 1)).alias("above"))
    return n


def level_profile(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    long = stack(df, [], variables, "string")
    return top_level(long, ["variable"], "value")


def inclusion_rule(df: DataFrame, c: str, completeness: float = 0.95, least: int = 10, missing: str = "MISSING/UNKNOWN") -> DataFrame:
    """Keep a variable when it is complete enough and its smallest level is large enough."""
    n = df.groupBy(F.col(c).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    known = F.col("level").isNotNull() & (F.col("level") != missing)
    out = n.agg(
        N.ratio(F.sum(F.when(known, F.col("n")).otherwise(0)), F.sum("n")).alias("completeness"),
        F.min(F.when(known, F.col("n"))).alias("smallest_level"),
    )
    keep = (F.col("completeness") >= completeness) & (F.col("smallest_level") >= least)
    return out.select(F.lit(c).alias("variable"), "completeness", "smallest_level", F.when(keep, "SECONDARY").otherwise("DROP").alias("status"))


def intervals_long(df: DataFrame, ids: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """estimate/low/high column triples to one row per measure, for display."""
    arr = F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(m).alias("estimate"), F.col(f"{m}_low").alias("low"), F.col(f"{m}_high").alias("high"))
        for m in measures
    ])
    return df.select(*ids, F.explode(arr).alias("_m")).select(*ids, "_m.*")


def denominator_table(df: DataFrame, label: str, count: str, total: str) -> DataFrame:
    return df.select(label, X.fmt_ratio(count, total).alias("n_of_total"), X.fmt_count_pct(count, total).alias("n_pct"))


