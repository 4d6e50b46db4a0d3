"""Grouped summaries used across the library."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import pct
from .keys import join_same
from .storage import keep  # noqa: F401 (re-exported)


def distinct_count(*cols: str) -> Column:
    """Distinct composite keys; null parts stay countable inside a struct."""
    return F.countDistinct(F.struct(*cols)) if len(cols) > 1 else F.countDistinct(cols[0])


def multi_key(df: DataFrame, key: Sequence[str], distinct: str, least: int = 2) -> DataFrame:
    return df.groupBy(*key).agg(F.countDistinct(distinct).alias("n")).where(F.col("n") >= least)


def carry(df: DataFrame, key: Sequence[str], attrs: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(*[F.min(a).alias(a) for a in attrs])


def distinct_list(c: str, sep: str = " | ") -> Column:
    return F.array_join(F.array_sort(F.collect_set(c)), sep)


def unique_in_order(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, name: str, sep: str = " | ") -> DataFrame:
    """Distinct non-blank values per key joined in first-seen order; repeats are folded before the lists form."""
    seen = df.where(F.trim(value) != "").groupBy(*key, F.trim(value).alias("_v")).agg(F.min(F.struct(*order)).alias("_o"))
    items = F.array_sort(F.collect_list(F.struct("_o", "_v")))
    return seen.groupBy(*key).agg(F.array_join(F.transform(items, lambda x: x["_v"]), sep).alias(name))


def limited_list(df: DataFrame, key: Sequence[str], value: str, name: str, limit: int | None = 80, sep: str = " | ") -> DataFrame:
    """Distinct values, shortest first; beyond ``limit`` only their number is written out. Without a limit all are.

    The rank filter runs before the lists form, so a list never outgrows ``limit``.
    """
    one = df.where(F.trim(value) != "").select(*key, F.trim(value).alias("_v")).distinct()
    shown = one
    if limit is not None:
        w = Window.partitionBy(*key).orderBy(F.length("_v"), F.lower("_v"), "_v")
        shown = one.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit)
    item = F.struct(F.length("_v"), F.lower("_v"), "_v")
    lists = shown.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["_v"]), sep).alias("_h"))
    if limit is None:
        return lists.select(*key, F.col("_h").alias(name))
    more = F.col("_n") - limit
    text = F.when(more > 0, F.concat("_h", F.lit(sep + "... ["), more.cast("string"), F.lit(" additional]"))).otherwise(F.col("_h"))
    return join_same(one.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")), lists, list(key)).select(*key, text.alias(name))


def support_profile(df: DataFrame, key: Sequence[str], trial: str, day: str, good: Column) -> DataFrame:
    return df.groupBy(*key).agg(
        distinct_list(trial).alias("trial_ids"), F.countDistinct(trial).alias("trials"),
        F.min(day).alias("first_completion"), F.max(day).alias("last_completion"), F.bool_and(good).alias("all_before_anchor"),
    )


def guarded_sd(c: str, least: int = 2) -> Column:
    return F.when(F.count(c) >= least, F.stddev_samp(c))


def known_rate(flag: str, name: str) -> list[Column]:
    """Mean of a flag over known values and the number of known values."""
    f = F.col(flag).cast("int")
    return [F.avg(f).alias(f"{name}_rate"), F.count(f).alias(f"{name}_known")]


def mix(df: DataFrame, key: Sequence[str], c: str, levels: Sequence[str]) -> DataFrame:
    """Share of each level, of other levels and of missing values."""
    col = F.col(c)
    aggs = [F.avg(F.when(col == lv, 1.0).otherwise(0.0)).alias(f"share_{i}") for i, lv in enumerate(levels)]
    aggs.append(F.avg(F.when(col.isNotNull() & ~col.isin(list(levels)), 1.0).otherwise(0.0)).alias("share_other"))
    aggs.append(F.avg(F.when(col.isNull(), 1.0).otherwise(0.0)).alias("share_missing"))
    return df.groupBy(*key).agg(*aggs)


def daily_counts(df: DataFrame, day: str, keys: Sequence[str] = (), name: str = "n") -> DataFrame:
    return df.groupBy(*keys, day).agg(F.count(F.lit(1)).alias(name))


def term_frequency(df: DataFrame, term: Column, report: str, case: str) -> DataFrame:
    return df.groupBy(term.alias("term")).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(report).alias("reports"), F.countDistinct(case).alias("cases")
    )


def concentration(df: DataFrame, by: Sequence[str], value: str, ks: Sequence[int]) -> DataFrame:
    """Percent of the total held by the k largest rows, per group.

    The rank filter is pushed below the shuffle, so only max(ks) rows per task travel.
    """
    by = list(by)
    keyed = df if by else df.withColumn("_g", F.lit(0))
    kk = by or ["_g"]
    w = Window.partitionBy(*kk).orderBy(F.col(value).desc())
    top = keyed.select(*kk, value).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max(ks))
    tops = top.groupBy(*kk).agg(*[F.sum(F.when(F.col("_rn") <= k, F.col(value))).alias(f"_t{k}") for k in ks])
    total = keyed.groupBy(*kk).agg(F.sum(value).alias("_total"))
    return join_same(total, tops, kk).select(*by, *[pct(f"_t{k}", "_total").alias(f"top{k}_pct") for k in ks])


def stratified_counts(df: DataFrame, dims: Sequence[str], measures: dict[str, Column] | None = None) -> DataFrame:
    """Counts per level of many dimensions in one pass, long form."""
    measures = measures or {}
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("level")) for d in dims])
    long = df.withColumn("_d", F.explode(pairs)).withColumn("dimension", F.col("_d.dimension"))
    long = long.withColumn("level", F.coalesce(F.col("_d.level"), F.lit("MISSING"))).drop("_d")
    return long.groupBy("dimension", "level").agg(F.count(F.lit(1)).alias("n"), *[m.alias(k) for k, m in measures.items()])


def top_level(df: DataFrame, key: Sequence[str], c: str) -> DataFrame:
    """Most frequent level and its share; ties go to the smaller level."""
    n = df.where(F.col(c).isNotNull()).groupBy(*key, c).agg(F.count(F.lit(1)).alias("_n"))
    out = n.groupBy(*key).agg(
        F.min_by(F.col(c), F.struct(-F.col("_n"), F.col(c))).alias("top_level"),
        F.max("_n").alias("top_count"), F.sum("_n").alias("known"),
    )
    return out.withColumn("top_share", F.try_divide(F.col("top_count").cast("double"), F.col("known")))


def crosstab(df: DataFrame, row: str, column: str, levels: Sequence, prefix: str = "n_") -> DataFrame:
    aggs = [F.count(F.when(F.col(column) == lv, 1)).alias(f"{prefix}{lv}") for lv in levels]
    return df.groupBy(row).agg(*aggs, F.count(F.lit(1)).alias("total"))


def first_per_group(df: DataFrame, key: Sequence[str], order: Sequence[str], firsts: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    """Attributes of the earliest record per group plus group-level aggregates."""
    return df.groupBy(*key).agg(*[F.min_by(F.col(c), F.struct(*order)).alias(c) for c in firsts], *extra)


def snapshot_counts(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    out = None
    for name, (df, key) in tables.items():
        part = df.groupBy(F.col(key).cast("string").alias("snapshot")).agg(F.count(F.lit(1)).alias("rows"))
        part = part.select(F.lit(name).alias("table_name"), "snapshot", "rows")
        out = part if out is None else out.unionAll(part)
    return out


def share_of_total(df: DataFrame, by: Sequence[str], value: str, name: str = "share") -> DataFrame:
    """Value over its group total; the totals are aggregated apart and joined, not windowed."""
    by = list(by)
    keyed = df if by else df.withColumn("_g", F.lit(0))
    kk = by or ["_g"]
    totals = keyed.groupBy(*kk).agg(F.sum(value).alias("_t"))
    out = join_same(keyed, totals, kk).withColumn(name, F.try_divide(F.col(value), F.col("_t"))).drop("_t")
    return out if by else out.drop("_g")


def rank_in(df: DataFrame, by: Sequence[str], value: str, name: str = "rank") -> DataFrame:
    """Competition rank, largest first. Meant for summary rows such as one per feature."""
    return df.withColumn(name, F.rank().over(Window.partitionBy(*by).orderBy(F.col(value).desc())))


def stratified_head(df: DataFrame, stratum: str, order: Sequence[Column], n: int, unique: Sequence[str]) -> DataFrame:
    """First ``n`` rows of every stratum after removing repeats of (stratum, key)."""
    one = df.dropDuplicates([stratum, *unique])
    w = Window.partitionBy(stratum).orderBy(*order)
    return one.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def top_then_sort(df: DataFrame, by: Sequence[Column], n: int, then: Sequence[Column]) -> DataFrame:
    return df.orderBy(*by).limit(n).orderBy(*then)


def examples(df: DataFrame, violation: Column, order: Sequence[str], n: int) -> DataFrame:
    return df.where(violation).orderBy(*order).limit(n)


def extremes(df: DataFrame, ident: str, variables: Sequence[str], k: int = 3) -> DataFrame:
    """The k largest values of every variable as one text."""
    pairs = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in variables])
    long = df.select(ident, F.explode(pairs).alias("_p")).select(ident, "_p.*").where("value IS NOT NULL")
    w = Window.partitionBy("variable").orderBy(F.col("value").desc(), F.col(ident))
    top = long.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    item = F.struct("rn", F.concat(F.col(ident).cast("string"), F.lit("="), F.format_string("%.2f", "value")).alias("t"))
    return top.groupBy("variable").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), "; ").alias("extremes")
    )


def funnel(stages: Sequence[tuple[str, DataFrame]], window: str, starts: Sequence[int], end: int, counts: dict[str, Sequence[str]], row_id: str | None = None) -> DataFrame:
    """Stages × window starts with distinct counts; absent columns are null."""
    out = None
    for i, (name, df) in enumerate(stages):
        placed = df.where(F.col(window) <= end).withColumn(
            "start", F.explode(F.filter(F.array(*[F.lit(s) for s in starts]), lambda s: s <= F.col(window)))
        )
        aggs = []
        for label, cols in counts.items():
            have = all(c in df.columns for c in cols)
            aggs.append((distinct_count(*cols) if have else F.lit(None).cast("long")).alias(label))
        aggs.append((F.count(F.lit(1)) if row_id is None or row_id in df.columns else F.lit(None).cast("long")).alias("rows"))
        part = placed.groupBy("start").agg(*aggs).withColumn("stage", F.lit(f"S{i}_{name}"))
        out = part if out is None else out.unionByName(part)
    return out
