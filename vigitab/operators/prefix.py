"""Ordered totals, window sums, ranks and exact quantiles without one-task sorts.

A plain ``sum().over(orderBy)`` puts a whole group in one task. Here a value is
located by a short list of coarse-to-fine ordering levels: every level is summed
first, so a window only ever sees the siblings below one prefix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .keys import join_same
from .storage import keep

Level = tuple[Column, bool]  # (ordering expression, descending)


def hierarchical_totals(
    df: DataFrame, by: Sequence[str], levels: Sequence[Level], values: Sequence[str], prefix: str = "cum_"
) -> DataFrame:
    """Inclusive running totals of ``values`` in the order given by ``levels``.

    The last level must order the rows left below one prefix; earlier levels
    must be coarser versions of the same order and not null.
    """
    out = df
    names = [f"_l{i}" for i in range(len(levels))]
    for n, (expr, _) in zip(names, levels):
        out = out.withColumn(n, expr)
    keyed = out
    path = list(by)
    for i, (n, (_, desc)) in enumerate(list(zip(names, levels))[:-1]):
        sums = keyed.groupBy(*path, n).agg(*[F.sum(v).alias(f"_s_{v}") for v in values])
        order = F.col(n).desc() if desc else F.col(n).asc()
        before = Window.partitionBy(*path).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        offsets = sums.select(
            *path, n, *[F.coalesce(F.sum(f"_s_{v}").over(before), F.lit(0)).alias(f"_o{i}_{v}") for v in values]
        )
        out = join_same(out, offsets, [*path, n])
        path.append(n)
    last, desc = names[-1], levels[-1][1]
    order = F.col(last).desc() if desc else F.col(last).asc()
    local = Window.partitionBy(*path).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for v in values:
        total = F.sum(v).over(local)
        for i in range(len(levels) - 1):
            total = total + F.col(f"_o{i}_{v}")
        out = out.withColumn(prefix + v, total)
    return out.drop(*names, *[f"_o{i}_{v}" for i in range(len(levels) - 1) for v in values])


def unit_levels(score: str, desc: bool = True) -> list[Level]:
    """Levels for numbers that mostly lie in [0, 1]: 12 bits, 24 bits, the value."""
    s = F.col(score)
    return [(F.floor(s * 4096), desc), (F.floor(s * 16777216), desc), (s, desc)]


def position(df: DataFrame, by: Sequence[str], levels: Sequence[Level], name: str = "position") -> DataFrame:
    """1-based position in a total order, spread over many tasks."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    out = hierarchical_totals(one, by, levels, ["_one"], prefix="_pos")
    return out.withColumnRenamed("_pos_one", name).drop("_one")


def window_totals(
    windows: DataFrame, daily: DataFrame, keys: Sequence[str], start: str, end: str, day: str, value: str, name: str
) -> DataFrame:
    """Sum of daily counts inside [start, end] for every window row, by prefix sums.

    ``daily`` holds one row per (keys, day). Distinct windows enter the ordered
    rows as two marks, the day before the start and the end, so one key never
    orders more rows than its calendar days and distinct windows. The sum per
    window keeps the partitioning of the running total: one shuffle in all.
    """
    keys = list(keys)
    marks = windows.select(*keys, start, end).distinct().withColumn(
        "_m",
        F.explode(F.array(
            F.struct(F.date_sub(F.col(start), 1).alias("d"), F.lit(-1).alias("s")),
            F.struct(F.col(end).alias("d"), F.lit(1).alias("s")),
        )),
    )
    none = F.lit(None)
    steps = daily.select(
        *keys, none.cast("date").alias(start), none.cast("date").alias(end), F.col(day).alias("_d"),
        F.lit(0).alias("_s"), F.col(value).cast("long").alias("_n"),
    )
    marks = marks.select(
        *keys, start, end, F.col("_m.d").alias("_d"), F.col("_m.s").alias("_s"), F.lit(0).cast("long").alias("_n")
    )
    run = Window.partitionBy(*keys).orderBy("_d").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        steps.unionByName(marks).withColumn("_cum", F.sum("_n").over(run)).where("_s <> 0")
        .groupBy(*keys, start, end).agg(F.sum(F.col("_cum") * F.col("_s")).alias(name))
    )


def cumulative(df: DataFrame, keys: Sequence[str], day: str, value: str, name: str) -> DataFrame:
    """Running total per key over days; ``df`` holds one row per (keys, day)."""
    run = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(value).over(run))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float]) -> DataFrame:
    """Exact linearly interpolated quantiles, long form (keys, q, quantile).

    Values are counted first. Their running counts come from three ordering
    levels over a log-compressed position between the smallest and the largest
    value, so neither a large group nor a long tail ends up in one task.
    """
    keys = list(keys)
    kk = keys or ["_all"]
    src = df.where(F.col(value).isNotNull())
    if not keys:
        src = src.withColumn("_all", F.lit(0))
    counts = keep(src.groupBy(*kk, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n")))
    squash = F.signum("_v") * F.log1p(F.abs("_v"))
    grouped = counts.groupBy(*kk) if keys else counts.groupBy()
    sizes = grouped.agg(F.sum("_n").alias("_total"), F.min(squash).alias("_lo"), F.max(squash).alias("_hi"))
    if keys:
        placed = join_same(counts, sizes, kk)
    else:  # one row of sizes: scalar subqueries instead of a join on a constant
        placed = counts
        for c in ("_total", "_lo", "_hi"):
            placed = placed.withColumn(c, sizes.select(c).scalar())
    placed = placed.withColumn("_share", F.coalesce(F.try_divide(squash - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)))
    levels = [(F.floor(F.col("_share") * 1024), False), (F.floor(F.col("_share") * 1048576), False), (F.col("_v"), False)]
    run = hierarchical_totals(placed, kk, levels, ["_n"], prefix="_upto")
    last = F.col("_total") - 1
    wanted = F.array(*[
        F.struct(F.lit(float(q)).alias("q"), F.lit(side).alias("side"), f(last * F.lit(float(q))).cast("long").alias("rank"))
        for q in qs for side, f in ((0, F.floor), (1, F.ceil))
    ])
    here = F.filter(wanted, lambda t: (t["rank"] < F.col("_upto_n")) & (t["rank"] >= F.col("_upto_n") - F.col("_n")))
    hit = run.where(F.size(here) > 0).select(*kk, "_total", "_v", F.explode(here).alias("_t"))
    pairs = hit.groupBy(*kk, F.col("_t.q").alias("q")).agg(
        F.max("_total").alias("_total"), F.max(F.when(F.col("_t.side") == 0, F.col("_v"))).alias("_v0"),
        F.max(F.when(F.col("_t.side") == 1, F.col("_v"))).alias("_v1"),
    )
    pos = (F.col("_total") - 1) * F.col("q")
    return pairs.select(*keys, "q", (F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (pos - F.floor(pos))).alias("quantile"))


def quantile_columns(df: DataFrame, keys: Sequence[str], value: str, named: dict[str, float]) -> DataFrame:
    """``exact_quantiles`` as one row per key with a column per name."""
    long = exact_quantiles(df, keys, value, sorted(set(named.values())))
    aggs = [F.max(F.when(F.col("q") == q, F.col("quantile"))).alias(n) for n, q in named.items()]
    return long.groupBy(*keys).agg(*aggs) if keys else long.agg(*aggs)


def equal_frequency_bins(df: DataFrame, by: Sequence[str], value: str, bins: int, name: str = "bin") -> DataFrame:
    """Right-closed equal-frequency bins with duplicate edges dropped, numbered from 0."""
    by = list(by)
    edges = exact_quantiles(df, by, value, [i / bins for i in range(bins + 1)])
    arr = F.array_sort(F.collect_set("quantile")).alias("_edges")
    joined = join_same(df, edges.groupBy(*by).agg(arr), by) if by else df.withColumn("_edges", edges.agg(arr).scalar())
    below = F.size(F.filter("_edges", lambda e: e < F.col(value)))
    return joined.withColumn(name, F.greatest(below - 1, F.lit(0))).drop("_edges")
