"""Evaluation of probabilities: ranking, losses, calibration, intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from ..functions import numeric as N
from .joins import join_checked
from .keys import join_same
from .prefix import equal_frequency_bins, quantile_columns
from .resample import ranking_from_ties
from .storage import keep


def stack_scores(df: DataFrame, ids: Sequence[str], scores: Sequence[str]) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(s).alias("score_set"), F.col(s).alias("p")) for s in scores])
    return df.select(*ids, F.explode(arr).alias("_s")).select(*ids, "_s.score_set", "_s.p")


def tie_groups(df: DataFrame, by: Sequence[str], y: str, p: str, w: str | None = None) -> DataFrame:
    weight = F.col(w).cast("double") if w else F.lit(1.0)
    return df.groupBy(*by, F.col(p).alias("p")).agg(
        F.sum(weight * F.col(y)).alias("pos"), F.sum(weight * (1 - F.col(y))).alias("neg")
    )


def score_curve(df: DataFrame, by: Sequence[str], y: str, p: str, w: str | None = None) -> DataFrame:
    """Running positives and negatives over tied score groups, best score first."""
    from .prefix import hierarchical_totals, unit_levels

    return hierarchical_totals(tie_groups(df, by, y, p, w), list(by), unit_levels("p"), ["pos", "neg"])


def ranking(df: DataFrame, by: Sequence[str], y: str, p: str, w: str | None = None) -> DataFrame:
    return ranking_from_ties(tie_groups(df, by, y, p, w), by, "p")


def losses(df: DataFrame, by: Sequence[str], y: str, p: str) -> DataFrame:
    pc = N.clip(p, fixed.DOUBLE_EPS, 1 - fixed.DOUBLE_EPS)  # only keeps the logarithm finite; the wider clip belongs to the bootstrap
    yy = F.col(y)
    aggs = [
        F.count(F.lit(1)).alias("rows"), F.sum(yy.cast("long")).alias("positives"), F.avg(yy.cast("double")).alias("prevalence"),
        F.avg(F.pow(yy - F.col(p), F.lit(2))).alias("brier"), F.avg(-(yy * F.ln(pc) + (1 - yy) * F.ln(1 - pc))).alias("log_loss"),
    ]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def metrics_by(df: DataFrame, by: Sequence[str], y: str, p: str) -> DataFrame:
    """Ranking and loss metrics with lift over prevalence for every group."""
    out = join_same(losses(df, by, y, p), ranking(df, by, y, p), by)
    return out.withColumn("ap_lift", F.try_divide(F.col("average_precision"), F.col("prevalence")))


def calibration(df: DataFrame, by: Sequence[str], y: str, p: str, w: str | None = None, steps: int = 100, tol: float = 1e-10) -> DataFrame:
    """Calibration intercept (offset logit) and slope by Newton steps for all groups at once.

    Rows are summed per distinct score first. The parameters are a table with a row per group: each step joins it to the sums, moves every
    group that has not settled, and writes the table; the driver only learns whether any group is left. A
    parameter that has not settled is null and its flag false.
    """
    by = list(by)
    keyed = tie_groups(df, by, y, p, w).withColumn("_x", N.logit("p"))
    if not by:
        keyed, by = keyed.withColumn("_g", F.lit(0)), ["_g"]
    data = keep(keyed.select(*by, "_x", (F.col("pos") + F.col("neg")).alias("_w"), F.col("pos").alias("_y")), "calibration_sums")
    zero = F.lit(0.0)
    state = data.select(*by).distinct().select(*by, zero.alias("_a"), zero.alias("_c"), F.lit(1.0).alias("_b"), F.lit(False).alias("_done_a"), F.lit(False).alias("_done_s"))
    state = keep(state, "calibration")
    x, weight = F.col("_x"), F.col("_w")
    fit_a, fit_s = N.expit(F.col("_a") + x), N.expit(F.col("_c") + F.col("_b") * x)
    miss, curve = F.col("_y") - weight * fit_s, weight * fit_s * (1 - fit_s)
    params = ["_a", "_c", "_b", "_done_a", "_done_s"]
    open_ = ~(F.col("_done_a") & F.col("_done_s"))
    for _ in range(steps):
        sums = join_same(data, state.where(open_), by).groupBy(*by, *params).agg(
            F.try_divide(F.sum(F.col("_y") - weight * fit_a), F.sum(weight * fit_a * (1 - fit_a))).alias("_da"),
            F.sum(weight * fit_a * (1 - fit_a)).alias("_va"),
            *(F.sum(v).alias(n) for n, v in (("_g0", miss), ("_g1", miss * x), ("_h00", curve), ("_h01", curve * x), ("_h11", curve * x * x))))
        det = F.col("_h00") * F.col("_h11") - F.pow("_h01", F.lit(2))
        # Newton direction of (c, b): the inverse of the 2 x 2 curvature times the gradient
        dc = (F.col("_h11") * F.col("_g0") - F.col("_h01") * F.col("_g1")) / det
        db = (F.col("_h00") * F.col("_g1") - F.col("_h01") * F.col("_g0")) / det
        go_a, go_s = ~F.col("_done_a") & (F.col("_va") > 1e-12), ~F.col("_done_s") & (det > 1e-12)
        moved = sums.select(
            *by, (F.col("_a") + F.when(go_a, F.col("_da")).otherwise(zero)).alias("_a"), (F.col("_c") + F.when(go_s, dc).otherwise(zero)).alias("_c"),
            (F.col("_b") + F.when(go_s, db).otherwise(zero)).alias("_b"), (F.col("_done_a") | (go_a & (F.abs("_da") < tol))).alias("_done_a"),
            (F.col("_done_s") | (go_s & (F.greatest(F.abs(dc), F.abs(db)) < tol))).alias("_done_s"), (go_a | go_s).alias("_moved"))
        nxt = keep(state.where(~open_).withColumn("_moved", F.lit(False)).unionByName(moved), "calibration")
        state = nxt.drop("_moved")
        if nxt.where(F.col("_moved") & open_).isEmpty():
            break
    return state.select(
        *by, F.when(F.col("_done_a"), F.col("_a")).alias("calibration_intercept"), F.when(F.col("_done_s"), F.col("_b")).alias("calibration_slope"), F.col("_done_a").alias("intercept_ok"), F.col("_done_s").alias("slope_ok")).drop("_g")


def calibration_bins(df: DataFrame, by: Sequence[str], y: str, p: str, bins: int = 10) -> DataFrame:
    placed = equal_frequency_bins(df, by, p, bins)
    sums = placed.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("positives"), F.avg(F.col(y).cast("double")).alias("observed_rate"),
        F.avg(p).alias("mean_p"), F.min(p).alias("min_p"), F.max(p).alias("max_p"),
    )
    return join_same(sums, quantile_columns(placed, [*by, "bin"], p, {"median_p": 0.5}), [*by, "bin"])


def paired_increment(boot: DataFrame, rep: str, family: Sequence[str], arm: str, base: str, new: str, measures: Sequence[str], lower_better: Sequence[str] = ("brier", "log_loss")) -> DataFrame:
    """Difference new − base per shared replicate (sign turned where lower is better), with limits."""
    keys = [*family, rep]
    a = boot.where(F.col(arm) == base).select(*keys, *[F.col(m).alias(f"_{m}") for m in measures])
    b = boot.where(F.col(arm) == new).select(*keys, *measures)
    d = b.join(a, keys)
    for m in measures:
        diff = F.col(f"_{m}") - F.col(m) if m in lower_better else F.col(m) - F.col(f"_{m}")
        d = d.withColumn(m, diff)
    arr = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in measures])
    long = d.select(*family, F.explode(arr).alias("_m")).select(*family, "_m.*")
    return long.groupBy(*family, "measure").agg(
        F.expr("percentile(value, 0.5)").alias("median"), F.expr("percentile(value, 0.025)").alias("low"),
        F.expr("percentile(value, 0.975)").alias("high"), F.count("value").alias("valid"),
    )


def join_outcomes(pred: DataFrame, labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Outcomes joined after the predictions are fixed; repeated keys on either side fail."""
    return join_checked(pred, labels, keys, "inner")


def metrics_by_support(df: DataFrame, by: Sequence[str], cluster: str, y: str, p: str, min_clusters: int = 10, min_class: int = 20) -> DataFrame:
    """Metrics per stratum, shown only where the stratum is stable."""
    m = metrics_by(df, by, y, p)
    size = df.groupBy(*by).agg(
        F.countDistinct(cluster).alias("clusters"), F.count(F.when(F.col(y) == 1, 1)).alias("_p"), F.count(F.when(F.col(y) == 0, 1)).alias("_n")
    )
    ok = (F.col("clusters") >= min_clusters) & (F.col("_p") >= min_class) & (F.col("_n") >= min_class)
    out = m.join(size, list(by)).withColumn("stable", ok)
    for c in ("average_precision", "auroc", "brier", "log_loss", "ap_lift"):
        out = out.withColumn(c, F.when(F.col("stable"), F.col(c)))
    return out.drop("_p", "_n")


def transport(dev: DataFrame, hold: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Both cohorts side by side with the change per measure."""
    a = dev.select(*keys, *[F.col(m).alias(f"{m}_dev") for m in measures])
    b = hold.select(*keys, *[F.col(m).alias(f"{m}_hold") for m in measures])
    out = a.join(b, list(keys))
    for m in measures:
        out = out.withColumn(f"{m}_change", F.col(f"{m}_hold") - F.col(f"{m}_dev"))
    return out


def rank_sum_auroc(df: DataFrame, by: Sequence[str], y: str, p: str) -> DataFrame:
    """AUROC by mean ranks: the independent second formula."""
    ties = tie_groups(df, by, y, p).withColumn("_n", F.col("pos") + F.col("neg"))
    from .prefix import hierarchical_totals, unit_levels

    run = hierarchical_totals(ties, list(by), unit_levels("p", desc=False), ["_n"])
    mean_rank = F.col("cum__n") - (F.col("_n") - 1) / 2
    g = run.groupBy(*by).agg(F.sum(F.col("pos") * mean_rank).alias("_r"), F.sum("pos").alias("_p"), F.sum("neg").alias("_q"))
    u = F.col("_r") - F.col("_p") * (F.col("_p") + 1) / 2
    return g.select(*by, F.try_divide(u, F.col("_p") * F.col("_q")).alias("auroc"))


def max_abs_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Largest difference per measure and the number of keys on one side only."""
    x = a.select(*keys, *[F.col(m).cast("double").alias(f"_a_{m}") for m in measures]).withColumn("_l", F.lit(1))
    y = b.select(*keys, *[F.col(m).cast("double").alias(f"_b_{m}") for m in measures]).withColumn("_r", F.lit(1))
    j = x.join(y, list(keys), "full")
    return j.agg(
        F.count(F.lit(1)).alias("keys"), F.count(F.when(F.col("_l").isNull() | F.col("_r").isNull(), 1)).alias("unmatched"),
        *[F.max(F.abs(F.col(f"_a_{m}") - F.col(f"_b_{m}"))).alias(f"{m}_diff") for m in measures],
    )


def null_model(df: DataFrame, fold: str, y: str) -> DataFrame:
    """Training prevalence of all other folds as the prediction of a fold."""
    per = df.groupBy(fold).agg(F.sum(F.col(y).cast("long")).alias("_p"), F.count(F.lit(1)).alias("_n"))
    every = Window.partitionBy()  # one row per fold
    p = (F.sum("_p").over(every) - F.col("_p")) / (F.sum("_n").over(every) - F.col("_n"))
    return per.select(fold, p.alias("null_p"), F.col("_n").alias("rows"))


def performance_table(metrics: DataFrame, ci: DataFrame, keys: Sequence[str], measures: Sequence[str], digits: int = 4) -> DataFrame:
    """Estimates next to their limits, long form for display."""
    arr = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("estimate")) for m in measures])
    long = metrics.select(*keys, F.explode(arr).alias("_m")).select(*keys, "_m.*")
    return long.join(ci.select(*keys, "measure", "low", "high"), [*keys, "measure"])


