"""Attribution summaries over signed contributions, and contributions from fitted models."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from .aggregates import rank_in, share_of_total
from .prefix import exact_quantiles, quantile_columns

FAM = ["family"]
KEY = ["family", "feature"]


def group_signed(contrib: DataFrame, row: Sequence[str], parent: str, value: str = "contribution") -> DataFrame:
    """Signed sum within a row per parent feature, before any absolute value."""
    return contrib.groupBy(*row, parent).agg(F.sum(value).alias(value))


def contribution_long(grouped: DataFrame, meta: DataFrame, raw: DataFrame, row: Sequence[str]) -> DataFrame:
    """Long frame with the domain of the feature and the raw value of the row."""
    return grouped.join(meta, "feature").join(raw, [*row, "feature"], "left")


def importance(long: DataFrame, specific: str = "pair_specific") -> DataFrame:
    """Mean, median and quartiles of the absolute contribution with ranks overall and among pair-specific features."""
    a = long.withColumn("_abs", F.abs("contribution"))
    m = a.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("rows"), F.avg("_abs").alias("mean_abs"), F.avg("contribution").alias("mean_signed"),
        F.min("domain").alias("domain"), F.bool_or(specific).alias(specific),
    )
    q = quantile_columns(a, KEY, "_abs", {"q1_abs": 0.25, "median_abs": 0.5, "q3_abs": 0.75})
    out = rank_in(m.join(q, KEY), FAM, "mean_abs", "rank_all")
    inside = rank_in(out.where(specific), FAM, "mean_abs", "rank_specific").select(*KEY, "rank_specific")
    return out.join(inside, KEY, "left")


def mean_abs_ranks(long: DataFrame) -> DataFrame:
    """Mean absolute and mean signed contribution of each family's features, with the rank of the former."""
    m = long.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.abs("contribution")).alias("mean_abs"), F.avg("contribution").alias("mean_signed"))
    return rank_in(m, FAM, "mean_abs", "rank_all")


def left_out_weights(cells: DataFrame, column: str, fold: str, x: str, y: str) -> DataFrame:
    """Weights of one-column linear models by family, column and fold: `own` from the other folds' rows, `full` from all.

    Families: slope (least squares of y on x) and gap (difference of the classes' means). One sum per column and fold is shuffled; a fold's
    model comes from the totals less its own sums. Without spread, or without both classes, the weight is null.
    """
    v, t = F.col(x).cast("double"), F.col(y).cast("double")
    parts = {"_n": F.lit(1.0), "_x": v, "_y": t, "_xy": v * t, "_xx": v * v}
    sums = cells.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(column, fold).agg(*(F.sum(e).alias(n) for n, e in parts.items()))
    every = Window.partitionBy(column)  # a row per fold

    def weights(n: Column, sx: Column, sy: Column, sxy: Column, sxx: Column) -> list[Column]:
        return [F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx), F.try_divide(sxy, sy) - F.try_divide(sx - sxy, n - sy)]

    full = [F.sum(c).over(every) for c in parts]
    own = weights(*(a - F.col(c) for a, c in zip(full, parts)))
    pairs = [F.struct(F.lit(f).alias("family"), o.alias("own"), w.alias("full")) for f, o, w in zip(("slope", "gap"), own, weights(*full))]
    return sums.select(column, fold, F.array(*pairs).alias("_w")).select(column, fold, F.explode("_w").alias("_w")).select(column, fold, "_w.*")


def domain_shares(imp: DataFrame) -> DataFrame:
    d = imp.groupBy("family", "domain").agg(F.sum("mean_abs").alias("total_abs"), F.count(F.lit(1)).alias("features"))
    return share_of_total(d, FAM, "total_abs")


def coefficient_stability(coefs: DataFrame, folds: int = 5, least: int = 4) -> DataFrame:
    """Sign counts, spread and stability over the outer fits (one coefficient per feature and fold)."""
    c = F.col("coefficient")
    g = coefs.groupBy("feature").agg(
        F.count(F.lit(1)).alias("models"), F.count(F.when(c != 0, 1)).alias("nonzero"), F.count(F.when(c > 0, 1)).alias("positive"),
        F.count(F.when(c < 0, 1)).alias("negative"), F.expr("percentile(coefficient, 0.5)").alias("median"),
        F.expr("percentile(coefficient, 0.25)").alias("q1"), F.expr("percentile(coefficient, 0.75)").alias("q3"),
    )
    sign = F.when(F.col("positive") > F.col("negative"), "positive").when(F.col("negative") > F.col("positive"), "negative").otherwise("none")
    stable = (F.col("nonzero") >= least) & (F.greatest("positive", "negative") >= least)
    return g.withColumn("dominant_sign", sign).withColumn("stable", stable).withColumn(
        "reported_direction", F.when(F.col("stable"), F.col("dominant_sign")).otherwise("not_assigned")
    )


def rank_concordance(imp: DataFrame, left: str, right: str, specific: str = "pair_specific") -> DataFrame:
    """Spearman correlation between two families over all and over pair-specific features."""
    a = imp.where(F.col("family") == left).select("feature", specific, F.col("rank_all").alias("_a"), F.col("rank_specific").alias("_as"))
    b = imp.where(F.col("family") == right).select("feature", F.col("rank_all").alias("_b"), F.col("rank_specific").alias("_bs"))
    return a.join(b, "feature").agg(
        F.corr(F.col("_a").cast("double"), F.col("_b").cast("double")).alias("rho_all"),
        F.corr(F.col("_as").cast("double"), F.col("_bs").cast("double")).alias("rho_specific"), F.count(F.lit(1)).alias("features"),
    )


def supported(imp: DataFrame, left: str, right: str, k: int = 10, rank: str = "rank_all") -> DataFrame:
    """Features among the first k of both families."""
    a = imp.where((F.col("family") == left) & (F.col(rank) <= k)).select("feature", F.col(rank).alias("rank_left"))
    b = imp.where((F.col("family") == right) & (F.col(rank) <= k)).select("feature", F.col(rank).alias("rank_right"))
    return a.join(b, "feature")


def dependence(long: DataFrame, value: str = "raw", bins: int = 5, binary: Sequence[str] = ()) -> DataFrame:
    """Binned response per feature, with rows of known and missing value.

    Values fall into right-closed quantile bins; heavily tied features fall back to quantiles of their distinct values. Features named in
    ``binary`` have the bins absent (0) and present (1).
    """
    flag = F.col("feature").isin(list(binary))
    known = long.groupBy("feature").agg(F.count(value).alias("known"), (F.count(F.lit(1)) - F.count(value)).alias("missing"))
    rows = long.where(F.col(value).isNotNull())
    qs = [i / bins for i in range(bins + 1)]

    def edges(df: DataFrame, name: str) -> DataFrame:
        return exact_quantiles(df, ["feature"], value, qs).groupBy("feature").agg(F.array_sort(F.collect_set("quantile")).alias(name))

    distinct = rows.select("feature", value).distinct()
    n = distinct.groupBy("feature").agg(F.count(F.lit(1)).alias("_d"))
    tied = (F.size("_e") - 1 < 3) & (F.col("_d") >= 3)
    method = F.when(flag, "BINARY").when(tied, "DISTINCT_VALUE_QUANTILES").otherwise("QUANTILES")
    table = edges(rows, "_e").join(n, "feature").join(edges(distinct, "_s"), "feature").select(
        "feature", F.when(tied, F.col("_s")).otherwise(F.col("_e")).alias("_edges"), method.alias("method"))
    below = F.size(F.filter("_edges", lambda e: e < F.col(value)))
    place = F.when(flag, F.col(value).cast("int")).otherwise(F.greatest(below, F.lit(1)))
    placed = rows.join(table, "feature").withColumn("bin", place).select("feature", "bin", F.col(value).alias("_v"), "contribution", "method")
    keys = ["feature", "bin"]
    out = placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("_v").alias("min_value"), F.max("_v").alias("max_value"), F.avg("_v").alias("mean_value"),
        F.avg("contribution").alias("mean_contribution"), F.max("method").alias("method"))
    for column, name in (("_v", "median_value"), ("contribution", "median_contribution")):
        out = out.join(quantile_columns(placed, keys, column, {name: 0.5}), keys)
    return out.join(known, "feature")


def shape_label(bins: DataFrame) -> DataFrame:
    """Direction of the binned response: at least three bins, |rank correlation| of bin medians ≥ 0.8, else mixed or unclear.

    A binary feature has the sign of present against absent.
    """
    w = Window.partitionBy("feature")
    b = bins.select(
        "feature", "bin", "mean_contribution", "method", mean_rank("median_value", w).alias("_rv"), mean_rank("mean_contribution", w).alias("_rc"),
        (F.col("mean_contribution") - F.lag("mean_contribution").over(w.orderBy("bin"))).alias("_d"),
    )
    g = b.groupBy("feature").agg(
        F.count(F.lit(1)).alias("bins"), F.round(F.corr("_rv", "_rc"), 12).alias("rho"),
        (F.max_by("mean_contribution", "bin") - F.min_by("mean_contribution", "bin")).alias("change"),
        (F.max("mean_contribution") - F.min("mean_contribution")).alias("_range"), F.max(F.col("method") == "BINARY").alias("_binary"),
        F.bool_or(F.col("_d") > 0).alias("_up"), F.bool_or(F.col("_d") < 0).alias("_down"),
    )
    flat = (F.col("_range") <= 1e-6) | (F.col("bins") < F.when(F.col("_binary"), 2).otherwise(3))
    label = (
        F.when(flat, "no clear direction").when(F.col("_binary"), F.when(F.col("change") > 0, "higher when present").otherwise("lower when present"))
        .when((F.col("rho") >= 0.8) & (F.col("change") > 0), "increasing").when((F.col("rho") <= -0.8) & (F.col("change") < 0), "decreasing")
        .when(F.col("_up") & F.col("_down"), "nonmonotonic").otherwise("no clear direction")
    )
    return g.withColumn("shape", label).drop("_range", "_up", "_down", "_binary")


def mean_rank(c: str, w: WindowSpec) -> Column:
    """Rank within the window's groups, ties sharing their mean rank. Meant for a few rows a group."""
    return F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(w.partitionBy("feature", c)) - 1) / 2


def availability_audit(imp: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Does an availability flag outweigh the measurement it belongs to?"""
    spec = F.array(*[F.struct(F.lit(m).alias("feature"), F.lit(a).alias("flag")) for m, a in pairs])
    m = imp.withColumn("_p", F.explode(F.filter(spec, lambda s: s["feature"] == F.col("feature"))))
    m = m.select("family", "feature", F.col("_p.flag").alias("flag"), F.col("mean_abs").alias("measurement_abs"), F.col("rank_all").alias("measurement_rank"))
    f = imp.select("family", F.col("feature").alias("flag"), F.col("mean_abs").alias("flag_abs"), F.col("rank_all").alias("flag_rank"))
    return m.join(f, ["family", "flag"]).withColumn("flag_dominates", F.col("flag_abs") > F.col("measurement_abs"))


def duplicate_flags(table: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Pairs of flag columns that agree on every row."""
    pairs = list(combinations(flags, 2))
    one = table.agg(*[F.bool_and(F.col(a).eqNullSafe(F.col(b))).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    arr = F.array(*[F.struct(F.lit(a).alias("left_flag"), F.lit(b).alias("right_flag"), F.col(f"_{i}").alias("identical")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(arr).alias("_p")).select("_p.*")


def agreement(oof: DataFrame, full: DataFrame) -> DataFrame:
    """Rank agreement class between two importance tables, per family; where all ranks of a side are equal, rho is null, the class UNDEFINED."""
    a = oof.select(*KEY, F.col("rank_all").alias("rank_oof"))
    b = full.select(*KEY, F.col("rank_all").alias("rank_full"))
    x, z = F.col("rank_oof").cast("double"), F.col("rank_full").cast("double")
    g = a.join(b, KEY).groupBy("family").agg(
        F.try_divide(F.covar_pop(x, z), F.stddev_pop(x) * F.stddev_pop(z)).alias("rho"),
        F.max(F.abs(F.col("rank_full") - F.col("rank_oof"))).cast("long").alias("largest_shift"),
    )
    return g.withColumn("agreement", F.when(F.col("rho").isNull(), "UNDEFINED").when(F.col("rho") >= 0.75, "HIGH").when(F.col("rho") >= 0.5, "MODERATE").otherwise("LOW"))


def additivity(contrib: DataFrame, margin: DataFrame, row: Sequence[str], base: float, tolerance: float = 1e-6) -> DataFrame:
    """Base plus the sum of contributions against the margin of every row."""
    s = contrib.groupBy(*row).agg(F.sum("contribution").alias("_s"))
    d = s.join(margin, list(row)).withColumn("_d", F.abs(F.lit(base) + F.col("_s") - F.col("margin")))
    return d.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("_d") > tolerance, 1)).alias("violations"))


# --- contributions from fitted models ---------------------------------------

def linear_contributions(model, df: DataFrame, row: str, features: str = "features") -> DataFrame:
    """Coefficient × encoded value per column of a linear model, long form."""
    coefs = [float(x) for x in model.coefficients.toArray()]  # one number per encoded column
    cells = F.transform(vector_to_array(features), lambda v, i: F.struct(i.alias("column_index"), v.alias("value")))
    values = df.select(row, F.explode(F.filter(cells, lambda c: c["value"] != 0)).alias("c")).select(row, "c.*")
    table = df.sparkSession.createDataFrame(list(enumerate(coefs)), "column_index int, coefficient double")
    return values.join(table, "column_index").withColumn("contribution", F.col("value") * F.col("coefficient"))


def concept_map(names: DataFrame, features: DataFrame) -> DataFrame:
    """Encoded column → feature → parent: the longest feature that is the column's name or stands before one of its equals signs.

    `features` may carry a `parent`; without it a feature is its own. Columns without a feature stay, unmapped. A feature with two parents,
    or a column name that stands for two columns, fails when the rows are read. Prefixes meet features by equality, so no pairs are formed.
    """
    own = features if "parent" in features.columns else features.withColumn("parent", F.col("feature"))
    known = own.groupBy("feature").agg(F.min("parent").alias("parent"), F.countDistinct("parent").alias("_parents"))
    cuts = F.expr("transform(sequence(1, size(split(column_name, '='))), k -> substring_index(column_name, '=', k))")
    tried = names.groupBy("column_name").agg(F.count(F.lit(1)).alias("_columns")).withColumn("feature", F.explode(cuts))
    best = tried.join(known, "feature", "left").groupBy("column_name").agg(
        F.max("_columns").alias("_columns"), F.max(F.when(F.col("_parents").isNotNull(), F.struct(F.length("feature").alias("size"), "feature", "parent", "_parents"))).alias("_hit"))
    wrong = F.when(F.col("_hit._parents") > 1, F.raise_error(F.concat(F.lit("two parents: "), F.col("column_name")))).when(
        F.col("_columns") > 1, F.raise_error(F.concat(F.lit("repeated column: "), F.col("column_name"))))
    checked = best.select("column_name", F.coalesce(wrong.cast("string"), F.col("_hit.feature")).alias("feature"), F.col("_hit.parent").alias("parent"), F.col("_hit").isNotNull().alias("mapped"))
    return names.join(checked, "column_name")


def flatten_trees(model) -> list[tuple[float, list]]:
    """(weight, leaves) per tree; a leaf is (value, [(feature, threshold, goes_left, cover ratio)])."""
    out = []
    for tree, weight in zip(model.trees, model.treeWeights):
        leaves: list = []

        def walk(node, path):
            if node.getClass().getSimpleName() == "LeafNode":
                leaves.append((float(node.prediction()), path))
                return
            split, n = node.split(), float(node.impurityStats().count())
            f, t = int(split.featureIndex()), float(split.threshold())
            for child, left in ((node.leftChild(), True), (node.rightChild(), False)):
                walk(child, [*path, (f, t, left, float(child.impurityStats().count()) / n)])

        walk(tree._java_obj.rootNode(), [])
        out.append((float(weight), leaves))
    return out


def _leaf_shares(x: np.ndarray, value: float, path: list, phi: np.ndarray) -> float:
    """Exact Shapley shares of one leaf: a product of (follows the path | cover ratio) per feature."""
    ind: dict[int, np.ndarray] = {}
    ratio: dict[int, float] = {}
    for f, t, left, r in path:
        ok = (x[:, f] <= t) if left else (x[:, f] > t)
        ind[f] = ind[f] & ok if f in ind else ok
        ratio[f] = ratio.get(f, 1.0) * r
    m = len(ratio)
    shares = np.array([factorial(k) * factorial(m - k - 1) / factorial(m) for k in range(m)])
    for f in ratio:
        # coefficient k: sum over sets of k other features that follow the path, the rest by cover
        sets = np.zeros((m, len(x)))
        sets[0] = 1.0
        for g in ratio:
            if g != f:
                sets[1:] = ratio[g] * sets[1:] + ind[g] * sets[:-1]
                sets[0] *= ratio[g]
        phi[:, f] += value * (shares @ sets) * (ind[f] - ratio[f])
    return value * float(np.prod(list(ratio.values()))) if ratio else value


def tree_contributions(model, df: DataFrame, row: str, features: str = "features") -> DataFrame:
    """Path-dependent Shapley values of a boosted model on the margin scale, long form.

    Trees are a small parameter table shipped with the task; rows stay where they are.
    """
    trees = flatten_trees(model)
    width = int(model.numFeatures)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.asarray(pdf["x"].tolist(), dtype=float).reshape(len(pdf), width)
            phi, base = np.zeros_like(x), 0.0
            for weight, leaves in trees:
                base += sum(_leaf_shares(x, weight * v, p, phi) for v, p in leaves)
            yield pd.DataFrame({row: pdf[row], "base": base, "phi": list(phi)})

    kind = df.schema[row].dataType.simpleString()
    out = df.select(row, vector_to_array(features).alias("x")).mapInPandas(run, f"{row} {kind}, base double, phi array<double>")
    cells = F.filter(F.transform("phi", lambda v, i: F.struct(i.alias("column_index"), v.alias("contribution"))), lambda c: c["contribution"] != 0)
    return out.select(row, "base", F.explode(cells).alias("c")).select(row, "base", "c.*")
