"""Training and scoring with Spark ML: fold-local preprocessing, grids, out-of-fold prediction."""

from __future__ import annotations

import itertools
import json
import random
from collections.abc import Sequence
from dataclasses import dataclass, field
from math import isfinite
from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, OneHotEncoderModel, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import numeric as N
from .describe import stack
from .features import fit_rare
from .prefix import exact_quantiles
from .resample import grouped_folds
from .storage import keep

# fixed values: search spaces
ELASTIC_NET_GRID = [
    {"C": c, "mix": m}
    for c, m in itertools.product([0.003, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0], [0.0, 0.25, 0.5, 0.75, 1.0])
]


BOOSTED_SPACE = {
    "maxIter": [200, 400, 800], "maxDepth": [2, 3, 4, 5], "stepSize": [0.02, 0.05, 0.10], "minInstancesPerNode": [1, 5, 10],
    "subsamplingRate": [0.70, 0.85, 1.00], "featureSubsetStrategy": ["0.5", "0.75", "all"], "minInfoGain": [0.0, 0.1],
}


def boosted_grid(n: int = 40, seed: int = 20260700) -> list[dict]:
    """Seeded random settings of the boosted search without repeats, for ``tune`` with ``boosted=True``."""
    picked = random.Random(seed).sample(list(itertools.product(*BOOSTED_SPACE.values())), n)
    return [dict(zip(BOOSTED_SPACE, p)) for p in picked]


@dataclass
class Preprocessor:
    """Imputation, log1p, population-SD scaling and one-hot levels learnt from training rows only."""

    numeric: list[str]
    log: list[str]
    categorical: list[str]
    zero_fill: list[str] = field(default_factory=list)
    rare: dict[str, tuple[str, int]] = field(default_factory=dict)  # column: (entity column, entities a level needs)
    kept: dict[str, list[str]] = field(default_factory=dict)
    fills: dict[str, float] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    sds: dict[str, float] = field(default_factory=dict)
    indexer: object = None
    encoder: object = None

    def _filled(self, df: DataFrame) -> DataFrame:
        out = df
        for c in self.numeric:
            v = F.coalesce(F.col(c).cast("double"), F.lit(self.fills[c]))
            out = out.withColumn(f"_x_{c}", F.log1p(v) if c in self.log else v)
        return out

    def _levels(self, df: DataFrame) -> DataFrame:
        """Levels with too few entities in the training rows, and unseen ones, share one label."""
        return df.withColumns({
            f"_c_{c}": F.when(F.col(c).isin(self.kept[c]), F.col(c)).otherwise(fixed.RARE_LEVEL) if c in self.rare else F.col(c) for c in self.categorical})

    def fit(self, train: DataFrame, medians: dict[str, float] | None = None) -> "Preprocessor":
        known = medians
        if known is None:
            med = exact_quantiles(stack(train, [], self.numeric), ["variable"], "value", [0.5]).collect()  # one row per feature
            known = {r["variable"]: r["quantile"] for r in med}
        self.fills = {c: 0.0 if c in self.zero_fill else float(known.get(c, 0.0)) for c in self.numeric}
        filled = self._filled(train)
        aggs = [f(f"_x_{c}").alias(f"{n}_{c}") for c in self.numeric for n, f in (("m", F.avg), ("s", F.stddev_pop))]
        row = filled.agg(*aggs).first()
        self.means = {c: float(row[f"m_{c}"]) for c in self.numeric}
        self.sds = {c: float(row[f"s_{c}"]) or 1.0 for c in self.numeric}
        if self.categorical:
            for c, (entity, least) in self.rare.items():
                self.kept[c] = [r[0] for r in fit_rare(train, c, entity, least).select(c).collect()]  # one row per kept level
            idx, levels = [f"_i_{c}" for c in self.categorical], self._levels(train)
            self.indexer = StringIndexer(inputCols=[f"_c_{c}" for c in self.categorical], outputCols=idx, handleInvalid="keep", stringOrderType="alphabetAsc").fit(levels)
            # the indexer's place for unknown levels comes last and is dropped: an unknown level has no column
            self.encoder = OneHotEncoder(inputCols=idx, outputCols=[f"_o_{c}" for c in self.categorical], dropLast=True).fit(self.indexer.transform(levels))
        return self

    def names(self) -> list[str]:
        out = list(self.numeric)
        for c, labels in zip(self.categorical, self.indexer.labelsArray if self.indexer else []):
            out += [f"{c}={lv}" for lv in labels]
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        """Append the encoded vector, sparse where one-hot columns are; its width is that of names()."""
        out = self._filled(df)
        scaled = F.array(*[(F.col(f"_x_{c}") - F.lit(self.means[c])) / F.lit(self.sds[c]) for c in self.numeric])
        out = out.withColumn("_n", array_to_vector(scaled))
        if self.categorical:
            out = self.encoder.transform(self.indexer.transform(self._levels(out)))
        out = VectorAssembler(inputCols=["_n", *(f"_o_{c}" for c in self.categorical)], outputCol="_v").transform(out)
        drop = [f"_x_{c}" for c in self.numeric] + [f"_{k}_{c}" for c in self.categorical for k in "ioc"] + ["_n", "_v"]
        # without the columns' attributes, so trees treat one-hot columns as numbers
        return out.withColumn("features", F.col("_v").alias("features", metadata={"encoded": True})).drop(*drop)


def fit_elastic_net(train: DataFrame, y: str, C: float, mix: float, rows: int | None = None, max_iter: int = 10_000):
    """Library penalty ``C`` on the summed loss equals ``1 / (C n)`` on the mean loss, n being the rows of the part that is fitted."""
    n = rows or train.count()
    lr = LogisticRegression(labelCol=y, featuresCol="features", regParam=1.0 / (C * n), elasticNetParam=mix, standardization=False, maxIter=max_iter)
    return lr.fit(train)


def converged(model, max_iter: int = 10_000) -> bool:
    """A linear fit that ended before its last allowed step."""
    return model.summary.totalIterations < max_iter


def fit_boosted(train: DataFrame, y: str, params: dict, seed: int = 1):
    return GBTClassifier(labelCol=y, featuresCol="features", seed=seed, **params).fit(train)


def mean_log_loss(scored: DataFrame, y: str) -> float:
    p = N.clip("p", fixed.DOUBLE_EPS, 1 - fixed.DOUBLE_EPS)
    return scored.agg(F.avg(-(F.col(y) * F.ln(p) + (1 - F.col(y)) * F.ln(1 - p)))).first()[0]


def tune(train: DataFrame, y: str, fold: str, folds: int, prep, grid: Sequence[dict], max_iter: int = 10_000, boosted: bool = False, parallelism: int = 4) -> DataFrame:
    """Mean inner log loss of each setting of either family; preprocessing and penalty are those of each inner training part.

    A setting is valid if every inner fit converged to a finite loss. The lowest mean loss among valid settings is chosen, ties go to the
    lower id; without a valid one none is.
    """
    sums, valid = [0.0] * len(grid), [True] * len(grid)
    for k in range(folds):
        pre = prep().fit(train.where(F.col(fold) != k))
        ready = keep(pre.apply(train).select(y, fold, "features"), "inner_split")
        part, check = ready.where(F.col(fold) != k).cache(), ready.where(F.col(fold) == k).cache()
        rows = part.count()

        def one(g: dict) -> tuple[float | None, bool]:
            model = fit_boosted(part, y, g) if boosted else fit_elastic_net(part, y, g["C"], g["mix"], rows, max_iter)
            return mean_log_loss(positive_probability(model.transform(check)), y), boosted or converged(model, max_iter)

        with ThreadPool(parallelism) as pool:  # fits are short and independent: several run at a time
            for i, (loss, ended) in enumerate(pool.map(inheritable_thread_target(train.sparkSession)(one), grid)):
                valid[i] = valid[i] and ended and loss is not None and isfinite(loss)
                sums[i] += loss if loss is not None else float("nan")
        part.unpersist()
        check.unpersist()
    rows = [(i, json.dumps(g), sums[i] / folds, valid[i]) for i, g in enumerate(grid)]
    best = min((r for r in rows if r[3]), key=lambda r: (r[2], r[0]), default=(None,))[0]
    out = train.sparkSession.createDataFrame(rows, "config_id int, setting string, mean_log_loss double, valid boolean")
    return out.withColumn("chosen", F.col("config_id").eqNullSafe(F.lit(best).cast("int")))


def nested_predict(df: DataFrame, fold: str, folds: int, y: str, group: str, prep, grid: Sequence[dict], ids: Sequence[str], inner: int = 4, seed: int = 12) -> DataFrame:
    """Out-of-fold probabilities of an elastic net tuned anew inside every outer training part."""
    out = None
    for k in range(folds):
        train, valid = df.where(F.col(fold) != k), df.where(F.col(fold) == k)
        inner_folds = grouped_folds(train, group, y, inner, seed).select(group, F.col("fold").cast("int").alias("_inner"))
        chosen = tune(train.join(inner_folds, group), y, "_inner", inner, prep, grid).where("chosen").first()
        if chosen is None:
            raise ValueError(f"no setting converged in outer fold {k}")
        pre = prep().fit(train)
        setting = json.loads(chosen["setting"])
        model = fit_elastic_net(pre.apply(train), y, setting["C"], setting["mix"])
        part = positive_probability(model.transform(pre.apply(valid))).select(*ids, fold, y, F.lit(chosen["config_id"]).alias("config_id"), "p")
        out = part if out is None else out.unionByName(part)
    return out


def save_final(folder: str, pre: Preprocessor, model) -> None:
    """Write a fitted model and its preprocessing below `folder`, which all machines share."""
    model.write().save(f"{folder}/model")
    if pre.categorical:
        pre.indexer.write().save(f"{folder}/indexer")
        pre.encoder.write().save(f"{folder}/encoder")
    plain = {k: getattr(pre, k) for k in ("numeric", "log", "categorical", "zero_fill", "rare", "kept", "fills", "means", "sds")}
    SparkSession.getActiveSession().createDataFrame([(json.dumps(plain),)], "spec string").coalesce(1).write.text(f"{folder}/spec")


def load_final(folder: str, model_class) -> tuple[Preprocessor, object]:
    """A saved preprocessing and model; `model_class` is the class of the fitted model."""
    spec = json.loads(SparkSession.getActiveSession().read.text(f"{folder}/spec").first()[0])
    pre = Preprocessor(**{**spec, "rare": {c: tuple(v) for c, v in spec["rare"].items()}})
    if pre.categorical:
        pre.indexer, pre.encoder = StringIndexerModel.load(f"{folder}/indexer"), OneHotEncoderModel.load(f"{folder}/encoder")
    return pre, model_class.load(f"{folder}/model")


def positive_probability(df: DataFrame, name: str = "p") -> DataFrame:
    return df.withColumn(name, F.element_at(vector_to_array("probability"), 2))


def training_medians(df: DataFrame, numeric: Sequence[str], fold: str, folds: int) -> dict[int, dict[str, float]]:
    """Exact medians of every training part (all rows but one fold) in one pass over the data."""
    parts = df.withColumn("_out", F.explode(F.array(*[F.lit(k) for k in range(folds)]))).where(F.col("_out") != F.col(fold))
    med = exact_quantiles(stack(parts, ["_out"], numeric), ["_out", "variable"], "value", [0.5]).collect()  # folds × features
    out: dict[int, dict[str, float]] = {k: {} for k in range(folds)}
    for r in med:
        out[r["_out"]][r["variable"]] = r["quantile"]
    return out


def oof_predict(df: DataFrame, fold: str, folds: int, y: str, prep, fit, ids: Sequence[str], pipeline: str) -> tuple[DataFrame, list]:
    """Out-of-fold probabilities: preprocessing and fit see only the other folds."""
    out, models = None, []
    medians = training_medians(df, prep().numeric, fold, folds)
    for k in range(folds):
        train, valid = df.where(F.col(fold) != k), df.where(F.col(fold) == k)
        pre = prep().fit(train, medians[k])
        model = fit(pre.apply(train))
        part = positive_probability(model.transform(pre.apply(valid))).select(*ids, fold, y, F.lit(pipeline).alias("pipeline"), "p")
        models.append((k, pre, model))
        out = part if out is None else out.unionByName(part)
    return out, models


def fit_final(df: DataFrame, prep, fit):
    pre = prep().fit(df)
    return pre, fit(pre.apply(df))


def score(model, pre, df: DataFrame, ids: Sequence[str]) -> DataFrame:
    return positive_probability(model.transform(pre.apply(df))).select(*ids, "p")


def score_checks(scored: DataFrame, key: Sequence[str]) -> DataFrame:
    return scored.agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("p").isNull() | F.isnan("p"), 1)).alias("null_scores"),
        F.count(F.when((F.col("p") < 0) | (F.col("p") > 1), 1)).alias("out_of_range"),
        (F.count(F.lit(1)) - F.countDistinct(F.struct(*key))).alias("repeated_keys"),
    )


def coefficients(spark, models: list) -> DataFrame:
    """Coefficient per encoded column and fold; a level absent in a fold is stated, not dropped."""
    rows = [(k, n, float(c)) for k, pre, m in models for n, c in zip(pre.names(), m.coefficients.toArray())]
    table = spark.createDataFrame(rows, "fold int, column_name string, coefficient double")
    names = table.select("column_name").distinct()
    grid = names.withColumn("fold", F.explode(F.array(*[F.lit(k) for k, _, _ in models])))
    return grid.join(table, ["column_name", "fold"], "left").withColumn("present", F.col("coefficient").isNotNull()).withColumn(
        "coefficient", F.coalesce("coefficient", F.lit(0.0))
    )


def split_importance(spark, models: list) -> DataFrame:
    """Gain share and number of splits per encoded column and fold."""
    from .attribution import flatten_trees

    rows = []
    for k, pre, m in models:
        gain = m.featureImportances.toArray()
        splits: dict[int, set] = {}
        for i, (_, leaves) in enumerate(flatten_trees(m)):
            for _, path in leaves:
                for d, (f, t, _, _) in enumerate(path):
                    splits.setdefault(f, set()).add((i, tuple(s[2] for s in path[:d]), t))
        rows += [(k, n, float(gain[j]), len(splits.get(j, ()))) for j, n in enumerate(pre.names())]
    return spark.createDataFrame(rows, "fold int, column_name string, gain double, splits int")
