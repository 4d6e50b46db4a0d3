"""Quality classifier by co-training of two views of a document: its text content and its page metadata.

Each view has a logistic model on its own features. In every round each view labels pool rows it is confident of, and the other view
learns from them. Each view is then calibrated on rows that no model has seen, and a last logistic model combines the calibrated views.
Fitting uses bounded samples; features of all documents and their scores are DataFrame expressions, so nothing leaves the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, let, stored, whole_text
from .quality_rules import CLASS_COUNTS, counted

#: Bounds of the samples: labelled rows, and pool rows without label, each in the order of a seeded hash.
LABELLED_ROWS, POOL_ROWS = 12000, 12000
ROUNDS, CONFIDENT, PER_ROUND = 4, 0.97, 1500
#: Buckets of hashed metadata values.
SOURCE_BUCKETS, LANG_BUCKETS = 32, 16
SEED = 5
#: Characters added to a text's length in shares that say little about a short text.
SHORT = 40


def per(count: Column, of: Column) -> Column:
    return count / F.greatest(of, F.lit(1))


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, text_view and meta_view (arrays of doubles) for every row. Nulls: an empty text, a metadata value like any other."""
    base = counted(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source")), "text")
    lines = F.filter(F.split(whole_text("text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = base.withColumn("lines", let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("distinct"))))
    triples = F.when(F.size("words") > 3, F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - 2, F.lit(1))), lambda i: F.xxhash64(F.slice("words", i, 3)))).otherwise(
        F.array().cast("array<bigint>"))
    chars = sum(F.col(c) for c in CLASS_COUNTS)
    words, letters = F.col("n_words"), F.col("n_lower") + F.col("n_letter")
    text_view = F.array(
        *(per(F.col(c), chars if c in ("n_lower", "n_space") else chars + SHORT) for c in CLASS_COUNTS), per(F.col("n_letter"), letters + SHORT), per(letters, words), F.log1p(words), per(words, F.col("lines.n")),
        per(F.size(F.array_distinct("words")), words), 1 - per(F.col("lines.distinct"), F.col("lines.n")),
        let(triples, lambda t: F.when(F.size(t) > 0, 1 - F.size(F.array_distinct(t)) / F.size(t)).otherwise(F.lit(0.0))),
        F.least(words, F.lit(20)) / 20,
    )
    size = F.log1p(F.octet_length(whole_text("text")))
    bucket = lambda c, n, seed: F.pmod(F.xxhash64(F.col(c), F.lit(seed)), F.lit(n))
    one_hot = lambda c, n, seed: [F.when(bucket(c, n, seed) == k, 1.0).otherwise(0.0) for k in range(n)]
    meta_view = F.array(size, size * size, *one_hot("source", SOURCE_BUCKETS, 1), *one_hot("lang", LANG_BUCKETS, 2))
    cast = lambda a: F.transform(a, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    return base.select("doc_id", cast(text_view).alias("text_view"), cast(meta_view).alias("meta_view"))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 25) -> np.ndarray:
    """Weights (the last is the intercept) by Newton steps on the ridge-penalised log-likelihood."""
    z = np.c_[x, np.ones(len(x))]
    w, penalty = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], ridge), 1e-6] * max(len(x), 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def logit(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


@dataclass
class CoTrained:
    """For each view: mean and spread of its features, weights, calibration (slope, intercept); last the combination of the two views."""

    means: list[np.ndarray]
    spreads: list[np.ndarray]
    weights: list[np.ndarray]
    calibration: list[np.ndarray]
    combination: np.ndarray
    exchanged: list[tuple[int, int]]  # pseudo-labels each view gave in each round


def co_train(views: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], rounds: int = ROUNDS) -> CoTrained:
    """Every fifth labelled row is kept for calibration and combination; the rest starts both views.

    A view gives the pool rows of both kinds it is surest of, at least CONFIDENT, PER_ROUND rows at most and in the labels' proportion.
    """
    means = [v.mean(axis=0) for v in views]
    spreads = [np.where(v.std(axis=0) > 1e-9, v.std(axis=0), 1) for v in views]
    views, pool = ([(v - m) / s for v, m, s in zip(part, means, spreads)] for part in (views, pool))
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(y), bool)  # too few rows to keep any back
    start, check = ~held, held if held.any() else ~held
    extra: list[dict[int, int]] = [{}, {}]  # pool row -> pseudo-label a view has been given
    share, exchanged = y[start].mean(), []

    def fit(k: int) -> np.ndarray:
        at = np.fromiter(extra[k], np.int64, len(extra[k]))
        given = np.fromiter(extra[k].values(), float, len(extra[k]))
        return fit_logistic(np.concatenate([views[k][start], pool[k][at]]), np.concatenate([y[start], given]))

    for _ in range(rounds):
        models, gave = [fit(0), fit(1)], []
        for k in (0, 1):
            p, given = predict(pool[k], models[k]), 0
            for label, sure, most in ((1, p, round(PER_ROUND * share)), (0, 1 - p, round(PER_ROUND * (1 - share)))):
                order = np.argsort(-sure, kind="stable")
                new = [i for i in order[sure[order] >= CONFIDENT].tolist() if i not in extra[1 - k]][:most]
                extra[1 - k].update((i, label) for i in new)
                given += len(new)
            gave.append(given)
        exchanged.append((gave[0], gave[1]))
        if not any(gave):
            break
    weights = [fit(0), fit(1)]
    raw = [logit(predict(views[k][check], weights[k])) for k in (0, 1)]
    calibration = [fit_logistic(r[:, None], y[check], 1e-4) for r in raw]
    both = np.c_[[logit(predict(r[:, None], c)) for r, c in zip(raw, calibration)]].T
    return CoTrained(means, spreads, weights, calibration, fit_logistic(both, y[check], 1e-4), exchanged)


def _sure(logit_: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(logit_, F.lit(-30.0)), F.lit(30.0))))


def scored(rows: DataFrame, model: CoTrained) -> DataFrame:
    """Append text_score, meta_score (calibrated views) and score to feature rows."""
    logits = []
    for k, view in enumerate(("text_view", "meta_view")):
        scale, w = model.weights[k][:-1] / model.spreads[k], model.weights[k]
        shift = float(w[-1] - scale @ model.means[k])
        factors = F.array(*(F.lit(float(v)) for v in scale))
        raw = F.aggregate(F.zip_with(F.col(view), factors, lambda a, b: a * b), F.lit(shift), lambda s, x: s + x)
        raw = F.least(F.greatest(raw, F.lit(-30.0)), F.lit(30.0))
        logits.append(raw * float(model.calibration[k][0]) + float(model.calibration[k][1]))
    a, b, c = map(float, model.combination)
    out = rows.withColumns({"__text": logits[0], "__meta": logits[1]})
    return out.withColumns({
        "text_score": _sure(F.col("__text")), "meta_score": _sure(F.col("__meta")), "score": _sure(F.col("__text") * a + F.col("__meta") * b + c)}).drop("__text", "__meta")


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", labelled: int = LABELLED_ROWS, pool: int = POOL_ROWS) -> CoTrained | None:
    """Co-train on at most `labelled` labelled rows and `pool` others; None if the labels are not of both kinds."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.min(F.col(label).cast("int")).alias("label"))
    order = [F.xxhash64("doc_id", F.lit(SEED)), F.col("doc_id")]
    chosen = stored(known.orderBy(*order).limit(labelled), "quality_sample")
    ids = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id")).join(known.select("doc_id"), "doc_id", "left_anti").distinct()
    others = stored(ids.orderBy(*order).limit(pool).withColumn("label", F.lit(None).cast("int")), "quality_pool")
    picked = docs.select(F.col(doc_id).alias("doc_id"), "text", "lang", "source").join(F.broadcast(chosen.unionByName(others)), "doc_id")  # bounded by the two parameters
    marks = picked.select("doc_id", "label").distinct()
    rows = features(picked).dropDuplicates(["doc_id"]).join(marks, "doc_id").orderBy("doc_id").collect()
    y = np.array([r["label"] for r in rows if r["label"] is not None], dtype=float)
    if len(set(y.tolist())) < 2:
        return None
    part = lambda view, have: np.array([r[view] for r in rows if (r["label"] is not None) == have]).reshape(-1, len(rows[0][view]))
    return co_train([part("text_view", True), part("meta_view", True)], y, [part("text_view", False), part("meta_view", False)])


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Return doc_id, score (P of good quality), text_score, meta_score, kept (score of a half or more) for every row.

    Texts that are null, empty or very long are rows like others. Without labels of both kinds the scores are null and every row is kept.
    Rows that repeat an id are scored one by one; in fitting one of them stands for all, and of different labels for an id the lower one
    holds. An empty table gives an empty result. Other columns are not read.
    """
    model = train(docs, labels)
    if model is None:
        none = F.lit(None).cast("double")
        return docs.select("doc_id", none.alias("score"), none.alias("text_score"), none.alias("meta_score"), F.lit(True).alias("kept"))
    return scored(features(docs), model).select("doc_id", "score", "text_score", "meta_score", (F.col("score") >= 0.5).alias("kept"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
