"""Nested tuning of elastic-net models: all training parts, feature sets and penalties are fitted in the same passes over the rows.

A part is an outer training part or an inner one inside it. Which parts a row trains is a matter of its entity's folds, so rows are kept
once, raw; a task encodes its rows for each part (fills, scales and levels are those of the part), and one pass adds up, for all parts,
the gradients of all settings at once. The sums of a part meet in one task, where every setting takes a proximal step on the quadratic
that bounds its loss; what meets is a matrix of columns by settings, however many rows there are. The next pass starts ahead of it by
the setting's momentum (accelerated proximal steps, begun anew where they point uphill). Passes go on until no coefficient moves. Settings
that still move after MAX_PASSES, as with few rows of one label, go on by Newton steps on their own curvature, halved where the loss would
grow. The driver sees settings, coefficients and column statistics, never rows.

A part whose rows all have one label has no finite fit: its intercept would grow without end. The log loss is clipped at DOUBLE_EPS, and
that loss is least with coefficients of zero and the intercept at the bound, whatever the setting; this is the fit of such a part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from . import features as FE
from .describe import stack
from .prefix import exact_quantiles
from .resample import grouped_folds, nested_folds
from .storage import keep

TOLERANCE, EXACT, MAX_PASSES, INNER_STEPS = 1e-5, 1e-11, 200, 400
TIE = 1e-9  # mean losses nearer than this are equal
NEWTON_FITS = 32  # settings whose own curvatures are summed in one pass


@dataclass
class Inputs:
    """Columns of a model table by treatment; a set is a list of features, and sets are fitted side by side."""

    sets: dict[str, list[str]]
    numeric: list[str]
    log: list[str]
    median: list[str]  # missing values become the training part's median; of other columns zero
    categorical: list[str]
    rare: dict[str, int]  # entities that a level of the column needs
    entity: str = "entity"
    key: str = "pair_id"
    y: str = "label"


def inputs_of(table: DataFrame, sets: dict[str, list[str]], least: int) -> Inputs:
    types, names = dict(table.dtypes), list(dict.fromkeys(n for s in sets.values() for n in s))
    kinds = {n: FE.feature_kind(n, types[n]) for n in names}
    numeric = [n for n in names if types[n] != "string"]
    return Inputs(
        sets, numeric, [n for n in numeric if kinds[n][1].startswith("log1p")], [n for n in numeric if kinds[n][2].startswith("median")],
        [n for n in names if types[n] == "string"], {n: least for n in names if kinds[n][2] == "rare level"})


def folded_rows(table: DataFrame, inputs: Inputs, outer: int, inner: int, seed: int, full: bool = False) -> DataFrame:
    """The model table's rows with their fold, the parts they train (`parts`) and those they check (`checks`).

    Part number: outer fold left out * (inner + 1) + 1 + inner fold left out, or + 0 for the whole outer training part. With `full` there
    is one more outer part, number `outer`, which leaves no fold out.
    """
    lefts = outer + int(full)
    folds = grouped_folds(table, inputs.entity, inputs.y, outer, seed).select(inputs.entity, F.col("fold").cast("int").alias("fold"))
    deep = nested_folds(table, folds, inputs.entity, inputs.y, inner, seed + 1, lefts)
    by_outer = deep.groupBy(inputs.entity).agg(F.map_from_entries(F.collect_list(F.struct("outer_fold", F.col("fold").cast("int")))).alias("inner"))
    step = inner + 1
    train = f"filter(sequence(0, {lefts * step - 1}), p -> int(p div {step}) <> fold and (p % {step} = 0 or p % {step} - 1 <> inner[int(p div {step})]))"
    check = f"filter(sequence(0, {lefts * step - 1}), p -> if(p % {step} = 0, int(p div {step}) = fold, int(p div {step}) <> fold and p % {step} - 1 = inner[int(p div {step})]))"
    entities = folds.join(by_outer, inputs.entity, "left").select(inputs.entity, "fold", F.expr(train).alias("parts"), F.expr(check).alias("checks"))
    return table.join(entities, inputs.entity)


def numeric_statistics(rows: DataFrame, inputs: Inputs) -> DataFrame:
    """part, variable, rows, fill, mean, sd (0 becomes 1) of every numeric column; sums are taken by entity first."""
    members = rows.select(inputs.entity, "parts").distinct().select(inputs.entity, F.explode("parts").alias("part"))
    value = F.when(F.col("variable").isin(inputs.log), F.log1p("value")).otherwise(F.col("value"))
    sums = stack(rows, [inputs.entity], inputs.numeric).withColumn("x", value).groupBy(inputs.entity, "variable").agg(
        F.count(F.lit(1)).alias("rows"), F.count("x").alias("known"), F.sum("x").alias("s1"), F.sum(F.col("x") * F.col("x")).alias("s2"))
    totals = members.join(sums, inputs.entity).groupBy("part", "variable").agg(*(F.sum(c).alias(c) for c in ("rows", "known", "s1", "s2")))
    cells = stack(rows.select(F.explode("parts").alias("part"), *inputs.median), ["part"], inputs.median)
    medians = exact_quantiles(cells, ["part", "variable"], "value", [0.5]).select("part", "variable", F.col("quantile").alias("median"))
    filled = totals.join(medians, ["part", "variable"], "left").withColumn("fill", F.coalesce("median", F.lit(0.0)))
    at = F.when(F.col("variable").isin(inputs.log), F.log1p("fill")).otherwise(F.col("fill"))
    gaps = F.col("rows") - F.col("known")
    mean = (F.coalesce("s1", F.lit(0.0)) + gaps * at) / F.col("rows")
    var = (F.coalesce("s2", F.lit(0.0)) + gaps * at * at) / F.col("rows") - mean * mean
    spread = F.when(var > 1e-12, F.sqrt(var)).otherwise(1.0)
    return filled.select("part", "variable", "rows", "fill", mean.alias("mean"), spread.alias("sd"))


def level_statistics(rows: DataFrame, inputs: Inputs) -> DataFrame:
    """part, variable, level of every one-hot column; levels of too few entities share one."""
    members = rows.select(inputs.entity, "parts").distinct().select(inputs.entity, F.explode("parts").alias("part"))
    seen = stack(rows, [inputs.entity], inputs.categorical, "string").where("value is not null").distinct()
    support = members.join(seen, inputs.entity).groupBy("part", "variable", "value").agg(F.countDistinct(inputs.entity).alias("entities"))
    least = F.lit(0)
    for column, n in inputs.rare.items():
        least = F.when(F.col("variable") == column, n).otherwise(least)
    level = F.when(F.col("entities") >= least, F.col("value")).otherwise(fixed.RARE_LEVEL)
    return support.select("part", "variable", level.alias("level")).distinct()


class Design:
    """Encoding of rows for one part: numeric columns, then one-hot columns, then the intercept."""

    def __init__(self, inputs: Inputs, numeric: list, levels: list):
        by = {r["variable"]: r for r in numeric}
        self.fill, self.mean, self.sd = (np.array([by[n][c] for n in inputs.numeric], dtype=float) for c in ("fill", "mean", "sd"))
        self.log = np.array([n in inputs.log for n in inputs.numeric], dtype=bool)
        self.rows = numeric[0]["rows"] if numeric else 0
        self.share = 0.5  # of the part's rows, those with label 1
        self.columns = [*((n, None) for n in inputs.numeric), *sorted((r["variable"], r["level"]) for r in levels)]
        self.places = [{lv: k for k, (n, lv) in enumerate(self.columns) if n == c and lv is not None} for c in inputs.categorical]
        self.mask = np.array([[n in inputs.sets[s] for s in inputs.sets] for n, _ in self.columns] + [[True] * len(inputs.sets)])

    def encode(self, numeric: np.ndarray, categorical: list[list]) -> np.ndarray:
        x = np.zeros((len(numeric), len(self.columns) + 1))
        v = np.where(np.isnan(numeric), self.fill, numeric)
        v[:, self.log] = np.log1p(v[:, self.log])
        x[:, : v.shape[1]] = (v - self.mean) / self.sd
        for places, values in zip(self.places, categorical):
            rare = places.get(fixed.RARE_LEVEL, -1)
            at = np.array([places.get(c, rare) for c in values], dtype=np.int64)
            x[np.flatnonzero(at >= 0), at[at >= 0]] = 1.0
        x[:, -1] = 1.0
        return x


@dataclass
class Fit:
    """Settings of one part side by side: coefficients (columns and intercept by settings), penalties, and which settings may use which column.

    A Newton fit has one setting, whose own curvature is summed in every pass.
    """

    weights: np.ndarray
    l1: np.ndarray
    l2: np.ndarray
    mask: np.ndarray
    curvature: np.ndarray | None = None  # of the bounding quadratic, once known; None: sum it up in this pass
    newton: bool = False
    reached: np.ndarray | None = None  # where the last step ended; `weights` is where the next one starts
    momentum: np.ndarray | None = None  # by setting
    part: int = 0
    settled: bool = False  # one label only: nothing to move
    base: np.ndarray | None = None  # of a Newton fit, the last point that lowered the loss, and the penalised loss there
    value: float | None = None

    def alone(self, k: int) -> Fit:
        """A Newton fit of one setting, from where it stands."""
        return Fit(self.weights[:, [k]], self.l1[[k]], self.l2[[k]], self.mask[:, [k]], newton=True, part=self.part)

    def advance(self, new: np.ndarray, still: np.ndarray, value: float | None = None) -> None:
        """Take the step that ended in `new`; settings that stand still and those whose momentum points uphill start without any.

        Of a Newton fit, `value` is the penalised loss where the step began, or None if that point is given up.
        """
        if self.newton:
            if value is not None:
                self.base, self.value = self.weights, value
            self.weights = self.reached = new
            return
        before = np.zeros_like(new) if self.reached is None else self.reached
        t = np.ones(new.shape[1]) if self.momentum is None else self.momentum
        t = np.where(still | (((self.weights - new) * (new - before)).sum(axis=0) > 0), 1.0, t)
        grown = (1 + np.sqrt(1 + 4 * t * t)) / 2
        self.weights, self.reached, self.momentum = new + np.where(still, 0.0, (t - 1) / grown) * (new - before), new, grown


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def stepped(fit: Fit, gradient: np.ndarray, curvature: np.ndarray) -> np.ndarray:
    """Minimum of the quadratic at the fit's coefficients plus the penalties, by accelerated proximal steps, for every setting.

    Under the bounding quadratic a hundredth of the way is left to the next pass, which moves the quadratic anyway.
    """
    start, inner = fit.weights, np.ones((len(fit.weights), 1))
    inner[-1] = 0.0  # the intercept has no penalty
    pace = 1 / (np.linalg.eigvalsh(curvature)[-1] + fit.l2.max() + 1e-12)
    now = ahead = start
    t = 1.0
    for _ in range(INNER_STEPS if not fit.newton else 20 * INNER_STEPS):
        slope = gradient + curvature @ (ahead - start) + inner * fit.l2 * ahead
        moved = ahead - pace * slope
        new = np.sign(moved) * np.maximum(np.abs(moved) - pace * fit.l1 * inner, 0.0) * fit.mask
        if (np.sum((ahead - new) * (new - now)) > 0) and t > 1:  # momentum points uphill: start it anew
            t, ahead = 1.0, now
            continue
        grown = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, t = new + (t - 1) / grown * (new - now), grown
        done = np.abs(new - now).max() < max(EXACT, 0.0 if fit.newton else 0.01 * np.abs(new - start).max())
        now = new
        if done:
            break
    return now


SUMS = "fit int, width int, payload binary"


def _rows_of(batch: pa.RecordBatch, inputs: Inputs):
    numeric = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in inputs.numeric]) if inputs.numeric else np.zeros((len(batch), 0))
    categorical = [batch.column(n).to_pylist() for n in inputs.categorical]
    y = batch.column(inputs.y).to_numpy(zero_copy_only=False).astype(float)
    return numeric, categorical, y


def _chosen(batch: pa.RecordBatch, column: str, part: int) -> np.ndarray:
    return np.array([part in p for p in batch.column(column).to_pylist()], dtype=bool)


def _sums(shared, inputs: Inputs):
    """Sums of a task for every fit: gradients of all settings, where asked for curvature, of Newton fits the loss; one array a fit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        designs, fits = shared.value
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            numeric, categorical, y = _rows_of(batch, inputs)
            encoded: dict[int, tuple] = {}
            for key, fit in fits.items():
                if fit.part not in encoded:  # fits of a part follow each other
                    at = np.flatnonzero(_chosen(batch, "parts", fit.part))
                    encoded = {fit.part: (at, designs[fit.part].encode(numeric[at], [[c[i] for i in at] for c in categorical]))}
                at, x = encoded[fit.part]
                if not len(at):
                    continue
                z = x @ fit.weights
                p = sigmoid(z)
                found = [x.T @ (p - y[at, None])]
                if fit.newton or fit.curvature is None:
                    bend = p[:, :1] * (1 - p[:, :1]) if fit.newton else np.full((len(at), 1), 0.25)
                    found.append((x * bend).T @ x)
                if fit.newton:
                    loss = np.zeros((x.shape[1], 1))
                    loss[0] = (np.logaddexp(0.0, z[:, 0]) - y[at] * z[:, 0]).sum()
                    found.append(loss)
                found.append((x.T @ y[at])[:, None])
                both = np.concatenate(found, axis=1)
                held[key] = held[key] + both if key in held else both
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()), pa.array([v.shape[1] for v in held.values()], pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["fit", "width", "payload"])

    return run


STEPS = "fit int, weights binary, moved binary, gradient binary, curvature binary, target binary, value double"


def _step(shared):
    """Add up a fit's sums, and move its settings. Of a Newton fit `value` is the penalised loss, or null if it grew and the step is halved."""
    def run(key, found):
        designs, fits = shared.value
        fit = fits[key[0].as_py()]
        n = designs[fit.part].rows
        width = found.column("width")[0].as_py()
        total = sum(np.frombuffer(v.as_py()).reshape(-1, width) for v in found.column("payload")) / n
        columns, settings = fit.weights.shape
        gradient, target = total[:, :settings], total[:, -1]
        summed = fit.newton or fit.curvature is None
        curvature, value = total[:, settings : settings + columns] if summed else fit.curvature, None
        if fit.newton:
            w = fit.weights[:-1, 0]
            value = float(total[0, -2] + fit.l1[0] * np.abs(w).sum() + 0.5 * fit.l2[0] * (w * w).sum())
        if fit.settled:
            new, moved = fit.weights, np.zeros(settings)
        elif fit.newton and fit.value is not None and not value <= fit.value + EXACT:
            new, value = (fit.base + fit.weights) / 2, None
            moved = np.abs(new - fit.base).max(axis=0)
        else:
            new = stepped(fit, gradient, curvature)
            moved = np.abs(new - fit.weights).max(axis=0)
        values = [new, moved, gradient, curvature if summed else np.zeros(0), target]
        return pa.Table.from_arrays(
            [pa.array([key[0].as_py()], pa.int32()), *(pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in values), pa.array([value], pa.float64())], names=[c.split()[0] for c in STEPS.split(", ")])

    return run


def fit_all(rows: DataFrame, inputs: Inputs, designs: dict[int, Design], fits: dict[int, Fit], tolerance: float) -> tuple[dict[int, np.ndarray], dict[int, tuple]]:
    """Pass over `rows` until no setting of any fit moves by more than `tolerance`; fits leave as they come to rest.

    Returns, by the fits' keys, which settings came to rest, and the gradient and target sums of the last pass. `fits` hold the coefficients;
    without any there is nothing to do.
    """
    rest, last, todo = {}, {}, dict(fits)
    context = rows.sparkSession.sparkContext
    for _ in range(MAX_PASSES if todo else 0):
        shared = context.broadcast((designs, todo))
        found = rows.mapInArrow(_sums(shared, inputs), SUMS).repartition(len(todo), "fit").groupBy("fit").applyInArrow(
            _step(shared), STEPS).collect()  # coefficients of each fit
        shared.destroy()
        for r in found:
            fit = todo[r["fit"]]
            shape = fit.weights.shape
            moved = np.frombuffer(r["moved"])
            last[r["fit"]] = (np.frombuffer(r["gradient"]).reshape(shape), np.frombuffer(r["target"]), fit.weights)
            rest[r["fit"]] = moved < tolerance
            fit.advance(np.frombuffer(r["weights"]).reshape(shape).copy(), rest[r["fit"]], r["value"])
            if not fit.newton and fit.curvature is None:
                fit.curvature = np.frombuffer(r["curvature"]).reshape(shape[0], shape[0])
        todo = {p: f for p, f in todo.items() if not rest[p].all()}
        if not todo:
            break
    for fit in fits.values():
        fit.weights = fit.weights if fit.reached is None else fit.reached
    return rest, last


def _losses(shared, inputs: Inputs):
    """Sum of log loss of every setting over a part's check rows, and their number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        designs, fits = shared.value
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            numeric, categorical, y = _rows_of(batch, inputs)
            for part, fit in fits.items():
                at = np.flatnonzero(_chosen(batch, "checks", part))
                if not len(at):
                    continue
                p = np.clip(sigmoid(designs[part].encode(numeric[at], [[c[i] for i in at] for c in categorical]) @ fit.weights), fixed.DOUBLE_EPS, 1 - fixed.DOUBLE_EPS)
                loss = -(y[at, None] * np.log(p) + (1 - y[at, None]) * np.log(1 - p)).sum(axis=0)
                held[part] = held.get(part, 0) + np.r_[loss, len(at)]
        rows = [(part, k, v[k], v[-1]) for part, v in held.items() for k in range(len(v) - 1)]
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.float64(), pa.float64()))], ["part", "at", "loss", "n"])

    return run


def _scores(shared, inputs: Inputs, step: int, kept: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        designs, fits = shared.value
        for batch in batches:
            numeric, categorical, _ = _rows_of(batch, inputs)
            fold = batch.column("fold").to_numpy()
            for k, name in enumerate(inputs.sets):
                p, fitted = np.zeros(len(batch)), np.zeros(len(batch), dtype=bool)
                for f in np.unique(fold):
                    at = np.flatnonzero(fold == f)
                    part = int(f) * step
                    if (part, k) not in fits:
                        continue
                    fitted[at] = True
                    p[at] = sigmoid(designs[part].encode(numeric[at], [[c[i] for i in at] for c in categorical]) @ fits[part, k].weights)[:, 0]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([name] * len(batch), pa.string()), pa.array(p, mask=~fitted)], [*kept, "feature_set", "p"])

    return run


def _contributions(shared, inputs: Inputs, step: int, kept: Sequence[str], full: int):
    """Each row's contributions, summed with sign over a feature's columns: by the fit that did not see the row, and by the full fit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        designs, fits = shared.value
        for batch in batches:
            numeric, categorical, _ = _rows_of(batch, inputs)
            fold = batch.column("fold").to_numpy()
            for k, (name, features) in enumerate(inputs.sets.items()):
                place = {f: j for j, f in enumerate(features)}
                for kind, parts in (("oof", fold * step), ("full", np.full(len(batch), full * step))):
                    values, base, margin = np.zeros((len(batch), len(features))), np.zeros(len(batch)), np.zeros(len(batch))
                    fitted = np.array([(int(part), k) in fits for part in parts], dtype=bool)
                    for part in np.unique(parts[fitted]):
                        at, design, w = np.flatnonzero(parts == part), designs[int(part)], fits[int(part), k].weights[:, 0]
                        x = design.encode(numeric[at], [[c[i] for i in at] for c in categorical])
                        for j, (feature, _) in enumerate(design.columns):
                            if feature in place:
                                values[at, place[feature]] += x[:, j] * w[j]
                        base[at], margin[at] = w[-1], x @ w
                    n = len(batch)
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(c) for c in kept), pa.array([name] * n, pa.string()), pa.array([kind] * n, pa.string()), pa.array(base, mask=~fitted), pa.array(margin, mask=~fitted), pa.array([v if ok else None for v, ok in zip(values, fitted)], pa.list_(pa.float64()))],
                        [*kept, "feature_set", "fit", "base", "margin", "contributions"])

    return run


def contribution_cells(wide: DataFrame, sets: dict[str, list[str]]) -> DataFrame:
    """Long form of a `Nested`'s contributions: a row for each feature of the set."""
    names = F.create_map(*[v for s, features in sets.items() for v in (F.lit(s), F.array(*map(F.lit, features)))])
    cells = F.arrays_zip(names[F.col("feature_set")].alias("feature"), F.col("contributions").alias("contribution"))
    return wide.select(*(c for c in wide.columns if c not in ("base", "margin", "contributions")), F.explode(cells).alias("_c")).select("*", "_c.feature", "_c.contribution").drop("_c")


@dataclass
class Nested:
    """Results: out-of-fold scores, the search, and the column statistics, coefficients and score equations of the outer fits.

    With a full fit there are also the contributions of every row, by the fit of its own fold and by the full one.
    """

    scores: DataFrame
    search: DataFrame
    numeric: DataFrame
    levels: DataFrame
    coefficients: DataFrame
    contributions: DataFrame | None = None


def nested_elastic_net(table: DataFrame, inputs: Inputs, grid: Sequence[dict], outer: int = 5, inner: int = 4, seed: int = 21, full: bool = False) -> Nested:
    """Tune and fit every feature set inside every outer training part, and score the rows left out.

    A setting's penalty C on the summed loss is 1 / (C n) on the mean loss. A setting is valid if its fits of all inner parts came to rest;
    of the valid ones the lowest mean of the inner folds' mean log losses is chosen, the lower id of equal ones. Inner folds without rows
    (fewer entities than folds) are no parts. Where none is valid there is no fit, and scores and contributions are null. Rows with a null
    entity or label are left out. A level that the training part lacks has no column. An empty table gives empty results. With `full`, all
    rows are one more training part, tuned and fitted in the same passes; it stands as fold `outer` in the tables and scores no row.
    """
    spark, step = table.sparkSession, inner + 1
    spread = folded_rows(table.where(F.col(inputs.y).isNotNull()), inputs, outer, inner, seed, full).repartition(spark.sparkContext.defaultParallelism)
    rows = keep(spread, "nested_rows")
    numeric, levels = keep(numeric_statistics(rows, inputs), "nested_numeric"), keep(level_statistics(rows, inputs), "nested_levels")
    of_part: dict[int, tuple[list, list]] = {}
    for k, side in enumerate((numeric, levels)):
        for r in side.collect():  # a row for each part and column
            of_part.setdefault(r["part"], ([], []))[k].append(r)
    designs = {p: Design(inputs, *v) for p, v in of_part.items()}
    for r in rows.select(F.explode("parts").alias("part"), inputs.y).groupBy("part").agg(F.avg(inputs.y).alias("share")).collect():  # a row for each part
        designs[r["part"]].share = float(r["share"])
    checked: dict[int, int] = {}
    for r in rows.select(F.explode("checks").alias("part")).distinct().where(F.col("part") % step != 0).collect():
        checked[r["part"] // step] = checked.get(r["part"] // step, 0) + 1
    sets, used = list(inputs.sets), rows.select("parts", "checks", "fold", inputs.key, inputs.entity, inputs.y, *inputs.numeric, *inputs.categorical)

    def start(part: int, chosen: list[tuple[int, int]], newton: bool) -> Fit:
        design = designs[part]
        scale = np.array([1 / (grid[g]["C"] * design.rows) for _, g in chosen])
        mix = np.array([grid[g]["mix"] for _, g in chosen])
        weights = np.zeros((len(design.columns) + 1, len(chosen)))
        share = min(max(design.share, fixed.DOUBLE_EPS), 1 - fixed.DOUBLE_EPS)
        weights[-1] = np.log(share) - np.log1p(-share)
        return Fit(weights, scale * mix, scale * (1 - mix), design.mask[:, [s for s, _ in chosen]], newton=newton, part=part, settled=design.share in (0.0, 1.0))

    every = [(s, g) for s in range(len(sets)) for g in range(len(grid))]
    tuned = {p: start(p, every, False) for p in designs if p % step}
    rest, _ = fit_all(used, inputs, designs, tuned, TOLERANCE)
    slow = [(p, k) for p in tuned for k in np.flatnonzero(~rest[p])]
    for at in range(0, len(slow), NEWTON_FITS):
        block = slow[at : at + NEWTON_FITS]
        alone = {j: tuned[p].alone(k) for j, (p, k) in enumerate(block)}
        done, _ = fit_all(used, inputs, designs, alone, TOLERANCE)
        for j, (p, k) in enumerate(block):
            tuned[p].weights[:, k], rest[p][k] = alone[j].weights[:, 0], done[j][0]
    shared = spark.sparkContext.broadcast((designs, tuned))
    losses = used.mapInArrow(_losses(shared, inputs), "part int, at int, loss double, n double").groupBy("part", "at").agg(
        (F.sum("loss") / F.sum("n")).alias("loss")).collect()  # parts by settings
    shared.destroy()
    found: dict[tuple[int, int, int], list] = {}
    for r in losses:
        s, g = every[r["at"]]
        found.setdefault((r["part"] // step, s, g), []).append((r["loss"], bool(rest[r["part"]][r["at"]])))
    search, best = [], {}
    for (fold, s, g), seen in sorted(found.items()):
        mean, valid = float(np.mean([v for v, _ in seen])), all(ok for _, ok in seen) and len(seen) == checked[fold]
        search.append([sets[s], fold, g, grid[g]["C"], grid[g]["mix"], mean, valid])
        if valid and (best.get((fold, s)) is None or mean < best[fold, s][0] - TIE):
            best[fold, s] = (mean, g)
    search_df = spark.createDataFrame([(*r, best.get((r[1], sets.index(r[0])), (0, None))[1] == r[2]) for r in search], "feature_set string, fold int, config_id int, c double, mix double, mean_log_loss double, valid boolean, chosen boolean")
    final, table_rows = {}, []
    for s in range(len(sets)):
        fits = {fold * step: start(fold * step, [(s, best[fold, s][1])], True) for fold in range(outer + int(full)) if (fold, s) in best}
        _, last = fit_all(used, inputs, designs, fits, EXACT * 100)
        for part, fit in fits.items():
            final[part, s] = fit
            gradient, target, at = (last[part][0][:, 0], last[part][1], last[part][2][:, 0])
            l1, l2 = float(fit.l1[0]), float(fit.l2[0])
            for k, (name, level) in enumerate([*designs[part].columns, ("(intercept)", None)]):
                if not fit.mask[k, 0]:
                    continue
                free = name == "(intercept)"
                side = 0.0 if free or not l1 else np.sign(at[k]) if at[k] else float(np.clip(-gradient[k] / l1, -1, 1))
                equation = target[k] + gradient[k] + (0.0 if free else l2 * at[k] + l1 * side)
                table_rows.append((sets[s], part // step, name if level is None else f"{name}={level}", float(at[k]), float(equation)))
    coefficients = spark.createDataFrame(table_rows, "feature_set string, fold int, column_name string, coefficient double, equation double")
    kept = [inputs.key, inputs.entity, "fold", inputs.y]
    types = dict(used.dtypes)
    shared = spark.sparkContext.broadcast((designs, final))
    scores = keep(used.mapInArrow(_scores(shared, inputs, step, kept), ", ".join(f"`{c}` {types[c]}" for c in kept) + ", feature_set string, p double"), "nested_scores")
    wide = None
    if full:
        types_of = ", ".join(f"`{c}` {types[c]}" for c in kept)
        wide = keep(used.mapInArrow(_contributions(shared, inputs, step, kept, outer), f"{types_of}, feature_set string, fit string, base double, margin double, contributions array<double>"), "nested_contributions")
    shared.destroy()
    return Nested(scores, search_df, numeric, levels, coefficients, wide)
