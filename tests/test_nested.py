"""Nested elastic net on a small frame against plain numpy."""

import numpy as np
import pytest

from vigitab.operators import nested as N

GRID = [{"C": 0.05, "mix": 0.5}, {"C": 1.0, "mix": 0.0}, {"C": 1.0, "mix": 1.0}]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(160):
        x = float(rng.normal())
        share = None if k % 9 == 0 else float(rng.uniform())
        level = ["a", "b", "rarely"][0 if rng.uniform() < 0.5 else 1] if k % 40 else "rarely"
        rows.append((f"p{k}", f"e{k % 16}", level, x, share, float(rng.integers(0, 50)), int(rng.uniform() < 1 / (1 + np.exp(-x)))))
    return spark.createDataFrame(rows, "pair_id string, entity string, event string, approval_year double, masked_fraction double, n_arms double, label int")


def plain(x, y, c, mix):
    """Proximal gradient on the mean loss, the last column being the intercept."""
    n, w = len(y), np.zeros(x.shape[1])
    lam, pace = 1 / (c * n), 4 * n / np.linalg.norm(x, 2) ** 2 / 1.5
    free = np.r_[np.ones(len(w) - 1), 0.0]
    for _ in range(60_000):
        g = x.T @ (1 / (1 + np.exp(-x @ w)) - y) / n + lam * (1 - mix) * w * free
        z = w - pace * g
        w = np.sign(z) * np.maximum(np.abs(z) - pace * lam * mix * free, 0)
    return w


def test_chosen_fits_equal_plain_ones(spark, table):
    sets = {"few": ["approval_year"], "all": ["approval_year", "masked_fraction", "n_arms", "event"]}
    inputs = N.inputs_of(table, sets, 5)
    assert inputs.median == ["masked_fraction"] and inputs.log == ["n_arms"] and inputs.rare == {"event": 5}
    got = N.nested_elastic_net(table, inputs, GRID, outer=3, inner=2, seed=1)
    search = got.search.collect()
    assert len(search) == 2 * 3 * 3 and all(r.valid for r in search) and sum(r.chosen for r in search) == 6
    rows = [r.asDict() for r in table.collect()]
    scores = {(r.feature_set, r.pair_id): (r.fold, r.p) for r in got.scores.collect()}
    assert len(scores) == 320
    fold_of = {r["pair_id"]: scores["all", r["pair_id"]][0] for r in rows}
    assert all(len({fold_of[r["pair_id"]] for r in rows if r["entity"] == e}) == 1 for e in {r["entity"] for r in rows})
    for fold in range(3):
        train = [r for r in rows if fold_of[r["pair_id"]] != fold]
        fill = float(np.median([r["masked_fraction"] for r in train if r["masked_fraction"] is not None]))
        kept = {lv for lv in ("a", "b", "rarely") if len({r["entity"] for r in train if r["event"] == lv}) >= 5}
        names = sorted(kept | ({"PT_RARE"} if {r["event"] for r in train} - kept else set()))

        def encode(part, fill=fill, kept=kept, names=names):
            num = np.array([[r["approval_year"], fill if r["masked_fraction"] is None else r["masked_fraction"], np.log1p(r["n_arms"])] for r in part])
            hot = np.array([[float((r["event"] if r["event"] in kept else "PT_RARE") == n) for n in names] for r in part])
            return num, hot

        num, hot = encode(train)
        mean, sd = num.mean(axis=0), num.std(axis=0)
        y = np.array([r["label"] for r in train], dtype=float)
        for name, width in (("few", 1), ("all", 3)):
            chosen = next(r for r in search if r.chosen and r.fold == fold and r.feature_set == name)
            make = lambda n, h, width=width, name=name: np.column_stack([((n - mean) / sd)[:, :width], *([h] if name == "all" else []), np.ones(len(n))])  # noqa: B023,E731
            w = plain(make(num, hot), y, chosen.c, chosen.mix)
            valid = [r for r in rows if fold_of[r["pair_id"]] == fold]
            p = 1 / (1 + np.exp(-make(*encode(valid)) @ w))
            assert np.allclose(p, [scores[name, r["pair_id"]][1] for r in valid], atol=1e-6)


def test_bands_change_no_replicate(spark, monkeypatch):
    from vigitab.operators import resample as R

    rng = np.random.default_rng(1)
    rows = [(f"g{k % 2}", k % 7, int(rng.uniform() < 0.4), float(round(rng.uniform(), 2))) for k in range(300)] + [("one", 99, 1, 0.5)]
    df = spark.createDataFrame(rows, "side string, cluster int, y int, p double")
    take = lambda: {(r.side, r.rep): r for r in R.bootstrap_metrics(df, ["side"], "cluster", "y", "p", 700, 3).collect()}
    whole = take()
    monkeypatch.setattr(R, "BAND_ROWS", 20)
    cut = take()
    assert whole.keys() == cut.keys() and {s for s, _ in whole} == {"g0", "g1", "one"} and all(r.auroc is None and r.average_precision == 1.0 for (s, _), r in cut.items() if s == "one")
    for k, r in whole.items():
        for m in ("average_precision", "auroc", "brier", "log_loss"):
            assert r[m] == cut[k][m] or abs(r[m] - cut[k][m]) < 1e-12
    draws = {}
    for r in R.draw_weights(df.select("cluster").distinct(), "cluster", 700, 3).where("rep = 123").collect():
        draws[r["cluster"]] = r["w"]
    own = [(p, y, draws.get(c, 0)) for s, c, y, p in rows if s == "g0"]
    n = sum(w for _, _, w in own)
    assert abs(whole["g0", 123].brier - sum(w * (y - p) ** 2 for p, y, w in own) / n) < 1e-12
    pos, neg = sum(w * y for _, y, w in own), sum(w * (1 - y) for _, y, w in own)
    area = sum(w * y * sum(v * (1 - z) * (1.0 if q < p else 0.5 if q == p else 0.0) for q, z, v in own) for p, y, w in own) / (pos * neg)
    assert abs(whole["g0", 123].auroc - area) < 1e-12


def test_no_valid_setting_leaves_scores_null(spark, table, monkeypatch):
    monkeypatch.setattr(N, "MAX_PASSES", 1)
    inputs = N.inputs_of(table, {"few": ["approval_year"]}, 5)
    got = N.nested_elastic_net(table, inputs, GRID, outer=3, inner=2, seed=1, full=True)
    assert not any(r.valid or r.chosen for r in got.search.collect()) and got.coefficients.count() == 0
    assert got.scores.count() == got.scores.where("p is null").count() == 160
    assert got.contributions.count() == got.contributions.where("contributions is null and base is null").count() == 320
    none = N.nested_elastic_net(table.limit(0), inputs, GRID, outer=3, inner=2, seed=1, full=True)
    assert none.scores.count() == none.contributions.count() == none.search.count() == 0


def test_momentum_needs_fewer_passes(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 12))
    x[:, 1:6] = x[:, :1] + 0.05 * x[:, 1:6]  # nearly one column, so steps under the bounding quadratic are short
    x[:, -1] = 1.0
    y = (rng.uniform(size=300) < N.sigmoid(4 * x[:, 0])).astype(float)
    curvature = 0.25 * x.T @ x / 300

    def passes(momentum):
        fit = N.Fit(np.zeros((12, 2)), np.array([0.0, 1e-4]), np.array([1e-4, 1e-4]), np.ones((12, 2), dtype=bool), curvature)
        for k in range(5000):
            new = N.stepped(fit, x.T @ (N.sigmoid(x @ fit.weights) - y[:, None]) / 300, curvature)
            still = np.abs(new - fit.weights).max(axis=0) < N.TOLERANCE
            if momentum:
                fit.advance(new, still)
            else:
                fit.weights = new
            if still.all():
                break
        return k, new

    slow, fast = passes(False), passes(True)
    assert fast[0] < 0.5 * slow[0] and np.allclose(slow[1], fast[1], atol=0.02)


def test_slow_settings_are_finished_by_newton_steps(spark, table, monkeypatch):
    inputs = N.inputs_of(table, {"few": ["approval_year"], "all": ["approval_year", "masked_fraction", "n_arms", "event"]}, 5)
    whole = {(r.feature_set, r.fold, r.config_id): r for r in N.nested_elastic_net(table, inputs, GRID, outer=3, inner=2, seed=1).search.collect()}
    monkeypatch.setattr(N, "MAX_PASSES", 8)  # too few for the accelerated steps alone
    cut = {(r.feature_set, r.fold, r.config_id): r for r in N.nested_elastic_net(table, inputs, GRID, outer=3, inner=2, seed=1).search.collect()}
    assert whole.keys() == cut.keys() and all(r.valid for r in cut.values())
    assert all(abs(r.mean_log_loss - cut[k].mean_log_loss) < 1e-5 and r.chosen == cut[k].chosen for k, r in whole.items())


@pytest.mark.parametrize("labels", ["1", "int(entity = 'e3' and pair_id < 'p5')"])  # none, or one entity only, has another label
def test_parts_with_one_label_are_fitted(spark, table, labels):
    import math

    from pyspark.sql import functions as F

    one = table.withColumn("label", F.expr(labels))
    inputs = N.inputs_of(one, {"few": ["approval_year"], "all": ["approval_year", "event"]}, 5)
    got = N.nested_elastic_net(one, inputs, GRID, outer=3, inner=2, seed=1, full=True)
    search = got.search.collect()
    assert all(r.valid for r in search) and sum(r.chosen for r in search) == 2 * 4
    scores = {(r.feature_set, r.pair_id): r for r in got.scores.collect()}
    assert len(scores) == 320 and all(0 < r.p < 1 for r in scores.values())
    rows = {r.pair_id: r for r in one.collect()}
    for r in got.coefficients.where("column_name = '(intercept)'").collect():
        train = [v.label for k, v in rows.items() if scores["few", k].fold != r.fold]
        assert abs(r.equation - np.mean(train)) < 1e-9
    for r in got.contributions.collect():
        p = scores[r.feature_set, r.pair_id].p
        right = math.log(p / (1 - p)) if r.fit == "oof" else r.margin
        assert abs(r.base + sum(r.contributions) - right) < 1e-6


def test_fewer_entities_than_folds(spark, table):
    few = table.where("entity in ('e1', 'e2', 'e3', 'e5')")
    inputs = N.inputs_of(few, {"few": ["approval_year"]}, 1)
    got = N.nested_elastic_net(few, inputs, GRID, outer=5, inner=4, seed=1, full=True)
    search = got.search.collect()
    assert {r.fold for r in search} == set(range(6)) and all(r.valid for r in search) and sum(r.chosen for r in search) == 6
    assert got.scores.where("p is null").count() == 0 and got.scores.count() == 40
