"""Attribution out of fold, the column map and the alias bridge on small frames."""

import numpy as np
import pytest

from vigitab.operators import attribution as X
from vigitab.operators import identity as I
from vigitab.operators import nested as N


def test_contributions_explain_each_row_by_the_fit_that_did_not_see_it(spark):
    rng = np.random.default_rng(8)
    rows = [(f"p{k}", f"e{k % 12}", "ab"[k % 2], float(rng.normal()), float(rng.integers(0, 9)), int(rng.uniform() < 0.5)) for k in range(96)]
    table = spark.createDataFrame(rows, "pair_id string, entity string, kind string, approval_year double, n_arms double, label int")
    sets = {"few": ["approval_year"], "all": ["approval_year", "n_arms", "kind"]}
    inputs = N.inputs_of(table, sets, 1)
    got = N.nested_elastic_net(table, inputs, [{"C": 1.0, "mix": 0.0}], outer=3, inner=2, seed=1, full=True)
    weights = {(r.feature_set, r.fold, r.column_name): r.coefficient for r in got.coefficients.collect()}
    assert {f for _, f, _ in weights} == {0, 1, 2, 3}
    stats = {(r.part, r.variable): (r.mean, r.sd, r.rows) for r in got.numeric.collect()}
    assert stats[9, "approval_year"][2] == 96  # the full part leaves no row out
    cells = {(r.feature_set, r.fit, r.pair_id, r.feature): r.contribution for r in N.contribution_cells(got.contributions, sets).collect()}
    assert len(cells) == 2 * 96 * (1 + 3)
    scores = {(r.feature_set, r.pair_id): (r.fold, r.p) for r in got.scores.collect()}
    for pair, _, kind, year, arms, _ in rows:
        for fit in ("oof", "full"):
            fold = scores["all", pair][0] if fit == "oof" else 3
            for name, value in (("approval_year", year), ("n_arms", np.log1p(arms))):
                mean, sd, _ = stats[fold * 3, name]
                assert cells["all", fit, pair, name] == pytest.approx((value - mean) / sd * weights["all", fold, name], abs=1e-9)
            assert cells["all", fit, pair, "kind"] == pytest.approx(weights["all", fold, f"kind={kind}"], abs=1e-9)
        fold, p = scores["all", pair]
        margin = weights["all", fold, "(intercept)"] + sum(cells["all", "oof", pair, f] for f in sets["all"])
        assert margin == pytest.approx(np.log(p / (1 - p)), abs=1e-9)


def test_left_out_weights_equal_plain_ones(spark):
    rng = np.random.default_rng(3)
    rows = [(k % 3, k % 4, float(rng.normal()), int(rng.uniform() < 0.4)) for k in range(240)] + [(7, 0, 1.0, 1), (7, 1, 1.0, 1), (7, 1, None, 0)]
    got = {(r.k, r.fold, r.family): (r.own, r.full) for r in X.left_out_weights(spark.createDataFrame(rows, "k int, fold int, x double, y int"), "k", "fold", "x", "y").collect()}
    for k in range(3):
        for fold in range(4):
            for place, part in enumerate(([r for r in rows if r[0] == k and r[1] != fold], [r for r in rows if r[0] == k])):
                x, y = np.array([r[2] for r in part]), np.array([r[3] for r in part], dtype=float)
                assert got[k, fold, "slope"][place] == pytest.approx(np.polyfit(x, y, 1)[0])
                assert got[k, fold, "gap"][place] == pytest.approx(x[y == 1].mean() - x[y == 0].mean())
    assert got[7, 0, "slope"] == (None, None) and got[7, 0, "gap"] == (None, None)


def names_of(spark, *names):
    return spark.createDataFrame(list(enumerate(names)), "column_index int, column_name string")


def test_longest_prefix_decides(spark):
    features = spark.createDataFrame([("a", "A"), ("a=b", "AB"), ("ab", "X"), ("c=d=e", "C")], "feature string, parent string")
    got = {r.column_name: (r.feature, r.parent, r.mapped) for r in X.concept_map(names_of(spark, "a", "a=c", "a=b", "a=b=c", "a=bc", "abc", "c=d", "c=d=e=f", ""), features).collect()}
    assert got == {
        "a": ("a", "A", True), "a=c": ("a", "A", True), "a=b": ("a=b", "AB", True), "a=b=c": ("a=b", "AB", True), "a=bc": ("a", "A", True),
        "abc": (None, None, False), "c=d": (None, None, False), "c=d=e=f": ("c=d=e", "C", True), "": (None, None, False)}


def test_two_parents_and_repeated_columns_fail(spark):
    twice = spark.createDataFrame([("a", "A"), ("a", "B"), ("b", "B")], "feature string, parent string")
    assert [r.parent for r in X.concept_map(names_of(spark, "b=1"), twice).collect()] == ["B"]
    for names in (("a=1",), ("b=1", "b=1")):
        with pytest.raises(Exception, match="two parents|repeated column"):
            X.concept_map(names_of(spark, *names), twice).collect()


def test_bridge_is_the_last_step(spark):
    index = I.build_name_index(spark.createDataFrame([("one", "ACTIVE", "one"), ("two", "ACTIVE", "two"), ("two", "BRAND", "both"), ("one", "BRAND", "both")], "entity string, kind string, raw string"))
    records = spark.createDataFrame([(1, "one"), (2, "two")], "record_id int, name string")
    aliases = spark.createDataFrame([(1, "uno"), (1, "shared"), (2, "shared"), (2, "both"), (1, "two")], "record_id int, name string")
    catalog = spark.createDataFrame([(v,) for v in ("uno", "shared", "both", "one", "nothing")], "raw string")
    bridge = I.bridge_index(spark.createDataFrame([(1, "one"), (2, "two")], "record_id int, entity string"), records.unionAll(aliases))
    got = {r.raw: (r.entity, r.method, r.status, list(r.candidates)) for r in I.resolve_names(catalog, index, bridge=bridge).collect()}
    assert got["uno"] == ("one", "SYNONYM_BRIDGE", "MAPPED", ["one"])  # bridged
    assert got["shared"] == (None, None, "AMBIGUOUS", ["one", "two"])  # shared alias: the clash list goes along
    assert got["both"] == (None, None, "AMBIGUOUS", ["one", "two"])  # clash of the index stays, although its alias leads to one entity
    assert got["one"][1] == "EXACT_ACTIVE" and got["nothing"] == (None, None, "UNRESOLVED", [])


def test_agreement_without_spread_is_undefined(spark):
    oof = spark.createDataFrame([("a", "x", 1), ("a", "y", 1), ("b", "x", 1), ("b", "y", 2), ("b", "z", 3)], "family string, feature string, rank_all int")
    full = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 2), ("b", "y", 1), ("b", "z", 3)], "family string, feature string, rank_all int")
    got = {r.family: (r.rho, r.largest_shift, r.agreement) for r in X.agreement(oof, full).collect()}
    assert got["a"] == (None, 1, "UNDEFINED") and got["b"][0] == pytest.approx(0.5) and got["b"][1:] == (1, "MODERATE")
