"""Hand-made edge frames."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigitab.functions import text as X
from vigitab.operators import aggregates as A
from vigitab.operators import attribution as AT
from vigitab.operators import evaluate as E
from vigitab.operators import evidence as EV
from vigitab.operators import features as FE
from vigitab.operators import identity as I
from vigitab.operators import joins as J
from vigitab.operators import prefix as P
from vigitab.operators import resample as R
from vigitab.operators import signals as S
from vigitab.operators import terms as T
from vigitab.operators.storage import keep

D = dt.date


def test_zero_cells_and_small_counts(spark):
    rows = [(0, 5, 5, 5), (3, 0, 5, 5), (3, 5, 0, 5), (3, 5, 5, 0), (2, 1, 1, 50), (3, 1, 1, 50)]
    df = spark.createDataFrame(rows, "a long, b long, c long, d long")
    df = df.withColumn("exposed_cases", F.expr("a+b")).withColumn("event_cases", F.expr("a+c")).withColumn("total_cases", F.expr("a+b+c+d"))
    out = [r.asDict() for r in S.criteria(S.signal_statistics(df)).collect()]
    assert [r["ror"] is None for r in out] == [True, True, True, True, False, False]
    # a below three is FALSE even without a bound; otherwise a missing bound stays null
    assert [r["criterion_r"] for r in out[:5]] == [False, None, None, None, False]
    assert out[5]["ror"] == pytest.approx(150.0)
    low = math.exp(math.log(150) - 1.96 * math.sqrt(1 / 3 + 1 + 1 + 1 / 50))
    assert out[5]["ror_lcl95"] == pytest.approx(low)
    safe = S.criteria_null_safe(S.signal_statistics(df)).collect()
    assert [r["criterion_r"] for r in safe[:4]] == [False] * 4


def test_leap_day_anchor_and_inclusive_window(spark):
    anchors = spark.createDataFrame([("e", D(2016, 2, 29))], "entity string, anchor date")
    pairs = spark.createDataFrame([("e", "x")], "entity string, event string")
    ph = S.anchored_pairs(pairs, anchors, [1])
    assert ph.first()["window_end"] == D(2017, 2, 28)
    days = [D(2016, 2, 28), D(2016, 2, 29), D(2017, 2, 28), D(2017, 3, 1)]
    cases = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "caseid long, report_date date")
    out = S.anchored_signals(ph, cases, cases.withColumn("entity", F.lit("e")), cases.withColumn("event", F.lit("x"))).first()
    assert (out["a"], out["total_cases"], out["exposed_cases"], out["event_cases"]) == (2, 2, 2, 2)


def test_version_choice(spark):
    rows = [
        (1, 10, None, 20200101), (1, 11, None, None),  # only null versions: date, then id
        (2, 20, 1, 20210101), (2, 21, 2, 20200101), (2, 22, None, 20220101),  # known version wins over date
        (3, 30, 1, 20200101), (3, 31, 1, 20200101),  # id decides
        (4, 30, 5, 20200101),  # id shared by two cases
    ]
    out = {r["caseid"]: r for r in S.latest_cases(spark.createDataFrame(rows, "caseid long, primaryid long, caseversion long, fda_dt int")).collect()}
    assert {k: v["primaryid"] for k, v in out.items()} == {1: 10, 2: 21, 3: 31, 4: 30}
    assert out[1]["latest_rule"] == "VERSIONLESS_DATE_ID_FALLBACK" and out[2]["report_count"] == 3


def test_window_totals_equal_plain_range_join(spark):
    rng = np.random.default_rng(1)
    d0 = D(2000, 1, 1)
    daily = [(f"k{k}", d0 + dt.timedelta(int(x)), int(rng.integers(1, 9))) for k in range(3) for x in rng.choice(400, 60, replace=False)]
    wins = [(f"k{k}", d0 + dt.timedelta(int(a)), d0 + dt.timedelta(int(a + b))) for k in range(4) for a, b in zip(rng.integers(0, 300, 20), rng.integers(0, 200, 20))]
    dd = spark.createDataFrame(daily, "k string, day date, n long")
    ww = spark.createDataFrame(wins, "k string, s date, e date")
    got = {(r["k"], r["s"], r["e"]): r["t"] for r in P.window_totals(ww, dd, ["k"], "s", "e", "day", "n", "t").collect()}
    assert got == {w: sum(n for k, d, n in daily if k == w[0] and w[1] <= d <= w[2]) for w in wins}


def test_exact_quantiles_and_positions(spark):
    rng = np.random.default_rng(2)
    vals = {"a": np.r_[rng.normal(size=301), 1e9, -1e7], "b": rng.integers(0, 4, 200).astype(float), "c": np.array([7.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in vals.items() for v in vs], "k string, v double")
    for r in P.exact_quantiles(df, ["k"], "v", [0.0, 0.1, 0.5, 0.9, 1.0]).collect():
        assert r["quantile"] == pytest.approx(np.quantile(vals[r["k"]], r["q"]))
    every = np.concatenate(list(vals.values()))
    assert P.exact_quantiles(df, [], "v", [0.25]).first()["quantile"] == pytest.approx(np.quantile(every, 0.25))
    ranked = P.position(df.where("k = 'a'"), ["k"], P.unit_levels("v", desc=False)).orderBy("v").collect()
    assert [r["position"] for r in ranked] == list(range(1, 304))


def test_ranking_metrics_with_ties_and_single_class(spark):
    rng = np.random.default_rng(3)
    p = np.round(rng.random(300), 1)
    y = (rng.random(300) < p).astype(int)
    df = spark.createDataFrame([("g", int(a), float(b)) for a, b in zip(y, p)] + [("one", 1, 0.5), ("one", 1, 0.5)], "g string, y int, p double")
    out = {r["g"]: r for r in E.metrics_by(df, ["g"], "y", "p").collect()}
    ap = cp = cn = 0.0
    for s in sorted(set(p), reverse=True):
        pos, neg = ((p == s) & (y == 1)).sum(), ((p == s) & (y == 0)).sum()
        cp, cn = cp + pos, cn + neg
        ap += pos * cp / (cp + cn)
    pairs = [(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]]
    assert out["g"]["average_precision"] == pytest.approx(ap / y.sum())
    assert out["g"]["auroc"] == pytest.approx(np.mean(pairs))
    assert out["one"]["auroc"] is None and out["one"]["average_precision"] == pytest.approx(1.0)


def test_calibration_solves_its_equations(spark):
    rng = np.random.default_rng(4)
    p = np.clip(rng.random(400), 0.02, 0.98)
    y = (rng.random(400) < p**1.5).astype(int)
    r = E.calibration(spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double"), [], "y", "p").first()
    x = np.log(p / (1 - p))
    assert r["intercept_ok"] and r["slope_ok"]
    assert abs(np.sum(y - 1 / (1 + np.exp(-(r["calibration_intercept"] + x))))) < 1e-6
    assert np.isfinite(r["calibration_slope"])


def test_bootstrap_weights_are_whole_draws(spark):
    df = spark.createDataFrame([(f"c{i}", i % 3, 3) for i in range(9)], "c string, num int, den int")
    w = R.draw_weights(df, "c", 30, 5).groupBy("rep").agg(F.sum("w").alias("n")).collect()
    assert len(w) == 30 and {r["n"] for r in w} == {9}
    micro = [r["micro"] for r in R.bootstrap_ratio(df, "c", "num", "den", 30, 5).collect()]
    assert all(0 <= m <= 2 / 3 for m in micro) and len(set(micro)) > 3


def test_stages_in_buckets_are_not_shuffled_again(spark):
    rows = spark.range(200).select((F.col("id") % 50).alias("k"), (F.col("id") % 4).alias("part"), F.col("id").alias("v"))
    tops = rows.groupBy("k").agg(F.max("v").alias("top"))

    def summed(left, right):
        met = left.withColumnRenamed("k", "nct_id").join(right.withColumnRenamed("k", "nct_id").hint("merge"), "nct_id")
        return met.groupBy("nct_id", "part").agg(F.count(F.lit(1)).alias("n"), F.max("top").alias("top"))

    out = summed(keep(rows, "left", "k"), keep(tops, "right", "k"))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, summed(rows, tops).collect()))


def test_copies_meet_the_draws_once(spark):
    rows = [(f"c{i % 4}", i % 2, 0.2 + 0.1 * (i % 3)) for i in range(12)]
    df = spark.createDataFrame(rows * 50, "c string, y int, p double").withColumn("g", F.lit("a"))
    drawn = R.drawn_scores(df, ["g"], "c", "y", "p", 20, 5)
    plain = df.join(R.draw_weights(df, "c", 20, 5), "c")
    per = lambda rows: sorted(map(tuple, rows.groupBy("rep", "c", "y", "p").agg(F.sum("w")).collect()))
    assert per(drawn) == per(plain)
    assert 50 * drawn.count() == plain.count()  # 50 copies of a row are one row here


def test_entity_without_signals_has_null_coverage(spark):
    sig = spark.createDataFrame([("a", True), ("a", False)], "entity string, seen boolean")
    ents = spark.createDataFrame([("a",), ("b",)], "entity string")
    out = {r["entity"]: r for r in R.entity_coverage(sig, ents, F.col("seen")).collect()}
    assert out["a"]["coverage"] == 0.5 and out["b"]["coverage"] is None and out["b"]["coverage_bin"] == "NO_SIGNALS"


def test_term_cascade_stops_at_first_level(spark):
    pt = spark.createDataFrame([("Head pain", 1), ("Rash", 2)], "term string, code long")
    llt = spark.createDataFrame([("headache", 1), ("spots", 1), ("spots", 2)], "term string, parent long")
    hist = spark.createDataFrame([("old rash", 2)], "term string, code long")
    terms = spark.createDataFrame([("Head pain",), ("ｈｅａｄ　ＰＡＩＮ",), ("head-pain",), ("spots",), ("Old Rash",), ("none",)], "term string")
    out = {r["term"]: (r["status"], r["level"], r["code"]) for r in T.map_terms_cascade(terms, T.build_term_index(pt, llt, hist)).collect()}
    assert out["Head pain"] == ("MAPPED", 1, 1) and out["ｈｅａｄ　ＰＡＩＮ"] == ("MAPPED", 2, 1) and out["head-pain"] == ("MAPPED", 3, 1)
    assert out["spots"][0] == "AMBIGUOUS" and out["Old Rash"] == ("MAPPED", 8, 2) and out["none"] == ("UNRESOLVED", None, None)


def test_names_resolving_to_two_entities(spark):
    names = spark.createDataFrame([("e1", "ACTIVE", "alpha"), ("e1", "BRAND", "Alpha"), ("e2", "ACTIVE", "beta sodium"), ("e3", "BRAND", "beta potassium"), ("e4", "ACTIVE", "gamma-abcd")], "entity string, kind string, raw string")
    cat = spark.createDataFrame([("ALPHA 20 mg tablet",), ("beta",), ("beta sodium",), ("alpha, beta sodium",), ("gamma",)], "raw string")
    out = {r["raw"]: (r["status"], r["entity"], r["method"]) for r in I.resolve_names(cat, I.build_name_index(names), split_lists=True).collect()}
    assert out["ALPHA 20 mg tablet"] == ("MAPPED", "e1", "EXACT_ACTIVE_AND_BRAND")
    assert out["beta"][0] == "AMBIGUOUS" and out["beta sodium"][1] == "e2"
    assert out["alpha, beta sodium"][0] == "AMBIGUOUS" and out["gamma"] == ("MAPPED", "e4", "UNIQUE_BASE")


def test_titles_matching_none_one_and_two_arms(spark):
    rg = spark.createDataFrame([(1, 1, "Arm A"), (1, 2, "Arm-B"), (1, 3, "zzz")], "n long, rg long, title string")
    dg = spark.createDataFrame([(1, 10, "ARM a"), (1, 11, "arm b"), (1, 12, "Arm  B"), (2, 13, "Arm A")], "n long, dg long, title string")
    out = {r["rg"]: r["matches"] for r in J.unique_text_match(rg, dg, "n", "rg", "dg", "title").collect()}
    assert out == {1: 1, 2: 2, 3: 0}


def test_checked_join_fails_on_repeats(spark):
    a = spark.createDataFrame([(1,), (2,)], "k long")
    b = spark.createDataFrame([(1, "x"), (1, "y")], "k long, v string")
    with pytest.raises(Exception, match="right key repeats"):
        J.join_checked(a, b, ["k"]).collect()


def test_text_helpers(spark):
    df = spark.createDataFrame([("20240230", "43831", "1/5/2020", "a | b |  | c"), ("20200229", "2020-01-02", "x", None)], "d string, m string, u string, l string")
    r = df.select(X.safe_date("d"), X.parse_mixed_date("m"), X.parse_mixed_date("u"), X.split_list("l")).collect()
    assert r[0][0] is None and r[1][0] == D(2020, 2, 29)
    assert r[0][1] == D(2020, 1, 1) and r[1][1] == D(2020, 1, 2) and r[0][2] == D(2020, 1, 5) and r[1][2] is None
    assert r[0][3] == ["a", "b", "c"] and r[1][3] is None


def test_bins_with_duplicate_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in [0] * 8 + [1, 2]], "v double")
    out = P.equal_frequency_bins(df, [], "v", 5).groupBy("v").agg(F.max("bin").alias("b")).collect()
    got = {r["v"]: r["b"] for r in out}
    assert got[0.0] == 0 and got[2.0] == max(got.values())


def test_null_groups_stay(spark):
    df = spark.createDataFrame([(None, 1.0, 1, 0.2), (None, 3.0, 0, 0.1), ("a", 2.0, 1, 0.7), ("a", 4.0, 0, 0.4)], "g string, v double, y int, p double")
    assert {(r["g"], r["quantile"]) for r in P.exact_quantiles(df, ["g"], "v", [0.5]).collect()} == {(None, 2.0), ("a", 3.0)}
    assert sorted(r["share"] for r in A.share_of_total(df, ["g"], "v").collect()) == pytest.approx([0.25, 1 / 3, 2 / 3, 0.75])
    assert {r["g"] for r in E.metrics_by(df, ["g"], "y", "p").collect()} == {None, "a"}
    assert {r["g"] for r in A.concentration(df, ["g"], "v", [1]).collect()} == {None, "a"}
    assert {r["g"] for r in A.limited_list(df.withColumn("t", F.col("v").cast("string")), ["g"], "t", "names", 1).collect()} == {None, "a"}
    assert {r["g"] for r in E.calibration(df, ["g"], "y", "p").collect()} == {None, "a"}


def test_checked_join_keeps_null_keys(spark):
    left = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "k string, v int")
    right = spark.createDataFrame([("a", 9)], "k string, w int")
    assert sorted((r["v"], r["w"]) for r in J.join_checked(left, right, ["k"]).collect()) == [(1, 9), (2, None), (3, None)]


def test_cohort_keeps_identities_without_trade_name(spark):
    rows = spark.createDataFrame(
        [(1, "One", "T", "2001-01-02", "", "A1"), (2, "Two", " ", "2002-01-02", "", "A2"), (3, "Three", None, "2003-01-02", "", "A3")],
        "source_row long, active string, trade string, approval_text string, notes string, application string")
    assert {(r["entity"], r["trades"]) for r in I.regulatory_cohort(rows, "2010-01-01").collect()} == {("One", "T"), ("Two", ""), ("Three", "")}


def test_identity_folding(spark):
    names = spark.createDataFrame([("STRASSE",), ("Straße",), ("\uff21\uff22\uff23",), ("abc ",)], "active string")
    assert {r["k"] for r in names.select(X.identity_key("active").alias("k")).collect()} == {"strasse", "abc"}


def _arms(spark):
    rows = spark.createDataFrame([(1, 10, 1, "E", "x", 1.0, 5.0)], "nct_id long, rgid long, row_no int, entity string, event string, affected double, at_risk double")
    groups = spark.createDataFrame([(1, 10, "Drug A-placebo")], "nct_id long, rgid long, title string")
    return rows, groups


def test_placebo_words_are_those_of_the_design_arm(spark):
    rows, groups = _arms(spark)
    arms = spark.createDataFrame([(1, 7, "Drug A placebo", "OTHER")], "nct_id long, dgid long, title string, group_type string")
    matched = EV.attribute_arms(rows, groups, arms).withColumn("intervention_name", F.lit("E"))
    assert matched.first()["arm_title"] == "Drug A placebo"  # event rows need no title of their own
    assert EV.treatment_arms(matched).count() == 0


def test_equal_event_rows_are_two_rows(spark):
    cols = "entity string, event string, nct_id long, row_no int, rgid long, dgid long, event_type string, threshold double, affected double, at_risk double, phase string, allocation string, masking string"
    row = ("E", "x", 1, 1, 10, 7, "other", 5.0, 1.0, 4.0, "PHASE1", "RANDOMIZED", "NONE")
    rows = spark.createDataFrame([row, (*row[:3], 2, *row[4:])], cols)
    got = FE.pair_features(rows, spark.createDataFrame([("E", 1)], "entity string, programme_trials long")).first()
    assert (got["row_variability_available"], got["proportion_iqr"], got["reporting_arms"]) == (1, 0.0, 1)


def test_clock_definitions_are_independent(spark):
    rows = spark.createDataFrame([
        ("PHASE2", "ESTIMATED", D(2000, 1, 1), D(2000, 1, 1), D(2009, 1, 1)), ("PHASE4", "ACTUAL", D(2000, 1, 1), D(2000, 1, 1), D(2000, 1, 1)),
        (None, "ACTUAL", D(2009, 1, 1), D(2009, 1, 1), D(2000, 1, 1))],
        "phase string, completion_type string, completion_date date, results_posted_date date, primary_completion_date date").withColumn("anchor", F.lit("2005-01-01").cast("date"))
    assert sorted(r["definition"] for r in EV.clock_definitions(rows).collect()) == ["RESULTS_POSTED", "WIDE_COMPLETION"]


def test_leaf_shares_are_shapley_values():
    from itertools import permutations

    path = [(0, 0.5, True, 0.4), (1, 0.5, False, 0.7), (2, 0.5, True, 0.2), (0, 0.2, True, 0.5)]
    x = np.array([[0.1, 0.9, 0.1], [0.4, 0.9, 0.9], [0.9, 0.1, 0.3]])
    phi = np.zeros((3, 4))
    AT._leaf_shares(x, 2.0, path, phi)
    follows = {0: (x[:, 0] <= 0.2), 1: (x[:, 1] > 0.5), 2: (x[:, 2] <= 0.5)}
    cover = {0: 0.2, 1: 0.7, 2: 0.2}
    want = np.zeros((3, 4))
    for order in permutations(cover):
        known = dict(cover)
        for f in order:
            before = np.prod([known[g] * np.ones(3) for g in cover], axis=0)
            known[f] = follows[f]
            want[:, f] += 2.0 * (np.prod([known[g] * np.ones(3) for g in cover], axis=0) - before) / 6
    assert np.allclose(phi, want)


def test_code_without_a_unique_branch_is_not_mapped(spark):
    terms = spark.createDataFrame([("a", 1), ("b", 1)], "term string, n long")
    index = T.build_term_index(*(spark.createDataFrame(r, s) for r, s in (([("a", 1), ("b", 2)], "term string, code long"), ([], "term string, parent long"), ([], "term string, code long"))))
    branches = spark.createDataFrame([(1, "m", "t", "Y"), (2, "m", "t", "Y"), (2, "m", "u", "Y")], "code long, middle string, top string, primary_flag string")
    got = {r["term"]: (r["status"], r["code"]) for r in T.map_terms_cascade(terms, index, T.primary_hierarchy(branches)).collect()}
    assert got == {"a": ("MAPPED", 1), "b": ("UNRESOLVED_HIERARCHY", None)}


def test_strict_rows_read_names_of_matched_arms_only(spark, monkeypatch):
    rows = spark.createDataFrame([("E", "x", 1, 10), ("E", "y", 1, 10), ("F", "x", 2, 20), ("E", "x", 3, 30), ("E", "x", None, 40)], "entity string, event string, nct_id int, rgid int")
    groups = spark.createDataFrame([(1, 10, "arm a"), (2, 20, "arm b"), (3, 30, "arm c"), (9, 90, "arm z"), (None, 40, "arm z")], "nct_id int, rgid int, title string")
    arms = spark.createDataFrame([(1, 100, "Arm A", "OTHER"), (2, 200, "Arm B", "OTHER"), (3, 300, "Arm C", "OTHER"), (9, 900, "Arm Z", "OTHER")], "nct_id int, dgid int, title string, group_type string")
    bridge = spark.createDataFrame([(100, 1), (100, 1), (200, 2), (200, 3), (300, None), (900, 9)], "dgid int, intervention_id int")
    drugs = spark.createDataFrame([(i, "F" if i == 2 else "E", f"drug {i}", "DRUG") for i in (1, 2, 3, 9)], "intervention_id int, entity string, intervention_name string, intervention_type string")
    plain = EV.treatment_arms(EV.target_monotherapy(EV.attribute_arms(rows, groups, arms), EV.arm_composition(arms, bridge, drugs), bridge, drugs))
    asked, compose = [], EV.arm_composition
    monkeypatch.setattr(EV, "arm_composition", lambda d, b, i: asked.append(({r.dgid for r in d.collect()}, {r.intervention_id for r in b.collect()})) or compose(d, b, i))
    got = EV.strict_rows(rows, groups, arms, bridge, drugs)
    assert got.columns == plain.columns and sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect())) and got.count() == 2
    assert asked == [({100, 200, 300}, {1, 2, 3})]


def test_items_and_orders_meet_in_one_written_stage(spark):
    from vigitab.sources.bindings import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    lines, orders = t.table("lineitem"), t.table("orders")
    assert t.items.count() == lines.count() and t.base.count() == lines.join(orders, lines.l_orderkey == orders.o_orderkey).count()
    assert t.base.where("orderkey IS NULL OR odate IS NULL OR custkey IS NULL").count() == 0 and "orders" not in t.items.columns + t.base.columns
    for df in (t.items, t.base):  # both read the stage, and neither shuffles again
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    per_order = t.items.groupBy("orderkey").agg(F.max("row_no").alias("last"), F.count(F.lit(1)).alias("n"))
    assert per_order.where("last <> n").count() == 0


def test_definitions_read_the_cascade_once_for_rows_that_meet_a_clock(spark, monkeypatch):
    from datetime import date

    n = 8
    ae = spark.createDataFrame(
        [(k, k * 10 + j, "B1" if j else "B2", "pain", 1.0, 5.0, f"Arm {j}") for k in range(n) for j in (0, 1)],
        "nct_id long, rgid long, entity string, event string, affected double, at_risk double, title string")
    day = lambda early: date(2000, 1, 1) if early else date(2010, 1, 1)
    trials = spark.createDataFrame(
        [(k, "PHASE4" if k == 5 else None, "ACTUAL", day(k < 2), day(k in (1, 2, 5)) if k != 3 else None, day(k == 4)) for k in range(n)],
        "nct_id long, phase string, completion_type string, completion_date date, results_posted_date date, primary_completion_date date")
    anchors = spark.createDataFrame([("B1", date(2005, 1, 1)), ("B2", date(1999, 1, 1))], "entity string, anchor date")
    arms = spark.createDataFrame([(k, k * 10 + j, f"ARM: {j}", "EXPERIMENTAL") for k in range(n) for j in (0, 1)], "nct_id long, dgid long, title string, group_type string")
    groups = ae.select("nct_id", "rgid", "title")
    bridge = spark.createDataFrame([(k * 10 + j, k * 100 + j) for k in range(n) for j in (0, 1)], "dgid long, intervention_id long")
    drugs = spark.createDataFrame([(k * 100 + j, k, "B1" if j else "B2", "drug", "DRUG") for k in range(n) for j in (0, 1)], "intervention_id long, nct_id long, entity string, intervention_name string, intervention_type string")
    seen, keep = {}, EV.keep

    def counted(df, name="stage", *by):
        out = keep(df, name, *by)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(EV, "keep", counted)
    setting = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(setting)
    got = EV.definition_rows(["nct_id", "rgid", "entity", "event"], ae, trials, anchors, groups, arms, bridge, drugs)
    assert spark.conf.get(setting) == before
    assert {(r.definition, r.nct_id) for r in got.collect()} == {("STRICT_COMPLETION", 0), ("STRICT_COMPLETION", 1), ("RESULTS_POSTED", 1), ("RESULTS_POSTED", 2), ("WIDE_COMPLETION", 4)}
    assert seen["definition_base"] == seen["attributed_rows"] == 4  # of 16 rows
    signals = spark.createDataFrame([("B1", "pain"), ("B1", "rash"), ("B2", "pain")], "entity string, event string")
    volume = spark.createDataFrame([("B1",)], "entity string")
    seen.clear()
    rows = {r.definition: r for r in EV.definition_summary(got, signals, volume).collect()}
    assert seen["definition_links"] == 5 and seen["definition_pairs"] == 3
    strict = rows["STRICT_COMPLETION"]
    assert (strict.trials, strict.arms, strict.volume_trials, strict.shared_pairs, strict.signals, strict.signals_represented) == (2, 2, 2, 1, 2, 1)


def test_cascade_leaves_groups_in_the_buckets_of_their_trial(spark, monkeypatch):
    from vigitab.operators.storage import keep

    ids = range(40)
    rows = keep(spark.createDataFrame([(k, k * 10, "B1", "pain") for k in ids], "nct_id long, rgid long, entity string, event string"), "rows", "nct_id")
    groups = keep(spark.createDataFrame([(k, k * 10, f"Arm {k}") for k in ids], "nct_id long, rgid long, title string"), "groups", "nct_id")
    arms = keep(spark.createDataFrame([(k, k * 10, f"ARM: {k}", "OTHER") for k in ids], "nct_id long, dgid long, title string, group_type string"), "arms", "nct_id")
    bridge = spark.createDataFrame([(k * 10, k) for k in ids], "dgid long, intervention_id long")
    drugs = spark.createDataFrame([(k, k, "B1", "drug", "DRUG") for k in ids], "intervention_id long, nct_id long, entity string, intervention_name string, intervention_type string")
    plans = {}

    def planned(df, name="stage", *by):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return keep(df, name, *by)

    monkeypatch.setattr(EV, "keep", planned)
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert EV.strict_rows(rows, groups, arms, bridge, drugs).count() == 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert "SortMergeJoin" in plans["attributed_rows"] and "Exchange" not in plans["attributed_rows"]
