"""Registered queries: coverage, bootstrap, folds, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import evaluate as E
from ..operators import joins as J
from ..operators import resample as R
from .oracle_views import VIEWS
from .registry import query

REPS, SEED = 5000, 20260700


def observed():
    return F.col("coverage_class") == "OBSERVED_BEFORE"


VIEWS["v_cov"] = """SELECT a.entity, a.kind, a.orphan, a.breakthrough, coalesce(s.n,0) AS signals, coalesce(s.o,0) AS observed, s.o::DOUBLE/s.n AS coverage, coalesce(s.n,0)-coalesce(s.o,0) AS only_after,
 CASE WHEN s.n IS NULL THEN 'NO_SIGNALS' WHEN s.o=0 THEN '0%' WHEN s.o::DOUBLE/s.n<=0.1 THEN '>0-10%' WHEN s.o::DOUBLE/s.n<=0.25 THEN '>10-25%' WHEN s.o::DOUBLE/s.n<=0.5 THEN '>25-50%' ELSE '>50%' END AS coverage_bin
 FROM v_approval a LEFT JOIN (SELECT entity, count(*) AS n, count(*) FILTER (WHERE coverage_class='OBSERVED_BEFORE') AS o FROM v_sigr GROUP BY 1) s ON s.entity=a.entity"""


def coverage(t):
    return A.keep(R.entity_coverage(t.signals3.where("criterion_r"), t.approval.select("entity", "kind", "orphan", "breakthrough"), observed()))


@query("entity_coverage", "SELECT entity, signals, observed, coverage, only_after, coverage_bin FROM v_cov", "coverage", "B-1 PF-15")
def _(t):
    return coverage(t).select("entity", "signals", "observed", "coverage", "only_after", "coverage_bin")


_SUM = """count(*) AS entities, count(coverage) AS with_signals, sum(signals)::BIGINT AS signals, sum(observed)::BIGINT AS observed, 100.0*sum(observed)/nullif(sum(signals),0) AS micro_pct, 100*avg(coverage) AS macro_pct"""


@query("coverage_summary", f"SELECT {_SUM}, 100*quantile_cont(coverage,0.25) AS p25_pct, 100*quantile_cont(coverage,0.5) AS median_pct, 100*quantile_cont(coverage,0.75) AS p75_pct, 100*min(coverage) AS min_pct, 100*max(coverage) AS max_pct FROM v_cov",
       "micro_pct macro_pct p25_pct median_pct p75_pct min_pct max_pct", "B-2")
def _(t):
    return R.coverage_summary(coverage(t))


@query("coverage_distribution", "SELECT b AS coverage_bin, count(coverage_bin) AS entities, 100.0*count(coverage_bin)/(SELECT count(*) FROM v_cov) AS percent FROM (VALUES ('0%'),('>0-10%'),('>10-25%'),('>25-50%'),('>50%'),('NO_SIGNALS')) x(b) LEFT JOIN v_cov ON coverage_bin=b GROUP BY 1", "percent", "B-6")
def _(t):
    return R.coverage_distribution(coverage(t))


def draws(src, cluster, by="", reps=REPS, seed=SEED):
    """SQL of the replicate weights for a cluster list."""
    b = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    using = f"USING ({by})" if by else "ON true"
    return f"""SELECT {b}rep, {cluster}, count(*) AS w FROM (SELECT {b}r.rep, ('0x'||substr(md5('{seed}|'||r.rep||'|'||j),1,8))::BIGINT % n AS idx
 FROM (SELECT {b}count(*) AS n FROM ({src}) {'GROUP BY ' + by if by else ''}) s, range({reps}) r(rep), LATERAL (SELECT unnest(range(s.n)) AS j) g) d
 JOIN (SELECT {b}{cluster}, row_number() OVER ({part}ORDER BY md5({cluster}::VARCHAR))-1 AS idx FROM ({src})) c USING ({b}idx) GROUP BY ALL"""


_BOOT = f"""WITH w AS ({draws('SELECT entity FROM v_cov', 'entity')}), b AS (SELECT rep, sum(w*observed)::DOUBLE/nullif(sum(w*signals),0) AS micro,
 sum(w*observed::DOUBLE/nullif(signals,0)) FILTER (WHERE signals>0)/nullif(sum(w) FILTER (WHERE signals>0),0) AS macro FROM w JOIN v_cov USING (entity) GROUP BY 1)"""


@query("bootstrap_replicates", f"{_BOOT} SELECT rep, micro, macro FROM b", "micro macro", "B-3")
def _(t):
    return R.bootstrap_ratio(coverage(t), "entity", "observed", "signals", REPS, SEED)


@query("bootstrap_interval", f"{_BOOT} SELECT 'micro' AS measure, 100*quantile_cont(micro,0.025) AS low, 100*quantile_cont(micro,0.975) AS high, count(micro) AS valid, count(*)-count(micro) AS failed FROM b UNION ALL SELECT 'macro', 100*quantile_cont(macro,0.025), 100*quantile_cont(macro,0.975), count(macro), count(*)-count(macro) FROM b", "low high", "B-3 E-11")
def _(t):
    return R.ci_table(R.bootstrap_ratio(coverage(t), "entity", "observed", "signals", REPS, SEED), [], ["micro", "macro"], 100.0)


@query("group_coverage", f"""WITH w AS ({draws('SELECT entity FROM v_cov', 'entity')}), c AS (SELECT top_group, entity, count(*) AS signals, count(*) FILTER (WHERE coverage_class='OBSERVED_BEFORE') AS observed FROM v_sigr JOIN v_group USING (event) GROUP BY 1,2),
 m AS (SELECT top_group, count(*) AS entities, sum(signals)::BIGINT AS signals, sum(observed)::BIGINT AS observed, 100*avg(observed::DOUBLE/signals) AS macro_pct, 100.0*sum(observed)/sum(signals) AS micro_pct, sum(signals)>=30 AS major FROM c GROUP BY 1),
 b AS (SELECT top_group, rep, sum(w*observed)::DOUBLE/nullif(sum(w*signals),0) AS micro FROM w JOIN c USING (entity) GROUP BY 1,2)
 SELECT m.*, 100*quantile_cont(b.micro,0.025) AS low_pct, 100*quantile_cont(b.micro,0.975) AS high_pct FROM m JOIN b USING (top_group) GROUP BY ALL""", "macro_pct micro_pct low_pct high_pct", "B-4")
def _(t):
    s = t.signals3.where("criterion_r").join(t.event_group, "event")
    return R.group_coverage(s, t.approval.select("entity"), "top_group", observed(), REPS, SEED)


VIEWS["v_strata"] = "SELECT u.s AS stratum, coalesce(u.l,'MISSING') AS level, u.s||':'||coalesce(u.l,'MISSING') AS sl, entity, signals, observed, coverage FROM (SELECT *, unnest([{'s':'kind','l':kind},{'s':'orphan','l':orphan},{'s':'breakthrough','l':breakthrough}]) AS u FROM v_cov)"


@query("strata_coverage", f"""WITH w AS ({draws('SELECT sl, entity FROM v_strata', 'entity', 'sl')}), b AS (SELECT sl, rep, sum(w*observed)::DOUBLE/nullif(sum(w*signals),0) AS micro FROM w JOIN v_strata USING (sl, entity) GROUP BY 1,2),
 m AS (SELECT sl, stratum, level, {_SUM}, count(*)<10 AS small FROM v_strata GROUP BY 1,2,3) SELECT m.* EXCLUDE (sl), 100*quantile_cont(micro,0.025) AS low_pct, 100*quantile_cont(micro,0.975) AS high_pct FROM m JOIN b USING (sl) GROUP BY ALL""", "micro_pct macro_pct low_pct high_pct", "B-5")
def _(t):
    return R.strata_coverage(coverage(t), ["kind", "orphan", "breakthrough"], REPS, SEED)


# --- folds -------------------------------------------------------------------

def _fold_sql(src, k, seed, by=""):
    b = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""SELECT {b}grp, rows, positives, CASE WHEN (r//{k})%2=0 THEN r%{k} ELSE {k}-1-r%{k} END AS fold FROM (SELECT *, row_number() OVER ({part}ORDER BY positives DESC, rows DESC, md5('{seed}|'||grp))-1 AS r
 FROM (SELECT {b}grp, count(*) AS rows, sum(y)::BIGINT AS positives FROM ({src}) GROUP BY ALL))"""


VIEWS["v_folds"] = _fold_sql("SELECT * FROM v_feat", 5, 11)
VIEWS["v_inner"] = _fold_sql("SELECT f.*, o.ofold AS outer_fold FROM v_feat f JOIN v_folds g USING (grp), range(5) o(ofold) WHERE o.ofold<>g.fold", 4, 12, "outer_fold")


def folds(t):
    return R.grouped_folds(t.feat, "grp", "y", 5, 11)


@query("grouped_folds", "SELECT grp, rows, positives, fold FROM v_folds", "", "FE-10")
def _(t):
    return folds(t)


@query("fold_balance", "SELECT fold, count(*) AS groups, sum(rows)::BIGINT AS rows, sum(positives)::BIGINT AS positives, 100.0*sum(positives)/sum(rows) AS prevalence_pct, sum(positives)>0 AND sum(positives)<sum(rows) AS both_classes FROM v_folds GROUP BY 1", "prevalence_pct", "FE-10")
def _(t):
    return R.fold_balance(folds(t))


@query("nested_folds", "SELECT outer_fold::INT AS outer_fold, grp, rows, positives, fold FROM v_inner", "", "M-4")
def _(t):
    return R.nested_folds(t.feat, folds(t), "grp", "y", 4, 12, 5)


@query("null_model", "WITH p AS (SELECT fold, sum(positives) AS p, sum(rows) AS n FROM v_folds GROUP BY 1) SELECT fold, ((SELECT sum(p) FROM p)-p)::DOUBLE/((SELECT sum(n) FROM p)-n) AS null_p, n::BIGINT AS rows FROM p", "null_p", "M-9")
def _(t):
    return E.null_model(t.feat.join(folds(t).select("grp", "fold"), "grp"), "fold", "y")


# --- evaluation ----------------------------------------------------------------

def long_pred(t):
    return E.stack_scores(t.pred, ["doc_id", "cluster", "lang", "y", "y2"], ["p0", "p1"])


def metric_sql(src, by, y="y"):
    """Metrics per group; ``by`` is a comma list."""
    return f"""SELECT {by}, rows, positives, prevalence, brier, log_loss, average_precision, auroc, average_precision/nullif(prevalence,0) AS ap_lift FROM (
 SELECT {by}, count(*) AS rows, sum({y})::BIGINT AS positives, avg({y}) AS prevalence, avg(({y}-p)*({y}-p)) AS brier, avg(-({y}*ln(p)+(1-{y})*ln(1-p))) AS log_loss FROM {src} GROUP BY {by}) JOIN (
 SELECT {by}, sum(pos*cp/nullif(cp+cn,0))/nullif(max(tp),0) AS average_precision, sum(pos*(tn-cn+0.5*neg))/nullif(max(tp)*max(tn),0) AS auroc FROM (
  SELECT *, sum(pos) OVER (PARTITION BY {by} ORDER BY p DESC) AS cp, sum(neg) OVER (PARTITION BY {by} ORDER BY p DESC) AS cn, sum(pos) OVER (PARTITION BY {by}) AS tp, sum(neg) OVER (PARTITION BY {by}) AS tn
  FROM (SELECT {by}, p, sum({y})::DOUBLE AS pos, sum(1-{y})::DOUBLE AS neg FROM {src} GROUP BY {by}, p)) GROUP BY {by}) USING ({by})"""


MET = "prevalence brier log_loss average_precision auroc ap_lift"


@query("score_curve", "SELECT score_set, p, pos, neg, sum(pos) OVER (PARTITION BY score_set ORDER BY p DESC) AS cum_pos, sum(neg) OVER (PARTITION BY score_set ORDER BY p DESC) AS cum_neg FROM (SELECT score_set, p, sum(y)::DOUBLE AS pos, sum(1-y)::DOUBLE AS neg FROM v_predl GROUP BY 1,2)", "p pos neg cum_pos cum_neg", "W-4")
def _(t):
    return E.score_curve(long_pred(t), ["score_set"], "y", "p")


@query("metrics", metric_sql("v_predl", "score_set"), MET, "E-1 E-2 E-3 E-4 E-7 W-4")
def _(t):
    return E.metrics_by(long_pred(t), ["score_set"], "y", "p")


@query("metrics_by_language", metric_sql("v_predl", "score_set, lang"), MET, "E-8")
def _(t):
    return E.metrics_by(long_pred(t), ["score_set", "lang"], "y", "p")


@query("calibration_bins", """WITH e AS (SELECT score_set, list_sort(list_distinct(quantile_cont(p,[0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) AS ed FROM v_predl GROUP BY 1),
 b AS (SELECT x.*, greatest(len(list_filter(ed, lambda q: q<p))-1,0)::INT AS bin FROM v_predl x JOIN e USING (score_set)) SELECT score_set, bin, count(*) AS n, sum(y)::BIGINT AS positives, avg(y) AS observed_rate, avg(p) AS mean_p, median(p) AS median_p, min(p) AS min_p, max(p) AS max_p FROM b GROUP BY 1,2""",
       "observed_rate mean_p median_p min_p max_p", "E-9 W-6")
def _(t):
    return E.calibration_bins(long_pred(t), ["score_set"], "y", "p")


VIEWS["v_ties"] = "SELECT score_set, ln(p/(1-p)) AS x, count(*)::DOUBLE AS w, sum(y)::DOUBLE AS y FROM v_predl GROUP BY score_set, p"
#: Thirty Newton steps from (0, 1): what settles at all has settled by then to the digits compared; the rest has no value.
_NEWTON = """WITH RECURSIVE n(score_set, k, a, c, b, da, ds) AS (SELECT DISTINCT score_set, 0, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE FROM v_ties UNION ALL
 SELECT score_set, k+1, a+ga/va, c+(h11*g0-h01*g1)/(h00*h11-h01*h01), b+(h00*g1-h01*g0)/(h00*h11-h01*h01), abs(ga/va), greatest(abs((h11*g0-h01*g1)/(h00*h11-h01*h01)), abs((h00*g1-h01*g0)/(h00*h11-h01*h01))) FROM (
  SELECT score_set, k, a, c, b, sum(y-w*m1) AS ga, sum(w*m1*(1-m1)) AS va, sum(y-w*m2) AS g0, sum(x*(y-w*m2)) AS g1, sum(w*m2*(1-m2)) AS h00, sum(x*w*m2*(1-m2)) AS h01, sum(x*x*w*m2*(1-m2)) AS h11
  FROM (SELECT n.*, t.x, t.y, t.w, 1/(1+exp(-(n.a+t.x))) AS m1, 1/(1+exp(-(n.c+n.b*t.x))) AS m2 FROM n JOIN v_ties t ON t.score_set=n.score_set WHERE n.k<30) GROUP BY score_set, k, a, c, b))
 SELECT score_set, CASE WHEN ok_a THEN a END AS calibration_intercept, CASE WHEN ok_s THEN b END AS calibration_slope, ok_a AS intercept_ok, ok_s AS slope_ok
 FROM (SELECT *, isfinite(da) AND da<1e-8 AS ok_a, isfinite(ds) AND ds<1e-8 AS ok_s FROM n WHERE k=30)"""


@query("calibration_newton", _NEWTON, "calibration_intercept calibration_slope", "E-5 E-6")
def _(t):
    return E.calibration(long_pred(t), ["score_set"], "y", "p")


BREPS = 5000
_BM = f"""WITH w AS ({draws('SELECT DISTINCT cluster FROM v_pred', 'cluster', '', BREPS)}), x AS (SELECT score_set, rep, p, y, w FROM v_predl JOIN w USING (cluster)),
 l AS (SELECT score_set, rep, sum(w*(y-p)*(y-p))/sum(w) AS brier, sum(w*-(y*ln(p)+(1-y)*ln(1-p)))/sum(w) AS log_loss FROM x GROUP BY 1,2), g AS (SELECT score_set, rep, p, sum(w*y)::DOUBLE AS pos, sum(w*(1-y))::DOUBLE AS neg FROM x GROUP BY 1,2,3),
 r AS (SELECT *, sum(pos) OVER (PARTITION BY score_set, rep ORDER BY p DESC) AS cp, sum(neg) OVER (PARTITION BY score_set, rep ORDER BY p DESC) AS cn, sum(pos) OVER (PARTITION BY score_set, rep) AS tp, sum(neg) OVER (PARTITION BY score_set, rep) AS tn FROM g),
 b AS (SELECT score_set, rep, sum(pos*cp/nullif(cp+cn,0))/nullif(max(tp),0) AS average_precision, sum(pos*(tn-cn+0.5*neg))/nullif(max(tp)*max(tn),0) AS auroc FROM r GROUP BY 1,2), m AS (SELECT * FROM b JOIN l USING (score_set, rep))"""
_ML = ["average_precision", "auroc", "brier", "log_loss"]


def boot(t):
    return R.bootstrap_metrics(long_pred(t), ["score_set"], "cluster", "y", "p", BREPS, SEED)


@query("bootstrap_metrics", f"{_BM} SELECT score_set, rep, average_precision, auroc, brier, log_loss FROM m", " ".join(_ML), "E-10", digits=9)
def _(t):
    return boot(t).select("score_set", "rep", *_ML)


@query("metric_intervals", _BM + " " + " UNION ALL ".join(f"SELECT score_set, '{m}' AS measure, quantile_cont({m},0.025) AS low, quantile_cont({m},0.975) AS high, count({m}) AS valid, count(*)-count({m}) AS failed FROM m GROUP BY 1" for m in _ML), "low high", "E-11")
def _(t):
    return R.ci_table(boot(t), ["score_set"], _ML)


@query("bootstrap_calibration", None, "", "E-10 E-5 E-6")
def _(t):
    drawn = R.drawn_scores(long_pred(t), ["score_set"], "cluster", "y", "p", BREPS, SEED)
    return E.calibration(drawn, ["score_set", "rep"], "y", "p", "w", steps=50, tol=1e-8)


def _inc(m):
    d = f"a.{m}-b.{m}" if m in ("brier", "log_loss") else f"b.{m}-a.{m}"
    return f"SELECT '{m}' AS measure, quantile_cont({d},0.5) AS median, quantile_cont({d},0.025) AS low, quantile_cont({d},0.975) AS high, count({d}) AS valid FROM m a JOIN m b ON a.rep=b.rep AND a.score_set='p0' AND b.score_set='p1'"


@query("paired_increment", _BM + " " + " UNION ALL ".join(_inc(m) for m in _ML), "median low high", "E-12")
def _(t):
    return E.paired_increment(A.keep(boot(t)), "rep", [], "score_set", "p0", "p1", _ML)


@query("performance_table", _BM + f", e AS ({metric_sql('v_predl', 'score_set')}) " + " UNION ALL ".join(f"SELECT e.score_set, '{m}' AS measure, max(e.{m}) AS estimate, quantile_cont(m.{m},0.025) AS low, quantile_cont(m.{m},0.975) AS high FROM e JOIN m USING (score_set) GROUP BY 1" for m in _ML), "estimate low high", "Q-22")
def _(t):
    return E.performance_table(E.metrics_by(long_pred(t), ["score_set"], "y", "p"), R.ci_table(boot(t), ["score_set"], _ML), ["score_set"], _ML)


@query("joined_outcomes", "SELECT d.doc_id, d.lang, l.quality AS y, l.toxic AS y2 FROM documents d JOIN labels l ON l.doc_id=d.doc_id", "", "E-13 J-14")
def _(t):
    lab = t.table("labels").select("doc_id", F.col("quality").alias("y"), F.col("toxic").alias("y2"))
    return E.join_outcomes(t.table("documents").select("doc_id", "lang"), lab, ["doc_id"])


@query("outcome_key_check", "SELECT doc_id, 'left_only' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right_only' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)", "", "J-17 E-13")
def _(t):
    return J.key_diff(t.table("documents"), t.table("labels"), ["doc_id"])


@query("metrics_by_support", f"""WITH m AS ({metric_sql('v_predl', 'score_set, lang')}), s AS (SELECT score_set, lang, count(DISTINCT cluster) AS clusters, count(DISTINCT cluster)>=10 AND count(*) FILTER (WHERE y=1)>=20 AND count(*) FILTER (WHERE y=0)>=20 AS stable FROM v_predl GROUP BY 1,2)
 SELECT score_set, lang, rows, positives, prevalence, clusters, stable, CASE WHEN stable THEN average_precision END AS average_precision, CASE WHEN stable THEN auroc END AS auroc, CASE WHEN stable THEN brier END AS brier, CASE WHEN stable THEN log_loss END AS log_loss,
 CASE WHEN stable THEN ap_lift END AS ap_lift FROM m JOIN s USING (score_set, lang)""", MET, "E-14")
def _(t):
    return E.metrics_by_support(long_pred(t), ["score_set", "lang"], "cluster", "y", "p")


_TR = ["average_precision", "auroc", "brier"]


@query("transport", f"WITH a AS ({metric_sql('(SELECT * FROM v_predl WHERE doc_id%3<>0)', 'score_set')}), b AS ({metric_sql('(SELECT * FROM v_predl WHERE doc_id%3=0)', 'score_set')}) SELECT a.score_set, " + ", ".join(f"a.{m} AS {m}_dev, b.{m} AS {m}_hold, b.{m}-a.{m} AS {m}_change" for m in _TR) + " FROM a JOIN b ON a.score_set=b.score_set",
       " ".join(f"{m}_{s}" for m in _TR for s in ("dev", "hold", "change")), "E-15")
def _(t):
    p = long_pred(t)
    return E.transport(E.metrics_by(p.where("doc_id % 3 <> 0"), ["score_set"], "y", "p"), E.metrics_by(p.where("doc_id % 3 = 0"), ["score_set"], "y", "p"), ["score_set"], _TR)


VIEWS["v_pred2"] = "SELECT doc_id, cluster, 'p0' AS score_set, p0 AS p, y2 FROM v_pred UNION ALL SELECT doc_id, cluster, 'p1', p1, y2 FROM v_pred"


@query("alternative_endpoint", f"SELECT score_set, average_precision, auroc, ap_lift FROM ({metric_sql('v_pred2', 'score_set', 'y2')})", "average_precision auroc ap_lift", "E-16")
def _(t):
    return E.metrics_by(long_pred(t), ["score_set"], "y2", "p").select("score_set", "average_precision", "auroc", "ap_lift")


@query("second_formula", "SELECT count(DISTINCT (score_set,lang)) AS keys, 0::BIGINT AS unmatched, 0.0 AS auroc_diff FROM v_predl", "auroc_diff", "E-17")
def _(t):
    p = long_pred(t)
    return E.max_abs_diff(E.ranking(p, ["score_set", "lang"], "y", "p"), E.rank_sum_auroc(p, ["score_set", "lang"], "y", "p"), ["score_set", "lang"], ["auroc"])
