"""Registered queries: features, model table, training, attribution."""

from __future__ import annotations

import uuid

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import attribution as X
from ..operators import describe as D
from ..operators import evidence as C
from ..operators import features as FE
from ..operators import model as M
from ..operators import resample as R
from ..operators.storage import shared_dir
from .oracle_views import VIEWS
from .registry import query

PF, CF = FE.pair_columns(), FE.CONTEXT_COLUMNS


def _status(c, na=False):
    mid = f"WHEN {c}='N/A' THEN 'N/A' " if na else ""
    return f"CASE WHEN lower({c}) LIKE 'yes%' OR lower({c})='true' THEN 'Yes' {mid}WHEN lower({c}) IN ('no','false') THEN 'No' ELSE 'MISSING/UNKNOWN' END AS {c}"


VIEWS["v_context"] = f"""SELECT c.entity, c.event, a.* EXCLUDE (entity), g.top_group, p.trials AS programme_trials, x.arms AS programme_arms, x.at_risk AS programme_at_risk, p.share_0 AS programme_phase1, p.randomized_rate AS programme_randomized, p.masked_rate AS programme_masked, p.industry_rate AS programme_industry
 FROM v_cand c JOIN (SELECT entity, approval_year, kind, {_status('orphan')}, {_status('accelerated')}, {_status('breakthrough', True)}, {_status('fast_track')}, CASE WHEN priority LIKE 'Priority%' THEN 'Priority' ELSE 'Standard' END AS priority,
 CASE WHEN route IS NULL THEN 'MISSING/UNKNOWN' WHEN strpos(route,'|')>0 THEN 'MULTIPLE' WHEN route='ORAL' THEN 'ORAL' ELSE 'PARENTERAL' END AS route_broad, CASE form WHEN 'TABLET' THEN 'SOLID' WHEN 'SOLUTION' THEN 'LIQUID' ELSE 'OTHER' END AS form_broad FROM v_approval) a ON a.entity=c.entity
 JOIN v_group g ON g.event=c.event JOIN v_prog p ON p.entity=c.entity JOIN (SELECT entity, count(*) AS arms, sum(m) AS at_risk FROM (SELECT entity, nct_id, rgid, max(at_risk) AS m FROM v_final GROUP BY 1,2,3) GROUP BY 1) x ON x.entity=c.entity"""
VIEWS["v_prow"] = "SELECT DISTINCT entity, event, nct_id, row_no, rgid, dgid, event_type, threshold, affected, at_risk, phase, allocation, masking, affected/at_risk AS prop FROM v_final"
VIEWS["v_pairf"] = """SELECT r.entity, r.event, reporting_trials, reporting_trials::DOUBLE/p.trials AS reporting_trial_fraction, reporting_arms, arm_at_risk, median_proportion, max_proportion, CASE WHEN n>=2 THEN q3-q1 END AS proportion_iqr, (n>=2)::INT AS row_variability_available,
 any_serious, serious_trials, serious_arms, serious_trial_fraction, serious_arm_fraction, max_serious_proportion, max_other_proportion, other_proportion_available, between_trial_sd, (reporting_trials>=2)::INT AS cross_trial_available,
 min_other_threshold, max_other_threshold, median_other_threshold, threshold_0_fraction, threshold_5_fraction, threshold_available, phase1_fraction, randomized_fraction, masked_fraction FROM (
 SELECT entity, event, count(*) AS n, quantile_cont(prop,0.25) AS q1, quantile_cont(prop,0.5) AS median_proportion, quantile_cont(prop,0.75) AS q3, max(prop) AS max_proportion, max(prop) FILTER (WHERE event_type='serious') AS max_serious_proportion,
  max(prop) FILTER (WHERE event_type='other') AS max_other_proportion, min(threshold) FILTER (WHERE event_type='other') AS min_other_threshold, max(threshold) FILTER (WHERE event_type='other') AS max_other_threshold, median(threshold) FILTER (WHERE event_type='other') AS median_other_threshold FROM v_prow GROUP BY 1,2) r
 JOIN (SELECT entity, event, count(*) AS reporting_arms, sum(r) AS arm_at_risk, max(s) AS any_serious, sum(s)::BIGINT AS serious_arms, avg(s) AS serious_arm_fraction, max(o) AS other_proportion_available FROM (
  SELECT entity, event, nct_id, rgid, dgid, max(at_risk) AS r, max((event_type='serious')::INT) AS s, max((event_type='other')::INT) AS o FROM v_prow GROUP BY 1,2,3,4,5) GROUP BY 1,2) a USING (entity, event)
 JOIN (SELECT entity, event, count(*) AS reporting_trials, sum(s)::BIGINT AS serious_trials, avg(s) AS serious_trial_fraction, CASE WHEN count(*)>=2 THEN stddev_samp(m) END AS between_trial_sd, avg(t0) AS threshold_0_fraction, avg(t5) AS threshold_5_fraction, max(ta) AS threshold_available,
  avg(p1) AS phase1_fraction, avg(rz) AS randomized_fraction, avg(mk) AS masked_fraction FROM (SELECT entity, event, nct_id, median(prop) AS m, max((event_type='serious')::INT) AS s, max(coalesce((event_type='other' AND threshold=0)::INT,0)) AS t0, max(coalesce((event_type='other' AND threshold=5)::INT,0)) AS t5,
  max((event_type='other' AND threshold IS NOT NULL)::INT) AS ta, max(coalesce((phase='PHASE1')::INT,0)) AS p1, max((allocation='RANDOMIZED')::INT) AS rz, max((masking<>'NONE')::INT) AS mk FROM v_prow GROUP BY 1,2,3) GROUP BY 1,2) t USING (entity, event) JOIN v_prog p ON p.entity=r.entity"""
VIEWS["v_lab"] = "SELECT c.entity, c.event, CASE WHEN s.entity IS NOT NULL THEN 1 ELSE 0 END AS label FROM v_cand c LEFT JOIN (SELECT entity, event FROM v_sigr) s ON s.entity=c.entity AND s.event=c.event"
VIEWS["v_model"] = "SELECT md5(entity||'|'||event) AS pair_id, * FROM v_context JOIN v_pairf USING (entity, event) JOIN v_lab USING (entity, event)"
_PD = "reporting_trial_fraction arm_at_risk median_proportion max_proportion proportion_iqr serious_trial_fraction serious_arm_fraction max_serious_proportion max_other_proportion between_trial_sd min_other_threshold max_other_threshold median_other_threshold threshold_0_fraction threshold_5_fraction phase1_fraction randomized_fraction masked_fraction"
_CD = "programme_at_risk programme_phase1 programme_randomized programme_masked programme_industry"


def programme(t):
    return C.programme(t.intervention, t.trial, ["PHASE1", "PHASE2", "PHASE3"])


def context(t):
    return FE.context_features(t.candidates, t.approval, programme(t), C.arm_exposure(t.final_rows), t.event_group)


def pair(t):
    return FE.pair_features(t.final_rows, programme(t).select("entity", F.col("trials").alias("programme_trials")))


def labels(t):
    return FE.label_pairs(t.candidates, t.signals3.where("criterion_r"))


def table(t):
    return FE.model_table(context(t), pair(t), labels(t))


@query("context_features", f"SELECT entity, {', '.join(CF)} FROM v_context", _CD, "FE-1 PF-12 PF-13")
def _(t):
    return context(t).select("entity", *CF)


@query("pair_features", f"SELECT entity, event, {', '.join(PF)} FROM v_pairf", _PD, "FE-2 A-8 A-9 A-10 A-11 A-13")
def _(t):
    return pair(t).select("entity", "event", *PF)


@query("model_table", f"SELECT pair_id, entity, {', '.join(CF)}, {', '.join(PF)}, label FROM v_model", _CD + " " + _PD, "FE-4 J-3 F-11")
def _(t):
    return table(t).select("pair_id", "entity", *CF, *PF, "label")


@query("pair_labels", "SELECT * FROM v_lab", "", "FE-5 J-16")
def _(t):
    return labels(t)


@query("label_reconciliation", "SELECT (SELECT count(*) FROM v_lab) AS candidates, (SELECT sum(label)::BIGINT FROM v_lab) AS positives, count(*) AS signals, count(*) FILTER (WHERE c.entity IS NULL) AS signals_without_candidate FROM (SELECT entity, event FROM v_sigr) s LEFT JOIN v_cand c ON c.entity=s.entity AND c.event=s.event", "", "FE-5 Q-16")
def _(t):
    return FE.label_reconciliation(labels(t), t.signals3.where("criterion_r"))


@query("inclusion_rule", " UNION ALL ".join(f"""SELECT '{v}' AS variable, completeness, smallest_level, CASE WHEN completeness>=0.95 AND smallest_level>=10 THEN 'SECONDARY' ELSE 'DROP' END AS status FROM (
 SELECT sum(n) FILTER (WHERE lv<>'MISSING/UNKNOWN')::DOUBLE/sum(n) AS completeness, min(n) FILTER (WHERE lv<>'MISSING/UNKNOWN') AS smallest_level FROM (SELECT {v} AS lv, count(*) AS n FROM (SELECT DISTINCT entity, {v} FROM v_context) GROUP BY 1))""" for v in ("priority", "orphan")), "completeness", "FE-3")
def _(t):
    per_entity = context(t).select("entity", "priority", "orphan").distinct()
    return D.inclusion_rule(per_entity, "priority").unionByName(D.inclusion_rule(per_entity, "orphan"))


_NUMERIC = set(FE.PROGRAMME_COLUMNS) | set(FE.EXPOSURE_COLUMNS) | {"approval_year"} | set(PF)


def _dictionary_sql():
    meta = [("PAIR_SET" if n in PF else "CONTEXT_SET", n, *FE.feature_kind(n, "double" if n in _NUMERIC else "string"), "DROP" if n == "priority" else "KEEP") for n in [*CF, *PF]]
    counts = " UNION ALL ".join(
        f"SELECT '{n}' AS variable, count(*) AS rows, count({n}) AS known, count(DISTINCT {n}) AS distinct_values, {f'count(*) FILTER (WHERE {n}=0)' if n in _NUMERIC else '0::BIGINT'} AS zeros FROM v_model" for n in [*CF, *PF])
    return f"SELECT d.feature_set, variable, d.kind, d.transform, d.missing_rule, d.status, rows, known, distinct_values, zeros FROM ({counts}) JOIN (VALUES {', '.join(map(str, meta))}) d(feature_set, variable, kind, transform, missing_rule, status) USING (variable)"


@query("feature_dictionary", _dictionary_sql(), "", "FE-6 FE-7")
def _(t):
    return FE.feature_dictionary(A.keep(table(t), "model_table"), ["priority"])


@query("outcome_distribution", "SELECT entity, count(*) AS pairs, sum(label)::BIGINT AS positives, count(DISTINCT entity) AS entities, count(DISTINCT event) AS events, 100.0*sum(label)/count(*) AS prevalence_pct FROM v_lab GROUP BY 1", "prevalence_pct", "FE-8")
def _(t):
    return FE.outcome_distribution(labels(t), ["entity"])


@query("outcome_concentration", "WITH e AS (SELECT entity, sum(label)::DOUBLE AS p FROM v_lab GROUP BY 1), r AS (SELECT p, row_number() OVER (ORDER BY p DESC) AS k FROM e) SELECT count(*) AS entities, count(*) FILTER (WHERE p=0) AS without_any, quantile_cont(p,0.25) AS q1, median(p) AS median, quantile_cont(p,0.75) AS q3, "
 + ", ".join(f"100.0*sum(p) FILTER (WHERE k<={k})/nullif(sum(p),0) AS top_{k}_percent" for k in FE.TOP_SHARES) + " FROM r", "q1 median q3 " + " ".join(f"top_{k}_percent" for k in FE.TOP_SHARES), "FE-8")
def _(t):
    return FE.outcome_concentration(labels(t))


@query("support_buckets", "SELECT event, count(DISTINCT entity) AS entities, count(*) AS pairs, CASE WHEN count(DISTINCT entity)=1 THEN '1' WHEN count(DISTINCT entity)<5 THEN '2_TO_4' ELSE 'GE_5' END AS bucket FROM v_cand GROUP BY 1", "", "FE-9")
def _(t):
    return FE.support_buckets(t.candidates)


VIEWS["v_dev"] = "SELECT vec_id, grp AS entity, level AS event, y FROM v_feat WHERE grp<12"
VIEWS["v_new"] = "SELECT vec_id, grp AS entity, CASE WHEN vec_id%29=0 THEN 'new' ELSE level END AS event, y FROM v_feat WHERE grp>=12"
VIEWS["v_kept"] = "SELECT event, count(DISTINCT entity) AS support FROM v_dev GROUP BY 1 HAVING count(DISTINCT entity)>=8"


def dev_new(t):
    f = t.feat.select("vec_id", F.col("grp").alias("entity"), F.col("level").alias("event"), "y")
    new = f.where("entity >= 12").withColumn("event", F.when(F.col("vec_id") % 29 == 0, "new").otherwise(F.col("event")))
    return f.where("entity < 12"), new


@query("support_strata", "SELECT n.vec_id, n.event, CASE WHEN k.event IS NOT NULL THEN 'SUPPORTED' ELSE 'RARE' END AS support, CASE WHEN k.event IS NOT NULL THEN 'NOT_APPLICABLE' WHEN n.event IN (SELECT event FROM v_dev) THEN 'SEEN_BUT_LOW_SUPPORT' ELSE 'UNSEEN_IN_DEVELOPMENT' END AS rare_subtype FROM v_new n LEFT JOIN v_kept k ON k.event=n.event", "", "FE-11")
def _(t):
    dev, new = dev_new(t)
    return FE.support_strata(new, dev, FE.fit_rare(dev, least=8)).select("vec_id", "event", "support", "rare_subtype")


@query("rare_levels", "SELECT n.vec_id, coalesce(k.event,'PT_RARE') AS level_kept FROM v_new n LEFT JOIN v_kept k ON k.event=n.event", "", "M-1")
def _(t):
    dev, new = dev_new(t)
    return FE.apply_rare(new, FE.fit_rare(dev, least=8)).select("vec_id", "level_kept")


@query("rare_transfer", """WITH f AS (SELECT f.level, f.grp, g.fold FROM v_feat f JOIN v_folds g USING (grp)), c AS (SELECT a.fold AS vf, a.level, count(*) AS rows FROM f a GROUP BY 1,2),
 s AS (SELECT c.*, (SELECT count(DISTINCT grp) FROM f WHERE f.level=c.level AND f.fold<>c.vf) AS tr FROM c) SELECT vf AS fold, sum(rows)::BIGINT AS rows, coalesce(sum(rows) FILTER (WHERE tr<11),0)::BIGINT AS rare, coalesce(sum(rows) FILTER (WHERE tr=0),0)::BIGINT AS unseen,
 coalesce(sum(rows) FILTER (WHERE tr>0 AND tr<11),0)::BIGINT AS low_support, 100.0*coalesce(sum(rows) FILTER (WHERE tr<11),0)/sum(rows) AS rare_pct FROM s GROUP BY 1""", "rare_pct", "M-2")
def _(t):
    fo = R.grouped_folds(t.feat, "grp", "y", 5, 11).select("grp", "fold")
    return FE.rare_transfer(t.feat.join(fo, "grp"), "fold", "level", "grp", 11)


# --- attribution on stored contributions ------------------------------------------

VIEWS["v_glong"] = """SELECT family, vec_id, 'f'||(k//4) AS feature, k//4>=6 AS pair_specific, 'D'||(k//16) AS domain, sum(c) AS contribution, sum(raw) AS raw FROM (
 SELECT vec_id, k, raw, u.f AS family, u.c AS c FROM (SELECT *, unnest([{'f':'linear','c':contribution},{'f':'tree','c':raw*(1+k%3)}]) AS u FROM v_contrib)) GROUP BY ALL"""
VIEWS["v_imp"] = """SELECT *, rank() OVER (PARTITION BY family ORDER BY mean_abs DESC) AS rank_all, CASE WHEN pair_specific THEN rank() OVER (PARTITION BY family, pair_specific ORDER BY mean_abs DESC) END AS rank_specific FROM (SELECT family, feature, count(*) AS rows, avg(abs(contribution)) AS mean_abs, avg(contribution) AS mean_signed,
 min(domain) AS domain, bool_or(pair_specific) AS pair_specific, quantile_cont(abs(contribution),0.25) AS q1_abs, quantile_cont(abs(contribution),0.5) AS median_abs, quantile_cont(abs(contribution),0.75) AS q3_abs FROM v_glong GROUP BY 1,2)"""


def glong(t, where=None):
    fam = F.array(F.struct(F.lit("linear").alias("family"), F.col("contribution").alias("c")), F.struct(F.lit("tree").alias("family"), (F.col("raw") * (1 + F.col("k") % 3)).alias("c")))
    c = t.contrib if where is None else t.contrib.where(where)
    c = c.withColumn("feature", F.concat(F.lit("f"), F.floor(F.col("k") / 4).cast("string")))
    long = c.withColumn("_f", F.explode(fam)).select("vec_id", "feature", "k", "_f.family", F.col("_f.c").alias("contribution"))
    grouped = X.group_signed(long, ["family", "vec_id"], "feature")
    meta = c.groupBy("feature").agg(F.bool_or(F.floor(F.col("k") / 4) >= 6).alias("pair_specific"), F.concat(F.lit("D"), F.min("domain").cast("string")).alias("domain"))
    raw = X.group_signed(c, ["vec_id"], "feature", "raw")
    return X.contribution_long(grouped, meta, raw, ["vec_id"])


@query("grouped_contributions", "SELECT vec_id, parent, sum(contribution) AS contribution FROM v_contrib GROUP BY 1,2", "contribution", "X-4")
def _(t):
    return X.group_signed(t.contrib, ["vec_id"], "parent")


@query("contribution_long", "SELECT family, vec_id, feature, domain, pair_specific, contribution, raw FROM v_glong", "contribution raw", "X-5")
def _(t):
    return glong(t).select("family", "vec_id", "feature", "domain", "pair_specific", "contribution", "raw")


@query("importance", "SELECT family, feature, rows, mean_abs, mean_signed, domain, pair_specific, q1_abs, median_abs, q3_abs, rank_all::INT AS rank_all, rank_specific::INT AS rank_specific FROM v_imp", "mean_abs mean_signed q1_abs median_abs q3_abs", "X-6 W-3")
def _(t):
    return X.importance(glong(t))


@query("domain_shares", "SELECT family, domain, total_abs, features, total_abs/sum(total_abs) OVER (PARTITION BY family) AS share FROM (SELECT family, domain, sum(mean_abs) AS total_abs, count(*) AS features FROM v_imp GROUP BY 1,2)", "total_abs share", "X-7 W-5")
def _(t):
    return X.domain_shares(X.importance(glong(t)))


@query("coefficient_stability", """WITH c AS (SELECT k AS feature, grp%5 AS fold, regr_slope(y, raw) AS coefficient FROM v_contrib GROUP BY 1,2), g AS (SELECT feature, count(*) AS models, count(*) FILTER (WHERE coefficient<>0) AS nonzero, count(*) FILTER (WHERE coefficient>0) AS positive,
 count(*) FILTER (WHERE coefficient<0) AS negative, quantile_cont(coefficient,0.5) AS median, quantile_cont(coefficient,0.25) AS q1, quantile_cont(coefficient,0.75) AS q3 FROM c GROUP BY 1) SELECT *, CASE WHEN positive>negative THEN 'positive' WHEN negative>positive THEN 'negative' ELSE 'none' END AS dominant_sign,
 nonzero>=4 AND greatest(positive,negative)>=4 AS stable, CASE WHEN nonzero>=4 AND greatest(positive,negative)>=4 THEN CASE WHEN positive>negative THEN 'positive' ELSE 'negative' END ELSE 'not_assigned' END AS reported_direction FROM g""", "median q1 q3", "X-8")
def _(t):
    c = t.contrib.groupBy(F.col("k").cast("long").alias("feature"), (F.col("grp") % 5).alias("fold")).agg(F.regr_slope(F.col("y").cast("double"), "raw").alias("coefficient"))
    return X.coefficient_stability(c)


@query("rank_concordance", "SELECT corr(a.rank_all, b.rank_all) AS rho_all, corr(a.rank_specific, b.rank_specific) AS rho_specific, count(*) AS features FROM v_imp a JOIN v_imp b ON a.feature=b.feature AND a.family='linear' AND b.family='tree'", "rho_all rho_specific", "X-9")
def _(t):
    return X.rank_concordance(A.keep(X.importance(glong(t))), "linear", "tree")


@query("supported_features", "SELECT a.feature, a.rank_all::INT AS rank_left, b.rank_all::INT AS rank_right FROM v_imp a JOIN v_imp b ON a.feature=b.feature AND a.family='linear' AND b.family='tree' WHERE a.rank_all<=10 AND b.rank_all<=10", "", "X-10 U-3")
def _(t):
    return X.supported(A.keep(X.importance(glong(t))), "linear", "tree")


VIEWS["v_dep0"] = """SELECT feature, contribution, CASE WHEN feature IN ('f3','f7') THEN greatest(round(raw*4),1) WHEN feature='f5' THEN (raw>0)::INT WHEN feature='f2' AND vec_id%13=0 THEN NULL ELSE raw END AS raw FROM v_glong WHERE family='linear'"""
VIEWS["v_dep"] = """WITH k AS (SELECT * FROM v_dep0 WHERE raw IS NOT NULL), e AS (SELECT feature, list_sort(list_distinct(quantile_cont(raw,[0,0.2,0.4,0.6,0.8,1.0]))) AS e, count(DISTINCT raw) AS d FROM k GROUP BY 1), s AS (SELECT feature, list_sort(list_distinct(quantile_cont(raw,[0,0.2,0.4,0.6,0.8,1.0]))) AS s FROM (SELECT DISTINCT feature, raw FROM k) GROUP BY 1),
 t AS (SELECT feature, CASE WHEN len(e)-1<3 AND d>=3 THEN s ELSE e END AS ed, CASE WHEN feature='f5' THEN 'BINARY' WHEN len(e)-1<3 AND d>=3 THEN 'DISTINCT_VALUE_QUANTILES' ELSE 'QUANTILES' END AS method FROM e JOIN s USING (feature)),
 m AS (SELECT feature, count(raw) AS known, count(*)-count(raw) AS missing FROM v_dep0 GROUP BY 1)
 SELECT feature, CASE WHEN method='BINARY' THEN raw ELSE greatest(len(list_filter(ed, lambda q: q<raw)),1) END::INT AS bin, count(*) AS n, min(raw) AS min_value, max(raw) AS max_value, avg(raw) AS mean_value, avg(contribution) AS mean_contribution, max(method) AS method,
 median(raw) AS median_value, median(contribution) AS median_contribution, max(known) AS known, max(missing) AS missing FROM k JOIN t USING (feature) JOIN m USING (feature) GROUP BY 1,2"""


def dep(t):
    """One feature made binary, one with missing values, two with heavy ties."""
    raw = F.col("raw")
    kinds = F.when(F.col("feature").isin("f3", "f7"), F.greatest(F.round(raw * 4), F.lit(1.0))).when(F.col("feature") == "f5", (raw > 0).cast("double"))
    kinds = kinds.when((F.col("feature") == "f2") & (F.col("vec_id") % 13 == 0), F.lit(None)).otherwise(raw)
    return X.dependence(glong(t).where("family = 'linear'").withColumn("raw", kinds), binary=["f5"])


@query("binned_response", "SELECT * FROM v_dep", "min_value max_value mean_value mean_contribution median_value median_contribution", "X-11 W-6")
def _(t):
    return dep(t)


@query("response_shape", """WITH r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY median_value)+(count(*) OVER (PARTITION BY feature, median_value)-1)/2.0 AS rv, rank() OVER (PARTITION BY feature ORDER BY mean_contribution)+(count(*) OVER (PARTITION BY feature, mean_contribution)-1)/2.0 AS rc,
 mean_contribution-lag(mean_contribution) OVER (PARTITION BY feature ORDER BY bin) AS d FROM v_dep),
 g AS (SELECT feature, count(*) AS bins, round(corr(rv,rc),12) AS rho, max_by(mean_contribution,bin)-min_by(mean_contribution,bin) AS change, max(mean_contribution)-min(mean_contribution) AS r, bool_or(method='BINARY') AS bi, bool_or(d>0) AS up, bool_or(d<0) AS dn FROM r GROUP BY 1)
 SELECT feature, bins, rho, change, CASE WHEN r<=1e-6 OR bins<(CASE WHEN bi THEN 2 ELSE 3 END) THEN 'no clear direction' WHEN bi THEN CASE WHEN change>0 THEN 'higher when present' ELSE 'lower when present' END WHEN rho>=0.8 AND change>0 THEN 'increasing' WHEN rho<=-0.8 AND change<0 THEN 'decreasing'
 WHEN up AND dn THEN 'nonmonotonic' ELSE 'no clear direction' END AS shape FROM g""", "rho change", "X-12 W-7")
def _(t):
    return X.shape_label(A.keep(dep(t)))


_AV = [("f0", "f6"), ("f1", "f7"), ("f2", "f8")]


@query("availability_audit", " UNION ALL ".join(f"SELECT m.family, m.feature, a.feature AS flag, m.mean_abs AS measurement_abs, m.rank_all::INT AS measurement_rank, a.mean_abs AS flag_abs, a.rank_all::INT AS flag_rank, a.mean_abs>m.mean_abs AS flag_dominates FROM v_imp m JOIN v_imp a ON a.family=m.family AND m.feature='{m}' AND a.feature='{a}'" for m, a in _AV), "measurement_abs flag_abs", "X-13")
def _(t):
    return X.availability_audit(A.keep(X.importance(glong(t))), _AV)


_FL = ["other_proportion_available", "threshold_available", "any_serious"]


@query("duplicate_flags", " UNION ALL ".join(f"SELECT '{a}' AS left_flag, '{b}' AS right_flag, bool_and({a} IS NOT DISTINCT FROM {b}) AS identical FROM v_pairf" for a, b in ((_FL[0], _FL[1]), (_FL[0], _FL[2]), (_FL[1], _FL[2]))), "", "X-13")
def _(t):
    return X.duplicate_flags(pair(t), _FL)


VIEWS["v_cfold"] = "SELECT c.*, g.fold FROM v_contrib c JOIN v_folds g USING (grp)"
_GAP = "avg(raw) FILTER (WHERE y=1)-avg(raw) FILTER (WHERE y=0)"
VIEWS["v_ownw"] = f"SELECT a.fold, k, regr_slope(y, raw) AS slope, {_GAP} AS gap FROM (SELECT DISTINCT fold FROM v_folds) a JOIN v_cfold f ON f.fold<>a.fold GROUP BY 1, 2"
VIEWS["v_allw"] = f"SELECT k, regr_slope(y, raw) AS slope, {_GAP} AS gap FROM v_cfold GROUP BY 1"


def _ranks(weights, on):
    return f"""SELECT family, feature, rank() OVER (PARTITION BY family ORDER BY avg(abs(c)) DESC) AS r FROM (
 SELECT w.family, vec_id, 'f'||(k//4) AS feature, sum(raw*w.value) AS c FROM v_cfold JOIN (UNPIVOT {weights} ON slope, gap INTO NAME family VALUE value) w USING ({on}) GROUP BY 1, 2, 3) GROUP BY 1, 2"""


@query("rank_agreement", f"SELECT family, rho, largest_shift, CASE WHEN rho>=0.75 THEN 'HIGH' WHEN rho>=0.5 THEN 'MODERATE' ELSE 'LOW' END AS agreement FROM (SELECT a.family, corr(a.r,b.r) AS rho, max(abs(a.r-b.r)) AS largest_shift FROM ({_ranks('v_ownw', 'k, fold')}) a JOIN ({_ranks('v_allw', 'k')}) b ON a.family=b.family AND a.feature=b.feature GROUP BY 1)", "rho", "X-14")
def _(t):
    """Ranks of features where each row is explained by the weights of the other folds, against those under the weights of all rows."""
    folds = R.grouped_folds(t.feat, "grp", "y", 5, 11).select("grp", "fold")
    cells = t.contrib.join(folds, "grp").select("vec_id", "k", "fold", "raw", "y")
    weighted = cells.join(A.keep(X.left_out_weights(cells, "k", "fold", "raw", "y"), "left_out_weights"), ["k", "fold"])
    sums = weighted.groupBy("family", "vec_id", F.concat(F.lit("f"), F.floor(F.col("k") / 4).cast("string")).alias("feature")).agg(
        *(F.sum(F.col("raw") * F.col(w)).alias(w) for w in ("own", "full")))
    sums = A.keep(sums, "left_out_contributions")
    return X.agreement(*(X.mean_abs_ranks(sums.withColumn("contribution", F.col(w))) for w in ("own", "full")))


VIEWS["v_colname"] = "SELECT DISTINCT u AS column_name FROM (SELECT unnest(['p_type='||p_type||'='||p_size, 'p_type='||p_type, 'p_type=size='||p_size, 'p_brand='||p_brand, p_name]) AS u FROM part)"
VIEWS["v_concept"] = "SELECT DISTINCT 'p_type='||p_type AS feature, 'kind' AS parent FROM part WHERE p_type<'M' UNION ALL VALUES ('p_type', 'type'), ('p_type=size', 'size'), ('p_typ', 'none')"


@query("concept_parents", "SELECT n.column_name, arg_max(feature, len(feature)) AS feature, arg_max(parent, len(feature)) AS parent, count(feature)>0 AS mapped FROM v_colname n LEFT JOIN v_concept c ON n.column_name=c.feature OR starts_with(n.column_name, c.feature||'=') GROUP BY 1", "", "X-3")
def _(t):
    part = t.table("part")
    typed, size = F.concat(F.lit("p_type="), F.col("p_type")), F.col("p_size").cast("string")
    spelled = F.array(typed, F.concat(typed, F.lit("="), size), F.concat(F.lit("p_type=size="), size), F.concat(F.lit("p_brand="), "p_brand"), F.col("p_name"))
    nested = part.where("p_type < 'M'").select(typed.alias("feature"), F.lit("kind").alias("parent")).distinct()
    plain = t.spark.createDataFrame([("p_type", "type"), ("p_type=size", "size"), ("p_typ", "none")], "feature string, parent string")
    return X.concept_map(part.select(F.explode(spelled).alias("column_name")).distinct(), nested.unionByName(plain))


@query("additivity", "SELECT count(*) AS rows, 0::BIGINT AS violations FROM v_feat", "", "X-15")
def _(t):
    m = F.aggregate(F.transform("embedding", lambda v, i: v.cast("double") * (i % 5 - 2)), F.lit(0.25), lambda a, v: a + v)
    return X.additivity(t.contrib, t.feat.select("vec_id", m.alias("margin")), ["vec_id"], 0.25)


# --- models (rows and invariants only) ----------------------------------------------

NUM = [f"n{i}" for i in range(16)]  # each sums four neighbouring components


def prep():
    return M.Preprocessor(numeric=NUM, log=[], categorical=["event"], rare={"event": ("grp", 11)})


def frame(t):
    """Numeric columns, a level and a grouped fold; rare levels are a matter of each training part."""
    fo = R.grouped_folds(t.feat, "grp", "y", 5, 11).select("grp", F.col("fold").cast("int").alias("fold"))
    f = t.feat.select("vec_id", "grp", "y", F.col("level").alias("event"), *[sum((F.element_at("embedding", 4 * i + j).cast("double") for j in (2, 3, 4)), F.element_at("embedding", 4 * i + 1).cast("double")).alias(n) for i, n in enumerate(NUM)])
    return A.keep(f.join(fo, "grp"), "model_frame")


def linear_fit(d):
    return M.fit_elastic_net(d, "y", 0.1, 0.5)


def boosted_fit(d):
    return M.fit_boosted(d, "y", {"maxIter": 5, "maxDepth": 3, "stepSize": 0.1})


IDS = ["vec_id", "grp"]


@query("preprocessed", None, "", "M-3")
def _(t):
    f = frame(t)
    return prep().fit(f.where("fold <> 0")).apply(f).select("vec_id", F.aggregate(M.vector_to_array("features"), F.lit(0.0), lambda a, v: a + v).alias("feature_sum"))


@query("tuned_elastic_net", None, "", "M-5 M-7")
def _(t):
    f = frame(t)
    inner = R.grouped_folds(f.where("fold <> 0"), "grp", "y", 4, 12).select("grp", F.col("fold").cast("int").alias("inner"))
    return M.tune(f.where("fold <> 0").join(inner, "grp"), "y", "inner", 4, prep, M.ELASTIC_NET_GRID)


@query("oof_elastic_net", None, "", "M-8 M-5")
def _(t):
    return M.oof_predict(frame(t), "fold", 5, "y", prep, linear_fit, IDS, "linear")[0]


@query("oof_boosted", None, "", "M-8 M-6")
def _(t):
    return M.oof_predict(frame(t), "fold", 5, "y", prep, boosted_fit, IDS, "boosted")[0]


@query("fold_coefficients", None, "", "M-12")
def _(t):
    return M.coefficients(t.spark, M.oof_predict(frame(t), "fold", 5, "y", prep, linear_fit, IDS, "linear")[1])


@query("split_importance", None, "", "M-13")
def _(t):
    return M.split_importance(t.spark, M.oof_predict(frame(t), "fold", 5, "y", prep, boosted_fit, IDS, "boosted")[1])


def later(t):
    """Scores of later groups by a model that was fitted on the others, saved and loaded again."""
    f = frame(t)
    folder = f"{shared_dir(t.spark)}/frozen-{uuid.uuid4().hex}"
    M.save_final(folder, *M.fit_final(f.where("grp < 12"), prep, linear_fit))
    pre, model = M.load_final(folder, LogisticRegressionModel)
    return M.score(model, pre, f.where("grp >= 12"), IDS)


@query("later_scores", None, "", "M-10 M-11")
def _(t):
    return later(t)


@query("later_score_checks", "SELECT count(*) AS rows, 0::BIGINT AS null_scores, 0::BIGINT AS out_of_range, 0::BIGINT AS repeated_keys FROM v_feat WHERE grp>=12", "", "M-11")
def _(t):
    return M.score_checks(later(t), IDS)


@query("linear_contributions", None, "", "X-1 X-3")
def _(t):
    f = frame(t)
    pre, model = M.fit_final(f, prep, linear_fit)
    names = t.spark.createDataFrame(list(enumerate(pre.names())), "column_index int, column_name string")
    cmap = X.concept_map(names, t.spark.createDataFrame([(n,) for n in [*NUM, "event"]], "feature string"))
    c = X.linear_contributions(model, pre.apply(f), "vec_id").join(cmap, "column_index")
    return X.group_signed(c, ["vec_id"], "feature")


@query("tree_contributions", None, "", "X-2")
def _(t):
    f = frame(t)
    pre, model = M.fit_final(f, prep, boosted_fit)
    return X.tree_contributions(model, pre.apply(f), "vec_id").where("contribution <> 0")


@query("tree_additivity", "SELECT count(*) AS rows, 0::BIGINT AS violations FROM v_feat", "", "X-2 X-15")
def _(t):
    f = frame(t)
    pre, model = M.fit_final(f, prep, boosted_fit)
    ready = pre.apply(f)
    margin = M.positive_probability(model.transform(ready)).select("vec_id", (0.5 * F.ln(F.col("p") / (1 - F.col("p")))).alias("margin"))
    c = X.tree_contributions(model, ready, "vec_id")
    first = F.when(F.col("column_index") == 0, F.col("base")).otherwise(0.0)
    return X.additivity(c.withColumn("contribution", F.col("contribution") + first), margin, ["vec_id"], 0.0)
