"""Registered queries: evidence cascade, cohort description and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import describe as D
from ..operators import evidence as C
from ..operators import joins as J
from ..operators import prefix as P
from ..operators import resample as R
from ..operators import terms as T
from .oracle_views import VIEWS, strict_sql
from .q_resample import REPS, SEED, draws
from .registry import query

AE = "nct_id, rgid, entity, event, affected, at_risk, event_type, threshold"


@query("valid_denominator", "SELECT event_type, count(*) AS n, sum(affected) AS affected, sum(at_risk) AS at_risk FROM v_ae WHERE at_risk>0 AND affected IS NOT NULL AND affected<=at_risk GROUP BY 1", "affected at_risk", "PF-4")
def _(t):
    return C.valid_denominator(t.ae_row).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("affected").alias("affected"), F.sum("at_risk").alias("at_risk"))


@query("evidence_rows", f"SELECT {AE}, completion_date, phase FROM v_evidence", "affected at_risk threshold", "C-3 PF-5 J-2")
def _(t):
    return t.evidence.select(*AE.split(", "), "completion_date", "phase")


@query("eligible_trials", """SELECT nct_id, phase, enrollment FROM v_trial WHERE nct_id IN (SELECT nct_id FROM v_iv WHERE intervention_type IN ('DRUG','BIOLOGICAL')) AND nct_id IN (SELECT nct_id FROM v_ae)""", "", "C-1 J-6")
def _(t):
    return C.eligible_trials(t.trial, t.intervention, t.ae_row).select("nct_id", "phase", "enrollment")


@query("entity_trials", "SELECT DISTINCT i.entity, i.nct_id, a.anchor FROM v_iv i JOIN v_anchor2 a ON a.entity=i.entity", "", "C-2")
def _(t):
    return C.entity_trials(t.intervention, t.trial_anchor.select("entity", "anchor")).select("entity", "nct_id", "anchor")


@query("unique_title_match", "SELECT nct_id, rgid, title_norm, matches, dgid, group_type FROM v_match", "", "J-11 F-3")
def _(t):
    m = J.unique_text_match(t.result_group, t.design_group, "nct_id", "rgid", "dgid", "title", ["group_type"])
    return m.select("nct_id", "rgid", "title_norm", "matches", "dgid", "group_type")


@query("attributed_arms", f"SELECT entity, event, nct_id, rgid, dgid, group_type FROM ({strict_sql('v_evidence', 1)})", "", "C-4")
def _(t):
    return C.attribute_arms(t.evidence, t.result_group, t.design_group).select("entity", "event", "nct_id", "rgid", "dgid", "group_type")


@query("arm_composition", "SELECT dgid, n_drugs, drug_names FROM v_comp", "", "J-12 A-6")
def _(t):
    return C.arm_composition(t.design_group, t.arm_bridge, t.intervention)


@query("target_monotherapy", f"SELECT entity, event, nct_id, rgid, dgid, intervention_name FROM ({strict_sql('v_evidence', 3)})", "", "C-5")
def _(t):
    a = C.attribute_arms(t.evidence, t.result_group, t.design_group)
    m = C.target_monotherapy(a, C.arm_composition(t.design_group, t.arm_bridge, t.intervention), t.arm_bridge, t.intervention)
    return m.select("entity", "event", "nct_id", "rgid", "dgid", "intervention_name")


@query("treatment_arm_rows", "SELECT entity, event, nct_id, rgid, dgid, group_type, affected, at_risk FROM v_final", "affected at_risk", "C-6 PF-6 PF-7")
def _(t):
    return t.final_rows.select("entity", "event", "nct_id", "rgid", "dgid", "group_type", "affected", "at_risk")


VIEWS["v_ceil0"] = "SELECT a.*, t.completion_date, t.completion_type, t.phase, t.results_posted_date, t.primary_completion_date FROM v_ae a JOIN v_trial t ON t.nct_id=a.nct_id WHERE at_risk>0 AND affected IS NOT NULL AND affected<=at_risk"
VIEWS["v_ceil"] = strict_sql("v_ceil0")


def ceiling(t):
    return C.quality_ceiling(t.ae_row, t.trial, t.result_group, t.design_group, t.arm_bridge, t.intervention)


_REG = """entity, event, count(DISTINCT nct_id) AS trials, count(DISTINCT rgid) AS arms, count(*) AS ae_rows, sum(affected) AS affected, sum(at_risk) AS at_risk, max((event_type='serious')::INT) AS any_serious,
 sum((event_type='serious')::INT)::BIGINT AS serious_rows, min(threshold) AS min_threshold, max(threshold) AS max_threshold"""


@query("quality_ceiling", f"SELECT {_REG} FROM v_ceil GROUP BY 1,2", "affected at_risk min_threshold max_threshold", "C-7 C-8")
def _(t):
    return C.pair_registry(ceiling(t))


@query("pair_registry", f"SELECT {_REG} FROM v_final GROUP BY 1,2", "affected at_risk min_threshold max_threshold", "C-8")
def _(t):
    return C.pair_registry(t.final_rows)


def _stage(tag, src, trial, arm, event, rows, year="approval_year"):
    n = lambda have, e: e if have else "NULL::BIGINT"
    return f"""SELECT s.start, '{tag}' AS stage, count(DISTINCT entity) AS entities, {n(trial, 'count(DISTINCT nct_id)')} AS trials, {n(arm, 'count(DISTINCT rgid)')} AS arms,
 {n(event, 'count(DISTINCT event)')} AS events, {n(event, 'count(DISTINCT (entity,event))')} AS pairs, {n(rows, 'count(*)')} AS rows FROM {src} JOIN (VALUES (1995),(1996),(1997),(1998)) s(start) ON {year}>=s.start WHERE {year}<=1998 GROUP BY 1"""


VIEWS["v_linked"] = "SELECT DISTINCT i.entity, i.nct_id, a.approval_year, a.anchor FROM v_iv i JOIN v_anchor2 a ON a.entity=i.entity"
VIEWS["v_done"] = "SELECT l.*, t.completion_date, t.completion_type, t.phase FROM v_linked l JOIN v_trial t ON t.nct_id=l.nct_id WHERE t.completion_type='ACTUAL' AND t.completion_date<=l.anchor AND coalesce(t.phase,'')<>'PHASE4'"
VIEWS["v_results"] = "SELECT d.*, a.rgid, a.event AS term, a.affected, a.at_risk, a.event_type, a.row_no FROM v_done d JOIN v_ae a ON a.nct_id=d.nct_id AND a.entity=d.entity"
VIEWS["v_results_den"] = "SELECT * FROM v_results WHERE at_risk>0 AND affected IS NOT NULL AND affected<=at_risk"
VIEWS["v_results_code"] = "SELECT d.*, d.term AS event FROM v_results_den d JOIN v_pt p ON p.term=d.term JOIN v_branch b ON b.code=p.code"
_STARTS = [1995, 1996, 1997, 1998]
_FUN = " UNION ALL ".join([
    _stage("S0_COHORT", "v_approval", 0, 0, 0, 0), _stage("S1_LINKED", "v_linked", 1, 0, 0, 0), _stage("S2_COMPLETED", "v_done", 1, 0, 0, 0), _stage("S3_RESULTS", "v_results", 1, 1, 0, 1),
    _stage("S4_DENOMINATOR", "v_results_den", 1, 1, 0, 1), _stage("S5_MAPPED", "v_results_code", 1, 1, 1, 1), _stage("S6_ATTRIBUTED", f"({strict_sql('v_results_code', 1)})", 1, 1, 1, 1),
    _stage("S7_MONOTHERAPY", f"({strict_sql('v_results_code', 3)})", 1, 1, 1, 1), _stage("S8_TREATMENT", f"({strict_sql('v_results_code')})", 1, 1, 1, 1),
    _stage("S9_PAIRS", f"(SELECT DISTINCT entity, event, approval_year FROM ({strict_sql('v_results_code')}))", 0, 0, 1, 0)])


@query("stage_funnel", _FUN, "", "C-9 A-20")
def _(t):
    """Ten stages, each from the one before, over four window starts."""
    anchors = t.trial_anchor.select("entity", "anchor", "approval_year")
    linked = t.intervention.select("entity", "nct_id").distinct().join(anchors, "entity")
    done = C.completed_before(linked.join(t.trial.select("nct_id", "completion_date", "completion_type", "phase"), "nct_id"))
    results = done.join(t.ae_row.withColumnRenamed("event", "term"), ["nct_id", "entity"])
    den = C.valid_denominator(results)
    codes = t.preferred.join(T.primary_hierarchy(t.hierarchy).where("hierarchy_status = 'RESOLVED'").select("code"), "code")
    mapped = A.keep(den.join(codes.select("term"), "term").withColumn("event", F.col("term")), "funnel_mapped")
    a = A.keep(C.attribute_arms(mapped, t.result_group, t.design_group), "funnel_attributed")
    m = A.keep(C.target_monotherapy(a, C.arm_composition(t.design_group, t.arm_bridge, t.intervention), t.arm_bridge, t.intervention), "funnel_mono")
    final = C.treatment_arms(m)
    stages = [
        ("COHORT", t.approval), ("LINKED", linked), ("COMPLETED", done), ("RESULTS", results), ("DENOMINATOR", den), ("MAPPED", mapped), ("ATTRIBUTED", a), ("MONOTHERAPY", m),
        ("TREATMENT", final), ("PAIRS", final.select("entity", "event", "approval_year").distinct())]
    counts = {"entities": ["entity"], "trials": ["nct_id"], "arms": ["rgid"], "events": ["event"], "pairs": ["entity", "event"]}
    return A.funnel(stages, "approval_year", _STARTS, 1998, counts, row_id="row_no")


VIEWS["v_defrow"] = """SELECT c.*, x.anchor, u.definition FROM v_ceil c JOIN v_anchor2 x ON x.entity=c.entity, (VALUES ('STRICT_COMPLETION'),('RESULTS_POSTED'),('WIDE_COMPLETION')) u(definition)
 WHERE coalesce(phase,'')<>'PHASE4' AND CASE definition WHEN 'STRICT_COMPLETION' THEN completion_type='ACTUAL' AND completion_date<=anchor WHEN 'RESULTS_POSTED' THEN results_posted_date<=anchor ELSE primary_completion_date<=anchor END"""


def defined(t, *columns):
    return C.definition_rows(columns, t.ae_row, t.trial, t.trial_anchor.select("entity", "anchor"), t.result_group, t.design_group, t.arm_bridge, t.intervention)


@query("clock_definitions", "SELECT definition, entity, count(DISTINCT nct_id) AS trials, count(*) AS rows FROM v_defrow GROUP BY 1,2", "", "C-10")
def _(t):
    return defined(t, "nct_id", "entity").groupBy("definition", "entity").agg(F.countDistinct("nct_id").alias("trials"), F.count(F.lit(1)).alias("rows"))


#: Entities with at least this many exposed cases in three years have volume; the test tables are small.
LEAST_EXPOSED = 20
VIEWS["v_volume"] = f"SELECT DISTINCT entity FROM v_labels3 WHERE exposed_cases>={LEAST_EXPOSED}"
VIEWS["v_repr"] = """SELECT e.definition, s.entity, s.event, (p.entity IS NOT NULL)::INT AS represented FROM (SELECT DISTINCT definition, entity FROM v_defrow WHERE entity IN (SELECT entity FROM v_volume)) e
 JOIN (SELECT DISTINCT entity, event FROM v_sigr) s ON s.entity=e.entity LEFT JOIN (SELECT DISTINCT definition, entity, event FROM v_defrow) p ON p.definition=e.definition AND p.entity=s.entity AND p.event=s.event"""


def volume(t):
    return t.labels3.where(F.col("exposed_cases") >= LEAST_EXPOSED).select("entity").distinct()


_DEF = "count(DISTINCT entity) AS {0}entities, count(DISTINCT nct_id) AS {0}trials, count(DISTINCT rgid) AS {0}arms, count(DISTINCT (entity,event)) AS {0}pairs"


@query("definition_summary", f"""WITH a AS (SELECT definition, {_DEF.format('')} FROM v_defrow GROUP BY 1), b AS (SELECT definition, {_DEF.format('volume_')} FROM v_defrow WHERE entity IN (SELECT entity FROM v_volume) GROUP BY 1),
 o AS (SELECT definition, count(*) AS shared_pairs FROM (SELECT DISTINCT definition, entity, event FROM v_defrow) WHERE (entity, event) IN (SELECT (entity, event) FROM v_defrow WHERE definition='STRICT_COMPLETION') GROUP BY 1),
 r AS (SELECT definition, count(*) AS signals, sum(represented)::BIGINT AS signals_represented FROM v_repr GROUP BY 1)
 SELECT *, 100.0*shared_pairs/pairs AS shared_pct, 100.0*signals_represented/nullif(signals,0) AS coverage_pct FROM a LEFT JOIN b USING (definition) LEFT JOIN o USING (definition) LEFT JOIN r USING (definition)""", "shared_pct coverage_pct", "C-11")
def _(t):
    return C.definition_summary(defined(t, "nct_id", "rgid", "entity", "event"), t.signals3.where("criterion_r"), volume(t))


@query("definition_coverage_interval", f"""WITH c AS (SELECT definition, entity, sum(represented) AS num, count(*) AS den FROM v_repr GROUP BY 1,2), w AS ({draws('SELECT definition, entity FROM c', 'entity', 'definition')}),
 b AS (SELECT definition, rep, sum(w*num)::DOUBLE/sum(w*den) AS micro FROM w JOIN c USING (definition, entity) GROUP BY 1,2)
 SELECT definition, 'micro' AS measure, 100*quantile_cont(micro,0.025) AS low, 100*quantile_cont(micro,0.975) AS high, count(micro) AS valid, 0::BIGINT AS failed FROM b GROUP BY 1""", "low high", "C-11 B-3")
def _(t):
    pairs = A.keep(defined(t, "entity", "event").distinct(), "definition_pairs")  # read twice
    found = C.represented(pairs, t.signals3.where("criterion_r"), volume(t)).withColumn("den", F.lit(1))
    return R.ci_table(R.bootstrap_ratio(found, "entity", "represented", "den", REPS, SEED, ["definition"]), ["definition"], ["micro"], 100.0)


_LINK = "entity, nct_id, completion_date, completion_type, anchor"


@query("added_link_reasons", f"""SELECT count(*) AS links, count(DISTINCT nct_id) AS trials, count(*) FILTER (WHERE completion_type='ACTUAL' AND completion_date<=anchor) AS actual_by_anchor, count(*) FILTER (WHERE completion_date>anchor) AS after_anchor,
 count(*) FILTER (WHERE completion_date<=anchor AND coalesce(completion_type,'')<>'ACTUAL') AS not_actual_by_anchor, count(*) FILTER (WHERE completion_date IS NULL) AS missing_completion
 FROM (SELECT {_LINK} FROM v_defrow WHERE definition='WIDE_COMPLETION' EXCEPT SELECT {_LINK} FROM v_defrow WHERE definition='STRICT_COMPLETION')""", "", "C-12")
def _(t):
    d = A.keep(defined(t, *_LINK.split(", ")).distinct(), "definition_trials")
    return C.added_link_reasons(C.added_links(d.where("definition = 'WIDE_COMPLETION'"), d.where("definition = 'STRICT_COMPLETION'"), _LINK.split(", ")))


VIEWS["v_cond"] = "SELECT DISTINCT orderkey AS nct_id, CASE WHEN name LIKE 'red%' THEN 'Lung carcinoma '||name ELSE name END AS condition FROM v_base"
VIEWS["v_tattr"] = """SELECT t.nct_id, m.any_m AS mapped_any, year(t.completion_date) AS study_year, phase, enrollment, n_arms, allocation='RANDOMIZED' AS randomized, (masking IS NOT NULL AND masking<>'NONE') AS masked, sponsor, model,
 a.n AS ae_rows, m.n AS groups, c.onc AS oncology FROM v_trial t JOIN (SELECT nct_id, bool_or(matches=1) AS any_m, count(*) AS n FROM v_match GROUP BY 1) m ON m.nct_id=t.nct_id
 JOIN (SELECT nct_id, count(*) AS n FROM v_ae GROUP BY 1) a ON a.nct_id=t.nct_id LEFT JOIN (SELECT nct_id, max((condition LIKE '%carcinoma%')::INT) AS onc FROM v_cond GROUP BY 1) c ON c.nct_id=t.nct_id"""


def trial_attrs(t):
    cond = t.items.select(F.col("orderkey").alias("nct_id"), F.when(F.col("name").startswith("red"), F.concat(F.lit("Lung carcinoma "), "name")).otherwise(F.col("name")).alias("condition")).distinct()
    m = J.unique_text_match(t.result_group, t.design_group, "nct_id", "rgid", "dgid", "title")
    return C.trial_attributes(t.trial, t.ae_row, m, cond)


@query("trial_attributes", "SELECT * FROM v_tattr", "", "C-13")
def _(t):
    return trial_attrs(t)


_CONT = ["study_year", "enrollment", "n_arms", "ae_rows"]
_BIN = ["randomized", "masked", "oncology"]
_CAT = ["phase", "sponsor", "model"]


def _balance(src, g):
    parts = [f"""SELECT '{v}' AS variable, 'continuous' AS kind, count({v}) FILTER (WHERE {g}) AS n_yes, avg({v}::DOUBLE) FILTER (WHERE {g}) AS value_yes, count({v}) FILTER (WHERE NOT {g}) AS n_no,
 avg({v}::DOUBLE) FILTER (WHERE NOT {g}) AS value_no, (avg({v}::DOUBLE) FILTER (WHERE {g})-avg({v}::DOUBLE) FILTER (WHERE NOT {g}))/sqrt((var_samp({v}::DOUBLE) FILTER (WHERE {g})+var_samp({v}::DOUBLE) FILTER (WHERE NOT {g}))/2) AS smd FROM {src}""" for v in _CONT]
    smd = "CASE WHEN sqrt((pa*(1-pa)+pb*(1-pb))/2)>0 THEN (pa-pb)/sqrt((pa*(1-pa)+pb*(1-pb))/2) ELSE 0 END"
    parts += [f"SELECT variable, kind, n_yes, pa, n_no, pb, {smd} FROM (SELECT '{v}' AS variable, 'binary' AS kind, count({v}) FILTER (WHERE {g}) AS n_yes, avg({v}::INT) FILTER (WHERE {g}) AS pa, count({v}) FILTER (WHERE NOT {g}) AS n_no, avg({v}::INT) FILTER (WHERE NOT {g}) AS pb FROM {src})" for v in _BIN]
    parts += [f"SELECT variable, kind, n_yes, pa, n_no, pb, {smd} FROM (SELECT '{v}:'||l.lv AS variable, 'level' AS kind, count(*) FILTER (WHERE {g}) AS n_yes, coalesce(avg((coalesce({v},'')=l.lv)::INT) FILTER (WHERE {g}),0) AS pa, count(*) FILTER (WHERE NOT {g}) AS n_no, coalesce(avg((coalesce({v},'')=l.lv)::INT) FILTER (WHERE NOT {g}),0) AS pb FROM {src}, (SELECT DISTINCT {v} AS lv FROM {src} WHERE {v} IS NOT NULL) l GROUP BY l.lv)" for v in _CAT]
    return " UNION ALL ".join(parts)


@query("balance_table", _balance("v_tattr", "mapped_any"), "value_yes value_no smd", "C-14 F-16")
def _(t):
    return D.balance_table(A.keep(trial_attrs(t)), "mapped_any", _CONT, _BIN, _CAT)


@query("arm_exposure", "SELECT entity, count(DISTINCT nct_id) AS trials, count(*) AS arms, sum(m) AS at_risk, max(m) AS largest_arm FROM (SELECT entity, nct_id, rgid, max(at_risk) AS m FROM v_final GROUP BY 1,2,3) GROUP BY 1", "at_risk largest_arm", "C-15")
def _(t):
    return C.arm_exposure(t.final_rows)


VIEWS["v_designs"] = "SELECT nct_id, allocation, masking, model, 'lead' AS role, sponsor FROM v_trial UNION ALL SELECT nct_id, NULL, NULL, model, 'collaborator', 'ZZZ' FROM v_trial WHERE nct_id%3=0"


@query("trial_design", """SELECT t.nct_id, t.phase, t.enrollment, max((d.allocation='RANDOMIZED')::INT) AS randomized, max((d.masking<>'NONE')::INT) AS masked, min(d.model) AS model, max(d.sponsor) FILTER (WHERE role='lead') AS lead_sponsor
 FROM v_trial t JOIN v_designs d ON d.nct_id=t.nct_id GROUP BY 1,2,3""", "", "C-16")
def _(t):
    a = t.trial.select("nct_id", "allocation", "masking", "model", F.lit("lead").alias("role"), "sponsor")
    n = F.lit(None).cast("string")
    b = t.trial.where("nct_id % 3 = 0").select("nct_id", n.alias("allocation"), n.alias("masking"), "model", F.lit("collaborator").alias("role"), F.lit("ZZZ").alias("sponsor"))
    return C.trial_design(t.trial, a.unionByName(b))


PH = ["PHASE1", "PHASE2", "PHASE3"]
VIEWS["v_prog"] = """SELECT i.entity, count(*) AS trials, avg((allocation='RANDOMIZED')::INT) AS randomized_rate, count(allocation) AS randomized_known, avg((masking<>'NONE')::INT) AS masked_rate, count(masking) AS masked_known,
 avg((sponsor='BUILDING')::INT) AS industry_rate, count(sponsor) AS industry_known, median(enrollment::DOUBLE) AS median_enrollment, avg((coalesce(phase,'')='PHASE1')::INT) AS share_0, avg((coalesce(phase,'')='PHASE2')::INT) AS share_1,
 avg((coalesce(phase,'')='PHASE3')::INT) AS share_2, avg((coalesce(phase,'')='PHASE4')::INT) AS share_other, avg((phase IS NULL)::INT) AS share_missing FROM (SELECT DISTINCT entity, nct_id FROM v_iv) i JOIN v_trial t ON t.nct_id=i.nct_id GROUP BY 1"""


@query("programme_profile", "SELECT * FROM v_prog", "randomized_rate masked_rate industry_rate median_enrollment share_0 share_1 share_2 share_other share_missing", "C-17 A-9 A-11 A-12")
def _(t):
    return C.programme(t.intervention, t.trial, PH)


@query("entity_characteristics", """SELECT a.entity, a.kind, CASE WHEN a.approval_year<=1996 THEN 'EARLY' ELSE 'LATE' END AS part, p.trials, p.randomized_rate, x.arms, x.at_risk FROM v_approval a JOIN v_prog p ON p.entity=a.entity
 JOIN (SELECT entity, count(*) AS arms, sum(m) AS at_risk FROM (SELECT entity, nct_id, rgid, max(at_risk) AS m FROM v_final GROUP BY 1,2,3) GROUP BY 1) x ON x.entity=a.entity""", "randomized_rate at_risk", "C-18 J-3")
def _(t):
    p = C.programme(t.intervention, t.trial, PH).select("entity", "trials", "randomized_rate")
    a = t.approval.select("entity", "kind", F.when(F.col("approval_year") <= 1996, "EARLY").otherwise("LATE").alias("part"))
    return J.assemble_by_key([a, p, C.arm_exposure(t.final_rows).select("entity", "arms", "at_risk")], "entity")


_T1C = ["enrollment", "ae_rows"]
VIEWS["v_t1"] = "SELECT * FROM (" + _balance("v_tattr", "mapped_any") + ")"


def _q(v):
    f = lambda g: f"format('{{:.1f}} [{{:.1f}}-{{:.1f}}]', quantile_cont({v}::DOUBLE,0.5) FILTER (WHERE {g}), quantile_cont({v}::DOUBLE,0.25) FILTER (WHERE {g}), quantile_cont({v}::DOUBLE,0.75) FILTER (WHERE {g}))"
    return f"SELECT '{v}' AS variable, {f('mapped_any')} AS text_yes, {f('NOT mapped_any')} AS text_no FROM v_tattr"


@query("table_one", f"""WITH q AS ({_q('enrollment')} UNION ALL {_q('ae_rows')}), r AS (SELECT b.variable, b.kind, q.text_yes, q.text_no, b.smd FROM v_t1 b JOIN q ON q.variable=b.variable
 UNION ALL SELECT variable, kind, format('{{}} ({{:.1f}}%)', round(value_yes*n_yes)::BIGINT, 100.0*round(value_yes*n_yes)/n_yes), format('{{}} ({{:.1f}}%)', round(value_no*n_no)::BIGINT, 100.0*round(value_no*n_no)/n_no), smd FROM v_t1 WHERE variable LIKE 'phase:%' OR variable LIKE 'model:%')
 SELECT *, abs(smd)>=0.2 AS imbalanced FROM r""", "smd", "C-19 F-18")
def _(t):
    return D.table_one(A.keep(trial_attrs(t)), "mapped_any", _T1C, ["phase", "model"])


@query("missingness", """WITH x AS (SELECT unnest(['ALL', sponsor]) AS part, phase, allocation, masking, enrollment FROM v_trial), l AS (SELECT part, u.variable AS variable, u.value AS value FROM (SELECT part, unnest([{'variable':'phase','value':phase},
 {'variable':'allocation','value':allocation},{'variable':'masking','value':masking},{'variable':'enrollment','value':enrollment::VARCHAR}]) AS u FROM x)) SELECT part, variable, count(*) AS rows, count(value) AS known, count(*)-count(value) AS missing,
 count(*) FILTER (WHERE try_cast(value AS DOUBLE)=0) AS zeros, count(DISTINCT value) AS distinct_values, 100.0*(count(*)-count(value))/count(*) AS missing_pct, CASE WHEN count(*)=count(value) THEN 'COMPLETE' WHEN count(value)=0 THEN 'ALL_MISSING' ELSE 'PARTIAL' END AS rule FROM l GROUP BY 1,2""", "missing_pct", "C-20 FE-7")
def _(t):
    return D.missingness(t.trial, ["phase", "allocation", "masking", "enrollment"], "sponsor")


_NUM = ["qty", "price", "tax", "total"]
_PCT = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


@query("distribution_profile", " UNION ALL ".join(f"SELECT '{v}' AS variable, count({v}) AS n, min({v}) AS min, max({v}) AS max, avg({v}) AS mean, stddev_samp({v}) AS sd, skewness({v}) AS skew, " + ", ".join(f"quantile_cont({v},{q}) AS {n}" for n, q in _PCT.items()) + " FROM v_base" for v in _NUM),
       "min max mean sd skew " + " ".join(_PCT), "C-21 A-9")
def _(t):
    return D.profile(t.base, _NUM)


@query("outlier_cut", " UNION ALL ".join(f"SELECT '{v}' AS variable, max(cut) AS cut, count(*) FILTER (WHERE {v}>cut) AS above FROM v_base, (SELECT greatest(quantile_cont({v},0.99), quantile_cont({v},0.75)+3*(quantile_cont({v},0.75)-quantile_cont({v},0.25))) AS cut FROM v_base)" for v in ("qty", "tax", "total")), "cut", "F-17")
def _(t):
    return D.outlier_cut(t.base, ["qty", "tax", "total"])


@query("level_profile", " UNION ALL ".join(f"SELECT '{v}' AS variable, min_by({v},(-n,{v})) AS top_level, max(n) AS top_count, sum(n)::BIGINT AS known, max(n)::DOUBLE/sum(n) AS top_share FROM (SELECT {v}, count(*) AS n FROM v_trial WHERE {v} IS NOT NULL GROUP BY 1)" for v in ("phase", "sponsor", "model")), "top_share", "A-18 C-21")
def _(t):
    return D.level_profile(t.trial, ["phase", "sponsor", "model"])


@query("extreme_values", " UNION ALL ".join(f"SELECT '{v}' AS variable, string_agg(o_orderkey||'='||format('{{:.2f}}',{v}::DOUBLE), '; ' ORDER BY rn) AS extremes FROM (SELECT o_orderkey, {v}, row_number() OVER (ORDER BY {v} DESC, o_orderkey) AS rn FROM orders) WHERE rn<=3" for v in ("o_totalprice", "o_custkey")), "", "S-6")
def _(t):
    return A.extremes(t.table("orders"), "o_orderkey", ["o_totalprice", "o_custkey"])


VIEWS["v_prim"] = "SELECT DISTINCT entity, nct_id FROM v_final"
VIEWS["v_same"] = """SELECT e.entity, e.event, string_agg(DISTINCT e.nct_id::VARCHAR,' | ' ORDER BY e.nct_id::VARCHAR) AS trial_ids, count(DISTINCT e.nct_id) AS trials, min(completion_date) AS first_completion, max(completion_date) AS last_completion,
 bool_and(completion_type='ACTUAL' AND completion_date<=anchor) AS all_before_anchor FROM v_evraw e SEMI JOIN v_prim p ON p.entity=e.entity AND p.nct_id=e.nct_id GROUP BY 1,2"""
VIEWS["v_other"] = VIEWS["v_same"].replace("SEMI JOIN", "ANTI JOIN").replace("v_evraw e", "(SELECT * FROM v_evraw WHERE eligible AND completion_type='ACTUAL' AND completion_date<=anchor) e")
VIEWS["v_evraw"] = "SELECT a.*, t.completion_date, t.completion_type, t.study_type='INTERVENTIONAL' AND t.nct_id IN (SELECT nct_id FROM v_iv WHERE intervention_type IN ('DRUG','BIOLOGICAL')) AS eligible, x.anchor FROM v_ae a JOIN v_trial t ON t.nct_id=a.nct_id JOIN v_anchor2 x ON x.entity=a.entity"
for _k in ("v_same", "v_other"):
    VIEWS[_k] = VIEWS.pop(_k)


def raw_evidence(t):
    drug = C.drug_trials(t.trial, t.intervention).select("nct_id", F.lit(True).alias("eligible"))
    trial = t.trial.select("nct_id", "completion_date", "completion_type").join(drug, "nct_id", "left")
    r = t.ae_row.join(trial, "nct_id").join(t.trial_anchor.select("entity", "anchor"), "entity")
    return r.withColumn("nct_id", F.col("nct_id").cast("string"))


def elsewhere(t):
    keys = A.keep(t.final_rows.select("entity", F.col("nct_id").cast("string").alias("nct_id")).distinct())
    raw = raw_evidence(t)
    good = raw.where("eligible AND completion_type = 'ACTUAL' AND completion_date <= anchor")
    return C.elsewhere_evidence(raw, keys, True), C.elsewhere_evidence(good, keys, False), keys, raw


@query("elsewhere_evidence", "SELECT 'same' AS place, * FROM v_same UNION ALL SELECT 'other', * FROM v_other", "", "C-22 J-7 A-7")
def _(t):
    a, b, _, _ = elsewhere(t)
    return a.withColumn("place", F.lit("same")).unionByName(b.withColumn("place", F.lit("other")))


VIEWS["v_dec"] = """SELECT s.entity, s.event, CASE WHEN a.entity IS NOT NULL THEN 'A_SAME_TRIAL_OTHER_ARM' WHEN b.entity IS NOT NULL THEN 'B_OTHER_COMPLETED_TRIAL' ELSE 'C_NOWHERE_BEFORE_ANCHOR' END AS decomposition, coalesce(a.trials,b.trials,0) AS support_trials
 FROM v_sig s LEFT JOIN v_same a ON a.entity=s.entity AND a.event=s.event LEFT JOIN v_other b ON b.entity=s.entity AND b.event=s.event WHERE s.coverage_class='ONLY_AFTER'"""


@query("decomposition", "SELECT * FROM v_dec", "", "C-23 J-16")
def _(t):
    a, b, _, _ = elsewhere(t)
    return C.decompose(t.signals3.where("coverage_class = 'ONLY_AFTER'"), a, b).select("entity", "event", "decomposition", "support_trials")


@query("recount_same_trial", "SELECT count(*) AS class_a_pairs, count(DISTINCT entity) AS entities FROM v_dec WHERE decomposition='A_SAME_TRIAL_OTHER_ARM'", "", "C-24")
def _(t):
    _, _, keys, raw = elsewhere(t)
    return C.recount_same_trial(t.signals3.where("coverage_class = 'ONLY_AFTER'"), raw, keys)


@query("event_type_profile", """SELECT entity, event, has_serious, has_other, CASE WHEN has_serious=1 AND has_other=1 THEN 'BOTH' WHEN has_serious=1 THEN 'SERIOUS_ONLY' WHEN has_other=1 THEN 'OTHER_ONLY' ELSE 'UNCLASSIFIABLE' END AS profile
 FROM (SELECT entity, event, max((event_type='serious')::INT) AS has_serious, max((event_type='other')::INT) AS has_other FROM v_final GROUP BY 1,2)""", "", "C-25")
def _(t):
    return C.event_type_profile(t.final_rows)


_TC = "CASE WHEN threshold=0 THEN '0%' WHEN threshold>0 AND threshold<5 THEN '>0_TO_<5%' WHEN threshold=5 THEN '=5%' WHEN threshold>5 THEN '>5%'"


@query("threshold_rows", f"""WITH l AS (SELECT unnest(['ALL', CASE WHEN event_type='other' THEN 'OTHER' ELSE 'SERIOUS' END]) AS scope, {_TC} ELSE 'MISSING' END AS category FROM v_evidence), n AS (SELECT scope, category, count(*) AS n FROM l GROUP BY 1,2)
 SELECT scope, category, n, sum(n) OVER (PARTITION BY scope)::BIGINT AS denominator, 100.0*n/sum(n) OVER (PARTITION BY scope) AS percent FROM n""", "percent", "C-26 PF-14")
def _(t):
    return C.threshold_rows(t.evidence)


@query("threshold_trials", f"""SELECT category, count(*) AS trials FROM (SELECT nct_id, CASE WHEN count(DISTINCT c)=0 THEN 'MISSING' WHEN count(DISTINCT c)=1 THEN min(c) ELSE 'MIXED_THRESHOLDS' END AS category
 FROM (SELECT nct_id, CASE WHEN event_type='other' THEN {_TC} END END AS c FROM v_evidence) GROUP BY 1) GROUP BY 1""", "", "C-26")
def _(t):
    return C.threshold_trials(t.evidence)


# --- summaries -------------------------------------------------------------------

@query("exact_quartiles", "SELECT brand AS entity, quantile_cont(price,0.25) AS q1, quantile_cont(price,0.5) AS median, quantile_cont(price,0.75) AS q3, CASE WHEN count(*)>=2 THEN quantile_cont(price,0.75)-quantile_cont(price,0.25) END AS iqr FROM v_base GROUP BY 1", "q1 median q3 iqr", "A-9")
def _(t):
    q = P.quantile_columns(t.items.select(F.col("brand").alias("entity"), "price"), ["entity"], "price", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return q.withColumn("iqr", F.col("q3") - F.col("q1"))


@query("conditional_stats", """SELECT entity, event, max(affected) FILTER (WHERE event_type='serious') AS max_serious, min(threshold) FILTER (WHERE event_type='other') AS min_other, median(threshold) FILTER (WHERE event_type='other') AS median_other,
 CASE WHEN count(affected)>=2 THEN stddev_samp(affected) END AS sd, bool_and(at_risk>=10) AS all_large FROM v_final GROUP BY 1,2""", "max_serious min_other median_other sd", "A-7 A-8 A-10")
def _(t):
    other = F.col("event_type") == "other"
    return t.final_rows.withColumn("_o", F.when(other, F.col("threshold"))).groupBy("entity", "event").agg(
        F.max(F.when(~other, F.col("affected"))).alias("max_serious"), F.min("_o").alias("min_other"), F.expr("percentile(_o, 0.5)").alias("median_other"),
        A.guarded_sd("affected").alias("sd"), F.bool_and(F.col("at_risk") >= 10).alias("all_large"))


@query("multi_event_cases", "SELECT caseid, count(DISTINCT event) AS n FROM v_report GROUP BY 1 HAVING count(DISTINCT event)>=5", "", "A-3")
def _(t):
    return A.multi_key(t.report, ["caseid"], "event", 5)


@query("carried_attributes", "SELECT brand AS entity, min(name) AS name, min(odate) AS odate, min(qty) AS qty FROM v_base GROUP BY 1", "qty", "A-5")
def _(t):
    return A.carry(t.base.withColumnRenamed("brand", "entity"), ["entity"], ["name", "odate", "qty"])


@query("earliest_record", "SELECT entity, min_by(event,(report_date,caseid,event)) AS event, min(report_date) AS report_date, count(*) AS n, bool_or(role='PS') AS any_ps FROM v_report GROUP BY 1", "", "A-22")
def _(t):
    return A.first_per_group(t.report, ["entity"], ["report_date", "caseid", "event"], ["event", "report_date"], [F.count(F.lit(1)).alias("n"), F.bool_or(F.col("role") == "PS").alias("any_ps")])


@query("category_mix", "SELECT sponsor, avg((coalesce(phase,'')='PHASE1')::INT) AS share_0, avg((coalesce(phase,'')='PHASE2')::INT) AS share_1, avg((phase IS NOT NULL AND phase NOT IN ('PHASE1','PHASE2'))::INT) AS share_other, avg((phase IS NULL)::INT) AS share_missing FROM v_trial GROUP BY 1", "share_0 share_1 share_other share_missing", "A-12")
def _(t):
    return A.mix(t.trial, ["sponsor"], "phase", ["PHASE1", "PHASE2"])


@query("stratified_counts", """SELECT u.d AS dimension, coalesce(u.l,'MISSING') AS level, count(*) AS n, sum(enrollment)::BIGINT AS enrollment FROM (SELECT enrollment, unnest([{'d':'phase','l':phase},{'d':'allocation','l':allocation},{'d':'masking','l':masking},{'d':'sponsor','l':sponsor}]) AS u FROM v_trial) GROUP BY 1,2""", "", "A-17")
def _(t):
    return A.stratified_counts(t.trial, ["phase", "allocation", "masking", "sponsor"], {"enrollment": F.sum("enrollment")})


@query("crosstab", "SELECT entity, count(*) FILTER (WHERE role='PS') AS n_PS, count(*) FILTER (WHERE role='SS') AS n_SS, count(*) FILTER (WHERE role='C') AS n_C, count(*) AS total FROM v_report GROUP BY 1", "", "A-19")
def _(t):
    return A.crosstab(t.report, "entity", "role", ["PS", "SS", "C"])


@query("top_concentration", "WITH n AS (SELECT top_group AS g, entity, count(*) AS n FROM v_report JOIN v_group USING (event) GROUP BY 1,2), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC) AS rn FROM n) SELECT g AS top_group, 100.0*sum(n) FILTER (WHERE rn<=1)/sum(n) AS top1_pct, 100.0*sum(n) FILTER (WHERE rn<=3)/sum(n) AS top3_pct FROM r GROUP BY 1", "top1_pct top3_pct", "A-16")
def _(t):
    n = t.report.join(t.event_group, "event").groupBy("top_group", "entity").agg(F.count(F.lit(1)).alias("n"))
    return A.concentration(n, ["top_group"], "n", [1, 3])


@query("violation_examples", "SELECT nct_id, rgid, entity, event, affected, at_risk FROM v_ae WHERE affected>at_risk ORDER BY affected-at_risk DESC, nct_id, rgid, entity, event, affected LIMIT 25", "affected at_risk", "S-2")
def _(t):
    d = t.ae_row.withColumn("_d", -(F.col("affected") - F.col("at_risk")))
    return A.examples(d, F.col("affected") > F.col("at_risk"), ["_d", "nct_id", "rgid", "entity", "event", "affected"], 25).select("nct_id", "rgid", "entity", "event", "affected", "at_risk")


@query("top_then_sort", "SELECT * FROM (SELECT entity, event, count(*) AS n FROM v_report GROUP BY 1,2 ORDER BY n DESC, entity, event LIMIT 20) ORDER BY entity, event", "", "S-3 S-5")
def _(t):
    n = t.report.groupBy("entity", "event").agg(F.count(F.lit(1)).alias("n"))
    return A.top_then_sort(n, [F.col("n").desc(), F.col("entity"), F.col("event")], 20, [F.col("entity"), F.col("event")])


@query("count_suppression", "SELECT entity, event, count(*)>=50 AS at_least_50, count(*)>=100 AS at_least_100 FROM v_report GROUP BY 1,2", "", "PF-10 PF-16")
def _(t):
    n = t.report.groupBy("entity", "event").agg(F.count(F.lit(1)).alias("n"))
    return n.select("entity", "event", *X.volume_tiers("n", [50, 100], "at_least_"))


@query("followup_complete", "SELECT entity, anchor, (anchor+INTERVAL 3 YEAR)::DATE<=DATE '2000-06-30' AS complete_3y FROM v_approval", "", "PF-19")
def _(t):
    return t.approval.select("entity", "anchor", X.followup_complete("anchor", 3, F.lit("2000-06-30").cast("date")).alias("complete_3y"))


@query("display_texts", "SELECT entity, format('{} ({:.1f}%)', count(*) FILTER (WHERE role='PS'), 100.0*count(*) FILTER (WHERE role='PS')/count(*)) AS n_pct, format('{}/{}', count(*) FILTER (WHERE role='PS'), count(*)) AS n_of_total FROM v_report GROUP BY 1", "", "F-18 Q-21")
def _(t):
    g = t.report.groupBy("entity").agg(F.count(F.when(F.col("role") == "PS", 1)).alias("k"), F.count(F.lit(1)).alias("n"))
    return D.denominator_table(g, "entity", "k", "n")


@query("assembled_rows", "SELECT a.entity, a.kind, a.approval_year, n.reports, p.pairs FROM v_approval a JOIN (SELECT entity, count(*) AS reports FROM v_report GROUP BY 1) n ON n.entity=a.entity JOIN (SELECT entity, count(*) AS pairs FROM v_cand GROUP BY 1) p ON p.entity=a.entity", "", "PF-17 J-3")
def _(t):
    n = t.report.groupBy("entity").agg(F.count(F.lit(1)).alias("reports"))
    p = t.candidates.groupBy("entity").agg(F.count(F.lit(1)).alias("pairs"))
    return J.assemble_by_key([t.approval.select("entity", "kind", "approval_year"), n, p], "entity")


@query("logit_transforms", "SELECT doc_id, ln(1+p0) AS log1p, ln(p0/(1-p0)) AS logit, 1/(1+exp(-(2*p1-1))) AS expit FROM v_pred", "log1p logit expit", "F-15")
def _(t):
    return t.pred.select("doc_id", F.log1p("p0").alias("log1p"), N.logit("p0").alias("logit"), N.expit(2 * F.col("p1") - 1).alias("expit"))
