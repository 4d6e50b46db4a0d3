"""Registered queries: nested tuning of the model table, its statistics and its score equations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import attribution as X
from ..operators import features as FE
from ..operators import model as M
from ..operators import nested as N
from ..operators.storage import keep
from ..sources.bindings import STAGES
from .oracle_views import VIEWS
from .q_features import _NUMERIC, CF, PF, table
from .q_resample import _fold_sql
from .registry import query

OUTER, INNER, SEED = 5, 4, 21
SETS = {"context": [c for c in CF if c != "priority"]}
SETS["all"] = [*SETS["context"], *PF]
KIND = {n: FE.feature_kind(n, "double" if n in _NUMERIC else "string") for n in SETS["all"]}
NUMBERS, LEVELS = [n for n in SETS["all"] if n in _NUMERIC], [n for n in SETS["all"] if n not in _NUMERIC]


def nested(t) -> N.Nested:
    """The nested search of both feature sets; made once for a session and folder, and read by all queries below."""
    key = (t.spark.sparkContext.applicationId, t.path, "nested_elastic_net")
    if key not in STAGES:
        rows = keep(table(t), "model_table")
        STAGES[key] = N.nested_elastic_net(rows, N.inputs_of(rows, SETS, fixed.RARE_MIN_ENTITIES), M.ELASTIC_NET_GRID, OUTER, INNER, SEED, full=True)
    return STAGES[key]


VIEWS["v_nfold"] = _fold_sql("SELECT entity AS grp, label AS y FROM v_model", OUTER, SEED)
VIEWS["v_ninner"] = _fold_sql(f"SELECT m.entity AS grp, m.label AS y, o.ofold AS outer_fold FROM v_model m JOIN v_nfold g ON g.grp=m.entity, range({OUTER + 1}) o(ofold) WHERE o.ofold<>g.fold", INNER, SEED + 1, "outer_fold")
VIEWS["v_nmember"] = f"""SELECT i.grp AS entity, (i.outer_fold*{INNER + 1}+s.k)::INT AS part FROM v_ninner i, range({INNER + 1}) s(k) WHERE s.k=0 OR s.k-1<>i.fold"""
VIEWS["v_nlong"] = " UNION ALL ".join(f"SELECT entity, pair_id, label, '{n}' AS variable, {f'ln(1+{n}::DOUBLE)' if KIND[n][1].startswith('log1p') else f'{n}::DOUBLE'} AS value, {n}::DOUBLE AS plain FROM v_model" for n in NUMBERS)
_MEDIAN = ", ".join(f"'{n}'" for n in NUMBERS if KIND[n][2].startswith("median"))
_LOGGED = ", ".join(f"'{n}'" for n in NUMBERS if KIND[n][1].startswith("log1p"))
VIEWS["v_nstat"] = f"""SELECT part, variable, rows, fill, mean, CASE WHEN sd>1e-6 THEN sd ELSE 1.0 END AS sd FROM (
 SELECT m.part, l.variable, count(*) AS rows, any_value(f.fill) AS fill, avg(coalesce(l.value, f.fill_value)) AS mean, stddev_pop(coalesce(l.value, f.fill_value)) AS sd
 FROM v_nlong l JOIN v_nmember m ON m.entity=l.entity JOIN (SELECT part, variable, fill, CASE WHEN variable IN ({_LOGGED}) THEN ln(1+fill) ELSE fill END AS fill_value FROM (
  SELECT part, variable, coalesce(CASE WHEN variable IN ({_MEDIAN}) THEN quantile_cont(plain, 0.5) END, 0.0) AS fill FROM v_nlong JOIN v_nmember USING (entity) GROUP BY 1, 2)) f ON f.part=m.part AND f.variable=l.variable GROUP BY 1, 2)"""
VIEWS["v_nlevel"] = " UNION ALL ".join(f"SELECT entity, pair_id, label, '{n}' AS variable, {n}::VARCHAR AS value FROM v_model WHERE {n} IS NOT NULL" for n in LEVELS)
VIEWS["v_nkept"] = f"""SELECT part, variable, value, CASE WHEN variable<>'event' OR n>={fixed.RARE_MIN_ENTITIES} THEN value ELSE '{fixed.RARE_LEVEL}' END AS level FROM (
 SELECT part, variable, value, count(DISTINCT entity) AS n FROM v_nlevel JOIN v_nmember USING (entity) GROUP BY 1, 2, 3)"""


@query("nested_statistics", "SELECT part, variable, rows, fill, mean, sd FROM v_nstat", "fill mean sd", "M-3 M-4 FE-7")
def _(t):
    return nested(t).numeric


@query("nested_levels", "SELECT DISTINCT part, variable, level FROM v_nkept", "", "M-3 M-1")
def _(t):
    return nested(t).levels


_SET_NAMES = " UNION ALL ".join(f"SELECT '{s}' AS feature_set, unnest([{', '.join(repr(n) for n in names)}]) AS variable" for s, names in SETS.items())


@query("nested_equations", f"""WITH s AS ({_SET_NAMES}), outer_part AS (SELECT entity, part, part//{INNER + 1} AS fold FROM v_nmember WHERE part%{INNER + 1}=0),
 size AS (SELECT part, count(*) AS n, avg(label) AS share FROM v_model JOIN outer_part USING (entity) GROUP BY 1),
 x AS (SELECT o.fold, l.variable, l.variable AS column_name, avg((coalesce(l.value, CASE WHEN l.variable IN ({_LOGGED}) THEN ln(1+k.fill) ELSE k.fill END)-k.mean)/k.sd*l.label) AS equation
  FROM v_nlong l JOIN outer_part o ON o.entity=l.entity JOIN v_nstat k ON k.part=o.part AND k.variable=l.variable GROUP BY 1, 2, 3
 UNION ALL SELECT o.fold, l.variable, l.variable||'='||k.level, sum(l.label)::DOUBLE/any_value(z.n) FROM v_nlevel l JOIN outer_part o ON o.entity=l.entity JOIN v_nkept k ON k.part=o.part AND k.variable=l.variable AND k.value=l.value JOIN size z ON z.part=o.part GROUP BY 1, 2, 3)
 SELECT feature_set, fold::INT AS fold, column_name, equation FROM x JOIN s USING (variable)
 UNION ALL SELECT f.feature_set, (part//{INNER + 1})::INT, '(intercept)', share FROM size, (SELECT DISTINCT feature_set FROM s) f""", "equation", "M-5 M-7 M-12", 5)
def _(t):
    """Score equations of the fits chosen in every outer part: mean of x times fitted probability plus the penalty's slope is the mean of x times label."""
    return nested(t).coefficients.select("feature_set", "fold", "column_name", "equation")


@query("nested_coefficients", None, "", "M-12")
def _(t):
    return nested(t).coefficients.select("feature_set", "fold", "column_name", "coefficient")


@query("nested_search", None, "", "M-7 M-5")
def _(t):
    return nested(t).search


@query("nested_choice", f"SELECT feature_set, fold::INT AS fold, 1::BIGINT AS chosen, {len(M.ELASTIC_NET_GRID)}::BIGINT AS settings, TRUE AS least_loss FROM (SELECT DISTINCT fold FROM v_nfold UNION ALL SELECT {OUTER}), ({_SET_NAMES}) GROUP BY 1, 2", "", "M-7")
def _(t):
    """One setting for every set and outer fold, and none that is valid has a lower loss."""
    s = nested(t).search
    picked = s.where("chosen").select("feature_set", "fold", F.col("mean_log_loss").alias("best"))
    return s.join(picked, ["feature_set", "fold"]).groupBy("feature_set", "fold").agg(
        F.count(F.when(F.col("chosen"), 1)).alias("chosen"), F.count(F.lit(1)).alias("settings"), F.min(~F.col("valid") | (F.col("mean_log_loss") > F.col("best") - 2 * N.TIE)).alias("least_loss"))


@query("oof_model_table", None, "", "M-8")
def _(t):
    return nested(t).scores


@query("oof_model_table_keys", f"SELECT f.feature_set, m.pair_id, m.entity, g.fold::INT AS fold, m.label, TRUE AS usable FROM v_model m JOIN v_nfold g ON g.grp=m.entity, (SELECT DISTINCT feature_set FROM ({_SET_NAMES})) f", "", "M-8 M-11")
def _(t):
    """Every pair of the model table has a score between 0 and 1 of every set, from the models of its own outer fold."""
    return nested(t).scores.select("feature_set", "pair_id", "entity", "fold", "label", F.coalesce(F.col("p").between(0, 1), F.lit(False)).alias("usable"))


# --- attribution: every row by the fit that did not see it, and by the full fit ---------


@query("oof_contribution_sums", f"""SELECT f.feature_set, k.fit, m.pair_id, m.entity, g.fold::INT AS fold, f.features, TRUE AS adds_up FROM v_model m JOIN v_nfold g ON g.grp=m.entity,
 (SELECT feature_set, count(*) AS features FROM ({_SET_NAMES}) GROUP BY 1) f, (VALUES ('oof'), ('full')) k(fit)""", "", "X-1 X-14 X-15")
def _(t):
    """Every pair is explained by both fits, in all features of the set, and base and contributions add up to the log odds of its score."""
    n = nested(t)
    scores = n.scores.select("feature_set", "pair_id", F.ln(F.col("p") / (1 - F.col("p"))).alias("scored"))
    total = F.aggregate("contributions", F.col("base"), lambda a, v: a + v)
    right = F.when(F.col("fit") == "oof", F.col("scored")).otherwise(F.col("margin"))
    return n.contributions.join(scores, ["feature_set", "pair_id"], "left").select(
        "feature_set", "fit", "pair_id", "entity", "fold", F.size("contributions").cast("long").alias("features"), F.coalesce(F.abs(total - right) < 1e-6, F.lit(False)).alias("adds_up"))


def ranked(t, fit):
    cells = N.contribution_cells(nested(t).contributions.where(F.col("fit") == fit), SETS)
    return X.mean_abs_ranks(cells.withColumn("family", F.col("feature_set")))


@query("oof_importance", None, "", "X-6 X-14")
def _(t):
    return ranked(t, "oof")


@query("oof_rank_agreement", None, "", "X-14")
def _(t):
    """Agreement of the features' ranks out of fold with those under the full fit, over the same rows."""
    return X.agreement(ranked(t, "oof"), ranked(t, "full"))
