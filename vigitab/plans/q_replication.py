"""Registered queries: replication in the second database, and other endpoints and horizons, with limits from whole entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import numeric as N
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import describe as D
from ..operators import evaluate as E
from ..operators import joins as J
from ..operators import resample as R
from ..operators import signals as S
from .oracle_views import VIEWS
from .q_resample import REPS, SEED, draws, metric_sql
from .q_signals import _DB2, _UNION, REP_MIN, second_db
from .registry import query

MEASURES = ["replicated", "replicated_strict", "directional"]
_TAGGED = f"""{_DB2.format(total=_UNION)}, tagged AS (SELECT x.*, CASE WHEN c.entity IS NOT NULL THEN 'OBSERVED_BEFORE' ELSE 'ONLY_AFTER' END AS coverage_class
 FROM x_class x LEFT JOIN v_cand c ON c.entity=x.entity AND c.event=x.event)"""


def tagged(t):
    rep = S.replication_class(second_db(t)[0], REP_MIN)
    return J.classify_presence(rep, t.candidates, ["entity", "event"], "coverage_class", "OBSERVED_BEFORE", "ONLY_AFTER")


_LONG = " UNION ALL ".join(f"SELECT entity, '{m}' AS measure, {m}::INT AS num, assessable::INT AS den, coverage_class FROM tagged" for m in MEASURES)


@query("replication_interval", f"""WITH {_TAGGED}, m AS ({_LONG}), p AS (SELECT entity, measure, num, den, unnest(['ALL', coverage_class]) AS population FROM m),
 c AS (SELECT population, measure, entity, sum(num) AS num, sum(den) AS den FROM p GROUP BY 1,2,3), w AS ({draws('SELECT entity FROM v_approval', 'entity')}),
 b AS (SELECT population, measure, rep, sum(w*num)::DOUBLE/nullif(sum(w*den),0) AS micro FROM w JOIN c USING (entity) GROUP BY 1,2,3),
 e AS (SELECT population, measure, sum(num)::BIGINT AS n, sum(den)::BIGINT AS denominator, 100.0*sum(num)/nullif(sum(den),0) AS percent FROM c GROUP BY 1,2)
 SELECT e.*, 100*quantile_cont(micro,0.025) AS low_pct, 100*quantile_cont(micro,0.975) AS high_pct FROM e JOIN b USING (population, measure) GROUP BY ALL""", "percent low_pct high_pct", "B-3 D-26 D-27")
def _(t):
    part = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("int").alias("num")) for m in MEASURES))
    long = tagged(t).select("entity", "coverage_class", F.col("assessable").cast("int").alias("den"), F.explode(part).alias("m")).select("entity", "coverage_class", "den", "m.*")
    rows = long.withColumn("population", F.explode(F.array(F.lit("ALL"), "coverage_class")))
    return R.cluster_rates(rows, t.approval.select("entity"), "entity", ["population", "measure"], "num", "den", REPS, SEED)


@query("replication_table", f"""WITH {_TAGGED}, s AS (SELECT coverage_class, count(*) FILTER (WHERE assessable) AS total, count(*) FILTER (WHERE replicated) AS n FROM tagged GROUP BY 1)
 SELECT coverage_class, format('{{}}/{{}}', n, total) AS n_of_total, format('{{}} ({{:.1f}}%)', n, 100.0*n/total) AS n_pct FROM s WHERE total>0""", "", "Q-21 F-18")
def _(t):
    g = tagged(t).groupBy("coverage_class").agg(F.count(F.when(F.col("assessable"), 1)).alias("total"), F.count(F.when(F.col("replicated"), 1)).alias("n"))
    return D.denominator_table(g.where("total > 0"), "coverage_class", "n", "total")


# --- endpoints and horizons -------------------------------------------------

#: (endpoint, horizon in years): the first is the one the scores stand for.
ENDPOINTS = [("criterion_r", 3), ("consensus", 3), ("criterion_r", 2), ("criterion_r", 1)]
_HASH = "((('0x'||substr(md5(entity||'|'||event),1,8))::BIGINT%10000)+0.5::DOUBLE)/10000"
VIEWS["v_endpoint"] = f"""WITH w AS (SELECT entity, event, {_HASH} AS u, coalesce(bool_or(criterion_r) FILTER (WHERE horizon=3),false)::INT AS y3, {', '.join(f"coalesce(bool_or({e}) FILTER (WHERE horizon={h}),false)::INT AS {e}_{h}" for e, h in ENDPOINTS)} FROM v_labels GROUP BY 1,2)
 SELECT entity, event, x.endpoint, x.horizon, x.y, s.score_set, s.p FROM w, LATERAL (VALUES {', '.join(f"('{e}',{h},{e}_{h})" for e, h in ENDPOINTS)}) x(endpoint, horizon, y), LATERAL (VALUES ('p0', round(u,2)), ('p1', round(0.7*u+0.3*y3,2))) s(score_set, p)"""


def endpoint_scores(t):
    """Two nested scores of every candidate pair against each endpoint; a missing label counts as none."""
    wide = S.label_wide(t.labels_h, fixed.HORIZONS)
    u = (F.conv(F.substring(X.pair_id("entity", "event"), 1, 8), 16, 10).cast("long") % 10000 + 0.5) / 10000
    y = lambda e, h: F.coalesce(F.col(f"{e}_{h}y").cast("int"), F.lit(0))
    labels = F.array(*(F.struct(F.lit(e).alias("endpoint"), F.lit(h).alias("horizon"), y(e, h).alias("y")) for e, h in ENDPOINTS))
    scores = wide.select("entity", "event", F.round(u, 2).alias("p0"), F.round(0.7 * u + 0.3 * y(*ENDPOINTS[0]), 2).alias("p1"), F.explode(labels).alias("l"))
    return E.stack_scores(scores.select("entity", "event", "l.*", "p0", "p1"), ["entity", "event", "endpoint", "horizon", "y"], ["p0", "p1"])


_BY = ["endpoint", "horizon", "score_set"]


@query("endpoint_performance", f"SELECT endpoint, horizon, score_set, rows, positives, prevalence, average_precision, auroc, ap_lift FROM ({metric_sql('(SELECT * REPLACE (least(greatest(p,1e-6),1-1e-6) AS p) FROM v_endpoint)', 'endpoint, horizon, score_set')})",
       "prevalence average_precision auroc ap_lift", "E-16 D-29")
def _(t):
    clipped = endpoint_scores(t).withColumn("p", N.clip("p", fixed.PRED_CLIP, 1 - fixed.PRED_CLIP))
    return E.metrics_by(clipped, _BY, "y", "p").select(*_BY, "rows", "positives", "prevalence", "average_precision", "auroc", "ap_lift")


@query("endpoint_increment", f"""WITH w AS ({draws('SELECT DISTINCT entity FROM v_endpoint', 'entity')}), c AS (SELECT endpoint, horizon, score_set, entity, p, sum(y)::DOUBLE AS pos, sum(1-y)::DOUBLE AS neg FROM v_endpoint GROUP BY 1,2,3,4,5),
 g AS (SELECT endpoint, horizon, score_set, rep, p, sum(w*pos) AS pos, sum(w*neg) AS neg FROM c JOIN w USING (entity) GROUP BY 1,2,3,4,5), r AS (SELECT *, sum(pos) OVER q AS cp, sum(neg) OVER q AS cn FROM g WINDOW q AS (PARTITION BY endpoint, horizon, score_set, rep ORDER BY p DESC)),
 b AS (SELECT endpoint, horizon, score_set, rep, sum(pos*cp/nullif(cp+cn,0))/nullif(sum(pos),0) AS ap FROM r GROUP BY 1,2,3,4)
 SELECT a.endpoint, a.horizon, 'average_precision' AS measure, quantile_cont(b.ap-a.ap,0.5) AS median, quantile_cont(b.ap-a.ap,0.025) AS low, quantile_cont(b.ap-a.ap,0.975) AS high, count(b.ap-a.ap) AS valid
 FROM b a JOIN b ON a.endpoint=b.endpoint AND a.horizon=b.horizon AND a.rep=b.rep AND a.score_set='p0' AND b.score_set='p1' GROUP BY 1,2""", "median low high", "E-16 E-12")
def _(t):
    boot = A.keep(R.bootstrap_metrics(endpoint_scores(t), _BY, "entity", "y", "p", REPS, SEED), "endpoint_boot")
    return E.paired_increment(boot, "rep", ["endpoint", "horizon"], "score_set", "p0", "p1", ["average_precision"])
