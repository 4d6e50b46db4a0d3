"""Registered queries: audits, scans and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import numeric as N
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import describe as D
from ..operators import joins as J
from ..operators import quality as Q
from ..operators import resample as R
from ..operators import signals as S
from ..operators.storage import shared_dir
from ..sources import io as IO
from .oracle_views import VIEWS
from .q_resample import REPS, SEED, coverage, draws
from .registry import query


@query("grain_audit", " UNION ALL ".join(f"SELECT '{n}' AS table_name, sum(c)::BIGINT AS rows, count(*) AS keys, sum(c-1)::BIGINT AS repeats, coalesce(sum(c) FILTER (WHERE nul),0)::BIGINT AS null_keys FROM (SELECT count(*) AS c, max(nul) AS nul FROM (SELECT {k}, ({w}) AS nul FROM {s}) GROUP BY {k})" for n, k, w, s in (("orders", "o_orderkey", "o_orderkey IS NULL", "orders"), ("items", "l_orderkey, l_linenumber", "l_orderkey IS NULL OR l_linenumber IS NULL", "lineitem"), ("versions", "caseid, caseversion", "caseid IS NULL OR caseversion IS NULL", "v_versioned"))), "", "Q-1 A-2")
def _(t):
    return Q.grain_audit({"orders": (t.table("orders"), ["o_orderkey"]), "items": (t.table("lineitem"), ["l_orderkey", "l_linenumber"]), "versions": (t.versioned_report, ["caseid", "caseversion"])})


@query("fk_audit", "SELECT 'documents' AS child, count(*) AS orphan_rows, count(DISTINCT doc_id) AS orphan_ids FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'labels', count(*), count(DISTINCT doc_id) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM labels)", "", "Q-2 J-5")
def _(t):
    return Q.fk_audit({"documents": (t.table("documents"), "doc_id"), "labels": (t.table("labels"), "doc_id")}, t.table("labels"), "doc_id")


@query("snapshot_counts", "SELECT 'orders' AS table_name, o_orderstatus AS snapshot, count(*) AS rows FROM orders GROUP BY 2 UNION ALL SELECT 'items', l_linestatus, count(*) FROM lineitem GROUP BY 2 UNION ALL SELECT 'labels', quality::VARCHAR, count(*) FROM labels GROUP BY 2", "", "Q-3 A-23 U-1")
def _(t):
    return A.snapshot_counts({"orders": (t.table("orders"), "o_orderstatus"), "items": (t.table("lineitem"), "l_linestatus"), "labels": (t.table("labels"), "quality")})


@query("period_coverage", "SELECT min(completion_date) AS first_day, max(completion_date) AS last_day, count(DISTINCT date_trunc('month', completion_date)) AS months, count(*) FILTER (WHERE completion_date IS NULL) AS null_days, count(*) AS rows FROM v_trial", "", "Q-4")
def _(t):
    return Q.period_coverage(t.trial, "completion_date")


@query("revision_audit", "SELECT rows_per_id, revisions, count(*) AS ids FROM (SELECT caseid, count(*) AS rows_per_id, count(DISTINCT caseversion) AS revisions FROM v_versioned GROUP BY 1) GROUP BY 1,2", "", "Q-5 W-2")
def _(t):
    return Q.revision_audit(t.versioned_report, "caseid", "caseversion")


@query("category_audit", "SELECT coalesce(phase,'MISSING') AS category, count(*) AS rows, count(DISTINCT nct_id) AS cases FROM v_trial GROUP BY 1", "", "Q-6")
def _(t):
    return Q.category_audit(t.trial, "phase", "nct_id")


@query("field_fill", "SELECT u.v AS variable, count(*) AS rows, count(*) FILTER (WHERE trim(u.n)<>'') AS filled, count(*) FILTER (WHERE trim(u.n)='') AS blank, count(*)-count(u.n) AS missing, 100.0*count(*) FILTER (WHERE trim(u.n)<>'')/count(*) AS filled_pct FROM (SELECT unnest([{'v':'name1','n':name1},{'v':'name2','n':name2},{'v':'name3','n':name3},{'v':'name4','n':name4},{'v':'name5','n':name5}]) AS u FROM v_alias) GROUP BY 1", "filled_pct", "Q-7 PF-3")
def _(t):
    return Q.field_fill(t.alias_row, ["name1", "name2", "name3", "name4", "name5"])


@query("mapped_by_year", "SELECT year(completion_date)::INT AS year, count(*) AS rows, count(phase) AS mapped, 100.0*count(phase)/count(*) AS mapped_pct FROM v_trial GROUP BY 1", "mapped_pct", "Q-8 F-13")
def _(t):
    return Q.mapped_by_year(t.trial, F.year("completion_date"), F.col("phase").isNotNull())


@query("unmapped_by_field", "SELECT field AS variable, sum(n)::BIGINT AS unmapped_rows, count(*) AS unmapped_values FROM (SELECT field, name, count(*) AS n FROM v_alias_long GROUP BY 1,2) WHERE name NOT IN (SELECT entity FROM v_approval) GROUP BY 1", "", "Q-9")
def _(t):
    return Q.unmapped_by_field(t.alias_row, ["name1", "name2", "name3", "name4", "name5"], t.approval, "entity")


@query("multi_value_loss", "SELECT count(*) AS filled, count(*) FILTER (WHERE len(string_split(route,'|'))>1) AS multi_valued, sum(len(string_split(route,'|'))-1)::BIGINT AS values_beyond_first, count(*) FILTER (WHERE len(string_split(route,'|'))>1 AND orphan IS NOT NULL) AS multi_valued_kept_one FROM v_approval WHERE trim(route)<>''", "", "Q-10")
def _(t):
    return Q.multi_value_loss(t.approval, "route", r"\|", "orphan")


@query("outcome_totals", "SELECT count(*) AS rows, count(threshold) AS known_rows, count(*) FILTER (WHERE event_type='serious') AS flag_rows, count(DISTINCT nct_id) AS cases, count(DISTINCT nct_id) FILTER (WHERE threshold IS NOT NULL) AS known_cases, count(DISTINCT nct_id) FILTER (WHERE event_type='serious') AS flag_cases FROM v_ae", "", "Q-11")
def _(t):
    return Q.outcome_totals(t.ae_row, "nct_id", F.col("event_type") == "serious", F.col("threshold").isNotNull())


VIEWS["v_textdate"] = "SELECT CASE o_orderkey%5 WHEN 0 THEN strftime(o_orderdate,'%Y%m%d') WHEN 1 THEN strftime(o_orderdate,'%Y%m') WHEN 2 THEN strftime(o_orderdate,'%Y') WHEN 3 THEN '20240230' ELSE NULL END AS start_text, CASE WHEN o_orderkey%2=0 THEN strftime(o_orderdate,'%Y%m%d') ELSE '' END AS end_text FROM orders"


@query("date_precision", " UNION ALL ".join(f"SELECT '{c}' AS variable, CASE WHEN coalesce(trim({c}),'')='' THEN 'MISSING' WHEN length({c})=8 AND try_strptime({c},'%Y%m%d') IS NOT NULL THEN 'DAY' WHEN regexp_full_match({c},'[0-9]{{6}}') THEN 'MONTH' WHEN regexp_full_match({c},'[0-9]{{4}}') THEN 'YEAR' ELSE 'OTHER' END AS precision, count(*) AS rows FROM v_textdate GROUP BY 2" for c in ("start_text", "end_text")), "", "Q-12 PF-2")
def _(t):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    s = F.when(k % 5 == 0, F.date_format(d, "yyyyMMdd")).when(k % 5 == 1, F.date_format(d, "yyyyMM")).when(k % 5 == 2, F.date_format(d, "yyyy")).when(k % 5 == 3, "20240230")
    e = F.when(k % 2 == 0, F.date_format(d, "yyyyMMdd")).otherwise("")
    return Q.date_precision(t.table("orders").select(s.alias("start_text"), e.alias("end_text")), ["start_text", "end_text"])


@query("pairing_structure", "SELECT exposures, events, count(*) AS cases, count(*)*exposures*events AS pairs FROM (SELECT caseid, count(*) AS exposures FROM v_exp GROUP BY 1) a JOIN (SELECT caseid, count(*) AS events FROM v_ev GROUP BY 1) b USING (caseid) GROUP BY 1,2", "", "Q-13")
def _(t):
    return Q.pairing_structure(t.exposures, t.case_event, "caseid")


@query("hierarchy_coverage", "SELECT count(*) AS codes, count(middle) AS with_middle, count(top) AS with_top FROM (SELECT code, CASE WHEN n=1 THEN m END AS middle, CASE WHEN n=1 THEN tp END AS top FROM (SELECT code, count(DISTINCT (middle,top)) AS n, min(middle) AS m, min(top) AS tp FROM v_hier GROUP BY 1))", "", "Q-14 T-5")
def _(t):
    from ..operators import terms as T

    return Q.hierarchy_coverage(T.primary_hierarchy(t.hierarchy.withColumn("primary_flag", F.lit("N"))), ["middle", "top"])


@query("shared_ids", "SELECT l_suppkey AS primaryid, count(DISTINCT l_orderkey) AS cases, count(*) AS rows FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey)>1", "", "Q-15 A-3")
def _(t):
    r = t.table("lineitem").select(F.col("l_suppkey").alias("primaryid"), F.col("l_orderkey").alias("caseid"))
    return Q.shared_ids(r, "primaryid", "caseid")


@query("reconciled_counts", "SELECT 'orders' AS metric, (SELECT count(*) FROM orders)::DOUBLE AS actual, (SELECT count(DISTINCT l_orderkey) FROM lineitem)::DOUBLE AS expected, (SELECT count(*) FROM orders)=(SELECT count(DISTINCT l_orderkey) FROM lineitem) AS passed UNION ALL SELECT 'cases', (SELECT count(*) FROM v_cases), (SELECT count(DISTINCT caseid) FROM v_report), TRUE", "actual expected", "Q-16")
def _(t):
    one = lambda df, name, c: df.agg(c.alias("value")).select(F.lit(name).alias("metric"), "value")
    n = F.count(F.lit(1))
    a = one(t.table("orders"), "orders", n).unionAll(one(t.cases, "cases", n))
    e = one(t.table("lineitem"), "orders", F.countDistinct("l_orderkey")).unionAll(one(t.report, "cases", F.countDistinct("caseid")))
    return Q.reconcile(a, e)


_BP = [(k, v.replace("'", "''")) for k, v in fixed.BOUNDARY_PATTERNS.items()]


@query("boundary_scan", " UNION ALL ".join(f"SELECT doc_id, '{k}' AS violation FROM documents WHERE regexp_matches(text, '{p}')" for k, p in _BP) + " UNION ALL SELECT doc_id, 'oversized' FROM documents WHERE strlen(text)>20000", "", "Q-17")
def _(t):
    return Q.boundary_scan(t.table("documents"), "doc_id", "text", 20000)


@query("equal_frames", "SELECT 0::BIGINT AS left_only, 0::BIGINT AS right_only, TRUE AS equal", "", "Q-18 J-17")
def _(t):
    a = t.report.groupBy("entity", "event").agg(F.count(F.lit(1)).alias("n"))
    b = t.items.groupBy(F.col("name").alias("event"), F.col("brand").alias("entity")).agg(F.count(F.lit(1)).alias("n"))
    return J.frames_equal(a, b)


@query("table_checks", "SELECT count(*) AS rows, 0::BIGINT AS repeated_labels, 0::BIGINT AS count_above_total, 0::BIGINT AS percent_off FROM v_approval", "", "Q-19")
def _(t):
    g = t.report.groupBy("entity").agg(F.count(F.when(F.col("role") == "PS", 1)).alias("n"), F.count(F.lit(1)).alias("total"))
    return Q.table_checks(g.withColumn("percent", N.pct("n", "total")), ["entity"], "n", "total", "percent")


@query("interval_table", f"""WITH w AS ({draws('SELECT entity FROM v_cov', 'entity')}), b AS (SELECT rep, sum(w*observed)::DOUBLE/nullif(sum(w*signals),0) AS micro, sum(w*observed::DOUBLE/nullif(signals,0)) FILTER (WHERE signals>0)/nullif(sum(w) FILTER (WHERE signals>0),0) AS macro FROM w JOIN v_cov USING (entity) GROUP BY 1)
 SELECT 'micro' AS measure, (SELECT sum(observed)/sum(signals)::DOUBLE FROM v_cov) AS estimate, quantile_cont(micro,0.025) AS low, quantile_cont(micro,0.975) AS high FROM b UNION ALL SELECT 'macro', (SELECT avg(coverage) FROM v_cov), quantile_cont(macro,0.025), quantile_cont(macro,0.975) FROM b""", "estimate low high", "Q-20 B-3")
def _(t):
    cov = coverage(t)
    b = R.bootstrap_ratio(cov, "entity", "observed", "signals", REPS, SEED)
    b = A.keep(b)
    limits = [b.agg(F.expr(f"percentile({m}, {p})").alias("v")).scalar().alias(f"{m}_{n}") for m in ("micro", "macro") for n, p in (("low", 0.025), ("high", 0.975))]
    est = cov.agg(N.ratio(F.sum("observed"), F.sum("signals")).alias("micro"), F.avg("coverage").alias("macro"))
    return D.intervals_long(est.select("micro", "macro", *limits), [], ["micro", "macro"])


@query("forbidden_columns", "SELECT unnest(['criterion_r','criterion_ic']) AS column_name, count(*) AS rows FROM v_sig", "", "PF-18")
def _(t):
    return Q.forbidden_columns(t.signals3, ["criterion", "outcome"])


# --- scans and sinks --------------------------------------------------------------

def scratch(t, name):
    """A new folder below the shared folder."""
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("filtered_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_returnflag='R' AND l_quantity>=45", "l_quantity", "IO-1")
def _(t):
    return IO.scan(t.spark, f"{t.path}/lineitem.parquet", ["l_orderkey", "l_quantity"], (F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 45))


@query("csv_text_scan", "SELECT p_partkey, p_name, p_size, p_retailprice, try_cast(p_brand AS BIGINT) AS p_brand FROM part", "p_retailprice", "IO-2 IO-8 PF-2")
def _(t):
    path = scratch(t, "parts-csv")
    IO.write_csv(t.table("part"), path, ["p_partkey", "p_name", "p_size", "p_retailprice", "p_brand"])
    return IO.scan_text_csv(t.spark, path, {"p_partkey": "bigint", "p_size": "int", "p_retailprice": "double", "p_brand": "bigint"})


@query("csv_inferred_scan", "SELECT o_orderkey::INT AS o_orderkey, o_orderstatus, o_totalprice FROM orders", "o_totalprice", "IO-3 IO-8")
def _(t):
    path = scratch(t, "orders-csv")
    IO.write_csv(t.table("orders"), path, ["o_orderkey", "o_orderstatus", "o_totalprice"])
    return IO.scan_csv(t.spark, path)


@query("dictionary_scan", "SELECT code, term FROM v_pt", "", "IO-4")
def _(t):
    path = scratch(t, "dictionary")
    IO.write_dictionary(t.preferred, path, ["code", "term"])
    return IO.scan_dictionary(t.spark, path, "code long, term string")


@query("registered_tables", "SELECT r_name, count(*) AS nations FROM region JOIN nation ON n_regionkey=r_regionkey GROUP BY 1", "", "IO-5")
def _(t):
    IO.register_tables(t.spark, {n: f"{t.path}/{n}.parquet" for n in ("region", "nation")})
    return t.spark.sql("SELECT r_name, count(*) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")


@query("matrix_scan", "SELECT p_partkey AS row_key, 'p_name' AS column_name, p_name AS value FROM part UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM part", "", "IO-6")
def _(t):
    head = F.array(F.lit("p_partkey"), F.lit("p_name"), F.lit("p_brand"))
    body = F.array(F.col("p_partkey").cast("string"), "p_name", "p_brand")
    # one small matrix per source row keeps the file splittable; each carries its own header
    path = scratch(t, "matrix")
    t.table("part").select(F.array(head, body).alias("values")).write.json(path)
    m = t.spark.read.json(path).withColumn("row_key", F.element_at(F.element_at("values", 2), 1).cast("long"))
    long = IO.matrix_to_table(m, "values", ["row_key"]).drop("row")
    return long.where("column_name <> 'p_partkey'")


@query("table_round_trip", "SELECT caseid, primaryid, report_count FROM v_latest", "", "IO-7")
def _(t):
    path = scratch(t, "latest")
    IO.write_table(S.latest_cases(t.versioned_report), path)
    return IO.scan(t.spark, path, ["caseid", "primaryid", "report_count"])


@query("metrics_record", "SELECT count(*) AS label_rows, count(DISTINCT entity) AS entities FROM v_labels", "", "IO-9")
def _(t):
    path = scratch(t, "metrics")
    IO.write_metrics(S.cell_audit(t.labels_h), path)
    return t.spark.read.json(path).select("label_rows", "entities")


@query("fingerprint", None, "", "IO-10")
def _(t):
    names = ["part", "orders", "customer", "lineitem"]
    return IO.stack_tables({n: IO.fingerprint(t.table(n)) for n in names})


@query("fingerprint_verified", "SELECT count(*) AS rows, TRUE AS unchanged FROM orders", "", "IO-10")
def _(t):
    path = scratch(t, "orders-copy")
    IO.write_table(t.table("orders"), path)
    return IO.verify_fingerprint(t.spark.read.parquet(path), IO.fingerprint(t.table("orders")))


@query("stacked_tables", "SELECT 'entities' AS source_table, entity, count(*) AS n, NULL AS event FROM v_report GROUP BY 2 UNION ALL SELECT 'events', NULL, count(*), event FROM v_report GROUP BY 4", "", "IO-11 U-1")
def _(t):
    a = t.report.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    b = t.report.groupBy("event").agg(F.count(F.lit(1)).alias("n"))
    return IO.stack_tables({"entities": a, "events": b})


@query("cohort_filter", "SELECT entity, anchor FROM v_approval WHERE approval_year BETWEEN 1996 AND 1997 AND kind='NDA' AND coalesce(orphan,'')<>'No'", "", "PF-1")
def _(t):
    return t.approval.where(F.col("approval_year").between(1996, 1997) & (F.col("kind") == "NDA") & (F.coalesce("orphan", F.lit("")) != "No")).select("entity", "anchor")


@query("parsed_reports", "SELECT fda_dt, try_strptime(fda_dt::VARCHAR,'%Y%m%d')::DATE AS report_date, count(*) AS n FROM v_versioned GROUP BY 1,2", "", "PF-2 A-14")
def _(t):
    return t.versioned_report.groupBy("fda_dt", X.safe_date("fda_dt").alias("report_date")).agg(F.count(F.lit(1)).alias("n"))
