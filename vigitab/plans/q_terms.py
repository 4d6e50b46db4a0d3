"""Registered queries: text keys, terminology, identity, version selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import identity as I
from ..operators import joins as J
from ..operators import signals as S
from ..operators import terms as T
from .oracle_views import CELLS, VIEWS, base_sql, cells_sql, name_sql, title_sql
from .registry import query, words

# --- version selection and edges ---------------------------------------------


@query("latest_cases", "SELECT * FROM v_latest", "", "D-1 W-1 W-2 A-4")
def _(t):
    return S.latest_cases(t.versioned_report)


def raw_terms(t):
    old = t.preferred.select(F.concat(F.lit("old "), "term").alias("term"), F.lit(1).cast("long").alias("n"))
    new = t.table("nation").select(F.concat(F.lit("Nothing "), "n_name").alias("term"), F.lit(1).cast("long").alias("n"))
    rows = t.versioned_report.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return rows.unionByName(old).unionByName(new).groupBy("term").agg(F.sum("n").alias("n"))


def term_index(t):
    return T.build_term_index(t.preferred, t.lower_level, T.redirect_history(t.history, t.preferred, t.child_codes))


def term_map(t):
    return T.map_terms_cascade(raw_terms(t), term_index(t), T.primary_hierarchy(t.hierarchy))


def event_map(t):
    """Mapped terms whose folded form leads to one code only."""
    terms = t.versioned_report.select("term").distinct()
    mapped = T.map_terms_cascade(terms, term_index(t), T.primary_hierarchy(t.hierarchy)).select("term", "status", "code")
    return T.quarantine_conflicts(mapped).where("status = 'MAPPED'").select("term", F.col("code").alias("event"))


_CE = "SELECT DISTINCT r.caseid, l.primaryid, l.fda_dt, m.event FROM v_versioned r JOIN v_latest l ON l.caseid=r.caseid AND l.primaryid=r.primaryid JOIN v_event_map m ON m.term=r.term"


@query("case_events", _CE, "", "D-2 J-1 J-2")
def _(t):
    return S.case_events(t.versioned_report, S.latest_cases(t.versioned_report), event_map(t))


@query("unresolved_events", """SELECT count(*) AS unresolved_rows, count(DISTINCT r.caseid) AS unresolved_cases, count(DISTINCT r.term) AS unresolved_terms FROM v_versioned r
 JOIN v_latest l ON l.caseid=r.caseid AND l.primaryid=r.primaryid WHERE r.term NOT IN (SELECT term FROM v_event_map)""", "", "D-3")
def _(t):
    return S.unresolved_events(t.versioned_report, S.latest_cases(t.versioned_report), event_map(t))


VIEWS["v_drugmap"] = f"""SELECT DISTINCT d.drugname, a.entity FROM (SELECT DISTINCT drugname, {base_sql('drugname')} AS k FROM v_versioned) d
 JOIN (SELECT entity, {base_sql('entity')} AS k FROM v_approval) a ON a.k=d.k"""


def drug_map(t):
    names = t.approval.select("entity", F.lit("ACTIVE").alias("kind"), F.col("entity").alias("raw"))
    m = I.resolve_names(t.versioned_report.select(F.col("drugname").alias("raw")).distinct(), I.build_name_index(names))
    return m.where("status = 'MAPPED'").select(F.col("raw").alias("drugname"), "entity")


@query("case_exposures", """SELECT DISTINCT r.caseid, l.primaryid, try_strptime(l.fda_dt::VARCHAR,'%Y%m%d')::DATE AS report_date, m.entity FROM v_versioned r
 JOIN v_latest l ON l.caseid=r.caseid AND l.primaryid=r.primaryid JOIN v_drugmap m ON m.drugname=r.drugname WHERE r.role='PS'""", "", "D-4 PF-2")
def _(t):
    return S.case_exposures(t.versioned_report, S.latest_cases(t.versioned_report), drug_map(t))


def _own(sql):
    """The window cells over the edges of the latest reports."""
    for a, b in (("v_cases", "y_cases"), ("v_exp", "y_exp"), ("v_ev ", "y_ev ")):
        sql = sql.replace(a, b)
    return sql


_CHAIN = f"""WITH y_cases AS (SELECT caseid, try_strptime(fda_dt::VARCHAR,'%Y%m%d')::DATE AS report_date FROM v_latest WHERE fda_dt IS NOT NULL),
 y_exp AS (SELECT DISTINCT r.caseid, c.report_date, m.entity FROM v_versioned r JOIN v_latest l ON l.caseid=r.caseid AND l.primaryid=r.primaryid JOIN y_cases c ON c.caseid=l.caseid JOIN v_drugmap m ON m.drugname=r.drugname WHERE r.role='PS'),
 y_ev AS (SELECT DISTINCT e.caseid, c.report_date, e.event FROM ({_CE}) e JOIN y_cases c ON c.caseid=e.caseid),
 y_pairs AS (SELECT DISTINCT x.entity, y.event, w.anchor, h.horizon, (w.anchor+h.horizon*INTERVAL 1 YEAR)::DATE AS window_end FROM y_exp x JOIN y_ev y ON y.caseid=x.caseid JOIN v_approval w ON w.entity=x.entity, (VALUES (1),(2),(3)) h(horizon)),
 y_cells AS ({_own(cells_sql('y_pairs'))}), y_stat AS ({CELLS.format(src='y_cells')})
 SELECT entity, event, horizon, a, b, c, d, total_cases, ror, ror_lcl95, ic, ic025, (a>=3 AND ror_lcl95>1) AS criterion_r, (a>=3 AND ic025>0) AS criterion_ic FROM y_stat"""


@query("signals_from_reports", _CHAIN, "ror ror_lcl95 ic ic025", "D-1 D-2 D-4 D-5 D-6 D-7 D-8 D-9 D-10 D-11 T-3 T-5 T-6")
def _(t):
    """Reports to newest version, mapped terms and names, unique edges, window cells and flags."""
    latest = A.keep(S.latest_cases(t.versioned_report), "latest")
    cases = latest.select("caseid", X.safe_date("fda_dt").alias("report_date")).where("report_date IS NOT NULL")
    exposures = A.keep(S.case_exposures(t.versioned_report, latest, drug_map(t)).select("caseid", "report_date", "entity"), "exposures")
    events = A.keep(S.case_events(t.versioned_report, latest, event_map(t)).select("caseid", "event").join(cases, "caseid"), "events")
    pairs = exposures.join(events.select("caseid", "event"), "caseid").select("entity", "event").distinct()
    out = S.anchored_signals(S.anchored_pairs(pairs, t.approval.select("entity", "anchor")), cases, exposures, events, restrict=False)
    return out.select("entity", "event", "horizon", "a", "b", "c", "d", "total_cases", "ror", "ror_lcl95", "ic", "ic025", "criterion_r", "criterion_ic")


# --- text keys ----------------------------------------------------------------

_L1 = "trim(regexp_replace(replace(lower(text),'ß','ss'), '\\s+', ' ', 'g'))"
_L2 = "trim(regexp_replace(replace(lower(text),'ß','ss'), '[^\\p{L}\\p{N}]+', ' ', 'g'))"


@query("corpus_normal_forms", f"SELECT doc_id, md5({_L1}) AS folded, md5({_L2}) AS alnum, length({_L2}) AS n FROM documents", "", "F-1 F-2")
def _(t):
    d = t.table("documents")
    return d.select("doc_id", X.norm_l1(F.col("text")).alias("l1"), X.norm_l2(F.col("text")).alias("l2")).select(
        "doc_id", F.md5("l1").alias("folded"), F.md5("l2").alias("alnum"), F.length("l2").cast("long").alias("n"))


@query("title_keys", f"SELECT DISTINCT title, {title_sql('title')} AS title_norm FROM v_rg", "", "F-3")
def _(t):
    return t.result_group.select("title", X.title_key("title").alias("title_norm")).distinct()


_AG = f"regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(x), '{fixed.BRACKETS}',' ','g'), '{fixed.STRENGTH}',' ','g'), '\\b({words(fixed.AGENT_WORDS)})\\b',' ','g'),'[^a-z0-9 -]+',' ','g')),'\\s+',' ','g')"


@query("agent_and_name_keys", f"""SELECT x, {_AG} AS agent, {name_sql('x')} AS name_key, {base_sql('x')} AS base_key, upper(trim(x)) AS fold_key FROM (
 SELECT DISTINCT drugname||CASE WHEN length(drugname)%2=0 THEN ' (oral) 5.5 mg' ELSE '-rwlc' END AS x FROM v_versioned UNION SELECT DISTINCT p_type||' sodium phosphate [film] 20 %' FROM part)""",
       "", "F-4 F-5 F-6 F-10")
def _(t):
    a = t.versioned_report.select("drugname").distinct()
    tail = F.when(F.length("drugname") % 2 == 0, " (oral) 5.5 mg").otherwise("-rwlc")
    b = t.table("part").select(F.concat("p_type", F.lit(" sodium phosphate [film] 20 %")).alias("x"))
    x = a.select(F.concat("drugname", tail).alias("x")).union(b).distinct()
    return x.select("x", X.agent_key("x").alias("agent"), X.name_key("x").alias("name_key"), X.base_key("x").alias("base_key"), X.fold_key("x").alias("fold_key"))


@query("parsed_dates", """SELECT source_row, approval_date, (approval_date IS NULL OR year(approval_date)<>stated_year) AS mismatch,
 try_cast(application[2:] AS BIGINT) AS number, (notes<>'') AS has_note FROM v_approval_row""", "", "F-12 F-13 PF-2 PF-3")
def _(t):
    d = t.approval_row.withColumn("approval_date", X.parse_mixed_date("approval_text"))
    return d.select("source_row", "approval_date", X.date_year_mismatch("approval_date", "stated_year").alias("mismatch"),
                    X.safe_long(F.expr("substring(application, 2)")).alias("number"), X.non_blank("notes").alias("has_note"))


@query("name_flags", f"""SELECT x, regexp_matches(lower(x),'\\+|/|\\sand\\s') AS combination, regexp_matches(regexp_replace(x,'\\([^)]*\\)','','g'),'(?i)[,;]|\\s+and\\s+') AS multi_active,
 regexp_matches(lower(x),'\\b({words(fixed.SALT_REVIEW_WORDS)})\\b') AS salt_review, regexp_matches(lower(x),'(^| )({words(fixed.PLACEBO_INTERVENTION)})( |$)') AS placebo FROM (
 SELECT DISTINCT CASE p_partkey%5 WHEN 0 THEN p_name||' and '||p_brand WHEN 1 THEN p_name||' + saline' WHEN 2 THEN p_name||' (x, y) sodium' WHEN 3 THEN p_name||' placebo' ELSE p_name||'; '||p_type END AS x FROM part)""", "", "PF-6 PF-7 PF-8 PF-9")
def _(t):
    k = F.col("p_partkey") % 5
    x = (F.when(k == 0, F.concat("p_name", F.lit(" and "), "p_brand")).when(k == 1, F.concat("p_name", F.lit(" + saline")))
         .when(k == 2, F.concat("p_name", F.lit(" (x, y) sodium"))).when(k == 3, F.concat("p_name", F.lit(" placebo")))
         .otherwise(F.concat("p_name", F.lit("; "), "p_type")))
    d = t.table("part").select(x.alias("x")).distinct()
    return d.select("x", X.combination_flag("x").alias("combination"), X.multi_active("x").alias("multi_active"),
                    X.word_flag("x", fixed.SALT_REVIEW_WORDS).alias("salt_review"), X.has_token("x", fixed.PLACEBO_INTERVENTION).alias("placebo"))


@query("list_columns", """WITH s AS (SELECT entity, string_agg(DISTINCT name||' | '||'AB-'||bn||'77x', ' | ' ORDER BY name||' | '||'AB-'||bn||'77x') AS packed FROM (SELECT brand AS entity, name, bn FROM v_base) GROUP BY 1),
 p AS (SELECT entity, list_filter(list_transform(string_split(packed,'|'), lambda x: trim(x)), lambda x: x<>'') AS parts FROM s)
 SELECT entity, len(parts) AS n, len(list_filter(parts, lambda x: regexp_matches(x,'^[A-Za-z]{1,8}[- ]?\\d{2,}[A-Za-z0-9-]*$'))) AS codes, array_to_string(list_sort(list_distinct(parts)),'|') AS joined FROM p""", "", "F-7 F-8 F-9 A-6")
def _(t):
    pack = t.base.select(F.col("brand").alias("entity"), F.concat("name", F.lit(" | AB-"), F.col("bn").cast("string"), F.lit("77x")).alias("v"))
    s = pack.groupBy("entity").agg(A.distinct_list("v").alias("packed"))
    p = s.withColumn("parts", X.split_list("packed"))
    return p.select("entity", F.size("parts").cast("long").alias("n"), F.size(X.dev_codes("parts")).cast("long").alias("codes"),
                    F.array_join(F.array_sort(F.array_distinct("parts")), "|").alias("joined"))


@query("status_collapse", """SELECT entity, CASE WHEN lower(orphan) LIKE 'yes%' THEN 'Yes' WHEN lower(orphan)='no' THEN 'No' ELSE 'MISSING/UNKNOWN' END AS orphan,
 CASE WHEN breakthrough='N/A' THEN 'N/A' WHEN lower(breakthrough) LIKE 'yes%' THEN 'Yes' WHEN lower(breakthrough)='no' THEN 'No' ELSE 'MISSING/UNKNOWN' END AS breakthrough,
 CASE WHEN route IS NULL THEN 'MISSING/UNKNOWN' WHEN strpos(route,'|')>0 THEN 'MULTIPLE' WHEN lower(route) LIKE '%oral%' THEN 'ORAL' ELSE 'PARENTERAL' END AS route_class,
 CASE WHEN form='TABLET' THEN 'SOLID' WHEN form='SOLUTION' THEN 'LIQUID' ELSE 'OTHER' END AS form_class FROM v_approval""", "", "PF-12 PF-13")
def _(t):
    return t.approval.select("entity", X.collapse_status("orphan").alias("orphan"), X.collapse_status("breakthrough", True).alias("breakthrough"),
                             X.broad_route("route").alias("route_class"), X.broad_form("form").alias("form_class"))


@query("keyword_classes", """SELECT container, count(*) AS n, max(onc::INT) AS any_oncology FROM (SELECT CASE WHEN x LIKE '%product used for unknown indication%' THEN 'product used for unknown indication'
 WHEN x LIKE '%off label use%' THEN 'off-label use' WHEN x LIKE '%premedication%' THEN 'premedication' WHEN x LIKE '%prophylaxis%' THEN 'prophylaxis' END AS container,
 regexp_matches(x, 'cancer|carcinoma|leukemia|leukaemia|lymphoma|melanoma|neoplasm|tumor|tumour|myeloma') AS onc
 FROM (SELECT CASE event_type WHEN 'error' THEN 'off label use in cancer' WHEN 'view' THEN 'premedication and prophylaxis' WHEN 'click' THEN 'prophylaxis' ELSE event_type END AS x FROM events)) GROUP BY 1""", "", "PF-11")
def _(t):
    e = F.col("event_type")
    x = F.when(e == "error", "Off label use in cancer").when(e == "view", "Premedication and prophylaxis").when(e == "click", "Prophylaxis").otherwise(e)
    d = t.table("events").select(x.alias("x")).select(X.keyword_class("x", fixed.INDICATION_CONTAINERS).alias("container"), X.word_flag("x", fixed.ONCOLOGY_WORDS, False).alias("onc"))
    return d.groupBy("container").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("onc").cast("int")).alias("any_oncology"))


@query("term_frequency", """SELECT 'raw' AS form, term, count(*) AS rows, count(DISTINCT primaryid) AS reports, count(DISTINCT caseid) AS cases FROM v_versioned GROUP BY 2
 UNION ALL SELECT 'folded', upper(trim(term)), count(*), count(DISTINCT primaryid), count(DISTINCT caseid) FROM v_versioned GROUP BY 2""", "", "A-15 F-10")
def _(t):
    a = A.term_frequency(t.versioned_report, F.col("term"), "primaryid", "caseid").withColumn("form", F.lit("raw"))
    b = A.term_frequency(t.versioned_report, X.fold_key("term"), "primaryid", "caseid").withColumn("form", F.lit("folded"))
    return a.unionByName(b)


# --- terminology ----------------------------------------------------------------

@query("history_redirect", "SELECT term, old_code, code FROM v_redirect", "", "T-2")
def _(t):
    return T.redirect_history(t.history, t.preferred, t.child_codes)


@query("term_index", "SELECT level, key, array_to_string(codes, ',') AS codes FROM v_index", "", "T-1")
def _(t):
    return term_index(t).select("level", "key", F.array_join(F.transform("codes", lambda x: x.cast("string")), ",").alias("codes"))


@query("term_cascade", "SELECT term, n, level, status, code FROM v_tmap", "", "T-3 T-4 J-2")
def _(t):
    return term_map(t).select("term", "n", "level", "status", "code")


@query("primary_hierarchy", """WITH x AS (SELECT *, max(primary_flag) OVER (PARTITION BY code) AS f FROM v_hier), g AS (SELECT code, count(DISTINCT (middle,top)) AS branches, min(middle) AS middle, min(top) AS top FROM x WHERE primary_flag=f GROUP BY 1)
 SELECT code, branches, CASE WHEN branches=1 THEN 'RESOLVED' ELSE 'UNRESOLVED_HIERARCHY' END AS hierarchy_status, CASE WHEN branches=1 THEN middle END AS middle, CASE WHEN branches=1 THEN top END AS top FROM g""", "", "T-5")
def _(t):
    return T.primary_hierarchy(t.hierarchy)


VIEWS["v_quar"] = """SELECT r.term, r.n, CASE WHEN b.norm IS NOT NULL THEN 'QUARANTINED' ELSE r.status END AS status, CASE WHEN b.norm IS NULL THEN r.code END AS code, r.norm FROM (SELECT *, trim(regexp_replace(lower(term),'[^a-z0-9]+',' ','g')) AS norm FROM (
 SELECT term, n, status, code FROM v_tmap UNION ALL SELECT replace(term,' ','_'), 1, 'MAPPED', code+1 FROM v_pt WHERE code%4=0)) r
 LEFT JOIN (SELECT norm FROM (SELECT code, trim(regexp_replace(lower(term),'[^a-z0-9]+',' ','g')) AS norm FROM (SELECT term, code FROM v_tmap UNION ALL SELECT replace(term,' ','_'), code+1 FROM v_pt WHERE code%4=0)) GROUP BY 1 HAVING count(DISTINCT code)>1) b ON b.norm=r.norm"""


def with_clashes(t):
    extra = t.preferred.where("code % 4 = 0").select(
        F.replace("term", F.lit(" "), F.lit("_")).alias("term"), F.lit(1).cast("long").alias("n"), F.lit("MAPPED").alias("status"), (F.col("code") + 1).alias("code"))
    return term_map(t).select("term", "n", "status", "code").unionByName(extra)


@query("quarantine", "SELECT term, n, status, code FROM v_quar", "", "T-6")
def _(t):
    return T.quarantine_conflicts(with_clashes(t)).select("term", "n", "status", "code")


_LEG = """x_leg AS (SELECT term, CASE WHEN code%6=0 THEN NULL WHEN code%6=1 THEN code+7 WHEN code%6=2 THEN 1 ELSE code END AS old_code, CASE WHEN code%6=3 THEN 'other' ELSE term END AS old_name FROM v_pt
 UNION ALL SELECT 'lost '||term, code, term FROM v_pt)"""


@query("legacy_defects", f"""WITH {_LEG} SELECT l.term, l.old_code, CASE WHEN l.old_code IS NULL THEN 'NO_OLD_CODE' WHEN m.code IS NULL THEN 'NEW_UNRESOLVED' WHEN p.term IS NULL THEN 'OLD_CODE_UNKNOWN' WHEN p.term<>l.old_name THEN 'OLD_NAME_MISMATCH'
 WHEN l.old_code<>m.code THEN 'CODE_CHANGED' ELSE 'CONSISTENT' END AS defect FROM x_leg l LEFT JOIN v_tmap m ON m.term=l.term LEFT JOIN v_pt p ON p.code=l.old_code""", "", "T-7")
def _(t):
    k = F.col("code") % 6
    a = t.preferred.select("term", F.when(k == 0, F.lit(None)).when(k == 1, F.col("code") + 7).when(k == 2, F.lit(1).cast("long")).otherwise(F.col("code")).alias("old_code"),
                           F.when(k == 3, "other").otherwise(F.col("term")).alias("old_name"))
    b = t.preferred.select(F.concat(F.lit("lost "), "term").alias("term"), F.col("code").alias("old_code"), F.col("term").alias("old_name"))
    return T.classify_legacy(a.unionByName(b), term_map(t), t.preferred).select("term", "old_code", "defect")


@query("review_sample", """WITH d AS (SELECT DISTINCT status, term, n FROM v_tmap), r AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY n DESC, term) AS rn FROM d) SELECT status, term, n, rn::INT AS rn FROM r WHERE rn<=15""", "", "T-8 S-4")
def _(t):
    return A.stratified_head(term_map(t).select("status", "term", "n"), "status", [F.col("n").desc(), F.col("term")], 15, ["term"])


@query("mapping_yield", """SELECT status, level, count(*) AS terms, sum(n)::BIGINT AS rows, 100.0*count(*)/(SELECT count(*) FROM v_tmap) AS terms_pct, 100.0*sum(n)/(SELECT sum(n) FROM v_tmap) AS rows_pct FROM v_tmap GROUP BY 1,2""", "terms_pct rows_pct", "T-9")
def _(t):
    return T.mapping_yield(term_map(t))


@query("mapping_failures", "SELECT count(*) FILTER (WHERE status='MAPPED' AND code IS NULL) AS mapped_without_code, count(*) FILTER (WHERE status<>'MAPPED' AND code IS NOT NULL) AS code_without_mapping, count(*)-count(DISTINCT term) AS repeated_terms FROM v_tmap", "", "T-9")
def _(t):
    return T.mapping_failures(term_map(t))


@query("vocabulary_overlap", """WITH l AS (SELECT DISTINCT p_name AS code FROM part), r AS (SELECT DISTINCT name AS code FROM v_base), s AS (SELECT count(*) AS n FROM l JOIN r USING (code))
 SELECT (SELECT count(*) FROM l) AS left_codes, (SELECT count(*) FROM r) AS right_codes, n AS shared, 100.0*n/(SELECT count(*) FROM l) AS left_covered_pct, 100.0*n/(SELECT count(*) FROM r) AS right_covered_pct FROM s""", "left_covered_pct right_covered_pct", "T-10 U-3")
def _(t):
    return T.vocabulary_overlap(t.table("part").select(F.col("p_name").alias("code")), t.items.select(F.col("name").alias("code")))


@query("bijection_audit", """SELECT 'code' AS side, count(*) AS values, count(*) FILTER (WHERE n>1) AS with_several FROM (SELECT p_name, count(DISTINCT p_brand) AS n FROM part GROUP BY 1)
 UNION ALL SELECT 'name', count(*), count(*) FILTER (WHERE n>1) FROM (SELECT p_brand, count(DISTINCT p_name) AS n FROM part GROUP BY 1)""", "", "T-11")
def _(t):
    return T.bijection_audit(t.table("part"), "p_name", "p_brand")


# --- identity -------------------------------------------------------------------

def cohort_names(t):
    brands = t.table("part").select(
        F.col("p_brand").alias("entity"), F.lit("BRAND").alias("kind"),
        F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, "").otherwise("-abcd")).alias("raw")).distinct()
    return t.approval.select("entity", F.lit("ACTIVE").alias("kind"), F.col("entity").alias("raw")).unionByName(brands)


VIEWS["v_nidx"] = "SELECT 'EXACT' AS form, nkey AS key, list_sort(list(DISTINCT entity)) AS entities, list_sort(list(DISTINCT kind)) AS kinds FROM v_names WHERE nkey<>'' GROUP BY 2 UNION ALL SELECT 'BASE', bkey, list_sort(list(DISTINCT entity)), list_sort(list(DISTINCT kind)) FROM v_names WHERE bkey<>'' GROUP BY 2"
VIEWS["v_rawname"] = """SELECT DISTINCT trim(raw) AS raw FROM (SELECT drugname AS raw FROM v_versioned UNION SELECT name FROM v_base UNION SELECT drugname||', '||'Brand#9' FROM v_versioned UNION SELECT n_name FROM nation UNION SELECT name||'; zzz' FROM v_base)"""
VIEWS["v_nvar"] = f"""SELECT raw, variant, {name_sql('variant')} AS e, {base_sql('variant')} AS b FROM (SELECT DISTINCT raw, unnest(CASE WHEN regexp_matches(raw,'[,;]') THEN list_concat([raw], list_filter(list_transform(regexp_split_to_array(raw,'[,;]'), lambda x: trim(x)), lambda x: x<>'')) ELSE [raw] END) AS variant FROM v_rawname)"""
VIEWS["v_nmap"] = """SELECT raw, CASE WHEN ok THEN hits[1] END AS entity, CASE WHEN ok THEN best.m END AS method, CASE WHEN ok THEN best.c END AS confidence, evry AS candidates,
 CASE WHEN ok THEN 'MAPPED' WHEN len(evry)>1 THEN 'AMBIGUOUS' ELSE 'UNRESOLVED' END AS status FROM (
 SELECT raw, hits, best, list_sort(list_distinct(list_concat(hits,amb))) AS evry, len(hits)=1 AND len(list_filter(amb, lambda x: NOT list_contains(hits,x)))=0 AS ok FROM (
 SELECT raw, coalesce(list_sort(list(DISTINCT hit) FILTER (WHERE hit IS NOT NULL)),[]) AS hits, coalesce(flatten(list(clash) FILTER (WHERE clash IS NOT NULL)),[]) AS amb,
  min({'o':conf<>'HIGH','m':CASE WHEN variant<>raw THEN 'LIST_'||method ELSE method END,'c':conf}) FILTER (WHERE hit IS NOT NULL) AS best FROM (
 SELECT v.raw, v.variant, CASE WHEN len(x.entities)=1 THEN x.entities[1] WHEN x.entities IS NULL AND len(y.entities)=1 THEN y.entities[1] END AS hit,
  CASE WHEN len(x.entities)=1 THEN 'HIGH' WHEN x.entities IS NULL AND len(y.entities)=1 THEN 'MEDIUM' END AS conf,
  CASE WHEN len(x.entities)=1 THEN CASE WHEN len(x.kinds)=2 THEN 'EXACT_ACTIVE_AND_BRAND' WHEN x.kinds[1]='ACTIVE' THEN 'EXACT_ACTIVE' ELSE 'EXACT_BRAND' END WHEN x.entities IS NULL AND len(y.entities)=1 THEN 'UNIQUE_BASE' END AS method,
  CASE WHEN len(x.entities)>1 THEN x.entities WHEN x.entities IS NULL AND len(y.entities)>1 THEN y.entities END AS clash
 FROM v_nvar v LEFT JOIN v_nidx x ON x.form='EXACT' AND x.key=v.e LEFT JOIN v_nidx y ON y.form='BASE' AND y.key=v.b) GROUP BY 1))"""


def raw_names(t):
    d = t.versioned_report.select("drugname").distinct()
    n = t.items.select("name").distinct()
    out = d.select(F.col("drugname").alias("raw")).union(n)
    out = out.union(d.select(F.concat("drugname", F.lit(", Brand#9")))).union(t.table("nation").select("n_name"))
    return out.union(n.select(F.concat("name", F.lit("; zzz")))).distinct()


def name_map(t):
    return I.resolve_names(raw_names(t), I.build_name_index(cohort_names(t)), split_lists=True)


@query("name_index", "SELECT form, key, array_to_string(entities,'|') AS entities, array_to_string(kinds,'|') AS kinds FROM v_nidx", "", "T-12")
def _(t):
    i = I.build_name_index(cohort_names(t))
    return i.select("form", "key", F.array_join("entities", "|").alias("entities"), F.array_join("kinds", "|").alias("kinds"))


@query("name_resolution", "SELECT raw, entity, method, confidence, status, array_to_string(candidates,'|') AS candidates FROM v_nmap", "", "T-13")
def _(t):
    return name_map(t).select("raw", "entity", "method", "confidence", "status", F.array_join("candidates", "|").alias("candidates"))


VIEWS["v_rec"] = "SELECT p_partkey AS record_id, p_brand AS name FROM part UNION ALL SELECT p_partkey, p_name FROM part WHERE p_partkey%3=0"
VIEWS["v_link"] = """SELECT record_id, min(entity) AS entity, min(confidence) AS confidence, string_agg(DISTINCT raw, ' | ' ORDER BY raw) AS matched_names FROM (
 SELECT r.record_id, r.name AS raw, m.entity, m.confidence FROM v_rec r JOIN v_nmap2 m ON m.raw=r.name WHERE m.entity IS NOT NULL) GROUP BY 1 HAVING count(DISTINCT entity)=1"""
VIEWS["v_nmap2"] = "SELECT * FROM v_nmap UNION ALL SELECT entity, entity, 'EXACT_ACTIVE', 'HIGH', [entity], 'MAPPED' FROM v_approval WHERE entity NOT IN (SELECT raw FROM v_nmap)"
VIEWS["v_link"] = VIEWS.pop("v_link")


def records(t):
    p = t.table("part")
    rec = p.select(F.col("p_partkey").alias("record_id"), F.col("p_brand").alias("name"))
    other = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("record_id"), F.col("p_name").alias("name"))
    names = raw_names(t).union(t.approval.select("entity")).distinct()
    return rec, other, I.resolve_names(names, I.build_name_index(cohort_names(t)), split_lists=True)


@query("record_links", "SELECT * FROM v_link", "", "T-14")
def _(t):
    return I.link_records(*records(t))


@query("alias_bridge", f"""SELECT key, array_to_string(list_sort(list(DISTINCT entity)),'|') AS entities, len(list(DISTINCT entity)) AS n FROM (SELECT {name_sql('r.name')} AS key, l.entity FROM v_rec r JOIN v_link l ON l.record_id=r.record_id) WHERE key<>'' GROUP BY 1""", "", "T-15")
def _(t):
    rec, other, m = records(t)
    b = I.bridge_index(I.link_records(rec, other, m), rec.unionAll(other))
    return b.select("key", F.array_join("entities", "|").alias("entities"), F.size("entities").cast("long").alias("n"))


VIEWS["v_balias"] = "SELECT p_partkey AS record_id, unnest(['maker code '||p_partkey, 'pack '||p_type, 'line '||p_brand, 'grade '||p_size||', '||'zzz', p_name]) AS name FROM part"
VIEWS["v_braw"] = "SELECT DISTINCT trim(raw) AS raw FROM (SELECT p_brand AS raw FROM part UNION SELECT name FROM v_balias UNION SELECT n_name FROM nation)"
VIEWS["v_bvar"] = VIEWS["v_nvar"].replace("v_rawname", "v_braw")
VIEWS["v_bmap"] = VIEWS["v_nmap"].replace("v_nvar", "v_bvar")
VIEWS["v_blink"] = "SELECT p_partkey AS record_id, min(m.entity) AS entity FROM part JOIN v_balias a ON a.record_id=p_partkey JOIN v_bmap m ON m.raw=a.name OR m.raw=p_brand WHERE m.entity IS NOT NULL GROUP BY 1 HAVING count(DISTINCT m.entity)=1"
VIEWS["v_bkey"] = f"SELECT key, list_sort(list(DISTINCT entity)) AS x FROM (SELECT {name_sql('a.name')} AS key, l.entity FROM (SELECT * FROM v_balias UNION ALL SELECT p_partkey, p_brand FROM part) a JOIN v_blink l ON l.record_id=a.record_id) WHERE key<>'' GROUP BY 1"


@query("bridged_names", f"""SELECT raw, CASE WHEN open AND n=1 THEN x[1] ELSE entity END AS entity, CASE WHEN open AND n=1 THEN 'SYNONYM_BRIDGE' ELSE method END AS method, CASE WHEN open AND n=1 THEN 'MEDIUM' ELSE confidence END AS confidence,
 CASE WHEN open AND n=1 THEN 'MAPPED' WHEN open AND n>1 THEN 'AMBIGUOUS' ELSE status END AS status, array_to_string(CASE WHEN open THEN coalesce(x, candidates) ELSE candidates END,'|') AS candidates
 FROM (SELECT m.*, b.x, coalesce(len(b.x),0) AS n, m.status='UNRESOLVED' AS open FROM v_bmap m LEFT JOIN v_bkey b ON b.key={name_sql('m.raw')})""", "", "T-15 T-13")
def _(t):
    """Names of parts and their aliases: those that neither pass over the index settles go through the aliases of linked records."""
    p = t.table("part")
    spelled = F.array(
        F.concat(F.lit("maker code "), F.col("p_partkey").cast("string")), F.concat(F.lit("pack "), "p_type"),
        F.concat(F.lit("line "), "p_brand"), F.concat(F.lit("grade "), F.col("p_size").cast("string"), F.lit(", zzz")), F.col("p_name"))
    rec = p.select(F.col("p_partkey").alias("record_id"), F.col("p_brand").alias("name"))
    other = p.select(F.col("p_partkey").alias("record_id"), F.explode(spelled).alias("name"))
    catalog = rec.select(F.col("name").alias("raw")).union(other.select("name")).union(t.table("nation").select("n_name"))
    index = A.keep(I.build_name_index(cohort_names(t)), "name_index")
    links = I.link_records(rec, other, I.resolve_names(catalog, index, split_lists=True))
    found = I.resolve_names(catalog, index, split_lists=True, bridge=I.bridge_index(links, rec.unionAll(other)))
    return found.select("raw", "entity", "method", "confidence", "status", F.array_join("candidates", "|").alias("candidates"))


VIEWS["v_alias_long"] = "SELECT id, seq, role, u.f AS field, u.n AS name FROM (SELECT id, seq, role, unnest([{'f':'name1','n':name1},{'f':'name2','n':name2},{'f':'name3','n':name3},{'f':'name4','n':name4},{'f':'name5','n':name5}]) AS u FROM v_alias) WHERE u.n IS NOT NULL AND trim(u.n)<>''"
NAMES5 = ["name1", "name2", "name3", "name4", "name5"]


@query("name_catalog", "SELECT name AS raw, count(DISTINCT id) AS cases, count(DISTINCT id) FILTER (WHERE role='PS') AS role_cases FROM v_alias_long GROUP BY 1", "", "T-16 U-1 J-15")
def _(t):
    return I.name_catalog(t.alias_row, "id", NAMES5)


VIEWS["v_amap"] = f"SELECT DISTINCT name AS raw, a.entity FROM (SELECT DISTINCT name, {base_sql('name')} AS k FROM v_alias_long) x JOIN (SELECT entity, {base_sql('entity')} AS k FROM v_approval) a ON a.k=x.k"


def alias_map(t):
    names = t.approval.select("entity", F.lit("ACTIVE").alias("kind"), F.col("entity").alias("raw"))
    cat = J.unpivot_names(t.alias_row, ["id"], NAMES5).where(X.non_blank("name")).select(F.col("name").alias("raw")).distinct()
    return I.resolve_names(cat, I.build_name_index(names))


@query("alias_hits", "SELECT DISTINCT l.id, l.seq, l.field, m.entity FROM v_alias_long l JOIN v_amap m ON m.raw=l.name", "", "J-15")
def _(t):
    m = alias_map(t).where("status = 'MAPPED'").select("raw", "entity")
    return J.alias_join(t.alias_row, ["id", "seq"], NAMES5, m, "raw").select("id", "seq", "field", "entity").distinct()


@query("consensus_entity", """SELECT id, seq, min(entity) AS entity, count(DISTINCT field) AS agreeing_fields FROM (SELECT DISTINCT l.id, l.seq, l.field, l.name, m.entity FROM v_alias_long l JOIN v_amap m ON m.raw=l.name) GROUP BY 1,2 HAVING count(DISTINCT entity)=1""", "", "T-21")
def _(t):
    return I.consensus_entity(t.alias_row, ["id", "seq"], NAMES5, alias_map(t))


VIEWS["v_coh"] = """SELECT identity, min_by(act,(approval_date,source_row)) AS entity, min(approval_date) AS first_approval, count(*) AS source_records, min_by(trade,(approval_date,source_row)) AS first_trade, count(DISTINCT application) AS applications,
 bool_or(regexp_matches(act,'[,;]')) AS multi_active, bool_or(regexp_matches(lower(notes),'transition product|new license number')) AS administrative FROM (
 SELECT *, trim(regexp_replace(active,'\\s+',' ','g')) AS act, lower(trim(regexp_replace(active,'\\s+',' ','g'))) AS identity FROM (
 SELECT source_row, CASE WHEN source_row%211=0 THEN active||', other' ELSE active END AS active, trade, approval_date, notes, application FROM v_approval_row)) GROUP BY 1"""


def approval_rows(t):
    return t.approval_row.withColumn("active", F.when(F.col("source_row") % 211 == 0, F.concat("active", F.lit(", other"))).otherwise(F.col("active")))


def cohort(t):
    return I.regulatory_cohort(approval_rows(t), "1993-07-01")


_COH = """SELECT identity, entity, first_approval, source_records, first_trade, applications, multi_active, administrative, year(first_approval) AS approval_year,
 (first_approval+INTERVAL 3 YEAR)::DATE<=DATE '1993-07-01' AS followup_complete, FALSE AS salt_review, multi_active AS excluded FROM v_coh"""


@query("regulatory_cohort", _COH, "", "T-22 A-22 PF-8 PF-9 PF-19 A-21")
def _(t):
    return cohort(t).drop("trades")


@query("cohort_windows", f"""WITH c AS ({_COH}) SELECT s.start, count(*) AS entities, count(*) FILTER (WHERE NOT excluded) AS eligible, count(*) FILTER (WHERE excluded) AS excluded, count(*) FILTER (WHERE NOT excluded AND followup_complete) AS complete_followup
 FROM c JOIN (VALUES (1990),(1991),(1992)) s(start) ON approval_year>=s.start AND approval_year<=1996 GROUP BY 1""", "", "T-23 PF-1")
def _(t):
    return I.cohort_windows(cohort(t), [1990, 1991, 1992], 1996)


@query("repeated_identities", "SELECT lower(trim(regexp_replace(active,'\\s+',' ','g'))) AS identity, count(*) AS records, count(DISTINCT trade) AS trades FROM v_approval_row GROUP BY 1 HAVING count(*)>1", "", "T-23 A-3 F-7")
def _(t):
    return I.repeated_identities(t.approval_row)


@query("trades_in_order", """WITH f AS (SELECT lower(trim(active)) AS identity, trade, min((approval_date,source_row)) AS o FROM v_approval_row GROUP BY 1,2) SELECT identity, string_agg(trade,' | ' ORDER BY o) AS trades, count(*) AS n FROM f GROUP BY 1""", "", "A-21")
def _(t):
    r = t.approval_row.withColumn("approval_date", X.parse_mixed_date("approval_text"))
    r = r.withColumn("identity", F.lower(F.trim("active")))
    out = A.unique_in_order(r, ["identity"], ["approval_date", "source_row"], "trade", "trades")
    return out.join(r.groupBy("identity").agg(F.countDistinct("trade").alias("n")), "identity")


@query("limited_lists", """WITH d AS (SELECT DISTINCT brand, name FROM v_base), r AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY length(name), lower(name), name) AS rn, count(*) OVER (PARTITION BY brand) AS n FROM d)
 SELECT brand AS entity, string_agg(name, ' | ' ORDER BY rn)||CASE WHEN max(n)>5 THEN ' | ... ['||(max(n)-5)||' additional]' ELSE '' END AS names FROM r WHERE rn<=5 GROUP BY 1""", "", "A-21")
def _(t):
    return A.limited_list(t.items.select(F.col("brand").alias("entity"), "name"), ["entity"], "name", "names", 5)


VIEWS["v_src1"] = "SELECT m.entity, min_by(m.drugname, (-w.n, m.drugname)) AS reports_name, CASE WHEN bool_and(m.drugname NOT LIKE '%sodium') THEN 'HIGH' ELSE 'MEDIUM' END AS reports_confidence FROM v_drugmap m JOIN (SELECT drugname, count(*) AS n FROM v_versioned GROUP BY 1) w ON w.drugname=m.drugname GROUP BY 1"
VIEWS["v_src2"] = "SELECT m.entity, min_by(m.raw, (-w.n, m.raw)) AS second_name, CASE WHEN bool_and(m.raw NOT LIKE '%sodium') THEN 'HIGH' ELSE 'MEDIUM' END AS second_confidence FROM v_amap m JOIN (SELECT name AS raw, count(*) AS n FROM v_alias_long GROUP BY 1) w ON w.raw=m.raw GROUP BY 1"
VIEWS["v_src3"] = "SELECT p_brand AS entity, p_brand AS registry_name, 'HIGH' AS registry_confidence FROM part GROUP BY 1"
VIEWS["v_master"] = """SELECT a.entity, a.kind, a.approval_year, bn%9=0 AS excluded, reports_name, second_name, registry_name, coalesce(reports_confidence,'UNRESOLVED') AS reports_confidence, coalesce(second_confidence,'UNRESOLVED') AS second_confidence,
 coalesce(registry_confidence,'UNRESOLVED') AS registry_confidence, CASE WHEN bn%9=0 THEN 'EXCLUDED' WHEN reports_name IS NOT NULL AND second_name IS NOT NULL AND registry_name IS NOT NULL THEN 'MAPPED_ALL'
 WHEN reports_name IS NOT NULL AND second_name IS NOT NULL THEN 'MAPPED_FIRST_TWO' WHEN coalesce(reports_name,second_name,registry_name) IS NOT NULL THEN 'PARTIAL' ELSE 'UNRESOLVED' END AS mapping_status,
 bn%9<>0 AND (reports_name IS NULL OR second_name IS NULL OR registry_name IS NULL OR reports_confidence='MEDIUM' OR second_confidence='MEDIUM' OR kind='BLA') AS review
 FROM v_approval a LEFT JOIN v_src1 s1 ON s1.entity=a.entity LEFT JOIN v_src2 s2 ON s2.entity=a.entity LEFT JOIN v_src3 s3 ON s3.entity=a.entity"""
TAGS = ["reports", "second", "registry"]


def master(t):
    names = t.approval.select("entity", F.lit("ACTIVE").alias("kind"), F.col("entity").alias("raw"))
    index = I.build_name_index(names)
    w1 = t.versioned_report.groupBy(F.col("drugname").alias("raw")).agg(F.count(F.lit(1)).alias("weight"))
    w2 = J.unpivot_names(t.alias_row, ["id"], NAMES5).where(X.non_blank("name")).groupBy(F.col("name").alias("raw")).agg(F.count(F.lit(1)).alias("weight"))
    w3 = t.table("part").groupBy(F.col("p_brand").alias("raw")).agg(F.count(F.lit(1)).alias("weight"))
    src = {k: I.source_summary(I.resolve_names(w.select("raw"), index), w, k) for k, w in zip(TAGS, (w1, w2, w3))}
    co = t.approval.select("entity", "kind", "approval_year", (F.col("bn") % 9 == 0).alias("excluded"))
    return I.identity_master(co, src)


_MC = ["entity", "kind", "approval_year", "excluded", "reports_name", "second_name", "registry_name", "reports_confidence", "second_confidence", "registry_confidence", "mapping_status", "review"]


@query("identity_master", f"SELECT {', '.join(_MC)} FROM v_master", "", "T-17 A-18")
def _(t):
    return master(t).select(*_MC)


@query("identity_review", """WITH r AS (SELECT *, list_filter([CASE WHEN reports_name IS NULL THEN 'reports' END, CASE WHEN second_name IS NULL THEN 'second' END, CASE WHEN registry_name IS NULL THEN 'registry' END], lambda x: x IS NOT NULL) AS m FROM v_master WHERE review)
 SELECT entity, mapping_status, array_to_string(m,'|') AS missing_sources, array_to_string(list_filter([CASE WHEN len(m)>0 THEN 'no evidence in '||array_to_string(m,', ') END, CASE WHEN kind='BLA' THEN 'biologic naming variant' END,
 CASE WHEN reports_confidence='MEDIUM' OR second_confidence='MEDIUM' THEN 'medium-confidence link' END], lambda x: x IS NOT NULL),'; ') AS reasons FROM r""", "", "T-18")
def _(t):
    return I.identity_review(master(t), TAGS)


@query("ambiguous_registry", "SELECT 'names' AS source, raw, len(candidates) AS candidate_count, array_to_string(candidates,' | ') AS candidates FROM v_nmap WHERE status='AMBIGUOUS'", "", "T-19")
def _(t):
    return I.ambiguous_registry({"names": name_map(t)})


@query("mapping_coverage", """SELECT s.start, count(*) AS entities, count(*) FILTER (WHERE reports_name IS NOT NULL) AS mapped_reports, count(*) FILTER (WHERE second_name IS NOT NULL) AS mapped_second, count(*) FILTER (WHERE registry_name IS NOT NULL) AS mapped_registry,
 count(*) FILTER (WHERE mapping_status='MAPPED_ALL') AS mapped_all, count(*) FILTER (WHERE review) AS review FROM v_master JOIN (VALUES (1996),(1997),(1998)) s(start) ON approval_year>=s.start WHERE NOT excluded AND approval_year<=1998 GROUP BY 1""", "", "T-20")
def _(t):
    return I.mapping_coverage(master(t), TAGS, [1996, 1997, 1998], 1998)
