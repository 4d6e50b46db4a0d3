"""Trial-evidence cascade: eligible trials, evidence rows, arm attribution, pair registry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import numeric as N
from ..functions import text as X
from .aggregates import known_rate, mix, support_profile
from .joins import unique_text_match
from .storage import joins_in_buckets, keep

DRUG_TYPES = ("DRUG", "BIOLOGICAL")


def valid_denominator(df: DataFrame) -> DataFrame:
    return df.where("at_risk > 0 AND affected IS NOT NULL AND affected <= at_risk")


def completed_before(df: DataFrame, anchor: str = "anchor") -> DataFrame:
    return df.where(
        (F.col("completion_type") == "ACTUAL") & F.col("completion_date").isNotNull()
        & (F.col("completion_date") <= F.col(anchor)) & (F.coalesce("phase", F.lit("")) != "PHASE4")
    )


def eligible_trials(trials: DataFrame, interventions: DataFrame, ae_rows: DataFrame) -> DataFrame:
    """Trials with a drug or biologic and at least one result row."""
    drugs = interventions.where(F.col("intervention_type").isin(*DRUG_TYPES)).select("nct_id").distinct()
    return trials.join(drugs, "nct_id", "left_semi").join(ae_rows.select("nct_id").distinct(), "nct_id", "left_semi")


def drug_trials(trials: DataFrame, interventions: DataFrame) -> DataFrame:
    """Interventional trials with a drug or biologic."""
    drugs = interventions.where(F.col("intervention_type").isin(*DRUG_TYPES)).select("nct_id").distinct()
    return trials.where("study_type = 'INTERVENTIONAL'").join(drugs, "nct_id", "left_semi")


def entity_trials(links: DataFrame, cohort: DataFrame) -> DataFrame:
    """Distinct entity × trial links, so that event rows are never multiplied."""
    return links.select("entity", "nct_id").distinct().join(cohort, "entity")


def evidence_rows(ae_rows: DataFrame, trials: DataFrame, anchors: DataFrame) -> DataFrame:
    """Clock, event rows and denominator in one pass over the event rows."""
    kept = valid_denominator(ae_rows).join(anchors, "entity").join(
        trials.where("completion_type = 'ACTUAL'"), "nct_id"
    )
    return completed_before(kept)


def attribute_arms(rows: DataFrame, result_groups: DataFrame, design_groups: DataFrame) -> DataFrame:
    """Rows whose result group matches exactly one design arm by title; the arm's own title comes along as ``arm_title``."""
    arms = design_groups.withColumn("arm_title", F.col("title"))
    matched = unique_text_match(result_groups, arms, "nct_id", "rgid", "dgid", "title", ["group_type", "arm_title"]).where("matches = 1")
    return rows.join(matched.drop("matches", "title_norm"), ["nct_id", "rgid"])


def arm_composition(design_groups: DataFrame, bridge: DataFrame, interventions: DataFrame) -> DataFrame:
    """Number of distinct drug interventions and the first names per design arm."""
    drug = F.col("intervention_type").isin(*DRUG_TYPES)
    return (
        design_groups.select("dgid").distinct().join(bridge, "dgid", "left")
        .join(interventions.select("intervention_id", "intervention_name", "intervention_type"), "intervention_id", "left")
        .groupBy("dgid").agg(
            F.countDistinct(F.when(drug, F.col("intervention_id"))).alias("n_drugs"),
            F.array_join(F.array_sort(F.collect_set(F.when(drug, F.col("intervention_name")))), " | ").alias("drug_names"),
        )
    )


def target_monotherapy(rows: DataFrame, composition: DataFrame, bridge: DataFrame, interventions: DataFrame) -> DataFrame:
    """Rows of arms whose only drug is the target entity."""
    single = composition.where("n_drugs = 1").select("dgid")
    target = bridge.join(
        interventions.select("intervention_id", "entity", "intervention_name").distinct(), "intervention_id"
    ).select("dgid", "entity", "intervention_name").distinct()
    return rows.join(single, "dgid", "left_semi").join(target, ["dgid", "entity"])


def treatment_arms(rows: DataFrame, title: str = "arm_title") -> DataFrame:
    return rows.where(
        F.col("group_type").isin("EXPERIMENTAL", "OTHER") & ~X.combination_flag("intervention_name")
        & ~X.has_token("intervention_name", fixed.PLACEBO_INTERVENTION) & ~X.has_token(title, fixed.PLACEBO_TITLE)
    )


def strict_rows(rows: DataFrame, result_groups, design_groups, bridge, interventions) -> DataFrame:
    """The cascade over few of the groups: titles are read for the rows' groups and trials only, names for the arms these match only.

    Rows and groups in buckets of the trial meet there, though groups and titles are joined by further columns too.
    """
    groups = result_groups.join(rows.select("nct_id", "rgid").distinct(), ["nct_id", "rgid"], "left_semi")
    designs = design_groups.join(rows.select("nct_id").distinct(), "nct_id", "left_semi")
    with joins_in_buckets(rows.sparkSession):
        attributed = keep(attribute_arms(rows, groups, designs), "attributed_rows")
    arms = attributed.select("dgid").distinct()
    linked = bridge.join(arms, "dgid", "left_semi").select("dgid", "intervention_id")
    named = keep(linked.join(interventions.select("intervention_id", "entity", "intervention_name", "intervention_type"), "intervention_id"), "arm_drugs")
    links, names = (named.select(*c).distinct() for c in (("dgid", "intervention_id"), ("intervention_id", "entity", "intervention_name", "intervention_type")))
    return treatment_arms(target_monotherapy(attributed, arm_composition(arms, links, names), links, names))


def quality_ceiling(ae_rows, trials, result_groups, design_groups, bridge, interventions) -> DataFrame:
    """The cascade without clock and without cohort: all entities, mapping before denominator."""
    base = ae_rows.join(trials, "nct_id")
    attributed = attribute_arms(base, result_groups, design_groups)
    composition = arm_composition(design_groups, bridge, interventions)
    return treatment_arms(target_monotherapy(valid_denominator(attributed), composition, bridge, interventions))


def pair_registry(rows: DataFrame) -> DataFrame:
    serious = (F.col("event_type") == "serious").cast("int")
    return rows.groupBy("entity", "event").agg(
        F.countDistinct("nct_id").alias("trials"), F.countDistinct("rgid").alias("arms"), F.count(F.lit(1)).alias("ae_rows"),
        F.sum("affected").alias("affected"), F.sum("at_risk").alias("at_risk"),
        F.max(serious).alias("any_serious"), F.sum(serious).alias("serious_rows"),
        F.min("threshold").alias("min_threshold"), F.max("threshold").alias("max_threshold"),
    )


def _definitions_met(anchor: str) -> Column:
    """Names of the definitions that a row meets: three dates of their own over one base without phase 4."""
    by_then = {
        "STRICT_COMPLETION": (F.col("completion_type") == "ACTUAL") & (F.col("completion_date") <= F.col(anchor)),
        "RESULTS_POSTED": F.col("results_posted_date") <= F.col(anchor),
        "WIDE_COMPLETION": F.col("primary_completion_date") <= F.col(anchor),
    }
    met = F.array_compact(F.array(*(F.when(met, F.lit(name)) for name, met in by_then.items())))
    return F.when(F.coalesce("phase", F.lit("")) != "PHASE4", met).otherwise(F.array().cast("array<string>"))


def clock_definitions(rows: DataFrame, anchor: str = "anchor") -> DataFrame:
    """Every row once per definition it meets."""
    return rows.withColumn("definition", F.explode(_definitions_met(anchor)))


def definition_rows(columns: Sequence[str], ae_rows, trials, anchors, result_groups, design_groups, bridge, interventions) -> DataFrame:
    """These columns and the definition of the quality ceiling's rows, once per definition they meet.

    The clocks are read first, so the cascade sees only rows, groups and arms of trials that some definition takes. Rows stand in buckets of
    the trial, as the groups should, and meet them there.
    """
    clocks = trials.select("nct_id", "phase", "completion_type", "completion_date", "results_posted_date", "primary_completion_date")
    dated = valid_denominator(ae_rows).join(clocks, "nct_id").join(anchors, "entity").withColumn("_met", _definitions_met("anchor"))
    rows = keep(dated.where(F.size("_met") > 0).select(*dict.fromkeys(["nct_id", "rgid", "entity", *columns]), "_met"), "definition_base", "nct_id")
    return strict_rows(rows, result_groups, design_groups, bridge, interventions).select(*columns, F.explode("_met").alias("definition"))


def definition_summary(defined: DataFrame, signals: DataFrame, volume: DataFrame, reference: str = "STRICT_COMPLETION") -> DataFrame:
    """Size of each definition, of its part over the entities of ``volume``, overlap with the reference, and signals represented.

    Signals count for the entities that have the definition and the volume; a signal is represented if its pair is among the definition's.
    """
    def sizes(df: DataFrame, prefix: str) -> DataFrame:
        return df.groupBy("definition").agg(
            F.countDistinct("entity").alias(f"{prefix}entities"), F.countDistinct("nct_id").alias(f"{prefix}trials"),
            F.countDistinct("rgid").alias(f"{prefix}arms"), F.countDistinct(F.struct("entity", "event")).alias(f"{prefix}pairs"))

    some = volume.select("entity").distinct()
    links = keep(defined.select("definition", "entity", "nct_id", "rgid", "event").distinct(), "definition_links")  # all that is counted below
    pairs = keep(links.select("definition", "entity", "event").distinct(), "definition_pairs")
    shared = pairs.join(pairs.where(F.col("definition") == reference).drop("definition"), ["entity", "event"], "left_semi")
    seen = represented(pairs, signals, some).groupBy("definition").agg(
        F.count(F.lit(1)).alias("signals"), F.sum("represented").alias("signals_represented"))
    out = sizes(links, "").join(sizes(links.join(some, "entity", "left_semi"), "volume_"), "definition", "left")
    out = out.join(shared.groupBy("definition").agg(F.count(F.lit(1)).alias("shared_pairs")), "definition", "left").join(seen, "definition", "left")
    return out.withColumn("shared_pct", N.pct("shared_pairs", "pairs")).withColumn("coverage_pct", N.pct("signals_represented", "signals"))


def represented(pairs: DataFrame, signals: DataFrame, volume: DataFrame) -> DataFrame:
    """Signals of each definition's entities with volume, and 1 if the definition has the pair, else 0."""
    entities = pairs.select("definition", "entity").distinct().join(volume, "entity", "left_semi")
    hit = pairs.withColumn("_hit", F.lit(1))
    found = signals.select("entity", "event").distinct().join(entities, "entity").join(hit, ["definition", "entity", "event"], "left")
    return found.select("definition", "entity", "event", F.coalesce("_hit", F.lit(0)).alias("represented"))


def added_links(wide: DataFrame, narrow: DataFrame, keys: Sequence[str]) -> DataFrame:
    return wide.select(*keys).subtract(narrow.select(*keys))


def added_link_reasons(added: DataFrame, anchor: str = "anchor") -> DataFrame:
    """One row: added links and trials, and the links by what the final completion date says."""
    done, kind, day = F.col("completion_date"), F.coalesce("completion_type", F.lit("")), F.col(anchor)
    reasons = {
        "actual_by_anchor": (kind == "ACTUAL") & (done <= day), "after_anchor": done > day,
        "not_actual_by_anchor": (kind != "ACTUAL") & (done <= day), "missing_completion": done.isNull(),
    }
    return added.agg(F.count(F.lit(1)).alias("links"), F.countDistinct("nct_id").alias("trials"), *(F.count(F.when(c, 1)).alias(n) for n, c in reasons.items()))


def trial_attributes(trials: DataFrame, ae_rows: DataFrame, matches: DataFrame, conditions: DataFrame) -> DataFrame:
    """Attributes of result-bearing trials and whether any group maps to one arm."""
    mapped = matches.groupBy("nct_id").agg(F.max((F.col("matches") == 1).cast("int")).alias("_m"), F.count(F.lit(1)).alias("groups"))
    rows = ae_rows.groupBy("nct_id").agg(F.count(F.lit(1)).alias("ae_rows"))
    onc = conditions.groupBy("nct_id").agg(F.max(X.word_flag("condition", fixed.ONCOLOGY_WORDS, whole=False).cast("int")).alias("_onc"))
    return (
        trials.join(mapped, "nct_id").join(rows, "nct_id").join(onc, "nct_id", "left")
        .select(
            "nct_id", (F.col("_m") > 0).alias("mapped_any"), F.year("completion_date").alias("study_year"), "phase",
            "enrollment", "n_arms", (F.col("allocation") == "RANDOMIZED").alias("randomized"),
            (F.col("masking").isNotNull() & (F.col("masking") != "NONE")).alias("masked"), "sponsor", "model",
            "ae_rows", "groups", F.coalesce("_onc", F.lit(0)).alias("oncology"),
        )
    )


def arm_exposure(rows: DataFrame, by: Sequence[str] = ("entity",)) -> DataFrame:
    """At-risk persons counted once per arm, then summed."""
    per_arm = rows.groupBy(*by, "nct_id", "rgid").agg(F.max("at_risk").alias("arm_at_risk"))
    return per_arm.groupBy(*by).agg(
        F.countDistinct("nct_id").alias("trials"), F.count(F.lit(1)).alias("arms"),
        F.sum("arm_at_risk").alias("at_risk"), F.max("arm_at_risk").alias("largest_arm"),
    )


def trial_design(trials: DataFrame, designs: DataFrame) -> DataFrame:
    """Design rows collapsed to one row per trial with the lead sponsor class."""
    d = designs.groupBy("nct_id").agg(
        F.max((F.col("allocation") == "RANDOMIZED").cast("int")).alias("randomized"),
        F.max(F.when(F.col("masking").isNotNull(), (F.col("masking") != "NONE").cast("int"))).alias("masked"),
        F.min("model").alias("model"),
        F.max(F.when(F.col("role") == "lead", F.col("sponsor"))).alias("lead_sponsor"),
    )
    return trials.select("nct_id", "phase", "enrollment").join(d, "nct_id", "left")


def programme(links: DataFrame, trials: DataFrame, phases: Sequence[str]) -> DataFrame:
    """Programme profile per entity: rates over known values, phase mix, median enrolment."""
    j = links.select("entity", "nct_id").distinct().join(trials, "nct_id").select(
        "entity", "nct_id", "phase", "enrollment",
        (F.col("allocation") == "RANDOMIZED").alias("randomized"), (F.col("masking") != "NONE").alias("masked"),
        (F.col("sponsor") == "BUILDING").alias("industry"),
    )
    rates = j.groupBy("entity").agg(
        F.count(F.lit(1)).alias("trials"), *known_rate("randomized", "randomized"), *known_rate("masked", "masked"),
        *known_rate("industry", "industry"), F.expr("percentile(enrollment, 0.5)").alias("median_enrollment"),
    )
    return rates.join(mix(j, ["entity"], "phase", list(phases)), "entity")


def elsewhere_evidence(rows: DataFrame, trial_keys: DataFrame, inside: bool) -> DataFrame:
    """Support per pair from trials that do (or do not) belong to the given entity × trial keys."""
    how = "left_semi" if inside else "left_anti"
    kept = rows.join(trial_keys, ["entity", "nct_id"], how)
    good = (F.col("completion_type") == "ACTUAL") & (F.col("completion_date") <= F.col("anchor"))
    return support_profile(kept, ["entity", "event"], "nct_id", "completion_date", good)


def decompose(signals: DataFrame, same: DataFrame, other: DataFrame) -> DataFrame:
    """Exclusive classes in fixed order: same trial, other trial, nowhere, not classifiable."""
    a = same.select("entity", "event", F.col("trials").alias("_ta"), F.col("trial_ids").alias("_ia"))
    b = other.select("entity", "event", F.col("trials").alias("_tb"), F.col("trial_ids").alias("_ib"))
    cls = (
        F.when(F.col("_ta").isNotNull(), "A_SAME_TRIAL_OTHER_ARM").when(F.col("_tb").isNotNull(), "B_OTHER_COMPLETED_TRIAL")
        .when(F.col("event").isNotNull(), "C_NOWHERE_BEFORE_ANCHOR").otherwise("D_UNCLASSIFIABLE")
    )
    return (
        signals.join(a, ["entity", "event"], "left").join(b, ["entity", "event"], "left")
        .withColumn("decomposition", cls).withColumn("support_trials", F.coalesce("_ta", "_tb", F.lit(0)))
        .withColumn("support_ids", F.coalesce("_ia", "_ib")).drop("_ta", "_tb", "_ia", "_ib")
    )


def recount_same_trial(signals: DataFrame, raw_rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Class A again from the raw rows by semi joins only."""
    hits = raw_rows.join(keys, ["entity", "nct_id"], "left_semi").select("entity", "event").distinct()
    found = signals.select("entity", "event").join(hits, ["entity", "event"], "left_semi")
    return found.agg(F.count(F.lit(1)).alias("class_a_pairs"), F.countDistinct("entity").alias("entities"))


def event_type_profile(rows: DataFrame) -> DataFrame:
    kinds = rows.groupBy("entity", "event").agg(
        F.max((F.lower("event_type") == "serious").cast("int")).alias("has_serious"),
        F.max((F.lower("event_type") == "other").cast("int")).alias("has_other"),
    )
    label = (
        F.when((F.col("has_serious") == 1) & (F.col("has_other") == 1), "BOTH")
        .when(F.col("has_serious") == 1, "SERIOUS_ONLY").when(F.col("has_other") == 1, "OTHER_ONLY").otherwise("UNCLASSIFIABLE")
    )
    return kinds.withColumn("profile", label)


def threshold_rows(rows: DataFrame) -> DataFrame:
    """Threshold class counts for all, other and serious rows."""
    scopes = F.array(F.lit("ALL"), F.when(F.col("event_type") == "other", "OTHER").otherwise("SERIOUS"))
    long = rows.select(F.explode(scopes).alias("scope"), X.threshold_class("threshold").alias("category"))
    n = long.groupBy("scope", "category").agg(F.count(F.lit(1)).alias("n"))
    den = n.groupBy("scope").agg(F.sum("n").alias("denominator"))
    return n.join(den, "scope").withColumn("percent", N.pct("n", "denominator"))


def threshold_trials(rows: DataFrame) -> DataFrame:
    """A trial has a class only when all its known non-serious thresholds agree."""
    cls = F.when(F.col("event_type") == "other", X.threshold_class("threshold", missing=None))
    per_trial = rows.groupBy("nct_id").agg(F.countDistinct(cls).alias("_k"), F.min(cls).alias("_one"))
    cat = F.when(F.col("_k") == 0, "MISSING").when(F.col("_k") == 1, F.col("_one")).otherwise("MIXED_THRESHOLDS")
    return per_trial.groupBy(cat.alias("category")).agg(F.count(F.lit(1)).alias("trials"))
