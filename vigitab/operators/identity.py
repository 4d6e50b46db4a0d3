"""Identity resolution of names against a regulatory cohort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X
from .aggregates import distinct_list, limited_list, unique_in_order
from .joins import unpivot_names
from .keys import join_same


def regulatory_cohort(rows: DataFrame, cutoff: str, years: int = 3) -> DataFrame:
    """One row per identity: first dated record, flags over all records, exclusion."""
    r = rows.withColumn("active", X.clean_text("active")).withColumn("identity", X.identity_key("active")).withColumn(
        "approval_date", X.parse_mixed_date("approval_text")
    )
    first = F.struct("approval_date", "source_row")
    g = r.groupBy("identity").agg(
        F.min_by("active", first).alias("entity"), F.min("approval_date").alias("first_approval"),
        F.count(F.lit(1)).alias("source_records"), F.min_by("trade", first).alias("first_trade"),
        F.countDistinct("application").alias("applications"),
        F.bool_or(X.multi_active("active")).alias("multi_active"),
        F.bool_or(X.word_flag("notes", fixed.ADMIN_NOTES, whole=False)).alias("administrative"),
    )
    trades = unique_in_order(r, ["identity"], ["approval_date", "source_row"], "trade", "trades")
    g = join_same(g, trades, ["identity"], "left").withColumn("trades", F.coalesce("trades", F.lit("")))
    done = X.followup_complete("first_approval", years, F.lit(cutoff).cast("date"))
    return g.withColumn("approval_year", F.year("first_approval")).withColumn("followup_complete", done).withColumn(
        "salt_review", X.word_flag("entity", fixed.SALT_REVIEW_WORDS)
    ).withColumn("excluded", F.col("multi_active"))


def cohort_windows(cohort: DataFrame, starts: Sequence[int], end: int) -> DataFrame:
    placed = cohort.where(F.col("approval_year") <= end).withColumn(
        "start", F.explode(F.filter(F.array(*[F.lit(s) for s in starts]), lambda s: s <= F.col("approval_year")))
    )
    return placed.groupBy("start").agg(
        F.count(F.lit(1)).alias("entities"), F.count(F.when(~F.col("excluded"), 1)).alias("eligible"),
        F.count(F.when(F.col("excluded"), 1)).alias("excluded"),
        F.count(F.when(~F.col("excluded") & F.col("followup_complete"), 1)).alias("complete_followup"),
    )


def repeated_identities(rows: DataFrame) -> DataFrame:
    key = X.identity_key("active")
    return rows.groupBy(key.alias("identity")).agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct("trade").alias("trades")
    ).where("records > 1")


def build_name_index(names: DataFrame) -> DataFrame:
    """(form, key) → candidate entities; ``names`` holds entity, kind (ACTIVE/BRAND) and raw name."""
    folded = names.select("entity", "kind", X.fold_names("raw").alias("raw"))
    exact = folded.select(F.lit("EXACT").alias("form"), X.name_key("raw").alias("key"), "entity", "kind")
    base = folded.select(F.lit("BASE").alias("form"), X.base_key("raw").alias("key"), "entity", "kind")
    return exact.unionByName(base).where("key <> ''").groupBy("form", "key").agg(
        F.array_sort(F.collect_set("entity")).alias("entities"), F.array_sort(F.collect_set("kind")).alias("kinds")
    )


def resolve_names(catalog: DataFrame, index: DataFrame, split_lists: bool = False, bridge: DataFrame | None = None) -> DataFrame:
    """Raw name → entity. Unique exact key is HIGH, unique base key MEDIUM; any conflict stays ambiguous.

    All variants of a raw name vote at once in one aggregation; nothing is collected.
    """
    names = catalog.select(F.trim("raw").alias("raw")).where("raw <> ''").distinct()
    var = F.array(F.col("raw"))
    if split_lists:
        parts = X.split_list("raw", "[,;]")
        var = F.when(F.regexp_like("raw", F.lit("[,;]")), F.concat(var, parts)).otherwise(var)
    v = names.select("raw", F.explode(var).alias("variant")).distinct().withColumn("_f", X.fold_names("variant"))
    v = v.withColumn("_e", X.name_key("_f")).withColumn("_b", X.base_key("_f"))
    ex = index.where("form = 'EXACT'").select(F.col("key").alias("_e"), F.col("entities").alias("_ee"), F.col("kinds").alias("_ek"))
    ba = index.where("form = 'BASE'").select(F.col("key").alias("_b"), F.col("entities").alias("_be"))
    j = v.join(ex, "_e", "left").join(ba, "_b", "left")
    exact = F.size("_ee") == 1
    base = F.col("_ee").isNull() & (F.size("_be") == 1)
    kind = (
        F.when(F.size("_ek") == 2, "EXACT_ACTIVE_AND_BRAND").when(F.element_at("_ek", 1) == "ACTIVE", "EXACT_ACTIVE")
        .otherwise("EXACT_BRAND")
    )
    method = F.when(exact, kind).when(base, "UNIQUE_BASE")
    method = F.when(F.col("variant") != F.col("raw"), F.concat(F.lit("LIST_"), method)).otherwise(method)
    hit = F.when(exact, F.element_at("_ee", 1)).when(base, F.element_at("_be", 1))
    conf = F.when(exact, "HIGH").when(base, "MEDIUM")
    clash = F.when(F.size("_ee") > 1, F.col("_ee")).when(F.col("_ee").isNull() & (F.size("_be") > 1), F.col("_be"))
    best = F.struct((conf != "HIGH").alias("o"), method.alias("m"), conf.alias("c"))
    g = j.groupBy("raw").agg(
        F.collect_set(hit).alias("_hits"), F.array_distinct(F.flatten(F.collect_set(clash))).alias("_amb"),
        F.min(F.when(hit.isNotNull(), best)).alias("_best"),
    )
    every = F.array_union("_hits", "_amb")
    single = (F.size("_hits") == 1) & (F.size(F.array_except("_amb", "_hits")) == 0)
    out = g.select(
        "raw", F.when(single, F.element_at("_hits", 1)).alias("entity"), F.when(single, F.col("_best.m")).alias("method"),
        F.when(single, F.col("_best.c")).alias("confidence"), F.array_sort(every).alias("candidates"),
        F.when(single, "MAPPED").when(F.size(every) > 1, "AMBIGUOUS").otherwise("UNRESOLVED").alias("status"),
    )
    if bridge is None:
        return out
    b = bridge.select(F.col("key").alias("_e"), F.col("entities").alias("_x"))
    out = out.withColumn("_e", X.name_key(X.fold_names("raw"))).join(b, "_e", "left")
    open_, one = F.col("status") == "UNRESOLVED", F.size("_x") == 1
    return out.select(
        "raw", F.when(open_ & one, F.element_at("_x", 1)).otherwise(F.col("entity")).alias("entity"),
        F.when(open_ & one, "SYNONYM_BRIDGE").otherwise(F.col("method")).alias("method"),
        F.when(open_ & one, "MEDIUM").otherwise(F.col("confidence")).alias("confidence"),
        F.when(open_, F.coalesce("_x", "candidates")).otherwise(F.col("candidates")).alias("candidates"),
        F.when(open_ & one, "MAPPED").when(open_ & (F.size("_x") > 1), "AMBIGUOUS").otherwise(F.col("status")).alias("status"),
    )


def link_records(records: DataFrame, aliases: DataFrame, name_map: DataFrame) -> DataFrame:
    """Record → entity through its primary and other names; kept only with one entity."""
    names = records.select("record_id", F.col("name").alias("raw")).unionAll(aliases.select("record_id", F.col("name").alias("raw")))
    hits = names.distinct().join(name_map.select("raw", "entity", "confidence").where("entity IS NOT NULL"), "raw")
    return hits.groupBy("record_id").agg(
        F.countDistinct("entity").alias("_n"), F.min("entity").alias("entity"), F.min("confidence").alias("confidence"),
        distinct_list("raw").alias("matched_names"),
    ).where("_n = 1").drop("_n")


def bridge_index(links: DataFrame, aliases: DataFrame) -> DataFrame:
    """Alias key → entities over linked records; shared aliases show several entities."""
    rows = aliases.join(links.select("record_id", "entity"), "record_id")
    return rows.select(X.name_key(X.fold_names("name")).alias("key"), "entity").where("key <> ''").groupBy("key").agg(
        F.array_sort(F.collect_set("entity")).alias("entities")
    )


def name_catalog(rows: DataFrame, ident: str, columns: Sequence[str], role: str = "PS") -> DataFrame:
    """Raw names over several columns with distinct-case weights, all roles and one role."""
    long = unpivot_names(rows, [ident, "role"], columns).where(X.non_blank("name"))
    return long.groupBy(F.col("name").alias("raw")).agg(
        F.countDistinct(ident).alias("cases"), F.countDistinct(F.when(F.col("role") == role, F.col(ident))).alias("role_cases")
    )


def source_summary(name_map: DataFrame, weights: DataFrame, tag: str) -> DataFrame:
    """Top name, synonyms, methods and confidence per entity for one source."""
    m = name_map.where("status = 'MAPPED'").join(weights, "raw")
    main = m.groupBy("entity").agg(
        F.min_by("raw", F.struct(-F.col("weight"), F.col("raw"))).alias(f"{tag}_name"), distinct_list("method").alias(f"{tag}_methods"),
        F.when(F.bool_and(F.col("confidence") == "HIGH"), "HIGH").otherwise("MEDIUM").alias(f"{tag}_confidence"),
    )
    return main.join(limited_list(m, ["entity"], "raw", f"{tag}_synonyms", None), "entity")


def identity_master(cohort: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """One row per entity with every source's evidence, the mapping status and the review flag."""
    out = cohort
    for tag, s in sources.items():
        out = out.join(s, "entity", "left").withColumn(f"{tag}_confidence", F.coalesce(f"{tag}_confidence", F.lit("UNRESOLVED")))
    tags = list(sources)
    have = {k: F.col(f"{k}_confidence") != "UNRESOLVED" for k in tags}
    n = sum((h.cast("int") for h in have.values()), F.lit(0))
    status = (
        F.when(F.col("excluded"), "EXCLUDED").when(n == len(tags), "MAPPED_ALL")
        .when(have[tags[0]] & have[tags[1]], "MAPPED_FIRST_TWO").when(n > 0, "PARTIAL").otherwise("UNRESOLVED")
    )
    medium = sum(((F.col(f"{k}_confidence") == "MEDIUM").cast("int") for k in tags), F.lit(0)) > 0
    review = ~F.col("excluded") & ((n < len(tags)) | medium | (F.col("kind") == "BLA"))
    return out.withColumn("mapping_status", status).withColumn("review", review)


def identity_review(master: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Rows to review with their reasons."""
    missing = F.array_compact(F.array(*[F.when(F.col(f"{k}_confidence") == "UNRESOLVED", F.lit(k)) for k in tags]))
    medium = sum(((F.col(f"{k}_confidence") == "MEDIUM").cast("int") for k in tags), F.lit(0)) > 0
    reasons = F.array_compact(F.array(
        F.when(F.size(missing) > 0, F.concat(F.lit("no evidence in "), F.array_join(missing, ", "))),
        F.when(F.col("kind") == "BLA", F.lit("biologic naming variant")),
        F.when(medium, F.lit("medium-confidence link")),
    ))
    return master.where("review").select(
        "entity", "mapping_status", F.array_join(missing, "|").alias("missing_sources"), F.array_join(reasons, "; ").alias("reasons")
    )


def ambiguous_registry(maps: dict[str, DataFrame]) -> DataFrame:
    out = None
    for tag, m in maps.items():
        part = m.where("status = 'AMBIGUOUS'").select(
            F.lit(tag).alias("source"), "raw", F.size("candidates").cast("long").alias("candidate_count"),
            F.array_join("candidates", " | ").alias("candidates"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def mapping_coverage(master: DataFrame, tags: Sequence[str], starts: Sequence[int], end: int) -> DataFrame:
    placed = master.where(~F.col("excluded") & (F.col("approval_year") <= end)).withColumn(
        "start", F.explode(F.filter(F.array(*[F.lit(s) for s in starts]), lambda s: s <= F.col("approval_year")))
    )
    have = {k: F.col(f"{k}_confidence") != "UNRESOLVED" for k in tags}
    every = F.lit(True)
    for h in have.values():
        every = every & h
    return placed.groupBy("start").agg(
        F.count(F.lit(1)).alias("entities"), *[F.count(F.when(h, 1)).alias(f"mapped_{k}") for k, h in have.items()],
        F.count(F.when(every, 1)).alias("mapped_all"), F.count(F.when(F.col("review"), 1)).alias("review"),
    )


def consensus_entity(rows: DataFrame, ids: Sequence[str], columns: Sequence[str], name_map: DataFrame) -> DataFrame:
    """A row counts only when all of its mapped name columns agree on one entity."""
    long = unpivot_names(rows, ids, columns).where(X.non_blank("name")).distinct()
    hits = long.join(name_map.where("entity IS NOT NULL").select(F.col("raw").alias("name"), "entity"), "name")
    return hits.groupBy(*ids).agg(
        F.countDistinct("entity").alias("_n"), F.min("entity").alias("entity"), F.countDistinct("field").alias("agreeing_fields")
    ).where("_n = 1").drop("_n")
