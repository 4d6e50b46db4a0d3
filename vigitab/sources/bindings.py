"""Views over the bundled test tables that stand in for the domain inputs."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import joins as J
from ..operators.storage import keep

#: Stages written so far, by application, data folder and name: base joins, edges and labels are made once and then read by every query.
STAGES: dict[tuple[str, str, str], DataFrame] = {}


def staged(view: Callable[[Tables], DataFrame], by: str | None = None) -> cached_property:
    """A view that is written to the shared folder when it is first asked for."""

    def get(t: Tables) -> DataFrame:
        key = (t.spark.sparkContext.applicationId, t.path, view.__name__)
        if key not in STAGES:
            STAGES[key] = keep(view(t), view.__name__, by)
        return STAGES[key]

    return cached_property(get)


def staged_by(column: str) -> Callable[[Callable[[Tables], DataFrame]], cached_property]:
    """Like staged, in buckets of the order's key under that name: the distinct rows of the cascade and of the cells are found there."""
    return partial(staged, by=column)


class Tables:
    """Views over a data folder; staged ones are written on first use, the others are lazy."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @staged_by("orderkey")
    def ordered_items(self) -> DataFrame:
        """Line items with the part's names and, where there is one, the order: numbered and joined in one exchange by order key."""
        part = self.table("part").select(
            F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"),
            X.safe_long(F.split_part("p_brand", F.lit("#"), F.lit(2))).alias("bn"),
        )
        rows = self.table("lineitem").join(part, "l_partkey").select(
            F.col("l_orderkey").alias("orderkey"),
            F.col("l_linenumber").alias("linenumber"), F.col("l_suppkey").alias("suppkey"),
            "brand", "name", "bn", F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"),
            F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("rflag"),
            F.col("l_linestatus").alias("lstatus"),
        ).withColumn("row_no", F.row_number().over(Window.partitionBy("orderkey").orderBy(
            "linenumber", "suppkey", "brand", "name", "qty", "price", "disc", "tax", "rflag", "lstatus")))
        orders = self.table("orders").groupBy(F.col("o_orderkey").alias("orderkey")).agg(F.collect_list(F.struct(
            F.col("o_custkey").alias("custkey"),
            F.col("o_orderstatus").alias("ostatus"), F.to_date("o_orderdate").alias("odate"),
            F.col("o_orderpriority").alias("oprio"), F.col("o_totalprice").alias("total"),
        )).alias("orders"))
        return rows.join(orders, "orderkey", "left")

    @cached_property
    def items(self) -> DataFrame:
        """Line items with the part's names; enough for everything that needs no order column."""
        return self.ordered_items.drop("orders")

    @cached_property
    def base(self) -> DataFrame:
        """Line items with their order, one row for each order of the key."""
        return self.ordered_items.select("*", F.inline("orders")).drop("orders")

    # --- reports ---------------------------------------------------------

    @cached_property
    def report(self) -> DataFrame:
        role = F.when(F.col("rflag") == "R", "PS").when(F.col("rflag") == "A", "SS").otherwise("C")
        return self.base.select(
            F.col("orderkey").alias("caseid"), F.col("orderkey").alias("primaryid"), "custkey",
            F.col("odate").alias("report_date"), F.date_format("odate", "yyyyMMdd").cast("int").alias("fda_dt"),
            role.alias("role"), F.col("brand").alias("entity"), F.col("name").alias("event"),
        )

    @staged_by("caseid")
    def cases(self) -> DataFrame:
        """One row per case with a report."""
        return self.report.select("caseid", "report_date").distinct()

    @staged_by("caseid")
    def exposures(self) -> DataFrame:
        return self.report.where("role = 'PS'").select("caseid", "report_date", "entity").distinct()

    @staged_by("caseid")
    def case_event(self) -> DataFrame:
        return self.report.select("caseid", "report_date", "event").distinct()

    @cached_property
    def db1(self) -> DataFrame:
        return self.report.where("custkey % 2 = 0")

    @cached_property
    def db2(self) -> DataFrame:
        return self.report.where("custkey % 2 <> 0")

    @cached_property
    def versioned_report(self) -> DataFrame:
        version = F.when((F.col("custkey") % 7 == 0) | (F.col("ostatus") == "P"), F.lit(None).cast("long")).otherwise(
            1 + F.col("orderkey") % 3
        )
        role = F.when(F.col("rflag") == "R", "PS").when(F.col("rflag") == "A", "SS").otherwise("C")
        return self.base.select(
            F.col("custkey").alias("caseid"), F.col("orderkey").alias("primaryid"), version.alias("caseversion"),
            F.date_format("odate", "yyyyMMdd").cast("int").alias("fda_dt"), role.alias("role"),
            self._raw_drug().alias("drugname"), self._raw_term().alias("term"), F.col("ostatus").alias("status"),
        )

    @staticmethod
    def _raw_drug():
        k = F.col("linenumber") % 3
        return (
            F.when(k == 0, F.concat(F.col("brand"), F.lit(" tablet 20 mg"))).when(k == 1, F.upper("brand"))
            .otherwise(F.concat(F.col("brand"), F.lit(" sodium")))
        )

    @staticmethod
    def _raw_term():
        k = F.col("linenumber") % 4
        return (
            F.when(k == 0, F.col("name")).when(k == 1, F.upper("name")).when(k == 2, F.replace("name", F.lit(" "), F.lit("-")))
            .otherwise(F.concat(F.col("name"), F.lit("s")))
        )

    # --- terminology -----------------------------------------------------

    @staged
    def preferred(self) -> DataFrame:
        return self.table("part").groupBy(F.col("p_name").alias("term")).agg(
            (F.min("p_partkey") + 10000000).alias("code")
        )

    @cached_property
    def lower_level(self) -> DataFrame:
        """Plural terms; every code divisible by 7 also lends its plural to a second code."""
        plural = self.preferred.select(F.concat("term", F.lit("s")).alias("term"), F.col("code").alias("parent"))
        extra = self.preferred.where("code % 7 = 0").select(
            F.concat("term", F.lit("s")).alias("term"), (F.col("code") + 500000).alias("parent")
        )
        return plural.unionByName(extra)

    @cached_property
    def history(self) -> DataFrame:
        """Retired codes: a third current, a third a current child term, a third gone."""
        k = F.col("code") % 3
        return self.preferred.select(
            F.concat(F.lit("old "), F.col("term")).alias("term"), (F.col("code") + 20000000).alias("old_code"),
            F.when(k == 0, F.col("code")).when(k == 1, F.col("code") + 30000000).otherwise(F.lit(-1).cast("long")).alias("target"),
        )

    @cached_property
    def child_codes(self) -> DataFrame:
        return self.preferred.select((F.col("code") + 30000000).alias("code"), F.col("code").alias("parent"))

    @cached_property
    def hierarchy(self) -> DataFrame:
        """Branches of every code; every fifth code has two branches, every tenth has two primaries."""
        top, mid = F.split_part("term", F.lit(" "), F.lit(2)), F.split_part("term", F.lit(" "), F.lit(1))
        main = self.preferred.select("code", mid.alias("middle"), top.alias("top"), F.lit("Y").alias("primary_flag"))
        second = self.preferred.where("code % 5 = 0").select(
            "code", mid.alias("middle"), F.lit("other").alias("top"),
            F.when(F.col("code") % 10 == 0, "Y").otherwise("N").alias("primary_flag"),
        )
        return main.unionByName(second)

    @cached_property
    def event_group(self) -> DataFrame:
        return self.preferred.select(
            F.col("term").alias("event"), F.split_part("term", F.lit(" "), F.lit(2)).alias("top_group"),
            F.split_part("term", F.lit(" "), F.lit(1)).alias("middle_group"),
        )

    # --- cohort and identity ---------------------------------------------

    @staged
    def approval(self) -> DataFrame:
        part = self.table("part").select(
            F.col("p_brand").alias("entity"), X.safe_long(F.split_part("p_brand", F.lit("#"), F.lit(2))).alias("bn")
        ).distinct()
        anchor = F.date_add(F.lit("1996-01-01").cast("date"), (F.col("bn") * 30).cast("int"))
        return part.select(
            "entity", "bn", anchor.alias("anchor"), F.year(anchor).alias("approval_year"),
            F.when(F.col("bn") % 3 == 0, "BLA").otherwise("NDA").alias("kind"),
            F.when(F.col("bn") % 5 == 0, "Yes (orphan)").when(F.col("bn") % 5 == 1, F.lit(None)).otherwise("No").alias("orphan"),
            F.when(F.col("bn") % 4 == 0, "N/A").when(F.col("bn") % 4 == 1, "Yes").otherwise("No").alias("breakthrough"),
            F.when(F.col("bn") % 6 == 0, "true").otherwise("No").alias("accelerated"),
            F.when(F.col("bn") % 7 == 0, "Yes").when(F.col("bn") % 7 == 1, "?").otherwise("No").alias("fast_track"),
            F.when(F.col("bn") % 2 == 0, "Priority Review").otherwise("Standard").alias("priority"),
            F.when(F.col("bn") % 4 == 0, "ORAL").when(F.col("bn") % 4 == 1, "INTRAVENOUS | ORAL")
            .when(F.col("bn") % 4 == 2, "SUBCUTANEOUS").otherwise(F.lit(None)).alias("route"),
            F.when(F.col("bn") % 3 == 0, "TABLET").when(F.col("bn") % 3 == 1, "SOLUTION").otherwise("AEROSOL").alias("form"),
        )

    @cached_property
    def approval_row(self) -> DataFrame:
        """Approval source rows, one per part: several per identity."""
        k = F.col("p_partkey") % 4
        name = (
            F.when(k == 0, F.col("p_brand")).when(k == 1, F.upper("p_brand"))
            .when(k == 2, F.concat(F.lit("  "), F.col("p_brand"), F.lit(" "))).otherwise(F.col("p_brand"))
        )
        serial = (F.lit(33000) + F.col("p_partkey") % 3000).cast("int")
        day = F.date_add(F.lit("1899-12-30").cast("date"), serial)
        written = (
            F.when(k == 0, serial.cast("string")).when(k == 1, F.date_format(day, "M/d/yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd"))
        )
        return self.table("part").select(
            F.col("p_partkey").alias("source_row"), name.alias("active"), F.col("p_type").alias("trade"),
            written.alias("approval_text"), (F.year(day) + F.when(F.col("p_partkey") % 50 == 0, 1).otherwise(0)).alias("stated_year"),
            F.when(F.col("p_size") % 9 == 0, "Transition product").otherwise(F.lit("")).alias("notes"),
            F.concat(F.lit("A"), F.col("p_size").cast("string")).alias("application"),
        )

    @cached_property
    def alias_row(self) -> DataFrame:
        """Drug rows of the second database with five name columns."""
        k = F.col("linenumber") % 5
        return self.items.select(
            F.col("orderkey").alias("id"), F.col("linenumber").alias("seq"),
            F.when(F.col("rflag") == "R", "PS").otherwise("C").alias("role"),
            F.when(k != 0, F.col("brand")).alias("name1"), F.when(k == 1, F.upper("brand")).alias("name2"),
            F.when(k == 2, F.concat(F.col("brand"), F.lit(" sodium"))).alias("name3"), F.lit("").alias("name4"),
            F.when(F.col("suppkey") % 13 == 0, F.lit("Brand#1")).alias("name5"),
        )

    # --- trial registry ---------------------------------------------------

    @cached_property
    def trial(self) -> DataFrame:
        o = self.table("orders").join(
            self.table("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("sponsor")), "o_custkey"
        )
        kind = F.when(F.col("o_orderstatus") == "F", "ACTUAL").when(F.col("o_orderstatus") == "O", "ESTIMATED")
        prio = F.substring("o_orderpriority", 1, 1)
        phase = (
            F.when(prio == "1", "PHASE1").when(prio == "2", "PHASE2").when(prio == "3", "PHASE3").when(prio == "5", "PHASE4")
        )
        k = F.col("o_orderkey")
        return o.select(
            k.alias("nct_id"), F.to_date("o_orderdate").alias("completion_date"), kind.alias("completion_type"),
            phase.alias("phase"), F.floor(F.col("o_totalprice") / 1000).alias("enrollment"), "sponsor",
            F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, "NON_RANDOMIZED").otherwise("RANDOMIZED").alias("allocation"),
            F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, "NONE").otherwise("DOUBLE").alias("masking"),
            F.when(k % 3 == 0, "PARALLEL").when(k % 3 == 1, "CROSSOVER").otherwise("SINGLE_GROUP").alias("model"),
            (k % 6 + 1).alias("n_arms"),
            F.when(k % 6 != 0, F.date_add(F.to_date("o_orderdate"), (k % 700).cast("int"))).alias("results_posted_date"),
            F.when(k % 11 != 0, F.date_sub(F.to_date("o_orderdate"), (k % 90).cast("int"))).alias("primary_completion_date"),
            F.when(k % 7 == 0, "OBSERVATIONAL").otherwise("INTERVENTIONAL").alias("study_type"),
        )

    @cached_property
    def ae_row(self) -> DataFrame:
        return self.items.select(
            F.col("orderkey").alias("nct_id"), (F.col("orderkey") * 10000 + F.col("linenumber") * 100 + F.col("bn")).alias("rgid"), "row_no",
            F.col("brand").alias("entity"), F.col("name").alias("event"), F.col("qty").alias("affected"),
            F.floor(F.col("price") / 1000).cast("double").alias("at_risk"),
            F.when(F.col("lstatus") == "F", "serious").otherwise("other").alias("event_type"),
            F.when(F.col("disc") == 0.1, F.lit(None)).otherwise(F.round(F.col("tax") * 100)).alias("threshold"),
            F.concat(F.lit("Arm "), F.col("brand"), F.lit(" #"), F.col("linenumber").cast("string")).alias("title"),
        )

    @staged_by("nct_id")
    def result_group(self) -> DataFrame:
        return self.ae_row.select("nct_id", "rgid", "title").distinct()

    @staged_by("nct_id")
    def design_group(self) -> DataFrame:
        rows = self.items.where("suppkey % 4 <> 0").select(
            F.col("orderkey").alias("nct_id"), F.col("suppkey").alias("suppkey"),
            (F.col("orderkey") * 10 + F.col("linenumber")).alias("_arm"),
            F.concat(F.lit("ARM: "), F.upper("brand"), F.lit(" / "), F.col("linenumber").cast("string")).alias("title"),
            F.when(F.col("rflag") == "A", "EXPERIMENTAL").when(F.col("rflag") == "R", "OTHER").otherwise("PLACEBO_COMPARATOR").alias("group_type"),
        )
        copies = F.when(F.col("suppkey") % 11 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        return rows.withColumn("_c", F.explode(copies)).select(
            "nct_id", (F.col("_arm") * 2 + F.col("_c")).alias("dgid"), "title", "group_type"
        ).distinct()

    @staged_by("nct_id")
    def intervention(self) -> DataFrame:
        return self.items.select(
            (F.col("orderkey") * 100 + F.col("bn")).alias("intervention_id"), F.col("orderkey").alias("nct_id"),
            F.when(F.col("orderkey") % 17 == 0, F.concat(F.col("brand"), F.lit(" + saline"))).otherwise(F.col("brand")).alias("intervention_name"),
            F.when(F.col("bn") % 8 == 7, "DEVICE").otherwise("DRUG").alias("intervention_type"), F.col("brand").alias("entity"),
        ).distinct()

    @staged
    def arm_bridge(self) -> DataFrame:
        return self.items.select(
            ((F.col("orderkey") * 10 + F.col("linenumber")) * 2).alias("dgid"),
            (F.col("orderkey") * 100 + F.col("bn")).alias("intervention_id"),
        ).distinct()

    @cached_property
    def trial_anchor(self) -> DataFrame:
        return self.approval.select("entity", "approval_year", F.date_add("anchor", 730).alias("anchor"))

    # --- predictions, features, contributions -----------------------------

    @staged
    def pred(self) -> DataFrame:
        """Two nested scores in two decimals, so ties occur."""
        hexed = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long")
        p0 = (hexed % 10000 + 0.5) / 10000
        j = self.table("labels").join(self.table("documents").select("doc_id", "source", "lang"), "doc_id")
        y = F.col("quality").cast("int")
        out = j.select("doc_id", F.col("source").alias("cluster"), "lang", y.alias("y"), p0.alias("_p"), F.col("toxic").cast("int").alias("y2"))
        mixed = 0.7 * F.col("_p") + 0.3 * (0.2 + 0.6 * F.col("y"))
        return out.withColumn("p0", F.round("_p", 2)).withColumn("p1", F.round(mixed, 2)).drop("_p").select(
            "doc_id", "cluster", "lang", "y", "y2",
            F.least(F.greatest(F.col("p0"), F.lit(0.01)), F.lit(0.99)).alias("p0"),
            F.least(F.greatest(F.col("p1"), F.lit(0.01)), F.lit(0.99)).alias("p1"),
        )

    @cached_property
    def feat(self) -> DataFrame:
        return self.table("embeddings").select(
            "vec_id", "embedding", F.when(F.col("label") < 3, 1).otherwise(0).alias("y"),
            (F.col("vec_id") % 20).alias("grp"), F.concat(F.lit("L"), (F.col("vec_id") % 37).cast("string")).alias("level"),
        )

    @cached_property
    def contrib(self) -> DataFrame:
        long = self.feat.select("vec_id", "grp", "y", F.posexplode("embedding").alias("k", "v"))
        v = F.col("v").cast("double")
        return long.select(
            "vec_id", "grp", "y", "k", F.floor(F.col("k") / 8).alias("parent"), F.floor(F.col("k") / 16).alias("domain"),
            v.alias("raw"), (v * (F.col("k") % 5 - 2)).alias("contribution"),
        )

    # --- composed stages --------------------------------------------------

    @staged_by("nct_id")
    def evidence(self) -> DataFrame:
        from ..operators import evidence as C

        return C.evidence_rows(self.ae_row, self.trial, self.trial_anchor)

    @staged_by("nct_id")
    def final_rows(self) -> DataFrame:
        from ..operators import evidence as C

        return C.strict_rows(
            self.evidence, self.result_group, self.design_group, self.arm_bridge, self.intervention
        )

    @staged
    def candidates(self) -> DataFrame:
        """Distinct pairs of the final evidence."""
        return self.final_rows.select("entity", "event").distinct()

    @staged
    def labels_h(self) -> DataFrame:
        """2x2 labels of candidate pairs at three horizons."""
        from ..operators import signals as S

        pairs = S.anchored_pairs(self.candidates, self.approval.select("entity", "anchor", "approval_year"))
        return S.anchored_signals(pairs, self.cases, self.exposures, self.case_event)

    @staged
    def labels3(self) -> DataFrame:
        from ..operators import signals as S

        pairs = S.anchored_pairs(self.candidates, self.approval.select("entity", "anchor", "approval_year"), [3])
        return S.anchored_signals(pairs, self.cases, self.exposures, self.case_event)

    @staged
    def signals3(self) -> DataFrame:
        """All exposed pairs with at least three joint cases, classed by earlier presence."""
        from ..operators import signals as S

        sig = S.all_exposed_signals(
            self.approval.select("entity", "anchor", "approval_year"), self.cases, self.exposures, self.case_event
        )
        return J.classify_presence(sig, self.candidates, ["entity", "event"], "coverage_class", "OBSERVED_BEFORE", "ONLY_AFTER")
