"""Coverage summaries, cluster bootstrap from hash draws, outcome-balanced grouped folds."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as X
from .keys import join_same
from .prefix import hierarchical_totals, position, unit_levels
from .storage import keep


def hash_index(n: Column, *parts: Column) -> Column:
    """Number in [0, n) from the first eight hex digits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long") % n


def indexed_clusters(clusters: DataFrame, cluster: str, by: Sequence[str] = ()) -> DataFrame:
    """Dense 0-based index per cluster in md5 order (an even order, so no task gets a long run)."""
    h = F.md5(F.col(cluster).cast("string"))
    out = position(clusters.withColumn("_h", h), list(by), [(F.substring(F.col("_h"), 1, 3), False), (F.col("_h"), False)], "_p")
    return out.withColumn("idx", F.col("_p") - 1).drop("_p", "_h")


def draw_weights(clusters: DataFrame, cluster: str, reps: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, rep, cluster, w): how often each replicate draws each cluster, n draws with replacement.

    Draw j of replicate r picks index hash(seed|r|j) mod n, so two engines and two
    runs agree and paired comparisons share their draws.
    """
    by = list(by)
    idx = keep(indexed_clusters(clusters.select(*by, cluster).distinct(), cluster, by))
    keyed = idx if by else idx.withColumn("_g", F.lit(0))
    kk = by or ["_g"]
    sizes = keyed.groupBy(*kk).agg(F.count(F.lit(1)).alias("_n"))
    draws = (
        sizes.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reps - 1).cast("long"))))
        .repartition(*kk, "rep")  # one size row becomes many replicates: spread them before drawing
        .withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
        .withColumn("idx", hash_index(F.col("_n"), F.lit(seed), F.col("rep"), F.col("_j")))
        .groupBy(*kk, "rep", "idx").agg(F.count(F.lit(1)).alias("w"))
    )
    return join_same(draws, keyed, [*kk, "idx"]).select(*by, "rep", cluster, "w")


def bootstrap_ratio(df: DataFrame, cluster: str, num: str, den: str, reps: int = 5000, seed: int = 20260700, by: Sequence[str] = ()) -> DataFrame:
    """Replicates of the ratio of sums (micro) and the mean of ratios (macro) over whole clusters."""
    by = list(by)
    sums = keep(df.groupBy(*by, cluster).agg(F.sum(num).cast("double").alias("_num"), F.sum(den).cast("double").alias("_den")), "cluster_sums")
    w = draw_weights(sums, cluster, reps, seed, by)
    j = join_same(w, sums, [*by, cluster])
    own = N.ratio("_num", "_den")
    return j.groupBy(*by, "rep").agg(
        F.try_divide(F.sum(F.col("w") * F.col("_num")), F.sum(F.col("w") * F.col("_den"))).alias("micro"),
        F.try_divide(F.sum(F.when(F.col("_den") > 0, F.col("w") * own)), F.sum(F.when(F.col("_den") > 0, F.col("w").cast("double")))).alias("macro"),
    )


def ci_table(boot: DataFrame, by: Sequence[str], measures: Sequence[str], scale: float = 1.0) -> DataFrame:
    """95 % percentile limits with valid and failed replicate counts, long form."""
    arr = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in measures])
    long = boot.select(*by, F.explode(arr).alias("_m")).select(*by, "_m.*")
    return long.groupBy(*by, "measure").agg(
        (F.expr("percentile(value, 0.025)") * scale).alias("low"), (F.expr("percentile(value, 0.975)") * scale).alias("high"),
        F.count("value").alias("valid"), (F.count(F.lit(1)) - F.count("value")).alias("failed"),
    )


def entity_coverage(signals: DataFrame, entities: DataFrame, observed: Column) -> DataFrame:
    """Coverage per entity, entities without signals included."""
    g = signals.groupBy("entity").agg(F.count(F.lit(1)).alias("signals"), F.count(F.when(observed, 1)).alias("observed"))
    out = entities.join(g, "entity", "left")
    for c in ("signals", "observed"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0)))
    cov = N.ratio("observed", "signals")
    return out.withColumn("coverage", cov).withColumn("only_after", F.col("signals") - F.col("observed")).withColumn(
        "coverage_bin", X.coverage_bin("coverage")
    )


def coverage_summary(cov: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    aggs = [
        F.count(F.lit(1)).alias("entities"), F.count("coverage").alias("with_signals"), F.sum("signals").alias("signals"),
        F.sum("observed").alias("observed"), N.pct(F.sum("observed"), F.sum("signals")).alias("micro_pct"),
        (100 * F.avg("coverage")).alias("macro_pct"),
        *[(100 * F.expr(f"percentile(coverage, {q})")).alias(n) for n, q in (("p25_pct", 0.25), ("median_pct", 0.5), ("p75_pct", 0.75))],
        (100 * F.min("coverage")).alias("min_pct"), (100 * F.max("coverage")).alias("max_pct"),
    ]
    return cov.groupBy(*by).agg(*aggs) if by else cov.agg(*aggs)


def _with_ci(main: DataFrame, boot: DataFrame, by: Sequence[str]) -> DataFrame:
    ci = boot.groupBy(*by).agg(
        (100 * F.expr("percentile(micro, 0.025)")).alias("low_pct"), (100 * F.expr("percentile(micro, 0.975)")).alias("high_pct")
    )
    return join_same(main, ci, by)


def group_coverage(signals: DataFrame, entities: DataFrame, group: str, observed: Column, reps: int, seed: int, major: int = 30) -> DataFrame:
    """Coverage per event group over the same cluster universe, with limits and a size flag."""
    cells = signals.groupBy(group, "entity").agg(F.count(F.lit(1)).alias("signals"), F.count(F.when(observed, 1)).alias("observed"))
    main = cells.groupBy(group).agg(
        F.count(F.lit(1)).alias("entities"), F.sum("signals").alias("signals"), F.sum("observed").alias("observed"),
        (100 * F.avg(N.ratio("observed", "signals"))).alias("macro_pct"),
    ).withColumn("micro_pct", N.pct("observed", "signals")).withColumn("major", F.col("signals") >= major)
    # clusters without signals of a group still take part in its draws, with zero sums
    w = draw_weights(entities, "entity", reps, seed)
    boot = w.join(cells, "entity").groupBy(group, "rep").agg(
        F.try_divide(F.sum(F.col("w") * F.col("observed")).cast("double"), F.sum(F.col("w") * F.col("signals")).cast("double")).alias("micro")
    )
    return _with_ci(main, boot, [group])


def cluster_rates(rows: DataFrame, clusters: DataFrame, cluster: str, by: Sequence[str], num: str, den: str, reps: int, seed: int) -> DataFrame:
    """Rate of sums per group with limits from whole clusters; every cluster of the list is drawn, with or without rows."""
    cells = keep(rows.groupBy(*by, cluster).agg(F.sum(num).alias("_num"), F.sum(den).alias("_den")), "rate_cells")
    main = cells.groupBy(*by).agg(F.sum("_num").alias("n"), F.sum("_den").alias("denominator")).withColumn("percent", N.pct("n", "denominator"))
    boot = draw_weights(clusters, cluster, reps, seed).join(cells, cluster).groupBy(*by, "rep").agg(
        F.try_divide(F.sum(F.col("w") * F.col("_num")).cast("double"), F.sum(F.col("w") * F.col("_den")).cast("double")).alias("micro"))
    return _with_ci(main, boot, by)


def strata_coverage(cov: DataFrame, dims: Sequence[str], reps: int, seed: int, small: int = 10) -> DataFrame:
    """Coverage by entity strata; resampling stays inside the stratum."""
    arr = F.array(*[F.struct(F.lit(d).alias("stratum"), F.coalesce(F.col(d).cast("string"), F.lit("MISSING")).alias("level")) for d in dims])
    long = cov.withColumn("_s", F.explode(arr)).select("entity", "signals", "observed", "coverage", "_s.stratum", "_s.level")
    main = coverage_summary(long, ["stratum", "level"]).select(
        "stratum", "level", "entities", "with_signals", "signals", "observed", "micro_pct", "macro_pct"
    ).withColumn("small", F.col("entities") < small)
    boot = bootstrap_ratio(long, "entity", "observed", "signals", reps, seed, ["stratum", "level"])
    return _with_ci(main, boot, ["stratum", "level"])


def coverage_distribution(cov: DataFrame) -> DataFrame:
    """Entities per coverage bin; empty bins stay with zero."""
    bins = [F.struct(F.lit(b).alias("coverage_bin"), (F.col("coverage_bin") == b).cast("long").alias("hit")) for b in X.COVERAGE_BINS]
    long = cov.select(F.explode(F.array(*bins)).alias("_b")).select("_b.*")
    return long.groupBy("coverage_bin").agg(F.sum("hit").alias("entities"), F.count(F.lit(1)).alias("_n")).withColumn(
        "percent", N.pct("entities", "_n")
    ).drop("_n")


# --- folds ---------------------------------------------------------------

def grouped_folds(df: DataFrame, group: str, y: str, k: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """One fold per group, dealt in snake order by positives, size and hash."""
    by = list(by)
    g = df.groupBy(*by, group).agg(F.count(F.lit(1)).alias("rows"), F.sum(y).alias("positives"))
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(group).cast("string")))
    g = g.withColumn("_h", h)
    levels = [(F.col("positives"), True), (F.col("rows"), True), (F.substring("_h", 1, 3), False), (F.col("_h"), False)]
    p = position(g, by, levels, "_pos").withColumn("_r", F.col("_pos") - 1)
    turn, slot = F.floor(F.col("_r") / k), F.col("_r") % k
    fold = F.when(turn % 2 == 0, slot).otherwise(k - 1 - slot)
    return p.withColumn("fold", fold).drop("_h", "_pos", "_r")


def fold_balance(folds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return folds.groupBy(*by, "fold").agg(
        F.count(F.lit(1)).alias("groups"), F.sum("rows").alias("rows"), F.sum("positives").alias("positives")
    ).withColumn("prevalence_pct", N.pct("positives", "rows")).withColumn("both_classes", (F.col("positives") > 0) & (F.col("positives") < F.col("rows")))


def nested_folds(df: DataFrame, folds: DataFrame, group: str, y: str, inner: int, seed: int, outer: int) -> DataFrame:
    """Inner folds inside every outer training part (all rows but the outer fold)."""
    placed = df.join(folds.select(group, "fold"), group)
    train = placed.withColumn("outer_fold", F.explode(F.array(*[F.lit(i) for i in range(outer)]))).where("outer_fold <> fold").drop("fold")
    return grouped_folds(train, group, y, inner, seed, ["outer_fold"])


# --- bootstrap of metrics -------------------------------------------------

def drawn_scores(df: DataFrame, by: Sequence[str], cluster: str, y: str, p: str, reps: int, seed: int) -> DataFrame:
    """(by, rep, cluster, p, y, w): what each replicate draws, w counting draws times rows.

    Equal rows of a cluster are counted before they meet the draws, so this grows with the distinct scores of the clusters, not with the rows.
    """
    counted = df.groupBy(*by, cluster, p, y).agg(F.count(F.lit(1)).alias("_n"))
    drawn = counted.join(draw_weights(df.select(cluster), cluster, reps, seed), cluster)
    return drawn.withColumn("w", F.col("w") * F.col("_n")).drop("_n")


#: Replicates of a vector, and (cluster, score) rows of a score band, so that a task holds about BLOCK * BAND_ROWS draws.
BLOCK, BAND_ROWS = 500, 4000
_MEASURES = ["average_precision", "auroc", "brier", "log_loss"]


def weight_vectors(clusters: DataFrame, cluster: str, reps: int, seed: int) -> DataFrame:
    """(cluster, block, draws): how often each of a block's replicates draws the cluster, as unsigned 32-bit integers side by side."""
    drawn = draw_weights(clusters, cluster, reps, seed).withColumn("block", (F.col("rep") / BLOCK).cast("int"))
    lists = drawn.groupBy(cluster, "block").agg(F.collect_list(F.struct("rep", "w")).alias("_l"))  # at most BLOCK entries

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own in batch.column("_l").to_pylist():
                v = np.zeros(BLOCK, dtype="<u4")
                v[[d["rep"] % BLOCK for d in own]] = [d["w"] for d in own]
                out.append(v.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(cluster), batch.column("block"), pa.array(out, pa.binary())], [cluster, "block", "draws"])

    return lists.mapInArrow(pack, f"`{cluster}` {dict(clusters.dtypes)[cluster]}, block int, draws binary")


def _vectors(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a band's rows: scores, highest first, weighted positives and negatives of each score, a column per replicate, and what each score counts."""
    p = rows.column("_p").to_numpy()
    order = np.argsort(-p, kind="stable")
    draws = np.stack([np.frombuffer(v.as_py(), dtype="<u4") for v in rows.column("draws")])[order].astype(float)
    scores, first = np.unique(-p[order], return_index=True)
    pos, neg = (np.add.reduceat(draws * rows.column(c).to_numpy()[order][:, None], first, axis=0) for c in ("_pos", "_neg"))
    return -scores, pos, neg, draws


def bootstrap_metrics(df: DataFrame, by: Sequence[str], cluster: str, y: str, p: str, reps: int, seed: int) -> DataFrame:
    """AP, AUROC, Brier and log loss per replicate; all ``by`` groups share their draws.

    Rows are summed per (cluster, score) first, and what multiplies them is a vector of draws, one for a block of replicates, never a row
    for each replicate. Scores stand in bands; a band's totals give the others their running starts, and each band then adds its part of
    every replicate's area. Replicates that draw no row of a group are left out of it.
    """
    by = list(by)
    types = dict(df.dtypes)
    ties = df.groupBy(*by, cluster, F.col(p).cast("double").alias("_p")).agg(F.sum(F.col(y).cast("double")).alias("_pos"), F.sum(1.0 - F.col(y)).alias("_neg"))
    ties = keep(ties.where("_p is not null"), "score_ties")
    bands = 1 + ties.count() // BAND_ROWS
    cuts = ties.groupBy(*by).agg(F.percentile_approx("_p", [k / bands for k in range(1, bands)] or [1.0], max(1000, 10 * bands)).alias("_cuts"))
    banded = join_same(ties, cuts, by) if by else ties.join(cuts)
    banded = banded.withColumn("band", F.size(F.filter("_cuts", lambda c: c > F.col("_p")))).drop("_cuts")
    joined = keep(banded.join(weight_vectors(df.select(cluster), cluster, reps, seed), cluster), "score_draws")
    keys = [*by, "block", "band"]
    joined = joined.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    head = ", ".join([*(f"`{c}` {types[c]}" for c in by), "block int, band int"])
    names = [*by, "block", "band"]

    def row(key: tuple, found: pa.Table, columns: list[str], values: list[np.ndarray]) -> pa.Table:
        own = [found.column(c).slice(0, 1) for c in names]
        return pa.Table.from_arrays([*own, *(pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in values)], names=[*names, *columns])

    def totals(key, found):
        _, pos, neg, _ = _vectors(found)
        return row(key, found, ["pos", "neg"], [pos.sum(axis=0), neg.sum(axis=0)])

    def starts(key, found):
        """Sums of the bands with higher scores, and of all, for every band of a block."""
        order = np.argsort(found.column("band").to_numpy(), kind="stable")
        found = found.take(pa.array(order))
        out = [found.column(c) for c in names]
        for c in ("pos", "neg"):
            v = np.stack([np.frombuffer(x.as_py()) for x in found.column(c)])
            upto = np.cumsum(v, axis=0)
            out.append(pa.array([(u - w).tobytes() for u, w in zip(upto, v)], pa.binary()))
            out.append(pa.array([upto[-1].tobytes()] * len(v), pa.binary()))
        return pa.Table.from_arrays(out, names=[*names, "pos", "all_pos", "neg", "all_neg"])

    def areas(key, found, before):
        scores, pos, neg, _ = _vectors(found)
        p0, n0, n_all = (np.frombuffer(before.column(c)[0].as_py()) for c in ("pos", "neg", "all_neg"))
        cp, cn = p0 + np.cumsum(pos, axis=0), n0 + np.cumsum(neg, axis=0)
        precision = np.divide(cp, cp + cn, out=np.zeros_like(cp), where=cp + cn > 0)
        clipped = np.clip(scores, N.fixed.PRED_CLIP, 1 - N.fixed.PRED_CLIP)[:, None]
        s = scores[:, None]
        parts = [precision * pos, pos * (n_all - cn + 0.5 * neg), pos * (1 - s) ** 2 + neg * s**2, -(pos * np.log(clipped) + neg * np.log(1 - clipped))]
        return row(key, found, _MEASURES, [v.sum(axis=0) for v in parts])

    def finish(key, found):
        """A row per replicate of a block."""
        sums = {c: sum(np.frombuffer(x.as_py()) for x in found.column(c)) for c in _MEASURES}
        tp, tn = (np.frombuffer(found.column(c)[0].as_py()) for c in ("all_pos", "all_neg"))
        at = np.flatnonzero(tp + tn > 0)
        below = {"average_precision": tp, "auroc": tp * tn, "brier": tp + tn, "log_loss": tp + tn}
        columns = [pa.array(sums[c][at] / np.where(below[c][at] > 0, below[c][at], 1), mask=below[c][at] <= 0) for c in _MEASURES]
        own = [pa.chunked_array([found.column(c).slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(at), dtype=np.int64)))]) for c in by]
        rep = found.column("block")[0].as_py() * BLOCK + at.astype(np.int64)
        return pa.Table.from_arrays([*own, pa.array(rep), *columns], names=[*by, "rep", *_MEASURES])

    sums = joined.groupBy(*keys).applyInArrow(lambda key, found: totals(key, found), f"{head}, pos binary, neg binary")
    begun = keep(sums.groupBy(*by, "block").applyInArrow(lambda key, found: starts(key, found), f"{head}, pos binary, all_pos binary, neg binary, all_neg binary"), "band_starts")
    both = joined.groupBy(*keys).cogroup(begun.groupBy(*keys))
    part = both.applyInArrow(lambda key, found, before: areas(key, found, before), f"{head}, " + ", ".join(f"{m} binary" for m in _MEASURES))
    whole = join_same(part, begun.select(*keys, "all_pos", "all_neg"), keys)
    return whole.groupBy(*by, "block").applyInArrow(lambda key, found: finish(key, found), ", ".join([*(f"`{c}` {types[c]}" for c in by), "rep long", *(f"{m} double" for m in _MEASURES)]))


def ranking_from_ties(ties: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    """Average precision (step sum) and AUROC (half credit for ties) from tie-group sums."""
    by = list(by)
    keyed = ties if by else ties.withColumn("_g", F.lit(0))
    kk = by or ["_g"]
    run = hierarchical_totals(keyed, kk, unit_levels(score), ["pos", "neg"])
    totals = keyed.groupBy(*kk).agg(F.sum("pos").alias("_tp"), F.sum("neg").alias("_tn"))
    precision = F.coalesce(F.try_divide(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")), F.lit(0.0))
    below = F.col("_tn") - F.col("cum_neg") + 0.5 * F.col("neg")
    out = join_same(run, totals, kk).groupBy(*kk).agg(
        F.try_divide(F.sum(precision * F.col("pos")), F.max("_tp")).alias("average_precision"),
        F.try_divide(F.sum(F.col("pos") * below), F.max("_tp") * F.max("_tn")).alias("auroc"),
    )
    return out.select(*by, "average_precision", "auroc")
