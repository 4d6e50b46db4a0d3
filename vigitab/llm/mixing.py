"""Mixing sources to target weights by hierarchical budgeting over a domain-language-source tree.

A token budget is split level by level in proportion to integer weights. A child gets no more than its subtree can supply; what it
cannot use goes to its siblings first, and only a subtree that is used up passes budget to its parent's siblings. Each leaf then takes
whole seeded epochs and, of the next epoch, a token-prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, documents, join_groups, stored, whole_text

#: Hex digits of the order key that make a bucket: a leaf is dealt into 16 to this power.
BUCKET_DIGITS = 3
NONE = "(none)"


def weight_of(level: str, weights: dict[str, int]) -> Column:
    """The node's weight, 1 where none is given."""
    found = F.lit(1)
    for value, weight in weights.items():
        found = F.when(F.col(level) == value, weight).otherwise(found)
    return found.cast("long")


def split_budget(nodes: DataFrame, parents: list[str], key: str, budget: str, out: str) -> DataFrame:
    """Give each child (weight, supply) its part of its parent's `budget` as `out`, in whole tokens.

    Children stand by supply over weight. A child is filled if its supply is within its share of what the children before it have left;
    the others share the rest by weight. The products stay below 2^63 up to 10^14 tokens and weights that add up to 9 * 10^4.
    """
    siblings = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    before = siblings.orderBy((F.col("supply") / F.col("weight")).asc(), key).rowsBetween(Window.unboundedPreceding, -1)
    run = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    full = F.col("supply") * (F.sum("weight").over(siblings) - run("weight")) <= F.col("weight") * (F.col(budget) - run("supply"))
    cut = nodes.withColumn("full", full)
    left = lambda c: F.sum(F.when(F.col("full"), F.col(c)).otherwise(0)).over(siblings)
    cut = cut.withColumns({"room": F.col(budget) - left("supply"), "share": F.sum("weight").over(siblings) - left("weight")})
    part = F.when(F.col("full"), F.col("supply")).otherwise(F.expr("(weight * room) div nullif(share, 0)"))
    return cut.withColumn(out, part).drop("full", "room", "share")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], budget: int) -> DataFrame:
    """Add `leaf_budget` to one row per leaf (levels, supply)."""
    table, above = leaves, F.lit(budget).cast("long")
    for k, level in enumerate(levels):
        at = levels[: k + 1]
        nodes = table.groupBy(*at).agg(F.sum("supply").alias("supply"), F.first("above").alias("above")) if k else table.groupBy(*at).agg(F.sum("supply").alias("supply")).withColumn("above", above)
        nodes = split_budget(nodes.withColumn("weight", weight_of(level, weights.get(level, {}))), levels[:k], level, "above", "granted")
        table = table.drop("above").join(nodes.select(*at, F.col("granted").alias("above")), at)
    return table.withColumnRenamed("above", "leaf_budget")


def order_key(seed: int, epoch: Column, doc_id: str) -> Column:
    """The key by which a leaf's rows stand in an epoch."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.col(doc_id).cast("string")))


def mix(
    docs: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, int]], percent: int, max_epochs: int = 1, seed: int = 0,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Return doc_id, the levels, tokens, leaf_budget and copies (in how many epochs the row is taken, 0 for none) for every row.

    The budget is `percent` hundredths of all tokens (words); a leaf supplies at most `max_epochs` times its tokens. In an epoch a leaf's
    rows stand by md5(seed|epoch|doc_id), then doc_id, then tokens, and the prefix ends with the last row that does not exceed the budget.
    A null level value is a node of its own, "(none)"; a null or empty text has no tokens and joins at no cost where it stands in the
    prefix. Rows with equal id and tokens tie and are taken in any order. An empty table gives an empty result.
    """
    names = list(levels)
    rows = stored(docs.select(
        F.col(doc_id).alias("doc_id"), *(F.coalesce(c.cast("string"), F.lit(NONE)).alias(n) for n, c in levels.items()),
        F.regexp_count(whole_text(text), F.lit(WORD)).cast("long").alias("tokens"),
    ).withColumn("leaf", F.to_json(F.array(*names))), "mix_rows")
    leaves = stored(rows.groupBy("leaf", *names).agg(F.sum("tokens").alias("leaf_tokens"), F.count(F.lit(1)).alias("leaf_rows")), "mix_leaves")
    tokens, total = leaves.agg(F.coalesce(F.sum("leaf_tokens"), F.lit(0)), F.coalesce(F.sum("leaf_rows"), F.lit(0))).first()
    plan = leaf_budgets(leaves.withColumn("supply", F.col("leaf_tokens") * max_epochs), names, weights, tokens * percent // 100)
    epochs = F.coalesce(F.expr("leaf_budget div nullif(leaf_tokens, 0)"), F.lit(0))
    plan = plan.select("leaf", "leaf_rows", "leaf_budget", epochs.alias("epochs"), (F.col("leaf_budget") - epochs * F.col("leaf_tokens")).alias("rest"))
    keyed = join_groups(rows, stored(plan, "mix_plan"), "leaf", total, "leaf_rows").withColumn("order_key", order_key(seed, F.col("epochs"), "doc_id"))
    keyed = keyed.withColumn("bucket", F.substring("order_key", 1, BUCKET_DIGITS))
    bucket = Window.partitionBy("leaf").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("leaf", "bucket").agg(F.sum("tokens").alias("bucket_tokens")).select(
        "leaf", "bucket", F.coalesce(F.sum("bucket_tokens").over(bucket), F.lit(0)).alias("start"))
    inside = Window.partitionBy("leaf", "bucket").orderBy("order_key", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    ended = keyed.withColumn("inside", F.sum("tokens").over(inside)).join(starts, ["leaf", "bucket"])
    taken = ((F.col("start") + F.col("inside")) <= F.col("rest")) & (F.col("rest") > 0) & (F.col("epochs") < max_epochs)
    return ended.select("doc_id", *names, "tokens", "leaf_budget", (F.col("epochs") + taken.cast("long")).alias("copies"))


def source_tree() -> dict[str, Column]:
    """Domain, language and source of a document; the domain is read off the source's number, five sources to a domain."""
    number = F.expr("try_cast(substring(source, 4) AS INT)")
    domain = F.when(number < 5, "web").when(number < 10, "forum").when(number < 15, "reference").otherwise("books")
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


TREE_WEIGHTS = {"domain": {"web": 4, "forum": 1, "reference": 3, "books": 2}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {}}
PERCENT, MAX_EPOCHS, SEED = 60, 2, 11


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir), source_tree(), TREE_WEIGHTS, PERCENT, MAX_EPOCHS, SEED)


def _fill(name: str, nodes: str, parent: str, key: str) -> str:
    """SQL for one level: children of `nodes` (parent columns, key, weight, supply, above) with `granted`."""
    over = f"PARTITION BY {parent}" if parent else "PARTITION BY 0"
    before = f"({over} ORDER BY supply / weight, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
{name}_a AS (SELECT *, supply * (sum(weight) OVER ({over}) - coalesce(sum(weight) OVER {before}, 0))
    <= weight * (above - coalesce(sum(supply) OVER {before}, 0)) AS filled FROM ({nodes})),
{name} AS (SELECT *, CASE WHEN filled THEN supply ELSE
    (weight * (above - sum(CASE WHEN filled THEN supply ELSE 0 END) OVER ({over})))
    // nullif(sum(weight) OVER ({over}) - sum(CASE WHEN filled THEN weight ELSE 0 END) OVER ({over}), 0) END AS granted FROM {name}_a)"""


def _weights(level: str) -> str:
    cases = " ".join(f"WHEN {level} = '{v}' THEN {w}" for v, w in TREE_WEIGHTS[level].items())
    return f"(CASE {cases} ELSE 1 END)" if cases else "1"


OP9_SQL = rf"""
WITH r0 AS (
  SELECT doc_id, coalesce(lang, '{NONE}') AS lang, coalesce(source, '{NONE}') AS source, try_cast(substring(source, 4) AS INT) AS k,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::HUGEINT AS tokens FROM documents
), r AS (
  SELECT *, CASE WHEN k < 5 THEN 'web' WHEN k < 10 THEN 'forum' WHEN k < 15 THEN 'reference' ELSE 'books' END AS domain FROM r0
), leaf AS (
  SELECT domain, lang, source, sum(tokens) AS leaf_tokens, sum(tokens) * {MAX_EPOCHS} AS supply FROM r GROUP BY ALL
), {_fill("d", f"SELECT domain, {_weights('domain')} AS weight, sum(supply) AS supply, (SELECT sum(tokens) FROM r) * {PERCENT} // 100 AS above FROM leaf GROUP BY domain", "", "domain")},
{_fill("l", f"SELECT leaf.domain, leaf.lang, {_weights("lang")} AS weight, sum(leaf.supply) AS supply, any_value(d.granted) AS above FROM leaf JOIN d USING (domain) GROUP BY leaf.domain, leaf.lang", "domain", "lang")},
{_fill("s", f"SELECT leaf.domain, leaf.lang, leaf.source, 1 AS weight, leaf.supply AS supply, leaf.leaf_tokens, l.granted AS above FROM leaf JOIN l USING (domain, lang)", "domain, lang", "source")},
p AS (
  SELECT domain, lang, source, granted, coalesce(granted // nullif(leaf_tokens, 0), 0) AS epochs,
    granted - coalesce(granted // nullif(leaf_tokens, 0), 0) * leaf_tokens AS rest FROM s
), o AS (
  SELECT r.doc_id, domain, lang, source, r.tokens, p.granted, p.epochs, p.rest, md5('{SEED}|' || p.epochs || '|' || r.doc_id) AS key
  FROM r JOIN p USING (domain, lang, source)
), c AS (
  SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id, tokens ROWS UNBOUNDED PRECEDING) AS upto FROM o
)
SELECT doc_id, domain, lang, source, tokens::BIGINT AS tokens, granted::BIGINT AS leaf_budget,
  (epochs + CASE WHEN upto <= rest AND rest > 0 AND epochs < {MAX_EPOCHS} THEN 1 ELSE 0 END)::BIGINT AS copies FROM c
"""
