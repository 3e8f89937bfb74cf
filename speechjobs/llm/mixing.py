"""Mixing sources to target weights by hierarchical budgeting, with DataFrame operations only.

Sources are the leaves of a domain - language - source tree. The token budget goes down the tree in proportion to the
weights of a node's children. A child that cannot take its share (its tokens times `max_epochs`) takes what it has,
and its shortage goes to its siblings; what a whole subtree cannot take was bounded by the subtree's own capacity one
level up, so it goes to the siblings of the ancestor. Each leaf then takes whole epochs and, of one more epoch in a
seeded order, the prefix of documents that fills its budget; the last one is taken in part.

A leaf's order is dealt into buckets of its hash; sums per bucket find the one where the prefix ends, and only the
rows of that bucket are sorted, so a source with a third of all rows is never in one task.

Defined results: null text has no tokens and is never taken; null domain parts are named `unknown`; equal rows count
one by one, and those with one id and one size in no fixed order; null ids order as the empty string; very long texts count
whole; an empty table gives an empty result; other columns are carried along untouched in keep_mixed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, ensure_checkpoint_dir, row_of

SHARE, MAX_EPOCHS, SEED = 0.6, 4, 17
PARTS = 1_000_000
LANGUAGE_WEIGHTS = {"de": 0.2, "en": 0.4, "es": 0.2, "fr": 0.2}
BROADCAST_LEAVES = 50_000
BUCKET_ROWS = 2_000
LEAF = ["domain", "lang", "source"]


def hashed_domain(source: Column, n: int = 4) -> Column:
    return F.concat(F.lit("domain"), F.pmod(F.conv(F.substring(F.md5(source.cast("binary")), 1, 4), 16, 10).cast("int"), F.lit(n)).cast("string"))


def _weight(name: str, weights: dict[str, float]) -> Column:
    if any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be above 0")
    whole = F.lit(PARTS).cast("long")
    if not weights:
        return whole
    return F.coalesce(F.create_map(*(F.lit(x) for k, w in weights.items() for x in (k, round(w * PARTS))))[F.col(name)].cast("long"), whole)


def share_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds `grant`: the parent's `budget` in proportion to `weight`, nobody above `cap`, shortages to siblings."""
    by = Window.partitionBy(*(parent or [F.lit(0)])).orderBy(F.col("cap") / F.col("weight"), name)
    used = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weights = F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    leveled = nodes.withColumn("_level", (F.col("budget") - used).cast("double") / weights.cast("double"))
    level = F.max("_level").over(Window.partitionBy(*(parent or [F.lit(0)])))
    return leveled.withColumn("_level", level).withColumn("grant", F.least("cap", F.floor(F.col("weight").cast("double") * F.col("_level")))).drop("_level")


def leaf_budgets(leaves: DataFrame, budget: int, max_epochs: int, weights: dict[str, dict[str, float]]) -> DataFrame:
    """domain, lang, source, tokens, rows, grant from leaves with tokens and rows."""
    level = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    granted = None
    for depth, name in enumerate(LEAF):
        nodes = level.groupBy(*LEAF[: depth + 1]).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(name, weights.get(name, {})))
        nodes = nodes.withColumn("budget", F.lit(budget).cast("long")) if granted is None else nodes.join(granted, LEAF[:depth])
        granted = share_out(nodes, LEAF[:depth], name).select(*LEAF[: depth + 1], F.col("grant").alias("budget"))
    return leaves.join(granted.withColumnRenamed("budget", "grant"), LEAF)


def _order(seed: int) -> Column:
    """A fraction in [0, 1) from 52 bits of a hash of seed, epoch and id."""
    text = F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mix(docs: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, domain: Callable[[Column], Column] = hashed_domain, weights: dict[str, dict[str, float]] | None = None, carry: bool = True) -> DataFrame:
    """A row for each document and epoch taken: doc_id, domain, lang, source, epoch, n_tokens, taken, and the input row as _row.

    Tokens are counted once, into a table of one small row a document; without `carry` the texts are not read again.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    named = lambda c: F.coalesce(docs[c].cast("string"), F.lit("unknown"))
    n_tokens = F.coalesce(F.regexp_count(docs["text"].cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    small_row = [docs["doc_id"], domain(named("source")).alias("domain"), named("lang").alias("lang"), named("source").alias("source"), n_tokens.alias("n_tokens")]
    sizes = docs.select(*small_row).where("n_tokens > 0").checkpoint()
    rows = docs.select(row_of(docs).alias("_row"), *small_row).where("n_tokens > 0") if carry else sizes
    leaves = sizes.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")).checkpoint()
    total, n_leaves = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    plan = leaf_budgets(leaves, int(share * total), max_epochs, weights or {"lang": LANGUAGE_WEIGHTS}).where("grant > 0")
    plan = plan.withColumn("epochs", F.floor(F.col("grant") / F.col("tokens"))).withColumn("rest", F.col("grant") - F.col("epochs") * F.col("tokens")).withColumn("buckets", F.ceil(F.col("rows") / F.lit(BUCKET_ROWS)).cast("long")).drop("tokens", "rows", "grant").checkpoint()
    small = F.broadcast if n_leaves <= BROADCAST_LEAVES else (lambda df: df)
    bucket = F.floor(_order(seed) * F.col("buckets"))

    ends = sizes.join(small(plan.where("rest > 0")), LEAF).withColumn("epoch", F.col("epochs")).withColumn("bucket", bucket)
    ends = ends.groupBy(*LEAF, "rest", "bucket").agg(F.sum("n_tokens").alias("sum"))
    before = F.coalesce(F.sum("sum").over(Window.partitionBy(*LEAF).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.withColumn("before", before).where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("sum") >= F.col("rest"))).select(*LEAF, F.col("bucket").alias("last"), "before")
    plan = plan.join(ends, LEAF, "left").checkpoint()

    taken = rows.join(small(plan), LEAF).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs"))))
    whole = taken.where("epoch < epochs").withColumn("taken", F.col("n_tokens"))
    prefix = taken.where("epoch = epochs and last is not null").withColumn("_u", _order(seed)).withColumn("bucket", F.floor(F.col("_u") * F.col("buckets")))
    inside = prefix.where("bucket < last").withColumn("taken", F.col("n_tokens"))
    running = F.coalesce(F.sum("n_tokens").over(Window.partitionBy(*LEAF).orderBy("_u", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = prefix.where("bucket = last").withColumn("_left", F.col("rest") - F.col("before") - running).where("_left > 0").withColumn("taken", F.least("n_tokens", "_left"))
    out = [*["_row"] * carry, "doc_id", *LEAF, "epoch", "n_tokens", "taken"]
    return whole.select(*out).unionByName(inside.select(*out)).unionByName(edge.select(*out))


def keep_mixed(docs: DataFrame, **how) -> DataFrame:
    """The input rows that are taken, with all their columns, once per epoch; the last of a leaf stays whole."""
    return mix(docs, **how).select("_row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir), carry=False).select("doc_id", "domain", "lang", "source", "epoch", "n_tokens", "taken")


def _sql_level(depth: int, weight: str) -> str:
    keys, parent, name = ", ".join(LEAF[: depth + 1]), ", ".join(LEAF[:depth]), LEAF[depth]
    over = f"PARTITION BY {parent} " if parent else ""
    source = f"(SELECT {keys}, sum(cap)::BIGINT AS cap FROM leaves GROUP BY ALL) n" + (f" JOIN g{depth - 1} USING ({parent})" if parent else "")
    budget = "budget" if parent else "(SELECT CAST(floor({share} * coalesce(sum(tokens), 0)) AS BIGINT) FROM leaves)"
    return f"""n{depth} AS (SELECT {keys}, cap, {budget} AS budget, ({weight})::BIGINT AS weight FROM {source}),
l{depth} AS (SELECT *, (budget - coalesce(sum(cap) OVER ({over}ORDER BY cap / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT::DOUBLE
  / (sum(weight) OVER ({over}ORDER BY cap / weight, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT::DOUBLE AS level FROM n{depth}),
g{depth} AS (SELECT {keys}, least(cap, CAST(floor(weight::DOUBLE * max(level) OVER ({over.strip()})) AS BIGINT)) AS budget FROM l{depth})"""


OP2_SQL = f"""
WITH r AS (SELECT doc_id, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source, 'domain' || (('0x' || substr(md5(coalesce(source, 'unknown')), 1, 4))::INT % 4) AS domain,
  len(regexp_extract_all(text, '{WORD}')) AS n_tokens FROM documents),
rows_ AS (SELECT * FROM r WHERE n_tokens > 0),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::BIGINT * {MAX_EPOCHS} AS cap FROM rows_ GROUP BY ALL),
{_sql_level(0, str(PARTS)).replace("{share}", str(SHARE))},
{_sql_level(1, "CASE lang " + " ".join(f"WHEN '{k}' THEN {round(w * PARTS)}" for k, w in LANGUAGE_WEIGHTS.items()) + f" ELSE {PARTS} END")},
{_sql_level(2, str(PARTS))},
p AS (SELECT domain, lang, source, budget // tokens AS epochs, budget % tokens AS rest FROM g2 JOIN leaves USING (domain, lang, source) WHERE budget > 0),
e AS (SELECT *, unnest(range(0, epochs + 1)) AS epoch FROM rows_ JOIN p USING (domain, lang, source)),
u AS (SELECT *, ('0x' || substr(md5('{SEED}:' || epoch || ':' || doc_id), 1, 13))::BIGINT AS u FROM e),
s AS (SELECT *, CASE WHEN epoch < epochs THEN n_tokens ELSE rest - coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY u, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS room FROM u)
SELECT doc_id, domain, lang, source, epoch, n_tokens, least(n_tokens, room)::BIGINT AS taken FROM s WHERE room > 0
"""
