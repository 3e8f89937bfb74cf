"""Document fingerprints by consistent weighted sampling, with DataFrame operations only.

The weight of a word is how often it occurs. For each of K samples a word's hash gives r and c, drawn from Gamma(2, 1),
and b, uniform on [0, 1). With t = floor(ln(weight) / r + b), the word with the least

    ln(a) = ln(c) - r * (t - b) - r

is the sample, known by (word, t). Two texts agree in a sample with a probability that is their generalised Jaccard
similarity: sum of the smaller over sum of the larger weights.

Each text is paired with its edited form and shuffled once; words are counted, sampled and reduced to K numbers in
the partition of their document. Words that cannot have the least ln(a) are told by a bound without logarithms; texts
for which the bound was too low, which is seen in their results, are done again without it. The order of ids comes from a range partitioning, with one small row per range.

Defined results: null text is empty text; texts without words share one fingerprint; rows equal in id and text are
one document, whose result is repeated; rows with one id stand in the order of their texts' hashes; null ids come last;
with one document it is its own next; very long texts are read whole; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, documents, ensure_checkpoint_dir, shuffle_parts, text_of

SAMPLES, REACH = 64, 16.0
PART_CHARS, PART_ROWS = 3_000_000, 10_000
BROADCAST_ROWS = 100_000
LAST = (1 << 63) - 1
KEY = ["doc_id", "text_hash"]


def neighbours(ids: DataFrame) -> DataFrame:
    """ids (doc_id, text_hash, ...) with next_id, next_hash in ascending order, the first after the last."""
    ranged = ids.repartitionByRange(shuffle_parts(ids.sparkSession), *KEY).withColumn("_range", F.spark_partition_id()).checkpoint()
    here = F.struct(*KEY)
    firsts = ranged.groupBy("_range").agg(F.min(here).alias("_first"))
    whole = Window.partitionBy(F.lit(0)).orderBy("_range")  # a row for each range
    firsts = firsts.select(F.col("_range"), F.coalesce(F.lead("_first").over(whole), F.min("_first").over(Window.partitionBy(F.lit(0)))).alias("_follows"))
    inside = ranged.withColumn("_next", F.lead(here).over(Window.partitionBy("_range").orderBy(*KEY)))
    return inside.join(F.broadcast(firsts), "_range").withColumn("_next", F.coalesce("_next", "_follows")).select(*ids.columns, F.col("_next.doc_id").alias("next_id"), F.col("_next.text_hash").alias("next_hash"))


def edited_pairs(rows: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id, text_hash, text, edited: the last quarter replaced by the start of the next document.

    Merge joins keep the rows in the partition of their document, where all later grouping is done.
    """
    nexts = links.select(F.col("next_id").alias("doc_id"), F.col("next_hash").alias("text_hash"), F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash"), F.floor(F.col("n_chars") / 4).cast("int").alias("_quarter"))
    starts = rows.hint("merge").join(nexts, KEY).select(F.col("_doc_id").alias("doc_id"), F.col("_text_hash").alias("text_hash"), "_quarter", F.expr("substring(text, 1, _quarter)").alias("_start"))
    return rows.hint("merge").join(starts, KEY).select(*KEY, "text", F.concat(F.expr("substring(text, 1, length(text) - _quarter)"), "_start").alias("edited"))


def _uniform(bits: Column, shift: int) -> Column:
    """21 bits as a number in (0, 1)."""
    return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << 21) - 1)) + F.lit(0.5)) / F.lit(float(1 << 21))


def uniforms(word: Column, k: Column) -> list[Column]:
    """Of a word in sample k: exp(-r), b and exp(-c)."""
    one, two = F.xxhash64(word, k), F.xxhash64(k, word)
    return [_uniform(one, 0) * _uniform(one, 21), _uniform(one, 42), _uniform(two, 0) * _uniform(two, 21)]


def may_reach(x: Column, b: Column, y: Column, weight: Column, near: Column) -> Column:
    """False only if a > near, told without logarithms, of x, b, y = exp(-r), b, exp(-c) and a weight that is not exceeded.

    c >= 1 - y, and a >= c * x / weight. Of weight 1, a = c * x ** (1 - b), and x ** p >= x / (p + (1 - p) * x).
    """
    p = F.when(weight > 1, 1.0).otherwise(1 - b)
    return (1 - y) * x <= near * 1.001 * weight * (p + (1 - p) * x)


def rank_of(log_a: Column) -> Column:
    return F.least(F.greatest(((log_a + 64.0) * float(1 << 24)).cast("long"), F.lit(0).cast("long")), F.lit((1 << 31) - 2).cast("long"))


def sampled(word: Column, r: Column, b: Column, c: Column, t: Column) -> Column:
    """A long that orders by ln(a) and carries 32 bits of (word, t); null where t is."""
    return F.when(t.isNotNull(), F.shiftleft(rank_of(c - r * (t - b) - r), 32).bitwiseOR(F.xxhash64(word, t).bitwiseAND(F.lit(0xFFFFFFFF))))


def counted(pairs: DataFrame, reach: float | None) -> DataFrame:
    """A row for each word (a hash w) of a text or its edited text: slot -1, its counts n0, n1 there, and near.

    Slots 0 to 3 carry the hash of the edited text, in four longs. No word begins with a space.
    """
    sha = F.sha2("edited", 256)
    carriers = F.array(*(F.concat(F.lit(f" {i}"), F.substring(sha, 16 * i + 1, 16)) for i in range(4)))
    split = pairs.select(*KEY, F.split("text", SPACE).alias("own"), F.split("edited", SPACE).alias("other"), carriers.alias("more"))
    near = F.lit(reach) / F.least(F.size("own"), F.size("other")) if reach else F.lit(1.0)
    sides = split.select(*KEY, near.alias("near"), F.explode(F.array(*(F.struct(F.lit(i).alias("side"), F.col(t).alias("t")) for i, t in enumerate(["own", "other", "more"])))).alias("s"))
    words = sides.select(*KEY, "near", "s.side", F.explode("s.t").alias("word")).where("word <> ''")
    carried = F.col("side") == 2
    slot = F.when(carried, F.substring("word", 2, 1).cast("int")).otherwise(-1)
    number = F.when(carried, F.conv(F.substring("word", 3, 16), 16, -10).cast("long")).otherwise(F.xxhash64("word"))
    numbers = words.select(*KEY, "near", slot.alias("slot"), number.alias("w"), *((F.col("side") == i).cast("int").alias(f"n{i}") for i in (0, 1)))
    return numbers.groupBy(*KEY, "slot", "w").agg(F.max("near").alias("near"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def candidates(counts: DataFrame, samples: int) -> DataFrame:
    """The rows of `counts` for each sample k in which their a may be at most near. One slot's row stands in every sample."""
    each = counts.select("*", F.explode(F.array(*(F.lit(i).cast("long") for i in range(samples)))).alias("k"))
    reached = may_reach(*uniforms(F.col("w"), F.col("k")), F.greatest("n0", "n1"), F.col("near"))
    return each.where(F.when(F.col("slot") < 0, reached).otherwise(F.col("slot") == F.col("k") % 4))


def signatures(pairs: DataFrame, samples: int = SAMPLES, reach: float | None = REACH) -> DataFrame:
    """doc_id, text_hash, edited_sha256, own, other: arrays of sample names, as 32-bit integers, of text and edited text; settled.

    The least a of a text of n words is above `reach` / n with probability exp(-reach), so draws are worked out only
    where a may be at most that. If every least is below it, no other word can have it, and the row is settled.
    """
    each = candidates(counts := counted(pairs, reach), samples)
    # in steps, as columns, so that no draw is worked out twice
    given = [*counts.columns, "k"]
    x, b, y = uniforms(F.col("w"), F.col("k"))
    each = each.select(*given, (-F.log(x)).alias("r"), b.alias("b"), F.log(-F.log(y)).alias("c"))
    weight = lambda n: F.when((F.col("slot") < 0) & (F.col(n) > 0), F.log(F.col(n).cast("double")))
    each = each.select(*given, "r", "b", "c", *(F.floor(weight(f"n{i}") / F.col("r") + F.col("b")).alias(f"t{i}") for i in (0, 1)))
    # most words weigh the same in both texts: their sample is worked out once
    at = lambda t: sampled(F.col("w"), F.col("r"), F.col("b"), F.col("c"), F.col(t))
    each = each.select(*given, "r", "b", "c", "t0", "t1", at("t0").alias("v0"))
    other = F.when(F.col("t1").eqNullSafe(F.col("t0")), F.col("v0")).otherwise(at("t1"))
    least = each.groupBy(*KEY, "k").agg(F.max("near").alias("near"), F.max(F.when(F.col("slot") >= 0, F.col("w"))).alias("sha"), F.min("v0").alias("v0"), F.min(other).alias("v1"))
    below = lambda v: F.coalesce(F.shiftright(v, 32) < rank_of(F.log("near")), F.lit(False))
    low = lambda v: F.shiftright(F.shiftleft(F.coalesce(F.col(v), F.lit(-1).cast("long")), 32), 32).cast("int")
    least = least.select(*KEY, ((F.col("near") >= 1) | below("v0") & below("v1")).alias("settled"), F.struct("k", "sha", low("v0").alias("own"), low("v1").alias("other")).alias("s"))
    parts = least.groupBy(*KEY).agg(F.min("settled").alias("settled"), F.array_sort(F.collect_list("s")).alias("p"))
    digest = F.lower(F.concat(*(F.lpad(F.hex(F.col("p.sha")[i]), 16, "0") for i in range(4))))
    return parts.select(*KEY, digest.alias("edited_sha256"), F.col("p.own").alias("own"), F.col("p.other").alias("other"), "settled")


def likeness(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)).cast("double") / F.size(a)


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def fingerprint(docs: DataFrame, samples: int = SAMPLES, reach: float | None = REACH) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    `reach` bounds what is worked out at first; results do not depend on it (None: everything at first).
    """
    ensure_checkpoint_dir(docs.sparkSession)
    all_rows = text_of(docs).select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    ids = all_rows.groupBy(*KEY).agg(F.max(F.length("text")).cast("long").alias("n_chars"), F.count("*").alias("copies"))
    links = neighbours(ids).checkpoint()
    rows = all_rows
    if not links.where("copies > 1").isEmpty():
        rows = all_rows.dropDuplicates(KEY)
    chars, n = links.agg(F.coalesce(F.sum("n_chars"), F.lit(0)), F.count("*")).first()
    parts = max(shuffle_parts(docs.sparkSession), -(-chars // PART_CHARS), -(-n // PART_ROWS))
    signs = signatures(edited_pairs(rows.repartition(parts, *KEY), links), samples, reach).checkpoint()
    late = signs.where("not settled").select(*KEY)
    if n_late := late.count():
        small = F.broadcast if n_late <= BROADCAST_ROWS else lambda df: df
        few = links.join(small(late), KEY, "left_semi").checkpoint()
        read = few.select(*KEY).union(few.select("next_id", "next_hash")).distinct()
        again = signatures(edited_pairs(rows.join(small(read), KEY, "left_semi").repartition(parts, *KEY), few), samples, None).checkpoint()
        signs = signs.where("settled").union(again)
    follow = signs.select(F.col("doc_id").alias("next_id"), F.col("text_hash").alias("next_hash"), F.col("own").alias("next_own"))
    out = links.join(signs, KEY).join(follow, ["next_id", "next_hash"]).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(F.when(F.col("doc_id") != LAST, F.col("doc_id")).alias("doc_id"), "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(documents(spark, sf_dir))
