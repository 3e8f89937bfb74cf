"""Model output: reading it, checking it, and choosing between attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_speaker, trimmed

SHORT, LONG, MANY, FEW = 5, 15, 3, 2
MOST_IDS = 5
CALL = ["track_id", "window_idx"]


def _between(raw: Column, opening: str, closing: str) -> Column:
    """From the first opening to the last closing mark, after the last closing think mark; as it is without both."""
    text = trimmed(F.regexp_replace(raw, "(?s)^.*</think>", ""))
    start, end = F.instr(text, opening), F.length(text) - F.instr(F.reverse(text), closing) + 1
    return F.when((start > 0) & F.contains(text, F.lit(closing)) & (end > start), F.substring(text, start, end - start + 1)).otherwise(text)


def extract_array(raw: Column) -> Column:
    return _between(raw, "[", "]")


def extract_object(raw: Column) -> Column:
    return _between(raw, "{", "}")


def parse_items(raw: Column, schema: str) -> Column:
    """The parsed array, or null."""
    return F.from_json(extract_array(raw), f"array<{schema}>", {"mode": "PERMISSIVE"})


def parse_object(raw: Column, schema: str) -> Column:
    """The parsed object, or null."""
    return F.from_json(extract_object(raw), schema, {"mode": "PERMISSIVE"})


def salvage(raw: Column, schema: str) -> Column:
    """The array; else without trailing commas; else every flat object that parses; rows without text go."""
    text = extract_array(raw)
    each = F.transform(F.regexp_extract_all(raw, F.lit(r"\{[^{}]*\}"), F.lit(0)), lambda x: F.from_json(x, schema))
    whole = F.when(text.rlike(r"(?s)^\[.*\]$") & ~text.rlike(r",\s*\]$"), F.from_json(text, f"array<{schema}>"))
    fixed = F.when(text.rlike(r"(?s)^\[.*,\s*\]$"), F.from_json(F.regexp_replace(text, r",\s*\]$", "]"), f"array<{schema}>"))
    return F.filter(F.coalesce(whole, fixed, each), lambda x: x.isNotNull() & (trimmed(F.coalesce(x["text"], F.lit(""))) != ""))


def collapse(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Output texts of a call that too many distinct inputs share. Long texts are grouped by a hash beside them."""
    rows = entries.where(F.length("text") > SHORT).withColumn("_h", F.xxhash64("text"))
    per = rows.groupBy(*keys, "_h", "text").agg(F.countDistinct(F.coalesce("input", F.lit(""))).alias("n_inputs"))
    return per.where(F.col("n_inputs") >= F.when(F.length("text") > LONG, FEW).otherwise(MANY)).drop("_h")


def conformance(entries: DataFrame, segments: DataFrame, most: int = MOST_IDS) -> DataFrame:
    """Faults of each window's entries (window keys, entry_idx, ids, start_ms, end_ms, input where echoed).

    Ids that are missing, unknown, doubled or not after the one before; entries with no id or too many, or with ids that
    do not follow each other; times other than those of the first and last segment; an echoed input other than the
    segments' texts with a space between.
    """
    flag = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    each = entries.select(*CALL, "entry_idx", F.posexplode("ids").alias("_pos", "local_id"))
    order = Window.partitionBy(*CALL).orderBy("entry_idx", "_pos")
    each = each.withColumn("_back", F.col("local_id") <= F.lag("local_id").over(order))
    back = each.groupBy(*CALL).agg(flag(F.col("_back")).alias("n_order"))
    uses = each.groupBy(*CALL, "local_id").agg(F.count("*").alias("_n"))
    known = segments.select(*CALL, "local_id", F.lit(True).alias("_known"))
    ids = known.join(uses, [*CALL, "local_id"], "full").groupBy(*CALL).agg(flag(F.col("_n").isNull()).alias("n_missing"), flag(F.col("_known").isNull()).alias("n_unknown"), flag(F.col("_n") > 1).alias("n_double"))
    meant = each.join(segments.select(*CALL, "local_id", F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"), F.col("text").alias("_t")), [*CALL, "local_id"], "left").groupBy(*CALL, "entry_idx").agg(F.array_sort(F.collect_list(F.struct("_pos", "_s", "_e", "_t"))).alias("_m"))
    size, m = F.size("ids"), F.col("_m")
    gaps = F.exists(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), lambda i: (i < size) & (F.get("ids", i) != F.get("ids", i - 1) + 1))
    times = (F.col("start_ms") != F.get(m, 0)["_s"]) | (F.col("end_ms") != F.get(m, size - 1)["_e"])
    echo = F.col("input").isNotNull() & (F.col("input") != F.array_join(F.transform(m, lambda x: F.coalesce(x["_t"], F.lit(""))), " "))
    per = entries.join(meant, [*CALL, "entry_idx"], "left").groupBy(*CALL).agg(flag((size < 1) | (size > most)).alias("n_size"), flag(gaps).alias("n_gaps"), flag(times).alias("n_times"), flag(echo).alias("n_input"))
    return ids.join(back, CALL, "left").join(per, CALL, "left").na.fill(0)


def resolve(attempts: DataFrame, segments: DataFrame) -> DataFrame:
    """The lowest attempt whose chunks are all ok gives the entries; chunks of the last that fail give the source text.

    attempts: window keys, attempt, chunk_idx, ok; segments: window keys, local_id, half, pair, text.
    """
    good = attempts.where("attempt < 4").groupBy(*CALL, "attempt").agg(F.bool_and("ok").alias("_ok")).where("_ok").groupBy(*CALL).agg(F.min("attempt").alias("attempt"))
    chosen = segments.select(*CALL).distinct().join(good, CALL, "left").withColumn("attempt", F.coalesce("attempt", F.lit(4)))
    last = attempts.where("attempt = 4").select(*CALL, F.col("chunk_idx").alias("pair"), F.col("ok").alias("_pair_ok"))
    rows = segments.join(chosen, CALL).join(last, [*CALL, "pair"], "left")
    fallback = (F.col("attempt") == 4) & ~F.coalesce("_pair_ok", F.lit(False))
    return rows.select(*CALL, "local_id", "attempt", fallback.alias("fallback"))


def resolved_entries(entries: DataFrame, attempts: DataFrame, segments: DataFrame, echo: bool = False) -> DataFrame:
    """track_id, window_idx, number, ids, text, input, start_ms, end_ms: all windows' entries in window order.

    entries: window keys, attempt, chunk_idx, entry_idx, ids, text, input, start_ms, end_ms of every attempt that parsed.
    Entries come from the attempt that counts; a segment of a failed last chunk is an entry with its own text.
    """
    state = resolve(attempts, segments)
    ok = attempts.where("ok").select(*CALL, "attempt", "chunk_idx")
    chosen = state.groupBy(*CALL).agg(F.max("attempt").alias("attempt"))
    parsed = entries.join(chosen, [*CALL, "attempt"]).join(ok, [*CALL, "attempt", "chunk_idx"], "left_semi")
    parsed = parsed.select(*CALL, F.col("chunk_idx").cast("long").alias("_chunk"), F.col("entry_idx").cast("long").alias("_entry"), "ids", "text", "input", "start_ms", "end_ms")
    own = segments.join(state.where("fallback"), [*CALL, "local_id"])
    given = own.select(*CALL, F.col("pair").cast("long").alias("_chunk"), F.col("local_id").cast("long").alias("_entry"), F.array(F.col("local_id").cast("long")).alias("ids"), "text", (F.col("text") if echo else F.lit(None).cast("string")).alias("input"), "start_ms", "end_ms")
    order = Window.partitionBy("track_id").orderBy("window_idx", "_chunk", "_entry")
    return parsed.unionByName(given).withColumn("number", F.row_number().over(order).cast("long")).drop("_chunk", "_entry")


def restore_ids(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """entry ids (array of local ids) as global ids; unknown ones stay."""
    each = entries.select(*CALL, "entry_idx", F.posexplode("ids").alias("_pos", "local_id"))
    found = each.join(ids.select(*CALL, "local_id", "global_id"), [*CALL, "local_id"], "left").withColumn("id", F.coalesce("global_id", "local_id"))
    return found.groupBy(*CALL, "entry_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "id"))), lambda x: x["id"]).alias("ids"))


def speaker_prefixes(entries: DataFrame) -> DataFrame:
    prefix = F.substring("text", F.lit(1), F.length("text") - F.length(strip_speaker(F.col("text"))))
    return entries.select("track_id", prefix.alias("prefix")).where("prefix <> ''").distinct()
