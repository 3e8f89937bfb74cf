"""Repair of time ranges: merging, planning, judging what came back, and putting it in."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trimmed
from ..sources.shared import stored
from .clean import classify, unite
from .energy import SILENCE_U, SNR_MILLI, VOCAL_U, bins, energy_join

CLUSTER_GAP_MS, CLUSTER_PAD_MS, CLUSTER_MS = 1200, 200, 1500
RESULT_LEEWAY_MS = 500
RANGE = ["track_id", "r_start", "r_end"]


def merge_ranges(ranges: DataFrame, order: list[str]) -> DataFrame:
    """Overlapping or touching ranges as one, with the reasons joined."""
    return unite(ranges, order, 0, None)


def _named(ranges: DataFrame) -> DataFrame:
    return ranges.select("track_id", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))


def overlapping(ranges: DataFrame, rows: DataFrame) -> DataFrame:
    """Each row with each range it strictly overlaps, by a binned join."""
    r = bins(_named(ranges), F.col("r_start"), F.col("r_end"), "_rbin").withColumnRenamed("_rbin", "_bin")
    s = bins(rows, F.col("start_ms"), F.col("end_ms"))
    hit = s.join(r, ["track_id", "_bin"]).where((F.col("start_ms") < F.col("r_end")) & (F.col("end_ms") > F.col("r_start")) & (F.col("_bin") == F.greatest("_bin_first", "_rbin_first")))
    return hit.drop("_bin", "_bin_first", "_rbin_first")


def range_members(ranges: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows that lie inside a range."""
    r = bins(_named(ranges), F.col("r_start"), F.col("r_end") + 1, "_rbin").withColumnRenamed("_rbin", "_bin")
    s = rows.withColumn("_bin", F.floor(F.col("start_ms") / 1000))
    return s.join(r, ["track_id", "_bin"]).where((F.col("start_ms") >= F.col("r_start")) & (F.col("end_ms") <= F.col("r_end"))).drop("_bin", "_rbin_first")


def speech_clusters(ranges: DataFrame, windows: DataFrame) -> DataFrame:
    """Runs of active windows in each range, joined over short gaps, padded and widened inside the range."""
    w = Window.partitionBy(*RANGE).orderBy("start_ms")
    on = overlapping(ranges, windows.where((F.col("vocal_u") >= VOCAL_U) & (F.col("snr_milli") >= SNR_MILLI)))
    on = on.withColumn("_end", F.least("end_ms", "r_end"))
    on = on.withColumn("cluster", F.sum(F.when(F.col("start_ms") > F.lag("_end").over(w) + CLUSTER_GAP_MS, 1).otherwise(0)).over(w))
    c = on.groupBy(*RANGE, "cluster").agg(F.min("start_ms").alias("_s"), F.max(F.struct("start_ms", "_end"))["_end"].alias("_e"))
    c = c.withColumn("_s", F.greatest("r_start", F.greatest("_s", "r_start") - CLUSTER_PAD_MS).cast("double")).withColumn("_e", F.least("r_end", F.col("_e") + CLUSTER_PAD_MS).cast("double"))
    short = F.col("_e") - F.col("_s") < CLUSTER_MS
    start = F.when(short, F.greatest("r_start", (F.col("_s") + F.col("_e")) / 2 - CLUSTER_MS / 2)).otherwise(F.col("_s"))
    c = c.withColumn("start_ms", start.cast("double"))
    end = F.when(short, F.least("r_end", F.col("start_ms") + CLUSTER_MS)).otherwise(F.col("_e"))
    return c.select(*RANGE, F.col("cluster").cast("long").alias("cluster"), "start_ms", end.cast("double").alias("end_ms"))


def new_ranges(first: DataFrame, second: DataFrame) -> DataFrame:
    """First-pass ranges and those of the second pass whose times, to a tenth of a second, are unseen."""
    tenth = lambda c: F.floor((F.col(c) + 50) / 100)
    keyed = lambda df: df.select("track_id", "start_ms", "end_ms", "reason", tenth("start_ms").alias("_a"), tenth("end_ms").alias("_b"))
    a, b = keyed(first), keyed(second)
    return a.unionByName(b.join(a, ["track_id", "_a", "_b"], "left_anti")).drop("_a", "_b")


def phoneme_noise(text: Column) -> Column:
    """Too short to be a word: under two CJK characters and under two word characters."""
    cjk = r"[぀-ヿ一-鿿ｦ-ﾟ]"
    return (F.regexp_count(text, F.lit(cjk)) < 2) & (F.regexp_count(text, F.lit(r"[A-Za-z0-9_぀-ヿ一-鿿ｦ-ﾟ]")) < 2)


def judge(candidates: DataFrame, windows: DataFrame, good: DataFrame, phoneme_engine: str = "mms") -> DataFrame:
    """Adds energies and accepted to candidates (track_id, range_idx, cand_idx, r_start, r_end, engine, ...).

    The phoneme engine has its own noise rules; others go through the garble rules in repair mode. A candidate that
    overlaps a good segment of its range is not accepted.
    """
    keys = ["range_idx", "cand_idx"]
    c = classify(energy_join(candidates, windows, keys), repair=True)
    own = F.col("engine") == phoneme_engine
    text = trimmed(F.col("text"))
    noise = phoneme_noise(text) | (F.coalesce("vocal_u", F.lit(0.0)) < SILENCE_U)
    c = c.withColumn("_bad", F.when(own, noise).otherwise(F.col("dropped"))).withColumn("text", F.when(own & text.rlike("^[A-Za-z]{1,2}$"), F.lit("")).otherwise(F.col("text")))
    g = overlapping(candidates.select("track_id", F.col("r_start").alias("start_ms"), F.col("r_end").alias("end_ms")).distinct(), good.select("track_id", "start_ms", "end_ms"))
    g = bins(g.select(*RANGE, F.col("start_ms").alias("_gs"), F.col("end_ms").alias("_ge")), F.col("_gs"), F.col("_ge"), "_gbin").withColumnRenamed("_gbin", "_bin").drop("_gbin_first")
    hit = bins(c.select(*RANGE, *keys, "start_ms", "end_ms"), F.col("start_ms"), F.col("end_ms")).join(g, [*RANGE, "_bin"]).where((F.col("_gs") < F.col("end_ms")) & (F.col("_ge") > F.col("start_ms"))).select("track_id", *keys).distinct()
    return c.join(hit.withColumn("_hit", F.lit(True)), ["track_id", *keys], "left").withColumn("accepted", ~F.col("_bad") & F.col("_hit").isNull()).drop("_bad", "_hit")


def assign_by_order(ranges: DataFrame, results: DataFrame) -> DataFrame:
    """Results (track_id, ordinal, ...) to the ranges (track_id, r_start, r_end) of a track that were sent, in order."""
    place = (F.row_number().over(Window.partitionBy("track_id").orderBy("r_start", "r_end")) - 1).cast("long")
    return ranges.withColumn("ordinal", place).join(results, ["track_id", "ordinal"])


def assign_by_time(ranges: DataFrame, rows: DataFrame, leeway_ms: int = RESULT_LEEWAY_MS) -> DataFrame:
    """Rows of one pooled result to the ranges that hold them, give or take the leeway."""
    wide = ranges.select("track_id", "r_start", "r_end", (F.col("r_start") - leeway_ms).alias("start_ms"), (F.col("r_end") + leeway_ms).alias("end_ms"))
    near = bins(wide, F.col("start_ms"), F.col("end_ms") + 1, "_rbin").select("track_id", "r_start", "r_end", F.col("_rbin").alias("_bin"))
    held = (F.col("start_ms") >= F.col("r_start") - leeway_ms) & (F.col("end_ms") <= F.col("r_end") + leeway_ms)
    return rows.withColumn("_bin", F.floor(F.col("start_ms") / 1000)).join(near, ["track_id", "_bin"]).where(held).drop("_bin")


def _bad() -> Column:
    """Neither good nor from a recogniser's first pass: what a repair may take out."""
    return F.col("mismatch_type").isNotNull() | F.col("engine").isNotNull()


def apply_repair(segments: DataFrame, judged: DataFrame) -> DataFrame:
    """Segments after repair, for disjoint ranges: where a row was accepted, what overlaps the range goes unless it is good.

    Good are segments without a mismatch that no earlier repair put in (engine).
    """
    ok = judged.where("accepted")
    gone = overlapping(_won(judged), segments.where(_bad()).select("track_id", "seg_idx", "start_ms", "end_ms")).select("track_id", "seg_idx").distinct()
    kept = segments.join(gone, ["track_id", "seg_idx"], "left_anti").select("track_id", "start_ms", "end_ms", "text", F.coalesce("engine", F.lit("first")).alias("origin"))
    return kept.unionByName(ok.select("track_id", "start_ms", "end_ms", "text", F.col("engine").alias("origin")))


def _won(judged: DataFrame) -> DataFrame:
    return judged.where("accepted").select("track_id", F.col("r_start").alias("start_ms"), F.col("r_end").alias("end_ms")).distinct()


def apply_repair_log(mismatches: DataFrame, judged: DataFrame) -> DataFrame:
    """Mismatches (with mismatch_idx) that overlap no repaired range."""
    gone = overlapping(_won(judged), mismatches.select("track_id", "mismatch_idx", "start_ms", "end_ms")).select("track_id", "mismatch_idx").distinct()
    return mismatches.join(gone, ["track_id", "mismatch_idx"], "left_anti")


_REPLAYED = "struct<rows:array<struct<start_ms:bigint,end_ms:bigint,text:string,engine:string>>,applied:array<bigint>>"


def _replay(segments: list[dict], log: list[dict]) -> dict:
    """One cluster of a track: the log's entries in order, on the segments that any of its ranges touches."""
    now = [x | {"bad": x["mismatch_type"] is not None} for x in segments]
    applied = []
    for entry in sorted(log, key=lambda x: x["log_idx"]):
        inside = lambda x, a=entry["r_start"], b=entry["r_end"]: x["start_ms"] < b and x["end_ms"] > a
        good = [x for x in now if inside(x) and not x["bad"]]
        new = [n for n in entry["new_segments"] if not any(g["start_ms"] < n["end_ms"] and g["end_ms"] > n["start_ms"] for g in good)]
        if new:
            now = [x for x in now if not inside(x) or (not x["bad"] and x["engine"] is None)]
            now += [n | {"bad": False} for n in new]
            applied.append(entry["log_idx"])
    return {"rows": [{k: x[k] for k in ("start_ms", "end_ms", "text", "engine")} for x in now], "applied": applied}


def _replayed():
    @F.arrow_udf(_REPLAYED)
    def run(segments: pa.Array, log: pa.Array) -> pa.Array:
        row = pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64()), ("text", pa.string()), ("engine", pa.string())])
        return pa.array([_replay(s or [], e or []) for s, e in zip(segments.to_pylist(), log.to_pylist(), strict=True)], pa.struct([("rows", pa.list_(row)), ("applied", pa.list_(pa.int64()))]))

    return run


def replay_log(segments: DataFrame, mismatches: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments and mismatches after a log whose ranges may overlap, entry by entry in the log's order.

    log: track_id, log_idx, r_start, r_end, status, new_segments (start_ms, end_ms, text, engine). Rows that an entry put
    in count as good for later conflicts, and go when a later entry of their range succeeds. Only segments that a range
    touches meet the log. Entries, with what they bring, and segments form clusters that do not overlap, so each cluster is
    replayed alone, whatever else its track holds.
    """
    used = log.where((F.col("status") == "success") & (F.size("new_segments") > 0))
    ranges = used.select("track_id", F.col("r_start").alias("start_ms"), F.col("r_end").alias("end_ms")).distinct()
    touched = overlapping(ranges, segments.select("track_id", "seg_idx", "start_ms", "end_ms")).select("track_id", "seg_idx").distinct()
    mine = segments.join(touched, ["track_id", "seg_idx"]).select("track_id", "seg_idx", "start_ms", "end_ms", "text", "engine", "mismatch_type")
    brought = lambda f, c: f(F.transform("new_segments", lambda x: x[c]))
    entries = used.select("track_id", F.least("r_start", brought(F.array_min, "start_ms")).alias("_s"), F.greatest("r_end", brought(F.array_max, "end_ms")).alias("_e"), F.lit(None).cast("long").alias("seg_idx"), "log_idx")
    spans = mine.select("track_id", F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"), "seg_idx", F.lit(None).cast("long").alias("log_idx")).unionByName(entries)
    by_time = Window.partitionBy("track_id").orderBy("_s", "_e")
    reach = F.max("_e").over(by_time.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("_cluster", F.sum(F.when(F.col("_s") >= reach, 1).otherwise(0)).over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    of = lambda c: spans.where(F.col(c).isNotNull()).select("track_id", c, "_cluster")
    by = ["track_id", "_cluster"]
    held = mine.join(of("seg_idx"), ["track_id", "seg_idx"]).groupBy(*by).agg(F.collect_list(F.struct("start_ms", "end_ms", "text", "engine", "mismatch_type")).alias("_rows"))
    told = used.join(of("log_idx"), ["track_id", "log_idx"]).groupBy(*by).agg(F.collect_list(F.struct("log_idx", "r_start", "r_end", "new_segments")).alias("_log"))
    out = stored(told.join(held, by, "left").select("track_id", _replayed()("_rows", "_log").alias("o")))
    columns = ["track_id", "start_ms", "end_ms", "text", "engine"]
    after = segments.join(touched, ["track_id", "seg_idx"], "left_anti").select(*columns).unionByName(out.select("track_id", F.explode("o.rows").alias("x")).select("track_id", "x.*"))
    applied = used.join(out.select("track_id", F.explode("o.applied").alias("log_idx")), ["track_id", "log_idx"], "left_semi").select("track_id", F.col("r_start").alias("start_ms"), F.col("r_end").alias("end_ms")).distinct()
    gone = overlapping(applied, mismatches.select("track_id", "mismatch_idx", "start_ms", "end_ms")).select("track_id", "mismatch_idx").distinct()
    return after, mismatches.join(gone, ["track_id", "mismatch_idx"], "left_anti")


def repair_outcome(ranges: DataFrame, judged: DataFrame) -> DataFrame:
    """success, failed (nothing accepted) or no_change (the engine gave nothing) for each range."""
    per = judged.groupBy("track_id", F.col("r_start").alias("start_ms"), F.col("r_end").alias("end_ms")).agg(F.count("*").alias("n_new"), F.sum(F.col("accepted").cast("long")).alias("n_accepted"))
    out = ranges.select("track_id", "start_ms", "end_ms").join(per, ["track_id", "start_ms", "end_ms"], "left").na.fill(0, ["n_new", "n_accepted"])
    return out.withColumn("status", F.when(F.col("n_new") == 0, "no_change").when(F.col("n_accepted") > 0, "success").otherwise("failed"))
