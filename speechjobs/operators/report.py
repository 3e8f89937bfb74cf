"""Reports: totals, timeline lanes, what is still to do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .align import sentences


def full_text(segments: DataFrame, words: DataFrame) -> DataFrame:
    """A track's text in order, with its numbers of segments and words."""
    text = segments.groupBy("track_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "text"))), lambda x: x["text"]), "").alias("full_text"), F.count("*").alias("n_segments"))
    return text.join(words.groupBy("track_id").agg(F.count("*").alias("n_words")), "track_id", "left").na.fill(0, ["n_words"])


def sentence_list(segments: DataFrame) -> DataFrame:
    """A track's sentences in order, as two arrays.

    sentences: (text, start_ms, end_ms), one for each segment, as engines that time segments give them; split: the same texts
    cut at their closing marks, as the engine that splits text gives them.
    """
    item = F.struct("seg_idx", F.struct("text", "start_ms", "end_ms").alias("s"), sentences(F.col("text")).alias("cut"))
    listed = segments.groupBy("track_id").agg(F.array_sort(F.collect_list(item)).alias("_l"))
    return listed.select("track_id", F.transform("_l", lambda x: x["s"]).alias("sentences"), F.flatten(F.transform("_l", lambda x: F.coalesce(x["cut"], F.array().cast("array<string>")))).alias("split"))


def track_report(tracks: DataFrame, raw: DataFrame, kept: DataFrame) -> DataFrame:
    """Counts before and after cleaning, and what became of each track. removed is below 0 where a resplit added rows."""
    a, b = raw.groupBy("track_id").agg(F.count("*").alias("n_raw")), kept.groupBy("track_id").agg(F.count("*").alias("n_clean"))
    out = tracks.select("track_id").join(a, "track_id", "left").join(b, "track_id", "left")
    status = F.when(F.col("n_raw").isNull(), "no transcript").when(F.col("n_clean").isNull(), "all garbled").otherwise("processed")
    return out.withColumn("status", status).na.fill(0, ["n_raw", "n_clean"]).withColumn("removed", F.col("n_raw") - F.col("n_clean"))


def bad_segment():
    return (F.coalesce("ratio_c", F.lit(0)) > 250) | (F.coalesce("logprob_c", F.lit(0)) < -150) | (F.coalesce("nospeech_c", F.lit(0)) > 80) | F.col("mismatch_type").isNotNull()


def timeline(raw: DataFrame, final: DataFrame, vad: DataFrame, log: DataFrame, signals: DataFrame | None = None, repairs: DataFrame | None = None) -> DataFrame:
    """Lanes of a track as (lane, kind, start_ms, end_ms, value); what has no length is shown for 100 ms.

    signals: windows with vocal_01, other_01 and snr_01; repairs: ranges with status.
    """
    none = F.lit(None).cast("double")
    lane = lambda df, name, kind, value=none: df.select("track_id", F.lit(name).alias("lane"), kind.alias("kind"), "start_ms", "end_ms", value.alias("value"))
    out = lane(raw, "raw", F.when(bad_segment(), "bad").otherwise("ok")).unionByName(lane(final, "final", F.lit("kept"))).unionByName(lane(vad, "vad", F.lit("speech"))).unionByName(lane(log, "mismatch", F.col("kind")))
    for name, kind in (("signal", "vocal"), ("signal", "other"), ("snr", "snr")) if signals is not None else ():
        out = out.unionByName(lane(signals, name, F.lit(kind), F.col(f"{kind}_01")))
    if repairs is not None:
        out = out.unionByName(lane(repairs, "repair", F.col("status")))
    return out.withColumn("end_ms", F.when(F.col("end_ms") <= F.col("start_ms"), F.col("start_ms") + 100).otherwise(F.col("end_ms")))


def todo(tracks: DataFrame, done: DataFrame, repaired: DataFrame) -> DataFrame:
    """Tracks without results, and whether a repair log is to be applied again instead of a new repair."""
    left = tracks.select("track_id").join(done.select("track_id").distinct(), "track_id", "left_anti")
    return left.join(repaired.select("track_id").distinct().withColumn("reapply", F.lit(True)), "track_id", "left").na.fill(False, ["reapply"])


def stale_works(tracks: DataFrame, manifest: DataFrame) -> DataFrame:
    """work_id of the works with a track (work_id, track_id, version) that no finished run has seen in this version."""
    seen = manifest.select("work_id", "track_id", "version").distinct()
    return tracks.select("work_id", "track_id", "version").join(seen, ["work_id", "track_id", "version"], "left_anti").select("work_id").distinct()
