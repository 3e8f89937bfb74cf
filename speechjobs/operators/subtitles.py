"""Subtitle lines from translation entries. Entries without text are no one's neighbours: they go first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse_runs, lrc_time, trimmed, vtt_time

PAUSE_MS = 2000


def merge_same_start(entries: DataFrame, order: list[str]) -> DataFrame:
    """Entries without text go; then neighbours with one start become one: texts and, where there are any, ids are joined."""
    w = Window.partitionBy("track_id").orderBy(*order)
    shown = entries.where(trimmed(F.coalesce("text", F.lit(""))) != "")
    r = shown.withColumn("_ord", F.row_number().over(w)).withColumn("_new", F.when(F.lag("start_ms").over(w) == F.col("start_ms"), 0).otherwise(1)).withColumn("run", F.sum("_new").over(w))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("_ord", c))), lambda x: x[c])
    ids = [F.flatten(listed("ids")).alias("ids")] if "ids" in entries.columns else []
    return r.groupBy("track_id", "run").agg(F.array_join(listed("text"), "～").alias("text"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), *ids)


def lrc_lines(merged: DataFrame, collapse: bool = True) -> DataFrame:
    """Text of a track's file; an empty line marks a pause of over two seconds before the next entry."""
    w = Window.partitionBy("track_id").orderBy("run")
    rows = merged.withColumn("_next", F.lead("start_ms").over(w))
    text = collapse_runs(F.col("text")) if collapse else F.col("text")
    line = F.concat(lrc_time(F.col("start_ms")), text)
    line = F.when(F.col("_next") - F.col("end_ms") > PAUSE_MS, F.concat(line, F.lit("\n"), lrc_time(F.col("end_ms")))).otherwise(line)
    return rows.withColumn("_line", line).groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("run", "_line"))).alias("_l")).select("track_id", F.concat(F.array_join(F.transform("_l", lambda x: x["_line"]), "\n"), F.lit("\n")).alias("lrc"))


def vtt_cues(merged: DataFrame, collapse: bool = True) -> DataFrame:
    rows = merged.withColumn("cue", F.row_number().over(Window.partitionBy("track_id").orderBy("run")))
    text = collapse_runs(F.col("text")) if collapse else F.col("text")
    return rows.select("track_id", F.col("cue").cast("long").alias("cue"), F.concat(vtt_time(F.col("start_ms")), F.lit(" --> "), vtt_time(F.col("end_ms"))).alias("times"), text.alias("text"))


def vtt_files(cues: DataFrame) -> DataFrame:
    """Text of a track's file: a header, then number, times and text of each cue between blank lines."""
    block = F.concat(F.col("cue").cast("string"), F.lit("\n"), F.col("times"), F.lit("\n"), F.col("text"), F.lit("\n"))
    listed = cues.withColumn("_b", block).groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("cue", "_b"))).alias("_l"))
    return listed.select("track_id", F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("_l", lambda x: x["_b"]), "\n")).alias("vtt"))
