"""Loudness windows: measuring them, joining them to segments, finding speech in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VOCAL_U, SILENCE_U, SNR_MILLI = 1000, 50, 2000
BIN_MS = 1000


def decibels(vocal: Column, other: Column) -> Column:
    return F.round(20 * F.log10((vocal + 1e-10) / (other + 1e-10)), 3)


def fine_energy(samples: DataFrame, per_window: int) -> DataFrame:
    """track_id, win_idx, vocal_rms, other_rms, snr_db, n from samples (track_id, sample_idx, vocal, other)."""
    rms = lambda c: F.round(F.sqrt(F.sum(F.col(c) * F.col(c)) / F.count("*")), 6)
    out = samples.groupBy("track_id", F.floor(F.col("sample_idx") / per_window).alias("win_idx")).agg(rms("vocal").alias("vocal_rms"), rms("other").alias("other_rms"), F.count("*").alias("n"))
    return out.withColumn("snr_db", decibels(F.col("vocal_rms"), F.col("other_rms")))


def mixdown(samples: DataFrame) -> DataFrame:
    """vocal and other per sample, from stems (track_id, stem, sample_idx, value): other is the sum of all but vocals."""
    vocal = F.col("stem") == "vocals"
    out = samples.groupBy("track_id", "sample_idx").agg(F.avg(F.when(vocal, F.col("value"))).alias("vocal"), F.sum(F.when(~vocal, F.col("value"))).alias("other"))
    return out.where("vocal is not null and other is not null")


def fine_energy_arrays(blocks: DataFrame, per_window: int) -> DataFrame:
    """The same from array columns vocal and other, window by window inside the row, without a shuffle."""
    starts = F.sequence(F.lit(0), F.floor((F.least(F.size("vocal"), F.size("other")) - 1) / per_window).cast("int"))
    part = lambda c, i: F.slice(F.col(c), i * per_window + 1, F.lit(per_window))
    power = lambda c, i: F.aggregate(part(c, i), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    window = lambda i: F.struct(i.cast("long").alias("win_idx"), power("vocal", i).alias("v"), power("other", i).alias("o"), F.size(part("vocal", i)).cast("long").alias("n"))
    each = blocks.select("track_id", F.explode(F.transform(starts, window)).alias("w")).select("track_id", "w.*")
    return each.select("track_id", "win_idx", F.round(F.sqrt(F.col("v") / F.col("n")), 6).alias("vocal_rms"), F.round(F.sqrt(F.col("o") / F.col("n")), 6).alias("other_rms"), "n")


def fine_energy_blocks(blocks: DataFrame, per_window: int) -> DataFrame:
    """The same from blocks of a track's samples (track_id, begin, vocal, others), of any lengths and any number of stems.

    begin is the track's number of the block's first sample, others an array of the other stems' arrays, which are mixed
    sample by sample in the row. A block gives sums of squares for the windows that it touches, at most two of them not its
    own, so what is shuffled is a few numbers a window and not its samples. Stems end with the shortest of a block.
    """
    length = F.array_min(F.concat(F.array(F.size("vocal")), F.transform("others", F.size)))
    mixed = F.aggregate(F.slice("others", 2, F.greatest(F.size("others"), F.lit(1))), F.transform(F.get("others", F.lit(0)), lambda x: x.cast("double")), lambda s, x: F.zip_with(s, x, lambda a, b: a + b.cast("double")))
    rows = blocks.where(F.size("others") > 0).select("track_id", F.col("begin").cast("long").alias("begin"), F.transform("vocal", lambda x: x.cast("double")).alias("vocal"), mixed.alias("other"), length.alias("_n")).where("_n > 0")
    touched = F.sequence(F.floor(F.col("begin") / per_window), F.floor((F.col("begin") + F.col("_n") - 1) / per_window))
    cut = rows.withColumn("win_idx", F.explode(touched))
    first = F.greatest(F.col("win_idx") * per_window - F.col("begin"), F.lit(0))
    last = F.least((F.col("win_idx") + 1) * per_window - F.col("begin"), F.col("_n").cast("long"))
    power = lambda c: F.aggregate(F.slice(c, (first + 1).cast("int"), (last - first).cast("int")), F.lit(0.0), lambda s, x: s + x * x)
    parts = cut.select("track_id", "win_idx", power("vocal").alias("_v"), power("other").alias("_o"), (last - first).alias("_k"))
    sums = parts.groupBy("track_id", "win_idx").agg(F.sum("_v").alias("_v"), F.sum("_o").alias("_o"), F.sum("_k").alias("n"))
    rms = lambda c: F.round(F.sqrt(F.col(c) / F.col("n")), 6)
    return sums.select("track_id", "win_idx", rms("_v").alias("vocal_rms"), rms("_o").alias("other_rms"), "n").withColumn("snr_db", decibels(F.col("vocal_rms"), F.col("other_rms")))


def bins(df: DataFrame, start: Column, end: Column, name: str = "_bin") -> DataFrame:
    """A row for each bin that [start, end) touches; a range without length touches one."""
    first = F.floor(start / BIN_MS)
    return df.withColumn(f"{name}_first", first).withColumn(name, F.explode(F.sequence(first, F.greatest(first, F.floor((end - 1) / BIN_MS)))))


def energy_join(segments: DataFrame, windows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Adds the plain means of vocal_u, other_u and snr_milli over the windows that a segment overlaps.

    Both sides are dealt out by (track, bin); a pair counts in the first bin that both touch.
    """
    keys = keys or ["seg_idx"]
    s = bins(segments.select("track_id", *keys, "start_ms", "end_ms"), F.col("start_ms"), F.col("end_ms"))
    w = bins(windows.select("track_id", F.col("start_ms").alias("_ws"), F.col("end_ms").alias("_we"), "vocal_u", "other_u", "snr_milli"), F.col("_ws"), F.col("_we"), "_wbin").withColumnRenamed("_wbin", "_bin")
    hit = s.join(w, ["track_id", "_bin"]).where((F.col("_ws") < F.col("end_ms")) & (F.col("_we") > F.col("start_ms")) & (F.col("_bin") == F.greatest("_bin_first", "_wbin_first")))
    mean = lambda c: (F.sum(c).cast("double") / F.count("*")).alias(c)
    return segments.join(hit.groupBy("track_id", *keys).agg(mean("vocal_u"), mean("other_u"), mean("snr_milli")), ["track_id", *keys], "left")


def islands(windows: DataFrame, active: Column) -> DataFrame:
    """Active windows with island (number of the run of neighbours) and pos (place in it)."""
    by_track = Window.partitionBy("track_id").orderBy("win_idx")
    on = windows.withColumn("_on", active).withColumn("island", F.sum(F.when(F.col("_on") & ~F.coalesce(F.lag("_on").over(by_track), F.lit(False)), 1).otherwise(0)).over(by_track)).where("_on").drop("_on")
    return on.withColumn("pos", F.row_number().over(Window.partitionBy("track_id", "island").orderBy("win_idx")) - 1)


def is_active() -> Column:
    return (F.col("vocal_u") > VOCAL_U) & (F.col("snr_milli") > SNR_MILLI)


def vad_islands(windows: DataFrame) -> DataFrame:
    return islands(windows, is_active()).groupBy("track_id", "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n_windows"))


def signal_norm(windows: DataFrame) -> DataFrame:
    """dBFS of both stems on one scale of the track and snr on its own, 0 to 1; a flat track gives 0."""
    by_track = Window.partitionBy("track_id")
    db = lambda c: F.greatest(F.lit(-60.0), F.least(F.lit(0.0), 20 * F.log10(F.greatest(F.col(c) * 1e-6, F.lit(1e-10)))))
    out = windows.withColumn("_v", db("vocal_u")).withColumn("_o", db("other_u"))
    low, high = F.least(F.min("_v").over(by_track), F.min("_o").over(by_track)), F.greatest(F.max("_v").over(by_track), F.max("_o").over(by_track))
    a, b = F.min("snr_milli").over(by_track), F.max("snr_milli").over(by_track)
    part = lambda x, low, high: F.round(F.when(high > low, (x - low) / (high - low)).otherwise(0.0), 5)
    return out.select("track_id", "win_idx", "start_ms", "end_ms", part(F.col("_v"), low, high).alias("vocal_01"), part(F.col("_o"), low, high).alias("other_01"), part(F.col("snr_milli"), a, b).alias("snr_01"))
