"""Transcript cleaning: resplit, repetition, garble rules, merging, missed speech, repair ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import effective, normalised, top_counts, trimmed
from ..sources.shared import stored
from .chains import reached
from .energy import SILENCE_U, SNR_MILLI, VOCAL_U, bins, is_active, islands

GAP_MS, REPEATS, LONG_TEXT = 1000, 3, 20
LEEWAY_MS, LONGEST_BLOCK_MS, PIECE_ROWS = 1000, 30_000, 4096
MIN_MISSED_MS, BAD_LOGPROB, MERGE_GAP_MS, MAX_RANGE_MS, PAD_MS = 1500, -200, 8000, 90000, 2000
# As pyarrow reads them: marks and blanks alone, and a mark with nothing but blanks behind it.
SILENCE = r"^[\s…・。、！？!?]+$"
ENDED = r"[。！？!?][\s\x{00A0}\x{3000}\x{FEFF}]*$"
# Stock closings that a recogniser invents in silence.
OUTROS = [
    "[おオ]やすみなさい[。！]?",
    "ご視聴ありがとうございました[。！]?",
    "チャンネル登録[。、]?よろしくお願いします[。！]?",
    "チャンネル登録よろしくお願いします[。！]?",
    "次回の動画でお会いしましょう[。！]?",
    "動画を聞いてくれてありがとう[。！]?",
    "動画を見てくれてありがとう[。！]?",
    "高評価[、。]?よろしくお願いします[。！]?",
    "[バパ]イ[バパ]イ[。！]?",
    "またね[。！]?",
]
# rule: (drop, mismatch)
RULES = {1: (True, "hallucinated"), 2: (False, "uncertain"), 3: (True, "hallucinated"), 4: (True, "hallucinated"), 5: (True, "hallucinated"), 6: (True, "hallucinated"), 7: (True, None), 8: (True, None), 9: (True, None), 10: (True, "hallucinated"), 11: (True, "hallucinated"), 13: (True, "hallucinated"), 14: (False, None)}


def _parts(gap_ms: int):
    """Parts of segments from their words (text, at_ms, w_dur) in order; none for a segment that is not cut."""

    @F.arrow_udf("array<struct<text:string,from_ms:bigint,to_ms:bigint>>")
    def run(words: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        row, each = np.repeat(np.arange(len(sizes)), sizes), words.flatten()
        text, start, lasts = (pc.struct_field(each, c) for c in ("text", "at_ms", "w_dur"))
        start, lasts = start.to_numpy(zero_copy_only=False), lasts.to_numpy(zero_copy_only=False)
        end = start + lasts
        yes = lambda mask: pc.fill_null(mask, False).to_numpy(zero_copy_only=False)[:-1]
        inner = row[1:] == row[:-1]
        after = yes(pc.match_substring_regex(text, ENDED)) | (yes(pc.and_(pc.match_substring_regex(text, SILENCE), pc.match_substring(text, "…"))) & (lasts[:-1] >= gap_ms))
        cut = inner & ((start[1:] - end[:-1] >= gap_ms) | after)
        shared = np.isin(row, row[1:][cut])
        begins = np.append(True, ~inner | cut)[: len(row)] & shared
        text, row, start, end, at = text.filter(pa.array(shared)), row[shared], start[shared], end[shared], np.flatnonzero(begins[shared])
        until = np.append(at[1:], len(row))[: len(at)]
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(at, len(row)), pa.int32()), text), "")
        parts = pa.StructArray.from_arrays([joined, pa.array(np.minimum.reduceat(start, at) if len(at) else start), pa.array(end[until - 1])], ["text", "from_ms", "to_ms"])
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(row[at], minlength=len(sizes)))), pa.int32()), parts)

    return run


def cut(segments: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """Parts (text, from_ms, to_ms after the segment's start), none for a segment that is not cut, in place of words.

    A text that its parts hold is not kept beside them.
    """
    return segments.withColumn("parts", _parts(gap_ms)("words")).drop("words").withColumn("text", F.when(F.size("parts") < 2, F.col("text")))


def resplit(segments: DataFrame, words: DataFrame | None = None, gap_ms: int = GAP_MS) -> DataFrame:
    """Segments cut between words; part_idx counts the parts, and an uncut segment keeps its own text and times.

    Words are a table; or an array in each segment (text, at_ms, w_dur), which needs no shuffle; or they are cut already.
    """
    if words is not None:
        own = words.join(segments.select("track_id", "seg_idx", F.col("start_ms").alias("_s")), ["track_id", "seg_idx"])
        listed = F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "text", (F.col("start_ms") - F.col("_s")).alias("at_ms"), "w_dur"))), lambda x: x.dropFields("word_idx"))
        segments = segments.join(own.groupBy("track_id", "seg_idx").agg(listed.alias("words")), ["track_id", "seg_idx"], "left")
    if "words" in segments.columns:
        segments = cut(segments, gap_ms)
    rest = [c for c in segments.columns if c not in ("track_id", "seg_idx", "text", "start_ms", "end_ms", "parts")]
    whole = F.array(F.struct("text", F.lit(0).cast("long").alias("from_ms"), (F.col("end_ms") - F.col("start_ms")).alias("to_ms")))
    each = segments.select("track_id", "seg_idx", "start_ms", F.posexplode(F.when(F.size("parts") > 1, F.col("parts")).otherwise(whole)).alias("_at", "_p"), *rest)
    return each.select("track_id", "seg_idx", F.col("_at").cast("long").alias("part_idx"), "_p.text", (F.col("start_ms") + F.col("_p.from_ms")).alias("start_ms"), (F.col("start_ms") + F.col("_p.to_ms")).alias("end_ms"), *rest)


def repetition_exact(rows: DataFrame, order: list[str], n: int = REPEATS) -> DataFrame:
    """Adds `repeated`: in a run of at least n equal normalised texts. Blank rows belong to the run before them."""
    w = Window.partitionBy("track_id").orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    r = rows.withColumn("_blank", trimmed(F.col("text")) == "").withColumn("_norm", F.when(~F.col("_blank"), normalised(F.col("text"))))
    last = F.last("_norm", ignorenulls=True).over(before)
    r = r.withColumn("_new", F.when(F.col("_blank"), 0).when(last.isNull() | (F.col("_norm") == "") | (last != F.col("_norm")), 1).otherwise(0)).withColumn("_run", F.sum("_new").over(w))
    count = F.sum((~F.col("_blank")).cast("int")).over(Window.partitionBy("track_id", "_run"))
    return r.withColumn("repeated", (F.col("_run") > 0) & (count >= n)).drop("_blank", "_norm", "_new", "_run")


def _long_runs(n: int, piece: int):
    """(first, last) place of a run of at least n rows that are not blank, at the row behind it or the track's last row.

    Reads rows as a window function gives them: a track at a time, in order; the places tell that none is missing. What is
    carried from row to row is the run's first text and its size.
    """

    @F.arrow_udf("struct<first:int,last:int>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        now, place, anchor, first, size = None, 0, None, None, 0
        for columns in batches:
            out = []
            for begin in range(0, len(columns[0]), piece):
                for track, at, norm, blank, end in zip(*(c.slice(begin, piece).to_pylist() for c in columns), strict=True):
                    if at == 1:
                        now, anchor, first, size = track, None, None, 0
                    elif track != now or at != place + 1:
                        raise ValueError(f"row {at} of track {track} is not after row {place} of track {now}")
                    place, found = at, None
                    if not (blank or (norm and anchor and (norm == anchor or (len(norm) > 10 and len(anchor) > 10 and (norm in anchor or anchor in norm))))):
                        found = (first, at - 1) if first is not None and size >= n else None
                        anchor, first, size = norm, at, 0
                    size += not blank
                    if end and first is not None and size >= n:
                        found = (first, at)
                    out.append(found and {"first": found[0], "last": found[1]})
            yield pa.array(out, pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    return run.asNondeterministic()  # what it gives depends on the rows before, so no filter may go below it


def repetition_fuzzy(rows: DataFrame, order: list[str], n: int = REPEATS, piece: int = PIECE_ROWS) -> DataFrame:
    """Adds `repeated`: a row joins a run if it equals the run's first text or, both over 10 characters, holds it or is held.

    Blank rows belong to the run before them. The fold is one pass over places and texts, sorted as for the window beside it,
    `piece` rows at a time, and gives only the runs that are long enough; all else stays where it is.
    """
    w = Window.partitionBy("track_id").orderBy(*order)
    placed = rows.withColumn("_ord", F.row_number().over(w))
    read = placed.select("track_id", "_ord", "text", F.lead(F.lit(1)).over(w).isNull().alias("_end"))
    found = read.select("track_id", _long_runs(n, piece)("track_id", "_ord", normalised(F.col("text")), F.coalesce(trimmed(F.col("text")) == "", F.lit(True)), "_end").alias("_r")).where("_r is not null")
    flags = found.select("track_id", F.explode(F.sequence("_r.first", "_r.last")).alias("_ord"), F.lit(True).alias("repeated"))
    return placed.join(flags, ["track_id", "_ord"], "left").na.fill(False, ["repeated"]).drop("_ord")


def with_rule(rows: DataFrame, repair: bool = False) -> DataFrame:
    """Adds rule_id: the number of the first rule that a segment with energies meets.

    What the rules measure of the text is worked out once a row. A rule on still lower log-probability stands after rule
    10 in the source of these rules; rules 2 and 7 have already taken all such rows, so it is left out.
    """
    ve, snr, lp, ratio, ns, text = (F.col(c) for c in ("vocal_u", "snr_milli", "logprob_c", "ratio_c", "nospeech_c", "text"))
    has = ve.isNotNull() & snr.isNotNull()
    yes = lambda c: has & F.coalesce(c, F.lit(False))
    silent, absent, noisy = yes(ve < VOCAL_U), yes(ve < SILENCE_U), yes(snr < SNR_MILLI)
    ok = has & ~silent & ~noisy
    rej = (F.coalesce(ns, F.lit(0)) > 80) | (F.coalesce(lp, F.lit(0)) < -150) | (F.coalesce(ratio, F.lit(0)) > 250)
    length, duration = F.col("_length"), F.col("end_ms") - F.col("start_ms")
    first, second = F.coalesce(F.get("_top", 0), F.lit(0)), F.coalesce(F.get("_top", 1), F.lit(0))
    loop = (length > 10) & ((first * 10 > length * 6) | ((length > 20) & ((first + second) * 100 > length * 85)))
    rule = F.when(F.coalesce(ratio, F.lit(0)) > 250, 1).when(rej & ok, 2).when(~rej & absent, 3).when(~rej & silent & (duration < 200), 4).when(~rej & silent & (F.length(text) > LONG_TEXT), 5)
    rule = rule.when(~rej & silent & yes(snr < 0), 6).when(rej, 7).when((F.col("start_ms") == 0) & (F.col("end_ms") > 15000) & (F.length(text) > 200), 8)
    rule = rule.when(length < 2, 9).when((length > 10) & (length * 1000 > 25 * F.greatest(duration, F.lit(100))), 10).when(loop, 11)
    if repair:
        rule = rule.when(trimmed(text).rlike("^(?:" + "|".join(OUTROS) + ")$"), 13)
    bare = _once(rows, effective(text).alias("_effective"))
    measured = _once(bare, F.length("_effective").alias("_length"), F.when(F.length("_effective") > 10, top_counts(F.col("_effective"))).alias("_top"))
    return _once(measured, rule.otherwise(14).alias("rule_id")).drop("_effective", "_length", "_top")


def _once(rows: DataFrame, *columns: Column) -> DataFrame:
    """Adds columns that are worked out once a row, however often a filter or other columns name them: nothing is pulled through a generator."""
    return rows.select("*", F.inline(F.array(F.struct(*columns))))


def classify(segments: DataFrame, repair: bool = False) -> DataFrame:
    """Adds rule_id, dropped and mismatch_type; a row that no rule takes keeps the mismatch_type it came with."""
    rows = with_rule(segments, repair)
    drops = [k for k, (drop, _) in RULES.items() if drop]
    own = F.col("mismatch_type") if "mismatch_type" in segments.columns else F.lit(None).cast("string")
    kind = F.when(F.col("rule_id") == 2, F.lit("uncertain")).when(F.col("rule_id").isin([k for k, (_, m) in RULES.items() if m == "hallucinated"]), F.lit("hallucinated"))
    return rows.withColumn("dropped", F.col("rule_id").isin(drops)).withColumn("mismatch_type", kind.when(F.col("rule_id") == 14, own))


def merge_same_start(rows: DataFrame, order: list[str]) -> DataFrame:
    """Neighbours that start in the same millisecond become one row; what has no rule comes from the first.

    Texts and arrays of words, where there are any, are joined in order.
    """
    w = Window.partitionBy("track_id").orderBy(*order)
    r = rows.withColumn("_ord", F.row_number().over(w)).withColumn("_new", F.when(F.lag("start_ms").over(w) == F.col("start_ms"), 0).otherwise(1)).withColumn("run", F.sum("_new").over(w))
    first = lambda c: F.min(F.struct("_ord", c))[c].alias(c)
    text = [F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_ord", "text"))), lambda x: x["text"]), "").alias("text")] if "text" in rows.columns else []
    words = [F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_ord", "words"))), lambda x: F.coalesce(x["words"], F.array()))).alias("words")] if "words" in rows.columns else []
    out = r.groupBy("track_id", "run").agg(*text, F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.min("logprob_c").alias("logprob_c"), F.max("ratio_c").alias("ratio_c"), F.max("nospeech_c").alias("nospeech_c"), F.max("vocal_u").alias("vocal_u"), F.min("snr_milli").alias("snr_milli"), first("other_u"), first("mismatch_type"), F.count("*").alias("n_merged"), *words)
    return out.withColumn("run", F.col("run").cast("long"))


def missed_blocks(windows: DataFrame, longest_ms: int = LONGEST_BLOCK_MS) -> DataFrame:
    """Blocks of active neighbours: a window that would end too far from the block's start begins the next block.

    Windows may have any lengths, with starts and ends in order. Only islands longer than a block are cut: each of their
    windows is linked with the one that would begin the block after it, and the chain of these links from the island's
    first window gives the blocks' starts. An island is never held in one row.
    """
    by = ["track_id", "island"]
    on = islands(windows, is_active()).select(*by, F.col("pos").alias("at"), F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"), "vocal_u", "snr_milli")
    whole = Window.partitionBy(*by)
    on = on.withColumn("_wide", F.max("end_ms").over(whole) - F.min("start_ms").over(whole) >= longest_ms)
    cut = stored(on.where("_wide").drop("_wide"))
    blocks = on.drop("_wide").withColumn("block", F.lit(0).cast("long"))
    if not cut.isEmpty():
        asked = cut.select(*by, (F.col("start_ms") + longest_ms).alias("_ms"), F.lit(1).alias("_asks"), "at", F.lit(None).cast("int").alias("_has"))
        given = cut.select(*by, F.col("end_ms").alias("_ms"), F.lit(0).alias("_asks"), "at", F.col("at").alias("_has"))
        later = Window.partitionBy(*by).orderBy(F.col("_ms").desc(), "_asks").rowsBetween(Window.unboundedPreceding, 0)
        links = asked.unionByName(given).withColumn("_next", F.min("_has").over(later)).where("_asks = 1 and _next is not null").withColumn("to", F.greatest("_next", F.col("at") + 1))
        links = links.join(given.select(*by, F.col("at").alias("to")), [*by, "to"], "left_semi")
        starts = reached(links, cut.where("at = 0"), by).withColumn("_first", F.lit(1))
        number = F.sum(F.coalesce("_first", F.lit(0))).over(Window.partitionBy(*by).orderBy("at")) - 1
        numbered = cut.join(starts, [*by, "at"], "left").withColumn("block", number.cast("long")).drop("_first")
        blocks = on.where("not _wide").drop("_wide").withColumn("block", F.lit(0).cast("long")).unionByName(numbered)
    mean = lambda c: (F.sum(c).cast("double") / F.count("*")).alias(c)
    return blocks.groupBy(*by, "block").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), mean("vocal_u"), mean("snr_milli"))


def missed_speech(windows: DataFrame, segments: DataFrame, leeway_ms: int = LEEWAY_MS) -> DataFrame:
    """Blocks that no segment overlaps or comes nearer to than the leeway."""
    b = bins(missed_blocks(windows), F.col("start_ms") - leeway_ms, F.col("end_ms") + leeway_ms + 1)
    s = bins(segments.select("track_id", F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e")).repartition("track_id").distinct(), F.col("_s"), F.col("_e") + 1, "_sbin").select("track_id", F.col("_sbin").alias("_bin"), "_s", "_e")
    near = ((F.col("_s") < F.col("end_ms")) & (F.col("_e") > F.col("start_ms"))) | (F.least(F.abs(F.col("start_ms") - F.col("_e")), F.abs(F.col("end_ms") - F.col("_s"))) < leeway_ms)
    met = b.join(s, ["track_id", "_bin"], "left").groupBy("track_id", "island", "block", "start_ms", "end_ms", "vocal_u", "snr_milli").agg(F.bool_or(F.coalesce(near, F.lit(False))).alias("_near"))
    return met.where("not _near").drop("_near")


def mismatch_log(flagged: DataFrame, missed: DataFrame) -> DataFrame:
    """track_id, kind, start_ms, end_ms, vocal_u, snr_milli, logprob_c: repeated, uncertain or hallucinated, missed."""
    kind = F.when(F.col("repeated"), F.lit("repeated")).otherwise(F.col("mismatch_type"))
    own = flagged.withColumn("kind", kind).where("kind is not null").select("track_id", "kind", "start_ms", "end_ms", "vocal_u", "snr_milli", "logprob_c")
    gone = missed.select("track_id", F.lit("missed").alias("kind"), "start_ms", "end_ms", "vocal_u", "snr_milli")
    return own.unionByName(gone, allowMissingColumns=True)


def _united(ranges: Column, gap: int, longest: int | None) -> Column:
    """Folds start-ordered ranges into merged ones: array of (start_ms, end_ms, reason). The open range is held apart."""
    kind = "array<struct<start_ms:bigint,end_ms:bigint,reason:string>>"
    fresh = lambda x: F.struct(x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"), x["reason"].alias("reason"))

    def add(state: Column, x: Column) -> Column:
        last = state["last"]
        fits = x["start_ms"] <= last["end_ms"] + gap
        if longest is not None:
            fits = fits & (x["end_ms"] - last["start_ms"] <= longest)
        reason = F.when(F.contains(last["reason"], x["reason"]), last["reason"]).otherwise(F.concat(last["reason"], F.lit("+"), x["reason"]))
        grown = F.struct(last["start_ms"].alias("start_ms"), F.greatest(last["end_ms"], x["end_ms"]).alias("end_ms"), reason.alias("reason"))
        return F.struct(F.when(fits, state["done"]).otherwise(F.concat(state["done"], F.array(last))).alias("done"), F.when(fits, grown).otherwise(fresh(x)).alias("last"))

    begin = F.struct(F.array().cast(kind).alias("done"), fresh(ranges[0]).alias("last"))
    return F.aggregate(F.slice(ranges, 2, F.size(ranges)), begin, add, lambda s: F.concat(s["done"], F.array(s["last"])))


def unite(ranges: DataFrame, order: list[str], gap: int, longest: int | None) -> DataFrame:
    """Merges ranges of a track in order. Cuts first where no merge can reach, so a fold sees one island."""
    w = Window.partitionBy("track_id").orderBy("start_ms", *order)
    reach = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = ranges.withColumn("_ord", F.row_number().over(w)).withColumn("_island", F.sum(F.when(F.col("start_ms") > reach + gap, 1).otherwise(0)).over(w))
    each = r.groupBy("track_id", "_island").agg(F.array_sort(F.collect_list(F.struct("_ord", F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"), "reason"))).alias("_r"))
    return each.select("track_id", F.explode(_united(F.col("_r"), gap, longest)).alias("x")).select("track_id", "x.start_ms", "x.end_ms", "x.reason")


def range_candidates(mismatches: DataFrame, kept: DataFrame) -> DataFrame:
    repeated = mismatches.where((F.col("kind") == "repeated") & (F.coalesce("vocal_u", F.lit(0.0)) > VOCAL_U)).select("track_id", "start_ms", "end_ms", F.lit("repetition_loop").alias("reason"), F.lit(0).alias("_kind"))
    missed = mismatches.where((F.col("kind") == "missed") & (F.col("end_ms") - F.col("start_ms") >= MIN_MISSED_MS)).select("track_id", "start_ms", "end_ms", F.lit("missed_speech").alias("reason"), F.lit(1).alias("_kind"))
    bad = kept.where((F.col("mismatch_type") == "uncertain") & (F.col("logprob_c") < BAD_LOGPROB)).select("track_id", "start_ms", "end_ms", F.lit("low_quality_signal").alias("reason"), F.lit(2).alias("_kind"))
    return repeated.unionByName(missed).unionByName(bad)


def repair_ranges(mismatches: DataFrame, kept: DataFrame) -> DataFrame:
    """track_id, start_ms, end_ms, reason: merged over gaps up to 8 s, up to 90 s long, then padded."""
    merged = unite(range_candidates(mismatches, kept), ["_kind", "end_ms"], MERGE_GAP_MS, MAX_RANGE_MS)
    return merged.select("track_id", F.greatest(F.col("start_ms") - PAD_MS, F.lit(0)).alias("start_ms"), (F.col("end_ms") + PAD_MS).alias("end_ms"), "reason")
