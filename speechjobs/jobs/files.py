"""Files of a collection, written from the tables and read again: queries and the same rows in SQL."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import subtitles, windows
from ..sources import files, fixtures, recordings
from ..sources.shared import ensure_checkpoint_dir, stored
from .clean import SCORED
from .repair import RANGES_SQL, TERMS, _numbered, _terms, _window_texts, merged_ranges
from .translate import _VTT, ATTEMPTS_SQL, MERGED, _LRC, _attempts, _entries, _merged


def _folder(spark: SparkSession) -> str:
    """A folder of its own in the one that all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


def _ordered(order: str, item: str):
    return F.transform(F.array_sort(F.collect_list(F.struct(order, item))), lambda x: x[item])


def _transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, w = fixtures.segments(spark, sf_dir), fixtures.words(spark, sf_dir)
    word = F.struct("text", (F.col("start_ms") / 1000).alias("start_time"), ((F.col("start_ms") + F.col("w_dur")) / 1000).alias("end_time"))
    words = w.withColumn("w", word).groupBy("track_id", "seg_idx").agg(_ordered("word_idx", "w").alias("words"))
    row = F.struct("text", (F.col("start_ms") / 1000).alias("start_time"), (F.col("end_ms") / 1000).alias("end_time"), "words", (F.col("logprob_c") / 100).alias("avg_logprob"), (F.col("ratio_c") / 100).alias("compression_ratio"), (F.col("nospeech_c") / 100).alias("no_speech_prob"))
    return s.join(words, ["track_id", "seg_idx"], "left").withColumn("s", row).groupBy(F.col("track_id").cast("string").alias("key")).agg(_ordered("seg_idx", "s").alias("segments"))


def _energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.struct((F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), (F.col("vocal_u") / 1e6).alias("vocal_rms"), (F.col("other_u") / 1e6).alias("other_rms"), (F.col("snr_milli") / 1000).alias("snr_db"))
    return fixtures.energy_windows(spark, sf_dir).withColumn("w", row).groupBy(F.col("track_id").cast("string").alias("key")).agg(_ordered("win_idx", "w").alias("windows"))


def _read_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files.write_bundle(_transcripts(spark, sf_dir), root := _folder(spark))
    return files.transcripts(spark, root, None)


def transcript_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = files.transcript_words(_read_transcripts(spark, sf_dir))
    ms = lambda c: F.floor(F.col(c) * 1000 + 0.5)
    return words.select(F.col("key").cast("long").alias("track_id"), F.col("seg_idx").cast("long").alias("seg_idx"), F.col("word_idx").cast("long").alias("word_idx"), "text", ms("start_time").alias("start_ms"), (ms("end_time") - ms("start_time")).alias("w_dur"))


def energy_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files.write_bundle(_energies(spark, sf_dir), root := _folder(spark))
    w = files.energy_windows(spark, root, None)
    return w.select(F.col("key").cast("long").alias("track_id"), F.col("win_idx").cast("long").alias("win_idx"), F.round(F.col("vocal_rms") * 1e6).cast("long").alias("vocal_u"), F.round(F.col("snr_db") * 1000).cast("long").alias("snr_milli"))


def attached_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both kinds of files, and their join."""
    files.write_bundle(_energies(spark, sf_dir), root := _folder(spark))
    out = files.attached(_read_transcripts(spark, sf_dir), files.energy_windows(spark, root, None))
    return out.withColumn("track_id", F.col("track_id").cast("long"))


def glossary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata in both shapes: extracted for even works, the user's own for odd ones."""
    t = _terms(spark, sf_dir).withColumn("p", F.struct("ja", "zh"))
    lists = t.groupBy("work_id").agg(*(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("ord", "p")))), lambda x: x["p"]).alias(k) for k in ("cv", "character", "term")))
    even, title = F.col("work_id") % 2 == 0, F.concat(F.lit("t"), F.col("work_id").cast("string"))
    extracted = F.when(even, F.struct(title.alias("title"), F.lit("s").alias("summary"), F.col("cv").alias("cv_mapping"), F.col("character").alias("character_mapping"), F.col("term").alias("term_mapping")))
    own = F.when(~even, F.struct(F.col("cv").alias("cvs"), F.col("character").alias("characters"), F.col("term").alias("terms")))
    files.write_bundle(lists.select(F.col("work_id").cast("string").alias("key"), extracted.alias("translate"), F.when(~even, title).alias("title"), own.alias("glossary")), root := _folder(spark))
    return files.glossary(spark, root, None).where("ja is not null").select(F.col("key").cast("long").alias("work_id"), "title", "summary", "kind", F.col("ord").cast("long").alias("ord"), "ja", "zh")


def _log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = merged_ranges(spark, sf_dir)
    span = F.struct((F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "reason")
    new = F.array(F.struct(F.lit("x").alias("text"), (F.col("start_ms") / 1000 + 0.5).alias("start_time"), (F.col("end_ms") / 1000).alias("end_time"), F.lit("qwen").alias("engine")))
    return r.select(F.col("track_id").cast("string").alias("key"), span.alias("range"), new.alias("newSegments"), F.when(F.col("start_ms") % 2 == 0, "success").otherwise("failed").alias("status"))


def repair_log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files.write_bundle(_log_entries(spark, sf_dir), root := _folder(spark))
    ms = lambda c: F.floor(c * 1000 + 0.5)
    log = files.repair_log(spark, root, None).withColumn("n", F.get("new_segments", 0))
    return log.select(F.col("key").cast("long").alias("track_id"), ms(F.col("range.start")).alias("r_start"), ms(F.col("range.end")).alias("r_end"), "range.reason", "status", ms(F.col("n.start_time")).alias("n_start"), "n.engine")


def repair_result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results in both shapes: an array with windows for even tracks, one object for odd ones."""
    s = fixtures.segments(spark, sf_dir)
    row = F.struct("text", (F.col("start_ms") / 1000).alias("start_time"), (F.col("end_ms") / 1000).alias("end_time"))
    each = s.withColumn("s", row).groupBy("track_id", F.floor(F.col("seg_idx") / 4).alias("part")).agg(_ordered("seg_idx", "s").alias("segments"))
    item = F.struct(F.array(F.col("part").cast("double"), F.col("part") + 0.5).alias("window"), "segments")
    listed = each.where("track_id % 2 = 0").withColumn("i", item).groupBy("track_id").agg(F.to_json(_ordered("part", "i")).alias("value"))
    one = s.where("track_id % 2 = 1").withColumn("s", row).groupBy("track_id").agg(F.to_json(F.struct(_ordered("seg_idx", "s").alias("segments"))).alias("value"))
    out = files.repair_results(listed.unionByName(one).withColumn("key", F.col("track_id").cast("string")), "mms")
    start = F.when(F.col("end") == float("inf"), -1.0).otherwise(F.col("start"))
    return out.select(F.col("key").cast("long").alias("track_id"), start.cast("long").alias("part"), F.col("segment.text").alias("text"), F.floor(F.col("segment.start_time") * 1000 + 0.5).alias("start_ms"), F.col("segment.engine").alias("engine"))


def glossary_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.glossary_text(_terms(spark, sf_dir), ["work_id"])


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request text of each window, by the template of its locale and mode."""
    texts = windows.transcript_json(_numbered(spark, sf_dir), ["track_id", "window_idx"])
    rows = texts.withColumn("locale", F.when(F.col("track_id") % 2 == 0, "zh-tw").otherwise("zh-cn")).withColumn("mode", F.when(F.col("window_idx") % 2 == 0, "base").otherwise("echo"))
    rows = rows.withColumn("track", F.concat(F.lit("track "), F.col("track_id").cast("string"))).withColumn("summary", F.lit(None).cast("string"))
    terms = _terms(spark, sf_dir)
    hits = windows.glossary_hits(_window_texts(spark, sf_dir), terms.where("kind = 'term'").select("work_id", "ja"))
    listed = windows.window_glossary(hits, terms)
    templates = spark.createDataFrame([(x, m, f"{x} {m}|{{track}}|{{summary}}|{{glossary}}|{{transcript}}") for x in ("zh-tw", "zh-cn") for m in ("base", "echo")], "locale string, mode string, template string")
    return files.requests(rows.join(listed, ["track_id", "window_idx"], "left"), templates, ("<user>", "<model>", "")).select("track_id", "window_idx", "request")


def written_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translation entries as JSON by work, read again."""
    e = _entries(spark, sf_dir).select((F.col("track_id") % 10).alias("work_id"), "track_id", F.array("global_id").alias("ids"), "input", "text", "start_ms", "end_ms")
    files.write_rows(e, root := _folder(spark), "work_id", "json")
    back = spark.read.schema("track_id long, ids array<long>, input string, text string, start_ms long, end_ms long, work_id long").json(root)
    return back.select("work_id", "track_id", F.get("ids", 0).alias("global_id"), "input", "text", "start_ms", "end_ms")


def written_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as Parquet by work, read again."""
    s = fixtures.segments(spark, sf_dir).withColumn("work_id", F.col("track_id") % 10)
    files.write_rows(s, root := _folder(spark), "work_id")
    return spark.read.parquet(root).select(F.col("work_id").cast("long").alias("work_id"), "track_id", "seg_idx", "text", "start_ms", "end_ms")


def lrc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtitle texts, one file a track, read again."""
    lines = subtitles.lrc_lines(_merged(spark, sf_dir), collapse=False)
    files.write_texts(lines.select((F.col("track_id") % 10).alias("work_id"), "track_id", F.col("lrc").alias("text")), root := _folder(spark))
    back = files.read_texts(spark, root)
    return back.select(F.col("work_id").cast("long").alias("work_id"), F.col("track_id").cast("long").alias("track_id"), "text")


def written_vtt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cue files, one a track, read again."""
    texts = subtitles.vtt_files(subtitles.vtt_cues(_merged(spark, sf_dir), collapse=False))
    files.write_texts(texts.select((F.col("track_id") % 10).alias("work_id"), "track_id", F.col("vtt").alias("text")), root := _folder(spark))
    return files.read_texts(spark, root).select(F.col("work_id").cast("long").alias("work_id"), F.col("track_id").cast("long").alias("track_id"), "text")


def recording_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file a track, written by tasks, listed again with its header: sound in two spellings, and notes that are none."""
    tracks = fixtures.segments(spark, sf_dir).groupBy("track_id").agg(F.max("end_ms").alias("n"))

    def contents(rows):
        for pdf in rows:
            parts = [recordings.wav(8000, 1 + t % 2, bytes(2 * (1 + t % 2) * (n // 1000))) if t % 3 < 2 else b"notes" for t, n in zip(pdf["track_id"], pdf["n"], strict=True)]
            names = [f"work {t // 16}/track.{t}{('.wav', '.WAV', '.txt')[t % 3]}" for t in pdf["track_id"]]
            yield pd.DataFrame({"rel_path": names, "content": parts})

    recordings.write_recordings(tracks.mapInPandas(contents, "rel_path string, content binary"), root := _folder(spark))
    out = recordings.with_headers(files.recordings(spark, root))
    work = F.regexp_extract("path", r"/work ([0-9]+)/", 1).cast("long")
    return out.select(work.alias("work_id"), "stem", "ext", "length", "rate", "channels", "length_ms")


def written_repair_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repair log by work, read again; a log without entries leaves no folder."""
    root = _folder(spark)
    log = _log_entries(spark, sf_dir).withColumn("work_id", F.col("key").cast("long") % 10).transform(stored)
    n = files.write_unless_empty(log, f"{root}/some", "work_id")
    none = files.write_unless_empty(log.where("status = 'skipped'"), f"{root}/none", "work_id")
    back = spark.read.schema(f"key string, range {files.RANGE}, status string, work_id long").json(f"{root}/some")
    ms = lambda c: F.floor(c * 1000 + 0.5)
    return back.select("work_id", F.col("key").cast("long").alias("track_id"), ms(F.col("range.start")).alias("r_start"), ms(F.col("range.end")).alias("r_end"), "status", F.lit(n).cast("long").alias("n_written"), F.lit(none).cast("long").alias("n_none"))


def written_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attempts of each window as JSON by track's work, read again."""
    attempts = _attempts(spark, sf_dir)[0]
    listed = attempts.groupBy("track_id", "window_idx").agg(F.array_sort(F.collect_list(F.struct("attempt", "chunk_idx", "ok"))).alias("attempts"))
    files.write_rows(listed.withColumn("work_id", F.col("track_id") % 10), root := _folder(spark), "work_id", "json")
    back = spark.read.schema("track_id long, window_idx long, attempts array<struct<attempt:long,chunk_idx:long,ok:boolean>>, work_id long").json(root)
    failed = F.filter("attempts", lambda x: ~x["ok"])
    return back.select("work_id", "track_id", "window_idx", F.size("attempts").cast("long").alias("n"), F.array_join(F.transform(failed, lambda x: F.concat_ws(":", x["attempt"].cast("string"), x["chunk_idx"].cast("string"))), ",").alias("failed"))


def incremental_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs: the first sees a part of the tracks, some in an older version; the second works out the rest. One run's rows."""
    root, segments = _folder(spark), fixtures.segments(spark, sf_dir)
    tracks = segments.select(F.floor(F.col("track_id") / 16).alias("work_id"), "track_id").distinct()
    version = lambda old: F.when(F.col("track_id") % old == 0, "0").otherwise("1")

    def make(left: DataFrame) -> DataFrame:
        rows = segments.join(left, "track_id").groupBy("work_id", "track_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
        return rows.withColumn("run", F.lit(now))

    now = 1
    files.run_incremental(tracks.where("work_id % 4 <> 3 and track_id % 64 <> 5").withColumn("version", version(96)), make, root)
    now = 2
    return files.run_incremental(tracks.withColumn("version", F.lit("1")), make, root).select("work_id", "track_id", "n", "chars", F.col("run").cast("long").alias("run"))


def repository_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", files.repository_name(F.col("url"), "https://").alias("name"))


QUERIES = {
    "transcript_files": transcript_files,
    "energy_files": energy_files,
    "attached_files": attached_files,
    "glossary_files": glossary_files,
    "repair_log_files": repair_log_files,
    "repair_result_files": repair_result_files,
    "glossary_json": glossary_json,
    "requests": requests,
    "written_entries": written_entries,
    "written_segments": written_segments,
    "lrc_files": lrc_files,
    "written_vtt": written_vtt,
    "recording_files": recording_files,
    "written_repair_log": written_repair_log,
    "written_attempts": written_attempts,
    "incremental_run": incremental_run,
    "repository_names": repository_names,
}

_GLOSSARY = " || ".join(["'{' || chr(10) || '  \"cvs\": '", "max(l) FILTER (kind = 'cv')", "',' || chr(10) || '  \"characters\": '", "max(l) FILTER (kind = 'character')", "',' || chr(10) || '  \"terms\": '", "max(l) FILTER (kind = 'term')", "chr(10) || '}'"])
for _k in ("cv", "character", "term"):
    _GLOSSARY = _GLOSSARY.replace(f"max(l) FILTER (kind = '{_k}')", f"coalesce('[' || chr(10) || max(l) FILTER (kind = '{_k}') || chr(10) || '  ]', '[]')")

ORACLE = {
    "transcript_files": fixtures.DUCK + " SELECT track_id, seg_idx, word_idx, text, start_ms, w_dur FROM words",
    "energy_files": fixtures.DUCK + " SELECT track_id, win_idx, vocal_u, snr_milli FROM energy_windows",
    "attached_files": fixtures.DUCK + SCORED + " SELECT * FROM scored",
    "glossary_files": fixtures.DUCK + TERMS + """ SELECT work_id, 't' || work_id AS title, CASE WHEN work_id % 2 = 0 THEN 's' ELSE '' END AS summary, kind, row_number() OVER (PARTITION BY work_id, kind ORDER BY ord) - 1 AS ord, ja, zh FROM terms_""",
    "repair_log_files": fixtures.DUCK + RANGES_SQL + " SELECT track_id, start_ms AS r_start, end_ms AS r_end, reason, CASE WHEN start_ms % 2 = 0 THEN 'success' ELSE 'failed' END AS status, start_ms + 500 AS n_start, 'qwen' AS engine FROM mr_",
    "repair_result_files": fixtures.DUCK + " SELECT track_id, CASE WHEN track_id % 2 = 0 THEN seg_idx // 4 ELSE -1 END AS part, text, start_ms, 'mms' AS engine FROM segments",
    "glossary_json": fixtures.DUCK + TERMS + f""",
gj AS (SELECT work_id, kind, string_agg('    {{' || chr(10) || '      "ja": ' || to_json(ja)::VARCHAR || ',' || chr(10) || '      "zh": ' || to_json(zh)::VARCHAR || chr(10) || '    }}', ',' || chr(10) ORDER BY ord) AS l FROM terms_ GROUP BY ALL)
SELECT work_id, {_GLOSSARY} AS glossary FROM gj GROUP BY work_id""",
    "requests": fixtures.DUCK + fixtures.derived_sql("entries") + TERMS + f""",
t AS (SELECT track_id, window_idx, string_agg(input, '' ORDER BY local_id) AS text FROM entries GROUP BY ALL),
gk AS (SELECT track_id, window_idx, kind, string_agg('    {{' || chr(10) || '      "ja": ' || to_json(ja)::VARCHAR || ',' || chr(10) || '      "zh": ' || to_json(zh)::VARCHAR || chr(10) || '    }}', ',' || chr(10) ORDER BY ord) AS l
  FROM t JOIN terms_ g ON g.work_id = t.track_id // 16 AND (kind <> 'term' OR contains(text, ja)) GROUP BY ALL),
h AS (SELECT track_id, window_idx, {_GLOSSARY} AS glossary FROM gk GROUP BY ALL),
m AS (SELECT *, max(local_id) OVER (PARTITION BY track_id, window_idx) AS last FROM entries),
j AS (SELECT track_id, window_idx, '[' || chr(10) || string_agg('  {{"id": ' || lpad(local_id::VARCHAR, len(last::VARCHAR)::INT, ' ') || ', "text": ' || to_json(input)::VARCHAR || ', "start": ' || start_ms || ', "end": ' || end_ms || '}}', ',' || chr(10) ORDER BY local_id) || chr(10) || ']' AS transcript FROM m GROUP BY ALL)
SELECT track_id, window_idx, '<user>' || CASE WHEN track_id % 2 = 0 THEN 'zh-tw' ELSE 'zh-cn' END || ' ' || CASE WHEN window_idx % 2 = 0 THEN 'base' ELSE 'echo' END || '|track ' || track_id || '||' || coalesce(glossary, '{{' || chr(10) || '  "cvs": [],' || chr(10) || '  "characters": [],' || chr(10) || '  "terms": []' || chr(10) || '}}') || '|' || transcript || '<model>' AS request
FROM j LEFT JOIN h USING (track_id, window_idx)""",
    "written_entries": fixtures.DUCK + fixtures.derived_sql("entries") + " SELECT track_id % 10 AS work_id, track_id, global_id, input, text, start_ms, end_ms FROM entries",
    "written_segments": fixtures.DUCK + " SELECT track_id % 10 AS work_id, track_id, seg_idx, text, start_ms, end_ms FROM segments",
    "lrc_files": MERGED + f""", n AS (SELECT *, lead(start_ms) OVER (PARTITION BY track_id ORDER BY run) AS nx FROM em)
SELECT track_id % 10 AS work_id, track_id, string_agg({_LRC.format('start_ms')} || text || CASE WHEN nx - end_ms > 2000 THEN chr(10) || {_LRC.format('end_ms')} ELSE '' END, chr(10) ORDER BY run) || chr(10) AS text FROM n GROUP BY track_id""",
    "written_vtt": MERGED + f""", vc AS (SELECT track_id, run, row_number() OVER (PARTITION BY track_id ORDER BY run) || chr(10) || {_VTT.format('start_ms')} || ' --> ' || {_VTT.format('end_ms')} || chr(10) || text || chr(10) AS b FROM em)
SELECT track_id % 10 AS work_id, track_id, 'WEBVTT' || chr(10) || chr(10) || string_agg(b, chr(10) ORDER BY run) AS text FROM vc GROUP BY track_id""",
    "recording_files": fixtures.DUCK + """, rn AS (SELECT track_id, max(end_ms) // 1000 AS k FROM segments GROUP BY ALL)
SELECT track_id // 16 AS work_id, 'track.' || track_id AS stem, 'wav' AS ext, 44 + 2 * (1 + track_id % 2) * k AS length, 8000::BIGINT AS rate, 1 + track_id % 2 AS channels, k * 1000 // 8000 AS length_ms FROM rn WHERE track_id % 3 < 2""",
    "written_repair_log": fixtures.DUCK + RANGES_SQL + " SELECT track_id % 10 AS work_id, track_id, start_ms AS r_start, end_ms AS r_end, CASE WHEN start_ms % 2 = 0 THEN 'success' ELSE 'failed' END AS status, count(*) OVER () AS n_written, 0::BIGINT AS n_none FROM mr_",
    "written_attempts": fixtures.DUCK + fixtures.derived_sql("entries") + ATTEMPTS_SQL + " SELECT track_id % 10 AS work_id, track_id, window_idx, count(*) AS n, coalesce(string_agg(attempt || ':' || chunk_idx, ',' ORDER BY attempt, chunk_idx) FILTER (NOT ok), '') AS failed FROM at_ GROUP BY ALL",
    "incremental_run": fixtures.DUCK + """, ir AS (SELECT track_id // 16 AS work_id, track_id, count(*) AS n, sum(len(text))::BIGINT AS chars FROM segments GROUP BY ALL),
iw AS (SELECT work_id, bool_or(track_id % 64 = 5 OR track_id % 96 = 0 OR work_id % 4 = 3) AS again FROM ir GROUP BY work_id)
SELECT ir.work_id, track_id, n, chars, CASE WHEN again THEN 2 ELSE 1 END::BIGINT AS run FROM ir JOIN iw USING (work_id)""",
    "repository_names": "SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN substr(url, 9) ELSE url END AS name FROM pages",
}
