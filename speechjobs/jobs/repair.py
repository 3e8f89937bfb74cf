"""Repair of ranges and windows for translation: queries and the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import clean, repair, windows
from ..sources import fixtures
from ..sources.shared import stored
from .clean import DROPS, MISMATCH, SCORED, rules_sql, scored_segments, united_sql

PROMPT_CHARS = 500  # length of the caller's template without what is filled in


def merged_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.merge_ranges(fixtures.derived(spark, sf_dir, "raw_ranges"), ["seg_idx"])


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written, as more than one thing is made from it."""
    return stored(clean.classify(scored_segments(spark, sf_dir)))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows for each range, in its first half and near its end, from one of two engines."""
    r = merged_ranges(spark, sf_dir).select("track_id", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"), F.floor(F.col("start_ms") / 100).alias("range_idx"))
    part = lambda n: F.floor((F.col("r_end") - F.col("r_start")) / n)
    candidate = lambda i, start, end: F.struct(F.lit(i).cast("long").alias("cand_idx"), start.alias("start_ms"), end.alias("end_ms"))
    cut = F.explode(F.array(candidate(0, F.col("r_start") + part(4), F.col("r_start") + part(2)), candidate(1, F.col("r_end") - part(3), F.col("r_end") - part(8))))
    c = r.select("*", cut.alias("c")).select("track_id", "range_idx", "r_start", "r_end", "c.*")
    kind = (F.col("range_idx") + F.col("cand_idx")) % 4
    text = F.when(kind == 0, "ab").when(kind == 1, "またね。").when(kind == 2, "いってきます").otherwise("あ")
    return c.withColumn("engine", F.when(F.col("range_idx") % 2 == 0, "mms").otherwise("qwen")).withColumn("text", text).withColumn("logprob_c", F.lit(-40).cast("long")).withColumn("ratio_c", F.lit(120).cast("long")).withColumn("nospeech_c", F.lit(10).cast("long"))


def judged(spark: SparkSession, sf_dir: str, classified: DataFrame | None = None) -> DataFrame:
    rows = classified if classified is not None else clean.classify(scored_segments(spark, sf_dir))
    return stored(repair.judge(_candidates(spark, sf_dir), fixtures.energy_windows(spark, sf_dir), rows.where("not dropped and mismatch_type is null")))


def _with_engine(spark: SparkSession, sf_dir: str, classified: DataFrame) -> DataFrame:
    return classified.where("not dropped or mismatch_type is not null").join(fixtures.derived(spark, sf_dir, "engines"), ["track_id", "seg_idx"])


def _mismatches(classified: DataFrame) -> DataFrame:
    return classified.where("mismatch_type is not null").select("track_id", F.col("seg_idx").alias("mismatch_idx"), "start_ms", "end_ms", "mismatch_type")


def apply_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _classified(spark, sf_dir)
    return repair.apply_repair(_with_engine(spark, sf_dir, rows), judged(spark, sf_dir, rows))


def repair_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _classified(spark, sf_dir)
    return repair.apply_repair_log(_mismatches(rows), judged(spark, sf_dir, rows))


def repair_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of unmerged ranges, which may overlap, with two new rows each; every fourth entry failed."""
    r = fixtures.derived(spark, sf_dir, "raw_ranges")
    new = lambda a, b, text: F.struct(a.cast("long").alias("start_ms"), b.cast("long").alias("end_ms"), F.concat(F.lit(text), F.col("seg_idx").cast("string")).alias("text"), F.lit("qwen").alias("engine"))
    rows = F.array(new(F.col("start_ms"), F.col("start_ms") + 400, "a"), new(F.col("end_ms") - 300, F.col("end_ms") + 900, "b"))
    status = F.when(F.col("seg_idx") % 4 == 3, "failed").otherwise("success")
    return r.select("track_id", F.col("seg_idx").alias("log_idx"), (F.col("start_ms") - 2000).alias("r_start"), (F.col("end_ms") + 2000).alias("r_end"), status.alias("status"), rows.alias("new_segments"))


def replayed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _classified(spark, sf_dir)
    return repair.replay_log(_with_engine(spark, sf_dir, rows), _mismatches(rows), repair_log(spark, sf_dir))


def _sent_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged_ranges(spark, sf_dir).select("track_id", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))


def results_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a track's ranges by their number; every segment stands for a result."""
    r = fixtures.segments(spark, sf_dir).select("track_id", F.col("seg_idx").alias("ordinal"), "text")
    return repair.assign_by_order(_sent_ranges(spark, sf_dir), r)


def results_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.segments(spark, sf_dir).select("track_id", "seg_idx", "start_ms", "end_ms")
    return repair.assign_by_time(_sent_ranges(spark, sf_dir), rows)


def _work(track: str = "track_id"):
    """Works are of sixteen tracks."""
    return F.floor(F.col(track) / 16)


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A work's glossary: the first word of eight letters or more in each of its lines; each tenth is a name. Written."""
    s = fixtures.segments(spark, sf_dir).select(_work().alias("work_id"), F.regexp_extract("text", r"([^\s。、]{8,})", 1).alias("ja")).where("ja <> ''").distinct()
    ranked = s.withColumn("ord", F.dense_rank().over(Window.partitionBy("work_id").orderBy("ja")).cast("long"))
    kind = F.when(F.col("ord") % 20 == 0, "cv").when(F.col("ord") % 20 == 1, "character").otherwise("term")
    return ranked.select("work_id", kind.alias("kind"), "ja", F.reverse("ja").alias("zh"), "ord").transform(stored)


def budget_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = windows.translation_segments(fixtures.segments(spark, sf_dir), ["start_ms", "seg_idx"]).withColumn("work_id", _work()).transform(stored)
    glossary = _terms(spark, sf_dir)
    terms = glossary.where("kind = 'term'").select("work_id", F.col("ord").alias("term_id"), "ja", F.length(windows.glossary_entry(F.col("ja"), F.col("zh"))).cast("long").alias("chars"))
    places = windows.term_places(s, terms).groupBy("track_id", "id").agg(F.collect_list(F.struct(F.col("term_id").alias("id"), "chars", "first")).alias("terms"))
    rows = s.withColumn("base", windows.json_base(F.col("text"), F.col("start_ms"), F.col("end_ms"))).join(places, ["track_id", "id"], "left").join(windows.glossary_overhead(glossary), "work_id", "left")
    name, summary = F.concat(F.lit("track "), F.col("track_id").cast("string")), F.concat(F.lit("summary of "), F.col("work_id").cast("string"))
    return windows.budget_windows(rows.withColumn("overhead", windows.prompt_overhead(PROMPT_CHARS, name, summary, F.col("chars"))))


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.derived(spark, sf_dir, "entries").select("track_id", "window_idx", "local_id", F.col("input").alias("text"), "start_ms", "end_ms")


def _window_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("local_id", "text"))), lambda x: x["text"]), "")
    return _numbered(spark, sf_dir).groupBy("track_id", "window_idx").agg(joined.alias("text")).withColumn("work_id", _work())


def glossary_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = _terms(spark, sf_dir)
    hits = windows.glossary_hits(_window_texts(spark, sf_dir), terms.where("kind = 'term'").select("work_id", "ja"))
    return windows.window_entries(hits, terms)


def glossary_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.glossary_names(_terms(spark, sf_dir)).withColumn("names", F.array_join("names", "\n"))


def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _numbered(spark, sf_dir).groupBy("track_id", "window_idx").agg(F.count("*").alias("n"), (F.sum(F.length("text")) + 900).alias("chars"))
    return n.select("track_id", "window_idx", windows.token_budget(F.col("n"), F.col("chars")).cast("long").alias("n_predict"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.segments(spark, sf_dir).groupBy("track_id").agg((F.max("end_ms") * 16).alias("n_samples"))


QUERIES = {
    "merge_ranges": merged_ranges,
    "speech_clusters": lambda spark, sf_dir: repair.speech_clusters(merged_ranges(spark, sf_dir), fixtures.energy_windows(spark, sf_dir)),
    "range_members": lambda spark, sf_dir: repair.range_members(merged_ranges(spark, sf_dir), fixtures.segments(spark, sf_dir)).select("track_id", "seg_idx", "r_start", "r_end"),
    "new_ranges": lambda spark, sf_dir: repair.new_ranges(fixtures.derived(spark, sf_dir, "raw_ranges"), fixtures.derived(spark, sf_dir, "second_ranges")),
    "repair_filter": lambda spark, sf_dir: judged(spark, sf_dir).select("track_id", "range_idx", "cand_idx", "engine", "text", "rule_id", "accepted"),
    "apply_repair": apply_repair,
    "repair_mismatches": repair_mismatches,
    "replay_log": lambda spark, sf_dir: replayed(spark, sf_dir)[0],
    "replay_mismatches": lambda spark, sf_dir: replayed(spark, sf_dir)[1],
    "results_by_order": results_by_order,
    "results_by_time": results_by_time,
    "repair_outcome": lambda spark, sf_dir: repair.repair_outcome(merged_ranges(spark, sf_dir), judged(spark, sf_dir)),
    "tr_segments": lambda spark, sf_dir: windows.translation_segments(fixtures.segments(spark, sf_dir), ["start_ms", "seg_idx"]).select("track_id", "id", "seg_idx", "start_ms", "end_ms"),
    "glossary_hits": glossary_hits,
    "glossary_names": glossary_names,
    "budget_windows": budget_windows,
    "token_budget": token_budget,
    "transcript_json": lambda spark, sf_dir: windows.transcript_json(_numbered(spark, sf_dir), ["track_id", "window_idx"]),
    "chunk_plan": lambda spark, sf_dir: windows.chunk_plan(_samples(spark, sf_dir), 480_000, 400_000, 800),
    "retry_split": lambda spark, sf_dir: windows.retry_split(_numbered(spark, sf_dir), ["track_id", "window_idx"]).select("track_id", "window_idx", "local_id", "half", "pair"),
}

RANGES_SQL = fixtures.derived_sql("raw_ranges") + ", ro AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY start_ms, seg_idx) AS ord FROM raw_ranges)" + united_sql("ro", "mr_", 0, None)
MERGED = fixtures.DUCK + RANGES_SQL
_C = r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}\x{FF66}-\x{FF9F}]"
_W = r"[A-Za-z0-9_\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}\x{FF66}-\x{FF9F}]"
JUDGED_SQL = RANGES_SQL + f"{rules_sql('scored', p='c')}, classified AS (SELECT *, {DROPS} AS dropped, {MISMATCH.format('')} AS mismatch_type FROM cruled)" + """,
rg AS (SELECT track_id, start_ms AS r_start, end_ms AS r_end, start_ms // 100 AS range_idx FROM mr_),
cd AS (SELECT *, 0 AS cand_idx, r_start + (r_end - r_start) // 4 AS start_ms, r_start + (r_end - r_start) // 2 AS end_ms FROM rg UNION ALL SELECT *, 1, r_end - (r_end - r_start) // 3, r_end - (r_end - r_start) // 8 FROM rg),
ct AS (SELECT *, CASE WHEN range_idx % 2 = 0 THEN 'mms' ELSE 'qwen' END AS engine, CASE (range_idx + cand_idx) % 4 WHEN 0 THEN 'ab' WHEN 1 THEN 'またね。' WHEN 2 THEN 'いってきます' ELSE 'あ' END AS text, -40 AS logprob_c, 120 AS ratio_c, 10 AS nospeech_c FROM cd),
ce AS (SELECT c.*, e.vocal_u, e.snr_milli FROM ct c LEFT JOIN (SELECT c.track_id, c.range_idx, c.cand_idx, sum(w.vocal_u)::DOUBLE / count(*) AS vocal_u, sum(w.snr_milli)::DOUBLE / count(*) AS snr_milli
  FROM ct c JOIN energy_windows w ON w.track_id = c.track_id AND w.start_ms < c.end_ms AND w.end_ms > c.start_ms GROUP BY ALL) e USING (track_id, range_idx, cand_idx))""" + rules_sql("ce", True, "j") + f""",
judged AS (SELECT track_id, range_idx, cand_idx, r_start, r_end, start_ms, end_ms, engine, CASE WHEN engine = 'mms' AND regexp_full_match(text, '[A-Za-z]{{1,2}}') THEN '' ELSE text END AS text, rule_id,
  NOT (CASE WHEN engine = 'mms' THEN (len(regexp_extract_all(text, '{_C}')) < 2 AND len(regexp_extract_all(text, '{_W}')) < 2) OR coalesce(vocal_u, 0) < 50 ELSE {DROPS} END)
  AND NOT EXISTS (SELECT 1 FROM classified g WHERE g.track_id = j.track_id AND NOT g.dropped AND g.mismatch_type IS NULL AND g.start_ms < j.end_ms AND g.end_ms > j.start_ms AND g.start_ms < j.r_end AND g.end_ms > j.r_start) AS accepted FROM jruled j)"""
JUDGED = fixtures.DUCK + SCORED + JUDGED_SQL
OUTCOME_SQL = """ SELECT r.track_id, r.start_ms, r.end_ms, count(j.track_id) AS n_new, coalesce(sum(j.accepted::INT), 0)::BIGINT AS n_accepted, CASE WHEN count(j.track_id) = 0 THEN 'no_change' WHEN sum(j.accepted::INT) > 0 THEN 'success' ELSE 'failed' END AS status
  FROM mr_ r LEFT JOIN judged j ON j.track_id = r.track_id AND j.r_start = r.start_ms AND j.r_end = r.end_ms GROUP BY r.track_id, r.start_ms, r.end_ms"""
ENTRIES = fixtures.DUCK + fixtures.derived_sql("entries")
TERMS = r""",
tg AS (SELECT DISTINCT track_id // 16 AS work_id, regexp_extract(text, '([^\s。、]{8,})', 1) AS ja FROM segments),
tr AS (SELECT work_id, ja, dense_rank() OVER (PARTITION BY work_id ORDER BY ja) AS ord FROM tg WHERE ja <> ''),
terms_ AS (SELECT work_id, CASE ord % 20 WHEN 0 THEN 'cv' WHEN 1 THEN 'character' ELSE 'term' END AS kind, ja, reverse(ja) AS zh, ord FROM tr)"""

ORACLE = {
    "merge_ranges": MERGED + " SELECT * FROM mr_",
    "speech_clusters": MERGED + """,
o AS (SELECT r.track_id, r.start_ms AS r_start, r.end_ms AS r_end, w.start_ms AS s, least(w.end_ms, r.end_ms) AS e FROM mr_ r JOIN energy_windows w ON w.track_id = r.track_id AND w.start_ms < r.end_ms AND w.end_ms > r.start_ms WHERE vocal_u >= 1000 AND snr_milli >= 2000),
l AS (SELECT *, lag(e) OVER (PARTITION BY track_id, r_start, r_end ORDER BY s) AS pe FROM o),
k AS (SELECT *, sum(CASE WHEN s > pe + 1200 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id, r_start, r_end ORDER BY s ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM l),
c AS (SELECT track_id, r_start, r_end, cluster, greatest(r_start, greatest(min(s), r_start) - 200)::DOUBLE AS s, least(r_end, arg_max(e, s) + 200)::DOUBLE AS e FROM k GROUP BY track_id, r_start, r_end, cluster),
d AS (SELECT *, CASE WHEN e - s < 1500 THEN greatest(r_start::DOUBLE, (s + e) / 2 - 750) ELSE s END AS start_ms FROM c)
SELECT track_id, r_start, r_end, cluster, start_ms, CASE WHEN e - s < 1500 THEN least(r_end::DOUBLE, start_ms + 1500) ELSE e END AS end_ms FROM d""",
    "range_members": MERGED + " SELECT s.track_id, s.seg_idx, r.start_ms AS r_start, r.end_ms AS r_end FROM mr_ r JOIN segments s ON s.track_id = r.track_id AND s.start_ms >= r.start_ms AND s.end_ms <= r.end_ms",
    "new_ranges": fixtures.DUCK + fixtures.derived_sql("raw_ranges") + fixtures.derived_sql("second_ranges") + """ SELECT track_id, start_ms, end_ms, reason FROM raw_ranges
  UNION ALL SELECT track_id, start_ms, end_ms, reason FROM second_ranges b WHERE NOT EXISTS (SELECT 1 FROM raw_ranges a WHERE a.track_id = b.track_id AND (a.start_ms + 50) // 100 = (b.start_ms + 50) // 100 AND (a.end_ms + 50) // 100 = (b.end_ms + 50) // 100)""",
    "repair_filter": JUDGED + " SELECT track_id, range_idx, cand_idx, engine, text, rule_id, accepted FROM judged",
    "apply_repair": JUDGED + fixtures.derived_sql("engines") + """ SELECT s.track_id, start_ms, end_ms, text, coalesce(g.engine, 'first') AS origin FROM classified s JOIN engines g ON g.track_id = s.track_id AND g.seg_idx = s.seg_idx WHERE (NOT dropped OR mismatch_type IS NOT NULL) AND ((mismatch_type IS NULL AND g.engine IS NULL) OR NOT EXISTS (SELECT 1 FROM judged j WHERE j.accepted AND j.track_id = s.track_id AND s.start_ms < j.r_end AND s.end_ms > j.r_start))
  UNION ALL SELECT track_id, start_ms, end_ms, text, engine FROM judged WHERE accepted""",
    "repair_mismatches": JUDGED + " SELECT track_id, seg_idx AS mismatch_idx, start_ms, end_ms, mismatch_type FROM classified s WHERE mismatch_type IS NOT NULL AND NOT EXISTS (SELECT 1 FROM judged j WHERE j.accepted AND j.track_id = s.track_id AND s.start_ms < j.r_end AND s.end_ms > j.r_start)",
    "results_by_order": MERGED + """, rn AS (SELECT track_id, start_ms AS r_start, end_ms AS r_end, row_number() OVER (PARTITION BY track_id ORDER BY start_ms, end_ms) - 1 AS ordinal FROM mr_)
SELECT rn.track_id, rn.ordinal, r_start, r_end, s.text FROM rn JOIN segments s ON s.track_id = rn.track_id AND s.seg_idx = rn.ordinal""",
    "results_by_time": MERGED + " SELECT s.track_id, s.seg_idx, s.start_ms, s.end_ms, r.start_ms AS r_start, r.end_ms AS r_end FROM mr_ r JOIN segments s ON s.track_id = r.track_id AND s.start_ms >= r.start_ms - 500 AND s.end_ms <= r.end_ms + 500",
    "repair_outcome": JUDGED + OUTCOME_SQL,
    "tr_segments": fixtures.DUCK + " SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY start_ms, seg_idx) AS id, seg_idx, start_ms, end_ms FROM segments",
    "glossary_hits": ENTRIES + TERMS + """,
t AS (SELECT track_id, window_idx, track_id // 16 AS work_id, string_agg(input, '' ORDER BY local_id) AS text FROM entries GROUP BY ALL)
SELECT t.work_id, track_id, window_idx, kind, ja FROM t LEFT JOIN terms_ g ON g.work_id = t.work_id AND (kind <> 'term' OR contains(text, ja))""",
    "glossary_names": fixtures.DUCK + TERMS + " SELECT work_id, string_agg(ja, chr(10) ORDER BY ja) AS names FROM terms_ WHERE kind <> 'term' GROUP BY work_id",
    "budget_windows": fixtures.DUCK + TERMS + f""",
few AS (SELECT *, 38 + len(to_json(ja)::VARCHAR) + len(to_json(zh)::VARCHAR) AS chars FROM terms_),
names AS (SELECT work_id, sum(CASE WHEN n > 0 THEN c + 2 * n + 2 ELSE 0 END)::BIGINT AS more FROM (SELECT work_id, kind, count(*) AS n, sum(chars) AS c FROM few WHERE kind <> 'term' GROUP BY ALL) GROUP BY ALL),
b AS MATERIALIZED (SELECT s.track_id, track_id // 16 AS work_id, row_number() OVER (PARTITION BY track_id ORDER BY start_ms, seg_idx) AS id, text, len(to_json(text)::VARCHAR) + len(start_ms::VARCHAR) + len(end_ms::VARCHAR) + 40 AS base,
  {PROMPT_CHARS} + 6 + len(track_id::VARCHAR) + 11 + len((track_id // 16)::VARCHAR) + 2 + {windows.EMPTY_GLOSSARY} + coalesce((SELECT more FROM names n WHERE n.work_id = track_id // 16), 0) AS overhead FROM segments s),
tl AS MATERIALIZED (SELECT work_id, list(ja) AS jas, list(chars + 2) AS costs FROM few WHERE kind = 'term' GROUP BY ALL),
g AS (SELECT track_id, id, 0 AS window_idx, 1 AS local_id, base AS total, text AS txt FROM b WHERE id = 1
  UNION ALL SELECT g.track_id, b.id, g.window_idx + m.cut, CASE WHEN m.cut = 1 THEN 1 ELSE g.local_id + 1 END, CASE WHEN m.cut = 1 THEN b.base ELSE g.total + b.base END, CASE WHEN m.cut = 1 THEN b.text ELSE g.txt || b.text END
  FROM g JOIN b ON b.track_id = g.track_id AND b.id = g.id + 1 LEFT JOIN tl ON tl.work_id = b.work_id,
  LATERAL (SELECT coalesce(list_sum([CASE WHEN contains(g.txt || b.text, tl.jas[i]) THEN tl.costs[i] ELSE 0 END FOR i IN range(1, len(tl.jas) + 1)]), 0) AS terms) h,
  LATERAL (SELECT (g.local_id >= 3 AND b.overhead + h.terms + CASE WHEN h.terms > 0 THEN 2 ELSE 0 END + g.total + b.base + (g.local_id + 1) * len(b.id::VARCHAR) + 2 * g.local_id + 4 > 2500)::INT AS cut) m)
SELECT track_id, id, window_idx, local_id FROM g QUALIFY count(*) OVER (PARTITION BY track_id, window_idx) >= 3""",
    "token_budget": ENTRIES + """, n AS (SELECT track_id, window_idx, count(*) AS n, greatest(1, ceil((sum(len(input)) + 900) / 2)) AS p FROM entries GROUP BY ALL)
SELECT track_id, window_idx, greatest(1, least(512 * n, ceil(p * 3.5), greatest(0, 8192 - p), greatest(0, 4096 - p)))::BIGINT AS n_predict FROM n""",
    "transcript_json": ENTRIES + """, m AS (SELECT *, max(local_id) OVER (PARTITION BY track_id, window_idx) AS last FROM entries)
SELECT track_id, window_idx, '[' || chr(10) || string_agg('  {"id": ' || lpad(local_id::VARCHAR, len(last::VARCHAR)::INT, ' ') || ', "text": ' || to_json(input)::VARCHAR || ', "start": ' || start_ms || ', "end": ' || end_ms || '}', ',' || chr(10) ORDER BY local_id) || chr(10) || ']' AS transcript FROM m GROUP BY ALL""",
    "chunk_plan": fixtures.DUCK + """, n AS (SELECT track_id, max(end_ms) * 16 AS n FROM segments GROUP BY ALL), c AS (SELECT track_id, n, unnest(range(0, (n + 399999) // 400000)) AS chunk_idx FROM n WHERE n > 0)
SELECT track_id, chunk_idx, chunk_idx * 400000 AS start, least(chunk_idx * 400000 + 480000, n) AS "end" FROM c WHERE least(chunk_idx * 400000 + 480000, n) - chunk_idx * 400000 >= 800""",
    "retry_split": ENTRIES + " SELECT track_id, window_idx, local_id, CASE WHEN local_id <= ceil(count(*) OVER (PARTITION BY track_id, window_idx) / 2) THEN 0 ELSE 1 END AS half, (local_id - 1) // 2 AS pair FROM entries",
}
