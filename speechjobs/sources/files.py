"""Reading and writing the files of a collection: recordings, transcripts, loudness, logs, results, subtitles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.energy import energy_join
from ..operators.report import stale_works
from .recordings import write_recordings

BROADCAST_TEMPLATES = 1000
MANIFEST = "work_id long, track_id long, version string"
EXTENSIONS = ["mp3", "wav", "flac", "m4a", "ogg", "opus", "aac"]
WORD = "struct<text:string,start_time:double,end_time:double>"
SEGMENT = f"struct<text:string,start_time:double,end_time:double,words:array<{WORD}>,avg_logprob:double,compression_ratio:double,no_speech_prob:double,engine:string>"
TRANSCRIPT = f"full_text string, sentences array<{WORD}>, segments array<{SEGMENT}>"
ENERGY = "windows array<struct<start:double,end:double,vocal_rms:double,other_rms:double,snr_db:double>>"
RANGE = "struct<start:double,end:double,reason:string>"
PAIR = "array<struct<ja:string,zh:string>>"
METADATA = f"asr struct<prompt:string>, translate struct<title:string,circle:string,cv_mapping:{PAIR},character_mapping:{PAIR},term_mapping:{PAIR},summary:string>, title string, summary string, glossary struct<cvs:{PAIR},characters:{PAIR},terms:{PAIR}>"


def _beside(path: Column, suffix: str) -> Column:
    """The path without its suffix: what a file and the recording beside it share."""
    return F.regexp_replace(path, suffix.replace(".", r"\.") + "$", "")


def recordings(spark: SparkSession, root: str) -> DataFrame:
    """key, path, stem, ext of every audio file below root; contents are not read."""
    few_bytes(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.select(F.regexp_replace("path", r"\.[^./]+$", "").alias("key"), "path", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem"), ext.alias("ext"), "length").where(F.col("ext").isin(EXTENSIONS))


def _json(spark: SparkSession, root: str, suffix: str | None, schema: str) -> DataFrame:
    """Rows with `key`: one document a file beside its recording, or, without a suffix, a folder of bundles.

    A bundle has one document a line, each with its key, as `write_bundle` makes them; a small file a recording does not
    go far on a large store.
    """
    if suffix is None:
        return spark.read.schema(f"key string, {schema}").json(root)
    read = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}")
    return read.json(root).withColumn("key", _beside(F.col("_metadata.file_path"), suffix))


def transcripts(spark: SparkSession, root: str, suffix: str | None = ".raw-transcription.json") -> DataFrame:
    """key, seg_idx and the fields of each segment."""
    return _json(spark, root, suffix, TRANSCRIPT).select("key", F.posexplode("segments").alias("seg_idx", "s")).select("key", "seg_idx", "s.*")


def transcript_words(segments: DataFrame) -> DataFrame:
    """key, seg_idx, word_idx, text, start_time, end_time from segments as read."""
    return segments.select("key", "seg_idx", F.posexplode("words").alias("word_idx", "w")).select("key", "seg_idx", "word_idx", "w.*")


def energy_windows(spark: SparkSession, root: str, suffix: str | None = ".energy.json") -> DataFrame:
    return _json(spark, root, suffix, ENERGY).select("key", F.posexplode("windows").alias("win_idx", "w")).select("key", "win_idx", "w.*")


def _ms(seconds: str) -> Column:
    return F.floor(F.col(seconds) * 1000 + 0.5)


def attached(segments: DataFrame, windows: DataFrame) -> DataFrame:
    """Segments as read, in milliseconds and scaled integers, with the means of the windows they overlap."""
    s = segments.select(F.col("key").alias("track_id"), F.col("seg_idx").cast("long").alias("seg_idx"), "text", _ms("start_time").alias("start_ms"), _ms("end_time").alias("end_ms"), F.round(F.col("avg_logprob") * 100).cast("long").alias("logprob_c"), F.round(F.col("compression_ratio") * 100).cast("long").alias("ratio_c"), F.round(F.col("no_speech_prob") * 100).cast("long").alias("nospeech_c"))
    w = windows.select(F.col("key").alias("track_id"), F.col("win_idx").cast("long").alias("win_idx"), _ms("start").alias("start_ms"), _ms("end").alias("end_ms"), F.round(F.col("vocal_rms") * 1e6).cast("long").alias("vocal_u"), F.round(F.col("other_rms") * 1e6).cast("long").alias("other_u"), F.round(F.col("snr_db") * 1000).cast("long").alias("snr_milli"))
    return energy_join(s, w)


def repair_log(spark: SparkSession, root: str, suffix: str | None = ".repair.json") -> DataFrame:
    """One row for each entry, in order; a file that cannot be read gives none."""
    logs = _json(spark, root, suffix, f"range {RANGE}, newSegments array<{SEGMENT}>, status string").where("range is not null")
    return logs.select("key", "range", F.col("newSegments").alias("new_segments"), "status")


def repair_results(texts: DataFrame, engine: str) -> DataFrame:
    """key, start, end, segment from results (key, value): an array of windows, or one object for the whole track."""
    one = f"struct<window:array<double>,segments:array<{SEGMENT}>>"
    listed = F.from_json("value", f"array<{one}>")
    rows = F.when(F.col("value").rlike(r"^\s*\["), listed).otherwise(F.array(F.from_json("value", one)))
    each = texts.select("key", F.explode(rows).alias("r")).where("r is not null")
    window = F.coalesce("r.window", F.array(F.lit(0.0), F.lit(float("inf"))))
    each = each.select("key", window[0].alias("start"), window[1].alias("end"), F.explode("r.segments").alias("segment"))
    return each.withColumn("segment", F.col("segment").withField("engine", F.lit(engine)))


def glossary(spark: SparkSession, root: str, suffix: str | None = "metadata.json") -> DataFrame:
    """key, title, summary, kind, ord, ja, zh from metadata in either of two shapes."""
    m = _json(spark, root, suffix, METADATA)
    extracted = F.col("translate").isNotNull()
    side = lambda a, b: F.coalesce(F.when(extracted, F.col(f"translate.{a}")).otherwise(F.col(f"glossary.{b}")), F.array().cast(PAIR))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), side(a, b).alias("pairs")) for k, a, b in (("cv", "cv_mapping", "cvs"), ("character", "character_mapping", "characters"), ("term", "term_mapping", "terms"))))
    head = m.select("key", F.when(extracted, F.col("translate.title")).otherwise(F.col("title")).alias("title"), F.when(extracted, F.col("translate.summary")).otherwise(F.coalesce("summary", F.lit(""))).alias("summary"), F.explode(kinds).alias("k"))
    return head.select("key", "title", "summary", "k.kind", F.posexplode_outer("k.pairs").alias("ord", "p")).select("key", "title", "summary", "kind", "ord", "p.ja", "p.zh")


def requests(windows: DataFrame, templates: DataFrame, marks: tuple[str, str, str]) -> DataFrame:
    """Request text for each window: the caller's template of (locale, mode) with its places filled, between chat marks."""
    filled = F.col("template")
    for name in ("track", "summary", "glossary", "transcript"):
        filled = F.replace(filled, F.lit("{" + name + "}"), F.coalesce(F.col(name), F.lit("")))
    start, middle, end = map(F.lit, marks)
    few = F.broadcast(templates) if templates.count() <= BROADCAST_TEMPLATES else templates
    return windows.join(few, ["locale", "mode"]).withColumn("request", F.concat(start, filled, middle, end)).drop("template")


def write_rows(rows: DataFrame, path: str, partition: str | None = None, form: str = "parquet") -> None:
    """Segments, mismatches, entries, attempts or logs, by work where asked; an empty table is written too."""
    writer = rows.write.mode("overwrite").format(form)
    (writer.partitionBy(partition) if partition else writer).save(path)


def write_unless_empty(rows: DataFrame, path: str, partition: str | None = None, form: str = "json") -> int:
    """Writes rows as write_rows does, counted on the way; without any, no folder is left. Gives their number.

    So a repair log is there only if something was repaired, and the rows are worked out once.
    """
    seen = Observation()
    write_rows(rows.observe(seen, F.count(F.lit(1)).alias("n")), path, partition, form)
    n = seen.get["n"]
    if not n:
        _folder(rows.sparkSession, path).delete()
    return n


class _folder:
    """A folder of any store that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        self.path = jvm.org.apache.hadoop.fs.Path(path)
        self.store = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self.store.exists(self.path)

    def delete(self) -> None:
        self.store.delete(self.path, True)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """work_id, track_id, version of what finished runs below root have seen."""
    path = f"{root}/manifest"
    return spark.read.schema(MANIFEST).parquet(path) if _folder(spark, path).exists() else spark.createDataFrame([], MANIFEST)


def run_incremental(tracks: DataFrame, make: Callable[[DataFrame], DataFrame], root: str) -> DataFrame:
    """Results of all tracks (work_id, track_id, version) below root; only works with new or changed tracks are worked out.

    make turns tracks into rows with their work_id. They replace those of the same works (dynamic partition overwrite), and
    the manifest is written after them: a run that breaks off in between does its works again, to the same end.
    """
    spark, by = tracks.sparkSession, "work_id"
    left = tracks.join(stale_works(tracks, manifest(spark, root)), by, "left_semi").select(by, "track_id", "version").checkpoint()
    if not left.isEmpty():
        make(left).repartition(by).sortWithinPartitions(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{root}/results")
        left.write.mode("append").parquet(f"{root}/manifest")
    return spark.read.parquet(f"{root}/results").withColumn(by, F.col(by).cast("long"))


def write_bundle(documents: DataFrame, path: str) -> None:
    """Documents (key and its fields) as JSON lines, compressed."""
    documents.write.mode("overwrite").option("ignoreNullFields", False).option("compression", "gzip").json(path)


def write_texts(files: DataFrame, path: str) -> None:
    """Subtitle files (work_id, track_id, text) as texts: a folder a work, a file a track. A last line break is the writer's.

    Tasks write them where they belong, so no file is moved and no folder is made for it alone.
    """
    _folder(files.sparkSession, path).delete()
    text = F.concat(F.regexp_replace(F.coalesce("text", F.lit("")), "\n$", ""), F.lit("\n"))
    name = F.concat(F.lit("work_id="), F.col("work_id").cast("string"), F.lit("/"), F.col("track_id").cast("string"), F.lit(".txt"))
    write_recordings(files.select(name.alias("rel_path"), F.encode(text, "UTF-8").alias("content")), path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """work_id, track_id, text of such files."""
    few_bytes(spark)
    found = spark.read.text(path, wholetext=True)
    return found.select("work_id", F.regexp_extract(F.col("_metadata.file_name"), r"^(-?[0-9]+)\.txt$", 1).alias("track_id"), F.col("value").alias("text"))


def few_bytes(spark: SparkSession) -> None:
    """Many small files go to a task: the cost that Spark takes for opening one would make a task of four."""
    spark.conf.set("spark.sql.files.openCostInBytes", str(64 << 10))


def repository_name(url: Column, prefix: str = "https://huggingface.co/") -> Column:
    """A model's name without the address before it."""
    return F.when(F.startswith(url, F.lit(prefix)), F.substring(url, F.lit(len(prefix) + 1), F.length(url))).otherwise(url)
