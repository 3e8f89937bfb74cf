import json

from pyspark.sql import functions as F

from speechjobs.operators import windows
from speechjobs.sources import files, recordings


def test_round_trip(spark, tmp_path):
    (tmp_path / "w1").mkdir()
    word = {"text": "あ", "start_time": 0.0, "end_time": 0.5}
    seg = {"text": "あ", "start_time": 0.0, "end_time": 0.5, "words": [word], "avg_logprob": -0.3, "compression_ratio": 1.1, "no_speech_prob": 0.1}
    (tmp_path / "w1/a.MP3").write_bytes(b"x")
    (tmp_path / "w1/b.wav").write_bytes(b"x")
    (tmp_path / "w1/notes.txt").write_text("x")
    (tmp_path / "w1/a.raw-transcription.json").write_text(json.dumps({"full_text": "あ", "segments": [seg, seg]}))
    (tmp_path / "w1/a.energy.json").write_text(json.dumps({"windows": [{"start": 0, "end": 1, "vocal_rms": 0.1, "other_rms": 0.2, "snr_db": -6.0}]}))
    (tmp_path / "w1/a.repair.json").write_text(json.dumps([{"range": {"start": 0, "end": 1, "reason": "x"}, "newSegments": [seg], "status": "success"}]))
    (tmp_path / "w1/b.repair.json").write_text("{broken")
    root = str(tmp_path)
    tracks = files.recordings(spark, root)
    assert {(r["stem"], r["ext"]) for r in tracks.collect()} == {("a", "mp3"), ("b", "wav")}
    got = files.transcripts(spark, root)
    assert [r["seg_idx"] for r in got.orderBy("seg_idx").collect()] == [0, 1] and got.first()["words"][0]["text"] == "あ"
    assert tracks.select(F.regexp_replace("key", "^file:/+", "/").alias("key")).join(got.select(F.regexp_replace("key", "^file:/+", "/").alias("key")).distinct(), "key", "left_anti").count() == 1
    assert files.energy_windows(spark, root).first()["snr_db"] == -6.0
    assert [r["status"] for r in files.repair_log(spark, root).collect()] == ["success"]


def test_repair_results_in_two_shapes(spark):
    seg = {"text": "x", "start_time": 0.0, "end_time": 0.5}
    rows = [(1, json.dumps([{"window": [5, 9], "segments": [seg]}])), (2, json.dumps({"segments": [seg, seg]})), (3, "oops")]
    got = files.repair_results(spark.createDataFrame(rows, "key long, value string"), "mms").collect()
    assert sorted((r["key"], r["start"], r["segment"]["engine"]) for r in got) == [(1, 5.0, "mms"), (2, 0.0, "mms"), (2, 0.0, "mms")]


def test_metadata_and_requests(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a/metadata.json").write_text(json.dumps({"translate": {"title": "t", "cv_mapping": [{"ja": "あ", "zh": "啊"}], "summary": "s"}}))
    (tmp_path / "b/metadata.json").write_text(json.dumps({"title": "u", "glossary": {"terms": [{"ja": "い", "zh": "伊"}]}}))
    got = files.glossary(spark, str(tmp_path))
    assert {(r["title"], r["summary"], r["kind"], r["zh"]) for r in got.where("ja is not null").collect()} == {("t", "s", "cv", "啊"), ("u", "", "term", "伊")}
    texts = windows.glossary_text(got.where("ja is not null"), ["title"]).collect()
    assert {r["title"]: json.loads(r["glossary"]) for r in texts} == {"t": {"cvs": [{"ja": "あ", "zh": "啊"}], "characters": [], "terms": []}, "u": {"cvs": [], "characters": [], "terms": [{"ja": "い", "zh": "伊"}]}}
    assert all(r["glossary"] == json.dumps(json.loads(r["glossary"]), indent=2, ensure_ascii=False) for r in texts)
    w = spark.createDataFrame([("zh", "base", "1", None, "{}", "[x]")], "locale string, mode string, track string, summary string, glossary string, transcript string")
    t = spark.createDataFrame([("zh", "base", "T{track} S{summary} {transcript}")], "locale string, mode string, template string")
    assert files.requests(w, t, ("<", "|", ">")).first()["request"] == "<T1 S [x]|>"
    files.write_rows(w.limit(0), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 0


def test_log_only_if_not_empty(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "work_id long, text string")
    assert files.write_unless_empty(df, str(tmp_path / "log"), "work_id") == 2 and (tmp_path / "log").exists()
    assert files.write_unless_empty(df.where("work_id > 5"), str(tmp_path / "none"), "work_id") == 0 and not (tmp_path / "none").exists()


def test_two_runs_equal_one(spark, tmp_path):
    texts = spark.createDataFrame([(t // 3, t, f"text {t}") for t in range(12)], "work_id long, track_id long, text string")
    asked = []

    def make(left):
        asked.append(sorted(r["track_id"] for r in left.collect()))
        return texts.join(left.select("track_id", "version"), "track_id")

    tracks = texts.select("work_id", "track_id").withColumn("version", F.lit("1"))
    files.run_incremental(tracks.where("track_id < 7"), make, str(tmp_path))
    files.run_incremental(tracks, make, str(tmp_path))
    last = files.run_incremental(tracks, make, str(tmp_path))
    assert asked == [list(range(7)), list(range(6, 12))]  # the work that was begun is done again, whole
    assert {tuple(r) for r in last.select("work_id", "track_id", "text").collect()} == {tuple(r) for r in texts.collect()}
    changed = tracks.withColumn("version", F.when(F.col("track_id") == 4, "2").otherwise("1"))
    assert files.run_incremental(changed, make, str(tmp_path)).count() == 12 and asked[-1] == [3, 4, 5]


def test_recordings_and_headers(spark, tmp_path):
    sound = recordings.wav(16_000, 2, bytes(4 * 8000))
    rows = [("a b/100%.wav", sound), ("c/d.e.MP3", b"x"), ("c/short.wav", b"RIFF"), ("notes.txt", b"n")]
    df = spark.createDataFrame(rows, "rel_path string, content binary").repartition(2)
    for _ in range(2):
        recordings.write_recordings(df, str(tmp_path))
    assert (tmp_path / "a b/100%.wav").read_bytes() == sound
    got = {r["stem"]: (r["ext"], r["length"], r["rate"], r["channels"], r["length_ms"]) for r in recordings.with_headers(files.recordings(spark, str(tmp_path))).collect()}
    assert got == {"100%": ("wav", len(sound), 16_000, 2, 500), "d.e": ("mp3", 1, None, None, None), "short": ("wav", 4, None, None, None)}
