"""How rows lie: what is made of one table stays where it was dealt out."""

from pyspark.sql import functions as F

from speechjobs.jobs import clean as clean_jobs
from speechjobs.operators import align, clean
from speechjobs.sources import fixtures

SF = "/root/testdata/sf0.001"


def _shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("ENSURE_REQUIREMENTS")


def test_loudness_meets_segments_without_another_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _shuffles(clean_jobs.scored_segments(spark, SF)) == 0
        assert _shuffles(clean_jobs.clean_segments(spark, SF)) <= 1  # the long runs, found beside the rows
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_words_in_segments_are_cut_as_a_table_of_words(spark):
    rows = fixtures.segments(spark, SF).where("track_id < 40")
    key = lambda df: sorted(map(tuple, df.select("track_id", "seg_idx", "part_idx", "text", "start_ms", "end_ms").collect()))
    assert key(clean.resplit(fixtures.with_words(rows))) == key(clean.resplit(rows, fixtures.words(spark, SF)))


def test_documents_with_one_id_share_their_times(spark, tmp_path):
    """A line's length is that of all lines of its number, and counts once for what comes after it."""
    spark.createDataFrame([(5, "ab cd\nxy"), (5, "efg\nz"), (None, "x")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.text, r.start_ms, r.end_ms) for r in fixtures.segments(spark, str(tmp_path)).collect())
    first = 70 * (4 + 3)
    assert [x for x in got if x[0] in ("ab cd", "efg")] == [("ab cd", 0, first), ("efg", 0, first)]
    assert len({x[1:] for x in got if x[0] in ("xy", "z")}) == 1 and len(got) == 4


def test_long_runs_in_several_partitions(spark):
    rows = [(t, i, x) for t in range(60) for i, x in enumerate(["a", "same words", "", "same words", "same words", "b"] + ["end of it"] * (t % 4))]
    df = spark.createDataFrame(rows, "track_id long, seg_idx long, text string").repartition(5, F.rand())
    got = clean.repetition_fuzzy(df, ["seg_idx"], piece=2).where("repeated").groupBy("track_id").count().collect()
    assert {r["track_id"]: r["count"] for r in got} == {t: 4 + (3 if t % 4 == 3 else 0) for t in range(60)}


def test_a_full_stop_in_a_prompt_is_no_letter(spark):
    df = spark.createDataFrame([("Os ñja。 Laos bo、rr", "Xy. Os ñja. Laos bo, rr. Zz."), ("Os ñja。 Laosx", "Os ñja. Laos.")], "text string, prompt string")
    assert [r[0] for r in df.select(align.leaks_exactly(F.regexp_replace("text", "、", ""), F.regexp_replace("prompt", ",", ""))).collect()] == [True, False]


def test_replay_is_no_group_of_pandas_for_each_cluster(spark):
    from speechjobs.jobs import repair as repair_jobs

    after, _ = repair_jobs.replayed(spark, SF)
    assert "FlatMapCoGroups" not in after._jdf.queryExecution().executedPlan().toString()


def test_texts_are_files_in_the_folder_of_their_work(spark, tmp_path):
    from speechjobs.sources import files

    df = spark.createDataFrame([(1, 5, "a\n"), (1, 6, "b\nc\n"), (2, 7, "d")], "work_id long, track_id long, text string")
    for rows in (df, df.where("track_id <> 6")):
        files.write_texts(rows, f"{tmp_path}/texts")
        assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.txt")) == sorted(f"texts/work_id={r.work_id}/{r.track_id}.txt" for r in rows.collect())
    assert {(int(r.track_id), r.text) for r in files.read_texts(spark, f"{tmp_path}/texts").collect()} == {(5, "a\n"), (7, "d\n")}


def test_a_work_is_written_by_one_task(spark, tmp_path):
    from speechjobs.sources import files

    tracks = spark.range(300).selectExpr("id % 3 as work_id", "id as track_id", "'1' as version")
    files.run_incremental(tracks, lambda left: left.repartition(7, F.rand()).select("work_id", "track_id"), str(tmp_path))
    assert len(list(tmp_path.glob("results/work_id=*/*.parquet"))) == 3
