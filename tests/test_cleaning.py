"""Rules at both sides of their thresholds, and folds against plain statements of them."""

import json
import random

import pytest
from pyspark.sql import functions as F

from speechjobs.functions.text import collapse_runs, lrc_time, path_safe, strip_speaker, vtt_time
from speechjobs.operators import align, clean, energy, metadata, repair, report, resolve, subtitles, windows

SEGMENT = "track_id long, seg_idx long, text string, start_ms long, end_ms long, logprob_c long, ratio_c long, nospeech_c long, vocal_u double, other_u double, snr_milli double"


def segment(text="これはとても長い言葉です", start=1000, end=5000, lp=-40, ratio=120, ns=10, ve=2000.0, snr=5000.0, i=0):
    return (1, i, text, start, end, lp, ratio, ns, ve, 100.0, snr)


CASES = [
    (segment(ratio=251), 1), (segment(ratio=250), 14),
    (segment(lp=-151), 2), (segment(lp=-150), 14), (segment(ns=81), 2), (segment(ns=80), 14),
    (segment(ve=49.0), 3), (segment(ve=50.0), 14),
    (segment("短いよ", end=1199, ve=500.0), 4), (segment("短いよ", end=1200, ve=500.0), 14),
    (segment("あいうえおかきくけこさしすせそたちつてとな", ve=500.0), 5), (segment("あいうえおかきくけこさしすせそたちつてと", ve=500.0), 14),
    (segment(ve=500.0, snr=-1.0), 6), (segment(ve=500.0, snr=0.0), 14), (segment(ve=1000.0, snr=-1.0), 14),
    (segment(lp=-151, ve=500.0), 7), (segment(lp=-151, snr=1999.0), 7), (segment(lp=-151, snr=2000.0), 2), (segment(lp=-400), 2), (segment(lp=-400, ve=None), 7),
    (segment("あいうえ、" * 41, start=0, end=15001, ve=None), 8), (segment("あいうえ、" * 40, start=0, end=15001, ve=None), 14), (segment("あいうえ、" * 41, start=1, end=15001, ve=None), 14),
    (segment("あ。"), 9), (segment("あい。"), 14), (segment("。、"), 9),
    (segment("あいうえおかきくけこさ", end=1439), 10), (segment("あいうえおかきくけこさ", end=1440), 14), (segment("あいうえおかきくけこ", end=1100), 14),
    (segment("あああああああいうえお", ve=None), 11), (segment("ああああああいうえおか", ve=None), 14),
    (segment("あい" * 9 + "うえお", ve=None), 11), (segment("あい" * 8 + "うえお", ve=None), 14),
]


def test_garble_rules(spark):
    df = spark.createDataFrame([(*s[:1], i, *s[2:]) for i, (s, _) in enumerate(CASES)], SEGMENT)
    got = {r["seg_idx"]: r["rule_id"] for r in clean.classify(df).collect()}
    assert got == {i: rule for i, (_, rule) in enumerate(CASES)}


def test_outros_only_in_repair(spark):
    df = spark.createDataFrame([segment("またね。"), segment("ご視聴ありがとうございました", i=1), segment("またねえ", i=2)], SEGMENT)
    assert [r["rule_id"] for r in clean.classify(df, repair=True).orderBy("seg_idx").collect()] == [13, 13, 14]
    assert {r["rule_id"] for r in clean.classify(df).collect()} == {14}


def _runs(rows, n):
    """rows of (normalised, blank) to flags."""
    flags, anchor, count, start = [False] * len(rows), "", 0, 0
    for i, (a, blank) in [*enumerate(rows), (len(rows), ("", None))]:
        if blank:
            continue
        same = blank is False and a and anchor and (a == anchor or (len(a) > 10 and len(anchor) > 10 and (a in anchor or anchor in a)))
        if same:
            count += 1
            continue
        if count >= n:
            flags[start:i] = [True] * (i - start)
        anchor, count, start = a, 1, i
    return flags


def test_repetition(spark):
    rng = random.Random(4)
    texts = ["はい", "はい。", "。。", " ", "", "ありがとうございましたほんとうに", "ありがとうございましたほんとうにどうも", "いいえ"]
    rows = [(t, i, rng.choice(texts)) for t in range(40) for i in range(rng.randrange(1, 14))]
    df = spark.createDataFrame(rows, "track_id long, seg_idx long, text string")
    fuzzy = {(r["track_id"], r["seg_idx"]): r["repeated"] for r in clean.repetition_fuzzy(df, ["seg_idx"]).collect()}
    import re

    for t in range(40):
        own = [x for x in rows if x[0] == t]
        want = _runs([(re.sub(r"[\s。]", "", x[2]), not x[2].strip()) for x in own], 3)
        assert [fuzzy[t, x[1]] for x in own] == want
    short = df.where("length(text) < 10")
    exact = {(r["track_id"], r["seg_idx"], r["repeated"]) for r in clean.repetition_exact(short, ["seg_idx"]).collect()}
    assert exact == {(r["track_id"], r["seg_idx"], r["repeated"]) for r in clean.repetition_fuzzy(short, ["seg_idx"]).collect()}


def _merge(ranges, gap, longest):
    out = []
    for s, e, r in ranges:
        if out and s <= out[-1][1] + gap and (longest is None or e - out[-1][0] <= longest):
            last = out[-1]
            out[-1] = (last[0], max(last[1], e), last[2] if r in last[2] else f"{last[2]}+{r}")
        else:
            out.append((s, e, r))
    return out


@pytest.mark.parametrize(("gap", "longest"), [(0, None), (8000, 90000)])
def test_unite(spark, gap, longest):
    rng = random.Random(gap)
    rows = [(t, i, s := rng.randrange(0, 300_000), s + rng.choice([0, 500, 8000, 40_000]), rng.choice(["a", "b", "ab"])) for t in range(30) for i in range(rng.randrange(1, 15))]
    df = spark.createDataFrame(rows, "track_id long, i long, start_ms long, end_ms long, reason string")
    got = clean.unite(df, ["i"], gap, longest).collect()
    for t in range(30):
        want = _merge([(r[2], r[3], r[4]) for r in sorted((x for x in rows if x[0] == t), key=lambda x: (x[2], x[1]))], gap, longest)
        assert sorted((r["start_ms"], r["end_ms"], r["reason"]) for r in got if r["track_id"] == t) == sorted(want)


def test_merge_edges(spark):
    rows = [(1, 0, 0, 1000, "a"), (1, 1, 9000, 9500, "b"), (2, 0, 0, 1000, "a"), (2, 1, 9001, 9500, "b"), (3, 0, 0, 85_000, "a"), (3, 1, 85_000, 90_000, "b"), (4, 0, 0, 85_000, "a"), (4, 1, 85_000, 90_001, "b")]
    got = clean.unite(spark.createDataFrame(rows, "track_id long, i long, start_ms long, end_ms long, reason string"), ["i"], 8000, 90_000).groupBy("track_id").count().collect()
    assert {r["track_id"]: r["count"] for r in got} == {1: 1, 2: 2, 3: 1, 4: 2}


def _grid(n, last=1000, off=()):
    return [(1, i, i * 1000, i * 1000 + (last if i == n - 1 else 1000), 0.0 if i in off else 2000.0, 100.0, 5000.0) for i in range(n)]


WINDOW = "track_id long, win_idx long, start_ms long, end_ms long, vocal_u double, other_u double, snr_milli double"


@pytest.mark.parametrize(("n", "last", "want"), [(29, 1000, [29_000]), (30, 1000, [29_000, 1000]), (30, 500, [29_500]), (31, 1000, [29_000, 2000]), (59, 500, [29_000, 29_500])])
def test_blocks(spark, n, last, want):
    got = clean.missed_blocks(spark.createDataFrame(_grid(n, last), WINDOW)).orderBy("start_ms").collect()
    assert [r["end_ms"] - r["start_ms"] for r in got] == want


def test_missed_speech_leeway(spark):
    wins = spark.createDataFrame(_grid(10, off=(0, 1, 2, 7, 8, 9)), WINDOW)  # a block from 3 s to 7 s
    for s, e, missed in [(0, 2000, True), (0, 2001, False), (8000, 9000, True), (7999, 9000, False), (0, 60_000, False)]:
        assert clean.missed_speech(wins, spark.createDataFrame([segment(start=s, end=e)], SEGMENT)).count() == missed


def test_energy_join_edges(spark):
    wins = spark.createDataFrame([(1, i, i * 1000, i * 1000 + 1000, float(i), 1.0, 1.0) for i in range(5)], WINDOW)
    rows = [segment(start=1000, end=2000), segment(start=999, end=2001, i=1), segment(start=1500, end=1500, i=2), segment(start=2000, end=2000, i=3), segment(start=9000, end=9500, i=4)]
    df = spark.createDataFrame(rows, SEGMENT).drop("vocal_u", "other_u", "snr_milli")
    assert {r["seg_idx"]: r["vocal_u"] for r in energy.energy_join(df, wins).collect()} == {0: 1.0, 1: 1.0, 2: 1.0, 3: None, 4: None}


def test_clusters_stay_in_range(spark):
    ranges = spark.createDataFrame([(1, 2500, 3600, "x")], "track_id long, start_ms long, end_ms long, reason string")
    got = repair.speech_clusters(ranges, spark.createDataFrame(_grid(10), WINDOW)).collect()
    assert [(r["start_ms"], r["end_ms"]) for r in got] == [(2500.0, 3600.0)]


def test_budget_windows_cover_all_but_the_tail(spark):
    rng = random.Random(2)
    rows = [(t, i + 1, rng.randrange(10, 900), [(k, 196, i + 1) for k in range(rng.randrange(0, 2))]) for t in range(25) for i in range(t * 5)]
    df = spark.createDataFrame(rows, "track_id long, id long, base long, terms array<struct<id:long,chars:long,first:long>>").withColumn("overhead", F.lit(600))
    got = windows.budget_windows(df).collect()
    for t in range(25):
        ids = sorted(r["id"] for r in got if r["track_id"] == t)
        assert ids == list(range(1, len(ids) + 1)) and t * 5 - len(ids) < 3
        for w in {r["window_idx"] for r in got if r["track_id"] == t}:
            own = sorted(r["id"] for r in got if (r["track_id"], r["window_idx"]) == (t, w))
            size = lambda ids: 600 + sum(rows_of[t, i][0] for i in ids) + len(ids) * len(str(ids[-1])) + 2 * (len(ids) - 1) + 4 + 200 * any(rows_of[t, i][1] for i in ids)  # noqa: E731, B023
            rows_of = {(x[0], x[1]): (x[2], x[3]) for x in rows}
            assert len(own) >= 3 and (len(own) == 3 or size(own) <= 2500)
            if (t, own[-1] + 1) in rows_of:
                assert size([*own, own[-1] + 1]) > 2500
    assert windows.budget_windows(df, keep_tail=True).count() == len(rows)


def test_budget_windows_in_pieces(spark):
    rng = random.Random(3)
    rows = [(t, i + 1, rng.randrange(150, 400), 600, [(rng.randrange(6), 96, max(1, i - 1))] if rng.random() < 0.3 else []) for t, n in ((1, 700), (2, 161), (3, 2), (4, 81), (5, 162)) for i in range(n)]
    df = spark.createDataFrame(rows, "track_id long, id long, base long, overhead long, terms array<struct<id:long,chars:long,first:long>>").repartition(4)
    whole = sorted(map(tuple, windows.budget_windows(df).collect()))
    assert len({(r[0], r[2]) for r in whole}) > 100 and max(r[3] for r in whole) > 4
    for piece in (20, 40, 80):
        assert sorted(map(tuple, windows.budget_windows(df, piece=piece).collect())) == whole


def test_text_functions(spark):
    row = spark.range(1).select(
        collapse_runs(F.lit("嗯" * 79)).alias("a"), lrc_time(F.lit(59_996)).alias("b"), lrc_time(F.lit(6_000_000)).alias("c"), vtt_time(F.lit(3_661_007)).alias("d"),
        strip_speaker(F.lit("和名： 言葉")).alias("e"), strip_speaker(F.lit("abc：x")).alias("f"), path_safe(F.lit("a/b:c%\u0001")).alias("g"),
    ).first()
    assert list(row) == ["嗯嗯嗯…", "[00:60.00]", "[100:00.00]", "01:01:01.007", "言葉", "abc：x", "a%2Fb%3Ac%25%01"]


def test_model_text(spark):
    raw = ["<think>x</think>", "", None, 'a [{"id": 1, "text": "x"}] b', "no ] [ order"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    got = [r["x"] for r in df.select("i", resolve.extract_array(F.col("raw")).alias("x")).orderBy("i").collect()]
    assert got == ["", "", None, '[{"id": 1, "text": "x"}]', "no ] [ order"]
    assert resolve.collapse(spark.createDataFrame([(1, f"in{i % k}", "x" * n) for n, k in ((5, 9), (6, 3), (15, 2), (16, 2)) for i in range(9)], "w int, input string, text string"), ["w"]).count() == 2


def test_subtitle_pause(spark):
    rows = [(1, 0, "a", 0, 1000), (1, 1, "b", 3000, 4000), (1, 2, None, 6001, 6500), (1, 3, "c", 6001, 7000)]
    merged = subtitles.merge_same_start(spark.createDataFrame(rows, "track_id long, i long, text string, start_ms long, end_ms long"), ["start_ms", "i"])
    assert subtitles.lrc_lines(merged).first()["lrc"] == "[00:00.00]a\n[00:03.00]b\n[00:04.00]\n[00:06.00]c\n"


def test_blank_entries_are_no_neighbours(spark):
    rows = [(1, 0, "a", 0, 1000, [1]), (1, 1, " \u3000", 2500, 3000, [2]), (1, 2, None, 2600, 3000, [3]), (1, 3, "b", 6000, 7000, [4]), (1, 4, "c", 6000, 7500, [5, 6])]
    merged = subtitles.merge_same_start(spark.createDataFrame(rows, "track_id long, i long, text string, start_ms long, end_ms long, ids array<long>"), ["start_ms", "i"])
    assert [(r["text"], r["end_ms"], r["ids"]) for r in merged.orderBy("run").collect()] == [("a", 1000, [1]), ("b～c", 7500, [4, 5, 6])]
    assert subtitles.lrc_lines(merged).first()["lrc"] == "[00:00.00]a\n[00:01.00]\n[00:06.00]b～c\n"
    assert subtitles.vtt_files(subtitles.vtt_cues(merged)).first()["vtt"] == "WEBVTT\n\n1\n00:00:00.000 --> 00:00:01.000\na\n\n2\n00:00:06.000 --> 00:00:07.500\nb～c\n"


def test_sentence_times(spark):
    tokens = [("あ", 1.0, 1.5), ("い", 1.5, 2.0), ("え", 5.0, 5.5)]
    df = spark.createDataFrame([(1, 0, ["あい。", "ううう！", "え"], tokens)], "track_id long, chunk_idx long, sentences array<string>, tokens array<struct<text:string,start_time:double,end_time:double>>")
    got = align.sentence_times(df).orderBy("sentence_idx").collect()
    assert [(r["start_time"], r["end_time"]) for r in got] == [(1.0, 2.0), (2.0, 5.0), (5.0, 5.5)]
    near = spark.createDataFrame([("この文章はほとんど同じです", "この文章はほとんど同じでし"), ("短い", "短い"), ("まったく違う文章をここに書く", "abcdefghijklmnop")], "a string, b string")
    assert [r["x"] for r in near.select(align.leaks_nearly()("a", "b").alias("x")).collect()] == [True, False, False]


def test_sentences_at_one_point_share_what_follows(spark):
    tokens = [("あ", 1.0, 1.0), ("い", 1.0, 1.0), ("え", 5.0, 5.5)]
    df = spark.createDataFrame([(1, k, ["あ。", "い。", "う。", "え。"], tokens) for k in (0, 7)], "track_id long, chunk_idx long, sentences array<string>, tokens array<struct<text:string,start_time:double,end_time:double>>")
    got = align.sentence_times(df).where("chunk_idx = 7").orderBy("sentence_idx").collect()
    assert [(r["chunk_idx"], r["start_time"], r["end_time"]) for r in got] == [(7, 1.0, 1.0), (7, 1.0, 1.0), (7, 1.0, 5.0), (7, 5.0, 5.5)]


def test_leaks_go_by_chunk_and_by_track(spark):
    prompt = "これは録音の説明です。静かな部屋で話します。"
    rows = [(1, 0, "静かな部屋で話します", prompt), (1, 1, "まったく別の言葉です", prompt), (2, 0, "これは録", prompt), (2, 1, "音の説明", prompt), (3, 0, "これは録音の説明です。静かな部屋で話しました。", prompt), (3, 1, "別", prompt)]
    got = align.drop_leaks(spark.createDataFrame(rows, "track_id long, chunk_idx long, text string, prompt string")).collect()
    assert sorted((r["track_id"], r["chunk_idx"]) for r in got) == [(1, 1), (3, 1)]


def test_existing_mismatch_is_kept(spark):
    rows = [(*segment(), "uncertain"), (*segment(i=1), None), (*segment(ratio=251, i=2), "uncertain"), (*segment(lp=-151, ve=500.0, i=3), "uncertain")]
    got = clean.classify(spark.createDataFrame(rows, SEGMENT + ", mismatch_type string")).orderBy("seg_idx").collect()
    assert [(r["rule_id"], r["mismatch_type"]) for r in got] == [(14, "uncertain"), (14, None), (1, "hallucinated"), (7, None)]


def test_growing_texts_are_flagged_in_the_flow(spark):
    texts = ["ご視聴ありがとうございました", "ご視聴ありがとうございましたどうも", "ご視聴ありがとうございましたどうもね"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "track_id long, seg_idx long, text string")
    assert [r["repeated"] for r in clean.repetition_fuzzy(df, ["seg_idx"]).collect()] == [True] * 3
    assert not any(r["repeated"] for r in clean.repetition_exact(df, ["seg_idx"]).collect())


def test_fuzzy_runs_in_pieces(spark):
    rng = random.Random(5)
    base = ["ご視聴ありがとうございました", "次回の動画でお会いしましょうね", "はい", "あ", "", "。。。"]
    rows = []
    for t in range(9):
        text = rng.choice(base)
        for i in range(rng.choice([3, 40, 90])):
            if rng.random() < (0.5 if t % 2 else 0.05):
                text = rng.choice(base)
            rows.append((t, i, text + rng.choice(["", "", "どうも", "ね"]) if len(text) > 5 else text))
    rows += [(20, i, base[0]) for i in range(100)] + [(21, i, base[0] + "どうも" * (i % 2)) for i in range(100)]
    df = spark.createDataFrame(rows, "track_id long, seg_idx long, text string")

    want = {}
    for t in {r[0] for r in rows}:
        own = [(i, "".join(c for c in x if c not in "。"), x.strip() == "") for tt, i, x in rows if tt == t]
        anchor, run = None, []
        for i, norm, blank in [*own, (None, None, False)]:
            same = blank or (bool(norm) and bool(anchor) and (norm == anchor or (len(norm) > 10 and len(anchor) > 10 and (norm in anchor or anchor in norm))))
            if not same:
                want |= {(t, k): anchor is not None and sum(not b for _, b in run) >= 3 for k, _ in run}
                anchor, run = norm, []
            if i is not None:
                run.append((i, blank))
    for piece in (7, 64, 4096):
        got = {(r["track_id"], r["seg_idx"]): r["repeated"] for r in clean.repetition_fuzzy(df, ["seg_idx"], piece=piece).collect()}
        assert got == want and sum(want.values()) > 100


def test_energy_of_blocks_across_windows(spark):
    rng = random.Random(3)
    tracks = {t: [[rng.uniform(-1, 1) for _ in range(n)] for _ in range(stems)] for t, n, stems in ((1, 100, 3), (2, 37, 2), (3, 1, 5))}
    rows = []
    for t, stems in tracks.items():
        at = 0
        while at < len(stems[0]):
            n = rng.choice([1, 5, 40])
            rows.append((t, at, stems[0][at : at + n], [s[at : at + n] for s in stems[1:]]))
            at += n
    rows += [(9, 0, [], [[]]), (9, 0, [1.0], [])]
    got = {(r["track_id"], r["win_idx"]): r for r in energy.fine_energy_blocks(spark.createDataFrame(rows, "track_id long, begin long, vocal array<double>, others array<array<double>>").repartition(3), 16).collect()}
    want = {(t, w) for t, s in tracks.items() for w in range((len(s[0]) + 15) // 16)}
    assert set(got) == want
    for (t, w), r in got.items():
        vocal, other = tracks[t][0][16 * w : 16 * w + 16], [sum(x) for x in zip(*tracks[t][1:])][16 * w : 16 * w + 16]
        assert r["n"] == len(vocal)
        for name, x in (("vocal_rms", vocal), ("other_rms", other)):
            assert abs(r[name] - (sum(v * v for v in x) / len(x)) ** 0.5) < 2e-6


def test_blocks_off_the_grid(spark):
    rng = random.Random(6)
    rows = []
    for t, step in ((1, 2000), (2, 1300), (3, 700), (4, 31_000)):
        at = 0
        for i in range(60):
            length = step if t == 1 else rng.randrange(step // 2, step)
            rows.append((t, i, at, at + length, 5000.0, 10.0, 9000.0 if i % 29 else 0.0))
            at += length
    got = sorted((r["track_id"], r["start_ms"], r["end_ms"]) for r in clean.missed_blocks(spark.createDataFrame(rows, WINDOW)).collect())
    want = []
    for t in (1, 2, 3, 4):
        block = None
        for _, i, a, b, *_ in [r for r in rows if r[0] == t]:
            if i % 29 == 0:
                block = None
            elif block is None or b - block[0] >= 30_000:
                block = [a, b]
                want.append((t, block))
            else:
                block[1] = b
    assert got == sorted((t, *b) for t, b in want) and max(b - a for t, a, b in got if t < 4) < 30_000


def test_conformance(spark):
    seg = spark.createDataFrame([(1, w, i, f"t{i}", i * 10, i * 10 + 5) for w in range(7) for i in (1, 2)], "track_id long, window_idx long, local_id long, text string, start_ms long, end_ms long")
    sent = [(1, 0, 0, [1, 2], 10, 25, "t1 t2"), (1, 1, 0, [1], 10, 15, None), (1, 1, 1, [9], 10, 15, None), (1, 2, 0, [2], 20, 25, None), (1, 2, 1, [1], 10, 15, None), (1, 3, 0, [1, 2], 11, 25, "x"), (1, 4, 0, [1], 10, 15, None), (1, 4, 1, [1, 2], 10, 25, None), (1, 5, 0, [1, 2, 3, 4, 5, 6], 10, 25, None)]
    got = {r["window_idx"]: r.asDict() for r in resolve.conformance(spark.createDataFrame(sent, "track_id long, window_idx long, entry_idx long, ids array<long>, start_ms long, end_ms long, input string"), seg).collect()}
    faults = lambda w: {k[2:]: v for k, v in got[w].items() if k.startswith("n_") and v}
    assert [faults(w) for w in range(7)] == [{}, {"missing": 1, "unknown": 1}, {"order": 1}, {"times": 1, "input": 1}, {"double": 1, "order": 1}, {"unknown": 4, "size": 1}, {"missing": 2}]


def _replayed(segments, log):
    now, applied = [dict(s) for s in segments], []
    for e in sorted(log, key=lambda e: e["log_idx"]):
        if e["status"] != "success" or not e["new"]:
            continue
        inside = lambda s, e=e: not (s["e"] <= e["a"] or s["s"] >= e["b"])
        good = [s for s in now if inside(s) and not s["bad"]]
        add = [n for n in e["new"] if not any(g["s"] < n[1] and g["e"] > n[0] for g in good)]
        if add:
            now = [s for s in now if not inside(s) or (not s["bad"] and not s["engine"])] + [{"s": a, "e": b, "bad": None, "engine": "q", "text": t} for a, b, t in add]
            applied.append((e["a"], e["b"]))
    return now, applied


def test_replay_of_overlapping_entries(spark):
    rng = random.Random(12)
    segs, logs, bad = [], [], []
    for t in range(12):
        for i in range(rng.randrange(0, 20)):
            a = rng.randrange(0, 60_000)
            segs.append({"t": t, "i": i, "s": a, "e": a + rng.randrange(200, 4000), "text": f"s{i}", "engine": rng.choice([None, None, "mms"]), "bad": rng.choice([None, None, "uncertain"])})
            bad.append((t, i, a, a + 900))
        for k in range(rng.randrange(0, 9)):
            a = rng.randrange(0, 60_000)
            b = a + rng.randrange(1000, 15_000)
            logs.append({"t": t, "log_idx": k, "a": a, "b": b, "status": rng.choice(["success", "success", "failed"]), "new": [(x := rng.randrange(a - 400, b), x + rng.randrange(100, 900), f"n{k}{j}") for j in range(rng.randrange(0, 4))]})
    sdf = spark.createDataFrame([(s["t"], s["i"], s["s"], s["e"], s["text"], s["engine"], s["bad"]) for s in segs], "track_id long, seg_idx long, start_ms long, end_ms long, text string, engine string, mismatch_type string")
    ldf = spark.createDataFrame([(x["t"], x["log_idx"], x["a"], x["b"], x["status"], [(*n, "q") for n in x["new"]]) for x in logs], "track_id long, log_idx long, r_start long, r_end long, status string, new_segments array<struct<start_ms:long,end_ms:long,text:string,engine:string>>")
    after, left = repair.replay_log(sdf, spark.createDataFrame(bad, "track_id long, mismatch_idx long, start_ms long, end_ms long"), ldf)
    got, kept = sorted((r["track_id"], r["start_ms"], r["end_ms"], r["text"]) for r in after.collect()), {(r["track_id"], r["mismatch_idx"]) for r in left.collect()}
    want, want_kept = [], set()
    for t in range(12):
        now, applied = _replayed([s for s in segs if s["t"] == t], [x for x in logs if x["t"] == t])
        want += [(t, s["s"], s["e"], s["text"]) for s in now]
        want_kept |= {(t, i) for tt, i, a, b in bad if tt == t and not any(a < y and b > x for x, y in applied)}
    assert got == sorted(want) and kept == want_kept


def test_names_always_count_and_terms_of_the_work(spark):
    w = spark.createDataFrame([(1, 0, 7, "赤い花と青"), (2, 0, 8, "赤い花"), (3, 0, 6, "赤"), (4, 1, 7, "")], "track_id long, window_idx long, work_id long, text string")
    terms = spark.createDataFrame([(7, "term", "赤い花"), (7, "term", "青"), (7, "term", "黒"), (7, "term", "い花"), (7, "cv", "名"), (7, "character", ""), (8, "term", "青"), (8, "term", "花と"), (9, "cv", "他")], "work_id long, kind string, ja string")
    got = {r["track_id"]: r["terms"] for r in windows.glossary_hits(w, terms.where("kind = 'term'").drop("kind")).collect()}
    assert got == {1: ["い花", "赤い花", "青"], 2: [], 3: [], 4: []}
    assert {r["work_id"]: r["names"] for r in windows.glossary_names(terms).collect()} == {7: ["名"], 9: ["他"]}
    pairs = terms.withColumn("ord", F.lit(0)).withColumn("zh", F.lit("z")).where("ja <> ''")
    text = {r["track_id"]: json.loads(r["glossary"]) for r in windows.window_glossary(windows.glossary_hits(w, terms.where("kind = 'term'").drop("kind")), pairs).collect()}
    assert [x["ja"] for x in text[1]["terms"]] and text[4] == {"cvs": [{"ja": "名", "zh": "z"}], "characters": [], "terms": []} and text[3] == {"cvs": [], "characters": [], "terms": []}


def test_window_entries_hold_names_and_terms(spark):
    w = spark.createDataFrame([(1, 0, 7, "赤い花と青"), (2, 0, 7, "白"), (3, 0, 6, "赤"), (4, 0, 8, "青と")], "track_id long, window_idx long, work_id long, text string")
    terms = spark.createDataFrame([(7, "term", "赤い花"), (7, "term", "黒"), (7, "cv", "名"), (7, "character", "人"), (7, "character", ""), (8, "term", "青")], "work_id long, kind string, ja string")
    got = windows.window_entries(windows.glossary_hits(w, terms.where("kind = 'term'").drop("kind")), terms)
    assert sorted((r["track_id"], r["kind"], r["ja"]) for r in got.where("kind is not null").collect()) == [(1, "character", "人"), (1, "cv", "名"), (1, "term", "赤い花"), (2, "character", "人"), (2, "cv", "名"), (4, "term", "青")]
    assert [(r["track_id"], r["ja"]) for r in got.where("kind is null").collect()] == [(3, None)]


def test_sentence_list_splits_texts_too(spark):
    s = spark.createDataFrame([(1, 1, 900, 950, "う"), (1, 0, 0, 800, "あ。 い？"), (2, 0, 5, 9, "")], "track_id long, seg_idx long, start_ms long, end_ms long, text string")
    got = {r["track_id"]: ([tuple(x) for x in r["sentences"]], r["split"]) for r in report.sentence_list(s).collect()}
    assert got == {1: ([("あ。 い？", 0, 800), ("う", 900, 950)], ["あ。", "い？", "う"]), 2: ([("", 5, 9)], [])}


def test_term_bands_of_any_width(spark):
    rng = random.Random(8)
    rows = [(t, i + 1, 1, "".join(rng.choice("あい") for _ in range(rng.randrange(0, 30)))) for t in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "track_id long, id long, work_id long, text string")
    words = ["あい", "い" * 9, "あいああ", "ああいいあ", "".join(r[3] for r in rows if r[0] == 1)[50:190]]  # one term is longer than bands and segments
    terms = spark.createDataFrame([(1, k, w, 10) for k, w in enumerate(words)], "work_id long, term_id long, ja string, chars long")
    want = set()
    for t in range(3):
        own = [(r[1], c) for r in rows if r[0] == t for c in r[3]]
        text = "".join(c for _, c in own)
        for k, w in enumerate(words):
            ends = {}
            for at in range(len(text) - len(w) + 1):
                if text.startswith(w, at):
                    ends.setdefault(own[at][0], own[at + len(w) - 1][0])
            want |= {(t, k, first, last) for first, last in ends.items()}
    overlap = terms.groupBy("work_id").agg((F.max(F.length("ja")) - 1).cast("long").alias("more"))
    for width in (7, 64, 8192):
        got = windows.term_spans(windows.text_bands(df, overlap, width), terms).groupBy("track_id", "term_id", "first").agg(F.min("id").alias("id")).collect()
        assert {(r["track_id"], r["term_id"], r["first"], r["id"]) for r in got} == want


def test_term_places_over_borders(spark):
    rng = random.Random(6)
    rows = [(t, i + 1, 1, "".join(rng.choice("あいう") for _ in range(rng.randrange(0, 4)))) for t in range(8) for i in range(12)]
    words = ["あ", "いう", "あいう", "ううああ", "いあいうあ"]
    terms = spark.createDataFrame([(1, k, w, 10) for k, w in enumerate(words)], "work_id long, term_id long, ja string, chars long")
    got = {(r["track_id"], r["term_id"], r["first"], r["id"]) for r in windows.term_places(spark.createDataFrame(rows, "track_id long, id long, work_id long, text string"), terms).collect()}
    for t in range(8):
        own = [r[3] for r in rows if r[0] == t]
        for a in range(12):
            for b in range(a, 12):
                held = {k for k, w in enumerate(words) if w in "".join(own[a : b + 1])}
                assert held == {k for tt, k, first, last in got if tt == t and first > a and last <= b + 1}


def test_pages_and_records(spark):
    html = '<p id="work_name2">no</p><h1 id="work_name"> A &amp; B </h1><i class="maker_names">no</i><span class="a maker_name b"><a>M</a></span><table><tr><th>声優</th>\n<td> x / y </td></tr></table><div class="work_parts_container">one<div>two<div>three</div></div> four</div><div>five</div>'
    row = spark.range(1).select(metadata.product_page(F.lit(html)).alias("p"), metadata.product_page(F.lit("<p>none</p>")).alias("q")).select("p.*", F.col("q.title").alias("none")).first()
    assert list(row) == ["A & B", "M", "x / y", "onetwothree four", None]
    records = ['{"id": 5, "box": {"id": "x"}, "tags": ["x[1]", "y", 3], "channel": "a \\"b\\" \\u3042"}', '{"id": "k", "uploader": 1, "creator": "c", "tags": [], "webpage_url": "u"}', "broken", None]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "i int, r string").select("i", metadata.info_record(F.col("r")).alias("x")).orderBy("i").select("x.id", "x.uploader", "x.tags", "x.webpage_url").collect()
    assert [tuple(r) for r in got] == [("unknown", 'a "b" あ', ["x[1]", "y"], None), ("k", "c", None, "u"), ("unknown", None, None, None), ("unknown", None, None, None)]


def test_sentence_times_of_long_segments(spark):
    from speechjobs.jobs import translate
    from speechjobs.sources import fixtures

    sf = "/root/testdata/sf0.001"
    long = fixtures.segments(spark, sf).where("length(text) >= 400").select("track_id", F.explode(align.sentences(F.col("text"))).alias("text")).distinct()
    got = translate.sentence_times(spark, sf).select("track_id", "text")
    assert long.count() and not long.join(got, ["track_id", "text"], "left_anti").count()
