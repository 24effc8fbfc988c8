"""Hand cases, properties and file formats of the timed-text operators."""

import itertools
import json
import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from spanloom import oracle, queries
from spanloom.functions import exprs
from spanloom.operators import captions, crop, edit, hooks, intervals, pacing, scoring, voice, windows
from spanloom.plans import jobs
from spanloom.sources import transcripts


def rows(df, *order):
    return [r.asDict(recursive=True) for r in df.orderBy(*order).collect()]


def test_scores(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(["62.5", "63.5", "true", "85", "x", None, "NaN", "Infinity", "-3", " 7 "])], "i int, v string")
    got = [r.s for r in df.select("i", exprs.clamp_score(F.col("v")).alias("s")).orderBy("i").collect()]
    assert got == [62, 64, 1, 85, 0, 0, 0, 100, 0, 7]
    m = spark.sql("select map('hook', null, 'pacing', '80') as m").select(scoring.retention_scores(F.col("m"), F.lit(50), F.lit(None).cast("int")).alias("s")).first().s
    assert m["hook"] == 0 and m["pacing"] == 68 and m["payoff"] == 50


def test_text_and_time(spark):
    one = spark.range(1)
    clock = lambda x: one.select(exprs.clock(F.lit(x)).alias("c")).first().c
    assert [clock(-1.0), clock(59.996), clock(3599.999), clock(3661.25)] == ["0:00:00.00", "0:01:00.00", "1:00:00.00", "1:01:01.25"]
    f = one.select(exprs.escape_caption(F.lit("{a}\\b")).alias("e"), exprs.caption_token(F.lit("„Știi!”")).alias("t"), exprs.pacing_token(F.lit("\n ămm.")).alias("p"), exprs.language_of(F.lit("și the")).alias("l"), exprs.word_count(F.lit(" a b  c ")).alias("n")).first()
    assert (f.e, f.t, f.p, f.l, f.n) == ("\\{a\\}\\\\b", "știi", "ămm", "ro", 3)


def test_json_arrays_keep_places(spark):
    text = json.dumps(["note", {"a": 1}, '{"a": 2}', None, {"a": None}])
    got = spark.createDataFrame([(text,), ("x",), (None,), ('{"a": 1}',)], "t string").select(exprs.json_objects(F.col("t")).alias("o")).collect()
    assert [[(o.pos, dict(o.obj)) for o in r.o] for r in got] == [[(1, {"a": "1"}), (4, {"a": None})], [], [], []]


def test_windows_and_suppression(spark):
    seg = spark.createDataFrame([(1, i, i * 10.0, i * 10.0 + 9, f"s{i}") for i in range(8)], "video_id long, seg_idx int, start double, end double, text string")
    links = rows(windows.sliding_windows(seg), "window_idx", "seg_idx")
    brute = [(k, i) for k in range(3) if k * 30 < 79 for i in range(8) if i * 10 + 9 >= k * 30 and i * 10 <= min(k * 30 + 45, 79)]
    assert [(r["window_idx"], r["seg_idx"]) for r in links] == brute
    cand = spark.createDataFrame([(1, 0, 0.0, 45.0, 90), (1, 1, 30.0, 75.0, 90), (1, 2, 60.0, 75.0, 95), (1, 3, 90.0, 135.0, 61)], "video_id long, window_idx int, start double, end double, score int")
    assert [(r["cand_idx"], r["window_idx"]) for r in rows(windows.suppress_overlaps(cand), "cand_idx")] == [(0, 2), (1, 0)]


def words_table(spark, words):
    return spark.createDataFrame([(1, 0, i, w, a, b, words[0][1], words[-1][2]) for i, (w, a, b) in enumerate(words)], "video_id long, seg_idx int, word_idx int, word string, start double, end double, seg_start double, seg_end double")


def test_pacing_with_and_without_words(spark):
    words = words_table(spark, [("So", 0.0, 0.2), ("um", 0.3, 0.5), ("um,", 0.6, 0.8), ("go", 2.0, 2.2)])
    spans = spark.createDataFrame([(1, 0, 0.0, 4.0), (1, 1, 50.0, 60.0)], "video_id long, cand_idx int, start double, end double")
    a, b = rows(pacing.of_spans(words, spans, ["video_id", "cand_idx"]), "cand_idx")
    assert (a["word_count"], a["filler_count"], a["repeated_word_count"], a["long_pause_seconds"], a["risks"][0]["severity"]) == (4, 2, 1, 1.2, 75)
    assert (b["word_count"], b["pacing_score"], b["information_density_proxy"], b["risks"]) == (0, 78, 30, [])


def test_merge_snap_timeline_removed(spark):
    key = ["video_id", "cand_idx"]
    p = spark.createDataFrame([(1, 0, 0, 0.0, 2.0, "hook", "a"), (1, 0, 1, 0.0, 2.0, "bridge", "x"), (1, 0, 2, 2.05, 4.0, "hook", "b"), (1, 0, 3, 1.0, 3.0, "hook", ""), (1, 0, 4, 3.0, 3.0, "hook", "")], "video_id long, cand_idx int, seg_pos int, start double, end double, role string, reason string")
    m = rows(intervals.merge_pieces(p, key), "seg_pos")
    assert [(r["start"], r["end"], r["reason"]) for r in m] == [(0.0, 4.0, "a; b"), (1.0, 3.0, "")]
    t = rows(intervals.timeline(p, key), "index")
    assert [r["index"] for r in t] == [0, 1, 2, 3] and all(abs(a["target_end"] - b["target_start"]) < 1e-9 for a, b in itertools.pairwise(t))
    points = spark.createDataFrame([(1, 0, 0, 5.0), (1, 0, 1, 9.0)], "video_id long, cand_idx int, point int, at double")
    bounds = spark.createDataFrame([(1, 0, 4.5), (1, 0, 5.5), (1, 0, 10.0)], "video_id long, cand_idx int, bound double")
    assert [r["at"] for r in rows(intervals.snap(points, bounds, key, "at"), "point")] == [4.5, 9.0]
    c = spark.createDataFrame([(1, 0, 0.0, 10.0)], "video_id long, cand_idx int, start double, end double")
    gone = rows(intervals.removed(c, p.where("seg_pos in (0, 3)"), key), "start")
    assert [(r["start"], r["end"]) for r in gone] == [(3.0, 10.0)]


def test_edit_costs_and_variants(spark):
    p = spark.createDataFrame([(1, 0, 0, i, s, s + 2.0, "hook", "") for i, s in enumerate([0.0, 30.0, 10.0, 13.0, 16.0])], "video_id long, cand_idx int, variant_pos int, seg_pos int, start double, end double, role string, reason string")
    r = edit.variant_costs(p).first()
    assert (r.duration, r.edit_penalty, r.n_pieces) == (10.0, 1.5 + 2.0 + 6.0, 5)


def test_buckets(spark):
    key = ["video_id"]
    clips = spark.createDataFrame([(1, 12.5), (2, 0.0)], "video_id long, duration double")
    item = spark.createDataFrame([(1, 0.0, 5.0, 100)], "video_id long, start double, end double, weight int")
    got = rows(edit.retention_buckets(clips, item, item.limit(0), key), "bucket")
    assert [(r["end"], r["score"], r["label"]) for r in got] == [(5.0, 100, "very_good"), (10.0, 60, "medium"), (12.5, 60, "medium")]


def test_hooks(spark):
    hooks_json = json.dumps([{"text": "Why this matters", "generated": True, "evidence": [1]}, {"text": "Did you know x", "generated": True}, {"text": "", "generated": True}, {"text": "cut", "source_start": 5, "source_end": 4}, {"text": "kept", "source_start": 5, "source_end": 8}, "x"])
    df = spark.createDataFrame([(1, 0, hooks_json)], "video_id long, cand_idx int, hooks_json string")
    ctx = spark.createDataFrame([(1, 0, 0.0, 7.0)], "video_id long, cand_idx int, context_start double, context_end double")
    got = rows(hooks.normalize(df, ctx), "hook_pos")
    assert [(r["hook_pos"], r["source_end"], r["application"]) for r in got] == [(0, None, "voiceover_tts_candidate"), (1, None, "voiceover_tts_candidate"), (4, 7.0, "extractive_audio")]
    assert got[0]["score"] - got[1]["score"] == 30


def brute_cost(costs):
    best = math.inf
    for sizes in itertools.product((1, 2, 3), repeat=len(costs)):
        at, total = 0, 0.0
        for k in sizes:
            if at == len(costs):
                break
            if at + k > len(costs):
                total = math.inf
                break
            total += costs[at][k - 1]
            at += k
        if at == len(costs):
            best = min(best, total)
    return best


def test_best_split_is_cheapest():
    rng = random.Random(3)
    for n in range(1, 8):
        costs = [tuple(rng.choice([math.inf, rng.uniform(-5, 9)]) if k else rng.uniform(-5, 9) for k in range(3)) for _ in range(n)]
        sizes, at, total = captions.best_split(costs), 0, 0.0
        for k in sizes:
            total += costs[at][k - 1]
            at += k
        assert at == n and abs(total - brute_cost(costs)) < 1e-9


def test_captions_end_to_end(spark):
    text = "You know what happened next. It took 20 minutes to get there, and Ana Pop was late".split()
    at, data = 0.0, []
    for i, w in enumerate(text):
        data.append((1, 0, i, w, at, at + 0.3))
        at += 0.3 + (0.6 if w.endswith(".") else 0.05)
    df = spark.createDataFrame(data, "video_id long, clip_idx int, place int, word string, start double, end double")
    key = ["video_id", "clip_idx"]
    groups = captions.caption_groups(captions.group_words(df, key), key)
    got = rows(groups, "group_idx")
    assert " ".join(g["text"] for g in got).split() == text and all(1 <= len(g["words"]) <= 3 for g in got)
    assert any("Ana Pop" in g["text"] for g in got) and any("20 minutes" in g["text"] for g in got)
    events = captions.word_events(groups, key)
    assert events.count() == len(text) and rows(events, "start")[0]["text"].startswith("{\\c&H0000FFFF}{\\fscx90")
    doc = captions.documents(events, key, ["group_idx", "active_index"]).first().document
    assert doc.startswith("[Script Info]\n") and doc.count("\nDialogue: 0,") == len(text) and "Style: Default,Anton,92," in doc
    assert captions.style_of(" TikTok")["margin_v"] == 145 and captions.style_of("nope") == captions.style_of(None)


def test_voice(spark):
    df = spark.createDataFrame([(1, "a bb, ccccccccccc", 2.0), (2, "  ", 1.0)], "video_id long, text string, duration double")
    got = rows(voice.word_timings(df, ["video_id"]), "w_idx")
    assert [(r["word"], r["end"]) for r in got] == [("a", 0.1818), ("bb,", 0.5455), ("ccccccccccc", 2.0)]
    speeds = spark.createDataFrame([(0.3,), (1.5,), (2.0,), (5.0,)], "s double").select(voice.tempo_factors(F.col("s")).alias("f")).collect()
    assert [list(r.f) for r in speeds] == [[0.5], [1.5], [2.0], [2.0, 2.0, 1.25]]
    routes = rows(voice.routed(spark.createDataFrame([(1, "ro"), (2, "AUTO"), (3, "fr")], "i int, l string"), F.col("l"), F.lit(None).cast("string")), "i")
    assert [(r["provider"], r["voice"]) for r in routes] == [("windows_sapi", ""), ("kokoro", "af_heart"), ("kokoro", "ff_siwis")]


def test_voice_over_with_and_without_hooks_audio_and_files(spark):
    clips = spark.createDataFrame([(1, k, 20.0) for k in range(1, 6)], "video_id long, clip_idx int, duration double")
    hooks_ = spark.createDataFrame([(1, k, "why it works", "question", 70, "en") for k in (1, 2, 3, 5)], "video_id long, clip_idx int, text string, type string, score int, language string")
    audio = spark.createDataFrame([(1, 1, 1.5, None), (1, 2, 9.0, None), (1, 3, None, "broken"), (1, 5, 1.0, None)], "video_id long, clip_idx int, hook_duration double, error string")
    anchors = spark.createDataFrame([(1, 1, 0, 8.0, 10.0, 10), (1, 1, 1, 2.0, 4.0, 90)], "video_id long, clip_idx int, pos int, start double, end double, importance int")
    out, missing = voice.applied(clips, hooks_, audio, clips.where("clip_idx < 5"), anchors, ["video_id", "clip_idx"])
    a, b, c, d = rows(out, "clip_idx")
    assert (a["applied"], a["hook_duration"], a["voice"], a["teaser"]["start"], a["teaser"]["source"]) == (True, 1.5, "af_heart", 2.25, "retention_anchor")
    assert (b["hook_duration"], b["teaser"]["source"], b["word_timings"][-1]["end"], b["transition"]["original_audio_start"]) == (4.0, "clip_start", 4.0, 4.0)
    assert (c["applied"], c["reason"], c["text"], d["applied"], d["reason"]) == (False, "broken", None, False, "no_valid_generated_hook")
    assert [r["clip_idx"] for r in rows(missing, "clip_idx")] == [5]


def test_plain_frame_pauses_and_single_words(spark):
    words = spark.createDataFrame([([("a", 0.0, 0.2), ("{b}", 0.3, 0.4)],)], "w array<struct<word:string,start:double,end:double>>")
    assert words.select(captions.rendered(F.col("w"), None, "capcut").alias("t")).first().t == "{\\c&H00FFFFFF\\fscx100\\fscy100}a {\\c&H00FFFFFF\\fscx100\\fscy100}\\{b\\}"
    pause = spark.range(1).select(exprs.has_pause(F.lit(1.0), F.lit(1.5)).alias("a"), exprs.has_pause(F.lit(1.0), F.lit(1.25)).alias("b")).first()
    assert (pause.a, pause.b) == (True, False)
    start, end = [0.0, 0.3, 0.6, 3.0, 4.0], [0.25, 0.55, 0.9, 3.2, 4.3]
    assert captions.joined_singles([[0, 1], [2], [3], [4]], start, end) == [[0, 1, 2], [3], [4]]
    assert captions.joined_singles([[0], [1, 2], [3]], start, end) == [[0, 1, 2], [3]]


def test_crop(spark):
    clips = spark.createDataFrame([(1, 0, 1920, 1080, 1.2), (1, 1, 1920, 1080, 0.0)], "video_id long, clip_idx int, width int, height int, duration double")
    boxes = spark.createDataFrame([(1, 0, 0.0, "face", 0, 900.0, 300.0, 100.0, 100.0), (1, 0, 0.5, "none", 0, 0.0, 0.0, 0.0, 0.0), (1, 0, 1.0, "person", 0, 1800.0, 300.0, 100.0, 100.0)], "video_id long, clip_idx int, t double, kind string, box_pos int, x double, y double, w double, h double")
    key = ["video_id", "clip_idx"]
    points = rows(crop.crop_track(boxes, clips, key), "clip_idx", "n")
    assert [p["source"] for p in points] == ["face", "previous", "person", "person", "center"] and points[2]["center_x"] < 1000
    docs = rows(crop.crop_commands(crop.crop_track(boxes, clips, key), clips, key), "clip_idx")
    assert docs[0]["document"].count("\n") == 6 and docs[1]["document"].startswith("0.000 crop@smart x ")


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark):
    return queries.derived(spark, SMALL)


@pytest.mark.parametrize("name", ["idea_spans", "boundary_costs", "caption_groups", "caption_events"])
def test_every_window_with_words_is_captioned(small, name):
    words = [r for r in small.words.collect() if r.word.strip()]
    spoken = {(s.video_id, s.window_idx) for s in small.spans.collect() for w in words if w.video_id == s.video_id and s.start <= (w.start + w.end) / 2 <= s.end and w.seg_end >= s.start and w.seg_start <= s.end}
    assert any(k % 2 for _, k in spoken)
    assert {(r.video_id, r.window_idx) for r in getattr(queries, name)(small).select("video_id", "window_idx").distinct().collect()} == spoken


def plain(value):
    return "~" if value is None or value != value else repr(float(value)) if isinstance(value, int | float) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_queries_equal_sql(small, name):
    db = duckdb.connect()
    for table in ("conversations", "documents"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    want = db.execute(oracle.SQL[name])
    names = [c[0] for c in want.description]
    got = getattr(queries, name)(small)
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(map(plain, r)) for r in got.select(*(f"`{c}`" for c in names)).collect()) == sorted(tuple(map(plain, r)) for r in want.fetchall())


def test_teasers_with_and_without_anchors(spark, small):
    assert {r.teaser_source for r in queries.voice_mix(small).select("teaser_source").distinct().collect()} == {"retention_anchor"}
    clips = spark.createDataFrame([(1, 30.0, 2.0), (2, 30.0, 2.0)], "video_id long, duration double, hook_duration double")
    anchors = spark.createDataFrame([(1, 0, 10.0, 14.0, 50)], "video_id long, pos int, start double, end double, importance int")
    got = rows(voice.teasers(clips, anchors, ["video_id"]), "video_id")
    assert [(r["teaser_start"], r["teaser_end"], r["teaser_source"]) for r in got] == [(11.0, 13.0, "retention_anchor"), (0.0, 2.0, "clip_start")]


def test_crop_follows_whole_clips(small):
    length = {(r.video_id, r.cand_idx): r.end - r.start for r in small.best.collect()}
    assert max(length.values()) > 20
    points = queries.crop_points(small).groupBy("video_id", "clip_idx").agg(F.max("time").alias("last"), F.count("*").alias("n")).collect()
    assert {(r.video_id, r.clip_idx) for r in points} == set(length)
    for r in points:
        whole = length[r.video_id, r.clip_idx]
        samples = math.floor((whole + 0.001) * 2) + 1
        assert r.n == samples + ((samples - 1) / 2 < whole) and whole <= r.last <= whole + 0.001
    for r in queries.crop_commands(small).select("video_id", "clip_idx", "n_chars").collect():
        assert r.n_chars > 100 * length[r.video_id, r.clip_idx]


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seg = [{"start": 0.0, "end": 1.0, "text": "hi", "words": [{"word": "hi", "start": 0.0, "end": 0.5}]}]
    (tmp_path / "in/a.b.json").write_text(json.dumps(seg))
    (tmp_path / "in/empty.json").write_text("[]")
    (tmp_path / "in/bad.json").write_text("nope")
    segments, words, bad = transcripts.read_transcripts(spark, str(tmp_path / "in"))
    assert segments.first().video_id == "a.b" and words.first().word == "hi" and {r.video_id for r in bad.collect()} == {"empty", "bad"}
    many = spark.createDataFrame([(str(i), i) for i in range(40)], "video_id string, x int")
    transcripts.write_table(many, str(tmp_path / "t"), buckets=8)
    transcripts.write_table(segments, str(tmp_path / "t"), buckets=8)
    assert transcripts.read_table(spark, str(tmp_path / "t")).count() == 1
    transcripts.clean_outputs(spark, str(tmp_path / "t"), str(tmp_path / "new"))
    assert not list((tmp_path / "t").glob("*")) and (tmp_path / "new").is_dir()
    (tmp_path / "r.jsonl").write_text(json.dumps({"video_id": 1, "window_idx": 2, "reply_json": "{}"}) + "\n")
    given = transcripts.read_replies(spark, str(tmp_path / "r.jsonl"), ["video_id", "window_idx"])
    given.write.parquet(str(tmp_path / "r"))
    assert given.collect() == transcripts.read_replies(spark, str(tmp_path / "r"), ["video_id", "window_idx"]).collect() and given.first().window_idx == 2
    transcripts.write_documents(spark.createDataFrame([(1, "x\ny\n")], "k int, document string"), str(tmp_path / "d"), ["k"])
    assert next((tmp_path / "d/k=1").glob("*.txt")).read_text() == "x\ny\n"


def test_last_candidate_too_short_to_cut(spark, tmp_path):
    """A recording whose last window is 0.025 s long: its clip has no valid cut, in the queries and in their SQL."""
    db = duckdb.connect()
    for table, key, odd in (("conversations", "conv_id", 711), ("documents", "doc_id", 2859)):
        db.execute(f"COPY (SELECT * FROM '/root/testdata/sf0.1/{table}.parquet' WHERE {key} = {odd}) TO '{tmp_path}/{table}.parquet'")
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    data = queries.derived(spark, str(tmp_path))
    for name in ("run_summary", "long_summary", "clip_rejects"):
        want = db.execute(oracle.SQL[name])
        got = getattr(queries, name)(data).select(*(c[0] for c in want.description)).collect()
        assert sorted(map(tuple, got)) == sorted(want.fetchall())
        assert name == "clip_rejects" or all(r.exported < r.clips for r in got)


def test_samples_of_clips_are_not_broadcast(small):
    """Samples derived from the clips' files look as small as those; sent whole to every executor they fail on many clips."""
    clips = queries._framed(small)
    plan = crop.crop_track(queries.fixtures.detections(clips), clips, ["video_id", "clip_idx"])._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


@pytest.mark.parametrize("name", [f.__name__ for f in queries._ALL if f.__name__ != "caption_styles"])
def test_no_query_broadcasts_rows(small, name):
    """Rows made from files of few bytes may be many: broadcast, they would all be in the driver's memory."""
    assert "Broadcast" not in getattr(queries, name)(small)._jdf.queryExecution().executedPlan().toString()


def test_no_saved_table_of_the_jobs_broadcasts_rows(small, monkeypatch):
    """The replies of candidates, for one, took 7 KB a candidate in the driver."""
    plans, save = {}, jobs.save
    monkeypatch.setattr(jobs, "save", lambda df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or save(df, name))
    jobs.optimise(small.segments, small.words, small.candidates, queries.fixtures.analysis_replies)
    assert {"contexts", "analyses", "cleaned", "evaluated", "hooks", "clips", "items"} <= set(plans)
    assert [name for name, plan in plans.items() if "Broadcast" in plan] == [] and "SortMergeJoin" in plans["analyses"]


def test_replies_are_spread_over_tasks(small):
    """Replies take much time for few bytes, so their files are not left to their size."""
    assert len(small.retention.analyses.inputFiles()) > 1


def test_methods_of_captions_are_compiled(spark, small):
    """The JVM never compiles a method of more than 8,000 bytes, and a key's words are sorted once, neither dealt nor sorted again for Python."""
    words = captions.prepared(queries._window_places(small), queries.W)
    rows_ = captions.word_events(captions.captions_of(queries._window_places(small), queries.W), queries.W)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plans = [df._jdf.queryExecution() for df in (captions.with_group_costs(captions.idea_spans(words, queries.W), queries.W), rows_)]
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
        texts = [p.explainString(mode) for p in plans]
        plan = plans[1].executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert all(int(n) < 8000 for text in texts for n in re.findall(r"maxMethodCodeSize:(\d+)", text))
    assert plan.count("Sort [") == 1 + 2 * plan.count("SortMergeJoin") and "ArrowEvalPython" not in plan and "FlatMapGroups" not in plan


def test_captions_do_not_depend_on_batches(spark, small):
    """A window's words may come in several batches, and a batch may end with a window."""
    want = sorted(map(str, queries.caption_groups(small).collect()))
    for size in ("1", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            assert sorted(map(str, queries.caption_groups(small).collect())) == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert captions.captions_of(queries._window_places(small).limit(0), queries.W).count() == 0


def test_plain_words_need_no_expressions(spark):
    words = ["abc", "abc\n", "Ana", "20", "3,5", "x.", " y ", "", "știi", "„Bb”", None, "a b", "_a_", "Z", "a\nb"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    w = F.col("w")
    got = df.select(exprs.pacing_token(w), exprs.caption_token(w), exprs.is_number(w), exprs.is_capitalized(w), exprs.clean_word(w), exprs.escape_caption(w)).collect()
    assert [tuple(r) for r in got[:4]] == [("abc", "abc", False, False, "abc", "abc"), ("abc", "abc", False, False, "abc", "abc\n"), ("ana", "ana", False, True, "Ana", "Ana"), ("20", "20", True, False, "20", "20")]
    assert [tuple(r)[:5] for r in got[4:]] == [("3,5", "3,5", True, False, "3,5"), ("x", "x", False, False, "x."), ("y", "y", False, False, "y"), ("", "", False, False, ""), ("știi", "știi", False, False, "știi"), ("bb", "bb", False, True, "„Bb”"), (None, None, None, None, ""), ("a b", "a b", False, False, "a b"), ("_a_", "_a_", False, False, "_a_"), ("z", "z", False, False, "Z"), ("a\nb", "a\nb", False, False, "a b")]


def test_tasks_that_read_words_hold_no_bounds(small):
    """Bounds are dealt before they are made distinct: a table of bounds in the tasks that read words would grow with the input."""
    df = queries.edit_bounds(small)
    above, below = df._jdf.queryExecution().executedPlan().toString().split("REPARTITION_BY_NUM")
    assert re.search(r"Aggregate\(keys=\[[^]]*bound", above) and not re.search(r"Aggregate\(keys=\[[^]]*bound", below)
    assert df.count() == df.distinct().count() > 0


def test_tokens_are_made_before_words_meet_spans(small):
    """A word lies in one or two windows; its token is made once, under the join."""
    plan = queries.pacing_windows(small)._jdf.queryExecution().optimizedPlan().toString()
    last_join = plan.rindex("Join Inner")
    assert "regexp_replace" in plan[last_join:] and "regexp_replace" not in plan[:last_join]


def test_pacing_by_parts_equals_pacing_at_once(spark):
    """Words that reach over buckets, overlap, end before they start or lie in no segment of theirs, in any order."""
    draw = random.Random(7)
    words = []
    for i in range(600):
        start = draw.randrange(0, 1900) / 10
        end = start + draw.choice([0.0, 0.2, 0.4, 0.9, 3.0, 40.0, 95.0, -0.5, -35.0])
        words.append((1 + i % 2, i // 20, i, draw.choice(["um", "a", "b", "!", "so"]), start, end, start + draw.choice([0.0, 0.0, 0.0, 50.0]), max(start, end)))
    words = spark.createDataFrame(words, "video_id long, seg_idx int, word_idx int, word string, start double, end double, seg_start double, seg_end double")
    spans = [(1 + i % 2, i, x, x + draw.choice([0.0, 5.0, 30.0, 45.0, 130.0, -4.0])) for i, x in enumerate(draw.randrange(0, 40) * 5.0 for _ in range(60))]
    spans = spark.createDataFrame(spans, "video_id long, cand_idx int, start double, end double")
    key = ["video_id", "cand_idx"]
    inside = intervals.words_inside(pacing._tokens(words), spans).withColumnRenamed("word", "token")
    want = pacing.measured(inside, spans.select(*key, (F.col("end") - F.col("start")).alias("duration")), key, ["start", "end", "seg_idx", "word_idx"])
    got = rows(pacing.of_spans(words, spans, key), *key)
    assert got == rows(want, *key) and max(r["word_count"] for r in got) > 50 and any(r["risks"] for r in got) and sum(r["repeated_word_count"] for r in got) > 20


def test_words_of_spans_are_dealt_once(small):
    """Words go through one shuffle, to where they meet their spans; behind it only sums do."""
    plan = queries.pacing_windows(small)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[plan.index("last(_token") : plan.rindex("SortMergeJoin")]
