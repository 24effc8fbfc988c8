"""The store: what readers see while runs fail, repeat and patch; jobs from files to files; whole items; sums in two levels."""

import json

import pytest
from pyspark.sql import functions as F

from spanloom import fixtures, queries
from spanloom.operators import edit, intervals
from spanloom.plans import files, jobs
from spanloom.sources import store, transcripts
from spanloom.sources.store import Store

SMALL = "/root/testdata/sf0.001"


def table(spark, rows):
    return spark.createDataFrame(rows, "video_id string, k int, x string")


def content(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_smaller_run_leaves_no_stale_bucket(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.publish(a=table(spark, [(str(i), i, "x") for i in range(60)]), b=table(spark, []))
    assert s.read("a").count() == 60 and s.read("b").collect() == [] and s.read("b").columns == ["video_id", "k", "x"]
    before = s.read("a")
    s.publish(a=table(spark, [("1", 1, "y")]))
    assert content(s.read("a")) == [("1", 1, "y")] and "b" not in s.tables() and before.count() == 60
    s.clean(keep=1)
    assert content(s.read("a")) == [("1", 1, "y")] and len(list((tmp_path / "s/runs").iterdir())) == 1


def test_failed_and_repeated_runs(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.publish(a=table(spark, [("1", 1, "x")]))
    bad = table(spark, [("2", 2, "y")]).withColumn("x", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        s.publish(a=table(spark, [("2", 2, "y")]), b=bad)
    assert content(s.read("a")) == [("1", 1, "x")] and list(s.tables()) == ["a"]
    (tmp_path / "s/_manifests/000000002.json").write_text('{"a": {"schema"')  # a writer stopped halfway through its switch
    assert content(s.read("a")) == [("1", 1, "x")]
    for _ in range(2):
        s.publish(a=table(spark, [("2", 2, "y")]))
        assert content(s.read("a")) == [("2", 2, "y")]
    s.clean(keep=1)
    assert len(list((tmp_path / "s/runs").iterdir())) == 1 and content(s.read("a")) == [("2", 2, "y")]


def test_two_writers_get_different_numbers(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path / "s"))
    s.publish(a=table(spark, [("1", 1, "x")]))
    names = Store._names
    monkeypatch.setattr(Store, "_names", lambda self, folder: [] if folder == "_manifests" else names(self, folder))  # it has seen no manifest yet
    with pytest.raises(Exception, match="(?i)exist"):
        s.publish(a=table(spark, [("2", 2, "y")]))
    monkeypatch.undo()
    assert content(s.read("a")) == [("1", 1, "x")]


def test_upsert_touches_only_its_buckets(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    s.publish(a=table(spark, [(str(i), i, "x") for i in range(60)] + [(None, 7, "n"), (None, None, "m")]))
    folders, before = s.tables()["a"]["folders"], s.read("a")
    for _ in range(2):  # repeated
        s.upsert({"a": table(spark, [("3", 3, "new"), ("3", 4, "more"), (None, 7, "null")])}, ["video_id", "k"])
        want = [(str(i), i, "x") for i in range(60) if i != 3] + [("3", 3, "new"), ("3", 4, "more"), (None, 7, "null"), (None, None, "m")]
        assert content(s.read("a")) == sorted(want, key=repr)
    now = s.tables()["a"]["folders"]
    assert sum(now[b] != folders[b] for b in folders) == 2 and before.count() == 62 and content(before.where("k = 3")) == [("3", 3, "x")]
    s.upsert({"a": table(spark, [])}, ["video_id", "k"])
    assert s.tables()["a"]["folders"] == now


@pytest.fixture(scope="module")
def small(spark):
    return queries.derived(spark, SMALL)


def test_catalogue_from_files_failed_then_repeated(spark, small, tmp_path, monkeypatch):
    """The first run fails while it writes its audit; run again, then over fewer videos, and voices patched in twice."""
    some = small.segments
    for folder, keep in (("all", "true"), ("few", "video_id < 4")):
        transcripts.write_transcripts(some.where(keep), small.words.where(keep), str(tmp_path / folder))
    (tmp_path / "all/video_id=99").mkdir()
    (tmp_path / "all/video_id=99/x.txt").write_text("[]")
    fixtures.window_replies(small.spans).write.json(str(tmp_path / "w.jsonl"))
    fixtures.analysis_replies(small.best).write.parquet(str(tmp_path / "a"))
    run = lambda folder: files.edit_catalogue(spark, str(tmp_path / folder), str(tmp_path / "w.jsonl"), str(tmp_path / "a"), str(tmp_path / "out"), kind="bigint")
    plain = jobs.audit
    monkeypatch.setattr(jobs, "audit", lambda *a: plain(*a).withColumn("error", F.raise_error(F.lit("stopped")).cast("string")))
    with pytest.raises(Exception, match="stopped"):
        run("all")
    assert Store(spark, str(tmp_path / "out")).tables() == {}
    monkeypatch.undo()
    r = run("all")
    s = Store(spark, str(tmp_path / "out"))
    assert [tuple(x) for x in s.read("rejects").collect()] == [(99, "empty transcript")]
    assert content(s.read("backup").select("video_id", "cand_idx", "score")) == content(small.candidates.select("video_id", "cand_idx", "score"))
    first = s.read("audit")
    assert first.where("voiceover is not null or selected.voiceover is not null").isEmpty()
    failed = first.where("error is not null").collect()
    assert failed and all(x.analysis is None and x.context is None and x.selected.strategy == "extractive_fallback" for x in failed)
    good = first.where("error is null").select(F.to_json("analysis").alias("a"), "cand_idx", "video_id").collect()
    given = {(x.video_id, x.cand_idx): json.loads(x.reply_json) for x in spark.read.parquet(str(tmp_path / "a")).collect() if x.reply_json.startswith("{")}
    assert good and all(json.loads(x.a) == given[x.video_id, x.cand_idx] for x in good)
    audio, there = fixtures.voice_audio(jobs.spoken_hooks(r)), fixtures.clip_files(r.clips)
    silent = {(x.video_id, x.clip_idx): x.document for x in s.read("documents").collect()}
    for _ in range(2):
        files.add_voices(spark, str(tmp_path / "out"), r, audio, there)
        said = {(x.video_id, x.clip_idx): x for x in s.read("clips").select("video_id", "clip_idx", "voiceover").collect()}
        with_file = {(x.video_id, x.clip_idx) for x in there.collect()}
        assert {k for k, x in said.items() if x.voiceover is not None} == with_file
        for x in s.read("audit").select("video_id", "selected", "voiceover").collect():
            assert x.voiceover == x.selected.voiceover == said[x.video_id, x.selected.clip_idx].voiceover
        spoken = {k for k, x in said.items() if x.voiceover is not None and x.voiceover.applied}
        now = {(x.video_id, x.clip_idx): x.document for x in s.read("documents").collect()}
        assert spoken and set(now) == set(silent) and {k for k in now if now[k] != silent[k]} == spoken
    assert first.count() == s.read("audit").count()  # the older version can still be read
    run("few")
    assert {x.video_id for x in s.read("clips").select("video_id").distinct().collect()} == {x.video_id for x in r.clips.where("video_id < 4").select("video_id").distinct().collect()}


def test_items_keep_what_they_say(spark):
    top = {"retention_anchors": json.dumps([{"start": 1, "end": 9, "type": "claim", "importance": "70", "extra": {"a": [1, None]}}, "note", {"start": "x"}, {"start": 4, "reason": None}])}
    analyses = spark.createDataFrame([(1, 0, top)], "video_id long, cand_idx int, top map<string,string>")
    line = spark.createDataFrame([(1, 0, 0, 0.0, 2.0, 0.0, 2.0, "hook"), (1, 0, 1, 5.0, 8.0, 2.0, 5.0, "payoff")], "video_id long, cand_idx int, index int, source_start double, source_end double, target_start double, target_end double, role string")
    told = edit.described(edit.read_items(analyses))
    got = edit.nested(intervals.remap_items(told, line, edit.C), edit.C, "items", ["pos", "index"]).select("items", F.transform("items", lambda x: F.to_json(x["item"])).alias("given")).first()
    assert [(x.pos, x["index"], x.source_start, x.source_end, x.start, x.end, x.weight, x.type, x.reason) for x in got["items"]] == [(0, 0, 1.0, 2.0, 1.0, 2.0, 70, "claim", None), (0, 1, 5.0, 8.0, 2.0, 5.0, 70, "claim", None)]
    assert all(json.loads(g) == {"start": 1, "end": 9, "type": "claim", "importance": "70", "extra": {"a": [1, None]}} for g in got.given)


def test_half_of_the_edits_win(small):
    chosen = small.retention.selected.select("variant_pos", "n_pieces").collect()
    assert sum(r.n_pieces > 1 for r in chosen) >= len(chosen) / 2 and {r.variant_pos for r in chosen} >= {0, 1000}


def test_long_recordings_have_more_candidates_than_are_edited_and_contexts_over_the_limit(small):
    assert queries.long_summary(small).where("skipped > 0").count() > 0
    sizes = [r.n_chars for r in queries.long_context_text(small).select("n_chars").collect()]
    assert 2500 in sizes and min(sizes) < 2500


def test_sums_of_one_long_recording_in_blocks(spark, monkeypatch):
    """A recording with nearly all segments, gaps between them: sums equal plain ones, and no window holds more than a block."""
    monkeypatch.setattr(fixtures, "BLOCK", 16)
    rows = [(1, i * 3, i % 7) for i in range(500)] + [(2, 5, 9), (3, 0, 0), (3, 1000, 4)]
    df = spark.createDataFrame(rows, "video_id long, seg_idx int, n int")
    want, total = [], {}
    for v, i, n in rows:
        want.append((v, i, total.get(v, 0)))
        total[v] = total.get(v, 0) + n
    assert sorted(map(tuple, fixtures.running(df, "n", "before").collect())) == sorted(want)
    assert fixtures.running(df, "n", "before").columns == ["video_id", "seg_idx", "before"]


def test_nullable_everywhere(spark):
    schema = spark.range(1).select(F.array(F.lit(1)).alias("a"), F.create_map(F.lit("k"), F.lit(2)).alias("m"), F.struct(F.lit(1).alias("x")).alias("s")).schema
    assert '"nullable":false' not in store._nullable(schema) and '"containsNull":false' not in store._nullable(schema)


def test_records_are_gathered_without_joins(small):
    """A record has a dozen parts, an audit record five more; joined one by one they would all be held or broadcast by one task."""
    r = small.retention
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    parts = [jobs.buckets(r), jobs.removed(r), r.selected_pieces, r.timeline, r.best_hooks, r.voice_hooks]
    assert joins(jobs.clip_records(r)) <= sum(map(joins, parts))
    assert joins(jobs.audit(r, small.voices[0])) <= 1 + joins(small.voices[0]) + joins(jobs.clip_records(r)) + joins(r.pacing) + joins(r.variants)


def test_many_transcripts_share_files(spark, small, tmp_path):
    """A folder and a file for each of many videos take most of a job's time; both forms read alike."""
    for name in ("in", "in.parquet"):
        transcripts.write_transcripts(small.segments, small.words, f"{tmp_path}/{name}")
    spark.createDataFrame([(-1, "no array"), (-2, "[]")], "video_id long, value string").write.mode("append").parquet(f"{tmp_path}/in.parquet")
    plain, packed = (transcripts.read_transcripts(spark, f"{tmp_path}/{name}", "bigint") for name in ("in", "in.parquet"))
    for a, b in zip(plain[:2], packed[:2], strict=True):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) != []
    assert sorted(r.reason for r in packed[2].collect()) == ["empty transcript", "no JSON array"]
    assert len(spark.read.parquet(f"{tmp_path}/in.parquet").inputFiles()) < small.segments.select("video_id").distinct().count() / 4


def test_upserted_rows_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    store = Store(spark, str(tmp_path))
    store.publish(t=spark.range(100).selectExpr("id as video_id", "0 as x"))
    store.upsert({"t": spark.range(50, 150, 1, 1).selectExpr("id as video_id", "1 as x").mapInArrow(counted, "video_id long, x int")}, ["video_id"])
    assert made.value == 100 and {(r.video_id, r.x) for r in store.read("t").collect()} == {(i, int(i >= 50)) for i in range(150)}
