"""The registered queries: one or more per operator, over timed text derived from the given tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom import fixtures
from spanloom.functions import exprs, fixed
from spanloom.operators import captions, crop, edit, hooks, intervals, pacing, voice, windows
from spanloom.plans import files, jobs
from spanloom.sources import scratch, transcripts
from spanloom.sources.store import Store

C, L = ["video_id", "cand_idx"], ["video_id", "clip_idx"]


class Data:
    """The derived tables of one data folder; each is written once, when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, lines=fixtures.lines):
        self.spark, self.sf_dir, self.folders = spark, sf_dir, set()
        self.words = self._save(fixtures.words(lines(spark, sf_dir)), "words")

    @cached_property
    def long(self) -> Data:
        """The same tables of a second catalogue, recordings of very different lengths."""
        out = Data(self.spark, self.sf_dir, fixtures.long_lines)
        self.folders |= out.folders
        return out

    def _save(self, df: DataFrame, name: str) -> DataFrame:
        out = scratch.save(df, name)
        self.folders |= {f.rsplit("/", 1)[0] for f in out.inputFiles()}
        return out

    def lost(self) -> bool:
        """Whether a derived table has gone from the shared folder."""
        return not all(scratch.exists(self.spark, f) for f in self.folders)

    @cached_property
    def segments(self) -> DataFrame:
        return self._save(fixtures.segments(self.words), "segments")

    @property
    def links(self) -> DataFrame:
        return windows.sliding_windows(self.segments)

    @cached_property
    def spans(self) -> DataFrame:
        return self._save(self.links.select("video_id", "window_idx", F.col("window_start").alias("start"), F.col("window_end").alias("end")).distinct(), "spans")

    @cached_property
    def scored(self) -> DataFrame:
        return self._save(windows.read_window_replies(self.spans, fixtures.window_replies(self.spans)), "scored")

    @cached_property
    def candidates(self) -> DataFrame:
        return self._save(windows.suppress_overlaps(self.scored), "candidates")

    @property
    def best(self) -> DataFrame:
        return windows.best_candidates(self.candidates)

    @cached_property
    def retention(self) -> jobs.Retention:
        return jobs.optimise(self.segments, self.words, self.candidates, fixtures.analysis_replies)

    @cached_property
    def voices(self) -> tuple[DataFrame, DataFrame]:
        r = self.retention
        records, missing = jobs.voice_over(r, fixtures.voice_audio(jobs.spoken_hooks(r)), fixtures.clip_files(r.clips))
        return self._save(records, "voices"), missing

    @cached_property
    def audit(self) -> DataFrame:
        return self._save(jobs.audit(self.retention, self.voices[0]), "audit")

    @cached_property
    def store(self) -> Store:
        """Transcripts and replies written as files, the job from files to files over them, and the voice-overs after it."""
        folder = scratch.folder(self.spark, "catalogue")
        transcripts.write_transcripts(self.segments, self.words, f"{folder}/transcripts.parquet")
        fixtures.window_replies(self.spans).write.json(f"{folder}/windows.json")
        fixtures.analysis_replies(self.best).write.parquet(f"{folder}/analyses")
        r = files.edit_catalogue(self.spark, f"{folder}/transcripts.parquet", f"{folder}/windows.json", f"{folder}/analyses", f"{folder}/out", kind="bigint")
        files.add_voices(self.spark, f"{folder}/out", r, fixtures.voice_audio(jobs.spoken_hooks(r)), fixtures.clip_files(r.clips))
        self.folders.add(f"{folder}/out/runs")
        return Store(self.spark, f"{folder}/out")

    @property
    def plain_pieces(self) -> DataFrame:
        """Three pieces per candidate, the last one backwards: edits that SQL can follow."""
        v, c = F.col("video_id"), F.col("start")
        cut = lambda n, a, d: F.struct(F.lit(n).alias("seg_pos"), (c + (v + a) % 12).alias("start"), (c + (v + a) % 12 + d).alias("end"))
        rows = self.best.select(*C, F.explode(F.array(cut(0, 3, 6.5), cut(1, 9, 8.25), cut(2, 1, 4.0))).alias("p"))
        return rows.select(*C, "p.seg_pos", "p.start", "p.end", F.lit("context").alias("role"))


_made: dict[tuple, Data] = {}


def derived(spark: SparkSession, sf_dir: str) -> Data:
    """The derived tables of a folder as it is now, shared by the queries of one session; made anew where they have gone."""
    key = (spark.sparkContext.applicationId, sf_dir, scratch.state(spark, f"{sf_dir}/conversations.parquet"))
    if key not in _made or _made[key].lost():
        _made[key] = Data(spark, sf_dir)
    return _made[key]


def forget() -> None:
    """The next query derives its tables anew."""
    _made.clear()


def _data(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(derived(spark, sf_dir))

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


def timed_words(d):
    return d.words


def timed_segments(d):
    return d.segments


def sliding_windows(d):
    return d.links.select("video_id", "window_idx", "window_start", "window_end", "seg_idx")


def window_text(d):
    return windows.window_text(d.links).select("video_id", "window_idx", "start", "end", "text")


def window_scores(d):
    return d.scored.select("video_id", "window_idx", "title", F.col("scores")["hook"].alias("hook"), F.col("scores")["information_density"].alias("density"), "score")


def candidates(d):
    return d.candidates.select("video_id", "cand_idx", "window_idx", "start", "end", "score")


def context_segments(d):
    return windows.context_segments(d.segments, windows.contexts(d.segments, d.best)).select(*C, "section", "seg_idx")


def context_text(d):
    bounds = windows.contexts(d.segments, d.best)
    text = windows.context_text(windows.context_segments(d.segments, bounds), bounds)
    return text.select(*C, F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def pacing_windows(d):
    return pacing.of_spans(d.words, d.spans, ["video_id", "window_idx"]).drop("risks")


def pacing_risks(d):
    rows = pacing.of_spans(d.words, d.spans, ["video_id", "window_idx"]).select("video_id", "window_idx", F.explode("risks").alias("r"))
    return rows.select("video_id", "window_idx", "r.*")


def pacing_edits(d):
    return pacing.of_edits(d.words, d.plain_pieces, C).drop("risks")


def best_windows(d):
    """The flagship: windows ranked by pacing score in each video, the first three."""
    rows = pacing.of_spans(d.words, d.spans, ["video_id", "window_idx"])
    order = Window.partitionBy("video_id").orderBy(F.desc("pacing_score"), F.desc("word_count"), "window_idx")
    return rows.withColumn("place", F.row_number().over(order)).where("place <= 3").select("video_id", "place", "window_idx", "word_count", "pacing_score")


def snapped_points(d):
    contexts = windows.contexts(d.segments, d.best)
    starts = edit.bounds_of(d.segments, d.words, contexts).where("side = 'start'").drop("side")
    points = d.plain_pieces.select(*C, "seg_pos", F.col("start").alias("at")).withColumn("point", F.struct(*C, "seg_pos"))
    return intervals.snap(points, starts, C, "at").select(*C, "seg_pos", "at")


def edit_bounds(d):
    return edit.bounds_of(d.segments, d.words, windows.contexts(d.segments, d.best))


def edit_timeline(d):
    return intervals.timeline(d.plain_pieces, C).drop("seg_pos")


def edit_words(d):
    return intervals.remap_words(d.words, d.plain_pieces, C)


def edit_removed(d):
    return intervals.removed(d.best, d.plain_pieces, C)


def edit_costs(d):
    return edit.variant_costs(d.plain_pieces.withColumn("variant_pos", F.lit(0)))


def edit_times(d):
    times = d.plain_pieces.select(*C, F.col("seg_pos").alias("point"), (F.col("start") + 2.5).alias("t"))
    return intervals.remap_times(times, intervals.timeline(d.plain_pieces, C), C)


def _plain_items(d):
    v, c = F.col("video_id"), F.col("start")
    item = lambda h: F.struct(F.lit(h).alias("pos"), (c + (h * 9 + v) % 40).alias("start"), (c + (h * 9 + v) % 40 + 3).alias("end"), ((v * 7 + h * 31) % 101).alias("weight"))
    return d.best.select(*C, F.explode(F.array(*map(item, range(5)))).alias("i")).select(*C, "i.*")


def edit_items(d):
    return intervals.remap_items(_plain_items(d), intervals.timeline(d.plain_pieces, C), C)


def edit_buckets(d):
    clips = d.plain_pieces.groupBy(*C).agg((F.sum(F.bround((F.col("end") - F.col("start")) * 1000)) / 1000).alias("duration"))
    items = intervals.remap_items(_plain_items(d), intervals.timeline(d.plain_pieces, C), C)
    return edit.retention_buckets(clips, items.where("pos % 2 = 0"), items.where("pos % 2 = 1"), C)


def discovered(d):
    """The discovery job end to end: windows, replies made for their texts, and the candidates that are left."""
    return jobs.discover(d.segments, fixtures.window_replies).select("video_id", "cand_idx", "window_idx", "title", "start", "end", "score")


def hook_scores(d):
    """Normalised hooks of all replies."""
    return d.retention.hooks.select(*C, "hook_pos", "text", "type", "generated", "language", F.col("n_evidence").cast("long").alias("n_evidence"), F.col("metrics")["brevity"].alias("brevity"), F.col("metrics")["curiosity"].alias("curiosity"), "score", "source_start", "source_end", "application")


def hook_evidence(d):
    """What each hook's reply says in its support, entry by entry."""
    rows = d.retention.hooks.select(*C, "hook_pos", F.posexplode("evidence").alias("pos", "e"))
    given = lambda k, kind: F.try_variant_get("e", f"$.{k}", kind).alias(k)
    return rows.select(*C, "hook_pos", "pos", given("start", "double"), given("end", "double"), given("reason", "string"))


def hook_best(d):
    return hooks.best(d.retention.hooks).select(*C, "hook_pos", "score", "generated")


def hook_voice(d):
    return hooks.best_voice(d.retention.hooks).select(*C, "hook_pos", "score", "text")


def variant_pieces(d):
    return d.retention.pieces


def variant_scores(d):
    rows = d.retention.variants
    return rows.select(*C, "variant_pos", "name", "duration", "edit_penalty", *(F.col("scores")[k].alias(k) for k in fixed.RETENTION_WEIGHTS), "word_count", "retention_score")


def clips(d):
    return d.retention.clips.select(*C, "clip_idx", "debug_index", "title", "start", "end", "duration", "strategy", "content_type", "rationale", F.col("scores")["hook"].alias("hook_points"), "retention_score", "n_pieces")


def _told(column: str, *fields: str):
    """An array of structs as text, entry by entry in its order: numbers with three decimals, nulls as a dash."""
    number = lambda v: F.when(v.isNotNull(), F.format_string("%.3f", v.cast("double")))
    text = lambda x, f: F.coalesce(number(x[f[1:]]) if f[0] == "#" else x[f].cast("string"), F.lit("-"))
    return F.md5(F.array_join(F.transform(column, lambda x: F.concat_ws("|", *(text(x, f) for f in fields))), ";"))


def clip_records(d):
    """Whole clip records: the chosen hooks, and every list of a record by its size and a digest of what it holds, in order."""
    rows = jobs.clip_records(d.retention)
    items = ("#pos", "#index", "#start", "#end", "#source_start", "#source_end", "#weight", "type", "reason", "text")
    lists = {
        "segments": ("#start", "#end", "role", "reason"),
        "timeline": ("#index", "#source_start", "#source_end", "#target_start", "#target_end", "role"),
        "hook_variants": ("#hook_pos", "text", "type", "language", "#n_evidence", "#score", "#source_start", "#source_end", "application"),
        "retention_timeline": ("#start", "#end", "#score", "label"),
        "removed_segments": ("#start", "#end", "reason"),
        **dict.fromkeys(edit.ITEM_WEIGHTS, items),
    }
    return rows.select(
        *C, "clip_idx", "title", "reason", "score", F.col("hook.text").alias("hook_text"), F.col("hook.score").alias("hook_score"), F.size("hook.evidence").cast("long").alias("hook_evidence"), F.col("voiceover_hook.text").alias("voice_text"),
        *(F.size(c).cast("long").alias(f"n_{c}") for c in lists), *(_told(c, *f).alias(f"{c}_md5") for c, f in lists.items()),
    )


def clip_segments(d):
    return d.retention.selected_pieces


def clip_timeline(d):
    return d.retention.timeline.drop("seg_pos")


def clip_items(d):
    """Every item in edited time with all that it says; ``given_start`` and ``given_weight`` come from the object as it was given."""
    field = F.when(F.col("kind") == "retention_risks", F.try_variant_get("item", "$.severity", "int")).when(F.col("kind") == "open_loops", F.try_variant_get("item", "$.strength", "int")).otherwise(F.try_variant_get("item", "$.importance", "int"))
    return d.retention.items.withColumns({"given_start": F.try_variant_get("item", "$.start", "double"), "given_weight": field}).drop("item")


def clip_buckets(d):
    return jobs.buckets(d.retention)


def clip_removed(d):
    return jobs.removed(d.retention)


def clip_cuts(d):
    r = d.retention
    return edit.cut_plan(r.clips, r.selected_pieces, C)[0]


def run_summary(d):
    r = d.retention
    return edit.run_summary(d.links, d.candidates, r.clips, edit.cut_plan(r.clips, r.selected_pieces, C)[0], d.voices[0])


def clip_rejects(d):
    """Clips without a valid cut: here those whose candidate's place is even are given an empty range first."""
    r = d.retention
    flat = r.clips.withColumn("end", F.when(F.col("cand_idx") % 2 == 0, F.col("start")).otherwise(F.col("end")))
    return edit.cut_plan(flat, r.selected_pieces.where("cand_idx % 2 = 1"), C)[1].select(*C, "clip_idx")


def audit_records(d):
    """One record per candidate: its own fields, what its reply holds, what was made of it, and its voice-over in both places."""
    rows = d.audit
    given = lambda k, kind: F.try_variant_get("analysis", f"$.{k}", kind)
    return rows.select(
        *C, "error", "candidate.window_idx", "candidate.score", given("content_type", "string").alias("content_type"), given("variants[1].strategy", "string").alias("second_strategy"), given("retention_anchors[1].reason", "string").alias("second_anchor"),
        F.bround("context.context_start", 3).alias("context_start"), F.bround("context.context_end", 3).alias("context_end"), F.col("candidate_pacing.word_count").alias("word_count"), F.size("hooks").cast("long").alias("n_hooks"), F.size("variants").cast("long").alias("n_variants"),
        F.element_at("variants", -1)["retention_score"].alias("last_score"), F.col("selected.clip_idx").alias("clip_idx"), F.col("selected.retention_score").alias("retention_score"), F.size("selected.segments").cast("long").alias("n_segments"),
        "voiceover.applied", "voiceover.reason", F.col("selected.voiceover.text").alias("spoken"),
    )


def catalogue_clips(d):
    """The clips that the job from files to files has written, their voice-overs patched in."""
    rows = d.store.read("clips")
    return rows.select(*C, "clip_idx", "score", "retention_score", "start", "end", F.size("segments").cast("long").alias("n_segments"), F.element_at("timeline", -1)["target_end"].alias("last_target"), "voiceover.applied", "voiceover.reason", F.col("voiceover.text").alias("spoken"))


def catalogue_audit(d):
    """The audit that the same job has written, the candidates' backup beside it."""
    backup = d.store.read("backup").select(*C, F.col("score").alias("backup_score"))
    rows = d.store.read("audit").select(*C, "error", F.size("hooks").cast("long").alias("n_hooks"), F.try_variant_get("analysis", "$.content_type", "string").alias("content_type"), "voiceover.applied", F.col("selected.voiceover.text").alias("spoken"))
    return backup.join(rows.hint("merge"), C, "left")


def catalogue_documents(d):
    """The subtitles that the same job has written, those with a spoken hook anew."""
    return d.store.read("documents").select(*L, F.length("document").cast("long").alias("n_chars"), F.md5("document").alias("document_md5"))


def long_segments(d):
    """Segments of the second catalogue, whose longest recordings have many times the length of the usual one."""
    return d.long.segments.select("video_id", "seg_idx", "start", "end", F.md5("text").alias("text_md5"))


def long_windows(d):
    return d.long.links.select("video_id", "window_idx", "window_start", "window_end", "seg_idx")


def long_pacing(d):
    return pacing.of_spans(d.long.words, d.long.spans, W).drop("risks")


def long_candidates(d):
    """Candidates of long recordings, and which of them are edited."""
    kept = windows.best_candidates(d.long.candidates).select(*C, F.lit(True).alias("edited"))
    return d.long.candidates.select(*C, "window_idx", "start", "end", "score").join(kept.hint("merge"), C, "left").fillna(False, ["edited"])


def long_context_text(d):
    """Contexts of long recordings with a limit that many of them pass, so that both surroundings are cut."""
    bounds = windows.contexts(d.long.segments, d.long.best)
    text = windows.context_text(windows.context_segments(d.long.segments, bounds), bounds, limit=2500)
    return text.select(*C, F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def long_summary(d):
    """The run over the second catalogue in numbers; its long recordings have more candidates than are edited."""
    r = d.long.retention
    return edit.run_summary(d.long.links, d.long.candidates, r.clips, edit.cut_plan(r.clips, r.selected_pieces, C)[0])


def clip_words(d):
    return intervals.clip_words(d.words, d.best, C)


def _window_places(d):
    inside = intervals.words_inside(d.words, d.spans)
    return inside.select("video_id", "window_idx", F.struct("seg_idx", "word_idx").alias("place"), "word", "start", "end")


W = ["video_id", "window_idx"]


def idea_spans(d):
    return captions.idea_spans(captions.prepared(_window_places(d), W), W).drop("order")


def boundary_costs(d):
    return captions.boundary_costs(captions.idea_spans(captions.prepared(_window_places(d), W), W), W).drop("order")


def caption_groups(d):
    return captions.captions_of(_window_places(d), W).drop("words")


def caption_events(d):
    return captions.word_events(captions.captions_of(_window_places(d), W), W)


def _clip_groups(d):
    r = d.retention
    return jobs.clip_captions(d.words, r.clips, r.selected_pieces, d.voices[0].where("applied"))


def clip_subtitles(d):
    return jobs.subtitles(_clip_groups(d)).select(*L, F.length("document").cast("long").alias("n_chars"), F.md5("document").alias("document_md5"))


def caption_styles(d):
    names = F.element_at(F.array(*map(F.lit, ["modern", " TikTok", "reels", "CapCut ", "submagic", "minimal", "nope"])), (F.col("video_id") % 7 + 1).cast("int"))
    return captions.with_style(d.segments.select("video_id").distinct(), names)


def voice_timings(d):
    rows = d.segments.select("video_id", "seg_idx", "text", (F.col("end") - F.col("start")).alias("duration"))
    return voice.word_timings(rows, ["video_id", "seg_idx"])


def voice_routes(d):
    language = F.element_at(F.array(*map(F.lit, ["en", "EN-GB ", "ro", "auto", "", "pt_br", "zh", "xx"])), (F.col("video_id") % 8 + 1).cast("int"))
    rows = d.segments.select("video_id").distinct().withColumn("language", language)
    return voice.routed(rows, F.col("language"), F.when(F.col("video_id") % 3 == 0, "own_voice"))


def voice_mix(d):
    v = F.col("video_id")
    rows = d.best.select(*C, (F.col("end") - F.col("start")).alias("duration"), (1.0 + v % 25 / 10).alias("hook_duration"))
    items = _plain_items(d).join(d.best.select(*C, F.col("start").alias("cs")).hint("merge"), C)
    items = items.select(*C, "pos", (F.col("start") - F.col("cs")).alias("start"), (F.col("end") - F.col("cs")).alias("end"), F.col("weight").alias("importance"))
    out = voice.mix_plan(voice.teasers(rows, items, C))
    return out.withColumn("speed", voice.fit_speed(F.col("hook_duration") * 3)).withColumn("tempo", F.array_join(F.transform(voice.tempo_factors(F.col("speed")), lambda x: F.format_string("%.6f", x)), ","))


def voice_hooks_spoken(d):
    return jobs.spoken_hooks(d.retention)


def voice_records(d):
    rows = d.voices[0]
    last = F.element_at("word_timings", -1)
    return rows.select(*L, "applied", "reason", "text", "type", "hook_score", "language", "hook_duration", "provider", "voice", F.size("word_timings").cast("long").alias("n_timings"), last["word"].alias("last_word"), last["start"].alias("last_start"), "teaser.*", F.col("transition.original_audio_start").alias("audio_start")).withColumnsRenamed({"start": "teaser_start", "end": "teaser_end", "source": "teaser_source"})


def voice_missing(d):
    """Clips whose file is not there."""
    return d.voices[1].select(*L)


def _framed(d):
    return fixtures.framed(d.best.select("video_id", F.col("cand_idx").alias("clip_idx"), (F.col("end") - F.col("start")).alias("duration")))


def crop_points(d):
    clips_ = _framed(d)
    return crop.crop_origins(crop.crop_track(fixtures.detections(clips_), clips_, L), clips_, L)


def crop_commands(d):
    clips_ = _framed(d)
    out = jobs.crop_documents(fixtures.detections(clips_), clips_)
    return out.select(*L, F.length("document").cast("long").alias("n_chars"), F.md5("document").alias("document_md5"))


def scalar_functions(d):
    """Text and time functions over all words."""
    w = F.col("word")
    return d.words.select("video_id", "seg_idx", "word_idx", exprs.pacing_token(w).alias("pacing_token"), exprs.caption_token(w).alias("caption_token"), exprs.is_number(w).alias("is_number"), exprs.ends_sentence(w).alias("ends_sentence"), exprs.ends_clause(w).alias("ends_clause"), exprs.remove_punctuation(w).alias("bare"), exprs.is_punctuation(w).alias("is_punctuation"), exprs.clock(F.col("start") * 10).alias("clock"))


def text_functions(d):
    """Text functions over all segments."""
    t = F.col("text")
    return d.segments.select("video_id", "seg_idx", exprs.word_count(t).cast("long").alias("n_words"), exprs.brevity(t).cast("long").alias("brevity"), exprs.language_of(t).alias("language"), exprs.weak_prefix(t).alias("weak"), exprs.escape_caption(t).alias("escaped"))


_ALL = [
    timed_words, timed_segments, sliding_windows, window_text, window_scores, candidates, discovered, context_segments, context_text, pacing_windows, pacing_risks, pacing_edits, best_windows,
    snapped_points, edit_bounds, edit_timeline, edit_words, edit_removed, edit_costs, edit_times, edit_items, edit_buckets, hook_scores, hook_evidence, hook_best, hook_voice, variant_pieces, variant_scores,
    clips, clip_records, clip_segments, clip_timeline, clip_items, clip_buckets, clip_removed, clip_cuts, clip_rejects, run_summary, audit_records, catalogue_clips, catalogue_audit, catalogue_documents, long_segments, long_windows, long_pacing, long_candidates, long_context_text, long_summary, clip_words, idea_spans, boundary_costs, caption_groups, caption_events, clip_subtitles, caption_styles, voice_timings, voice_routes,
    voice_mix, voice_hooks_spoken, voice_records, voice_missing, crop_points, crop_commands, scalar_functions, text_functions,
]
QUERIES = {f.__name__: _data(f) for f in _ALL}
