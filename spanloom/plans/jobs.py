"""The jobs end to end: discovery, retention editing, captions and crop."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators import captions, crop, edit, hooks, intervals, pacing, voice, windows
from spanloom.sources.scratch import save

L = ["video_id", "clip_idx"]

#: H3: replies as a table, or a function that makes them from the units to be answered.
Replies = DataFrame | Callable[[DataFrame], DataFrame]


def _answered(replies: Replies, units: DataFrame) -> DataFrame:
    return replies(units) if callable(replies) else replies


def discover(segments: DataFrame, replies: Replies) -> DataFrame:
    """W-A: windows, their replies' scores, and the candidates that remain after overlap suppression."""
    texts = windows.window_text(windows.sliding_windows(segments))
    return windows.suppress_overlaps(windows.read_window_replies(texts, _answered(replies, texts)))


@dataclass
class Retention:
    """W-B's tables, keyed by video_id and cand_idx."""

    analyses: DataFrame
    contexts: DataFrame
    hooks: DataFrame
    variants: DataFrame
    pieces: DataFrame
    selected: DataFrame
    selected_pieces: DataFrame
    timeline: DataFrame
    clips: DataFrame
    pacing: DataFrame
    best_hooks: DataFrame
    voice_hooks: DataFrame
    items: DataFrame


def optimise(segments: DataFrame, words: DataFrame, candidates: DataFrame, replies: Replies) -> Retention:
    """W-B: every video's best candidates re-edited: hooks, variants, scores, the chosen edit and its timeline.

    Replies are parsed once; tables that several later steps read are written in between.
    """
    best = windows.best_candidates(candidates)
    contexts = save(windows.contexts(segments, best), "contexts")
    # Replies take much time for few bytes: left to the size of files, one or two tasks would parse them all.
    spread = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    analyses = save(edit.read_analyses(best, _answered(replies, best).repartition(spread, *edit.C)), "analyses")
    ok = analyses.where(F.col("top").isNotNull())
    proposed = edit.proposed_variants(analyses)
    cleaned = edit.clean_pieces(edit.proposed_pieces(proposed), contexts, segments, words)
    variants, pieces = edit.with_original(proposed, save(cleaned, "cleaned"), ok)
    evaluated = save(edit.evaluate(variants, pieces, words, analyses), "evaluated")
    selected = edit.select_best(evaluated)
    own = pieces.join(selected.select(*edit.V).hint("merge"), edit.V, "left_semi").select(*edit.C, "seg_pos", "start", "end", "role", "reason")
    spans = contexts.select(*edit.C, F.col("candidate_start").alias("start"), F.col("candidate_end").alias("end"))
    measured, found = pacing.of_spans(words, spans, edit.C), save(edit.hooks_of(analyses, contexts), "hooks")
    line, clips = intervals.timeline(own, edit.C), save(edit.assemble(selected, analyses), "clips")
    items = save(remapped_items(analyses, measured, line), "items")
    return Retention(analyses, contexts, found, evaluated, pieces, selected, own, line, clips, measured, hooks.best(found), hooks.best_voice(found), items)


def remapped_items(analyses: DataFrame, measured: DataFrame, line: DataFrame) -> DataFrame:
    """Anchors, risks (the reply's and the measured), open loops and interrupts in edited time, with all that they say.

    ``weight`` and the texts are columns; ``item`` is the whole object as it was given.
    """
    told = edit.described(edit.with_measured_risks(edit.read_items(analyses), measured))
    return intervals.remap_items(told, line, edit.C)


def of_kind(r: Retention, kind: str) -> DataFrame:
    """One kind of a job's items."""
    return r.items.where(F.col("kind") == kind).drop("kind")


def buckets(r: Retention) -> DataFrame:
    """The retention buckets of every optimised clip."""
    optimised = r.clips.join(r.selected.select(*edit.C).hint("merge"), edit.C, "left_semi").select(*edit.C, "duration")
    return edit.retention_buckets(optimised, of_kind(r, "retention_anchors"), of_kind(r, "retention_risks"), edit.C)


def removed(r: Retention) -> DataFrame:
    """What every optimised clip leaves out of its candidate."""
    optimised = r.analyses.join(r.selected.select(*edit.C).hint("merge"), edit.C, "left_semi").select(*edit.C, "start", "end")
    return intervals.removed(optimised, r.selected_pieces, edit.C)


def clip_records(r: Retention) -> DataFrame:
    """Every clip as one record with its segments, timeline, hooks, items, buckets and removed parts as arrays.

    Fallback clips have a segment and a timeline entry, empty anchors and risks, and nothing else.
    """
    segment, entry = edit.fallback_pieces(r.analyses)
    hook = ["hook_pos", "text", "type", "generated", "language", "evidence", "n_evidence", "metrics", "score", "source_start", "source_end", "application"]
    hooks_ = lambda rows: rows.select(*edit.C, *hook)
    parts = {
        "segments": (r.selected_pieces.unionByName(segment), ["seg_pos"]),
        "timeline": (r.timeline.unionByName(entry), ["index", "seg_pos"]),
        "hook": (hooks_(r.best_hooks), []),
        "voiceover_hook": (hooks_(r.voice_hooks), []),
        "hook_variants": (hooks_(r.hooks), ["hook_pos"]),
        "retention_timeline": (buckets(r), ["bucket"]),
        "removed_segments": (removed(r), ["start"]),
    }
    parts |= {k: (of_kind(r, k), ["pos", "index"]) for k in edit.ITEM_WEIGHTS}
    out = edit.gathered(r.clips, edit.C, parts)
    arrays = [f.name for f in out.schema.fields if f.dataType.typeName() == "array"]
    return out.withColumns({c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in arrays})


def spoken_hooks(r: Retention) -> DataFrame:
    """The chosen spoken hook of every clip that has one."""
    return r.voice_hooks.join(r.clips.select(*edit.C, "clip_idx").hint("merge"), edit.C).select(*L, "text", "type", "score", "language")


def voice_over(r: Retention, audio: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """W-D: voice-over records of all clips with a file (see ``voice.applied``), and the clips without one."""
    anchors = of_kind(r, "retention_anchors").join(r.clips.select(*edit.C, "clip_idx").hint("merge"), edit.C)
    # Places of equal weight keep the order in which items were mapped.
    place = F.col("pos").cast("long") * (1 << 20) + F.col("index")
    anchors = anchors.select(*L, place.alias("pos"), "start", "end", F.col("weight").alias("importance"))
    return voice.applied(r.clips, spoken_hooks(r), audio, files, anchors, L)


def audit(r: Retention, voices: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """One record per candidate, failures included, as structs and arrays of structs: candidate, context, candidate_pacing, analysis (its
    whole reply), hooks, variants, selected (the clip record), error and voiceover.

    A failed candidate has its error, its fallback clip and no analysis. ``voices`` are the voice-over records so far, none at first;
    ``with_voices`` adds them later. ``records`` are the clip records, where they have been made already.
    """
    failed = F.col("top").isNull()
    out = r.analyses.select(
        *edit.C, F.struct("window_idx", "start", "end", "title", "reason", "scores", "score").alias("candidate"),
        F.when(~failed, F.try_parse_json("reply_json")).alias("analysis"), F.when(failed, "no JSON object").alias("error"),
    )
    parts = {"context": (r.contexts, []), "candidate_pacing": (r.pacing, []), "hooks": (r.hooks, ["hook_pos"]), "variants": (r.variants, ["variant_pos"]), "selected": (clip_records(r) if records is None else records, [])}
    out = edit.gathered(out, edit.C, parts)
    out = out.withColumns({c: F.when(F.col("error").isNull(), F.col(c)) for c in ("context", "candidate_pacing")})
    return with_voices(out, voices, F.col("selected.clip_idx"))


def with_voices(records: DataFrame, voices: DataFrame, clip_idx: Column) -> DataFrame:
    """Audit records with ``voiceover``, and with it inside ``selected``: that of ``voices`` (keyed by clip) where there is one, else what was there, else null."""
    kept = [c for c in records.columns if c != "voiceover"]
    said = voices.select(F.col("video_id").alias("_v"), F.col("clip_idx").alias("_c"), F.struct(*(c for c in voices.columns if c not in L)).alias("_said"))
    joined = records.join(said.hint("merge"), (F.col("video_id") == F.col("_v")) & (clip_idx == F.col("_c")), "left")
    given = F.coalesce("_said", "voiceover") if "voiceover" in records.columns else F.col("_said")
    selected = F.when(F.col("selected").isNotNull(), F.col("selected").withField("voiceover", given))
    return joined.withColumn("voiceover", given).withColumn("selected", selected).select(*kept, "voiceover")


def clip_captions(words: DataFrame, clips: DataFrame, pieces: DataFrame, voices: DataFrame) -> DataFrame:
    """W-C: caption groups (video_id, clip_idx, part, group_idx, place, word, start, end).

    Part 0 is the spoken hook, part 1 the clip's own words, moved behind it; they are grouped apart. Clips
    without pieces take the words that touch them.
    """
    by_clip = pieces.join(clips.select("video_id", "cand_idx", "clip_idx").hint("merge"), ["video_id", "cand_idx"]).select(*L, "seg_pos", "start", "end")
    edited = intervals.remap_words(words, by_clip, L)
    plain = intervals.clip_words(words, clips.join(by_clip.select(*L).distinct().hint("merge"), L, "left_anti"), L).withColumn("seg_pos", F.lit(0))
    every = edited.unionByName(plain).join(voices.select(*L, "hook_duration").hint("merge"), L, "left")
    own = intervals.shift_words(every, F.col("hook_duration"))
    place = F.struct("seg_pos", "seg_idx", "word_idx")
    own = own.select(*L, F.lit(1).alias("part"), place.alias("place"), "word", "start", "end")
    hook = voice.word_timings(voices, L, "text", "hook_duration")
    zero = F.lit(0)
    first = F.struct(zero.alias("seg_pos"), zero.alias("seg_idx"), F.col("w_idx").alias("word_idx"))
    hook = hook.select(*L, zero.alias("part"), first.alias("place"), "word", "start", "end")
    return captions.group_words(hook.unionByName(own), [*L, "part"])


def subtitles(grouped: DataFrame, animation: str = "capcut") -> DataFrame:
    """One subtitle document per clip."""
    key = [*L, "part"]
    events = captions.word_events(captions.caption_groups(grouped, key), key, animation)
    return captions.documents(events, L, ["part", "group_idx", "active_index"], animation=animation)


def crop_documents(detections: DataFrame, clips: DataFrame) -> DataFrame:
    """One crop command document per clip (video_id, clip_idx, width, height, duration)."""
    return crop.crop_commands(crop.crop_track(detections, clips, L), clips, L)
