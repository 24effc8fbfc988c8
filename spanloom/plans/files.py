"""W-A to W-D from files to files: transcripts and replies in, one store of results out, voice-overs patched in later."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import edit
from spanloom.plans import jobs
from spanloom.sources import transcripts
from spanloom.sources.scratch import save
from spanloom.sources.store import Store


def edit_catalogue(spark: SparkSession, transcript_path: str, window_replies: str, analysis_replies: str, out: str, kind: str = "string") -> jobs.Retention:
    """Reads transcripts and replies (see ``read_transcripts`` and ``read_replies``), finds, edits and records every video's clips, and
    replaces what the store ``out`` holds by one switch.

    Tables: rejects, words, backup (the candidates as they were found), clips (whole records), segments (of the clips), documents (subtitles
    without voice-over) and audit. A run that fails changes nothing. Folders of older runs but the last go.
    """
    segments, words, rejects = transcripts.read_transcripts(spark, transcript_path, kind)
    segments, words = save(segments, "segments"), save(words, "words")
    key = {"video_id": kind, "window_idx": "int", "cand_idx": "int"}
    windows = transcripts.read_replies(spark, window_replies, ["video_id", "window_idx"], key)
    analyses = transcripts.read_replies(spark, analysis_replies, ["video_id", "cand_idx"], key)
    candidates = save(jobs.discover(segments, windows), "candidates")
    r = jobs.optimise(segments, words, candidates, analyses)
    none = _no_voices(r)
    records = save(jobs.clip_records(r).join(none.hint("merge"), jobs.L, "left"), "records")
    store = Store(spark, out)
    store.publish(
        rejects=rejects, words=words, backup=candidates, clips=records, segments=r.selected_pieces, items=r.items.drop("item"),
        documents=jobs.subtitles(jobs.clip_captions(words, r.clips, r.selected_pieces, _silent(none))), audit=jobs.audit(r, _unnested(none), records.drop("voiceover")),
    )
    store.clean()
    return r


def add_voices(spark: SparkSession, out: str, r: jobs.Retention, audio: DataFrame, files: DataFrame) -> None:
    """W-D: voice-over records into the clips, the audit and its ``selected``, and new subtitles for the clips that have one, by one switch.

    Run again, with the same or other audio, it replaces what it wrote.
    """
    store = Store(spark, out)
    voices, _ = jobs.voice_over(r, audio, files)
    voices = save(voices, "voices")
    named = voices.select(*jobs.L, F.struct(*(c for c in voices.columns if c not in jobs.L)).alias("_said"))
    clips = store.read("clips").join(named.hint("merge"), jobs.L).withColumn("voiceover", F.col("_said")).drop("_said")
    audit = store.read("audit")
    touched = audit.join(clips.select(*edit.C).hint("merge"), edit.C, "left_semi")
    spoken = voices.where("applied")
    own = r.clips.join(spoken.select(*jobs.L).hint("merge"), jobs.L, "left_semi")
    documents = jobs.subtitles(jobs.clip_captions(store.read("words"), own, store.read("segments"), spoken))
    keyed = documents.join(r.clips.select(*jobs.L, "cand_idx").hint("merge"), jobs.L)
    base = store.read("documents")
    store.upsert({"clips": clips, "audit": jobs.with_voices(touched, voices, F.col("selected.clip_idx"))}, edit.C)
    store.upsert({"documents": keyed.select(*base.columns)}, jobs.L)


def _no_voices(r: jobs.Retention) -> DataFrame:
    """Voice-over records of the right type for no clip, as one struct ``voiceover``."""
    spark = r.clips.sparkSession
    audio = spark.createDataFrame([], f"video_id {r.clips.schema['video_id'].dataType.simpleString()}, clip_idx int, hook_duration double, error string")
    voices, _ = jobs.voice_over(r, audio, audio)
    return spark.createDataFrame([], voices.select(*jobs.L, F.struct(*(c for c in voices.columns if c not in jobs.L)).alias("voiceover")).schema)


def _unnested(none: DataFrame) -> DataFrame:
    return none.select(*jobs.L, "voiceover.*")


def _silent(none: DataFrame) -> DataFrame:
    return _unnested(none)
