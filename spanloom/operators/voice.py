"""Voice-over planning: word timings, routing, teaser and mix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import exprs, fixed


def word_timings(hooks: DataFrame, key: list[str], text: str = "text", duration: str = "duration") -> DataFrame:
    """Key, w_idx, word, start, end: the duration shared by word lengths (1 to 8 letters each), the last word ending with it.

    Shares are taken of whole tenths of milliseconds, so that ties do not depend on float noise.
    """
    bare = exprs.strip(F.coalesce(text, F.lit("")))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"(?U)\s+"))
    rows = hooks.select(*key, F.greatest(F.lit(0.01), F.col(duration).cast("double")).alias("_d"), F.posexplode(words).alias("w_idx", "word"))
    letters = F.length(F.regexp_replace("word", r"[^\p{L}\p{N}_]+", ""))
    rows = rows.withColumn("_w", exprs.bounded(letters, 1, 8).cast("bigint"))
    w = Window.partitionBy(*key).orderBy("w_idx")
    upto = F.sum("_w").over(w.rowsBetween(Window.unboundedPreceding, 0))
    all_ = F.sum("_w").over(Window.partitionBy(*key))
    rows = rows.withColumns({"_upto": upto, "_all": all_, "_t": exprs.ticks(F.col("_d"))})
    at = lambda c: F.bround(F.col("_t") * c / F.col("_all"))
    start = at(F.col("_upto") - F.col("_w"))
    end = F.when(F.col("_upto") == F.col("_all"), F.col("_t").cast("double")).otherwise(F.greatest(start + 100, at(F.col("_upto"))))
    return rows.select(*key, "w_idx", "word", (start / 10000.0).alias("start"), (end / 10000.0).alias("end"))


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def routed(rows: DataFrame, language: Column, requested: Column) -> DataFrame:
    """Adds lang_code, provider and voice: a requested voice wins, an unsupported language goes to the fallback provider."""
    given = F.lower(F.trim(F.coalesce(language, F.lit("auto"))))
    code = F.try_element_at(_map(fixed.VOICE_CODES), F.when(given.isin("", "auto"), fixed.VOICE_LANGUAGE).otherwise(given))
    rows = rows.withColumn("lang_code", code)
    own = F.trim(F.coalesce(requested, F.lit("")))
    voice = F.when(F.col("lang_code").isNull(), "").when(own != "", own).otherwise(F.try_element_at(_map(fixed.VOICES), F.col("lang_code")))
    return rows.withColumns({"provider": F.when(F.col("lang_code").isNull(), fixed.VOICE_FALLBACK).otherwise(fixed.VOICE_PROVIDER), "voice": voice})


def teasers(clips: DataFrame, anchors: DataFrame, key: list[str]) -> DataFrame:
    """Clips (key, duration, hook_duration) with teaser_start, teaser_end, teaser_source.

    The anchor (key, pos, start, end, importance) of the highest importance is the middle, the first of equals;
    without anchors it is the clip's start.
    """
    hook = F.least(F.greatest(F.lit(0.1), F.col("hook_duration")), F.greatest(F.lit(0.1), F.col("duration")))
    best = anchors.groupBy(*key).agg(F.max(F.struct(F.col("importance").cast("double").alias("i"), (-F.col("pos")).alias("p"), F.col("start").alias("s"), F.col("end").alias("e"))).alias("_a"))
    rows = clips.join(best.hint("merge"), key, "left").withColumn("_h", hook)
    middle = F.greatest(F.col("_a.s"), (F.col("_a.s") + F.col("_a.e")) / 2.0)
    at = F.greatest(F.lit(0.0), F.least(F.greatest(F.lit(0.0), F.col("duration") - F.col("_h")), middle - F.col("_h") / 2.0))
    start = F.when(F.col("_a").isNull(), 0.0).otherwise(at)
    rows = rows.withColumn("teaser_start", start)
    return rows.withColumns({"teaser_end": F.least(F.col("duration"), F.col("teaser_start") + F.col("_h")), "teaser_source": F.when(F.col("_a").isNull(), "clip_start").otherwise("retention_anchor")}).drop("_a", "_h")


def mix_plan(rows: DataFrame, fade: float = fixed.VOICE_FADE) -> DataFrame:
    """F16: adds pad, fade and fade_start of the hook over the teaser (duration, hook_duration, teaser_start, teaser_end)."""
    hook = F.greatest(F.lit(0.1), F.col("hook_duration"))
    start = F.greatest(F.lit(0.0), F.least("duration", "teaser_start"))
    end = F.greatest(start + 0.01, F.least("duration", "teaser_end"))
    length = F.greatest(F.lit(0.0), F.least(F.lit(fade), hook / 3.0))
    return rows.withColumns({"pad": F.greatest(F.lit(0.0), hook - F.greatest(F.lit(0.01), end - start)), "fade": length, "fade_start": F.greatest(F.lit(0.0), hook - length)})


def fit_speed(duration: Column, most: float = fixed.VOICE_SECONDS) -> Column:
    """F16: how much faster a voice must run to last ``most`` seconds; 1 if it does within 0.02 s."""
    limit = max(0.1, most)
    return F.when(duration <= limit + 0.02, 1.0).otherwise(duration / limit)


def tempo_factors(speed: Column) -> Column:
    """F16: a speed as factors of at most 2, largest first; a speed below 0.5 counts as 0.5."""
    s = F.greatest(F.lit(0.5), speed)
    n = F.greatest(F.lit(0), F.ceil(F.log2(s)) - 1).cast("int")
    twos = F.when(n > 0, F.array_repeat(F.lit(2.0), n)).otherwise(F.array().cast("array<double>"))
    return F.concat(twos, F.array(s / F.pow(F.lit(2.0), n)))


def fitted(duration: Column, most: float = fixed.VOICE_SECONDS) -> Column:
    """How long a voice lasts once it fits: its own length, or ``most`` if it had to be sped up."""
    return F.when(fit_speed(duration, most) == 1.0, duration).otherwise(max(0.1, most))


def applied(clips: DataFrame, hooks: DataFrame, audio: DataFrame, files: DataFrame, anchors: DataFrame, key: list[str], requested: str = "") -> tuple[DataFrame, DataFrame]:
    """Clips with a cut file and their voice-over record, and the clips that have no file.

    clips: key, duration. hooks: key, text, type, score, language (the chosen ones). audio: key, hook_duration of
    the synthesised voice and ``error`` where synthesis failed. anchors: key, pos, start, end, importance in clip
    time. ``applied`` is false without a hook (no_valid_generated_hook) or with an error, which is the reason then.
    """
    found = clips.join(files.select(*key).hint("merge"), key, "left_semi").select(*key, "duration")
    rows = found.join(hooks.select(*key, "text", "type", F.col("score").alias("hook_score"), "language").hint("merge"), key, "left").join(audio.select(*key, F.col("hook_duration").alias("raw_duration"), "error").hint("merge"), key, "left")
    has = F.col("text").isNotNull()
    failed = has & (F.col("error").isNotNull() | F.col("raw_duration").isNull())
    reason = F.when(~has, "no_valid_generated_hook").when(failed, F.coalesce("error", F.lit("no audio")))
    rows = rows.withColumns({"enabled": F.lit(True), "applied": has & ~failed, "reason": reason, "hook_duration": F.when(has & ~failed, fitted(F.col("raw_duration")))})
    spoken = rows.where("applied")
    named = routed(spoken, F.col("language"), F.lit(requested))
    ranged = teasers(named, anchors, key)
    timed = word_timings(spoken, key, "text", "hook_duration").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("w_idx", "word", "start", "end"))).alias("word_timings"))
    r = lambda c: F.bround(c, 3)
    teaser = F.struct(r(F.col("teaser_start")).alias("start"), r(F.col("teaser_end")).alias("end"), F.col("teaser_source").alias("source"))
    transition = F.struct(
        r(F.col("hook_duration")).alias("original_audio_start"), F.lit(True).alias("original_audio_muted_during_hook"), F.lit(False).alias("audio_ducking"),
        F.lit(0.0).alias("ducking_volume"), F.lit("tts_fade_out_then_original_fade_in").alias("mode"), F.lit(fixed.VOICE_FADE).alias("fade_duration"),
    )
    detail = ranged.select(*key, "provider", "voice", teaser.alias("teaser"), transition.alias("transition")).join(timed.hint("merge"), key, "left")
    own = lambda c: F.when(F.col("applied"), F.col(c)).alias(c)
    out = rows.join(detail.hint("merge"), key, "left").select(*key, "enabled", "applied", "reason", own("text"), own("type"), own("hook_score"), own("language"), r(F.col("hook_duration")).alias("hook_duration"), "provider", "voice", "word_timings", "teaser", "transition")
    return out, clips.join(files.select(*key).hint("merge"), key, "left_anti")
