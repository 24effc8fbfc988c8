"""Opening hooks: normalised, scored and chosen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import exprs, fixed

C = ["video_id", "cand_idx"]


def _truthy(text: Column) -> Column:
    """Truth of a JSON value as text: false, null, 0, "" and empty lists or objects are not."""
    return F.coalesce(~F.lower(text).isin("false", "null", "", "0", "0.0", "[]", "{}"), F.lit(False))


def metrics(hook: Column, text: Column) -> Column:
    """Ten metrics of a hook object as map<string,int>: from metrics, else hook_scores, else the hook itself, else the default; brevity from the text."""
    empty = F.create_map().cast("map<string,string>")
    first = F.when(_truthy(hook["metrics"]), hook["metrics"]).otherwise(hook["hook_scores"])
    raw = F.coalesce(exprs.json_map(first), empty)
    values = {}
    for k in fixed.HOOK_WEIGHTS:
        if k == "brevity":
            values[k] = exprs.brevity(text)
        else:
            values[k] = F.when(F.map_contains_key(raw, k), exprs.clamp_score(raw[k])).otherwise(exprs.map_score(hook, k, fixed.HOOK_DEFAULTS[k]))
    return F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*(v.cast("int") for v in values.values())))


def score(metric: Column, hook: Column, text: Column, generated: Column) -> Column:
    """A5: weighted metrics, less 18 for a weak opening and 12 for a generated hook without evidence, a quarter the model's own score.

    Sums are whole hundredths; the blend is exact in ten-thousandths.
    """
    total = sum((metric[k] * w for k, w in fixed.HOOK_WEIGHTS.items()), F.lit(0))
    total = total - F.when(exprs.weak_prefix(text), 1800).otherwise(0) - F.when(generated & ~_truthy(hook["evidence"]), 1200).otherwise(0)
    own = F.coalesce(exprs.clamp_score(hook["score"]), F.lit(0))
    blended = F.when(own > 0, total * 75 + own * 2500).otherwise(total * 100)
    return exprs.bounded(F.bround(blended / 10000.0), 0.0, 100.0).cast("int")


def normalize(rows: DataFrame, contexts: DataFrame) -> DataFrame:
    """Hooks (key, hook_pos, text, type, generated, language, evidence, n_evidence, metrics, score, source_start, source_end, application).

    rows: key, hooks_json. ``evidence`` is the reply's list as array<variant>, empty where it is none. Hooks without text go, and extractive ones without a source range inside the context.
    """
    hooks = rows.select(*C, F.explode(exprs.json_objects(F.col("hooks_json"))).alias("h")).select(*C, F.col("h.pos").alias("hook_pos"), F.col("h.obj").alias("obj"))
    obj = F.col("obj")
    text = exprs.strip(F.coalesce(obj["text"], F.when(F.map_contains_key(obj, "text"), F.lit("None")).otherwise("")))
    hooks = hooks.withColumn("text", text).where(F.col("text") != "")
    generated = _truthy(obj["generated"])
    given = F.lower(exprs.strip(F.coalesce(obj["language"], F.lit(""))))
    language = F.when(given.isin("ro", "en"), given).otherwise(exprs.language_of(F.col("text")))
    kind = exprs.strip(F.coalesce(obj["type"], F.lit("unknown")))
    proof = F.coalesce(F.try_variant_get(F.try_parse_json(obj["evidence"]), "$", "array<variant>"), F.array().cast("array<variant>"))
    hooks = hooks.withColumns({"generated": generated, "language": language, "type": F.when(kind == "", "unknown").otherwise(kind), "evidence": proof, "n_evidence": F.size(proof), "metrics": metrics(obj, F.col("text"))})
    hooks = hooks.withColumn("score", score(F.col("metrics"), obj, F.col("text"), F.col("generated")))
    hooks = hooks.join(contexts.select(*C, "context_start", "context_end").hint("merge"), C)
    cut = lambda k: F.greatest(F.col("context_start"), F.least(F.col("context_end"), obj[k].try_cast("double")))
    known = obj["source_start"].try_cast("double").isNotNull() & obj["source_end"].try_cast("double").isNotNull()
    hooks = hooks.withColumn("source_start", F.when(~F.col("generated") & known, cut("source_start"))).withColumn("source_end", F.when(~F.col("generated") & known, cut("source_end")))
    ok = F.col("generated") | (F.col("source_end") > F.col("source_start"))
    way = F.when(F.col("generated"), "voiceover_tts_candidate").otherwise("extractive_audio")
    return hooks.where(F.coalesce(ok, F.lit(False))).withColumn("application", way).drop("obj", "context_start", "context_end")


def best(hooks: DataFrame, prefer_original: bool = True) -> DataFrame:
    """T5: each candidate's hook of the highest rank, 8 less if generated; the first of equals."""
    rank = F.col("score") - (F.when(F.col("generated"), 8).otherwise(0) if prefer_original else F.lit(0))
    return _first(hooks, rank)


def voice_candidates(hooks: DataFrame, max_words: int = fixed.VOICE_MAX_WORDS, least: int = fixed.VOICE_MIN_SCORE) -> DataFrame:
    """Generated hooks with evidence, a strong opening, at most ``max_words`` words and a score of ``least`` or more."""
    return hooks.where(F.col("generated") & (F.col("n_evidence") > 0) & ~exprs.weak_prefix(F.col("text")) & (exprs.word_count(F.col("text")) <= max_words) & (F.col("score") >= least))


def best_voice(hooks: DataFrame, max_words: int = fixed.VOICE_MAX_WORDS, least: int = fixed.VOICE_MIN_SCORE) -> DataFrame:
    """The best of ``voice_candidates``, the first of equals."""
    return _first(voice_candidates(hooks, max_words, least), F.col("score"))


def _first(hooks: DataFrame, rank: Column) -> DataFrame:
    top = hooks.groupBy(*C).agg(F.max(F.struct(rank.alias("rank"), (-F.col("hook_pos")).alias("place"))).alias("t"))
    return hooks.join(top.select(*C, (-F.col("t.place")).alias("hook_pos")).hint("merge"), [*C, "hook_pos"])
