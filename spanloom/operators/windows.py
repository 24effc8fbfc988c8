"""Candidate discovery: windows of a transcript, their scores, and the best that do not overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import exprs, fixed
from spanloom.operators.intervals import touching


def video_ends(segments: DataFrame) -> DataFrame:
    """A10: end of each video's last segment by order."""
    return segments.groupBy("video_id").agg(F.max_by("end", "seg_idx").alias("last"))


def sliding_windows(segments: DataFrame, size: int = fixed.WINDOW_SECONDS, step: int = fixed.WINDOW_STEP) -> DataFrame:
    """Each segment in every window it touches: video_id, window_idx, window_start, window_end, seg_idx, start, end, text.

    window_idx counts steps, so an empty window leaves a gap. No join: a segment's windows follow from its
    times, and only the video's end (one row a video) is joined.
    """
    first = F.greatest(F.lit(0), F.ceil((F.col("start") - size) / step)).cast("int")
    last = F.floor(F.col("end") / step).cast("int")
    rows = segments.where(last >= first).withColumn("window_idx", F.explode(F.sequence(first, last)))
    begin = (F.col("window_idx") * step).cast("double")
    rows = rows.join(video_ends(segments).hint("merge"), "video_id").withColumn("window_start", begin).withColumn("window_end", F.least(begin + size, F.col("last")))
    met = (F.col("window_start") < F.col("last")) & (F.col("end") >= F.col("window_start")) & (F.col("start") <= F.col("window_end"))
    return rows.where(met).select("video_id", "window_idx", "window_start", "window_end", "seg_idx", "start", "end", "text")


def tenths(seconds: Column) -> Column:
    """One decimal, ties to even."""
    return F.format_string("%.1f", F.bround(seconds, 1))


def window_text(links: DataFrame) -> DataFrame:
    """A window's segments as lines with their times, in order."""
    line = F.concat(F.lit("["), tenths(F.col("start")), F.lit("s - "), tenths(F.col("end")), F.lit("s] "), F.coalesce("text", F.lit("")), F.lit("\n"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("seg_idx", line.alias("line")))), lambda r: r["line"])
    return links.groupBy("video_id", "window_idx").agg(F.first("window_start").alias("start"), F.first("window_end").alias("end"), F.array_join(lines, "").alias("text"))


def read_window_replies(windows: DataFrame, replies: DataFrame) -> DataFrame:
    """Windows with the title, reason and scores of their reply, and the weighted score.

    A window whose reply is missing or whose scores are no object is skipped; a reply that is no JSON object
    scores 0. Each reply and its scores are read once: what ``explode`` makes of an array of one is a value, which no filter or
    later column works out anew.
    """
    once = lambda c: F.explode(F.array(c))
    top = F.coalesce(exprs.json_map(F.col("reply_json")), F.create_map().cast("map<string,string>"))
    rows = windows.join(replies.where(F.col("reply_json").isNotNull()).hint("merge"), ["video_id", "window_idx"]).withColumn("_top", once(top))
    rows = rows.withColumn("_given", once(exprs.json_map(F.col("_top")["scores"])))
    rows = rows.where(~F.coalesce(F.map_contains_key("_top", "scores"), F.lit(False)) | F.col("_given").isNotNull()).withColumn("_scores", F.coalesce("_given", F.create_map().cast("map<string,string>")))
    values = {k: exprs.map_score(F.col("_scores"), k, 0) for k in fixed.CANDIDATE_WEIGHTS}
    total = sum((v * fixed.CANDIDATE_WEIGHTS[k] for k, v in values.items()), F.lit(0))
    title = F.coalesce(F.when(F.map_contains_key("_top", "title"), F.col("_top")["title"]), F.lit("Untitled"))
    named = F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*values.values()))
    return rows.select("video_id", "window_idx", "start", "end", title.alias("title"), F.coalesce(F.col("_top")["reason"], F.lit("")).alias("reason"), named.alias("scores"), exprs.half_even(total).alias("score"))


def suppress_overlaps(scored: DataFrame, least: int = fixed.MIN_CANDIDATE_SCORE, limit: float = fixed.OVERLAP_LIMIT) -> DataFrame:
    """Of each video's windows from ``least`` on, best first, those that overlap no better kept one.

    Adds cand_idx, the place among the kept. The fold holds a video's windows over the threshold, which its
    length bounds.
    """
    others = [c for c in scored.columns if c not in ("video_id", "window_idx", "score")]
    # Only what decides is folded; a video's rank and window order its rows, since both come first in the struct.
    row = F.struct((-F.col("score")).alias("rank"), "window_idx", "start", "end")
    good = scored.where(F.col("score") >= least)
    best = good.groupBy("video_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    kept = F.aggregate("rows", F.slice("rows", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda k: exprs.overlap_ratio(k, x) >= limit), acc).otherwise(F.concat(acc, F.array(x))))
    places = best.select("video_id", F.posexplode(kept).alias("cand_idx", "r")).select("video_id", "cand_idx", "r.window_idx")
    return places.join(good.hint("merge"), ["video_id", "window_idx"]).select("video_id", "cand_idx", "window_idx", "score", *others)


def best_candidates(candidates: DataFrame, limit: int = fixed.MAX_CANDIDATES) -> DataFrame:
    """The first ``limit`` candidates of each video."""
    return candidates.where(F.col("cand_idx") < limit)


def contexts(segments: DataFrame, candidates: DataFrame, before: float = fixed.CONTEXT_BEFORE, after: float = fixed.CONTEXT_AFTER) -> DataFrame:
    """Bounds of each candidate and its surroundings, cut to the video."""
    rows = candidates.join(video_ends(segments).hint("merge"), "video_id")
    cs, ce = F.greatest(F.lit(0.0), F.col("start")), F.least("last", "end")
    return rows.select("video_id", "cand_idx", cs.alias("candidate_start"), ce.alias("candidate_end"), F.greatest(F.lit(0.0), cs - before).alias("context_start"), F.least(F.col("last"), ce + after).alias("context_end"))


def context_segments(segments: DataFrame, bounds: DataFrame) -> DataFrame:
    """video_id, cand_idx, section (before, candidate, after, all), seg_idx, start, end, text; a segment may be in several."""
    met = touching(segments.select("video_id", "seg_idx", "start", "end", "text"), bounds.withColumns({"start": F.col("context_start"), "end": F.col("context_end")}))
    low, high = F.col("start"), F.col("end")
    inside = lambda a, b: (high >= F.col(a)) & (low <= F.col(b))
    sections = F.array(
        F.when(inside("context_start", "candidate_start"), "before"),
        F.when(inside("candidate_start", "candidate_end"), "candidate"),
        F.when(inside("candidate_end", "context_end"), "after"),
        F.lit("all"),
    )
    return met.withColumn("section", F.explode(F.array_compact(sections))).select("video_id", "cand_idx", "section", "seg_idx", "start", "end", "text")


def context_text(links: DataFrame, bounds: DataFrame, limit: int = fixed.CONTEXT_CHARS) -> DataFrame:
    """Three labelled sections as text; over ``limit`` the candidate stays whole and the rest shares what is left."""
    hundredths = lambda c: F.format_string("%.2f", F.bround(c, 2))
    bare = exprs.strip(F.coalesce("text", F.lit("")))
    line = F.concat(F.lit("["), hundredths(F.col("start")), F.lit("-"), hundredths(F.col("end")), F.lit("] "), bare)
    rows = links.where((F.col("section") != "all") & (bare != "")).groupBy("video_id", "cand_idx", "section")
    texts = rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg_idx", line.alias("line")))), lambda r: r["line"]), "\n").alias("body"))
    by = texts.groupBy("video_id", "cand_idx").agg(*(F.max(F.when(F.col("section") == s, F.col("body"))).alias(s) for s in ("before", "candidate", "after")))
    full = bounds.select("video_id", "cand_idx").join(by.hint("merge"), ["video_id", "cand_idx"], "left")
    named = {s: F.concat_ws("\n", F.lit(label), F.col(s)) for s, label in (("before", "CONTEXT_BEFORE"), ("candidate", "CANDIDATE"), ("after", "CONTEXT_AFTER"))}
    full = full.withColumns(named).withColumn("payload", F.concat_ws("\n\n", "before", "candidate", "after"))
    half = F.floor(F.greatest(F.lit(0), limit - F.length("candidate") - 20) / 2).cast("int")
    head = F.when(half > 0, F.right(F.col("before"), half)).otherwise("")
    foot = F.when(half > 0, F.left(F.col("after"), half)).otherwise("")
    short = F.left(F.concat(head, F.lit("\n\n"), F.col("candidate"), F.lit("\n\n"), foot), F.lit(limit))
    return full.select("video_id", "cand_idx", F.when(F.length("payload") <= limit, F.col("payload")).otherwise(short).alias("text"))
