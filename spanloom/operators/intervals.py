"""Joins and folds on time intervals: the core the other operators use.

Interval joins are equi-joins on the key and a time bucket: the point side has one bucket, the interval
side one row per bucket it touches, so a long recording is spread and no pair is found twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import fixed

#: Seconds per bucket of the interval joins.
BUCKET = 30.0


def _bucket(t) -> Column:
    return F.floor(t / BUCKET)


def touched(start: Column, end: Column, size: float) -> Column:
    """Buckets of ``size`` seconds that an interval touches; none for a backward interval."""
    first, last = F.floor(start / size), F.floor(end / size)
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def words_inside(words: DataFrame, spans: DataFrame, key: str = "video_id") -> DataFrame:
    """Words whose midpoint lies in a span (ends included) and whose segment touches it.

    words: key, seg_idx, word_idx, word, start, end, seg_start, seg_end. spans: key, start, end and more
    columns, which come back with start and end as span_start and span_end.
    """
    middle = (F.col("start") + F.col("end")) / 2.0
    left = words.select(F.col(key), "seg_idx", "word_idx", "word", "start", "end", "seg_start", "seg_end", middle.alias("middle"), _bucket(middle).alias("bucket"))
    right = spans.withColumnsRenamed({"start": "span_start", "end": "span_end"})
    right = right.withColumn("bucket", F.explode(touched(F.col("span_start"), F.col("span_end"), BUCKET)))
    inside = (F.col("middle") >= F.col("span_start")) & (F.col("middle") <= F.col("span_end")) & (F.col("seg_end") >= F.col("span_start")) & (F.col("seg_start") <= F.col("span_end"))
    return right.join(left.hint("merge"), [key, "bucket"]).where(inside).drop("bucket", "middle", "seg_start", "seg_end")


def words_in_parts(words: DataFrame, spans: DataFrame, key: str = "video_id") -> DataFrame:
    """``words_inside`` with ``part``, a bucket: in the order of start a span's parts follow each other, and the join leaves a part's words in one task.

    A word has the buckets from its start to its midpoint, mostly one; a pair counts in the span's bucket that is nearest to the word's start.
    """
    first, middle = _bucket(F.col("start")), _bucket((F.col("start") + F.col("end")) / 2.0)
    left = words.select(F.col(key), "seg_idx", "word_idx", "word", "start", "end", "seg_start", "seg_end", F.explode(F.sequence(F.least(first, middle), F.greatest(first, middle))).alias("part"))
    right = spans.withColumnsRenamed({"start": "span_start", "end": "span_end"})
    right = right.withColumn("part", F.explode(touched(F.col("span_start"), F.col("span_end"), BUCKET)))
    at = (F.col("start") + F.col("end")) / 2.0
    inside = (at >= F.col("span_start")) & (at <= F.col("span_end")) & (F.col("seg_end") >= F.col("span_start")) & (F.col("seg_start") <= F.col("span_end"))
    own = F.col("part") == F.least(F.greatest(first, _bucket(F.col("span_start"))), _bucket(F.col("span_end")))
    return right.join(left.hint("merge"), [key, "part"]).where(inside & own).drop("seg_start", "seg_end")


def touching(items: DataFrame, spans: DataFrame, key: str = "video_id") -> DataFrame:
    """Pairs of items and spans (both key, start, end) that touch, ends included.

    A pair can meet in several buckets; it counts in that of the later start. Span columns come back as
    span_start and span_end.
    """
    left = items.withColumn("bucket", F.explode(touched(F.col("start"), F.col("end"), BUCKET)))
    right = spans.withColumnsRenamed({"start": "span_start", "end": "span_end"})
    right = right.withColumn("bucket", F.explode(touched(F.col("span_start"), F.col("span_end"), BUCKET)))
    met = (F.col("start") <= F.col("span_end")) & (F.col("end") >= F.col("span_start")) & (F.col("bucket") == _bucket(F.greatest("start", "span_start")))
    return right.join(left.hint("merge"), [key, "bucket"]).where(met).drop("bucket")


def snap(points: DataFrame, bounds: DataFrame, key: list[str], at: str, reach: float = fixed.SNAP_SECONDS) -> DataFrame:
    """``at`` moved to the nearest bound within ``reach`` (the smaller of two), else kept.

    points: key columns, a unique ``point`` and ``at``; bounds: key columns and ``bound``. The reach is
    part of the join, so each point meets the bounds of three one-second buckets only.
    """
    near = F.sequence(F.floor(F.col(at)) - 1, F.floor(F.col(at)) + 1)
    left = points.select(*key, "point", F.col(at).alias("_at"), F.explode(near).alias("bucket"))
    right = bounds.select(*key, "bound", F.floor("bound").alias("bucket"))
    far = F.abs(F.col("bound") - F.col("_at"))
    best = left.join(right.hint("merge"), [*key, "bucket"]).where(far <= reach).groupBy("point").agg(F.min(F.struct(far.alias("far"), F.col("bound"))).alias("best"))
    return points.join(best.hint("merge"), "point", "left").withColumn(at, F.coalesce(F.col("best.bound"), F.col(at))).drop("best")


def nearest_ends(spans: DataFrame, met: DataFrame, place: list[str]) -> DataFrame:
    """Spans (unique by ``place``) with each end at the nearest of the bounds it has met, the smaller of two; without any it stays.

    met: place, side (start or end), at (that end), bound.
    """
    far = F.abs(F.col("bound") - F.col("at"))
    best = lambda c: F.min(F.when(F.col("side") == c, F.struct(far.alias("far"), F.col("bound")))).alias(f"_{c}")
    moved = met.groupBy(*place).agg(best("start"), best("end"))
    out = spans.join(moved.hint("merge"), place, "left")
    return out.withColumns({c: F.coalesce(F.col(f"_{c}.bound"), F.col(c)) for c in ("start", "end")}).drop("_start", "_end")


def merge_pieces(pieces: DataFrame, key: list[str]) -> DataFrame:
    """W6 then W5: drops a piece equal to the one before it, then joins neighbours of one role at most 0.08 s apart.

    pieces: key, seg_pos, start, end, role, reason, in edit order. Joined reasons are separated by "; ".
    """
    w = Window.partitionBy(*key).orderBy("seg_pos")
    same = (F.lag("start").over(w) == F.col("start")) & (F.lag("end").over(w) == F.col("end"))
    kept = pieces.withColumn("_same", F.coalesce(same, F.lit(False))).where(~F.col("_same")).drop("_same")
    gap = F.col("start") - F.lag("end").over(w)
    joins = (gap >= 0) & (gap <= fixed.MERGE_GAP) & (F.lag("role").over(w) == F.col("role"))
    marked = kept.withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    marked = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    row = F.sort_array(F.collect_list(F.struct("seg_pos", "reason")))
    text = F.array_join(F.filter(F.transform(row, lambda r: r["reason"]), lambda r: r != ""), "; ")
    out = marked.groupBy(*key, "_island").agg(F.min("seg_pos").alias("seg_pos"), F.min_by("start", "seg_pos").alias("start"), F.max_by("end", "seg_pos").alias("end"), F.min_by("role", "seg_pos").alias("role"), text.alias("reason"))
    return out.drop("_island")


def timeline(pieces: DataFrame, key: list[str]) -> DataFrame:
    """Where each piece of an edit lies in the edited clip; empty pieces are left out but keep their place in index."""
    w = Window.partitionBy(*key).orderBy("seg_pos")
    index = pieces.withColumn("index", F.row_number().over(w) - 1)
    length = F.greatest(F.lit(0.0), F.col("end") - F.col("start"))
    before = F.coalesce(F.sum("_len").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    placed = index.withColumn("_len", length).withColumn("_at", before).where(F.col("_len") > 0)
    r = lambda c: F.bround(c, 3)
    return placed.select(*key, "index", "seg_pos", r(F.col("start")).alias("source_start"), r(F.col("end")).alias("source_end"), r(F.col("_at")).alias("target_start"), r(F.col("_at") + F.col("_len")).alias("target_end"), "role")


def remap_items(items: DataFrame, placed: DataFrame, key: list[str]) -> DataFrame:
    """Items (key, start, end, ...) cut to each timeline piece they overlap, in source and edited time."""
    pieces = placed.select(*key, "index", F.col("source_start").alias("_s"), F.col("source_end").alias("_e"), F.col("target_start").alias("_t"))
    low, high = F.greatest("start", "_s"), F.least("end", "_e")
    joined = items.join(pieces.hint("merge"), key).where(high > low).withColumn("_lo", low).withColumn("_hi", high)
    r = lambda c: F.bround(c, 3)
    at = lambda c: r(F.col("_t") + (F.col(c) - F.col("_s")))
    return joined.withColumns({"source_start": r(F.col("_lo")), "source_end": r(F.col("_hi")), "start": at("_lo"), "end": at("_hi")}).drop("_s", "_e", "_t", "_lo", "_hi")


def remap_times(times: DataFrame, placed: DataFrame, key: list[str]) -> DataFrame:
    """Source times (key, point, t) in edited time; the first piece that holds one wins, null if none does."""
    pieces = placed.select(*key, "index", "source_start", "source_end", "target_start")
    held = times.join(pieces.hint("merge"), key).where((F.col("t") >= F.col("source_start")) & (F.col("t") <= F.col("source_end")))
    best = held.groupBy(*key, "point").agg(F.min_by(F.col("target_start") + (F.col("t") - F.col("source_start")), "index").alias("target"))
    return times.join(best.hint("merge"), [*key, "point"], "left")


def removed(candidates: DataFrame, pieces: DataFrame, key: list[str], least: float = 0.15) -> DataFrame:
    """Parts of each candidate (key, start, end) that no piece covers, longer than ``least``."""
    spans = candidates.select(*key, F.col("start").alias("_cs"), F.col("end").alias("_ce"))
    inside = pieces.select(*key, "seg_pos", "start", "end").join(spans.hint("merge"), key).where((F.col("end") > F.col("_cs")) & (F.col("start") < F.col("_ce")))
    cut = inside.select(*key, "_cs", "_ce", "seg_pos", F.greatest("start", "_cs").alias("s"), F.least("end", "_ce").alias("e"), F.col("start").alias("order"))
    w = Window.partitionBy(*key).orderBy("order", "seg_pos").rowsBetween(Window.unboundedPreceding, -1)
    gaps = cut.withColumn("at", F.greatest(F.coalesce(F.max("e").over(w), F.col("_cs")), F.col("_cs"))).where(F.col("s") > F.col("at") + least)
    inner = gaps.select(*key, F.col("at").alias("start"), F.col("s").alias("end"))
    ends = spans.join(cut.groupBy(*key).agg(F.max("e").alias("last")).hint("merge"), key, "left")
    tail = ends.withColumn("at", F.coalesce("last", "_cs")).where(F.col("at") < F.col("_ce") - least).select(*key, F.col("at").alias("start"), F.col("_ce").alias("end"))
    return inner.unionByName(tail).select(*key, F.bround("start", 3).alias("start"), F.bround("end", 3).alias("end"), F.lit("not_selected_by_retention_edit").alias("reason"))


def remap_words(words: DataFrame, pieces: DataFrame, key: list[str], video: str = "video_id") -> DataFrame:
    """Words of each piece in edited time, cut to the piece, repeated rows of a piece once, in transcript order.

    pieces: key (with the video), seg_pos, start, end. Returns key, seg_pos, seg_idx, word_idx, word, start, end.
    """
    w = Window.partitionBy(*key).orderBy("seg_pos")
    length = F.greatest(F.lit(0.0), F.col("end") - F.col("start"))
    placed = pieces.select(*key, "seg_pos", "start", "end", length.alias("_len"))
    placed = placed.withColumn("_at", F.coalesce(F.sum("_len").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).where(F.col("_len") > 0)
    inside = words_inside(words, placed, video)
    twin = Window.partitionBy(*key, "seg_pos", F.bround("start", 4), F.bround("end", 4), "word").orderBy("seg_idx", "word_idx")
    once = inside.withColumn("_twin", F.row_number().over(twin)).where(F.col("_twin") == 1)
    first = F.greatest(F.lit(0.0), F.col("start") - F.col("span_start"))
    last = F.least(F.col("_len"), F.greatest(F.col("_first"), F.col("end") - F.col("span_start")))
    out = once.withColumn("_first", first).withColumn("_last", last)
    return out.select(*key, "seg_pos", "seg_idx", "word_idx", F.trim("word").alias("word"), F.bround(F.col("_at") + F.col("_first"), 4).alias("start"), F.bround(F.col("_at") + F.col("_last"), 4).alias("end"))


def clip_words(words: DataFrame, clips: DataFrame, key: list[str], video: str = "video_id") -> DataFrame:
    """Words that touch a clip (ends included), in clip time; they may begin before 0."""
    met = touching(words.drop("seg_start", "seg_end"), clips.select(*key, "start", "end"), video)
    return met.select(*key, "seg_idx", "word_idx", "word", (F.col("start") - F.col("span_start")).alias("start"), (F.col("end") - F.col("span_start")).alias("end"))


def shift_words(words: DataFrame, offset: Column) -> DataFrame:
    """P10: times moved later by ``offset`` (0 if it is negative or null)."""
    by = F.greatest(F.lit(0.0), F.coalesce(offset, F.lit(0.0)))
    return words.withColumns({"start": F.bround(F.col("start") + by, 4), "end": F.bround(F.col("end") + by, 4)})
