"""Timed text derived from text tables, so that every operator runs over whole tables of any size.

All arithmetic is on whole numbers, so other engines get the same values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import fixed
from spanloom.sources.scratch import save

LONG = "Aaaaaaaaaaaaaaaaaaaaaaa"


#: Segments of a recording that are added up together; the sums of such blocks are added up after them.
BLOCK = 1024


def running(rows: DataFrame, value: str, name: str) -> DataFrame:
    """video_id, seg_idx and ``name``: the sum of ``value`` over a recording's earlier segments. rows: video_id, seg_idx (unique), value.

    Sums go block by block, so no task sorts more than a block or a recording's blocks: a recording of n segments is n / 1024 rows at most.
    """
    narrow = rows.select("video_id", "seg_idx", value, F.floor(F.col("seg_idx") / BLOCK).alias("_block"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = narrow.groupBy("video_id", "_block").agg(F.sum(value).alias("_sum"))
    tops = sums.select("video_id", "_block", F.coalesce(F.sum("_sum").over(before(Window.partitionBy("video_id").orderBy("_block"))), F.lit(0)).alias("_top"))
    inside = F.coalesce(F.sum(value).over(before(Window.partitionBy("video_id", "_block").orderBy("seg_idx"))), F.lit(0))
    return narrow.join(tops.hint("merge"), ["video_id", "_block"]).select("video_id", "seg_idx", (F.col("_top") + inside).alias(name))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations: video_id, seg_idx, text."""
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("video_id"), F.col("turn").cast("int").alias("seg_idx"), F.col("text"))


def long_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents, some of them very long: video_id, seg_idx, text."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("video_id"), F.posexplode(F.split("text", "\n")).alias("seg_idx", "text"))


def words(raw: DataFrame) -> DataFrame:
    """Words of segments (video_id, seg_idx, text): video_id, seg_idx, word_idx, word, start, end, seg_start, seg_end.

    What runs along a recording is summed over narrow rows, one a segment (see ``running``), and joined back; words are only added up inside
    a segment, so a very long recording is no single task. The narrow rows are written, so texts are parted into words once for them and once
    for the result, and both joins are of segments, before there is a row a word.
    """
    key = ["video_id", "seg_idx"]
    tokens = F.array_remove(F.split(F.trim("text"), r"\s+"), "")
    rows = raw.select("video_id", "seg_idx", tokens.alias("tokens")).where(F.size("tokens") > 0)
    counts = save(rows.select(*key, F.size("tokens").alias("n")), "word_counts")
    firsts = save(running(counts, "n", "n0"), "word_firsts")
    lengths = save(_timed(rows.join(firsts.hint("merge"), key)).groupBy(*key).agg(F.sum(F.col("dur") + F.col("gap")).alias("length"), F.max_by("gap", "word_idx").alias("rest")), "segment_lengths")
    based = running(lengths, "length", "base").join(lengths.hint("merge"), key).join(firsts.hint("merge"), key).select(*key, "n0", "base", (F.col("base") + F.col("length") - F.col("rest")).alias("stop"))
    based = save(based, "segment_bases")
    inside = Window.partitionBy(*key).orderBy("word_idx").rowsBetween(Window.unboundedPreceding, -1)
    each = _timed(rows.join(based.hint("merge"), key), "base", "stop").withColumn("st", F.col("base") + F.coalesce(F.sum(F.col("dur") + F.col("gap")).over(inside), F.lit(0)))
    ms = lambda c: c / 1000.0
    return each.select(*key, "word_idx", "word", ms(F.col("st")).alias("start"), ms(F.col("st") + F.col("dur")).alias("end"), ms(F.col("base")).alias("seg_start"), ms(F.col("stop")).alias("seg_end"))


def _timed(placed: DataFrame, *more: str) -> DataFrame:
    """Words with their milliseconds and those of the pause after them, of segments (video_id, seg_idx, tokens, n0: words before it)."""
    each = placed.select("video_id", "seg_idx", *more, "n0", F.posexplode("tokens").alias("word_idx", "w0")).withColumn("n", F.col("n0") + F.col("word_idx"))
    n, word = F.col("n"), F.col("word")
    spoken = F.when(n % 41 == 3, "20").when(n % 41 == 4, "de").when(n % 41 == 5, "ani").when(n % 43 == 11, "you").when(n % 43 == 12, "know,")
    spoken = spoken.when(n % 47 == 13, "Știi").when((n % 53).isin(17, 18), "echo").when(n % 59 == 19, "Ana").when(n % 59 == 20, "Pop").when(n % 29 == 6, "um").when(n % 211 == 100, LONG).otherwise(F.col("w0"))
    letters = F.least(F.lit(8), F.greatest(F.lit(1), F.length(F.regexp_replace(word, r"[^\p{L}\p{N}_]+", ""))))
    dur = F.when(word == LONG, 2500).otherwise(90 + 45 * letters).cast("bigint")
    gap = F.when(word.rlike("[.!?]$"), 600 + n * 37 % 5 * 100).when(word.endswith(","), 250).when(n % 11 == 0, 800).otherwise(n * 13 % 4 * 30).cast("bigint")
    return each.withColumn("word", spoken).select("video_id", "seg_idx", *more, "word_idx", "word", dur.alias("dur"), gap.alias("gap"))


def segments(words_: DataFrame) -> DataFrame:
    """Segments of words: video_id, seg_idx, start, end, text."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_idx", "word"))), lambda r: r["word"]), " ")
    return words_.groupBy("video_id", "seg_idx").agg(F.first("seg_start").alias("start"), F.first("seg_end").alias("end"), text.alias("text"))


def _scores(names: list[str], value) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(value(d).cast("string") for d in range(len(names)))))


def window_replies(windows: DataFrame) -> DataFrame:
    """A reply per window: video_id, window_idx, reply_json. Some are missing, no JSON, no object, or have no usable scores."""
    v, k = F.col("video_id"), F.col("window_idx")
    base = (v * 31 + k * 17) % 101
    scores = _scores(list(fixed.CANDIDATE_WEIGHTS), lambda d: F.greatest(F.lit(0), F.least(F.lit(100), base + d * 5 - 15)))
    good = F.to_json(F.struct(F.concat(F.lit("Window "), k.cast("string")).alias("title"), scores.alias("scores"), F.lit("why").alias("reason")))
    odd = (v * 7 + k * 3) % 23
    bad = F.when(odd == 1, F.lit(None)).when(odd == 2, F.lit('{"title":"list","scores":[1]}')).when(odd == 3, F.lit("not json")).when(odd == 4, F.lit("[1, 2]")).when(odd == 5, F.lit('{"reason":"bare"}'))
    return windows.select("video_id", "window_idx", F.when(odd.between(1, 5), bad).otherwise(good).alias("reply_json"))


def analysis_replies(candidates: DataFrame) -> DataFrame:
    """A reply per candidate; some are no JSON or no object, some scores are missing, null or text."""
    v, c, cs = F.col("video_id"), F.col("cand_idx"), F.col("start")
    keys = list(fixed.RETENTION_WEIGHTS)
    values = []
    for d in range(8):
        own = ((v * 29 + c * 19 + d * 13) % 101).cast("string")
        values.append(F.when(v % 11 == 0, F.concat(F.lit('"'), F.lit("85"), F.lit('"'))).otherwise(own) if d == 1 else F.when(v % 7 == 0, "null").otherwise(own) if d == 2 else F.when(v % 5 == 0, None).otherwise(own) if d == 3 else own)
    scores = F.concat(F.lit("{"), F.concat_ws(",", *(F.when(x.isNotNull(), F.concat(F.lit(f'"{k}":'), x)) for k, x in zip(keys, values, strict=True))), F.lit("}"))
    roles = F.array(*map(F.lit, [*fixed.ROLES, "other"]))

    def piece(j: Column, q: Column) -> Column:
        # Variant 0 keeps two to four long pieces, variant 2 begins with a later one, the others scatter short ones.
        start = F.when(j == 0, cs + (q * 13 + v % 4)).when(j == 2, cs + (q * 16 + 20) % 36).otherwise(cs + (q * 11 + j * 7 + v) % 40) + 0.137
        end = start + F.when(j == 0, 9 + (q * 3 + v) % 4).when(j == 2, 8 + q).otherwise(1 + (q + j) % 9)
        return F.struct(start.alias("start"), end.alias("end"), F.element_at(roles, ((q + j) % 7 + 1).cast("int")).alias("role"), F.concat(F.lit("r"), q.cast("string")).alias("reason"))

    def variant(j: Column) -> Column:
        n = F.when(j == 0, 2 + v % 3).when(j == 2, 3).otherwise(10)
        pieces = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda q: piece(j, q))
        own = _scores(keys, lambda d: F.when(j == 0, 60 + (v * 7 + c * 5 + d * 11) % 41).otherwise(40 + (v * 3 + c * 11 + d * 17) % 61))
        given = F.when(((j == 0) & ((v + c) % 3 != 0)) | (j == 2), own).otherwise(F.create_map().cast("map<string,string>"))
        way = F.when((j == 1) & (v % 4 == 0), "tts").otherwise("extractive")
        return F.struct(F.concat(F.lit("v"), j.cast("string")).alias("name"), way.alias("strategy"), F.concat(F.lit("why "), j.cast("string")).alias("rationale"), given.alias("scores"), pieces.alias("segments"))

    ints = lambda n: F.sequence(F.lit(0), F.lit(n))
    kinds = F.array(*map(F.lit, ["claim", "payoff", "story"]))
    named = {"type": lambda h: F.element_at(kinds, (h % 3 + 1).cast("int")), "reason": lambda h: F.concat(F.lit("because "), h.cast("string")), "text": lambda h: F.concat(F.lit("what is w"), h.cast("string"))}

    def item(h: Column, own: list[str], k: str, w: Column) -> Column:
        start = cs + (h * 9 + v) % 40
        whole = F.struct(start.alias("start"), (start + 3 + h % 3 * 4).alias("end"), *(named[f](h).alias(f) for f in own), w.alias(k))
        return F.when(h % 6 == 5, F.lit('"note"')).otherwise(F.to_json(whole))

    listed = lambda k, w, *own: F.concat(F.lit("["), F.array_join(F.transform(ints(6), lambda h: item(h, own, k, w(h))), ","), F.lit("]"))
    proof = lambda h, i: F.struct((cs + h).alias("start"), (cs + h + 1.5 + i).alias("end"), F.concat(F.lit("said at "), i.cast("string")).alias("reason"))
    hook = lambda h: F.struct(
        F.concat(F.when((v + h) % 6 == 0, "Did you know ").otherwise(""), F.array_join(F.transform(F.sequence(F.lit(1), 4 + h * 5), lambda x: F.concat(F.lit("the w"), x.cast("string"))), " ")).alias("text"),
        F.lit("question").alias("type"),
        (h % 2 == 0).alias("generated"),
        F.when((v + h) % 5 != 0, F.transform(F.sequence(F.lit(0), (h % 2).cast("int")), lambda i: proof(h, i))).otherwise(F.array().cast("array<struct<start:double,end:double,reason:string>>")).alias("evidence"),
        F.create_map(F.lit("curiosity"), (v * 3 + h * 11) % 101, F.lit("relevance"), (v * 5 + h * 7) % 101).alias("metrics"),
        F.when(h % 2 == 1, cs + h).alias("source_start"),
        F.when(h % 2 == 1, cs + h + 2).alias("source_end"),
    )
    good = F.concat(
        F.lit('{"content_type":"podcast","scores":'), scores,
        F.lit(',"retention_anchors":'), listed("importance", lambda h: (v * 7 + h * 31) % 101, "type", "reason"),
        F.lit(',"retention_risks":'), listed("severity", lambda h: (v * 11 + h * 17) % 101, "reason"),
        F.lit(',"open_loops":'), listed("strength", lambda h: (v * 13 + h * 19) % 101, "text"),
        F.lit(',"pattern_interrupts":'), listed("importance", lambda h: (v * 17 + h * 23) % 101, "type", "reason"),
        F.lit(',"hook_variants":'), F.to_json(F.transform(ints(4), hook)),
        F.lit(',"variants":'), F.to_json(F.transform(ints(3), variant)), F.lit("}"),
    )
    return candidates.select("video_id", "cand_idx", F.when(v % 13 == 0, "not json").when(v % 17 == 0, "[1, 2]").otherwise(good).alias("reply_json"))


#: Frames of the clips: wide, upright, odd, square and small.
FRAMES = [(1920, 1080), (1080, 1920), (1279, 719), (1000, 1000), (202, 360)]


def framed(clips: DataFrame) -> DataFrame:
    """Clips (video_id, clip_idx, duration) with the size of their frames."""
    kinds = F.array(*(F.struct(F.lit(w).alias("width"), F.lit(h).alias("height")) for w, h in FRAMES))
    at = F.element_at(kinds, (F.col("video_id") % len(FRAMES) + 1).cast("int"))
    return clips.select("video_id", "clip_idx", at["width"].alias("width"), at["height"].alias("height"), "duration")


def detections(clips: DataFrame) -> DataFrame:
    """Boxes every half second: video_id, clip_idx, t, kind, box_pos, x, y, w, h."""
    v = F.col("video_id")
    rows = clips.select("video_id", "clip_idx", F.explode(F.sequence(F.lit(0), F.floor((F.col("duration") + 0.001) * 2).cast("int"))).alias("i"))
    i = F.col("i")
    x, y, s = (v * 37 + i * 29) % 1500, (v * 17 + i * 11) % 700, 80 + i % 3 * 40
    box = lambda kind, dx: F.struct(F.lit(kind).alias("kind"), (x + dx).cast("double").alias("x"), y.cast("double").alias("y"), s.cast("double").alias("w"), s.cast("double").alias("h"))
    none = F.struct(F.lit("none").alias("kind"), *(F.lit(0.0).alias(c) for c in "xywh"))
    boxes = F.array_compact(F.array(none, F.when((v + i) % 6 != 0, box("face", 0)), F.when(((v + i) % 6 != 0) & (i % 5 == 0), box("face", 200)), F.when((v + i) % 4 != 0, box("person", 50))))
    return rows.select("video_id", "clip_idx", (i * 0.5).alias("t"), F.posexplode(boxes).alias("box_pos", "b")).select("video_id", "clip_idx", "t", "b.kind", "box_pos", "b.x", "b.y", "b.w", "b.h")


def voice_audio(hooks: DataFrame) -> DataFrame:
    """The synthesised voice of each spoken hook: its length, or an error for some."""
    v = F.col("video_id")
    return hooks.select("video_id", "clip_idx", (1.0 + v % 37 / 10).alias("hook_duration"), F.when(v % 10 == 3, "synthesis failed").alias("error"))


def clip_files(clips: DataFrame) -> DataFrame:
    """The clips whose file is there."""
    return clips.where("(video_id + clip_idx) % 9 <> 0").select("video_id", "clip_idx")
