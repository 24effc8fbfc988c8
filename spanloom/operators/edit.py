"""Edits of candidates: proposed variants cleaned, scored, chosen and assembled into clips."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import exprs, fixed
from spanloom.operators import hooks as hook_ops
from spanloom.operators import intervals, pacing, scoring

C = ["video_id", "cand_idx"]
V = [*C, "variant_pos"]


def read_analyses(candidates: DataFrame, replies: DataFrame) -> DataFrame:
    """Candidates with their reply as map<string,string> ``top``; null where it is missing or no JSON object; ``reply_json`` stays."""
    return candidates.join(replies.hint("merge"), C, "left").withColumn("top", exprs.json_map(F.col("reply_json")))


#: Bounds of contexts that one task makes distinct.
BOUNDS = 1_500_000


def bounds_of(segments: DataFrame, words: DataFrame, contexts: DataFrame) -> DataFrame:
    """Distinct ``bound`` by ``side`` (start, end) in each context: of segments that touch it, uncut, and of words inside it.

    Hardly any bound comes twice, so rows are dealt before they are made distinct: a task that reads words holds none of them, and those that
    hold bounds are as many as the words (``words`` is a saved table, which counts for nothing) make them.
    """
    spans = contexts.select(*C, F.col("context_start").alias("start"), F.col("context_end").alias("end"))
    sides = lambda: F.array(*(F.struct(F.lit(c).alias("side"), F.col(c).alias("bound")) for c in ("start", "end")))
    whole = intervals.touching(segments.select("video_id", "start", "end"), spans).select(*C, F.explode(sides()).alias("b")).select(*C, "b.*")
    own = words.select("video_id", "seg_start", "seg_end", F.explode(sides()).alias("b")).select("video_id", "seg_start", "seg_end", "b.*").withColumn("bucket", F.floor(F.col("bound") / intervals.BUCKET))
    near = spans.withColumn("bucket", F.explode(intervals.touched(F.col("start"), F.col("end"), intervals.BUCKET)))
    inside = F.col("bound").between(F.col("start"), F.col("end")) & (F.col("seg_end") >= F.col("start")) & (F.col("seg_start") <= F.col("end"))
    inner = near.join(own.hint("merge"), ["video_id", "bucket"]).where(inside).select(*C, "side", "bound")
    n = max(words.sparkSession.sparkContext.defaultParallelism, math.ceil(2 * words.count() / BOUNDS))
    return whole.unionByName(inner).repartition(n, *C, "side", "bound").distinct()


def proposed_variants(analyses: DataFrame, limit: int = fixed.MAX_VARIANTS) -> DataFrame:
    """P5, first part: the first ``limit`` places of a reply's variants that are extractive objects."""
    rows = analyses.where(F.col("top").isNotNull()).select(*C, F.explode(exprs.json_objects(F.col("top")["variants"], limit)).alias("v")).select(*C, F.col("v.pos").alias("variant_pos"), F.col("v.obj").alias("obj"))
    return rows.where(F.lower(exprs.strip(F.coalesce(F.col("obj")["strategy"], F.lit("extractive")))) == "extractive")


def proposed_pieces(variants: DataFrame, limit: int = fixed.MAX_SEGMENTS) -> DataFrame:
    """P6, first part: the first ``limit`` places of a variant's segments with a numeric start and end."""
    rows = variants.select(*V, F.explode(exprs.json_objects(F.col("obj")["segments"], limit)).alias("s"))
    number = lambda k: F.col("s.obj")[k].try_cast("double")
    role = F.lower(exprs.strip(F.coalesce(F.col("s.obj")["role"], F.lit("bridge"))))
    out = rows.select(*V, F.col("s.pos").alias("seg_pos"), number("start").alias("start"), number("end").alias("end"), F.when(role.isin(fixed.ROLES), role).otherwise("bridge").alias("role"), exprs.strip(F.coalesce(F.col("s.obj")["reason"], F.lit(""))).alias("reason"))
    return out.where(F.col("start").isNotNull() & F.col("end").isNotNull())


def nearby_bounds(pieces: DataFrame, segments: DataFrame, words: DataFrame) -> DataFrame:
    """A11 where J3 needs it: bounds (key, variant_pos, seg_pos, side, at, bound) within reach of either end of pieces that have their context's bounds.

    Ends meet the bounds of their own second and of the two beside it, so not all bounds of a context are ever listed.
    """
    side = lambda c: F.transform(F.sequence(F.floor(F.col(c)) - 1, F.floor(F.col(c)) + 1), lambda b: F.struct(F.lit(c).alias("side"), F.col(c).alias("at"), b.alias("bucket")))
    ends = pieces.select(*V, "seg_pos", "context_start", "context_end", F.explode(F.concat(side("start"), side("end"))).alias("p")).select(*V, "seg_pos", "context_start", "context_end", "p.*")
    bound = lambda rows, low, high, inner: rows.select("video_id", F.col(low).alias("_from"), F.col(high).alias("_to"), F.lit(inner).alias("inner"), F.explode(F.array(*(F.struct(F.lit(c).alias("side"), F.col(c).alias("bound")) for c in ("start", "end")))).alias("b")).select("video_id", "_from", "_to", "inner", "b.*")
    every = bound(segments, "start", "end", False).unionByName(bound(words, "seg_start", "seg_end", True)).withColumn("bucket", F.floor("bound"))
    met = ends.join(every.hint("merge"), ["video_id", "side", "bucket"]).where((F.col("_from") <= F.col("context_end")) & (F.col("_to") >= F.col("context_start")))
    met = met.where(~F.col("inner") | F.col("bound").between(F.col("context_start"), F.col("context_end")))
    return met.where(F.abs(F.col("bound") - F.col("at")) <= fixed.SNAP_SECONDS).select(*V, "seg_pos", "side", "at", "bound")


def clean_pieces(pieces: DataFrame, contexts: DataFrame, segments: DataFrame, words: DataFrame) -> DataFrame:
    """Pieces cut to the context, snapped to bounds of its segments and words, at least 0.35 s, merged; in edit order by seg_pos."""
    rows = pieces.join(contexts.select(*C, "context_start", "context_end").hint("merge"), C)
    cut = lambda c: F.greatest(F.col("context_start"), F.least(F.col("context_end"), F.col(c)))
    rows = rows.withColumns({"start": cut("start"), "end": cut("end")})
    rows = intervals.nearest_ends(rows, nearby_bounds(rows, segments, words), [*V, "seg_pos"])
    rows = rows.where(F.col("end") - F.col("start") >= fixed.MIN_SEGMENT)
    rows = rows.select(*V, "seg_pos", F.bround("start", 3).alias("start"), F.bround("end", 3).alias("end"), "role", "reason")
    return intervals.merge_pieces(rows, V)


def variant_costs(pieces: DataFrame) -> DataFrame:
    """Duration, edit penalty and bounds of each variant's pieces."""
    w = Window.partitionBy(*V).orderBy("seg_pos")
    back = F.col("start") < F.lag("start").over(w)
    far = ~back & (F.col("start") - F.lag("end").over(w) > 20.0)
    rows = pieces.withColumn("_back", F.coalesce(back, F.lit(False))).withColumn("_far", F.coalesce(far, F.lit(False)))
    ms = F.bround(F.greatest(F.lit(0.0), F.col("end") - F.col("start")) * 1000).cast("bigint")
    penalty = F.greatest(F.lit(0).cast("bigint"), F.count("*") - 4) * 1.5 + F.count_if("_back") * 6.0 + F.count_if("_far") * 2.0
    return rows.groupBy(*V).agg((F.sum(ms) / 1000.0).alias("duration"), penalty.alias("edit_penalty"), F.min("start").alias("clip_start"), F.max("end").alias("clip_end"), F.count("*").alias("n_pieces"))


def with_original(variants: DataFrame, pieces: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Variants of an allowed length and, last, every candidate as it is (penalty 0, no scores)."""
    costs = variant_costs(pieces)
    ok = costs.where((F.col("duration") >= fixed.MIN_CLIP * 0.65) & (F.col("duration") <= fixed.MAX_CLIP * 1.20))
    named = variants.select(*V, F.coalesce(F.col("obj")["name"], F.concat(F.lit("variant_"), (F.col("variant_pos") + 1).cast("string"))).alias("name"), exprs.strip(F.coalesce(F.col("obj")["rationale"], F.lit(""))).alias("rationale"), exprs.json_map(F.col("obj")["scores"]).alias("raw_scores"))
    kept = named.join(ok.hint("merge"), V)
    last = F.lit(1000).alias("variant_pos")
    whole = F.bround(F.greatest(F.lit(0.0), F.col("end") - F.col("start")), 3)
    own = candidates.select(*C, last, F.lit("original_fallback").alias("name"), F.lit("original candidate").alias("rationale"), F.lit(None).cast("map<string,string>").alias("raw_scores"), whole.alias("duration"), F.lit(0.0).alias("edit_penalty"), F.col("start").alias("clip_start"), F.col("end").alias("clip_end"), F.lit(1).cast("bigint").alias("n_pieces"))
    own_pieces = candidates.select(*C, last, F.lit(0).alias("seg_pos"), "start", "end", F.lit("escalation").alias("role"), F.lit("original_candidate").alias("reason"))
    return kept.unionByName(own), pieces.join(ok.select(*V).hint("merge"), V, "left_semi").unionByName(own_pieces)


def evaluate(variants: DataFrame, pieces: DataFrame, words: DataFrame, analyses: DataFrame) -> DataFrame:
    """Variants with their pacing, scores and retention_score; without own scores the reply's count."""
    measured = pacing.of_edits(words, pieces, V).select(*V, "pacing_score", "information_density_proxy", "word_count")
    base = analyses.select(*C, exprs.json_map(F.col("top")["scores"]).alias("base"))
    rows = variants.join(measured.hint("merge"), V, "left").join(base.hint("merge"), C, "left")
    empty = F.create_map().cast("map<string,string>")
    raw = F.when(F.size(F.coalesce("raw_scores", empty)) > 0, F.col("raw_scores")).otherwise(F.coalesce("base", empty))
    rows = rows.withColumn("scores", scoring.retention_scores(raw, F.col("pacing_score"), F.col("information_density_proxy")))
    return rows.withColumn("retention_score", scoring.retention_score(F.col("scores"), F.col("edit_penalty"))).drop("raw_scores", "base")


def select_best(evaluated: DataFrame) -> DataFrame:
    """T4: each candidate's variant with the highest score, the first of equals."""
    best = evaluated.groupBy(*C).agg(F.max(F.struct("retention_score", (-F.col("variant_pos")).alias("place"))).alias("b"))
    return evaluated.join(best.select(*C, (-F.col("b.place")).alias("variant_pos")).hint("merge"), V)


def read_items(analyses: DataFrame, *fields: str) -> DataFrame:
    """Objects of a reply's lists (anchors, risks, loops, interrupts; all of them by default) with numeric start and end (end defaults to start).

    ``obj`` holds their fields as strings, ``item`` (a variant) as they were given, nested values included. Each reply is read once.
    """
    lists = F.array(*(F.struct(F.lit(f).alias("kind"), F.col("top")[f].alias("json")) for f in fields or ITEM_WEIGHTS))
    rows = analyses.where(F.col("top").isNotNull()).select(*C, F.explode(lists).alias("l")).select(*C, "l.kind", F.explode(exprs.json_objects(F.col("l.json"))).alias("i"))
    number = lambda k: F.col("i.obj")[k].try_cast("double")
    end = F.when(F.map_contains_key(F.col("i.obj"), "end"), number("end")).otherwise(number("start"))
    rows = rows.select(*C, "kind", F.col("i.pos").alias("pos"), number("start").alias("start"), end.alias("end"), F.col("i.obj").alias("obj"), F.parse_json("i.body").alias("item"))
    return rows.where(F.col("start").isNotNull() & F.col("end").isNotNull())


def with_measured_risks(risks: DataFrame, measured: DataFrame) -> DataFrame:
    """The reply's risks and, after them, the long pauses that were measured (``risks`` of pacing rows)."""
    rows = measured.select(*C, F.posexplode("risks").alias("pos", "r"))
    obj = F.map_from_arrays(F.array(F.lit("reason"), F.lit("severity")), F.array(F.col("r.reason"), F.col("r.severity").cast("string")))
    own = rows.select(*C, F.lit("retention_risks").alias("kind"), (F.col("pos") + 1_000_000).alias("pos"), F.col("r.start").alias("start"), F.col("r.end").alias("end"), obj.alias("obj"), F.to_variant_object("r").alias("item"))
    return risks.unionByName(own)


def retention_buckets(clips: DataFrame, anchors: DataFrame, risks: DataFrame, key: list[str], size: float = fixed.BUCKET_SECONDS) -> DataFrame:
    """The clip in pieces of ``size`` seconds, each 60 plus anchors' and less risks' shares, with a label.

    clips: key, duration. anchors and risks: key, start, end and ``weight`` (0 to 100, whole). Overlaps are
    summed as whole milliseconds times weight and divided once.
    """
    n = F.ceil((F.col("duration") - 1e-6) / size).cast("int")
    grid = clips.where((F.col("duration") > 0) & (n > 0)).select(*key, "duration", F.explode(F.sequence(F.lit(0), n - 1)).alias("bucket"))
    grid = grid.select(*key, "bucket", (F.col("bucket") * size).alias("start"), F.least(F.col("duration"), (F.col("bucket") + 1) * size).alias("end"))
    items = anchors.select(*key, "start", "end", (F.col("weight") * 45).alias("w")).unionByName(risks.select(*key, "start", "end", (F.col("weight") * -55).alias("w")))
    items = items.select(*key, F.col("start").alias("i_start"), F.col("end").alias("i_end"), "w", F.explode(intervals.touched(F.greatest(F.lit(0.0), F.col("start")), F.col("end"), size)).alias("b"))
    items = items.withColumn("bucket", F.col("b").cast("int")).drop("b")
    low, high = F.greatest("start", "i_start"), F.least("end", "i_end")
    shares = grid.join(items.hint("merge"), [*key, "bucket"]).where(high > low).groupBy(*key, "bucket").agg(F.sum(F.bround((high - low) * 1000).cast("bigint") * F.col("w").cast("bigint")).alias("mass"))
    span = F.greatest(F.lit(1).cast("bigint"), F.bround((F.col("end") - F.col("start")) * 1000).cast("bigint"))
    score = exprs.bounded(F.bround(60.0 + F.coalesce("mass", F.lit(0).cast("bigint")) / (span * 100)), 0.0, 100.0).cast("int")
    rows = grid.join(shares.hint("merge"), [*key, "bucket"], "left").withColumn("score", score)
    label = F.when(F.col("score") >= 80, "very_good").when(F.col("score") >= 65, "good").when(F.col("score") >= 45, "medium").otherwise("retention_hole")
    return rows.select(*key, "bucket", F.bround("start", 3).alias("start"), F.bround("end", 3).alias("end"), "score", label.alias("label"))


def described(items: DataFrame) -> DataFrame:
    """Items with ``weight`` (their kind's score: 50 where missing, 0 to 100) and the texts that they may have: type, reason, text; ``item`` stays, ``obj`` goes."""
    field = F.create_map(*(F.lit(x) for pair in ITEM_WEIGHTS.items() for x in pair))[F.col("kind")]
    given = F.when(F.map_contains_key("obj", field), F.struct(F.col("obj")[field].alias("score")))
    weight = F.when(given.isNotNull(), exprs.clamp_score(given["score"])).otherwise(F.lit(50))
    return items.withColumns({"weight": weight, **{k: F.col("obj")[k] for k in ITEM_TEXTS}}).drop("obj")


#: Fields of items that are texts.
ITEM_TEXTS = ["type", "reason", "text"]

#: The field of each kind of item that says how much it counts.
ITEM_WEIGHTS = {"retention_anchors": "importance", "retention_risks": "severity", "open_loops": "strength", "pattern_interrupts": "importance"}


def fallback_clips(analyses: DataFrame, reason: str = "retention_error") -> DataFrame:
    """Candidates whose reply failed, whole, scored as they were found."""
    rows = analyses.where(F.col("top").isNull())
    whole = F.bround(F.greatest(F.lit(0.0), F.col("end") - F.col("start")), 3)
    none = F.create_map().cast("map<string,int>")
    return rows.select(*C, "title", "reason", "start", "end", whole.alias("duration"), F.lit("extractive_fallback").alias("strategy"), F.lit(None).cast("string").alias("content_type"), F.lit(reason).alias("rationale"), none.alias("scores"), F.col("score").alias("retention_score"), F.lit(1).cast("bigint").alias("n_pieces"), "score")


def assemble(selected: DataFrame, analyses: DataFrame) -> DataFrame:
    """One clip per candidate - the chosen variant, or the fallback - ranked in its video (clip_idx from 1).

    ``debug_index`` is the candidate's place from 1, by which audit records are named; ``score`` is the candidate's own.
    """
    ok = selected.join(analyses.where(F.col("top").isNotNull()).select(*C, "title", "reason", "score", F.coalesce(F.col("top")["content_type"], F.lit("general")).alias("content_type")).hint("merge"), C)
    r = lambda c: F.bround(c, 3)
    clips = ok.select(*C, "title", "reason", r("clip_start").alias("start"), r("clip_end").alias("end"), r("duration").alias("duration"), F.lit("extractive").alias("strategy"), "content_type", "rationale", "scores", "retention_score", "n_pieces", "score")
    every = clips.unionByName(fallback_clips(analyses))
    order = Window.partitionBy("video_id").orderBy(F.desc("retention_score"), "cand_idx")
    return every.withColumns({"clip_idx": F.row_number().over(order), "debug_index": F.col("cand_idx") + 1})


def fallback_pieces(analyses: DataFrame, reason: str = "retention_error") -> tuple[DataFrame, DataFrame]:
    """The one segment and the one timeline entry of each fallback clip."""
    rows = analyses.where(F.col("top").isNull())
    role = F.lit("escalation").alias("role")
    segment = rows.select(*C, F.lit(0).alias("seg_pos"), "start", "end", role, F.lit(reason).alias("reason"))
    whole = F.bround(F.greatest(F.lit(0.0), F.col("end") - F.col("start")), 3)
    line = rows.select(*C, F.lit(0).alias("index"), F.lit(0).alias("seg_pos"), F.col("start").alias("source_start"), F.col("end").alias("source_end"), F.lit(0.0).alias("target_start"), whole.alias("target_end"), role)
    return segment, line


def _in_order(rows: Column, order: list[str]) -> Column:
    """An array of structs sorted by their fields ``order``."""
    place = lambda x: F.struct(*(x[c].alias(c) for c in order))
    return F.array_sort(rows, lambda a, b: F.when(place(a) < place(b), -1).when(place(a) > place(b), 1).otherwise(0))


def nested(rows: DataFrame, key: list[str], name: str, order: list[str]) -> DataFrame:
    """Per key the rows as an array of structs ``name``, in the order of ``order``; the other columns, variants and maps too, follow in theirs."""
    rest = [c for c in rows.columns if c not in key and c not in order]
    return rows.groupBy(*key).agg(_in_order(F.collect_list(F.struct(*order, *rest)), order).alias(name))


def gathered(base: DataFrame, key: list[str], parts: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """``base`` (unique by key) with each part's rows as ``nested`` makes them or, where a part has no order, its one row as a struct; null without rows.

    All parts are grouped at once. Joined one by one, each would hold a sorted table in the memory of the same task, or be broadcast whole
    where its file looks small.
    """
    own = [c for c in base.columns if c not in key]
    every = base.select(*key, F.struct(*own).alias("_base"))
    for name, (rows, order) in parts.items():
        rest = [c for c in rows.columns if c not in key and c not in order]
        every = every.unionByName(rows.select(*key, F.struct(*order, *rest).alias(name)), allowMissingColumns=True)
    listed = lambda name, order: F.when(F.count(name) > 0, _in_order(F.collect_list(name), order)) if order else F.first(name, ignorenulls=True)
    out = every.groupBy(*key).agg(F.first("_base", ignorenulls=True).alias("_base"), *(listed(name, order).alias(name) for name, (_, order) in parts.items()))
    return out.where(F.col("_base").isNotNull()).select(*key, "_base.*", *parts)


def cut_plan(clips: DataFrame, pieces: DataFrame, key: list[str], least: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """The cuts of each clip in order (n, start, duration, whole), and the rejected clips without a valid cut.

    Pieces shorter than ``least`` are left out; a clip without pieces is one cut.
    """
    rows = clips.select(*key, F.col("start").alias("cs"), F.col("end").alias("ce")).join(pieces.select(*key, "seg_pos", F.col("start").alias("s"), F.col("end").alias("e")).hint("merge"), key, "left")
    none = F.col("seg_pos").isNull()
    rows = rows.select(*key, F.coalesce("seg_pos", F.lit(0)).alias("seg_pos"), F.coalesce("s", "cs").alias("start"), F.coalesce("e", "ce").alias("end"), none.alias("whole"))
    valid = rows.where((~F.col("whole") & (F.col("end") - F.col("start") >= least)) | (F.col("whole") & (F.col("end") > F.col("start"))))
    w = Window.partitionBy(*key)
    plan = valid.withColumn("cuts", F.count("*").over(w)).withColumn("n", F.row_number().over(w.orderBy("seg_pos")))
    plan = plan.select(*key, "n", "start", F.bround(F.col("end") - F.col("start"), 4).alias("duration"), (F.col("cuts") == 1).alias("continuous"))
    return plan, clips.join(plan.select(*key).distinct().hint("merge"), key, "left_anti")


def run_summary(windows: DataFrame, candidates: DataFrame, clips: DataFrame, plan: DataFrame, voices: DataFrame | None = None, limit: int = fixed.MAX_CANDIDATES) -> DataFrame:
    """Per video windows, candidates kept, candidates past the limit, clips optimised, exported and, of ``voices``, given a spoken hook."""
    counts = [
        windows.select("video_id", "window_idx").distinct().groupBy("video_id").agg(F.count("*").alias("windows")),
        candidates.groupBy("video_id").agg(F.count("*").alias("candidates"), F.count_if(F.col("cand_idx") >= limit).alias("skipped")),
        clips.groupBy("video_id").agg(F.count("*").alias("clips")),
        plan.groupBy("video_id").agg(F.count_if(F.col("n") == 1).alias("exported")),
    ]
    if voices is not None:
        counts.append(voices.groupBy("video_id").agg(F.count_if("applied").alias("hooks_applied")))
    out = counts[0]
    for c in counts[1:]:
        out = out.join(c.hint("merge"), "video_id", "left")
    return out.fillna(0)


def hooks_of(analyses: DataFrame, contexts: DataFrame) -> DataFrame:
    """The normalised hooks of all replies."""
    return hook_ops.normalize(analyses.where(F.col("top").isNotNull()).select(*C, F.col("top")["hook_variants"].alias("hooks_json")), contexts)
