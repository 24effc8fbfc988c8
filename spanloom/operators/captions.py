"""Captions: words grouped into short lines, and one event per word."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import exprs, fixed
from spanloom.operators import pacing

#: Fixed values of grouping: most words, longest group, shortest display, hard pause.
MAX_WORDS, MAX_SECONDS, MIN_SECONDS, HARD_PAUSE = 3, 1.85, 0.38, 0.55


def prepared(words: DataFrame, key: list[str]) -> DataFrame:
    """Input of grouping (key, place, word, start, end): cleaned, blank words left out, ends not before starts.

    ``order`` keeps the given place, by which all that follows is in order, so that a key's words are sorted once.
    """
    rows = words.withColumnRenamed("place", "order").withColumn("word", exprs.clean_word(F.col("word"))).where(F.col("word") != "")
    return rows.withColumn("end", F.greatest("start", "end")).withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("order")) - 1)


def idea_spans(words: DataFrame, key: list[str]) -> DataFrame:
    """Adds ``span``: a new one after a sentence's end or a pause of 0.55 s or more."""
    w = Window.partitionBy(*key).orderBy("order")
    cut = exprs.ends_sentence(F.lag("word").over(w)) | (F.col("start") - F.lag("end").over(w) >= HARD_PAUSE)
    rows = words.withColumn("_cut", F.when(F.coalesce(cut, F.lit(False)), 1).otherwise(0))
    return rows.withColumn("span", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut")


#: Words that a phrase is made of.
_OF_PHRASES = sorted({w for p in fixed.PHRASES for w in p.split(" ")})


def boundary_costs(words: DataFrame, key: list[str]) -> DataFrame:
    """Adds the rhythm at each word and ``cost``, that of a break after it (null at a span's end).

    Neighbours are looked up along the key's order and count where they are of the same span; a window of each span would need another sort.
    """
    w = Window.partitionBy(*key).orderBy("order")
    rows = words.withColumns({"token": exprs.caption_token(F.col("word")), "number": exprs.is_number(F.col("word")), "capital": exprs.is_capitalized(F.col("word"))})
    own = F.struct("span", "token", "number", "capital", "start", "end")
    rows = rows.withColumns({f"_w{i}": (F.lead(own, i) if i > 0 else F.lag(own, -i)).over(w) for i in range(-3, 4) if i})
    rows = rows.withColumns({f"_w{i}": F.when(F.col(f"`_w{i}`")["span"] == F.col("span"), F.col(f"`_w{i}`")) for i in range(-3, 4) if i})
    near = {i: F.col(f"`_w{i}`") if i else own for i in range(-3, 4)}
    rows = pacing.with_rates(rows, [near[i] for i in range(-3, 4)])
    tokens = {i: near[i]["token"] if i else F.col("token") for i in range(-2, 4)}
    nxt = tokens[1]
    # Only where this word and the next may both be of a phrase are the runs around them looked up.
    may = lambda t: t.isin(_OF_PHRASES) | F.contains(t, F.lit(" "))
    around = F.array(*(tokens[i] for i in range(-2, 4)))
    run = lambda r: F.array_join(F.slice(around, r["at"], r["n"]), " ", "\0")
    runs = F.array(*(F.struct(F.lit(a + 3).alias("at"), F.lit(n).alias("n")) for n in (2, 3, 4) for a in range(2 - n, 1)))
    phrase = F.when(may(F.col("token")) & may(nxt), F.exists(runs, lambda r: F.array_contains(F.array(*map(F.lit, fixed.PHRASES)), run(r)))).otherwise(False)
    named = F.col("capital") & near[1]["capital"] & ~F.col("token").isin(fixed.ENDERS) & ~nxt.isin(fixed.STARTERS)
    unit = nxt.isin(fixed.UNITS)
    counted = (F.col("number") & (unit | (nxt == "de"))) | (F.coalesce(near[-1]["number"], F.lit(False)) & (F.col("token") == "de") & unit)
    pause = F.greatest(F.lit(0.0), near[1]["start"] - F.col("end"))
    ender = F.col("token").isin(fixed.ENDERS)
    cost = (
        F.when(pause >= HARD_PAUSE, -6.0).when(pause >= 0.35, -4.0).when(pause >= 0.18, -1.8).when(pause < 0.05, 0.35).otherwise(0.0)
        + F.when(exprs.ends_sentence(F.col("word")), -7.0).when(exprs.ends_clause(F.col("word")), -2.2).otherwise(0.0)
        + F.when(ender, 3.6).otherwise(0.0)
        + F.when(nxt.isin(fixed.STARTERS), 3.0).otherwise(0.0)
        + F.when(ender & (F.length("token") <= 2), 1.0).otherwise(0.0)
    )
    rows = rows.withColumn("cost", F.when(nxt.isNull(), None).when(phrase | named | counted, 100.0).otherwise(cost))
    return rows.drop(*(f"_w{i}" for i in near), "number", "capital", "wps")


def with_group_costs(words: DataFrame, key: list[str]) -> DataFrame:
    """Adds c1, c2, c3: the cost of a group of one to three words from each word on (infinite where not allowed)."""
    w = Window.partitionBy(*key).orderBy("order")
    rows = boundary_costs(words, key)
    own = F.struct("span", "token", "end", "cost", "ideal_words", "ideal_duration", "max_duration")
    rows = rows.withColumns({"_first": F.coalesce(F.lag("span").over(w) != F.col("span"), F.lit(True)), "_w1": F.lead(own, 1).over(w), "_w2": F.lead(own, 2).over(w)})
    rows = rows.withColumns({c: F.when(F.col(c)["span"] == F.col("span"), F.col(c)) for c in ("_w1", "_w2")})
    inf = F.lit(float("inf"))
    costs = {}
    for n in (1, 2, 3):
        last = (lambda c, n=n: F.col(f"_w{n - 1}")[c] if n > 1 else F.col(c))
        d = last("end") - F.col("start")
        too_long = (d > MAX_SECONDS + 0.30) | ((d > last("max_duration")) if n > 1 else F.lit(False))
        own = F.abs(F.lit(n) - last("ideal_words")) * 1.15
        if n == 1:
            own = own + 1.15 - F.when(d >= 0.70, 0.65).otherwise(0.0) - F.when(exprs.ends_sentence(F.col("word")), 0.45).otherwise(0.0)
        own = own + F.abs(d - last("ideal_duration")) * 1.25 + F.when(d < MIN_SECONDS, (MIN_SECONDS - d) * 6.0).otherwise(0.0)
        own = own + F.when(F.col("token").isin(fixed.STARTERS) & ~F.col("_first"), 1.6).otherwise(0.0)
        after = last("cost")
        own = own + F.when(last("token").isin(fixed.ENDERS) & after.isNotNull(), 2.1).otherwise(0.0) + F.coalesce(after, F.lit(0.0))
        costs[f"c{n}"] = F.when(last("end").isNull() | too_long, inf).otherwise(own)
    return rows.withColumns(costs).drop("_first", "_w1", "_w2")


def best_split(costs: list[tuple[float, float, float]]) -> list[int]:
    """Sizes of the cheapest groups of one span; one word each if no split is allowed. Ties go to smaller groups."""
    n = len(costs)
    total, size = [math.inf] * n + [0.0], [0] * n
    for i in range(n - 1, -1, -1):
        for k in range(1, min(MAX_WORDS, n - i) + 1):
            value = costs[i][k - 1] + total[i + k]
            if value < total[i]:
                total[i], size[i] = value, k
    if n and not size[0]:
        return [1] * n
    out, i = [], 0
    while i < n:
        out.append(size[i] or 1)
        i += out[-1]
    return out


def joined_singles(groups: list[list[int]], start: list[float], end: list[float]) -> list[list[int]]:
    """Short single words join the group before them, else the one after, where length, time and pause allow."""

    def fits(a: list[int], b: list[int]) -> bool:
        return len(a) + len(b) <= MAX_WORDS and end[b[-1]] - start[a[0]] <= MAX_SECONDS and start[b[0]] - end[a[-1]] < HARD_PAUSE

    out: list[list[int]] = []
    i = 0
    while i < len(groups):
        g = groups[i]
        if len(groups) > 1 and len(g) == 1 and max(0.0, end[g[0]] - start[g[0]]) < 0.65:
            if out and fits(out[-1], g):
                out[-1] = out[-1] + g
                i += 1
                continue
            if i + 1 < len(groups) and fits(g, groups[i + 1]):
                out.append(g + groups[i + 1])
                i += 2
                continue
        out.append(g)
        i += 1
    return out


_GIVEN = ["place", "word", "start", "end", "span", "c1", "c2", "c3"]


def _sizes(table: pa.Table) -> tuple[list[int], list[int]]:
    """Sizes of the caption groups of whole keys' words, in order, and each group's number in its key."""
    first, span, start, end = (table[c].to_pylist() for c in ("place", "span", "start", "end"))
    costs = list(zip(*(table[c].to_pylist() for c in ("c1", "c2", "c3")), strict=True))
    sizes, numbers, i = [], [], 0
    while i < len(span):
        groups, j = [], i
        while j < len(span) and (j == i or first[j] != 0):
            k = j
            while k < len(span) and span[k] == span[j] and (k == i or first[k] != 0):
                k += 1
            for n in best_split(costs[j:k]):
                groups.append(list(range(j, j + n)))
                j += n
        groups = joined_singles(groups, start, end)
        sizes += map(len, groups)
        numbers += range(len(groups))
        i = j
    return sizes, numbers


def _lines(table: pa.Table) -> pa.RecordBatch:
    """One row per caption group of whole keys' words."""
    table = table.combine_chunks()
    sizes, numbers = _sizes(table)
    ends = np.cumsum([0, *sizes])
    own = pa.StructArray.from_arrays([pa.concat_arrays(table[c].chunks) for c in ("place", "word", "start", "end")], ["place", "word", "start", "end"])
    keys = table.select([c for c in table.column_names if c not in _GIVEN]).take(pa.array(ends[:-1]))
    out = keys.append_column("group_idx", pa.array(numbers, pa.int64())).append_column("words", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), own))
    return out.combine_chunks().to_batches()[0]


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Caption groups of words that come key by key in order; a key's last words may come with the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        begins = np.flatnonzero(batch.column("place").to_numpy() == 0)
        if len(begins):
            held.append(batch.slice(0, begins[-1]))
            if sum(map(len, held)):
                yield _lines(pa.Table.from_batches(held))
            held = []
            batch = batch.slice(begins[-1])
        held.append(batch)
    if sum(map(len, held)):
        yield _lines(pa.Table.from_batches(held))


def grouped_words(words: DataFrame, key: list[str]) -> DataFrame:
    """H1: caption groups of words (key, place, word, start, end): key, group_idx, words (place, word, start, end) in order.

    Costs are columns; only the recurrence runs in Python, on one clip part at a time. The costs' windows leave a key's words together and in
    order, so they are neither dealt nor sorted again.
    """
    ready = with_group_costs(idea_spans(prepared(words.select(*key, "place", "word", "start", "end"), key), key), key)
    slim = ready.sortWithinPartitions(*key, "order").select(*key, *_GIVEN)
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in key) + ", group_idx long, words array<struct<place:int,word:string,start:double,end:double>>"
    return slim.mapInArrow(_by_key, schema)


def group_words(words: DataFrame, key: list[str]) -> DataFrame:
    """H1: words (key, place, word, start, end) with their caption group: key, group_idx, place, word, start, end."""
    return grouped_words(words, key).select(*key, "group_idx", F.inline("words"))


def _captioned(groups: DataFrame, key: list[str]) -> DataFrame:
    return groups.select(*key, "group_idx", F.col("words")[0]["start"].alias("start"), F.element_at("words", -1)["end"].alias("end"), "words", F.array_join(F.transform("words", lambda w: w["word"]), " ").alias("text"))


def captions_of(words: DataFrame, key: list[str]) -> DataFrame:
    """What ``caption_groups`` makes of ``group_words``, without taking the groups apart between them."""
    return _captioned(grouped_words(words, key), key)


def caption_groups(grouped: DataFrame, key: list[str]) -> DataFrame:
    """One row per group: start, end, words (in order) and text."""
    rows = F.sort_array(F.collect_list(F.struct("place", "word", "start", "end")))
    return _captioned(grouped.groupBy(*key, "group_idx").agg(rows.alias("words")), key)


def _tagged(animation: str) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """a word plain, and as the active one: coloured, animated and reset."""
    tag = fixed.WORD_TAGS.get(animation.strip().lower(), "")
    plain = lambda w: F.concat(F.lit("{\\c" + fixed.PLAIN_COLOR + "\\fscx100\\fscy100}"), exprs.escape_caption(w["word"]))
    lit_up = lambda w: F.concat(F.lit("{\\c" + fixed.ACTIVE_COLOR + "}" + tag), exprs.escape_caption(w["word"]), F.lit(fixed.RESET_TAG))
    return plain, lit_up


def rendered(words: Column, active: Column | None, animation: str) -> Column:
    """the words of a group, the active one coloured, animated and reset; without ``active`` all plain."""
    plain, lit_up = _tagged(animation)
    if active is None:
        return F.array_join(F.transform(words, plain), " ")
    return F.array_join(F.transform(words, lambda w, i: F.when(i == active, lit_up(w)).otherwise(plain(w))), " ")


def word_events(groups: DataFrame, key: list[str], animation: str = "capcut") -> DataFrame:
    """One event per word: until the next word starts, the last until the group ends, 0.01 s at least.

    Texts are those of ``rendered``; a group's plain words are made once, not once an event.
    """
    plain, lit_up = _tagged(animation)
    starts, n = F.transform("words", lambda w: w["start"]), F.size("words")
    rows = groups.select(*key, "group_idx", F.col("end").alias("_end"), starts.alias("_starts"), F.transform("words", plain).alias("_plain"), n.alias("_n"), F.posexplode("words").alias("active_index", "w"))
    at = F.col("active_index")
    stop = F.greatest(F.col("w.end"), F.coalesce(F.get("_starts", at + 1), F.col("_end")))
    length = F.greatest(F.lit(0.01), stop - F.col("w.start"))
    text = F.concat_ws(" ", F.slice("_plain", F.lit(1), at), lit_up(F.col("w")), F.slice("_plain", at + 2, F.col("_n")))
    out = rows.select(*key, "group_idx", "active_index", F.col("w.start").alias("start"), (F.col("w.start") + length).alias("end"), F.col("w.word").alias("word"), text.alias("text"))
    return out.where(F.col("end") > F.col("start"))


def styles() -> dict[str, dict]:
    """Caption styles by name."""
    return {name: fixed.STYLE_BASE | own for name, own in fixed.STYLES.items()}


def style_of(name: str | None, overrides: dict | None = None) -> dict:
    """The style of a name (trimmed, lower case; unknown or empty: tiktok), fields of ``overrides`` replaced."""
    known = styles()
    return known.get((name or "").strip().lower(), known["tiktok"]) | (overrides or {})


def style_table(spark) -> DataFrame:
    """The styles as a table of six rows: a dimension for joins."""
    rows = [(name, *(str(s[f]) for f in fixed.STYLE_FIELDS)) for name, s in styles().items()]
    return spark.createDataFrame(rows, "style string, " + ", ".join(f"{f} string" for f in fixed.STYLE_FIELDS))


def with_style(rows: DataFrame, name: Column) -> DataFrame:
    """J10 for a column of names, by a broadcast join with the six styles."""
    table = style_table(rows.sparkSession)
    wanted = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    known = F.when(wanted.isin(list(fixed.STYLES)), wanted).otherwise("tiktok")
    return rows.withColumn("style", known).join(F.broadcast(table), "style", "left")


def header(style: dict) -> str:
    """the head of a subtitle document."""
    columns = "Name,Fontname,Fontsize,PrimaryColour,SecondaryColour,OutlineColour,BackColour,Bold,Italic,Underline,StrikeOut,ScaleX,ScaleY,Spacing,Angle,BorderStyle,Outline,Shadow,Alignment,MarginL,MarginR,MarginV,Encoding"
    order = ["font", "font_size", "primary_color", "secondary_color", "outline_color", "back_color", "bold", "italic", None, None, "scale_x", "scale_y", "spacing", "angle", "border_style", "outline", "shadow", "alignment", "margin_l", "margin_r", "margin_v", "encoding"]
    values = ",".join(["Default", *("0" if f is None else str(style[f]) for f in order)])
    events = "Layer,Start,End,Style,Name,MarginL,MarginR,MarginV,Effect,Text"
    return f"[Script Info]\nScriptType: v4.00+\nPlayResX: 1080\nPlayResY: 1920\n\n[V4+ Styles]\n\nFormat: {columns}\nStyle: {values}\n\n[Events]\n\nFormat: {events}\n"


def dialogue(events: DataFrame, animation: str = "capcut") -> DataFrame:
    """adds ``line``, an event as a subtitle line."""
    tag = fixed.LINE_TAGS.get(animation.strip().lower(), "")
    line = F.concat(F.lit("Dialogue: 0,"), exprs.clock(F.col("start")), F.lit(","), exprs.clock(F.col("end")), F.lit(",Default,,0,0,0,," + tag), F.col("text"))
    return events.withColumn("line", line)


def documents(events: DataFrame, key: list[str], order: list[str], style: dict | None = None, animation: str = "capcut") -> DataFrame:
    """One subtitle document per key, head and lines in order."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct(*order, "line"))), lambda r: r["line"])
    body = dialogue(events, animation).groupBy(*key).agg(F.array_join(rows, "\n").alias("body"))
    head = header(style or style_of("modern", fixed.STYLE_OVERRIDES))
    return body.select(*key, F.concat(F.lit(head), "body", F.lit("\n")).alias("document"))
