"""Column expressions; all are built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions import fixed


def clamp_score(value: Column) -> Column:
    """Text of a JSON value as an int from 0 to 100, rounded half to even; what is no number is 0, infinities are the ends."""
    text = value.cast("string")
    number = F.nanvl(F.coalesce(text.try_cast("double"), F.when(F.lower(F.trim(text)) == "true", 1.0), F.lit(0.0)), F.lit(0.0))
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), number))).cast("int")


def bounded(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low) if not isinstance(low, Column) else low, F.least(F.lit(high) if not isinstance(high, Column) else high, value))


def half_even(hundredths: Column) -> Column:
    """A whole number of hundredths as the nearest int from 0 to 100, ties to even."""
    return bounded(F.bround(hundredths / 100.0), 0.0, 100.0).cast("int")


def strip(text: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def map_score(values: Column, key: str, default: int) -> Column:
    """A score from a string map: the default where the key is missing, 0 where its value is null or no number."""
    return F.when(F.coalesce(F.map_contains_key(values, key), F.lit(False)), clamp_score(values[key])).otherwise(F.lit(default))


def json_map(text: Column) -> Column:
    """A JSON object as a map of strings (nested values as JSON text); null for anything else."""
    return F.when(F.ltrim(text).startswith("{"), F.from_json(text, "map<string,string>"))


def json_objects(text: Column, limit: int | None = None) -> Column:
    """Objects of a JSON array as array<struct<pos:int,obj:map<string,string>,body:string>>; others, and what is no array, are left out.

    ``body`` is the object's own JSON text, for what must keep its types and nesting. ``limit`` counts places of the array before anything is left out.
    """
    items = F.coalesce(F.try_variant_get(F.try_parse_json(text), "$", "array<variant>"), F.array().cast("array<variant>"))
    if limit is not None:
        items = F.slice(items, 1, limit)
    rows = F.transform(items, lambda v, i: F.struct(i.cast("int").alias("pos"), F.when(F.schema_of_variant(v).startswith("OBJECT"), F.to_json(v)).alias("body")))
    rows = F.filter(rows, lambda r: r["body"].isNotNull())
    return F.transform(rows, lambda r: F.struct(r["pos"].alias("pos"), F.from_json(r["body"], "map<string,string>").alias("obj"), r["body"].alias("body")))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Intersection of two intervals (structs with start, end) over the shorter one, which counts as 0.001 at least."""
    shared = F.greatest(F.lit(0.0), F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]))
    return shared / F.greatest(F.lit(0.001), F.least(a["end"] - a["start"], b["end"] - b["start"]))


def _plain(word: Column) -> Column:
    """Whether a word is of a to z alone. Most are, and the functions of words need no more expressions for them."""
    return word.rlike(r"^[a-z]+\z")


def pacing_token(word: Column) -> Column:
    """Lower case, without what is no letter, digit or underscore at the ends."""
    return F.when(_plain(word), word).otherwise(F.regexp_replace(F.lower(strip(word)), r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", ""))


def caption_token(word: Column) -> Column:
    """Lower case, without quotes and brackets at the ends and marks behind."""
    return F.when(_plain(word), word).otherwise(F.regexp_replace(F.lower(strip(word)), "^[\\s\"“”„'()\\[\\]{}]+|[\\s\"“”„'()\\[\\]{}.,!?;:]+$", ""))


def is_number(word: Column) -> Column:
    return F.when(_plain(word), False).otherwise(F.replace(caption_token(word), F.lit(","), F.lit(".")).rlike(r"^\d+(\.\d+)?%?$"))


def is_capitalized(word: Column) -> Column:
    bare = F.regexp_replace(word, "^[ \"'“”„()\\[\\]{}.,!?;:]+|[ \"'“”„()\\[\\]{}.,!?;:]+$", "")
    return F.when(_plain(word), False).otherwise((F.length(bare) > 1) & F.substring(bare, 1, 1).rlike(r"^\p{Lu}"))


def ends_sentence(word: Column) -> Column:
    return word.rlike("[.!?][\"']?$")


def ends_clause(word: Column) -> Column:
    return word.rlike(r"[,;:]\s*$")


def has_pause(previous_end: Column, start: Column, least: float = 0.35) -> Column:
    return start - previous_end >= least


def clean_word(word: Column) -> Column:
    return F.when(word.rlike(r"^[!-~]+\z"), word).otherwise(F.coalesce(F.replace(strip(word), F.lit("\n"), F.lit(" ")), F.lit("")))


def remove_punctuation(word: Column) -> Column:
    return F.regexp_replace(word, "[.,!?;:\"'(){}\\[\\]]", "")


def is_punctuation(word: Column) -> Column:
    return word.rlike("^[.,!?;:]+$")


def clock(seconds: Column) -> Column:
    """H:MM:SS.CC; below 0 is 0, and 100 hundredths carry."""
    s = F.greatest(F.lit(0.0), seconds)
    whole = F.floor(s)
    hundredths = F.bround((s - whole) * 100).cast("long")
    carried = whole + F.when(hundredths >= 100, 1).otherwise(0)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(F.floor(carried / 3600).cast("string"), F.lit(":"), two(F.floor(carried % 3600 / 60)), F.lit(":"), two((carried % 60).cast("long")), F.lit("."), two(F.when(hundredths >= 100, 0).otherwise(hundredths)))


def escape_caption(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(F.replace(out, F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}"))
    return F.when(text.rlike(r"[\\{}]"), out).otherwise(text)


def word_count(text: Column) -> Column:
    bare = strip(F.coalesce(text, F.lit("")))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"(?U)\s+")))


def brevity(text: Column) -> Column:
    n = word_count(text)
    return F.when(n <= 0, 0).when(n <= 8, 100).when(n <= 10, 94).when(n <= 12, 86).when(n <= 14, 70).otherwise(F.greatest(F.lit(20), 70 - (n - 14) * 8))


def weak_prefix(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).rlike("^(?:" + "|".join(fixed.WEAK_PREFIXES) + ")")


def language_of(text: Column) -> Column:
    """ro for Romanian letters or strictly more Romanian hint words, else en."""
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    hits = lambda words: sum((F.contains(padded, F.lit(f" {w} ")).cast("int") for w in words), F.lit(0))
    return F.when(padded.rlike("[ăâîșț]") | (hits(fixed.RO_HINTS) > hits(fixed.EN_HINTS)), "ro").otherwise("en")


def even(value: Column) -> Column:
    """The nearest whole number, one less if it is odd, at least 2."""
    n = F.greatest(F.lit(2), F.bround(value).cast("int"))
    return F.greatest(F.lit(2), n - n % 2)


def crop_size(width: Column, height: Column) -> tuple[Column, Column]:
    """Largest 9:16 area of a frame."""
    wide = width / height >= fixed.CROP_RATIO
    w = F.when(wide, even(height * fixed.CROP_RATIO)).otherwise(width)
    h = F.when(wide, height).otherwise(even(width / fixed.CROP_RATIO))
    return F.least(w, width).cast("int"), F.least(h, height).cast("int")


def ticks(seconds: Column) -> Column:
    """Tenths of milliseconds, so that sums do not depend on order."""
    return F.bround(seconds * 10000).cast("bigint")
