"""Benchmark decontamination by winnowing.

Every k-gram of words is hashed, and of each run of w consecutive k-grams the smallest hash is kept
(the last of equals). Two texts that share a span of at least w + k - 1 words keep a common
fingerprint inside it, so joining fingerprints and extending each match word by word finds every
shared window of that length. Test items shorter than a window are looked up whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm import text as tx
from spanloom.llm.common import Rows, save

#: Bits of the filter that drops document fingerprints no test item has. Fixed, so its broadcast is 2 MB.
FILTER_BITS = 24

_MATCH = "array<struct<size:int,fp:long,pos:long,before:array<string>,after:array<string>>>"
_MATCH_ARROW = pa.list_(pa.struct([("size", pa.int32()), ("fp", pa.int64()), ("pos", pa.int64()), ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))]))


def winnow(hashes: np.ndarray, fits: np.ndarray, w: int) -> np.ndarray:
    """Positions kept: of each w consecutive hashes the smallest, the last of equals. ``fits``: window starts."""
    starts = np.flatnonzero(fits)
    if not len(starts):
        return starts
    best, at = hashes[starts], np.zeros(len(starts), dtype=np.int64)
    for i in range(1, w):
        h = hashes[starts + i]
        lower = h <= best
        best = np.where(lower, h, best)
        at[lower] = i
    return np.unique(starts + at)


def _fingerprints(window: int, sizes: list[int], whole: bool, bits: np.ndarray | None):
    """mapInArrow function: key and text in, key, number of words and fingerprints with their surroundings out."""
    k = window // 2
    w = window - k + 1

    def kept(fp: np.ndarray) -> np.ndarray:
        slot = fp >> tx.U64(64 - FILTER_BITS)
        return (bits[(slot >> tx.U64(3)).astype(np.int64)] >> (slot & tx.U64(7)).astype(np.uint8)) & 1 == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in tx.chunks(batch.column(1)):
                ws = tx.words(data, at, "alnum")
                rows, counts = ws.rows, ws.counts
                found: list[list[dict]] = [[] for _ in range(j - i)]

                def add(positions: np.ndarray, fps: np.ndarray, size: int, k: int, found=found, rows=rows, ws=ws) -> None:
                    for p, fp in zip(positions.tolist(), fps.view(np.int64).tolist(), strict=True):
                        r = int(rows[p])
                        lo, hi = max(int(ws.row_at[r]), p - (window - k)), min(int(ws.row_at[r + 1]), p + window)
                        if size < window:
                            lo, hi = p, p + size
                        word = [ws.text(q).translate(_LOWER) for q in range(lo, hi)]
                        found[r].append({"size": size, "fp": fp, "pos": p - int(ws.row_at[r]), "before": word[: p - lo][::-1], "after": word[p - lo :]})

                h = tx.grams(ws.hashes, k)
                spots = winnow(h, tx.gram_starts(ws.row_at, window), w)
                fps = h[spots]
                if bits is not None:
                    ok = kept(fps)
                    spots, fps = spots[ok], fps[ok]
                add(spots, fps, window, k)
                for size in sizes:
                    h, fits = tx.grams(ws.hashes, size), tx.gram_starts(ws.row_at, size)
                    if whole:
                        fits &= (counts == size)[rows[: len(fits)]]
                    if bits is not None:
                        fits &= kept(h)
                    spots = np.flatnonzero(fits)
                    add(spots, h[spots], size, size)
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(counts), pa.array(found, type=_MATCH_ARROW)], names=["key", "n_words", "matches"])

    return run


_LOWER = {i: i + 32 for i in range(65, 91)}


def _run_length(a: str, b: str):
    """How many leading elements two arrays share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0)))
    first = F.array_position(same, 0)
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("long")


def matches(docs: DataFrame, items: DataFrame, window: int = 10, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Spans of test items inside documents.

    Returns (rows, hits). rows: row_key, doc_id, n_words - one per input row, repeated ids included.
    hits: row_key, item_id, start, end (word positions, end excluded), every span a run of whole
    shared windows. Null or wordless texts have no hits; ids may be null or repeated.
    """
    spark = docs.sparkSession
    source = items.select(F.col(item_id).cast("string").alias("key"), F.col(item_text).cast("string").alias("text"))
    prints = source.mapInArrow(_fingerprints(window, list(range(1, window)), True, None), f"key string, n_words long, matches {_MATCH}")
    prints = save(prints.select("key", F.explode("matches").alias("m")).select(F.col("key").alias("item_id"), "m.*"), "test_prints")
    slot = f"shiftrightunsigned(fp, {64 - FILTER_BITS})"
    words = prints.select(F.expr(f"shiftright({slot}, 3)").alias("i"), F.expr(f"shiftleft(1, cast({slot} & 7 as int))").alias("b")).groupBy("i").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
    bits[words["i"].to_numpy()] = words["b"].to_numpy()
    sizes = sorted(r["size"] for r in prints.where(F.col("size") < window).select("size").distinct().collect())

    shared = spark.sparkContext.broadcast(bits)
    rows = docs.select(F.monotonically_increasing_id().alias("row_key"), F.col(doc_id).alias("doc_id"), F.col(doc_text).cast("string").alias("text"))
    keyed = rows.select(F.struct("row_key", "doc_id").alias("key"), "text")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _fingerprints(window, sizes, False, shared.value)(batches)

    kind = docs.schema[doc_id].dataType.simpleString()
    base = save(keyed.mapInArrow(search, f"key struct<row_key:long,doc_id:{kind}>, n_words long, matches {_MATCH}").select("key.*", "n_words", "matches"), "document_prints")
    mine = base.where(F.size("matches") > 0).select("row_key", F.explode("matches").alias("m")).select("row_key", F.col("m.size").alias("size"), F.col("m.fp").alias("fp"), "m.pos", F.col("m.before").alias("d_before"), F.col("m.after").alias("d_after"))
    theirs = prints.select("item_id", "size", "fp", F.col("before").alias("i_before"), F.col("after").alias("i_after"))
    joined = mine.join(theirs, ["size", "fp"]).select("row_key", "item_id", "size", "pos", _run_length("d_before", "i_before").alias("left"), _run_length("d_after", "i_after").alias("right"))
    enough = F.when(F.col("size") < window, F.col("right") >= F.col("size")).otherwise((F.col("right") >= window // 2) & (F.col("left") + F.col("right") >= window))
    hits = joined.where(enough).select("row_key", "item_id", (F.col("pos") - F.col("left")).alias("start"), (F.col("pos") + F.col("right")).alias("end"))
    return base.select("row_key", "doc_id", "n_words"), hits


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, **columns: str) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside a shared window), n_items, items_sha256, contaminated.

    One row per input row, repeated ones and null ids included. Null, empty and wordless texts have no words and no hits; very long texts
    are searched whole. Items that repeat an id are one item; those without text match nothing. An empty table gives no rows, an empty test set no hits.
    """
    rows, hits = matches(docs, items, window, **columns)
    hits = save(hits, "hits")
    # Spans in order: each adds what lies behind the furthest end before it.
    along = Window.partitionBy("row_key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0).cast("long"), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(along), "start")))
    n_hit = hits.select("row_key", "start", "end").distinct().withColumn("new", new).groupBy("row_key").agg(F.sum("new").alias("n_hit"))
    listed = hits.select("row_key", "item_id").distinct().groupBy("row_key").agg(F.count("*").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("item_id"))), 256).alias("items_sha256"))
    zero = F.lit(0).cast("long")
    return rows.join(n_hit, "row_key", "left").join(listed, "row_key", "left").select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", zero).alias("n_hit"),
        F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10, doc_id: str = "doc_id", **columns: str) -> DataFrame:
    """Documents without a shared window; all columns stay. Rows with a null id are judged like others of that id."""
    bad = contamination(docs, items, window, doc_id=doc_id, **columns).where("contaminated").select(F.col("doc_id").alias("bad")).distinct()
    rows = Rows(docs)
    return rows.back(rows.df.join(save(bad, "contaminated"), rows.col(doc_id).eqNullSafe(F.col("bad")), "left_anti"))
