"""Perplexity scoring with an interpolated modified Kneser-Ney model of order two or three.

Counting is a Spark job. A first pass counts words. Then tasks aggregate n-grams and shuffle them by ranges of
the hash of the word that both an n-gram's history and its continuation contain: the history of a bigram, the
middle word of a trigram. So one task holds whole histories and whole continuations of its words and writes one file
of sorted hash arrays into the shared folder; a last shuffle by word brings counts and continuation counts
together. Words that are too frequent for one task ("hot", at most ``MAX_HOT``, known from the first pass) have
their n-grams dealt by the whole history instead, and their continuations by the pair, which adds up.
Scoring tasks memory-map the files and look up each chunk's distinct n-grams by binary search, so no task
holds the model.

P(w|h) = (c(hw) - D(c)) / c(h) + gamma(h) P'(w), where P' is the next lower order on continuation counts,
discounted in the same way; below it lies 1 / (V + 1), where V counts the words and the end. Pairs that begin a
text keep their counts, since nothing else can stand before them. Order three adds a row per token to the shuffle
and hash arrays of about the corpus's size.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import text as tx
from spanloom.llm.common import parts_for, save, scratch

_U = np.uint64
BEGIN, END = _U(0x243F6A8885A308D3), _U(0x13198A2E03707344)
#: Tokens a task aggregates before it writes n-grams out, and text bytes per range of histories.
BUFFER, RANGE_BYTES = 2_000_000, 8_000_000
#: Text bytes scored at once.
SCORE_BYTES = 4 << 20
#: Bits of a pair's key that come from the history, so that ranges of histories are ranges of keys.
HEAD = 20
#: Tokens from which a word is hot, and most hot words: where there would be more, the bar is higher.
HOT_TOKENS, MAX_HOT = 1_000_000, 1 << 16


def pair_key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    own = tx.mix(h * _U(0x9FB21C651E98DF25) + w)
    return (h & _U((1 << HEAD) - 1 << 64 - HEAD)) | (own >> _U(HEAD))


def gram_key(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return tx.mix(tx.mix(u * _U(0xA24BAED4963EE407) + v) + w * _U(0x9FB21C651E98DF25))


def history_key(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return tx.mix(u * _U(0xA24BAED4963EE407) + v)


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """The range that a hash belongs to; ranges are equal parts of its first bits."""
    return (((keys >> _U(32)) * _U(ranges)) >> _U(32)).astype(np.int64)


def _member(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which keys are among sorted ones."""
    if not len(among):
        return np.zeros(len(keys), bool)
    return among[np.minimum(np.searchsorted(among, keys), len(among) - 1)] == keys


def tokens_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The last word but one and the last word before each token of some rows, the tokens, the end included, and the row offsets."""
    ws = tx.words(data, at, "space")
    rows = len(at) - 1
    ends = ws.row_at[1:] + np.arange(rows)
    w = np.empty(len(ws.hashes) + rows, dtype=_U)
    is_end = np.zeros(len(w), dtype=bool)
    is_end[ends] = True
    w[is_end] = END
    w[~is_end] = ws.hashes
    row_at = np.concatenate([[0], ends + 1])
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[row_at[:-1]] = BEGIN
    u = np.empty_like(w)
    u[1:] = v[:-1]
    u[row_at[:-1]] = BEGIN
    return u, v, w, row_at


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal rows in sorted columns."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    fresh = np.ones(len(keys[0]), dtype=bool)
    fresh[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(fresh)


def _slices(starts: np.ndarray, size: int) -> list[slice]:
    return [slice(a, b) for a, b in zip(starts.tolist(), [*starts.tolist()[1:], size], strict=True)]


def _cuts(keys: np.ndarray, ranges: int) -> list[tuple[int, slice]]:
    own = range_of(keys, ranges)
    return [(int(own[s.start]), s) for s in _slices(_runs(own), len(keys))]


def _sum(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else values[:0]


def _lengths(starts: np.ndarray, size: int) -> np.ndarray:
    return np.diff(np.concatenate([starts, [size]]))


def _kinds(c: np.ndarray, heads: np.ndarray) -> list[np.ndarray]:
    """Of each history: how many of its counts are one, two and more."""
    return [_sum((c == k if k < 3 else c >= 3).astype(np.int64), heads) for k in (1, 2, 3)]


def _count_words(ranges: int):
    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        w, c = np.unique(np.concatenate(held), return_counts=True)
        rows = _cuts(w, ranges)
        return pa.record_batch([pa.array([r for r, _ in rows], pa.int32()), pa.array([w[s].tobytes() for _, s in rows], pa.binary()), pa.array([c[s].astype("<i8").tobytes() for _, s in rows], pa.binary())], names=["range", "w", "raw"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, data, at in tx.chunks(batch.column(0)):
                held.append(tokens_of(data, at)[2])
                size += len(held[-1])
                if size > BUFFER:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return run


def _merge_counts(hot_tokens: int):
    def run(group: pa.Table) -> pa.Table:
        w, c = (np.concatenate([np.frombuffer(x, t) for x in group[k].to_pylist()]) for k, t in (("w", "<u8"), ("raw", "<i8")))
        w, back = np.unique(w, return_inverse=True)
        total = np.zeros(len(w), np.int64)
        np.add.at(total, back, c)
        c, hot = total, total >= hot_tokens
        one = lambda x, t: pa.array([x], t)
        return pa.table({"range": group["range"].slice(0, 1), "w": one(w.tobytes(), pa.binary()), "raw": one(c.astype("<i8").tobytes(), pa.binary()), "n": one(int(c.sum()), pa.int64()), "v": one(len(w), pa.int64()), "hot": one(w[hot].view(np.int64), pa.list_(pa.int64())), "hot_n": one(c[hot], pa.list_(pa.int64()))})

    return run


_GRAMS = "range int, v binary, us binary, u binary, ws binary, w binary, counts binary"


def _count_grams(order: int, ranges: int, hot):
    """n-grams of order two or three, aggregated: per range v with how many u each has, u with how many w, w and counts.

    Order two has one u (0) for every v. Ranges from ``ranges`` on are those of hot words.
    """

    def flush(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        u, v, w = (np.concatenate(x) for x in zip(*held, strict=True))
        own = range_of(v, ranges)
        is_hot = _member(v, hot.value)
        by_whole = history_key(u[is_hot], v[is_hot]) if order == 3 else pair_key(v[is_hot], w[is_hot])
        own[is_hot] = ranges + range_of(tx.mix(by_whole), ranges)
        by = np.lexsort((w, u, v, own))
        own, u, v, w = own[by], u[by], v[by], w[by]
        starts = _runs(own, v, u, w)
        counts = _lengths(starts, len(w)).astype("<u4")
        own, u, v, w = own[starts], u[starts], v[starts], w[starts]
        rows = []
        for s in _slices(_runs(own), len(own)):
            vs, us, ws = v[s], u[s], w[s]
            u_at, v_at = _runs(vs, us), _runs(vs)
            us_of_v = np.diff(np.searchsorted(u_at, np.concatenate([v_at, [len(vs)]]))).astype("<u4")
            rows.append((int(own[s.start]), vs[v_at].tobytes(), us_of_v.tobytes(), us[u_at].tobytes(), _lengths(u_at, len(vs)).astype("<u4").tobytes(), ws.tobytes(), counts[s].tobytes()))
        return pa.record_batch([pa.array([x[0] for x in rows], pa.int32()), *(pa.array([x[k] for x in rows], pa.binary()) for k in range(1, 7))], names=["range", "v", "us", "u", "ws", "w", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, data, at in tx.chunks(batch.column(0)):
                u, v, w, _ = tokens_of(data, at)
                held.append((u if order == 3 else np.zeros_like(u), v, w))
                size += len(w)
                if size > BUFFER:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return run


def _narrow(values: np.ndarray) -> np.ndarray:
    """Counts in the narrowest unsigned type that holds them all."""
    top = int(values.max()) if len(values) else 0
    return values.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


def _write(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """Whole files only: written under another name, then renamed, so a repeated task does no harm.

    A file is the number of arrays, each one's length and item size (signed 64-bit), and the arrays, widest first by the caller.
    """
    os.makedirs(folder, exist_ok=True)
    own = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        f.write(np.array([len(arrays), *(x for a in arrays for x in (len(a), a.itemsize))], "<i8").tobytes())
        for a in arrays:
            f.write(a.tobytes())
            f.write(b"\0" * (-a.nbytes % 8))
    os.replace(own, f"{folder}/{name}")


_OUT = "kind int, range int, a binary, b binary, c binary"
#: Kinds of rows that tasks hand on: counts of counts by order, pairs of hot words, words' continuations, sums of hot histories.
COUNTED, PAIRS, WORDS, SUMS = 0, 1, 2, 3


def _out(rows: list[tuple]) -> pa.Table:
    types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["kind", "range", "a", "b", "c"])


def _counted(order: int, c: np.ndarray) -> tuple:
    return COUNTED, order, np.array([np.count_nonzero(c == k) for k in (1, 2, 3, 4)], "<i8").tobytes(), b"", b""


def _continued(w: np.ndarray, ranges: int) -> list[tuple]:
    """In how many different pairs each word comes second."""
    w, c = np.unique(w, return_counts=True)
    return [(WORDS, r, w[s].tobytes(), c[s].astype("<i8").tobytes(), b"") for r, s in _cuts(w, ranges)]


def _pairs_file(folder: str, name: str, v: np.ndarray, w: np.ndarray, c: np.ndarray, heads: np.ndarray | None) -> None:
    keys = pair_key(v, w)
    by = np.argsort(keys)
    arrays = [keys[by], _narrow(c[by])]
    if heads is not None:
        arrays += [v[heads], _narrow(_sum(c, heads)), *map(_narrow, _kinds(c, heads))]
    _write(folder, name, arrays)


def _merge_grams(order: int, folder: str, ranges: int):
    """One range's n-grams: its files, and what goes on to the next shuffles."""

    def run(group: pa.Table) -> pa.Table:
        tx.release()
        us_, vs_, ws_, cs_ = [], [], [], []
        for v, n_u, u, n_w, w, c in zip(*(group[k].to_pylist() for k in ("v", "us", "u", "ws", "w", "counts")), strict=True):
            n_w = np.frombuffer(n_w, "<u4")
            vs_.append(np.repeat(np.repeat(np.frombuffer(v, "<u8"), np.frombuffer(n_u, "<u4")), n_w))
            us_.append(np.repeat(np.frombuffer(u, "<u8"), n_w))
            ws_.append(np.frombuffer(w, "<u8"))
            cs_.append(np.frombuffer(c, "<u4").astype(np.int64))
        number = group["range"][0].as_py()
        del group
        u, v, w, c = (np.concatenate(x) for x in (us_, vs_, ws_, cs_))
        del us_, vs_, ws_, cs_
        rows = []
        if order == 3:
            by = np.lexsort((w, u, v))
            u, v, w, c = u[by], v[by], w[by], c[by]
            starts = _runs(v, u, w)
            c = _sum(c, starts)
            u, v, w = u[starts], v[starts], w[starts]
            rows.append(_counted(3, c))
            heads = _runs(v, u)
            keys, names = gram_key(u, v, w), history_key(u[heads], v[heads])
            by, near = np.argsort(keys), np.argsort(names)
            _write(folder, f"grams-{number}", [keys[by], names[near], _narrow(c[by]), *(_narrow(x[near]) for x in (_sum(c, heads), *_kinds(c, heads)))])
            c = np.where(v == BEGIN, c, 1)
        by = np.lexsort((w, v))
        v, w, c = v[by], w[by], c[by]
        starts = _runs(v, w)
        c = _sum(c, starts)
        v, w = v[starts], w[starts]
        if number >= ranges:
            by = np.argsort(pair_key(v, w))
            v, w, c = v[by], w[by], c[by]
            own = range_of(tx.mix(pair_key(v, w)), ranges)
            by = np.argsort(own, kind="stable")
            own, v, w, c = own[by], v[by], w[by], c[by]
            return _out(rows + [(PAIRS, int(own[s.start]), v[s].tobytes(), w[s].tobytes(), c[s].astype("<i8").tobytes()) for s in _slices(_runs(own), len(own))])
        _pairs_file(folder, f"pairs-{number}", v, w, c, _runs(v))
        return _out([*rows, _counted(2, c), *_continued(w, ranges)])

    return run


def _merge_pairs(folder: str, ranges: int):
    """Pairs of hot words: their file, words' continuations and each hot word's sums in this range."""

    def run(group: pa.Table) -> pa.Table:
        tx.release()
        number = group["range"][0].as_py()
        v, w, c = (np.concatenate([np.frombuffer(x, t) for x in group[k].to_pylist()]) for k, t in (("a", "<u8"), ("b", "<u8"), ("c", "<i8")))
        by = np.lexsort((w, v))
        v, w, c = v[by], w[by], c[by]
        starts = _runs(v, w)
        c = _sum(c, starts)
        v, w = v[starts], w[starts]
        _pairs_file(folder, f"hot-{number}", v, w, c, None)
        heads = _runs(v)
        sums = np.stack([_sum(c, heads), *_kinds(c, heads)], axis=1).astype("<i8")
        return _out([_counted(2, c), *_continued(w, ranges), (SUMS, 0, v[heads].tobytes(), sums.tobytes(), b"")])

    return run


def _merge_words(folder: str):
    """Counts and continuation counts of one range's words: their file, and its totals."""

    def run(group: pa.Table) -> pa.Table:
        tx.release()
        w, n, is_raw = [], [], []
        for kind, a, b in zip(*(group[k].to_pylist() for k in ("kind", "a", "b")), strict=True):
            w.append(np.frombuffer(a, "<u8"))
            n.append(np.frombuffer(b, "<i8"))
            is_raw.append(np.full(len(w[-1]), kind < 0))
        w, n, is_raw = map(np.concatenate, (w, n, is_raw))
        w, back = np.unique(w, return_inverse=True)
        raw, cont = (np.zeros(len(w), np.int64) for _ in range(2))
        np.add.at(raw, back[is_raw], n[is_raw])
        np.add.at(cont, back[~is_raw], n[~is_raw])
        _write(folder, f"words-{group['range'][0].as_py()}", [w, _narrow(raw), _narrow(cont)])
        kinds = [int(np.count_nonzero(cont == k)) for k in (1, 2, 3, 4)]
        return pa.table({k: pa.array([v], pa.int64()) for k, v in zip(("t", "n1", "n2", "n3", "n4"), (int(cont.sum()), *kinds), strict=True)})

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from counts of counts, kept within 0 and the count they lower."""
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
    out = []
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        out.append(min(float(k), max(0.0, k - (k + 1) * y * b / a)) if a else 0.5 * k)
    return out[0], out[1], out[2]


@dataclass
class Model:
    """Where the hash arrays lie and what else scoring needs: a few numbers, and the sums of at most ``MAX_HOT`` hot words."""

    folder: str
    order: int
    ranges: int
    tokens: int
    words: int
    types: int
    discounts: dict[int, tuple[float, float, float]]
    word_rest: float
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, _U))
    hot_sums: np.ndarray = field(default_factory=lambda: np.zeros((0, 4), np.int64))


def local(uri: str) -> str:
    """The shared folder as workers see it. Memory-mapping needs a mounted folder."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"the hash arrays are memory-mapped: {uri} must be a folder mounted on every worker")
    return uri


def _hot_words(words: DataFrame) -> np.ndarray:
    """The hot words, sorted: those of ``HOT_TOKENS`` or more, of which the ``MAX_HOT`` commonest; texts begin as often as they end."""
    listed = words.select(F.explode(F.arrays_zip("hot", "hot_n")).alias("x")).select("x.hot", "x.hot_n").orderBy(F.desc("hot_n"), "hot").limit(MAX_HOT)
    found = listed.toArrow()["hot"].to_numpy().astype(np.int64).view(_U)
    return np.sort(np.append(found, BEGIN) if END in found else found)


def train(docs: DataFrame, text_column: str = "text", order: int = 2) -> Model:
    """Counts the rows' texts (null: empty) and writes the model; an empty table gives an empty model."""
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    spark = docs.sparkSession
    texts = docs.select(F.col(text_column).cast("string").alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = parts_for(size, RANGE_BYTES)
    folder = local(scratch(spark, "model"))
    counted = "range int, w binary, raw binary, n long, v long, hot array<long>, hot_n array<long>"
    words = save(texts.mapInArrow(_count_words(ranges), "range int, w binary, raw binary").groupBy("range").applyInArrow(_merge_counts(HOT_TOKENS), counted), "words")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    hot = _hot_words(words)
    shared = spark.sparkContext.broadcast(hot)
    grams = texts.mapInArrow(_count_grams(order, ranges, shared), _GRAMS)
    merged = save(grams.groupBy("range").applyInArrow(_merge_grams(order, folder, ranges), _OUT), "grams")
    pairs = save(merged.where(F.col("kind") == PAIRS).groupBy("range").applyInArrow(_merge_pairs(folder, ranges), _OUT), "pairs") if len(hot) else merged.limit(0)
    every = merged.unionByName(pairs)
    both = every.where(F.col("kind") == WORDS).select("kind", "range", "a", "b").unionByName(words.select(F.lit(-1).alias("kind"), "range", F.col("w").alias("a"), F.col("raw").alias("b")))
    stats = save(both.groupBy("range").applyInArrow(_merge_words(folder), "t long, n1 long, n2 long, n3 long, n4 long"), "stats")
    s = stats.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in stats.columns)).first()
    four = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n1", "n2", "n3", "n4")]
    counts = every.where(F.col("kind") == COUNTED).select("range", "a").mapInArrow(_counts_of_counts, "order int, n1 long, n2 long, n3 long, n4 long").groupBy("order").agg(*four)
    kinds = {2: [0] * 4, 3: [0] * 4} | {x.order: [x.n1, x.n2, x.n3, x.n4] for x in counts.collect()}
    d = {1: discounts(s.n1, s.n2, s.n3, s.n4)} | {k: discounts(*map(int, n)) for k, n in kinds.items()}
    rest = (d[1][0] * s.n1 + d[1][1] * s.n2 + d[1][2] * (total[1] - s.n1 - s.n2)) / s.t if s.t else 1.0
    model = Model(folder, order, ranges, total[0], total[1], s.t, d, rest, hot, np.zeros((len(hot), 4), np.int64))
    sums = pairs.where(F.col("kind") == SUMS).select("a", "b").mapInArrow(_hot_sums, "w long, n1 long, n2 long, n3 long, n4 long").groupBy("w").agg(*four)
    for x in sums.toLocalIterator():  # a row a hot word
        model.hot_sums[np.searchsorted(hot, np.int64(x.w).astype(_U))] = (x.n1, x.n2, x.n3, x.n4)
    return model


def _counts_of_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """order, and how many of a range's n-grams were seen once, twice, three and four times: a row a range."""
    for batch in batches:
        n = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i8").reshape(-1, 4)
        yield pa.record_batch([batch.column(0).cast(pa.int32()), *(pa.array(n[:, k]) for k in range(4))], names=["order", "n1", "n2", "n3", "n4"])


def _hot_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each hot word of each range: its pairs there, and those seen once, twice and more often."""
    for batch in batches:
        w = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u8").view(np.int64)
        n = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i8").reshape(-1, 4)
        yield pa.record_batch([pa.array(w), *(pa.array(n[:, k]) for k in range(4))], names=["w", "n1", "n2", "n3", "n4"])


#: Files that a worker keeps mapped, at most: the corpus decides how many there are, the system how many maps a process may hold.
MAPS = 2048


class Arrays:
    """Memory-mapped look-ups in a model's files, of which the ``MAPS`` used last stay mapped."""

    def __init__(self, model: Model):
        self.model, self.maps = model, OrderedDict()

    def _map(self, name: str) -> list[np.ndarray] | None:
        if name in self.maps:
            self.maps.move_to_end(name)
        else:
            while len(self.maps) >= MAPS:
                self.maps.popitem(last=False)
            path = f"{self.model.folder}/{name}"
            if not os.path.exists(path):
                self.maps[name] = None
            else:
                raw = np.memmap(path, dtype=np.uint8, mode="r")
                n = int(raw[:8].view("<i8")[0])
                sizes = raw[8 : 8 + 16 * n].view("<i8").tolist()
                at, out = 8 + 16 * n, []
                for count, width in zip(sizes[::2], sizes[1::2], strict=True):
                    out.append(raw[at : at + count * width].view(f"<u{width}"))
                    at += count * width + -(count * width) % 8
                self.maps[name] = out
        return self.maps[name]

    def _look(self, kinds: tuple[str, ...], of: np.ndarray, keys: np.ndarray, key: int, values: list[int]) -> list[np.ndarray]:
        """For keys, the values beside them in their files, 0 where a key is missing; ``of`` counts the ranges of the first kind, then of the next."""
        out = [np.zeros(len(keys), np.int64) for _ in values]
        by = np.lexsort((keys, of))
        of, keys = of[by], keys[by]
        for s in _slices(_runs(of), len(of)):
            kind, at = divmod(int(of[s.start]), self.model.ranges)
            arrays = self._map(f"{kinds[kind]}-{at}" if len(kinds) > 1 else f"{kinds[0]}-{int(of[s.start])}")
            if arrays and len(arrays[key]):
                at = np.minimum(np.searchsorted(arrays[key], keys[s]), len(arrays[key]) - 1)
                hit = arrays[key][at] == keys[s]
                for o, v in zip(out, values, strict=True):
                    o[by[s]] = np.where(hit, arrays[v][at], 0)
        return out

    def words(self, w: np.ndarray) -> list[np.ndarray]:
        """Counts and continuation counts."""
        return self._look(("words",), range_of(w, self.model.ranges), w, 0, [1, 2])

    def pairs(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        keys, of = pair_key(v, w), range_of(v, self.model.ranges)
        hot = _member(v, self.model.hot)
        of[hot] = self.model.ranges + range_of(tx.mix(keys[hot]), self.model.ranges)
        return self._look(("pairs", "hot"), of, keys, 0, [1])[0]

    def histories(self, v: np.ndarray) -> list[np.ndarray]:
        """Sum of a word's pairs and the numbers of those seen once, twice and more often."""
        out = self._look(("pairs",), range_of(v, self.model.ranges), v, 2, [3, 4, 5, 6])
        hot = np.flatnonzero(_member(v, self.model.hot))
        sums = self.model.hot_sums[np.searchsorted(self.model.hot, v[hot])]
        for k, o in enumerate(out):
            o[hot] = sums[:, k]
        return out

    def _gram_file(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        of = range_of(v, self.model.ranges)
        hot = _member(v, self.model.hot)
        of[hot] = self.model.ranges + range_of(tx.mix(history_key(u[hot], v[hot])), self.model.ranges)
        return of

    def grams(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        return self._look(("grams",), self._gram_file(u, v), gram_key(u, v, w), 0, [2])[0]

    def pair_histories(self, u: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
        return self._look(("grams",), self._gram_file(u, v), history_key(u, v), 1, [3, 4, 5, 6])


def _less(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return c - np.array([0.0, *d])[np.minimum(c, 3)]


def _interpolated(c: np.ndarray, history: list[np.ndarray], d: tuple[float, float, float], lower: np.ndarray) -> np.ndarray:
    """A higher order's probability; the lower one's where the history was never seen."""
    total, once, twice, more = history
    with np.errstate(divide="ignore", invalid="ignore"):
        p = (_less(c, d) + (d[0] * once + d[1] * twice + d[2] * more) * lower) / total
    return np.where(total > 0, p, lower)


def score_rows(arrays: Arrays, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """n_tokens, n_known, base_score and score of each row."""
    m = arrays.model
    u, v, w, row_at = tokens_of(data, at)
    names, inverse = np.unique(np.concatenate([w, [BEGIN]]), return_inverse=True)
    raw, cont = arrays.words(names)
    w_at = inverse[:-1]
    before = np.empty_like(w_at)
    before[1:] = w_at[:-1]
    before[row_at[:-1]] = inverse[-1]
    _, first, back = np.unique(before.astype(np.int64) * len(names) + w_at, return_index=True, return_inverse=True)
    p1 = m.word_rest / (m.words + 1) + _less(cont, m.discounts[1]) / max(1, m.types)
    history = [x[before[first]] for x in arrays.histories(names)]
    p = _interpolated(arrays.pairs(v[first], w[first]), history, m.discounts[2], p1[w_at[first]])[back]
    if m.order == 3:
        _, first, back = np.unique(gram_key(u, v, w), return_index=True, return_inverse=True)
        _, pair, again = np.unique(history_key(u, v), return_index=True, return_inverse=True)
        history = [x[again[first]] for x in arrays.pair_histories(u[pair], v[pair])]
        p = _interpolated(arrays.grams(u[first], v[first], w[first]), history, m.discounts[3], p[first])[back]
    logs = np.log10(p)
    base = np.log10((raw + 1) / (m.tokens + m.words + 1))[w_at]
    known = (raw > 0)[w_at].astype(np.int64)
    starts = row_at[:-1]
    return np.diff(row_at), np.add.reduceat(known, starts), np.add.reduceat(base, starts), np.add.reduceat(logs, starts)


_open: dict[str, Arrays] = {}


def score(docs: DataFrame, model: Model, key: str = "doc_id", text_column: str = "text") -> DataFrame:
    """key, n_tokens, n_known, base_score, score (log10 probability) per row; null text is empty, the end alone.

    Rows are scored one by one, repeated ones and null keys alike; very long texts in chunks of whole texts; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model.folder not in _open:
            _open.clear()
            _open[model.folder] = Arrays(model)
        for batch in batches:
            for i, j, data, at in tx.chunks(batch.column(1), SCORE_BYTES):
                yield pa.record_batch([batch.column(0).slice(i, j - i), *map(pa.array, score_rows(_open[model.folder], data, at))], names=["key", "n_tokens", "n_known", "base_score", "score"])

    source = docs.select(F.col(key).alias("key"), F.col(text_column).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, n_tokens long, n_known long, base_score double, score double")
