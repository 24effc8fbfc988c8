"""Packing documents into fixed-length training sequences.

Pieces are dealt to groups of bounded size. In a group best-fit decreasing makes the bins and a
swap-based local search follows: it moves documents, exchanges one for one or two for one between
underfull bins whenever the sum of squared fills grows, until the lower bound or until no bin has a step
left. All underfull bins are then dealt to groups anew and packed together, until that empties none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import parts_for, save
from spanloom.llm.text import release
from spanloom.llm.tokens import crc32, encode_documents

#: Pieces per group: bounds a task's memory and time.
GROUP_PIECES = 20_000


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins of indices. Each piece goes to the fullest bin that still holds it."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in order:
        n = lengths[i]
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(bins), capacity
            bins.append([])
        bins[b].append(i)
        by_room[room - n].append(b)
        rooms |= 1 << (room - n)
    return bins


class _Search:
    """Bins of one group under search. Only lengths matter to a step, so a bin is known by what it can give: its distinct lengths and sums of two."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.bins, self.lengths, self.capacity = [list(b) for b in bins], lengths, capacity
        self.fill = np.array([sum(lengths[i] for i in b) for b in bins], dtype=np.int64)
        self.least = -(-int(self.fill.sum()) // capacity)
        self.count = int(np.count_nonzero(self.fill))
        self.clock = 1
        self.changed = np.ones(len(bins), dtype=np.int64)  # when a bin last changed
        self.seen = np.zeros(len(bins), dtype=np.int64)  # when a bin last had no step with any other
        self.gives: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(bins)
        self._gather(self.underfull())

    def underfull(self) -> np.ndarray:
        """Bins that a step can change: a full one neither takes more nor grows fuller."""
        return np.flatnonzero((self.fill > 0) & (self.fill < self.capacity))

    def options(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """What bin ``b`` can give back: sums and how many pieces each is (none, one or two)."""
        if self.gives[b] is None:
            own = np.array([self.lengths[i] for i in self.bins[b]], dtype=np.int64)
            one, times = np.unique(own, return_counts=True)
            i, j = np.triu_indices(len(one), 1)
            two = np.unique(np.concatenate([one[i] + one[j], 2 * one[times > 1]]))
            self.gives[b] = np.concatenate([[0], one, two]), np.repeat([0, 1, 2], [1, len(one), len(two)])
        return self.gives[b]

    def _gather(self, which: np.ndarray) -> None:
        found = [self.options(b) for b in which.tolist()]
        self.owner = np.repeat(which, [len(x[0]) for x in found])
        self.back = np.concatenate([x[0] for x in found]) if found else np.zeros(0, np.int64)
        self.kind = np.concatenate([x[1] for x in found]) if found else np.zeros(0, np.int64)

    def _touch(self, b: int) -> None:
        self.clock += 1
        self.changed[b] = self.clock
        self.gives[b] = None
        live = self.owner != b
        self.owner = self.owner[live]
        self.back, self.kind = self.back[live], self.kind[live]
        if 0 < self.fill[b] < self.capacity:
            back, kind = self.options(b)
            self.owner = np.concatenate([self.owner, np.full(len(back), b)])
            self.back, self.kind = np.concatenate([self.back, back]), np.concatenate([self.kind, kind])

    def step(self, e: int) -> bool:
        """One move out of bin ``e``, or the exchange that empties it most; False if there is none with a bin changed since the last time."""
        since = 0 if self.changed[e] > self.seen[e] else self.seen[e]
        owner, back, kind = self.owner, self.back, self.kind
        if since:
            if self.clock <= since:
                return False
            near = np.flatnonzero((self.changed > since)[owner])
            owner, back, kind = owner[near], back[near], kind[near]
        mine, many = self.options(e)
        low = back + np.maximum(0, self.fill[e] - self.fill[owner])  # what is given must be more: the sum of squared fills grows
        high = back + self.capacity - self.fill[owner]
        best = (0, 0)
        for n in (1, 2):
            own = mine[many == n]
            if not len(own):
                continue
            at = np.searchsorted(own, high, side="right") - 1
            gives = own[np.maximum(at, 0)]
            ok = (at >= 0) & (gives > low) & (owner != e) & ((n == 1) | (kind == 1))
            move = ok & (kind == 0)
            rows = np.flatnonzero(move if move.any() else ok)
            if not len(rows):
                continue
            score = (gives[rows] - back[rows]) * (self.capacity + 1) + self.fill[owner[rows]]
            r = int(rows[np.argmax(score)])
            if n == 1 and move.any():
                best = (1, r)
                value = int(gives[r])
                break
            if not best[0] or gives[r] - back[r] > value - back[best[1]]:
                best = (n, r)
                value = int(gives[r])
        if not best[0]:
            self.seen[e] = self.clock
            return False
        n, r = best
        b = int(owner[r])
        out, into = self._pick(e, value, n), self._pick(b, int(back[r]), int(kind[r]))
        for here, there, pieces in ((e, b, out), (b, e, into)):
            for i in pieces:
                self.bins[here].remove(i)
            self.bins[there] += pieces
        gain = value - int(back[r])
        self.fill[e] -= gain
        self.fill[b] += gain
        self.count -= int(self.fill[e] == 0)
        self._touch(e)
        self._touch(b)
        return True

    def _pick(self, b: int, total: int, n: int) -> list[int]:
        """``n`` pieces of bin ``b`` whose lengths add up to ``total``."""
        if n == 0:
            return []
        first: dict[int, int] = {}
        for i in self.bins[b]:
            if n == 1 and self.lengths[i] == total:
                return [i]
            if n == 2 and total - self.lengths[i] in first:
                return [first[total - self.lengths[i]], i]
            first[self.lengths[i]] = i
        raise AssertionError("no such pieces")


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Empties bins by moves and exchanges that raise the sum of squared fills.

    Passes over all underfull bins, emptiest first, end at the lower bound or when one improves nothing.
    """
    s = _Search(bins, lengths, capacity)
    better = True
    while better and s.count > s.least:
        better = False
        open_ = s.underfull()
        for e in open_[np.argsort(s.fill[open_], kind="stable")].tolist():
            while 0 < s.fill[e] < capacity and s.count > s.least and s.step(e):
                better = True
    return [b for b in s.bins if b]


def _pack_group(capacity: int):
    def run(group: pa.Table) -> pa.Table:
        release()
        group = group.sort_by("piece_key")
        lengths = group["length"].to_pylist()
        bins = local_search(best_fit(lengths, capacity), lengths, capacity)
        if group["home"].null_count == 0:
            homes: dict[int, list[int]] = {}
            for i, h in enumerate(group["home"].to_pylist()):
                homes.setdefault(h, []).append(i)
            kept = local_search(list(homes.values()), lengths, capacity)
            bins = kept if len(kept) <= len(bins) else bins
        n = len(lengths)
        of, offset, full = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        for k, members in enumerate(bins):
            at = 0
            for i in members:
                of[i], offset[i] = k, at
                at += lengths[i]
            full[members] = at == capacity
        return pa.table({"piece_key": group["piece_key"], "length": group["length"], "g": group["g"], "bin": of, "offset": offset, "full": full})

    return run


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """piece_key (unique long) and length (1 to capacity) in; piece_key, sequence_id, offset out.

    Full pieces are sequences of their own. The number of groups follows the number of pieces. All underfull
    bins are dealt anew, level by level, until one group holds them or a level empties none.
    """
    whole = pieces.where(F.col("length") == capacity).select("piece_key", (F.lit(1 << 62) + F.col("piece_key")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity).select("piece_key", "length", F.lit(None).cast("long").alias("home"))
    schema = "piece_key long, length long, g int, bin long, offset long, full boolean"
    out, level, before = whole, 0, None
    while True:
        n = parts_for(rest.count(), GROUP_PIECES)
        by = F.xxhash64(F.lit(level), "home") if level else F.xxhash64("piece_key")
        dealt = rest.select("piece_key", "length", "home", F.pmod(by, F.lit(n)).cast("int").alias("g"))
        found = save(dealt.repartition(n, "g").groupBy("g").applyInArrow(_pack_group(capacity), schema), f"packed_{level}")
        found = found.withColumn("home", F.lit(level << 56) + F.col("g").cast("long") * (1 << 32) + F.col("bin"))
        totals = found.where("offset = 0").agg(F.count("*").alias("bins"), F.count(F.when(~F.col("full"), 1)).alias("open")).first()
        last = n == 1 or totals["bins"] == before
        done = found if last else found.where("full")
        out = out.unionByName(done.select("piece_key", F.col("home").alias("sequence_id"), "offset"))
        if last:
            return out
        rest, before, level = found.where("not full").select("piece_key", "length", "home"), totals["open"], level + 1


def sequences(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int | None = 1, keep_ids: bool = False, doc_id: str = "doc_id", doc_text: str = "text") -> DataFrame:
    """Documents as pieces of packed sequences.

    Returns per piece doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with
    ``keep_ids`` the piece's ids as little-endian unsigned 32-bit binary. Only documents longer than
    ``capacity`` are cut. Null text counts as empty (its end id alone); ids may be null or repeated.
    """
    fields = [("doc_id", None), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in encode_documents(tokenizer, batches, end_id):
            owner, columns = [], [[] for _ in fields[1:]]
            for r, ids in enumerate(rows):
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start : start + capacity]
                    owner.append(r)
                    for column, value in zip(columns, (piece, start, len(own), crc32(own), own.astype("<u4").tobytes() if keep_ids else None), strict=False):
                        column.append(value)
            yield pa.record_batch([part.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, f[1]) for c, f in zip(columns, fields[1:], strict=True))], names=[f[0] for f in fields])

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).cast("string").alias("text"))
    pieces = save(source.mapInArrow(cut, schema).withColumn("piece_key", F.monotonically_increasing_id()), "pieces")
    return pieces.join(pack(pieces, capacity), "piece_key").drop("piece_key")
