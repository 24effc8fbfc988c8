"""Words and n-grams of Arrow text columns as numpy arrays.

Everything works on the UTF-8 bytes of a column, so no Python string is made per word. A word's
64-bit hash is a polynomial over its bytes, taken as a difference of one running sum; an n-gram's
hash is a polynomial over its words' hashes. Hashes depend on content alone, not on the machine.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_GRAM = U64(0x9FB21C651E98DF25)
_MASK = (1 << 64) - 1


def _byte_values(fold: bool) -> np.ndarray:
    raw = [hashlib.blake2b(bytes([i]), digest_size=8).digest() for i in range(256)]
    out = np.frombuffer(b"".join(raw), dtype="<u8").copy()
    if fold:
        out[65:91] = out[97:123]
    return out


def _classes(kind: str) -> np.ndarray:
    out = np.ones(256, dtype=bool)
    if kind == "space":  # [^\x20\x09-\x0D]+
        out[[32, *range(9, 14)]] = False
    else:  # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became a-z
        out[:128] = False
        out[48:58] = out[65:91] = out[97:123] = True
    return out


FOLDED, EXACT = _byte_values(True), _byte_values(False)
WORD_BYTES = {"space": _classes("space"), "alnum": _classes("alnum")}
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES * 2)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def release() -> None:
    """Hands memory that this worker no longer uses back to the system.

    Workers live on from task to task and stage to stage; what allocators keep of each would add up.
    """
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # only some C libraries have it
    _trim = None


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads a hash over all bits."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(29))


@dataclass
class Words:
    """The words of some rows. ``row_at[i]:row_at[i+1]`` are row i's words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    row_at: np.ndarray
    sums: np.ndarray

    def beginnings(self, n: int) -> np.ndarray:
        """Hashes of the words' first n bytes; words of fewer bytes have 0."""
        stop = np.minimum(self.starts + n, len(self.data))
        h = mix((self.sums[stop] - self.sums[self.starts]) * _power(len(self.data) + 1)[1][self.starts] + U64(n))
        return np.where(self.ends - self.starts >= n, h, U64(0))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.row_at)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.row_at) - 1), self.counts)

    def text(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a text column; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``size`` bytes: first row, end row, bytes, offsets. A longer text is its own run."""
    data, at = buffers(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, side="right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j
    release()


def words(data: np.ndarray, at: np.ndarray, kind: str = "space", fold: bool = True) -> Words:
    """Words of the rows that ``at`` bounds, with their hashes."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(0, U64), np.zeros(len(at), np.int64), np.zeros(1, U64))
    inside = WORD_BYTES[kind][data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = np.diff(at) > 0
    heads, tails = at[:-1][full], at[1:][full] - 1
    first[heads] = inside[heads]
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power(n + 1)
    sums = np.empty(n + 1, dtype=U64)
    sums[0] = 0
    values = (FOLDED if fold else EXACT)[data]
    values *= up[:n]
    np.cumsum(values, out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    return Words(data, starts, ends, hashes, np.searchsorted(starts, at, side="left"), sums)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on (positions near the end are left out)."""
    size = max(0, len(hashes) - n + 1)
    out = np.zeros(size, dtype=U64)
    for i in range(n):
        out = out * _GRAM + hashes[i : i + size]
    return mix(out + U64(n))


def gram_starts(row_at: np.ndarray, n: int) -> np.ndarray:
    """True at word positions from which n words lie in one row."""
    total = int(row_at[-1])
    ok = np.zeros(max(0, total - n + 1), dtype=bool)
    counts = np.diff(row_at)
    fits = counts >= n
    edge = np.zeros(total + 1, dtype=np.int32)
    np.add.at(edge, row_at[:-1][fits], 1)
    np.add.at(edge, (row_at[1:] - n + 1)[fits], -1)
    ok[:] = np.cumsum(edge[: len(ok)]) > 0 if len(ok) else False
    return ok


def signed(h: np.ndarray) -> pa.Array:
    """Unsigned hashes as Spark longs."""
    return pa.array(h.view(np.int64))
