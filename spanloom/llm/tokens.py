"""Token ids of text columns with a public tokenizer, at the cost of its distinct words.

The tokenizer's pre-tokenization never joins text across ASCII white space, so a text's ids are
its words' ids in order. Each Python worker keeps the ids of the words it has met in sorted numpy
arrays and asks the library only for new ones; words that it met once give way when the store is full.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import text as tx

#: Words kept per worker (about 30 bytes each): beyond it, those met in one chunk only go. The library makes an
#: object of about a thousand bytes for each word it is asked for, so it is asked for so many at a time.
CACHE_WORDS, ASK_WORDS = 1_600_000, 4_000
#: Words that a tokenizer must encode alike alone and between white space.
_PROBE = ["Ab", "9x", "don't", "é.", "(z)"]
_encoders: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Encodes chunks of rows; ``path`` is a tokenizers JSON file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        if any(ids(gap.join(_PROBE)) != [i for w in _PROBE for i in ids(w)] for gap in (" ", "\n", " \t ")):
            raise ValueError(f"{path} joins text across white space, so texts cannot be encoded word by word")
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, tx.U64)
        self.at = np.zeros(0, np.int32)
        self.size = np.zeros(0, np.int32)
        self.again = np.zeros(0, bool)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _shrink(self) -> None:
        """Drops the words that were met in one chunk only; all, where that leaves too many."""
        keep = np.flatnonzero(self.again)
        if len(keep) > CACHE_WORDS // 2:
            return self._clear()
        size = self.size[keep]
        ends = np.cumsum(size, dtype=np.int64)
        ids = self.ids[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.at[keep] - ends + size, size)]
        self.keys, self.size, self.at, self.again = self.keys[keep], size, (ends - size).astype(np.int32), np.zeros(len(keep), bool)
        self.ids, self.used = np.concatenate([ids, np.zeros(1 << 16, np.uint32)]), len(ids)

    @classmethod
    def of(cls, path: str) -> "WordEncoder":
        """This worker's encoder for ``path``."""
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        sizes, ids = [], []
        for i in range(0, len(texts), ASK_WORDS):
            found = [e.ids for e in self.tokenizer.encode_batch(texts[i : i + ASK_WORDS], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter((x for own in found for x in own), np.uint32, int(sizes[-1].sum())))
        size, new = np.concatenate(sizes), np.concatenate(ids)
        while self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(new), len(self.ids) // 4), np.uint32)])
        self.ids[self.used : self.used + len(new)] = new
        where = np.searchsorted(self.keys, keys)
        self.at = np.insert(self.at, where, (self.used + np.cumsum(size) - size).astype(np.int32))
        self.size = np.insert(self.size, where, size.astype(np.int32))
        self.again = np.insert(self.again, where, False)
        self.keys = np.insert(self.keys, where, keys)
        self.used += len(new)

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids in a row, and the ids of each row's end: offsets of length rows + 1."""
        ws = tx.words(data, at, "space", fold=False)
        if not len(ws.hashes):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        keys, first, inverse = np.unique(ws.hashes, return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_WORDS:
            self._shrink()
        spot = np.searchsorted(self.keys, keys)
        known = spot < len(self.keys)
        known[known] = self.keys[spot[known]] == keys[known]
        self.again[spot[known]] = True
        if not known.all():
            self._learn(keys[~known], [ws.text(i) for i in first[~known].tolist()])
            spot = np.searchsorted(self.keys, keys)
        size, start = self.size[spot][inverse].astype(np.int64), self.at[spot][inverse]
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)
        return self.ids[flat], ends[ws.row_at]


def encode_documents(path: str, batches: Iterator[pa.RecordBatch], end_id: int | None) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """For record batches whose last column is text: slices of them with each row's uint32 ids, ``end_id`` last."""
    tail = np.array([] if end_id is None else [end_id], dtype=np.uint32)
    encoder = WordEncoder.of(path)
    for batch in batches:
        for i, j, data, at in tx.chunks(batch.column(batch.num_columns - 1)):
            ids, ends = encoder.encode(data, at)
            yield batch.slice(i, j - i), [np.concatenate([ids[a:b], tail]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def crc32(ids: np.ndarray) -> int:
    """crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def id_type(path: str, end_id: int | None) -> str:
    """The narrowest little-endian unsigned type that holds the tokenizer's ids."""
    return "<u2" if max(WordEncoder.of(path).tokenizer.get_vocab_size(), end_id or 0) < 1 << 16 else "<u4"


def encoded(docs: DataFrame, path: str, end_id: int | None, doc_id: str = "doc_id", doc_text: str = "text") -> DataFrame:
    """Per input row: doc_id, n_tokens, ids_crc32 and ids (binary of ``id_type``). Null text is empty."""
    kept = id_type(path, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in encode_documents(path, batches, end_id):
            yield pa.record_batch(
                [part.column(0), pa.array([len(x) for x in rows], pa.int64()), pa.array([crc32(x) for x in rows], pa.int64()), pa.array([x.astype(kept).tobytes() for x in rows], pa.binary())],
                names=["doc_id", "n_tokens", "ids_crc32", "ids"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_crc32 long, ids binary")
