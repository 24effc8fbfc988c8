"""Token-id files: static range asymmetric numeral system (rANS) blocks.

All blocks share one frequency table. A block holds whole documents and interleaves ``LANES``
coders, symbol i belonging to lane i modulo LANES, so numpy steps all lanes at once. Blocks are
independent of each other; inside a block every ``CHECKPOINT`` symbols the lanes' states and the
stream position are kept, so parts of a block can be decoded apart too. A crc32 guards each block.

Block layout, little endian: magic ``SRA1``; u32 symbols, lanes, checkpoints, stream words; then per
checkpoint u32 stream position and LANES u64 states; then the u32 stream; last u32 crc32 of all before.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import parts_for, save, scratch
from spanloom.llm.tokens import crc32, encoded, id_type

LANES = 1024
CHECKPOINT = 1 << 18
BLOCK_TOKENS = 1 << 20
SHARD_TOKENS = 8 << 20
SCALE = 20
LOW = np.uint64(1 << 31)
_U = np.uint64


def quantise(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**SCALE; every symbol that occurs has at least 1."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros(len(counts), np.uint32)
    whole = 1 << SCALE
    if np.count_nonzero(counts) > whole:
        raise ValueError(f"more than {whole} symbols")
    freq = np.maximum((counts.astype(np.float64) * (whole / total)).astype(np.int64), counts > 0)
    over = int(freq.sum()) - whole
    order = np.argsort(-freq, kind="stable")
    if over < 0:
        freq[order[0]] -= over
    for s in order.tolist():
        if over <= 0:
            break
        take = min(over, int(freq[s]) - 1)
        freq[s] -= take
        over -= take
    return freq.astype(np.uint32)


class Coder:
    """Encodes and decodes blocks with one frequency table."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.base = np.concatenate([[0], np.cumsum(self.freq)])[:-1].astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray) -> bytes:
        n = len(ids)
        f, c = self.freq[ids], self.base[ids]
        state = np.full(LANES, LOW, dtype=np.uint64)
        stream: list[np.ndarray] = []
        points: list[tuple[int, np.ndarray]] = []
        words = 0
        for start in range((n - 1) // LANES * LANES, -1, -LANES) if n else ():
            own = slice(start, min(n, start + LANES))
            x = state[: own.stop - start]
            fs = f[own]
            big = x >= (fs << _U(43))
            out = x[big]
            stream.append((out & _U(0xFFFFFFFF)).astype("<u4"))
            words += len(out)
            x[big] = out >> _U(32)
            q = x // fs
            x[:] = (q << _U(SCALE)) + (x - q * fs) + c[own]
            if start % CHECKPOINT == 0:
                points.append((words, state.copy()))
        body = np.concatenate(stream[::-1]) if stream else np.zeros(0, "<u4")
        head = struct.pack("<4sIIII", b"SRA1", n, LANES, len(points), words)
        marks = b"".join(struct.pack("<I", words - at) + s.astype("<u8").tobytes() for at, s in points[::-1])
        out = head + marks + body.tobytes()
        return out + struct.pack("<I", zlib.crc32(out))

    def decode(self, block: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids of checkpoints ``first`` up to ``last`` (all, if not given)."""
        magic, n, lanes, count, words = struct.unpack_from("<4sIIII", block)
        if magic != b"SRA1" or struct.unpack_from("<I", block, len(block) - 4)[0] != zlib.crc32(memoryview(block)[:-4]):
            raise ValueError("damaged block")
        if n == 0 or first >= count:
            return np.zeros(0, np.uint32)
        stop = n if last is None else min(n, last * CHECKPOINT)
        each = 4 + 8 * lanes
        (at,) = struct.unpack_from("<I", block, 20 + first * each)
        state = np.frombuffer(block, "<u8", lanes, 24 + first * each).astype(np.uint64)
        body = np.frombuffer(block, "<u4", words, 20 + count * each).astype(np.uint64)
        begin = first * CHECKPOINT
        out = np.empty(stop - begin, dtype=np.uint32)
        mask, scale = _U((1 << SCALE) - 1), _U(SCALE)
        for start in range(begin, stop, lanes):
            size = min(n, start + lanes) - start
            x = state[:size]
            slot = x & mask
            s = self.symbol[slot]
            out[start - begin : start - begin + size] = s
            x[:] = self.freq[s] * (x >> scale) + slot - self.base[s]
            low = np.flatnonzero(x < LOW)
            x[low] = (x[low] << _U(32)) | body[at : at + len(low)]
            at += len(low)
        return out


def counts_of(ids: DataFrame, kept: str) -> DataFrame:
    """symbol, n over a table with ``ids`` (binary of type ``kept``); at most one row per vocabulary entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            own = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kept).astype(np.int64), minlength=len(total))
            own[: len(total)] += total
            total = own
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["symbol", "n"])

    return ids.select("ids").mapInArrow(run, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n"))


_BLOCK = "shard int, block int, start long, n_tokens long, doc_ids array<{0}>, sizes array<long>, payload binary"


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = 2, doc_id: str = "doc_id", doc_text: str = "text") -> None:
    """Writes ``path``/table (the frequencies) and ``path``/blocks (one row per block), documents in ascending id order.

    Shards are ranges of ids; ``start`` counts ids within the shard. Nulls sort first; equal ids keep the
    order of their length and checksum. An empty table gives no blocks.
    """
    kept = id_type(tokenizer, end_id)
    ids = save(encoded(docs, tokenizer, end_id, doc_id, doc_text), "ids")
    spark, kind = docs.sparkSession, docs.schema[doc_id].dataType.simpleString()
    found = counts_of(ids, kept).collect()  # bounded by the vocabulary
    counts = np.zeros(max((r.symbol for r in found), default=0) + 1, np.int64)
    for r in found:
        counts[r.symbol] = r.n
    freq = quantise(counts)
    spark.createDataFrame([(bytearray(freq.astype("<u4").tobytes()),)], "freq binary").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(freq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, block, start, shard = Coder(shared.value), 0, 0, 0
        held: list[tuple[object, np.ndarray]] = []

        def closed() -> pa.RecordBatch:
            ids = np.concatenate([x for _, x in held])
            return pa.record_batch([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([start]), pa.array([len(ids)]), pa.array([[k for k, _ in held]], type=pa.list_(key)), pa.array([[len(x) for _, x in held]], pa.list_(pa.int64())), pa.array([coder.encode(ids)], pa.binary())], names=["shard", "block", "start", "n_tokens", "doc_ids", "sizes", "payload"])

        n = 0
        for batch in batches:
            key = batch.column(1).type
            for s, k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = np.frombuffer(raw, kept)
                shard = s
                if held and n + len(own) > BLOCK_TOKENS:
                    yield closed()
                    held, start, block, n = [], start + n, block + 1, 0
                held.append((k, own))
                n += len(own)
        if held:
            yield closed()

    shards = parts_for(int(counts.sum()), SHARD_TOKENS)
    ranged = ids.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "n_tokens", "ids_crc32").select(F.spark_partition_id().alias("shard"), "doc_id", "ids")
    ranged.mapInArrow(run, _BLOCK.format(kind)).write.option("compression", "none").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens, ids_crc32, and with ``keep_ids`` their ids as binary. Blocks decode in parallel."""
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    freq = np.frombuffer(spark.read.parquet(f"{path}/table").first().freq, "<u4")
    shared = spark.sparkContext.broadcast(freq)
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()  # one row per 8M tokens
    before, at = {}, 0
    for r in totals:
        before[r.shard] = at
        at += r.n
    offsets = spark.sparkContext.broadcast(before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(k)[i] for k, n in enumerate(batch.schema.names)}
                coder = coder or Coder(shared.value)
                ids = coder.decode(row["payload"].as_py())
                sizes = np.array(row["sizes"].as_py(), np.int64)
                ends = np.cumsum(sizes)
                cut = [ids[b - n : b] for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                first = offsets.value[row["shard"].as_py()] + row["start"].as_py()
                columns = [row["doc_ids"].values, pa.array(first + ends - sizes), pa.array(sizes), pa.array([crc32(x) for x in cut], pa.int64())]
                yield pa.record_batch(columns + [pa.array([x.astype("<u4").tobytes() for x in cut], pa.binary())] * keep_ids, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * keep_ids)

    return blocks.select("shard", "start", "doc_ids", "sizes", "payload").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int | None = 2) -> DataFrame:
    """Writes the files into the shared folder and reads them back."""
    path = scratch(docs.sparkSession, "token_files")
    write(docs, tokenizer, path, end_id)
    return read(docs.sparkSession, path)
