"""Document quality from line labels: a linear-chain conditional random field.

Every line is good or bad given its own features, those of its neighbours and the neighbouring labels.
Line labels are hidden: a document's label is evidence on the share of its lines that are good, so a bad line
may stand in a good document. Forward-backward marginals of "good", weighted by line length, make a document's
mean, which a logistic curve fitted on all labelled documents turns into a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import text as tx
from spanloom.llm.common import save, within_bytes
from spanloom.llm.langid import sampled

#: Learning documents per label at most (expected number; chosen by a hash of the id).
SAMPLE_PER_LABEL = 1_000
#: Bytes of text that weights are learned from, at most: features take some times as much on the driver.
SAMPLE_BYTES = 24 << 20
STEPS = 150
#: How sharply the share of good lines decides a document's label, what neighbours' features weigh beside a line's own,
#: and the penalties on weights and on label changes.
STEEPNESS, NEIGHBOUR, WEIGHT_PENALTY, CHANGE_PENALTY = 10.0, 0.15, 1e-3, 3e-2
#: Cells of the curve's histogram per unit of log odds.
CELLS = 50
#: Line features: see ``line_features``.
N_OWN = 16
_SETS = {
    "alpha": [*range(65, 91), *range(97, 123), *range(128, 256)],
    "digit": list(range(48, 58)),
    "upper": list(range(65, 91)),
    "symbol": [ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"],
    "mark": [ord(c) for c in ".,;:!?'\"-()"],
    "end": [ord(c) for c in ".!?"],
}
_MEMBER = {k: np.isin(np.arange(256), v) for k, v in _SETS.items()}


def line_features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and byte lengths of all lines, and the offsets of each row's lines. Every row has a line at least."""
    breaks = np.flatnonzero(data == 10)
    row = np.searchsorted(at, breaks, side="right") - 1
    starts = np.sort(np.concatenate([at[:-1], breaks + 1]), kind="stable")
    n = len(starts)
    line_at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(at) - 1) + 1)])
    ends = np.empty(n, np.int64)
    ends[:-1] = starts[1:]
    ends[-1] = at[-1]
    last = np.zeros(n, dtype=bool)
    last[line_at[1:] - 1] = True
    ends = np.where(last, ends, ends - 1)
    size = ends - starts
    ws = tx.words(data, np.concatenate([at[:1], at[1:]]), "space")
    first = np.searchsorted(ws.starts, starts)
    stop = np.searchsorted(ws.starts, ends)
    count = stop - first

    def share(member: np.ndarray, low: np.ndarray, high: np.ndarray, by: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(member, dtype=np.int64)])
        return (sums[high] - sums[low]) / np.maximum(by, 1)

    same = np.zeros(len(ws.hashes), dtype=bool)
    if len(same):
        same[1:] = ws.hashes[1:] == ws.hashes[:-1]
        same[first[count > 0]] = False
    line_of = np.repeat(np.arange(n), count)
    by = np.lexsort((ws.hashes, line_of))
    again = np.zeros(len(by), dtype=bool)
    if len(by):
        again[by[1:]] = (ws.hashes[by[1:]] == ws.hashes[by[:-1]]) & (line_of[by[1:]] == line_of[by[:-1]])
    length = ws.ends - ws.starts
    closes = np.zeros(n)
    opens = np.zeros(n)
    full = count > 0
    closes[full] = _MEMBER["end"][data[ws.ends[stop[full] - 1] - 1]]
    opens[full] = _MEMBER["upper"][data[ws.starts[first[full]]]] | (data[ws.starts[first[full]]] > 127)
    alone = _MEMBER["symbol"][data[ws.starts]] & (length == 1) if len(length) else np.zeros(0, bool)
    mean = share(length, first, stop, count)
    out = np.stack(
        [
            np.log1p(size) / 8,
            np.log1p(count) / 6,
            np.minimum(mean, 30) / 15,
            *(share(_MEMBER[k][data], starts, ends, size) for k in ("alpha", "digit", "upper", "symbol", "mark")),
            closes,
            opens,
            share(same, first, stop, count),
            share(again, first, stop, count),
            share(alone, first, stop, count),
            share(length > 20, first, stop, count),
            share(length <= 3, first, stop, count),
            (count == 0).astype(float),
        ],
        axis=1,
    )
    return out.astype(np.float32), size, line_at


def with_neighbours(own: np.ndarray, line_at: np.ndarray) -> np.ndarray:
    """Each line's features, those of the lines before and after it in its document, and a constant."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[line_at[:-1]] = 0
    after[line_at[1:] - 1] = 0
    return np.concatenate([own, NEIGHBOUR * before, NEIGHBOUR * after, np.ones((len(own), 1), own.dtype)], axis=1)


@dataclass
class Model:
    """A few dozen numbers: weights per label and feature, label changes, the final curve."""

    weights: np.ndarray
    changes: np.ndarray
    curve: tuple[float, float]

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return x.astype(np.float64) @ self.weights


def forward_backward(e: np.ndarray, changes: np.ndarray, line_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label marginals of all lines, summed pair marginals and each document's log partition sum.

    Documents advance together, longest first, so step t touches those with more than t lines.
    """
    sizes = np.diff(line_at)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = line_at[:-1][order], sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    live = np.searchsorted(-sizes, -np.arange(longest), side="left")
    a, b = np.empty_like(e), np.zeros_like(e)
    for t in range(longest):
        at = begin[: live[t]] + t
        a[at] = e[at] if t == 0 else e[at] + np.logaddexp(a[at - 1][:, :1] + changes[0], a[at - 1][:, 1:] + changes[1])
    for t in range(longest - 2, -1, -1):
        at = begin[: live[t + 1]] + t
        nxt = e[at + 1] + b[at + 1]
        b[at] = np.logaddexp(changes[:, 0] + nxt[:, :1], changes[:, 1] + nxt[:, 1:])
    last = line_at[1:] - 1
    z = np.logaddexp(a[last, 0], a[last, 1])
    z_of = np.repeat(z, np.diff(line_at))
    p = np.exp(a + b - z_of[:, None])
    inner = np.ones(len(e), dtype=bool)
    inner[line_at[1:] - 1] = False
    i = np.flatnonzero(inner)
    pairs = np.zeros((2, 2))
    for s in (0, 1):
        for u in (0, 1):
            pairs[s, u] = np.exp(a[i, s] + changes[s, u] + e[i + 1, u] + b[i + 1, u] - z_of[i]).sum()
    return p, pairs, z


def _document_means(p: np.ndarray, size: np.ndarray, line_at: np.ndarray) -> np.ndarray:
    weight = size + 1.0
    return np.add.reduceat(p[:, 1] * weight, line_at[:-1]) / np.add.reduceat(weight, line_at[:-1])


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _log_sigmoid(z: np.ndarray) -> np.ndarray:
    return -np.logaddexp(0, -z)


def evidence(p: np.ndarray, weight: np.ndarray, line_at: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What a document's label says for each of its lines being good (column 1), the others being as likely good as they are now.

    A label is likely if the share of good lines, by ``weight``, lies on its side of one half; once it does, it says little.
    """
    doc = np.repeat(np.arange(len(y)), np.diff(line_at))
    share = np.add.reduceat(p[:, 1] * weight, line_at[:-1])[doc]
    side = np.where(y == 1, STEEPNESS, -STEEPNESS)[doc]
    with_line, without = share + weight * (1 - p[:, 1]), share - weight * p[:, 1]
    out = np.zeros_like(p)
    out[:, 1] = _log_sigmoid(side * (with_line - 0.5)) - _log_sigmoid(side * (without - 0.5))
    return out


def fit(own: np.ndarray, size: np.ndarray, line_at: np.ndarray, y: np.ndarray) -> Model:
    """Hidden line labels by expectation and gradient steps (Adam), each document counting alike.

    The curve is that of these documents; ``train`` sets it anew from all labelled ones.
    """
    x = with_neighbours(own, line_at).astype(np.float64)
    w, c = np.zeros((x.shape[1], 2)), np.zeros((2, 2))
    weight = size + 1.0
    weight /= np.repeat(np.add.reduceat(weight, line_at[:-1]), np.diff(line_at))
    m = [np.zeros_like(w), np.zeros_like(c)]
    v = [np.zeros_like(w), np.zeros_like(c)]
    for t in range(1, STEPS + 1):
        e = x @ w
        p, pairs, _ = forward_backward(e, c, line_at)
        q, known_pairs, _ = forward_backward(e + evidence(p, weight, line_at, y), c, line_at)
        grads = [x.T @ (q - p) / len(y) - WEIGHT_PENALTY * w, (known_pairs - pairs) / len(y) - CHANGE_PENALTY * c]
        for k, (param, g) in enumerate(zip((w, c), grads, strict=True)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            param += 0.1 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    p, _, _ = forward_backward(x @ w, c, line_at)
    z = _logit(_document_means(p, size, line_at))
    return Model(w, c, curve_of(z, y, np.ones(len(y))))


def curve_of(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from log odds to labels."""
    slope, shift = 1.0, 0.0
    for _ in range(100):  # Newton steps
        q = 1 / (1 + np.exp(-(slope * z + shift)))
        s = weight * q * (1 - q) + 1e-6
        g = np.array([(weight * (y - q) * z).sum() - 0.1 * slope, (weight * (y - q)).sum()])
        h = np.array([[(s * z * z).sum() + 0.1, (s * z).sum()], [(s * z).sum(), s.sum()]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        slope, shift = slope + step[0], shift + step[1]
    return float(slope), float(shift)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", label: str = "quality") -> Model | None:
    """Learns from documents with a label 0 or 1: weights from a sample bounded by ``SAMPLE_PER_LABEL`` and ``SAMPLE_BYTES``, the curve from all. None without labels."""
    given = labels.select(F.col(label_id).alias("key"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and key is not null")
    chosen = sampled(given, F.col("y"), SAMPLE_PER_LABEL, F.col("key"))
    source = docs.select(F.col(doc_id).alias("key"), F.col(text).cast("string").alias("text"))
    rows = within_bytes(save(source.join(F.broadcast(chosen), "key").select("y", "text"), "learned"), "text", SAMPLE_BYTES)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in tx.chunks(batch.column(1)):
                own, size, line_at = line_features(data, at)
                cut = list(zip(line_at[:-1].tolist(), line_at[1:].tolist(), strict=True))
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array([own[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([size[a:b].tobytes() for a, b in cut], pa.binary())], names=["y", "x", "size"])

    found = rows.mapInArrow(features, "y int, x binary, size binary").toArrow()
    if found.num_rows == 0:
        return None
    own = np.concatenate([np.frombuffer(x, np.float32).reshape(-1, N_OWN) for x in found["x"].to_pylist()])
    size = np.concatenate([np.frombuffer(x, np.int64) for x in found["size"].to_pylist()])
    line_at = np.concatenate([[0], np.cumsum([len(x) // (4 * N_OWN) for x in found["x"].to_pylist()])])
    m = fit(own, size, line_at, found["y"].to_numpy().astype(np.int64))
    shared = docs.sparkSession.sparkContext.broadcast(m)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in tx.chunks(batch.column(1)):
                own, size, line_at = line_features(data, at)
                p, _, _ = forward_backward(shared.value.emissions(with_neighbours(own, line_at)), shared.value.changes, line_at)
                cell = np.floor(_logit(_document_means(p, size, line_at)) * CELLS).astype(np.int32)
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(cell)], names=["key", "cell"])

    # Texts stay where they are: only keys and cells meet the labels.
    scored = source.mapInArrow(cells, f"key {source.schema['key'].dataType.simpleString()}, cell int")
    table = scored.join(given, "key").groupBy("y", "cell").count().toArrow()
    y, cell, count = (table[c].to_numpy() for c in ("y", "cell", "count"))
    m.curve = curve_of((cell + 0.5) / CELLS, y, count)
    return m


def score_rows(model: Model, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's score, every line's probability to be good, and the offsets of each row's lines."""
    own, size, line_at = line_features(data, at)
    p, _, _ = forward_backward(model.emissions(with_neighbours(own, line_at)), model.changes, line_at)
    slope, shift = model.curve
    return 1 / (1 + np.exp(-(slope * _logit(_document_means(p, size, line_at)) + shift))), p[:, 1], line_at


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", lines: bool = False) -> DataFrame:
    """key and score per row, with ``lines`` also each line's probability to be good. Null and empty texts are one empty line; no model gives 0.5.

    Rows are scored one by one, repeated ones and null keys alike; a very long text is one chain of its lines; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value or Model(np.zeros((3 * N_OWN + 1, 2)), np.zeros((2, 2)), (1.0, 0.0))
        for batch in batches:
            for i, j, data, at in tx.chunks(batch.column(1)):
                value, good, line_at = score_rows(m, data, at)
                extra = [pa.ListArray.from_arrays(pa.array(line_at, pa.int32()), pa.array(good))] * lines
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(value), *extra], names=["key", "score"] + ["line_scores"] * lines)

    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, score double" + ", line_scores array<double>" * lines)
