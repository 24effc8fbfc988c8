"""Toxicity by a convolutional text classifier.

A word's embedding is the sum of hashed ones: its own and those of its beginnings, so that inflected and
unseen forms resemble known ones. Filters of several widths slide over the whole text and each
keeps its maximum; a linear layer on the maxima gives the probability. All of it is trained in numpy on a bounded
sample. Thresholds are calibrated by the text's predicted language on all labelled texts outside that sample, weighted to the
labels' true rates, and scores are bent so that every language's threshold lies at the same score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import langid
from spanloom.llm import text as tx
from spanloom.llm.common import save, within_bytes
from spanloom.llm.langid import sampled

#: Learning documents at most by label (expected number; chosen by a hash of the id).
SAMPLE_PER_LABEL = 2_000
#: Bytes of text that weights are learned from, at most: slots take some times as much on the driver.
SAMPLE_BYTES = 32 << 20
BITS, DEPTH = 15, 12
WIDTHS, FILTERS = (1, 2, 3), 12
REACH = max(WIDTHS) - 1
EPOCHS, BATCH = 6, 32
#: Bytes of the beginnings that have embeddings of their own.
BEGINNINGS = (3, 4, 5)
PARTS = 1 + len(BEGINNINGS)
#: The score at which a text counts as toxic in every language.
CUT = 0.3
PAD = 1 << BITS
#: Cells of a threshold's histogram per unit of log odds.
CELLS = 50


def word_slots(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedding slots of all rows' words (one row each: word and beginnings) with blanks after each row, and row offsets.

    There are twice as many blanks as a filter reaches ahead: windows may begin at the first half of them, so that an
    empty text has some and none sees the next text.
    """
    ws = tx.words(data, at, "alnum")
    row_at = ws.row_at + 2 * REACH * np.arange(len(at))
    out = np.full((int(row_at[-1]), PARTS), PAD, np.int32)
    place = np.arange(len(ws.hashes)) + 2 * REACH * ws.rows
    out[place, 0] = ws.hashes >> tx.U64(64 - BITS)
    for k, n in enumerate(BEGINNINGS, 1):
        h = ws.beginnings(n) if len(ws.hashes) else ws.hashes
        out[place, k] = np.where(h == 0, PAD, h >> tx.U64(64 - BITS))
    return out, row_at


@dataclass
class Model:
    """Embeddings and filters of fixed size, and thresholds by language index (-1: any other)."""

    embed: np.ndarray
    filters: list[np.ndarray]  # by place in the window: depth x filters, narrower filters' columns being 0
    bias: np.ndarray
    out: np.ndarray
    base: float
    languages: langid.Model
    thresholds: dict[int, float] = field(default_factory=dict)

    def maps(self, slots: np.ndarray) -> np.ndarray:
        x = self.embed[slots[:, 0]]
        for k in range(1, PARTS):
            x += self.embed[slots[:, k]]
        z = x @ self.filters[0]
        for k in range(1, len(self.filters)):
            first = k * FILTERS
            z[:-k, first:] += x[k:] @ self.filters[k][:, first:]
        return z

    def probability(self, slots: np.ndarray, row_at: np.ndarray) -> np.ndarray:
        ends = np.stack([row_at[:-1], row_at[1:] - REACH], axis=1).ravel()
        top = np.maximum.reduceat(self.maps(slots), ends, axis=0)[::2]
        return 1 / (1 + np.exp(-np.clip(np.maximum(top + self.bias, 0) @ self.out + self.base, -30, 30)))

    def language(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        if not self.languages.languages:
            return np.full(len(at) - 1, -1)
        return self.languages.predict(data, at)[0]

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        p = self.probability(*word_slots(data, at))
        return bend(p, self.language(data, at), self.thresholds)


def bend(p: np.ndarray, language: np.ndarray, thresholds: dict[int, float]) -> np.ndarray:
    """Probabilities as scores: each language's threshold becomes ``CUT``; order within a language stays."""
    t = np.full(len(p), thresholds.get(-1, 0.5))
    for k, v in thresholds.items():
        t[language == k] = v
    return np.where(p < t, p / t * CUT, CUT + (p - t) / (1 - t) * (1 - CUT))


#: Weight of the penalty on the output layer, and toxic documents that the common threshold counts like beside a language's own.
OUT_PENALTY, SHRINK = 1e-3, 8


def gradients(m: Model, masks: list[np.ndarray], slots: np.ndarray, at: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], float, np.ndarray, np.ndarray]:
    """Gradients of the mean log loss and the penalty for filters, bias and output, then the base's, and embedding rows with theirs.

    Only the places that gave a maximum have a part in it; ``masks`` say which weights of the filters are theirs.
    """
    n_f = len(m.bias)
    z = m.maps(slots)
    place = np.stack([z[a : b - REACH].argmax(axis=0) + a for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
    top = z[place, np.arange(n_f)] + m.bias
    on = np.maximum(top, 0)
    p = 1 / (1 + np.exp(-np.clip(on @ m.out + m.base, -30, 30)))
    g = ((p - y) / len(y)).astype(m.out.dtype)
    down = (g[:, None] * m.out) * (top > 0)
    grads, touched, moves = [], [], []
    for k, w in enumerate(m.filters):
        cols = np.flatnonzero(masks[k].any(axis=0))
        where = slots[place[:, cols] + k]
        d = down[:, cols]
        gw = np.zeros_like(w)
        gw[:, cols] = np.einsum("bf,bfd->df", d, m.embed[where].sum(axis=2))
        grads.append(gw)
        touched.append(where.ravel())
        moves.append(np.repeat((d[:, :, None] * w[:, cols].T[None]).reshape(-1, DEPTH), PARTS, axis=0))
    names, back = np.unique(np.concatenate(touched), return_inverse=True)
    total = np.zeros((len(names), DEPTH), m.embed.dtype)
    np.add.at(total, back, np.concatenate(moves))
    total[names == PAD] = 0
    return [*grads, down.sum(axis=0), on.T @ g + OUT_PENALTY * m.out], float(g.sum()), names, total


def fit(rows: list[np.ndarray], y: np.ndarray, languages: langid.Model) -> Model:
    """Adam for filters, row-wise Adagrad for embeddings; only the places that gave a maximum learn."""
    rng = np.random.default_rng(7)
    n_f = FILTERS * len(WIDTHS)
    filters = []
    for k in range(max(WIDTHS)):
        w = rng.normal(0, 0.4, (DEPTH, n_f)).astype(np.float32)
        for i, width in enumerate(WIDTHS):
            if k >= width:
                w[:, i * FILTERS : (i + 1) * FILTERS] = 0
        filters.append(w)
    masks = [w != 0 for w in filters]
    embed = rng.normal(0, 0.02, (PAD + 1, DEPTH)).astype(np.float32)
    embed[PAD] = 0
    out = rng.normal(0, 0.3, n_f).astype(np.float32)
    rate = max(1e-3, y.mean())
    m = Model(embed, filters, np.zeros(n_f, np.float32), out, float(np.log(rate / (1 - rate))), languages)
    dense = [*filters, m.bias, m.out]
    first, second = [np.zeros_like(d) for d in dense], [np.zeros_like(d) for d in dense]
    seen = np.full(PAD + 1, 1e-4, np.float32)
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), BATCH):
            own = order[i : i + BATCH]
            slots = np.concatenate([rows[r] for r in own])
            at = np.concatenate([[0], np.cumsum([len(rows[r]) for r in own])])
            grads, base, names, total = gradients(m, masks, slots, at, y[own])
            step += 1
            for k, (param, grad) in enumerate(zip(dense, grads, strict=True)):
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.99 * second[k] + 0.01 * grad * grad
                param -= 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
            m.base -= 0.05 * base
            seen[names] += (total * total).mean(axis=1)
            embed[names] -= 0.1 * total / np.sqrt(seen[names])[:, None]
    return m


def best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> float:
    """The middle of the widest-scoring cut: the threshold with the best F1, halfway to the next value in log odds."""
    weight = np.ones(len(p)) if weight is None else weight
    p, back = np.unique(np.clip(p, 1e-6, 1 - 1e-6), return_inverse=True)
    hits = np.cumsum(np.bincount(back, weight * y)[::-1])
    f1 = 2 * hits / (np.cumsum(np.bincount(back, weight)[::-1]) + hits[-1])
    i = int(np.argmax(f1))
    odds = np.log(p / (1 - p))[::-1]
    low = odds[i + 1] if i + 1 < len(p) else odds[i] - 2
    return float(np.clip(1 / (1 + np.exp(-(odds[i] + low) / 2)), 0.02, 0.98))


def learned(given: DataFrame) -> DataFrame:
    """The labelled documents (key, y) that weights are learned from."""
    return sampled(given, F.col("y"), SAMPLE_PER_LABEL, F.col("key")).where(F.pmod(F.xxhash64("key", F.lit(5)), F.lit(5)) != 0)


def train(docs: DataFrame, labels: DataFrame, languages: langid.Model, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", label: str = "toxic") -> Model | None:
    """Learns from a sample of documents with a label 0 or 1, bounded by ``SAMPLE_PER_LABEL`` and ``SAMPLE_BYTES``; all labelled documents it did not learn from set the thresholds. None without both labels."""
    given = labels.select(F.col(label_id).alias("key"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and key is not null")
    chosen = learned(given)
    source = docs.select(F.col(doc_id).alias("key"), F.col(text).cast("string").alias("text"))
    rows = within_bytes(save(source.join(F.broadcast(chosen), "key"), "learned"), "text", SAMPLE_BYTES)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in tx.chunks(batch.column(2)):
                slots, row_at = word_slots(data, at)
                own = [slots[a:b].tobytes() for a, b in zip(row_at[:-1].tolist(), row_at[1:].tolist(), strict=True)]
                yield pa.record_batch([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(own, pa.binary())], names=["order", "y", "x"])

    found = rows.select(F.xxhash64("key").alias("order"), "y", "text").mapInArrow(features, "order long, y int, x binary").toArrow().sort_by("order")
    y = found["y"].to_numpy().astype(np.float32)
    if not 0 < y.sum() < len(y):
        return None
    m = fit([np.frombuffer(v, np.int32).reshape(-1, PARTS) for v in found["x"].to_pylist()], y, languages)
    del found
    shared = docs.sparkSession.sparkContext.broadcast(m)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in tx.chunks(batch.column(1), 1 << 18):
                p = np.clip(shared.value.probability(*word_slots(data, at)).astype(np.float64), 1e-6, 1 - 1e-6)
                cell = np.floor(np.log(p / (1 - p)) * CELLS).astype(np.int32)
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(shared.value.language(data, at), pa.int64()), pa.array(cell)], names=["key", "lang", "cell"])

    # Texts stay where they are: only keys and cells meet the labels.
    unseen = given.join(F.broadcast(chosen.select("key")), "key", "left_anti")
    scored = source.mapInArrow(cells, f"key {source.schema['key'].dataType.simpleString()}, lang long, cell int")
    table = scored.join(unseen, "key").groupBy("lang", "y", "cell").count().toArrow()
    total = {r["y"]: r["count"] for r in given.groupBy("y").count().collect()}
    set_thresholds(m, *(table[c].to_numpy() for c in ("lang", "y", "cell", "count")), total)
    return m


def set_thresholds(m: Model, lang: np.ndarray, y: np.ndarray, cell: np.ndarray, count: np.ndarray, total: dict[int, int]) -> None:
    """Thresholds of all languages and of each from counts by language, label and cell of log odds; ``total`` are the labels' true counts.

    A language's own threshold and the common one are averaged in log odds, by its number of toxic documents and ``SHRINK``.
    """
    p = 1 / (1 + np.exp(-(cell + 0.5) / CELLS))
    weight = count * np.where(y == 1, total.get(1, 0) / max(1, count[y == 1].sum()), total.get(0, 0) / max(1, count[y == 0].sum()))
    if not (y == 1).any():
        return
    odds = lambda t: np.log(t / (1 - t))
    m.thresholds[-1] = best_threshold(p, y, weight)
    for k in set(lang.tolist()):
        own = lang == k
        if n := int(count[own & (y == 1)].sum()):
            z = (n * odds(best_threshold(p[own], y[own], weight[own])) + SHRINK * odds(m.thresholds[-1])) / (n + SHRINK)
            m.thresholds[k] = float(1 / (1 + np.exp(-z)))


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score per row; null text is empty; 0 without a model.

    Rows are scored one by one, repeated ones and null keys alike, very long texts whole; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for i, j, data, at in tx.chunks(batch.column(1), 1 << 18):
                value = m.score(data, at) if m else np.zeros(j - i)
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(np.asarray(value, np.float64))], names=["key", "score"])

    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, score double")
